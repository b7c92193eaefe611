"""Queries of Naive Bayes, calibration, information, clusters, funds and the query language."""

from __future__ import annotations

from pyspark.sql import functions as F

from presage.functions.analysis import stated_terms, terms_sql
from presage.operators import bayes, information, lift, ranking
from presage.operators.count_store import CountStore, fitted
from presage.operators.staging import materialize, new_path
from presage.plans.core import CLASSES, FEATURES, FIRMS_SQL, FOLDS, LONG_SQL, PRESENT_SQL, firms, query, rounded, table
from presage.plans.facade import Engine, Gateway, predicted, response
from presage.sources import sinks

_NAMES = "['" + "', '".join(CLASSES) + "']"

def _cv_sql(long: str, folds: str = "[0, 1, 2, 3, 4]") -> str:
    """Held-out probabilities p(id, cls, c, p, r) over the rows u(id, fold, cls, field, value) of `long`: every fold trained on the others."""
    return f"""{long}, c as (select unnest({_NAMES}) as c), k as (select unnest({folds}) as k),
  cell as (select fold, field, value, cls, count(*) as n from u group by all),
  grid as (select k.k, d.field, d.value, c.c, sum(case when cell.cls = c.c and cell.fold <> k.k then cell.n else 0 end) as n
    from (select distinct field, value from u) d, k, c, cell where cell.field = d.field and cell.value = d.value group by all),
  nc as (select k.k, c.c, sum((f.cls = c.c and f.fold <> k.k)::int) as n from k, c, firms f group by all),
  v as (select k, field, count(*) as v from (select k, field, value from grid group by all having sum(n) > 0) group by all),
  ll as (select g.k, g.field, g.value, g.c, ln((g.n + 1.0::double) / (nc.n + v.v + 1)) as ll from grid g join nc on nc.k = g.k and nc.c = g.c join v on v.k = g.k and v.field = g.field),
  prior as (select k, c, ln((n + 1.0::double) / (sum(n) over (partition by k) + 5)) as lp from nc),
  each as (select u.id, u.fold, u.cls, u.field, ll.c, ll.ll from u join ll on ll.k = u.fold and ll.field = u.field and ll.value = u.value),
  s as (select e.id, e.cls, e.c, sum(e.ll) + min(p.lp) as s from each e join prior p on p.k = e.fold and p.c = e.c group by all),
  x as (select *, exp(s - max(s) over (partition by id)) as e from s),
  p as (select id, cls, c, e / sum(e) over (partition by id) as p, cast(c[1] as int) - 1 as r from x)"""


_CV_SQL = _cv_sql(f"{FIRMS_SQL}, {LONG_SQL}")

_JUDGED_SQL = f"""{_CV_SQL}, j as (select id, cls, cast(cls[1] as int) - 1 as t, max(p) as conf, arg_max(r, (round(p, 12), -r)) as pred, max(p) filter (where c = cls) as pt,
  sum(p) filter (where r <= 1) as good, sum(power(p - (c = cls)::int, 2)) as b from p group by all)"""


def _scored(spark, sf_dir):
    return bayes.cross_validate(firms(spark, sf_dir), FEATURES, CLASSES, FOLDS)


@query("nb_cv", f"with {_CV_SQL} select id, c, round(p, 6) as p from p")
def nb_cv(spark, sf_dir):
    return rounded(bayes.long(_scored(spark, sf_dir), CLASSES), "p")


@query("nb_predict", f"with {_CV_SQL} select id, c, round(p, 6) as p from p where id in (select id from firms where fold = 0)")
def nb_predict(spark, sf_dir):
    f = firms(spark, sf_dir)
    return rounded(bayes.long(bayes.predict(f.where("fold <> 0"), f.where("fold = 0"), FEATURES, CLASSES), CLASSES), "p")


@query(
    "nb_binary",
    f"""with {FIRMS_SQL}, {LONG_SQL}, f as (select id, rank = 0 as y from firms), l as (select u.field, u.value, sum(y::int) as a, sum((not y)::int) as b from u join f using (id) group by all),
        n as (select sum(y::int) as a, sum((not y)::int) as b, count(*) as t from f), v as (select field, count(*) as v from l group by 1),
        s as (select u.id, sum(ln((l.a + 1.0::double) / (n.a + v.v + 1))) + min(ln((n.a + 1.0::double) / (n.t + 2))) as sa, sum(ln((l.b + 1.0::double) / (n.b + v.v + 1))) + min(ln((n.b + 1.0::double) / (n.t + 2))) as sb
          from u join l using (field, value) join v using (field), n group by 1)
        select id, round(1 / (1 + exp(sb - sa)), 6) as p from s""",
)
def nb_binary(spark, sf_dir):
    f = firms(spark, sf_dir).withColumn("cls", F.when(F.col("rank") == 0, "yes").otherwise("no"))
    return bayes.predict(f, f, FEATURES, ["yes", "no"]).select("id", F.round(F.col("p")[0], 6).alias("p"))


@query(
    "nb_explain",
    f"""with {FIRMS_SQL}, {LONG_SQL}, c as (select unnest({_NAMES}) as c), l as (select field, value, c.c, sum((cls = c.c)::int) as n, count(*) as t from u, c group by all),
        n as (select c.c, sum((f.cls = c.c)::int) as n, count(*) as t from c, firms f group by 1), v as (select field, count(distinct value) as v from l group by 1),
        e as (select l.field, l.value, l.c, (l.n + 1.0::double) / (n.n + v.v + 1) / (l.t / n.t) as lift from l join n on n.c = l.c join v using (field))
        select u.id, e.c, u.field, u.value, round(e.lift, 6) as lift from u join e using (field, value) """,
)
def nb_explain(spark, sf_dir):
    f = firms(spark, sf_dir)
    return rounded(bayes.explain(f, f, FEATURES, CLASSES), "lift")


@query(
    "nb_metrics",
    f"""with {_JUDGED_SQL}, e as (select sum(abs(c - h)) as e from (select greatest(0, ceil(conf * 10) - 1) as bin, sum(conf) as c, sum((pred = t)::int) as h from j group by 1))
        select count(*) as n, round(avg(-ln(greatest(pt, 1e-12))), 6) as logloss, round(avg((pred = t)::int), 6) as accuracy, round(avg(conf), 6) as mean_conf, round(avg(conf) - avg((pred = t)::int), 6) as overconfidence,
          round(avg(good) - avg((t <= 1)::int), 6) as optimism, round(avg(b), 6) as brier, round(min(e.e) / count(*), 6) as ece from j, e""",
)
def nb_metrics(spark, sf_dir):
    m = bayes.metrics(_scored(spark, sf_dir), CLASSES, CLASSES[:2])
    return rounded(m, *[c for c in m.columns if c != "n"])


@query(
    "info_gain",
    f"""with {_JUDGED_SQL}, m as (select cls, count(*) as m, row_number() over (order by count(*) desc, cls) - 1 as br from j group by 1),
        r as (select p.id, sum((p.p > j.pt)::int) as r from p join j using (id) group by 1), h as (select sum(-m::double / t * log2(m::double / t)) as h, max(m) / max(t) as ba, sum(br * m) / max(t) as bmr from m, (select count(*) as t from j)),
        a as (select count(*) as n, avg((pred = t)::int) as acc, avg(-log2(greatest(pt, 1e-12))) as x from j)
        select n, round(acc, 6) as accuracy, round(ba, 6) as base_accuracy, round(h - x, 6) as info_gain, round(power(2, h - x), 6) as geom_mean_lift, round((select avg(r) from r), 6) as mean_rank, round(bmr, 6) as base_mean_rank from a, h""",
)
def info_gain(spark, sf_dir):
    m = bayes.evaluate(_scored(spark, sf_dir), CLASSES)
    m = m.select("n", "accuracy", "base_accuracy", "info_gain", "geom_mean_lift", "mean_rank", "base_mean_rank")
    return rounded(m, *[c for c in m.columns if c != "n"])


@query(
    "reliability_bins",
    f"""with {_JUDGED_SQL} select cast(greatest(0, ceil(conf * 10) - 1) as int) as bin, count(*) as n, round(avg(conf), 6) as mean_conf, round(avg((pred = t)::int), 6) as accuracy, round(avg(conf) - avg((pred = t)::int), 6) as gap from j group by 1""",
)
def reliability_bins(spark, sf_dir):
    j = bayes.judged(_scored(spark, sf_dir), CLASSES).withColumn("hit", F.col("true_rank") == F.col("pred_rank"))
    return rounded(ranking.reliability(j, "conf", "hit"), "mean_conf", "accuracy", "gap")


@query(
    "calibration_deciles",
    f"""with {_CV_SQL}, r as (select id, p, (cls = c)::int as hit, row_number() over (order by round(p, 9), id) - 1 as r, count(*) over () as n from p where r = 0)
        select cast(least(9, floor(r / greatest(1, n // 10))) as int) as bin, count(*) as n, round(avg(p), 6) as predicted, round(avg(hit), 6) as actual from r group by 1""",
)
def calibration_deciles(spark, sf_dir):
    s = _scored(spark, sf_dir).select("id", F.round(F.col("p")[0], 9).alias("p"), (F.col("cls") == CLASSES[0]).alias("hit"))
    return rounded(ranking.calibration(s, "p", "hit", "id"), "predicted", "actual")


@query("brier", f"with {_CV_SQL} select count(*) as n, round(avg(power(p - (cls = c)::int, 2)), 6) as brier from p where r = 0")
def brier(spark, sf_dir):
    s = _scored(spark, sf_dir).select(F.col("p")[0].alias("p"), (F.col("cls") == CLASSES[0]).alias("hit"))
    return rounded(ranking.brier(s, "p", "hit"), "brier")


_ORDER = ["region", "segment", "size", "status"]


@query(
    "feature_sweep",
    f"""with {_CV_SQL}, sw as (select z.k, e.id, e.cls, e.c, sum(e.ll) + min(q.lp) as s from each e join prior q on q.k = e.fold and q.c = e.c, (select unnest([1, 2, 4]) as k) z
          where list_position(['{"', '".join(_ORDER)}'], e.field) <= z.k group by all),
        sx as (select *, exp(s - max(s) over (partition by k, id)) as e from sw), sp as (select k, id, cls, c, e / sum(e) over (partition by k, id) as p from sx)
        select k, count(*) as n, round(avg(-ln(greatest(pt, 1e-12))), 6) as logloss, round(avg((top = cls)::int), 6) as accuracy
        from (select k, id, cls, max(p) filter (where c = cls) as pt, arg_max(c, (round(p, 12), -cast(c[1] as int))) as top from sp group by all) group by 1""",
)
def feature_sweep(spark, sf_dir):
    out = bayes.prefix_scores(firms(spark, sf_dir), _ORDER, CLASSES, FOLDS, [1, 2, 4])
    return rounded(out, "logloss", "accuracy")


#: Held-out log loss of each single feature, and of the class shares.
_SINGLE_SQL = f"""{_CV_SQL}, one as (select e.id, e.cls, e.field, e.c, e.ll + q.lp as s from each e join prior q on q.k = e.fold and q.c = e.c),
  ox as (select *, exp(s - max(s) over (partition by id, field)) as e from one), op as (select *, e / sum(e) over (partition by id, field) as p from ox),
  base as (select avg(-q.lp + ln(z.z)) as b from firms f join prior q on q.k = f.fold and q.c = f.cls join (select k, sum(exp(lp)) as z from prior group by 1) z on z.k = f.fold),
  ranked as (select field, count(*) as n, avg(-ln(greatest(p, 1e-12))) as logloss, min(b) - avg(-ln(greatest(p, 1e-12))) as gain from op, base where c = cls group by 1)"""


@query("feature_rank", f"with {_SINGLE_SQL} select field, n, round(logloss, 6) as logloss, round(gain, 6) as gain from ranked")
def feature_rank(spark, sf_dir):
    """Features by what each alone gains on held-out rows, from one count table."""
    return rounded(bayes.rank_features(firms(spark, sf_dir), FEATURES, CLASSES, FOLDS), "logloss", "gain")


@query(
    "ranked_sweep",
    f"""with {_SINGLE_SQL}, pl as (select field, row_number() over (order by gain desc, field) as place from ranked),
        sw as (select z.k, e.id, e.cls, e.c, sum(e.ll) + min(q.lp) as s from each e join prior q on q.k = e.fold and q.c = e.c join pl using (field), (select unnest([1, 2, 3, 4]) as k) z where pl.place <= z.k group by all),
        sx as (select *, exp(s - max(s) over (partition by k, id)) as e from sw), sp as (select k, id, cls, c, e / sum(e) over (partition by k, id) as p from sx)
        select k, (select field from pl where place = k) as added, count(*) as n, round(avg(-ln(greatest(p, 1e-12))), 6) as logloss from sp where c = cls group by 1""",
)
def ranked_sweep(spark, sf_dir):
    """Features are ranked by their held-out gain first; then the first k of them are scored, for every k."""
    f = firms(spark, sf_dir)
    order = [r["field"] for r in bayes.rank_features(f, FEATURES, CLASSES, FOLDS).collect()]  # a row a feature
    out = bayes.prefix_scores(f, order, CLASSES, FOLDS, [1, 2, 3, 4])
    names = F.element_at(F.array(*[F.lit(x) for x in order]), F.col("k"))
    return rounded(out.select("k", names.alias("added"), "n", "logloss"), "logloss")


@query(
    "prob_fallback",
    f"""with {FIRMS_SQL}, pr as (select cls, count(*) / (select count(*) from firms) as p from firms group by 1)
        select id, round(case when id % 3 = 0 then (select p from pr where cls = '1-URGENT') when id % 3 = 1 then 0.2 else 0.1 / 0.5 end, 6) as p from firms""",
)
def prob_fallback(spark, sf_dir):
    f = firms(spark, sf_dir)
    n = f.agg(*[F.avg((F.col("cls") == c).cast("double")).alias(f"p{i}") for i, c in enumerate(CLASSES)])
    priors = n.select(F.array(*[F.col(f"p{i}") for i in range(5)]).alias("p"))
    own = F.when(F.col("id") % 3 == 1, F.array_repeat(F.lit(0.0), 5)).when(F.col("id") % 3 == 2, F.array_repeat(F.lit(0.1), 5))
    return bayes.with_fallback(f.select("id", own.alias("p")), priors, CLASSES).select("id", F.round(F.col("p")[0], 6).alias("p"))


_MI_SQL = f"""{FIRMS_SQL}, w as (select coalesce(segment, '(missing)') as segment, status, region, size from firms),
  pr as (select unnest([('segment', 'status', segment, status), ('segment', 'region', segment, region), ('segment', 'size', segment, size), ('status', 'region', status, region), ('status', 'size', status, size), ('region', 'size', region, size)]) as x from w),
  ce as (select x[1] as fa, x[2] as fb, x[3] as va, x[4] as vb, count(*)::double as n from pr group by all),
  a as (select fa, fb, va, sum(n) as n from ce group by all), b as (select fa, fb, vb, sum(n) as n from ce group by all), t as (select count(*)::double as t from w),
  mi as (select ce.fa, ce.fb, greatest(0, sum(ce.n / t * ln(ce.n * t / (a.n * b.n)))) as mi from ce join a using (fa, fb, va) join b using (fa, fb, vb), t group by all),
  ha as (select fa, fb, sum(-n / t * ln(n / t)) as h, count(*) as k from a, t group by all), hb as (select fa, fb, sum(-n / t * ln(n / t)) as h, count(*) as k from b, t group by all),
  m as (select mi.fa, mi.fb, cast(t as bigint) as n, mi.mi, case when ha.h * hb.h > 0 then mi.mi / sqrt(ha.h * hb.h) else 0 end as nmi, t * mi.mi / ln(2) - 0.5 * (ha.k - 1) * (hb.k - 1) * log2(t) as gain from mi join ha using (fa, fb) join hb using (fa, fb), t)"""


@query("mi_pairs", f"with {_MI_SQL} select fa, fb, n, round(mi, 8) as mi, round(nmi, 8) as nmi from m")
def mi_pairs(spark, sf_dir):
    return rounded(information.mutual_information(firms(spark, sf_dir), FEATURES).drop("mdl_gain"), "mi", "nmi", digits=8)


@query("mdl_gain", f"with {_MI_SQL} select fa, fb, round(gain, 4) as mdl_gain from m")
def mdl_gain(spark, sf_dir):
    return information.mutual_information(firms(spark, sf_dir), FEATURES).select("fa", "fb", F.round("mdl_gain", 4).alias("mdl_gain"))


@query("redundant_pairs", f"with {_MI_SQL} select fa, fb, round(nmi, 8) as nmi from m order by nmi desc, fa, fb limit 3")
def redundant_pairs(spark, sf_dir):
    return rounded(information.redundant_pairs(firms(spark, sf_dir), FEATURES, 3).select("fa", "fb", "nmi"), "nmi", digits=8)


@query(
    "cluster_features",
    f"""with {FIRMS_SQL}, l as (select id, unnest([('segment', 1, coalesce(segment, '(missing)')), ('status', 2, status), ('region', 3, region), ('size', 4, size), ('segment2', 5, coalesce(lower(segment), '(missing)')), ('region2', 6, substr(nation, 1, 3))]) as x from firms),
        f as (select id, x[1] as name, x[2] as o, x[3] as v from l), t as (select count(*)::double as t from firms),
        ce as (select a.o as oa, b.o as ob, a.v as va, b.v as vb, count(*)::double as n from f a join f b on a.id = b.id and a.o < b.o group by all),
        m as (select oa, ob, va, vb, n, sum(n) over (partition by oa, ob, va) as na, sum(n) over (partition by oa, ob, vb) as nb from ce),
        i as (select oa, ob, sum(n / t * ln(n * t / (na * nb))) as mi, count(distinct va) as ka, count(distinct vb) as kb from m, t group by 1, 2), h as (select o, sum(-n / t * ln(n / t)) as h from (select o, v, count(*) as n from f group by 1, 2), t group by 1),
        near as (select i.oa, i.ob from i join h ha on ha.o = i.oa join h hb on hb.o = i.ob, t where mi / sqrt(ha.h * hb.h) >= 0.3 and t * mi / ln(2) - 0.5 * (ka - 1) * (kb - 1) * log2(t) > 0),
        -- No feature is in two near pairs here, so that each pair is a cluster.
        c as (select n.name, n.o, coalesce((select min(oa) from near where ob = n.o), n.o) as first from (select distinct name, o from f) n),
        g as (select first, count(*) as size, string_agg(name, '|' order by o) as features from c group by 1)
        select cast(row_number() over (order by size desc, features) - 1 as int) as cluster, cast(size as int) as size, features from g""",
)
def cluster_features(spark, sf_dir):
    """Clusters of features of which two are made to agree with others; the merging is held against brute force in the tests."""
    f = firms(spark, sf_dir).withColumns({"segment2": F.lower("segment"), "region2": F.substring("nation", 1, 3)})
    found = information.cluster_features(f, [*FEATURES, "segment2", "region2"])
    return spark.createDataFrame([(i, len(c), "|".join(c)) for i, c in enumerate(found)], "cluster int, size int, features string")


_CLUSTERS = {"market": ["segment", "region"], "deal": ["status", "size"]}
_THEME_SQL = f"""{FIRMS_SQL}, {LONG_SQL}, th as (select *, case when field in ('segment', 'region') then 'market' else 'deal' end as theme from u), tk as (select unnest([0, 1, 2, 3, 4]) as k),
  tm as (select tk.k, field, value, avg(rank) filter (where fold <> tk.k) as m from th, tk group by all),
  rw as (select tm.k, th.id, th.fold, th.theme, avg(tm.m) as raw from th join tm using (field, value) group by all),
  ed as (select k, theme, quantile_cont(round(raw, 12), [0.25, 0.5, 0.75]) as edges from rw where fold <> k group by all),
  te as (select r.id, r.fold, r.theme, r.raw, concat('L', len(list_filter(edges, lambda e: e <= round(r.raw, 12)))) as level from rw r join ed using (k, theme) where r.fold = r.k)"""


def _themes(spark, sf_dir):
    return information.theme_encode(firms(spark, sf_dir), _CLUSTERS, "rank", FOLDS)


@query("theme_encode", f"with {_THEME_SQL} select id, theme, round(raw, 6) as raw, level from te")
def theme_encode(spark, sf_dir):
    return rounded(_themes(spark, sf_dir).select("id", "theme", "raw", "level"), "raw")


_CLUSTERED_SQL = _cv_sql(
    _THEME_SQL.replace("u as (", "plain as (", 1).replace("from u)", "from plain)") + ", u as (select te.id, te.fold, f.cls, te.theme as field, te.level as value from te join firms f using (id))"
)


def _levels(spark, sf_dir):
    """Firms with a column of its level for each theme."""
    wide = _themes(spark, sf_dir).groupBy("id").pivot("theme", list(_CLUSTERS)).agg(F.first("level"))
    return firms(spark, sf_dir).join(wide, "id")


@query("clustered_nb", f"with {_CLUSTERED_SQL} select id, c, round(p, 6) as p from p")
def clustered_nb(spark, sf_dir):
    """Naive Bayes on themes: each cluster of features votes once."""
    scored = bayes.cross_validate(_levels(spark, sf_dir).select("id", "fold", "cls", *_CLUSTERS), list(_CLUSTERS), CLASSES, FOLDS)
    return rounded(bayes.long(scored, CLASSES), "p")


#: The share of what a feature says beyond its theme: ln P(value | theme, class) / P(value | theme), smoothed.
_RESIDUAL_SQL = f"""{_CLUSTERED_SQL},
  w as (select plain.id, plain.fold, plain.cls, plain.field, plain.value, u.field as theme, u.value as level from plain join u on u.id = plain.id and u.field = case when plain.field in ('segment', 'region') then 'market' else 'deal' end),
  wc as (select k.k, theme, level, field, value, c.c, sum((w.cls = c.c and w.fold <> k.k)::int) as n from w, k, c group by all),
  lc as (select k.k, field as theme, value as level, c.c, sum((u.cls = c.c and u.fold <> k.k)::int) as n from u, k, c group by all),
  wv as (select k, field, count(distinct value) as v from wc where n > 0 group by all),
  rs as (select wc.*, ln((wc.n + 1.0::double) / (lc.n + wv.v + 1)) - ln((sum(wc.n) over w1 + 1.0::double) / (sum(lc.n) over w1 + wv.v + 1)) as res
    from wc join lc on lc.k = wc.k and lc.theme = wc.theme and lc.level = wc.level and lc.c = wc.c join wv on wv.k = wc.k and wv.field = wc.field
    window w1 as (partition by wc.k, wc.theme, wc.level, wc.field, wc.value)),
  s2 as (select s.id, s.cls, s.c, min(s.s) + 0.5 * sum(rs.res) as s from s join w on w.id = s.id join rs on rs.k = w.fold and rs.theme = w.theme and rs.level = w.level and rs.field = w.field and rs.value = w.value and rs.c = s.c group by all),
  x2 as (select *, exp(s - max(s) over (partition by id)) as e from s2)"""


@query("clustered_residual", f"with {_RESIDUAL_SQL} select id, c, round(e / sum(e) over (partition by id), 6) as p from x2")
def clustered_residual(spark, sf_dir):
    """Clustered Naive Bayes in which features add half of what they say beyond their theme."""
    scored = bayes.cross_validate_clustered(_levels(spark, sf_dir), _CLUSTERS, CLASSES, FOLDS, beta=0.5)
    return rounded(bayes.long(scored, CLASSES), "p")


_SCORE_SQL = f"{_CV_SQL}, sc as (select id, round(sum(p * (4 - r)), 9) as score from p group by 1), fs as (select f.*, score from firms f join sc using (id))"


def _funds(spark, sf_dir):
    p = F.col("p")
    score = sum((p[i] * (4 - i) for i in range(1, 5)), p[0] * 4)
    return firms(spark, sf_dir).join(_scored(spark, sf_dir).select("id", F.round(score, 9).alias("score")), "id")


@query(
    "fund_stats",
    f"""with {_SCORE_SQL}, b as (select avg(balance) as b from fs), t as (select *, row_number() over (order by score desc, id) as r, row_number() over (order by score, id desc) as q from fs),
        g as (select 'top20' as fund, balance from t where r <= 20 union all select 'top50', balance from t where r <= 50 union all select 'top100', balance from t where r <= 100 union all select 'bottom20', balance from t where q <= 20)
        select fund, count(*) as n, round(avg(balance), 4) as mean, round(median(balance), 4) as median, round(avg(balance) - min(b.b), 4) as excess, round(avg((balance > 0)::int), 6) as hit_rate from g, b group by 1""",
)
def fund_stats(spark, sf_dir):
    out = ranking.fund_stats(_funds(spark, sf_dir), "score", "id", "balance")
    return rounded(rounded(out, "hit_rate"), "mean", "median", "excess", digits=4)


@query(
    "fund_report",
    f"""with {_SCORE_SQL}, g as (select *, balance / 100 as growth from fs), b as (select avg(growth) as b from g),
        t as (select *, row_number() over (order by score desc, id) as r, row_number() over (order by score, id desc) as q from g),
        h as (select concat('top', z) as fund, t.*, r as place from t, (select unnest([20, 50, 100]) as z) where r <= z union all select 'bottom20', *, -q from t where q <= 20)
        select fund, count(*) as n, round(avg(price), 4) as mean_total, round(median(price), 4) as median_total, round(avg(growth), 6) as growth, round(avg(growth) - min(b.b), 6) as excess_growth,
          round(avg((cls in ('1-URGENT', '2-HIGH'))::int), 6) as upside_hit, string_agg(cast(id as varchar), ',' order by place) as holdings from h, b group by 1""",
)
def fund_report(spark, sf_dir):
    """Funds with their totals, growth against the universe, hits by class and holdings."""
    f = _funds(spark, sf_dir).withColumn("growth", F.col("balance") / 100)
    out = ranking.fund_report(f, "score", "id", "price", "growth", "cls", CLASSES[:2])
    out = out.withColumn("holdings", F.array_join(F.transform("holdings", lambda x: x.cast("string")), ","))
    return rounded(rounded(out, "growth", "excess_growth", "upside_hit"), "mean_total", "median_total", digits=4)


@query(
    "per_vintage_topn",
    f"""with {_SCORE_SQL}, t as (select *, row_number() over (partition by vintage order by score desc, id) as r from fs)
        select vintage, count(*) filter (where r <= 20) as n, round(avg(balance) filter (where r <= 20), 4) as fund_mean, round(avg(balance), 4) as market_mean, round(avg(balance) filter (where r <= 20) - avg(balance), 4) as excess from t group by 1""",
)
def per_vintage_topn(spark, sf_dir):
    out = ranking.top_by_group(_funds(spark, sf_dir), "vintage", "score", "id", "balance")
    return rounded(out, "fund_mean", "market_mean", "excess", digits=4)


@query(
    "basket_relate",
    f"""with {_SCORE_SQL}, t as (select id, row_number() over (order by score desc, id) <= 100 as y from fs), {PRESENT_SQL.replace("u as", "pu as")}
        select field, value, count(*) as n, round(avg(y::int) / (select avg(y::int) from t), 6) as lift from pu join t using (id) group by 1, 2""",
)
def basket_relate(spark, sf_dir):
    f = _funds(spark, sf_dir)
    basket = f.orderBy(F.desc("score"), "id").limit(100).select("id", F.lit(True).alias("y"))  # the top hundred
    return rounded(lift.lift_table(f.join(basket, "id", "left"), FEATURES, F.coalesce("y", F.lit(False))), "lift")


@query(
    "error_scopes",
    f"""with {_JUDGED_SQL}, {PRESENT_SQL.replace("u as", "pu as")}, so as (select id, pred <> t as y, 'all' as scope from j union all select id, pred <> t, concat('actual ', cls) from j union all select id, pred <> t, concat('predicted ', pred) from j),
        ba as (select scope, avg(y::int) as b from so group by 1)
        select so.scope, field, value, count(*) as n, round(avg(y::int) / min(b), 6) as lift from so join pu using (id) join ba on ba.scope = so.scope where b > 0 group by all""",
)
def error_scopes(spark, sf_dir):
    f = firms(spark, sf_dir)
    j = bayes.judged(_scored(spark, sf_dir), CLASSES).select("id", "true_rank", "pred_rank")
    scopes = {"all": F.lit(True)} | {f"actual {c}": F.col("cls") == c for c in CLASSES} | {f"predicted {i}": F.col("pred_rank") == i for i in range(5)}
    return rounded(lift.scoped_lift(f.join(j, "id"), FEATURES, F.col("true_rank") != F.col("pred_rank"), scopes), "lift")


@query(
    "regression_shrunk",
    f"""with {FIRMS_SQL}, {LONG_SQL}, g as (select avg(price) as g from firms), m as (select u.field, u.value, count(*) as n, avg(f.price) as m from u join (select id, price from firms) f using (id) group by 1, 2)
        select field, value, n, round(n / (n + 10.0::double) * (m - g), 4) as effect from m, g""",
)
def regression_shrunk(spark, sf_dir):
    return rounded(information.shrunk_effects(firms(spark, sf_dir), FEATURES, F.col("price")), "effect", digits=4)


@query(
    "expected_cagr",
    f"""with {_CV_SQL}, m as (select k.k, cls, avg(balance) filter (where fold <> k.k) as m from firms, k group by all)
        select p.id, round(sum(p.p * m.m), 4) as expected from p join firms f on f.id = p.id join m on m.k = f.fold and m.cls = p.c group by 1""",
)
def expected_cagr(spark, sf_dir):
    f = firms(spark, sf_dir)
    own = f.groupBy("fold", "cls").agg(F.sum("balance").alias("s"), F.count("*").alias("n"))
    total = own.groupBy("cls").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    means = own.join(total, "cls").select("fold", F.col("cls").alias("c"), ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("m"))
    scored = _scored(spark, sf_dir)
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in CLASSES]).alias("c"), F.col("p").alias("p"))).alias("x")
    each = scored.select("id", "fold", pairs).select("id", "fold", "x.c", "x.p").join(means, ["fold", "c"])
    return each.groupBy("id").agg(F.round(F.sum(F.col("p") * F.col("m")), 4).alias("expected"))


_SCHOOLS = {"value": ["size", "status"], "quality": ["segment", "region"], "growth": ["size", "region"], "composite": FEATURES}
_SCHOOL_ROWS = ", ".join(f"('{name}', '{f}')" for name, fields in _SCHOOLS.items() for f in fields)


@query(
    "schools",
    f"""with {_CV_SQL}, sets as (select * from (values {_SCHOOL_ROWS}) v(school, field)),
        sw as (select sets.school, e.id, e.c, sum(e.ll) + min(q.lp) as s from each e join sets using (field) join prior q on q.k = e.fold and q.c = e.c group by all),
        sx as (select *, exp(s - max(s) over (partition by school, id)) as e from sw), sp as (select school, id, c, e / sum(e) over (partition by school, id) as p from sx),
        sc as (select school, id, round(sum(p * (5 - cast(c[1] as int))), 9) as score from sp group by all),
        r as (select sc.school, f.balance, row_number() over (partition by sc.school order by sc.score desc, sc.id) as r from sc join firms f using (id)),
        m as (select school, round(avg(balance) filter (where r <= 20), 4) as top20, round(avg(balance) filter (where r <= 50), 4) as top50, round(avg(balance) filter (where r <= 100), 4) as top100 from r group by 1)
        select school, top20, top50, top100, round(top100 - top20, 4) as decay from m""",
)
def schools(spark, sf_dir):
    """Feature sets as investing schools: the mean of each one's best 20, 50 and 100, and the decay between."""
    # What the model counts and scores, stored: the joins that make firms run once.
    f = materialize(firms(spark, sf_dir).select("id", "fold", "cls", "balance", *FEATURES), "firms")
    scored = bayes.subset_scores(f, FEATURES, _SCHOOLS, CLASSES, FOLDS, keep=["balance"])
    score = lambda p: F.round(sum((p[i] * (4 - i) for i in range(1, 5)), p[0] * 4), 9)
    means = ranking.fund_means(scored.select("id", "balance", *[score(F.col(f"p_{s}")).alias(s) for s in _SCHOOLS]), list(_SCHOOLS), "id", "balance")
    out = rounded(means, "top20", "top50", "top100", digits=4).withColumnRenamed("name", "school")
    return out.withColumn("decay", F.round(F.col("top100") - F.col("top20"), 4))


_SCORED_SQL = f"""{_CV_SQL}, sets as (select * from (values {_SCHOOL_ROWS}) v(school, field)),
  sw as (select sets.school, e.id, e.fold, e.c, sum(e.ll) + min(q.lp) as s from each e join sets using (field) join prior q on q.k = e.fold and q.c = e.c group by all),
  sx as (select *, exp(s - max(s) over (partition by school, id)) as e from sw), sp as (select school, id, fold, c, e / sum(e) over (partition by school, id) as p from sx),
  m as (select k.k, cls, avg(balance) filter (where fold <> k.k) as m from firms, k group by all),
  sc as (select school, id, unnest([('rank', round(sum(p * (5 - cast(c[1] as int))), 9)), ('top', round(sum(case when c = '1-URGENT' then p else 0 end), 9)), ('expected', round(sum(p * m.m), 6))]) as x
    from sp join m on m.k = sp.fold and m.cls = sp.c group by 1, 2)"""


@query(
    "schools_scored",
    f"""with {_SCORED_SQL}, mk as (select vintage, avg(balance) as market from firms group by 1),
        r as (select school, x[1] as scoring, f.balance, mk.market, row_number() over (partition by school, x[1] order by x[2] desc, id) as r from sc join firms f using (id) join mk using (vintage))
        select school, scoring, cast(size as int) as size, round(avg(balance), 4) as mean, round(avg((balance > market)::int), 6) as share_beating from r, (select unnest([20, 50, 100]) as size) where r <= size group by 1, 2, 3""",
)
def schools_scored(spark, sf_dir):
    """Four schools by three scorings by three fund sizes, from one scan of the rows, with the share of holdings that beat their vintage's market."""
    f = firms(spark, sf_dir)
    means = ranking.fold_means(f, "fold", "cls", "balance", CLASSES, FOLDS)
    scored = bayes.subset_scores(f, FEATURES, _SCHOOLS, CLASSES, FOLDS, keep=["vintage", "balance"]).join(F.broadcast(means), "fold")  # a row a fold
    over = lambda p, w: F.aggregate(F.zip_with(p, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    ranks = F.array(*[F.lit(float(4 - i)) for i in range(5)])
    ways = {"rank": lambda p: F.round(over(p, ranks), 9), "top": lambda p: F.round(p[0], 9), "expected": lambda p: F.round(over(p, F.col("means")), 6)}
    each = F.array(*[F.struct(F.lit(s).alias("school"), F.lit(w).alias("scoring"), of(F.col(f"p_{s}")).alias("score")) for s in _SCHOOLS for w, of in ways.items()])
    rows = scored.select("id", "vintage", "balance", each.alias("s"))
    out = ranking.fund_table(rows, "s", ["school", "scoring"], "id", "balance", "vintage", (20, 50, 100))
    return rounded(rounded(out, "share_beating"), "mean", digits=4)


@query(
    "similarity",
    f"""with {FIRMS_SQL}, {PRESENT_SQL}, w as (select field, value, ln((select count(*) from firms) / count(*)) as w from u group by 1, 2),
        s as (select a.id as focal, b.id, sum(w.w) as score from u a join u b using (field, value) join w using (field, value) where a.id % 20 = 0 and a.id <> b.id and b.id in (select id from firms where vintage < 2000) group by 1, 2)
        select focal, id, round(score, 6) as score, cast(r as int) as rank from (select *, row_number() over (partition by focal order by round(score, 9) desc, id) as r from s) where r <= 6""",
)
def similarity(spark, sf_dir):
    f = firms(spark, sf_dir).withColumn("outcome", F.when(F.col("vintage") < 2000, F.col("cls")))
    # A search: the rows whose id is divisible by 20 against all rows.
    return rounded(ranking.similar(f, f.where("id % 20 = 0"), "id", FEATURES, 6, "outcome"), "score")


def _engine(spark, sf_dir) -> Engine:
    """An engine over the firms, which it reads anew for each query."""
    return Engine(spark, {"companies": lambda: firms(spark, sf_dir).withColumn("note", F.concat_ws(" ", "nation", "status", "size"))}, {"note"})


def _nb_sql(columns: dict[str, str], given: dict[str, str], scope: str = "true", classes: str = _NAMES, cls: str = "cls") -> str:
    """The probabilities r(feature, p, base, lifts) of one query: columns are categories of firms, given their stated values."""
    long = " union all ".join(f"select {cls} as cls, '{name}' as field, coalesce(cast({sql} as varchar), '(missing)') as value from fs" for name, sql in columns.items())
    values = ", ".join(f"('{name}', '{value}')" for name, value in given.items())
    return f"""{FIRMS_SQL}, note as (select id, regexp_split_to_array(lower(concat_ws(' ', nation, status, size)), '[^a-z]+') as words from firms), fs as (select f.*, note.words from firms f join note using (id) where {scope}),
  u as ({long}), c as (select unnest({classes}) as c), g as (select * from (values {values}) g(field, value)),
  n as (select c.c, sum((fs.{cls} = c.c)::int) as n, count(*) as t from c, fs group by 1), v as (select field, count(distinct value) as v from u group by 1),
  l as (select c.c, g.field, g.value, (count(u.cls) filter (where u.cls = c.c) + 1.0::double) / (min(n.n) + min(v.v) + 1) as pc, count(u.cls) / min(n.t)::double as pv
    from c join n on n.c = c.c cross join g join v on v.field = g.field left join u on u.field = g.field and u.value = g.value group by all),
  s as (select l.c, sum(ln(pc)) + min(ln((n.n + 1.0::double) / (n.t + (select count(*) from c)))) as s from l join n on n.c = l.c group by 1),
  r as (select c as feature, exp(s - max(s) over ()) / sum(exp(s - (select max(s) from s))) over () as p from s)"""


#: Conditions of every kind, as a body and as columns of SQL.
_RICH = {"$and": [{"price": {"$gte": 100000, "$lt": 250000}}, {"$or": [{"region": "ASIA"}, {"region": "EUROPE"}]}], "$not": {"segment": "BUILDING"}, "note": "large china", "status": {"$has": "F"}}
_RICH_COLUMNS = {
    "price": "price >= 100000 and price < 250000", "either": "region = 'ASIA' or region = 'EUROPE'", "not": "not (segment = 'BUILDING')",
    "large": "list_contains(words, 'large')", "china": "list_contains(words, 'china')", "status": "status",
}
_RICH_GIVEN = {"price": "true", "either": "true", "not": "true", "large": "true", "china": "true", "status": "F"}


@query("query_predict_conditions", f"with {_nb_sql(_RICH_COLUMNS, _RICH_GIVEN)} select feature, round(p, 6) as p from r")
def query_predict_conditions(spark, sf_dir):
    """Ranges, $and, $or, $not, tokens and $has as evidence of one prediction."""
    return rounded(_engine(spark, sf_dir).run("predict", {"from": "companies", "where": _RICH, "predict": "cls", "select": ["feature", "$p"]}), "p")


@query(
    "query_match_conditions",
    f"""with {_nb_sql({"price": "price < 200000", "size": "size"}, {"price": "true", "size": "small"}, "vintage >= 1995", "(select list(distinct region) from firms)", "region")} select feature, round(p, 6) as score from r""",
)
def query_match_conditions(spark, sf_dir):
    where = {"price": {"$lt": 200000}, "size": "small", "$on": {"prop": {}, "on": {"vintage": {"$gte": 1995}}}}
    return rounded(_engine(spark, sf_dir).run("match", {"from": "companies", "where": where, "match": "region"}), "score")


@query(
    "query_why",
    f"""with {_nb_sql({"region": "region", "size": "size", "price": "price >= 200000"}, {"region": "ASIA", "size": "large", "price": "true"})},
        b as (select c as feature, 'baseP' as kind, cast(null as varchar) as proposition, (n + 1.0::double) / (t + 5) as value from n),
        f as (select c as feature, 'relatedPropositionLift' as kind, case field when 'price' then '{{"price": {{"$gte": 200000}}}}' else concat(field, ' = ', l.value) end as proposition, pc / pv as value from l),
        z as (select r.feature, 'normalizer' as kind, cast(null as varchar) as proposition, r.p / min(b.value) / product(f.value) as value from r join b using (feature) join f using (feature) group by r.feature, r.p),
        a as (select *, 1 as place from b union all select *, 1 + row_number() over (partition by feature order by round(abs(ln(value)), 9) desc, proposition) from f union all select *, 5 from z)
        select feature, place, kind, proposition, round(value, 6) as value from a""",
)
def query_why(spark, sf_dir):
    """The factors of each class's probability, those that tell most first."""
    body = {"from": "companies", "where": {"region": "ASIA", "size": "large", "price": {"$gte": 200000}}, "predict": "cls", "select": ["feature", "$why"]}
    why = _engine(spark, sf_dir).run("predict", body).select("feature", F.posexplode("why").alias("place", "w"))
    return rounded(why.select("feature", (F.col("place") + 1).alias("place"), "w.kind", "w.proposition", "w.value"), "value")


@query(
    "query_grouped_votes",
    f"""with {_nb_sql({"price": "price >= 300000 and size = 'large'", "region": "region"}, {"price": "true", "region": "ASIA"})} select feature, round(p, 6) as p from r""",
)
def query_grouped_votes(spark, sf_dir):
    """config.ai = high: size and the price it is made from agree, so they vote once, together."""
    body = {"from": "companies", "where": {"price": {"$gte": 300000}, "size": "large", "region": "ASIA"}, "predict": "cls", "config": {"ai": "high"}}
    return rounded(_engine(spark, sf_dir).run("predict", body), "p")


_DECILE = "(select quantile_cont(price, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) from firms)"
_BIN = "concat('bin ', greatest(1, len(list_filter({edges}, lambda e: e < {x}))))"


@query(
    "query_binned",
    f"""with {FIRMS_SQL}, q as (select {_DECILE} as edges), b as (select f.cls, {_BIN.format(edges="q.edges", x="f.price")} as value from firms f, q), g as (select {_BIN.format(edges="q.edges", x="123456.7::double")} as value from q),
        c as (select unnest({_NAMES}) as c), n as (select c.c, sum((f.cls = c.c)::int) as n, count(*) as t from c, firms f group by 1), v as (select count(distinct value) as v from b),
        s as (select n.c, (sum((b.cls = n.c)::int) + 1.0::double) / (min(n.n) + min(v.v) + 1) * (min(n.n) + 1) / (min(n.t) + 5) as e from n, b, g, v where b.value = g.value group by 1)
        select c as feature, round(e / sum(e) over (), 6) as p from s""",
)
def query_binned(spark, sf_dir):
    """A number with decimals stands for its decile."""
    return rounded(_engine(spark, sf_dir).run("predict", {"from": "companies", "where": {"price": 123456.7}, "predict": "cls"}), "p")


@query(
    "query_relate_binned",
    f"""with {FIRMS_SQL}, q as (select {_DECILE} as edges), b as (select {_BIN.format(edges="q.edges", x="f.price")} as value, cls = '1-URGENT' as y from firms f, q)
        select 'price' as field, value, round(avg(y::int) / (select avg(y::int) from b), 6) as lift from b group by 2""",
)
def query_relate_binned(spark, sf_dir):
    body = {"from": "companies", "where": {"cls": "1-URGENT"}, "relate": ["price"], "select": ["field", "value", "lift"]}
    return rounded(_engine(spark, sf_dir).run("relate", body), "lift")


@query(
    "query_search_order",
    f"""with {FIRMS_SQL} select id, vintage, round(price, 2) as price, cast(row_number() over (order by vintage desc, price, id) as int) as place from firms where region = 'AFRICA' and size <> 'small' order by vintage desc, price, id limit 40""",
)
def query_search_order(spark, sf_dir):
    """Two sort keys and a tie-break; the place shows the order."""
    body = {"from": "companies", "where": {"region": "AFRICA", "size": {"$not": "small"}}, "orderBy": [{"field": "vintage", "desc": True}, "price"], "ties": ["id"], "select": ["id", "vintage", "price"], "limit": 40}
    rows = _engine(spark, sf_dir).run("search", body)
    return rows.select("id", "vintage", F.round("price", 2).alias("price"), (F.monotonically_increasing_id() + 1).cast("int").alias("place"))  # the limit's one partition, in order


@query(
    "query_search_similarity",
    f"""with {FIRMS_SQL}, w as (select f.*, regexp_split_to_array(lower(concat_ws(' ', nation, status, size)), '[^a-z]+') as words from firms f),
        n as (select count(*) as n, count(*) filter (where list_contains(words, 'large')) as a, count(*) filter (where list_contains(words, 'japan')) as b from w),
        t as (select case when a > 0 then ln(n / a) else 0 end as a, case when b > 0 then ln(n / b) else 0 end as b from n)
        select id, round(list_contains(words, 'large')::int * a + list_contains(words, 'japan')::int * b, 6) as score from w, t where list_contains(words, 'large') or list_contains(words, 'japan')
        order by round(list_contains(words, 'large')::int * a + list_contains(words, 'japan')::int * b, 9) desc, id limit 50""",
)
def query_search_similarity(spark, sf_dir):
    body = {"from": "companies", "where": {"note": "Large Japan"}, "orderBy": "$similarity", "ties": ["id"], "select": ["id", "$score"], "limit": 50}
    return rounded(_engine(spark, sf_dir).run("search", body), "score")


_ASKED = "Stndeas of the reing, thatndou?"
_BM25_SQL = " + ".join(
    f"w{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(stated_terms(_ASKED, "english")))
)


@query(
    "query_search_ranked",
    f"""with d as (select doc_id, {terms_sql("text", "english")} as t from documents where text is not null),
        c as (select doc_id, len(t) as size, {", ".join(f"len(list_filter(t, lambda x: x = '{w}')) as f{i}" for i, w in enumerate(stated_terms(_ASKED, "english")))} from d),
        m as (select avg(size) as mean, {", ".join(f"ln(1 + (count(*) - count(*) filter (where f{i} > 0) + 0.5) / (count(*) filter (where f{i} > 0) + 0.5)) as w{i}" for i in range(len(stated_terms(_ASKED, "english"))))} from c),
        s as (select doc_id, {_BM25_SQL} as score from c, m where {" or ".join(f"f{i} > 0" for i in range(len(stated_terms(_ASKED, "english"))))})
        select doc_id, round(score, 6) as score from s order by round(score, 9) desc, doc_id limit 100""",
)
def query_search_ranked(spark, sf_dir):
    """Whole documents ranked by BM25 under the English analyzer, which takes the question's and the texts' words alike."""
    engine = Engine(spark, {"documents": lambda: table(spark, sf_dir, "documents")}, {"text": "english"})
    body = {"from": "documents", "where": {"text": _ASKED}, "orderBy": "$bm25", "ties": ["doc_id"], "select": ["doc_id", "$score"], "limit": 100}
    return rounded(engine.run("search", body), "score")


@query(
    "counts_appended",
    f"""with {_nb_sql({"region": "region", "size": "size"}, {"region": "ASIA", "size": "large"})} select feature, round(p, 6) as p from r""",
)
def counts_appended(spark, sf_dir):
    """A prediction from kept counts of a table that was loaded in two steps: only the second step's files are counted after it."""
    f, path, fields = firms(spark, sf_dir), new_path(spark, "companies"), ["region", "size"]
    store = CountStore(spark, new_path(spark, "counts"))
    view = lambda df: df.select(F.lit(None).cast("int").alias("fold"), "cls", *fields)
    early = F.col("vintage") < 1996
    sinks.refresh(f.where(early), path)
    store.counts("companies", path, view, fields)
    sinks.append_new(f.where(~early), path, ["id"])
    counts = store.counts("companies", path, view, fields)
    if store.did != "new":
        raise AssertionError("the whole table was counted anew")
    return rounded(predicted(spark, fitted(counts, fields), {"region": "ASIA", "size": "large"}), "p")


@query(
    "query_on_scope",
    f"""with {_nb_sql({"size": "size"}, {"size": "large"}, "status = 'F'")} select feature, round(p, 6) as p from r""",
)
def query_on_scope(spark, sf_dir):
    """$on restricts the population that a prediction learns from."""
    where = {"$and": [{"$on": {"prop": {"size": "large"}, "on": {"status": "F"}}}]}
    return rounded(_engine(spark, sf_dir).run("predict", {"from": "companies", "where": where, "predict": "cls"}), "p")


@query("query_gateway", "select * from (values (200, 'match'), (200, 'predict'), (400, 'search'), (400, 'table'), (422, 'field'), (422, 'operator')) v(status, asked)")
def query_gateway(spark, sf_dir):
    """What the gateway answers to good and bad bodies."""
    gate = Gateway(_engine(spark, sf_dir))
    asked = {
        "match": ("match", {"from": "companies", "match": "region"}), "predict": ("predict", {"from": "companies", "where": {"size": "large"}, "predict": "cls"}),
        "search": ("search", {"from": "companies"}), "table": ("predict", {"from": "other", "predict": "cls"}),
        "field": ("predict", {"from": "companies", "where": {"nope": 1}, "predict": "cls"}), "operator": ("relate", {"from": "companies", "where": {"price": {"$like": 1}}, "relate": ["size"]}),
    }
    return spark.createDataFrame([(gate.post(*body)[0], name) for name, body in asked.items()], "status int, asked string")


@query(
    "gateway_hits",
    f"""with {_nb_sql({"region": "region", "size": "size"}, {"region": "ASIA", "size": "large"})}, m as (select region as feature, count(*) / (select count(*) from firms) as p from firms group by 1)
        select 200 as status, 'predict' as asked, feature, round(p, 6) as p from r union all select 200, 'match', feature, round(p, 6) from m""",
)
def gateway_hits(spark, sf_dir):
    """What served bodies answer: the gateway's rows with their status."""
    gate, out = Gateway(_engine(spark, sf_dir)), None
    bodies = {"predict": {"from": "companies", "where": {"region": "ASIA", "size": "large"}, "predict": "cls"}, "match": {"from": "companies", "match": "region"}}
    for kind, body in bodies.items():
        status, rows = gate.post(kind, body)
        rows = rows.select(F.lit(status).alias("status"), F.lit(kind).alias("asked"), "feature", F.round("p" if kind == "predict" else "score", 6).alias("p"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "query_predict",
    f"""with {FIRMS_SQL}, {LONG_SQL}, c as (select unnest({_NAMES}) as c), g as (select * from (values ('region', 'ASIA'), ('size', 'large')) g(field, value)),
        n as (select c.c, sum((f.cls = c.c)::int) as n, count(*) as t from c, firms f group by 1), v as (select field, count(distinct value) as v from u group by 1),
        s as (select c.c, sum(ln(((select count(*) from u where u.field = g.field and u.value = g.value and u.cls = c.c) + 1.0::double) / (n.n + v.v + 1))) + min(ln((n.n + 1.0::double) / (n.t + 5))) as s from c, g join v using (field), n where n.c = c.c group by 1)
        select c as feature, round(exp(s) / sum(exp(s)) over (), 6) as p from s""",
)
def query_predict(spark, sf_dir):
    hits = _engine(spark, sf_dir).run("predict", {"from": "companies", "where": {"region": "ASIA", "size": {"$has": "large"}}, "predict": "cls"})
    return rounded(response(hits, "feature", "p", CLASSES).select("feature", "p"), "p")


@query(
    "query_relate",
    f"""with {FIRMS_SQL}, {PRESENT_SQL}, f as (select id, (region = 'ASIA' or price >= 200000 and price < 400000) as y from firms where status = 'F')
        select field, value, count(*) as n, round(avg(y::int) / (select avg(y::int) from f), 6) as lift from u join f using (id) where field in ('segment', 'size') group by 1, 2 having count(*) >= 20""",
)
def query_relate(spark, sf_dir):
    where = {"$on": {"prop": {"$or": [{"region": "ASIA"}, {"price": {"$gte": 200000, "$lt": 400000}}]}, "on": {"status": "F"}}}
    return rounded(_engine(spark, sf_dir).run("relate", {"from": "companies", "where": where, "relate": ["segment", "size"], "support": 20}), "lift")


@query(
    "query_match",
    f"with {FIRMS_SQL} select region as feature, round(count(*) / (select count(*) from firms), 6) as score from firms group by 1",
)
def query_match(spark, sf_dir):
    return rounded(_engine(spark, sf_dir).run("match", {"from": "companies", "match": "region"}), "score")


@query(
    "query_similarity",
    f"""with {FIRMS_SQL}, {PRESENT_SQL}, w as (select field, value, ln((select count(*) from firms) / count(*)) as w from u group by 1, 2)
        select id, round(sum(w), 6) as score from u join w using (field, value) where (field, value) in (('region', 'EUROPE'), ('size', 'small')) group by 1 order by round(sum(w), 9) desc, id limit 10""",
)
def query_similarity(spark, sf_dir):
    body = {"from": "companies", "similarity": {"region": "EUROPE", "size": "small"}, "key": "id", "limit": 10}
    return rounded(_engine(spark, sf_dir).run("similarity", body), "score")


@query(
    "query_search",
    f"""with {FIRMS_SQL} select id, ticker, vintage from firms where size = 'large' and vintage >= 1997 and status in ('F', 'O') and not (region = 'ASIA')""",
)
def query_search(spark, sf_dir):
    body = {
        "from": "companies",
        "where": {"note": "large", "vintage": {"$gte": 1997}, "status": {"$or": ["F", "O"]}, "$not": {"region": "ASIA"}},
        "orderBy": {"price": "desc"},
        "ties": ["id"],
        "select": ["id", "ticker", "vintage"],
    }
    return _engine(spark, sf_dir).run("search", body)


@query(
    "query_evaluate",
    f"""with {_JUDGED_SQL}, j0 as (select j.* from j join firms f using (id) where f.fold = 0), m as (select cls, count(*) as m, row_number() over (order by count(*) desc, cls) - 1 as br from j0 group by 1),
        r as (select p.id, sum((p.p > j0.pt)::int) as r from p join j0 using (id) group by 1), h as (select sum(-m::double / t * log2(m::double / t)) as h, max(m) / max(t) as ba, sum(br * m) / max(t) as bmr from m, (select count(*) as t from j0)),
        a as (select count(*) as n, avg((pred = t)::int) as acc, avg(-log2(greatest(pt, 1e-12))) as x from j0)
        select n, round(acc, 6) as accuracy, round(ba, 6) as base_accuracy, round(acc - ba, 6) as accuracy_gain, round(h - x, 6) as info_gain, round(x, 6) as mxe, round(h, 6) as h, round(power(2, h - x), 6) as geom_mean_lift,
          round((select avg(r) from r), 6) as mean_rank, round(bmr, 6) as base_mean_rank from a, h""",
)
def query_evaluate(spark, sf_dir):
    """Held-out metrics of one fold, trained on the others."""
    body = {"test": {"fold": 0}, "evaluate": {"from": "companies", "where": {f: {"$get": f} for f in FEATURES}, "predict": "cls"}}
    m = _engine(spark, sf_dir).run("evaluate", body)
    return rounded(m, *[c for c in m.columns if c != "n"])


@query(
    "sweep_peak",
    f"""with {_CV_SQL}, sw as (select z.k, e.id, e.cls, e.c, sum(e.ll) + min(q.lp) as s from each e join prior q on q.k = e.fold and q.c = e.c, (select unnest([1, 2, 3, 4]) as k) z
          where list_position(['{"', '".join(_ORDER)}'], e.field) <= z.k group by all),
        sx as (select *, exp(s - max(s) over (partition by k, id)) as e from sw), sp as (select k, id, cls, c, e / sum(e) over (partition by k, id) as p from sx)
        select k, n, round(logloss, 6) as logloss from (select k, count(*) as n, avg(-ln(greatest(p, 1e-12))) as logloss from sp where c = cls group by 1) order by logloss, k limit 1""",
)
def sweep_peak(spark, sf_dir):
    """The number of ranked features at which held-out log loss is least."""
    out = bayes.peak(bayes.prefix_scores(firms(spark, sf_dir), _ORDER, CLASSES, FOLDS, [1, 2, 3, 4]))
    return rounded(out.select("k", "n", "logloss"), "logloss")


@query(
    "additive_score",
    f"""with {FIRMS_SQL}, {LONG_SQL}, g as (select avg(price) as g from firms), m as (select u.field, u.value, count(*) as n, avg(f.price) as m from u join (select id, price from firms) f using (id) group by 1, 2),
        e as (select field, value, n / (n + 10.0::double) * (m - g) as effect from m, g) select u.id, round(min(g) + sum(e.effect), 4) as score from u join e using (field, value), g group by 1""",
)
def additive_score(spark, sf_dir):
    """The whole mean and the shrunk effects of a row's values, summed."""
    f = firms(spark, sf_dir)
    effects = information.shrunk_effects(f, FEATURES, F.col("price"))
    return rounded(information.additive_scores(f, effects, "id", FEATURES, f.agg(F.avg("price")).first()[0]), "score", digits=4)


@query(
    "funds_beating",
    f"""with {_SCORE_SQL}, t as (select *, row_number() over (partition by vintage order by score desc, id) as r from fs),
        e as (select vintage, avg(balance) filter (where r <= 20) - avg(balance) as excess from t group by 1) select count(*) as groups, round(avg((excess > 0)::int), 6) as share_beating from e""",
)
def funds_beating(spark, sf_dir):
    """The share of vintages whose best twenty beat their market."""
    return rounded(ranking.beats(ranking.top_by_group(_funds(spark, sf_dir), "vintage", "score", "id", "balance")), "share_beating")
