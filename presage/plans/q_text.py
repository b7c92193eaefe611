"""Queries of text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.functions import text
from presage.plans.core import query, table


@query(
    "html_to_text",
    r"""with a as (select page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') as t from pages),
        b as (select page_id, regexp_replace(t, '(?s)<[^>]+>', chr(10), 'g') as t from a),
        c as (select page_id, replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as t from b),
        d as (select page_id, regexp_replace(t, '[ \t]+', ' ', 'g') as t from c)
        select page_id, trim(regexp_replace(t, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')) as body from d""",
)
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))


@query(
    "section_extract",
    """select doc_id, case when length(text) > 9000 then substr(text, 8001, 42000) end as business_and_risks,
         case when length(text) > 90000 then substr(text, 80001, 30000) end as mda, case when length(text) <= 9000 then substr(text, 1, 40000) end as head from documents""",
)
def section_extract(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *[c.alias(k) for k, c in text.annual_sections(F.col("text")).items()])


@query(
    "excerpt_budget",
    """with s as (select doc_id, substr(text, 1, 1000) as a, substr(text, 1001, 5000) as b from documents), n as (select *, length(a) + length(b) > 2000 as over from s)
       select doc_id, case when over and length(a) > length(b) then substr(a, 1, greatest(2000 - length(b), 0)) else a end as head,
         case when over and length(b) >= length(a) then substr(b, 1, greatest(2000 - length(a), 0)) else b end as body from n""",
)
def excerpt_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    parts = {"head": F.substring("text", 1, 1000), "body": F.substring("text", 1001, 5000)}
    kept = d.select("doc_id", text.within_budget(parts, 500).alias("s"))
    return kept.select("doc_id", F.col("s")[0]["body"].alias("head"), F.col("s")[1]["body"].alias("body"))


_MARKS = " &#8217;&#x2019;&ndash;&#146;&bogus; &amp;lt; &#0;&copy AT&T"


@query("html_entities", f"""with p as (select page_id, html || '{_MARKS}' as t from pages) select page_id, md5({text.unescaped_sql("t")}) as digest, length({text.unescaped_sql("t")}) as n from p""")
def html_entities(spark, sf_dir):
    """Whole pages with every named and numbered entity read once."""
    p = table(spark, sf_dir, "pages").select("page_id", text.unescaped(F.concat("html", F.lit(_MARKS))).alias("t"))
    return p.select("page_id", F.md5("t").alias("digest"), F.char_length("t").cast("bigint").alias("n"))


@query(
    "excerpt_marked",
    """with s as (select doc_id, text as a, concat('source ', source) as b from documents), n as (select *, length(a) + length(b) > 2000 and length(a) > length(b) as cut from s)
       select doc_id, md5(case when cut then concat(substr(a, 1, 2000 - length(b)), chr(10), chr(10), '[…section truncated for token budget…]') else a end) as digest, cut from n""",
)
def excerpt_marked(spark, sf_dir):
    """Whole texts within a budget; where one is cut a mark says so."""
    d = table(spark, sf_dir, "documents")
    body = text.within_budget({"text": F.col("text"), "source": F.concat(F.lit("source "), "source")}, 500, mark=text.CUT)[0]["body"]
    return d.select("doc_id", F.md5(body).alias("digest"), body.endswith(text.CUT).alias("cut"))


@query(
    "keyword_signals",
    """with t as (select doc_id, lower(text) as t from documents),
       w as (select doc_id, t, t like '%miss%' or t like '%below expectations%' or t like '%decline%' or t like '%lower%' or t like '%cut guidance%' or t like '%disappoint%' as bad,
         t like '%record%' or t like '%beat%' or t like '%raise%' or t like '%exceeded%' or t like '%strong%' or t like '%growth%' as good from t)
       select doc_id, case when bad and not good then 'clearly_negative' when good and not bad then 'clearly_positive' else 'mixed' end as headline_signal,
         case when t like '%miss%' then 'miss' when t like '%beat%' then 'beat' else 'not_stated' end as reported_beat,
         case when t like '%lower%' or t like '%cut%' then 'lowered' when t like '%raise%' then 'raised' else 'none' end as guidance,
         case when bad and not good then 'down' else 'up' end as eps_direction, case when t like '%record revenue%' or t like '%revenue grew%' then 'up' else 'not_stated' end as revenue_direction,
         case when t like '%charge%' or t like '%impairment%' then 'charges' else 'none' end as one_time_items, case when bad then 'cautious' else 'confident' end as tone from w""",
)
def keyword_signals(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *[c.alias(k) for k, c in text.keyword_signals(F.col("text")).items()])


@query(
    "classify_releases",
    """with t as (select doc_id, lower(text) as t from documents where length(text) >= 40),
       w as (select doc_id, t like '%miss%' as miss, t like '%lower%' or t like '%cut%' as lowered, t like '%raise%' as raised,
         t like '%miss%' or t like '%below expectations%' or t like '%decline%' or t like '%lower%' or t like '%cut guidance%' or t like '%disappoint%' as bad,
         t like '%record%' or t like '%beat%' or t like '%raise%' or t like '%exceeded%' or t like '%strong%' or t like '%growth%' as good from t)
       select doc_id, case when lowered or miss or (bad and not good) then 'down' when raised or (good and not bad) then 'up' else 'flat' end as bucket,
         case when lowered or miss or (bad and not good) then 0.55::double when raised or (good and not bad) then 0.5 else 0.4 end as p from w""",
)
def classify_releases(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.char_length("text") >= 40)
    s = d.select("doc_id", *[c.alias(k) for k, c in text.keyword_signals(F.col("text")).items()])
    best = text.rule_prediction(F.col("guidance"), F.col("reported_beat"), F.col("headline_signal"))[0]
    return s.select("doc_id", best["bucket"].alias("bucket"), best["p"].alias("p"))


@query(
    "text_tokens",
    "select doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda t: t <> '')) as n from documents",
)
def text_tokens(spark, sf_dir):
    from presage.functions.analysis import words as tokens

    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n"))


@query(
    "release_rank",
    """with f as (select doc_id, concat(['press', 'cfo', 'exhibit', 'ex99', 'index'][doc_id % 5 + 1], '_', doc_id, ['.htm', '.txt', '.pdf'][doc_id % 3 + 1]) as name, source from documents),
       r as (select source, name, case when name like 'press%' or name like 'ex99%' then 0 when name like 'cfo%' then 1 else 2 end as k from f where not name like '%.pdf' and not name like 'index%')
       select source, name, cast(n as int) as rank from (select *, row_number() over (partition by source order by k, name) as n from r) where n <= 3""",
)
def release_rank(spark, sf_dir):
    def pick(values, by):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % by + 1).cast("int"))

    name = F.concat(pick(["press", "cfo", "exhibit", "ex99", "index"], 5), F.lit("_"), F.col("doc_id").cast("string"), pick([".htm", ".txt", ".pdf"], 3))
    f = table(spark, sf_dir, "documents").select("source", name.alias("name"))
    kept = f.where((F.endswith("name", F.lit(".htm")) | F.endswith("name", F.lit(".txt"))) & ~F.rlike("name", F.lit("^index")))
    w = Window.partitionBy("source").orderBy(text.release_rank(F.col("name")), "name")
    return kept.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query("prompt_template", "select conv_id, turn, replace('As of {VINTAGE_DATE}: {ROLE}', '{VINTAGE_DATE}', '2017-01-01') as prompt from conversations")
def prompt_template(spark, sf_dir):
    filled = F.replace(F.lit("As of {VINTAGE_DATE}: {ROLE}"), F.lit("{VINTAGE_DATE}"), F.lit("2017-01-01"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", filled.alias("prompt"))
