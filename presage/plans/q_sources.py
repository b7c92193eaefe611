"""Queries of sources and sinks over written files, and of the filters and expressions that feed them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from presage.functions import text
from presage.operators import joins
from presage.operators.staging import new_path
from presage.plans.core import FIRMS_SQL, PRICES_SQL, firms, prices, query, rounded, table
from presage.sources import connector, readers, sinks


@query("csv_file", "select s_suppkey, s_name, case when s_suppkey % 3 = 0 then null else s_acctbal end as s_acctbal from supplier")
def csv_file(spark, sf_dir):
    """A CSV file with comment lines and NaN, written and read under a given schema."""
    s, path = table(spark, sf_dir, "supplier"), new_path(spark, "csv")
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name", F.when(F.col("s_suppkey") % 3 == 0, "NaN").otherwise(F.col("s_acctbal").cast("string")))
    lines = s.select(F.explode(F.array(F.concat(F.lit("# supplier "), F.col("s_suppkey").cast("string")), line)).alias("value"))
    lines.write.text(path)
    # The lines have no header: a partitioned text file has none to give.
    return readers.csv(spark, path, "s_suppkey bigint, s_name string, s_acctbal double", "#", header=False)


@query("csv_sink", "select c_custkey, c_name, round(c_acctbal, 2) as c_acctbal, c_mktsegment from customer")
def csv_sink(spark, sf_dir):
    """Written with a header by the CSV sink, read by the CSV source."""
    path = new_path(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment"), path)
    return readers.Csv(path, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string").read(spark)


@query("json_report", "select o_orderkey as id, round(o_totalprice / 7, 2) as price, round(o_totalprice / 13, 2) as part from orders")
def json_report(spark, sf_dir):
    """A report with a struct in it, its numbers rounded wherever they stand, written and read back."""
    o, path = table(spark, sf_dir, "orders"), new_path(spark, "json")
    nested = F.struct((F.col("o_totalprice") / 13).alias("part"), F.lit("x").alias("note")).alias("more")
    sinks.write_json(o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 7).alias("price"), nested), path, 2)
    return spark.read.schema("id bigint, price double, more struct<part: double, note: string>").json(path).select("id", "price", "more.part")


@query("half_even", "select l_orderkey, l_linenumber, case when l_quantity % 2 = 0 then l_quantity / 2 when cast(l_quantity - 1 as bigint) // 2 % 2 = 0 then (l_quantity - 1) / 2 else (l_quantity + 1) / 2 end as half from lineitem")
def half_even(spark, sf_dir):
    """Halves rounded to whole numbers, ties to the even one."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 2).cast("double").alias("half"))
    return sinks.rounded(items, 0, half_even=True)


@query(
    "engine_row_types",
    """select c_custkey, concat('{"id":', c_custkey, ',"nation":', c_nationkey, case when c_custkey % 4 = 0 then '' else concat(',"segment":"', c_mktsegment, '"') end, '}') as json from customer""",
)
def engine_row_types(spark, sf_dir):
    """Rows for an engine: whole doubles as integers, NaN and null left out."""
    c = table(spark, sf_dir, "customer")
    c = c.select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("nation"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("segment"),
        F.lit(float("nan")).alias("score"),
    )
    rows = sinks.json_rows(c, whole=["nation"])
    return rows.select(F.get_json_object("json", "$.id").cast("bigint").alias("c_custkey"), "json")


@query("append_rows", "select o_orderkey, case when o_orderkey % 3 = 0 then 'old' else 'new' end as batch from orders where o_orderkey % 3 = 0 or o_orderkey % 2 = 0")
def append_rows(spark, sf_dir):
    """A third of the rows stored, then a half appended: keys that are there are not taken again."""
    o, path = table(spark, sf_dir, "orders").select("o_orderkey"), new_path(spark, "table")
    sinks.refresh(o.withColumn("batch", F.lit("stale")), path)
    sinks.refresh(o.where("o_orderkey % 3 = 0").withColumn("batch", F.lit("old")), path)
    sinks.append_new(o.where("o_orderkey % 2 = 0").withColumn("batch", F.lit("new")), path, ["o_orderkey"])
    return spark.read.schema("o_orderkey bigint, batch string").parquet(path)


@query("pending_report", "select cast(null as varchar) as theme, cast(null as bigint) as n, true as _pending, 'events,prices' as _missing")
def pending_report(spark, sf_dir):
    return sinks.pending(spark, "theme string, n bigint", ["events", "prices"])


@query("read_through_table", "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1")
def read_through_table(spark, sf_dir):
    """Made at the first reading; the second finds the stored table and does not make it."""
    path = new_path(spark, "cache")

    def make():
        c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return c.groupBy("n_name").agg(F.count("*").alias("n"))

    readers.read_through(spark, path, make)
    return readers.read_through(spark, path, lambda: spark.range(0).select(F.lit("").alias("n_name"), F.lit(0).cast("bigint").alias("n")))


@query("table_schema", "select * from (values ('r_regionkey', 'int'), ('r_name', 'string')) v(name, type)")
def table_schema(spark, sf_dir):
    found = readers.schema_of(readers.Parquet(sf_dir, "region").read(spark))
    return spark.createDataFrame([(n, t) for n, t, _ in found if n in ("r_regionkey", "r_name")], "name string, type string")


@query("price_history", f"with {PRICES_SQL}, b as (select min(ts) + interval 2 day as lo, max(ts) - interval 2 day as hi from prices) select key, event_id, close from prices, b where ts >= lo and ts < hi")
def price_history(spark, sf_dir):
    p = prices(spark, sf_dir)
    b = p.agg((F.min("ts") + F.expr("interval 2 day")).alias("lo"), (F.max("ts") - F.expr("interval 2 day")).alias("hi")).first()
    return readers.history(p, "ts", b["lo"], b["hi"]).select("key", "event_id", "close")


@query("subset_rows", f"with {FIRMS_SQL} select id, region from firms where region in ('ASIA', 'AFRICA') order by id limit 500")
def subset_rows(spark, sf_dir):
    """Named keys and a limit, for looking at a part by hand."""
    f = firms(spark, sf_dir).select("id", "region")
    return readers.subset(readers.subset(f, "region", ["ASIA", "AFRICA"]), "id", limit=500)


@query("html_rows", "select c_custkey, cast(1 as int) as row, c_name as name, concat(c_mktsegment, ' & co') as segment from customer")
def html_rows(spark, sf_dir):
    """Tables of pages as rows of cells: markup inside cells goes, entities are read."""
    c = table(spark, sf_dir, "customer")
    page = F.concat(
        F.lit("<p>x</p><table class='a'><tr><th>Name</th><th>Segment</th></tr>\n<tr><td><b>"), "c_name", F.lit("</b></td><td>"), "c_mktsegment", F.lit(" &amp; co</td></tr></table>")
    )
    rows = readers.html_tables(c.select("c_custkey", page.alias("html")), "html", "c_custkey").where("row > 0")
    return rows.select("c_custkey", "row", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("segment"))


_FILED = """f as (select c_custkey % 50 as ticker, cast('1995-01-01' as date) + cast(c_custkey * 37 % 1500 as int) as filed, c_custkey as id from customer)"""


def _filing_rows(spark, sf_dir, form):
    """A filing for each customer: (ticker, form, filed, accession, text)."""
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") * 37 % 1500).cast("int"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("ticker"), F.date_format(day, "yyyy-MM-dd").alias("filed"), F.col("c_custkey").cast("string").alias("id"))
    return c.select(F.col("ticker").cast("string").alias("ticker"), form.alias("form"), "filed", F.col("id").alias("accession"), F.concat(F.lit("report "), "id").alias("text"))


@query("filing_scan", f"""with {_FILED} select c as ticker, max_by(case when id is not null then concat('report ', id) end, (filed, id)) as text, max(filed) as filed from (select unnest(range(50)) as c) left join f on f.ticker = c and filed < date '1997-01-01' group by 1""")
def filing_scan(spark, sf_dir):
    """Folders of metadata and texts, each of many filings, written and scanned, and the latest before a cutoff taken for each ticker."""
    root = new_path(spark, "filings")
    sinks.write_filings(_filing_rows(spark, sf_dir, F.lit("10-K")), root)
    scanned = readers.filing_folders(spark, root).select(F.col("ticker").cast("bigint").alias("ticker"), "filed", F.col("accession").cast("bigint").alias("id"), "text")
    cuts = spark.range(50).select(F.col("id").alias("ticker"), F.lit("1997-01-01").cast("date").alias("cutoff"))
    return joins.asof_backward(cuts, scanned, "ticker", "cutoff", "filed", "text", "id").select("ticker", "text", "filed")


@query("filing_source", f"""with {_FILED} select cast(ticker as varchar) as ticker, case when ticker % 2 = 0 then '10-K' else '8-K' end as form, filed, concat('report ', id) as text from f where ticker % 2 = 0 and filed >= date '1996-01-01' and ticker in (4, 8, 15, 16)""")
def filing_source(spark, sf_dir):
    """The folders as a data source: form, ticker and date are filtered on the metadata, and only what is left is opened."""
    connector.register(spark)
    root = new_path(spark, "filings")
    sinks.write_filings(_filing_rows(spark, sf_dir, F.when(F.col("ticker") % 2 == 0, "10-K").otherwise("8-K")), root)
    rows = spark.read.format("filings").option("path", root).option("folders", 16).load()
    return rows.where((F.col("form") == "10-K") & (F.col("filed") >= F.lit("1996-01-01").cast("date")) & F.col("ticker").isin("4", "8", "15", "16")).drop("accession")


@query("batch_sink", "select c_mktsegment as segment, count(*) as n, round(sum(c_acctbal), 2) as balance from customer group by 1")
def batch_sink(spark, sf_dir):
    """Rows written in batches of at most a thousand, appended to once, and read back from the committed files."""
    connector.register(spark)
    path, schema = new_path(spark, "batches"), "c_custkey bigint, c_mktsegment string, c_acctbal double"
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_mktsegment", "c_acctbal")
    for part, mode in ((F.col("c_acctbal") < 0, "overwrite"), (F.col("c_acctbal") >= 0, "append")):
        c.where(part).write.format("batches").option("path", path).option("rows", 1000).mode(mode).save()
    back = spark.read.format("batches").schema(schema).option("path", path).load()
    return back.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


_PAGED_SQL = "select o_custkey as ticker, o_orderkey as id, o_orderstatus as form from orders"


@query("submission_pages", _PAGED_SQL)
def submission_pages(spark, sf_dir):
    """Filings in a company's first file and in a further page that it names."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.struct("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).alias("r"))
    r = o.groupBy("ticker").agg(F.sort_array(F.collect_list("r")).alias("r")).withColumn("cut", F.ceil(F.size("r") / 2).cast("int"))

    def arrays(of):
        part = lambda f: F.transform(of, f)
        return F.struct(
            part(lambda x: x["o_orderstatus"]).alias("form"), part(lambda x: x["d"]).alias("filingDate"), part(lambda x: x["d"]).alias("reportDate"),
            part(lambda x: x["o_orderkey"].cast("string")).alias("accessionNumber"), part(lambda x: x["d"]).alias("primaryDocument"), part(lambda x: x["d"]).alias("items"),
        )

    name = F.concat(F.lit("page-"), F.col("ticker").cast("string"))
    first = F.struct(arrays(F.slice("r", F.lit(1), F.col("cut"))).alias("recent"), F.array(F.struct(name.alias("name"))).alias("files"))
    docs = r.select("ticker", F.to_json(F.struct(first.alias("filings"))).alias("json"))
    pages = r.select(name.alias("name"), F.to_json(arrays(F.slice("r", F.col("cut") + 1, F.size("r")))).alias("json"))
    return readers.submissions(docs, "ticker", pages=pages).select("ticker", F.col("accessionNumber").cast("bigint").alias("id"), "form")


@query(
    "release_filings",
    """with f as (select event_id, case event_id % 3 when 0 then '8-K' when 1 then '10-Q' else '8-K/A' end as form, concat(['2.02', '9.01', '7.01', '2.02'][event_id % 4 + 1], ',9.01') as items, cast(ts as date) as filed from events)
       select event_id from f where form = '8-K' and contains(items, '2.02') and filed >= (select min(filed) + 5 from f)""",
)
def release_filings(spark, sf_dir):
    """Filings of one form that hold one item, from a date on; a date that cannot be read is passed over."""
    form = F.when(F.col("event_id") % 3 == 0, "8-K").when(F.col("event_id") % 3 == 1, "10-Q").otherwise("8-K/A")
    items = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("2.02", "9.01", "7.01", "2.02")]), (F.col("event_id") % 4 + 1).cast("int")), F.lit(",9.01"))
    f = table(spark, sf_dir, "events").select("event_id", form.alias("form"), items.alias("items"), F.date_format("ts", "yyyy-MM-dd").alias("written"))
    f = f.withColumn("filed", text.date_of(F.col("written")))
    since = f.agg(F.date_add(F.min("filed"), 5).alias("since"))
    kept = f.where((F.col("form") == "8-K") & F.array_contains(text.items(F.col("items")), "2.02")).crossJoin(F.broadcast(since))  # one row
    return kept.where(F.col("filed") >= F.col("since")).select("event_id")


@query(
    "material_events",
    """with f as (select event_id, case event_id % 3 when 0 then '8-K' else '10-Q' end as form, ['2.02', '9.01', '5.02', '9.99'][event_id % 4 + 1] as items from events)
       select event_id, case items when '2.02' then 'earnings' when '5.02' then 'management change' else 'other' end as theme from f where form = '8-K' and items <> '9.01'""",
)
def material_events(spark, sf_dir):
    """Events of one form with their themes, without those of exhibits only."""
    form = F.when(F.col("event_id") % 3 == 0, "8-K").otherwise("10-Q")
    items = F.element_at(F.array(*[F.lit(x) for x in ("2.02", "9.01", "5.02", "9.99")]), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", form.alias("form"), text.theme(items).alias("theme"))
    return e.where((F.col("form") == "8-K") & (F.col("theme") != "exhibits only")).select("event_id", "theme")


@query("seasoned_vintages", f"with {FIRMS_SQL} select vintage, count(*) as n from firms where date_diff('day', make_date(vintage, 6, 1), date '1998-06-01') >= 365 group by 1")
def seasoned_vintages(spark, sf_dir):
    """Vintages of at least a year's age as of a date."""
    f = firms(spark, sf_dir).where(F.datediff(F.lit("1998-06-01").cast("date"), F.make_date("vintage", F.lit(6), F.lit(1))) >= 365)
    return f.groupBy("vintage").agg(F.count("*").alias("n"))


@query("number_labels", "select c_custkey, concat('age = ', c_custkey % 90) as whole, concat('share = ', cast(c_custkey % 8 + 0.5 as varchar)) as broken, concat('segment = ', c_mktsegment) as word from customer")
def number_labels(spark, sf_dir):
    """Labels: a double without decimals as an integer, others and text as they are."""
    c = table(spark, sf_dir, "customer")
    whole, broken = (F.col("c_custkey") % 90).cast("double"), (F.col("c_custkey") % 8).cast("double") + 0.5
    return c.select("c_custkey", text.label("age", whole).alias("whole"), text.label("share", broken).alias("broken"), text.label("segment", F.col("c_mktsegment")).alias("word"))


@query(
    "row_propositions",
    f"""with {FIRMS_SQL}, l as (select id, 1 as o, concat('segment = ', segment) as p from firms where segment is not null union all select id, 2, concat('vintage = ', vintage) from firms union all select id, 3, concat('size = ', size) from firms)
        select id, cast(row_number() over (partition by id order by o) as int) as place, p as proposition from l""",
)
def row_propositions(spark, sf_dir):
    """A row's known values as a numbered list of propositions."""
    f = firms(spark, sf_dir)
    said = F.array(*[F.when(F.col(c).isNotNull(), text.label(c, F.col(c))) for c in ("segment", "vintage", "size")])
    return f.select("id", F.posexplode(F.array_compact(said)).alias("at", "proposition")).select("id", (F.col("at") + 1).alias("place"), "proposition")


@query("feature_count", "select cast(4 as bigint) as features, 'segment,status,region,size' as names, 'rank' as ranks")
def feature_count(spark, sf_dir):
    """How many columns are features: all but keys, outcomes and rationales; and a column found by a part of its name."""
    f = firms(spark, sf_dir).withColumn("segment_rationale", F.lit("why"))
    others = {"id", "ticker", "vintage", "cls", "rank", "nation", "price", "balance", "ts", "fold"}
    names = [c for c in f.columns if c not in others and not c.endswith("_rationale")]
    return spark.createDataFrame([(len(names), ",".join(names), ",".join(text.columns_like([*f.columns, "rank"], "RAN")))], "features bigint, names string, ranks string")


@query(
    "theme_events_join",
    """with e as (select user_id as ticker, cast(ts as date) as day, count(*) as n from events where event_type = (select min(event_type) from events) group by 1, 2),
       s as (select user_id as ticker, cast(ts as date) as day, max(value) as top from events where event_type = (select max(event_type) from events) group by 1, 2)
       select ticker, day, n, round(top, 4) as top from e join s using (ticker, day)""",
)
def theme_events_join(spark, sf_dir):
    """Events of one theme joined with another's signals on ticker and day."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("day"), "event_type", "value")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    e = e.crossJoin(F.broadcast(ends))  # one row
    first = e.where("event_type = lo").groupBy("ticker", "day").agg(F.count("*").alias("n"))
    second = e.where("event_type = hi").groupBy("ticker", "day").agg(F.max("value").alias("top"))
    return rounded(first.join(second, ["ticker", "day"]), "top", digits=4)


@query(
    "overlay_outcome",
    """with o as (select o_orderkey as id, (o_totalprice / 1000 - 150) as total, cast(o_orderdate as date) as s, cast(o_orderdate as date) + 2000 as e from orders),
       p as (select l_orderkey as id, min(l_quantity) as total, min(cast(l_shipdate as date)) + 2500 as e from lineitem where l_linenumber = 2 and l_quantity > 30 group by 1),
       m as (select o.id, coalesce(p.total, o.total) as total, greatest(date_diff('day', o.s, coalesce(p.e, o.e)) / 365.25, 0.01) as w from o left join p on p.id = o.id),
       c as (select id, total, w, case when total >= -100 then power(1 + total / 100, 1 / w) - 1 end as cagr from m)
       select id, round(w, 6) as window, round(cagr, 6) as cagr, case when cagr is null then null when cagr < -0.1 then 'disaster' when cagr < 0 then 'poor' when cagr < 0.07 then 'market' when cagr < 0.13 then 'good' else 'great' end as outcome from c""",
)
def overlay_outcome(spark, sf_dir):
    """Later returns put over earlier ones, with window, growth and outcome made anew."""
    day = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000 - 150).alias("total"), day.alias("s"), F.date_add(day, 2000).alias("e"))
    late = table(spark, sf_dir, "lineitem").where("l_linenumber = 2 and l_quantity > 30").groupBy(F.col("l_orderkey").alias("id"))
    p = late.agg(F.min("l_quantity").cast("double").alias("total"), F.date_add(F.min(F.to_date("l_shipdate")), 2500).alias("e")).withColumn("s", F.lit(None).cast("date"))
    out = joins.overlay_outcomes(o, p, ["id"], "total", "s", "e")
    return rounded(out.select("id", "window", "cagr", "outcome"), "window", "cagr")


@query(
    "asof_nullable",
    """with f as (select o_custkey as ticker, cast(o_orderdate as date) as filed, cast(o_orderdate as date) - 60 as "end", max(o_totalprice) as val from orders group by 1, 2, 3),
       c as (select c_custkey as ticker, case when c_custkey % 3 <> 0 then c_mktsegment end as note, date '1997-01-01' as cutoff, r from customer, range(2) t(r)),
       b as (select c.ticker, c.note, c.r, arg_max(f.val, f."end") as val, max(year(f."end")) as y from c left join f on f.ticker = c.ticker and f.filed < c.cutoff group by 1, 2, 3)
       select b.ticker, b.note, b.val, (select arg_max(f.val, f."end") from f where f.ticker = b.ticker and f.filed < date '1997-01-01' and year(f."end") = b.y - 1) as back from b""",
)
def asof_nullable(spark, sf_dir):
    """Latest values and those a year before, for rows that repeat and have nulls among their attributes."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("filed")).agg(F.max("o_totalprice").alias("val"))
    o = o.withColumn("end", F.date_sub("filed", 60))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("note"), F.lit("1997-01-01").cast("date").alias("cutoff"))
    c = c.unionByName(c)
    out = joins.asof_by(c, o, ["ticker"], "cutoff", "filed", "end", "val").drop("end")
    return joins.periods_back(out, o.withColumnRenamed("val", "back"), ["ticker"], "cutoff", "filed", "end", "back", 1).select("ticker", "note", "val", "back")


@query("prompt_filled", "select conv_id, turn, concat('As of 2017-01-01: ', coalesce(role, ''), ' said it in turn ', turn, '.') as prompt from conversations")
def prompt_filled(spark, sf_dir):
    """A template filled from columns."""
    c = table(spark, sf_dir, "conversations")
    template = F.lit("As of {VINTAGE_DATE}: {ROLE} said it in turn {TURN}.")
    return c.select("conv_id", "turn", text.filled(template, {"VINTAGE_DATE": F.lit("2017-01-01"), "ROLE": F.col("role"), "TURN": F.col("turn")}).alias("prompt"))


_PAD = "repeat('lorem ipsum ', 200)"
_PROXY = f"concat('Contents: Compensation Discussion and Analysis page 9. ', {_PAD}, 'COMPENSATION DISCUSSION  AND ANALYSIS of firm ', doc_id, '. ', case when doc_id % 3 = 0 then 'short' else {_PAD} end)"


@query(
    "proxy_windows",
    f"""with t as (select doc_id, {_PROXY} as t, length(concat('Contents: Compensation Discussion and Analysis page 9. ', {_PAD})) as pos from documents)
        select doc_id, case when length(t) - pos >= 1000 then substr(t, pos + 1, 20000) end as cd_a, case when length(t) - pos < 1000 then substr(t, 1, 30000) end as head from t""",
)
def proxy_windows(spark, sf_dir):
    """Sections from their last header on, where enough follows it; else the head."""
    pad = F.repeat(F.lit("lorem ipsum "), 200)
    t = F.concat(
        F.lit("Contents: Compensation Discussion and Analysis page 9. "), pad, F.lit("COMPENSATION DISCUSSION  AND ANALYSIS of firm "), F.col("doc_id").cast("string"), F.lit(". "),
        F.when(F.col("doc_id") % 3 == 0, "short").otherwise(pad),
    )
    found = text.proxy_sections(F.col("t"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", found["cd_a"].alias("cd_a"), found["head"].alias("head"))


@query(
    "section_anchor",
    """with t as (select doc_id, concat(repeat('x', 50000 + doc_id % 40), chr(10), ' Management''s Discussion and Analysis ', doc_id, ' ', repeat('y', 100)) as t from documents)
       select doc_id, substr(t, 50002 + doc_id % 40, 30000) as mda from t""",
)
def section_anchor(spark, sf_dir):
    """A section from its header on, searched from an offset."""
    t = F.concat(
        F.repeat(F.lit("x"), (F.lit(50_000) + F.col("doc_id") % 40).cast("int")), F.lit("\n Management's Discussion and Analysis "), F.col("doc_id").cast("string"), F.lit(" "), F.repeat(F.lit("y"), 100)
    )
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.regexp_replace(text.annual_sections(F.col("t"))["mda"], r"^\n", "").alias("mda"))


@query(
    "excerpt_combined",
    r"""with s as (select doc_id, substr(text, 1, 900) as a, substr(text, 1, 400) as b from documents)
        select doc_id, concat('== annual / head ==', chr(10), trim(substr(a, 1, 600)), chr(10), chr(10), '== proxy / head ==', chr(10), trim(substr(b, 1, 200)), chr(10)) as excerpt from s""",
)
def excerpt_combined(spark, sf_dir):
    """Excerpts of two reports in one text, three quarters of the budget for the first, each under its banner."""
    d = table(spark, sf_dir, "documents")
    annual, proxy = {"head": F.substring("text", 1, 900)}, {"head": F.substring("text", 1, 400)}
    return d.select("doc_id", text.combined_excerpt(annual, proxy, 200).alias("excerpt"))


@query("insert_table", "select c_nationkey, count(*) + 1 as n from customer group by 1")
def insert_table(spark, sf_dir):
    """A named table made anew, then rows inserted into it: counts of what it holds."""
    name = f"presage_insert_{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "customer").select("c_nationkey")
    try:
        sinks.refresh_table(c.limit(0), name, new_path(spark, "table"))
        sinks.refresh_table(c, name, new_path(spark, "table"))
        sinks.insert_rows(c.distinct(), name)
        out = spark.table(name).groupBy("c_nationkey").agg(F.count("*").alias("n"))
        path = new_path(spark, "counts")
        sinks.refresh(out, path)
    finally:
        sinks.drop_table(spark, name)
    return spark.read.schema(out.schema).parquet(path)
