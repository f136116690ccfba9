"""Registered queries, third part: the table of record with its rollup and id bitmaps, and what is built on stored tables.

Importing the module adds them to ``catalog.REGISTRY``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import bitmaps, paging, rollup, textindex
from revlens.plans import catalog as C
from revlens.sources import tables as T
from revlens.sources.store import PredictionStore

V, register = T.with_views, C.register
WRITERS, BATCHES = 2, 2

# Stored rows with missing products and labels, millisecond times and unusable ones.
VARIED_SQL = """select * replace (case when Id % 10 = 0 then null when Id % 3 = 0 then ProductId || '-' || (Id % 50) else ProductId end as ProductId,
       case when Id % 7 = 0 then Time * 1000 when Id % 11 = 0 then 5 else Time end as Time,
       case when Id % 13 = 0 then null when Id % 17 = 0 then '' else sentiment_label end as sentiment_label)
from predictions_keyed"""


def _varied(spark, d):
    i, product, label = F.col("Id"), F.col("ProductId"), F.col("sentiment_label")
    return C._pk(spark, d).withColumns({
        "ProductId": F.when(i % 10 != 0, F.when(i % 3 == 0, F.concat_ws("-", product, (i % 50).cast("string"))).otherwise(product)),
        "Time": F.when(i % 7 == 0, F.col("Time") * 1000).when(i % 11 == 0, F.lit(5)).otherwise(F.col("Time")),
        "sentiment_label": F.when(i % 13 != 0, F.when(i % 17 == 0, F.lit("")).otherwise(label))})


def _part(rows, writer: int, batch: int):
    i = F.col("Id")
    return rows.filter((i % WRITERS == writer) & (F.pmod(F.floor(i / WRITERS), F.lit(BATCHES)) == batch))


def _filled_store(spark, rows) -> PredictionStore:
    """Two writers, two batches each; every batch is sent twice, and one writer dies before a commit."""
    store = PredictionStore(spark, C._scratch(spark, "store"), fan=2)
    for batch in range(BATCHES):
        for writer in range(WRITERS):
            part = _part(rows, writer, batch)
            for _ in range(2):
                store.append(part, f"writer{writer}", batch)
    store._write_rows(_part(rows, 0, 0))
    return store


@register("stored_once", V("""
select Id, ProductId, prediction, strftime(inserted_at, '%Y-%m-%d') as day, cast(1 as bigint) as times, cast(1 as bigint) as before
from varied""", "predictions_keyed", ctes={"varied": VARIED_SQL}))
def q_stored_once(spark, d):
    """S7 + S9: replays, a dead writer and two writers give every row once; so does a reader that opened the table
    before the compaction of its closed days."""
    rows = _varied(spark, d)
    store = _filled_store(spark, rows)
    opened = store.predictions().select("Id", F.lit(0).alias("times"), F.lit(1).alias("before"))
    last = rows.select(F.max(F.to_date("inserted_at"))).first()[0]
    store.compact(last)
    now = store.predictions().select("Id", "ProductId", "prediction", "inserted_at")
    seen = opened.groupBy("Id").agg(F.count(F.lit(1)).alias("before"))
    return (now.groupBy("Id", "ProductId", "prediction", F.to_date("inserted_at").cast("string").alias("day"))
            .agg(F.count(F.lit(1)).alias("times")).join(seen, "Id", "left"))


@register("rollup_kpis", V(f"""
select 'total' as metric, '' as key, '' as label, count(*) as n from varied
union all
select 'labels', '', l, count(*) filter (where sentiment_label = l)
from varied, (values ('negative'), ('neutral'), ('positive')) t(l) group by l
union all
select 'year', cast(year(make_timestamp({C.NORM_TIME_SQL} * 1000000)) as varchar), coalesce(nullif(sentiment_label, ''), 'neutral'), count(*)
from varied where {C.NORM_TIME_SQL} is not null group by all
union all
select 'bin', cast(case when confidence is null or isnan(confidence) or confidence < 0.55 then 0
                        else least(9, (select count(*) - 1 from (values (0.5), (0.55), (0.6), (0.65), (0.7), (0.75), (0.8), (0.85), (0.9), (0.95)) e(x)
                                       where confidence >= e.x)) end as varchar), sentiment_label, count(*)
from varied where sentiment_label in ('negative', 'neutral', 'positive') group by all
union all
select 'top', id, 'positive', n from (
  select ProductId as id, count(*) as n from varied where sentiment_label = 'positive' group by 1
  order by n desc, id asc nulls last limit 10)""", "predictions_keyed", ctes={"varied": VARIED_SQL}))
def q_rollup_kpis(spark, d):
    """A13-A15, A17, A21 from the rollup alone, after replays and merging of its parts: (metric, key, label, n)."""
    store = _filled_store(spark, _varied(spark, d))
    store.compact("0001-01-01")
    parts = store.counts()
    none = F.lit("")

    def stacked(df, metric, key, names):
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("n")) for n in names])).alias("x")
        return df.select(F.lit(metric).alias("metric"), key.alias("key"), pairs).select("metric", "key", "x.label", "x.n")

    years = stacked(rollup.yearly_trend(parts), "year", F.col("year"), ["positive", "neutral", "negative"]).filter("n > 0")
    bins = rollup.confidence_histogram(parts).filter("n > 0").select(F.lit("bin").alias("metric"), F.col("bin").cast("string").alias("key"), "label", "n")
    top = rollup.top_products(parts, "positive").select(F.lit("top").alias("metric"), F.col("id").alias("key"), F.lit("positive").alias("label"),
                                                       F.col("count").alias("n"))
    total = rollup.total(parts).select(F.lit("total").alias("metric"), none.alias("key"), none.alias("label"), F.col("totalPredictions").alias("n"))
    return (total.unionByName(stacked(rollup.global_distribution(parts), "labels", none, ["negative", "neutral", "positive"]))
            .unionByName(years).unionByName(bins).unionByName(top))


@register("rollup_monthly", V(f"""
select m.month_num, m.month, coalesce(a.positive, 0) as positive, coalesce(a.neutral, 0) as neutral, coalesce(a.negative, 0) as negative
from {C.MONTHS_SQL} m(month_num, month) left join (
  select cast(month(make_timestamp(t * 1000000)) as integer) as month_num, {C.LABEL_COUNTS_SQL}
  from (select *, {C.NORM_TIME_SQL} as t from varied) x where year(make_timestamp(t * 1000000)) = 2024 group by 1) a using (month_num)""",
                              "predictions_keyed", ctes={"varied": VARIED_SQL}))
def q_rollup_monthly(spark, d):
    """A16 from the rollup alone."""
    return rollup.monthly_trend(_filled_store(spark, _varied(spark, d)).counts(), 2024)


@register("distinct_products_bitmaps", V(f"""
select b.batch as batches, (select count(distinct ProductId) from varied where (Id // {WRITERS}) % {BATCHES} <= b.batch) as products
from (values {", ".join(f"({b})" for b in range(BATCHES))}) b(batch)""", "predictions_keyed", ctes={"varied": VARIED_SQL}))
def q_distinct_products_bitmaps(spark, d):
    """Distinct products after each round of batches, from merged bitmaps; NULL is no product, new ids come with later batches."""
    store = _filled_store(spark, _varied(spark, d))
    store.compact("0001-01-01")
    versions = [(b, (b + 1) * WRITERS) for b in range(BATCHES)]
    rows = [bitmaps.distinct_count(store.id_bitmaps(v)).select(F.lit(b).alias("batches"), F.col("n").alias("products")) for b, v in versions]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


# ----------------------------------------------------------------- search
# Every match contains the literal runs "worth" and "ess"; RE2 and Java read the pattern alike.
INDEXED_PATTERN = "worth(l|L)?[a-z]ess"


def _indexed(spark, d):
    """The reviews stored in id order, and the trigram index of them."""
    stored, index = C._scratch(spark, "reviews"), C._scratch(spark, "trigrams")
    T.reviews(spark, d).repartitionByRange("Id").sortWithinPartitions("Id").write.parquet(stored)
    rows = spark.read.parquet(stored)
    textindex.write_index(T.spread(rows), index)
    return rows, spark.read.schema(textindex.POSTINGS).parquet(index)


def _search_sql(pattern: str) -> str:
    return V(f"""
select Id, ProductId, Summary from reviews
where coalesce(regexp_matches(Summary, '{pattern}', 'i'), false) or coalesce(regexp_matches(Text, '{pattern}', 'i'), false)
order by Id limit 20""", "reviews")


@register("search_indexed", _search_sql(INDEXED_PATTERN))
def q_search_indexed(spark, d):
    """P17 by the trigram index: a regex whose literal runs name the candidates."""
    rows, index = _indexed(spark, d)
    return textindex.search(rows, index, INDEXED_PATTERN, 20).select("Id", "ProductId", "Summary")


@register("search_indexed_unicode", _search_sql(C.UNICODE_TERM))
def q_search_indexed_unicode(spark, d):
    """P17 by the trigram index: a literal beyond ASCII, in another case than the texts."""
    rows, index = _indexed(spark, d)
    return textindex.search(rows, index, C.UNICODE_TERM, 20).select("Id", "ProductId", "Summary")


# ----------------------------------------------------------------- paging
@register("product_pages_indexed", V(f"""
select * exclude (rn) from (
  select p.*, (select count(*) from varied where ProductId = '{C.KEYED_PRODUCT}') as total,
         cast((rn - 1) // 20 + 1 as integer) as page, 20 as pageSize
  from (select {C.FORMAT_SQL}, row_number() over (order by Time desc nulls last, Id desc) as rn
        from varied where ProductId = '{C.KEYED_PRODUCT}') p)
where page in (1, 2, (total + 19) // 20)""", "predictions_keyed", ctes={"varied": VARIED_SQL}))
def q_product_pages_indexed(spark, d):
    """L3 / L4 by the rank index: the first, the second and the last page of a product, from the days that hold them."""
    stored, index = C._scratch(spark, "predictions"), C._scratch(spark, "page-counts")
    _varied(spark, d).repartitionByRange("ProductId", "Time").sortWithinPartitions("ProductId", "Time").write.parquet(stored)
    rows = spark.read.parquet(stored)
    for part in (0, 1):  # counted in two batches, which add up
        paging.page_counts(rows.filter(F.col("Id") % 2 == part)).write.mode("append").parquet(index)
    counts = spark.read.schema(paging.COUNTS).parquet(index)
    total = counts.filter(F.col("product") == C.KEYED_PRODUCT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pages = [paging.product_page(rows, counts, C.KEYED_PRODUCT, page=p) for p in sorted({1, 2, -(-total // 20)} - {0})]
    out = pages[0]
    for more in pages[1:]:
        out = out.unionByName(more)
    return out
