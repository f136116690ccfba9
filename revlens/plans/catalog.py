"""Registered queries: name -> Spark plan over the shared tables + DuckDB oracle SQL.

Every query reads whole tables (or frames Spark derives from them); limits
appear only where the operator itself is a top-k or a page.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from revlens.functions.mathfn import share_sql
from revlens.functions.timefn import MONTHS
from revlens.functions.hashing import unit_hash_sql
from revlens.functions.text import clean_text_sql
from revlens.operators import distribution, evaluation, feed, prep, products, profile, quality, trends, words
from revlens.sources import tables as T

V = T.with_views

# Parameters of the registered queries.
TREND_YEAR = 1998
KEYED_PRODUCT = "42"
BIG_PRODUCT = "7"
CURSOR = 5000
SEARCH_TERM = "worthless"

# ------------------------------------------------------------ SQL fragments
LABEL_COUNTS_SQL = """count(*) filter (where coalesce(nullif(sentiment_label, ''), 'neutral') = 'positive') as positive,
       count(*) filter (where coalesce(nullif(sentiment_label, ''), 'neutral') = 'neutral') as neutral,
       count(*) filter (where coalesce(nullif(sentiment_label, ''), 'neutral') = 'negative') as negative"""
KNOWN_COUNTS_SQL = """count(*) filter (where sentiment_label = 'negative') as negative,
       count(*) filter (where sentiment_label = 'neutral') as neutral,
       count(*) filter (where sentiment_label = 'positive') as positive"""
NORM_TIME_SQL = ("(case when (case when Time > 4000000000 then Time // 1000 else Time end) "
                 "between 788918400 and 1893456000 "
                 "then (case when Time > 4000000000 then Time // 1000 else Time end) end)")
FORMAT_SQL = f"""cast(Id as varchar) as id, coalesce(ProductId, '') as productId, coalesce(UserId, '') as userId,
       coalesce(Summary, '') as summary, coalesce(Text, '') as text,
       coalesce(strftime(make_timestamp({NORM_TIME_SQL} * 1000000), '%Y-%m-%d'), '') as time,
       case when sentiment_label is null or sentiment_label = '' then
            (case cast(trunc(coalesce(prediction, 0.0)) as integer) when 0 then 'negative'
                  when 1 then 'neutral' when 2 then 'positive' else 'neutral' end)
            else sentiment_label end as sentiment,
       try_cast(confidence as double) as confidence, true_sentiment as trueSentiment, prediction"""
MONTHS_SQL = "(values " + ", ".join(f"({i + 1}, '{m}')" for i, m in enumerate(MONTHS)) + ")"


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, oracle)
        return fn
    return deco


def _pb(spark, d):
    return T.predictions_big(spark, d)


def _pk(spark, d):
    return T.predictions_keyed(spark, d)


# ---------------------------------------------------------------- trends
@register("yearly_trend", T.with_views("""
select cast(year(make_timestamp(t * 1000000)) as varchar) as year,
       count(*) filter (where coalesce(nullif(sentiment_label, ''), 'neutral') = 'positive') as positive,
       count(*) filter (where coalesce(nullif(sentiment_label, ''), 'neutral') = 'neutral') as neutral,
       count(*) filter (where coalesce(nullif(sentiment_label, ''), 'neutral') = 'negative') as negative
from (select *, NORM as t from predictions_big) x where t is not null
group by 1 order by 1""".replace("NORM", NORM_TIME_SQL), "predictions_big"))
def q_yearly_trend(spark, d):
    return trends.yearly_trend(_pb(spark, d))


@register("monthly_trend", V(f"""
select m.month_num, m.month, coalesce(a.positive, 0) as positive, coalesce(a.neutral, 0) as neutral,
       coalesce(a.negative, 0) as negative
from {MONTHS_SQL} m(month_num, month) left join (
  select cast(month(make_timestamp(t * 1000000)) as integer) as month_num, {LABEL_COUNTS_SQL}
  from (select *, {NORM_TIME_SQL} as t from predictions_big) x
  where t is not null
    and t >= epoch(make_timestamp({TREND_YEAR}, 1, 1, 0, 0, 0))
    and t < epoch(make_timestamp({TREND_YEAR + 1}, 1, 1, 0, 0, 0))
  group by 1) a using (month_num)""", "predictions_big"))
def q_monthly_trend(spark, d):
    return trends.monthly_trend(_pb(spark, d), TREND_YEAR)


@register("activity_heatmap", V("""
select g.day, g.day_name, g.hour, coalesce(a.count, 0) as count, coalesce(a.negative, 0) as negative,
       coalesce(a.neutral, 0) as neutral, coalesce(a.positive, 0) as positive
from (select d.day, d.day_name, h.hour from
        (values (0,'Mon'),(1,'Tue'),(2,'Wed'),(3,'Thu'),(4,'Fri'),(5,'Sat'),(6,'Sun')) d(day, day_name),
        (select cast(range as integer) as hour from range(24)) h) g
left join (select cast(isodow(inserted_at) - 1 as integer) as day, cast(hour(inserted_at) as integer) as hour,
                  count(*) as count, count(*) filter (where sentiment_label = 'negative') as negative,
                  count(*) filter (where sentiment_label = 'neutral') as neutral,
                  count(*) filter (where sentiment_label = 'positive') as positive
           from predictions_keyed where inserted_at is not null group by 1, 2) a
on a.day = g.day and a.hour = g.hour""", "predictions_keyed"))
def q_activity_heatmap(spark, d):
    return trends.activity_heatmap(_pk(spark, d))


@register("throughput_windows", V("""
select w_start // 1000000 as window_start_s, (w_start + 60000000) // 1000000 as window_end_s, count(*) as n,
       round(count(*) / 60.0, 2) as rate
from (select (epoch_us(inserted_at) // 10000000) * 10000000 - k * 10000000 as w_start
      from predictions_keyed, (select range as k from range(6)) ks) x
group by w_start""", "predictions_keyed"))
def q_throughput_windows(spark, d):
    from pyspark.sql import functions as F
    w = trends.throughput_windows(_pk(spark, d))
    return w.select(F.unix_seconds("window_start").alias("window_start_s"),
                    F.unix_seconds("window_end").alias("window_end_s"), "n", "rate")


@register("throughput_series", V("""
select w_start // 1000000 as window_start_s, count(*) as n, round(count(*) / 60.0, 2) as rate
from (select (epoch_us(inserted_at) // 10000000) * 10000000 - k * 10000000 as w_start
      from predictions_keyed, (select range as k from range(6)) ks) x
group by w_start order by w_start desc limit 60""", "predictions_keyed"))
def q_throughput_series(spark, d):
    from pyspark.sql import functions as F
    return trends.throughput_series(_pk(spark, d)).select(
        F.unix_seconds("window_start").alias("window_start_s"), "n", "rate")


# ---------------------------------------------------------- distributions
@register("score_distribution", V("""
select Score, count(*) as n from reviews group by 1 order by 1""", "reviews"))
def q_score_distribution(spark, d):
    return distribution.score_distribution(T.reviews(spark, d))


@register("class_distribution", V(f"""
select label, n, {share_sql('n', 'sum(n) over ()', 100, 1)} as pct
from (select sentiment as label, count(*) as n from reviews group by 1) a""", "reviews"))
def q_class_distribution(spark, d):
    return distribution.class_distribution(T.labelled_reviews(spark, d), "sentiment")


@register("prediction_distribution", V("""
select sentiment_label, count(*) as n from predictions_big group by 1""", "predictions_big"))
def q_prediction_distribution(spark, d):
    return distribution.prediction_distribution(_pb(spark, d))


@register("global_distribution", V(f"""
select {KNOWN_COUNTS_SQL} from predictions_big""", "predictions_big"))
def q_global_distribution(spark, d):
    return distribution.global_distribution(_pb(spark, d))


_SHARES_SQL = f"""
select l.label, case l.label when 'negative' then negative when 'neutral' then neutral else positive end as n,
       {share_sql("case l.label when 'negative' then negative when 'neutral' then neutral else positive end",
                  'negative + neutral + positive', 100, 1)} as pct
from (select {KNOWN_COUNTS_SQL} from SRC) g, (values ('negative'), ('neutral'), ('positive')) l(label)"""


@register("label_shares", V(_SHARES_SQL.replace("SRC", "predictions_big"), "predictions_big"))
def q_label_shares(spark, d):
    return distribution.label_shares(_pb(spark, d))


KPI_NOW = "2023-06-01 00:00:00"  # a fixed clock before the end of the data, so that rows count


@register("kpi", V(f"""
select count(*) as totalPredictions, count(distinct ProductId) as uniqueProducts,
       round(count(*) filter (where inserted_at >= timestamp '{KPI_NOW}' - interval 60 seconds) / 60.0, 2) as throughput
from predictions_keyed""", "predictions_keyed"))
def q_kpi(spark, d):
    return distribution.kpi(_pk(spark, d), KPI_NOW)


@register("product_vs_global", V("""
select p.label, p.n as product_n, p.pct as product_pct, g.n as global_n, g.pct as global_pct
from prod p join allp g using (label)""", "predictions_keyed", ctes={
    "prod": _SHARES_SQL.replace("SRC", f"predictions_keyed where ProductId = '{KEYED_PRODUCT}'"),
    "allp": _SHARES_SQL.replace("SRC", "predictions_keyed")}))
def q_product_vs_global(spark, d):
    return distribution.product_vs_global(_pk(spark, d), KEYED_PRODUCT)


# ------------------------------------------------------------- evaluation
@register("confusion_counts", V("""
select true_sentiment as label, prediction, count(*) as n from predictions_big group by 1, 2""",
                                "predictions_big"))
def q_confusion_counts(spark, d):
    return evaluation.confusion_counts(_pb(spark, d))


_NAME = "(case {c} when 0 then 'negative' when 1 then 'neutral' when 2 then 'positive' end)"


@register("confusion_matrix", V(f"""
select {_NAME.format(c='g.t')} as true_label, {_NAME.format(c='g.p')} as predicted_label, coalesce(a.n, 0) as n
from (select t.range as t, p.range as p from range(3) t, range(3) p) g
left join (select cast(true_sentiment as integer) as t, cast(trunc(prediction) as integer) as p, count(*) as n
           from predictions_big
           where true_sentiment in (0, 1, 2) and prediction is not null
             and cast(trunc(prediction) as integer) between 0 and 2
           group by 1, 2) a on a.t = g.t and a.p = g.p""", "predictions_big"))
def q_confusion_matrix(spark, d):
    return evaluation.confusion_matrix(_pb(spark, d))


def _conf_bin_sql(c: str) -> str:
    edges = evaluation.CONF_BINS
    whens = " ".join(f"when {c} < {edges[i]} then {i - 1}" for i in range(1, len(edges)))
    return f"(case when {c} is null or isnan({c}) then 0 {whens} else 9 end)"


_HIST_SQL = f"""
select g.label, g.bin, g.bin_start, coalesce(a.n, 0) as n
from (select l.label, cast(b.bin as integer) as bin, b.bin_start
      from (values ('negative'), ('neutral'), ('positive')) l(label),
           (values {", ".join(f"({i}, cast({e} as double))" for i, e in enumerate(evaluation.CONF_BINS))})
             b(bin, bin_start)) g
left join (select sentiment_label as label, {_conf_bin_sql('confidence')} as bin, count(*) as n
           from SRC where sentiment_label in ('negative', 'neutral', 'positive') group by 1, 2) a
on a.label = g.label and a.bin = g.bin"""


@register("confidence_histogram", V(_HIST_SQL.replace("SRC", "predictions_big"), "predictions_big"))
def q_confidence_histogram(spark, d):
    return evaluation.confidence_histogram(_pb(spark, d))


@register("confidence_histogram_keyed", V(_HIST_SQL.replace("SRC", "predictions_keyed"), "predictions_keyed"))
def q_confidence_histogram_keyed(spark, d):
    return evaluation.confidence_histogram(_pk(spark, d))


@register("product_confidence_histogram", V(f"""
select g.bin, g.bin_start, coalesce(a.n, 0) as n
from (select bin, cast(bin_start as double) as bin_start
      from (values (0, 0.5), (1, 0.6), (2, 0.7), (3, 0.8), (4, 0.9)) v(bin, bin_start)) g
left join (select case when c >= 0.5 and c < 0.6 then 0 when c >= 0.6 and c < 0.7 then 1
                       when c >= 0.7 and c < 0.8 then 2 when c >= 0.8 and c < 0.9 then 3
                       when c >= 0.9 and c < 1.0 then 4 end as bin, count(*) as n
           from (select coalesce(confidence, 0.0) as c from predictions_keyed
                 where ProductId = '{KEYED_PRODUCT}') x
           group by 1) a using (bin)""", "predictions_keyed"))
def q_product_confidence_histogram(spark, d):
    return evaluation.product_confidence_histogram(_pk(spark, d), KEYED_PRODUCT)


_PER_CLASS_SQL = """
select k as cls, c[k * 3 + k + 1] as tp,
       c[k * 3 + 1] + c[k * 3 + 2] + c[k * 3 + 3] as support,
       c[k + 1] + c[3 + k + 1] + c[6 + k + 1] as predicted, total
from (select [count(*) filter (where t = 0 and p = 0), count(*) filter (where t = 0 and p = 1),
              count(*) filter (where t = 0 and p = 2), count(*) filter (where t = 1 and p = 0),
              count(*) filter (where t = 1 and p = 1), count(*) filter (where t = 1 and p = 2),
              count(*) filter (where t = 2 and p = 0), count(*) filter (where t = 2 and p = 1),
              count(*) filter (where t = 2 and p = 2)] as c, count(*) as total
      from (select cast(true_sentiment as integer) as t, cast(trunc(prediction) as integer) as p
            from predictions_big where true_sentiment is not null and prediction is not null) x
      where t between 0 and 2 and p between 0 and 2) w, (select range as k from range(3)) ks"""
_PRF_SQL = """
select *, case when precision + recall > 0 then 2.0 * precision * recall / (precision + recall) else 0.0 end as f1
from (select *, case when predicted > 0 then cast(tp as double) / predicted else 0.0 end as precision,
             case when support > 0 then cast(tp as double) / support else 0.0 end as recall from per_class) y"""


@register("classification_report", V("""
select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from (
  select (case cls when 0 then 'negative' when 1 then 'neutral' else 'positive' end) as class,
         precision, recall, f1, cast(support as bigint) as support from prf
  union all
  select 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) from prf
  union all
  select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), cast(sum(support) as bigint) from prf) r""",
                                     "predictions_big", ctes={"per_class": _PER_CLASS_SQL, "prf": _PRF_SQL}))
def q_classification_report(spark, d):
    return evaluation.classification_report(_pb(spark, d))


@register("model_metrics", V("""
select round(sum(tp) / max(total), 6) as accuracy,
       round(sum(precision * support) / sum(support), 6) as weighted_precision,
       round(sum(recall * support) / sum(support), 6) as weighted_recall,
       round(sum(f1 * support) / sum(support), 6) as f1_weighted,
       round(avg(f1), 6) as f1_macro, cast(max(total) as bigint) as n
from prf""", "predictions_big", ctes={"per_class": _PER_CLASS_SQL, "prf": _PRF_SQL}))
def q_model_metrics(spark, d):
    return evaluation.model_metrics(_pb(spark, d))


# --------------------------------------------------------------- products
@register("top_products", V("""
select ProductId as id, count(*) as count from predictions_big where sentiment_label = 'positive'
group by 1 order by count desc, id asc nulls last limit 10""", "predictions_big"))
def q_top_products(spark, d):
    return products.top_products(_pb(spark, d), "positive", 10)


@register("top_products_any", V("""
select ProductId as id, count(*) as count from predictions_keyed
group by 1 order by count desc, id asc nulls last limit 10""", "predictions_keyed"))
def q_top_products_any(spark, d):
    return products.top_products(_pk(spark, d), None, 10)


@register("all_products", V("""
select ProductId as id, count(*) as count from predictions_big where ProductId is not null and ProductId <> ''
group by 1 order by count desc, id asc limit 2000""", "predictions_big"))
def q_all_products(spark, d):
    return products.all_products(_pb(spark, d), 2000)


@register("product_id_search", V(f"""
select ProductId as id, count(*) as count from predictions_big
where ProductId is not null and contains(lower(ProductId), '{BIG_PRODUCT}1') group by 1""", "predictions_big"))
def q_product_id_search(spark, d):
    return products.product_id_search(_pb(spark, d), BIG_PRODUCT + "1")


@register("product_list", V("""
select id, count, src, pos from (
  select *, row_number() over (partition by id order by src, pos) as k from (
    select id, count, src, cast(row_number() over (partition by src order by count desc, id asc) as integer) as pos
    from (
      (select ProductId as id, count(*) as count, 0 as src from predictions_big
       where sentiment_label = 'positive' group by 1 order by count desc, id asc nulls last limit 10)
      union all
      (select ProductId as id, count(*) as count, 1 as src from predictions_big
       where sentiment_label = 'negative' group by 1 order by count desc, id asc nulls last limit 10)) u) r) z
where k = 1""", "predictions_big"))
def q_product_list(spark, d):
    return products.product_list(_pb(spark, d))


@register("product_summary", V(f"""
select '{KEYED_PRODUCT}' as id, * from (
  select count(*) as totalReviews, {KNOWN_COUNTS_SQL}
  from predictions_keyed where ProductId = '{KEYED_PRODUCT}') a where totalReviews > 0""", "predictions_keyed"))
def q_product_summary(spark, d):
    return products.product_summary(_pk(spark, d), KEYED_PRODUCT)


@register("product_yearly", V(f"""
select cast(year(make_timestamp(t * 1000000)) as varchar) as year, {LABEL_COUNTS_SQL}
from (select *, {NORM_TIME_SQL} as t from predictions_big where ProductId = '{BIG_PRODUCT}') x
where t is not null
group by 1""", "predictions_big"))
def q_product_yearly(spark, d):
    return products.product_yearly(_pb(spark, d), BIG_PRODUCT)


@register("product_page_counts", V(f"""
select case when grouping(year) = 1 then 'total' else 'year' end as level, year, count(*) as totalReviews,
       case when grouping(year) = 1 then count(*) filter (where sentiment_label = 'negative')
            else count(*) filter (where coalesce(nullif(sentiment_label, ''), 'neutral') = 'negative') end
         as negative,
       case when grouping(year) = 1 then count(*) filter (where sentiment_label = 'neutral')
            else count(*) filter (where coalesce(nullif(sentiment_label, ''), 'neutral') = 'neutral') end
         as neutral,
       case when grouping(year) = 1 then count(*) filter (where sentiment_label = 'positive')
            else count(*) filter (where coalesce(nullif(sentiment_label, ''), 'neutral') = 'positive') end
         as positive
from (select *, cast(year(make_timestamp({NORM_TIME_SQL} * 1000000)) as varchar) as year
      from predictions_big where ProductId = '{BIG_PRODUCT}') x
group by rollup (year)
having (grouping(year) = 1 or year is not null) and count(*) > 0""", "predictions_big"))
def q_product_page_counts(spark, d):
    return products.product_page_counts(_pb(spark, d), BIG_PRODUCT)


@register("product_newest", V(f"""
select {FORMAT_SQL} from predictions_keyed where ProductId = '{KEYED_PRODUCT}'
order by Time desc nulls last, Id desc limit 20""", "predictions_keyed"))
def q_product_newest(spark, d):
    return products.product_newest(_pk(spark, d), KEYED_PRODUCT)


@register("product_reviews", V(f"""
select p.*, t.total, 2 as page, 20 as pageSize from (
  select {FORMAT_SQL} from predictions_keyed where ProductId = '{KEYED_PRODUCT}' and sentiment_label = 'neutral'
  order by Time desc nulls last, Id desc limit 20 offset 20) p,
 (select count(*) as total from predictions_keyed
  where ProductId = '{KEYED_PRODUCT}' and sentiment_label = 'neutral') t""", "predictions_keyed"))
def q_product_reviews(spark, d):
    return products.product_reviews(_pk(spark, d), KEYED_PRODUCT, "neutral", page=2, page_size=20)


# ------------------------------------------------------------------- feed
@register("recent", V(f"""
select {FORMAT_SQL} from predictions_keyed order by inserted_at desc nulls last, Id desc limit 50""",
                      "predictions_keyed"))
def q_recent(spark, d):
    return feed.format_prediction(feed.recent(_pk(spark, d), 50))


@register("recent_negative", V(f"""
select {FORMAT_SQL} from predictions_keyed where sentiment_label = 'negative'
order by inserted_at desc nulls last, Id desc limit 50""", "predictions_keyed"))
def q_recent_negative(spark, d):
    return feed.format_prediction(feed.recent(_pk(spark, d), 50, "negative"))


@register("after_cursor", V(f"""
select {FORMAT_SQL} from predictions_keyed where Id > {CURSOR} order by Id asc limit 20""", "predictions_keyed"))
def q_after_cursor(spark, d):
    return feed.format_prediction(feed.after_cursor(_pk(spark, d), CURSOR, 20))


@register("latest", V(f"""
select {FORMAT_SQL} from predictions_keyed order by inserted_at desc nulls last, Id desc limit 1""",
                      "predictions_keyed"))
def q_latest(spark, d):
    return feed.format_prediction(feed.latest(_pk(spark, d)))


@register("search", V(f"""
select Id, ProductId, Summary from reviews
where coalesce(regexp_matches(Summary, '{SEARCH_TERM}', 'i'), false)
   or coalesce(regexp_matches(Text, '{SEARCH_TERM}', 'i'), false)
order by Id limit 20""", "reviews"))
def q_search(spark, d):
    return feed.search(T.reviews(spark, d), SEARCH_TERM, 20).select("Id", "ProductId", "Summary")


UNICODE_TERM = "CIÓN"


@register("search_unicode", V(f"""
select Id, ProductId, Summary from reviews
where coalesce(regexp_matches(Summary, '{UNICODE_TERM}', 'i'), false)
   or coalesce(regexp_matches(Text, '{UNICODE_TERM}', 'i'), false)
order by Id limit 20""", "reviews"))
def q_search_unicode(spark, d):
    """The match ignores case beyond ASCII."""
    return feed.search(T.reviews(spark, d), UNICODE_TERM, 20).select("Id", "ProductId", "Summary")


@register("text_preview", V("""
select Id, case when length(coalesce(Text, '')) > 100 then substring(coalesce(Text, ''), 1, 100) || '…'
                else coalesce(Text, '') end as preview
from reviews""", "reviews"))
def q_text_preview(spark, d):
    return T.reviews(spark, d).select("Id", feed.text_preview("Text", 100).alias("preview"))


# ------------------------------------------------------------------- text
def _cleaned(spark, d):
    """Cleaned, labelled reviews (P1 + P2 + P3) with their display label."""
    from revlens.functions.labels import label_name
    return (prep.clean_reviews(T.spread(T.reviews(spark, d)))
            .withColumn("sentiment_label", label_name("sentiment")))


def _split(spark, d):
    return prep.stratified_split(_cleaned(spark, d))


_CLEANED_SQL = f"""
select Id, ProductId, UserId, Time, Summary, Text,
       {clean_text_sql("coalesce(Summary, '') || '. ' || coalesce(Text, '')")} as cleaned, Score, sentiment,
       case sentiment when 0 then 'negative' when 1 then 'neutral' when 2 then 'positive' end as sentiment_label
from reviews"""
_U_SPLIT = unit_hash_sql("Id", 42)
_U_EXAMPLE = unit_hash_sql("Id", 42, "example")
_SPLIT_SQL = f"""
select *, case when {_U_SPLIT} < 0.8 then 'train' when {_U_SPLIT} < 0.9 then 'val' else 'test' end as split
from cleaned"""


@register("clean_text", V("""select Id, cleaned from cleaned""", "reviews", ctes={"cleaned": _CLEANED_SQL}))
def q_clean_text(spark, d):
    return _cleaned(spark, d).select("Id", "cleaned")


@register("word_frequencies", V(f"""
select label, rank, word, n, 10 + cast(floor(n / max(n) over (partition by label) * 32 + 0.5) as integer) as size
from (select label, word, n, cast(row_number() over (partition by label order by n desc, word asc) as integer) as rank
      from (select label, word, count(*) as n from (
              select label, unnest(string_split(lower(src), ' ')) as word from (
                select sentiment_label as label,
                       case when length(coalesce(cleaned, '')) > 2 then cleaned else coalesce(Text, '') end as src
                from cleaned where sentiment_label in ('negative', 'neutral', 'positive')) s) w
            where not list_contains([{", ".join(repr(x) for x in words.WORD_STOPWORDS)}], word)
              and regexp_matches(word, '^[a-z]{{3,15}}\n?$')
            group by 1, 2) c) r
where rank <= 25""", "reviews", ctes={"cleaned": _CLEANED_SQL}))
def q_word_frequencies(spark, d):
    return words.word_frequencies(_cleaned(spark, d), 25)


@register("text_length_stats", V("""
select round(avg(length(coalesce(Text, ''))), 6) as avg_text_len,
       round(avg(length(coalesce(Summary, ''))), 6) as avg_summary_len,
       count(*) filter (where Summary is null) as summary_nulls, count(*) as rows
from reviews""", "reviews"))
def q_text_length_stats(spark, d):
    return profile.text_length_stats(T.reviews(spark, d))


_REVIEW_COLS = [("Id", "bigint"), ("ProductId", "string"), ("UserId", "string"), ("Time", "bigint"),
                ("Score", "int"), ("Summary", "string"), ("Text", "string")]


@register("null_profile", V(" union all ".join(
    f"select {i} as position, '{c}' as \"column\", '{t}' as dtype, count(*) filter (where {c} is null) as nulls,"
    f" count(*) as rows from reviews" for i, (c, t) in enumerate(_REVIEW_COLS)), "reviews"))
def q_null_profile(spark, d):
    return profile.null_profile(T.reviews(spark, d))


@register("preprocessing_stats", V("""
select count(*) as total, count(*) filter (where split = 'train') as train,
       count(*) filter (where split = 'val') as val, count(*) filter (where split = 'test') as test,
       count(*) filter (where sentiment = 0) as negative, count(*) filter (where sentiment = 1) as neutral,
       count(*) filter (where sentiment = 2) as positive,
       round(avg(length(coalesce(cleaned, ''))), 6) as avg_cleaned_len,
       count(*) filter (where coalesce(cleaned, '') = '') as empty_cleaned
from splits""", "reviews", ctes={"cleaned": _CLEANED_SQL, "splits": _SPLIT_SQL}))
def q_preprocessing_stats(spark, d):
    return profile.preprocessing_stats(_split(spark, d))


@register("split_assignment", V("""select Id, sentiment, split from splits""", "reviews",
                                ctes={"cleaned": _CLEANED_SQL, "splits": _SPLIT_SQL}))
def q_split_assignment(spark, d):
    return _split(spark, d).select("Id", "sentiment", "split")


@register("split_assignment_exact", V(f"""
select Id, sentiment,
       case when r < n - (n * 20 + 99) // 100 then 'train'
            when r < n - (((n * 20 + 99) // 100) * 10 + 19) // 20 then 'val' else 'test' end as split
from (select Id, sentiment, row_number() over (partition by sentiment order by {_U_SPLIT}, Id) - 1 as r,
             count(*) over (partition by sentiment) as n from cleaned) x""", "reviews", ctes={"cleaned": _CLEANED_SQL}))
def q_split_assignment_exact(spark, d):
    """L9, exact per-class 80/10/10 sizes via the range-partitioned rank."""
    return prep.stratified_split_exact(_cleaned(spark, d)).select("Id", "sentiment", "split")


@register("split_exact_wide", V(f"""
select Id, sentiment, Summary, Text, cleaned,
       case when r < n - (n * 20 + 99) // 100 then 'train'
            when r < n - (((n * 20 + 99) // 100) * 10 + 19) // 20 then 'val' else 'test' end as split
from (select *, row_number() over (partition by sentiment order by {_U_SPLIT}, Id) - 1 as r,
             count(*) over (partition by sentiment) as n from cleaned) x""", "reviews", ctes={"cleaned": _CLEANED_SQL}))
def q_split_exact_wide(spark, d):
    """L9, exact sizes, with the texts kept."""
    return prep.stratified_split_exact(_cleaned(spark, d)).select("Id", "sentiment", "Summary", "Text", "cleaned", "split")


# A fixture with the corpus's imbalance: far more positives than 3 x neutral (the fraction is below 1).
_SKEWED_SQL = """select Id, case when Id % 20 = 0 then 1 when Id % 20 < 4 then 0 else 2 end as sentiment from reviews"""
_U_BAL2 = unit_hash_sql("Id", 42, "undersample")
_U_FOLD = unit_hash_sql("Id", 42, "fold")


def _skewed(spark, d):
    from pyspark.sql import functions as F
    k = F.col("Id") % 20
    return T.reviews(spark, d).select("Id", F.when(k == 0, 1).when(k < 4, 0).otherwise(2).alias("sentiment"))


@register("undersample_skewed", V(f"""
select Id, sentiment from skewed where sentiment <> 2
   or {_U_BAL2} < (select least(3.0 * count(*) filter (where sentiment = 1) / count(*) filter (where sentiment = 2), 1.0) from skewed)""",
                                  "reviews", ctes={"skewed": _SKEWED_SQL}))
def q_undersample_skewed(spark, d):
    """L8 + U1 where rows are dropped: 16 of 20 positive, 1 of 20 neutral."""
    return prep.undersample_majority(_skewed(spark, d))


@register("cv_folds", V(f"""
select cast(floor({_U_FOLD} * 3) as integer) as fold, sentiment, count(*) as n from skewed group by 1, 2""",
                        "reviews", ctes={"skewed": _SKEWED_SQL}))
def q_cv_folds(spark, d):
    """M3: size of each fold and class; every fold holds every class."""
    from pyspark.sql import functions as F
    from revlens.plans import training
    return (training.with_folds(_skewed(spark, d)).groupBy("fold", "sentiment").agg(F.count(F.lit(1)).alias("n")))


@register("split_report", V(f"""
select split, sentiment, n, split_rows, {share_sql('n', 'split_rows', 100, 1)} as pct_of_split,
       {share_sql('split_rows', 'cast(sum(n) over () as bigint)', 100, 1)} as split_pct
from (select split, sentiment, n, cast(sum(n) over (partition by split) as bigint) as split_rows
      from (select split, sentiment, count(*) as n from splits group by 1, 2) a) b""",
                            "reviews", ctes={"cleaned": _CLEANED_SQL, "splits": _SPLIT_SQL}))
def q_split_report(spark, d):
    return profile.split_report(_split(spark, d))


@register("split_verify", V("""
select split, count(*) as rows, array_to_string(list_sort(list_distinct(list(cast(sentiment as varchar)))), ',')
       as labels, count(*) filter (where sentiment is null) as label_nulls
from splits group by 1""", "reviews", ctes={"cleaned": _CLEANED_SQL, "splits": _SPLIT_SQL}))
def q_split_verify(spark, d):
    return profile.split_verify(_split(spark, d))


_BAL_FRACTION_SQL = """(select case when count(*) filter (where sentiment = 2) = 0 then 1.0
        else least(3.0 * count(*) filter (where sentiment = 1) / count(*) filter (where sentiment = 2), 1.0) end
        from train)"""
_U_BAL = unit_hash_sql("Id", 42, "undersample")
_BALANCED_SQL = f"""select * from train where sentiment is not null
  and (sentiment <> 2 or {_U_BAL} < {_BAL_FRACTION_SQL})"""


def _balanced(spark, d):
    train = _split(spark, d).filter("split = 'train'")
    return prep.drop_unusable(prep.undersample_majority(train))


@register("undersample_majority", V("""select Id, sentiment from balanced""", "reviews", ctes={
    "cleaned": _CLEANED_SQL, "splits": _SPLIT_SQL, "train": "select * from splits where split = 'train'",
    "balanced": _BALANCED_SQL + " and cleaned is not null and cleaned <> ''"}))
def q_undersample_majority(spark, d):
    return _balanced(spark, d).select("Id", "sentiment")


@register("class_weights", V("""
select sentiment, n, cast(sum(n) over () as double) / (3.0 * n) as classWeight
from (select sentiment, count(*) as n from balanced where sentiment in (0, 1, 2) group by 1) a""", "reviews", ctes={
    "cleaned": _CLEANED_SQL, "splits": _SPLIT_SQL, "train": "select * from splits where split = 'train'",
    "balanced": _BALANCED_SQL + " and cleaned is not null and cleaned <> ''"}))
def q_class_weights(spark, d):
    return prep.class_weights(_balanced(spark, d))


@register("examples_per_class", V(f"""
select Id, sentiment, example from (
  select Id, sentiment, cast(row_number() over (partition by sentiment order by {_U_EXAMPLE}, Id) as integer)
         as example from cleaned) x where example <= 2""", "reviews", ctes={"cleaned": _CLEANED_SQL}))
def q_examples_per_class(spark, d):
    return prep.examples_per_class(_cleaned(spark, d), 2).select("Id", "sentiment", "example")


# --------------------------------------------------------------------- ML
# Training reads only these columns of the written split table.
_TRAIN_COLS = ("Id", "cleaned", "sentiment", "split")


def _written_split(spark, d):
    """The split table, written once to the shared folder and read back (nothing stays cached)."""
    path = _scratch(spark, "split")
    _split(spark, d).select(*_TRAIN_COLS).write.parquet(path)
    return spark.read.parquet(path)


@register("score_test_split")
def q_score_test_split(spark, d):
    """M1 + M2 + M6 + P5 + P6: fit the weighted TF-IDF logistic regression on the
    balanced train split and score the test split (no SQL oracle: model fit)."""
    from pyspark.sql import functions as F
    from revlens.plans import scoring, training
    split_df = _written_split(spark, d)
    balanced, _, test = training.training_tables(split_df)
    model = training.fit_logreg(balanced)
    scored = scoring.score(model, test)
    return scored.select("Id", "sentiment", "prediction", "sentiment_label",
                         F.round("confidence", 6).alias("confidence"))


@register("model_selection")
def q_model_selection(spark, d):
    """M2 + M4 + M5 + A9 + S13: logistic regression vs naive Bayes on validation F1,
    test metrics of the winner, as the one-row metadata record (M3: logistic
    regression cross-validated over the whole grid, 3 x 2 points in 3 folds)."""
    from revlens.plans import training
    split_df = _written_split(spark, d)
    result = training.train(split_df)
    return training.metadata_frame(spark, result["metadata"]).drop("trained_on")


# ---------------------------------------------------------------- quality
_CHECK_COLS = '"check", status, value, threshold, detail'
# The checks are measured against a fixed clock, so that they can fail and give the same answer when re-run.
CHECK_NOW = "2024-01-15 12:00:00"
EARLY_NOW = "2023-06-01 00:00:00"
_NOW_SQL = f"timestamp '{CHECK_NOW}'"
_FRESH_SQL = f"""
select 'stats_freshness' as "check",
       case when total = 0 then 'skip' when recent = 0 then 'fail' else 'ok' end as status,
       cast(recent as double) / 120.0 as value, cast(0.0 as double) as threshold,
       '+' || recent || ' rows/2min, total ' || total as detail
from (select count(*) as total,
             count(*) filter (where inserted_at >= {_NOW_SQL} - interval 120 seconds) as recent
      from predictions_keyed) a"""
_QUALITY_SQL = """
select 'prediction_labels' as "check",
       case when n = 0 then 'skip' when unlabelled > 10 then 'fail' else 'ok' end as status,
       cast(unlabelled as double) as value, cast(10.0 as double) as threshold, unlabelled || '/' || n || ' unlabelled' as detail
from q
union all
select 'prediction_confidence', case when n = 0 then 'skip' when mean_conf < 0.5 then 'fail' else 'ok' end,
       round(mean_conf, 6), cast(0.5 as double), 'mean confidence over ' || n || ' rows, ' || null_conf || ' without confidence'
from q"""
_Q_CTE = """select count(*) as n, count(*) filter (where sentiment_label is null or sentiment_label = '') as unlabelled,
       avg(coalesce(confidence, 0.0)) as mean_conf, count(*) filter (where confidence is null) as null_conf
from (select * from predictions_keyed order by inserted_at desc nulls last, Id desc limit 50) x"""
_LATENCY_SQL = f"""
select 'pipeline_latency' as "check",
       case when last is null then 'skip' when lag > 60 then 'fail' else 'ok' end as status,
       lag as value, cast(60.0 as double) as threshold,
       coalesce('lag ' || cast(round(lag, 0) as bigint) || ' s', 'no rows') as detail
from (select max(inserted_at) as last,
             (epoch_us({_NOW_SQL}) - epoch_us(max(inserted_at))) / 1e6 as lag from predictions_keyed) a"""
_BALANCE_SQL = """
select 'sentiment_balance' as "check",
       case when total < 100 then 'skip' when cast(positive as double) * 100.0 / total > 95.0 then 'fail'
            when cast(negative as double) * 100.0 / total > 60.0 then 'fail' else 'ok' end as status,
       round(cast(positive as double) * 100.0 / total, 6) as value, cast(95.0 as double) as threshold,
       'positive ' || positive || ', negative ' || negative || ', total ' || total as detail
from (select count(*) as total, count(*) filter (where sentiment_label = 'negative') as negative,
             count(*) filter (where sentiment_label = 'positive') as positive from predictions_keyed) a"""
_SNAP_SQL = """
select run_s, 'events' as topic, cast(sum(coalesce(n, 0)) over (order by run_s) as bigint) as total
from (select unnest(range(min(run_s), max(run_s) + 300, 300)) as run_s from per) g left join per using (run_s)"""
_PER_SQL = "select (epoch_us(ts) // 1000000 // 300 + 1) * 300 as run_s, count(*) as n from events group by 1"
_TRAFFIC_SQL = """
select run_s, topic, 'source_traffic' as "check",
       case when total = 0 then 'skip' when prev is null then 'ok' when total - prev = 0 then 'fail' else 'ok' end
         as status,
       cast(coalesce(total - prev, 0) as double) as value, cast(0.0 as double) as threshold,
       case when total = 0 then 'topic empty' when prev is null then 'first run, offset ' || total
            else '+' || (total - prev) || ' messages, offset ' || total end as detail
from (select *, lag(total) over (partition by topic order by run_s) as prev from snaps) s"""


def _snapshots(spark, d):
    return quality.event_snapshots(T.table(spark, d, "events"))


def _traffic(spark, d):
    from pyspark.sql import functions as F
    return (quality.traffic(_snapshots(spark, d))
            .withColumn("run_s", F.unix_seconds("run_time")).drop("run_time"))


@register("stats_freshness", V(_FRESH_SQL, "predictions_keyed"))
def q_stats_freshness(spark, d):
    return quality.freshness(_pk(spark, d), CHECK_NOW)


@register("prediction_quality", V(_QUALITY_SQL, "predictions_keyed", ctes={"q": _Q_CTE}))
def q_prediction_quality(spark, d):
    return quality.prediction_quality(_pk(spark, d))


@register("pipeline_latency", V(_LATENCY_SQL, "predictions_keyed"))
def q_pipeline_latency(spark, d):
    return quality.latency(_pk(spark, d), CHECK_NOW)


@register("sentiment_balance", V(_BALANCE_SQL, "predictions_keyed"))
def q_sentiment_balance(spark, d):
    return quality.balance(_pk(spark, d))


@register("source_traffic", V(_TRAFFIC_SQL, "predictions_keyed",
                              ctes={"per": _PER_SQL, "snaps": _SNAP_SQL}))
def q_source_traffic(spark, d):
    return _traffic(spark, d)


_LIVE = "event_type in ('purchase', 'signup')"
_LIVE_SNAP_SQL = _SNAP_SQL.replace("'events' as topic", "'predictions-live' as topic")
_LIVE_TRAFFIC_SQL = _TRAFFIC_SQL.replace("'source_traffic'", "'live_traffic'")


@register("live_traffic", V(_LIVE_TRAFFIC_SQL, "predictions_keyed", ctes={
    "per": _PER_SQL.replace("from events", f"from events where {_LIVE}"), "snaps": _LIVE_SNAP_SQL}))
def q_live_traffic(spark, d):
    """Q3: the same check over the snapshots of the live topic (here: the events that end in a positive prediction)."""
    from pyspark.sql import functions as F
    live = T.table(spark, d, "events").filter(_LIVE)
    return (quality.traffic(quality.event_snapshots(live, topic="predictions-live"), "live_traffic")
            .withColumn("run_s", F.unix_seconds("run_time")).drop("run_time"))


def _cases_sql(sql: str) -> str:
    """One check over three tables and clocks: fresh (every row is newer than the clock less the window), late, empty."""
    parts = []
    for case, now, where in (("early", EARLY_NOW, "true"), ("late", CHECK_NOW, "true"), ("empty", CHECK_NOW, "Id < 0")):
        body = sql.replace(_NOW_SQL, f"timestamp '{now}'").replace("from predictions_keyed", f"from predictions_keyed where {where}")
        parts.append(f"select '{case}' as case_name, * from ({body}) t_{case}")
    return " union all ".join(parts)


def _cases(check, pred):
    from pyspark.sql import functions as F
    out = None
    for case, now, rows in (("early", EARLY_NOW, pred), ("late", CHECK_NOW, pred), ("empty", CHECK_NOW, pred.filter("Id < 0"))):
        part = check(rows, now).withColumn("case_name", F.lit(case))
        out = part if out is None else out.unionByName(part)
    return out


@register("freshness_cases", V(_cases_sql(_FRESH_SQL), "predictions_keyed"))
def q_freshness_cases(spark, d):
    """Q4 ok, fail and skip: fresh, late and empty table."""
    return _cases(quality.freshness, _pk(spark, d))


@register("latency_cases", V(_cases_sql(_LATENCY_SQL), "predictions_keyed"))
def q_latency_cases(spark, d):
    """Q6 ok, fail and skip."""
    return _cases(quality.latency, _pk(spark, d))


@register("balance_cases", V(" union all ".join(
    f"select '{n}' as case_name, * from ({_BALANCE_SQL.replace('from predictions_keyed', 'from predictions_keyed where ' + w)}) t_{n}"
    for n, w in (("all", "true"), ("negative", "sentiment_label = 'negative'"), ("positive", "sentiment_label = 'positive'"),
                 ("few", "Id < 50"))), "predictions_keyed"))
def q_balance_cases(spark, d):
    """Q7 ok, fail on either side, and skip."""
    from pyspark.sql import functions as F
    out = None
    for name, where in (("all", "true"), ("negative", "sentiment_label = 'negative'"),
                        ("positive", "sentiment_label = 'positive'"), ("few", "Id < 50")):
        part = quality.balance(_pk(spark, d).filter(where)).withColumn("case_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_STEPS = ("case \"check\" when 'inputs_exist' then 1 when 'source_traffic' then 2 when 'live_traffic' then 3 "
          "when 'stats_freshness' then 4 when 'prediction_labels' then 5 when 'prediction_confidence' then 5 "
          "when 'pipeline_latency' then 6 when 'sentiment_balance' then 7 end")


@register("quality_report", V(f"""
select "check", case when ff is not null and step > ff then 'skip' else status end as status,
       value, threshold, detail, step
from (select *, min(case when status = 'fail' then step end) over () as ff
      from (select *, {_STEPS} as step from (
        select 'inputs_exist' as "check", 'ok' as status, cast(0.0 as double) as value,
               cast(0.0 as double) as threshold,
               'all inputs present' as detail
        union all (select {_CHECK_COLS} from traffic order by run_s desc limit 1)
        union all (select {_CHECK_COLS} from live order by run_s desc limit 1)
        union all {_FRESH_SQL}
        union all {_QUALITY_SQL}
        union all {_LATENCY_SQL}
        union all {_BALANCE_SQL}) u) v) w""", "predictions_keyed",
                              ctes={
                                  "q": _Q_CTE, "per": _PER_SQL, "snaps": _SNAP_SQL, "traffic": _TRAFFIC_SQL,
                                  "live_per": _PER_SQL.replace("from events", f"from events where {_LIVE}"),
                                  "live_snaps": _LIVE_SNAP_SQL.replace("from per", "from live_per").replace("join per", "join live_per"),
                                  "live": _LIVE_TRAFFIC_SQL.replace("from snaps", "from live_snaps")}))
def q_quality_report(spark, d):
    import os
    from pyspark.sql import functions as F
    pk = _pk(spark, d)
    inputs = quality.inputs_exist(spark, {t: os.path.join(d, f"{t}.parquet") for t in ("events", "lineitem")})
    last_run, last_live = (runs.orderBy(F.desc("run_s")).limit(1) for runs in (_traffic(spark, d), q_live_traffic(spark, d)))
    return quality.report(inputs, last_run, last_live, quality.table_checks(pk, CHECK_NOW), quality.prediction_quality(pk))


_U_SAMPLE = unit_hash_sql("Id", 42, "sample")


@register("sample_per_label", V(f"""
select Id, sentiment_label from (
  select Id, sentiment_label,
         row_number() over (partition by sentiment_label order by {_U_SAMPLE}, Id) as rn
  from cleaned) x where rn <= 100""", "reviews", ctes={"cleaned": _CLEANED_SQL}))
def q_sample_per_label(spark, d):
    """An exact, seeded sample of 100 reviews per label (the sampler behind A19)."""
    return words.sample_by_label(_cleaned(spark, d), 100).select("Id", "sentiment_label")


@register("word_frequencies_sampled", V(f"""
select label, rank, word, n, 10 + cast(floor(n / max(n) over (partition by label) * 32 + 0.5) as integer) as size
from (select label, word, n, cast(row_number() over (partition by label order by n desc, word asc) as integer) as rank
      from (select label, word, count(*) as n from (
              select label, unnest(string_split(lower(src), ' ')) as word from (
                select sentiment_label as label,
                       case when length(coalesce(cleaned, '')) > 2 then cleaned else coalesce(Text, '') end as src
                from (select * from (select *, row_number() over (partition by sentiment_label
                                                  order by {_U_SAMPLE}, Id) as rn from cleaned) z
                      where rn <= 5000) smp
                where sentiment_label in ('negative', 'neutral', 'positive')) s) w
            where not list_contains([{", ".join(repr(x) for x in words.WORD_STOPWORDS)}], word)
              and regexp_matches(word, '^[a-z]{{3,15}}\n?$')
            group by 1, 2) c) r
where rank <= 25""", "reviews", ctes={"cleaned": _CLEANED_SQL}))
def q_word_frequencies_sampled(spark, d):
    """A19 with the reference's 5000 reviews per label, drawn by the exact seeded sampler."""
    return words.word_frequencies(_cleaned(spark, d), 25, sample_per_label=5000)


# -------------------------------------------------------------- streaming
MAX_FILES_PER_BATCH = 64


def _as_file_stream(spark, df, name: str, batches: int = 4):
    """Replay ``df`` in ingest-time order as a file stream of at least ``batches`` micro-batches.

    The file source delivers files by the time they were written, so the time
    slices are written one after the other (the slice range reaches the scan). A
    slice is one micro-batch of at most MAX_FILES_PER_BATCH files of
    scan-split size: the batch does not grow with the table.
    """
    from pyspark.sql import functions as F
    path = _scratch(spark, name)
    splits = df.rdd.getNumPartitions()
    slices = max(batches, -(-splits // MAX_FILES_PER_BATCH))
    files = -(-splits // slices)
    ts = F.col("inserted_at")
    cuts = df.select(F.percentile_approx(F.unix_micros(ts), [i / slices for i in range(1, slices)])).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    for lo, hi in zip(edges, edges[1:]):
        rows = df if lo is None else df.filter(ts > F.timestamp_micros(F.lit(lo)))
        if hi is not None:
            below = ts <= F.timestamp_micros(F.lit(hi))
            rows = rows.filter(below | ts.isNull() if lo is None else below)
        rows.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _run_complete(stream_df, spark, name: str):
    """Run a complete-mode aggregate to its end and read the newest snapshot table."""
    from revlens.streaming import monitors
    path = _scratch(spark, name)
    q = monitors.start_snapshot_query(stream_df, path, _scratch(spark, name + "-ckpt"), available_now=True)
    q.awaitTermination()
    return monitors.read_snapshot(spark, path, q)


@register("stream_label_counters", V("""
select coalesce(sentiment_label, 'unknown') as label, count(*) as count from predictions_keyed group by 1""",
                                     "predictions_keyed"))
def q_stream_label_counters(spark, d):
    """T4s: running label counters over a multi-batch stream of stored predictions."""
    from revlens.streaming import monitors
    stream = _as_file_stream(spark, _pk(spark, d), "keyed-stream")
    return _run_complete(monitors.label_counters(stream), spark, "counters")


@register("stream_throughput", V("""
select w_start // 1000000 as window_start_s, (w_start + 60000000) // 1000000 as window_end_s, count(*) as n
from (select (epoch_us(inserted_at) // 10000000) * 10000000 - k * 10000000 as w_start
      from predictions_keyed, (select range as k from range(6)) ks) x
where w_start + 60000000 <= (select epoch_ms(max(inserted_at)) * 1000 - 120000000 from predictions_keyed)
group by w_start""", "predictions_keyed"))
def q_stream_throughput(spark, d):
    """T5s: sliding 60 s / 10 s ingest windows over a multi-batch stream in append mode:
    the windows that the two-minute watermark has closed, each stored once."""
    from pyspark.sql import functions as F
    from revlens.streaming import monitors
    stream = _as_file_stream(spark, _pk(spark, d), "keyed-stream")
    path = _scratch(spark, "throughput")
    q = monitors.start_append_query(monitors.closed_throughput(stream), path, _scratch(spark, "throughput-ckpt"),
                                    available_now=True)
    q.awaitTermination()
    out = monitors.read_closed(spark, path)
    return out.select(F.unix_seconds("window_start").alias("window_start_s"),
                      F.unix_seconds("window_end").alias("window_end_s"), "n")


# Micro-batch timings of the last stream_scoring run (read by bench.py).
STREAM_STATS: dict = {}


@register("stream_scoring")
def q_stream_scoring(spark, d):
    """E2 / T1s: test-split reviews published as messages (half without a cleaned
    text), consumed as a multi-file stream, cleaned where needed, scored by the
    fitted pipeline, and written to the live feed and the batch_id-partitioned
    prediction table; returns the stored predictions (no SQL oracle: model fit)."""
    import os
    from pyspark.sql import functions as F
    from revlens.plans import training
    from revlens.sources import messages
    from revlens.streaming import scoring as sscore
    split_df = _split(spark, d)
    balanced, _, _ = training.training_tables(_written_split(spark, d))
    model = training.fit_logreg(balanced)
    inbox = _scratch(spark, "inbox")
    test = split_df.filter(F.col("split") == "test").withColumn(
        "cleaned", F.when(F.col("Id") % 2 == 0, F.col("cleaned")))
    # At least 4 message files (so the stream runs several micro-batches), more
    # when the test split spans more scan splits; a batch has at most MAX_FILES_PER_BATCH.
    files = max(4, test.rdd.getNumPartitions())
    messages.write_message_files(messages.publish_reviews(test).repartition(files), inbox)
    root = _scratch(spark, "stream")
    table = os.path.join(root, "predictions")
    q_live, q_stats = sscore.start_two_queries(
        messages.message_files_source(spark, inbox, max_files_per_trigger=min(MAX_FILES_PER_BATCH, -(-files // 4))), model, table,
        os.path.join(root, "ckpt"), live_path=os.path.join(root, "live"), available_now=True)
    q_live.awaitTermination()
    q_stats.awaitTermination()
    from revlens.streaming.monitors import batch_latency
    STREAM_STATS.update(live=batch_latency(q_live), stats=batch_latency(q_stats))
    return (sscore.read_stats_table(spark, table)
            .select("Id", "ProductId", "true_sentiment", "prediction", "sentiment_label",
                    F.round("confidence", 6).alias("confidence"), "batch_id"))


# ------------------------------------------------------------- connectors
def _scratch(spark, name):
    import os
    import uuid
    from revlens.session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@register("message_roundtrip", V("""
select Id, ProductId, cleaned, sentiment as true_sentiment, cast(length(coalesce(Text, '')) as integer) as text_len from cleaned""",
                                 "reviews", ctes={"cleaned": _CLEANED_SQL}))
def q_message_roundtrip(spark, d):
    """S5 -> S4 -> P4: reviews published as keyed JSON messages, decoded by the
    stream schema and re-cleaned only where no cleaned text was sent."""
    from pyspark.sql import functions as F
    from revlens.sources import messages
    from revlens.streaming.scoring import prepare
    src = prep.clean_reviews(T.spread(T.reviews(spark, d)))
    # Send half of the messages without a cleaned text so the consumer must clean them.
    src = src.withColumn("cleaned", F.when(F.col("Id") % 2 == 0, F.col("cleaned")))
    decoded = prepare(messages.decode_reviews(messages.publish_reviews(src)))
    return decoded.select("Id", "ProductId", "cleaned", "true_sentiment",
                          F.length(F.coalesce("Text", F.lit(""))).alias("text_len"))


@register("split_files_roundtrip", V("""
select Id, split, sentiment, cleaned, cast(length(coalesce(Text, '')) as integer) as text_len
from splits""", "reviews",
                                     ctes={"cleaned": _CLEANED_SQL, "splits": _SPLIT_SQL}))
def q_split_files_roundtrip(spark, d):
    """S10 -> S2: splits written as quote-all CSV partitioned by split, read back
    with the fixed schema (multi-line texts included); '' and NULL stay apart."""
    from pyspark.sql import functions as F
    from revlens.sources import files
    path = _scratch(spark, "splits")
    files.write_splits(_split(spark, d), path, fmt="csv")
    back = files.read_splits(spark, path, fmt="csv")
    return back.select("Id", "split", "sentiment", "cleaned", F.length(F.coalesce("Text", F.lit(""))).alias("text_len"))


@register("raw_reviews_csv", V("""
select Id, ProductId, UserId, cast(null as varchar) as ProfileName, Score, Time,
       Summary, Text from reviews""", "reviews"))
def q_raw_reviews_csv(spark, d):
    """The raw corpus written as CSV (quoted, multi-line texts) and scanned back
    with the fixed raw-review schema -- no inference pass."""
    from pyspark.sql import functions as F
    from revlens.sources import files
    path = _scratch(spark, "raw")
    raw = T.reviews(spark, d).select(
        "Id", "ProductId", "UserId", F.lit(None).cast("string").alias("ProfileName"),
        F.lit(None).cast("int").alias("HelpfulnessNumerator"), F.lit(None).cast("int").alias("HelpfulnessDenominator"),
        "Score", "Time", "Summary", "Text")
    files.write_csv(raw, path)
    back = files.read_reviews_csv(spark, path)
    return back.select("Id", "ProductId", "UserId", "ProfileName", "Score", "Time", "Summary", "Text")


@register("live_feed", V("""
select cast(Id as varchar) as id, coalesce(ProductId, '') as productId,
       substring(coalesce(Summary, ''), 1, 120) as summary, coalesce(sentiment_label, '') as sentiment,
       coalesce(confidence, 0.0) as confidence, coalesce(cast(Time as varchar), '') as time
from predictions_keyed""", "predictions_keyed"))
def q_live_feed(spark, d):
    """S6 -> S8: compact live records encoded as JSON and normalised by the reader."""
    from revlens.sources import messages
    return messages.normalise_live(messages.live_records(_pk(spark, d)))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q.run for n, q in REGISTRY.items()}


def all_oracles() -> dict[str, str]:
    return {n: q.oracle for n, q in REGISTRY.items() if q.oracle}
