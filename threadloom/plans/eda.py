"""Queries: preparation joins, aggregates, windows, reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import stats
from ..operators import eda
from ..sources.driver_tables import POSTS, posts, table, threads
from .registry import query

T = "(SELECT conv_id * 1000 + turn AS id, conv_id AS thread_id, turn AS round, text AS tweet, role FROM conversations)"


@query("p1_keep_present", "SELECT o_orderkey, o_custkey FROM orders")
def keep_present(spark, d):
    return schema.keep_present(table(spark, d, "orders"), ["o_orderkey", "o_missing", "o_custkey"])


@query("p2_rename_drop", "SELECT c_custkey AS id, c_mktsegment AS topic FROM customer")
def rename_drop(spark, d):
    return table(spark, d, "customer").withColumnRenamed("c_custkey", "id").withColumnRenamed("c_mktsegment", "topic").drop("c_name", "c_nationkey", "c_acctbal", "nothing")


@query("p3_derived_column", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem", "net")
def derived(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("p4_row_filter", f"SELECT id, day FROM ({POSTS}) WHERE comment_to <> -1 AND day <= 10")
def row_filter(spark, d):
    return posts(spark, d).where("comment_to <> -1 and day <= 10").select("id", "day")


@query("p5_length_filter", "SELECT conv_id, turn FROM conversations WHERE length(text) >= 10")
def length_filter(spark, d):
    return table(spark, d, "conversations").where(F.length("text") >= 10).select("conv_id", "turn")


@query("p6_drop_incomplete", "SELECT a.doc_id, quality, toxic FROM documents a LEFT JOIN labels b ON a.doc_id = b.doc_id WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def drop_incomplete(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").na.drop(subset=["quality", "toxic"])


@query("p7_fill_zero", "SELECT a.doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM documents a LEFT JOIN labels b ON a.doc_id = b.doc_id")
def fill_zero(spark, d):
    return schema.fill_zero(table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left"))


@query("p9_mean_imputation", "WITH x AS (SELECT a.doc_id, quality FROM documents a LEFT JOIN labels b ON a.doc_id = b.doc_id) SELECT doc_id, CAST(quality IS NOT NULL AS INT) AS has_parent, coalesce(quality, avg(quality) OVER ()) AS avg_reply_coherence FROM x", "avg_reply_coherence")
def mean_imputation(spark, d):
    from ..operators.clustering import impute_coherence

    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("quality").cast("double").alias("avg_reply_coherence"))
    return impute_coherence(rows).select("doc_id", "has_parent", "avg_reply_coherence")


@query("p10_conditional_null", "SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 70 THEN stddev_pop(value) END AS s FROM events GROUP BY user_id", "s")
def conditional_null(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("value").alias("s"))
    return g.withColumn("s", F.when(F.col("n") >= 70, F.col("s")))


@query("p11_membership", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def membership(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("p12_boolean_flag", "SELECT conv_id, turn, length(trim(text)) = 0 AS is_empty FROM conversations")
def boolean_flag(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", (F.trim("text") == "").alias("is_empty"))


@query("p13_casts", "SELECT CAST(event_id AS VARCHAR) AS id_text, CAST(floor(value) AS INT) AS v FROM events")
def casts(spark, d):
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("id_text"), F.floor("value").cast("int").alias("v"))


@query("p16_preview", "SELECT conv_id, turn, substring(text, 1, 90) || '...' AS preview FROM conversations")
def preview(spark, d):
    from ..functions.text import preview as shown

    return table(spark, d, "conversations").select("conv_id", "turn", shown(F.col("text")).alias("preview"))


@query("p17_dense_hours", f"SELECT CAST(h AS INT) AS hour, count(p.id) AS n FROM range(24) t(h) LEFT JOIN ({POSTS}) p ON p.hour = h GROUP BY h")
def dense_hours(spark, d):
    return eda.hourly(spark, posts(spark, d))


DESCRIBE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM lineitem" for c in ("l_quantity", "l_discount"))


@query("p18_describe", DESCRIBE, "mean std min q25 q50 q75 max")
def describe(spark, d):
    return stats.describe(table(spark, d, "lineitem"), ["l_quantity", "l_discount"])


@query("p19_null_audit", "WITH x AS (SELECT a.doc_id, quality FROM documents a LEFT JOIN labels b ON a.doc_id = b.doc_id) SELECT 'doc_id' AS \"column\", count(*) - count(doc_id) AS n_null, count(*) AS n_rows FROM x UNION ALL SELECT 'quality', count(*) - count(quality), count(*) FROM x")
def null_audit(spark, d):
    return stats.null_audit(table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality"))


@query("j1_posts_rounds", "SELECT s_suppkey AS id, n_nationkey % 24 AS hour, n_regionkey AS day FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def posts_rounds(spark, d):
    rounds = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("day"), (F.col("n_nationkey") % 24).alias("hour"))
    return eda.join_rounds(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("round")), rounds).drop("round")


PIVOT = "SELECT user_id AS post_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id"


@query("a5_reaction_pivot", PIVOT)
def reaction_pivot(spark, d):
    return eda.reaction_pivot(table(spark, d, "events").select(F.col("user_id").alias("post_id"), F.col("event_type").alias("type")), ("click", "view"))


@query("j2_posts_reactions", f"SELECT c_custkey AS id, coalesce(click, 0) AS click, coalesce(view, 0) AS view FROM customer LEFT JOIN ({PIVOT}) p ON c_custkey = p.post_id")
def posts_reactions(spark, d):
    return eda.add_reactions(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), reaction_pivot(spark, d))


@query("j3_topics_interests", "SELECT s_suppkey AS post_id, n_name AS topic FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def topics_interests(spark, d):
    links = table(spark, d, "supplier").select(F.col("s_suppkey").alias("post_id"), F.col("s_nationkey").alias("topic_id"))
    return links.join(table(spark, d, "nation").select(F.col("n_nationkey").alias("topic_id"), F.col("n_name").alias("topic")), "topic_id").select("post_id", "topic")


@query("j4_post_hashtags", "SELECT c_custkey AS post_id, c_nationkey AS hashtag_id, n_name AS hashtag FROM customer JOIN nation ON c_nationkey = n_nationkey")
def post_hashtags(spark, d):
    return eda.post_hashtags(table(spark, d, "customer").select(F.col("c_custkey").alias("post_id"), F.col("c_nationkey").alias("hashtag_id")), table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("hashtag"))).select("post_id", "hashtag_id", "hashtag")


def _topic_rows(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("post_id"), (F.col("o_orderkey") % 25).alias("topic_id"))
    return eda.topic_posts(people, orders, table(spark, d, "nation").select(F.col("n_nationkey").alias("iid"), F.col("n_name").alias("interest")))


TOPIC_ROWS = "SELECT c.c_custkey AS id, c.c_mktsegment, t.post_id, t.topic_id, t.topic FROM customer c FULL JOIN (SELECT o_custkey AS post_id, o_orderkey % 25 AS topic_id, n_name AS topic FROM orders JOIN nation ON o_orderkey % 25 = n_nationkey) t ON c.c_custkey = t.post_id"


@query("j5_topic_posts", TOPIC_ROWS)
def topic_posts(spark, d):
    return _topic_rows(spark, d).select("id", "c_mktsegment", "post_id", "topic_id", "topic")


@query("a6_true_topics", f"SELECT post_id, array_to_string(list_sort(list(topic)), ',') AS topics FROM ({TOPIC_ROWS}) WHERE post_id IS NOT NULL GROUP BY post_id")
def true_topics(spark, d):
    return eda.true_topics(_topic_rows(spark, d)).select("post_id", F.array_join("true_topics", ",").alias("topics"))


@query("j6_posts_topics", f"SELECT c_custkey AS id, coalesce(len(l), 0) AS n_topics FROM customer LEFT JOIN (SELECT post_id, list(topic) AS l FROM ({TOPIC_ROWS}) WHERE post_id IS NOT NULL GROUP BY post_id) ON c_custkey = post_id")
def posts_topics(spark, d):
    found = eda.true_topics(_topic_rows(spark, d))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return people.join(found, people["id"] == found["post_id"], "left").select("id", F.coalesce(F.size("true_topics").cast("long"), F.lit(0)).alias("n_topics"))


@query("j7_daily_volume_engagement", f"SELECT day, count(*) AS volume, CAST(sum(reaction_count) AS BIGINT) AS engagement FROM ({POSTS}) GROUP BY day")
def daily(spark, d):
    return eda.daily(posts(spark, d))


@query("j12_posts_traits", "SELECT o_orderkey AS id, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def posts_traits(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), "c_mktsegment")


@query("j16_coalesced_join", "SELECT a.doc_id, coalesce(CAST(quality AS VARCHAR), 'None') AS sub_community FROM documents a LEFT JOIN labels b ON a.doc_id = b.doc_id")
def coalesced_join(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("None")).alias("sub_community"))


@query("j17_active_both_days", f"SELECT DISTINCT user_id FROM ({POSTS}) WHERE day = 0 INTERSECT SELECT DISTINCT user_id FROM ({POSTS}) WHERE day = 29")
def active_both(spark, d):
    p = posts(spark, d)
    return p.where("day = 0").select("user_id").intersect(p.where("day = 29").select("user_id"))


@query("j19_scalar_limits", "SELECT l_orderkey, l_linenumber, (l_quantity - (SELECT min(l_quantity) FROM lineitem)) / ((SELECT max(l_quantity) FROM lineitem) - (SELECT min(l_quantity) FROM lineitem)) AS x FROM lineitem", "x")
def scalar_limits(spark, d):
    li = table(spark, d, "lineitem")
    lim = li.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return li.crossJoin(F.broadcast(lim)).select("l_orderkey", "l_linenumber", ((F.col("l_quantity") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("x"))


@query("a1_group_count", f"SELECT user_id, day, topic, count(*) AS n FROM ({POSTS}) GROUP BY ALL")
def group_count(spark, d):
    return eda.counts(posts(spark, d), "user_id", "day", "topic")


@query("a2_group_sum", f"SELECT user_id, CAST(sum(\"like\") AS BIGINT) AS likes, CAST(sum(reaction_count) AS BIGINT) AS reactions FROM ({POSTS}) GROUP BY user_id")
def group_sum(spark, d):
    return posts(spark, d).groupBy("user_id").agg(F.sum("like").alias("likes"), F.sum("reaction_count").alias("reactions"))


@query("a3_mean_length", f"SELECT thread_id, role, avg(length(tweet)) AS mean_length FROM {T} GROUP BY ALL", "mean_length")
def mean_length(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), "role", F.col("text").alias("tweet"))
    return eda.mean_length(rows, "tweet", "thread_id", "role")


@query("a4_longest_text", f"SELECT thread_id, CAST(max(length(tweet)) AS INT) AS max_length FROM {T} GROUP BY thread_id")
def longest(spark, d):
    return eda.longest(threads(spark, d), "tweet", "thread_id")


@query("a7_joined_text", f"SELECT thread_id, md5(string_agg(tweet, ' ' ORDER BY id)) AS digest FROM {T} GROUP BY thread_id")
def joined_text(spark, d):
    return eda.joined_text(threads(spark, d), "thread_id", "tweet", "id").select("thread_id", F.md5(F.col("tweet").cast("binary")).alias("digest"))


@query("a8_mean_std", "SELECT user_id, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM events GROUP BY user_id", "m s")
def mean_std(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("s"))


@query("a18_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, d):
    return eda.value_counts(table(spark, d, "events"), "event_type")


@query("a19_distinct_counts", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events")
def distinct_counts(spark, d):
    return table(spark, d, "events").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"))


@query("a25_correlations", "SELECT a, b, r FROM (SELECT corr(l_quantity, l_extendedprice) AS qe, corr(l_quantity, l_discount) AS qd, corr(l_extendedprice, l_discount) AS ed FROM lineitem), LATERAL (VALUES ('l_quantity', 'l_quantity', 1), ('l_extendedprice', 'l_extendedprice', 1), ('l_discount', 'l_discount', 1), ('l_quantity', 'l_extendedprice', qe), ('l_extendedprice', 'l_quantity', qe), ('l_quantity', 'l_discount', qd), ('l_discount', 'l_quantity', qd), ('l_extendedprice', 'l_discount', ed), ('l_discount', 'l_extendedprice', ed)) v(a, b, r)", "r")
def correlations(spark, d):
    return stats.correlation_matrix(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


SPIKES = f"SELECT *, rolling_mean + 3 * rolling_std AS upper, volume > rolling_mean + 3 * rolling_std AS spike FROM (SELECT day, count(*) AS volume, avg(count(*)) OVER w AS rolling_mean, coalesce(stddev_samp(count(*)) OVER w, 0) AS rolling_std FROM ({POSTS}) GROUP BY day WINDOW w AS (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"


@query("w9_daily_spikes", SPIKES, "rolling_mean rolling_std upper")
def spikes(spark, d):
    return eda.spikes(eda.daily(posts(spark, d)).select("day", "volume"))


@query("w7_equal_width_bins", "SELECT bin, count(*) AS n FROM (SELECT CAST(least(greatest(ceil((l_quantity - lo) / ((hi - lo) / 10)), 1) - 1, 9) AS INT) AS bin FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)) GROUP BY bin")
def equal_width(spark, d):
    return eda.counts(stats.with_bins(table(spark, d, "lineitem").select("l_quantity"), "l_quantity", 10), "bin")


@query("w8_three_bins", "SELECT label, count(*) AS n FROM (SELECT ['Low', 'Medium', 'High'][CAST(least(greatest(ceil((l_quantity - lo) / ((hi - lo) / 3)), 1), 3) AS INT)] AS label FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)) GROUP BY label")
def three_bins(spark, d):
    rows = stats.with_bins(table(spark, d, "lineitem").select("l_quantity"), "l_quantity", 3)
    return eda.counts(rows.select(F.get(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), F.col("bin")).alias("label")), "label")


@query("w14_quartiles", "SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, median(value) AS med FROM events", "q1 q3 med")
def quartiles(spark, d):
    return table(spark, d, "events").agg(F.percentile("value", 0.25).alias("q1"), F.percentile("value", 0.75).alias("q3"), F.median("value").alias("med"))


@query("o1_multi_key_sort", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn")
def multi_sort(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query("o2_bottom_ten", "SELECT user_id, avg(value) AS m FROM events GROUP BY user_id ORDER BY m, user_id LIMIT 10", "m")
def bottom_ten(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m")).orderBy("m", "user_id").limit(10)


@query("o3_largest_groups", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def largest_groups(spark, d):
    return eda.value_counts(table(spark, d, "events"), "user_id").limit(10)


@query("o4_first_rows", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 2")
def first_rows(spark, d):
    return eda.first_rows(table(spark, d, "events").select("event_type", "event_id"), "event_type", 2, "event_id")


@query("o6_extremes", "WITH m AS (SELECT user_id, avg(value) AS score FROM events GROUP BY user_id) SELECT * FROM (SELECT * FROM m ORDER BY score, user_id LIMIT 25) UNION SELECT * FROM (SELECT * FROM m ORDER BY score DESC, user_id DESC LIMIT 25)", "score")
def extremes(spark, d):
    return eda.extremes(table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("score")), "score", "user_id")


@query("o9_longest_thread", f"SELECT id, thread_id FROM {T} WHERE thread_id = (SELECT thread_id FROM {T} GROUP BY thread_id ORDER BY count(*) DESC, thread_id LIMIT 1)")
def longest_thread(spark, d):
    return eda.drill_down(threads(spark, d).select("id", "thread_id"), "thread_id", "id").select("id", "thread_id")


@query("r1_vertical_concat", "SELECT r_regionkey AS k, r_name AS n FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def vertical_concat(spark, d):
    return table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("n")).unionByName(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")))


@query("r3_pivot_long", f"SELECT thread_id, round, avg(roberta_compound) AS value, avg(avg(roberta_compound)) OVER (PARTITION BY thread_id) AS row_mean FROM ({POSTS}) GROUP BY thread_id, round", "value row_mean")
def pivot_long(spark, d):
    from ..operators.coherence import heatmap

    return heatmap(posts(spark, d), "roberta_compound")


@query("r4_crosstab", "WITH t AS (SELECT c_mktsegment, c_nationkey % 4 AS cluster, count(*) AS n FROM customer GROUP BY 1, 2) SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY c_mktsegment) AS DOUBLE), 3) AS share FROM t")
def crosstab(spark, d):
    return stats.crosstab(table(spark, d, "customer").select("c_mktsegment", (F.col("c_nationkey") % 4).alias("cluster")), "c_mktsegment", "cluster")


@query("r6_struct_columns", "SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INT) AS k FROM events")
def struct_columns(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")


@query("r7_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id")).distinct()


@query("h17_histogram", "SELECT CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1")
def histogram(spark, d):
    return stats.histogram(table(spark, d, "events"), "value", 20)


@query("s7_json_map", "SELECT '{' || string_agg(chr(34) || n_nationkey || chr(34) || ':' || n_regionkey, ',' ORDER BY CAST(n_nationkey AS VARCHAR)) || '}' AS json FROM nation")
def json_map(spark, d):
    from ..sources.files import as_json_map

    return as_json_map(table(spark, d, "nation"), "n_nationkey", "n_regionkey")


@query("w11_first_last", f"SELECT user_id, arg_min(roberta_compound, day * 1000000 + id) AS first, arg_max(roberta_compound, day * 1000000 + id) AS last FROM ({POSTS}) GROUP BY user_id", "first last")
def first_last(spark, d):
    rows = posts(spark, d).select("id", "user_id", "day", F.col("roberta_compound").alias("attitude_score"))
    from ..operators.echo import attitude_shift

    return attitude_shift(rows).select("user_id", "first", "last")


@query("w13_recency_weights", f"SELECT id, exp(day - max(day) OVER (PARTITION BY user_id)) AS w FROM ({POSTS})", "w")
def recency(spark, d):
    return posts(spark, d).select("id", F.exp(F.col("day") - F.max("day").over(Window.partitionBy("user_id"))).alias("w"))


@query("p14_header_artefact", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IS NOT NULL AND c_custkey <> (SELECT min(c_custkey) FROM customer)")
def header_artefact(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    return eda.drop_artefact(rows, "c_custkey", (rows.agg(F.min("c_custkey")).first()[0],))


@query("r2_horizontal_concat", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def horizontal_concat(spark, d):
    return eda.side_by_side(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("w15_median", "SELECT event_type, median(value) AS median, count(value) AS n FROM events GROUP BY event_type", "median")
def medians(spark, d):
    return eda.medians(table(spark, d, "events"), "value", "event_type")
