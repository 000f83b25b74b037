"""Queries: text functions over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import clustering, eda
from ..sources.driver_tables import table, threads
from .registry import query

TWEETS = "SELECT conv_id * 1000 + turn AS id, '@User_1 Hello #Tag' || turn || ' &amp; see https://x.example/a?b ' || text || '!  www.site.example so... 😊 #été' AS tweet FROM conversations"
W = r"[\p{L}\p{N}_]"


def tweets(spark, d):
    """Conversation texts dressed with what cleaners remove."""
    body = F.concat(F.lit("@User_1 Hello #Tag"), F.col("turn").cast("string"), F.lit(" &amp; see https://x.example/a?b "), F.col("text"), F.lit("!  www.site.example so... 😊 #été"))
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), body.alias("tweet"))


def _chain(text: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


SQUEEZE = ((r"[ \t\n\r]+", " "),)
URL = (r"http[^ \t\n\r]+|www\.[^ \t\n\r]+|www[^ \t\n\r]+|https[^ \t\n\r]+", "")
URL_PLAIN = (r"http[^ \t\n\r]+|www\.[^ \t\n\r]+", "")
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), (r"&#[0-9]+;", ""))
CLEAN = f"trim({_chain('lower(tweet)', URL, (f'@{W}+', ''), (f'#({W}+)', chr(92) + '1'), ('#', ''), *ENTITIES, *SQUEEZE)})"
PLAIN = f"trim({_chain('lower(tweet)', URL_PLAIN, (f'@{W}+', ''), (f'#({W}+)', chr(92) + '1'), *ENTITIES, *SQUEEZE)})"
STANCE = f"trim({_chain('lower(tweet)', URL, (f'@{W}+', ''), ('#', ''), *SQUEEZE)})"
FEATURE = f"lower(trim({_chain('tweet', (r'http[^ \t\n\r]+|www[^ \t\n\r]+', ''), (f'@{W}+', ''), (f'#{W}+', ''), (r'[^\p{L}\p{N}_ \t\n\r]', ''), *SQUEEZE)}))"


def _cleaner(f):
    return lambda spark, d: tweets(spark, d).select("id", f(F.col("tweet")).alias("clean"))


query("t1_clean_text", f"SELECT id, {CLEAN} AS clean FROM ({TWEETS})")(_cleaner(t.clean_text))
query("t2_clean_plain", f"SELECT id, {PLAIN} AS clean FROM ({TWEETS})")(_cleaner(t.clean_text_plain))
query("t3_clean_stance", f"SELECT id, {STANCE} AS clean FROM ({TWEETS})")(_cleaner(t.clean_stance_text))
query("t4_clean_features", f"SELECT id, {FEATURE} AS clean FROM ({TWEETS})")(_cleaner(t.clean_tweet))

STOP = ("the", "and", "of", "to", "in", "de", "la", "die", "der", "und", "is", "are", "that", "this")
LEMMAS = {"ones": "one", "tions": "tion", "things": "thing"}
P = r"[!-/:-@\[-`{-~]"
_STOP = ", ".join(f"'{w}'" for w in STOP)
TOKENS = f"list_filter(string_split(trim(regexp_replace({_chain('trim(lower(text))', (P, ''))}, '[ \\t\\n\\r]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({_STOP}))"


@query("t5_topic_tokens", f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS tokens FROM documents")
def topic_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(t.topic_tokens(F.col("text"), STOP, None), " ").alias("tokens"))


@query("t6_tokenize", f"SELECT doc_id, len(regexp_extract_all(text, '{W}+|[^\\p{{L}}\\p{{N}}_\\s]')) AS n FROM documents")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(t.tokenize(F.col("text"))).cast("long").alias("n"))


@query("t7_char_length", "SELECT doc_id, length(text) AS n FROM documents")
def char_length(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"))


EMOJI_SQL = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"


@query("t8_emoji_rate", f"SELECT id, len(regexp_extract_all(tweet, '{EMOJI_SQL}')) / CAST(length(tweet) AS DOUBLE) AS x FROM ({TWEETS})", "x")
def emoji(spark, d):
    return tweets(spark, d).select("id", t.emoji_rate(F.col("tweet")).alias("x"))


@query("t9_punctuation_rate", f"SELECT id, len(regexp_extract_all(tweet, '{P}')) / CAST(length(tweet) AS DOUBLE) AS x FROM ({TWEETS})", "x")
def punctuation(spark, d):
    return tweets(spark, d).select("id", t.punctuation_rate(F.col("tweet")).alias("x"))


SENTENCES = "len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '[^ \\t\\n\\r]')))"


@query("t10_sentences", f"SELECT doc_id, {SENTENCES} AS n FROM documents")
def sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", t.n_sentences(F.col("text")).cast("long").alias("n"))


TOK = f"regexp_extract_all(text, '{W}+|[^\\p{{L}}\\p{{N}}_\\s]')"
STYLE = f"""SELECT doc_id, len(list_filter(k, lambda w: lower(w) IN ('i', 'me', 'my', 'mine', 'myself'))) / (len(list_filter(k, lambda w: lower(w) IN ('we', 'us', 'our', 'ours', 'you', 'your', 'yours'))) + 0.00001) AS pronoun_ratio,
  greatest(len(k), 1) / CAST(greatest({SENTENCES}, 1) AS DOUBLE) AS avg_sent_length, len(regexp_extract_all(text, '!')) / CAST(greatest(len(k), 1) AS DOUBLE) AS exclamation_rate,
  len(regexp_extract_all(text, '\\.\\.\\.')) / CAST(greatest(len(k), 1) AS DOUBLE) AS ellipsis_rate FROM (SELECT doc_id, text, {TOK} AS k FROM documents)"""


@query("t11_t13_style", STYLE, "pronoun_ratio avg_sent_length exclamation_rate ellipsis_rate")
def style(spark, d):
    made = t.style_features(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *(made[c] for c in ("pronoun_ratio", "avg_sent_length", "exclamation_rate", "ellipsis_rate")))


WORDS_ = f"list_filter({TOK}, lambda w: regexp_matches(w, '^{W}+$'))"
EASE = f"SELECT doc_id, CASE WHEN len(k) > 0 THEN 206.835 - 1.015 * len(k) / greatest(s, 1) - 84.6 * list_sum(list_transform(k, lambda w: greatest(len(regexp_extract_all(lower(w), '[aeiouy]+')), 1))) / len(k) ELSE 0 END AS ease FROM (SELECT doc_id, CAST({SENTENCES} AS DOUBLE) AS s, {WORDS_} AS k FROM documents)"


@query("t14_reading_ease", EASE, "ease", 9)
def ease(spark, d):
    return table(spark, d, "documents").select("doc_id", t.reading_ease(F.col("text")).alias("ease"))


#: MTLD as a recursion over token positions, both ways: the types so far, until their share of a factor's tokens falls to 0.72.
_SPLIT = "list_filter(string_split(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')), ' '), lambda w: w <> '')"
MTLD_SQL = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, {_SPLIT} AS t FROM conversations), d AS (SELECT conv_id, turn, 0 AS way, t FROM k UNION ALL SELECT conv_id, turn, 1, list_reverse(t) FROM k),
s AS (SELECT conv_id, turn, way, t, 0 AS i, 0 AS f, CAST([] AS VARCHAR[]) AS types, 0 AS n FROM d
  UNION ALL SELECT conv_id, turn, way, t, i + 1, f + CAST(ends AS INT), CASE WHEN ends THEN CAST([] AS VARCHAR[]) ELSE now END, CASE WHEN ends THEN 0 ELSE n + 1 END
  FROM (SELECT *, len(now) / CAST(n + 1 AS DOUBLE) <= 0.72 AS ends FROM (SELECT *, CASE WHEN list_contains(types, t[i + 1]) THEN types ELSE list_append(types, t[i + 1]) END AS now FROM s WHERE i < len(t)))),
m AS (SELECT conv_id, turn, len(t) AS n, f + CASE WHEN s.n > 0 THEN (1 - len(types) / CAST(s.n AS DOUBLE)) / 0.28 ELSE 0 END AS factors FROM s WHERE i = len(t)),
x AS (SELECT conv_id, turn, max(n) AS n, CASE WHEN max(n) < 2 THEN 0 ELSE avg(CASE WHEN factors > 0 THEN n / factors ELSE 0 END) END AS mtld FROM m GROUP BY conv_id, turn)"""
TURN_ENTROPY = f"SELECT conv_id, turn, -sum(n / CAST(total AS DOUBLE) * log2(n / CAST(total AS DOUBLE))) AS entropy FROM (SELECT conv_id, turn, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY conv_id, turn) AS total FROM (SELECT conv_id, turn, unnest({_SPLIT}) AS w FROM conversations) GROUP BY conv_id, turn, w) GROUP BY conv_id, turn"


@query("t15_lexical_features", MTLD_SQL + f" SELECT x.conv_id, x.turn, CASE WHEN n >= 5 THEN mtld END AS mtld, CASE WHEN n >= 5 THEN entropy END AS entropy, CAST(n AS INT) AS token_count FROM x LEFT JOIN ({TURN_ENTROPY}) e ON e.conv_id = x.conv_id AND e.turn = x.turn", "mtld entropy")
def lexical(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", t.split_words(F.lower("text")).alias("k"))
    return rows.select("conv_id", "turn", *t.lexical_features(F.col("k")).values())


@query("r5_t16_hashtags", f"SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(tweet, '#{W}+')) AS tag FROM ({TWEETS})) GROUP BY tag")
def hashtags(spark, d):
    return eda.counts(tweets(spark, d).select(F.explode(t.hashtags(F.col("tweet"))).alias("tag")), "tag")


@query("t17_label_map", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'negative' WHEN 'assistant' THEN 'positive' ELSE 'system' END AS label FROM conversations")
def label_map(spark, d):
    from ..functions.scores import normal_label

    raw = F.when(F.col("role") == "user", "LABEL_0").when(F.col("role") == "assistant", "Pos").otherwise("SYSTEM")
    return table(spark, d, "conversations").select("conv_id", "turn", normal_label(raw).alias("label"))


@query("t18_cluster_names", "SELECT n_nationkey, CASE WHEN n_regionkey = 4 THEN 'Noise' ELSE 'Cluster ' || n_regionkey || ': ' || n_name || ', x' END AS label FROM nation")
def cluster_names(spark, d):
    rows = table(spark, d, "nation").withColumn("c", F.when(F.col("n_regionkey") == 4, -1).otherwise(F.col("n_regionkey")))
    return rows.select("n_nationkey", t.cluster_name(F.col("c"), F.array("n_name", F.lit("x"))).alias("label"))


ENTROPY = "WITH k AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ')) AS w FROM documents WHERE doc_id % 1 = 0), c AS (SELECT doc_id, w, count(*) AS n FROM k WHERE w <> '' GROUP BY ALL), s AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY doc_id) SELECT doc_id, -sum(n / CAST(t AS DOUBLE) * log2(n / CAST(t AS DOUBLE))) AS entropy FROM c JOIN s USING (doc_id) GROUP BY doc_id"


@query("h12_token_entropy", ENTROPY.replace(" WHERE doc_id % 1 = 0", ""), "entropy")
def entropy(spark, d):
    """By explode and count, which is linear in a text's length; the array form suits short posts."""
    k = table(spark, d, "documents").select("doc_id", F.explode(t.split_words(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    s = k.groupBy("doc_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("q"))
    return s.select("doc_id", (F.log2("t") - F.col("q") / F.col("t")).alias("entropy"))


@query("h13_mtld", MTLD_SQL + " SELECT conv_id, turn, mtld FROM x", "mtld")
def mtld(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", t.mtld(t.split_words(F.lower("text"))).alias("mtld"))


@query("u1_prepared_tweets", f"SELECT id, {FEATURE} AS clean_tweet FROM ({TWEETS}) WHERE {FEATURE} <> ''")
def prepared(spark, d):
    return tweets(spark, d).select("id", t.clean_tweet(F.col("tweet")).alias("clean_tweet")).where("clean_tweet <> ''")


LABELS_SQL = f"""WITH w AS (SELECT conv_id * 1000 + turn AS d, turn % 4 AS cluster, unnest(regexp_extract_all(lower(text), '{W}{{2,}}')) AS term FROM conversations WHERE turn % 4 <> 3),
n AS (SELECT cluster, term, count(*) AS n, count(DISTINCT d) AS docs FROM w WHERE term NOT IN ({_STOP}) GROUP BY ALL),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, encode(term)) <= 200),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY docs DESC, encode(term)) AS r FROM k)
SELECT cluster, 'Cluster ' || cluster || ': ' || string_agg(term, ', ' ORDER BY r) AS cluster_label FROM r WHERE r <= 4 GROUP BY cluster UNION ALL SELECT -1, 'Noise'"""


@query("u5_cluster_labels", LABELS_SQL)
def cluster_labels(spark, d):
    rows = threads(spark, d).select(F.when(F.col("round") % 4 == 3, -1).otherwise(F.col("round") % 4).cast("int").alias("cluster"), F.col("tweet").alias("clean_tweet"))
    return clustering.cluster_labels(rows, STOP)


@query("u6_cluster_counts", "SELECT count(DISTINCT label) FILTER (WHERE label <> 3) AS n_clusters, count(*) FILTER (WHERE label = 3) AS n_noise FROM embeddings")
def cluster_counts(spark, d):
    return clustering.cluster_counts(table(spark, d, "embeddings").select(F.when(F.col("label") == 3, -1).otherwise(F.col("label")).alias("cluster")))


@query("l2_dictionary", f"WITH t AS (SELECT doc_id, {TOKENS} AS k FROM documents), n AS (SELECT count(*) AS n FROM t WHERE len(k) >= 7) SELECT term, count(*) AS docs FROM (SELECT unnest(list_distinct(k)) AS term FROM t WHERE len(k) >= 7) GROUP BY term HAVING count(*) >= 10 AND count(*) <= 0.5 * (SELECT n FROM n)")
def dictionary(spark, d):
    from ..operators import topics

    return topics.dictionary(topics.prepare(table(spark, d, "documents").withColumnRenamed("text", "tweet"), STOP))


@query("l1_l9_prepared", f"SELECT doc_id, len({TOKENS}) AS length FROM documents WHERE len({TOKENS}) >= 7")
def prepared_topics(spark, d):
    from ..operators import topics

    return topics.prepare(table(spark, d, "documents").withColumnRenamed("text", "tweet"), STOP).select("doc_id", F.col("length").cast("long").alias("length"))


CTFIDF = f"""WITH k AS (SELECT lang AS topic, unnest({TOKENS}) AS term FROM documents), tf AS (SELECT topic, term, count(*) AS n FROM k GROUP BY ALL), s AS (SELECT topic, sum(n) AS size FROM tf GROUP BY topic),
f AS (SELECT term, sum(n) AS f FROM tf GROUP BY term), x AS (SELECT topic, term, n / CAST(size AS DOUBLE) * ln(1 + (SELECT avg(size) FROM s) / f) AS score FROM tf JOIN s USING (topic) JOIN f USING (term))
SELECT topic, CAST(r AS INT) AS rank, term, score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, encode(term)) AS r FROM x) WHERE r <= 4"""


@query("l8_class_terms", CTFIDF, "score")
def class_terms(spark, d):
    from ..operators import topics

    return topics.class_terms(table(spark, d, "documents").select("lang", t.topic_tokens(F.col("text"), STOP).alias("tokens")), "lang")
