import math
import time

import pytest
from pyspark.sql import functions as F
from threadloom.functions import text as t


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean_text(spark):
    assert one(spark, t.clean_text, "@Ann_1 saw 3 #Otters &lt;today&gt; at http://river.test/x?y=1 🦦", " \t", None) == ["saw 3 otters <today> at 🦦", "", ""]
    assert one(spark, lambda c: t.clean_text(c, remove_urls=False, lowercase=False), "Map: www.river.test #Otters") == ["Map: www.river.test Otters"]
    assert one(spark, lambda c: t.clean_text(c, keep_emojis=False), "Wet 🌧 week # 9") == ["wet week 9"]
    assert one(spark, t.clean_text, "It&#39;s #naïve\tÉté\n!") == ["it&39;s naïve été !"]
    assert one(spark, t.clean_tweet, "Dear @Bo: read #this, twice? (https://a.test/b)") == ["dear read twice"]


def test_topic_text(spark):
    tokens = lambda c: t.topic_tokens(c, ("of", "a"), {"otters": "otter", "swam": "swim"})
    assert one(spark, lambda c: t.topic_text(tokens(c), 1), "A raft of OTTERS swam.") == ["raft otter swim"]
    assert one(spark, lambda c: t.topic_text(tokens(c), 4), "A raft of otters") == [""]


def test_style(spark):
    s = lambda k: lambda c: t.style_features(c, tokenizer=t.split_words, readability=lambda x: F.lit(1.0))[k]
    text = "I think you agree! I do..."
    assert one(spark, s("pronoun_ratio"), text, "", None) == [pytest.approx(2 / (1 + 1e-5)), 0, 0]
    assert one(spark, s("avg_sent_length"), text) == [3.0]
    assert one(spark, s("exclamation_rate"), text) == [pytest.approx(1 / 6)] and one(spark, s("ellipsis_rate"), text) == [pytest.approx(1 / 6)]
    assert one(spark, t.emoji_rate, "a😊!", "") == [pytest.approx(1 / 3), 0] and one(spark, t.punctuation_rate, "a😊!") == [pytest.approx(1 / 3)]


#: MTLD by hand. A factor ends where the share of types falls to 0.72 or less; a rest counts (1 - share) / 0.28 of one.
MTLD_CASES = [
    ([], 0.0),
    (["one"], 0.0),
    (list("abcde"), 0.0),  # all types differ: no factor at all
    (["x", "x"], 2.0),  # 1/2 ends the only factor, both ways
    (["x", "x", "y"], (3 / 1.0 + 3 / (1 / 3 / 0.28 if 2 / 3 > 0.72 else 1.0)) / 2),  # forwards xx and a rest y of share 1; backwards y, yx, yxx: 2/3 ends it
    (list("abca"), 4 / (0.25 / 0.28)),  # 3/4 stays above: the rest alone, alike both ways
    (list("abcab"), 5.0),  # 3/5 ends it at the fifth token, alike both ways
    (list("aabbcc"), (6 / 3 + 6 / 3) / 2),  # pairs end factors one by one
    (list("abcdabcd") * 50, 400 / (400 / 6)),  # 4/6 ends each factor, 66 of them and a rest of four types
]


def test_diversity(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(MTLD_CASES)], "i int, k array<string>")
    rows = df.select("i", t.token_entropy(F.col("k")).alias("e"), t.mtld(F.col("k")).alias("m"), *t.lexical_features(F.col("k")).values()).orderBy("i").collect()
    for r, (c, want) in zip(rows, MTLD_CASES, strict=True):
        shares = [c.count(w) / len(c) for w in set(c)]
        assert r["e"] == pytest.approx(-sum(p * math.log2(p) for p in shares), abs=1e-12)
        assert r["m"] == pytest.approx(want, rel=0.02 if len(c) > 100 else 1e-9), c
    assert rows[5]["mtld"] is None and rows[5]["token_count"] == 4 and rows[6]["mtld"] == pytest.approx(5.0)


def test_diversity_of_long_texts(spark):
    """All types of a long text differ: neither measure may take the square of its length."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda x: F.concat(F.lit("w"), x.cast("string"))).alias("k"))
    start = time.time()
    r = df.select(t.token_entropy(F.col("k")).alias("e"), t.mtld(F.col("k")).alias("m")).first()
    assert r["e"] == pytest.approx(math.log2(200_000)) and r["m"] == 0.0 and time.time() - start < 60


def test_labels(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (-1, [])], "c int, w array<string>")
    assert [r[0] for r in df.select(t.cluster_name(F.col("c"), F.col("w"))).collect()] == ["Cluster 0: a, b", "Noise"]
    assert one(spark, t.hashtags, "#Été #b_1 x#y") == [["#Été", "#b_1", "#y"]]
