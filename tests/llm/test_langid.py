from threadloom.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, score int"


def brute(text, profiles, top, text_top):
    from collections import Counter

    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts = Counter(g for w in words for p in [f" {w} "] for n in (1, 2, 3) for g in (p[i : i + n] for i in range(len(p) - n + 1)) if g.strip())
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for g, _ in sorted(((code(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))][:text_top]


def test_ranking_equals_brute_force():
    text = "The cat's hat, the HAT! Éa ß 12 ö"
    assert langid.ranked(langid.grams(langid.spaced(text)), 50).tolist() == brute(text, None, 0, 50)


def test_distances_equal_brute_force(spark):
    texts = {"en": ["the quick brown fox and the lazy dog", "with them that is the thing"], "de": ["der schnelle braune fuchs und das faule tier", "ist nicht schön"], "fr": ["le renard brun rapide et le chien paresseux"]}
    settings = langid.Settings(top=60, text_top=40)
    learned = langid.learn(spark.createDataFrame([(lang, t) for lang, ts in texts.items() for t in ts], "lang string, text string"), settings)
    profiles = {lang: brute(" ".join(ts), None, 0, 60) for lang, ts in texts.items()}
    for text in ("the dog is quick", "das tier ist faul", "le chien", "z q", "Été"):
        top = brute(text, None, 0, 40)
        far = {lang: sum(abs(p.index(g) - i) if g in p else 60 for i, g in enumerate(top)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert langid.guess(text, learned, 40) == (best, 1 - far[best] / (60 * len(top)))


def test_best_ngrams_are_cut_before_the_shuffle(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = spark.range(9).select((F.col("id") % 2).alias("lang"), F.col("id").alias("n"))
    plan = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("n"))).where("k <= 3")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_predicts(spark):
    en, de = "the quick brown fox and the lazy dog with them that is the thing", "der schnelle braune fuchs und das faule tier ist nicht schön für die leute"
    data = [(i, (en if i % 2 else de) + f" {i}", "en" if i % 2 else "de", 1) for i in range(40)] + [(100, None, "en", 1), (101, "123 !?", "en", 1), (102, en, None, 1), (102, en, None, 1), (None, de * 3000, None, 1)]
    docs = spark.createDataFrame(data, SCHEMA)
    got = langid.identify(docs, langid.learn(docs)).collect()
    assert len(got) == len(data)
    for r in got:
        want = "und" if r["doc_id"] in (100, 101) else "de" if r["doc_id"] is None or (r["doc_id"] < 100 and r["doc_id"] % 2 == 0) else "en"
        assert r["lang_pred"] == want and 0 <= r["score"] <= 1


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "text", None, 1)], SCHEMA)
    assert langid.identify(docs, langid.learn(docs)).first()["lang_pred"] == "und"
    assert langid.identify(docs.limit(0), langid.learn(docs)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    got = langid.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
