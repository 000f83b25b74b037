import re
from collections import Counter

from threadloom.llm import quality

SCHEMA = "doc_id bigint, text string, source string, n_words int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \t\n\x0b\x0c\r", "one", "a b c d e f a b c d e", "x " * 30, "l1 w\nl1 w\n\n \n#*$ <é>\nl1 w", " ".join(f"w{i}" for i in range(20000)), "q w e r t y u i o p " * 2, "a b c"]


def test_stats(spark):
    docs = spark.createDataFrame([(i, t, "s", 5) for i, t in enumerate(TEXTS)], SCHEMA)
    for r in quality.judge(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(TEXTS[r["doc_id"]]), r["doc_id"]


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(50)), "too short"
    data = [(i, bad, "bad", 0) for i in range(200)] + [(1000, good, "bad", 0)] + [(2000 + i, good, f"h{i % 5}", 0) for i in range(100)] + [(5000, good, None, 0)] * 6 + [(5001, bad, None, 0)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(data, SCHEMA)).collect()}
    assert not got[1000]["kept"] and not got[1000]["base_failed"] and got[2000]["kept"] and got[5000]["kept"] and not got[5001]["kept"]
    assert quality.judge(spark.createDataFrame(data, SCHEMA)).count() == len(data)


def test_skewed_hosts_against_brute_force(spark):
    """Small hosts shrink towards all others, large ones hardly: the verdict is the posterior mean's."""
    good, bad = " ".join(f"w{i}" for i in range(20)), "short"
    sizes = {"hot": (400, 120), "worst": (60, 48), "mixed": (50, 20), "one": (1, 1), "two": (2, 2), "many": (30, 28), **{f"s{k}": (20 + k, 6 + k % 3) for k in range(8)}}
    data = [(i, bad if i < k else good, h, 0) for h, (n, k) in sizes.items() for i in range(n)]
    n = sum(x for x, _ in sizes.values())
    mean = sum(k for _, k in sizes.values()) / n
    within = mean * (1 - mean)
    between = sum(k * k / x for x, k in sizes.values()) / n - mean * mean - within * len(sizes) / n
    strength = min(max(within / between - 1, 1.0), 10_000.0)
    failed = {h for h, (x, k) in sizes.items() if (k + mean * strength) / (x + strength) > 0.5}
    assert "worst" in failed and "one" not in failed and len(failed) < 5
    for r in quality.judge(spark.createDataFrame(data, SCHEMA)).collect():
        assert r["kept"] == (not r["base_failed"] and r["source"] not in failed)


def test_empty(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
