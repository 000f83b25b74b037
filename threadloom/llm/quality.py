"""Operator 2: host-level quality rules.

Base rules judge each text. Failures are aggregated by host, the hosts' rates
are shrunk with an empirical beta prior (method of moments over all hosts), and
hosts whose shrunk rate is too high reject all their documents.

Texts are read once: the base statistics go to a durable table, from which both
the host rates and the join back are computed. Only DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, durable, let, measured_join, packed, words

#: Symbols counted by n_symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules and of the host verdict."""

    min_words: int = 10
    max_repeat_percent: int = 20
    #: A host is rejected if its shrunk failure rate is above this.
    max_host_rate: float = 0.5
    #: Strength of the prior, in documents: bounds, and the value used when hosts do not differ.
    min_strength: float = 1.0
    max_strength: float = 10_000.0


def _windows(hashes: Column) -> Column:
    """A 64-bit hash for each window of WINDOW words."""
    n = F.size(hashes)
    at = lambda i, k: F.get(hashes, i + k)
    return F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))))


def _covered(windows: Column) -> Column:
    """Words covered by windows that occur twice or more.

    Sorted (hash, position) pairs put equal windows side by side; the positions of
    repeated ones, sorted again, cover 5 words each less what they overlap.
    """
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(a: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(a, k)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(a, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    add = lambda z, i: F.struct(i.alias("last"), (z["n"] + F.least(i - z["last"], F.lit(WINDOW))).alias("n"))
    return F.aggregate(let(pairs, starts), zero, add, lambda z: z["n"])


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_stats(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``row, text, host`` rows with the base statistics and ``base_failed``.

    Defined cases: null, empty or blank text has no words, so all counts are 0 and
    the rule on words fails it. Windows are compared by a 64-bit hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    out = rows.withColumn("hashes", F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).withColumn("windows", _windows(F.col("hashes"))).withColumn("lines", lines)
    stats = {
        "n_words": F.size("hashes").cast("long"),
        "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(_covered(F.col("windows"))),
    }
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return out.withColumns(stats).drop("text", "hashes", "windows", "lines").withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Hosts with ``n_docs, n_failed, shrunk_rate, host_failed``; a null host is a host of its own.

    The prior is a beta distribution fitted by moments: its mean is the overall
    rate, its strength follows from the variance between hosts beyond what
    sampling alone would give. The fit is one row, so joining it is a broadcast of
    one row.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = durable(hosts, "hosts")
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("k"), F.count(F.lit(1)).alias("h"), F.sum(F.pow(F.col("n_failed"), 2) / F.col("n_docs")).alias("q"))
    mean = F.col("k") / F.col("n")
    within = mean * (1 - mean)
    between = F.col("q") / F.col("n") - mean * mean - within * F.col("h") / F.col("n")
    strength = F.when(between > 1e-12, F.least(F.greatest(within / between - 1, F.lit(rules.min_strength)), F.lit(rules.max_strength))).otherwise(F.lit(rules.max_strength))
    prior = total.where(F.col("n") > 0).select(mean.alias("mean"), strength.alias("strength"))
    fit = prior.first()
    mean, strength = (fit["mean"], fit["strength"]) if fit else (0.0, rules.max_strength)
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("shrunk_rate", rate).withColumn("host_failed", rate > rules.max_host_rate)


def _judged(docs: DataFrame, text: Column, host: Column, rules: Rules, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row, host``, the base statistics, ``base_failed, shrunk_rate, kept`` of each row."""
    judged = durable(with_stats(packed(docs, keep, text=text, host=host), rules), "quality")
    verdicts = host_verdicts(judged, rules).where("host_failed").select(F.col("host").alias("bad"), "shrunk_rate", F.lit(True).alias("is_bad"))
    out = measured_join(judged, verdicts, F.col("host").eqNullSafe(F.col("bad")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("is_bad").isNull()).drop("bad", "is_bad")


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", rules: Rules = Rules(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """All rows with base statistics, ``base_failed``, ``shrunk_rate`` and ``kept``.

    ``kept`` is false if the base rules or the host's verdict fail the document; the rate
    is that of rejected hosts, else null. Defined cases: repeated rows count each; null
    hosts share one verdict; columns of the input with the names of the statistics are
    replaced; empty input gives an empty result. Only the columns in ``keep`` (default:
    all) are stored and returned.
    """
    made = (*STATS, "base_failed", "shrunk_rate", "kept")
    out = _judged(docs, F.col(text_col), F.col(host_col), rules, keep)
    return out.select(*(F.col(f"row.`{c}`") for c in (docs.columns if keep is None else keep) if c not in made), *made)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, keep=("doc_id",)).select("doc_id", *STATS, "base_failed", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that base rules or host verdicts reject go.

    Null, empty and very long texts are judged as by ``judge``; repeated rows are judged
    alike; an empty table stays empty; columns of any name, the statistics' too, are
    kept as they are.
    """
    return _judged(docs, F.col("text"), F.col("source"), Rules()).where("kept").select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
flat AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
grams AS (
  SELECT doc_id, i, lead(word, 4) OVER o AS fifth,
    word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram
  FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
twice AS (SELECT doc_id, i, fifth IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS again FROM grams),
covered AS (SELECT doc_id, max(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM twice),
rep AS (SELECT doc_id, sum(c) AS n FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
base AS (
  SELECT w.doc_id, w.source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS k FROM judged GROUP BY source),
total AS (SELECT sum(n) AS n, sum(k) / sum(n) AS m, count(*) AS h, sum(k * k / n) AS q FROM hosts),
prior AS (SELECT m, CASE WHEN q / n - m * m - m * (1 - m) * h / n > 1e-12
  THEN least(greatest(m * (1 - m) / (q / n - m * m - m * (1 - m) * h / n) - 1, 1.0), 10000.0) ELSE 10000.0 END AS s FROM total),
bad AS (SELECT source FROM hosts, prior WHERE (k + m * s) / (n + s) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM judged.source) AS kept
FROM judged
"""
