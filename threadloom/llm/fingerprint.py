"""Operator 3: threshold-scaled document sketches.

A document's sketch keeps every shingle hash below a fixed fraction of the hash
range, and never fewer than the LEAST smallest: of its sorted distinct hashes, a
prefix. Sketches of any two documents, however unequal, intersect and unite like
the sets they sample, so containment estimates come from the sketches alone, and the
sketch of united texts is a prefix of their sketches' union.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, plan_bytes, words

SHINGLE = 5
#: One hash in SCALE is kept, but no fewer than LEAST. A long text's fingerprint has one character a word, more or less.
SCALE, LEAST = 16, 32
#: Bytes of files that a range of documents has, ranges for each core at least, and the most ranges (bounds are literals of the plan).
RANGE_BYTES, RANGES_A_CORE, MOST_RANGES = 4 << 20, 16, 1 << 16


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """64-bit hashes of k-word shingles; fewer words are one shingle, none give none."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        n = F.size(h)
        whole = F.aggregate(h, F.lit(42).cast("long"), lambda z, x: F.xxhash64(z, x))
        return (
            F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n < k, F.array(whole))
            .otherwise(F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k)))))
        )

    return let(hashes, windows)


def _below(scale: int) -> Column:
    """The end of the lowest 1/scale of the (signed) range."""
    return F.lit(-(2**63) + 2**64 // scale)


def sketch(text: Column, scale: int = SCALE, k: int = SHINGLE, least: int = LEAST) -> Column:
    """Sorted distinct shingle hashes: those below 1/scale of the range, or the ``least`` smallest if these are more.

    Null, empty and blank texts have an empty sketch; texts of up to ``least`` distinct
    shingles are kept whole.
    """

    def kept(h: Column) -> Column:
        low = F.sort_array(F.array_distinct(F.filter(h, lambda x: x < _below(scale))))
        return let(low, lambda a: F.when(F.size(a) >= least, a).otherwise(F.slice(F.sort_array(F.array_distinct(h)), 1, least)))

    return let(shingles(text, k), kept)


def merge(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The sketch of two texts' united shingle sets, from their sketches."""
    cut = lambda u: F.slice(u, F.lit(1), F.greatest(F.size(F.filter(u, lambda x: x < _below(scale))), F.lit(least)))
    return let(F.sort_array(F.array_union(a, b)), cut)


def containment(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """Estimated share of the smaller document's shingles that the other has, 0 to 1.

    Only hashes are compared up to which both sketches are complete. Two empty sketches
    are alike (1), an empty and another are not (0); nor are those without a hash to compare.
    """
    whole = lambda x: F.when(F.size(x) < least, F.lit(2**63 - 1)).otherwise(F.greatest(_below(scale) - 1, F.try_element_at(x, F.lit(-1))))

    def share(t: Column) -> Column:
        upto = lambda x: F.size(F.filter(x, lambda h: h <= t))
        n = F.least(upto(a), upto(b))
        return F.when(n == 0, F.lit(0.0)).otherwise(upto(F.array_intersect(a, b)) / n)

    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(F.least(whole(a), whole(b)), share)).cast("double")


def encode(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def decode(text: Column) -> Column:
    """A sketch from its text."""
    pieces = F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), (F.length(text) / 16).cast("int") - 1), lambda i: F.substring(text, (i * 16 + 1).cast("int"), F.lit(16))))
    high = lambda p: F.conv(F.substring(p, 1, 8), 16, 10).cast("long")
    low = lambda p: F.conv(F.substring(p, 9, 8), 16, 10).cast("long")
    return F.transform(pieces, lambda p: F.shiftleft(high(p), 32).bitwiseOR(low(p)))


def bucket_of(key: Column, splits: list[int]) -> Column:
    """1-based number of the last split that is not above the key, by binary search."""
    a = F.expr(f"array({', '.join(f'{x}L' if x > -(2**63) else 'bigint(-9223372036854775808)' for x in splits)})")
    step = F.array(*(F.lit(1 << m) for m in reversed(range(len(splits).bit_length()))))
    return F.aggregate(step, F.lit(0), lambda at, p: F.when(F.coalesce(F.get(a, at + p - 1) <= key, F.lit(False)), at + p).otherwise(at))


def n_ranges(docs: DataFrame) -> int:
    """Ranges for a table of this many bytes (of its files, or as estimated)."""
    return max(RANGES_A_CORE * docs.sparkSession.sparkContext.defaultParallelism, min(MOST_RANGES, plan_bytes(docs) // RANGE_BYTES + 1))


def with_next(docs: DataFrame, key_col: str, value_cols: dict[str, str], n_buckets: int | None = None) -> DataFrame:
    """Add columns of the next row in ascending key order; the last row's next is the first.

    ``value_cols`` maps a source column to the name of its copy. Rows are dealt
    into ranges of the key, split at approximate quantiles (a bounded list of
    actual keys), so no task orders the whole table. The first row of a range also
    goes, marked, to the end of the range before; so each range is complete by
    itself and one shuffle does. There are as many ranges as the table's bytes ask for.
    Null keys come first; equal keys order by the values' hash.
    """
    n_buckets = n_buckets or n_ranges(docs)
    low = F.lit(-(2**63) + 1)
    key = F.coalesce(F.col(key_col).cast("long"), low)
    steps = [i / n_buckets for i in range(n_buckets)]
    got = docs.select(key.alias("k")).agg(F.percentile_approx("k", steps, F.lit(20 * n_buckets)).alias("s"), F.min("k").alias("m")).first()
    splits = sorted({got["m"], *(got["s"] or [])}) if got["m"] is not None else [0]
    b = F.col("_b")
    rows = docs.withColumn("_k", key).withColumn("_b", bucket_of(F.col("_k"), splits)).withColumn("_tie", F.xxhash64(*value_cols))
    at_split = F.get(F.expr(f"array({', '.join(f'{x}L' for x in splits)})"), b - 1) == F.col("_k")
    before = F.when(b > 1, b - 1).otherwise(F.lit(len(splits)))
    home = F.struct(b.alias("b"), F.lit(0).alias("late"))
    places = F.when(at_split, F.array(home, F.struct(before.alias("b"), F.lit(1).alias("late")))).otherwise(F.array(home))
    rows = rows.withColumn("_p", F.explode(places)).withColumn("_b", F.col("_p.b")).withColumn("_late", F.col("_p.late"))
    order = Window.partitionBy("_b").orderBy("_late", "_k", "_tie")
    return rows.withColumns({new: F.lead(old).over(order) for old, new in value_cols.items()}).where("_late = 0").drop("_k", "_tie", "_p", "_b", "_late")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of op3: fingerprints of each text and of its edited text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("sketch", sketch(F.col("text"))), "doc_id", {"text": "next_text", "sketch": "next_sketch"}, n_ranges(docs))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch").withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        encode(F.col("sketch")).alias("fingerprint"),
        encode(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
