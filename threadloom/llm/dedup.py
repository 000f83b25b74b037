"""Operator 9: near-duplicate groups by MinHash, odd sketches and exact set checks.

1. One Arrow pass turns each text into its shingle set's size and 128-bit id,
   MinHash bands, and an odd sketch (the MinHash samples folded into a parity bitmap).
2. Documents with equal sets are one class; only its smallest id goes on.
3. Band buckets pair each member with the bucket's hub, the member with most
   company: a star, not all pairs. Odd sketches drop hubs that are plainly unlike.
4. Full sets decide each star pair. What a member adds to and lacks of its hub
   (its difference) is kept.
5. Members that the stars leave in another component than their hub may link to
   other members. Such pairs share over 4/9 of a difference (see ``_missed``), so an
   exact prefix join on the rarest difference elements finds them without trying all
   pairs of the group. Members unlike their hub are compared by sketches first.
6. Links make components by alternating large and small stars.

Every link that the bands propose is confirmed on full sets. A pair at similarity
0.8 shares no band with probability (1 - 0.8**4)**32, about 5e-8.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, measured_join, packed, ship

ship(__name__)

SHINGLE = 2
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 80
SAMPLES, ROWS = 128, 4
BITS = 512
#: Differing sketch bits above which a pair is plainly unlike: similarity 0.45 gives 108 of 512, deviation 10.
MOST_BITS = 148
MIX = np.uint64(0x9E3779B97F4A7C15)
WORD_CACHE = 500_000
#: Tasks that a vertex's links are dealt to when its component is found.
SALTS = 8


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k-word shingles of a text with A-Z lower-cased.

    Fewer than k words are one shingle; null or blank text has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(words) < k:
        out = np.uint64(len(words))
        for x in h:
            out = mixed(np.array([out * MIX ^ x]))[0]
        return np.array([out])
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = mixed(out * MIX + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * MIX)
    return (x[:SAMPLES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[SAMPLES:] >> np.uint64(32)).astype(np.uint32)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima of linear permutations of the shingles' upper halves."""
    a, b = _permutations()
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 512):
        part = np.multiply.outer(a, low[at : at + 512])
        part += b[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of ROWS samples."""
    rows = samples.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) * MIX
    for j in range(ROWS):
        key = mixed(key * MIX + rows[:, j])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Each sample flips one of BITS bits; the XOR of two sketches counts samples that differ."""
    at = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * MIX + samples.astype(np.uint64)) % np.uint64(BITS)
    parity = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def _features(batches):
    import pyarrow as pa
    import xxhash

    hashes = WordHashes()
    for batch in batches:
        ids, n, high, low, bands, odd = batch.column(0), [], [], [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py(), hashes)
            n.append(len(s))
            digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
            high.append(int(digest[0]))
            low.append(int(digest[1]))
            samples = min_hashes(s) if len(s) else None
            bands.append(band_keys(samples) if len(s) else np.empty(0, np.int64))
            odd.append(odd_sketch(samples) if len(s) else np.empty(0, np.int64))
        lists = lambda x: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int32), np.concatenate(x) if x else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), lists(bands), lists(odd)], names=["doc", "n", "high", "low", "bands", "odd"])


def _sets(batches):
    import pyarrow as pa

    hashes = WordHashes()
    for batch in batches:
        made = [shingle_set(text.as_py(), hashes).view(np.int64) for text in batch.column(1)]
        ends = np.concatenate([[0], np.cumsum([len(v) for v in made])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, np.concatenate(made) if made else np.empty(0, np.int64))], names=["doc", "set"])


def features(docs: DataFrame) -> DataFrame:
    """``doc, n, high, low, bands, odd`` of ``doc, text`` rows."""
    return docs.select("doc", "text").mapInArrow(_features, "doc bigint, n bigint, high bigint, low bigint, bands array<bigint>, odd array<bigint>")


def _linked(sym: Column, a: Column, b: Column) -> Column:
    """Similarity of PERCENT or more, from the size of the symmetric difference and the sets' sizes."""
    union = (a + b + sym) / 2
    return 100 * (union - sym) >= PERCENT * union


def _bits(a: str, b: str) -> Column:
    """Differing bits of two odd sketches."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)")


def _star(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct ``hub, doc`` pairs with ``unlike`` from their odd sketches."""
    pairs = members.where("doc <> hub").select("hub", "doc").distinct()
    pairs = pairs.join(reps.select("doc", "odd"), "doc").join(reps.select(F.col("doc").alias("hub"), F.col("odd").alias("hub_odd")), "hub")
    return pairs.select("hub", "doc", (_bits("odd", "hub_odd") > MOST_BITS).alias("unlike"))


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Star pairs with the member's difference from its hub (added elements first) and ``linked``."""
    full = pairs.join(sets, "doc").join(sets.select(F.col("doc").alias("hub"), F.col("set").alias("hub_set")), "hub")
    full = full.select("hub", "doc", F.array_except("set", "hub_set").alias("added"), F.array_except("hub_set", "set").alias("lacking"), F.size("set").cast("long").alias("n"), F.size("hub_set").cast("long").alias("n_hub"))
    full = full.withColumn("diff", F.concat("added", "lacking")).drop("added", "lacking")
    sym = F.size("diff").cast("long")
    return full.withColumn("linked", _linked(sym, F.col("n"), F.col("n_hub"))).withColumn("similarity", (F.col("n") + F.col("n_hub") - sym) / (F.col("n") + F.col("n_hub") + sym))


def _missed(diffs: DataFrame) -> DataFrame:
    """Links between two members of one hub of which one, x, is in another component than the hub.

    With D the difference from the hub h, x and y differ in |Dx| + |Dy| - 2|Dx n Dy|
    elements, at most (|x| + |y|) / 9 if they link; |Dx| is above (|x| + |h|) / 9. So
    18 |Dx n Dy| > 9 |Dy| + |h| - |y|: y shares at least t elements of its difference,
    hence one of any |Dy| - t + 1 of them. Those that fewest x have are tried: what y
    adds to the hub is mostly its own, so few pairs are.
    """
    apart = diffs.where("part <> hub_part")
    x = apart.select("hub", F.col("doc").alias("x"), F.col("part").alias("part_x"), F.col("n").alias("nx"), F.explode("diff").alias("e"))
    held = x.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("held"), F.min("part_x").alias("low"), F.max("part_x").alias("high"))
    t = F.expr("(9 * size(diff) + n_hub - n) div 18 + 1")
    y = diffs.join(apart.select("hub").distinct(), "hub", "left_semi").withColumn("k", F.size("diff") - t + 1)
    y = y.select("hub", F.col("doc").alias("y"), F.col("part").alias("part_y"), F.col("n").alias("ny"), "k", F.explode("diff").alias("e"))
    y = y.join(held, ["hub", "e"], "left").withColumn("r", F.row_number().over(Window.partitionBy("hub", "y").orderBy(F.col("held").asc_nulls_first(), "e")))
    # What only y's own component has makes no pair.
    y = y.where("r <= k and held is not null and (low <> part_y or high <> part_y)").select("hub", "y", "part_y", "ny", "e")
    like = 100 * F.least("nx", "ny") >= PERCENT * F.greatest("nx", "ny")
    tried = x.join(y, ["hub", "e"]).where(like & (F.col("part_x") != F.col("part_y"))).select("hub", "x", "y").distinct()
    tried = tried.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("hub").alias("hub"))
    side = lambda v: diffs.select("hub", F.col("doc").alias(v), F.col("diff").alias(f"d{v}"), F.col("n").alias(f"n{v}"))
    both = tried.join(side("x"), ["hub", "x"]).join(side("y"), ["hub", "y"])
    sym = F.size("dx") + F.size("dy") - 2 * F.size(F.array_intersect("dx", "dy"))
    return both.where(_linked(sym.cast("long"), F.col("nx"), F.col("ny"))).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _among(far: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of members that are plainly unlike a hub, with each other or with others below 0.65.

    ``far``: ``doc, part, unlike``, one row for each document. Linked sets share at least PERCENT of the
    larger one, hence one of the rarest elements that remain when as many less one are left out.
    Elements that one component alone has there are dropped before pairs are made: what members far from
    a hub have in common is what they all have, and rare elements are mostly their own.
    """
    has = far.join(sets, "doc").select("doc", "part", "unlike", F.size("set").cast("long").alias("n"), F.explode("set").alias("e"))
    has = durable(has, "elements")
    held = has.groupBy("e").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    rarest = Window.partitionBy("doc").orderBy(F.col("held").asc_nulls_first(), "e")
    prefix = has.join(held, "e", "left").withColumn("r", F.row_number().over(rarest))
    prefix = durable(prefix.where(f"held is not null and r <= n - ({PERCENT} * n + 99) div 100 + 1").select("doc", "part", "unlike", "n", "e"), "prefixes")
    split = prefix.groupBy("e").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max("unlike").alias("any")).where("low <> high and any").select("e")
    left = prefix.join(split, "e")
    other = left.select("e", F.col("doc").alias("b"), F.col("part").alias("part_b"), F.col("unlike").alias("unlike_b"), F.col("n").alias("n_b"))
    near = (F.col("doc") < F.col("b")) & (F.col("part") != F.col("part_b")) & (F.col("unlike") | F.col("unlike_b")) & (100 * F.least("n", "n_b") >= PERCENT * F.greatest("n", "n_b"))
    pairs = left.join(other, "e").where(near).select(F.col("doc").alias("a"), "b").distinct()
    side = lambda c, odd: reps.select(F.col("doc").alias(c), F.col("odd").alias(odd))
    pairs = pairs.join(side("a", "odd_a"), "a").join(side("b", "odd_b"), "b").where(_bits("odd_a", "odd_b") <= MOST_BITS).select("a", "b")
    full = pairs.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("doc").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return full.where(100 * common >= PERCENT * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _with_hubs(keys: DataFrame) -> DataFrame:
    """``key, hub, doc`` of bands that two documents or more share.

    A bucket's hub is the member with most company over all its bands (ties: smallest
    id): in a group of edited copies that is the text they were made from, or nearly.
    """
    shared = keys.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("company")).where("first < last").select("key", "company")
    members = durable(keys.join(shared, "key").select("key", "doc", "company"), "shared")
    rank = members.groupBy("doc").agg(F.sum("company").alias("rank"))
    hubs = members.join(rank, "doc").groupBy("key").agg(F.max(F.struct("rank", (-F.col("doc")).alias("d"))).alias("best")).select("key", (-F.col("best.d")).alias("hub"))
    return durable(members.join(hubs, "key").select("key", "hub", "doc"), "members")


def _at_hubs(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` with the ``m`` of their ``u``; a hub's rows are dealt to SALTS tasks, each of which gets its ``m``."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    every = least.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return salted.join(every, ["u", "salt"])


def components(links: DataFrame) -> DataFrame:
    """``doc, component`` (the smallest id reachable) for each id in ``a, b`` links.

    Alternating large and small stars; each step is a durable narrow table. Minima
    are aggregated before they are joined back, and a hub's links are dealt to several
    tasks there: a hub is not gathered anywhere.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = _at_hubs(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _at_hubs(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        got = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(got) == state:
            break
        state = tuple(got)
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("doc"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row.

    Defined cases: null, empty or blank texts have no shingles, link with nothing and
    are kept; equal sets link whatever the texts; rows with a null id link with
    nothing, have a null component and are kept; rows that repeat an id are one
    document each with the same component; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    feats = durable(features(rows), "features")
    keyed = feats.where("n > 0 and doc is not null")
    classes = durable(keyed.groupBy("high", "low").agg(F.min("doc").alias("rep")), "classes")
    reps = keyed.join(classes.select(F.col("rep").alias("doc"), "high", "low"), ["doc", "high", "low"]).dropDuplicates(["doc", "high", "low"])
    reps = durable(reps.select("doc", "n", "bands", "odd"), "reps")
    keys = reps.select("doc", F.explode("bands").alias("key"))
    members = _with_hubs(keys)
    wanted = durable(members.select("doc").distinct(), "wanted")
    sets = durable(measured_join(rows, wanted, "doc", "left_semi").mapInArrow(_sets, "doc bigint, set array<bigint>"), "sets")
    star = durable(_star(members, reps), "star")
    diffs = durable(_differences(star.where("not unlike").select("hub", "doc"), sets), "differences")
    # First the stars' components: only pairs of different ones need trying.
    stars = durable(components(diffs.where("linked").select(F.col("hub").alias("a"), F.col("doc").alias("b"))), "stars")
    part = lambda c, new: stars.select(F.col("doc").alias(c), F.col("component").alias(new))
    diffs = diffs.join(part("doc", "part"), "doc", "left").join(part("hub", "hub_part"), "hub", "left").withColumn("part", F.coalesce("part", "doc")).withColumn("hub_part", F.coalesce("hub_part", "hub"))
    # A member unlike its hub may link to one below 0.65 (0.45 and 0.2): such pairs are tried by their rarest elements.
    far = star.where("unlike").select("doc", "unlike").unionByName(diffs.where("similarity < 0.65").select("doc", F.lit(False).alias("unlike")))
    far = far.groupBy("doc").agg(F.max("unlike").alias("unlike")).join(part("doc", "part"), "doc", "left").withColumn("part", F.coalesce("part", "doc"))
    links = stars.select(F.col("doc").alias("a"), F.col("component").alias("b")).unionByName(_missed(diffs)).unionByName(_among(durable(far, "far"), reps, sets))
    parts = components(links)
    of_class = classes.join(parts.withColumnRenamed("doc", "rep"), "rep", "left").select("high", "low", F.coalesce("component", "rep").alias("component"))
    out = feats.select("doc", "n", "high", "low").join(of_class, ["high", "low"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.coalesce("component", "doc")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each group stays.

    Null, empty and blank texts link with nothing and stay, as do rows with a null id;
    texts of any length are compared whole; of rows that repeat an id, one stays (that
    of the least hash); an empty table stays empty; columns of any name are kept as they are.
    """
    gone = durable(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    twice = durable(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("twice")).count().where("count > 1").select("twice"), "twice")
    rows = measured_join(packed(docs, doc=F.col("doc_id").cast("long")), gone, F.col("doc") == F.col("gone"), "left_anti")
    if not twice.isEmpty():
        same = F.col("doc") == F.col("twice")
        # Repeated rows shrink to the least in each task first, so that no id's rows are gathered.
        least = measured_join(rows, twice, same, "left_semi").groupBy("doc").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        rows = measured_join(rows, twice, same, "left_anti").select("row").unionByName(least.select("row"))
    return rows.select("row.*")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(l) = 0 THEN [] WHEN len(l) = 1 THEN l
    ELSE list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) END)) AS e FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sig AS (SELECT doc_id, md5(string_agg(e, chr(10) ORDER BY e)) AS sig FROM s GROUP BY doc_id),
rep AS (SELECT sig, min(doc_id) AS rep FROM sig GROUP BY sig),
r AS (SELECT s.doc_id, s.e FROM s JOIN rep ON rep.rep = s.doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM r a JOIN r b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT rep AS a, rep AS b FROM rep UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
part AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(part.c, d.doc_id) AS component_id, coalesce(part.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN sig ON sig.doc_id = d.doc_id
LEFT JOIN rep ON rep.sig = sig.sig LEFT JOIN part ON part.rep = rep.rep
"""
