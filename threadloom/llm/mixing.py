"""Operator 4: mixing sources to target weights by Sainte-Laguë apportionment.

Each source's words are cut into equal blocks. Seats (blocks to take) go to
sources by highest quotients ``votes / (2 seats + 1)``, then, within a source, to
its shards in the same way; within a shard a seeded permutation picks the blocks.
A source whose target is above its size is taken in whole rounds first.

Only narrow tables (sources, shards) are ordered as a whole. Documents are dealt to
shards of bounded size by hash, so a source with a third of all rows is many shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, durable, let, measured_join, n_words, packed


@dataclass(frozen=True)
class Mix:
    """Weights by rank of the source, the most a source may repeat, and block sizes."""

    weights: tuple[int, ...] = (5, 2, 1)
    most_repeats: int = 3
    #: Words in a block: the smallest target over ``blocks_for_least``, within these bounds.
    least_block: int = 16
    most_block: int = 4096
    blocks_for_least: int = 64
    blocks_in_shard: int = 1024
    seed: int = 17


def _primes(n: int = 16, least: int = 1_000_000_000, step: int = 61_803_399) -> tuple[int, ...]:
    """Primes far apart: the first at or after each of ``n`` numbers, a step apart."""
    small = [p for p in range(2, 46_341) if all(p % q for q in range(2, int(p**0.5) + 1))]
    return tuple(next(x for x in range(least + k * step, least + (k + 1) * step) if all(x % p for p in small)) for k in range(n))


#: Primes above any number of blocks in a shard: multiplying by one permutes them. Each shard's seed draws its own.
PRIMES = _primes()


def webster(rows: DataFrame, group: list[str], key: list[str], votes: str, seats: Column, out: str) -> DataFrame:
    """Seats by highest Sainte-Laguë quotients, as column ``out``; exact, ties by key.

    Divisors that surely give too few and too many seats bracket each row's seats;
    only the quotients between are ranked, about two for each row.
    """
    all_rows = Window.partitionBy(*group)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(all_rows)).withColumn("_w", F.sum(votes).over(all_rows)).withColumn("_seats", seats)
    share = lambda n: F.when(F.col("_w") > 0, F.floor(F.col(votes) * F.greatest(n, F.lit(0.0)) / F.col("_w") + 0.5)).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("_lo", share(F.col("_seats") - F.col("_n") / 2)).withColumn("_hi", share(F.col("_seats") + F.col("_n") / 2))
    rows = rows.withColumn("_left", F.col("_seats") - F.sum("_lo").over(all_rows))
    tried = rows.select(*dict.fromkeys([*group, *key, votes, "_left"]), F.explode(F.sequence(F.col("_lo"), F.greatest(F.col("_hi"), F.col("_lo")))).alias("_s"))
    best = Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_s") + 1)).desc(), *key)
    won = tried.withColumn("_rank", F.row_number().over(best)).where("_rank <= _left").groupBy(*dict.fromkeys([*group, *key])).agg(F.count(F.lit(1)).alias("_won"))
    names = list(dict.fromkeys([*group, *key]))
    a, b = rows.alias("a"), won.alias("b")
    on = None
    for c in names:
        same = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        on = same if on is None else on & same
    joined = a.join(b, on, "left")
    keep = [c for c in rows.columns if not c.startswith("_") or c in names]
    return joined.select(*(F.col(f"a.{c}") for c in keep), (F.col("a._lo") + F.coalesce(F.col("b._won"), F.lit(0))).cast("long").alias(out))


def plan_sources(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row for each source: ``source, source_size, target, block, n_blocks, quota, n_shards``.

    The table of sources (a narrow row each) is ordered in one task, as ranks ask.
    Targets: water level by weights; a source stops at ``most_repeats`` times its size.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = F.array(*(F.lit(w) for w in mix.weights))
    s = s.withColumn("weight", F.get(weights, (F.row_number().over(by_name) - 1) % len(mix.weights)))
    s = s.withColumn("cap", mix.most_repeats * F.col("source_size")).withColumn("total", F.sum("source_size").over(everything))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
    weight_sum = F.sum("weight").over(everything)
    s = s.withColumn("capped", F.col("cap") * (weight_sum - F.col("weight_before")) <= F.col("weight") * (F.col("total") - F.col("cap_before")))
    taken_cap = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    free_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("total") - taken_cap) / F.nullif(free_weight, F.lit(0))))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    block = F.least(F.greatest(F.floor(least / mix.blocks_for_least), F.lit(mix.least_block)), F.lit(mix.most_block))
    s = s.withColumn("block", F.coalesce(block, F.lit(mix.least_block)).cast("long"))
    s = s.withColumn("n_blocks", F.greatest(F.floor(F.col("source_size") / F.col("block") + 0.5), F.lit(1)).cast("long"))
    s = s.withColumn("n_shards", F.ceil(F.col("n_blocks") / mix.blocks_in_shard).cast("long"))
    s = s.withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(F.lit(0.0)))
    s = durable(s.select("source", "source_size", "target", "block", "n_shards", "votes"), "sources")
    seats = F.floor(F.sum("votes").over(everything) + 0.5)
    return webster(s, [], ["source"], "votes", seats, "quota")


def _seeded(id_col: str, mix: Mix) -> Column:
    return F.md5(F.concat(F.lit(f"{mix.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def _place(rows: DataFrame, sources: DataFrame, id_col: str, mix: Mix) -> DataFrame:
    """Rows with their source's plan and their shard."""
    rows = measured_join(rows, sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "inner").drop("_source")
    rows = rows.withColumn("_order", _seeded(id_col, mix))
    return rows.withColumn("_shard", F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % F.col("n_shards"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix = Mix(), with_rows: bool = False) -> DataFrame:
    """Words that the mix takes of each row: ``doc_id, source, size, source_size, target, taken, cover``.

    ``cover`` lists the row's pieces in order, as ``start, stop`` (words, 0-based) and
    ``times``. Whole rows are carried along, as a struct ``row``, if asked for.

    Defined cases: null or blank texts have size 0 and nothing is taken; null sources
    are one source, ordered last; rows with equal ids and sizes are interchangeable;
    all sizes 0 give targets and takings of 0; texts of any length are cut into blocks;
    other columns are ignored, whatever their names.
    """
    rows = packed(docs, None if with_rows else (), doc_id=F.col(id_col), source=F.col(source_col).cast("string"), size=n_words(F.col(text_col)))
    rows = rows if with_rows else rows.drop("row")
    sizes = durable(rows.select("doc_id", "source", "size"), "sizes")
    if not with_rows:
        rows = sizes
    sources = durable(plan_sources(sizes, mix), "quotas")
    shards = _place(sizes, sources, "doc_id", mix).groupBy("source", "_shard", "block", "quota").agg(F.sum("size").alias("words"))
    shards = shards.withColumn("blocks", F.greatest(F.floor(F.col("words") / F.col("block") + 0.5), F.lit(1)).cast("long"))
    shards = shards.withColumnRenamed("_shard", "shard").withColumn("blocks_d", F.col("blocks").cast("double"))
    of_source = F.sum("blocks").over(Window.partitionBy("source"))
    shards = shards.withColumn("rounds", F.floor(F.col("quota") / of_source).cast("long")).withColumn("rest", F.col("quota") % of_source)
    shards = durable(shards.select("source", "shard", "words", "blocks", "blocks_d", "rounds", "rest"), "shards")
    quotas = webster(shards, ["source"], ["shard"], "blocks_d", F.col("rest"), "extra")
    drawn = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.coalesce("source", F.lit("")), F.col("shard")).cast("binary"))
    number = lambda at: F.conv(F.substring(drawn, at, 8), 16, 10).cast("long")
    prime = F.get(F.array(*map(F.lit, PRIMES)), (number(9) % len(PRIMES)).cast("int")).cast("long")
    quotas = durable(quotas.select("source", "shard", "words", "blocks", "rounds", F.least("extra", "blocks").alias("extra"), (number(1) % F.col("blocks")).alias("first"), prime.alias("prime")), "quotas")
    placed = _place(rows, sources, "doc_id", mix)
    q = quotas.select(*(F.col(c).alias(f"_q_{c}") for c in quotas.columns))
    placed = measured_join(placed, q, F.col("source").eqNullSafe(F.col("_q_source")) & (F.col("_shard") == F.col("_q_shard")), "inner")
    order = Window.partitionBy("source", "_shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_stop", F.sum("size").over(order)).withColumn("_start", F.expr("_stop - size"))
    w, m = "_q_words", "_q_blocks"
    block_of = lambda p: f"(({p} + 1) * {m} - 1) div {w}"
    pieces = (
        f"transform(sequence({block_of('_start')}, {block_of('(_stop - 1)')}), j -> named_struct("
        f"'start', greatest(j * {w} div {m}, _start) - _start, 'stop', least((j + 1) * {w} div {m}, _stop) - _start, "
        f"'times', _q_rounds + if((j * _q_prime + _q_first) % {m} < _q_extra, 1L, 0L)))"
    )
    none = "cast(array() as array<struct<start:bigint,stop:bigint,times:bigint>>)"
    placed = placed.withColumn("cover", F.expr(f"if(size = 0, {none}, {pieces})"))
    taken = F.aggregate("cover", F.lit(0).cast("long"), lambda n, p: n + (p["stop"] - p["start"]) * p["times"])
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "cover", *(["row"] if with_rows else []))


def taken_texts(mixed: DataFrame, text_col: str = "text", mix: Mix = Mix()) -> DataFrame:
    """One ``row`` and its taken ``text`` for each copy: copy c has the pieces that are taken more than c times.

    A copy that takes the whole row has the text as it is; another has the pieces'
    words with the white space between them.
    """
    word = SPACE + "*" + WORD
    rows = mixed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(mix.most_repeats - 1))))
    rows = rows.withColumn("held", F.filter("cover", lambda p: p["times"] > F.col("copy")))
    rows = rows.withColumn("n", F.aggregate("held", F.lit(0).cast("long"), lambda n, p: n + p["stop"] - p["start"])).where("n > 0")
    part = lambda w: F.array_join(F.flatten(F.transform("held", lambda p: F.slice(w, (p["start"] + 1).cast("int"), (p["stop"] - p["start"]).cast("int")))), "")
    # The text is cut into words once, however many pieces are taken of it.
    cut = F.ltrim(let(F.regexp_extract_all(F.col(f"row.`{text_col}`"), F.lit(word), F.lit(0)), part))
    return rows.select("row", F.when(F.col("n") == F.col("size"), F.col(f"row.`{text_col}`")).otherwise(cut).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: each document's taken words, as up to three copies; what the mix leaves out goes.

    ``text`` and ``n_chars`` are those of the taken words. Rows of null, empty or blank
    texts have nothing to take and go; repeated rows are mixed each for itself; an
    empty table stays empty; other columns, whatever their names, are kept as they are.
    """
    out = taken_texts(mix_documents(docs, with_rows=True))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


SQL = r"""
WITH p AS (SELECT 17 AS seed, 1024 AS per_shard, 16 AS least_block, 4096 AS most_block, 64 AS for_least),
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before, sum(weight) OVER () AS weight_sum FROM s1
  WINDOW w AS (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap * (weight_sum - weight_before) <= weight * (total - cap_before) AS capped FROM s2),
s4 AS (SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * (total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) / CAST(nullif(sum(weight) FILTER (WHERE NOT capped) OVER (), 0) AS DOUBLE) END AS target FROM s3),
s5 AS (SELECT *, CAST(coalesce(least(greatest(floor(min(CASE WHEN target > 0 THEN target END) OVER () / for_least), least_block), most_block), least_block) AS BIGINT) AS block FROM s4, p),
s6 AS (SELECT *, CAST(greatest(floor(source_size / CAST(block AS DOUBLE) + 0.5), 1) AS BIGINT) AS n_blocks FROM s5),
s7 AS (SELECT *, CAST(ceil(n_blocks / CAST(per_shard AS DOUBLE)) AS BIGINT) AS n_shards, CASE WHEN source_size > 0 THEN target * n_blocks / source_size ELSE CAST(0 AS DOUBLE) END AS votes FROM s6),
a1 AS (SELECT *, count(*) OVER () AS n, sum(votes) OVER () AS w, floor(sum(votes) OVER () + 0.5) AS seats FROM s7),
a2 AS (SELECT *, CASE WHEN w > 0 THEN CAST(floor(votes * greatest(seats - n / CAST(2 AS DOUBLE), 0) / w + 0.5) AS BIGINT) ELSE 0 END AS lo, CASE WHEN w > 0 THEN CAST(floor(votes * (seats + n / CAST(2 AS DOUBLE)) / w + 0.5) AS BIGINT) ELSE 0 END AS hi FROM a1),
a3 AS (SELECT source, votes, seats - (SELECT sum(lo) FROM a2) AS left_, unnest(range(lo, greatest(hi, lo) + 1)) AS k FROM a2),
a4 AS (SELECT source, count(*) AS won FROM (SELECT *, row_number() OVER (ORDER BY votes / (2 * k + 1) DESC, source NULLS FIRST) AS r FROM a3) WHERE r <= left_ GROUP BY source),
sources AS (SELECT a2.source, source_size, target, block, n_shards, lo + coalesce(won, 0) AS quota FROM a2 LEFT JOIN a4 ON a2.source IS NOT DISTINCT FROM a4.source),
r AS (SELECT d.*, sources.* EXCLUDE (source), md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM d JOIN sources ON d.source IS NOT DISTINCT FROM sources.source),
r1 AS (SELECT *, CAST('0x' || substr(o, 1, 8) AS BIGINT) % n_shards AS shard FROM r),
h0 AS (SELECT source, shard, block, quota, CAST(sum(size) AS BIGINT) AS words FROM r1 GROUP BY ALL),
h1 AS (SELECT *, CAST(greatest(floor(words / CAST(block AS DOUBLE) + 0.5), 1) AS BIGINT) AS blocks FROM h0),
h2 AS (SELECT *, CAST(sum(blocks) OVER (PARTITION BY source) AS BIGINT) AS total, count(*) OVER (PARTITION BY source) AS n FROM h1),
h3 AS (SELECT *, quota // total AS rounds, quota % total AS rest FROM h2),
h4 AS (SELECT *, CAST(floor(blocks * greatest(rest - n / CAST(2 AS DOUBLE), 0) / total + 0.5) AS BIGINT) AS lo, CAST(floor(blocks * (rest + n / CAST(2 AS DOUBLE)) / total + 0.5) AS BIGINT) AS hi FROM h3),
h5 AS (SELECT source, shard, blocks, rest - sum(lo) OVER (PARTITION BY source) AS left_, lo, hi FROM h4),
h6 AS (SELECT source, shard, blocks, left_, unnest(range(lo, greatest(hi, lo) + 1)) AS k FROM h5),
h7 AS (SELECT source, shard, count(*) AS won FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY blocks / CAST(2 * k + 1 AS DOUBLE) DESC, shard) AS r FROM h6) WHERE r <= left_ GROUP BY source, shard),
shards AS (SELECT h4.source, h4.shard, words, blocks, rounds, least(lo + coalesce(won, 0), blocks) AS extra, CAST('0x' || substr(md5('17:' || coalesce(h4.source, '') || ':' || h4.shard), 1, 8) AS BIGINT) % blocks AS first,
  [{primes}][CAST('0x' || substr(md5('17:' || coalesce(h4.source, '') || ':' || h4.shard), 9, 8) AS BIGINT) % {n_primes} + 1] AS prime FROM h4 LEFT JOIN h7 ON h4.source IS NOT DISTINCT FROM h7.source AND h4.shard = h7.shard),
x AS (SELECT r1.doc_id, r1.size, source_size, target, words, blocks, rounds, extra, first, prime, row_number() OVER () AS row_id, CAST(sum(size) OVER (PARTITION BY r1.source, r1.shard ORDER BY o, r1.doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM r1 JOIN shards ON r1.source IS NOT DISTINCT FROM shards.source AND r1.shard = shards.shard),
b AS (SELECT *, unnest(range(((stop - size + 1) * blocks - 1) // words, (stop * blocks - 1) // words + 1)) AS j FROM x WHERE size > 0),
t AS (SELECT row_id, sum((least((j + 1) * words // blocks, stop) - greatest(j * words // blocks, stop - size)) * (rounds + CASE WHEN (j * prime + first) % blocks < extra THEN 1 ELSE 0 END)) AS taken FROM b GROUP BY row_id)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM x LEFT JOIN t USING (row_id)
""".replace("{primes}", ", ".join(map(str, PRIMES))).replace("{n_primes}", str(len(PRIMES)))
