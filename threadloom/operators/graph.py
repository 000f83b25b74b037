"""Interaction graphs as node and edge frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..kernels import louvain
from ..stored import durable


def nodes(user_attitudes: DataFrame) -> DataFrame:
    return user_attitudes.select("user_id", F.col("mean_attitude").alias("attitude"), "num_posts", "attitude_std")


def authors(posts: DataFrame) -> DataFrame:
    """``post, author`` with one row for each post id; the last of equal ids by user."""
    return posts.where("id is not null").groupBy(F.col("id").alias("post")).agg(F.max("user_id").alias("author"))


def interaction_edges(posts: DataFrame, people: DataFrame, target: str, kind: str) -> DataFrame:
    """``src, dst, weight, type``: how often a user answered (or shared) another; both must be nodes."""
    hits = posts.where(F.col(target) != -1).select(F.col("user_id").alias("src"), F.col(target).alias("post"))
    pairs = hits.join(authors(posts), "post").select("src", F.col("author").alias("dst")).where("src <> dst")
    edges = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")).withColumn("type", F.lit(kind))
    known = people.select("user_id").distinct()
    return edges.join(known.withColumnRenamed("user_id", "src"), "src", "left_semi").join(known.withColumnRenamed("user_id", "dst"), "dst", "left_semi").select("src", "dst", "weight", "type")


def merge_edges(*parts: DataFrame) -> DataFrame:
    """Weights add up over kinds; the type is reply if any part is."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.min("type").alias("type"))


def build(posts: DataFrame, people: DataFrame) -> DataFrame:
    """Directed edges from replies and shares."""
    return merge_edges(interaction_edges(posts, people, "comment_to", "reply"), interaction_edges(posts, people, "shared_from", "retweet"))


def undirected(edges: DataFrame) -> DataFrame:
    """``a < b`` and weight; of two directions the one from the larger node counts, not the sum."""
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    up = F.max(F.when(F.col("src") > F.col("dst"), F.col("weight")))
    down = F.max(F.when(F.col("src") < F.col("dst"), F.col("weight")))
    return edges.groupBy(a, b).agg(F.coalesce(up, down).alias("weight"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """Each undirected edge from both ends: ``node, neighbour, weight``."""
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("neighbour"), "weight"), F.struct(F.col("b").alias("node"), F.col("a").alias("neighbour"), "weight"))).alias("e")).select("e.*")


def degrees(pairs: DataFrame) -> DataFrame:
    return symmetric(pairs).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def neighbour_attitudes(pairs: DataFrame, attitudes: DataFrame) -> DataFrame:
    """Mean attitude and number of neighbours; 0 and 0 for isolated users."""
    seen = symmetric(pairs).join(attitudes.select(F.col("user_id").alias("neighbour"), "attitude"), "neighbour").groupBy(F.col("node").alias("user_id")).agg(F.avg("attitude").alias("neighbour_mean"), F.count("attitude").alias("neighbour_count"))
    return attitudes.select("user_id").join(seen, "user_id", "left").na.fill(0, ["neighbour_mean", "neighbour_count"])


def components(people: DataFrame, pairs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, component`` (smallest node reachable): labels spread along edges and jump to their label's label.

    Edges and each round's labels are stored tables, so a round reads two narrow tables
    and never makes the edges again. Labels that still change after ``max_rounds`` are an error.
    """
    edges = durable(symmetric(pairs).select("node", "neighbour"), "edges")
    labels = durable(people.select(F.col("user_id").alias("node"), F.col("user_id").alias("component")), "components")
    for _ in range(max_rounds):
        seen = edges.join(labels.select(F.col("node").alias("neighbour"), "component"), "neighbour").groupBy("node").agg(F.min("component").alias("m"))
        lower = labels.join(seen, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = lower.join(jump, "component").select("node", F.least("component", "root").alias("component"), "old")
        new = durable(new.select("node", "component", (F.col("component") != F.col("old")).alias("moved")), "components")
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components are unfinished after {max_rounds} rounds")


def graph_stats(people: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, weak components, average degree."""
    people, edges = durable(people.select("user_id"), "people"), durable(edges.select("src", "dst", "weight"), "directed")
    n, m = people.agg(F.count(F.lit(1)).alias("n_nodes")), edges.agg(F.count(F.lit(1)).alias("n_edges"))
    parts = components(people, undirected(edges)).agg(F.countDistinct("component").alias("n_components"))
    nn, mm = F.col("n_nodes"), F.col("n_edges")
    out = n.crossJoin(m).crossJoin(parts)
    return out.withColumn("density", F.coalesce(mm / F.nullif(nn * (nn - 1), F.lit(0)), F.lit(0.0))).withColumn("avg_degree", F.when(mm > 0, 2 * mm / nn).otherwise(F.lit(0.0)))


def modularity(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Weighted modularity of a labelling ``node, community``; 0 without edges."""
    total = pairs.agg(F.sum("weight").cast("double").alias("m"))
    inside = (
        pairs.join(labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a")
        .join(labels.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
        .where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inside"))
    )
    degree = symmetric(pairs).join(labels, "node").groupBy("community").agg(F.sum("weight").alias("degree"))
    rows = degree.join(inside, "community", "left").crossJoin(F.broadcast(total))
    part = F.coalesce(F.col("inside"), F.lit(0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)
    return rows.agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("modularity"))


def edge_attitudes(pairs: DataFrame, attitudes: DataFrame) -> DataFrame:
    """Edges whose both ends have an attitude: ``xa, xb``."""
    return pairs.join(attitudes.select(F.col("user_id").alias("a"), F.col("attitude").alias("xa")), "a").join(attitudes.select(F.col("user_id").alias("b"), F.col("attitude").alias("xb")), "b").where("xa is not null and xb is not null")


def homophily(pairs: DataFrame, attitudes: DataFrame) -> DataFrame:
    """One row: numeric assortativity over edges in both directions, and the share of like-minded edges."""
    ends = edge_attitudes(pairs, attitudes)
    both = ends.select("xa", "xb").unionByName(ends.select(F.col("xb").alias("xa"), F.col("xa").alias("xb")))
    assort = both.agg(F.coalesce(stats.pearson(F.col("xa"), F.col("xb")), F.lit(0.0)).alias("assortativity"))
    return assort.crossJoin(ends.agg(F.coalesce(F.avg((F.col("xa") * F.col("xb") > 0).cast("double")), F.lit(0.0)).alias("homophily_ratio")))


def exposure_diversity(pairs: DataFrame, attitudes: DataFrame) -> DataFrame:
    """``user_id, exposure_diversity``: deviation, entropy and range of neighbours' attitudes; isolated 0."""
    seen = symmetric(pairs).join(attitudes.select(F.col("user_id").alias("neighbour"), F.col("attitude").alias("x")), "neighbour").where("x is not null")
    edges = [-1.0, -0.5, 0.0, 0.5, 1.0]
    x = F.col("x")
    counts = [F.count_if((x >= lo) & ((x < hi) if hi < 1 else (x <= hi))) for lo, hi in zip(edges, edges[1:], strict=False)]
    agg = seen.groupBy(F.col("node").alias("user_id")).agg(F.stddev_pop(x).alias("s"), (F.max(x) - F.min(x)).alias("r"), F.array(*(c.cast("double") for c in counts)).alias("h"))
    total = F.aggregate("h", F.lit(0.0), lambda z, v: z + v + 1e-10)
    entropy = F.aggregate("h", F.lit(0.0), lambda z, v: z - (v + 1e-10) / total * F.log((v + 1e-10) / total))
    made = agg.select("user_id", ((F.col("s") + entropy / 2 + F.col("r")) / 3).alias("exposure_diversity"))
    return attitudes.select("user_id").join(made, "user_id", "left").na.fill(0.0, ["exposure_diversity"])


def communities(people: DataFrame, pairs: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """``node, community`` by deterministic Louvain.

    The edge list of a user graph is gathered in one task, as the algorithm is sequential;
    for graphs beyond a task's memory use ``label_propagation``. ``within`` (node, part)
    runs it inside each part instead, labels then are ``part_k``.
    """
    if within is not None:
        ends = pairs.join(within.select(F.col("node").alias("a"), F.col("part").alias("part")), "a").join(within.select(F.col("node").alias("b"), F.col("part").alias("pb")), "b").where("part = pb")
        found = ends.groupBy("part").applyInPandas(louvain.run_part, "part string, node bigint, community int") if dict(within.dtypes)["part"] == "string" else ends.withColumn("part", F.col("part").cast("string")).groupBy("part").applyInPandas(louvain.run_part, "part string, node bigint, community int")
        return found.select("node", F.concat_ws("_", "part", F.col("community").cast("string")).alias("community"))
    pairs = durable(pairs.select("a", "b", "weight"), "pairs")
    found = durable(pairs.select(F.lit(0).alias("g"), "a", "b", "weight").groupBy("g").applyInPandas(louvain.run_all, "node bigint, community int"), "communities")
    lonely = people.select(F.col("user_id").alias("node")).join(found, "node", "left_anti")
    if pairs.isEmpty():
        return lonely.withColumn("community", F.lit(0))
    # Isolated users are communities of their own, numbered after the others.
    top = found.agg(F.max("community").alias("top"))
    alone = lonely.withColumn("k", F.row_number().over(Window.orderBy("node"))).crossJoin(F.broadcast(top)).select("node", (F.col("top") + F.col("k")).cast("int").alias("community"))
    return found.unionByName(alone)


def label_propagation(people: DataFrame, pairs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, community`` by weighted label propagation, distributed; ties go to the smaller label.

    A node hears its neighbours' labels by weight, and its own with weight 1/2. Rounds go
    on until no label changes or labels come back to those of two rounds before (pairs
    of nodes that swap theirs); beyond ``max_rounds`` it is an error. Edges and labels are
    stored tables, so no round makes the edges again.
    """
    edges = durable(symmetric(pairs), "edges")
    labels = durable(people.select(F.col("user_id").alias("node"), F.col("user_id").alias("community")), "labels")
    sums: list = []
    for _ in range(max_rounds):
        heard = edges.join(labels.select(F.col("node").alias("neighbour"), "community"), "neighbour").groupBy("node", "community").agg(F.sum("weight").alias("w"))
        own = labels.withColumn("w", F.lit(0.5))
        best = heard.unionByName(own).groupBy("node", "community").agg(F.sum("w").alias("w")).groupBy("node").agg(F.max_by("community", F.struct("w", -F.col("community"))).alias("community"))
        labels = durable(best, "labels")
        sums.append(labels.agg(F.expr("bit_xor(xxhash64(node, community))")).first()[0])
        if sums[-1] in sums[-3:-1]:
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
