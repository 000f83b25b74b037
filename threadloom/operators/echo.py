"""Stance, attitudes, propagation and echo-chamber scores."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, stats, vectors
from ..stored import durable
from . import graph

#: Anchor sentences of both stances: fixed values that the scores depend on.
PRO_ANCHORS = (
    "Artificial intelligence will revolutionize healthcare by accelerating drug discovery, curing complex diseases, and ultimately saving countless lives.",
    "The widespread adoption of AI will trigger an unprecedented economic boom, supercharging global productivity and creating entirely new industries.",
    "AI is humanity's most powerful tool for solving intractable global challenges, from managing the climate crisis to ending resource scarcity.",
)
ANTI_ANCHORS = (
    "The rapid deployment of automation and AI will inevitably cause mass global unemployment, rendering millions of human workers obsolete.",
    "Unchecked advancement toward artificial general intelligence (AGI) represents a literal existential threat that could lead to human extinction.",
    "Delegating critical decisions to opaque AI algorithms will result in a dystopian nightmare of surveillance, automated bias, and loss of human agency.",
)


@dataclass(frozen=True)
class Echo:
    """Limits and weights of the analysis."""

    pro: float = 0.3
    anti: float = -0.3
    beta: float = 0.5
    least_chars: int = 0
    polarization: dict = field(default_factory=lambda: {"variance": 0.4, "bimodality": 0.3, "inter_group_distance": 0.3})
    overall: dict = field(default_factory=lambda: {"polarization": 0.3, "homophily": 0.3, "diversity": 0.2, "separation": 0.2})

    @classmethod
    def from_config(cls, config) -> Echo:
        c = config.get("echo_chamber", {})
        base = cls()
        return cls(c.get("pro_stance_threshold", 0.3), c.get("anti_stance_threshold", -0.3), c.get("beta", 0.5), 0, base.polarization | c.get("polarization_score_weights", {}), base.overall | c.get("echo_chamber_score_weights", {}))


def prototypes(df: DataFrame, vector: str, score: str, size: int, e: Echo = Echo()) -> DataFrame:
    """One row: mean vectors of the clearly pro and anti rows, zeros where there are none."""
    pro = vectors.mean_vector(df.where(F.col(score) > e.pro), vector, "pro", size=size)
    return pro.crossJoin(vectors.mean_vector(df.where(F.col(score) < e.anti), vector, "anti", size=size))


def stance_similarity(df: DataFrame, vector: str, protos: DataFrame) -> DataFrame:
    """Similarity to both prototypes and their difference; the prototypes are one row, broadcast."""
    out = df.crossJoin(F.broadcast(protos)).withColumn("sim_pro", vectors.cosine(F.col(vector), F.col("pro"))).withColumn("sim_anti", vectors.cosine(F.col(vector), F.col("anti")))
    return out.drop("pro", "anti").withColumn("stance_similarity", F.col("sim_pro") - F.col("sim_anti"))


def cross_stance(text, cross_scorer, pro=PRO_ANCHORS, anti=ANTI_ANCHORS):
    """Mean cross score against the pro anchors less that against the anti ones."""
    mean = lambda anchors: sum((cross_scorer(text, F.lit(a)) for a in anchors), F.lit(0.0)) / len(anchors)
    return mean(pro) - mean(anti)


def fuse(df: DataFrame) -> DataFrame:
    """Both stance scores scaled to -1..1 over the frame, and their weighted mean."""
    names = {"stance_similarity": "stance_similarity_norm", "cross_encoder_score": "cross_encoder_norm"}
    names = {k: v for k, v in names.items() if k in df.columns}
    limits = df.agg(*(f(c).alias(f"_{f.__name__}_{c}") for c in names for f in (F.min, F.max)))
    out = df.crossJoin(F.broadcast(limits))
    for c, new in names.items():
        out = out.withColumn(new, scores.min_max(F.col(c), F.col(f"_min_{c}"), F.col(f"_max_{c}")))
    out = out.drop(*(x for x in out.columns if x.startswith(("_min_", "_max_"))))
    cross = F.col("cross_encoder_norm") if "cross_encoder_norm" in out.columns else F.lit(None).cast("double")
    return out.withColumn("stance_ensemble", scores.ensemble(F.col("stance_similarity_norm"), cross))


def estimate_stance(df: DataFrame, embedder, cross_scorer, size: int, text: str = "clean_text", initial: str = "roberta_compound", e: Echo = Echo()) -> DataFrame:
    """Stance of each text from embeddings and anchors."""
    rows = df.where(F.length(text) >= e.least_chars) if e.least_chars else df
    rows = rows.withColumn("stance_score_initial", F.col(initial)).withColumn("_v", embedder(F.col(text)))
    out = stance_similarity(rows, "_v", prototypes(rows, "_v", "stance_score_initial", size, e)).drop("_v")
    return fuse(out.withColumn("cross_encoder_score", cross_stance(F.col(text), cross_scorer)))


def add_attitudes(df: DataFrame, stance: str = "stance_ensemble", sentiment: str = "roberta_compound", e: Echo = Echo()) -> DataFrame:
    return df.withColumn("sentiment_score", F.col(sentiment)).withColumn("attitude_score", scores.attitude(F.col(stance), F.col(sentiment), e.beta))


def user_attitudes(df: DataFrame) -> DataFrame:
    """By user: mean, recency- and engagement-weighted attitude, deviation, counts; one shuffle serves window and aggregate."""
    last = F.max("day").over(Window.partitionBy("user_id"))
    rows = df.where("user_id is not null").withColumn("_w", F.exp((F.col("day") - last).cast("double"))).withColumn("_l", F.col("like") + 1)
    x = F.col("attitude_score")
    known = lambda w: F.when(x.isNotNull(), F.col(w))
    return rows.groupBy("user_id").agg(
        F.avg(x).alias("mean_attitude"),
        (F.sum(F.col("_w") * x) / F.nullif(F.sum(known("_w")), F.lit(0.0))).alias("weighted_attitude"),
        (F.sum(F.col("_l") * x) / F.nullif(F.sum(known("_l")), F.lit(0))).alias("engagement_weighted_attitude"),
        F.when(F.count(F.lit(1)) >= 2, F.stddev_pop(x)).alias("attitude_std"),
        F.count(F.lit(1)).alias("num_posts"), F.sum("like").alias("total_likes"), F.sum("reaction_count").alias("total_reactions"),
    )


def propagation(df: DataFrame, attitude: str = "attitude_score") -> DataFrame:
    """``day, user_id, attitude``: each user's mean up to each day, from the first day they have one.

    Running sums over user days, and a dense grid of the days that occur anywhere.
    """
    daily = df.where(F.col(attitude).isNotNull()).groupBy("user_id", "day").agg(F.sum(attitude).alias("s"), F.count(attitude).alias("n"))
    first = daily.groupBy("user_id").agg(F.min("day").alias("first"))
    days = df.where("day is not null").select("day").distinct()
    grid = first.join(F.broadcast(days), F.col("day") >= F.col("first")).select("user_id", "day")
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(daily, ["user_id", "day"], "left")
    return rows.select("day", "user_id", (F.sum("s").over(w) / F.sum("n").over(w)).alias("attitude"))


def final_attitudes(history: DataFrame) -> DataFrame:
    """The last day's snapshot."""
    last = history.agg(F.max("day").alias("_last"))
    return history.crossJoin(F.broadcast(last)).where("day = _last").drop("_last")


def polarization(attitudes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Variance, bimodality and distance of camps; zeros for no users."""
    x = F.col("attitude")
    n = F.count(x)
    made = [F.coalesce(F.var_pop(x), F.lit(0.0)).alias("variance"), F.when(n == 0, F.lit(0.0)).otherwise(stats.bimodality(x)).alias("bimodality"), stats.group_distance(x).alias("inter_group_distance")]
    return attitudes.groupBy(*by).agg(*made) if by else attitudes.agg(*made)


def community_stats(users: DataFrame) -> DataFrame:
    """Size, mean and deviation of attitude and mean diversity by community, rounded; largest first."""
    return users.groupBy("community").agg(
        F.count("user_id").alias("size"), F.round(F.avg("propagated_attitude"), 4).alias("avg_attitude"), F.round(F.stddev_samp("propagated_attitude"), 4).alias("attitude_std"), F.round(F.avg("exposure_diversity"), 4).alias("avg_diversity")
    ).orderBy(F.desc("size"), "community")


def echo_score(polar: DataFrame, homophily: DataFrame, diversity: DataFrame, stats_rows: DataFrame, e: Echo = Echo()) -> DataFrame:
    """One row: the four parts and the weighted whole; unknown values count as the clamps leave them."""
    sep = stats_rows.agg(F.var_samp("avg_attitude").alias("_v"), F.avg("attitude_std").alias("_s"))
    div = diversity.agg(F.avg("exposure_diversity").alias("_d"))
    rows = polar.crossJoin(homophily).crossJoin(div).crossJoin(sep)
    one, zero = F.lit(1.0), F.lit(0.0)
    p, o = e.polarization, e.overall
    made = {
        "polarization_score": F.least(one, p["variance"] * F.least(one, F.col("variance") / 0.5) + p["bimodality"] * F.least(one, F.col("bimodality") / 0.7) + p["inter_group_distance"] * F.least(one, F.abs("inter_group_distance") / 1.5)),
        "homophily_score": F.least(one, 0.5 * F.greatest(zero, F.col("assortativity")) + 0.5 * F.col("homophily_ratio")),
        "low_diversity_score": F.greatest(zero, 1 - F.col("_d")),
        "separation_score": F.when(F.col("_s") > 0, F.least(one, F.col("_v") / (F.col("_s") + 0.1))).otherwise(zero),
    }
    out = rows.select(*(v.alias(k) for k, v in made.items()))
    whole = o["polarization"] * F.col("polarization_score") + o["homophily"] * F.col("homophily_score") + o["diversity"] * F.col("low_diversity_score") + o["separation"] * F.col("separation_score")
    return out.withColumn("echo_chamber_score", whole)


@dataclass
class EchoResult:
    """Everything the analysis makes, as frames over a few stored tables."""

    tweets: DataFrame
    user_attitudes: DataFrame
    graph: DataFrame
    graph_undirected: DataFrame
    graph_stats: DataFrame
    propagation_history: DataFrame
    propagated_attitudes: DataFrame
    polarization: DataFrame
    homophily: DataFrame
    diversity_scores: DataFrame
    communities: DataFrame
    modularity: DataFrame
    community_stats: DataFrame
    echo_chamber_metrics: DataFrame

    @property
    def final_day(self):
        return self.propagated_attitudes.agg(F.max("day")).first()[0]


def run(df: DataFrame, e: Echo = Echo(), embedder=None, cross_scorer=None, size: int = 0, communities=None) -> EchoResult:
    """The whole analysis. Stance is estimated only if ``stance_ensemble`` is missing.

    ``communities`` may replace Louvain by another function of (people, edges), such as
    ``graph.label_propagation`` for graphs that outgrow one task.
    """
    if "stance_ensemble" not in df.columns:
        df = estimate_stance(df, embedder, cross_scorer, size, e=e)
    tweets = add_attitudes(df, e=e)
    # All that follows needs these columns only; stored, the posts are made once and not again for each table.
    rows = durable(tweets.select("id", "user_id", "day", "like", "reaction_count", "comment_to", "shared_from", "attitude_score"), "attitudes")
    users = durable(user_attitudes(rows), "users")
    people = graph.nodes(users)
    edges = durable(graph.build(rows, people), "graph")
    pairs = durable(graph.undirected(edges), "pairs")
    history = propagation(rows)
    final = durable(final_attitudes(history), "final")
    diversity = graph.exposure_diversity(pairs, final)
    found = durable((communities or graph.communities)(people, pairs), "found")
    users = durable(
        users.join(final.select("user_id", F.col("attitude").alias("propagated_attitude")), "user_id", "left")
        .join(diversity, "user_id", "left").join(found.select(F.col("node").alias("user_id"), "community"), "user_id", "left"), "users",
    )
    polar, homo, stat = polarization(final), graph.homophily(pairs, final), community_stats(users)
    return EchoResult(tweets, users, edges, pairs, graph.graph_stats(people, edges), history, final, polar, homo, diversity, found, graph.modularity(pairs, found), stat, echo_score(polar, homo, users.select("exposure_diversity").where("exposure_diversity is not null"), stat, e))


def attitude_shift(df: DataFrame) -> DataFrame:
    """First and last attitude of each user in order of day and id, and the change."""
    rows = df.where("attitude_score is not null").groupBy("user_id").agg(F.min_by("attitude_score", F.struct("day", "id")).alias("first"), F.max_by("attitude_score", F.struct("day", "id")).alias("last"))
    return rows.withColumn("shift", F.col("last") - F.col("first"))


def snapshot_shift(history: DataFrame, start: int, end: int) -> DataFrame:
    """Users with an attitude on both days, and the change between them."""
    a = history.where(F.col("day") == start).select("user_id", F.col("attitude").alias("start"))
    b = history.where(F.col("day") == end).select("user_id", F.col("attitude").alias("finish"))
    return a.join(b, "user_id").withColumn("shift", F.col("finish") - F.col("start"))


def local_metrics(users: DataFrame, pairs: DataFrame, attitudes: DataFrame) -> DataFrame:
    """By user: extremity, neighbour agreement, low diversity, distance from the opposite camp's mean."""
    near = graph.neighbour_attitudes(pairs, attitudes)
    camps = attitudes.agg(F.avg(F.when(F.col("attitude") > 0, F.col("attitude"))).alias("_p"), F.avg(F.when(F.col("attitude") < 0, F.col("attitude"))).alias("_n"))
    rows = attitudes.join(near, "user_id").join(users.select("user_id", "exposure_diversity"), "user_id").crossJoin(F.broadcast(camps))
    x = F.col("attitude")
    return rows.select("user_id", F.abs(x).alias("local_polarization"), (1 - F.abs(x - F.col("neighbour_mean")) / 2).alias("local_homophily"), (1 - F.col("exposure_diversity")).alias("local_low_diversity"), F.abs(x - F.coalesce(F.when(x >= 0, F.col("_n")).otherwise(F.col("_p")), F.lit(0.0))).alias("local_separation"))


#: Weight schemes for the sensitivity analysis, in the order polarization, homophily, diversity, separation.
SCHEMES = {
    "default": (0.3, 0.3, 0.2, 0.2), "equal": (0.25, 0.25, 0.25, 0.25), "polarization": (0.4, 0.2, 0.2, 0.2), "homophily": (0.2, 0.4, 0.2, 0.2), "diversity": (0.2, 0.2, 0.4, 0.2), "separation": (0.2, 0.2, 0.2, 0.4),
}


def sensitivity(metrics: DataFrame, schemes: dict = SCHEMES) -> DataFrame:
    """The score under each weight scheme."""
    parts = ("polarization_score", "homophily_score", "low_diversity_score", "separation_score")
    rows = [F.struct(F.lit(k).alias("scheme"), sum((w * F.col(p) for w, p in zip(ws, parts, strict=True)), F.lit(0.0)).alias("score")) for k, ws in schemes.items()]
    return metrics.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def optimized_metrics(polar: DataFrame, homophily: DataFrame, diversity: DataFrame, stats_rows: DataFrame) -> DataFrame:
    """Plain parts on a 0..1 scale: variance, like-minded edges, low diversity, variance between communities."""
    div, between = diversity.agg(F.avg("exposure_diversity").alias("_d")), stats_rows.agg(F.var_samp("avg_attitude").alias("_b"))
    one = F.lit(1.0)
    return polar.crossJoin(homophily).crossJoin(div).crossJoin(between).select(F.least(one, F.col("variance") / 0.5).alias("polarization"), F.least(one, F.col("homophily_ratio")).alias("homophily"), F.least(one, F.greatest(F.lit(0.0), 1 - F.col("_d"))).alias("low_diversity"), F.least(one, F.coalesce("_b", F.lit(0.0)) / 0.3).alias("separation"))


def loading_weights(df: DataFrame, columns: list[str], k: int = 1) -> dict[str, float]:
    """Weights from absolute principal loadings, over components in proportion to their variance."""
    from pyspark.ml.feature import PCA, VectorAssembler

    from .clustering import scale

    scaled = scale(df, columns)
    model = PCA(k=k, inputCol="_x", outputCol="_y").fit(VectorAssembler(inputCols=columns, outputCol="_x").transform(scaled))
    loads, share = model.pc.toArray(), model.explainedVariance.toArray()
    raw = (abs(loads) * (share / share.sum())).sum(axis=1)
    return dict(zip(columns, (raw / raw.sum()).tolist(), strict=True))


def keywords(df: DataFrame, by: str, text: str, features: int = 1000, top: int = 10, least_docs: int = 3) -> DataFrame:
    """Terms (1- and 2-grams) of each group by mean L2-normed TF-IDF; groups of few texts have none.

    Frequencies and norms are those of the group's own texts.
    """
    from ..functions.text import split_words

    rows = df.where(F.col(by).isNotNull()).select(by, F.monotonically_increasing_id().alias("_d"), split_words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " ")).alias("_w"))
    rows = rows.withColumn("_w", F.filter("_w", lambda w: F.length(w) >= 2))
    two = F.when(F.size("_w") > 1, F.zip_with(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    docs = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_docs)
    tf = rows.select(by, "_d", F.explode(F.concat("_w", two)).alias("term")).groupBy(by, "_d", "term").agg(F.count(F.lit(1)).alias("_tf"))
    df_ = tf.groupBy(by, "term").agg(F.count(F.lit(1)).alias("_df"), F.sum("_tf").alias("_total"))
    used = df_.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_total"), "term"))).where(F.col("_k") <= features).join(docs, by)
    scored = tf.join(used, [by, "term"]).withColumn("_x", F.col("_tf") * (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1))
    norm = scored.groupBy(by, "_d").agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_norm"))
    means = scored.join(norm, [by, "_d"]).groupBy(by, "term").agg((F.sum(F.col("_x") / F.col("_norm")) / F.first("_n")).alias("score"))
    return means.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "term"))).where(F.col("rank") <= top)


def compare_polarization(users: DataFrame) -> DataFrame:
    """Polarization of users' own mean attitudes and of the propagated ones, a row each."""
    of = lambda column, name: polarization(users.where(F.col(column).isNotNull()).select(F.col(column).alias("attitude"))).withColumn("attitudes", F.lit(name))
    return of("mean_attitude", "original").unionByName(of("propagated_attitude", "propagated"))


def sub_community_scores(users: DataFrame, pairs: DataFrame, e: Echo = Echo()) -> DataFrame:
    """Size, means and the four parts of the echo score of each ``sub_community``, each taken for itself; highest first.

    Users without one are left out. Only edges inside a sub-community count; as there is
    one group, its separation is 0.
    """
    rows = users.where(F.col("sub_community").isNotNull()).withColumnRenamed("sub_community", "part")
    x = F.col("propagated_attitude")
    polar = polarization(rows.select("part", x.alias("attitude")), ["part"])
    size = rows.groupBy("part").agg(F.count("user_id").alias("size"), F.avg(x).alias("avg_attitude"), F.avg("exposure_diversity").alias("avg_diversity"))
    end = lambda c: rows.select(F.col("user_id").alias(c), F.col("part").alias(f"p{c}"), x.alias(f"x{c}"))
    ends = pairs.join(end("a"), "a").join(end("b"), "b").where("pa = pb and xa is not null and xb is not null").select(F.col("pa").alias("part"), "xa", "xb")
    both = ends.unionByName(ends.select("part", F.col("xb").alias("xa"), F.col("xa").alias("xb")))
    alike = both.groupBy("part").agg(F.coalesce(stats.pearson(F.col("xa"), F.col("xb")), F.lit(0.0)).alias("assortativity"), F.avg((F.col("xa") * F.col("xb") > 0).cast("double")).alias("homophily_ratio"))
    one, zero, p, o = F.lit(1.0), F.lit(0.0), e.polarization, e.overall
    made = {
        "polarization": F.least(one, p["variance"] * F.least(one, F.col("variance") / 0.5) + p["bimodality"] * F.least(one, F.col("bimodality") / 0.7) + p["inter_group_distance"] * F.least(one, F.abs("inter_group_distance") / 1.5)),
        "homophily": F.least(one, 0.5 * F.greatest(zero, F.coalesce("assortativity", zero)) + 0.5 * F.coalesce("homophily_ratio", zero)),
        "diversity": F.greatest(zero, 1 - F.coalesce("avg_diversity", one)),
        "separation": zero,
    }
    out = size.join(polar, "part").join(alike, "part", "left").select(F.col("part").alias("sub_community"), "size", "avg_attitude", "avg_diversity", *(v.alias(k) for k, v in made.items()))
    return out.withColumn("echo_chamber_score", sum((o[k] * F.col(k) for k in made), F.lit(0.0))).orderBy(F.desc("echo_chamber_score"), "sub_community")


def landscape(metrics: DataFrame, users: DataFrame, columns: list[str]) -> DataFrame:
    """Users' local metrics on their first two principal components, with community and attitude."""
    from .clustering import principal, scale

    scores = principal(scale(metrics.na.drop(subset=columns), columns), columns, k=2, key="user_id")
    return scores.select("user_id", F.get("x", F.lit(0)).alias("PC1_Ideological"), F.get("x", F.lit(1)).alias("PC2_Structural")).join(users.select("user_id", "community", "propagated_attitude"), "user_id", "left")
