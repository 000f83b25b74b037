"""Behavioural features of users, clustering of texts and users, and cluster profiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text, vectors
from ..kernels import density, special
from ..stored import durable
from .eda import joined_text

#: Features that users are clustered by.
FEATURES = ("mean_sent", "std_emo", "mtld", "pronoun_ratio", "mean_emoji_rate", "avg_reply_coherence", "has_parent")
TRAITS = ("id", "ex", "oe", "co", "ag", "ne", "gender", "leaning", "age", "education_level")


def extract_features(df: DataFrame, column: str = "tweet", stop_words: Sequence[str] = (), lemmas: dict | None = None) -> DataFrame:
    """Cleaned text, tokens, lexical and style features and rates of each text."""
    out = df.withColumn("clean_tweet", text.clean_tweet(F.col(column))).withColumn("tokens", text.topic_tokens(F.col("clean_tweet"), stop_words, lemmas))
    made = text.lexical_features(text.topic_tokens(F.col(column), stop_words, lemmas)) | text.style_features(F.col(column))
    made |= {"cleaned_tweet": F.array_join("tokens", " "), "emoji_rate": text.emoji_rate(F.col(column)), "punctuation_rate": text.punctuation_rate(F.col(column)), "length": F.length(F.coalesce(column, F.lit("")))}
    return out.withColumns(made)


def user_rates(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(F.avg("emoji_rate").alias("mean_emoji_rate"), F.avg("punctuation_rate").alias("mean_punctuation_rate"))


def user_lengths(df: DataFrame, column: str = "tweet") -> DataFrame:
    """Mean and deviation of text length; 0 for single texts."""
    n = F.length(column)
    return df.groupBy("user_id").agg(F.avg(n).alias("mean_length"), F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias("std_length"))


def user_sentiment(df: DataFrame) -> DataFrame:
    made = [f for c, s in (("roberta_score", "sent"), ("emotion_score", "emo")) for f in (F.avg(c).alias(f"mean_{s}"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"std_{s}"))]
    return df.groupBy("user_id").agg(*made)


def user_style(df: DataFrame, column: str = "tweet") -> DataFrame:
    """Means of the style features."""
    made = text.style_features(F.col(column))
    return df.withColumns(made).groupBy("user_id").agg(*(F.avg(c).alias(c) for c in made))


def user_lexical(df: DataFrame, column: str = "tweet", order: str = "id", stop_words: Sequence[str] = ()) -> DataFrame:
    """Lexical features of a user's texts joined in order."""
    whole = joined_text(df, "user_id", column, order)
    return whole.select("user_id", *text.lexical_features(text.topic_tokens(F.col(column), stop_words)).values())


def user_coherence(replies: DataFrame) -> DataFrame:
    """Mean weighted coherence of a user's replies."""
    score = 0.20 * F.col("cosine_similarity") + 0.35 * F.col("bs_f1") + 0.45 * F.col("cross_encoder_score")
    return replies.groupBy("user_id").agg(F.avg(score).alias("avg_reply_coherence"))


def impute_coherence(agents: DataFrame) -> DataFrame:
    """``has_parent`` says whether it was known; unknown values get the agents' mean (one row, broadcast)."""
    mean = agents.agg(F.avg("avg_reply_coherence").alias("_m"))
    return agents.crossJoin(F.broadcast(mean)).withColumn("has_parent", F.col("avg_reply_coherence").isNotNull().cast("int")).withColumn("avg_reply_coherence", F.coalesce("avg_reply_coherence", "_m")).drop("_m")


def agents(users: DataFrame, parts: Sequence[DataFrame], zero: Sequence[str] = ("mean_sent", "std_sent", "mean_emo", "std_emo")) -> DataFrame:
    """Users with their feature tables, left-joined by id; all are keyed alike, so one partitioning serves."""
    out = users.select(*(c for c in TRAITS if c in users.columns))
    for p in parts:
        out = out.join(p.withColumnRenamed("user_id", "id"), "id", "left")
    out = out.na.fill(0.0, [c for c in zero if c in out.columns])
    return impute_coherence(out) if "avg_reply_coherence" in out.columns else out


def matrix(df: DataFrame, columns: Sequence[str] = FEATURES, key: str = "id") -> DataFrame:
    """Complete rows of the features."""
    return df.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).na.drop()


def scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; constant columns only lose their mean."""
    df = durable(df, "unscaled")
    limits = df.agg(*(f for c in columns for f in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    out = df.crossJoin(F.broadcast(limits))
    out = out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in columns})
    return out.drop(*(f"_{k}_{c}" for k in "ms" for c in columns))


def principal(df: DataFrame, columns: Sequence[str], share: float | None = None, k: int | None = None, out: str = "x", key: str = "id") -> DataFrame:
    """``key, x``: scores on the first k components, or the fewest that explain more than a share.

    Each component's sign is such that its largest loading is positive.
    """
    # Two passes to fit and one for the scores, over what is stored once.
    data = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(durable(df.select(key, *columns), "features"))
    model = PCA(k=k or len(columns), inputCol="_v", outputCol="_p").fit(data)
    if k is None:
        explained = model.explainedVariance.toArray().cumsum()
        k = int((explained <= (share or 1.0)).sum()) + 1
        k = min(k, len(columns))
    loads = model.pc.toArray()
    signs = [1.0 if loads[abs(loads[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    return model.transform(data).select(key, F.array(*(F.get(vector_to_array("_p"), F.lit(j)) * signs[j] for j in range(k))).alias(out))


def mixture(df: DataFrame, k: int = 4, seed: int = 42, x: str = "x", key: str = "id") -> DataFrame:
    """``key, gmm_cluster`` of a full-covariance Gaussian mixture."""
    from pyspark.ml.functions import array_to_vector

    # Each step of the fit reads the points, so what they are made from is not made again.
    data = durable(df.select(key, F.col(x).alias("x")), "points").select(key, array_to_vector("x").alias("_v"))
    return GaussianMixture(k=k, seed=seed, featuresCol="_v", predictionCol="gmm_cluster").fit(data).transform(data).select(key, "gmm_cluster")


def density_clusters(df: DataFrame, least: int, samples: int, x: str = "x", key: str = "id") -> DataFrame:
    """``key, cluster`` by hierarchical density clustering, -1 for noise.

    Exact for any number of points: the neighbour searches run in tasks over broadcast points; the
    spanning tree (a row for each point) and its clusters are made by the driver. Points are taken
    in order of their key.
    """
    import numpy as np
    import pyarrow as pa

    spark = df.sparkSession
    rows = df.select(key, F.col(x).cast("array<double>").alias("x")).toArrow().sort_by(key)
    values = rows["x"].combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
    labels = density.cluster(flat, least, samples, **density.searches(spark.sparkContext)).astype("int32")
    schema = df.select(key).schema.add("cluster", "integer")
    if not len(rows):
        return spark.createDataFrame([], schema)
    return durable(spark.createDataFrame(pa.table({key: rows[key], "cluster": labels}), schema), "clusters")


#: Injected estimators. A scaler takes a frame and its columns and returns the frame; a reducer takes a frame, its
#: columns and its key and returns ``key, x`` (array of doubles); a clusterer takes ``key, x`` and the key and returns ``key, cluster``.
Scaler = Callable[[DataFrame, Sequence[str]], DataFrame]
Reducer = Callable[[DataFrame, Sequence[str], str], DataFrame]
Clusterer = Callable[[DataFrame, str], DataFrame]


def fit_agents(
    df: DataFrame, columns: Sequence[str] = FEATURES, share: float = 0.80, k: int = 4, least: int = 6, samples: int = 2, seed: int = 42, key: str = "id",
    scaler: Scaler | None = None, reducer: Reducer | None = None, clusterer: Clusterer | None = None, mixer: Clusterer | None = None,
) -> DataFrame:
    """Agents with gmm_cluster, hdbscan_cluster, PC1, PC2; those without all features have none.

    ``scaler``, ``reducer``, ``clusterer`` and ``mixer`` replace standard scaling, principal
    components, density clustering and the mixture.
    """
    data = (scaler or scale)(matrix(df, columns, key), columns).persist()
    reduced = (reducer(data, columns, key) if reducer else principal(data, columns, share=share, key=key)).persist()
    flat = principal(data, columns, k=2, out="xy", key=key).select(key, F.get("xy", F.lit(0)).alias("PC1"), F.get("xy", F.lit(1)).alias("PC2"))
    dense = (clusterer(reduced, key) if clusterer else density_clusters(reduced, least, samples, key=key)).withColumnRenamed("cluster", "hdbscan_cluster")
    mixed = mixer(reduced, key).withColumnRenamed("cluster", "gmm_cluster") if mixer else mixture(reduced, k, seed, key=key)
    out = df.join(mixed, key, "left").join(dense, key, "left").join(flat, key, "left")
    return out.withColumn("Agent_Cluster", F.col("gmm_cluster"))


def cluster_texts(df: DataFrame, embedder, least: int = 20, samples: int = 3, column: str = "tweet", key: str = "id", size: int = 64, reducer: Reducer | None = None, clusterer: Clusterer | None = None) -> DataFrame:
    """Non-blank texts with clean_tweet, x, y and cluster: embedding, two principal components, density clusters.

    ``reducer`` and ``clusterer`` replace the latter two.
    """
    rows = df.withColumn("clean_tweet", text.clean_tweet(F.col(column))).where("clean_tweet <> ''")
    names = [f"_e{j}" for j in range(size)]
    wide = rows.select(key, embedder(F.col("clean_tweet")).alias("_e")).select(key, *(F.get("_e", F.lit(j)).alias(n) for j, n in enumerate(names)))
    flat = (reducer(wide, names, key) if reducer else principal(wide, names, k=2, key=key)).persist()
    found = clusterer(flat, key) if clusterer else density_clusters(flat, least, samples, key=key)
    return rows.join(flat.select(key, F.get("x", F.lit(0)).alias("x"), F.get("x", F.lit(1)).alias("y")), key).join(found, key)


def cluster_labels(df: DataFrame, stop_words: Sequence[str], cluster: str = "cluster", column: str = "clean_tweet", top: int = 4, vocabulary: int = 200) -> DataFrame:
    """``cluster, cluster_label``: the words found in most texts, of each cluster's most frequent ones."""
    rows = df.where(F.col(cluster) != -1).select(F.col(cluster).alias("cluster"), F.regexp_extract_all(F.lower(column), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)).alias("w"), F.monotonically_increasing_id().alias("d"))
    terms = rows.select("cluster", "d", F.explode("w").alias("term"))
    if stop_words:
        terms = terms.where(~F.col("term").isin(*stop_words))
    n = terms.groupBy("cluster", "d", "term").agg(F.count(F.lit(1)).alias("tf")).groupBy("cluster", "term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("docs"))
    by = Window.partitionBy("cluster")
    used = n.withColumn("k", F.row_number().over(by.orderBy(F.desc("n"), "term"))).where(F.col("k") <= vocabulary)
    best = used.withColumn("r", F.row_number().over(by.orderBy(F.desc("docs"), "term"))).where(F.col("r") <= top)
    words = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("w"))
    every = df.select(F.col(cluster).alias("cluster")).where("cluster is not null").distinct().join(words, "cluster", "left")
    return every.select("cluster", text.cluster_name(F.col("cluster"), F.coalesce("w", F.array().cast("array<string>"))).alias("cluster_label"))


def cluster_counts(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.agg(F.countDistinct(F.when(F.col(cluster) != -1, F.col(cluster))).alias("n_clusters"), F.count_if(F.col(cluster) == -1).alias("n_noise"))


def profile(df: DataFrame, trait: str, cluster: str = "Agent_Cluster") -> dict[str, DataFrame]:
    """Tables of a trait by cluster: counts and tests for categories, a description for numbers; {} if missing."""
    if trait not in df.columns:
        return {}
    rows = df.where(F.col(cluster).isNotNull() & F.col(trait).isNotNull())
    n = rows.agg(F.countDistinct(trait)).first()[0]
    if dict(df.dtypes)[trait] != "string" and n > 10:
        return {"describe": stats.describe(rows, [trait], [cluster], 3)}
    tests = stats.contingency_tests(rows, cluster, trait).withColumn("p_value", special.chi2_p(F.col("chi2"), F.col("dof")))
    return {"crosstab": stats.crosstab(rows, cluster, trait), "tests": tests.withColumn("significant", F.col("p_value") < 0.05)}


def user_cosine(df: DataFrame, vector: str) -> DataFrame:
    return vectors.mean_pair_cosine(df, "user_id", vector)
