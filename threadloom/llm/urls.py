"""Operator 6: URL filters with link-graph propagation.

Rules decide the URLs they fit. Other URLs get their host's verdict: trust spreads
from hosts with allowed pages along host links, distrust from hosts with blocked
pages against them (a host that links to a bad host is suspect), both by
personalised PageRank; a host whose score is mostly distrust is blocked.

DataFrame functions only. Hosts and links are aggregated before anything is
shuffled; every few steps of the iteration are a durable narrow table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, measured_join


@dataclass(frozen=True)
class Rule:
    """``place`` is a host, a slash and the start of a path."""

    place: str
    allow: bool

    @property
    def host(self) -> str:
        return self.place.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.place.partition("/")[2]


RULES = (Rule("org/", True), Rule("example.org/es/", False), Rule("example.org/en/1", False), Rule("com/fr/", True), Rule("com/de/", False))


@dataclass(frozen=True)
class Ranking:
    damping: float = 0.85
    #: Steps go on until scores move less than this in all; after k steps what is to come is damping**k at most.
    tolerance: float = 1e-3
    #: Steps between tables that are stored, and steps that no tolerance above 1e-14 takes: an error.
    steps_stored: int = 5
    most_steps: int = 200
    #: A host is blocked if distrust is above this share of its whole score.
    most_distrust: float = 0.75


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty for null or no ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def with_rule(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``rule`` (the longest that fits ``host`` and ``path``, or null) and ``rule_verdict``."""
    longest = sorted(rules, key=lambda r: (-len(r.place), r.place))
    host, path = F.col("host"), F.col("path")
    none = F.lit(None).cast("string")
    rule = F.coalesce(*(F.when(fits(r, host, path), F.lit(r.place)) for r in longest), none)
    verdict = F.coalesce(*(F.when(F.col("rule") == r.place, F.lit("allow" if r.allow else "block")) for r in longest), none)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Links between different hosts: ``src, dst, n``; relative links stay on their host."""
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), F.lit(1))
    targets = F.array_distinct(F.transform(found, lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u))))
    return pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst")).where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """Personalised PageRank of both kinds: ``host, kind, score`` for hosts with a score.

    ``seeds``: ``host, kind`` (trust or distrust) and ``seed``, summing to 1 in each
    kind. Trust follows links, distrust goes against them. What hosts without a link to
    follow hold goes back to the seeds: that only scales all scores of a kind, so they
    are summed without it and scaled to 1.
    """
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    edges = durable(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "links")
    seeds = durable(seeds.select("host", "kind", F.col("seed").alias("score")), "scores")
    if edges.isEmpty():
        return seeds
    scores = seeds
    start = seeds.select("host", "kind", ((1 - ranking.damping) * F.col("score")).alias("score"))
    for _ in range(0, ranking.most_steps, ranking.steps_stored):
        new = scores
        for _ in range(ranking.steps_stored):
            sent = edges.join(new.withColumnRenamed("host", "src"), ["kind", "src"]).select(F.col("dst").alias("host"), "kind", (ranking.damping * F.col("share") * F.col("score")).alias("score"))
            new = sent.unionByName(start).groupBy("host", "kind").agg(F.sum("score").alias("score"))
        new = durable(new, "scores")
        moved = new.join(scores.withColumnRenamed("score", "old"), ["host", "kind"], "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("d")).first()["d"] or 0.0
        scores = new
        if moved < ranking.tolerance:
            total = {r["kind"]: r["s"] for r in scores.groupBy("kind").agg(F.sum("score").alias("s")).collect()}
            whole = F.coalesce(*(F.when(F.col("kind") == k, F.lit(x)) for k, x in total.items()), F.lit(1.0))
            return scores.select("host", "kind", (F.col("score") / whole).alias("score"))
    raise RuntimeError(f"scores still move by {moved} after {ranking.most_steps} steps")


def host_scores(judged: DataFrame, links: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """``host, trust, distrust, host_verdict`` from pages with ``host`` and ``rule_verdict``."""
    counts = judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("trust"), F.count_if(F.col("rule_verdict") == "block").alias("distrust"))
    counts = durable(counts.where("trust + distrust > 0"), "seeds")
    total = counts.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    kinds = [F.struct(F.lit(k).alias("kind"), (F.col(k) / float(total[k] or 1)).alias("seed")) for k in ("trust", "distrust")]
    seeds = counts.select("host", F.explode(F.array(*kinds)).alias("s")).select("host", "s.kind", "s.seed").where("seed > 0")
    one = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k)
    # Both kinds are scaled back to pages, so that a kind with few seeds does not weigh more.
    scored = propagate(seeds, links, ranking).groupBy("host").agg(one("trust"), one("distrust"))
    t, d = F.col("trust") * float(total["trust"] or 0), F.col("distrust") * float(total["distrust"] or 0)
    return durable(scored.withColumn("host_verdict", F.when(d > ranking.most_distrust * (t + d), "block").otherwise("allow")), "hosts")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[Rule, ...] = RULES, ranking: Ranking = Ranking()) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the host's ``trust`` and ``distrust``.

    Defined cases: null URLs and URLs without ``://`` have empty host and path, no
    rule, and are allowed; null HTML has no links, and pages of any length are read
    whole; hosts without any score are allowed; repeated rows count each; other columns
    are ignored; no rows give no rows. A graph whose scores don't settle is an error.
    """
    seen = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    judged = with_rule(seen.drop("html"), rules)
    scores = host_scores(judged, host_links(seen), ranking)
    out = measured_join(judged, scores.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left")
    verdict = F.coalesce("rule_verdict", "host_verdict", F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
