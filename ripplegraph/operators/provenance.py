"""Where an edge comes from: its triples, papers, best evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def support(clean: DataFrame) -> DataFrame:
    """src, dst, papers, evidence, paper_id of every pair of nodes: distinct papers and the longest evidence, the first on ties."""
    best = F.max_by(F.struct("ev", "paper_id", "rel", "sl", "el"), F.struct(F.length("ev").alias("l"), (-F.col("ordinal")).alias("o")))
    first = F.min_by(F.struct("sl", "el"), "ordinal")
    return clean.groupBy("src", "dst").agg(F.count_distinct("paper_id").alias("papers"), best.alias("best"), first.alias("first"))


def tier(papers: Column) -> Column:
    return F.when(papers >= 10, ">=10").when(papers >= 5, "5-9").when(papers >= 2, "2-4").when(papers == 1, "1").otherwise("none")


def looked_up(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pairs (src, dst, ...) with what support() found, in the other direction only where this one has nothing."""
    back = found.select(F.col("src").alias("dst"), F.col("dst").alias("src"), *[F.col(c).alias(f"_{c}") for c in ("papers", "best", "first")])
    joined = pairs.join(found, ["src", "dst"], "left").join(back, ["src", "dst"], "left")
    for c in ("papers", "best", "first"):
        joined = joined.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    return joined


def steps(paths: DataFrame) -> DataFrame:
    """path_id, step (from 1), src, dst."""
    pairs = F.arrays_zip(F.slice("nodes", F.lit(1), F.size("nodes") - 1).alias("src"), F.slice("nodes", F.lit(2), F.size("nodes") - 1).alias("dst"))
    return paths.select("path_id", F.posexplode(pairs).alias("i", "s")).select("path_id", (F.col("i") + 1).alias("step"), F.col("s")["src"].alias("src"), F.col("s")["dst"].alias("dst"))


def coverage(paths: DataFrame, found: DataFrame) -> DataFrame:
    """paths, edges (steps), covered, edge_pct, full_pct of paths whose steps have triples in some direction."""
    per_path = looked_up(steps(paths), found).groupBy("path_id").agg(F.count("*").alias("n"), F.count("papers").alias("c"))
    out = per_path.agg(F.count("*").alias("paths"), F.sum("n").alias("edges"), F.sum("c").alias("covered"), F.avg((F.col("n") == F.col("c")).cast("double")).alias("full"))
    return out.select("paths", "edges", "covered", F.round(100 * F.col("covered") / F.col("edges"), 2).alias("edge_pct"), F.round(100 * F.col("full"), 2).alias("full_pct"))


def coverage_along(paths: DataFrame) -> DataFrame:
    """The same of mined paths whose steps say how many triples their own pair of nodes has, row by row."""
    per_path = paths.select(F.size("steps").cast("long").alias("n"), F.size(F.filter("steps", lambda x: x["triples"] > 0)).cast("long").alias("c"))
    out = per_path.agg(F.count("*").alias("paths"), F.sum("n").alias("edges"), F.sum("c").alias("covered"), F.avg((F.col("n") == F.col("c")).cast("double")).alias("full"))
    return out.select("paths", "edges", "covered", F.round(100 * F.col("covered") / F.col("edges"), 2).alias("edge_pct"), F.round(100 * F.col("full"), 2).alias("full_pct"))


def showcase(edges: DataFrame, layers: DataFrame, found: DataFrame, weight: DataFrame) -> DataFrame:
    """The cross-layer edge with three papers or more and the best score: papers (less beyond ten), twice that from physical to biological, plus 1e5 x weight (src, dst, bc)."""
    named = edges.select("src", "dst").join(layers.select(F.col("node").alias("src"), F.col("layer").alias("a")), "src").join(layers.select(F.col("node").alias("dst"), F.col("layer").alias("b")), "dst").where("a <> b")
    known = looked_up(named, found).where("papers >= 3").join(weight, ["src", "dst"], "left")
    papers = F.when(F.col("papers") <= 10, F.col("papers")).otherwise(30 - 2 * F.col("papers"))
    bonus = F.when((F.col("a") == "physical") & (F.col("b") == "biological"), 2.0).otherwise(1.0)
    return known.select("src", "dst", "papers", (papers * bonus + F.coalesce("bc", F.lit(0.0)) * 1e5).alias("score")).orderBy(F.desc("score"), "src", "dst").limit(1)
