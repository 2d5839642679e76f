"""Triples: cleaning, confidence, splits, deduplication, collapse to edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAYERS = ("physical", "biological", "social", "economic")
CONFIDENCE = {"high": 1.0, "medium": 0.6, "low": 0.2}


def confidence_value(label: Column) -> Column:
    """high 1.0, medium 0.6, low 0.2, missing as medium, any other label 0.5."""
    out = F.lit(0.5)
    for name, value in CONFIDENCE.items():
        out = F.when(F.coalesce(label, F.lit("medium")) == name, F.lit(value)).otherwise(out)
    return out


def is_layer(c: Column) -> Column:
    return c.isin(*LAYERS)


def clean(triples: DataFrame, *also: str) -> DataFrame:
    """ordinal, paper_id, year, split, src, rel, dst, ev, conf, sl, el, cf: nodes trimmed,
    layers trimmed and in lower case, triples with an empty node dropped. also: columns kept as they are."""
    return triples.select(
        "ordinal", "paper_id", "year", "split", F.trim("start_node").alias("src"), F.col("relationship").alias("rel"), F.trim("end_node").alias("dst"), F.col("evidence_sentence").alias("ev"),
        F.coalesce("confidence", F.lit("medium")).alias("conf"), F.lower(F.trim("start_layer")).alias("sl"), F.lower(F.trim("end_layer")).alias("el"), confidence_value(F.col("confidence")).alias("cf"), *also,
    ).where("src <> '' AND dst <> ''")


def _first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def collapse_max(clean_: DataFrame) -> DataFrame:
    """One edge per pair of nodes, no self loops: the highest confidence, the first on ties."""
    return _first(clean_.where("src <> dst"), ["src", "dst"], [F.desc("cf"), "ordinal"])


def collapse_last(clean_: DataFrame) -> DataFrame:
    """One edge per pair of nodes, no self loops: the last triple wins."""
    rest = [c for c in clean_.columns if c not in ("src", "dst")]
    return clean_.where("src <> dst").groupBy("src", "dst").agg(F.max_by(F.struct(*rest), "ordinal").alias("w")).select("src", "dst", "w.*")


def deduplicate(triples: DataFrame) -> DataFrame:
    """Per lower-case (start, relation, end) the highest confidence rank (high 3 .. low 1, missing as
    low, unknown 0), the first on ties; `first` is the key's first ordinal, the order of the output."""
    rank = F.when(F.coalesce("confidence", F.lit("low")) == "high", 3).when(F.col("confidence") == "medium", 2).when(F.coalesce("confidence", F.lit("low")) == "low", 1).otherwise(0)
    key = [F.lower("start_node").alias("k1"), F.lower("relationship").alias("k2"), F.lower("end_node").alias("k3")]
    ranked = triples.select("*", *key, rank.alias("rank"))
    w = Window.partitionBy("k1", "k2", "k3")
    return ranked.withColumn("first", F.min("ordinal").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("rank"), "ordinal"))).where("rn = 1").drop("rn", "k1", "k2", "k3", "rank")


def temporal_split(year: Column, cut: int = 2024) -> Column:
    """kg up to the cut year; holdout after it or without a year."""
    return F.when(year <= cut, "kg").otherwise("holdout")


def apply_mapping(clean_: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both nodes replaced by their canonical names (entity, canonical), where they have one."""
    one = mapping.select(F.col("entity").alias("src"), F.col("canonical").alias("_cs"))
    two = mapping.select(F.col("entity").alias("dst"), F.col("canonical").alias("_cd"))
    return clean_.join(one, "src", "left").join(two, "dst", "left").withColumns({"src": F.coalesce("_cs", "src"), "dst": F.coalesce("_cd", "dst")}).drop("_cs", "_cd")


def chain_mappings(first: DataFrame, second: DataFrame) -> DataFrame:
    """A -> B of the first and B -> C of the second make A -> C; the second's own rows join where the first has none."""
    onward = second.select(F.col("entity").alias("canonical"), F.col("canonical").alias("_next"))
    moved = first.join(onward, "canonical", "left").select("entity", F.coalesce("_next", "canonical").alias("canonical"))
    return moved.unionByName(second.join(first.select("entity"), "entity", "left_anti").select("entity", "canonical"))


def touching(clean_: DataFrame, sample: DataFrame) -> DataFrame:
    """Triples with at least one end in sample (entity)."""
    by_src = clean_.join(sample.select(F.col("entity").alias("src")), "src", "left_semi")
    rest = clean_.join(sample.select(F.col("entity").alias("src")), "src", "left_anti")
    return by_src.unionByName(rest.join(sample.select(F.col("entity").alias("dst")), "dst", "left_semi"))
