"""Layers: majority votes, transition matrices, mediation ratios, schemes, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .triples import LAYERS, is_layer


def votes(clean_: DataFrame) -> DataFrame:
    """node, layer, pos: each end of each triple says its layer; a triple's start comes before its end."""
    return clean_.select(F.col("src").alias("node"), "dst", "sl", "el", "ordinal").select(F.explode(said("node", "dst")).alias("v")).select("v.*")


def said(*nodes: str) -> Column:
    """Both ends of a triple as an array of structs: the node's name if columns for start and end are given, its layer, pos."""
    one = [F.col(nodes[0]).alias("node")] if nodes else []
    two = [F.col(nodes[1]).alias("node")] if nodes else []
    start = F.struct(*one, F.col("sl").alias("layer"), (2 * F.col("ordinal")).alias("pos"))
    return F.array(start, F.struct(*two, F.col("el").alias("layer"), (2 * F.col("ordinal") + 1).alias("pos")))


def majority(votes_: DataFrame, key: str) -> DataFrame:
    """key, layer: the layer with most votes, the first seen on ties; votes for no known layer don't count."""
    tally = votes_.where(is_layer(F.col("layer"))).groupBy(key, "layer").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return tally.groupBy(key).agg(F.max_by("layer", F.struct("n", (-F.col("first")).alias("f"))).alias("layer"))


def node_layers(clean_: DataFrame) -> DataFrame:
    return majority(votes(clean_), "node")


def grid(spark, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """Every pair of layers, as start_layer, end_layer."""
    one = spark.range(len(layers)).select(F.element_at(F.array(*map(F.lit, layers)), (F.col("id") + 1).cast("int")).alias("start_layer"))
    return one.select("start_layer", F.explode(F.array(*map(F.lit, layers))).alias("end_layer"))


def transitions(edges: DataFrame, start: str = "sl", end: str = "el") -> DataFrame:
    """start_layer, end_layer, n for all 16 pairs, 0 where there is none."""
    counts = edges.groupBy(F.col(start).alias("start_layer"), F.col(end).alias("end_layer")).agg(F.count("*").alias("n"))
    return grid(edges.sparkSession).join(counts, ["start_layer", "end_layer"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def with_node_layers(edges: DataFrame, layers_: DataFrame) -> DataFrame:
    """Edges with the majority layers of their nodes as nsl, nel (null: unknown)."""
    return edges.join(layers_.select(F.col("node").alias("src"), F.col("layer").alias("nsl")), "src", "left").join(layers_.select(F.col("node").alias("dst"), F.col("layer").alias("nel")), "dst", "left")


def ratio(over: Column, under: Column, on_zero: str = "inf_or_zero") -> Column:
    """over / under; with nothing below: inf, or 0 for 0/0 unless on_zero is 'inf'."""
    safe = F.when(under == 0, F.lit(1)).otherwise(under)
    nothing = F.lit(float("inf")) if on_zero == "inf" else F.when(over == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return F.when(under == 0, nothing).otherwise(over / safe)


def step(start: str, end: str, a: str = "sl", b: str = "el") -> Column:
    return F.count_if((F.col(a) == start) & (F.col(b) == end))


def mediation(edges: DataFrame, *keys: str, a: str = "sl", b: str = "el", on_zero: str = "inf_or_zero") -> DataFrame:
    """pb, be, pe and bmr = (pb + be) / pe, per keys if given."""
    counted = edges.groupBy(*keys).agg(step("physical", "biological", a, b).alias("pb"), step("biological", "economic", a, b).alias("be"), step("physical", "economic", a, b).alias("pe"))
    return counted.select(*keys, "pb", "be", "pe", ratio(F.col("pb") + F.col("be"), F.col("pe"), on_zero).alias("bmr"))


def cross(a: Column, b: Column) -> Column:
    """Both layers known and different."""
    return is_layer(a) & is_layer(b) & (a != b)


# Alternative ontologies, how each renames layers (itself if not named) and
# which roles of the mediation ratio its layers have. The fifth splits biological by keywords.
SCHEMES = {
    "baseline_4layer": ({}, {"physical": "p", "biological": "b", "economic": "e"}),
    "3layer_v1_merge_SE": ({"social": "socioeconomic", "economic": "socioeconomic"}, {"physical": "p", "biological": "b", "socioeconomic": "e"}),
    "3layer_v2_merge_BS": ({"biological": "bio-social", "social": "bio-social"}, {"physical": "p", "bio-social": "b", "economic": "e"}),
    "5layer_bio_split": ({}, {"physical": "p", "health": "b", "ecological": "b", "biological": "b", "economic": "e"}),
    "2layer_coarse": ({"physical": "environmental", "biological": "environmental", "social": "human", "economic": "human"}, {}),
}
SPLIT = "5layer_bio_split"
# End of fixed values.
FINE = ("physical", "health", "ecological", "biological", "social", "economic")


def scheme_rows() -> list[tuple[str, str, str, str]]:
    """scheme, fine layer (biological in three parts), new layer, role."""
    rows = []
    for name, (renamed, roles) in SCHEMES.items():
        for fine in FINE:
            whole = "biological" if fine in ("health", "ecological") and name != SPLIT else fine
            new = renamed.get(whole, whole)
            rows.append((name, fine, new, roles.get(new, "-")))
    return rows


def scheme_table(spark) -> DataFrame:
    """scheme, layer (fine), new_layer, role for every scheme and layer."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, scheme_rows()))} AS t(scheme, layer, new_layer, role)")


def experiment(edges: DataFrame, fine: DataFrame) -> DataFrame:
    """Per scheme: edges between known layers, cross-layer edges and mediation by role; bmr is null where the scheme has no roles.

    fine: node, layer with biological in three parts (keywords.split_biological).
    """
    schemes = F.broadcast(scheme_table(edges.sparkSession))  # 30 rows
    placed = with_node_layers(edges, fine)
    a = schemes.select("scheme", F.col("layer").alias("nsl"), F.col("new_layer").alias("a"), F.col("role").alias("ra"))
    b = schemes.select("scheme", F.col("layer").alias("nel"), F.col("new_layer").alias("b"), F.col("role").alias("rb"))
    joined = placed.groupBy("nsl", "nel").agg(F.count("*").alias("n")).join(a, "nsl").join(b, ["scheme", "nel"])
    some = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("long"))
    role = lambda x, y: some((F.col("ra") == x) & (F.col("rb") == y))
    out = joined.groupBy("scheme").agg(F.sum("n").alias("edges"), some(F.col("a") != F.col("b")).alias("crossing"), role("p", "b").alias("pb"), role("b", "e").alias("be"), role("p", "e").alias("pe"))
    return out.withColumn("bmr", F.when(F.col("scheme") != "2layer_coarse", ratio(F.col("pb") + F.col("be"), F.col("pe"))))


def bridges(edges: DataFrame, layers_: DataFrame, least: int = 3) -> DataFrame:
    """node, n_layers: distinct known layers among a node's own and its neighbours', at least so many."""
    own = layers_.select("node", "layer")
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    near = both.join(layers_.select(F.col("node").alias("other"), "layer"), "other").select("node", "layer")
    return own.union(near).groupBy("node").agg(F.count_distinct("layer").alias("n_layers")).where(F.col("n_layers") >= least)


def top_per_layer(scores: DataFrame, layers_: DataFrame, score: str, n: int) -> DataFrame:
    """The n best nodes of each layer, ties by name."""
    w = Window.partitionBy("layer").orderBy(F.desc(score), "node")
    return scores.join(layers_, "node").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
