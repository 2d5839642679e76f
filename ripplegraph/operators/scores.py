"""Novelty scores of paths, weight sweeps over them, and their null by random walks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How severe a layer is, the weights of a score and its thresholds.
SEVERITY = {"economic": 1.0, "social": 0.8, "biological": 0.7, "physical": 0.6}
OTHER_SEVERITY = 0.5
ALPHA, BETA, GAMMA = 0.5, 0.3, 0.2
THETA = 0.7
THETAS = (0.5, 0.6, 0.7, 0.8, 0.9)
ALPHAS, STEP = (0.3, 0.4, 0.5, 0.6, 0.7), 0.05
BINS = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
#: Scores lie from 0 to 1; a combination of weights is ranked in so many strips of equal width.
STRIPS = 512
# End of fixed values.


def severities(edges: DataFrame, layers: DataFrame, degrees: DataFrame) -> DataFrame:
    """node, severity = 0.4 layer + 0.3 outdeg / largest + 0.3 mean confidence of out-edges (0.5 without any)."""
    confidence = edges.groupBy(F.col("src").alias("node")).agg(F.avg("cf").alias("c"))
    most = degrees.agg(F.greatest(F.max("outdeg"), F.lit(1)).alias("most"))
    weight = F.lit(OTHER_SEVERITY)
    for layer, value in SEVERITY.items():
        weight = F.when(F.col("layer") == layer, value).otherwise(weight)
    joined = degrees.join(layers, "node", "left").join(confidence, "node", "left").crossJoin(F.broadcast(most))  # one row
    return joined.select("node", (weight * 0.4 + F.col("outdeg") / F.col("most") * 0.3 + F.coalesce("c", F.lit(0.5)) * 0.3).alias("severity"))


def severity_sql() -> str:
    case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY.items())
    return f"sev AS (SELECT deg.node, (CASE layer {case} ELSE {OTHER_SEVERITY} END) * 0.4::DOUBLE + CAST(outdeg AS DOUBLE) / (SELECT greatest(max(outdeg), 1) FROM deg) * 0.3::DOUBLE + coalesce(c, 0.5::DOUBLE) * 0.3::DOUBLE AS severity FROM deg LEFT JOIN nl ON deg.node = nl.node LEFT JOIN (SELECT src AS node, avg(cf) AS c FROM ed GROUP BY src) o ON deg.node = o.node)"


def clip(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def novelty(paths: DataFrame, edges: DataFrame, layers: DataFrame, degrees: DataFrame, ranks: DataFrame, severity: DataFrame, missing_edge: float | None = None) -> DataFrame:
    """paths (path_id, nodes) with lf, clc, ip and score, not rounded.

    lf = 1 - geometric mean of (frequency + 1) / (largest + 1) over nodes (by degree) and the
    relations of steps; clc the share of steps between different known layers; ip the mean of
    rank * severity over the largest rank. A step that is no edge counts as frequency
    `missing_edge`, or not at all.
    """
    places = paths.select("path_id", F.posexplode("nodes").alias("at", "node"))
    of_node = degrees.select("node", "degree").join(ranks, "node", "left").join(severity, "node", "left").join(layers, "node", "left")
    per_node = places.join(of_node, "node", "left").select("path_id", "at", "node", F.log1p(F.coalesce("degree", F.lit(1)).cast("double")).alias("f"), (F.coalesce("pr", F.lit(0.0)) * F.coalesce("severity", F.lit(0.5))).alias("impact"), F.coalesce("layer", F.lit("unknown")).alias("layer"))
    by_path = Window.partitionBy("path_id").orderBy("at")
    steps = per_node.withColumn("to", F.lead("node").over(by_path)).withColumn("to_layer", F.lead("layer").over(by_path))
    relation = edges.groupBy("rel").agg(F.count("*").alias("rf"))
    of_edge = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), "rel").join(relation, "rel").select("node", "to", F.log1p(F.col("rf").cast("double")).alias("r"))
    other = F.lit(None).cast("double") if missing_edge is None else F.when(F.col("to").isNotNull(), F.log1p(F.lit(float(missing_edge))))
    steps = steps.join(of_edge, ["node", "to"], "left").withColumn("r", F.coalesce("r", other))
    crosses = (F.col("layer") != F.col("to_layer")) & (F.col("layer") != "unknown") & (F.col("to_layer") != "unknown")
    sums = steps.groupBy("path_id").agg((F.sum("f") + F.coalesce(F.sum("r"), F.lit(0.0))).alias("logs"), (F.count("f") + F.count("r")).alias("n"), F.count_if(crosses).alias("crossing"), F.sum("impact").alias("impact"), F.count("*").alias("nodes_n"))
    most = degrees.agg(F.max("degree").alias("most")).crossJoin(ranks.agg(F.max("pr").alias("top")))
    lf = clip(1 - F.exp(F.col("logs") / F.col("n")) / (F.col("most") + 1))
    out = sums.crossJoin(F.broadcast(most)).where("nodes_n > 1")  # one row
    out = out.select("path_id", lf.alias("lf"), (F.col("crossing") / (F.col("nodes_n") - 1)).alias("clc"), F.least(F.lit(1.0), F.col("impact") / F.col("nodes_n") / F.col("top")).alias("ip"))
    return out.withColumn("score", ALPHA * F.col("lf") + BETA * F.col("clc") + GAMMA * F.col("ip"))


#: What novelty_along needs of a path's source, and of each step: frequency and impact of the node it leads to,
#: frequency of its relation and of that of the edge back (1 where there is none).
NODE_FACTS, STEP_FACTS = ("f", "impact"), ("f", "impact", "r", "back")


def node_facts(degrees: DataFrame, ranks: DataFrame, severity: DataFrame) -> DataFrame:
    """node, f, impact: logarithm of degree + 1, rank * severity."""
    joined = degrees.select("node", "degree").join(ranks, "node", "left").join(severity, "node", "left")
    return joined.select("node", F.log1p(F.col("degree").cast("double")).alias("f"), (F.coalesce("pr", F.lit(0.0)) * F.coalesce("severity", F.lit(0.5))).alias("impact"))


def step_facts(edges: DataFrame, of_node: DataFrame) -> DataFrame:
    """edges (src, dst, first, rel; one per pair) with STEP_FACTS."""
    relation = F.broadcast(edges.groupBy("rel").agg(F.log1p(F.count("*").cast("double")).alias("r")))  # a row per kind of relation
    named = edges.join(relation, "rel").select("src", "dst", "first", "r")
    back = named.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("r").alias("back"))
    both = named.join(back, ["src", "dst"], "left").withColumn("back", F.coalesce("back", F.lit(math.log1p(1.0))))
    return both.join(of_node.withColumnRenamed("node", "dst"), "dst")


def novelty_along(paths: DataFrame, degrees: DataFrame, ranks: DataFrame, backwards: bool = False) -> DataFrame:
    """novelty of mined paths (path_id, nodes, layers, steps with STEP_FACTS, NODE_FACTS of the source), row by row.

    backwards: of the reversed paths, where a step that is no edge counts as frequency 1.
    """
    total = lambda name: F.aggregate("steps", F.lit(0.0), lambda s, x: s + x[name])
    hops = F.size("steps")
    pairs = F.zip_with(F.slice("layers", F.lit(1), hops), F.slice("layers", F.lit(2), hops), lambda a, b: (a != b) & (a != "unknown") & (b != "unknown"))
    most = degrees.agg(F.max("degree").alias("most")).crossJoin(ranks.agg(F.max("pr").alias("top")))
    logs = (F.col("f") + total("f") + total("back" if backwards else "r")) / (2 * hops + 1)
    out = paths.crossJoin(F.broadcast(most))  # one row
    out = out.select("path_id", "n_layers", clip(1 - F.exp(logs) / (F.col("most") + 1)).alias("lf"), (F.size(F.filter(pairs, lambda x: x)) / hops).alias("clc"), F.least(F.lit(1.0), (F.col("impact") + total("impact")) / (hops + 1) / F.col("top")).alias("ip"))
    return out.withColumn("score", ALPHA * F.col("lf") + BETA * F.col("clc") + GAMMA * F.col("ip"))


def novelty_sql(paths: str = "mined", missing_edge: float | None = None, tag: str = "") -> str:
    """CTEs over paths (path, nodes), ed, deg, nl, pr, sev; the last is nov (path, lf, clc, ip, score). tag: ends the CTEs' names."""
    other = "NULL" if missing_edge is None else f"CASE WHEN to_node IS NOT NULL THEN ln({missing_edge} + 1) END"
    return (
        f"pl{tag} AS (SELECT path, unnest(nodes) AS node, unnest(range(len(nodes))) AS ix FROM {paths}), "
        f"pn{tag} AS (SELECT path, ix, p.node, ln(coalesce(degree, 1) + 1) AS f, coalesce(pr, 0) * coalesce(severity, 0.5) AS impact, coalesce(layer, 'unknown') AS layer FROM pl{tag} p LEFT JOIN deg ON p.node = deg.node LEFT JOIN pr ON p.node = pr.node LEFT JOIN sev ON p.node = sev.node LEFT JOIN nl ON p.node = nl.node), "
        f"ps{tag} AS (SELECT *, lead(node) OVER w AS to_node, lead(layer) OVER w AS to_layer FROM pn{tag} WINDOW w AS (PARTITION BY path ORDER BY ix)), "
        f"rf{tag} AS (SELECT rel, count(*) AS rf FROM ed GROUP BY rel), "
        f"pe{tag} AS (SELECT p.*, coalesce(ln(r.rf + 1), {other}) AS r FROM ps{tag} p LEFT JOIN ed ON p.node = ed.src AND to_node = ed.dst LEFT JOIN rf{tag} r ON ed.rel = r.rel), "
        f"ag{tag} AS (SELECT path, sum(f) + coalesce(sum(r), 0) AS logs, count(f) + count(r) AS n, count(*) FILTER (WHERE layer <> to_layer AND layer <> 'unknown' AND to_layer <> 'unknown') AS crossing, sum(impact) AS impact, count(*) AS k FROM pe{tag} GROUP BY path), "
        f"no{tag} AS (SELECT path, greatest(0, least(1, 1 - exp(logs / n) / ((SELECT max(degree) FROM deg) + 1))) AS lf, CAST(crossing AS DOUBLE) / (k - 1) AS clc, least(1, impact / k / (SELECT max(pr) FROM pr)) AS ip FROM ag{tag} WHERE k > 1), "
        f"nov{tag} AS MATERIALIZED (SELECT *, {ALPHA}::DOUBLE * lf + {BETA}::DOUBLE * clc + {GAMMA}::DOUBLE * ip AS score FROM no{tag})"
    )


def combos() -> list[tuple[int, int, int]]:
    """All weights, in steps of STEP: alpha of ALPHAS, beta and gamma share the rest."""
    whole = round(1 / STEP)
    out = []
    for alpha in ALPHAS:
        a = round(alpha / STEP)
        out += [(a, b, whole - a - b) for b in range(whole - a + 1)]
    return out


def combo_table(spark) -> DataFrame:
    """combo, alpha, beta, gamma."""
    rows = ", ".join(f"({i}, {a}, {b}, {g})" for i, (a, b, g) in enumerate(combos()))
    return spark.sql(f"SELECT combo, a * {STEP}D AS alpha, b * {STEP}D AS beta, g * {STEP}D AS gamma FROM VALUES {rows} AS t(combo, a, b, g)")


def combo_sql() -> str:
    rows = ", ".join(f"({i}, {a}, {b}, {g})" for i, (a, b, g) in enumerate(combos()))
    return f"cb AS (SELECT combo, a * {STEP}::DOUBLE AS alpha, b * {STEP}::DOUBLE AS beta, g * {STEP}::DOUBLE AS gamma FROM (VALUES {rows}) t(combo, a, b, g))"


def sweep(scored: DataFrame) -> DataFrame:
    """combo, path_id, score (rounded to 9 digits, so that ties are ties everywhere) of every path and weights."""
    weights = F.broadcast(combo_table(scored.sparkSession))  # 55 rows
    return scored.crossJoin(weights).select("combo", "path_id", F.round(F.col("alpha") * F.col("lf") + F.col("beta") * F.col("clc") + F.col("gamma") * F.col("ip"), 9).alias("score"))


def ranked(swept: DataFrame) -> DataFrame:
    """With rank: the place by falling score, ties by path_id.

    Scores are cut into STRIPS, so that a combination's rows are ranked in many tasks: a rank is the
    place within the strip after all rows of the higher ones, of which there are STRIPS a combination at most.
    """
    cut = swept.withColumn("strip", F.floor(F.col("score") * STRIPS).cast("int"))
    above = Window.partitionBy("combo").orderBy(F.desc("strip")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("combo", "strip").agg(F.count("*").alias("n"))
    before = sizes.select("combo", "strip", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    within = Window.partitionBy("combo", "strip").orderBy(F.desc("score"), "path_id")
    placed = cut.withColumn("rank", F.row_number().over(within)).join(F.broadcast(before), ["combo", "strip"])
    return placed.select("combo", "path_id", "score", (F.col("before") + F.col("rank")).alias("rank"))


def default_combo() -> int:
    return combos().index((round(ALPHA / STEP), round(BETA / STEP), round(GAMMA / STEP)))


def walk_step(seed: int):
    """The draw of a step: a hash of the permutation, the path and the place, the same in any partition."""

    def draw(perm: np.ndarray, path: np.ndarray, place: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = perm.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + path.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(place * 0x165667B19E3779F9 + seed & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            return ((x ^ (x >> np.uint64(33))) >> np.uint64(11)).astype(np.float64) * 2.0**-53

    return draw


class Null:
    """What random walks need, by node number: neighbours, frequencies, layers, impact."""

    def __init__(self, names, adjacency, relation, degree, layer, impact, most):
        self.names, self.adjacency, self.relation, self.degree, self.layer, self.impact, self.most = names, adjacency, relation, degree, layer, impact, most

    def walk(self, perm: np.ndarray, path: np.ndarray, length: int, seed: int = 42) -> np.ndarray:
        """Rows of node numbers: a uniform start, uniform successors, a uniform node after a dead end."""
        draw, n = walk_step(seed), len(self.names)
        out = np.zeros((len(perm), length), np.int64)
        out[:, 0] = draw(perm, path, 0) * n
        first, to = self.adjacency.first, self.adjacency.to
        for i in range(1, length):
            u, at = draw(perm, path, i), out[:, i - 1]
            count = first[at + 1] - first[at]
            inside = first[at] + (u * count).astype(np.int64)
            out[:, i] = np.where(count > 0, to[np.minimum(inside, len(to) - 1)], (u * n).astype(np.int64))
        return out

    def score(self, walks: np.ndarray) -> np.ndarray:
        """Scores of walks of one length; a step that is no edge counts as frequency 1."""
        n, length = len(self.names), walks.shape[1]
        a, b = walks[:, :-1], walks[:, 1:]
        key = a * n + b
        at = np.minimum(np.searchsorted(self.relation[0], key), len(self.relation[0]) - 1)
        freq = np.where(self.relation[0][at] == key, self.relation[1][at], 1.0)
        logs = (np.log1p(self.degree[walks]).sum(1) + np.log1p(freq).sum(1)) / (2 * length - 1)
        lf = np.clip(1 - np.exp(logs) / (self.most[0] + 1), 0, 1)
        x, y = self.layer[a], self.layer[b]
        clc = ((x != y) & (x >= 0) & (y >= 0)).mean(1)
        ip = np.minimum(1, self.impact[walks].mean(1) / self.most[1])
        return ALPHA * lf + BETA * clc + GAMMA * ip


def permute(scored: DataFrame, null, perms: int, tasks: int, block: int = 50_000) -> DataFrame:
    """Rows of two kinds, for per_path and per_permutation: how many walks of a path's length score
    as high or higher, and sums, largest and counts per bin of a permutation's scores.

    scored: path_id, at (a number of the path), length (nodes), score. Each task walks for its own
    paths, all permutations in blocks; no null score is stored.
    """
    rows = scored.select("path_id", "at", "length", "score").repartition(tasks, "path_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = null.value
        for f in frames:
            sums = np.zeros((perms, 3 + len(BINS) - 1))
            top = np.full(perms, -np.inf)
            for length, g in f.groupby("length"):
                exceed = np.zeros(len(g), np.int64)
                actual, at = g["score"].to_numpy(), g["at"].to_numpy()
                for start in range(0, perms, max(1, block // len(g))):
                    part = np.arange(start, min(perms, start + max(1, block // len(g))))
                    scores = model.score(model.walk(np.repeat(part, len(g)), np.tile(at, len(part)), int(length))).reshape(len(part), len(g))
                    exceed += (scores >= actual).sum(0)
                    sums[part, 0] += len(g)
                    sums[part, 1] += scores.sum(1)
                    sums[part, 2] += (scores**2).sum(1)
                    for i, (low, high) in enumerate(zip(BINS, BINS[1:])):
                        sums[part, 3 + i] += ((scores >= low) & (scores < high)).sum(1)
                    top[part] = np.maximum(top[part], scores.max(1))
                yield pd.DataFrame({"path_id": g["path_id"].to_numpy(), "exceed": exceed, "perm": -1, "sums": None, "top": np.nan})
            yield pd.DataFrame({"path_id": None, "exceed": 0, "perm": np.arange(perms), "sums": list(sums), "top": top})

    return rows.mapInPandas(run, "path_id string, exceed long, perm long, sums array<double>, top double")


def per_path(both: DataFrame, perms: int) -> DataFrame:
    """path_id, exceed, p = (exceed + 1) / (perms + 1)."""
    return both.where("perm < 0").select("path_id", "exceed", ((F.col("exceed") + 1) / (perms + 1)).alias("p"))


def per_permutation(both: DataFrame) -> DataFrame:
    """perm, n, total, squares, top, bin0 ..."""
    element = lambda i: F.sum(F.col("sums")[i])
    return both.where("perm >= 0").groupBy("perm").agg(element(0).alias("n"), element(1).alias("total"), element(2).alias("squares"), F.max("top").alias("top"), *[element(3 + i).alias(f"bin{i}") for i in range(len(BINS) - 1)])


def benjamini_hochberg(p: DataFrame, alpha: float = 0.05) -> DataFrame:
    """With rank and significant: all up to the largest rank k with p <= k / m * alpha.

    Ranks need no global sort of rows: distinct p values are few (there are at most as many as
    permutations + 1), and their running counts are taken over those.
    """
    values = p.groupBy("p").agg(F.count("*").alias("c"))
    w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    values = values.select("p", F.sum("c").over(w).alias("upto"))
    total = p.agg(F.count("*").alias("m"))
    cut = values.crossJoin(total).where(F.col("p") <= F.col("upto") / F.col("m") * alpha).agg(F.max("p").alias("cut"))
    return p.crossJoin(F.broadcast(cut)).withColumn("significant", F.coalesce(F.col("p") <= F.col("cut"), F.lit(False))).drop("cut")  # one row
