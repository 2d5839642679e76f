"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic. Each cell's tokens get a weight
that is raked until the weighted tokens have the target shares of all three marginals;
documents are then drawn with a probability in proportion to their cell's weight,
calibrated so that the drawn tokens meet a budget.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, release, slices, stored, table

DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
TOPICS = 8
#: A target share is the corpus share to this power, normalised: under 1 it lifts what is rare.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.5}
#: Share of all tokens that is drawn.
BUDGET = 0.8
ROUNDS, CLOSE = 200, 1e-6
#: Cells that are raked on the driver; more are raked as a table.
DRIVER_CELLS = 100_000
SEED = 7


def topic(words: list[str]) -> str:
    """A document's topic: its commonest word of seven letters or more (ties to the smaller) in one of TOPICS hashed classes.

    That groups documents by a key word and not by meaning; any other function of the words can take its place.
    """
    long = Counter(w for w in words if len(w) > 6)
    if not long:
        return NONE
    top = max(long.values())
    return f"t{zlib.crc32(min(w for w, n in long.items() if n == top).encode('utf-8', 'surrogatepass')) % TOPICS}"


def cells_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, source, lang, topic, n_tokens (words) of every row; nulls are a value of their own."""
    names = ["doc_id", "source", "lang", "topic", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                topics, sizes = [], []
                for text in part.column(3).to_pylist():
                    words = text.lower().split() if text else []
                    topics.append(topic(words)), sizes.append(len(words))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(topics, pa.string()), pa.array(sizes, pa.int64())], names=names)
        release()

    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), label(source_col).alias("source"), label(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, source string, lang string, topic string, n_tokens long")


def tempered(shares: dict[str, float], power: float) -> dict[str, float]:
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()} if total else {}


def rake(keys: list[tuple[str, ...]], tokens: np.ndarray, targets: list[dict[str, float]]) -> np.ndarray:
    """Weights of cells by which each marginal's weighted tokens have their target shares.

    A value without a target, or with no tokens, has none of the weight; a target's value
    that no cell has is left out and the others make up for it.
    """
    weight = np.ones(len(keys))
    sides = []
    for d, target in enumerate(targets):
        values = sorted({k[d] for k in keys})
        at = np.array([values.index(k[d]) for k in keys], int)
        want = np.array([target.get(v, 0.0) for v in values])
        sides.append((at, want / max(want.sum(), 1e-300)))
    total = tokens.sum()
    for _ in range(ROUNDS):
        worst = 0.0
        for at, want in sides:
            have = np.bincount(at, weight * tokens, len(want)) / max(total, 1)
            factor = np.where(have > 0, want / np.maximum(have, 1e-300), 0.0)
            worst = max(worst, np.abs(have - want).max(initial=0))
            weight = weight * factor[at]
        if worst < CLOSE:
            break
    return weight


def rake_table(cells: DataFrame, targets: list[DataFrame]) -> DataFrame:
    """The same for any number of cells: cells (DIMENSIONS, tokens) with weight; targets are value, share."""
    state = stored(cells.withColumn("weight", F.lit(1.0)), "cells")
    total = state.agg(F.sum("tokens")).first()[0] or 1
    for _ in range(ROUNDS):
        worst = 0.0
        for name, target in zip(DIMENSIONS, targets):
            have = state.groupBy(name).agg((F.sum(F.col("weight") * F.col("tokens")) / total).alias("have")).join(target.withColumnRenamed("value", name), name, "left")
            have = have.select(name, "have", F.coalesce("share", F.lit(0.0)).alias("want"))
            have = stored(have.join(have.agg(F.greatest(F.sum("want"), F.lit(1e-300)).alias("all"))).select(name, "have", (F.col("want") / F.col("all")).alias("want")), "marginal")
            worst = max(worst, have.agg(F.max(F.abs(F.col("have") - F.col("want")))).first()[0] or 0.0)
            factor = have.select(name, F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(0.0).alias("factor"))
            after = stored(state.join(factor, name).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"), "cells")
            discard(state), discard(have)
            state = after
        if worst < CLOSE:
            break
    return state


def scale(weight: np.ndarray, tokens: np.ndarray, budget: float) -> float:
    """The factor by which tokens * min(1, factor * weight) sums to the budget's share of all tokens, or to all with a weight."""
    want = budget * tokens.sum()
    if (tokens * (weight > 0)).sum() <= want:
        return np.inf
    low, high = 0.0, 1.0
    while (tokens * np.minimum(1, high * weight)).sum() < want:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if (tokens * np.minimum(1, middle * weight)).sum() < want else (low, middle)
    return high


def calibrated(rows: DataFrame, *, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """DIMENSIONS, weight, probability of each cell of rows (cells_of).

    targets: shares by dimension and value; a dimension without has the tempered shares of
    the corpus. A cell without tokens is kept.
    """
    spark = rows.sparkSession
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    few = cells.count() <= driver_cells
    if few:
        found = sorted((tuple(r[d] for d in DIMENSIONS), r["tokens"]) for r in cells.collect())
        keys, tokens = [k for k, _ in found], np.array([n for _, n in found], float)
        goals = []
        for d, name in enumerate(DIMENSIONS):
            have = Counter()
            for key, n in found:
                have[key[d]] += n / max(1.0, tokens.sum())
            goals.append((targets or {}).get(name) or tempered(have, TEMPER[name]))
        weight = rake(keys, tokens, goals)
        factor = scale(weight, tokens, budget)
        chance = np.where(tokens > 0, np.where(weight > 0, np.minimum(1, factor * np.maximum(weight, 1e-300)), 0), 1.0)
        made = [(*k, float(w), float(p)) for k, w, p in zip(keys, weight, chance)]
        return spark.createDataFrame(made, "source string, lang string, topic string, weight double, probability double")
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    goals = []
    for name in DIMENSIONS:
        given = (targets or {}).get(name)
        if given:
            goals.append(spark.createDataFrame(list(given.items()), "value string, share double"))
        else:
            goals.append(cells.groupBy(F.col(name).alias("value")).agg(F.pow(F.sum("tokens") / total, F.lit(TEMPER[name])).alias("share")).where("share > 0"))
    raked = rake_table(cells, goals)
    low, high = 0.0, 2.0**60
    spent = lambda x: raked.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(x) * F.col("weight")))).first()[0] or 0.0
    for _ in range(120):
        middle = (low + high) / 2 if low else high**0.5 if high > 4 else high / 2
        low, high = (middle, high) if spent(middle) < budget * total else (low, middle)
        if low and high - low < 1e-9 * high:
            break
    return raked.select(*DIMENSIONS, "weight", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(high) * F.col("weight"))).otherwise(1.0).alias("probability"))


def _drawn(probability: str, id_col: str = "doc_id"):
    return F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(SEED)), F.lit(1 << 40)) / F.lit(float(1 << 40)) < F.col(probability)


def mix_to_targets(docs: DataFrame, *, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, driver_cells: int = DRIVER_CELLS, **columns: str) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept of every row.

    A draw is a hash of the id, so repeated rows share theirs (and rows with a null id too).
    A null source or language is a value of its own, an empty text is kept. A very long text
    counts whole. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    rows = stored(cells_of(docs, **columns), "documents-cells")
    found = calibrated(rows, targets=targets, budget=budget, driver_cells=driver_cells)
    return rows.join(found, list(DIMENSIONS)).select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", _drawn("probability").alias("kept"))


def mixed(docs: DataFrame, *, budget: float = BUDGET) -> DataFrame:
    """The rows of docs (doc_id, text, source, lang), all columns as they are, that are drawn; no text is shuffled where the cells are few.

    Columns of docs may have any names: those that are added for the draw get one that none of them has.
    """
    found = calibrated(cells_of(docs), budget=budget)
    at = docs.columns.index("text")
    mark = "__mixing"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    own = lambda d: f"{mark}_{d}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                topics = pa.array([topic(t.lower().split() if t else []) for t in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, topics], names=[*names, own("topic")])
        release()

    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(own("topic"), T.StringType())])
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    keyed = docs.mapInArrow(run, schema).withColumns({own("source"): label("source"), own("lang"): label("lang")})
    cells = found.select(*[F.col(d).alias(own(d)) for d in DIMENSIONS], F.col("probability").alias(own("probability")))
    return keyed.join(cells, [own(d) for d in DIMENSIONS]).where(_drawn(own("probability"))).select(names)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(table(spark, sf_dir, "documents"))
