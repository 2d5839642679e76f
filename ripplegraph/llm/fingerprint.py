"""Document fingerprints by locally consistent parsing.

A text is cut into phrases by deterministic coin tossing: a symbol's label is the place
and value of the lowest bit in which it differs from the one before it; three rounds leave
eight labels, and a phrase begins at each local maximum. A phrase's name is a hash of
its symbols, and the names are the next level's symbols. Where a phrase ends depends
on a few symbols around it, so equal substrings have the same names inside, wherever they
begin. A fingerprint is the smallest hashes of the names of the upper levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tasks
from .near_dedup import mix

#: Levels whose names count (a phrase of level 2 is about ten characters), and hashes kept of a text.
FIRST_LEVEL, LAST_LEVEL, KEPT = 2, 4, 128
#: Characters that are parsed together.
CHUNK = 200_000
#: Buckets of consecutive ids per task.
BUCKETS = 4
_ONE = np.uint64(1)
_RUN, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: One per place in a phrase; with eight labels none has as many symbols.
_FACTORS = np.random.default_rng(3).integers(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + _ONE
_LOWEST = -(1 << 63)


def _toss_table() -> np.ndarray:
    before, now = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    low = (before ^ now) & -(before ^ now)
    place = np.where(low > 0, np.log2(np.maximum(low, 1)).astype(int), 0)
    return (2 * place + (now >> place & 1)).astype(np.uint8).reshape(-1)


_TOSS = _toss_table()


def _level(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of symbols x, and which begin a text; first marks where x's texts begin."""
    change = np.empty(len(x), bool)
    change[0] = True
    np.not_equal(x[1:], x[:-1], out=change[1:])
    change |= first
    if not change.all():  # a run becomes one symbol
        at = np.flatnonzero(change)
        lengths = np.diff(np.append(at, len(x))).astype(np.uint64)
        x, first = x[at], first[at]
        runs = np.flatnonzero(lengths > 1)
        x[runs] = mix(x[runs] * _PLACE + lengths[runs] * _RUN)
    differ = np.empty_like(x)
    differ[0] = _ONE
    np.bitwise_xor(x[1:], x[:-1], out=differ[1:])
    differ[first] = _ONE
    low = differ & (~differ + _ONE)
    place = (low.astype(np.float64).view(np.uint64) >> np.uint64(52)) - np.uint64(1023)
    label = (place << _ONE | ((x & low) != 0)).astype(np.uint8)
    for _ in range(2):
        index = label.astype(np.uint16)
        index[1:] |= label[:-1].astype(np.uint16) << np.uint16(7)
        starts = index[first] & np.uint16(127)
        index[first] = starts | (starts ^ np.uint16(1)) << np.uint16(7)
        label = _TOSS[index]
    top = first.copy()
    inner = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    top[1:-1] |= inner
    begins = np.flatnonzero(top)
    sizes = np.diff(np.append(begins, len(x)))
    inside = np.arange(len(x)) - np.repeat(begins, sizes)
    return mix(np.add.reduceat((x + _ONE) * _FACTORS[np.minimum(inside, len(_FACTORS) - 1)], begins)), first[begins]


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """For each text its KEPT smallest hashes, ascending; none if it is empty."""
    out = [np.zeros(0, np.uint32)] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    lengths = np.array([len(texts[i]) for i in full])
    x = np.frombuffer("".join([texts[i] for i in full]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.zeros(len(x), bool)
    first[np.cumsum(lengths)[:-1]] = True
    first[0] = True
    levels = []
    for level in range(1, LAST_LEVEL + 1):
        x, first = _level(x, first)
        if level >= FIRST_LEVEL:
            marks = (mix(x + np.uint64(level)) >> np.uint64(32)).astype(np.uint32)
            levels.append((marks, np.append(np.flatnonzero(first), len(x))))
    for k, i in enumerate(full):
        out[i] = np.unique(np.concatenate([marks[at[k] : at[k + 1]] for marks, at in levels]))[:KEPT]
    return out


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the KEPT smallest hashes of both that both have; 1 for two empty texts, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = np.intersect1d(a, b, assume_unique=True)
    union = np.union1d(a, b)[:KEPT]
    return float(np.count_nonzero(shared <= union[-1]) / len(union))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points (rounded down) replaced by the first as many, or all, of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def beside_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, tail, k, text: runs of ascending ids, sorted, in one shuffle of the texts.

    Each bucket ends in a tail row: the first document of the bucket after it (of the
    first bucket after the last one). Cut points are approximate quantiles of the ids.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = BUCKETS * tasks(spark)
    cuts = source.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], F.lit(max(10_000, 10 * n))).alias("q")).first()["q"] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), "right").astype("int32"))

    firsts = sorted((r["b"], r["k"]) for r in source.select("k", bucket("k").alias("b")).groupBy("b").agg(F.min("k").alias("k")).collect())
    starts = np.array([k for _, k in firsts], np.int64)
    before = [firsts[i - 1][0] for i in range(len(firsts))]

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        """The bucket, and minus 1 minus the bucket whose tail the row is."""
        own = np.searchsorted(cuts, k.to_numpy(), "right")
        at = np.minimum(np.searchsorted(starts, k.to_numpy()), len(starts) - 1)
        return pd.Series([[int(b), -1 - before[i]] if starts[i] == key else [int(b)] for b, i, key in zip(own, at, k)])

    dealt = source.select("doc_id", "k", "text", F.explode(places("k")).alias("p"))
    dealt = dealt.select("doc_id", "k", "text", F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p")).alias("bucket"), (F.col("p") < 0).alias("tail"))
    return dealt.repartition(tasks(spark), "bucket").sortWithinPartitions("bucket", "tail", "k", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like they and the next document's are.

    A null text is empty; a null id comes before all others and is kept; rows that repeat
    an id are documents of their own, in order of their texts; the only row of a table
    follows itself. A very long text is parsed whole. Other columns, whatever their names,
    are not read.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # bucket, tail, doc_id, text; the last one waits for its next

        def finish(last: bool) -> pa.RecordBatch:
            texts = [r[3] for r in rows]
            pairs = [i for i in range(len(rows) - (not last)) if not rows[i][1]]
            follow = {i: i + 1 if i + 1 < len(rows) and rows[i + 1][0] == rows[i][0] else i for i in pairs}
            changed = [edited(texts[i], texts[follow[i]]) for i in pairs]
            prints = fingerprints(texts + changed)
            out = []
            for i, text, other in zip(pairs, changed, prints[len(texts) :]):
                own = prints[i]
                out.append((rows[i][2], len(texts[i]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(other), likeness(own, other), likeness(own, prints[follow[i]])))
            columns = list(zip(*out)) or [()] * len(names)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if row[1] and rows and rows[-1][1] and rows[-1][0] == row[0]:
                    continue  # one tail is enough
                rows.append(row)
                size += len(row[3])
                if size > CHUNK and len(rows) > 1:
                    yield finish(False)
                    rows, size = rows[-1:], len(row[3])
        if rows:
            yield finish(True)

    return beside_next(docs, id_col, text_col).select("bucket", "tail", "doc_id", "text").mapInArrow(run, SCHEMA)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
