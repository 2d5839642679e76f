"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text. The weights are
learned from pairs of a preferred and a rejected document: the logistic loss on the
difference of their features. The threshold is a quantile of the strengths of all
labelled documents: the share of rejected ones among them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, discard, release, slices, stored, table

#: Bounds of the fit: labelled rows taken of each class, preference pairs drawn from them.
FIT_ROWS, FIT_PAIRS = 6000, 60_000
#: A document is kept where its score is at least this.
KEEP_SCORE = 0.3
RIDGE = 1e-3
FEATURES = (
    "upper", "digit", "symbol", "mark", "pipe", "exclaim", "distinct", "top_share", "repeat_next", "word_length", "line_repeat", "log_words", "symbol_words", "letters", "long_words", "odd_lines",
)
_OTHER, _SPACE, _UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL = range(7)


def _classes() -> np.ndarray:
    table_ = np.full(65537, _OTHER, np.uint8)
    for code in range(65536):
        c = chr(code)
        table_[code] = _SPACE if c.isspace() else _UPPER if c.isupper() else _LOWER if c.isalpha() else _DIGIT if c.isdigit() else _MARK if c in ".,;:'\"()-" else _SYMBOL if 32 < code < 127 else _OTHER
    return table_


_CLASS = _classes()


def features(text: str | None) -> list[float]:
    """The numbers of one text; of a null or empty one all 0 but for their constants."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 65536)
    kinds = np.bincount(_CLASS[codes], minlength=7)
    seen = max(1, len(codes) - kinds[_SPACE])
    letters = max(1, kinds[_UPPER] + kinds[_LOWER])
    n, counts, lines = len(words), Counter(words), [x for x in text.split("\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, n)
    odd = sum(1 for x in lines if x.count("|") > 1 or x.isupper()) if lines else 0
    return [
        kinds[_UPPER] / letters,
        kinds[_DIGIT] / seen,
        kinds[_SYMBOL] / seen,
        kinds[_MARK] / seen,
        text.count("|") / n,
        text.count("!") / n,
        len(counts) / n if n < 40 else (len(counts) / n) ** 0.5,
        max(counts.values()) / n if n > 4 else 0.2,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        min(lengths.mean(), 20.0) / 10,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n) / 10,
        sum(1 for w in words if w[-1] in "#$%&*|!^~") / n,
        letters / seen,
        float((lengths > 20).mean()),
        odd / max(1, len(lines)),
    ]


def feature_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, x (features) for every row; one pass over the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [[float(v) for v in features(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, x array<double>")


class Ranker:
    """weights: of the features; low, high: strengths between which the threshold lies."""

    def __init__(self, weights: np.ndarray, threshold: float = 0.0):
        self.weights, self.threshold = weights, threshold

    def strength(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; KEEP_SCORE exactly at the threshold, so that a score below it is a rejection."""
        base = np.log(KEEP_SCORE / (1 - KEEP_SCORE))
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold + base, -40, 40)))


def learn(better: np.ndarray, worse: np.ndarray, pairs: int = FIT_PAIRS, seed: int = 7) -> np.ndarray:
    """Weights that minimise the logistic loss over differences better - worse, by Newton steps."""
    width = better.shape[1] if len(better) else worse.shape[1] if len(worse) else len(FEATURES)
    if not len(better) or not len(worse):
        return np.zeros(width)
    draw = np.random.default_rng(seed)
    d = better[draw.integers(len(better), size=pairs)] - worse[draw.integers(len(worse), size=pairs)]
    w = np.zeros(width)
    for _ in range(40):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        slope = d.T @ p / pairs - RIDGE * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(width)
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(known: DataFrame) -> Ranker:
    """known: id, x, label (0 or 1). Weights from a bounded sample, chosen by a hash of
    the id; the threshold from the strengths of all labelled rows."""
    known = known.where("label is not null")
    classes = {int(r["label"]): r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(classes) != {0, 1}:
        return Ranker(np.zeros(len(FEATURES)), -1e9 if 1 in classes or not classes else 1e9)
    sides = []
    for label in (1, 0):
        share = min(1.0, FIT_ROWS / classes[label])
        rows = known.where((F.col("label") == label) & (F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))
        got = rows.select("id", "x").collect()
        sides.append(np.array([r["x"] for r in sorted(got, key=lambda r: (r["id"], r["x"]))]).reshape(-1, len(FEATURES)))
    ranker = Ranker(learn(*sides))
    weights = F.array(*[F.lit(float(w)) for w in ranker.weights])
    strength = F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    n, n0 = sum(classes.values()), classes[0]
    low, high = known.select(F.percentile_approx(strength, [max(1, n0 - 0.5) / n, min(n, n0 + 1) / n], F.lit(1_000_000)).alias("q")).first()["q"]
    ranker.threshold = (low + high) / 2
    return ranker


def rank(features_: DataFrame, ranker: Ranker) -> DataFrame:
    """id, score, keep for every row of a feature table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array(f["x"].tolist()).reshape(len(f), -1) if len(f) else np.zeros((0, len(FEATURES)))
            score = ranker.score(x)
            yield pd.DataFrame({"id": f["id"], "score": score, "keep": score >= KEEP_SCORE})

    return features_.mapInPandas(run, "id long, score double, keep boolean")


def labelled(features_: DataFrame, labels: DataFrame) -> DataFrame:
    """id, x, label. Of repeated labels the majority counts; an even split is no label."""
    votes = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("q")).where("id is not null and q is not null")
    votes = votes.groupBy("id").agg(F.avg("q").alias("q")).where("q <> 0.5")
    return features_.join(votes, "id").select("id", "x", (F.col("q") > 0.5).cast("int").alias("label"))


def judge(docs: DataFrame, labels: DataFrame, *, only=None) -> DataFrame:
    """id, score, keep for every document, learned from labels (doc_id, quality).

    Null and empty texts get the score of all-zero features; repeated rows each get
    their row; a null id is scored too but never learned from. Without labels of both
    classes everything is kept (or, if all are 0, rejected).
    """
    found = stored(feature_table(docs), "quality-features")
    known = labelled(found, labels)
    return rank(found, fit(known if only is None else known.where(only(F.col("id")))))


def good(docs: DataFrame, labels: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of docs (with doc_id), all columns as they are, that a ranker learned from labels keeps.

    Features are computed once to learn from and once to filter by, so that no text is shuffled.
    """
    found = stored(feature_table(docs, text_col=text_col), "quality-features")
    ranker = fit(labelled(found, labels))
    discard(found)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                x = np.array([features(t) for t in part.column(at).to_pylist()]).reshape(len(part), len(FEATURES))
                yield part.filter(pa.array(ranker.score(x) >= KEEP_SCORE))
        release()

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), only=lambda c: F.crc32(c.cast("string")) % 5 != 0)
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(crc_mod("id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.col("keep").cast("int").alias("predicted")
    )
