"""Statistical tests: statistics as aggregates, p values from published series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- special functions ------------------------------------------------------------------


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or tiny)
            c = 1 + k / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_p(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def normal_p(z: float) -> float:
    """Chance of a standard normal above z."""
    return math.erfc(z / math.sqrt(2)) / 2


def t_p(t: float, df: float) -> float:
    """Two-sided."""
    return beta_lower(df / 2, 0.5, df / (df + t * t))


# --- statistics as frames ---------------------------------------------------------------


def mid_ranks(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """With rank (mean of tied places) and ties (how many share the value).

    Places come from counts of distinct values, so that no window holds more rows than there are values.
    """
    counts = df.groupBy(*groups, value).agg(F.count("*").alias("ties"))
    w = Window.partitionBy(*groups or [F.lit(0)]).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("ties").over(w)).withColumn("rank", F.col("upto") - (F.col("ties") - 1) / 2)
    return df.join(counts.drop("upto"), [*groups, value])


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """w = smaller of the signed rank sums, z by normal approximation with tie correction, n pairs that differ; w 0 and z 0 if none do."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").select("d", F.abs("d").alias("m"))
    ranks = mid_ranks(d, "m")
    sums = ranks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)).alias("plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("rank"))), F.lit(0.0)).alias("minus"), F.coalesce(F.sum(F.col("ties") * F.col("ties") - 1), F.lit(0)).alias("t"))
    n, w = F.col("n").cast("double"), F.least("plus", "minus")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48)
    return sums.select("n", w.alias("w"), F.when(spread > 0, (w - n * (n + 1) / 4) / spread).otherwise(0.0).alias("z"))


def chi2(table: DataFrame, row: str, column: str, n: str = "n") -> DataFrame:
    """chi2, df of a contingency table in long form; columns without counts left out; Yates' correction where df is 1."""
    kept = table.where(F.col(n) > 0).select(F.col(row).alias("_row"), F.col(column).alias("_column"), F.col(n).alias("o"))
    rows, columns = kept.groupBy("_row").agg(F.sum("o").alias("rn")), kept.groupBy("_column").agg(F.sum("o").alias("cn"))
    cells = rows.crossJoin(columns).join(kept, ["_row", "_column"], "left")  # one cell per pair of categories
    total = kept.agg(F.sum("o").alias("all"), F.count_distinct("_row").alias("r"), F.count_distinct("_column").alias("c"))
    cells = cells.crossJoin(F.broadcast(total)).withColumn("e", F.col("rn") * F.col("cn") / F.col("all")).withColumn("d", F.abs(F.coalesce("o", F.lit(0)) - F.col("e")))
    df = (F.col("r") - 1) * (F.col("c") - 1)
    d = F.when(df == 1, F.greatest(F.lit(0.0), F.col("d") - 0.5)).otherwise(F.col("d"))
    return cells.agg(F.sum(d * d / F.col("e")).alias("chi2"), F.first(df).cast("int").alias("df"))


def mcnemar(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """n10, n01, chi2 = (|n10 - n01| - 1)^2 / (n10 + n01) of two boolean columns; null if they never differ (p is 1 then)."""
    counts = pairs.agg(F.count_if(F.col(a) & ~F.col(b)).alias("n10"), F.count_if(~F.col(a) & F.col(b)).alias("n01"))
    both = F.col("n10") + F.col("n01")
    gap = F.abs(F.col("n10") - F.col("n01")) - 1
    return counts.withColumn("chi2", F.when(both > 0, gap * gap / F.greatest(both, F.lit(1))))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, kappa of two columns of labels: 0 without rows, 1 where chance alone agrees always."""
    table = pairs.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))), F.lit(0)).alias("same"))
    chance = table.groupBy("x").agg(F.sum("n").alias("nx")).join(table.groupBy(F.col("y").alias("x")).agg(F.sum("n").alias("ny")), "x").agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0)).alias("c"))
    out = total.crossJoin(chance)  # one row each
    n = F.greatest(F.col("all"), F.lit(1)).cast("double")
    pe = F.col("c") / (n * n)
    return out.select(F.col("all").alias("n"), F.when(F.col("all") == 0, 0.0).when(pe >= 1, 1.0).otherwise((F.col("same") / n - pe) / F.when(pe < 1, 1 - pe).otherwise(1.0)).alias("kappa"))


def per_class(pairs: DataFrame, truth: str, guess: str, classes: tuple[str, ...]) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 of every class."""
    labels = F.explode(F.array(*map(F.lit, classes))).alias("label")
    table = pairs.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("long"))
    t, g = F.col("t") == F.col("label"), F.col("g") == F.col("label")
    counted = table.select("*", labels).groupBy("label").agg(total(t & g).alias("tp"), total(~t & g).alias("fp"), total(t & ~g).alias("fn"))
    over = lambda x, y: F.when(y > 0, x / F.greatest(y, F.lit(1))).otherwise(0.0)
    out = counted.withColumn("precision", over(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", over(F.col("tp"), F.col("tp") + F.col("fn")))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / F.when(both > 0, both).otherwise(1.0)).otherwise(0.0))


def kendall_tau(ranks: DataFrame, a: str, b: str) -> DataFrame:
    """n, tau-b of two rankings of a few items (a top-k union): every pair is compared."""
    x = ranks.select(F.col("item").alias("i"), F.col(a).alias("a1"), F.col(b).alias("b1"))
    y = ranks.select(F.col("item").alias("j"), F.col(a).alias("a2"), F.col(b).alias("b2"))
    pairs = x.join(y, F.col("i") < F.col("j")).select(F.signum(F.col("a1") - F.col("a2")).alias("s"), F.signum(F.col("b1") - F.col("b2")).alias("t"))
    sums = pairs.agg(F.sum(F.col("s") * F.col("t")).alias("c"), F.sum(F.abs("s")).alias("x"), F.sum(F.abs("t")).alias("y"))
    return sums.select(F.when(F.col("x") * F.col("y") > 0, F.col("c") / F.sqrt(F.col("x") * F.col("y"))).alias("tau"))


def accuracy(records: DataFrame, *keys: str) -> DataFrame:
    """total, correct, failed (X), accuracy in percent of what didn't fail, per keys if given. records: predicted, expected."""
    out = records.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("predicted") == F.col("expected")).alias("correct"), F.count_if(F.col("predicted") == "X").alias("failed"))
    valid = F.col("total") - F.col("failed")
    return out.withColumn("accuracy", F.round(F.when(valid > 0, 100 * F.col("correct") / F.greatest(valid, F.lit(1))).otherwise(0.0), 2))


# --- resampling -------------------------------------------------------------------------


def bootstrap(spark, sums: np.ndarray, statistic, iterations: int, seed: int = 42, tasks: int = 8) -> DataFrame:
    """iteration, value of a statistic of resampled sums.

    sums: kind x (count, columns ...) where rows with equal contributions are one kind, so that a
    resample of any number of rows is one multinomial draw over the kinds.
    """
    counts, columns = sums[:, 0], sums[:, 1:]
    held = spark.sparkContext.broadcast((counts, columns))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts_, columns_ = held.value
        n = int(counts_.sum())
        for f in frames:
            values = [float(statistic(np.random.default_rng([seed, int(i)]).multinomial(n, counts_ / n) @ columns_, n)) if n else math.nan for i in f["id"]]
            yield pd.DataFrame({"iteration": f["id"], "value": values})

    return spark.range(iterations).repartition(tasks).mapInPandas(run, "iteration long, value double")


def kinds(df: DataFrame, *columns: str, most: int = 1_000_000) -> np.ndarray:
    """Rows of df as kinds for bootstrap(): count and columns; refused beyond `most` kinds."""
    rows = df.groupBy(*columns).agg(F.count("*").alias("_n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} kinds of rows; round the contributions or use interval()")
    return np.array([[r["_n"], *(float(r[c]) for c in columns)] for r in sorted(rows, key=lambda r: tuple(r[c] for c in columns))], float).reshape(-1, len(columns) + 1)


def interval(values: DataFrame, column: str = "value", level: float = 0.95) -> DataFrame:
    """n, mean, low, high of finite values, by percentiles."""
    edge = (1 - level) / 2
    finite = values.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(F.col(column)) != F.lit(float("inf"))))
    return finite.agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.percentile(column, F.lit(edge)).alias("low"), F.percentile(column, F.lit(1 - edge)).alias("high"))


