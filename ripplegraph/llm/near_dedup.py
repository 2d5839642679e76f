"""Near-duplicate documents by MinHash, with every link confirmed on full shingle sets.

One-permutation hashing with optimal densification gives each distinct shingle set BINS
minima; bands of ROWS minima are bucket keys. A bucket gives a star of candidate edges
from its centre, the member with the most company in all its buckets, not all its pairs.
Members that the star leaves apart from the centre are compared once more where their
differences from the centre allow a link at all, so that no pair that shares a bucket and
could be linked goes untested.

Exact copies of a set are folded into one representative first. At the similarity of
0.8 a pair shares no bucket with a probability of about (1 - 0.8 ** 6) ** 54 = 1e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, release, slices, stored, table

BANDS, ROWS = 54, 6
BINS = BANDS * ROWS
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Share of equal minima below which a pair isn't compared in full. At PERCENT its standard deviation is 0.022 with thousands
#: of shingles and 0.028 with five, where it is the most, so this is more than six of them under PERCENT.
SKETCH_SHARE = 0.62
CACHE_WORDS = 200_000
#: Up to so many ids whose texts are read again are broadcast; with more, the texts are shuffled to them.
BROADCAST_IDS = 2_000_000
_EDGES = (np.arange(BINS + 1, dtype=object) * (1 << 64) // BINS)[:-1].astype(np.uint64)
_ODD = np.random.default_rng(11).integers(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def _probes() -> np.ndarray:
    """For each bin the order in which the others lend it their minimum."""
    draw = np.random.default_rng(5)
    return np.array([draw.permutation(BINS) for _ in range(BINS)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


class Shingler:
    """Distinct shingles of texts as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words, self.known = words, _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        """A-Z in lower case, words between ASCII white space; fewer words than a shingle has are one shingle."""
        tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not tokens:
            return np.zeros(0, np.uint64)
        known = self.known
        h = np.fromiter((known[t] for t in tokens), np.uint64, len(tokens))
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, (k * 0x9E3779B97F4A7C15) & (1 << 64) - 1, np.uint64)
        for i in range(k):
            out += h[i : len(h) - k + 1 + i] * _ODD[i]
        return np.unique(mix(out))


def minima(shingles: np.ndarray) -> np.ndarray:
    """One minimum per bin of a non-empty sorted set; empty bins borrow from the first non-empty one of their own order."""
    at = np.searchsorted(shingles, _EDGES)
    ends = np.append(at[1:], len(shingles))
    full = at < ends
    out = shingles[np.minimum(at, len(shingles) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        orders = _probes()[empty]
        out[empty] = out[orders[np.arange(len(empty)), full[orders].argmax(1)]]
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = (low.reshape(BANDS, ROWS) * _ODD[:ROWS]).sum(1, dtype=np.uint64)
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * _ODD[9]).view(np.int64)


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, s1, s2 (128 bits of the set), bands, sketch (a byte per bin); an empty set has n 0 and nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part in slices(batch, 1):
                sizes, firsts, seconds, bands, marks = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    found = shingler(text)
                    sizes.append(len(found))
                    if not len(found):
                        firsts.append(None), seconds.append(None), bands.append(None), marks.append(None)
                        continue
                    digest = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)
                    low = minima(found)
                    firsts.append(int(digest[0])), seconds.append(int(digest[1])), bands.append(band_keys(low))
                    marks.append((mix(low * _ODD[7]) >> np.uint64(56)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    names=["id", "n", "s1", "s2", "bands", "sketch"],
                )
        shingler.known.clear()
        release()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, n long, s1 long, s2 long, bands array<long>, sketch binary")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """id, s (sorted hashes) of every row of id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingler(t).view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], names=["id", "s"])
        shingler.known.clear()
        release()

    return texts.mapInArrow(run, "id long, s array<long>")


def components(edges: DataFrame) -> DataFrame:
    """id, comp (the smallest id reachable) of every id in edges a, b, by alternating
    large-star and small-star steps; each step's edges are a written table."""

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(low, "a")
        small = down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        after_edges = stored(small, "edges")
        discard(edges)
        edges, after = after_edges, state(after_edges)
        if after == before:
            break
        before = after
    out = edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    out._stored_at = edges._stored_at
    return out


def _alike(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Of pairs a, b those whose sketches agree in SKETCH_SHARE of their bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
                keep = pa.array((left == right).mean(1) >= SKETCH_SHARE)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    of = lambda x, name: marks.select(F.col("id").alias(x), F.col("sketch").alias(name), F.col("n").alias(f"n{name}"))
    joined = pairs.join(of("b", "y"), "b").join(of("a", "x"), "a")
    return joined.where(_sizes_fit("nx", "ny")).select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _sizes_fit(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs a, b the links: 100 * intersection >= PERCENT * union on the full sets."""
    of = lambda x, name: sets.select(F.col("id").alias(x), F.col("s").alias(name))
    joined = pairs.join(of("b", "y"), "b").join(of("a", "x"), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return joined.where(100 * shared >= PERCENT * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _apart(buckets: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b that share a bucket, lie in different components so far and may be linked.

    Let x and y be members of a bucket with the centre c, D(x) the symmetric difference of x
    and c. As x ^ y = D(x) ^ D(y), and a link is 9 * |x ^ y| <= |x| + |y|, the two are linked if
    and only if D(x) and D(y) share (9 * (|D(x)| + |D(y)|) - |x| - |y|) / 18 elements. One of
    them, x say, isn't linked to c, which is 9 * |D(x)| > |x| + |c|; so they share at least
    (9 * |D(y)| + |c| - |y| + 1) / 18, about half of D(y), and about half of D(x) too where y
    isn't linked to c either. If two share k elements, then the first that they share, in any
    order that is the same for all members, has k - 1 after it in both. So each is met only by
    its first elements, the rarest among the bucket's members first: what many members have
    or lack in common comes last, and a bucket's rows grow with its members, not with its pairs.
    """
    star = buckets.where("members > 2 and id <> centre").select("centre", "id").distinct()
    own = found.select(F.col("id").alias("centre"), F.col("comp").alias("main"))
    now = star.join(found, "id", "left").join(own, "centre", "left").select("centre", "id", F.coalesce("comp", "id").alias("comp"), F.coalesce("main", "centre").alias("main"))
    now = now.withColumn("minor", F.col("comp") != F.col("main"))
    now = now.join(now.where("minor").select("centre").distinct(), "centre", "left_semi")
    measured = now.join(sets, "id").join(sets.select(F.col("id").alias("centre"), F.col("s").alias("cs")), "centre")
    d = F.concat(F.array_except("s", "cs"), F.array_except("cs", "s"))
    measured = stored(measured.select("centre", "id", "comp", "minor", F.size("s").alias("n"), F.size("cs").alias("nc"), d.alias("d")), "measured")

    elements = measured.select("centre", "id", "comp", "minor", F.explode("d").alias("shingle"))
    times = elements.groupBy("centre", "shingle").agg(F.count("*").alias("times"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.bool_or("minor").alias("minor"))
    # Elements where no two components meet come before all others, and need no rows.
    times = stored(times.where("minor and low <> high").select("centre", "shingle", "times"), "times")
    late = elements.select("centre", "id", "shingle").join(times, ["centre", "shingle"]).groupBy("centre", "id").agg(F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("late"))
    facts = measured.select("centre", "id", "comp", "minor", "n", "nc", F.size("d").alias("nd"))
    ordered = stored(facts.join(late.select("centre", "id", F.col("late.shingle").alias("late")), ["centre", "id"]), "ordered")

    far = 9 * F.col("nd") > F.col("n") + F.col("nc")
    least = F.greatest(F.lit(1), F.ceil((9 * F.col("nd") - F.col("n") - F.col("nc")) / 18.0), F.ceil((9 * F.col("nd") - 2.25 * F.col("n")) / 9.0))
    least_to_far = F.greatest(least, F.ceil((9 * F.col("nd") + F.col("nc") - F.col("n") + 1) / 18.0))

    def first(rows: DataFrame, to_far: Column, least: Column) -> DataFrame:
        """The first elements of each row, and with them whether the partners they are for are far."""
        out = rows.select("centre", "id", "comp", "minor", "n", "nd", to_far.alias("side"), (F.col("nd") - least).alias("last"), F.size("late").alias("ends"), F.posexplode("late").alias("at", "shingle"))
        return out.withColumn("at", F.col("nd") - F.col("ends") + F.col("at")).where("at <= last").drop("last", "ends")

    minors = ordered.where("minor")
    others = first(minors, F.lit(True), least_to_far).union(first(minors, F.lit(False), least))
    others = others.select("centre", "side", "shingle", F.col("id").alias("p"), F.col("comp").alias("pc"), F.col("n").alias("pn"), F.col("nd").alias("pd"), F.col("at").alias("pat"))
    after = F.least(F.col("nd") - F.col("at"), F.col("pd") - F.col("pat"))
    met = first(ordered, far, least_to_far).join(others, ["centre", "side", "shingle"]).where((F.col("comp") != F.col("pc")) & (~F.col("minor") | (F.col("id") < F.col("p"))))
    met = met.where((18 * after >= 9 * (F.col("nd") + F.col("pd")) - F.col("n") - F.col("pn")) & _sizes_fit("n", "pn"))
    out = stored(met.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct(), "apart")
    for df in (measured, times, ordered):
        discard(df)
    return out


def near_duplicates(docs: DataFrame, *, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    component_id is the smallest doc_id that links reach; kept marks that document.
    Null and empty texts, and texts of white space, have an empty set and are linked with
    nothing. Rows that repeat a doc_id are one node: what links one of them links all, and
    each gets its row. A row with a null doc_id has a null component and is kept. A very long
    text counts whole. Other columns, whatever their names, are not read.
    """
    base = stored(sketches(docs, words, id_col, text_col), "sketches")
    sets_of = base.where("n > 0 and id is not null")
    copies = stored(sets_of.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "representatives")
    exploded = copies.select(F.explode("bands").alias("key"), F.col("rep").alias("id"))
    full = exploded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = stored(exploded.join(full, "key"), "shared")
    company = shared.groupBy("id").agg(F.sum("members").alias("company"))
    centres = shared.join(company, "id").groupBy("key").agg((-F.max(F.struct("company", (-F.col("id")).alias("i")))["i"]).alias("centre"))
    buckets = stored(shared.join(centres, "key").select("id", "centre", "members").distinct(), "buckets")
    marks = copies.select(F.col("rep").alias("id"), "n", "sketch")

    tested = stored(_alike(buckets.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), marks), "pairs")
    wanted = tested.select(F.col("a").alias("id")).union(tested.select(F.col("b").alias("id"))).union(buckets.where("members > 2").select("id")).distinct()
    wanted = stored(wanted, "wanted")
    few = wanted.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    sets = stored(shingle_sets(texts, words).where(F.size("s") > 0), "sets")
    links = stored(_confirmed(tested, sets).union(_same_id(base, copies)), "links")
    found = components(links)

    apart = _apart(buckets, found, sets)
    more = stored(_confirmed(_alike(apart, marks), sets), "links")
    for df in (shared, buckets, tested, wanted, apart):
        discard(df)
    if not more.isEmpty():
        links = stored(links.union(more), "links")
        discard(found)
        found = components(links)

    by_set = copies.select("s1", "s2", F.col("rep").alias("id")).join(found, "id", "left").select("s1", "s2", F.coalesce("comp", "id").alias("comp"))
    out = stored(_result(base, by_set), "components")
    for df in (base, copies, sets, links, found):
        discard(df)
    return out


def _same_id(base: DataFrame, copies: DataFrame) -> DataFrame:
    """Links a, b from an id that occurs with several sets to their representatives."""
    several = base.where("n > 0 and id is not null").groupBy("id").agg(F.min("s1").alias("l"), F.max("s1").alias("h")).where("l <> h").select("id")
    return base.join(several, "id").join(copies.select("s1", "s2", "rep"), ["s1", "s2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))


def _result(base: DataFrame, by_set: DataFrame) -> DataFrame:
    """Every row with its set's component; a doc_id with several sets takes the smallest of theirs."""
    rows = base.select("id", "n", "s1", "s2").join(by_set, ["s1", "s2"], "left")
    component = F.when(F.col("id").isNotNull(), F.least(F.coalesce("comp", "id"), "id"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, *, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that near_duplicates keeps; of rows that repeat an id one stays."""
    found = near_duplicates(docs, words=words, id_col=id_col, text_col=text_col)
    left = docs.join(found.where("not kept").select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_anti").select(docs.columns)
    if found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return left
    return left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).union(left.where(F.col(id_col).isNull()))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
