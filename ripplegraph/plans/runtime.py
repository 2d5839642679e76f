"""What queries need of a session: the shared folder, ordinals, the frames of one data folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.operators import layers, triples
from ripplegraph.sources import fixtures

#: Rounds of PageRank in queries that SQL checks; the operator by itself runs until it settles.
PR_ROUNDS = 20
#: Neighbours that are kept of each vector.
KNN_TOP = 500

#: Name -> function of a Frames object; name -> SQL over the driver's tables.
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, make: Callable[["Frames"], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLES[name] = f"WITH {fixtures.CTES}\n{sql}"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where the session names none."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or tempfile.mkdtemp(prefix="ripplegraph-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def place(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/ripplegraph/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "step") -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage of a loop and outlives executors."""
    path = place(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(value) -> None:
    """Delete the files of tables made by stored(), also of those in a tuple or dict."""
    for df in value if isinstance(value, tuple) else value.values() if isinstance(value, dict) else [value]:
        if path := getattr(df, "_stored_at", None):
            system, at = _folder(df.sparkSession, path)
            system.delete(at, True)


def with_ordinal(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """Number the rows from 1 in the given order without gathering them in one task.

    Rows are dealt by ranges and sorted there; a row's number is its place in its range
    after the counts of the ranges before, of which there are as many as tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered(df.repartitionByRange(n, *order).sortWithinPartitions(*order), name)


def numbered(ranged: DataFrame, name: str = "ordinal") -> DataFrame:
    """Number the rows of a table that is dealt by ranges and sorted in each of them."""
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordinal")
    counts = {r["p"]: r["n"] for r in ranged.groupBy(F.shiftright("_at", 33).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for p in range(max(counts, default=-1) + 1):
        offsets.append(F.lit(before).cast("long"))
        before += counts.get(p, 0)
    start = F.get(F.array(*offsets), F.shiftright("_at", 33).cast("int")) if offsets else F.lit(0).cast("long")
    out = ranged.withColumn(name, start + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at")
    out._stored_at = ranged._stored_at
    return out


def tasks(spark: SparkSession) -> int:
    """How many tasks to deal work out to: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Frames:
    """The tables of a data folder and the knowledge-graph frames derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._novel: dict[int, DataFrame] = {}
        self._mined: dict[tuple, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def coded(self) -> DataFrame:
        """What each raw triple is made from (fixtures.CODED), numbered in a total order.

        Lines are dealt once, by ranges of their order, together with the orders themselves, so that
        no second shuffle joins the two; all text is made when a row is read.
        """
        lines = self.table("lineitem").select(*fixtures.LINE_ORDER).where("l_orderkey IS NOT NULL")
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("yr")).where("o_orderkey IS NOT NULL").join(customers, F.col("o_custkey") == F.col("c_custkey"))
        orders = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("is_line"), F.struct("yr", "c_custkey", "c_nationkey").alias("o"))
        both = lines.withColumn("is_line", F.lit(1)).unionByName(orders, allowMissingColumns=True).repartitionByRange(tasks(self.spark), "l_orderkey")
        of_order = Window.partitionBy("l_orderkey").orderBy("is_line", *fixtures.LINE_ORDER[1:])
        placed = both.withColumn("o", F.collect_list("o").over(of_order)).where("is_line = 1").withColumn("o", F.explode("o")).select("*", "o.*")
        return numbered(self.spark.sql(fixtures.CODED, lines=placed))

    def _triples(self, coded: DataFrame, *also: str) -> DataFrame:
        """Raw triples of coded rows, and more columns of these."""
        return self.spark.sql(fixtures.decoded_sql(*also), coded=coded)

    @cached_property
    def kg(self) -> DataFrame:
        """Raw triples (fixture), numbered in a total order."""
        return self._triples(self.coded)

    @cached_property
    def records(self) -> DataFrame:
        """doc_id, doc: one tagged bibliographic record per document (fixture)."""
        return self.spark.sql(fixtures.RECORDS.replace("FROM documents", "FROM {documents}"), documents=self.table("documents"))

    @cached_property
    def pages(self) -> DataFrame:
        """doc_id, page_no, text: the lines of documents as pages (fixture)."""
        return self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("page_no"), "text")

    @cached_property
    def clean(self) -> DataFrame:
        return triples.clean(self.kg)

    @cached_property
    def ids(self) -> DataFrame:
        """clean with ids as src and dst instead of names."""
        return self._by_id(self.coded)

    def _by_id(self, coded: DataFrame, *also: str) -> DataFrame:
        """Clean triples of coded rows by ids, and columns of these rows."""
        more = ("src_id", "dst_id", *also)
        return triples.clean(self._triples(coded, *more), *more).drop("src", "dst").withColumnsRenamed({"src_id": "src", "dst_id": "dst"})

    @cached_property
    def chosen(self) -> DataFrame:
        """The coded row of each edge, with the first ordinal and the number of triples of its pair of nodes."""
        pair = Window.partitionBy("src_id", "dst_id")
        rows = self.coded.where("src_id <> dst_id").withColumns({"first": F.min("ordinal").over(pair), "triples": F.count("*").over(pair)})
        best = pair.orderBy(F.desc(triples.confidence_value(F.expr(fixtures.CONFIDENCE))), "ordinal")
        return stored(rows.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn"), "edges")

    @cached_property
    def edges(self) -> DataFrame:
        """triples.collapse_max of clean, from the rows that it keeps."""
        return triples.clean(self._triples(self.chosen))

    @cached_property
    def links(self) -> DataFrame:
        """edges with ids as src and dst, first and triples."""
        return self._by_id(self.chosen, "first", "triples")

    def named(self, df: DataFrame, *columns: str) -> DataFrame:
        """df with names instead of ids in these columns."""
        return df.withColumns({c: F.expr(fixtures.name_sql(c)) for c in columns})

    @cached_property
    def layers_by_id(self) -> DataFrame:
        return stored(layers.node_layers(self.ids), "layers")

    @cached_property
    def node_layers(self) -> DataFrame:
        return self.named(self.layers_by_id, "node")

    @cached_property
    def fine_layers(self) -> DataFrame:
        """node, layer with biological split by keywords."""
        from ripplegraph.operators import keywords

        return self.node_layers.select("node", keywords.split_biological(F.col("node"), F.col("layer")).alias("layer"))

    @cached_property
    def degrees_by_id(self) -> DataFrame:
        from ripplegraph.operators import graph

        return stored(graph.degrees(self.links), "degrees")

    @cached_property
    def degrees(self) -> DataFrame:
        return self.named(self.degrees_by_id, "node")

    @cached_property
    def ranks_by_id(self) -> DataFrame:
        from ripplegraph.operators import graph

        return stored(graph.pagerank(self.links, stored, PR_ROUNDS, None), "ranks")

    @cached_property
    def ranks(self) -> DataFrame:
        """PageRank after PR_ROUNDS rounds."""
        return self.named(self.ranks_by_id, "node")

    def mined(self, *carry: str) -> DataFrame:
        """Mined paths by ids, with path_id: the nodes' names joined by >. carry: what `steps` says of each step (cf, rel, triples)."""
        if carry not in self._mined:
            self._mined[carry] = self._mine(self.links, self.layers_by_id, carry)
        return self._mined[carry]

    def _mine(self, links: DataFrame, of_node: DataFrame, carry: tuple, own: tuple = ()) -> DataFrame:
        from ripplegraph.operators import graph

        paths = graph.mine_paths(links.select("src", "dst", "first", *carry), of_node, stored, carry=carry, own=own)
        return self.named(paths, "source").withColumn("nodes", F.expr(f"transform(nodes, x -> {fixtures.name_sql('x')})")).withColumn("path_id", F.concat_ws(">", "nodes"))

    @cached_property
    def paths(self) -> DataFrame:
        """Mined paths with path_id: the nodes joined by >."""
        return self.mined()

    @cached_property
    def frequencies(self) -> DataFrame:
        """Mined paths with f, the logarithm of degree + 1, of the source and of the node that each step leads to."""
        of_node = self.degrees_by_id.select("node", F.log1p(F.col("degree").cast("double")).alias("f"))
        links = self.links.select("src", "dst", "first").join(of_node.withColumnRenamed("node", "dst"), "dst")
        return self._mine(links, self.layers_by_id.join(of_node, "node"), ("f",), ("f",))

    @cached_property
    def severity_by_id(self) -> DataFrame:
        from ripplegraph.operators import scores

        return stored(scores.severities(self.links, self.layers_by_id, self.degrees_by_id), "severity")

    @cached_property
    def severity(self) -> DataFrame:
        return self.named(self.severity_by_id, "node")

    @cached_property
    def weighed(self) -> DataFrame:
        """Mined paths with what scores.novelty_along needs of their nodes and steps."""
        from ripplegraph.operators import scores

        of_node = scores.node_facts(self.degrees_by_id, self.ranks_by_id, self.severity_by_id)
        links = scores.step_facts(self.links.select("src", "dst", "first", "rel"), of_node)
        return self._mine(links, self.layers_by_id.join(of_node, "node"), scores.STEP_FACTS, scores.NODE_FACTS)

    @cached_property
    def scored(self) -> DataFrame:
        """path_id, lf, clc, ip, score of the mined paths, rounded to 6 digits."""
        from ripplegraph.operators import scores

        found = scores.novelty_along(self.weighed, self.degrees_by_id, self.ranks_by_id)
        return found.select("path_id", *[F.round(c, 6).alias(c) for c in ("lf", "clc", "ip", "score")])

    @cached_property
    def swept(self) -> DataFrame:
        """combo, path_id, score, rank of every path under all weights."""
        from ripplegraph.operators import scores

        return stored(scores.ranked(scores.sweep(self.scored)), "swept")

    @cached_property
    def neighbours(self) -> DataFrame:
        """src, dst, sim, rank of the KNN_TOP nearest vectors of each."""
        from ripplegraph.operators import resolve

        return stored(resolve.knn(self.table("embeddings"), KNN_TOP), "neighbours")

    @cached_property
    def no_mapping(self) -> DataFrame:
        return self.spark.createDataFrame([], "entity long, canonical long")

    @cached_property
    def halves(self) -> tuple[DataFrame, DataFrame]:
        """Edges of the holdout and of the known graph, by ids."""
        return tuple(stored(triples.collapse_last(self.ids.where(F.col("split") == s).select("src", "dst", "ordinal")), s) for s in ("holdout", "kg"))

    @staticmethod
    def name(c):
        """The name of a node by its id."""
        return fixtures.name_column(c)

    def with_path_id(self, df: DataFrame) -> DataFrame:
        """df with path_id, the names of its nodes joined by >."""
        return df.withColumn("path_id", F.array_join(F.transform("nodes", self.name), ">"))

    def novel(self, hops: int) -> DataFrame:
        """path_id, nodes (ids), n_known."""
        from ripplegraph.operators import benchmark

        if hops not in self._novel:
            self._novel[hops] = stored(benchmark.novel_paths(*self.halves, hops, stored), "novel")
        return self.with_path_id(self._novel[hops])

    @cached_property
    def walks(self) -> DataFrame:
        """nodes, seqs of two-hop questions, by ids."""
        from ripplegraph.operators import benchmark

        return stored(benchmark.walk_candidates(self.novel(2).select("nodes"), self.halves[1], 1, stored, name=self.name), "walks")

    @cached_property
    def distractors(self) -> DataFrame:
        """path_id, nodes, seqs of two-hop questions, by names."""
        return self._picked(self.walks)

    def _picked(self, walks: DataFrame) -> DataFrame:
        from ripplegraph.operators import benchmark

        rest = [c for c in walks.columns if c not in ("nodes", "seqs")]
        named = self.with_path_id(walks).select(*rest, "path_id", F.transform("nodes", self.name).alias("nodes"), F.transform("seqs", lambda s: F.transform(s, self.name)).alias("seqs"))
        return named.withColumn("seqs", benchmark.picked(F.col("path_id"), F.col("seqs")))

    @cached_property
    def questions(self) -> DataFrame:
        """Two-hop questions; the answer's place goes round from question to question."""
        from ripplegraph.operators import benchmark

        slots = with_ordinal(self.novel(2).select("path_id", "nodes"), "path_id", name="n").select("nodes", ((F.col("n") - 1) % 4).cast("int").alias("slot"))
        return benchmark.build(self._picked(self.walks.join(slots, "nodes")))

    @cached_property
    def evaluated(self) -> DataFrame:
        """id, hop_count, expected, pa, pb: answers of two modes to questions (fixture from orders)."""
        letter = lambda c: F.chr((65 + c % 4).cast("int"))
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        a = F.when(c % 31 == 0, "X").when(F.col("o_orderstatus") == "F", letter(c)).otherwise(letter(o))
        b = F.when(c % 37 == 0, "X").when(F.col("o_orderstatus").isin("F", "P"), letter(c)).otherwise(letter(o + c))
        return self.table("orders").select(o.alias("id"), (o % 4 + 1).cast("int").alias("hop_count"), letter(c).alias("expected"), a.alias("pa"), b.alias("pb"))


_frames: dict[tuple[str, str], tuple[tuple, Frames]] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of a data folder's files: changed data gives another state."""
    system, at = _folder(spark, sf_dir)
    files = system.listFiles(at, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().getName(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    """The Frames of a session and the present state of a folder; made once, so that derived
    tables are written once. Those of an earlier state are deleted."""
    key, state = (spark.sparkContext.applicationId, sf_dir), _state(spark, sf_dir)
    if key not in _frames or _frames[key][0] != state:
        if key in _frames:
            for value in vars(_frames[key][1]).values():
                discard(value)
        _frames[key] = (state, Frames(spark, sf_dir))
    return _frames[key][1]
