"""Readers: tagged records, JSON triples, CSV lists, Markdown, JSON lines, merge maps, model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLE = "start_node string, relationship string, end_node string, evidence_sentence string, confidence string, start_layer string, end_layer string, paper_id string"


def split_records(files: DataFrame) -> DataFrame:
    """path, pos, doc: whole texts cut before each line that begins with `PT `; what doesn't begin so is dropped."""
    parts = files.select("path", F.posexplode(F.split("text", r"\n(?=PT )")).alias("pos", "doc"))
    return parts.where(F.trim("doc").startswith("PT "))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The same for files: lines end before `PT `, so that no file is held as one value."""
    lines = spark.read.option("lineSep", "\nPT ").text(path).select(F.col("value"))
    doc = F.when(F.trim("value").startswith("PT "), F.col("value")).otherwise(F.concat(F.lit("PT "), F.col("value")))
    return lines.where(F.length(F.trim("value")) > 0).select(doc.alias("doc"))


def read_triples(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Arrays or lines of JSON triples; unreadable ones are dropped (see read_quarantine)."""
    return spark.read.schema(f"{TRIPLE}{', ' + extra if extra else ''}, _corrupt_record string").option("mode", "PERMISSIVE").json(path).where("_corrupt_record IS NULL").drop("_corrupt_record")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """payload: the unreadable lines of JSON triples."""
    raw = spark.read.text(path).withColumnRenamed("value", "payload")
    parsed = F.from_json("payload", TRIPLE + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return raw.where(parsed["_corrupt_record"].isNotNull())


def read_csv_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, a byte-order mark before it dropped."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', encoding="UTF-8")


def read_csv_positional(spark: SparkSession, path: str) -> DataFrame:
    """pos (from 1), value of a headerless list; blank lines take a number and are dropped."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("p", "v")).select((F.col("p") + 1).alias("pos"), F.trim("v").alias("value")).where("value <> ''")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_merge_map(spark: SparkSession, path: str) -> DataFrame:
    """entity, canonical; a path that isn't there is the empty map."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "entity string, canonical string")
    return spark.read.parquet(path)


def convert_remote(documents: DataFrame, client, schema: str = "doc_id long, page_no int, text string") -> DataFrame:
    """Pages of documents by an injected converter (rows of a frame -> rows of pages)."""
    return documents.mapInPandas(lambda frames: map(client, frames), schema)


def ask(prompts: DataFrame, client, tries: int = 5) -> DataFrame:
    """id, reply by an injected model client (text -> text); after so many failures the reply is empty."""
    import pandas as pd

    def one(prompt: str) -> str:
        for _ in range(tries):
            try:
                return client(prompt)
            except Exception:  # noqa: BLE001  the client's errors are unknown
                continue
        return ""

    return prompts.select("id", "prompt").mapInPandas(lambda frames: (pd.DataFrame({"id": f["id"], "reply": [one(p) for p in f["prompt"]]}) for f in frames), "id long, reply string")
