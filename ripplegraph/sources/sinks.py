"""Sinks: JSON by split, CSV, appended JSON lines, tables as text."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, which name each field in each row: compressed, as are the others."""
    df.write.json(path, compression="gzip")


def write_split_json(df: DataFrame, path: str, by: str = "split") -> None:
    """One folder of JSON lines per split."""
    df.write.partitionBy(by).json(path, compression="gzip")


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header; bom: a byte-order mark before the first column's name, as spreadsheets want it."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.csv(path, header=True, escape='"')


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path, compression="gzip")


def json_report(frames: dict[str, DataFrame]) -> str:
    """Small frames as one JSON text; infinite and undefined numbers as strings or null."""

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else ("inf" if v > 0 else "-inf") if math.isinf(v) else v
        return v

    return json.dumps({k: [{c: plain(v) for c, v in r.asDict(recursive=True).items()} for r in f.collect()] for k, f in frames.items()}, sort_keys=True)


def markdown_table(df: DataFrame) -> str:
    """A small frame as a Markdown table."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in df.collect()])
