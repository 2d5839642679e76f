"""Running stages: order, resumption, finished work by fingerprint, rate limits, configuration."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


@dataclass
class Stage:
    name: str
    run: Callable[[], object]
    status: str = "waiting"
    seconds: float = 0.0
    error: str = ""


@dataclass
class Pipeline:
    """Stages in order. A failure ends the run unless skip_on_fail; start_from names the first to run."""

    stages: list[Stage] = field(default_factory=list)

    def run(self, start_from: str | None = None, skip_on_fail: bool = False) -> bool:
        names = [s.name for s in self.stages]
        if start_from is not None and start_from not in names:
            raise ValueError(f"no stage {start_from!r}; there are {names}")
        begin = names.index(start_from) if start_from is not None else 0
        for stage in self.stages[:begin]:
            stage.status = "skipped"
        for stage in self.stages[begin:]:
            if not self._one(stage) and not skip_on_fail:
                break
        return all(s.status in ("done", "skipped") for s in self.stages)

    def run_single(self, name: str) -> bool:
        return self._one(next(s for s in self.stages if s.name == name))

    def _one(self, stage: Stage) -> bool:
        began = time.monotonic()
        try:
            stage.run()
            stage.status = "done"
        except Exception as e:  # noqa: BLE001  a stage may fail in any way
            stage.status, stage.error = "failed", str(e)
            log.exception("stage %s", stage.name)
        stage.seconds = time.monotonic() - began
        return stage.status == "done"

    def status(self) -> list[dict]:
        return [{"name": s.name, "status": s.status, "seconds": s.seconds, "error": s.error} for s in self.stages]


def fingerprint(*inputs: object) -> str:
    """A short name for what a step was made from."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()[:20]


def finished(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept for this key, made and written first where there is none (or where its writing broke off)."""
    path = f"{folder.rstrip('/')}/{key}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def undone(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What isn't done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


class RateLimit:
    """At most n calls in any window of so many seconds."""

    def __init__(self, n: int, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.n, self.seconds, self.clock, self.sleep, self.calls = n, seconds, clock, sleep, deque()

    def acquire(self) -> None:
        now = self.clock()
        while self.calls and now - self.calls[0] >= self.seconds:
            self.calls.popleft()
        if len(self.calls) >= self.n:
            self.sleep(self.seconds - (now - self.calls[0]))
            return self.acquire()
        self.calls.append(self.clock())


def load_of(events: DataFrame, seconds: int = 60, limit: int = 60) -> DataFrame:
    """event_id, recent (a user's events in the window that ends at this one), over: more than the limit."""
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-seconds, 0)
    counted = events.select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")).withColumn("recent", F.count("*").over(w))
    return counted.select("event_id", "recent", (F.col("recent") > limit).alias("over"))


class Config:
    """Nested settings with dotted names."""

    def __init__(self, values: dict):
        self.values = values

    @classmethod
    def read(cls, *paths: str) -> "Config":
        """The first of these files that is there (JSON, or YAML where its library is)."""
        for path in paths:
            try:
                with open(path, encoding="utf-8") as f:
                    text = f.read()
            except FileNotFoundError:
                continue
            if path.endswith(".json"):
                return cls(json.loads(text))
            import yaml

            return cls(yaml.safe_load(text) or {})
        return cls({})

    def get(self, name: str, default: object = None) -> object:
        at: object = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at
