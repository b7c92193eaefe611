"""Count tables that are kept on storage and follow their table as it grows.

Counts add up. A store keeps, for each model of a table, parts: count tables of
the files that were there when they were counted. What a table consists of is its
snapshot: each file's path, size and time of change. When a table has gained files
only, those are counted and become a part; when a file has gone or changed, all
parts are dropped and the table is counted anew; when nothing has changed, no row
is read. Streams add a part a batch, named by the batch, so that a batch that is
run twice counts once.

What is counted is a row-wise view of the table. The state of a model is one small
file that names its parts; a part is written whole before that names it, and the
file is replaced in one step, so a crash leaves the former state.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presage.operators import bayes

#: Parts of a model before they are added up into one.
PARTS = 16
COUNTS = "fold int, cls string, field string, value string, n bigint"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def snapshot(df: DataFrame) -> dict[str, list[int]]:
    """{file: [bytes, time of change]} of the files that df reads."""
    out = {}
    for f in sorted(df.inputFiles()):
        system, target = _fs(df.sparkSession, f)
        status = system.getFileStatus(target)
        out[f] = [status.getLen(), status.getModificationTime()]
    return out


def snapshot_key(df: DataFrame) -> str:
    """One name for the state of what df reads; a frame that reads no files is its own plan."""
    files = snapshot(df)
    told = json.dumps([files, df.semanticHash()], sort_keys=True)
    return sha256(told.encode()).hexdigest()[:32]


class CountStore:
    """Kept counts under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        #: Rows counted by the last call, for reports: "none", "new" or "all".
        self.did = ""

    def _state(self, model: str) -> dict:
        system, target = _fs(self.spark, f"{self.folder}/{model}/state.json")
        if not system.exists(target):
            return {"files": {}, "parts": [], "next": 0}
        [row] = self.spark.read.text(target.toString(), wholetext=True).collect()
        return json.loads(row["value"])

    def _save(self, model: str, state: dict) -> None:
        system, target = _fs(self.spark, f"{self.folder}/{model}/state.json")
        _, fresh = _fs(self.spark, f"{self.folder}/{model}/state.new")
        out = system.create(fresh, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fresh, target, options)

    def _write(self, model: str, state: dict, name: str, counts: DataFrame) -> None:
        counts.write.mode("overwrite").parquet(f"{self.folder}/{model}/{name}")
        if name not in state["parts"]:
            state["parts"].append(name)

    def _sum(self, model: str, state: dict) -> DataFrame:
        if not state["parts"]:
            return self.spark.createDataFrame([], COUNTS)
        rows = self.spark.read.schema(COUNTS).parquet(*[f"{self.folder}/{model}/{p}" for p in state["parts"]])
        return rows if len(state["parts"]) == 1 else rows.groupBy("fold", "cls", "field", "value").agg(F.sum("n").alias("n"))

    def _compact(self, model: str, state: dict) -> None:
        old = list(state["parts"])
        if len(old) <= PARTS:
            return
        whole = self._sum(model, state)
        state["parts"], name = [], f"sum-{state['next']}"
        state["next"] += 1
        self._write(model, state, name, whole)
        state["batches"] = sorted({*state.get("batches", []), *[p for p in old if p.startswith("batch-")]})
        self._save(model, state)
        for p in old:
            system, target = _fs(self.spark, f"{self.folder}/{model}/{p}")
            system.delete(target, True)

    def counts(self, model: str, path: str, view: Callable[[DataFrame], DataFrame], features: list[str]) -> DataFrame:
        """(fold, cls, field, value, n) of the table at path, seen through view(rows) -> (fold, cls, features), row by row."""
        read = self.spark.read
        now = snapshot(read.parquet(path))
        state = self._state(model)
        known = state["files"]
        if any(now.get(f) != s for f, s in known.items()) or state.get("features", features) != features:
            state, known = {"files": {}, "parts": [], "next": state["next"]}, {}
        new = [f for f in now if f not in known]
        self.did = "none" if not new else "new" if known else "all"
        if new:
            name = f"part-{state['next']}"
            state["next"] += 1
            self._write(model, state, name, bayes.counted(view(read.option("basePath", path).parquet(*new)), features))
            state["files"], state["features"] = now, features
            self._save(model, state)
            self._compact(model, state)
        return self._sum(model, state)

    def add_batch(self, model: str, batch: DataFrame, batch_id: int, features: list[str]) -> None:
        """Adds the counts of a stream's batch(fold, cls, features): for foreachBatch. A batch that comes again replaces itself."""
        state = self._state(model)
        name = f"batch-{batch_id}"
        if name in state.get("batches", []):  # added up with others already
            return
        self._write(model, state, name, bayes.counted(batch, features))
        self._save(model, state)
        self._compact(model, state)

    def stream_counts(self, model: str) -> DataFrame:
        return self._sum(model, self._state(model))


def fitted(counts: DataFrame, features: list[str], classes: list[str] | None = None, folds: list[int] | None = None, alpha: float = bayes.ALPHA) -> bayes.Counts | None:
    """The model of kept counts, None if they are over the driver's bound."""
    rows = [tuple(r) for r in counts.select("fold", "cls", "field", "value", "n").limit(bayes.BOUND + 1).collect()]
    if len(rows) > bayes.BOUND:
        return None
    names = classes if classes is not None else sorted({r[1] for r in rows})
    return bayes.Counts(rows, features, names, folds, alpha)
