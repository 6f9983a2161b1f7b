"""Tables kept as files in the folder that driver and executors share, switched as a whole."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def for_workers(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver runs from another folder."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and Spark runs in one process, a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written and read back: a lost executor costs a reread from here on."""
    path = path or fresh(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_parts(batch: pa.RecordBatch, size: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch's rows of about ``most`` bytes together, one row at least."""
    upto, at = np.cumsum(size), 0
    while at < batch.num_rows:
        held = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, held + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class Files:
    """Small files and folders of any store that Spark reaches."""

    def __init__(self, spark: SparkSession):
        self._spark, self._jvm = spark, spark.sparkContext._jvm

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf())

    def delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)

    def names(self, path: str) -> list[str]:
        at, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def put(self, path: str, text: str) -> bool:
        """A whole new file, or False where one is: written aside, then renamed."""
        aside, fs = self._at(f"{path}.{uuid.uuid4().hex}.part")
        out = fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        at, _ = self._at(path)
        done = not fs.exists(at) and fs.rename(aside, at)
        if not done:
            fs.delete(aside, False)
        return done

    def text(self, path: str) -> str:
        return "\n".join(r.value for r in self._spark.read.text(path).collect())  # a manifest: small


class Commits:
    """Numbered states of a table, each one JSON file that names the folders it consists of.

    A state exists when its file does, and files appear by a rename, so a run that dies halfway
    leaves the last state whole; two writers of one number: the second is refused.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._files, self.path = Files(spark), path

    def last(self) -> tuple[int, dict]:
        found = [int(n[6:-5]) for n in self._files.names(self.path) if n.startswith("state-") and n.endswith(".json")]
        return (0, {}) if not found else (max(found), json.loads(self._files.text(f"{self.path}/state-{max(found)}.json")))

    def commit(self, number: int, state: dict) -> None:
        if not self._files.put(f"{self.path}/state-{number}.json", json.dumps(state)):
            raise RuntimeError(f"state {number} of {self.path} was written by someone else")
