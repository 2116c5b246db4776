"""Session settings the operators rely on, and the shared scratch folder.

Nothing here is required on a cluster that sets its own configuration: the
settings are runtime SQL confs, applied only where the session left them unset
or where the result (not the speed) depends on them.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Settings results depend on.
SEMANTIC_CONFS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

#: Rows handed to Python at once: texts of any length must fit in a worker's memory.
ARROW_ROWS = "2000"


def get_session(app: str = "factloom", master: str = "local[8]", **confs: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **SEMANTIC_CONFS,
        **confs,
    }
    for k, v in defaults.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def apply_semantics(spark: SparkSession) -> SparkSession:
    for k, v in SEMANTIC_CONFS.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only a local session gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-scratch-")
        atexit.register(shutil.rmtree, found[len("file://"):], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Scratch folders of this process that are still there.
_LIVE: set[tuple[SparkSession, str]] = set()


def release(spark: SparkSession | None = None) -> int:
    """Removes the scratch folders of ``spark`` (of all sessions, if none is given); frames read from them are lost.

    Runs by itself when the process ends, so that no job leaves tables behind.
    """
    mine = [x for x in _LIVE if spark is None or x[0] is spark]
    for session, path in mine:
        _LIVE.discard((session, path))
        try:
            remove(session, path)
        except Exception:  # the session is gone and its file system with it
            pass
    return len(mine)


class Scratch:
    """Tables written to the shared folder in order to cut lineage.

    ``keep`` writes a frame as Parquet and reads it back; the result survives the
    loss of executors. ``drop`` removes a table that a later one replaced.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark).rstrip('/')}/factloom-{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.count = 0
        if not _LIVE:
            atexit.unregister(release)
            atexit.register(release)
        _LIVE.add((spark, self.base))

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/t{self.count}"
        self.count += 1
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def keep_counted(self, df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
        """As ``keep``, with the number of rows (of those for which ``which`` holds), counted while they are written."""
        seen = Observation()
        counted = F.count(F.lit(1)) if which is None else F.count_if(which)
        return self.keep(df.observe(seen, counted.alias("n"))), int(seen.get["n"] or 0)

    def drop(self, df: DataFrame | None) -> None:
        path = self.paths.pop(id(df), None) if df is not None else None
        if path:
            remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    if path.startswith("file:") or path.startswith("/"):
        local = path[len("file:"):] if path.startswith("file:") else path
        shutil.rmtree(os.path.normpath("/" + local.lstrip("/")), ignore_errors=True)
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
