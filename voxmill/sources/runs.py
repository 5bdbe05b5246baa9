"""Writes that happen once: files staged by run id, one commit marker, readers that take committed runs only.

Layout of a folder of runs: `data/<run>-<attempt>/` holds what an attempt has written, `commits/<run>`
names the attempt that counts. A marker is written aside and put in its place by one rename that
fails where a marker stands, so of two attempts at a run one counts and readers see all of it or
nothing. A driver or executor lost before that leaves files that nobody reads, and `sweep` removes.
The store's rename must be atomic, as those of HDFS and local folders are. Run ids are listed on
the driver; there are as many as runs, however large each is.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._=]*")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or tempfile.mkdtemp(prefix="spark-")


class Store:
    """The few calls to Hadoop's file system that a folder of runs needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, name: str, to: str, over: bool) -> bool:
        """False where `to` stands and may not be replaced."""
        options = self.jvm.org.apache.hadoop.fs.Options
        wanted = self.jvm.java.lang.reflect.Array.newInstance(options.Rename.NONE.getClass(), 1)
        wanted[0] = options.Rename.OVERWRITE if over else options.Rename.NONE
        try:
            self.context.rename(self.path(name), self.path(to), wanted)
        except Py4JJavaError as e:
            if not over and self.exists(to):
                return False
            raise e
        return True

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.path(name), True)


def stage(df: DataFrame, folder: str, run_id: str, fmt: str = "parquet", **options: str) -> str:
    """Write an attempt at a run, which counts for nothing until it is committed; returns the attempt's name."""
    if not RUN_ID.fullmatch(run_id):
        raise ValueError(f"run id {run_id!r}: letters, digits, '.', '_' and '=' only")
    attempt = f"{run_id}-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(f"{folder.rstrip('/')}/data/{attempt}")
    return attempt


def commit(spark: SparkSession, folder: str, attempt: str, replace: bool = False) -> bool:
    """Make an attempt the one that counts for its run. False, and nothing changes, if another one does and `replace` isn't set."""
    store, run_id = Store(spark, folder), attempt.rpartition("-")[0]
    store.put(f"pending/{attempt}", attempt)
    store.fs.mkdirs(store.path("commits"))
    done = store.move(f"pending/{attempt}", f"commits/{run_id}", replace)
    if not done:
        store.delete(f"pending/{attempt}")
        store.delete(f"data/{attempt}")
    return done


def committed(spark: SparkSession, folder: str) -> dict[str, str]:
    """The attempt that counts for each run."""
    store = Store(spark, folder)
    return {run: store.text(f"commits/{run}") for run in store.names("commits") if not run.startswith(".")}


def write_run(df: DataFrame, folder: str, run_id: str, replace: bool = False, fmt: str = "parquet", **options: str) -> bool:
    """Write `df` as a run, once: a run that is committed is left alone, and not computed again, unless `replace` is set."""
    spark = df.sparkSession
    if not replace and Store(spark, folder).exists(f"commits/{run_id}"):
        return False
    return commit(spark, folder, stage(df, folder, run_id, fmt, **options), replace)


def read_runs(spark: SparkSession, folder: str, schema: str, run_ids: Sequence[str] | None = None, fmt: str = "parquet", **options: str) -> DataFrame:
    """The rows of the committed runs (of those given), with their `run_id`. None committed: no rows."""
    found = {run: attempt for run, attempt in committed(spark, folder).items() if run_ids is None or run in run_ids}
    if not found:
        return spark.createDataFrame([], f"{schema}, run_id string")
    rows = spark.read.format(fmt).schema(schema).options(**options).load([f"{folder.rstrip('/')}/data/{a}" for a in found.values()])
    return rows.withColumn("run_id", F.regexp_extract(F.input_file_name(), r"/data/([^/]+)-[0-9a-f]{32}/", 1))


def sweep(spark: SparkSession, folder: str, older_than_s: float = 86_400.0) -> list[str]:
    """Remove attempts that don't count and are older than that; returns their names. Attempts under way are younger."""
    store, held = Store(spark, folder), set(committed(spark, folder).values())
    now = store.jvm.System.currentTimeMillis()
    gone = [a for a in store.names("data") if a not in held and now - store.fs.getFileStatus(store.path(f"data/{a}")).getModificationTime() >= older_than_s * 1000]
    for attempt in gone:
        store.delete(f"data/{attempt}")
        store.delete(f"pending/{attempt}")
    return gone
