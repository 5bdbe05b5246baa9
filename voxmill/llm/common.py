"""What the operators share: cutting lineage, Arrow batch bounds, distributed running totals."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARROW_BATCH_BYTES = 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, nbytes: int = ARROW_BATCH_BYTES) -> None:
    """Limit Arrow batches by bytes too, so that a run of very long texts stays small in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(nbytes))


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or tempfile.mkdtemp(prefix="spark-")


@contextlib.contextmanager
def configured(spark: SparkSession, **settings: str) -> Iterator[None]:
    """The session with other settings (dots written as __) for a while."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def settled(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from the files.

    The shuffle files of the job, which nothing reads after that, go with its end.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting holds for the new frame
    finally:
        spark.conf.set(CLEANUP, before)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, with what it holds; none is no error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out_bucket(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo `modulus`; null ids fall into bucket 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Add `<m>_before`: the sum of m over the earlier rows (by `order`) with the same keys.

    Rows are dealt by range of (keys, order), so that a key with any share of the rows is
    cut over many tasks; only one sum for each (task, key) is gathered. `order` should be
    unique within a key. The number of distinct keys must be bounded by the caller.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    ranged = settled(ranged)
    sums = ranged.groupBy("_part", *keys).agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *keys, *[F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"_{m}_base") for m in measures])
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(sums, ["_part", *keys])
    return out.select(
        *df.columns,
        *[(F.col(f"_{m}_base") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"{m}_before") for m in measures],
    )
