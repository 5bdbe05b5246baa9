"""What is done, what is missing, where it goes instead, and the final table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OFFICIAL_BYTES, OFFICIAL_SECONDS, FILL_BYTES = 4096, 0.1, 2048
#: Ids of one bitmap (Spark's own size), and bytes of bitmaps that may go to every task.
BUCKET_IDS, BITMAP_BYTES = 32_768, 64 << 20


def official_outputs(listing: DataFrame) -> DataFrame:
    """(utt, path, name, size): finished outputs, one for each utterance, the first path of several."""
    fine = listing.where(F.col("name").rlike(r"(?i)^\d+\.wav$") & ~F.lower("name").contains("tmp") & (F.col("size") >= OFFICIAL_BYTES))
    if "duration_s" in listing.columns:
        fine = fine.where(F.coalesce(F.col("duration_s") >= OFFICIAL_SECONDS, F.lit(True)))
    named = fine.withColumn("utt", F.regexp_extract("name", r"^(\d+)", 1).try_cast("bigint")).where(F.col("utt").isNotNull())
    return named.groupBy("utt").agg(F.min("path").alias("path"), F.min_by("name", "path").alias("name"), F.min_by("size", "path").alias("size"))


def pending_tasks(tasks: DataFrame, done: DataFrame, key: str = "utt") -> DataFrame:
    return tasks.join(done.select(key), key, "left_anti")


def progress(done: DataFrame, total: int | Column, key: str = "utt") -> DataFrame:
    """`total` is a number, or a scalar subquery that is counted with the rest."""
    n = F.countDistinct(key)
    return done.agg(n.alias("n_done")).select("n_done", F.greatest(F.lit(0), (F.lit(total) if isinstance(total, int) else total) - F.col("n_done")).alias("n_left"))


def missing_ids(spark: SparkSession, n: int, done: DataFrame, key: str = "utt") -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", key).join(done.select(key), key, "left_anti")


def done_bitmaps(done: DataFrame, key: str = "utt") -> DataFrame:
    """(bucket, bits): finished ids as bitmaps, one of 4 KB for each BUCKET_IDS ids that hold any. Ids are integers; null ids are left out."""
    given = done.where(F.col(key).isNotNull())
    return given.groupBy(F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def is_set(bits: Column, place: Column) -> Column:
    """Whether the bit at `place` is set; false where there is no bitmap."""
    byte = F.ascii(F.decode(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))  # a byte is the character of its value
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def pending_by_bits(tasks: DataFrame, bitmaps: DataFrame, key: str = "utt", most_bytes: int = BITMAP_BYTES) -> DataFrame:
    """`pending_tasks` for integer ids. The bitmaps are counted first; up to `most_bytes` of them go to every
    task and the tasks aren't shuffled, beyond that both sides meet by bucket. A task with a null id is pending."""
    fits = bitmaps.count() * BUCKET_IDS // 8 <= most_bytes
    own = bitmaps.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    joined = tasks.join(F.broadcast(own) if fits else own, F.bitmap_bucket_number(key) == F.col("_bucket"), "left")
    return joined.where(~is_set(F.col("_bits"), F.bitmap_bit_position(key))).select(*tasks.columns)


def progress_by_bits(bitmaps: DataFrame, total: int | Column) -> DataFrame:
    """`progress` from the bitmaps."""
    n = F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n_done")
    return bitmaps.agg(n).select("n_done", F.greatest(F.lit(0), (F.lit(total) if isinstance(total, int) else total) - F.col("n_done")).alias("n_left"))


def missing_by_bits(spark: SparkSession, n: int | Column, bitmaps: DataFrame, key: str = "utt") -> DataFrame:
    """The ids from 1 to n that aren't set, bucket by bucket. `n` may be a scalar subquery, so nothing is counted on the driver."""
    last = F.lit(n) if isinstance(n, int) else n
    some = spark.range(1).select(last.cast("long").alias("_n"))
    # A literal `n` is folded into the sequence, so that has to be one for any value.
    tops = F.sequence(F.lit(1).cast("long"), F.greatest(F.bitmap_bucket_number("_n"), F.lit(1)), F.lit(1000).cast("long"))
    some = some.select("_n", F.explode(F.when(F.col("_n") > 0, tops)).alias("_top"))
    some = some.select("_n", F.explode(F.sequence("_top", F.least(F.col("_top") + 999, F.bitmap_bucket_number("_n")))).alias("bucket"))
    first = (F.col("bucket") - 1) * BUCKET_IDS + 1
    ids = F.sequence(first, F.least(first + BUCKET_IDS - 1, F.col("_n")))
    unset = F.filter(ids, lambda i: ~is_set(F.col("bits"), F.bitmap_bit_position(i)))
    return some.join(bitmaps, "bucket", "left").select(F.explode(unset).alias(key))


def needs_fill(tasks: DataFrame, listing: DataFrame, min_bytes: int = FILL_BYTES, key: str = "utt") -> DataFrame:
    """Tasks whose output is absent or too small."""
    sizes = listing.groupBy(key).agg(F.max("size").alias("_size"))
    return tasks.join(sizes, key, "left").where(F.col("_size").isNull() | (F.col("_size") <= min_bytes)).drop("_size")


def fallback_route(has_reference: Column, piper: Column) -> Column:
    """Without candidates: the offline voice if there is one, else a collage of the reference, else a tone."""
    return F.when(piper, "piper").when(has_reference, "collage").otherwise("tone")


def main_route(n_candidates: Column, has_reference: Column, piper: Column) -> Column:
    """`best` where candidates exist and the reference does, else the fallback."""
    return F.when(has_reference & (n_candidates > 0), "best").otherwise(fallback_route(has_reference, piper))


def sweep_route(has_reference: Column, piper: Column) -> Column:
    return fallback_route(has_reference, piper)


def run_counters(routes: DataFrame, filled: Column | None = None) -> DataFrame:
    n = [F.count_if(F.col("route") == r).alias(f"n_{r}") for r in ("piper", "collage", "tone")]
    return routes.agg(*n, F.count_if(filled if filled is not None else F.lit(False)).alias("n_filled"))


def error_summary(errors: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first n errors in processing order, each with the total number of errors (a sum over all)."""
    first = errors.orderBy(order).limit(n)
    return first.crossJoin(F.broadcast(errors.agg(F.count("*").alias("n_errors"))))


def final_table(tasks: DataFrame, chosen: DataFrame, fills: DataFrame, key: str = "utt", value: str = "wav_path") -> DataFrame:
    """Exactly one row for each task: the chosen output, else its fill."""
    one = lambda df, name: df.groupBy(key).agg(F.min(value).alias(name))
    joined = tasks.join(one(chosen, "_chosen"), key, "left").join(one(fills, "_fill"), key, "left")
    origin = F.when(F.col("_chosen").isNotNull(), "chosen").when(F.col("_fill").isNotNull(), "fill")
    return joined.withColumn(value, F.coalesce("_chosen", "_fill")).withColumn("origin", origin).drop("_chosen", "_fill")


def cache_key(path: Column, size: Column, mtime: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", path, size.cast("string"), mtime.cast("string"))), 1, length)


def config_key(path: Column, config: Column, length: int = 10) -> Column:
    return F.substring(F.sha1(F.concat(path, config)), 1, length)


def trimmed_name(stem: Column, key: Column, seconds: int = 60) -> Column:
    return F.concat(stem, F.lit(f"__trim{seconds}s__"), key, F.lit(".wav"))


def embed_name(stem: Column, key: Column) -> Column:
    return F.concat(stem, F.lit("."), key, F.lit(".embed.wav"))


def missing_references(tasks: DataFrame, references: DataFrame, name: str = "reference_speech", key: str = "utt") -> DataFrame:
    """A MissingRef error row for each task whose reference file isn't there."""
    lost = tasks.join(references.select(F.col("name").alias(name)).distinct(), name, "left_anti")
    return lost.select(key, F.lit("MissingRef").alias("stage"), F.col(name).alias("error"))
