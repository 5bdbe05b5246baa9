"""Task tables, output listings, clips and what a run writes."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the task table and of the score log.
TASK_SCHEMA = "utt LONG, reference_speech STRING, text STRING"
LOG_COLUMNS = ("ts", "utt", "tag", "wav_path", "wer", "sim", "aasist", "wer_norm", "sim_norm", "aasist_norm", "final_score", "chosen")


def read_tasks(spark: SparkSession, path: str, schema: str = TASK_SCHEMA) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")


def limit_tasks(df: DataFrame, n: int, key: str = "utt") -> DataFrame:
    """The n rows with the smallest keys; all of them for n <= 0."""
    return df.orderBy(key).limit(n) if n > 0 else df


def list_outputs(spark: SparkSession, directory: str) -> DataFrame:
    """(path, name, size) of the files in a folder; their content is not read."""
    files = spark.read.format("binaryFile").load(directory)
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"))


def result_manifest(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("synthesized_speech", F.concat(F.col("utt").cast("string"), F.lit(".wav")))


def result_directory(directory: str) -> str:
    name = directory.rstrip("/")
    return name if name.endswith("-result") or name.rpartition("/")[2] == "result" else f"{name}-result"


def write_manifest(df: DataFrame, directory: str) -> str:
    """Quotes in texts are doubled and white space is kept, so that `read_tasks` gives the texts back."""
    out = result_directory(directory)
    df.write.mode("overwrite").csv(out, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return out


def format_score_log(df: DataFrame) -> DataFrame:
    """Text columns as the log holds them: six decimals, empty for null, 1 or 0 for chosen."""
    kinds = dict(df.dtypes)

    def shown(c: str):
        if kinds[c] in ("double", "float"):
            return F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.6f", c))
        if kinds[c] == "boolean":
            return F.when(F.col(c), "1").otherwise("0")
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return df.select(*[shown(c).alias(c) for c in df.columns])


def write_score_log(df: DataFrame, path: str) -> None:
    format_score_log(df.select(*[c for c in LOG_COLUMNS if c in df.columns])).write.mode("append").csv(path, header=True, emptyValue="")


def decode_wave(content: bytes) -> tuple[int, int, np.ndarray]:
    """Sample rate, channels and interleaved samples in [-1, 1] of a PCM file; louder ones are scaled down."""
    with wave.open(io.BytesIO(content)) as w:
        sr, channels, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
    peak = np.abs(x).max(initial=0.0)
    return sr, channels, (x / peak if peak > 1 else x).astype(np.float32)


def load_clips(spark: SparkSession, glob: str) -> DataFrame:
    """(clip_id, sr, channels, samples) of PCM WAV files; clip_id is the file's name without suffix."""
    files = spark.read.format("binaryFile").load(glob)
    named = files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("clip_id"), "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *decode_wave(c)) for i, c in zip(b["clip_id"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["clip_id", "sr", "channels", "samples"])

    return named.mapInPandas(decode, "clip_id string, sr int, channels int, samples array<float>")
