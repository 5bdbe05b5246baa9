"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of `docs`. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import decontamination, learning, neardup, packing, substrings, toxicity
from voxmill.llm.common import remove, settled, shared_folder, table

#: No stage has a SQL form. Tests hold the near-duplicate and the repeats stage against brute force, the toxicity stage against
#: its model applied text by text, and the other two against their operators, which have brute-force tests of their own.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the others stay as they are."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return learning.below(docs, model, toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the least id stays."""
    gone = neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the 50-byte repeats of documents with smaller ids, in whole characters.

    A document that held nothing else stays with an empty text.
    """
    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = [f"column_{k}" for k in range(len(own))]  # so that none clashes with those of the operator
    renamed = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(own, names, strict=True)])

    def back(found: DataFrame) -> DataFrame:
        text = F.col("repeats.kept")
        columns = {c: F.col(n) for c, n in zip(own, names, strict=True)} | {"doc_id": F.col("doc_id"), "text": text}
        if "n_chars" in own:
            columns["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        return found.select(*[columns[c].alias(c) for c in docs.columns])

    return substrings.without_repeats(renamed, names, as_text=True, result=back)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaked = decontamination.benchmark_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack_documents(docs, packing.default_tokenizer(), keep_ids=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated substrings", cut_repeats),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    try:
        return settled(_staged(spark, docs, sf_dir, folder))
    finally:
        remove(spark, folder)


def _staged(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str) -> DataFrame:
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return out
