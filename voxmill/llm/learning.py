"""Fitting a text classifier on a bounded labelled sample and scoring every document with it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held_out_bucket
from .trees import Forest, Isotonic, fit_boosted, fit_isotonic

#: At most so many labelled rows are fitted on; chosen by a hash of the id, alike at every size.
MAX_LABELLED_ROWS = 20_000
CALIBRATION_SHARE = 4  # one labelled row in so many calibrates instead of fitting


@dataclass(frozen=True)
class TextModel:
    features: Callable[[list[str]], np.ndarray]
    forest: Forest
    calibration: Isotonic

    def score(self, texts: list[str]) -> np.ndarray:
        return np.clip(self.calibration(self.forest.probability(self.features(texts))), 0.0, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, max_rows: int) -> DataFrame:
    """(doc_id, text, y, calibrates) of at most `max_rows` labelled rows outside the held-out bucket.

    The row limit is what makes the broadcast of ids and the driver's share bounded.
    Labels other than 0 and 1 and null ids are left out; of repeated labels the largest counts,
    of repeated documents the least text.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .where(held_out_bucket("doc_id", modulus) != held)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION_SHARE)) == 0
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).withColumn("calibrates", calibrates)


def feature_rows(sample: DataFrame, features: Callable[[list[str]], np.ndarray], width: int) -> pd.DataFrame:
    """The bounded sample as numbers, computed on the executors."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = features(b["text"].fillna("").tolist())
                yield b[["doc_id", "y", "calibrates"]].assign(x=list(x.astype("float64")))

    return sample.mapInPandas(rows, "doc_id long, y int, calibrates boolean, x array<double>").toPandas().sort_values(["doc_id", "y"])


def fit(rows: pd.DataFrame, features: Callable, width: int, **options) -> TextModel:
    """Boosted trees on most of the sample, isotonic calibration on the rows set apart for it."""
    x = np.array(rows["x"].tolist(), float).reshape(-1, width)
    y = rows["y"].to_numpy(float)
    own = ~rows["calibrates"].to_numpy(bool)
    forest = fit_boosted(x[own], y[own], **options)
    held = forest.probability(x[~own])
    usable = len(held) >= 50 and 0 < y[~own].sum() < len(held)
    return TextModel(features, forest, fit_isotonic(held, y[~own]) if usable else Isotonic(np.array([]), np.array([])))


def score_documents(docs: DataFrame, model: TextModel) -> DataFrame:
    """(doc_id, score) of every row of `docs`; null text counts as empty."""
    bound_batches(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(b["text"].fillna("").tolist())})

    return docs.select("doc_id", "text").mapInPandas(rows, "doc_id long, score double")


def below(docs: DataFrame, model: TextModel, threshold: float) -> DataFrame:
    """The rows of `docs`, with all their columns, that score under the threshold."""
    bound_batches(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[model.score(b["text"].fillna("").tolist()) < threshold]

    return docs.mapInPandas(rows, docs.schema)
