"""Quality scores: histogram boosted trees over document statistics."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, held_out_bucket, table
from .learning import MAX_LABELLED_ROWS, TextModel, feature_rows, fit, labelled_sample, score_documents

THRESHOLD = 0.3
WIDTH = 28
# Frequent function words of the corpus' languages.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on are this from or an der die und den von zu das mit sich des auf für ist im dem nicht ein eine als"
    " de la le et les des en un du une est pour que qui dans par pas sur au el y los se del las por con no para al lo como".split()
)


def text_statistics(texts: list[str]) -> np.ndarray:
    """One row of WIDTH statistics for each whole text; an empty text gives zeros."""
    out = np.zeros((len(texts), WIDTH))
    for i, text in enumerate(texts):
        if not text:
            continue
        coded = text.encode("utf-8", "replace")
        raw = np.bincount(np.frombuffer(coded, np.uint8), minlength=256)
        m = len(coded)
        words = text.split()
        n = max(len(words), 1)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        lines = text.split("\n")
        lower = list(map(str.lower, words))
        seen = set(lower)
        pairs = set(zip(lower, lower[1:], strict=False))
        filled = [x for x in lines if x.strip()]
        longest = max((lower.count(w) for w in ("the", "de", "der", "la")), default=0)
        out[i] = (
            math.log1p(n), math.log1p(m), math.log1p(len(lines)), m / n, lengths.mean() if len(words) else 0,
            lengths.std() if len(words) else 0, lengths.max(initial=0), len(seen) / n, len(pairs) / max(n - 1, 1),
            sum(1 for w in lower if w.strip(".,;:!?") in FUNCTION_WORDS) / n, sum(map(str.isupper, words)) / n,
            sum(1 for x in filled if x.rstrip()[-1] in ".!?") / max(len(filled), 1), len(set(filled)) / max(len(filled), 1),
            len(zlib.compress(coded, 1)) / m, raw[65:91].sum() / m, raw[48:58].sum() / m, raw[33] / m, raw[46] / n, raw[44] / n,
            (raw[35:39].sum() + raw[42]) / m, raw[124] / n, raw[128:].sum() / m, raw[10] / m, raw[64] / n,
            (raw[91] + raw[93] + raw[123] + raw[125] + raw[60] + raw[62] + raw[47] + raw[61] + raw[95] + raw[126] + raw[94]) / m,
            sum(w.count("...") + w.count("…") for w in words) / n, raw[:32].sum() / m, longest / n,
        )
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, max_rows: int = MAX_LABELLED_ROWS) -> TextModel:
    """Fit on labelled rows outside the held-out bucket; only text and label are used."""
    bound_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", modulus, held, max_rows)
    return fit(feature_rows(sample, text_statistics, WIDTH), text_statistics, WIDTH, trees=80, depth=4)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, repeated rows included.

    Null and empty texts are scored as empty; a null doc_id falls into the held-out bucket 0.
    """
    scored = score_documents(docs, fit_quality(docs, labels))
    return scored.select(
        "doc_id",
        (held_out_bucket("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
