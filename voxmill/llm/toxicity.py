"""Toxicity scores: boosted trees over lexicon densities and writing habits, calibrated."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, held_out_bucket, table
from .learning import MAX_LABELLED_ROWS, TextModel, feature_rows, fit, labelled_sample, score_documents

# Plain insults that count before any label is seen.
BASE_LEXICON = (
    "bastard", "clown", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser",
    "moron", "pathetic", "scum", "stupid", "trash", "ugly", "worthless",
)
# Second-person words of the corpus' languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ya tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie tú ti tuyo usted ustedes vosotros".split()
)
# Characters that stand in for letters.
STAND_INS = str.maketrans("013457@$!|", "oieastasil")

PREFIX_LENGTHS = (4, 5, 6)
LEXICON_SIZE = 600
MIN_POSITIVE = 3  # documents of label 1 with a term, and this share of them
MIN_POSITIVE_SHARE = 0.003
MIN_LOG_ODDS = 2.5
NEAR = 5
THRESHOLD = 0.3
WIDTH = 18
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’¿¡…"
_INNER = re.compile(r"[\W_]+")


def _words(text: str) -> list[str]:
    return [t.strip(_EDGE) for t in text.lower().split()]


def _plain(word: str) -> str:
    """The word with stand-ins put back, separators dropped and long repeats shortened."""
    return re.sub(r"(.)\1{2,}", r"\1", _INNER.sub("", word.translate(STAND_INS)))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Whole words and word beginnings (marked *) that mark label 1, with their log odds.

    Counts are per document, added up on the executors; at most LEXICON_SIZE entries come back.
    """

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, y in zip(b["text"].fillna(""), b["y"], strict=True):
                words = {w for w in _words(text) if len(w) > 2}
                n[y].update(words | {w[:k] + "*" for w in words for k in PREFIX_LENGTHS if len(w) >= k})
            terms = list(n[0].keys() | n[1].keys())
            yield pd.DataFrame({"term": terms, "pos": [n[1][t] for t in terms], "neg": [n[0][t] for t in terms]})

    totals = sample.groupBy().agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).first()
    odds = F.log((F.col("pos") + 0.5) / (totals.p + 1)) - F.log((F.col("neg") + 0.5) / (totals.n + 1))
    best = (
        sample.select("text", "y").mapInPandas(counts, "term string, pos long, neg long")
        .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where(F.col("pos") >= max(MIN_POSITIVE, MIN_POSITIVE_SHARE * totals.p))
        .withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
        .orderBy((F.col("odds") * F.sqrt("pos")).desc(), "term").limit(LEXICON_SIZE)
    )
    learned = {r.term: float(r.odds) for r in best.collect()}
    return {w: MIN_LOG_ODDS for w in BASE_LEXICON} | learned


def text_features(texts: list[str], lexicon: dict[str, float]) -> np.ndarray:
    """One row of WIDTH numbers for each whole text; an empty text gives zeros."""
    starts = {t[:3] for t in lexicon}

    @functools.lru_cache(200_000)
    def weight(word: str) -> float:
        found = [lexicon.get(word, 0.0), *(lexicon.get(word[:k] + "*", 0.0) for k in PREFIX_LENGTHS if len(word) >= k)]
        return max(found)

    out = np.zeros((len(texts), WIDTH))
    for i, text in enumerate(texts):
        if not text:
            continue
        words = _words(text)
        n = max(len(words), 1)
        hits = [(k, s) for k, w in enumerate(words) if w[:3] in starts and (s := weight(w))]
        odd = [(k, w) for k, w in enumerate(words) if w and not w.isalpha() and not w.isdigit()]
        hidden = [(k, s) for k, w in odd if (s := weight(_plain(w))) and not weight(w)]
        found = hits + hidden
        you = {k for k, w in enumerate(words) if w in SECOND_PERSON}
        near = sum(any(k + d in you for d in range(-NEAR, NEAR + 1)) for k, _ in found)
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        m = int(raw.sum())
        weights = [s for _, s in found]
        caps = sum(1 for t in text.split() if len(t) > 2 and t.isupper())
        out[i] = (
            math.log1p(n), len(found), 100 * len(found) / n, max(weights, default=0), math.log1p(sum(weights)),
            near, 100 * len(you) / n, raw[65:91].sum() / m, caps / n, raw[33] / m, raw[63] / m,
            (raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()) / m,
            raw[48:58].sum() / m, len(odd) / n, len(hidden), (raw[35:39].sum() + raw[42] + raw[64]) / m,
            len({words[k] for k, _ in found}), m / n,
        )
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, max_rows: int = MAX_LABELLED_ROWS) -> TextModel:
    """Fit on labelled rows outside the held-out bucket.

    Only the text and the label are used. Without usable labels the score is a base rate.
    """
    bound_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", modulus, held, max_rows)
    lexicon = learn_lexicon(sample.where("not calibrates"))  # calibration is on rows that no feature has seen
    features = functools.partial(text_features, lexicon=lexicon)
    return fit(feature_rows(sample, features, WIDTH), features, WIDTH, trees=60, depth=3)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, repeated rows included.

    Null and empty texts are scored as empty; a null doc_id stays null and isn't held out.
    """
    scored = score_documents(docs, fit_toxicity(docs, labels))
    return scored.select(
        "doc_id",
        (held_out_bucket("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
