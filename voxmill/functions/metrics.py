"""Error rates, vectors and model replies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import strip, strip_all_space


def edits(ref: Sequence, hyp: Sequence) -> int:
    """Edit distance of two sequences of hashable items, in whole bit vectors (Myers 1999, Hyyro 2003).

    A column of the distance table is held as its vertical differences, a bit for each item of the longer side, in
    machine words that one addition carries through; each item of the shorter side costs a dozen operations on them.
    """
    if len(ref) < len(hyp):
        ref, hyp = hyp, ref
    start, m = 0, len(ref)
    while start < len(hyp) and ref[start] == hyp[start]:
        start += 1
    end = 0
    while end < len(hyp) - start and ref[m - 1 - end] == hyp[len(hyp) - 1 - end]:
        end += 1
    ref, hyp = ref[start : m - end], hyp[start : len(hyp) - end]
    m = len(ref)
    if not hyp:
        return m
    held: dict = {}
    for place, item in enumerate(ref):
        held.setdefault(item, []).append(place)
    where = {}
    for item in set(hyp) & held.keys():
        bits = bytearray(m // 8 + 1)
        for place in held[item]:
            bits[place >> 3] |= 1 << (place & 7)
        where[item] = int.from_bytes(bits, "little")
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m  # rises by one and falls by one from item to item of the column
    for item in hyp:
        eq = where.get(item, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (full & ~(flat | up)), flat & up
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        rise = (rise << 1 | 1) & full
        up, down = (fall << 1 & full) | (full & ~(flat | rise)), flat & rise
    return score


def _rates(ref: pd.Series, hyp: pd.Series, parts: Callable[[str], Sequence], bare: Callable[[Sequence], float | None]) -> pd.Series:
    """Edits over the reference's parts, `bare` of the other side where it has none; null for a null side."""
    out = []
    for r, h in zip(ref, hyp, strict=True):
        if not isinstance(r, str) or not isinstance(h, str):
            out.append(None)
            continue
        r, h = parts(r), parts(h)
        out.append(edits(r, h) / len(r) if r else bare(h))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def _cer(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return _rates(ref, hyp, lambda x: x, lambda h: float(bool(h)))


def cer(ref: Column, hyp: Column) -> Column:
    """Character edits over the reference's length, without white space; may exceed 1. An empty reference: 0 if the other is, else 1."""
    return _cer(strip_all_space(ref), strip_all_space(hyp))


@F.pandas_udf(DoubleType())
def wer(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Word edits over reference words; null for a null side or a reference without words."""
    return _rates(ref, hyp, str.split, lambda _: None)


def asr_error(rate: Column, hyp: Column, status: Column) -> Column:
    """Neutral policy: 0.5 with recognition off or failed, 1 for an empty hypothesis, else the rate (0.5 if it has none)."""
    return F.when(status.isin("off", "failed"), 0.5).when(strip(F.coalesce(hyp, F.lit(""))) == "", 1.0).otherwise(F.coalesce(rate, F.lit(0.5)))


def asr_error_nullable(rate: Column, hyp: Column, status: Column) -> Column:
    """Log policy: null with recognition off or failed, or an empty hypothesis."""
    return F.when(~status.isin("off", "failed") & (strip(F.coalesce(hyp, F.lit(""))) != ""), rate)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + F.lit(1e-9)
    return F.transform(v, lambda x: x.cast("double") / norm)


def _softmax_at(logits: Column, last: bool) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    return F.exp(F.element_at(logits, -1 if last else 1).cast("double") - top) / total


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x.cast("double")))


def spoof_probability(logits: Column, convention: str = "last") -> Column:
    """Two logits or more: the softmax of the `last` or `first`; one: its sigmoid, or one less that. None: null."""
    one = _sigmoid(F.get(logits, F.lit(0)))
    one = one if convention == "last" else 1 - one
    return F.when(F.size(logits) >= 2, _softmax_at(logits, convention == "last")).when(F.size(logits) == 1, one)


def bonafide_probability(logits: Column) -> Column:
    return spoof_probability(logits, "last")


def parse_score_reply(stdout: Column) -> Column:
    """The score in a model's reply: its last line as JSON, else the first line with such an object in it, else null."""
    last = F.regexp_extract(F.regexp_replace(stdout, r"\s+$", ""), r"([^\n]*)\z", 1)
    found = F.regexp_extract(stdout, r'\{[^\n]*"cm_score"\s*:\s*([0-9.eE+-]+)[^\n]*\}', 1)
    return F.coalesce(F.get_json_object(last, "$.cm_score").try_cast("double"), found.try_cast("double"))


def score_reply_or_neutral(stdout: Column) -> Column:
    """Struct (score, backend, error): 0.5 tagged `fallback`, with the reply kept, where no score is found."""
    score = parse_score_reply(stdout)
    last = F.regexp_extract(F.regexp_replace(stdout, r"\s+$", ""), r"([^\n]*)\z", 1)
    backend = F.coalesce(F.get_json_object(last, "$.backend"), F.lit("regex"))
    return F.struct(
        F.coalesce(score, F.lit(0.5)).alias("score"),
        F.when(score.isNull(), "fallback").otherwise(backend).alias("backend"),
        F.when(score.isNull(), F.coalesce(stdout, F.lit(""))).alias("error"),
    )
