"""Repeated substrings where ids repeat or are null: rows, not ids, are documents."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxmill.llm import substrings

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def plain(rows):
    """What is left of each text, window by window; null ids come last and are equal."""
    raws = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, raw in raws:
        for k in range(len(raw) - substrings.WINDOW + 1):
            w = raw[k : k + substrings.WINDOW]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - substrings.WINDOW + 1):
            if least[raw[k : k + substrings.WINDOW]] < i:
                gone[k : k + substrings.WINDOW] = b"\1" * substrings.WINDOW
        out.append(bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


def cases():
    rng = random.Random(4)
    a, b, c, shared = words(rng, 40), words(rng, 40), words(rng, 60), words(rng, 15)
    yield [(1, a), (7, a), (7, b)]
    yield [(1, a), (None, a), (None, b)]
    yield [(7, a), (7, a), (7, b + shared), (7, c + shared), (None, shared + a), (None, c), (None, c), (2, shared), (2, None), (1, "")]
    yield [(rng.choice([1, 2, 2, 3, None, None]), rng.choice([a, b, c, a[:80] + b, shared + c, c + shared])) for _ in range(30)]


@pytest.mark.parametrize("rows", list(cases()))
@pytest.mark.parametrize("parts", [1, 4])
def test_rows_are_documents(spark, rows, parts):
    docs = spark.createDataFrame([(i, t, str(k), "s", None) for k, (i, t) in enumerate(rows)], DOC).repartition(parts)
    want = {str(k): x for k, x in enumerate(plain(rows))}
    got = substrings.without_repeats(docs, ["lang"]).select("lang", "repeats.kept").collect()
    assert {r.lang: bytes(r.kept) for r in got} == want and len(got) == len(rows)
    stage = corpus_pipeline.cut_repeats(spark, docs.withColumn("_row", F.lit("own")), "").collect()
    assert {r.lang: r.text.encode() for r in stage} == want and all(r["_row"] == "own" and r.n_chars == len(r.text) for r in stage)
