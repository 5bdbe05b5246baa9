"""Operators that stay bounded at any size, each against its plain form."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators import completeness, selection, waves


def shown(df):
    return sorted(map(repr, map(tuple, df.collect())))


# ---- references of hot utterances -------------------------------------------


def vectors(spark, n=3000):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 2 else rng.choice(["a", "b", None, "unknown"]), [rng.random(), rng.random()]) for i in range(n)]
    cands = spark.createDataFrame(rows, "id long, utt string, vector array<double>")
    refs = spark.createDataFrame([("hot", [1.0, 2.0]), ("a", [0.0, 1.0]), ("b", [3.0, 0.0]), (None, [1.0, 1.0]), ("unused", [1.0, 1.0])], "utt string, ref_vector array<double>")
    return cands, refs


def test_hot_reference(spark):
    cands, refs = vectors(spark)
    plain = selection.speaker_similarity(cands, refs)
    cut = selection.speaker_similarity(cands, refs, held=100)
    assert shown(cut) == shown(plain) and cut.count() == 3000
    sims = {r.id: r.sim for r in cut.collect()}
    want = {r.id: 0.0 if r.utt not in ("hot", "a", "b") else None for r in cands.collect()}
    assert all(sims[k] == 0.0 for k, v in want.items() if v == 0.0)
    first = np.array(cands.where("id = 1").first().vector)
    assert sims[1] == pytest.approx(float(first / np.linalg.norm(first) @ np.array([1, 2]) / 5**0.5), abs=1e-6)


def test_hot_shares(spark):
    cands, _ = vectors(spark)
    shares = {r.utt: r._shares for r in selection.hot_shares(cands, "utt", 400).collect()}
    assert shares["hot"] == 4 and set(shares) <= {"hot", "a", "b", None, "unknown"}
    assert {r.utt for r in selection.hot_shares(cands, "utt", 1, 2).collect()} <= {"hot"}  # fewer than two keys
    assert selection.hot_shares(cands.limit(0), "utt").isEmpty()


def test_hot_reference_is_cut_over_tasks(spark):
    cands, refs = vectors(spark)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = selection.speaker_similarity(cands, refs, held=50).where("utt = 'hot'").groupBy(F.spark_partition_id()).count()
        assert found.count() == 4 and found.agg(F.max("count")).first()[0] < 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_candidates_or_references(spark):
    cands, refs = vectors(spark, 20)
    assert selection.speaker_similarity(cands.limit(0), refs).isEmpty()
    assert {r.sim for r in selection.speaker_similarity(cands, refs.limit(0), missing=None, held=2).collect()} == {None}


# ---- finished ids as bitmaps ------------------------------------------------


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "utt long")


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_pending_by_bits(spark, most):
    rng = random.Random(2)
    done = [rng.randrange(-70_000, 200_000) for _ in range(5000)] + [1, 8, 9, 32_768, 32_769, 65_536, 10**15, None, 1]
    tasks = [rng.randrange(-70_000, 200_000) for _ in range(5000)] + [1, 8, 9, 32_768, 32_769, 32_770, 0, 10**15, None, None]
    d, t = ids(spark, *done), ids(spark, *tasks).withColumn("bits", F.lit("x"))
    bitmaps = completeness.done_bitmaps(d)
    assert shown(completeness.pending_by_bits(t, bitmaps, most_bytes=most)) == shown(completeness.pending_tasks(t, d))
    assert shown(completeness.progress_by_bits(bitmaps, 10_000)) == shown(completeness.progress(d, 10_000))


@pytest.mark.parametrize("n", [0, 1, 7, 32_768, 32_769, 100_000])
def test_missing_by_bits(spark, n):
    done = ids(spark, *range(-5, 200_000, 3), 2, 32_768, 32_769, None)
    got = completeness.missing_by_bits(spark, spark.range(n).agg(F.count("*")).scalar(), completeness.done_bitmaps(done))
    assert shown(got) == shown(completeness.missing_ids(spark, n, done))
    none = completeness.done_bitmaps(done.limit(0))
    assert completeness.missing_by_bits(spark, n, none).count() == n
    assert completeness.progress_by_bits(none, n).first().n_left == n


def test_tasks_are_not_shuffled(spark):
    pending = completeness.pending_by_bits(spark.range(1000).withColumnRenamed("id", "utt"), completeness.done_bitmaps(ids(spark, 3)))
    plan = pending._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the ids' own


# ---- joined clips by blocks -------------------------------------------------


def pieces(spark, rng, utts=4, many=9, longest=60, chunk=13):
    clips, rows = {}, []
    for u in [*range(utts), None]:
        for pos in range(rng.randrange(1, many)):
            y = np.array([rng.uniform(-1, 1) for _ in range(rng.choice([0, 1, 3, rng.randrange(longest)]))], np.float32)
            clips.setdefault(u, []).append(y)
            rows += [(u, pos, at, y[at : at + chunk].tolist()) for at in range(0, max(1, len(y)), chunk)]
    rows.append((0, 999, 0, None))
    rng.shuffle(rows)
    return clips, spark.createDataFrame(rows, "utt long, pos long, at long, samples array<float>")


@pytest.mark.parametrize("power", [True, False])
@pytest.mark.parametrize("block", [1, 7, 64, 100_000])
def test_joined_blocks(spark, power, block):
    for seed in range(2):
        clips, df = pieces(spark, random.Random(seed))
        got = {}
        for r in waves.joined_blocks(df, 100, 100, power, block).orderBy("utt", "block").collect():
            got.setdefault(r.utt, []).append((r.block, r.samples))
        for u, ys in clips.items():
            want = waves.overlapped([y.astype(float) for y in ys], 10, power)
            parts = got.get(u, [])
            assert [b for b, _ in parts] == list(range(-(-len(want) // block))) and all(len(y) == block for _, y in parts[:-1])
            assert np.allclose([x for _, y in parts for x in y], want, atol=1e-6)


def test_joined_blocks_of_long_clips(spark):
    """A clip of 1,200,000 samples stands in rows of 10,000, over several tasks; large keys stay exact."""
    big = 2**60 + 1
    sin = F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda i: F.sin(i + F.col("pos")).cast("float"))
    df = spark.range(300).select(F.lit(big).alias("utt"), F.col("id").alias("pos"), F.lit(0).alias("at"), sin.alias("samples"))
    out = waves.joined_blocks(df, 1000, 50, True, 10_000)
    got = out.select("utt", "block", F.size("samples").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert {r.utt for r in got} == {big} and sum(r.n for r in got) == 300 * 4000 - 299 * 50 and max(r.n for r in got) == 10_000
    want = waves.overlapped([np.sin(np.arange(4000) + p).astype(np.float32).astype(float) for p in range(300)], 50, True)
    values = np.concatenate([r.samples for r in out.orderBy("block").collect()])
    assert np.allclose(values, want, atol=1e-5)
    assert waves.joined_blocks(df.limit(0), 1000, 50, True).isEmpty()


# ---- alignment --------------------------------------------------------------


def by_correlation(before, head, hop, tail, sr, length, least=0.35):
    if tail < int(0.15 * sr) or length < int(0.2 * sr) or len(head) <= len(before) + 2:
        return None
    at = int(np.argmax(np.correlate(head, before, mode="valid")))
    window = head[at : at + len(before)]
    if float(window @ before / (np.linalg.norm(window) * np.linalg.norm(before) + 1e-8)) < least:
        return None
    return max(0, min(at * hop + tail - int(0.02 * sr), length - 1))


def test_alignment_by_transform():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        head = rng.standard_normal(rng.integers(1, 400)) * 10.0 ** rng.integers(-6, 6)
        n = int(rng.integers(1, 60))
        before = head[(at := int(rng.integers(0, len(head)))) : at + n] + (k % 3) * 0.1 * head.std() if k % 2 else rng.standard_normal(n)
        rows.append((before, head, 16, int(rng.integers(0, 60)), 100, int(rng.integers(0, 8000))))
    got = waves.best_alignments([*rows, None])
    assert got == [*(by_correlation(*r) for r in rows), None] and sum(g is not None for g in got) > 60
    assert [waves.best_alignment(*r) for r in rows[:40]] == got[:40]


def test_alignment_of_even_and_odd_values():
    flat = np.ones(50)
    assert waves.best_alignment(flat[:9], flat, 4, 40, 100, 500) == 38  # the first of equal places
    twice = np.tile([0.0, 0, 3, 1], 6)
    assert waves.best_alignment(twice[2:4], twice, 1, 40, 100, 500) == by_correlation(twice[2:4], twice, 1, 40, 100, 500) == 40
    assert waves.best_alignment(np.zeros(3), flat, 4, 40, 100, 500) is None
    assert waves.best_alignment(np.array([]), flat, 4, 40, 100, 500) is None
    assert waves.best_alignment(np.array([1.0, np.nan]), flat, 4, 40, 100, 500) is None
