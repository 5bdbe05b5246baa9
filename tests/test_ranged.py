"""Groups of any size: the ranged forms against those of windows and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from voxmill.operators import frames as fr
from voxmill.operators import ranged


def hot_clip(spark, n=4000, parts=6):
    """Clip 0 holds most frames, null is a clip, and one clip is a single frame."""
    rng = random.Random(1)
    rows = [(None if (c := rng.choice([0, 0, 0, 1, 2, 9])) == 9 else c, k, rng.choice([rng.random() * 100, 5.0, 5.0]), rng.random() < 0.6) for k in range(n)] + [(77, 0, 1.0, True)]
    return spark.createDataFrame(rows, "clip_id long, frame_idx long, energy double, is_speech boolean").repartition(parts)


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_numbered(spark):
    df = hot_clip(spark).withColumnRenamed("frame_idx", "at")
    got = ranged.numbered(df, ["clip_id"], ["at"], "k").collect()
    by = {}
    for r in got:
        by.setdefault(r.clip_id, []).append((r.at, r.k))
    assert len(got) == 4001 and all([k for _, k in sorted(v)] == list(range(len(v))) for v in by.values())


def test_islands(spark):
    df = hot_clip(spark)
    plain = df.where("clip_id is not null")
    assert rows(ranged.speech_runs(plain, 10)) == rows(fr.speech_runs(plain, 10))
    runs = fr.speech_runs(plain, 10)
    assert rows(ranged.pad_and_merge(runs, 7, 50_000)) == rows(fr.pad_and_merge(runs, 7, 50_000))
    assert ranged.speech_runs(df.where("clip_id is null"), 10).count() > 1
    assert ranged.speech_runs(df.limit(0), 10).isEmpty()


def test_one_run_over_many_ranges(spark):
    df = spark.range(0, 5000, 1, 7).select(F.lit("a").alias("clip_id"), F.col("id").alias("frame_idx"), F.lit(True).alias("is_speech"))
    assert [tuple(r) for r in ranged.speech_runs(df, 2).collect()] == [("a", 0, 10_000)]


@pytest.mark.parametrize("held", [3, 40, 700, 100_000])
def test_quantiles(spark, held):
    qs = {"low": 0.1, "mid": 0.5, "high": 0.9, "first": 0.0, "last": 1.0}
    wide = F.when(F.col("frame_idx") % 5 == 0, F.pow(F.lit(10.0), F.col("energy"))).when(F.col("frame_idx") % 7 == 0, None).otherwise(F.col("energy"))
    df = hot_clip(spark).withColumn("v", wide)
    want = df.groupBy("clip_id").agg(*[F.percentile("v", q).alias(c) for c, q in qs.items()])
    assert rows(ranged.exact_quantiles(df, ["clip_id"], F.col("v"), qs, held)) == rows(want)


def test_quantiles_of_ties_and_nothing(spark):
    same = spark.range(1000).select(F.lit(1).alias("k"), F.lit(2.5).alias("v"))
    assert [tuple(r) for r in ranged.exact_quantiles(same, ["k"], F.col("v"), {"m": 0.5}, 10).collect()] == [(1, 2.5)]
    none = same.select("k", F.lit(None).cast("double").alias("v"))
    assert [tuple(r) for r in ranged.exact_quantiles(none, ["k"], F.col("v"), {"m": 0.5}, 10).collect()] == [(1, None)]
    assert ranged.exact_quantiles(same.limit(0), ["k"], F.col("v"), {"m": 0.5}, 10).isEmpty()


def test_frames_of_a_hot_clip(spark):
    df = hot_clip(spark).where("clip_id is not null").drop("is_speech")
    assert rows(ranged.voiced_by_median(df, "energy", 50).select("clip_id", "frame_idx", "is_speech")) == rows(fr.voiced_by_median(df, "energy").select("clip_id", "frame_idx", "is_speech"))
    segs = fr.pad_and_merge(fr.speech_runs(fr.voiced_by_median(df, "energy"), 10), 3, 50_000)
    near = lambda d: sorted((r.clip_id, r.start, r.end, round(r.energy, 9)) for r in d.collect())
    assert near(ranged.segment_energy(df, segs, 10)) == near(fr.segment_energy(df, segs, 10))
    snr = lambda d: {r.clip_id: r.snr_db for r in d.collect()}
    got, want = snr(ranged.snr_from_speech(df, segs, 10, 100, 50)), snr(fr.snr_from_speech(df, segs, 10, 100))
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) if want[c] is not None else got[c] is None for c in want)
