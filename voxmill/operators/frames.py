"""Clips as frame and segment tables. Every window and join has the clip as its equality key.

Frames are (clip_id, frame_idx, energy[, is_speech]); segments are (clip_id, start, end) in
samples, half open; `hop` and `pad` are samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = "clip_id"


def _clip() -> Window:
    return Window.partitionBy(CLIP)


def frame_rms(y: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """RMS of frames that start at 0, hop, ... below max(1, length - frame)."""
    starts = np.arange(0, max(1, len(y) - frame), hop)
    total = np.concatenate([[0.0], np.cumsum(np.asarray(y, np.float64) ** 2)])
    ends = np.minimum(starts + frame, len(y))
    return np.sqrt((total[ends] - total[starts]) / np.maximum(ends - starts, 1) + 1e-9)


def frames(clips: DataFrame, frame_s: float = 0.02, hop_s: float = 0.01) -> DataFrame:
    """(clip_id, frame_idx, rms) from (clip_id, sr, samples); an empty clip gives no frames."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [frame_rms(np.asarray(y, np.float64), int(frame_s * sr), int(hop_s * sr)) if y is not None and len(y) else np.zeros(0) for y, sr in zip(b["samples"], b["sr"], strict=True)]
            yield pd.DataFrame({CLIP: b[CLIP], "rms": rows})

    kind = dict(clips.dtypes)[CLIP]
    arrays = clips.select(CLIP, "sr", "samples").mapInPandas(cut, f"{CLIP} {kind}, rms array<double>")
    return arrays.select(CLIP, F.posexplode("rms").alias("frame_idx", "rms"))


def voiced_by_median(df: DataFrame, value: str = "rms") -> DataFrame:
    """`is_speech`: at least 0.6 of the clip's median, and 1e-4."""
    limit = F.greatest(F.lit(1e-4), 0.6 * F.median(value).over(_clip()))
    return df.withColumn("is_speech", F.col(value) >= limit)


def speech_runs(df: DataFrame, hop: int) -> DataFrame:
    """(clip_id, start, end) of the runs of consecutive speech frames."""
    order = _clip().orderBy("frame_idx")
    runs = df.where("is_speech").withColumn("_run", F.col("frame_idx") - F.row_number().over(order))
    first, last = F.min("frame_idx") * hop, F.max("frame_idx") * hop + hop
    return runs.groupBy(CLIP, "_run").agg(first.cast("long").alias("start"), last.cast("long").alias("end")).drop("_run")


def voiced_by_peak(df: DataFrame, hop: int, sr: int, top_db: float = 35.0) -> DataFrame:
    """Runs over 0.2 s within `top_db` of the clip's peak energy; for a clip without any, its middle 12 s."""
    loud = F.col("energy") >= F.max("energy").over(_clip()) * F.lit(10 ** (-top_db / 10))
    flagged = df.withColumn("is_speech", loud & (F.col("energy") > 0))
    runs = speech_runs(flagged, hop).where(F.col("end") - F.col("start") > int(0.2 * sr))
    sizes = df.groupBy(CLIP).agg(((F.max("frame_idx") + 1) * hop).cast("long").alias("_n"))
    silent = sizes.join(runs.select(CLIP).distinct(), CLIP, "left_anti")
    start = F.greatest(F.lit(0), F.floor(F.col("_n") / 2) - 6 * sr).cast("long")
    middle = silent.select(CLIP, start.alias("start"), F.least(F.col("_n"), start + 12 * sr).alias("end"))
    return runs.unionByName(middle)


def pad_and_merge(segs: DataFrame, pad: int, length: str | int) -> DataFrame:
    """Padded at both ends, kept inside the clip, merged where a start is within `pad` of the end before.

    `length` is the clip's length or a column with it.
    """
    size = F.col(length) if isinstance(length, str) else F.lit(length)
    padded = segs.select(CLIP, F.greatest(F.lit(0), F.col("start") - pad).cast("long").alias("start"), F.least(size, F.col("end") + pad).cast("long").alias("end"))
    order = _clip().orderBy("start", "end")
    apart = padded.withColumn("_new", F.coalesce((F.col("start") > F.lag("end").over(order) + pad).cast("int"), F.lit(1)))
    numbered = apart.withColumn("_seg", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(CLIP, "_seg").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_seg")


def _placed(df: DataFrame, segs: DataFrame, hop: int) -> DataFrame:
    """The frames with the `_start` and `_end` of the segment that each starts in, or nulls.

    A clip's segments must not overlap. They stand among its frames in order of time, and each frame
    looks back to the last one: a sort of the clip, however many segments it has.
    """
    frames = df.withColumn("_at", (F.col("frame_idx") * hop).cast("long"))
    both = frames.unionByName(segs.select(CLIP, F.col("start").alias("_at"), F.col("start").alias("_start"), F.col("end").alias("_end")), allowMissingColumns=True)
    order = _clip().orderBy("_at", F.col("frame_idx").isNotNull())
    back = lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    looked = both.select(*df.columns, "_at", back("_start").alias("_start"), back("_end").alias("_end")).where("frame_idx is not null")
    inside = F.col("_at") < F.col("_end")
    return looked.select(*df.columns, F.when(inside, F.col("_start")).alias("_start"), F.when(inside, F.col("_end")).alias("_end"))


def segment_energy(df: DataFrame, segs: DataFrame, hop: int) -> DataFrame:
    """Segments (none over another) with the mean `energy` of the frames that start in them."""
    held = _placed(df, segs, hop).where("_end is not null")
    return held.groupBy(CLIP, F.col("_start").alias("start"), F.col("_end").alias("end")).agg(F.avg("energy").alias("energy"))


def segment_score(segs: DataFrame, sr: int, hnr: str | None = None) -> DataFrame:
    """`score`: 0.7 hnr + 0.3 energy, or the energy alone; segments under 0.1 s are left out."""
    score = 0.7 * F.col(hnr) + 0.3 * F.col("energy") if hnr else F.col("energy")
    return segs.where(F.col("end") - F.col("start") >= int(0.1 * sr)).withColumn("score", score)


def pick_top_segments(segs: DataFrame, want: int, clips: DataFrame | None = None) -> DataFrame:
    """(clip_id, rank, start, end): best first until `want` samples are taken, the last one cut.

    With `clips` (clip_id, length), clips without segments give their head.
    """
    order = _clip().orderBy(F.col("score").desc(), "start")
    before = F.coalesce(F.sum(F.col("end") - F.col("start")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = segs.withColumn("_before", before).withColumn("rank", F.row_number().over(order)).where(F.col("_before") < want)
    out = ranked.select(CLIP, "rank", "start", F.least(F.col("end"), F.col("start") + want - F.col("_before")).cast("long").alias("end"))
    if clips is None:
        return out
    bare = clips.join(segs.select(CLIP).distinct(), CLIP, "left_anti")
    return out.unionByName(bare.select(CLIP, F.lit(1).alias("rank"), F.lit(0).cast("long").alias("start"), F.least(F.lit(want), F.col("length")).cast("long").alias("end")))


def stitch_in_order(segs: DataFrame, want: int) -> DataFrame:
    """(clip_id, part, kind, start, end): whole segments in time order until `want` samples are reached.

    A clip that stays short repeats the head of its last segment, then is padded with silence
    (a row of kind `pad` from 0 to the samples still missing).
    """
    order = _clip().orderBy("start")
    size = F.col("end") - F.col("start")
    placed = segs.withColumn("_before", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    used = placed.where(F.col("_before") < want)
    whole = used.select(CLIP, F.row_number().over(order).alias("part"), F.lit("segment").alias("kind"), "start", "end")
    ends = used.groupBy(CLIP).agg(F.sum(size).alias("_got"), F.max_by(F.struct("start", "end"), "start").alias("_last"), F.count("*").alias("_n"))
    short = ends.where(F.col("_got") < want).withColumn("_take", F.least(F.lit(want) - F.col("_got"), F.col("_last.end") - F.col("_last.start")))
    again = short.select(CLIP, (F.col("_n") + 1).cast("int").alias("part"), F.lit("repeat").alias("kind"), F.col("_last.start").alias("start"), (F.col("_last.start") + F.col("_take")).alias("end"))
    missing = F.lit(want) - F.col("_got") - F.col("_take")
    pad = short.where(missing > 0).select(CLIP, (F.col("_n") + 2).cast("int").alias("part"), F.lit("pad").alias("kind"), F.lit(0).cast("long").alias("start"), missing.cast("long").alias("end"))
    return whole.unionByName(again).unionByName(pad)


def snr_from_speech(df: DataFrame, segs: DataFrame, hop: int, sr: int) -> DataFrame:
    """(clip_id, snr_db): mean energy inside over outside the segments, none of which lies over another.

    Where either side has under 0.2 s, the 0.8 and 0.2 quantiles of the frames' magnitudes are used.
    """
    marked = _placed(df, segs, hop).withColumn("_in", F.col("_end").isNotNull())
    magnitude = F.sqrt("energy")
    sides = marked.groupBy(CLIP).agg(
        (F.count_if("_in") * hop).alias("_speech"),
        (F.count_if(~F.col("_in")) * hop).alias("_noise"),
        (F.avg(F.when(F.col("_in"), F.col("energy"))) + 1e-12).alias("_ps"),
        (F.avg(F.when(~F.col("_in"), F.col("energy"))) + 1e-12).alias("_pn"),
        F.percentile(magnitude, 0.8).alias("_q80"),
        (F.percentile(magnitude, 0.2) + 1e-8).alias("_q20"),
    )
    short = (F.col("_speech") < 0.2 * sr) | (F.col("_noise") < 0.2 * sr)
    return sides.select(CLIP, F.when(short, 20 * F.log10(F.col("_q80") / F.col("_q20"))).otherwise(10 * F.log10(F.col("_ps") / F.col("_pn"))).alias("snr_db"))


def snr_from_percentiles(bins: DataFrame, bin_col: str = "freq_hz") -> DataFrame:
    """(clip_id, snr_db) from the mean over bins of the magnitudes' 10th and 90th percentiles."""
    q = bins.groupBy(CLIP, bin_col).agg(F.percentile("mag", 0.1).alias("_low"), F.percentile("mag", 0.9).alias("_high"))
    return q.groupBy(CLIP).agg((20 * F.log10(F.avg(F.col("_high") + 1e-9) / F.avg(F.col("_low") + 1e-9) + 1e-9)).alias("snr_db"))


def hum_decision(bins: DataFrame) -> DataFrame:
    """(clip_id, hum_hz): 50 or 60, whichever has the larger mean magnitude within 3 Hz; null where both are weak."""
    near = lambda hz: F.coalesce(F.avg(F.when(F.col("freq_hz").between(hz - 3, hz + 3), F.col("mag"))), F.lit(0.0))
    peaks = bins.groupBy(CLIP).agg(near(50).alias("_p50"), near(60).alias("_p60"))
    return peaks.select(CLIP, F.when(F.greatest("_p50", "_p60") < 0.001, None).when(F.col("_p50") >= F.col("_p60"), 50).otherwise(60).alias("hum_hz"))


def denoise_policy_dual(snr: Column, route: str = "embed") -> Column:
    """Embedding route: none from 15 dB on, 0.4 from 8 on, 0.2 below (lighter, to spare the timbre). Recognition: 0.9."""
    if route == "asr":
        return F.lit(0.9)
    return F.when(snr >= 15, None).when(snr >= 8, 0.4).otherwise(0.2)


def denoise_policy_auto(snr: Column, hnr: Column, policy: str = "auto") -> Column:
    if policy != "auto":
        return F.lit({"off": None, "light": 0.1, "strong": 0.2}[policy]).cast("double")
    return F.when((snr < 10) | (hnr < 15), 0.12)


def clip_report(segs: DataFrame, facts: DataFrame) -> DataFrame:
    """`facts` (one row a clip: sr, snr_db, hnr_db, ...) with the clip's ordered `segments`."""
    lists = segs.groupBy(CLIP).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("segments"))
    none = F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint>>")
    return facts.join(lists, CLIP, "left").withColumn("segments", F.coalesce("segments", none))


def spectral_floor(bins: DataFrame, strength: float = 0.9) -> DataFrame:
    """`floored`: each magnitude less `strength` times the 10th percentile of its frequency in the clip, at least 0."""
    mag = F.col("mag") + 1e-8
    floor = F.percentile(mag, 0.1).over(Window.partitionBy(CLIP, "freq_hz"))
    return bins.withColumn("floored", F.greatest(mag - strength * floor, F.lit(0.0)))
