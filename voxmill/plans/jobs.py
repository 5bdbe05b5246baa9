"""The three workloads end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalize_text
from ..functions.text import estimate_duration
from ..operators import completeness, selection, sentences
from ..operators import frames as fr


@dataclass(frozen=True)
class ClipConfig:
    hop: int = 160
    pad: int = 3200
    sr: int = 16000
    want_seconds: float = 6.0


def finish_run(tasks: DataFrame, done: DataFrame, candidates: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row for each task not done before: the chosen candidate, else where the sweep sends it."""
    pending = completeness.pending_tasks(tasks, done)
    chosen = selection.pick_best_with_fallback(selection.score_dynamic_weights(candidates)).select("utt", "wav_path")
    fills = completeness.needs_fill(pending, outputs).withColumn("route", completeness.sweep_route(F.col("reference_speech").isNotNull(), F.lit(False)))
    fills = fills.select("utt", F.concat_ws(":", "route", F.col("utt").cast("string")).alias("wav_path"))
    return completeness.final_table(pending, chosen, fills)


def text_plan(tasks: DataFrame, max_len: int = 80, look_back: int = 8) -> DataFrame:
    """Sentences of the normalised text with look-back context and estimated duration; no shuffle."""
    spoken = tasks.withColumn("text", normalize_text("text"))
    return sentences.sentence_plan(spoken, "text", max_len, look_back).withColumn("duration_s", estimate_duration(F.col("sentence")))


def clean_clips(frames: DataFrame, cfg: ClipConfig = ClipConfig()) -> DataFrame:
    """Report of each clip: SNR, denoise strength and the best segments within the budget."""
    sizes = frames.groupBy("clip_id").agg(((F.max("frame_idx") + 1) * cfg.hop).cast("long").alias("length"))
    runs = fr.speech_runs(fr.voiced_by_median(frames, "energy"), cfg.hop)
    merged = fr.pad_and_merge(runs.join(sizes, "clip_id"), cfg.pad, "length")
    snr = fr.snr_from_speech(frames, merged, cfg.hop, cfg.sr)
    scored = fr.segment_score(fr.segment_energy(frames, merged, cfg.hop), cfg.sr)
    picked = fr.pick_top_segments(scored, int(cfg.want_seconds * cfg.sr), sizes)
    facts = sizes.join(snr, "clip_id", "left").withColumn("denoise", fr.denoise_policy_dual(F.col("snr_db")))
    return fr.clip_report(picked, facts)
