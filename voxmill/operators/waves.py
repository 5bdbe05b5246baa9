"""Waveform columns: arrays of samples in, arrays of samples out, one row at a time and narrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sentences import timeline_rows

SAMPLES = "array<float>"
TARGET_DB = -23.0
#: Samples that are transformed together, and places of one correlation that are weighed one by one.
PADDED, TIES = 1 << 20, 8
#: Samples in a row of a joined clip.
BLOCK = 65_536


def _each(change: Callable[..., np.ndarray], *columns: Column) -> Column:
    """Apply `change` to each row's samples (and further columns), in doubles, in Arrow batches; null stays null."""

    @F.pandas_udf(SAMPLES)
    def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
        out = []
        for row in zip(first, *rest, strict=True):
            out.append(None if row[0] is None else np.asarray(change(np.array(row[0], np.float64), *row[1:]), np.float32))
        return pd.Series(out)

    return run(*columns)


def to_mono(samples: Column, channels: Column) -> Column:
    return _each(lambda y, n: y if n < 2 else y[: len(y) // n * n].reshape(-1, n).mean(1), samples, channels)


def trim_seconds(samples: Column, sr: Column, seconds: float = 60.0) -> Column:
    """The first round(seconds * sr) samples where the clip is longer than that by over a microsecond."""
    kept = F.rint(F.lit(seconds) * sr).cast("int")
    return F.when(F.size(samples) / sr > seconds + 1e-6, F.slice(samples, F.lit(1), kept)).otherwise(samples)


def _level(db: float) -> float:
    return 10 ** (db / 20)


def rms_gain(samples: Column, target: float = TARGET_DB) -> Column:
    """To the target level, clipped to [-1, 1]."""
    return _each(lambda y: np.clip(y * (_level(target) / np.sqrt(np.mean(y**2) + 1e-9)), -1, 1) if len(y) else y, samples)


def rms_normalize(samples: Column, target: float = TARGET_DB) -> Column:
    return _each(lambda y: y * (_level(target) / (np.sqrt(np.mean(y**2)) + 1e-12)) if len(y) else y, samples)


def peak_limit(samples: Column, target: float = -3.0) -> Column:
    """Scaled down where the peak is above the target."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double")))) + 1e-9
    limit = _level(target)
    return F.when(peak > limit, F.transform(samples, lambda x: (x.cast("double") * (F.lit(limit) / peak)).cast("float"))).otherwise(samples)


def faded(y: np.ndarray, n: int, mode: str = "skip") -> np.ndarray:
    """Linear in and out over n samples: `skip` if it does not fit twice, or n cut to a `half` or `third` of the clip."""
    y = y.copy()
    if mode == "skip":
        n = max(1, n)
        if len(y) < 2 * n:
            return y
    else:
        n = min(n, len(y) // {"half": 2, "third": 3}[mode])
        if n <= 0:
            return y
    ramp = np.linspace(0, 1, n)
    y[:n] *= ramp
    y[-n:] *= ramp[::-1]
    return y


def fade(samples: Column, sr: Column, ms: float = 10, mode: str = "skip") -> Column:
    return _each(lambda y, rate: faded(y, int(rate * ms / 1000), mode), samples, sr)


def overlapped(pieces: list[np.ndarray], overlap: int, equal_power: bool) -> np.ndarray:
    """Pieces one after another, each laid over the end of what there is."""
    out = np.zeros(sum(map(len, pieces)), np.float64)
    at = 0
    for k, piece in enumerate(pieces):
        n = 0
        if k:
            n = min(overlap, at, len(piece)) if equal_power else overlap * (at > overlap < len(piece))
        if n:
            t = np.linspace(0, 1, n)
            fall, rise = (np.cos(t * np.pi / 2), np.sin(t * np.pi / 2)) if equal_power else (1 - t, t)
            out[at - n : at] = out[at - n : at] * fall + piece[:n] * rise
        out[at : at + len(piece) - n] = piece[n:]
        at += len(piece) - n
    return np.clip(out[:at], -1, 1)


def join_pieces(df: DataFrame, sr: int, ms: float, equal_power: bool, key: str = "utt", order: str = "pos", samples: str = "samples") -> DataFrame:
    """One clip for each key, its pieces in order; a clip's pieces meet in one row, as the clip must."""
    gathered = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, samples)))[samples].alias("_p"))
    n = int(sr * ms / 1000)

    @F.pandas_udf(SAMPLES)
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([overlapped([np.asarray(p, np.float64) for p in r if p is not None], n, equal_power).astype(np.float32) for r in rows])

    return gathered.select(key, run("_p").alias(samples))


def join_linear(df: DataFrame, sr: int, ms: float = 10, **names: str) -> DataFrame:
    return join_pieces(df, sr, ms, False, **names)


def join_equal_power(df: DataFrame, sr: int, ms: float = 60, **names: str) -> DataFrame:
    return join_pieces(df, sr, ms, True, **names)


def joined_blocks(df: DataFrame, sr: int, ms: float, equal_power: bool, block: int = BLOCK, key: str = "utt", order: str = "pos", at: str = "at", samples: str = "samples") -> DataFrame:
    """(key, block, samples): the clip that `join_pieces` makes, `block` samples a row, each laid by itself.

    A piece is (key, order) and comes in any number of rows, whose first samples stand `at` in it. Lengths alone are
    laid out by the key; samples meet by (key, block), in order of the pieces, and a task holds the
    samples of one block, however many pieces cover it. Null samples count as none; a null `at` is 0; a null
    key is a key; a clip without samples has no rows.
    """
    lap = int(sr * ms / 1000)
    given = df.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.coalesce(at, F.lit(0)).cast("long").alias("_at"), F.col(samples).cast(SAMPLES).alias("_y"))
    given = given.where(F.size("_y") > 0)
    sizes = given.groupBy("_key", "_order").agg(F.sum(F.size("_y")).alias("_n"))
    laid = timeline_rows(sizes, "_n", lap, equal_power, "_key", "_order")
    before = Window.partitionBy("_key").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("_lap", F.coalesce(F.max("end").over(before), F.col("start")) - F.col("start"))
    both = given.alias("g").join(laid.alias("l"), F.col("g._key").eqNullSafe(F.col("l._key")) & F.col("g._order").eqNullSafe(F.col("l._order")))
    first = F.col("start") + F.col("_at")
    last = first + F.size("_y") - 1
    cut = both.select("g._key", "g._order", "_at", "_lap", "_y", first.alias("_first"), F.explode(F.sequence(F.floor(first / block), F.floor(last / block))).alias("block"))
    skip = F.greatest(F.lit(0), F.col("block") * block - F.col("_first"))
    within = F.col("_first") + skip - F.col("block") * block
    taken = F.slice("_y", (skip + 1).cast("int"), (F.lit(block) - within).cast("int"))
    cut = cut.select("_key", "block", "_order", (F.col("_at") + skip).alias("_from"), within.alias("_place"), "_lap", taken.alias("_y"))
    dealt = cut.repartition("_key", "block").sortWithinPartitions("_key", "block", "_order", "_from")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind, out, size = None, None, np.zeros(block), 0
        done: list[tuple] = []

        def settle() -> None:
            if now is not None:
                done.append((*now, np.clip(out[:size], -1, 1).astype(np.float32)))

        def handed() -> pa.RecordBatch:
            keys, blocks, values = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(blocks, pa.int64()), pa.array(values, pa.list_(pa.float32()))], ["_key", "block", "_y"])

        for b in batches:
            kind = b.schema.field("_key").type
            for k, n, start, place, n_lap, y in zip(*(b.column(c).to_pylist() for c in ("_key", "block", "_from", "_place", "_lap")), b.column("_y"), strict=True):
                if now != (k, n):
                    settle()
                    if len(done) * block >= PADDED:
                        yield handed()
                    now, size = (k, n), 0
                    out[:] = 0
                y = y.values.to_numpy(zero_copy_only=False)
                i = np.arange(start, start + len(y))
                t = np.minimum(i, n_lap) / max(n_lap - 1, 1)
                fall, rise = (np.cos(t * np.pi / 2), np.sin(t * np.pi / 2)) if equal_power else (1 - t, t)
                held = out[place : place + len(y)]
                out[place : place + len(y)] = np.where(i < n_lap, held * fall + y * rise, y)
                size = max(size, place + len(y))
        settle()
        if done:
            yield handed()

    kind = dict(dealt.dtypes)["_key"]
    return dealt.mapInArrow(lay, f"_key {kind}, block long, _y {SAMPLES}").select(F.col("_key").alias(key), "block", F.col("_y").alias(samples))


def head_cut_by_chars(sr: Column, chars: Column) -> Column:
    return F.floor(sr * F.greatest(F.lit(0.0), chars * F.lit(0.12) + F.lit(0.06))).cast("int")


def trim_head_by_chars(samples: Column, sr: Column, chars: Column) -> Column:
    """Without the seconds that so many characters take; unchanged where nothing would go, or all."""
    cut = head_cut_by_chars(sr, chars)
    return F.when((cut > 0) & (cut < F.size(samples)), F.slice(samples, cut + 1, F.size(samples))).otherwise(samples)


def first_peaks(heads: list[np.ndarray], befores: list[np.ndarray]) -> list[int]:
    """Where each `before` correlates best within its `head`, the first place of several.

    Rows of one padded size are transformed together, at most PADDED samples at a time: n log n in a head's samples.
    Places within the transform's rounding of the largest are told apart by their own dot products, and beyond
    TIES of them count as equal.
    """
    sizes = [1 << (len(h) - 1).bit_length() for h in heads]
    out = [0] * len(heads)
    for size in sorted(set(sizes)):
        rows = [k for k, n in enumerate(sizes) if n == size]
        step = max(1, PADDED // size)
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            both = np.zeros((2, len(part), size))
            for r, k in enumerate(part):
                both[0, r, : len(heads[k])], both[1, r, : len(befores[k])] = heads[k], befores[k]
            waves = np.fft.rfft(both)
            # Circular, but nothing wraps at the places where a whole `before` lies inside its head.
            dots = np.fft.irfft(waves[0] * np.conj(waves[1]), size)
            for r, k in enumerate(part):
                head, before = heads[k], befores[k]
                valid = dots[r, : len(head) - len(before) + 1]
                near = np.flatnonzero(valid >= valid.max() - 1e-12 * np.linalg.norm(head) * np.linalg.norm(before))
                if 1 < len(near) <= TIES:
                    exact = [float(head[p : p + len(before)] @ before) for p in near]
                    near = near[np.argmax(exact) :]
                out[k] = int(near[0]) if len(near) else 0
    return out


def best_alignments(rows: list[tuple | None], least: float = 0.35) -> list[int | None]:
    """For rows of (before, head, hop, tail, sr, length): samples to cut so that `head` starts where the envelope
    `before` ends in it. None where they don't match, where a row is None, and where a value is not finite."""

    def usable(before: np.ndarray, head: np.ndarray, hop: int, tail: int, sr: int, length: int) -> bool:
        if tail < int(0.15 * sr) or length < int(0.2 * sr) or not 0 < len(before) < len(head) - 2:
            return False
        return bool(np.isfinite(before).all() and np.isfinite(head).all())

    kept = [k for k, row in enumerate(rows) if row is not None and usable(*row)]
    peaks = first_peaks([rows[k][1] for k in kept], [rows[k][0] for k in kept])
    out: list[int | None] = [None] * len(rows)
    for k, at in zip(kept, peaks, strict=True):
        before, head, hop, tail, sr, length = rows[k]
        window = head[at : at + len(before)]
        if float(window @ before / (np.linalg.norm(window) * np.linalg.norm(before) + 1e-8)) >= least:
            out[k] = max(0, min(at * hop + tail - int(0.02 * sr), length - 1))
    return out


def best_alignment(before: np.ndarray, head: np.ndarray, hop: int, tail: int, sr: int, length: int, least: float = 0.35) -> int | None:
    return best_alignments([(before, head, hop, tail, sr, length)], least)[0]


def align_cut(before: Column, head: Column, hop: Column, tail: Column, sr: Column, length: Column) -> Column:
    @F.pandas_udf("long")
    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns, strict=True)
        given = [None if b is None or h is None or any(pd.isna(x) for x in r) else (np.asarray(b, float), np.asarray(h, float), *map(int, r)) for b, h, *r in rows]
        return pd.Series(best_alignments(given), dtype="Int64")

    return run(before, head, hop, tail, sr, length)


def lookback_cut(aligned: Column, sr: Column, chars: Column, length: Column) -> Column:
    """The aligned cut where it lies inside the clip, else the one by characters, else 0."""
    fits = aligned.isNotNull() & (aligned > 0) & (aligned < length)
    by_chars = head_cut_by_chars(sr, chars)
    return F.when(fits, aligned).when((chars > 0) & (by_chars > 0) & (by_chars < length), by_chars).otherwise(0).cast("long")


def tone(seconds: Column, sr: int = 16000, freq: float = 440.0) -> Column:
    n = F.greatest(F.floor(seconds * sr), F.lit(0)).cast("int")
    wave = F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), lambda i: (0.1 * F.sin(2 * np.pi * freq * i / sr)).cast("float"))
    return fade(wave, F.lit(sr), 50)


def dither(samples: Column, seed: Column, scale: float = 1e-4) -> Column:
    """A little Gaussian noise, the same for the same seed."""
    return _each(lambda y, s: np.clip(y + scale * np.random.default_rng(abs(int(s))).standard_normal(len(y)), -1, 1), samples, seed)


def duration_seconds(samples: Column, sr: Column) -> Column:
    return F.size(samples) / sr
