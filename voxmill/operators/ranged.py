"""Work on groups of any size: rows are dealt by ranges of (group, order), so a hot group is cut over many tasks.

What crosses the borders of ranges (a running number, an open run) is settled on a few rows for each
task. Quantiles of hot groups narrow to their rank by counts, without buffering a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.runs import shared_folder
from .frames import CLIP

#: Rows of a group that may stand in one buffer.
HELD_ROWS = 100_000


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` read back from the shared checkpoint folder; what made it is not run again."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """`df` with the place of each row within its keys by `order`, from 0, as a long.

    (keys, order) should tell rows apart. Ranges are numbered by themselves and shifted by the rows of the key in the
    ranges before, of which there is one count for each (range, key).
    """
    spread = checkpointed(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))  # borders are drawn by a sample, once
    counts = spread.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_range", *keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range", *keys).orderBy(*order)
    own = spread.withColumn("_own", F.row_number().over(within))
    joined = own.alias("o").join(base.alias("b"), F.expr(" AND ".join(f"o.`{k}` <=> b.`{k}`" for k in ["_range", *keys])))
    return joined.select(*[F.col(f"o.`{c}`") for c in df.columns], (F.col("_base") + F.col("_own") - 1).alias(name))


def merged_intervals(df: DataFrame, gap: int = 0) -> DataFrame:
    """(clip_id, start, end) of intervals put together where one starts at most `gap` after the end before it.

    Takes (clip_id, start, end) whose ends ascend with their starts. Ranges of starts are merged one by one; of each only
    the first and the last result can go on in another range, so a second pass sees two rows a task. Repeated rows
    merge; null clips are a clip; no rows give none.
    """
    kind = dict(df.dtypes)[CLIP]
    ranged = df.select(CLIP, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).repartitionByRange(CLIP, "start").sortWithinPartitions(CLIP, "start", "end")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, first = None, True
        for b in batches:
            if held is not None:
                b = pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            codes = pd.factorize(b[CLIP], use_na_sentinel=False)[0]
            start, end = b["start"].to_numpy(), b["end"].to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (np.diff(codes) != 0) | (start[1:] > end[:-1] + gap)]))
            out = pd.DataFrame({CLIP: b[CLIP].to_numpy()[new], "start": start[new], "end": np.maximum.reduceat(end, new)})
            held, done = out.iloc[-1:], out.iloc[:-1]
            if len(done):
                yield done.assign(edge=np.arange(len(done)) == 0 if first else False)
                first = False
        if held is not None:
            yield held.assign(edge=True)

    local = checkpointed(ranged.mapInPandas(merge, f"{CLIP} {kind}, start long, end long, edge boolean"))
    order = Window.partitionBy(CLIP).orderBy("start", "end")
    edges = local.where("edge").withColumn("_new", F.coalesce((F.col("start") > F.lag("end").over(order) + gap).cast("int"), F.lit(1)))
    placed = edges.withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = placed.groupBy(CLIP, "_k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_k")
    return local.where("NOT edge").drop("edge").unionByName(stitched)


def speech_runs(df: DataFrame, hop: int) -> DataFrame:
    """`frames.speech_runs` for clips of any length: the runs of consecutive speech frames, in samples."""
    own = F.col("frame_idx").cast("long")
    runs = merged_intervals(df.where("is_speech").select(CLIP, own.alias("start"), own.alias("end")), 1)
    return runs.select(CLIP, (F.col("start") * hop).alias("start"), (F.col("end") * hop + hop).alias("end"))


def pad_and_merge(segs: DataFrame, pad: int, length: str | int) -> DataFrame:
    """`frames.pad_and_merge` for clips with any number of segments, none of which holds another."""
    size = F.col(length) if isinstance(length, str) else F.lit(length)
    padded = segs.select(CLIP, F.greatest(F.lit(0), F.col("start") - pad).alias("start"), F.least(size, F.col("end") + pad).alias("end"))
    return merged_intervals(padded, pad)


#: Parts of a round's approximate quantiles, and the accuracy they are asked for: ranks are off by less than a part.
PARTS, ACCURACY = 512, 4096


def _same(keys: Sequence[str]) -> Column:
    return F.expr(" AND ".join(f"l.`{k}` <=> r.`{k}`" for k in keys))


def _rows_of(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The values between the bounds of each wanted quantile, with `columns` of it."""
    met = rows.alias("l").join(wanted.alias("r"), _same(keys)).where("_v >= coalesce(lo, _v) AND _v <= coalesce(hi, _v)")
    return met.select(*[F.col(f"l.`{k}`") for k in keys], *columns, "_v")


def _narrowed(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One round: of each wanted quantile the bounds that hold its two ranks, or the values `a` and `b` at them."""
    by = [*keys, "q"]
    rank = lambda k: f"({k} - below) / greatest(n - 1, 1) * {PARTS}"
    inside = _rows_of(rows, wanted, keys, ["q", "k", "k2", "below", "n"])
    spread = F.array(*[F.lit(i / PARTS) for i in range(PARTS + 1)])
    cut = inside.groupBy(*by, "k", "k2", "below", "n").agg(F.percentile_approx("_v", spread, ACCURACY).alias("cuts"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    cut = cut.withColumns({"i": F.expr(f"greatest(0, CAST(floor({rank('k')}) AS INT) - 1)"), "j": F.expr(f"least({PARTS}, CAST(ceil({rank('k2')}) AS INT) + 1)")})
    cut = cut.select(*by, "k", "k2", "below", "n", "low", "high", F.expr("if(i = 0, low, cuts[i])").alias("from"), F.expr(f"if(j = {PARTS}, high, cuts[j])").alias("to"))
    met = _rows_of(rows, wanted, keys, ["q"]).alias("l").join(cut.alias("r"), _same(by)).select(*[F.col(f"r.`{c}`") for c in cut.columns], "_v")
    counted = met.groupBy(*cut.columns).agg(
        F.count_if(F.expr("_v < from")).alias("under"), F.count_if(F.expr("_v BETWEEN from AND to")).alias("within"), F.max(F.expr("if(_v < from, _v, NULL)")).alias("before"), F.min(F.expr("if(_v > to, _v, NULL)")).alias("after")
    )
    first, second = "k - below", "k2 - below"
    place = f"CASE WHEN {second} < under THEN 'under' WHEN {first} >= under + within THEN 'over' WHEN {first} >= under AND {second} < under + within THEN 'within' WHEN {first} < under THEN 'left' ELSE 'right' END"
    case = lambda **of: F.expr("CASE place " + " ".join(f"WHEN '{p}' THEN {v}" for p, v in of.items()) + " END")
    found = counted.withColumn("place", F.expr(place)).select(
        *by, "k", "k2",
        case(under="below", within="below + under", over="below + under + within", left="below", right="below").alias("below"), case(under="under", within="within", over="n - under - within", left="1L", right="1L").alias("n"),
        case(under="low", within="from", over="after", left="before", right="to").alias("lo"), case(under="before", within="to", over="high", left="from", right="after").alias("hi"), F.col("place").isin("left", "right").alias("split"),
    )
    ended = F.expr("split OR lo = hi")
    return found.select(*by, "k", "k2", "below", "n", "lo", "hi", F.when(ended, F.col("lo")).alias("a"), F.when(ended, F.col("hi")).alias("b"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column, qs: dict[str, float], held: int = HELD_ROWS) -> DataFrame:
    """One row for each group with its exact quantiles, interpolated as `percentile` does; nulls and NaN don't count.

    Groups of at most `held` values go to `percentile`. For larger ones each round takes an approximate range around the
    wanted ranks (a bounded sketch for each task) and counts the values below, inside and above it, until what is
    left is one value or at most `held`; a round leaves about a hundredth. What the rounds keep is a table of a few numbers
    for each hot group. Groups whose values are all null give nulls; no rows give none.
    """
    names, given = list(qs), list(keys)
    keys = [f"_key{i}" for i in range(len(given))]  # so that none clashes with the columns of a round
    rows = df.select(*[F.col(k).alias(c) for k, c in zip(given, keys, strict=True)], value.cast("double").alias("_v")).withColumn("_v", F.expr("if(isnan(_v), NULL, _v)"))
    own = [F.col(c).alias(k) for k, c in zip(given, keys, strict=True)]
    sizes = checkpointed(rows.groupBy(*keys).agg(F.count("_v").alias("n")))
    hot = sizes.where(F.col("n") > held)
    plain = [F.percentile("_v", qs[c]).alias(c) for c in names]
    if hot.isEmpty():
        return rows.groupBy(*keys).agg(*plain).select(*own, *names)
    small = rows.alias("l").join(hot.select(*keys).alias("r"), _same(keys), "left_anti").groupBy(*keys).agg(*plain)
    at = F.explode(F.array(*[F.struct(F.lit(c).alias("q"), ((F.col("n") - 1) * F.lit(float(qs[c]))).alias("at")) for c in names]))
    none = F.lit(None).cast("double")
    asked = hot.select(*keys, "n", at.alias("at")).select(*keys, "at.q", "at.at", F.floor("at.at").alias("k"), F.ceil("at.at").alias("k2"), "n")
    open_ = checkpointed(asked.select(*keys, "q", "k", "k2", F.lit(0).cast("long").alias("below"), "n", *[none.alias(c) for c in ("lo", "hi", "a", "b")]))
    done = open_.limit(0)
    while not open_.where(F.col("n") > held).isEmpty():
        step = checkpointed(_narrowed(rows, open_.where(F.col("n") > held), keys).unionByName(open_.where(F.col("n") <= held)))
        done, open_ = done.unionByName(step.where("a IS NOT NULL")), step.where("a IS NULL")
    last = _rows_of(rows, open_, keys, ["q", "k", "k2", "below"]).groupBy(*keys, "q", "k", "k2", "below").agg(F.sort_array(F.collect_list("_v")).alias("v"))
    done = done.select(*keys, "q", "a", "b").unionByName(last.select(*keys, "q", F.expr("v[CAST(k - below AS INT)]").alias("a"), F.expr("v[CAST(k2 - below AS INT)]").alias("b")))
    both = done.alias("l").join(asked.alias("r"), _same([*keys, "q"])).select(*[F.col(f"l.`{k}`") for k in keys], "l.q", "at", "a", "b")
    valued = both.select(*keys, "q", F.expr("if(a = b, a, (ceil(at) - at) * a + (at - floor(at)) * b)").alias("v"))
    return small.unionByName(valued.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == c, F.col("v"))).alias(c) for c in names])).select(*own, *names)


def placed(df: DataFrame, segs: DataFrame, hop: int) -> DataFrame:
    """The frames with the `_start` and `_end` of the segment that each starts in, or nulls; segments of a clip don't overlap.

    Frames and segments are dealt by ranges of time; each range is told the last segment before it.
    """
    frames = df.withColumn("_at", (F.col("frame_idx") * hop).cast("long"))
    marks = segs.select(CLIP, F.col("start").alias("_at"), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).alias("_seg"))
    both = frames.unionByName(marks, allowMissingColumns=True).withColumn("_frame", F.col("frame_idx").isNotNull())
    spread = checkpointed(both.repartitionByRange(CLIP, "_at", "_frame").withColumn("_range", F.spark_partition_id()))
    lasts = spread.groupBy("_range", CLIP).agg(F.max("_seg").alias("_last"))
    earlier = Window.partitionBy(CLIP).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = lasts.select("_range", CLIP, F.last("_last", ignorenulls=True).over(earlier).alias("_base"))
    within = Window.partitionBy("_range", CLIP).orderBy("_at", "_frame").rowsBetween(Window.unboundedPreceding, 0)
    own = spread.withColumn("_own", F.last("_seg", ignorenulls=True).over(within)).where("_frame")
    met = own.alias("l").join(base.alias("r"), _same(["_range", CLIP])).withColumn("_found", F.coalesce("_own", "_base"))
    inside = F.col("_at") < F.col("_found.end")
    return met.select(*[F.col(f"l.`{c}`") for c in df.columns], F.when(inside, F.col("_found.start")).alias("_start"), F.when(inside, F.col("_found.end")).alias("_end"))


def segment_energy(df: DataFrame, segs: DataFrame, hop: int) -> DataFrame:
    """`frames.segment_energy` for clips of any length."""
    held = placed(df, segs, hop).where("_end IS NOT NULL")
    return held.groupBy(CLIP, F.col("_start").alias("start"), F.col("_end").alias("end")).agg(F.avg("energy").alias("energy"))


def voiced_by_median(df: DataFrame, value: str = "rms", held: int = HELD_ROWS) -> DataFrame:
    """`frames.voiced_by_median` for clips of any length."""
    limits = exact_quantiles(df, [CLIP], F.col(value), {"_median": 0.5}, held)
    met = df.alias("l").join(limits.alias("r"), _same([CLIP]))
    return met.select("l.*", (F.col(f"l.`{value}`") >= F.greatest(F.lit(1e-4), 0.6 * F.col("_median"))).alias("is_speech"))


def snr_from_speech(df: DataFrame, segs: DataFrame, hop: int, sr: int, held: int = HELD_ROWS) -> DataFrame:
    """`frames.snr_from_speech` for clips of any length."""
    marked = placed(df, segs, hop).withColumn("_in", F.col("_end").isNotNull())
    sides = marked.groupBy(CLIP).agg(
        (F.count_if("_in") * hop).alias("_speech"), (F.count_if(~F.col("_in")) * hop).alias("_noise"),
        (F.avg(F.when(F.col("_in"), F.col("energy"))) + 1e-12).alias("_ps"), (F.avg(F.when(~F.col("_in"), F.col("energy"))) + 1e-12).alias("_pn"),
    )
    levels = exact_quantiles(df, [CLIP], F.sqrt("energy"), {"_q80": 0.8, "_q20": 0.2}, held)
    short = (F.col("_speech") < 0.2 * sr) | (F.col("_noise") < 0.2 * sr)
    snr = F.when(short, 20 * F.log10(F.col("_q80") / (F.col("_q20") + 1e-8))).otherwise(10 * F.log10(F.col("_ps") / F.col("_pn")))
    return sides.alias("l").join(levels.alias("r"), _same([CLIP])).select(F.col(f"l.{CLIP}"), snr.alias("snr_db"))


def snr_from_percentiles(bins: DataFrame, bin_col: str = "freq_hz", held: int = HELD_ROWS) -> DataFrame:
    """`frames.snr_from_percentiles` for clips of any length."""
    q = exact_quantiles(bins, [CLIP, bin_col], F.col("mag"), {"_low": 0.1, "_high": 0.9}, held)
    return q.groupBy(CLIP).agg((20 * F.log10(F.avg(F.col("_high") + 1e-9) / F.avg(F.col("_low") + 1e-9) + 1e-9)).alias("snr_db"))


def spectral_floor(bins: DataFrame, strength: float = 0.9, held: int = HELD_ROWS) -> DataFrame:
    """`frames.spectral_floor` for clips of any length."""
    floors = exact_quantiles(bins, [CLIP, "freq_hz"], F.col("mag") + 1e-8, {"_floor": 0.1}, held)
    met = bins.alias("l").join(floors.alias("r"), _same([CLIP, "freq_hz"]))
    return met.select("l.*", F.greatest(F.col("mag") + 1e-8 - strength * F.col("_floor"), F.lit(0.0)).alias("floored"))
