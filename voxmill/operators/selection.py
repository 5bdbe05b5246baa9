"""Candidates of an utterance: planning, normalising inside the group, scoring and choosing.

All windows are over the utterance, so one exchange serves them all. `cand_idx` is the order of
the candidates; ties go to the lowest.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

W_WER, W_SIM, W_SPOOF = 0.4, 0.4, 0.2
#: Rows of one key that may stand in a task, and keys that may count as hot.
HELD_ROWS, MOST_HOT = 100_000, 10_000
#: Rows that a task sorts by group, and tasks from which on it takes up to five times as many: with more than 200 tasks to write for,
#: Spark's shuffle writers no longer stream what they read (spark.shuffle.sort.bypassMergeThreshold), but sort their split in memory.
TASK_ROWS, STREAMED = 250_000, 200


def _group(key: str):
    return Window.partitionBy(key)


def by_group(df: DataFrame, key: str = "utt", held: int = TASK_ROWS) -> DataFrame:
    """Rows dealt by group over so many tasks that each gets about `held`, in large tables up to five times as many, whatever the session's partitions.

    The windows here need no other exchange after it. The rows are counted first. A larger group stays whole.
    """
    rows, least = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, min(math.ceil(rows / held), STREAMED), math.ceil(rows / (5 * held))), key)


def plan_candidates(spark: SparkSession, tasks: DataFrame, backends: Sequence[tuple[str, int]], key: str = "utt") -> DataFrame:
    """One row for each task, backend and seed 0..k-1; the plan's few rows are part of the query text."""
    plan = [(b, s) for b, k in backends for s in range(k)]
    rows = F.array(*[F.struct(F.lit(i).alias("cand_idx"), F.lit(b).alias("backend"), F.lit(s).alias("seed"), F.lit(f"{b}_{s}").alias("tag")) for i, (b, s) in enumerate(plan)])
    return tasks.select(key, F.explode(rows).alias("c")).select(key, "c.*") if plan else tasks.select(key).limit(0)


def union_candidates(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def minmax(c: str, key: str = "utt", flat: float | None = 0.0, clip: bool = False) -> Column:
    """(x - min) / (max - min) in the group; a flat group gives `flat`, a null stays null there."""
    low, high = F.min(c).over(_group(key)), F.max(c).over(_group(key))
    scaled = (F.col(c) - low) / (high - low)
    if clip:
        scaled = F.when(scaled.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))  # greatest() passes over nulls
    return F.when(high > low, scaled).otherwise(F.lit(flat).cast("double"))


def minmax_in_group(df: DataFrame, cols: Sequence[str], key: str = "utt", flat: float | None = 0.0, clip: bool = False) -> DataFrame:
    return df.withColumns({f"{c}_norm": minmax(c, key, flat, clip) for c in cols})


def _runner_score(df: DataFrame, spoof_term: Column, key: str) -> DataFrame:
    varied = F.coalesce(F.max("cm").over(_group(key)) > F.min("cm").over(_group(key)), F.lit(False))
    clear, alike = 1 - F.col("wer_norm"), F.col("sim_norm")
    full = W_WER * clear + W_SIM * alike + W_SPOOF * spoof_term
    scored = minmax_in_group(df, ["wer", "sim", "cm"], key)
    return scored.withColumn("score", F.when(F.col("cm").isNull() | ~varied, 0.5 * (clear + alike)).otherwise(full))


def score_penalize_spoof(df: DataFrame, key: str = "utt") -> DataFrame:
    """cm is a spoof probability: high is bad. Without it, or where it is flat, the mean of the other two terms."""
    return _runner_score(df, 1 - F.col("cm_norm"), key)


def score_constant_spoof(df: DataFrame, key: str = "utt") -> DataFrame:
    """As above, with a spoof term of 0.5 whatever the value."""
    return _runner_score(df, F.lit(0.5), key)


def score_dynamic_weights(df: DataFrame, key: str = "utt") -> DataFrame:
    """cm is a bonafide probability: high is good. Flat or missing terms drop out with their weights; none left: null."""
    scored = minmax_in_group(df, ["wer", "sim", "cm"], key, flat=None, clip=True)
    terms = [(W_WER, 1 - F.col("wer_norm")), (W_SIM, F.col("sim_norm")), (W_SPOOF, F.col("cm_norm"))]
    total = reduce(lambda a, b: a + b, [F.coalesce(w * t, F.lit(0.0)) for w, t in terms])
    weight = reduce(lambda a, b: a + b, [F.when(t.isNull(), 0.0).otherwise(w) for w, t in terms])
    return scored.withColumn("score", F.when(weight > 0, total / weight))


def pick_best(df: DataFrame, score: str = "score", key: str = "utt") -> DataFrame:
    """The row with the highest score of each group."""
    order = _group(key).orderBy(F.col(score).desc_nulls_last(), "cand_idx")
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def mark_chosen(df: DataFrame, key: str = "utt") -> DataFrame:
    """`chosen` by score, null as -1; where a group has no score by similarity, else the first candidate.

    The least of a group needs no order inside it, so a task sorts its rows once, by the key. The row's number keeps
    one of several alike.
    """
    scores, sims = F.count("score").over(_group(key)), F.count("sim").over(_group(key))
    by = F.when(scores > 0, F.coalesce("score", F.lit(-1.0))).when(sims > 0, F.coalesce("sim", F.lit(-1.0))).otherwise(0.0).cast("double")
    marked = df.withColumns({"_by": by, "_row": F.monotonically_increasing_id()})
    best = F.min(F.struct(~F.isnan("_by"), -F.col("_by"), "cand_idx", "_row")).over(_group(key))  # not a number counts as the highest
    return marked.withColumn("chosen", F.col("_row") == best["_row"]).drop("_by", "_row")


def pick_best_with_fallback(df: DataFrame, key: str = "utt") -> DataFrame:
    return mark_chosen(df, key).where("chosen").drop("chosen")


def single_candidate_shortcut(df: DataFrame, asr_on: bool, spoof_on: bool, key: str = "utt") -> DataFrame:
    """With recognition and spoof scoring off, the metrics of a lone candidate are null: it wins unscored."""
    if asr_on or spoof_on:
        return df
    lone = F.count(F.lit(1)).over(_group(key)) == 1
    return df.withColumn("_lone", lone).withColumns({c: F.when(~F.col("_lone"), F.col(c)) for c in ("wer", "sim", "cm")}).drop("_lone")


def first_on_scoring_failure(df: DataFrame, failed: str = "failed", key: str = "utt") -> tuple[DataFrame, DataFrame]:
    """Winners by `score`, but candidate 0 of a group in which scoring failed; and an error row for each such group."""
    broken = F.max(F.coalesce(F.col(failed), F.lit(False))).over(_group(key))
    order = _group(key).orderBy(F.when(F.col("_broken"), None).otherwise(F.col("score")).desc_nulls_last(), "cand_idx")
    ranked = df.withColumn("_broken", broken).withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    errors = ranked.where("_broken").select(key, F.lit("Scoring").alias("stage"), F.lit("scoring failed").alias("error"))
    return ranked.drop("_broken", "_rank"), errors


def score_log(df: DataFrame, key: str = "utt") -> DataFrame:
    """Every candidate with its normalised metrics, score and whether it was chosen."""
    return mark_chosen(score_dynamic_weights(df, key), key)


def score_lines(df: DataFrame, key: str = "utt") -> DataFrame:
    """One text line for each candidate: three decimals, NA for null."""
    shown = lambda c: F.when(F.col(c).isNull(), "NA").otherwise(F.format_string("%.3f", F.col(c)))
    # The names in a line.
    fields = [("utt", F.col(key).cast("string")), ("model", F.coalesce("tag", F.lit("NA"))), ("WER", shown("wer")), ("SIM", shown("sim")), ("AASIST", shown("cm")), ("TOTAL", shown("score"))]
    line = F.concat_ws(" | ", *[F.concat(F.lit(f"{n}="), v) for n, v in fields])
    return df.select(key, "cand_idx", line.alias("line"))


def losing_candidates(df: DataFrame, key: str = "utt") -> DataFrame:
    """All candidates but the chosen one of each group."""
    return mark_chosen(df, key).where(~F.col("chosen")).drop("chosen")


def hot_shares(df: DataFrame, key: str, held: int = HELD_ROWS, most: int = MOST_HOT) -> DataFrame:
    """(key, _shares): keys with more than `held` rows, and more than a `most`-th of all, and in how many shares their rows go.

    There are fewer than `most` of them, whatever the table's size. A null key is one of them too.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    limit = F.greatest(F.lit(held), F.coalesce(counts.agg(F.sum("_n")).scalar() / most, F.lit(0)))
    return counts.where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / held).cast("int").alias("_shares"))


def speaker_similarity(cands: DataFrame, refs: DataFrame, key: str = "utt", missing: float | None = 0.0, held: int = HELD_ROWS) -> DataFrame:
    """`sim`: dot product of each candidate's `vector` and its utterance's `ref_vector`, both normalised here.

    An utterance of more than `held` candidates is cut into shares of about that size by a hash of the row, and
    its reference goes to each share, so no task holds a hot utterance. Rows alike in all columns stay together.
    Without a reference, or with a null key, `sim` is `missing`; several references give as many rows.
    """
    from ..functions.metrics import dot, l2_normalize

    hot = F.broadcast(hot_shares(cands, key, held))  # fewer than MOST_HOT rows
    same = lambda a, b: F.col(f"{a}.{key}").eqNullSafe(F.col(f"{b}.{key}"))
    own = refs.select(key, l2_normalize(F.col("ref_vector")).alias("_ref"))
    dealt = cands.alias("c").join(hot.alias("h"), same("c", "h"), "left")
    share = F.pmod(F.xxhash64(*[F.col(f"c.`{c}`") for c in cands.columns]), F.coalesce("h._shares", F.lit(1))).cast("int")
    dealt = dealt.select("c.*", share.alias("_share"))
    shares = F.sequence(F.lit(0), F.coalesce("h._shares", F.lit(1)) - 1)
    copied = own.alias("c").join(hot.alias("h"), same("c", "h"), "left").select("c.*", F.explode(shares).alias("_share"))
    joined = dealt.join(copied, [key, "_share"], "left")
    sim = F.coalesce(dot(l2_normalize(F.col("vector")), F.col("_ref")), F.lit(missing).cast("double"))
    return joined.select(*cands.columns, sim.alias("sim"))


def hypothesis_from_segments(segments: DataFrame, key: str = "clip_id", order: str = "pos", text: str = "text") -> DataFrame:
    """The segments of each clip in order, joined without a separator and stripped."""
    from ..functions.text import strip

    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return segments.groupBy(key).agg(strip(F.array_join(parts[text], "")).alias("hypothesis"))
