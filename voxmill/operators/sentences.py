"""Sentence rows, look-back context and the timeline of joined pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_sentences


def explode_sentences(df: DataFrame, text: str = "text", max_len: int = 80) -> DataFrame:
    """(others, pos, sentence). The cut stands in the generator: from a column Spark infers filters that would cut each text again."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(split_sentences(F.col(text), max_len)).alias("pos", "sentence"))


def sentence_plan(df: DataFrame, text: str = "text", max_len: int = 80, look_back: int = 8) -> DataFrame:
    """(others, pos, sentence, context, in_text), built in the row before it is exploded: no shuffle."""
    others = [c for c in df.columns if c != text]
    split = df.select(*others, split_sentences(F.col(text), max_len).alias("_s"))
    before = lambda i: F.when(i > 0, F.right(F.get(F.col("_s"), i - 1), F.lit(look_back)))
    rows = F.transform("_s", lambda s, i: F.struct(s.alias("sentence"), before(i).alias("context")))
    out = split.select(*others, F.posexplode(rows).alias("pos", "_r")).select(*others, "pos", "_r.*")
    return out.withColumn("in_text", F.concat(F.coalesce("context", F.lit("")), "sentence"))


def lookback_context(df: DataFrame, n: int = 8, key: str = "utt") -> DataFrame:
    """The same context for sentence rows that are already a table."""
    before = F.lag("sentence").over(Window.partitionBy(key).orderBy("pos"))
    out = df.withColumn("context", F.right(before, F.lit(n)))
    return out.withColumn("in_text", F.concat(F.coalesce("context", F.lit("")), "sentence"))


def timeline(lengths: Column, overlap: int, equal_power: bool = True) -> Column:
    """Array of (start, end) of joined pieces, from an array of their lengths in samples.

    For short arrays, whose spans are copied at each step; `timeline_rows` is linear in the pieces.

    Equal power: a piece overlaps by min(overlap, what is there, its own length). Linear: by
    `overlap` if both are longer than that, else it is appended.
    """

    def step(acc: Column, n: Column) -> Column:
        total = acc["total"]
        first = F.size(acc["spans"]) == 0
        shared = F.least(F.lit(overlap).cast("long"), total, n) if equal_power else F.when((total > overlap) & (n > overlap) & (F.lit(overlap) > 0), F.lit(overlap)).otherwise(0).cast("long")
        start = F.when(first, F.lit(0).cast("long")).otherwise(total - shared)
        span = F.array(F.struct(start.alias("start"), (start + n).alias("end")))
        return F.struct(F.concat(acc["spans"], span).alias("spans"), F.greatest(total, start + n).alias("total"))

    empty = F.struct(F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(F.transform(lengths, lambda n: n.cast("long")), empty, step, lambda acc: acc["spans"])


def timeline_rows(df: DataFrame, length: str, overlap: int, equal_power: bool = True, key: str = "utt", order: str = "pos") -> DataFrame:
    """`start` and `end` of each row's piece, as `timeline` gives them; a null length counts as 0.

    What is there before a piece reaches the overlap as soon as one piece (equal power) or all together
    (linear) do, so running maxima and sums in one sort of the key are enough.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n, lap = F.coalesce(F.col(length), F.lit(0)).cast("long"), F.lit(overlap).cast("long")
    earlier = lambda total: F.coalesce(total.over(before), F.lit(0).cast("long"))
    shared = F.least(lap, earlier(F.max(n)), n) if equal_power else F.when((earlier(F.sum(n)) > lap) & (n > lap), lap).otherwise(F.lit(0).cast("long"))
    laid = df.withColumn("_shared", shared)
    start = earlier(F.sum(n - F.col("_shared"))) - F.col("_shared")
    return laid.withColumn("start", start).withColumn("end", F.col("start") + n).drop("_shared")
