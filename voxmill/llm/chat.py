"""Chat formatting from event logs, with DataFrame functions only.

A log row is (conv_id, turn, seq, kind, role, text): kind `open` starts a message, `delta`
appends streamed text, `edit` replaces what the message holds, `regenerate` throws it away so
that the following deltas stream anew. Folding keeps, of each (conv_id, turn), what follows the
last edit or regeneration.

Template: `<|im_start|>` role newline text `<|im_end|>` newline. Inside roles and texts `&`
becomes `&amp;`, `<` becomes `&lt;` and `[` becomes `&#91;` (role: newline `&#10;` too), so no
control string can appear there, and the escapes are undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
DELTA_CHARS = 256
PIECE_CHARS = 1024  # of a rendered conversation, from which spans are read
PLANTED_ID, PLANTED_TEXT = -7, "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def pieces(c: Column, chars: int) -> Column:
    """The text in pieces of `chars` code points (the last may be shorter), cut in one pass; none of an empty text."""
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))


def turn_log(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """Finished turns as the log a streaming server writes: one open row, then deltas in order.

    Null texts count as empty and null roles as the empty role. Several rows of one turn are
    separate messages, ordered by role and text.
    """
    own = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("part", F.row_number().over(own))
    said = F.concat(F.array(F.lit("")), pieces(F.col("text"), delta_chars))
    steps = rows.select("conv_id", "turn", "part", "role", F.posexplode(said).alias("seq", "text"))
    return steps.select("conv_id", "turn", "part", "seq", F.when(F.col("seq") == 0, "open").otherwise("delta").alias("kind"), "role", "text")


def fold_messages(log: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text): the final text of each message.

    Deltas before the last edit or regeneration are void; the role is the first one logged.
    Events that share a seq are ordered by kind and text. A message regenerated and never
    streamed again is empty. The deltas of one message meet in one task, as its text must.
    """
    message = ["conv_id", "turn", "part"]
    order = Window.partitionBy(*message).orderBy("seq", "kind", "text")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = log.withColumn("_at", F.row_number().over(order))
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("_at"))).over(whole)
    live = at.withColumn("_reset", F.coalesce(reset, F.lit(0)))
    says = F.when((F.col("_at") >= F.col("_reset")) & F.col("kind").isin("delta", "edit"), F.struct("_at", F.coalesce("text", F.lit("")).alias("t")))
    folded = live.groupBy(*message).agg(F.sort_array(F.collect_list(says)).alias("_parts"), F.min_by("role", "_at").alias("role"))
    return folded.select(*message, F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.col("_parts.t"), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): the whole conversation as one text.

    loss_spans are [start, length] pairs in code points of `formatted` that cover the text of
    each assistant turn, in order. A conversation is one row, as its text must be; turns are
    laid out by running lengths before they are gathered.
    """
    order = ["turn", "part"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    turns = messages.select("conv_id", *order, "role", escape(F.col("text")).alias("_body"), head.alias("_head"))
    turns = turns.withColumn("_piece", F.concat("_head", "_body", F.lit(END + "\n")))
    turns = turns.withColumn("_start", F.coalesce(F.sum(F.char_length("_piece").cast("long")).over(before), F.lit(0)) + F.char_length("_head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("_start").alias("start"), F.char_length("_body").cast("long").alias("length")))
    gathered = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct(*order, "_piece"))).alias("_pieces"), F.sort_array(F.collect_list(span)).alias("loss_spans")
    )
    return gathered.select("conv_id", F.array_join(F.col("_pieces._piece"), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest of each conversation, taken from the rendered text and its loss spans alone.

    Spans are cut out of the pieces that hold them, so the work is linear in a conversation.
    """
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.greatest(F.size(F.split("formatted", r"<\|im_start\|>")) - 1, F.lit(0)))

    def plain(part: Column) -> Column:
        role = unescape(F.replace(F.substring_index(part, "\n", 1), F.lit("&#10;"), F.lit("\n")))
        body = part.substr(F.char_length(F.substring_index(part, "\n", 1)) + 2, F.char_length(part))
        body = body.substr(F.lit(1), F.char_length(body) - len(END) - 1)
        return F.concat(role, F.lit("\n"), unescape(body), F.lit("\n"))

    def cut(held: Column, span: Column) -> Column:
        first, skipped = F.floor(span["start"] / PIECE_CHARS).cast("int"), (span["start"] % PIECE_CHARS).cast("int")
        count = F.floor((skipped + span["length"]) / PIECE_CHARS).cast("int") + 1
        return F.array_join(F.slice(held, first + 1, count), "").substr(skipped + 1, span["length"].cast("int"))

    def spoken(held: Column) -> Column:
        return F.array_join(F.transform("loss_spans", lambda span: unescape(cut(held, span))), "")

    # The outer array has one element, so that the pieces are made once and not for each span.
    said = F.element_at(F.transform(F.array(pieces(F.col("formatted"), PIECE_CHARS)), spoken), 1)
    read = formatted.select("conv_id", F.transform(parts, plain).alias("_turns"), said.alias("_loss"), "formatted")
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("_turns", ""), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Log, fold and render whole conversations."""
    return render(fold_messages(turn_log(conversations)))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(PLANTED_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED_TEXT).alias("text"),
    )
    return read_back(format_conversations(given.unionByName(planted)))


#: Each turn is escaped one to one, so the digests are those of the plain turns.
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
OP8_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PLANTED_ID}, 0, 'user', '{PLANTED_TEXT}' UNION ALL SELECT {PLANTED_ID}, 1, 'assistant', '{PLANTED_TEXT}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format('text')}) + length(replace({_ESCAPED.format('role')}, chr(10), '&#10;'))
    + {len(START) + len(END) + 2}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
