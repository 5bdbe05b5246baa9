"""Sentences, white space and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that always end a sentence, and marks that end one once it is long.
HARD, SOFT = "。！？!?", "，,、;；:："
# Unicode's white space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def strip_all_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s", "")


def split_sentences(c: Column, max_len: int = 80) -> Column:
    """Array of stripped, non-empty sentences: cut after a hard mark, after a soft one from `max_len` characters on.

    Hard marks first, and soft ones only in long pieces: classes of a few marks are found several times as fast as all
    characters but those are passed over.
    """
    long = F.lit(f"(?s).{{{max_len - 1}}}.*?[{SOFT}]|.+")
    cut = lambda p: F.when(F.length(p) < max_len, F.array(p)).otherwise(F.regexp_extract_all(p, long, F.lit(0)))
    pieces = F.flatten(F.transform(F.split(c, f"(?<=[{HARD}])"), cut))
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def estimate_duration(c: Column) -> Column:
    """Seconds of speech: 0.18 a visible character and 0.2 a hard mark, between 0.6 and 15."""
    shown = F.length(strip_all_space(c))
    marks = F.length(c) - F.length(F.regexp_replace(c, f"[{HARD}]", ""))
    return F.least(F.greatest(shown * F.lit(0.18) + marks * F.lit(0.2), F.lit(0.6)), F.lit(15.0))


def tail_window_seconds(c: Column) -> Column:
    """How much of the previous clip to match, from the look-back text."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0.6).otherwise(F.greatest(F.lit(0.4), F.least(F.lit(1.0), 0.2 + 0.1 * F.length(c))))
