"""Spoken form of numbers, dates and units in Chinese text, and the tokens kept as they are.

All of it is column expressions. Rules put marks around the numbers and units they find, so that no later rule
reads them again, and one fold at the end says every marked piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numerals import ID_MARKS, MEASURE_WORDS, UNIT_NAMES, canonical_unit, plain_number, spell

# Patterns of what is read in a way of its own. Repeats of groups are possessive, so they take no stack.
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
WHOLE = r"[0-9]++(?:\.[0-9]++)?+"  # a number before what is no digit or point, where a shorter one never fits
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]*+"
WORD = r"[\p{L}\p{N}_]"
RUN = rf"[0-9A-Za-z]++(?:_[0-9A-Za-z]++)*+(?!{WORD})"
TOKEN = rf"(?<!{WORD}){RUN}(?:[.-]{RUN})*+"
AMOUNT_TOKEN = r"[0-9]+(?:\.[0-9]+)?[A-Za-z]+"
AT = "(?=[0-9])"  # before anything dearer is tried, which most characters then spare
START = f"{AT}(?<![0-9])"  # where a number found nowhere else begins: each run of digits is tried once
RANGE = rf"{AT}(?:(?<![A-Za-z0-9])|(?<=[A-Za-z][0-9]))({WHOLE}){SPACE}[-~—–]{SPACE}({NUMBER})(?![A-Za-z])"
# Only units are read in any case, as that makes each character dear; their first characters come before their names.
UNITS = "(?=[A-Za-z\u212a℃°µμΜ米千公])((?iu:" + "|".join(re.escape(u) for u in sorted(UNIT_NAMES, key=len, reverse=True)) + "))"
MEASURES = "|".join(sorted(MEASURE_WORDS, key=len, reverse=True))

# Private-use characters: both ends of a marked piece, its kinds, one for a character of this block in the text itself, and
# one for each character of a protected token.
MARK, FOREIGN, TOKENS, AS_NUMBER, AS_DIGITS, AS_BARE, AS_UNIT = (chr(0xE000 + k) for k in range(7))
TOKEN_CHARS = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._-"
HELD_CHARS = "".join(chr(0xE008 + k) for k in range(len(TOKEN_CHARS)))
BLOCK = f"[{MARK}-{HELD_CHARS[-1]}]"


def _mark(kind: str, group: int) -> str:
    return f"{MARK}{kind}${group}{MARK}"


def _number(group: int) -> str:
    return _mark(AS_NUMBER, group)


def _any_of(marks: str) -> Callable[[Column], Column]:
    return lambda t: reduce(lambda a, b: a | b, [t.contains(m) for m in marks])


#: What every unit's name holds, in any case: a letter (or one that folds to it), a sign or a slash.
UNIT_SIGNS = "[A-Za-z\u212a\u017f℃°/]"

#: Patterns, and their order: a later rule sees what the earlier ones have left. Rules stand in groups, each
#: beside what a text holds wherever one of its rules has something to find.
RULES: list[tuple[Callable[[Column], Column], list[tuple[str, str]]]] = [
    (_any_of("-"), [(rf"{AT}(?<!{WORD})([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}})(?!{WORD})", f"{_mark(AS_DIGITS, 1)}年{_number(2)}月{_number(3)}日")]),
    (_any_of("月"), [
        (rf"{AT}(?<![A-Za-z])([0-9]{{4}})年([0-9]{{1,2}})月([0-9]{{1,2}})日", f"{_mark(AS_DIGITS, 1)}年{_number(2)}月{_number(3)}日"),
        (rf"{AT}(?<![A-Za-z])([0-9]{{1,2}})月([0-9]{{1,2}})日", f"{_number(1)}月{_number(2)}日"),
    ]),
    (_any_of("时"), [(rf"{AT}(?<![A-Za-z])([0-9]{{1,2}})时([0-9]{{1,2}})分", f"{_number(1)}时{_number(2)}分")]),
    (_any_of("%"), [(rf"{START}({WHOLE}){SPACE}%", f"百分之{_number(1)}")]),
    (_any_of("-−~—–"), [(RANGE, "$1到$2"), (rf"[-−]{SPACE}({WHOLE}){SPACE}{UNITS}", f"负{_number(1)}{_mark(AS_UNIT, 2)}")]),
    (lambda t: t.rlike(UNIT_SIGNS), [
        (rf"{START}({WHOLE}){SPACE}{UNITS}", f"{_number(1)}{_mark(AS_UNIT, 2)}"),
        # the micro sign has no name; its letter counts as the text's own
        (rf"{MARK}{AS_UNIT}(µ[Mm]){MARK}", "$1"),
    ]),
    (_any_of("-"), [(rf"(?=-)(?<![A-Za-z0-9_])-({NUMBER})(?![A-Za-z%])", f"负{_number(1)}")]),
]
#: Marked pieces stay; a bare number before a measure word, after a mark of identifiers, or elsewhere.
BARE = (
    rf"(?=[0-9{MARK}])(?:({MARK}[^{MARK}]*+{MARK})|(?<![A-Za-z0-9_])(?:({WHOLE})(?={MEASURES})|(?<=[{ID_MARKS}])({NUMBER})(?![A-Za-z%])|({NUMBER})(?![A-Za-z%])))",
    f"$1{_number(2)}{_mark(AS_DIGITS, 3)}{_mark(AS_BARE, 4)}",
)
NOTHING = f"{MARK}[{AS_NUMBER}{AS_DIGITS}{AS_BARE}]{MARK}"  # left by the kinds of `BARE` that were not found


def _let(c: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a text, not null, that is computed once. It is joined, as getting an item asks the whole expression for its type in each row."""
    return F.array_join(F.transform(F.array(c), body), "")


def _fold(marked: Column, end: str, say: Callable[[Column], Column]) -> Column:
    """Every second piece between `end` is said, the others stay. One plain character is cut at without a pattern."""
    return F.array_join(F.transform(F.split(marked, end), lambda p, i: F.when(i % 2 == 1, say(p)).otherwise(p)), "")


def is_protected(token: Column) -> Column:
    """Letters and digits mixed, other than a number followed by letters."""
    return token.rlike("[A-Za-z]") & token.rlike("[0-9]") & ~token.rlike(f"^{AMOUNT_TOKEN}$")


def _hold(c: Column) -> Column:
    """Protected tokens in characters that no rule reads."""
    marked = F.regexp_replace(c, f"({TOKEN})", f"{TOKENS}$1{TOKENS}")
    return _fold(marked, TOKENS, lambda t: F.when(is_protected(t), F.translate(t, TOKEN_CHARS, HELD_CHARS)).otherwise(t))


def _say(piece: Column) -> Column:
    """A marked piece, by its kind. Numbers of more than 16 digits have no name and are read digit by digit."""
    is_a, body = piece.startswith, F.substring(piece, 2, 2**31 - 1)
    spelled = is_a(AS_DIGITS) | (is_a(AS_BARE) & ((F.length(body) > 4) | body.contains("."))) | ((F.length(body) > 16) & body.rlike("^0*[1-9][0-9]{16}"))
    return F.when(is_a(AS_UNIT), canonical_unit(body)).when(spelled, spell(body)).otherwise(plain_number(body))


def _ruled(out: Column, needed: Callable[[Column], Column], rules: list[tuple[str, str]]) -> Column:
    return _let(out, lambda t: F.when(needed(t), reduce(lambda s, rule: F.regexp_replace(s, *rule), rules, t)).otherwise(t))


def _spoken(c: Column) -> Column:
    """A group's patterns are run only on texts that hold what it needs, as most hold nothing for most rules."""
    lettered = c.rlike("[A-Za-z]")
    out = F.when(lettered, _hold(c)).otherwise(c)
    for group in RULES:
        out = _ruled(out, *group)
    out = F.regexp_replace(out, *BARE)
    out = F.regexp_replace(out, NOTHING, "")
    return _let(_fold(out, MARK, _say), lambda t: F.when(lettered, F.translate(t, HELD_CHARS, TOKEN_CHARS)).otherwise(t))


def _own_block(c: Column, own: Column) -> Column:
    """The text's own characters of the block, back in their places."""
    own = F.regexp_extract_all(own, F.lit(BLOCK), F.lit(0))
    return F.array_join(F.zip_with(F.split(c, FOREIGN), own, lambda p, o: F.concat(p, F.coalesce(o, F.lit("")))), "")


def normalize_text(c: Column | str) -> Column:
    """All rules in order; null stays null. Text without a digit stays: every rule needs one."""
    c = F.col(c) if isinstance(c, str) else c

    def said(t: Column) -> Column:
        held = t.rlike(BLOCK)
        spoken = _let(F.when(held, F.regexp_replace(t, BLOCK, FOREIGN)).otherwise(t), _spoken)
        return F.when(t.rlike("[0-9]"), _let(spoken, lambda s: F.when(held, _own_block(s, t)).otherwise(s))).otherwise(t)

    return F.when(c.isNotNull(), _let(c, said))


def ranges_to_words(c: Column) -> Column:
    """`a-b` becomes `a到b`, as a stand-alone expression."""
    return F.regexp_replace(c, RANGE, "$1到$2")


def protected_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each protected token of `text`, with its position among them, beside the other columns."""
    kept = F.filter(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), is_protected)
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(kept).alias("token_pos", "token"))
