"""The rules of the normaliser text by text, in plain Python: what the column expressions are held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from voxmill.functions.numerals import DIGITS, GROUPS, ID_MARKS, MEASURE_WORDS, PLACES, UNIT_NAMES

# Patterns of what is read in a way of its own.
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
TOKEN = r"\b[0-9A-Za-z]+(?:[._-][0-9A-Za-z]+)*\b"
AMOUNT_TOKEN = r"[0-9]+(?:\.[0-9]+)?[A-Za-z]+"
RANGE = rf"(?<![A-Za-z])({NUMBER})\s*[-~—–]\s*({NUMBER})(?![A-Za-z])"
BARE = rf"(?<![A-Za-z0-9_])({NUMBER})(?![A-Za-z%])"
UNITS = "|".join(re.escape(u) for u in sorted(UNIT_NAMES, key=len, reverse=True))

_TO_DIGITS = str.maketrans("0123456789.", DIGITS + "点")


def spoken_digits(s: str) -> str:
    return s.translate(_TO_DIGITS)


def spoken_number(s: str) -> str:
    """Integers of more than 16 digits have no name and are read digit by digit."""
    whole, point, fraction = s.partition(".")
    n = int(whole)
    if n >= 10**16:
        return spoken_digits(s)
    groups = []
    for name in GROUPS:
        n, group = divmod(n, 10_000)
        text = "".join(DIGITS[int(d)] + (p if d != "0" else "") for d, p in zip(f"{group:04d}", PLACES, strict=True))
        text = re.sub("零+", "零", text).strip("零")
        groups.append(text + name if text else "")
    said = re.sub("^一十", "十", "".join(reversed(groups))) or DIGITS[0]
    return said + ("点" + spoken_digits(fraction) if point else "")


def _unit(u: str) -> str:
    return UNIT_NAMES.get(u) or UNIT_NAMES.get(u.lower(), u)


def _bare(m: re.Match) -> str:
    number, left, right = m[1], m.string[: m.start()], m.string[m.end() :]
    if right.startswith(tuple(MEASURE_WORDS)):
        return spoken_number(number)
    if "." in number or len(number) > 4 or left.endswith(tuple(ID_MARKS)):
        return spoken_digits(number)
    return spoken_number(number)


def _date(m: re.Match) -> str:
    return f"{spoken_digits(m[1])}年{spoken_number(m[2])}月{spoken_number(m[3])}日"


#: In the order in which they apply: a later rule sees what the earlier ones have left.
RULES: list[tuple[re.Pattern, Callable[[re.Match], str]]] = [
    (re.compile(r"\b([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\b"), _date),
    (re.compile(r"(?<![A-Za-z])([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日"), _date),
    (re.compile(r"(?<![A-Za-z])([0-9]{1,2})月([0-9]{1,2})日"), lambda m: f"{spoken_number(m[1])}月{spoken_number(m[2])}日"),
    (re.compile(r"(?<![A-Za-z])([0-9]{1,2})时([0-9]{1,2})分"), lambda m: f"{spoken_number(m[1])}时{spoken_number(m[2])}分"),
    (re.compile(rf"({NUMBER})\s*%"), lambda m: "百分之" + spoken_number(m[1])),
    (re.compile(RANGE), lambda m: f"{m[1]}到{m[2]}"),
    (re.compile(rf"[-−]\s*({NUMBER})\s*({UNITS})", re.IGNORECASE), lambda m: "负" + spoken_number(m[1]) + _unit(m[2])),
    (re.compile(rf"({NUMBER})\s*({UNITS})", re.IGNORECASE), lambda m: spoken_number(m[1]) + _unit(m[2])),
    (re.compile(rf"(?<![A-Za-z0-9_])-({NUMBER})(?![A-Za-z%])"), lambda m: "负" + spoken_number(m[1])),
    (re.compile(BARE), _bare),
]
_TOKEN, _AMOUNT = re.compile(TOKEN), re.compile(AMOUNT_TOKEN)


def is_protected(token: str) -> bool:
    """Letters and digits mixed, other than a number followed by letters."""
    return bool(re.search("[A-Za-z]", token) and re.search("[0-9]", token)) and not _AMOUNT.fullmatch(token)


def normalize(text: str) -> str:
    if not re.search("[0-9]", text):
        return text  # every rule needs a digit
    mark = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in text)
    held: list[str] = []

    def hold(m: re.Match) -> str:
        if not is_protected(m[0]):
            return m[0]
        held.append(m[0])
        return mark

    text = _TOKEN.sub(hold, text)
    for pattern, say in RULES:
        text = pattern.sub(say, text)
    back = iter(held)
    return re.sub(mark, lambda _: next(back), text)
