"""Chinese numerals and unit names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, places within four digits, names of the groups of four.
DIGITS = "零一二三四五六七八九"
PLACES = ("千", "百", "十", "")
GROUPS = ("", "万", "亿", "兆")

# Spoken names of units.
UNIT_NAMES = {
    "℃": "摄氏度", "°c": "摄氏度", "°C": "摄氏度", "°": "度",
    "m/s": "米每秒", "km/h": "千米每小时", "km/s": "千米每秒",
    "米/秒": "米每秒", "千米/小时": "千米每小时", "千米/秒": "千米每秒", "公里/小时": "千米每小时", "公里/秒": "千米每秒",
    "ml": "毫升", "mL": "毫升", "l": "升", "L": "升",
    "km": "千米", "m": "米", "cm": "厘米", "mm": "毫米", "um": "微米", "μm": "微米",
    "kg": "千克", "g": "克", "mg": "毫克", "t": "吨",
    "hz": "赫兹", "khz": "千赫兹", "mhz": "兆赫兹", "ghz": "吉赫兹",
    "v": "伏", "a": "安", "w": "瓦", "kb": "千比", "mb": "兆比", "gb": "吉比",
}

# Words that, right of a number, make it a quantity.
MEASURE_WORDS = (
    "年 月 日 号 周 天 小时 时 分钟 分 秒 岁 级 层 人 台 件 个 位 次 条 只 张 本 辆 处 口 倍 页"
    " 米 千米 公里 厘米 毫米 升 毫升 千克 克 吨 寸 英寸 元 块 美元 欧元 日元 韩元 卢比 分辨率"
).split()

# What stands before a number that is an identifier.
ID_MARKS = "：:、「【"


def _unsigned(c: Column) -> Column:
    return F.when(c.startswith("-"), F.substring(c, 2, 2**31 - 1)).otherwise(c)


def spell(c: Column) -> Column:
    """Digit by digit; a point is 点, other characters stay."""
    return F.translate(c, "0123456789.", DIGITS + "点")


def digits_to_chinese(c: Column) -> Column:
    """Digit by digit; a leading minus is 负, a point 点, other characters stay."""
    return F.concat(F.when(c.startswith("-"), "负").otherwise(""), spell(_unsigned(c)))


def _within_thousand(begun: bool) -> list[str]:
    """Names of 0 to 999: after other places 0 has none and places left out are 零, as a whole 10 to 19 go without 一."""
    names = []
    for n in range(1000):
        digits = f"{n:03d}" if begun else str(n)
        said = "".join((DIGITS[int(d)] + p if d != "0" else "0") for d, p in zip(digits, PLACES[-len(digits) :], strict=True)).rstrip("0")
        said = said.replace("00", "0").replace("0", DIGITS[0])
        names.append(said if begun else said.removeprefix("一") if 10 <= n < 20 else said or DIGITS[0])
    return names


def _one_of(names: list[str], n: Column) -> Column:
    """The name at `n`. The names are constant, so their array is made once a query."""
    return F.get(F.split(F.lit(",".join(names)), ","), n.cast("int"))


def _div(n: Column, by: int) -> Column:
    return F.call_function("div", n, F.lit(by))


def _group_name(n: Column) -> Column:
    """0 to 9,999; no name for 0."""
    thousands = _one_of(["", *(DIGITS[k] + PLACES[0] for k in range(1, 10))], _div(n, 1000))
    rest = _one_of(_within_thousand(begun=True), n % 1000)
    return F.when(n < 1000, F.ltrim(rest, F.lit(DIGITS[0]))).otherwise(F.concat(thousands, rest))


def _many(n: Column) -> Column:
    """From 10,000 on. Groups are joined without 零."""
    groups = F.array(*[F.struct((_div(n, 10_000**k) % 10_000).alias("n"), F.lit(name).alias("name")) for k, name in reversed(list(enumerate(GROUPS)))])
    said = F.array_join(F.transform(F.filter(groups, lambda g: g.n > 0), lambda g: F.concat(_group_name(g.n), g["name"])), "")
    return F.regexp_replace(said, "^一十", "十")


def _named(n: Column) -> Column:
    return F.when(n < 1000, _one_of(_within_thousand(begun=False), n)).when(n < 10_000, _group_name(n)).when(n.isNotNull(), _many(n))


def int_to_chinese(c: Column) -> Column:
    """Positional numerals; null from 10^16 on, which has no group name."""
    size = F.abs(c.cast("decimal(20,0)"))
    said = F.get(F.transform(F.array(F.when(size < 10**16, size).cast("long")), _named), 0)
    return F.concat(F.when((c < 0) & (size > 0), "负").otherwise(""), said)


def plain_number(c: Column) -> Column:
    """As `number_to_chinese`, of digits with at most one point within and up to 16 places before it, other than leading zeros."""
    point = c.contains(".")
    whole = F.when(point, F.substring_index(c, ".", 1)).otherwise(c)
    said = F.get(F.transform(F.array(F.substring(whole, -17, 17).cast("long")), _named), 0)
    return F.concat(said, F.when(point, F.concat(F.lit("点"), spell(F.substring_index(c, ".", -1)))).otherwise(""))


def number_to_chinese(c: Column) -> Column:
    """A decimal string: the integer part as a number, 点, the fraction digit by digit."""
    plain, point = _unsigned(c), F.instr(c, ".") > 0
    whole = int_to_chinese(F.substring_index(plain, ".", 1).try_cast("decimal(20,0)"))
    fraction = F.translate(F.regexp_replace(F.substring(plain, F.instr(plain, ".") + 1, F.length(plain)), "[^0-9]", ""), "0123456789", DIGITS)
    return F.concat(F.when(c.startswith("-"), "负").otherwise(""), whole, F.when(point, F.concat(F.lit("点"), fraction)).otherwise(""))


def canonical_unit(c: Column) -> Column:
    """The unit's spoken name: as written, else in lower case, else the unit itself."""
    names = F.str_to_map(F.lit(";".join(f"{u}={name}" for u, name in UNIT_NAMES.items())), F.lit(";"), F.lit("="))
    return F.coalesce(F.try_element_at(names, c), F.try_element_at(names, F.lower(c)), c)


def number_reading(num: Column, left: Column, right: Column) -> Column:
    """`number` or `digits`, from the number and the text on both sides."""
    measured = right.rlike("^(" + "|".join(MEASURE_WORDS) + ")")
    pointed = F.instr(num, ".") > 0
    known_id = (~pointed & (F.length(num) >= 5)) | left.rlike(f"[{ID_MARKS}]$")
    return F.when(measured, "number").when(known_id, "digits").when(~pointed & (F.length(num) <= 4), "number").otherwise("digits")
