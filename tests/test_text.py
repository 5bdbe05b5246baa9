"""Numerals, normaliser, sentences, durations: golden values."""

import random
import time

import plain_normalizer
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxmill.functions import normalize, numerals, text
from voxmill.operators import sentences

SPOKEN = [
    # dates and times
    ("会议在 1998-7-21 举行", "会议在 一九九八年七月二十一日 举行"), ("1066年10月14日开战", "一零六六年十月十四日开战"), ("7月1日放假", "七月一日放假"), ("闹钟定在6时45分", "闹钟定在六时四十五分"),
    # shares, ranges, signs
    ("电量剩 8 %", "电量剩 百分之八"), ("涨幅0.5%", "涨幅百分之零点五"), ("等7~10天", "等七到十天"), ("冷库保持-18℃", "冷库保持负十八摄氏度"), ("海拔 -154。", "海拔 负一百五十四。"), ("夜里-4-9℃", "夜里负四到九摄氏度"),
    # numbers with units, as written or in another case
    ("背包重12kg", "背包重十二千克"), ("全长42.195KM", "全长四十二点一九五千米"), ("风速6m/s", "风速六米每秒"), ("主频3GHz", "主频三吉赫兹"),
    # bare numbers: quantities, identifiers, long ones, decimals
    ("来了1203人", "来了一千二百零三人"), ("工号：4417", "工号：四四一七"), ("约100500，", "约一零零五零零，"), ("100500台", "十万五百台"), ("圆周率3.14", "圆周率三点一四"), ("标价 9.90元", "标价 九点九零元"),
    # tokens of letters and digits stay, and so does text without numbers
    ("把 MP3 和 B-52 交给 R2D2 看", "把 MP3 和 B-52 交给 R2D2 看"), ("接 HDMI2.1 线", "接 HDMI2.1 线"), ("Q4年报", "Q4年报"), ("没有数字", "没有数字"), ("3 little pigs", "三升ittle pigs"), ("", ""),
]


@pytest.mark.parametrize("given_text,expected", SPOKEN)
def test_normalize(given_text, expected):
    assert plain_normalizer.normalize(given_text) == expected


def test_normalize_column(spark):
    rows = spark.createDataFrame([(a,) for a, _ in SPOKEN] + [(None,)], "t string").select(normalize.normalize_text("t")).collect()
    assert [r[0] for r in rows] == [b for _, b in SPOKEN] + [None]


#: What rules look for and what stands in their way: signs, spaces of all kinds, letters of both cases, marks, letters of
#: other scripts, the block of private use that the expressions mark with.
PARTS = """1 2 0 12 345 2024 1999 10000 0.5 3.14 . - - − ~ — % 年 月 日 时 分 ℃ °C ° km KM kg m/s 米/秒 µm μm m a A x Z _ é 中 人 元 美元 ： : 、 「
    usb 1.5kg 99999999999999999 12345678901234567890123 2024-3-5 3月5日 6时45分 7-9 , 。 ² ٣ K ſ""".split() + [" ", "\u3000", "\t", "\n", "\x1c", "\xa0", "\ue000", "\ue002", "\ue007", "\ue00a"]  # fmt: skip


def test_normalize_against_plain_version(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(1, 14))) for _ in range(8000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", normalize.normalize_text("t").alias("s")).collect()
    assert len(rows) == len(texts) and [(texts[r.i], r.s) for r in rows if r.s != plain_normalizer.normalize(texts[r.i])] == []


@pytest.mark.parametrize("part,times", [("1.1-a", 50_000), ("12kg ", 5_000), ("1-", 20_000), ("a.a.b-", 20_000), ("a1_", 50_000), ("5 " + " " * 50, 1_000)])
def test_normalize_long_texts(spark, part, times):
    """Neither the stack nor the time of a pattern grows out of hand with the text."""
    said = spark.createDataFrame([(part * times,)], "t string").select(normalize.normalize_text("t")).first()[0]
    assert said == plain_normalizer.normalize(part * times)


def test_normalize_one_long_number(spark):
    said = spark.createDataFrame([("1" * 200_000,)], "t string").select(normalize.normalize_text("t")).first()[0]
    assert said == "一" * 200_000


def test_normalize_needs_no_python_worker(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(normalize.normalize_text("t"))._jdf.queryExecution().toString()
    assert "Python" not in plan


NUMBERS = {0: "零", 10: "十", 15: "十五", 110: "一百一十", 1005: "一千零五", 2010: "二千零一十", 10000: "一万", 10001: "一万一", 18000: "一万八千",
    100000: "十万", 100010: "十万一十", 20000000: "二千万", 20240305: "二千零二十四万三百零五", 100000000: "一亿", -3: "负三", 10**16: None}


def test_int_to_chinese(spark):
    df = spark.createDataFrame([(n,) for n in NUMBERS], "n long")
    assert {r[0]: r[1] for r in df.select("n", numerals.int_to_chinese(F.col("n"))).collect()} == NUMBERS


def test_other_numerals(spark):
    row = spark.range(1).select(
        numerals.digits_to_chinese(F.lit("-12.50")), numerals.number_to_chinese(F.lit("0.75")), numerals.number_to_chinese(F.lit("-137.9")),
        numerals.canonical_unit(F.lit("GHz")), numerals.canonical_unit(F.lit("°C")), numerals.canonical_unit(F.lit("zz")),
        numerals.number_reading(F.lit("12345"), F.lit(""), F.lit("元")), numerals.number_reading(F.lit("12"), F.lit("号："), F.lit("")), numerals.number_reading(F.lit("12"), F.lit(""), F.lit("")),
    ).first()
    assert list(row) == ["负一二点五零", "零点七五", "负一百三十七点九", "吉赫兹", "摄氏度", "zz", "number", "digits", "number"]


def test_protected_tokens(spark):
    df = spark.createDataFrame([(1, "USB3.0 15kg H2O 2024 abc C-130 第A1-2B")], "utt long, text string")
    assert [r.token for r in normalize.protected_tokens(df).orderBy("token_pos").collect()] == ["USB3.0", "H2O", "C-130"]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**16 - 1))
def test_spoken_number_has_no_doubled_zero(n):
    said = plain_normalizer.spoken_number(str(n))
    assert said and "零零" not in said and (said == "零" or not said.endswith("零"))


def reference_split(s: str, max_len: int = 80) -> list[str]:
    out, held = [], ""
    for ch in s:
        held += ch
        if ch in text.HARD or (ch in text.SOFT and len(held) >= max_len):
            out.append(held.strip())
            held = ""
    return [x for x in [*out, held.strip()] if x]


CASES = ["哈哈！！x", "a, b. c", "x" * 79 + "，y", "x" * 78 + "，y", " ！ ", "", "a　。　b", "？" * 5, "，" * 200 + "。x，"]
CASES += [c * 30 for c in CASES] + ["\u2003\x85x\u3000。\xa0y\n", "\U0001f600" * 79 + "，z", "x\n" * 90 + "；y！" + "z" * 500]


def test_split_sentences(spark):
    rows = spark.createDataFrame([(c,) for c in CASES], "t string").select(text.split_sentences(F.col("t"))).collect()
    assert [list(r[0]) for r in rows] == [reference_split(c) for c in CASES]


def test_split_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", text.split_sentences(F.col("text"), 40).alias("s")).collect()
    assert all(list(r.s) == reference_split(r.text, 40) for r in rows)


def test_sentences_are_cut_once(spark):
    """No filter on the sentences cuts each text again."""
    df = spark.range(1).select("id", F.lit("a").alias("text"), F.uuid().alias("_u")).select("id", F.concat("text", "_u").alias("text"))
    for out in (sentences.explode_sentences(df), sentences.sentence_plan(df), sentences.lookback_context(sentences.explode_sentences(df), key="id")):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_cut_is_as_quick_as_marks_are_found(spark):
    """Some seven times the time of a plain split at hard marks, as it was with classes of all other characters, is too much."""
    df = spark.range(4000).select(F.repeat(F.lit("some words of a text that is not short, "), 100).alias("t")).repartition(4).persist()
    df.count()

    def seconds(c):
        times = []
        for _ in range(3):
            start = time.perf_counter()
            df.select(c).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return min(times)

    assert seconds(text.split_sentences(F.col("t"))) < 4 * seconds(F.split("t", f"[{text.HARD}]"))


def test_durations(spark):
    rows = [("哈哈哈哈哈哈哈！", 1.64), ("", 0.6), ("a" * 100, 15.0)]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(text.estimate_duration(F.col("t")), text.tail_window_seconds(F.col("t"))).collect()
    assert [r[0] for r in got] == pytest.approx([d for _, d in rows])
    assert [round(r[1], 6) for r in got] == [1.0, 0.6, 1.0]


def test_lookback_forms_agree(spark):
    df = spark.createDataFrame([(1, "一二三四五六七八九。好。完"), (2, None), (3, "")], "utt long, text string")
    plan = sentences.sentence_plan(df).orderBy("utt", "pos").collect()
    assert [r.context for r in plan] == [None, "三四五六七八九。", "好。"]
    assert plan[1].in_text == "三四五六七八九。好。"
    window = sentences.lookback_context(sentences.explode_sentences(df)).orderBy("utt", "pos").collect()
    assert [(r.pos, r.context, r.in_text) for r in plan] == [(r.pos, r.context, r.in_text) for r in window]


TIMELINES = [
    (True, 1440, [24000, 24000, 500], [0, 22560, 46060], 46560),
    (False, 240, [24000, 24000, 500], [0, 23760, 47520], 48020),
    (False, 240, [24000, 24000, 200], [0, 23760, 47760], 47960),
    (True, 1440, [], [], None),
]


@pytest.mark.parametrize("power,overlap,lengths,starts,total", TIMELINES)
def test_timeline(spark, power, overlap, lengths, starts, total):
    df = spark.createDataFrame([(lengths,)], "n array<int>")
    spans = df.select(sentences.timeline(F.col("n"), overlap, power)).first()[0]
    assert [s.start for s in spans] == starts and (total is None or spans[-1].end == total)


@pytest.mark.parametrize("power", [True, False])
def test_timeline_rows_match_timeline(spark, power):
    rows = [(u, p, (u * 37 + p * p * 11) % (30 if u % 3 else 12)) for u in range(40) for p in range(u % 9)]
    df = spark.createDataFrame(rows, "utt int, pos int, n int").repartition(4)
    got = {(r.utt, r.pos): (r.start, r.end) for r in sentences.timeline_rows(df, "n", 10, power).collect()}
    lists = df.groupBy("utt").agg(F.sort_array(F.collect_list(F.struct("pos", "n")))["n"].alias("n"))
    expected = {(r.utt, p): tuple(s) for r in lists.select("utt", sentences.timeline(F.col("n"), 10, power).alias("spans")).collect() for p, s in enumerate(r.spans)}
    assert got == expected and len(got) == len(rows)


def test_rule_texts_are_dealt_over_all_partitions(spark, sf_dir):
    from voxmill.queries import written_rules

    assert written_rules(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_units_hold_a_sign_that_is_looked_for():
    import re

    assert all(re.search(normalize.UNIT_SIGNS, u) for u in numerals.UNIT_NAMES)
