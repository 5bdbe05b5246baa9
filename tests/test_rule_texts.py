"""The texts of the normaliser's rules: said once for all orders that share them, and numbers as the plain version names them."""

import random
from datetime import datetime

import duckdb
import plain_normalizer
from pyspark.sql import functions as F

from voxmill.functions import normalize, numerals
from voxmill.queries import ORACLE_SQL, QUERIES


def rules_against_sql(spark, d, rows):
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp").repartition(3).write.parquet(f"{d}/orders.parquet")
    got = QUERIES["spoken_rules"](spark, d)
    con = duckdb.connect()
    con.execute(f"create view orders as select * from read_parquet('{d}/orders.parquet/*.parquet')")
    expected = con.execute(ORACLE_SQL["spoken_rules"])
    assert got.columns == [c[0] for c in expected.description]
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, expected.fetchall()))


def test_each_text_is_said_once(spark, sf_dir):
    """Every step that normalises reads values without repeats, and there are few such steps to plan."""
    lines = QUERIES["spoken_rules"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    says = [k for k, line in enumerate(lines) if "regexp_replace" in line]
    assert len(says) == 3 and all("Aggregate [" in lines[k] + lines[k + 1] for k in says)


def test_rules_of_orders_without_key_or_date(spark, tmp_path):
    day = datetime(2024, 2, 29)
    rows = [(None, day), (7, None), (None, None), (0, day), (0, day), (9990, day), (19_989, datetime(1992, 12, 1)), (5, datetime(1992, 12, 1))]
    got, expected = rules_against_sql(spark, str(tmp_path), rows)
    assert len(got) == len(rows) and got == expected


def test_rules_of_orders_that_share_all_values(spark, tmp_path):
    rows = [(9990 * 7 * k + 1234, datetime(2001, 1, 1 + k % 2)) for k in range(400)]
    got, expected = rules_against_sql(spark, str(tmp_path), rows)
    assert len(got) == len(rows) and got == expected


def test_numbers_against_plain_version(spark):
    rng = random.Random(9)
    numbers = [str(n) for n in range(12_000)] + [str(rng.randrange(10 ** rng.randint(5, 16))) for _ in range(3000)]
    numbers += ["007", "0000", "0010", "00012345", "0" * 30 + "12", "0" * 40, "0012.50", "0.0", "9999.9", "10000.01"]
    rows = spark.createDataFrame(list(enumerate(numbers)), "i int, t string").repartition(4)
    said = rows.select("i", numerals.plain_number(F.col("t")).alias("plain"), numerals.number_to_chinese(F.col("t")).alias("any")).collect()
    wrong = [(numbers[r.i], r.plain, r.any) for r in said if not r.plain == r.any == plain_normalizer.spoken_number(numbers[r.i])]
    assert len(said) == len(numbers) and wrong == []


def test_units_are_found_by_their_first_characters(spark):
    """Every unit, in either case, after a number that stands close or apart."""
    texts = [f"{sign}{n}{gap}{u}" for u in numerals.UNIT_NAMES for u in (u, u.lower(), u.upper(), u.replace("k", "K")) for n in ("3", "12.5", "0.5") for gap in ("", " ", "　") for sign in ("", "-", "− ")]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", normalize.normalize_text("t").alias("s")).collect()
    assert [(texts[r.i], r.s) for r in rows if r.s != plain_normalizer.normalize(texts[r.i])] == []
