"""What a task of the score logs holds doesn't grow with the table."""

import pytest
from pyspark.sql import functions as F

from voxmill import queries
from voxmill.operators import selection

ROWS = 2_000_000


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Line items of half a million orders, more than the session's four partitions should hold."""
    d = str(tmp_path_factory.mktemp("large"))
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(n)).cast("int")
    columns = {"l_orderkey": F.floor(F.col("id") / 4), "l_linenumber": (F.col("id") % 4).cast("int"), "l_partkey": F.col("id"), "l_suppkey": F.col("id"), "l_shipdate": F.lit("2000-01-01").cast("timestamp")}
    columns |= {"l_extendedprice": F.lit(1.0), "l_discount": part(11) / 100, "l_tax": part(9) / 100, "l_quantity": part(50).cast("double"), "l_returnflag": F.substring(F.lit("ANR"), part(3) + 1, F.lit(1))}
    spark.range(ROWS).select(*[v.alias(c) for c, v in columns.items()]).write.parquet(f"{d}/lineitem.parquet")
    return d


def rows_and_most(df):
    """The rows, and those of the largest task that chooses; all columns are asked for, so that no window falls away."""
    tasks = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), *[F.max(c).alias(f"any_{c}") for c in df.columns])
    return tuple(tasks.agg(F.sum("n"), F.max("n")).first())


def test_score_log_holds_a_bounded_number_of_rows_in_a_task(spark, large):
    rows, most = rows_and_most(queries.QUERIES["score_log"](spark, large))
    assert rows == ROWS and most < 300_000


def test_score_log_is_dealt_and_sorted_once(spark, sf_dir):
    plan = queries.QUERIES["score_log"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_score_log_text_holds_a_bounded_number_of_rows_in_a_task(spark, large):
    rows, most = rows_and_most(queries.QUERIES["score_log_text"](spark, large))
    assert rows == ROWS and most < 300_000


def test_score_log_runs_writes_from_tasks_of_a_bounded_number_of_rows(spark, large, monkeypatch):
    found, write = [], queries.rn.write_run

    def watched(log, *a, **k):
        found.append(rows_and_most(log))
        return write(log, *a, **k)

    monkeypatch.setattr(queries.rn, "write_run", watched)
    assert queries.QUERIES["score_log_runs"](spark, large).count() == ROWS
    assert len(found) == 2 and all(rows == ROWS and most < 300_000 for rows, most in found)


def test_tasks_of_small_and_large_tables(spark):
    parts = lambda rows, held: selection.by_group(spark.range(rows), "id", held).rdd.getNumPartitions()
    assert [parts(0, 10), parts(1001, 100), parts(1990, 10), parts(9000, 10), parts(15_000, 10)] == [4, 11, 199, 200, 300]
