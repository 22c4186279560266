"""Work is dealt over tasks by rows, and brought together once."""

from treesift.checks.registry import Tables
from treesift.operators.name_lookup import resolved
from treesift.sources.python_names import NAMES


def test_rows_of_one_file_are_dealt_over_tasks(spark, tmp_path):
    spark.range(50_000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    files = Tables(spark, str(tmp_path)).derive("SELECT p_partkey FROM part")
    assert files.rdd.getNumPartitions() == 3 and files.count() == 50_000


def test_names_of_a_file_meet_in_one_shuffle(spark):
    plan = resolved(spark.createDataFrame([], NAMES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_names_in_order_are_not_dealt_again(spark):
    plan = resolved(spark.createDataFrame([], NAMES), in_order=True)._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Sort", "Window"))
