"""Scratch tables keep their rows, and the session its settings."""

import pytest
from pyspark.sql import functions as F

from marlstone.llm import common


@pytest.mark.parametrize("before", ["false", "true"])
def test_written_steps_can_be_read_again_and_joined(spark, before):
    spark.conf.set(common._FREE_SHUFFLES, before)
    try:
        grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        first = common.materialize(grouped)
        second = common.materialize(grouped.join(first.withColumnRenamed("n", "m"), "k"))
        assert first.agg(F.sum("n")).first()[0] == 1000 and second.filter("n <> m").count() == 0
        assert grouped.count() == 7 and second.count() == 7
        assert spark.conf.get(common._FREE_SHUFFLES) == before
        with pytest.raises(ZeroDivisionError), common.freed_shuffles(spark):
            raise ZeroDivisionError
        assert spark.conf.get(common._FREE_SHUFFLES) == before
    finally:
        spark.conf.unset(common._FREE_SHUFFLES)
