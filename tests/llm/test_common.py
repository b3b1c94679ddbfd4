"""What the operators share: scratch tables, positions of rows, broadcasts by bytes."""

import os

import pytest
from pyspark.sql import functions as F

from talkgauge.llm.common import POSITION, broadcast_if_small, positioned, scratch, setting, shared_dir, written
from tests.llm.test_operators import SF


def tables(spark):
    return {x for x in os.listdir(shared_dir(spark)) if x.startswith("table-")}


def test_scratch_tables_are_deleted_but_for_those_kept(spark):
    written(spark.range(1))
    before = tables(spark)
    with scratch(spark) as keep:
        one = written(spark.range(3))
        with scratch(spark) as keep_inside:
            two = keep_inside(written(one.selectExpr("id + 1 AS id")).filter("id > 1"))
            three = keep(two.selectExpr("id * 10 AS id"))
        assert len(tables(spark) - before) == 3 and two.count() == 2
    assert len(tables(spark) - before) == 1 and sorted(r.id for r in three.collect()) == [20, 30]
    with pytest.raises(ZeroDivisionError), scratch(spark):
        written(spark.range(1))
        raise ZeroDivisionError
    assert len(tables(spark) - before) == 1


def test_positions_tell_rows_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    repeated = docs.select("doc_id").join(docs.select(F.lit(1).alias("one")).limit(3), F.lit(True))
    for df in (docs, docs.select("text").filter("length(text) > 100"), repeated, spark.createDataFrame([(None,)] * 9, "doc_id long"), docs.limit(0), docs.withColumn("_row", F.lit(1))):
        placed = positioned(df)
        assert placed.count() == df.count() == placed.select(*POSITION).dropna().distinct().count()
    assert positioned(docs).exceptAll(positioned(docs)).count() == 0


def test_small_tables_are_broadcast_by_bytes(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    assert hinted(broadcast_if_small(spark.range(10))) and hinted(broadcast_if_small(spark.range(0)))
    assert not hinted(broadcast_if_small(spark.range(10), F.lit(4 << 20)))


def test_settings_are_put_back(spark):
    key = "spark.sql.shuffle.partitions"
    was = spark.conf.get(key)
    with pytest.raises(ValueError), setting(spark, key, "3"):
        assert spark.conf.get(key) == "3"
        raise ValueError
    assert spark.conf.get(key) == was
