"""Running positions against row_number, and that no task sees more than its part."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators.ordinal import with_next, with_ordinal, with_position


def test_positions_follow_the_order_over_many_parts(spark):
    rows = spark.range(0, 200_000, 1, 7).select((F.col("id") * 7919 % 200_003).alias("k"), F.col("id").alias("v"))
    got = with_ordinal(rows, ["k"], unique=True)
    assert got.columns == ["k", "v", "ordinal"]
    want = rows.withColumn("want", F.row_number().over(Window.orderBy("k")) - 1)
    assert got.join(want, ["k", "v"]).where("ordinal <> want").count() == 0 and got.count() == 200_000
    sizes = [r[0] for r in got.groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) >= 4 and max(sizes) < 100_000


def test_equal_rows_spread_and_each_place_is_taken_once(spark):
    """A third and more of the rows are equal in the order, nulls among them."""
    rows = spark.range(0, 30_000, 1, 5).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("k"), F.lit("x").alias("row_place"), F.lit("y").alias("row_tie"))
    got = with_ordinal(rows, [F.desc_nulls_last("k")], name="n", start=1)
    ends = got.groupBy("k").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count_distinct("n").alias("c")).orderBy("a").collect()
    assert [tuple(r) for r in ends] == [(1, 1, 10_000, 10_000), (0, 10_001, 20_000, 10_000), (None, 20_001, 30_000, 10_000)]
    assert got.columns == ["k", "row_place", "row_tie", "n"]


def test_rows_without_an_order_are_numbered_as_read(spark):
    got = with_ordinal(spark.range(0, 1000, 1, 6)).collect()
    assert sorted(r["ordinal"] for r in got) == list(range(1000)) and all(r["id"] == r["ordinal"] for r in got)


def test_positions_in_groups(spark):
    """One group holds most rows; null groups and null orders count."""
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [("b", 2), ("b", None), (None, 1), (None, 1)], "g string, v long").repartition(4)
    got = with_position(rows, ["g"], [F.asc_nulls_first("v")], start=1)
    want = rows.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy("v")).cast("long"))
    assert sorted(map(str, got.select("g", "v", "position").collect())) == sorted(map(str, want.collect()))


def test_empty_tables_and_taken_names(spark):
    assert with_ordinal(spark.range(0)).count() == 0 and with_position(spark.range(0), ["id"], ["id"]).columns == ["id", "position"]
    with pytest.raises(ValueError):
        with_ordinal(spark.range(1), name="ID")


def test_the_next_row_of_a_group_over_blocks(spark):
    """Groups that span blocks, null groups and null values; a block's first row stands in two blocks and comes out once."""
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [("b", 2), ("b", None), (None, 1), (None, 3), ("c", 7)], "g string, v long").repartition(4)
    want = rows.withColumn("next_v", F.lead("v").over(Window.partitionBy("g").orderBy("v")))
    for block in (1, 7, 1 << 16):
        got = with_next(rows, ["g"], ["v"], ["v"], unique=True, block=block)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
