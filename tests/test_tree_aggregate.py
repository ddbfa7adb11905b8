from datetime import datetime

import pytest
from pyspark.sql import functions as F

from framelake.operators.hot_keys import country_codes, hot_keys, key_totals
from framelake.operators.tree_aggregate import Merge, rounds_for, tree_aggregate

FILES = "file_id bigint, seen_at timestamp, length bigint, location struct<city:string,country:string>, code string, spelling string"
BORDERS = "country string, name string"


def files(spark, rows):
    return spark.createDataFrame([(i, datetime(2025, 1, s), n, loc, "x", "clash") for i, s, n, loc in rows], FILES)


def test_rounds():
    assert [rounds_for(n, 4) for n in (0, 1, 4, 5, 16, 17, 64, 65)] == [1, 1, 1, 2, 2, 3, 3, 4]
    with pytest.raises(ValueError):
        rounds_for(9, 1)


@pytest.mark.parametrize("fan_in, chunks", [(2, 64), (3, 10), (16, 8)])
def test_equals_plain_aggregate_under_skew(spark, fan_in, chunks):
    df = spark.range(20_000, numPartitions=9).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 97).cast("string")).alias("k"), F.col("id").alias("v"))
    df = df.withColumn("k", F.when(F.col("v") % 50 == 0, None).otherwise(F.col("k")))
    tree = tree_aggregate(df, ["k"], {"n": Merge.count(), "s": Merge.sum(F.col("v")), "lo": Merge.min(F.col("v")), "hi": Merge.max(F.col("v"))}, chunks, fan_in)
    plain = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert sorted(map(str, tree.collect())) == sorted(map(str, plain.collect()))


def test_no_reducer_gets_more_than_fan_in_states(spark):
    df = spark.range(1000, numPartitions=16).select(F.lit("hot").alias("k"))
    plan = tree_aggregate(df, ["k"], {"n": Merge.count()}, 16, 4)._jdf.queryExecution().simpleString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_key_totals_rules(spark):
    rows = [
        (1, 1, 10, ("Rome", "XA")), (1, 2, 10, ("Rome", "XA")), (2, 1, 5, (" rome ", "xa ")), (3, 1, None, ("ROME", "Aland")), (4, 1, 7, (None, "XB")),
        (5, 1, 7, ("Rome", "XB")), (6, 1, 1, ("  ", "XB")), (7, 1, 1, ("Oslo", None)), (8, 1, 1, ("Oslo", " ")), (9, 1, 1, None), (None, 1, 1, ("Rome", "XA")), (10, 1, 3, ("Bern", "Nowhere")),
    ]
    totals = key_totals(files(spark, rows), spark.createDataFrame([("XA", "Aland"), ("XA", "Aland"), ("XB", "Beland"), (None, None)], BORDERS))
    got = {(r.key_kind, r.country, r.city): (r.files, r.total_length) for r in totals.collect()}
    assert got == {
        ("country", "XA", ""): (3, 15), ("country", "XB", ""): (3, 15), ("country", "NOWHERE", ""): (1, 3),
        ("city", "XA", "rome"): (3, 15), ("city", "XB", "rome"): (1, 7), ("city", "NOWHERE", "bern"): (1, 3),
    }


def test_hot_share_and_empty(spark):
    borders = spark.createDataFrame([("XA", "Aland"), ("XB", "Beland")], BORDERS)
    rows = [(i, 1, 1, (f"c{i}" if i > 30 else "hot", "XA" if i else "XB")) for i in range(100)]
    got = {tuple(r) for r in hot_keys(key_totals(files(spark, rows), borders)).collect()}
    assert got == {("country", "XA", ""), ("city", "XA", "hot")}
    assert key_totals(files(spark, []), borders).count() == 0
    assert hot_keys(key_totals(files(spark, []), borders)).count() == 0


def test_code_beats_name(spark):
    got = {r.spelling: r.code for r in country_codes(spark.createDataFrame([("XA", "XB"), ("XB", "Other"), ("XC", "Other")], BORDERS)).collect()}
    assert got == {"xa": "XA", "xb": "XB", "xc": "XC", "other": "XB"}
