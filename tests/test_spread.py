"""One participant with a third of all rows must not end up in one task."""

import pytest
from pyspark.sql import functions as F

from cohortwise.functions import spread
from cohortwise.operators import align, summary


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def hot_events(spark, rows=30000):
    start = F.expr("TIMESTAMP_NTZ'2020-01-01 00:00:00'")
    who = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), (F.col("id") % 997).cast("string")))
    return spark.range(rows).select(
        who.alias("p_id"), (start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("ts"), F.lit("x").alias("data_name")
    )


def people(spark, events):
    return events.select("p_id").distinct().withColumn("enrollment_date", F.expr("DATE'2020-01-01'"))


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_spread_join_equals_a_plain_join(spark, no_broadcast):
    events = hot_events(spark, 3000)
    dates = people(spark, events).filter("p_id <> 'p5'")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = events.join(dates, "p_id", how)
        spread_out = spread.spread_join(events, dates, ["p_id"], how, ["ts"])
        assert sorted(map(str, plain.select(*spread_out.columns).collect())) == sorted(map(str, spread_out.collect()))


def test_the_hot_participant_is_split_in_the_join(spark, no_broadcast):
    events = hot_events(spark)
    dates = people(spark, events)
    assert largest_share(events.join(dates, "p_id")) > 0.33
    assert largest_share(align.attach_enrollment(events, dates, ["ts"])) < 0.3


def test_an_aggregate_after_the_spread_join_combines_before_its_shuffle(spark, no_broadcast):
    events = hot_events(spark)
    counted = align.attach_enrollment(events, people(spark, events), ["ts"]).groupBy("p_id").count()
    text = counted._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in text.split("SortMergeJoin")[0]


def test_the_rollup_leaves_a_day_bounded_number_of_rows(spark):
    events = hot_events(spark)
    days = align.daily_rollup(events, ("p_id",))
    assert days.filter("p_id = 'hot'").count() == events.select(F.to_date("ts")).distinct().count()
    assert days.agg(F.sum("n")).first()[0] == 30000


def test_surveys_of_a_hot_participant(spark, no_broadcast):
    events = hot_events(spark, 3000)
    records = events.select("p_id", F.col("ts").alias("start_time"), (F.second("ts") % 7).alias("sum_phq8"), F.minute("ts").alias("total_time_taken"))
    indexed = summary.index_surveys(records, people(spark, events), "inner")
    stats = {r.p_id: (r.m, r.md) for r in summary.survey_period_summary(indexed, 10_000, {"m": ("total_time_taken", "mean"), "md": ("total_time_taken", "median")}).collect()}
    expected = records.groupBy("p_id").agg(F.avg("total_time_taken").alias("m"), F.median("total_time_taken").alias("md"))
    for row in expected.collect():
        assert stats[row.p_id] == (pytest.approx(row.m), row.md)


def test_only_hot_keys_are_repeated(spark):
    """A third of the rows on one key makes as many parts as its rows ask for; other keys stay as they are."""
    rows = [(7 if i % 3 == 0 else i % 500, i) for i in range(9000)] + [(None, -i) for i in range(1, 40)]
    large = spark.createDataFrame(rows, "k int, v int")
    small = spark.createDataFrame([(k, f"n{k}") for k in range(400)] + [(None, "none")], "k int, name string")
    hot = {r.k: r["__parts"] for r in spread.hot_keys(large, ["k"], 20).collect()}
    assert hot[7] > 128 and hot[None] == 2 and len(hot) == 2
    joined = spread.hot_join(large, small, ["k"], "left", ["v"], 20)
    assert sorted(map(repr, joined.collect())) == sorted(f"Row(k={k!r}, v={v!r}, name={(None if k is not None and k >= 400 else 'none' if k is None else f'n{k}')!r})" for k, v in rows)
    inner = spread.hot_join(large, small, ["k"], "inner", ["v"])
    assert inner.count() == sum(k is None or k < 400 for k, _ in rows)
