"""Sizes, limits and left-over copies."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from riskloom.operators import encode, lookup, models, ranking, smote, split
from riskloom.plans import training
from riskloom.session import scratch, write_out


def stages(spark) -> set[str]:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return set(os.listdir(folder.removeprefix("file://"))) if folder and os.path.isdir(folder.removeprefix("file://")) else set()


def test_pin_counts_bytes(spark):
    wide = spark.range(4).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    assert lookup.pin(wide, max_bytes=1000) is None
    assert lookup.pin(wide).count() == 4
    assert lookup.pin(wide, limit=3) is None and lookup.pin(spark.range(4), limit=3) is None


def test_scratch_deletes_its_copies_but_kept_ones(spark):
    write_out(spark.range(1), "before")
    before = stages(spark)
    with scratch(spark):
        write_out(spark.range(3), "gone")
        kept = write_out(spark.range(2), "kept", keep=True)
    assert kept.count() == 2 and len(stages(spark) - before) == 1


def test_training_leaves_no_copies(spark):
    rows = spark.range(60).select(
        "id", (F.col("id") % 2 * 10.0 + F.col("id") % 3).alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y")
    )
    write_out(spark.range(1), "before")
    before = stages(spark)
    small = models.ModelSettings(logistic_iterations=10, trees=2, rounds=2, depth=2)
    assert {r["accuracy"] for r in training.train_and_evaluate(rows, "y", "id", settings=small).scores.collect()} == {1.0}
    run = training.train_models(rows, "y", "id", settings=small)
    assert run.reports.count() > 0 and run.best_name
    assert stages(spark) == before


def test_training_goes_on_where_oversampling_fails(spark, monkeypatch):
    def broken(*args, **options):
        raise ValueError("no neighbours")

    monkeypatch.setattr(training, "smote", broken)
    rows = spark.range(30).select("id", F.col("id").cast("double").alias("x"), (F.col("id") >= 15).cast("int").alias("y"))
    small = models.ModelSettings(logistic_iterations=5, trees=2, rounds=2, depth=2)
    run = training.train_and_evaluate(rows, "y", "id", ["x"], oversample=True, settings=small)
    assert run.info["oversampling"] == "no neighbours" and run.scores.count() == 3


def test_many_classes_oversampled(spark):
    """1,500 classes, one of which is larger."""
    rows = spark.range(4505).select("id", (F.col("id") * 0.5).alias("x"), F.least(F.floor(F.col("id") / 3), F.lit(1499)).alias("y"))
    sizes = smote.smote(rows, ["x"], "y", "id").groupBy("y").count().select("count").distinct().collect()
    assert [r[0] for r in sizes] == [8]


def test_clean_data_scans_grow_in_proportion(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lookup, "PIN_ROWS", 5)
    text = [F.concat(F.lit(k), (F.col("id") % (20 + i)).cast("string")).alias(k) for i, k in enumerate("abc")]
    spark.range(100).select("id", (F.col("id") * 1.5).alias("v"), *text).write.parquet(f"{tmp_path}/t")
    scans = []
    for n in (1, 2, 3):
        df = spark.read.parquet(f"{tmp_path}/t").select("id", "v", *list("abc")[:n])
        plan = training.clean_data(df, "v", "id")._jdf.queryExecution().optimizedPlan().toString()
        scans.append(plan.count("parquet"))
    assert scans[2] - scans[1] == scans[1] - scans[0]


def test_spread_depends_on_rows_alone(spark):
    from riskloom.operators.ordering import spread

    def placed(files: int) -> dict:
        dealt = spread(spark.range(1000).repartition(files), 1000, ["id"], 100).withColumn("p", F.spark_partition_id())
        return {r["id"]: r["p"] for r in dealt.collect()}

    assert placed(3) == placed(7)


def test_forest_is_the_same_from_any_files(spark):
    rows = spark.range(400).select("id", (F.col("id") % 7 * 1.0).alias("x"), (F.col("id") % 5 * 1.0).alias("z"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    one, two = (
        {r["feature"]: r["importance"] for r in ranking.forest_importance(rows.repartition(n), ["x", "z"], "y", trees=5, id_col="id").collect()}
        for n in (2, 9)
    )
    assert one == two and one["x"] > one["z"]


def test_sparse_one_hot_and_summary(spark):
    df = spark.createDataFrame([(1, "b", "u"), (2, "a", None), (3, None, "v")], "id int, k string, m string")
    coded, layout = encode.one_hot_sparse(df)
    assert {tuple(r) for r in coded.collect()} == {(1, 1, 2), (2, 0, None), (3, None, 3)}
    assert {tuple(r) for r in layout.collect()} == {("k", "a", 0), ("k", "b", 1), ("m", "u", 2), ("m", "v", 3)}
    said = encode.one_hot_summary(df, encode.one_hot(df))
    assert said == {"encoded": ["k", "m"], "new": ["k_a", "k_b", "m_u", "m_v"], "shape": (3, 5)}
    assert encode.one_hot_sparse(df.select("id"))[1].count() == 0


def test_class_weights_of_an_empty_table(spark):
    assert split.class_weights(spark.range(0), "id").count() == 0


def test_tasks_of_a_fit_follow_the_rows():
    from riskloom.operators.ordering import fit_tasks

    assert [fit_tasks(n) for n in (0, 10, 40_000, 10**9)] == [1, 1, 2, 4096]
    assert fit_tasks(10**11) == 50_000  # no task takes more than two million rows
    assert all(n / fit_tasks(n) <= 2_000_000 * 1.01 or n < 10**9 for n in (10**9, 10**10, 10**12))


def test_tasks_of_a_fit_grow_slower_than_small_tables_ask():
    """A hundred passes cost a fixed share a task: some million rows are dealt to few tasks."""
    from riskloom.operators.ordering import fit_tasks
    from riskloom.operators.ranking import FOREST_ROWS

    assert fit_tasks(20_000, FOREST_ROWS) == 8 and fit_tasks(900_000) == 45  # as many as before
    assert fit_tasks(7_200_000, FOREST_ROWS) <= 64 and fit_tasks(6_000_000) <= 64 and fit_tasks(43_000_000) <= 200
    assert all(n / fit_tasks(n) <= 250_000 for n in range(10**6, 10**9, 10**7 - 1))


def test_small_slices_share_partitions(spark, monkeypatch):
    """Ten thousand slices of seven rows in four partitions: right totals, few tasks."""
    from riskloom.operators import ordering

    monkeypatch.setattr(ordering, "FEW_TASKS", 4)
    parts, write = [], ordering.write_out
    monkeypatch.setattr(ordering, "write_out", lambda df, *a: parts.append(df.rdd.getNumPartitions()) or write(df, *a))
    rows = spark.range(70_000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("x"), "id", (F.col("id") % 11).alias("w"))
    got = ordering.running_total(rows, ["g"], ["x", "id"], "w", "upto", 70_000, window_rows=7).toPandas()
    want = got.sort_values(["g", "x", "id"]).groupby("g").w.cumsum()
    assert len(got) == 70_000 and (want == got.upto).all() and parts[0] == 4
