import pytest
from pyspark.sql import functions as F

from tarnwatch.sources import profiles, store

SETTINGS = {"mode": "wbf", "weights": "uniform", "rate": 0.85, "balance": 1.0, "discount": {"forecast": 1.0}, "calendar": ["2024-01-01"]}


def test_thresholds_hold_for_their_settings(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(ValueError):
        store.read_threshold(spark, folder, SETTINGS)
    assert store.read_threshold(spark, folder, SETTINGS, fallback=0.2) == 0.2
    store.save_threshold(spark, folder, 0.1026, SETTINGS)
    store.save_threshold(spark, folder, 0.3, {**SETTINGS, "mode": "cbf"})
    assert store.read_threshold(spark, folder, {**SETTINGS, "rate": 0.85 + 1e-12}) == 0.1026
    assert store.read_threshold(spark, folder, {**SETTINGS, "mode": "cbf"}) == 0.3
    for change in ({"rate": 0.9}, {"discount": {"forecast": 0.5}}, {"calendar": []}):
        with pytest.raises(ValueError):
            store.read_threshold(spark, folder, {**SETTINGS, **change})
        assert store.read_threshold(spark, folder, {**SETTINGS, **change}, fallback=0.5, strict=False) == 0.5


def test_models_and_runs(spark, tmp_path):
    folder = str(tmp_path)
    models = spark.createDataFrame([("a", 0.5), ("b", 0.7)], "leaf string, r2 double")
    store.save_models(models, folder, "2024-01-31")
    assert sorted(map(tuple, store.load_models(spark, folder, "2024-01-31").collect())) == [("a", 0.5), ("b", 0.7)]
    with pytest.raises(ValueError):
        store.load_models(spark, folder, "2024-02-01")
    patched = store.patch_models(models, spark.createDataFrame([("a", 0.9)], "leaf string, mase double"), "leaf", ["mase"])
    assert {r.leaf: r.mase for r in patched.collect()} == {"a": 0.9, "b": None}
    for run, v in (("r1", 0.8), ("r2", 0.6)):
        store.log_run(spark, folder, run, {"f1_micro": v, "fpr": 0.01})
    got = {(r.run, r.metric): r.value for r in store.read_runs(spark, folder, ["r1", "gone"], {"f1_micro": "f1"}).collect()}
    assert got == {("r1", "f1"): 0.8, ("r1", "fpr"): 0.01}


def test_identities_and_frequencies(spark):
    a = store.run_id({"x": 1, "y": [2]}, "v1", {"t": "d"})
    assert len(a) == 16 and a == store.run_id({"y": [2], "x": 1}, "v1", {"t": "d"}) != store.run_id({"x": 1, "y": [2]}, "v2", {"t": "d"})
    df = spark.range(10)
    assert store.table_digest(df) == store.table_digest(df.orderBy(F.desc("id"))) != store.table_digest(df.filter("id > 0"))
    assert [store.seconds_of(x) for x in ("30s", "10min", "1h", "2d", "min", "soon", "")] == [30, 600, 3600, 172800, 60, 300, 300]


def test_wide_opinions_as_files(spark, tmp_path):
    rows = [(w, leaf, 0.2, 0.1, 0.3, 0.4, 1 / 3, 1 / 3, 1 / 3) for w in (1, 2) for leaf in ("a", "b")]
    df = spark.createDataFrame(rows, "w int, leaf string, b_safe double, b_susp double, b_atk double, u double, a_safe double, a_susp double, a_atk double")
    wide = store.wide_opinions(df, "w", "leaf", ["a", "b"])
    store.save_opinions(wide, str(tmp_path), "csv")
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/opinions")
    assert back.count() == 2 and len(back.columns) == 11 and abs(back.first()["a_proj_atk"] - (0.3 + 0.4 / 3)) < 1e-12


def test_the_cut_of_the_training_span_keeps_times_together(spark):
    df = spark.range(40).select(F.timestamp_seconds(F.floor(F.col("id") / 4) * 60).alias("timestamp"), "id")
    got = {(r.part, r["count"]) for r in profiles.split_train(df, "1970-01-01 00:08:30").groupBy("part").count().collect()}
    # 36 rows up to the split, 27 of them for the model: the time that holds the 27th stays whole.
    assert got == {("model", 28), ("calibration", 8), ("test", 4)}


def test_a_write_that_dies_leaves_the_old_table(spark, tmp_path):
    folder = str(tmp_path)
    one = spark.createDataFrame([("a", 0.5)], "leaf string, r2 double")
    store.save_models(one, folder, "x")
    broken = one.withColumn("r2", F.raise_error(F.lit("killed")).cast("double"))
    with pytest.raises(Exception, match="killed"):
        store.save_models(broken, folder, "x")
    assert store.load_models(spark, folder, "x").collect() == one.collect()
    assert [p.name for p in tmp_path.iterdir()] == ["models"]
    # Dead between the two renames: the table stands aside until it is next asked for.
    (tmp_path / "models").rename(tmp_path / "models.aside")
    assert store.load_models(spark, folder, "x").collect() == one.collect()
    store.save_models(one.withColumn("r2", F.lit(0.9)), folder, "x")
    assert store.load_models(spark, folder, "x").first().r2 == 0.9 and [p.name for p in tmp_path.iterdir()] == ["models"]
    assert store.read_runs(spark, folder).count() == 0


def test_hours_of_a_schedule_are_rounded_as_printf_does(spark):
    df = spark.range(1, 60_000).selectExpr("timestamp '2024-01-02 12:00:00' AS start", "timestamp '2024-01-02 12:00:00' + make_interval(0, 0, 0, 0, 0, 0, 18 * id) AS end", "'U' || id AS name")
    got = {r.line.split("  ")[3]: r.line.split("  ")[2] for r in store.schedule(df).collect()}
    assert got == {f"U{i}": f"{18 * i / 3600:.2f} h" for i in range(1, 60_000)}
    assert [r.line for r in store.schedule(df.limit(1).withColumn("name", F.lit(None).cast("string"))).collect()] == [None]
