"""The daily chain: what each stage holds, and runs that go on where the last one stopped."""

import datetime as dt
import os

from pyspark.sql import functions as F

from thermagrid.plans import queries, stages
from thermagrid.sources import storage

SF = "/root/testdata/sf0.001"


def impute(rows):
    return rows.withColumn("predicted", F.col("t") - 4 * F.col("ndvi"))


def test_stages_of_every_day(spark):
    x = queries._layers(spark, SF)
    made = stages.products(x, impute, queries._scored, storage.stored, least=5)
    assert list(made) == ["imputed", "matched", "fine", "fused"]
    n = {(r.stage): r.days for r in stages.report(made).groupBy("stage").agg(F.count("d").alias("days")).collect()}
    assert n["imputed"] == 30 and n["fused"] == n["fine"] == n["matched"] <= 30
    inside = made["imputed"].join(x.static.where("roi = 1"), ["r", "c"])
    assert inside.where("lst is null").count() == 0
    out = made["fused"].agg(F.min("lst"), F.max("lst")).first()
    assert made["fine"].where("lst is not null").count() > 0 and out[0] >= 215 and out[1] <= 350


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    x = queries._layers(spark, SF)
    three = x.spine.where("d <= date'2024-01-03'")
    some = stages.Layers(**{**x.__dict__, "spine": three})
    folder = f"{tmp_path}/out"
    first = stages.run(spark, some, folder, impute, queries._scored, least=5).collect()
    assert len(first) == 12 and {r.status for r in first} == {"ok"}
    stamp = {p: os.stat(f"{folder}/fused/{p}").st_mtime_ns for p in os.listdir(f"{folder}/fused") if p.startswith("d=")}
    assert len(stamp) == 3
    four = stages.Layers(**{**x.__dict__, "spine": x.spine.where("d <= date'2024-01-04'").union(spark.createDataFrame([(dt.date(2030, 1, 1),)], "d date"))})
    again = {(r.d, r.stage): (r.n, r.status) for r in stages.run(spark, four, folder, impute, queries._scored, least=5).collect()}
    assert all(os.stat(f"{folder}/fused/{p}").st_mtime_ns == t for p, t in stamp.items())
    assert again[dt.date(2024, 1, 4), "fused"][1] == "ok" and {again[dt.date(2030, 1, 1), s] for s in ("imputed", "fused")} == {(0, "missing")}
    assert {(r.d, r.stage): (r.n, r.status) for r in first}.items() <= again.items()
    whole = stages.products(four, impute, queries._scored, storage.stored, least=5)["fused"]
    stored = spark.read.parquet(f"{folder}/fused").select("d", "r", "c", "lst")
    assert stored.exceptAll(whole.select("d", "r", "c", "lst")).count() == 0 and stored.count() == whole.count()
