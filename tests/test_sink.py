"""The film sink: committed batches, touched buckets, loads at one time."""

import threading

from pyspark.sql import functions as F

from reelgauge import schemas
from reelgauge.sources import sink as K


def films(spark, titles):
    blank = [None] * (len(schemas.FILM_COLUMNS) - 1)
    return spark.createDataFrame([(t, *blank) for t in titles], schemas.FILM)


def stored(spark, path):
    return sorted((r.title for r in K.read_film_sink(spark, path).collect()), key=str)


def test_loads_add_only_new_titles(spark, tmp_path):
    path = str(tmp_path / "sink")
    assert stored(spark, path) == [] and K.read_film_sink(spark, path).columns == list(schemas.FILM_COLUMNS)
    K.append_films(films(spark, ["Alien", "Up"]), path)
    K.append_films(films(spark, [" ALIEN", "Up", "Heat", "heat "]), path)
    K.append_films(films(spark, ["alien", "UP "]), path)  # nothing new, no entry
    assert stored(spark, path) == ["Alien", "Up", "heat "] or stored(spark, path) == ["Alien", "Heat", "Up"]
    assert [version for version, _ in K.committed(spark, path)] == [0, 1]
    K.append_films(films(spark, []), path)
    asked = films(spark, ["HEAT", "Ran", None])
    assert {r.title for r in K.unstored_titles(asked, path).collect()} == {"Ran", None}


def test_a_batch_counts_once_committed(spark, tmp_path):
    path = str(tmp_path / "sink")
    K.append_films(films(spark, ["Alien"]), path)
    K._write_batch(films(spark, ["Lost"]), path)  # a load that failed before its entry
    assert stored(spark, path) == ["Alien"]
    K.append_films(films(spark, ["Lost"]), path)
    assert stored(spark, path) == ["Alien", "Lost"]


def test_only_buckets_of_the_titles_are_read(spark, tmp_path):
    path = str(tmp_path / "sink")
    K.append_films(films(spark, [f"Film {i}" for i in range(500)]), path)
    asked = films(spark, ["film 7", "New"])
    touched = {r[0] for r in asked.select(K.title_bucket(F.col("title"))).collect()}
    plan = K.unstored_titles(asked, path)
    text = plan._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in text.splitlines() if "FileScan parquet" in x)
    assert "PartitionFilters" in line and all(str(b) in line.split("PartitionFilters")[1] for b in touched)
    assert "ReadSchema: struct<title:string>" in line
    assert [r.title for r in plan.collect()] == ["New"]


def test_loads_at_one_time_store_each_title_once(spark, tmp_path):
    path = str(tmp_path / "sink")
    start = threading.Barrier(3)
    failed = []

    def load(name):
        try:
            own = films(spark, ["Shared", "shared ", f"Own {name}"])
            start.wait()
            K.append_films(own, path)
        except Exception as error:  # shown by the assertion below
            failed.append(error)

    loads = [threading.Thread(target=load, args=(i,)) for i in range(3)]
    for load_ in loads:
        load_.start()
    for load_ in loads:
        load_.join()
    assert not failed
    found = stored(spark, path)
    assert sum(t.strip().lower() == "shared" for t in found) == 1
    assert len(found) == 4 and {"Own 0", "Own 1", "Own 2"} <= set(found)
    versions = [version for version, _ in K.committed(spark, path)]
    assert versions == list(range(len(versions)))
