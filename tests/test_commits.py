"""Loads that fail, repeat or meet add their rows once."""

import pytest
from pyspark.sql import functions as F

from auditlake.sources import writers
from auditlake.sources.commits import GrowingTable


def docs(spark, *ids):
    return spark.createDataFrame([(i, f"text {i}") for i in ids], "id string, text string")


def stored(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).collect())


@pytest.mark.parametrize("step", ["claim", "publish"])
def test_a_load_that_fails_is_there_once_or_not_at_all(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "table")
    writers.load_new(docs(spark, "a"), path)
    with monkeypatch.context() as m:
        m.setattr(GrowingTable, step, lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            writers.load_new(docs(spark, "a", "b", "c"), path)
    assert stored(spark, path) == ["a"]  # neither staged nor claimed files are seen
    added = writers.load_new(docs(spark, "a", "b", "c"), path)
    assert sorted(r.id for r in added.collect()) == (["b", "c"] if step == "claim" else [])
    assert stored(spark, path) == ["a", "b", "c"]


def test_a_load_that_loses_its_number_starts_again(spark, tmp_path):
    path, first = str(tmp_path / "table"), docs(spark, "a", "b")
    table, met = GrowingTable(spark, path), []

    def rows(there):
        if not met:  # another load comes in between
            met.append(writers.load_new(docs(spark, "b", "c"), path).count())
        return first if there is None else first.join(there.select("id"), "id", "left_anti")

    added = table.append(rows)
    assert met == [2] and [r.id for r in added.collect()] == ["a"] and stored(spark, path) == ["a", "b", "c"]
    assert GrowingTable(spark, path).read().columns == ["id", "text"]


def test_a_named_run_counts_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    results = spark.createDataFrame([("k", "llm_vote", "vuln")], "key string, final_method string, final_verdict string")
    for _ in range(3):
        writers.write_cache(results, path, now=F.lit("2024-01-01").cast("timestamp"), run="one")
    writers.write_cache(results, path, run="two")
    assert spark.read.parquet(path).count() == 2


def test_an_empty_load(spark, tmp_path):
    path = str(tmp_path / "table")
    assert GrowingTable(spark, path).read() is None
    assert writers.load_new(docs(spark, "a").filter("false"), path).count() == 0
    assert writers.load_new(docs(spark, "a", None, ""), path).count() == 1
