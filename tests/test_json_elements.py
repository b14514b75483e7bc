"""One JSON file read by many tasks."""

import json
import random

import pytest

from auditlake.sources import json_elements


def rich(rnd, i):
    return {"id": i, "t": rnd.choice(['},{"x"', 'say \\"hi\\" },', "plain", "é{[", "\\", ""]), "n": {"a": [{"b": rnd.randint(0, 9)}] * rnd.randint(0, 3)}, "e": {}}


@pytest.mark.parametrize(("indent", "separator", "size"), [(None, "},", 400), (2, "},", 700), (None, ",", 300), (None, "},", 10_000_000)])
def test_elements_equal_a_whole_parse(spark, tmp_path, indent, separator, size):
    rnd = random.Random(61)
    files = {}
    for name in ("a.json", "b.json", "empty.json"):
        rows = [rich(rnd, i) for i in range(0 if name == "empty.json" else 150)]
        doc = {"title": "x },{", "meta": {"k": [1, 2]}, "rows": rows, "count": len(rows)}
        (tmp_path / name).write_text(json.dumps(doc, indent=indent, ensure_ascii=False))
        files[name] = rows
    (tmp_path / "a.json").write_text(json.dumps({"rows": [*files["a.json"], {"id": -1, "t": "},".join("abc") * 900}]}, indent=indent))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = json_elements.elements(spark, str(tmp_path), separator=separator).cache()
        got = sorted((r.file.rsplit("/", 1)[1], json.dumps(json.loads(r.element), sort_keys=True)) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    files["a.json"].append({"id": -1, "t": "},".join("abc") * 900})
    assert got == sorted((n, json.dumps(r, sort_keys=True)) for n, rows in files.items() for r in rows)
    assert sorted(r.id for r in json_elements.parsed(found, "id bigint, t string").collect()) == sorted(r["id"] for rows in files.values() for r in rows)


def test_many_tasks_and_a_cut_file(spark, tmp_path):
    rows = [{"id": i, "text": "x" * 50} for i in range(2000)]
    whole = json.dumps(rows)
    (tmp_path / "cut.json").write_text(whole[: len(whole) - 40])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.option("lineSep", "},").text(str(tmp_path)).rdd.getNumPartitions() > 8
        found = json_elements.parsed(json_elements.elements(spark, str(tmp_path), depth=1), "id bigint, text string")
        assert found.filter("_corrupt_record IS NULL").count() == 1999
        assert found.filter("_corrupt_record IS NOT NULL").count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
