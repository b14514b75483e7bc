"""Readers and writers on small files."""

import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from auditlake.catalog import source_queries
from auditlake.plans import triage
from auditlake.session import checkpoint_folder
from auditlake.sources import readers, writers
from auditlake.streaming import incremental


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_source_files(spark, tmp_path):
    write(tmp_path / "a" / "x.c", "﻿int f() { return 1; }")
    write(tmp_path / "y.py", "def f(): pass")
    write(tmp_path / "z.txt", "no")
    got = {(r.file.split("/")[-1], r.language, r.content[:3]) for r in readers.source_files(spark, str(tmp_path)).collect()}
    assert got == {("x.c", "c", "int"), ("y.py", "python", "def")}
    assert readers.source_files(spark, str(tmp_path), ["python"]).count() == 1


def test_written_source_files_are_bounded(spark, tmp_path):
    lines = spark.range(0, 25, 1, 2).select(F.concat(F.lit("int f"), "id", F.lit("() {}")).alias("value"))
    source_queries._files(lines, str(tmp_path / "c"), "a.c", rows=4)
    got = [r.content.splitlines() for r in readers.source_files(spark, str(tmp_path)).collect()]
    assert len(got) >= 7 and max(map(len, got)) <= 4
    assert sorted(x for part in got for x in part) == sorted(f"int f{i}() {{}}" for i in range(25))


def sparse_events(spark, folder, rows=400):
    kinds = "id * 1000 AS event_id", "timestamp'2024-01-01' AS ts", "if(id % 7 = 0, null, id % 30) AS user_id", "'view' AS event_type", "id / 8 AS value", "'' AS props"
    spark.range(rows).selectExpr(*kinds).write.parquet(str(folder / "events.parquet"))
    return str(folder)


def files_of(spark, name, run):
    """What ``run`` returns, and the files that it wrote below a folder of that name."""
    kept = Path(checkpoint_folder(spark).removeprefix("file:"))
    before = set(kept.glob(f"{name}-*"))
    rows = run().collect()
    (folder,) = set(kept.glob(f"{name}-*")) - before
    return rows, [f for f in folder.rglob("part-*") if f.stat().st_size]


def test_written_truth_is_in_few_files_whatever_the_ids(spark, tmp_path):
    sf = sparse_events(spark, tmp_path)
    rows, files = files_of(spark, "truth", lambda: source_queries.ground_truth_file(spark, sf))
    assert sum(r.n for r in rows) == 400 and len(files) <= 2 * spark.sparkContext.defaultParallelism
    want = Counter((f"m{i % 30 % 20}#fn_{i % 30}", int(i / 8 * 100) % 10 < 4) for i in range(400) if i % 7)
    assert {(r.sample_id, r.label): r.n for r in rows if "#fn_" in (r.sample_id or "")} == want


def test_written_labels_are_in_few_files_whatever_the_ids(spark, tmp_path):
    sf = sparse_events(spark, tmp_path)
    rows, files = files_of(spark, "json", lambda: source_queries.labelled_from_json(spark, sf))
    assert len(files) <= 2 * spark.sparkContext.defaultParallelism and all(len(r.code_md5) == 32 for r in rows)
    want = Counter((f"fn_{i % 30}", int(i / 8 * 100) % 10 < 4) for i in range(400) if i % 7)
    assert Counter((r.function_name, r.label) for r in rows) == want  # without a user there is no code


@pytest.mark.parametrize(("most", "chars", "longest"), [(4, 10**9, 4), (1000, 100, 10), (1000, 1, 1), (1000, 10**9, 50)])
def test_json_arrays_are_bounded(spark, tmp_path, most, chars, longest):
    rows = spark.range(0, 100, 1, 2).select("id", F.when(F.col("id") % 3 == 0, F.lit('],\n"\\é')).alias("t"))
    source_queries._json_arrays(rows, str(tmp_path / "j"), most, chars)
    parts = [json.loads(f.read_text()) for f in (tmp_path / "j").glob("part-*")]
    assert max(map(len, parts)) <= longest and (longest < 50 or len(parts) == 2)
    got = spark.read.schema("id bigint, t string").option("multiLine", True).json(str(tmp_path / "j"))
    assert sorted((r.id, r.t) for r in got.collect()) == [(i, '],\n"\\é' if i % 3 == 0 else None) for i in range(100)]
    source_queries._json_arrays(rows.filter("id < 0"), str(tmp_path / "none"), most, chars)
    assert spark.read.schema("id bigint, t string").option("multiLine", True).json(str(tmp_path / "none")).count() == 0


def test_labelled_files(spark, tmp_path):
    csv = write(tmp_path / "d.csv", 'code,target,cwe\n"int f(int a) {\n return ""x"";\n}",1,CWE-1\n"",0,\n"void g() {}",0,\n')
    got = {(r.function_name, r.label) for r in readers.labelled_csv(spark, csv, "set").collect()}
    assert got == {("f", True), ("g", False)}
    js = write(tmp_path / "d.json", json.dumps([{"code": "int h(int a) {}", "has_vulnerability": True}, {"func": "int k(int a) {}"}, {"code": "int m(int a) {}", "label": "vuln"}]))
    got = {(r.function_name, r.label) for r in readers.labelled_json(spark, js, "set").collect()}
    assert got == {("h", True), ("k", False), ("m", True)}


def test_manifests(spark, tmp_path):
    write(tmp_path / "p1" / "requirements.txt", "﻿flask==0.12\n# c\n-r x\nplain\nreq >= 2.0\n")
    write(tmp_path / "p2" / "setup.py", "setup(install_requires={'a': '1.0'})")
    write(tmp_path / "p3" / "pom.xml", "<properties><v>1.1</v></properties><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency>")
    got = {(r.name, r.version, r.ecosystem) for r in readers.manifests(spark, str(tmp_path)).collect()}
    assert got == {("flask", "0.12", "PyPI"), ("req", "2.0", "PyPI"), ("a", "1.0", "PyPI"), ("g:a", "1.1", "Maven")}


def test_sarif_lines_are_shifted_and_clamped(spark, tmp_path):
    loc = lambda n: {"physicalLocation": {"artifactLocation": {"uri": "a.c"}, "region": {"startLine": n, "startColumn": 2}}}
    doc = {"runs": [{"results": [{"ruleId": "r", "message": {"text": "m" * 300}, "locations": [loc(20), loc(3), loc(0)]}]}]}
    rows = readers.scanner_reports(spark, write(tmp_path / "r.sarif", json.dumps(doc)), "sarif").collect()
    assert sorted(r.line for r in rows) == [1, 1, 12] and {len(r.message) for r in rows} == {200}


def test_reports_skip_unreadable_files(spark, tmp_path):
    write(tmp_path / "a.json", json.dumps({"timestamp": "2024", "dataset": "d", "preset": "v1", "sample_count": 3, "metrics": {"F1": 0.5}}))
    write(tmp_path / "b.json", "{not json")
    rows = readers.eval_reports(spark, str(tmp_path)).collect()
    assert [(r.report_id, r.metrics.F1) for r in rows] == [("a.json", 0.5)]


def test_loading_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "kb")
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), ("", "z"), (None, "w")], "id string, document string")
    writers.load_new(docs, path)
    writers.load_new(docs.unionByName(spark.createDataFrame([("c", "n")], docs.schema)), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_writers(spark, tmp_path):
    r = spark.createDataFrame([("k", True, "llm_x", "d", "v1", 1), ("j", False, "static_deterministic", "d", "v1", 2)],
                              "key string, has_vulnerability boolean, final_method string, dataset string, preset string, _debug int")
    s = writers.scan_report(r, str(tmp_path / "scan")).collect()[0]
    assert (s.total, s.vulnerable) == (2, 1)
    writers.eval_report(r, str(tmp_path / "ev"))
    assert "_debug" not in spark.read.json(str(tmp_path / "ev")).columns
    writers.write_cache(r, str(tmp_path / "cache"))
    assert [x.key for x in spark.read.parquet(str(tmp_path / "cache")).collect()] == ["k"]
    writers.results_csv(r, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_model_hook(spark):
    req = spark.createDataFrame([("r1", "s", "p", "", 0.0, 5)], "request_id string, stage string, prompt string, system string, temperature double, max_tokens int")
    got = triage.score_with(req, lambda batch: batch["prompt"] + "!").collect()
    assert [(r.request_id, r.raw) for r in got] == [("r1", "p!")]


def test_a_second_call_handles_new_files_only(spark, tmp_path):
    src, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    write(src / "a.json", json.dumps({"file": "a.py", "language": "python", "content": "def f(x):\n  eval(x)\n"}))

    def run():
        stream = incremental.arriving(spark, str(src), "file string, language string, content string", "json")
        return sorted(tuple(r) for r in incremental.run_available(incremental.scan_files(stream).select("sample_id", "sink_type"), table, state).collect())

    assert run() == [("a.py#f#1", "eval")]
    write(src / "b.json", json.dumps({"file": "b.py", "language": "python", "content": "def g(x):\n  exec(x)\n"}))
    assert run() == [("a.py#f#1", "eval"), ("b.py#g#1", "exec")]
    assert run() == [("a.py#f#1", "eval"), ("b.py#g#1", "exec")]
