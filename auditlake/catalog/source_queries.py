"""Sources and sinks: whole derived tables written to the session's shared folder and read back by the readers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.catalog import derived
from auditlake.catalog.registry import query, table
from auditlake.operators import extract, findings, history, requests
from auditlake.session import checkpoint_folder
from auditlake.sources import readers, writers

_CODE = derived.cte(derived.CODE)


def _folder(spark, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of one written file at most, and characters of one JSON array unless a single row has more.
FILE_ROWS = 5_000
FILE_CHARS = 4_000_000


def _files(lines: DataFrame, folder: str, name: str, rows: int = FILE_ROWS) -> None:
    """Text files of that name below ``folder``, in folders of their own, of at most ``rows`` rows each."""
    spark = lines.sparkSession
    lines.write.option("maxRecordsPerFile", rows).text(f"{folder}/_written-{name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for number, part in enumerate(fs.globStatus(path(f"{folder}/_written-{name}/part-*"))):
        fs.mkdirs(path(f"{folder}/p{number}"))
        fs.rename(part.getPath(), path(f"{folder}/p{number}/{name}"))
    fs.delete(path(f"{folder}/_written-{name}"), True)


def _json_arrays(rows: DataFrame, folder: str, most: int = FILE_ROWS, chars: int = FILE_CHARS) -> None:
    """JSON arrays of at most ``most`` rows, each a file of its own; rows stay in their task, whatever their values."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, length = [], 0

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"[{','.join(held)}]"], pa.string())], ["value"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if held and (len(held) == most or length + len(text) > chars):
                    yield whole()
                    held, length = [], 0
                held.append(text)
                length += len(text)
        if held:
            yield whole()

    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    lines.mapInArrow(arrays, "value string").write.option("maxRecordsPerFile", 1).text(folder)


@query(
    "source_tree",
    f"""SELECT language, concat('fn_', user_id) AS function_name, count(*) AS functions FROM {_CODE} c WHERE language <> 'other' GROUP BY ALL""",
)
def source_tree(spark, sf):
    """Source files below a folder, by extension; other files are not read."""
    folder, code = _folder(spark, "tree"), derived.derive(spark, sf, derived.CODE)
    for language, name in (("c", "a.c"), ("python", "b.py"), ("java", "C.java"), ("c", "notes.txt")):
        _files(code.filter(F.col("language") == language).select(F.concat("code", F.lit("\n")).alias("value")), f"{folder}/{language}", name)
    found = extract.split_functions(readers.source_files(spark, folder)).filter("function_name LIKE 'fn#_%' ESCAPE '#'")
    return found.groupBy("language", "function_name").agg(F.count(F.lit(1)).alias("functions"))


_LABELLED = f"SELECT concat('fn_', user_id) AS function_name, file, label, md5(code) AS code_md5 FROM {_CODE} c"


@query("labelled_from_csv", _LABELLED.replace("SELECT", "SELECT CASE WHEN user_id % 2 = 0 THEN 'CWE-78' END AS cwe,"))
def labelled_from_csv(spark, sf):
    folder, code = _folder(spark, "csv"), derived.derive(spark, sf, derived.CODE)
    code.select(
        F.concat(F.lit("fn_"), "user_id").alias("func_name"), F.when(F.col("user_id") % 2 == 0, "CWE-78").alias("cwe"), F.col("code").alias("func"),
        F.col("label").cast("int").alias("target"), "file",
    ).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(folder)
    rows = readers.labelled_csv(spark, folder, "set")
    return rows.select(F.when(F.col("cwe") != "", F.col("cwe")).alias("cwe"), "function_name", "file", "label", F.md5("code").alias("code_md5"))


@query("labelled_from_json", _LABELLED)
def labelled_from_json(spark, sf):
    folder, code = _folder(spark, "json"), derived.derive(spark, sf, derived.CODE)
    rows = code.select(F.concat(F.lit("fn_"), "user_id").alias("function_name"), "file", F.when(F.col("label"), "vuln").alias("label"), "code", "row_ord")
    _json_arrays(rows, folder)
    return readers.labelled_json(spark, folder, "set").select("function_name", "file", "label", F.md5("code").alias("code_md5"))


@query("ground_truth_file", f"SELECT concat('m', user_id % 20, '#fn_', user_id) AS sample_id, label, count(*) AS n FROM {_CODE} c GROUP BY ALL")
def ground_truth_file(spark, sf):
    folder, code = _folder(spark, "truth"), derived.derive(spark, sf, derived.CODE)
    rows = code.select(F.concat(F.lit("x/m"), F.col("user_id") % 20).alias("file"), F.concat(F.lit("fn_"), "user_id").alias("function_name"), F.when(F.col("label"), True).alias("has_vulnerability"), "row_ord")
    _json_arrays(rows, folder)
    return readers.ground_truth(spark, folder).groupBy("sample_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("cve_file", f"SELECT cve_id, cwe_id, summary, project, lang, score, publish_date FROM {derived.cte(derived.CVE_ROWS)} c")
def cve_file(spark, sf):
    folder = _folder(spark, "cve")
    columns = ["cve_id", "cwe_id", "summary", "project", "lang", "score", "publish_date"]
    derived.derive(spark, sf, derived.CVE_ROWS).select(columns).write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(folder)
    rows = readers.cve_csv(spark, folder)
    return rows.select([F.coalesce(c, F.lit("")).alias(c) for c in columns])


@query("cwe_file", "SELECT concat('CWE-', p_partkey) AS id, p_name AS name, p_type || ',' || p_brand AS examples, 'c' AS language FROM part")
def cwe_file(spark, sf):
    folder = _folder(spark, "cwe")
    rows = table(spark, sf, "part").select(
        F.concat(F.lit("CWE-"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("code_examples"), F.lit("c").alias("language"), "p_partkey"
    )
    _json_arrays(rows, folder)
    return readers.cwe_list(spark, folder).select("id", "name", F.array_join("code_examples", ",").alias("examples"), "language")


@query("response_file", f"SELECT sample_id AS request_id, md5(raw) AS raw_md5 FROM {derived.cte(derived.RESPONSES)} r")
def response_file(spark, sf):
    folder = _folder(spark, "responses")
    derived.derive(spark, sf, derived.RESPONSES).select(F.col("sample_id").alias("request_id"), "raw", F.lit("2024-01-01T00:00:00Z").alias("created_at")).write.json(folder)
    return readers.responses(spark, folder).select("request_id", F.md5("raw").alias("raw_md5"))


@query("report_files", "SELECT 'r' || o_orderkey AS report_id, o_orderpriority AS preset, CAST(o_custkey AS INT) AS sample_count FROM orders WHERE o_orderkey % 10 <> 0")
def report_files(spark, sf):
    """Saved reports, one file each bucket; broken files are left out."""
    folder = _folder(spark, "reports")
    o = table(spark, sf, "orders")
    whole = F.to_json(F.struct(F.concat(F.lit("r"), "o_orderkey").alias("report_id"), F.col("o_orderpriority").alias("preset"), F.col("o_custkey").cast("int").alias("sample_count")))
    # every tenth report was cut off while it was written
    o.select(F.when(F.col("o_orderkey") % 10 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("value")).write.text(folder)
    raw = spark.read.schema(readers.schemas.EVAL_REPORT + ", _corrupt_record string").option("mode", "PERMISSIVE").json(folder)
    return readers.whole_reports(raw).select("report_id", "preset", "sample_count")


_DEPS = derived.cte(derived.DEPENDENCIES)


@query("manifest_files", f"SELECT name, version, 'PyPI' AS ecosystem, count(*) AS n FROM {_DEPS} d GROUP BY ALL")
def manifest_files(spark, sf):
    """Requirement files below a folder."""
    folder, deps = _folder(spark, "manifests"), derived.derive(spark, sf, derived.DEPENDENCIES)
    _files(deps.select(F.concat("name", F.lit("=="), "version").alias("value")), folder, "requirements.txt")
    return readers.manifests(spark, folder).groupBy("name", "version", "ecosystem").agg(F.count(F.lit(1)).alias("n"))


_RES = derived.cte(derived.RESULTS)


@query("scan_report_written", f"SELECT count(*) AS total, count(*) FILTER (WHERE final_verdict = 'vuln') AS vulnerable, count(*) AS written FROM {_RES} r")
def scan_report_written(spark, sf):
    folder = _folder(spark, "report")
    rows = derived.derive(spark, sf, derived.RESULTS).withColumn("has_vulnerability", F.col("final_verdict") == "vuln")
    writers.scan_report(rows, folder)
    return spark.read.json(f"{folder}/summary").select("total", "vulnerable", F.lit(spark.read.json(f"{folder}/results").count()).cast("bigint").alias("written"))


@query("results_csv_written", f"SELECT sample_id, final_verdict, reasoning FROM {_RES} r")
def results_csv_written(spark, sf):
    folder = _folder(spark, "results")
    writers.results_csv(derived.derive(spark, sf, derived.RESULTS).select("sample_id", "final_verdict", "reasoning"), folder)
    back = spark.read.option("header", True).option("escape", '"').csv(folder)
    return back.select("sample_id", "final_verdict", F.coalesce("reasoning", F.lit("")).alias("reasoning"))


@query("evaluation_written", f"SELECT sample_id, 'd' || (pattern_count % 2) AS dataset, final_method AS preset FROM {_RES} r")
def evaluation_written(spark, sf):
    folder = _folder(spark, "evaluation")
    rows = derived.derive(spark, sf, derived.RESULTS).select("sample_id", F.concat(F.lit("d"), F.col("pattern_count") % 2).alias("dataset"), F.col("final_method").alias("preset"), F.lit(1).alias("_inner"))
    writers.eval_report(rows, folder)
    back = spark.read.option("basePath", folder).json(folder)
    return back.select("sample_id", "dataset", "preset") if "_inner" not in back.columns else back


def _feeds(spark, sf, rows: str, name: str) -> str:
    """Feed documents of 200 records each in a few files; the last document is cut off."""
    folder, opening = _folder(spark, name), '{"vulnerabilities": ['
    record = F.expr(f"substring(doc, {len(opening) + 1}, length(doc) - {len(opening) + 2})")
    docs = derived.derive(spark, sf, rows).select(F.floor(F.col("p_partkey") / 200).alias("block"), "p_partkey", record.alias("r"))
    told = docs.groupBy("block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "r"))), lambda x: x["r"]), ", ").alias("r"))
    told.select(F.concat(F.lit(opening), "r", F.lit("]}")).alias("value")).unionByName(spark.range(1).select(F.lit(opening + '{"cve": {"id": "cut').alias("value"))).coalesce(3).write.text(folder)
    return folder


@query(
    "feed_elements",
    "SELECT 'CVE-2022-' || p_partkey AS id, 'Analyzed' AS status, false AS broken FROM part UNION ALL SELECT NULL, NULL, true",
)
def feed_elements(spark, sf):
    """Feeds read element by element; what can't be read is set aside."""
    rows = derived.FEED.replace("SELECT ", "SELECT p_partkey, ", 1)
    feed = readers.cve_feed(spark, _feeds(spark, sf, rows, "feeds"))
    broken = F.col("_corrupt_record").isNotNull()
    return feed.select(F.when(~broken, F.col("cve.id")).alias("id"), F.when(~broken, F.col("cve.vulnStatus")).alias("status"), broken.alias("broken"))


@query("load_twice", "SELECT CAST(l_partkey AS VARCHAR(20)) AS id, min(l_orderkey) AS first_order, count(*) * 0 + 1 AS copies FROM lineitem GROUP BY l_partkey")
def load_twice(spark, sf):
    """Loading the same rows again, or duplicates of an id, adds nothing."""
    folder = _folder(spark, "load")
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("id"), F.lpad(F.col("l_orderkey").cast("string"), 20, "0").alias("o"))
    writers.load_new(rows, folder)
    writers.load_new(rows, folder)
    return spark.read.parquet(folder).groupBy("id").agg(F.min("o").cast("bigint").alias("first_order"), F.count(F.lit(1)).alias("copies"))


@query("cache_written", f"SELECT sample_id AS key, final_verdict FROM {_RES} r WHERE final_method LIKE 'llm%' OR final_method LIKE 'tool_aware%'")
def cache_written(spark, sf):
    folder = _folder(spark, "cache")
    for _ in range(2):  # the same run again, as after a failure
        writers.write_cache(derived.derive(spark, sf, derived.RESULTS).withColumnRenamed("sample_id", "key"), folder, run="first")
    return spark.read.parquet(folder).select("key", F.get_json_object("payload", "$.final_verdict").alias("final_verdict"))


@query("comparison_written", f"SELECT sample_id, run FROM {_RES} r CROSS JOIN (SELECT unnest(['baseline', 'rag']) AS run) x")
def comparison_written(spark, sf):
    folder, rows = _folder(spark, "comparison"), derived.derive(spark, sf, derived.RESULTS)
    writers.comparison(rows, rows, folder)
    return spark.read.json(folder).select("sample_id", "run")


@query("mitigation_lists", "SELECT p_partkey, CAST(CASE WHEN p_size % 4 = 0 THEN 0 ELSE 2 END AS INT) AS parts, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS first_part FROM part")
def mitigation_lists(spark, sf):
    """Mitigation text back into a list."""
    detail = F.when(F.col("p_size") % 4 != 0, F.concat_ws("; ", "p_type", "p_brand"))
    back = requests.context(detail)
    return table(spark, sf, "part").select("p_partkey", F.size(back).alias("parts"), F.coalesce(F.try_element_at(back, F.lit(1)), F.lit("")).alias("first_part"))


@query("tool_languages", f"SELECT tool, count(*) AS functions FROM {_CODE} c JOIN (VALUES ('codeql', 'c'), ('semgrep', 'python'), ('bandit', 'python')) t(tool, lang) ON t.lang = c.language GROUP BY tool")
def tool_languages(spark, sf):
    """How many functions each tool can look at."""
    code = derived.derive(spark, sf, derived.CODE)
    able = F.array_compact(F.array(*[F.when(findings.supported_by(t), t) for t in ("codeql", "semgrep", "bandit")]))
    return code.select(F.explode(able).alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("functions"))


_BASE = "SELECT p_brand AS config, 's' || p_size AS section, p_type AS key, min(p_type) AS value FROM {part} GROUP BY ALL"
_OVER = "SELECT p_brand AS config, 's' || p_size AS section, p_type AS key, min(p_name) AS value FROM {part} WHERE p_size % 3 = 0 GROUP BY ALL UNION ALL SELECT 'new', 's', 'k', min(p_name) FROM {part}"


@query("merged_overrides", f"SELECT config, section, key, coalesce(o.value, b.value) AS value FROM {derived.cte(_BASE)} b FULL JOIN {derived.cte(_OVER)} o USING (config, section, key)")
def merged_overrides(spark, sf):
    return requests.merge_overrides(derived.derive(spark, sf, _BASE), derived.derive(spark, sf, _OVER))


@query(
    "preset_parameters",
    "SELECT p_brand AS config, max(CASE WHEN p_size % 2 = 0 THEN p_type END) AS code_window_mode, max(CASE WHEN p_size % 2 = 1 THEN p_type END) AS strategy FROM part GROUP BY p_brand",
)
def preset_parameters(spark, sf):
    even = F.col("p_size") % 2 == 0
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("config"), F.when(even, "code_window").otherwise("llm").alias("section"), F.lit("mode").alias("key"), F.col("p_type").alias("value")
    )
    return requests.preset_comparison(rows).select("config", "code_window_mode", "strategy")


@query("first_of_filtered", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def first_of_filtered(spark, sf):
    """The head of a filtered, ordered list (a top-k report)."""
    return history.head(table(spark, sf, "orders"), "o_orderstatus = 'F'", F.desc("o_totalprice"), "o_orderkey", n=20).select("o_orderkey", "o_totalprice")
