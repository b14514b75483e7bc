"""Readers: files of the audit world into tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import schemas
from auditlake.functions import rulebook as rb
from auditlake.operators.extract import basename, function_name, language_from_path, sample_key
from auditlake.sources import json_elements

# --- source files -------------------------------------------------------------


def source_files(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """Every source file below ``root`` with its language and text.

    The name filter reaches the file listing, the language filter the scan;
    content is decoded as UTF-8 with a leading byte-order mark removed.
    """
    kept = [e for e, lang in rb.LANGUAGE_BY_EXTENSION.items() if languages is None or lang in languages]
    glob = "*.{" + ",".join(e[1:] for e in kept) + "}"
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    )
    return _decoded(raw)


def _decoded(raw: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return raw.select(
        F.col("path").alias("file"), language_from_path(F.col("path")).alias("language"), text.alias("content")
    ).filter(F.col("language").isNotNull())


def labelled_csv(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Labelled functions from CSV, columns found by header name; rows without code are dropped.

    All files of one call must have the same header; another order of columns
    fails instead of being read under wrong names.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    for name in ("code", "func", "target", "cwe", "project", "func_name", "file"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    return _labelled(raw, F.col("target").try_cast("int") == 1, F.col("func_name"), F.col("cwe"), dataset)


def labelled_json(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Labelled functions from a JSON array; a missing label is False."""
    raw = spark.read.schema(schemas.LABELLED_JSON).option("multiLine", True).json(path)
    label = F.coalesce("has_vulnerability", F.col("label") == "vuln", F.lit(False))
    return _labelled(raw, label, F.col("function_name"), F.coalesce("cwe", "cwe_id"), dataset)


def _labelled(raw: DataFrame, label: Column, name: Column, cwe: Column, dataset: str) -> DataFrame:
    code = F.coalesce(F.when(F.trim("code") != "", F.col("code")), F.col("func"))
    rows = raw.withColumn("code", code).filter(F.trim(F.coalesce("code", F.lit(""))) != "")
    fallback = F.concat(F.lit("fn_"), F.substring(F.md5("code"), 1, 12))
    fn = F.coalesce(F.when(name != "", name), function_name(F.col("code"), fallback))
    rows = rows.withColumn("_fn", fn)
    file = F.coalesce(F.when(F.col("file") != "", F.col("file")), F.concat(F.lit(f"{dataset}/"), "_fn"))
    return rows.select(
        # copies of one function in one file are told apart by their text
        F.concat_ws("#", file, F.col("_fn"), F.substring(F.md5("code"), 1, 12)).alias("sample_id"),
        sample_key(file, F.col("_fn")).alias("evaluation_key"),
        file.alias("file"),
        F.col("_fn").alias("function_name"),
        cwe.alias("cwe"),
        F.coalesce(label, F.lit(False)).alias("label"),
        "code",
        "project",
        F.lit(dataset).alias("dataset"),
    )


def good_bad_pairs(pairs: DataFrame, *, min_chars: int = 20) -> DataFrame:
    """One record with ``good`` and ``bad`` code into two labelled rows."""
    keep = [c for c in pairs.columns if c not in ("good", "bad")]
    return (
        pairs.unpivot(keep, ["bad", "good"], "kind", "code")
        .filter(F.length("code") > min_chars)
        .withColumn("label", F.col("kind") == "bad")
        .drop("kind")
    )


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.GROUND_TRUTH).option("multiLine", True).json(path)
    return raw.withColumn("sample_id", sample_key(F.col("file"), F.col("function_name"))).withColumn(
        "label", F.coalesce("has_vulnerability", F.lit(False))
    )


# --- scanner output ----------------------------------------------------------


def sarif(docs: DataFrame, *, line_offset: int = rb.C_WRAPPER_LINES) -> DataFrame:
    """Findings of SARIF documents (one ``runs`` column per row)."""
    result = docs.select(F.explode("runs").alias("run")).select(F.explode("run.results").alias("r"))
    located = result.select("r", F.explode("r.locations").alias("loc"))
    region = F.col("loc.physicalLocation.region")
    raw_line = F.coalesce(F.when(region["startLine"] != 0, region["startLine"]), F.lit(1))
    return located.select(
        F.coalesce(F.col("loc.physicalLocation.artifactLocation.uri"), F.lit("")).alias("uri"),
        F.lit("codeql").alias("tool"),
        F.coalesce(F.col("r.ruleId"), F.lit("?")).alias("type"),
        F.greatest(F.lit(1), raw_line - line_offset).alias("line"),
        region["startColumn"].alias("column"),
        F.coalesce(F.col("r.level"), F.lit("warning")).alias("severity"),
        F.substring(F.coalesce(F.col("r.message.text"), F.lit("")), 1, 200).alias("message"),
    )


def semgrep(docs: DataFrame) -> DataFrame:
    r = docs.select(F.explode("results").alias("r"))
    return r.select(
        F.coalesce(F.col("r.path"), F.lit("")).alias("uri"),
        F.lit("semgrep").alias("tool"),
        F.coalesce(F.col("r.check_id"), F.lit("")).alias("type"),
        F.coalesce(F.col("r.start.line"), F.lit(0)).alias("line"),
        F.lit(None).cast("int").alias("column"),
        F.coalesce(F.col("r.extra.severity"), F.lit("WARNING")).alias("severity"),
        F.substring(F.coalesce(F.col("r.extra.message"), F.lit("")), 1, 200).alias("message"),
    )


def bandit(docs: DataFrame) -> DataFrame:
    r = docs.select(F.explode("results").alias("r"))
    return r.select(
        F.coalesce(F.col("r.filename"), F.lit("")).alias("uri"),
        F.lit("bandit").alias("tool"),
        F.coalesce(F.col("r.test_id"), F.lit("")).alias("type"),
        F.coalesce(F.col("r.line_number"), F.lit(0)).alias("line"),
        F.lit(None).cast("int").alias("column"),
        F.coalesce(F.col("r.issue_severity"), F.lit("medium")).alias("severity"),
        F.substring(F.coalesce(F.col("r.issue_text"), F.lit("")), 1, 200).alias("message"),
        F.coalesce(F.col("r.issue_confidence"), F.lit("medium")).alias("confidence"),
    )


_SCANNERS = {
    "sarif": (schemas.SARIF, sarif), "semgrep": (schemas.SEMGREP, semgrep), "bandit": (schemas.BANDIT, bandit),
}


def scanner_reports(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Findings out of report files; ``kind`` is sarif, semgrep or bandit."""
    schema, flatten = _SCANNERS[kind]
    return flatten(spark.read.schema(schema).option("multiLine", True).json(path))


def scanner_texts(df: DataFrame, text: str, kind: str) -> DataFrame:
    """The same for reports held as text in a column."""
    schema, flatten = _SCANNERS[kind]
    return flatten(df.select(F.from_json(text, schema).alias("j")).select("j.*"))


# --- dependency manifests -----------------------------------------------------

# --- fixed values: version separators, in the order they are tried -----------
SEPARATORS = ["==", ">=", "<=", "~=", "!=", ">"]


def requirement_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """name, version out of requirement lines; other columns are kept."""
    text = F.trim(F.regexp_replace(F.col(line), "^﻿", ""))
    keep = [c for c in lines.columns if c != line]
    rows = lines.withColumn("_t", text).filter(
        (F.col("_t") != "") & ~F.col("_t").startswith("#") & ~F.col("_t").startswith("-")
    )
    used = F.coalesce(*[F.when(F.col("_t").contains(s), F.lit(s)) for s in SEPARATORS])
    rows = rows.withColumn("_s", used).filter(F.col("_s").isNotNull())
    at = F.instr(F.col("_t"), F.col("_s"))
    return rows.select(
        *keep,
        F.trim(F.substring(F.col("_t"), F.lit(1), at - 1)).alias("name"),
        F.trim(F.substring(F.col("_t"), at + F.length("_s"), F.length("_t"))).alias("version"),
        F.lit("PyPI").alias("ecosystem"),
    )


# --- fixed values: how names and versions are written in setup scripts and project files --
_SETUP_PAIR = r"""['"]([^'"]+)['"]\s*[:>=]=?\s*['"]([^'"]+)['"]"""

_PROPERTY = r"<([^>]+)>([^<]+)</\1>"
_DEPENDENCY = (
    r"<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>\s*<version>([^<]+)</version>"
)


def setup_pairs(files: DataFrame, content: str = "content") -> DataFrame:
    """name, version pairs quoted in setup scripts."""
    keep = [c for c in files.columns if c != content]
    pairs = F.arrays_zip(
        F.regexp_extract_all(content, F.lit(_SETUP_PAIR), 1).alias("name"),
        F.regexp_extract_all(content, F.lit(_SETUP_PAIR), 2).alias("version"),
    )
    return files.select(*keep, F.explode(pairs).alias("p")).select(
        *keep, F.trim("p.name").alias("name"), F.trim("p.version").alias("version"), F.lit("PyPI").alias("ecosystem")
    )


def pom_dependencies(files: DataFrame, content: str = "content") -> DataFrame:
    """group:artifact and version; ``${ref}`` is looked up among the file's own tags.

    The lookup stays in the row (last definition of a tag wins), so no file has
    to be joined with itself.
    """
    keep = [c for c in files.columns if c != content]
    names = F.regexp_extract_all(content, F.lit(_PROPERTY), 1)
    values = F.regexp_extract_all(content, F.lit(_PROPERTY), 2)
    deps = F.arrays_zip(
        *[F.regexp_extract_all(content, F.lit(_DEPENDENCY), i).alias(n) for i, n in ((1, "g"), (2, "a"), (3, "v"))]
    )
    rows = files.select(
        *keep, F.arrays_zip(names.alias("n"), values.alias("v")).alias("_props"), F.explode(deps).alias("d")
    )
    ref = F.regexp_extract("d.v", r"^\$\{([^}]+)\}$", 1)
    resolved = F.element_at(F.filter("_props", lambda p: p["n"] == ref), -1)["v"]
    looked_up = F.when(F.exists("_props", lambda p: p["n"] == ref), resolved).otherwise(ref)
    return rows.filter((ref != "") | ~F.col("d.v").contains("$")).select(
        *keep,
        F.concat_ws(":", "d.g", "d.a").alias("name"),
        F.when(ref != "", looked_up).otherwise(F.col("d.v")).alias("version"),
        F.lit("Maven").alias("ecosystem"),
    )


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """All dependencies below ``root``: project, manifest, name, version, ecosystem."""

    def files(name: str) -> DataFrame:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
        return raw.select(
            F.regexp_replace("path", r"/[^/]*$", "").alias("project"), F.lit(name).alias("manifest"),
            F.decode("content", "UTF-8").alias("content"),
        )

    lines = files("requirements.txt").select("project", "manifest", F.explode(F.split("content", r"\r?\n")).alias("value"))
    return (
        requirement_lines(lines)
        .unionByName(setup_pairs(files("setup.py")))
        .unionByName(pom_dependencies(files("pom.xml")))
    )


def advisories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ADVISORY).option("multiLine", True).json(path)


# --- knowledge feeds ----------------------------------------------------------


def cve_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(schemas.CVE_CSV).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    )


def cwe_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CWE_LIST).option("multiLine", True).json(path)


def exploited_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the catalogue, one file read by many tasks; an entry that can't be read has its text in ``_corrupt_record``."""
    return json_elements.parsed(json_elements.elements(spark, path), schemas.EXPLOITED_ENTRY).drop("file")


def cve_feed(spark: SparkSession, path: str) -> DataFrame:
    """Records of a feed (cve), read and set aside likewise."""
    return json_elements.parsed(json_elements.elements(spark, path), f"cve {schemas.CVE_ENTRY}").drop("file")


# --- responses and saved reports ----------------------------------------------


def responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESPONSES).json(path)


def eval_reports(spark: SparkSession, path: str) -> DataFrame:
    """Saved reports; files that cannot be read are left out."""
    raw = (
        spark.read.schema(schemas.EVAL_REPORT + ", _corrupt_record string").option("multiLine", True)
        .option("mode", "PERMISSIVE").json(path)
    )
    name = basename(F.col("_metadata.file_path"))
    return whole_reports(raw.withColumn("size_bytes", F.col("_metadata.file_size")).withColumn("report_id", F.coalesce("report_id", name)))


def whole_reports(raw: DataFrame) -> DataFrame:
    """Reports without the broken ones."""
    return raw.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
