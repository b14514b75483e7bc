"""Findings of several tools: unified table, consensus, coverage, attachment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import rulebook as rb
from auditlake.functions.columns import lookup, settle, str_array
from auditlake.operators.extract import wrapped_name
from auditlake.operators.ranking import rank_within

SHAPE = ["sample_id", "tool", "type", "line", "column", "severity", "message"]


def unify(*tables: DataFrame) -> DataFrame:
    """One findings table out of several; columns a tool lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def sink_findings(slices: DataFrame) -> DataFrame:
    """The rule scan's own finding for each slice with a sink."""
    return slices.filter(F.col("sink_type").isNotNull()).select(
        "sample_id",
        F.lit("codeslicer").alias("tool"),
        F.col("sink_category").alias("type"),
        F.col("line_start").alias("line"),
        F.col("risk_level").alias("severity"),
        F.concat(
            F.lit("Sink "), "sink_type", F.lit(" ("), "sink_category", F.lit("), risk="), "risk_level"
        ).alias("message"),
    )


def attach_by_content(samples: DataFrame, tool_output: DataFrame, *, file_column: str = "uri") -> DataFrame:
    """Tool output back to samples by content-addressed file name.

    Copies of the same code all keep the findings.  A heavily copied function
    is a hot key on the sample side only, which adaptive execution splits.
    """
    keyed = samples.select("sample_id", wrapped_name(F.col("code"), F.col("language")).alias(file_column))
    named = tool_output.withColumn(file_column, F.regexp_extract(F.col(file_column), r"([^/\\]*)$", 1))
    return keyed.join(named, file_column, "left")


def per_sample_types(findings: DataFrame) -> DataFrame:
    """(sample_id, type) counts; combined map-side, so a hot sample shrinks before the shuffle."""
    return findings.groupBy("sample_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("tool").alias("tools")
    )


def type_profile(findings: DataFrame) -> DataFrame:
    """(sample_id, profile): array<struct<type,n,tools>>, one entry per type of the sample."""
    return per_sample_types(findings).groupBy("sample_id").agg(
        F.collect_list(F.struct("type", "n", "tools")).alias("profile")
    )


def _agreement(profile: Column) -> dict[str, Column]:
    """Consensus columns of a profile."""
    count = F.aggregate(profile, F.lit(0).cast("bigint"), lambda acc, p: acc + p["n"])
    tools = F.array_sort(F.array_distinct(F.flatten(F.transform(profile, lambda p: p["tools"]))))
    types = F.array_sort(F.transform(profile, lambda p: p["type"]))
    modal = F.array_min(F.transform(profile, lambda p: F.struct((-p["n"]).alias("neg"), p["type"].alias("type"))))
    agree = (count >= 2) & (F.size(profile) < count)
    level = (
        F.when(count == 0, "no_signal")
        .when((F.size(tools) >= 2) & agree, "high")
        .when((F.size(tools) == 1) & (count >= 2), "medium")
        .when(F.size(tools) >= 2, "conflict")
        .otherwise("low")
    )
    detail = (
        F.when(level == "no_signal", "")
        .when(level == "high", F.concat(F.size(tools).cast("string"), F.lit(" tools agree on sink area")))
        .when(level == "medium", "single tool with multiple findings")
        .when(level == "conflict", F.concat(F.lit("tools disagree: "), F.array_join(types, ", ")))
        .otherwise("single finding or weak signal")
    )
    return {
        "finding_count": count,
        "tools": tools,
        "types": types,
        "tool_count": F.size(tools),
        "level": level,
        "agreed_area": F.when(level != "conflict", modal["type"]),
        "detail": detail,
        "cross_tool": F.exists(profile, lambda p: F.size(p["tools"]) >= 2),
    }


def consensus(findings: DataFrame) -> DataFrame:
    """How far the tools agree on a sample.

    Levels: high (two or more tools, some type repeated), conflict (two or more
    tools, nothing repeated), medium (one tool, several findings), low.
    The modal type breaks ties alphabetically; ``cross_tool`` says whether a
    repeated type comes from different tools.
    """
    rows = type_profile(findings)
    return rows.select("sample_id", *[c.alias(n) for n, c in _agreement(F.col("profile")).items()])


def covered_classes(tools_run: Column, found_types: Column) -> Column:
    """Classes some tool that ran covers, plus those actually found."""
    table = F.create_map(*[x for t, v in rb.TOOL_COVERS.items() for x in (F.lit(t), str_array(v))])
    per_tool = F.transform(
        tools_run, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))
    )
    return F.array_distinct(F.concat(F.flatten(per_tool), found_types))


def blind_spots(tools_run: Column, found_types: Column) -> Column:
    """Universal gaps, then each tool's own, minus what is covered; order kept."""
    table = F.create_map(*[x for t, v in rb.TOOL_BLIND_SPOTS.items() for x in (F.lit(t), str_array(v))])
    own = F.flatten(
        F.transform(tools_run, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))
    )
    return F.array_except(
        F.array_distinct(F.concat(str_array(rb.UNIVERSAL_BLIND_SPOTS), own)),
        covered_classes(tools_run, found_types),
    )


def tool_reports(slices: DataFrame, findings: DataFrame, *, tools: list[str] | None = None) -> DataFrame:
    """One report per slice: tools run and missing, consensus, blind spots.

    ``findings`` are those of the external tools; the rule scan's own finding
    is added inside the row, so the slices are read once.  ``tools`` names the
    external tools that were run at all (default: those with findings on the
    sample).
    """
    empty = F.array().cast("array<string>")
    shape = "array<struct<type:string,n:bigint,tools:array<string>>>"
    own = F.when(
        F.col("sink_type").isNotNull(),
        F.array(
            F.struct(
                F.col("sink_category").alias("type"), F.lit(1).cast("bigint").alias("n"),
                F.array(F.lit("codeslicer")).alias("tools"),
            )
        ),
    ).otherwise(F.array().cast(shape))
    rows = slices.join(type_profile(findings), "sample_id", "left")
    rows = rows.withColumn("_all", F.concat(F.coalesce("profile", F.array().cast(shape)), own))

    def merged(t: Column) -> Column:
        same = F.filter("_all", lambda p: p["type"] == t)
        return F.struct(
            t.alias("type"),
            F.aggregate(same, F.lit(0).cast("bigint"), lambda acc, p: acc + p["n"]).alias("n"),
            F.array_distinct(F.flatten(F.transform(same, lambda p: p["tools"]))).alias("tools"),
        )

    rows = rows.withColumn("_profile", F.transform(F.array_distinct(F.transform("_all", lambda p: p["type"])), merged))
    rows = settle(rows, con=F.struct(*[c.alias(n) for n, c in _agreement(F.col("_profile")).items()]))
    external = str_array(tools) if tools is not None else F.array_except("con.tools", F.array(F.lit("codeslicer")))
    rows = rows.withColumn("tools_run", F.array_distinct(F.concat(F.array(F.lit("codeslicer")), F.array_sort(external))))
    expected = lookup(rb.EXPECTED_TOOL, F.col("language"))
    failed = F.when(
        expected.isNotNull() & ~F.array_contains("tools_run", expected),
        F.array(F.concat(expected, F.lit(" (not run)"))),
    ).otherwise(empty)
    return rows.select(
        "sample_id", "language", "tools_run",
        failed.alias("tools_failed"),
        F.col("con.finding_count").alias("finding_count"),
        F.struct("con.level", "con.agreed_area", "con.tool_count", "con.detail").alias("consensus"),
        blind_spots(F.col("tools_run"), F.col("con.types")).alias("blind_spots"),
        F.coalesce("sink_type", F.lit("none")).alias("sink"),
        "sink_category", "risk_level",
        F.array_join("sanitizers", "; ").alias("sanitization_detail"),
    )


def supported_by(tool: str) -> Column:
    """Language filter of a tool."""
    return F.col("language") == {"codeql": "c", "semgrep": "python", "bandit": "python"}[tool]


#: Lines that are joined in one go.
BLOCK_LINES = 500


def _finding_lines(findings: DataFrame) -> DataFrame:
    """sample_id, _r (place in the sample), _text: one row for each different finding, with its number."""
    line = F.format_string(
        "  [%s] %s @ line %s: %s",
        F.col("tool"), F.col("type"), F.coalesce(F.col("line").cast("string"), F.lit("?")),
        F.substring(F.coalesce("message", F.lit("")), 1, 120),
    )
    counted = findings.select(
        "sample_id", F.coalesce("line", F.lit(0)).alias("_line"), "tool", "type", line.alias("_text")
    ).groupBy("sample_id", "_line", "tool", "type", "_text").agg(F.count(F.lit(1)).alias("_n"))
    text = F.when(F.col("_n") > 1, F.concat("_text", F.lit(" (x"), F.col("_n").cast("string"), F.lit(")"))).otherwise(
        F.col("_text")
    )
    ranked = rank_within(counted, ["sample_id"], ["_line", "tool", "type", "_text"], "_r")
    return ranked.select("sample_id", "_r", text.alias("_text"))


def _joined(place: str, text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda o: o[text]), "\n")


def _blocks(lines: DataFrame, size: int) -> DataFrame:
    block = F.floor((F.col("_r") - 1) / size).alias("block")
    return lines.groupBy("sample_id", block).agg(_joined("_r", "_text").alias("findings_summary"))


def findings_text(findings: DataFrame, *, most_lines: int) -> DataFrame:
    """Findings of a sample as prompt text, one line each, in line order.

    Identical findings are counted first and written once with their number.  ``most_lines`` is
    the room the caller's prompt has: of more different ones the first stay and a last line says that there
    are more.  ``findings_blocks`` has all lines of any sample as rows.
    """
    told = F.when(F.col("_r") > most_lines, "  ... (more findings)").otherwise(F.col("_text"))
    lines = _finding_lines(findings).filter(F.col("_r") <= most_lines + 1).withColumn("_text", told)
    return _blocks(lines, BLOCK_LINES).groupBy("sample_id").agg(_joined("block", "findings_summary").alias("findings_summary"))


def findings_blocks(findings: DataFrame, *, lines: int = BLOCK_LINES) -> DataFrame:
    """All finding lines as rows: sample_id, block (from 0), findings_summary of at most ``lines`` lines each.

    Places come from range parts, so a sample of any size is neither ordered nor collected in one task.
    """
    return _blocks(_finding_lines(findings), lines)


def merge_nearby(findings: DataFrame, *, within: int = 2, key: tuple[str, ...] = ("sample_id", "cwe")) -> DataFrame:
    """Same class, lines at most ``within`` apart: one finding with a line range.

    Repeated (key, line) rows are combined first, so the ordered pass sees each
    line of a group once.
    """
    distinct = findings.groupBy(*key, "line").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*key).orderBy("line")
    gap = F.col("line") - F.lag("line").over(w)
    marked = distinct.withColumn("_new", F.when(gap.isNull() | (gap > within), 1).otherwise(0))
    grouped = marked.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*key, "_group").agg(
        F.min("line").alias("line_from"), F.max("line").alias("line_to"), F.sum("n").alias("finding_count")
    ).drop("_group")
