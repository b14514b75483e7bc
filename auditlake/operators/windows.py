"""Code windows around finding lines, cut inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def head(code: Column, max_chars: int) -> Column:
    return F.substring(code, 1, max_chars)


def focus_window(code: Column, focus: Column, *, lines: int = 5, max_chars: int = 3000, fallback_chars: int = 2000) -> Column:
    """±``lines`` around each focus line (1-based), ascending, every line once.

    A marker follows each focus.  Windows are visited in ascending order and
    are equally wide, so a line was already written exactly when it lies before
    the end of the previous window; no line table is needed.
    """
    text = F.split(code, "\n")
    total = F.size(text)
    wanted = F.array_sort(F.array_distinct(F.filter(focus, lambda f: f > 0)))

    def end_of(f: Column) -> Column:
        return F.least(total, f + F.lit(lines))

    def part(f: Column, i: Column) -> Column:
        before = F.coalesce(F.try_element_at(wanted, i), F.lit(-lines))
        start = F.greatest(F.lit(0), f - F.lit(1 + lines), F.when(i > 0, end_of(before)).otherwise(F.lit(0)))
        count = F.greatest(F.lit(0), end_of(f) - start)
        marker = F.concat(F.lit("# --- focus line "), f.cast("string"), F.lit(" ---"))
        return F.concat(F.slice(text, start + F.lit(1), count), F.array(marker))

    joined = F.array_join(F.flatten(F.transform(wanted, part)), "\n")
    cut = F.when(
        F.length(joined) > max_chars, F.concat(F.substring(joined, 1, max_chars), F.lit("\n# ... (truncated)"))
    ).otherwise(joined)
    return F.when(F.size(wanted) > 0, cut).otherwise(head(code, fallback_chars))


def focus_lines(findings: DataFrame, *, max_chars: int) -> DataFrame:
    """Distinct finding lines and distinct tools per sample, ready for windows of ``max_chars``.

    Give the same number as to the window (the preset's ``iris_max_chars``): it
    holds at most max_chars / len(marker) focuses, so the smallest that many
    lines decide the text; a sample with millions of finding lines still yields
    a short array and the same window.
    """
    enough = max_chars // len("# --- focus line 1 ---") + 2
    lines = findings.filter(F.col("line") > 0).select("sample_id", "line").distinct()
    w = Window.partitionBy("sample_id").orderBy("line")
    lines = lines.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= enough)
    lines = lines.groupBy("sample_id").agg(F.array_sort(F.collect_list("line")).alias("focus"))
    tools = findings.groupBy("sample_id").agg(
        F.count_distinct(F.when(F.col("tool") != "", F.col("tool"))).alias("tool_count")
    )
    return tools.join(lines, "sample_id", "left")


def dynamic_window(code: Column, focus: Column, tool_count: Column, *, lines: int = 5, max_chars: int = 3000, medium_chars: int = 3000) -> Column:
    """Narrow when two tools speak, medium for one, everything when all are silent."""
    none = F.array().cast("array<int>")
    return (
        F.when(F.coalesce(tool_count, F.lit(0)) >= 2, focus_window(code, F.coalesce(focus, none), lines=lines, max_chars=max_chars))
        .when(tool_count == 1, head(code, medium_chars))
        .otherwise(code)
    )


def requested_window(
    code: Column, suggestion: Column, sink_type: Column, sink_line: Column, *, lines: int = 5, max_chars: int = 3000
) -> Column:
    """±``lines`` around the sink's line in the function when asked for, else all.

    ``sink_line`` is 1-based inside the function (finding line minus the
    function's first line plus one).
    """
    text = F.split(code, "\n")
    start = F.greatest(F.lit(0), sink_line - F.lit(1 + lines))
    end = F.least(F.size(text), sink_line + F.lit(lines))
    window = F.array_join(F.slice(text, start + F.lit(1), F.greatest(F.lit(0), end - start)), "\n")
    cut = F.when(
        F.length(window) > max_chars, F.concat(F.substring(window, 1, max_chars), F.lit("\n// ... (truncated)"))
    ).otherwise(window)
    return F.when((suggestion == "iris") & sink_type.isNotNull() & (sink_type != ""), cut).otherwise(code)


def code_window(df: DataFrame, params: dict, name: str = "code_window") -> DataFrame:
    """Window by a preset's ``code_window`` section; needs code, focus, tool_count."""
    mode = params.get("mode", "simple")
    code, focus, tools = F.col("code"), F.coalesce(F.col("focus"), F.array().cast("array<int>")), F.col("tool_count")
    if mode == "iris":
        out = focus_window(
            code, focus, lines=params.get("iris_window_lines", 5), max_chars=params.get("iris_max_chars", 3000),
            fallback_chars=params.get("iris_fallback_chars", 2000),
        )
    elif mode == "dynamic":
        out = dynamic_window(
            code, focus, tools, lines=params.get("dynamic_iris_lines", 5), max_chars=params.get("iris_max_chars", 3000),
            medium_chars=params.get("dynamic_medium_chars", 3000),
        )
    else:
        out = head(code, params.get("simple_max_chars", 1500))
    return df.withColumn(name, out)


def highlight(lines: Column) -> Column:
    """Two numbers are an inclusive range, anything else a list."""
    return F.when(
        (F.size(lines) == 2) & (lines[0] <= lines[1]), F.sequence(lines[0], lines[1])
    ).otherwise(F.when(F.size(lines) == 2, F.array().cast("array<int>")).otherwise(lines))
