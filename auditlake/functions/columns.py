"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule patterns come from a Unicode-aware, newline-only regex dialect.
JVM_FLAGS = "(?dU)"

# Same language as the rule's pattern, but without a group loop the JVM would
# recurse on: a list literal with thousands of entries must not end the task.
_JVM_PATTERN = {
    r'[\[{]\s*"[^"]+"(?:\s*,\s*(?:"[^"]+"|\w+))*\s*[\]}]':
        r'[\[{]\s*"[^"]+"(?:\s*,\s*(?:"[^"]+"|\w+))*+\s*[\]}]',
}


def jvm(pattern: str) -> str:
    """The pattern as Spark's regex engine should see it."""
    return JVM_FLAGS + _JVM_PATTERN.get(pattern, pattern)


def sql_text(value: str) -> str:
    """Value as a Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def str_array(values: Iterable[str]) -> Column:
    """Constant array; parsed in one go, so large rule tables stay cheap to plan."""
    return F.expr("cast(array(" + ", ".join(sql_text(v) for v in values) + ") as array<string>)")


def lookup(mapping: Mapping[str, str], key: Column, default: Column | None = None) -> Column:
    """Constant map lookup; the map is part of the plan, nothing is joined."""
    entries = ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in mapping.items())
    found = F.try_element_at(F.expr(f"map({entries})"), key)
    return found if default is None else F.coalesce(found, default)


def lookup_list(mapping: Mapping[str, Iterable[str]], key: Column) -> Column:
    """Constant map of lists; an empty list for keys it lacks."""
    entries = ", ".join(
        f"{sql_text(k)}, array(" + ", ".join(sql_text(v) for v in vs) + ")" for k, vs in mapping.items()
    )
    return F.coalesce(F.try_element_at(F.expr(f"map({entries})"), key), F.array().cast("array<string>"))


def first_true(rules: Iterable[tuple[Column, Column]]) -> Column:
    """Value of the first rule whose condition holds, else null."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if out is not None else F.lit(None)


def ratio(num: Column, den: Column, digits: int = 4) -> Column:
    """num/den with 0.0 for an empty denominator."""
    return F.round(F.when(den > 0, num / den).otherwise(F.lit(0.0)), digits)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds computed columns behind a one-row generator.

    A filter on such a column stays above it.  Without that, the optimizer
    rewrites the filter into the column's definition and moves it to the scan,
    where large definitions are then evaluated several times per row.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
