"""Vulnerability types and CWE identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions import rulebook as rb
from auditlake.functions.columns import first_true, lookup


def map_type(vuln_type: Column, table: list[tuple[str, str]] | None = None) -> Column:
    """struct<cwe, confidence>: given CWE 0.9, exact key 0.85, first key that
    contains or is contained 0.7, otherwise the text itself at 0.3."""
    table = table or rb.CWE_BY_TYPE
    norm = F.trim(F.lower(vuln_type))
    exact = lookup(dict(table), norm)
    fuzzy = F.coalesce(*[F.when(norm.contains(k) | F.lit(k).contains(norm), F.lit(c)) for k, c in table])

    def out(cwe: Column, confidence: float) -> Column:
        return F.struct(cwe.alias("cwe"), F.lit(confidence).alias("confidence"))

    return first_true(
        [
            (vuln_type.isNull() | vuln_type.isin("", "UNKNOWN"), out(F.lit("UNKNOWN"), 0.0)),
            (F.upper(vuln_type).startswith("CWE-"), out(F.upper(vuln_type), 0.9)),
            (exact.isNotNull(), out(exact, 0.85)),
            (fuzzy.isNotNull(), out(fuzzy, 0.7)),
            (F.lit(True), out(vuln_type, 0.3)),
        ]
    )


def type_of(cwe: Column, table: dict[str, str] | None = None) -> Column:
    return lookup(table or rb.TYPE_BY_CWE_FEED, F.coalesce(cwe, F.lit("")), F.lit("unknown"))


def reference_of(sink: Column) -> Column:
    """Reference CWE of a sink, null when it has none."""
    return lookup(rb.CWE_BY_SINK, F.coalesce(sink, F.lit("")))
