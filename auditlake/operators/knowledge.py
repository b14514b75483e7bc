"""Feeds into knowledge documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import rulebook as rb
from auditlake.operators.cwe import type_of
from auditlake.operators.sampling import keep_first

COLUMNS = [
    "id", "type", "document", "cve_id", "cwe_id", "vuln_type", "language", "source", "exploited", "cvss_score",
    "published",
]


def _shape(df: DataFrame, **cols: Column) -> DataFrame:
    types = {"exploited": "boolean", "cvss_score": "double"}
    return df.select(*[cols.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in COLUMNS])


def lines(*parts: Column) -> Column:
    """Non-null parts joined by newlines."""
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def _field(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit("")))


def exploited_documents(entries: DataFrame) -> DataFrame:
    """Catalogue of exploited vulnerabilities; entries without id are dropped."""
    cve = F.trim("cveID")
    cwes = F.coalesce("cwes", F.array().cast("array<string>"))
    cwe_text = F.when(F.size(cwes) > 0, F.array_join(cwes, ", ")).otherwise("N/A")
    notes = F.coalesce("notes", F.lit(""))
    text = lines(
        F.lit("[ACTIVELY EXPLOITED IN THE WILD]"),
        _field("CVE", cve),
        _field("Vendor", F.coalesce("vendorProject", F.lit("unknown"))),
        _field("Product", F.col("product")),
        _field("CWE", cwe_text),
        _field("Added to KEV", F.col("dateAdded")),
        _field("Remediation due", F.col("dueDate")),
        F.concat(F.lit("\nDescription:\n"), F.coalesce("shortDescription", F.lit(""))),
        F.when(notes != "", F.concat(F.lit("\nNotes:\n"), notes)),
    )
    return _shape(
        entries.filter(F.coalesce(cve, F.lit("")) != ""),
        id=F.concat(F.lit("kev_"), cve), type=F.lit("kev_vuln"), document=text, cve_id=cve, cwe_id=cwe_text,
        vuln_type=type_of(F.try_element_at(cwes, F.lit(1))), source=F.lit("cisa_kev"), exploited=F.lit(True),
        published=F.col("dateAdded"),
    )


def feed_documents(entries: DataFrame) -> DataFrame:
    """CVE feed entries (column ``cve``)."""
    cve = F.trim("cve.id")
    descriptions = F.col("cve.descriptions")
    english = F.filter(descriptions, lambda d: d["lang"] == "en")
    text_en = F.coalesce(F.try_element_at(english, F.lit(1))["value"], F.lit(""))
    description = F.when(text_en != "", text_en).otherwise(
        F.coalesce(F.try_element_at(descriptions, F.lit(1))["value"], F.lit(""))
    )
    ids = F.filter(
        F.flatten(F.transform("cve.weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"]))),
        lambda v: v.startswith("CWE-"),
    )
    ids = F.coalesce(ids, F.array().cast("array<string>"))
    cwe_text = F.when(F.size(ids) > 0, F.array_join(F.slice(ids, 1, 3), ", ")).otherwise("N/A")
    cvss = F.coalesce(
        F.try_element_at("cve.metrics.cvssMetricV31", F.lit(1)), F.try_element_at("cve.metrics.cvssMetricV30", F.lit(1))
    )["cvssData"]
    score = F.coalesce(cvss["baseScore"].cast("string"), F.lit(""))
    text = lines(
        _field("CVE", cve),
        _field("CWE", cwe_text),
        F.concat(F.lit("Severity: "), F.coalesce(cvss["baseSeverity"], F.lit("")), F.lit(" ("), score, F.lit(")")),
        _field("Status", F.col("cve.vulnStatus")),
        _field("Published", F.col("cve.published")),
        F.concat(F.lit("\nDescription:\n"), description),
    )
    return _shape(
        entries.filter(F.coalesce(cve, F.lit("")) != ""),
        id=F.concat(F.lit("nvd_"), cve), type=F.lit("nvd_cve"), document=text, cve_id=cve, cwe_id=cwe_text,
        vuln_type=type_of(F.try_element_at(ids, F.lit(1))), source=F.lit("nvd"), exploited=F.lit(False),
        cvss_score=cvss["baseScore"], published=F.col("cve.published"),
    )


def labelled_cve_documents(rows: DataFrame, *, order: str, min_summary: int = 30, max_samples: int | None = None) -> DataFrame:
    """CVE table rows: valid ids with a real summary, first row per CVE in ``order``."""

    def value(name: str, default: str) -> Column:
        return F.trim(F.coalesce(F.when(F.col(name) != "", F.col(name)), F.lit(default)))

    rows = rows.withColumns({"cve_id": F.trim("cve_id"), "summary": F.trim("summary")})
    rows = rows.filter(F.col("cve_id").startswith("CVE-") & (F.length("summary") >= min_summary))
    rows = keep_first(rows, ["cve_id"], [order])
    if max_samples is not None:
        rows = rows.orderBy(order).limit(max_samples)
    cwe, project, lang = value("cwe_id", "N/A"), value("project", "unknown"), value("lang", "c")
    score, published = value("score", ""), value("publish_date", "")
    text = lines(
        _field("CVE", F.col("cve_id")), _field("CWE", cwe), _field("Language", lang), _field("Project", project),
        F.when(score != "", _field("CVSS", score)),
        F.when(published != "", _field("Published", published)),
        F.concat(F.lit("\nDescription:\n"), F.col("summary")),
    )
    return _shape(
        rows,
        id=F.concat(F.lit("bigvul_"), "cve_id"), type=F.lit("bigvul_case"), document=text, cve_id=F.col("cve_id"),
        cwe_id=cwe, vuln_type=type_of(cwe, rb.TYPE_BY_CWE_LABELLED), language=F.substring(lang, 1, 20),
        source=F.substring(project, 1, 100), exploited=F.lit(False), cvss_score=score.try_cast("double"),
        published=published,
    )


def cwe_documents(rows: DataFrame) -> DataFrame:
    """CWE definitions; the id is a column, not only part of the text."""
    text = lines(
        _field("CWE", F.coalesce("name", F.lit("Unknown"))),
        F.when(F.coalesce("description", F.lit("")) != "", _field("Description", F.col("description"))),
        F.when(F.coalesce("mitigation", F.lit("")) != "", _field("Mitigation", F.col("mitigation"))),
    )
    return _shape(
        rows,
        id=F.col("id"), type=F.lit("cwe"), document=text, cwe_id=F.col("id"), vuln_type=type_of(F.col("id")),
        language=F.col("language"), source=F.lit("cwe"), exploited=F.lit(False),
    )


def build(*documents: DataFrame) -> DataFrame:
    """All documents with an id, one row per id."""
    from functools import reduce

    everything = reduce(lambda a, b: a.unionByName(b), documents)
    return keep_first(everything.filter(F.coalesce("id", F.lit("")) != ""), ["id"], ["type", F.md5("document")])


def page_windows(start: Column, end: Column, days: int = 120) -> Column:
    """Start dates of the fixed-length windows a feed is requested in."""
    return F.sequence(start, end, F.expr(f"interval {days} days"))
