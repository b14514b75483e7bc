"""Model responses (text) into verdict columns.

A response is tried as a ladder of candidate texts; the first that is a JSON
object wins and its rung is kept in ``parsed_from``.  Rows no rung can read
are ``quarantine`` and carry the stage's fallback verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.columns import clamp, settle
from auditlake.schemas import VERDICT_JSON

_CLOSED_THINK = r"<think>[\s\S]*?</think>"
_OPEN_THINK = r"<think>[\s\S]*$"
_LEAD_WORD = r"^\s*(?:response|Response)\s*\n?"
_FENCE = r"```(?:json)?\s*([\s\S]*?)\s*```"
_BRACES = r"(\{[\s\S]*\})"
_STRAY_QUOTE = r'(\d+\.\d+)",'
# Strings, an unclosed string with all behind it, brackets, commas, and the rest.
_JSON_TOKEN = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|"[\s\S]*+|[\[\]{},]|[^"\[\]{},]++'

# --- fixed values: what a stage answers when its response cannot be read -----
FALLBACKS = {
    "single_pass": ("vuln", 0.3),
    "screen": ("vuln", 0.3),
    "integrate": ("vuln", 0.3),
    "full_scan": ("vuln", 0.3),
    "verify": ("uncertain", 0.4),
}


def clean(raw: Column) -> Column:
    """Text without reasoning blocks and without a leading "response" line."""
    text = F.regexp_replace(raw, _CLOSED_THINK, "")
    text = F.regexp_replace(text, _OPEN_THINK, "")
    return F.regexp_replace(F.regexp_replace(text, _LEAD_WORD, ""), r"^\s+|\s+$", "")


def is_object(text: Column) -> Column:
    """True for exactly one well-formed JSON object."""
    boxed = F.concat(F.lit("["), text, F.lit("]"))
    return (
        text.startswith("{") & text.endswith("}")
        & F.try_parse_json(boxed).isNotNull() & (F.json_array_length(boxed) == 1)
    )


def cut_at_last_pair(text: Column) -> Column:
    """The first object of a truncated text up to its last comma outside all inner brackets, closed; "" if there is none.

    One fold over the tokens with the depth of brackets, so values may nest as deep as they like.
    """
    body = F.when(F.instr(text, "{") > 0, F.substring(text, F.instr(text, "{"), F.length(text))).otherwise("")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("place"), F.lit(0).alias("cut"))

    def step(acc: Column, token: Column) -> Column:
        depth = acc["depth"] + F.when(token.isin("{", "["), 1).when(token.isin("}", "]"), -1).otherwise(0)
        cut = F.when((token == ",") & (acc["depth"] == 1), acc["place"]).otherwise(acc["cut"])
        return F.struct(depth.alias("depth"), (acc["place"] + F.length(token)).alias("place"), cut.alias("cut"))

    def of(b: Column) -> Column:
        cut = F.aggregate(F.regexp_extract_all(b, F.lit(_JSON_TOKEN), 0), start, step)["cut"]
        return F.when(cut > 0, F.concat(F.substring(b, F.lit(1), cut), F.lit("}"))).otherwise("")

    return F.transform(F.array(body), of)[0]


def _rung(name: str, text: Column) -> Column:
    return F.struct(F.lit(name).alias("rung"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))


def parse(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``json`` (object text or null) and ``parsed_from``."""
    df = responses.withColumn("_t", clean(F.coalesce(F.col(raw), F.lit(""))))
    t = F.col("_t")
    fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```\s*$", ""), _STRAY_QUOTE, "$1,")
    fixed_object = F.regexp_extract(fixed, _BRACES, 1)

    def first_object(rungs: Column) -> Column:
        return F.try_element_at(F.filter(rungs, lambda r: is_object(r["text"])), F.lit(1))

    def one(name: str, text: Column) -> Column:
        return first_object(F.array(_rung(name, text)))

    # coalesce stops at the first rung that reads, so later rungs cost nothing.
    hit = F.coalesce(
        first_object(F.transform(F.regexp_extract_all(t, F.lit(_FENCE), 1), lambda x: _rung("fenced", x))),
        one("open_fence", F.when(t.startswith("```"), F.regexp_extract(t, _BRACES, 1)).otherwise("")),
        one("whole", t),
        one("braces", F.regexp_extract(t, _BRACES, 1)),
        one("stray_quote", F.when(fixed_object == "", fixed).otherwise(fixed_object)),
        one("salvaged", cut_at_last_pair(fixed)),
    )
    df = df.withColumn("_hit", hit)
    return settle(
        df.drop("_t"), json=F.col("_hit.text"), parsed_from=F.coalesce("_hit.rung", F.lit("quarantine"))
    ).drop("_hit")


def _truth(text: Column, default: bool) -> Column:
    low = F.lower(text)
    return F.when(text.isNull(), F.lit(default)).otherwise(~low.isin("false", "0", "0.0", "", "null"))


def validated(parsed: DataFrame) -> DataFrame:
    """Adds ``v``: every verdict field with its type and default."""
    df = parsed.withColumn("_j", F.from_json("json", VERDICT_JSON))
    j = lambda name: F.col(f"_j.{name}")
    lines = F.transform(
        F.filter(F.coalesce(j("line_numbers"), F.array().cast("array<string>")), lambda x: F.trim(x).rlike(r"^-?\d+$")),
        lambda x: F.trim(x).cast("int"),
    )
    fields = {
        "has_vulnerability": _truth(j("has_vulnerability"), False),
        "vulnerability_type": F.coalesce(j("vulnerability_type"), F.lit("UNKNOWN")),
        "confidence": F.round(
            clamp(F.coalesce(j("confidence").try_cast("double"), F.lit(0.0)), 0.0, 1.0), 4
        ),
        "description": F.coalesce(j("description"), F.lit("")),
        "line_numbers": lines,
        "remediation": F.coalesce(j("remediation"), F.lit("")),
    }
    passed = [
        "severity", "cwe_id", "cwe_type", "exploitability", "impact", "reasoning_chain", "cwe_reference", "reason",
        "adjusted_severity", "false_positive_reason", "verdict", "reasoning", "refined_description",
        "initial_verdict", "window_suggestion", "blind_spot_risk", "winner", "final_verdict", "findings",
    ]
    for name in passed:
        fields[name] = j(name)
    fields["suspicious"] = _truth(j("suspicious"), True)
    fields["confirmed"] = _truth(j("confirmed"), True)
    fields["no_findings"] = _truth(j("no_findings"), False)
    fields["adjusted_confidence"] = j("adjusted_confidence").try_cast("double")
    fields["raw_confidence"] = j("confidence").try_cast("double")
    return df.withColumn(
        "v", F.when(F.col("json").isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))
    ).drop("_j")


def verdicts(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """parse + validated."""
    return validated(parse(responses, raw))


def fallback(stage: Column) -> Column:
    """struct<verdict, confidence> a stage falls back to."""
    out = F.lit(None)
    out = F.when(F.lit(False), F.struct(F.lit("").alias("verdict"), F.lit(0.0).alias("confidence")))
    for name, (verdict, confidence) in FALLBACKS.items():
        out = out.when(stage == name, F.struct(F.lit(verdict).alias("verdict"), F.lit(confidence).alias("confidence")))
    return out.otherwise(F.struct(F.lit("vuln").alias("verdict"), F.lit(0.3).alias("confidence")))


def parse_rate(parsed: DataFrame, *by: str) -> DataFrame:
    """Responses, unreadable ones and their share, by group."""
    failed = F.count_if(F.col("parsed_from") == "quarantine")
    return parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("responses"),
        failed.alias("unreadable"),
        F.round(failed / F.count(F.lit(1)), 4).alias("failure_rate"),
    )


def explode_findings(parsed: DataFrame, *keep: str) -> DataFrame:
    """One response that lists findings into one row per finding."""
    return parsed.filter(F.col("v").isNotNull()).select(
        *keep, F.posexplode("v.findings").alias("ord", "f"), F.lit("llm_full_sweep").alias("detection_method")
    ).select(*keep, "ord", "f.*", "detection_method")


def apply_self_check(deep: DataFrame, check: DataFrame, key: str = "sample_id") -> DataFrame:
    """Stage-3 corrections over stage-2 verdicts (``v`` columns on both sides)."""
    c = check.select(key, F.col("v").alias("c"))
    df = deep.join(c, key, "left")
    rejected = F.coalesce(~F.col("c.confirmed"), F.lit(False))
    return df.select(
        *[x for x in deep.columns if x != "v"],
        F.when(rejected, F.lit(False)).otherwise(F.col("v.has_vulnerability")).alias("has_vulnerability"),
        F.coalesce(F.col("c.adjusted_confidence"), F.col("v.confidence")).alias("confidence"),
        F.coalesce(F.col("c.adjusted_severity"), F.col("v.severity")).alias("severity"),
        F.coalesce(F.col("c.refined_description"), F.col("v.description")).alias("description"),
        F.when(rejected, F.coalesce(F.col("c.false_positive_reason"), F.lit(""))).alias("false_positive_reason"),
    )


def confidence_filter(df: DataFrame, *, threshold: float = 0.6) -> DataFrame:
    """Vulnerable rows below the threshold become safe; ``status`` says which."""
    weak = F.col("has_vulnerability") & (F.col("confidence") < threshold)
    return df.withColumn(
        "status",
        F.when(weak, "FILTERED_LOW_CONFIDENCE").when(F.col("has_vulnerability"), "CONFIRMED"),
    ).withColumn("has_vulnerability", F.when(weak, F.lit(False)).otherwise(F.col("has_vulnerability")))
