"""Rule-based scan of functions: sinks, mitigations, source-to-sink flow, risk.

One function is one row and the rule tables are plan constants, so the whole
scan is a single narrow stage behind the file read: no join, no shuffle, no
grouping key that could run hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import rulebook as rb
from auditlake.functions.columns import clamp, first_true, jvm, lookup, lookup_list, settle, sql_text, str_array
from auditlake.operators import extract

_SOURCE_T = "array<struct<var:string,type:string>>"


def bare(name: str) -> str:
    return name.rstrip("(")


def _best_entry_per_name(language: str) -> dict[str, tuple[int, int, str, str]]:
    """name -> (risk order, -length, name, category), best category first."""
    best: dict[str, tuple[int, int, str, str]] = {}
    for category, names in rb.SINKS[language].items():
        for raw in names:
            n = bare(raw)
            entry = (rb.RISK_ORDER[rb.RISK.get(category, "medium")], -len(n), n, category)
            best[n] = min(best.get(n, entry), entry)
    return best


def _sink_map(language: str) -> Column:
    entries = ", ".join(
        f"{sql_text(n)}, named_struct('prio', {prio}, 'neg_len', {neg_len}, 'function', {sql_text(fn)}, 'category', {sql_text(c)})"
        for n, (prio, neg_len, fn, c) in _best_entry_per_name(language).items()
    )
    return F.expr(f"map({entries})")


def sink_entry(language: Column, name: Column) -> Column:
    """Registry entry of a called name in its language, null if it is no sink."""
    return first_true([(language == lang, F.try_element_at(_sink_map(lang), name)) for lang in rb.SINKS])


def pick_sink(calls: Column, language: Column) -> Column:
    """One sink per function: highest risk, longest name, name, category."""
    names = F.array_distinct(F.flatten(F.transform(calls, lambda c: c["suffixes"])))
    hits = F.filter(F.transform(names, lambda n: sink_entry(language, n)), lambda e: e.isNotNull())
    return F.array_min(hits)


def rule_labels(code: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of every rule that matches, in rule order."""
    return F.array_compact(F.array(*[F.when(code.rlike(jvm(p)), F.lit(label)) for p, label in rules]))


def sanitizer_labels(code: Column, language: Column) -> Column:
    return F.coalesce(
        first_true([(language == lang, rule_labels(code, rules)) for lang, rules in rb.SANITIZERS.items()]),
        F.array().cast("array<string>"),
    )


def sanitizer_confidence(labels: Column) -> Column:
    return F.round(F.least(F.lit(0.9), F.size(labels) * F.lit(0.3)), 2)


def likely_safe(labels: Column, category: Column) -> Column:
    """Any mitigation that settles the category (quick variant of the table)."""
    return F.arrays_overlap(labels, lookup_list(rb.QUICK_SAFE_SIGNALS, category))


_RELEVANT = {c: strong + rb.EXTRA_RELEVANT.get(c, []) for c, strong in rb.STRONG_SIGNALS.items()}


def relevant_labels(labels: Column, category: Column) -> Column:
    """Labels that count for the category, as detected."""
    counted = lookup_list(_RELEVANT, category)
    return F.filter(labels, lambda x: F.array_contains(counted, x))


def has_strong(labels: Column, category: Column) -> Column:
    return F.arrays_overlap(labels, lookup_list(rb.STRONG_SIGNALS, category))


def risk_level(category: Column, labels: Column, has_flow: Column) -> Column:
    """Category risk, one step down for a single relevant mitigation and one
    for a missing flow; low when a strong or two relevant mitigations match."""
    levels = str_array(list(rb.RISK_ORDER))
    base = F.array_position(levels, lookup(rb.RISK, category, F.lit("medium"))).cast("int")
    n = F.size(relevant_labels(labels, category))
    missing_flow = ~has_flow & ~category.isin(rb.SELF_CONTAINED)
    steps = F.least(n, F.lit(1)) + missing_flow.cast("int")
    lowest = F.lit(len(rb.RISK_ORDER))
    return F.element_at(
        levels, F.when((n >= 2) | has_strong(labels, category), lowest).otherwise(F.least(lowest, base + steps))
    )


def ast_confidence(source_var: Column, labels: Column) -> Column:
    """Evidence score of a function that has a flow."""
    score = (
        F.lit(0.7)
        + F.when(source_var != "unknown_var", 0.15).otherwise(0.0)
        - F.when(F.size(labels) > 0, 0.2).otherwise(0.0)
    )
    return F.round(clamp(score, 0.0, 1.0), 2)


def _source(var: Column, kind: Column) -> Column:
    return F.struct(var.alias("var"), kind.alias("type"))


def source_variables(df: DataFrame, language: str = "language") -> DataFrame:
    """Adds ``sources``: ordered array<struct<var,type>>, first mention wins.

    Order: values of source calls, source objects, source variables,
    parameters, then results of helpers that were given a source (chained in
    text order).
    """
    lang = F.col(language)
    empty = F.array().cast(_SOURCE_T)

    def is_source_call(name: Column) -> Column:
        return F.coalesce(
            first_true([(lang == k, name.isin(v["function_calls"])) for k, v in rb.SOURCES.items() if v["function_calls"]]),
            F.lit(False),
        )

    from_calls = F.transform(
        F.filter("assigns", lambda a: is_source_call(a["head_call"])),
        lambda a: _source(a["lhs"], F.concat(F.lit("function:"), a["head_call"])),
    )

    def first_object(text: Column) -> Column:
        return first_true(
            [
                (lang == k, F.coalesce(*[F.when(text.contains(o), F.lit(o)) for o in v["objects"]]))
                for k, v in rb.SOURCES.items() if v.get("objects")
            ]
        )

    whole = first_object(F.col("body"))
    from_objects = F.when(
        whole.isNotNull(),
        F.concat(
            F.array(_source(F.lit("unknown_var"), F.concat(F.lit("object:"), whole))),
            F.filter(
                F.transform("assigns", lambda a: _source(a["lhs"], F.concat(F.lit("object:"), first_object(a["rhs"])))),
                lambda s: s["type"].isNotNull(),
            ),
        ),
    ).otherwise(empty)

    c_vars = rb.SOURCES["c"]["variables"]
    named = F.array_distinct(
        F.concat(
            F.filter("params", lambda p: p.isin(c_vars)),
            F.regexp_extract_all("body", F.lit(r"\b(" + "|".join(c_vars) + r")\b"), 1),
        )
    )
    from_vars = F.when(lang == "c", F.transform(named, lambda v: _source(v, F.lit("parameter_source")))).otherwise(empty)
    from_params = F.transform("params", lambda p: _source(p, F.lit("function_parameter")))

    out = df.withColumn("_direct", F.concat(from_calls, from_objects, from_vars, from_params))
    out = out.withColumn(
        "_direct",
        F.aggregate(
            "_direct", empty,
            lambda acc, s: F.when(F.exists(acc, lambda y: y["var"] == s["var"]), acc).otherwise(F.array_append(acc, s)),
        ),
    )

    def helper_hit(acc: Column, a: Column) -> Column:
        helpers = F.filter(a["calls"], lambda c: ~F.exists(c["suffixes"], lambda n: sink_entry(lang, n).isNotNull()))
        pairs = F.flatten(
            F.transform(
                helpers,
                lambda c: F.transform(
                    F.filter(acc, lambda s: F.array_contains(c["idents"], s["var"])),
                    lambda s: F.concat(F.lit("cross_function:"), s["var"], F.lit("→"), c["name"]),
                ),
            )
        )
        return F.try_element_at(pairs, F.lit(1))

    return settle(
        out,
        sources=F.when(
            F.size("_direct") > 0,
            F.aggregate(
                "assigns", F.col("_direct"),
                lambda acc, a: F.when(F.exists(acc, lambda y: y["var"] == a["lhs"]), acc).otherwise(
                    F.concat(
                        acc,
                        F.filter(F.array(_source(a["lhs"], helper_hit(acc, a))), lambda s: s["type"].isNotNull()),
                    )
                ),
            ),
        ).otherwise(empty),
    ).drop("_direct")


def flow(df: DataFrame, language: str = "language") -> DataFrame:
    """Adds ``flow`` struct<var,type,sink,kind> (null without source or sink call).

    The first sink call in text order is reported, reached by the first source
    in its arguments; failing that, by the first source of the function, and
    then marked ``co_present``.
    """
    lang = F.col(language)
    sink_calls = F.filter("calls", lambda c: F.exists(c["suffixes"], lambda n: sink_entry(lang, n).isNotNull()))
    out = df.withColumn("_call", F.try_element_at(sink_calls, F.lit(1)))
    out = out.withColumn(
        "_hit",
        F.try_element_at(
            F.filter("sources", lambda s: F.array_contains(F.col("_call.idents"), s["var"])), F.lit(1)
        ),
    )
    first = F.try_element_at("sources", F.lit(1))
    kind = (
        F.when(F.col("_hit").isNull(), "co_present")
        .when(F.col("_hit.type").startswith("cross_function:"), "one_hop")
        .otherwise("direct")
    )
    chosen = F.coalesce(F.col("_hit"), first)
    return settle(
        out,
        flow=F.when(
            F.col("_call").isNotNull() & first.isNotNull(),
            F.struct(
                chosen["var"].alias("var"), chosen["type"].alias("type"),
                F.col("_call.name").alias("sink"), kind.alias("kind"),
            ),
        ),
    ).drop("_call", "_hit")


def scan(functions: DataFrame, *, keep_syntax: bool = False) -> DataFrame:
    """Slices out of a table of functions (``sample_id, file, language, code`` at least).

    Functions without a registered sink are kept, as ``generic``/``medium``.
    """
    given = set(functions.columns)
    df = functions
    if "line_start" not in given:
        df = df.withColumn("line_start", F.lit(1))
    if "line_end" not in given:
        df = df.withColumn(
            "line_end",
            F.col("line_start") + F.length("code") - F.length(F.replace(F.col("code"), F.lit("\n"), F.lit(""))),
        )
    df = extract.with_syntax(df)
    if "function_name" not in given:
        df = df.withColumn("function_name", F.when(F.col("fn_name") == "", "unknown").otherwise(F.col("fn_name")))
    df = flow(source_variables(df))
    df = settle(df, _sink=pick_sink(F.col("calls"), F.col("language")))
    has_sink = F.col("_sink").isNotNull()
    df = df.withColumn(
        "sanitizers",
        F.when(has_sink, sanitizer_labels(F.col("code"), F.col("language"))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    has_flow = F.col("flow").isNotNull()
    category = F.coalesce(F.col("_sink.category"), F.lit("generic"))
    columns = {
        "sink_type": F.col("_sink.function"),
        "sink_category": category,
        "risk_level": F.when(has_sink, risk_level(category, F.col("sanitizers"), has_flow)).otherwise("medium"),
        "sanitization_confidence": sanitizer_confidence(F.col("sanitizers")),
        "source_var": F.when(has_sink & has_flow, F.col("flow.var")).otherwise(""),
        "source_type": F.when(has_sink & has_flow, F.col("flow.type")).otherwise("unknown"),
        "dataflow_path": F.when(~has_sink, F.lit(""))
        .when(
            has_flow,
            F.concat(F.col("flow.var"), F.lit(" ("), F.col("flow.type"), F.lit(") → "), F.col("flow.sink")),
        )
        .otherwise(F.concat(F.lit("? → "), F.col("_sink.function"))),
        "flow_kind": F.when(has_sink & has_flow, F.col("flow.kind")).otherwise("none"),
        "ast_confidence": F.when(~has_sink, F.lit(0.0))
        .when(has_flow, ast_confidence(F.col("flow.var"), F.col("sanitizers")))
        .otherwise(F.lit(0.3)),
    }
    df = settle(df, sanitizers=F.col("sanitizers"), **columns)
    drop = ["_sink"] if keep_syntax else ["_sink", "flow", "sources", "calls", "assigns", "params", "body", "fn_name"]
    return df.drop(*drop)


def static_decision(
    df: DataFrame, *, no_sink="safe", low_risk_sink="safe", sanitizer_threshold=0, dataflow_required=True,
) -> Column:
    """vuln / safe / uncertain by rules alone; parameters may be values or columns."""

    def col(v) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    n = F.size("sanitizers")
    known_flow = (F.col("dataflow_path") != "") & ~F.col("dataflow_path").contains("?")
    return (
        F.when(F.col("sink_type").isNull() | (F.col("sink_type") == ""), col(no_sink))
        .when((F.col("risk_level") == "high") & (n == 0) & (~col(dataflow_required) | known_flow), "vuln")
        .when((col(sanitizer_threshold) > 0) & (n > 0) & (n >= col(sanitizer_threshold)), "safe")
        .when(F.col("risk_level") == "low", col(low_risk_sink))
        .otherwise("uncertain")
    )


def skips_screening() -> Column:
    """Slices that go straight to deep analysis."""
    return (
        (F.coalesce(F.col("ast_confidence"), F.lit(0.0)) >= 0.8)
        | (F.col("risk_level") == "high")
        | ((F.size("sanitizers") == 0) & F.coalesce(F.col("sink_type").isin(rb.PRIORITY_SINKS), F.lit(False)))
    )


def wants_retrieval() -> Column:
    return F.col("ast_confidence").between(0.4, 0.7)


def calls_sampled_sink(code: Column) -> Column:
    """Sampling filter: a listed call name followed by an opening parenthesis."""
    return code.rlike(jvm(r"\b(" + "|".join(rb.SAMPLING_SINK_NAMES) + r")\s*\("))


def arithmetic_label(code: Column) -> Column:
    """First arithmetic-overflow rule that matches."""
    return F.coalesce(*[F.when(code.rlike(jvm(p)), F.lit(label)) for p, label in rb.ARITHMETIC_RULES])


def safe_usage(code: Column, sink_type: Column) -> Column:
    """True when no dangerous call of the row's own sink is used unsafely."""
    sink = F.lower(F.regexp_replace(F.coalesce(sink_type, F.lit("")), r"^_+", ""))

    def called(f: str) -> Column:
        return code.rlike(jvm(rf"\b{f}\s*\("))

    any_called = None
    unsafe_own = F.lit(False)
    for f in rb.DANGEROUS_CALLS:
        any_called = called(f) if any_called is None else any_called | called(f)
        excused = F.lit(False)
        if f in ("printf", "fprintf", "dprintf"):
            excused = code.rlike(jvm(rf'\b{f}\s*\(\s*"'))
        elif f in ("system", "popen"):
            literal = F.regexp_extract(code, jvm(rf'\b{f}\s*\(\s*("[^"]*")'), 1)
            excused = (literal != "") & ~literal.contains("%")
        elif f in ("memcpy", "memmove"):
            excused = code.rlike(jvm(rf"\b{f}\s*\([^,]+,[^,]+,\s*sizeof\s*\("))
        unsafe_own = unsafe_own | ((sink == f) & called(f) & ~excused)
    return F.when(~any_called, ~sink.isin(rb.DANGEROUS_CALLS)).otherwise(~unsafe_own)
