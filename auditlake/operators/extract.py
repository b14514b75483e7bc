"""Functions, calls, assignments and parameters out of source text.

Everything here is a projection over one row, so the corpus is read once and
nothing is shuffled.  Precision is that of token patterns on text whose
comments and string literals were removed, not that of a syntax tree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import rulebook as rb
from auditlake.functions.columns import blank_to_null, lookup
from auditlake.operators import splitting
from auditlake.session import known_to_workers

# Words that look like calls but are not.
KEYWORDS = [
    "if", "for", "while", "switch", "return", "sizeof", "catch", "else", "do",
    "and", "or", "not", "in", "is", "lambda", "elif", "except", "with",
    "assert", "new", "synchronized", "def", "class", "case", "defined",
]


def _nested(depth: int) -> str:
    """Text with parentheses balanced up to ``depth`` levels (possessive loops)."""
    flat = r"[^()]*+"
    return flat if depth == 0 else rf"{flat}(?:\({_nested(depth - 1)}\){flat})*+"


# Strings and comments in one pass.  Possessive loops: long literals must not
# make the regex engine recurse.
_STR = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' + r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_NOISE_C = _STR + r"|//[^\n]*|/\*[\s\S]*?\*/"
# Interpolated Python strings stay: their fields are code.
_NOISE_PY = r"(\b[rR]?[fF](?:" + _STR + r"))|" + r'"""[\s\S]*?"""' + r"|'''[\s\S]*?'''|" + _STR + r"|#[^\n]*"

#: Levels of parentheses the patterns look into; calls nested deeper are found by a running depth.
DEPTH = 16

# Parameter lists hold types, defaults and function pointers; deeper nesting than this is no declaration.
_HEADER_C = (
    r"^(?:\s*@[\w.]+\s*(?:\([^()]*+\))?)*+[^(){};=]*?(?<!\w)([A-Za-z_]\w*+)\s*+\((" + _nested(DEPTH) + r")\)[^(){};=]*\{"
)
_HEADER_PY = r"^([\s\S]*?)\bdef\s+([A-Za-z_]\w*)\s*\((" + _nested(DEPTH) + r")\)[^:\n]*:"
_POINTER = r"\(\s*\*+\s*([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*\)\s*\(" + _nested(DEPTH) + r"\)"

_CALL_NAME = r"([A-Za-z_][\w.]*)\s*\("
# Arguments sit in a lookahead, so calls nested in them are found as well.
# The character behind them is an opening bracket only where they nest deeper than the pattern.
_CALL_ARGS = r"(?<![\w.])\.*+([A-Za-z_][\w.]*+)\s*+\((?=(" + _nested(DEPTH) + r")([\s\S]?))"
# One pass writes every call as mark, name, mark, arguments, mark, next character, mark.
_MARKS = "\x01\x02\x03\x04"
_ASSIGN_C = r"(?<!\w)([A-Za-z_]\w*+)\s*+(?:\[[^\[\]\n]*+\])?+\s*+=\s*+([^=;{}\s][^;{}]*+)"
_ASSIGN_PY = r"(?m)^[ \t]*+([A-Za-z_]\w*+)[\w.]*+\s*+=\s*+([^=\n\s][^\n]*+)"
_IDENT = r"([A-Za-z_]\w*)"


def is_python(language: Column) -> Column:
    return language == "python"


def strip_noise(code: Column, language: Column) -> Column:
    """Code with comments and literals blanked."""
    return F.when(is_python(language), F.regexp_replace(code, _NOISE_PY, "$1 ")).otherwise(
        F.regexp_replace(code, _NOISE_C, " ")
    )


def language_from_path(path: Column) -> Column:
    """c / python / java by extension, null for anything else."""
    return lookup(rb.LANGUAGE_BY_EXTENSION, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def basename(path: Column) -> Column:
    return F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1)


def place_key(path: Column, function_name: Column, line: Column) -> Column:
    """Identity of a function in a corpus: full path, name and first line."""
    return F.concat_ws("#", F.translate(path, "\\", "/"), F.coalesce(function_name, F.lit("")), line.cast("string"))


def sample_key(path: Column, function_name: Column) -> Column:
    """Short key of labelled sets, for evaluation only: many functions of a corpus may share it."""
    return F.concat_ws("#", basename(path), F.coalesce(function_name, F.lit("")))


def function_name(code: Column, fallback: Column) -> Column:
    """Name by definition pattern: C-like at line start, then ``def``, then the fallback."""
    return F.coalesce(
        blank_to_null(F.regexp_extract(code, "(?U)" + rb.C_DEFINITION, 1)),
        blank_to_null(F.regexp_extract(code, "(?U)" + rb.PY_DEFINITION, 1)),
        fallback,
    )


def wrapped_name(code: Column, language: Column) -> Column:
    """Content-addressed file name a scanner sees for a lone function."""
    body = F.when(language == "c", F.concat(F.lit(rb.C_WRAPPER), code)).otherwise(
        F.when(F.trim(code) == "", F.lit("pass")).otherwise(F.trim(code))
    )
    ext = F.when(language == "c", ".c").when(is_python(language), ".py").otherwise(".txt")
    return F.concat(F.lit("fn_"), F.substring(F.md5(body), 1, 12), ext)


def _suffixes(name: Column) -> Column:
    """The dotted name, its last two segments and its last segment."""
    return F.array_distinct(
        F.array(name, F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1), F.substring_index(name, ".", -1))
    )


def _calls_by_depth(text: Column) -> Column:
    """array<struct<name, args>> by a running bracket depth, however deep calls nest."""
    kind = "array<struct<name:string,args:string>>"
    tokens = F.regexp_extract_all(text, F.lit(r"[()]|[^()]+"), 0)

    def calls(t: Column) -> Column:
        step = F.transform(t, lambda x: F.when(x == "(", 1).when(x == ")", -1).otherwise(0))
        depth = F.aggregate(step, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))  # before token i, from 0

        def of(d: Column) -> Column:
            def one(i: Column) -> Column:  # token i opens, token i - 1 ends with the name
                close = F.array_position(F.slice(d, i + 3, F.size(d)), d[i])  # tokens until the depth is back
                inside = F.slice(t, i + 2, F.when(close > 0, close.cast("int") - 1).otherwise(F.size(t)))
                return F.struct(F.regexp_extract(t[i - 1], r"([A-Za-z_][\w.]*)\s*$", 1).alias("name"), F.array_join(inside, "").alias("args"))

            opens = F.filter(F.sequence(F.lit(1), F.size(t) - 1), lambda i: t[i] == "(")
            return F.filter(F.transform(opens, one), lambda c: c["name"] != "")

        return F.transform(F.array(depth), of)[0]

    return F.when(F.size(tokens) > 1, F.transform(F.array(tokens), calls)[0]).otherwise(F.array().cast(kind))


def _calls(text: Column) -> Column:
    """array<struct<name, suffixes, idents>> in text order."""
    start, args, after, end = _MARKS
    plain = F.when(text.rlike(f"[{_MARKS}]"), F.translate(text, _MARKS, "    ")).otherwise(text)
    marked = F.split(F.regexp_replace(plain, _CALL_ARGS, f"{start}$1{args}$2{after}$3{end}"), start)

    def of(parts: Column) -> Column:
        found = F.transform(
            F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))),
            lambda x: F.struct(F.substring_index(x, args, 1).alias("name"), F.substring_index(F.substring_index(x, after, 1), args, -1).alias("args")),
        )
        return F.when(F.exists(parts, lambda x: F.instr(x, f"{after}({end}") > 0), _calls_by_depth(text)).otherwise(found)

    pairs = F.transform(F.array(marked), of)[0]
    keep = F.filter(pairs, lambda p: ~F.substring_index(p["name"], ".", -1).isin(KEYWORDS))
    return F.transform(
        keep,
        lambda p: F.struct(
            p["name"].alias("name"),
            _suffixes(p["name"]).alias("suffixes"),
            p["args"].alias("args"),
            F.array_distinct(F.regexp_extract_all(p["args"], F.lit(_IDENT), 1)).alias("idents"),
        ),
    )


def _params(text: Column, language: Column) -> Column:
    """Parameter names; the last identifier of each C/Java parameter, the first of a Python one."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _POINTER, "$1"), "<[^<>]*>", ""), "<[^<>]*>", "")
    parts = F.split(F.when(is_python(language), F.regexp_replace(text, r"=[^,()]*\([^()]*\)", "")).otherwise(flat), ",")
    c = F.transform(parts, lambda p: F.regexp_extract(p, r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*$", 1))
    py = F.transform(parts, lambda p: F.regexp_extract(p, _IDENT, 1))
    picked = F.when(is_python(language), py).otherwise(c)
    return F.array_distinct(F.filter(picked, lambda p: (p != "") & (p != "void")))


def with_syntax(df: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """Adds ``fn_name, params, body, calls, assigns`` to a table of functions."""
    lang = F.col(language)
    out = df.withColumn("_clean", strip_noise(F.col(code), lang))
    py = is_python(lang)
    out = out.withColumn(
        "fn_name",
        F.when(py, F.regexp_extract("_clean", _HEADER_PY, 2)).otherwise(F.regexp_extract("_clean", _HEADER_C, 1)),
    )
    out = out.withColumn(
        "params",
        _params(
            F.when(py, F.regexp_extract("_clean", _HEADER_PY, 3)).otherwise(F.regexp_extract("_clean", _HEADER_C, 2)),
            lang,
        ),
    )
    out = out.withColumn(
        "body",
        F.when(py, F.regexp_replace("_clean", _HEADER_PY, "$1")).otherwise(F.regexp_replace("_clean", _HEADER_C, "")),
    )
    out = out.withColumn("calls", _calls(F.col("body")))
    pairs = F.when(
        py,
        F.arrays_zip(
            F.regexp_extract_all("body", F.lit(_ASSIGN_PY), 1).alias("lhs"),
            F.regexp_extract_all("body", F.lit(_ASSIGN_PY), 2).alias("rhs"),
        ),
    ).otherwise(
        F.arrays_zip(
            F.regexp_extract_all("body", F.lit(_ASSIGN_C), 1).alias("lhs"),
            F.regexp_extract_all("body", F.lit(_ASSIGN_C), 2).alias("rhs"),
        )
    )
    out = out.withColumn(
        "assigns",
        F.transform(
            pairs,
            lambda p: F.struct(
                p["lhs"].alias("lhs"),
                p["rhs"].alias("rhs"),
                F.regexp_extract(p["rhs"], r"^" + _CALL_NAME, 1).alias("head_call"),
                _calls(p["rhs"]).alias("calls"),
            ),
        ),
    )
    return out.drop("_clean")


def calls_table(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Long form: one row per call, in text order."""
    return df.select(key, "language", F.posexplode("calls").alias("pos", "call")).select(
        key, "language", "pos", F.col("call.name").alias("name"), F.col("call.args").alias("arg_text"),
        F.col("call.idents").alias("idents"),
    )


def call_args_table(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Long form: one row per identifier in a call's arguments."""
    return calls_table(df, key).select(key, F.col("pos").alias("call_id"), "name", F.explode("idents").alias("ident"))


def assigns_table(df: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.select(key, F.posexplode("assigns").alias("pos", "a")).select(
        key, "pos", F.col("a.lhs").alias("lhs"), F.col("a.head_call").alias("head_call"),
    )


def params_table(df: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.select(key, F.explode("params").alias("ident"))


PIECES = "array<struct<name:string,first:int,last:int,code:string>>"


def split_functions(files: DataFrame) -> DataFrame:
    """One row per function or method of a whole file, nested ones too, and ``<module>`` rows for all other lines.

    ``sample_id`` is the full path, the name and the first line, so equal names in
    different folders, or overloads, stay apart; ``evaluation_key`` is the short
    form that labelled sets use.  The cut is a helper per file, see ``splitting``;
    rows stay where they are.
    """

    def cut(content: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([splitting.pieces(t, lang) for t, lang in zip(content, language)])

    known_to_workers(files.sparkSession)
    piece = F.explode(F.pandas_udf(cut, PIECES)(F.col("content"), F.col("language"))).alias("_p")
    out = files.select(*[c for c in files.columns if c != "content"], piece)
    return out.select(
        *[c for c in files.columns if c != "content"], F.col("_p.name").alias("function_name"), F.col("_p.code").alias("code"),
        F.col("_p.first").alias("line_start"), F.col("_p.last").alias("line_end"),
        place_key(F.col("file"), F.col("_p.name"), F.col("_p.first")).alias("sample_id"),
        sample_key(F.col("file"), F.col("_p.name")).alias("evaluation_key"),
    )
