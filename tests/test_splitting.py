"""The splitter and the call patterns on hostile sources: linear time, and no line lost."""

import time

import pytest
from pyspark.sql import functions as F

from auditlake.operators import extract
from auditlake.operators.splitting import DEEPEST, MODULE, pieces

HOSTILE = {
    "throws": ("java", "void f() throws a throws b "), "qualifiers": ("c", "f() const "), "open lists": ("c", "X((a, 1\n"), "open calls": ("c", "f("),
    "calls in calls": ("c", "f(g(x) {"), "escaped quotes": ("c", '"\\'), "mixed quotes": ("c", "'\\\""), "one name": ("c", "a"), "spaces": ("c", "a      "),
    "braces": ("c", "{"), "initialisers": ("c", "a() : "), "bodies after colons": ("java", "a() : b(1) {"), "nested functions": ("java", "void f() {\n"),
    "methods": ("java", "void f() { }\n"), "anonymous classes": ("java", "a(new B() {"), "annotations": ("java", "@a(@b "), "macro": ("c", "#define f(x) \\\n"),
    "old declarations": ("c", "f(a) int a; "), "open def": ("python", "def f(\n"), "defs": ("python", "def f():\n  x\n"), "triple quotes": ("python", '"""'),
    "python quotes": ("python", "'\\\""), "decorators": ("python", "@a\n"), "open decorators": ("python", "@a(\n"), "continued": ("python", "def f(): \\\n"),
    "comment": ("c", "/*"), "digits": ("c", "1'000 "), "statements": ("c", "f();"),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_text_is_linear(name):
    language, unit = HOSTILE[name]
    took = []
    for size in (100_000, 400_000):
        text = unit * (size // len(unit))
        started = time.perf_counter()
        found = pieces(text, language)
        took.append(time.perf_counter() - started)
        covered = {i for p in found for i in range(p["first"], p["last"] + 1)}
        assert all(i in covered or not line.strip() for i, line in enumerate(text.split("\n"), 1))
    assert took[1] < max(1.5, 10 * took[0])  # four times the text; squares would take sixteen times as long


def test_short_hostile_header():
    assert pieces("void f() " + "throws a " * 16 + ";", "java")[0]["name"] == MODULE
    assert [p["name"] for p in pieces("void f() throws a.B, C<D> {\n}\n", "java")] == ["f"]


def test_initialisers_quotes_and_nesting():
    code = "A::A(int x)\n  : m(x), n{\n{ }\n"
    assert [p["name"] for p in pieces("A::A(int x) : m(x), n(x) {\n  go(x);\n}\n", "c")] == ["A"]
    assert pieces(code, "c")[0]["first"] == 1
    assert [p["name"] for p in pieces("#error don't\nint f(int a) {\n return a;\n}\n", "c")] == [MODULE, "f"]
    assert [p["name"] for p in pieces("int f(a, b)\nint a;\nchar *b;\n{\n}\n", "c")] == ["f"]
    nested = "\n".join(" " * i + f"def f{i}():" for i in range(40)) + "\n" + " " * 40 + "pass\n"
    assert [p["name"] for p in pieces(nested, "python")] == [f"f{i}" for i in range(DEEPEST)]
    text = "def f():\n    a = 1\n  # inside\n\n# outside\nx = 1\n"
    assert [(p["name"], p["first"], p["last"]) for p in pieces(text, "python")] == [("f", 1, 3), (MODULE, 5, 6)]


def test_calls_nested_to_any_depth(spark):
    deep = "f0(" + "".join(f"a, f{i}(" for i in range(1, 40)) + "x" + ")" * 40
    open_end = "void f(int a) { go(a, (b; run(a); }"
    rows = [("void f(int a) { " + deep + "; last(a); }", "c"), (open_end, "c"), ("void f(char c) { put(c, '\x01'); x\x02.y(c); obj[0].run(c); }", "c"), ("void f() { " + "g(a);" * 4000 + deep + "; }", "c")]
    got = [
        [(c["name"], c["idents"]) for c in r.calls]
        for r in extract.with_syntax(spark.createDataFrame(rows, "code string, language string")).select("calls").collect()
    ]
    assert [n for n, _ in got[0]] == [f"f{i}" for i in range(40)] + ["last"]
    assert got[0][0][1] == ["a", *[f"f{i}" for i in range(1, 40)], "x"] and got[0][39][1] == ["x"]
    assert [n for n, _ in got[1]] == ["go", "run"]
    assert [n for n, _ in got[2]] == ["put", "y", "run"]
    assert len(got[3]) == 4040


def test_deep_parameter_lists(spark):
    rows = [("int f(" + "(" * 12 + "int a" + ")" * 12 + ") { return a; }", "c"), ("a" * 200_000, "c"), ("def g(a=" + "(" * 10 + "1" + ")" * 10 + ", b=2):\n  pass", "python")]
    got = extract.with_syntax(spark.createDataFrame(rows, "code string, language string").withColumn("n", F.monotonically_increasing_id())).orderBy("n").collect()
    assert [r.fn_name for r in got] == ["f", "", "g"]
