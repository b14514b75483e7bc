"""Facts about the rule scan, on a few functions."""

import pytest

from auditlake.operators import extract, splitting, static_scan as ss

C_COPY = "void vuln(char *input) {\n  char buf[64];\n  strcpy(buf, input); // system(x)\n}"
ROWS = [
    ("copy", "c", C_COPY),
    ("guarded", "c", "void f(char *input) {\n char buf[8];\n if (strlen(input) < sizeof(buf)) {\n strcpy(buf, input);\n }\n}"),
    ("helper", "c", "int run(char *cmd) { char *t = trim(cmd); return system(t); }"),
    ("shell", "c", "void g(char *cmd) {\n  system(cmd);\n}"),
    ("eval", "python", "def f(user_input):\n    return eval(user_input)\n"),
    ("json", "python", "def f(s):\n    return json.loads(s)\n"),
    ("sql", "python", 'def f(uid):\n    cursor.execute(f"select {uid}")\n'),
    ("sql_params", "python", 'def f(uid):\n    cursor.execute("select ?", (uid,))\n'),
    ("pickle", "python", "def f(data):\n    return pickle.loads(data)\n"),
    ("chained", "python", "def f():\n    q = request.args\n    z = clean(q)\n    y = wrap(z)\n    os.system(y)\n"),
    ("text_only", "python", 'def f():\n    """eval(x)"""\n    # os.system(x)\n    return "exec(x)"\n'),
    ("opened", "python", "def f(p):\n    return open(p)\n"),
    ("builder", "java", "@Override\npublic void go(String q) { new ProcessBuilder(q); }"),
    ("deep", "c", "void d(char *a) { system(one(two(three(a)))); }"),
]


@pytest.fixture(scope="module")
def slices(spark):
    df = spark.createDataFrame([(i, f"{i}.x", lang, code) for i, lang, code in ROWS], "sample_id string, file string, language string, code string")
    return {r.sample_id: r for r in ss.scan(df).collect()}


def test_copy_of_a_parameter(slices):
    r = slices["copy"]
    assert (r.sink_type, r.sink_category, r.function_name) == ("strcpy", "buffer_overflow", "vuln")
    assert (r.risk_level, r.flow_kind, r.ast_confidence) == ("high", "direct", 0.85)
    assert r.dataflow_path == "input (function_parameter) → strcpy"


def test_length_check_lowers_the_risk(slices):
    assert slices["guarded"].sanitizers and slices["guarded"].risk_level == "low"


def test_helper_result_is_a_source(slices):
    r = slices["helper"]
    assert (r.source_type, r.flow_kind) == ("cross_function:cmd→trim", "one_hop")


def test_helper_results_chain_in_text_order(slices):
    assert slices["chained"].source_type == "cross_function:z→wrap"


def test_command_call(slices):
    r = slices["shell"]
    assert r.sink_category == "command_injection" and r.risk_level in {"high", "medium", "low"} and r.ast_confidence > 0


def test_python_sinks(slices):
    assert slices["eval"].sink_category == "code_injection"
    assert slices["json"].sink_type is None and slices["json"].sink_category == "generic"
    assert "execute" in slices["sql"].sink_type and slices["sql"].flow_kind == "direct"
    assert slices["sql_params"].sanitizers == ["parameterized_query"] and slices["sql_params"].risk_level != "high"
    assert slices["pickle"].sink_type == "pickle.loads"
    assert slices["opened"].sink_type == "open"


def test_comments_and_literals_hold_no_calls(slices):
    assert slices["text_only"].sink_type is None


def test_java_and_nested_arguments(slices):
    assert slices["builder"].function_name == "go" and slices["builder"].sink_type == "ProcessBuilder"
    assert slices["deep"].source_var == "a"


def test_line_ranges(slices):
    assert all(r.line_start > 0 and r.line_end >= r.line_start for r in slices.values())


def test_long_literals_do_not_exhaust_the_regex_engine(spark):
    code = "def f(a):\n    x = [" + ", ".join(f'"item{i}"' for i in range(20000)) + "]\n    s = '" + "\\\\'" * 20000 + "'\n    eval(a)\n"
    df = spark.createDataFrame([("1", "a.py", "python", code)], "sample_id string, file string, language string, code string")
    assert ss.scan(df).collect()[0].sink_type == "eval"


def test_files_are_cut_into_functions(spark):
    files = spark.createDataFrame(
        [
            ("x.c", "c", "#include <a.h>\nint a(int x) {\n return strcpy(x);\n}\n\nstatic char *b(char *y)\n{\n  if (y) { system(y); }\n}\n"),
            ("y.py", "python", "import os\n\ndef a(x):\n  eval(x)\n\n\ndef b(y):\n  os.system(y)\n"),
            ("z.py", "python", "print(1)\n"),
            ("q.java", "java", "class A {\n  public void x(String a) {\n foo(a);\n }\n}\n"),
        ],
        "file string, language string, content string",
    )
    got = {(r.file, r.function_name, r.line_start, r.line_end) for r in extract.split_functions(files).collect()}
    assert got == {
        ("x.c", "<module>", 1, 1), ("x.c", "a", 2, 4), ("x.c", "b", 6, 9), ("y.py", "<module>", 1, 1), ("y.py", "a", 3, 4), ("y.py", "b", 7, 8),
        ("z.py", "<module>", 1, 1), ("q.java", "<module>", 1, 1), ("q.java", "x", 2, 4), ("q.java", "<module>", 5, 5),
    }


WHOLE = {
    "c": "#include <a.h>\nint old(a, b)\n  char *a; int b;\n{\n  f(a);\n}\nint x = f(3);\nmain() {\n EACH(x) { y(); }\n}\nint tail(void (*f)(int), int n) { return f(n); }\n",
    "python": "import os\n@dec(\n 1)\nclass A:\n  x = 1\n  @p\n  def m(self,\n      a,\n  ):\n    '''doc\nzero def fake(x):\n'''\n    def inner(q):\n      eval(q)\n    return inner\n\ndef g(a): return a\nasync def h(b):\n  x = (\n1)\nos.system(X)\n",
    "java": "class A {\n  int f = call(3);\n  void run(String d) {\n    new T(new R() { public void go() { x(); } });\n    if (a) { b(); } else if (c) { d(); }\n  }\n  @Override\n  public <T> List<T> all(int a) throws IOException, X {\n  }\n  A() { init(); }\n}\n",
}


@pytest.mark.parametrize(("language", "names"), [("c", ["old", "main", "tail"]), ("python", ["m", "inner", "g", "h"]), ("java", ["run", "go", "all", "A"])])
def test_pieces_cover_every_line(language, names):
    text = WHOLE[language]
    found = splitting.pieces(text, language)
    assert [p["name"] for p in found if p["name"] != "<module>"] == names
    lines = {i for p in found for i in range(p["first"], p["last"] + 1)}
    assert all(i in lines for i, line in enumerate(text.split("\n"), 1) if line.strip())
    assert splitting.pieces("", language) == [] and splitting.pieces(None, None) == []


def test_equal_names_in_two_folders_stay_apart(spark):
    rows = [("a/util.c", "c", "int init(void) { return 1; }\nint init(int a) { return a; }\n"), ("b/util.c", "c", "int init(void) { return 2; }\n")]
    out = extract.split_functions(spark.createDataFrame(rows, "file string, language string, content string")).collect()
    assert len({r.sample_id for r in out}) == 3 and {r.evaluation_key for r in out} == {"util.c#init"}


def test_scan_is_one_stage(spark):
    df = spark.createDataFrame([("1", "a.c", "c", C_COPY)], "sample_id string, file string, language string, code string")
    assert "Exchange" not in ss.scan(df)._jdf.queryExecution().executedPlan().toString()
