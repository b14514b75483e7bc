"""Rule tables against running every rule on every text."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditlake.operators import rule_tables
from auditlake.operators.rule_tables import RuleSet, folded, required

PATTERNS = [
    r"strcpy\s*\(", r"(?i)STRNCPY|memcpy|gets", r"free\(\w+\)", r"(?:foo|ba+r)+x", r"[abc]x?", r"", r"^", r"(?i)straße", r"(?i)k[i]ss", r"a{0,3}bcd", r"(?=mem)mem\w", r"(ab|cd)(ef)?",
    r"x(?#comment)yz", r"(?i:Sql)\.exec", r"\bif\s*\(.*==\s*NULL", r"(?s)begin.*end", r"a|", r"(?<!un)safe", r"\d{2,}", r"(?P<q>['\"])select (?P=q)",
]
PARTS = [
    "strcpy", " (", "STRNCPY", "memcpy", "gets", "free(p)", "foo", "baar", "x", "abcd", "STRASSE", "straße", "Kiss", "kıss", "Kiss", "kiſſ", "kİss", "mema", "cdef", "xyz", "sql.exec",
    "SQL.exec", "if (p == NULL", "begin\n", "end", "unsafe", "safe", "12", "'select '", "", "é", "\x00",
]


def test_literals_never_lose_a_match():
    random.seed(21)
    rules = RuleSet([(k, p, None) for k, p in enumerate(PATTERNS)])
    for _ in range(4000):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 5)))
        want = [k for k, p in enumerate(PATTERNS) if re.search(p, text)]
        assert sorted(rules.matching(text)) == want, text
    assert required(r"strcpy\s*\(") == {"strcpy"} and required(r"(?i)STRNCPY|memcpy|gets") == {"strncpy", "memcpy", "gets"}
    assert required(r"a|b") == required("[abc]xy?") == set() and folded("İSTRASSE") == "istrasse"


def test_only_rules_with_their_literal_run(monkeypatch):
    rules = RuleSet([(k, rf"\bword{k}\b", None) for k in range(10_000)])
    assert rules.matching("a word77 here") == [77]
    tried = []
    rules.compiled = [type("Spy", (), {"search": lambda self, t, k=k: tried.append(k)})() for k in range(10_000)]
    rules.matching("a word77 here")
    assert len(tried) <= 2  # word7 is a prefix of word77


@pytest.mark.parametrize("rule_bytes", [1 << 20, 200])
def test_table_equals_brute_force(spark, rule_bytes):
    random.seed(22)
    texts = [(k, "c" if k % 3 else None, "".join(random.choice(PARTS) for _ in range(6))) for k in range(120)] + [(5, "java", None), (7, "c", "strcpy (" * 5000), (7, "c", "strcpy (" * 5000), (None, "java", "gets")]
    rules = [(k, p, ["c", "java", None][k % 3]) for k, p in enumerate(PATTERNS)] + [(3, PATTERNS[3], None), (None, "gets", None), (99, None, None)]
    df = spark.createDataFrame(texts, "id bigint, language string, text string").withColumn("rule_id", F.lit("x")).repartition(4)
    table = spark.createDataFrame(rules, "rule_id bigint, pattern string, language string")
    got = rule_tables.match(df, table, ["id"], language="language", rule_language="language", rule_bytes=rule_bytes)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0)
    want = [(i, r) for i, lang, t in texts if t is not None for r, p, own in rules if p is not None and own in (None, lang) and re.search(p, t)]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert rule_tables.match(df, table.filter("false"), ["id"]).count() == 0 and rule_tables.match(df.filter("false"), table, ["id"]).count() == 0


def test_matches_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(rule_tables, "MOST_ROWS", 500)
    rules = RuleSet([(k, "gets", None) for k in range(300)] + [(300, "never (here|there)", None)])
    texts = pa.RecordBatch.from_pydict({"id": [*range(40)], "__text": ["gets"] * 40, "__language": pa.nulls(40, pa.string())})
    out = [*rule_tables.matches(iter([texts]), rules, ["id"], pa.int64())]
    assert sum(b.num_rows for b in out) == 40 * 300 and max(b.num_rows for b in out) <= 800
    assert [c is None for c in rules.compiled] == [False, True]


def test_broken_rules_are_named(spark):
    with pytest.raises(ValueError, match="rule 4"):
        rule_tables.match(spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([(4, "(")], "rule_id bigint, pattern string"), [])
