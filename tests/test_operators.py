"""Operators against plain-Python brute force and stated facts."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditlake.operators import dependencies as dp, evaluate as ev, findings as fo, responses as rs, retrieval as rt
from auditlake.operators import requests as rq, traffic as tr, votes as vt, windows
from auditlake.operators import sampling as sp


def test_responses_ladder(spark):
    rows = [
        ("fenced", 'text\n```json\n{"a": 1}\n```'), ("whole", ' {"a": 1} '), ("braces", 'see {"a": 1} ok'),
        ("whole", '<think>{"b": 2}</think>{"a": 1}'), ("quarantine", "just prose"), ("quarantine", '<think>{"a": 1}'),
        ("stray_quote", '{"confidence":1.0","reasoning":"x"}'), ("salvaged", '{"a": 1, "b": "two", "c": "cut of'),
        ("quarantine", '{"a": 1} {"b": 2}'), ("quarantine", ""), ("quarantine", None), ("open_fence", '```json\n{"a": 1}'),
    ]
    got = [r.parsed_from for r in rs.parse(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "i int, raw string")).orderBy("i").collect()]
    assert got == [w for w, _ in rows]


def test_salvage_keeps_all_complete_pairs(spark):
    rnd = random.Random(51)

    def value(depth):
        kind = rnd.randint(0, 6 if depth < 5 else 3)
        if kind > 4:
            return {f"k{i}": value(depth + 1) for i in range(rnd.randint(0, 3))}
        if kind > 3:
            return [value(depth + 1) for _ in range(rnd.randint(0, 3))]
        return rnd.choice([1, -2.5, True, None, "a, b", 'q"{', "\\", "é}]", ""])

    texts, want = [], []
    for _ in range(300):
        whole = {f"p{i}": value(0) for i in range(rnd.randint(1, 5))}
        raw = json.dumps(whole, ensure_ascii=rnd.random() < 0.5)
        cut = raw[: rnd.randint(1, len(raw) - 1)]
        complete = {}
        for name in whole:  # pairs whose comma is still there
            kept = {**complete, name: whole[name]}
            if any(json.dumps(kept, ensure_ascii=a)[:-1] + "," in (cut[: len(json.dumps(kept, ensure_ascii=a))],) for a in (True, False)):
                complete = kept
            else:
                break
        texts.append(cut)
        want.append(complete)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r.i: r.c for r in df.select("i", rs.cut_at_last_pair(F.col("t")).alias("c")).collect()}
    assert all((json.loads(got[i]) if got[i] else {}) == w for i, w in enumerate(want)) and sum(map(bool, want)) > 100
    long = '{"a": [' + '{"b": 1}, ' * 50_000
    assert rs.parse(spark.createDataFrame([('{"x": 1, ' + long[1:],)], "raw string")).first().json == '{"x": 1}'


def test_verdict_defaults_and_clamp(spark):
    v = rs.verdicts(spark.createDataFrame([('{"confidence": 2.5, "line_numbers": [1, "2", "x", 3.5]}',), ("{}",)], "raw string")).collect()
    assert (v[0].v.confidence, v[0].v.line_numbers) == (1.0, [1, 2])
    assert (v[1].v.has_vulnerability, v[1].v.confidence, v[1].v.vulnerability_type, v[1].v.line_numbers) == (False, 0.0, "UNKNOWN", [])


def test_focus_window_against_brute_force(spark):
    rnd = random.Random(1)
    cases = []
    for i in range(60):
        lines = [f"line{n}" + "x" * rnd.randint(0, 80) for n in range(rnd.randint(1, 60))]
        cases.append((i, "\n".join(lines), sorted({rnd.randint(1, 70) for _ in range(rnd.randint(0, 12))})))

    def brute(code, focus, n=5, limit=600, fallback=200):
        if not focus:
            return code[:fallback]
        lines, seen, parts = code.split("\n"), set(), []
        for f in focus:
            for i in range(max(0, f - 1 - n), min(len(lines), f + n)):
                if i not in seen:
                    seen.add(i)
                    parts.append(lines[i])
            parts.append(f"# --- focus line {f} ---")
        text = "\n".join(parts)
        return text[:limit] + "\n# ... (truncated)" if len(text) > limit else text

    df = spark.createDataFrame(cases, "i int, code string, focus array<int>")
    got = df.select("i", windows.focus_window(F.col("code"), F.col("focus"), max_chars=600, fallback_chars=200).alias("w")).collect()
    assert {r.i: r.w for r in got} == {i: brute(c, f) for i, c, f in cases}


def test_focus_lines_keep_enough_for_the_window(spark):
    """A sample with very many finding lines gives the same window as with all of them."""
    code = "\n".join(f"l{i}" for i in range(5000))
    f = spark.createDataFrame([("s", "a", i) for i in range(1, 4000)], "sample_id string, tool string, line int")
    kept = windows.focus_lines(f, max_chars=3000).collect()[0].focus
    assert len(kept) < 200
    df = spark.createDataFrame([(code, kept, list(range(1, 4000)))], "code string, kept array<int>, every array<int>")
    r = df.select(windows.focus_window(F.col("code"), F.col("kept")).alias("a"), windows.focus_window(F.col("code"), F.col("every")).alias("b")).collect()[0]
    assert r.a == r.b


def test_top_k_ways_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    d, q = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    d[100:200] = d[0]  # a third are copies
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "doc_id bigint, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(unit(q) @ unit(d).T, 9)
    want = {(i, int(j), r + 1) for i in range(40) for r, j in enumerate(np.lexsort((np.arange(300), -sim[i]))[:7])}
    for limit in (1 << 20, 5):
        got = rt.top_k(queries, docs, k=7, broadcast_bytes=limit, block_rows=64)
        assert {(r.query_id, r.doc_id, r.rank) for r in got.collect()} == want


def test_version_order(spark):
    order = ["1.0dev3", "1.0a1", "1.0-beta.2", "1.0rc1", "1.0rc10", "1.0", "1.0.0.1", "1.9", "1.10", "v2.0.0rc1", "2"]
    same = {"v1.10.0": "1.10", "2.0.0": "2", "1.0alpha1": "1.0a1", "1.0+build7": "1.0"}
    r = spark.createDataFrame([(v,) for v in [*order, *same, "2.0.post-x", "abc"]], "v string").select("v", dp.version_key(F.col("v")).alias("k"), dp.comparable(F.col("v")).alias("ok"))
    rows = {x.v: x for x in r.collect()}
    assert sorted(order, key=lambda v: rows[v].k) == order and all(rows[v].ok for v in order)
    assert all(rows[a].k == rows[b].k for a, b in same.items())
    assert not rows["2.0.post-x"].ok and not rows["abc"].ok


def test_ranges_types_order_and_open_questions(spark):
    def advisory(id, *ranges, versions=()):
        return (id, [((("a", "PyPI")), [(kind, [tuple(e.get(k) for k in ("introduced", "fixed", "last_affected")) for e in events]) for kind, events in ranges], list(versions))])

    adv = [
        advisory("sorted", ("ECOSYSTEM", [{"fixed": "2.0"}, {"introduced": "0"}, {"introduced": "2.5"}, {"last_affected": "3.0"}])),
        advisory("commits", ("GIT", [{"introduced": "0"}])),
        advisory("rc", ("SEMVER", [{"introduced": "1.0"}, {"fixed": "v2.0.0rc1"}])),
        advisory("asked", ("ECOSYSTEM", [{"introduced": "1.0"}, {"fixed": "2.0.post-x"}]), versions=["1.5"]),
    ]
    kind = "id string, affected array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,versions:array<string>>>"
    deps = spark.createDataFrame([("p", "m", "a", v, "PyPI") for v in ("1.5", "2.0", "2.0.0rc1", "3.0", "3.1", "odd")], "project string, manifest string, name string, version string, ecosystem string")
    got = {(r.version, r.id): r.status for r in dp.match(deps, dp.rules(spark.createDataFrame(adv, kind))).collect()}
    want = {("1.5", "sorted"): "affected", ("2.0.0rc1", "sorted"): "affected", ("3.0", "sorted"): "affected", ("odd", "sorted"): "unknown", ("1.5", "rc"): "affected", ("odd", "rc"): "unknown"}
    want |= {(v, "asked"): "unknown" for v in ("2.0", "2.0.0rc1", "3.0", "3.1", "odd")} | {("1.5", "asked"): "affected"}
    assert got == want


def test_listed_versions_and_a_skewed_package(spark):
    rnd = random.Random(41)
    versions = [f"{a}.{b}" for a in range(20) for b in range(20)] + ["v1.2.0", "1.2", "1.2.0.0", "odd", "1.5rc1"]
    ranges = [(f"adv{i}", *sorted(rnd.sample([(a, b) for a in range(22) for b in range(20)], 2)), rnd.choice(["fixed", "last_affected", None])) for i in range(150)]
    rows = [(i, [(("big", "PyPI"), [("ECOSYSTEM", [(f"{lo[0]}.{lo[1]}", None, None), (None, *((f"{hi[0]}.{hi[1]}", None) if end == "fixed" else (None, f"{hi[0]}.{hi[1]}")))][: 2 if end else 1])], [])]) for i, lo, hi, end in ranges]
    rows += [("listed", [(("big", "PyPI"), [], ["1.2.0", "odd"])]), ("other", [(("big", "Maven"), [], ["1.2"])]), ("empty", [(("big", "PyPI"), None, None)])]
    kind = "id string, affected array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,versions:array<string>>>"
    deps = spark.createDataFrame([("p", "m", "big", v, "PyPI") for v in versions * 2], "project string, manifest string, name string, version string, ecosystem string")
    got = {(r.version, r.id): r.status for r in dp.match(deps, dp.rules(spark.createDataFrame(rows, kind))).collect()}
    number = lambda v: {"v1.2.0": (1, 2), "1.2.0.0": (1, 2), "1.5rc1": (1, 4.5)}.get(v) or tuple(map(int, v.split(".")))
    want = {("odd", i): "unknown" for i, *_ in ranges} | {(v, "listed"): "affected" for v in ("1.2", "v1.2.0", "1.2.0.0", "odd")}
    for i, lo, hi, end in ranges:
        for v in set(versions) - {"odd"}:
            at = number(v)
            if lo <= at and (end is None or at < hi or end == "last_affected" and at == hi):
                want[v, i] = "affected"
    assert got == want


def test_packages_of_few_and_of_many_rules_are_matched_alike(spark):
    rnd = random.Random(7)
    bounds = ["0", "1.0", "v1.2", "1.2.0rc1", "2.0", "2.0.post-x", "3"]
    rows = []
    for i in range(60):
        events = [(rnd.choice(bounds), None, None)] + rnd.choice([[], [(None, rnd.choice(bounds), None)], [(None, None, rnd.choice(bounds))]])
        rows.append((f"adv{i}", [((f"pkg{i % 7}", "PyPI"), [("ECOSYSTEM", events)], rnd.choice([None, [], [None], ["1.2", None, "odd"]]))]))
    rows.append(("nothing", [(("bare", "PyPI"), None, [None])]))
    kind = "id string, affected array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,versions:array<string>>>"
    names = [f"pkg{i}" for i in range(8)] + ["bare", None]
    deps = spark.createDataFrame([("p", "m", n, v, "PyPI") for n in names for v in ["0.5", "1.2", "v1.2.0", "1.2rc1", "2", "3.0", "odd", None]], "project string, manifest string, name string, version string, ecosystem string")
    told = dp.rules(spark.createDataFrame(rows, kind))
    few, mixed, many = (sorted(map(tuple, dp.match(deps, told, n).collect())) for n in (64, 9, 0))
    assert few and few == mixed == many
    assert not any(r[1] == "bare" for r in few)  # a null among the listed versions is no range without bounds


def test_cache_split_covers_the_input(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    cache = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b", "2023-12-30 00:00:00")], "key string, t string").select("key", F.col("t").cast("timestamp").alias("cached_at"))
    hits, misses = dp.split_by_cache(wanted, cache, now)
    assert [r.key for r in hits.collect()] == ["a"] and sorted(r.key for r in misses.collect()) == ["b", "c"]


def test_universes_and_counts(spark):
    rnd = random.Random(2)
    t = {str(i): rnd.random() < 0.5 for i in range(50)}
    p = {str(i): rnd.random() < 0.5 for i in range(30, 90)}
    truth = spark.createDataFrame(list(t.items()), "sample_id string, label boolean")
    pred = spark.createDataFrame(list(p.items()), "sample_id string, pred boolean")
    for universe, keys in (("union", t.keys() | p.keys()), ("truth", t.keys()), ("answered", t.keys() & p.keys())):
        m = ev.metrics(ev.pair(truth, pred, ["sample_id"], universe=universe)).collect()[0]
        tp = sum(t.get(k, False) and p.get(k, False) for k in keys)
        assert m.tp == tp and m.tp + m.fp + m.fn + m.tn == len(keys)


def test_empty_denominators_are_zero(spark):
    m = ev.metrics(spark.createDataFrame([(False, False)], "label boolean, pred boolean")).collect()[0]
    assert (m.precision, m.recall, m.f1, m.fpr, m.accuracy) == (0.0, 0.0, 0.0, 0.0, 1.0)


def test_keep_first_is_idempotent(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "k int, o int")
    once = sp.keep_first(df, ["k"], ["o"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sp.keep_first(once, ["k"], ["o"]).collect())) == [(i, i) for i in range(7)]


def test_large_first_n_of_a_dominant_class(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), "id")
    got = sp.first_n(df, ["k"], ["id"], 1500)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(r[1] for r in rows if r[0] == "a") == [3 * i for i in range(1500)]
    assert sorted(r[1] for r in rows if r[0] == "b") == [i for i in range(9000) if i % 3][:1500]


def test_consensus_levels(spark):
    rows = [("h", "a", "x"), ("h", "b", "x"), ("c", "a", "x"), ("c", "b", "y"), ("m", "a", "x"), ("m", "a", "y"), ("l", "a", "x")]
    got = {r.sample_id: (r.level, r.agreed_area) for r in fo.consensus(spark.createDataFrame(rows, "sample_id string, tool string, type string")).collect()}
    assert got == {"h": ("high", "x"), "c": ("conflict", None), "m": ("medium", "x"), "l": ("low", "x")}


def test_confidence_vote_counts_uncertain_in_the_total(spark):
    v = spark.createDataFrame([("a", "confirmed_vuln", 0.5), ("a", "uncertain", 0.4), ("a", "uncertain", 0.4)], "sample_id string, verdict string, confidence double")
    assert vt.confidence_vote(v).collect()[0].verdict == "false_positive"


def test_render_never_rereads_filled_text(spark):
    df = spark.createDataFrame([("{b}", "x")], "a string, b string")
    assert df.select(rq.render("{{{a}}} {b}").alias("t")).collect()[0].t == "{{b}} x"


def test_presets_merge_per_section(spark):
    p = rq.params_for("v3", {"static_decision": {"no_sink": "uncertain"}})
    assert p["static_decision"] == {"no_sink": "uncertain", "low_risk_sink": "safe", "sanitizer_threshold": 2, "dataflow_required": True}
    base = spark.createDataFrame(rq.preset_rows(), "config string, section string, key string, value string")
    over = spark.createDataFrame([("v1", "llm", "mode", "single_pass")], base.schema)
    got = {r.config: r for r in rq.preset_comparison(rq.merge_overrides(base, over)).collect()}
    assert got["v1"].strategy == "single_pass" and got["v4"].strategy == "tool_aware_chain" and got["v3"].no_sink == "safe"


def test_sessions_of_a_busy_user_match_brute_force(spark):
    rnd = random.Random(5)
    rows, t = [], 0
    for i in range(400):
        t += rnd.choice([60, 600, 4000, 90000])
        rows.append((1, i, t))
    df = spark.createDataFrame(rows, "user_id int, event_id int, s int").withColumn("ts", F.timestamp_seconds("s")).withColumn("bucket", F.to_date("ts"))
    got = {r.event_id: r.session_no for r in tr.sessions(df, gap_minutes=30).collect()}
    want, n, before = {}, 0, None
    for _, i, s in rows:
        n += before is None or s - before > 1800
        want[i], before = n, s
    assert got == want


def test_merge_nearby(spark):
    df = spark.createDataFrame([("s", "CWE-1", x) for x in (1, 3, 5, 9, 9, 11, 20)], "sample_id string, cwe string, line int")
    got = {(r.line_from, r.line_to, r.finding_count) for r in fo.merge_nearby(df).collect()}
    assert got == {(1, 5, 3), (9, 11, 3), (20, 20, 1)}


def test_overturn_keeps_both_reasons(spark):
    from auditlake.plans import triage

    df = spark.sql(
        """SELECT 's' AS sample_id,
        named_struct('initial_verdict', 'suspicious', 'window_suggestion', 'iris', 'blind_spot_risk', 'low', 'confidence', 0.6D, 'reasoning', 'first') AS a1,
        named_struct('verdict', 'safe', 'confidence', 0.8D) AS a2,
        CAST(NULL AS struct<verdict:string,confidence:double>) AS fs,
        named_struct('has_vulnerability', true, 'no_findings', false, 'confidence', 0.7D, 'reasoning', 'other area', 'cwe_type', 'CWE-78') AS a3"""
    )
    r = triage.resolve_tool_aware(df).collect()[0]
    assert (r.final_verdict, r.final_method, r.final_confidence, r.llm_calls) == ("vuln", "tool_aware_a2_false_positive_a3_blind_spot", 0.7, 3)
    assert r.reasoning == "first [A3 BLIND SPOT: other area]" and r.vulnerability_type == "CWE-78"


def test_findings_text_and_blocks_hold_every_finding(spark):
    rows = [("s", "t", "x", i, f"m{i}") for i in range(1_203)] + [("q", "t", "x", 1, "m")]
    df = spark.createDataFrame(rows, "sample_id string, tool string, type string, line int, message string")
    text = {r.sample_id: r.findings_summary for r in fo.findings_text(df, most_lines=100_000).collect()}
    assert text["s"].split("\n") == [f"  [t] x @ line {i}: m{i}" for i in range(1_203)] and text["q"] == "  [t] x @ line 1: m"
    blocks = [r for r in fo.findings_blocks(df).orderBy("block").collect() if r.sample_id == "s"]
    assert [r.block for r in blocks] == [0, 1, 2] and max(r.findings_summary.count("\n") for r in blocks) == 499
    assert "\n".join(r.findings_summary for r in blocks) == text["s"]


def test_findings_text_has_a_last_line_where_it_is_cut(spark):
    rows = [("s", "t", "x", i, f"m{i}", 1) for i in range(30)] + [("s", "t", "x", 0, "m0", 1), ("q", "t", "x", 1, "m", 1)]
    df = spark.createDataFrame(rows, "sample_id string, tool string, type string, line int, message string, n int")
    got = {r.sample_id: r.findings_summary.split("\n") for r in fo.findings_text(df, most_lines=5).collect()}
    assert len(got["s"]) == 6 and got["s"][0].endswith("(x2)") and got["s"][-1] == "  ... (more findings)" and len(got["q"]) == 1


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_top_k_ranks_few_documents_whole(monkeypatch, metric):
    rng = np.random.default_rng(4)
    d = rng.normal(size=(6000, 16)) * 10
    d[500:900], d[3000:3400], d[100] = d[7], d[7] * 2, 0  # copies, equal directions, a zero vector
    q, ids = np.vstack([d[::40], d[7:8], np.zeros((1, 16))]), np.array([f"d{k}" for k in range(6000)])
    ranked, whole = [], rt._chunk_best
    monkeypatch.setattr(rt, "_chunk_best", lambda q, i, d, *rest: ranked.append(len(q) * len(d)) or whole(q, i, d, *rest))
    parts = [pd.DataFrame({"doc_id": ids[at : at + 2500], "vector": list(d[at : at + 2500])}) for at in range(0, 6000, 2500)]
    got = pd.concat([*rt._best_of(np.arange(len(q)), q, iter(parts), 5, -1e9, metric)])
    assert sum(ranked) < len(q) * 6000 / 4
    sim = rt._similarity(q, d, metric)
    want = [(k, ids[i], sim[k, i]) for k in range(len(q)) for i in np.lexsort((ids, -sim[k]))[:5]]
    key = got.sort_values(["query_id", "similarity", "doc_id"], ascending=[True, False, True])
    assert [*zip(key["query_id"], key["doc_id"])] == [w[:2] for w in want] and np.allclose(key["similarity"], [w[2] for w in want], atol=2e-9)
