"""Operators 11, 12 and 13."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import impact_search, prefix_trie, queries, token_counts

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")


def test_counts_equal_the_library(documents, odd, none):
    library = token_counts.piece_model(MODEL)
    for df in (documents, odd):
        for size, cache in ((16_384, 200_000), (3, 5)):
            got = token_counts.token_counts(df, MODEL, limit=50, table_size=size, cache_size=cache).collect()
            want = Counter((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 50) for r in df.collect())
            assert Counter(map(tuple, got)) == want
    assert token_counts.token_counts(none, MODEL).count() == 0


def test_pre_tokens_add_up():
    random.seed(11)
    library, table = token_counts.piece_model(MODEL), token_counts.Lengths(["the", ""], token_counts.lengths_of(["the", ""], MODEL), MODEL, 50)
    parts = [" ", "  ", "\n", "\n\n", "a", "the", "▁", "\t", "\r\n", "\x00", "漢字", "é", "<s>", "</s>", "<0x0A>", ";", "🙂", "x" * 60, "."]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(3000)]
    got = sum((table.counts(texts[at : at + 50]) for at in range(0, len(texts), 50)), [])
    assert got == [len(library.encode(t)) for t in texts] and len(table.all) <= 2 + 50 + 50 * 14


def test_summaries_keep_what_is_frequent(spark):
    rows = [("hot " * 50 + " ".join(f"w{i}x{k}" for k in range(100)),) for i in range(60)]
    df = spark.createDataFrame(rows, "text string").repartition(20)
    assert "hot" in token_counts.frequent(df, 4)[:4]  # 20 summaries of 12,000 different words, merged in two rounds


def test_table_bytes_are_checked(documents):
    with pytest.raises(ValueError):
        token_counts.token_counts(documents, MODEL, most_bytes=10)


# -- operator 12


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, digest), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    members, below = defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                below[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    out = []
    for node, convs in members.items():
        inside = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        out.append(
            (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(below[node]), sum(not below[n] for n in inside),
             sum((len(members[n]) - 1) * len(n[-1][1]) for n in inside if n), hashlib.sha256(ends.encode()).hexdigest())
        )
    return Counter(out)


COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def odd_conversations(seed):
    random.seed(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 7_300, 7_399, -5, -100]:
        for t in range(random.choice([1, 2, 3, 9, 30])):
            rows.append((c, t, random.choice(["user", "assistant"]), random.choice(["hi", "ok", "Ünï 漢", ""])))
    rows += [(3, None, None, None), (3, None, "user", None), (4, 0, "user", "again"), (4, 0, "user", "again"), (None, 1, "user", "lost")]
    return rows + [(200, t, "user", "same") for t in range(40)] + [(200 + k, t, "user", "same") for k in (1, 2, 3) for t in range(40 - k)]


@pytest.mark.parametrize(("height", "block", "piece"), [(8, 256, 1000), (2, 4, 3), (64, 256, 1000)])
def test_trie_equals_brute_force(spark, monkeypatch, height, block, piece):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = odd_conversations(height)
    df = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("x") for c in ("node", "depth", "part", "n")})
    assert Counter(map(tuple, prefix_trie.trie(df, height).collect())) == brute_trie(rows)


def test_trie_of_nothing_and_of_one_turn(spark):
    assert prefix_trie.trie(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = [(1, 0, "user", "gone")]  # crc32("1") % 6 is 1: the only turn is replaced by one of a missing conversation
    assert Counter(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, COLUMNS)).collect())) == brute_trie(rows)


# -- operator 13


def brute_search(docs, items, top=10):
    def cut(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    docs = [(i, Counter(cut(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms, df = len(docs), sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in cut(text) if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return Counter(out)


ITEMS = [(1, "word60 word61 WORD62 word60"), (1, "one two"), (2, None), (3, ""), (4, "nothing-of-the-kind zzz"), (None, "Ünï çödé 漢字"), (6, "w1x0 w2x0 tail x endoftext")]


def test_search_equals_brute_force(spark, documents, odd, none, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert Counter(map(tuple, impact_search.search(documents, benchmark).collect())) == brute_search(rows, items)
    odd_items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("number", F.lit("x")).withColumn("score", F.lit(1))
    for top, postings, item_bytes in ((10, 1_000_000, 4 << 20), (3, 1, 30)):
        got = impact_search.search(odd, odd_items, top, postings, item_bytes).collect()
        assert Counter(map(tuple, got)) == brute_search([(r.doc_id, r.text) for r in odd.collect()], ITEMS, top)
    assert impact_search.search(none, odd_items).count() == 0 and impact_search.search(odd, odd_items.filter("false")).count() == 0


def test_ties_go_by_id_and_blocks_share_a_bound(spark):
    rows = [(i, "same words here") for i in range(500, 0, -1)] + [(1000 + i, f"same other{i}") for i in range(50)]
    docs, items = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), spark.createDataFrame([(1, "same words")], "item_id bigint, text string")
    assert Counter(map(tuple, impact_search.search(docs, items, block_postings=100).collect())) == brute_search(rows, [(1, "same words")])


def test_interval_search_equals_a_scan_of_all_documents():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n_docs, n_terms = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        lists = [np.flatnonzero(rng.random(n_docs) < rng.choice([0.0, 0.1, 0.6, 1.0])) for _ in range(n_terms)]
        docs, df = np.concatenate(lists), np.array([len(x) for x in lists])
        block = impact_search.Block(rng.integers(1, 50, n_docs), df, docs, rng.integers(1, 4, len(docs)), rng.integers(0, 3000, n_terms), n_docs, 25 * n_docs)
        own, repeats = np.arange(n_terms), rng.integers(1, 3, n_terms)
        score = np.zeros(n_docs, np.int64)
        np.add.at(score, docs, block.impact * np.repeat(repeats, df))
        best = sorted((-int(s), d) for d, s in enumerate(score) if s)[:5]
        want = [(-s, d) for s, d in best]
        assert block.search(own, repeats, 5, 0) == want
        if len(want) == 5:
            assert block.search(own, repeats, 5, want[-1][0]) == want
        assert all(s <= want[0][0] for s, _ in block.search(own, repeats, 5, 0, rounds=1))


def test_queries_of_whole_tables(spark, sf):
    counted = queries.QUERIES["op11_token_counts"](spark, sf)
    assert counted.count() == 200 and counted.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert queries.QUERIES["op12_prefix_trie"](spark, sf).filter("depth = 0 AND parent_conv_id IS NULL").count() == 1
    assert queries.QUERIES["op13_impact_search"](spark, sf).agg(F.max("rank")).first()[0] == 10
