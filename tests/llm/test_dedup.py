"""Operators 1, 2, 4 and 9 against brute force."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import components, containment, edit_near_dedup, radix_dedup, suffix_dedup
from auditlake.llm.common import HandOver
from auditlake.llm.suffix_groups import suffix_order


def edit_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def groups_of(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = defaultdict(set)
    for i in ids:
        out[find(i)].add(i)
    return {frozenset(x) for x in out.values()}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.integers(0, 9))
def test_band_says_what_the_full_table_says(a, b, most):
    assert edit_near_dedup.Aligned(a).within(b, most) == (edit_distance(a, b) <= most)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=30))
def test_suffix_order_equals_sorting(symbols):
    text = [*symbols, 0]
    assert suffix_order(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint"), HandOver(spark), "t").collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(31)} | {(i, 100) for i in range(100, 160)} | {(200, 200), (201, 200)}


def test_near_classes_equal_all_pairs(documents):
    got = edit_near_dedup.near_duplicates(documents).collect()
    words = {r.doc_id: (r.text or "").lower().split() for r in documents.collect()}
    bags = {i: Counter(w) for i, w in words.items()}
    ids, links = sorted(words), []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            longer = max(len(words[a]), len(words[b]))
            if sum((bags[a] & bags[b]).values()) >= 0.8 * longer - 1e-9 and edit_distance(words[a], words[b]) <= int(0.2 * longer + 1e-9):
                links.append((a, b))
    classes = defaultdict(set)
    for r in got:
        classes[r.class_id].add(r.doc_id)
        assert r.kept == (r.doc_id == r.class_id)
    assert {frozenset(x) for x in classes.values()} == groups_of(links, ids)
    assert all(r.class_size == len(classes[r.class_id]) for r in got)


def test_near_classes_of_odd_rows(odd, none):
    got = edit_near_dedup.near_duplicates(odd).collect()
    assert len(got) == 15 and sum(r.kept for r in got) == 6  # prose, no words, two, long, unicode, xs
    prose = [r for r in got if r.class_size == 5]
    assert len(prose) == 5 and sum(r.kept for r in prose) == 1
    assert edit_near_dedup.near_duplicates(none).count() == 0
    assert edit_near_dedup.without_near_duplicates(odd).columns == odd.columns


def test_a_bucket_of_strangers_loses_no_link(spark):
    """Texts that share one long passage meet in every bucket; only those that are alike may be joined."""
    random.seed(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = [f"u{i // 3}_{k}" for k in range(90)]
        if i % 3:
            own[random.randrange(90)] = f"edit{i}"
        rows.append((i, " ".join(own[:45] + passage + own[45:])))
    got = edit_near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 3 for i in range(60)}


def test_pairs_whose_buckets_are_led_by_a_stranger(spark):
    """Every ten-word block of a row is in half of all rows; rows differ in five of 20 blocks and more (0.75), partners in four (0.8)."""
    random.seed(7)
    taken, rows = [], []
    while len(rows) < 160:
        one = [random.randrange(2) for _ in range(20)]
        two = [1 - x if k in (1, 6, 11, 16) else x for k, x in enumerate(one)]
        if all(sum(x != y for x, y in zip(new, old)) > 4 for new in (one, two) for old in taken):
            taken += [one, two]
            rows += [(len(rows) + n, " ".join(f"b{k}_{x}_{i}" for k, x in enumerate(v) for i in range(10))) for n, v in enumerate((one, two))]
    got = edit_near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i in range(160)}


def test_scattered_edits_become_candidates(spark):
    """Copies of 200 words with single words replaced at random places, at 0.8, 0.85 and 0.9."""
    random.seed(3)
    rows = []
    for i in range(150):
        words = [f"w{i}_{k}" for k in range(200)]
        edited = list(words)
        for k in random.sample(range(200), (40, 30, 20)[i % 3]):
            edited[k] = f"e{i}_{k}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
    got = {r.doc_id: r.class_id for r in edit_near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = [sum(got[2 * i + 1] == 2 * i for i in range(at, 150, 3)) for at in range(3)]
    assert found[0] >= 45 and found[1] >= 49 and found[2] == 50


def test_bags_never_leave_out_a_pair_that_is_alike():
    random.seed(9)
    for _ in range(300):
        a = random.choices(range(40), k=random.randrange(1, 60))
        b = [x if random.random() < 0.8 else random.randrange(60) for x in a if random.random() < 0.95]
        one, two = (np.frombuffer(edit_near_dedup.bag(np.array(x, np.uint64)), np.uint8).astype(int) for x in (a, b))
        assert max(np.maximum(one - two, 0).sum(), np.maximum(two - one, 0).sum()) <= edit_distance(a, b)


def test_equal_texts(documents, odd, none):
    for df in (documents, odd):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        best, size = {}, Counter(t for _, t in rows)
        for i, t in rows:
            best[t] = max(best.get(t, -1), -1 if i is None else i)
        got = radix_dedup.exact_duplicates(df, digest=True).collect()
        want = sorted((-1 if i is None else i, best[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
        assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(best) == radix_dedup.without_duplicates(df).count()
    assert radix_dedup.exact_duplicates(none).count() == 0


@pytest.mark.parametrize("at", [0, 63, 64, 65, 511, 575, 576, 577, 4_700])
def test_texts_that_differ_in_one_byte_or_in_length(spark, at):
    base = "a" * 4_700
    rows = [(0, base), (1, base[:at]), (2, base[:at] + "b" + base[at + 1 :]), (3, base), (4, base[:at])]
    got = radix_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = {i: max(k for k, t in rows if t == text) for i, text in rows}
    assert {r.doc_id: r.keep_id for r in got} == want


def covered(data, length):
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        spans = []
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append([tuple(s) for s in spans])
    return out


def spans_of(df):
    return {r.doc_id: ([(s["from"], s["to"]) for s in r.spans], bytes(r.kept)) for r in df.collect()}


def test_repeated_strings(documents):
    rows = [(r.doc_id, (r.text or "").encode()) for r in documents.collect()]
    got = spans_of(suffix_dedup.without_repeats(documents))
    for (i, b), spans in zip(rows, covered([b for _, b in rows], 400)):
        assert got[i][0] == spans
        left = bytearray()
        end = 0
        for s, e in spans:
            left += b[end:s]
            end = e
        assert got[i][1] == bytes(left + b[end:])


@pytest.mark.parametrize("most", [20_000, 5])
def test_repeats_at_every_offset_and_in_crowds(spark, monkeypatch, most):
    """``most`` 5 sends keys with many different entries the counted way."""
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    random.seed(7)
    noise = lambda n: "".join(random.choices("abcdefgh ", k=n))
    passage = noise(470)
    texts = [noise(random.randrange(300)) + passage[random.randrange(40) : 470 - random.randrange(40)] + noise(random.randrange(300)) for _ in range(40)]
    texts += [passage * 3, "z" * 1_300, noise(900), texts[0], passage[:399], passage[:400]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = spans_of(suffix_dedup.without_repeats(df))
    assert [got[i][0] for i in range(len(texts))] == covered([t.encode() for t in texts], 400)


def test_repeats_of_odd_rows(odd, none):
    got = suffix_dedup.without_repeats(odd).collect()
    assert len(got) == 15
    assert {r.doc_id: len(r.kept) for r in got}[11] == 0  # the same letter all over
    assert suffix_dedup.without_repeats(none).count() == 0


def runs(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_items_inside_documents(spark, documents, sf, odd, none):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.containment for r in containment.contained(documents, items, block_bytes=2_000).collect()}
    want = {}
    docs = {r.doc_id: runs(r.text or "") for r in documents.collect()}
    for item in items.collect():
        own = runs(item.text)
        for i, d in docs.items():
            share = len(own & d) / len(own)
            if share >= 0.8:
                want[i, item.item_id] = share
    assert got == want and want
    clean = containment.without_contaminated(documents, items)
    assert {r.doc_id for r in clean.collect()} == set(docs) - {i for i, _ in want}
    assert containment.contained(odd, items).count() == 0 and containment.contained(none, items).count() == 0
    assert containment.contained(documents, items.filter("false")).count() == 0
    odd_items = spark.createDataFrame([(1, None), (2, ""), (None, "one two"), (4, " ".join(f"word{i}" for i in range(20, 60)))], "item_id bigint, text string")
    pairs = sorted((r.doc_id or 0, r.item_id or 0) for r in containment.contained(odd, odd_items).collect())
    assert pairs == sorted([(1, 4), (2, 4), (2, 4), (0, 4), (9, 4), (6, 0)])


def test_items_of_one_to_four_words_are_found_in_long_documents(spark, none):
    random.seed(79)
    vocabulary = [f"v{i}" for i in range(60)]
    docs = [(i, " ".join(random.choices(vocabulary, k=random.choice([0, 1, 2, 3, 4, 5, 60, 300])))) for i in range(80)] + [(80, None), (81, "V1  v2\nv3")]
    items = [(i, " ".join(random.choices(vocabulary, k=random.randint(1, 4)))) for i in range(40)] + [(40, "v1 v2 V3"), (41, ""), (42, None), (43, " ".join(vocabulary[:6]))]

    def has(text, item):
        a, b = (text or "").lower().split(), (item or "").lower().split()
        return bool(b) and any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1))

    df, table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    for block_bytes in (16 << 20, 100):
        got = {(r.doc_id, r.item_id) for r in containment.contained(df, table, block_bytes=block_bytes).collect()}
        assert got == {(d, i) for d, text in docs for i, item in items if has(text, item)}
    assert containment.without_contaminated(df, table).count() == sum(not any(has(t, i) for _, i in items) for _, t in docs)


@pytest.mark.parametrize("block", [4096, 7])
def test_pairs_of_a_bucket_by_cells_of_blocks(spark, block):
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(600)]
    words = {}
    for i in range(60):  # a passage with rests of several lengths, and near copies of some
        own = passage + [f"w{i}x{j}" for j in range(rnd.choice([100, 200, 230]))]
        words[2 * i], words[2 * i + 1] = own, own[:3] + own[4:] + [f"z{i}"] * (i % 9)
    buckets = {1: list(words), 2: list(words), 3: rnd.sample(list(words), 20), 4: [0, 1], 5: [118]}
    root = {i: i if i % 5 else 0 for i in words}
    nodes = [(i, bytearray(edit_near_dedup.bag(edit_near_dedup.WordHashes().of(w)))) for i, w in words.items()]
    left = spark.createDataFrame([(b, i, root[i], len(words[i])) for b, ids in buckets.items() for i in ids], "bucket bigint, row_id bigint, root bigint, n_words bigint")
    near = edit_near_dedup._near_bags(left, spark.createDataFrame(nodes, "row_id bigint, bag binary"), 0.8, block)
    got = [tuple(r) for r in near.collect()]
    want = set()
    for a, b in itertools.combinations(sorted(words), 2):
        longer = max(len(words[a]), len(words[b]))
        if root[a] != root[b] and longer - sum((Counter(words[a]) & Counter(words[b])).values()) <= int(0.2 * longer + 1e-9):
            want.add((a, b))
    assert len(got) == len(set(got)) and set(got) >= want and want
    # hardly a pair is left that the exact number of shared words rules out
    assert len(got) <= 1.1 * len(want)


def test_rows_between_steps_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """Texts of the same words, a third in another order each: nearly all pairs of a bucket must be aligned, none may be lost, few become rows."""
    monkeypatch.setattr(edit_near_dedup, "BLOCK", 100)
    bands, rnd, words = 4, random.Random(11), []
    for i in range(360):
        own = [f"b{i}" for i in range(65)] + [f"c{i}" for i in rnd.sample(range(35), 35)]
        if i % 2:
            own = list(words[-1])
            for k in rnd.sample(range(65, 100), 3 * (i % 9)):
                own[k] = f"e{i}_{k}"
        words.append(own)
    counted = {}

    class Counting(HandOver):
        def settle(self, df, name):
            out = super().settle(df, name)
            counted[name] = out.count()
            return out

    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id bigint, text string")
    rows, roots = edit_near_dedup.classes(docs, Counting(spark), bands=bands)
    assert max(counted.values()) <= 2 * bands * len(words), counted
    own = dict(rows.select("row_id", "doc_id").join(roots, "row_id").select("doc_id", "root").collect())
    got = defaultdict(set)
    for i in range(len(words)):
        got[own.get(i, -1 - i)].add(i)
    wide = [edit_near_dedup.sketch(edit_near_dedup.shingles(edit_near_dedup.WordHashes().of(w), edit_near_dedup.RUN), bands)[0] for w in words]
    links = []
    for a, one in enumerate(words):
        aligned = edit_near_dedup.Aligned(one)
        links += [(a, b) for b in range(a + 1, len(words)) if set(wide[a]) & set(wide[b]) and edit_near_dedup.similar(aligned, words[b], 0.8)]
    assert {frozenset(x) for x in got.values()} == groups_of(links, range(len(words)))
    assert 1 < len(got) < len(words)
