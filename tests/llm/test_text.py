"""Operators 3, 5, 6, 7, 8 and 10, and the pipeline."""

import heapq
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditlake.llm import best_fit, chat_repair, context_tree, license_scan, queries, token_matrix, toxic_segments
from auditlake.llm.license_rules import rules

P = pytest.importorskip("public_tokenizers")


def test_matrix_round_trip(odd, none, documents):
    path = P.path("byte_bpe_50k.tiktoken")
    bpe = token_matrix.byte_bpe(path, P.PATTERN)
    for df in (documents, odd):
        matrix = token_matrix.packed(df, path, P.PATTERN, 50_256, seq_len=256, block_ids=20_000)
        for r in matrix.collect():
            ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
            assert len(ids) == len(positions) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids
            for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
                assert positions[a:b].tolist() == list(range(b - a))
            assert not positions[r.n_ids :].any()
        found = defaultdict(list)
        for r in token_matrix.documents_of(matrix).collect():
            found[r.doc_id].append((r.piece, np.frombuffer(r.ids, "<u2").tolist()))
        texts = Counter((r.doc_id, r.text or "") for r in df.collect())
        for (i, text), n in texts.items():
            if list(texts).count((i, text)) == 1 and n == 1 and i is not None:
                ids = [x for _, piece in sorted(found[i]) for x in piece]
                assert ids[-1] == 50_256 and bpe.decode(ids[:-1]) == text
    assert token_matrix.packed(none, path, P.PATTERN, 50_256).count() == 0


def test_segment_tree_search_equals_a_scan():
    random.seed(2)
    for _ in range(200):
        lengths = [random.randint(1, 40) for _ in range(random.randint(0, 60))]
        rows = token_matrix.best_fit_decreasing(lengths, 40)
        free, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r, f in enumerate(free) if f >= lengths[i]]
            if fits:
                r = min(fits, key=lambda r: free[r])
                free[r] -= lengths[i]
            else:
                free.append(40 - lengths[i])
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(40 - sum(lengths[i] for i in r) for r in rows) == sorted(free)


def test_packing_places_every_piece_once(documents, odd, none):
    tokenizer = __import__("tokenizers").Tokenizer.from_file(queries.word_vocabulary())
    for df in (documents, odd):
        got = best_fit.pack(df, queries.word_vocabulary(), seq_len=512).collect()
        want = Counter()
        for r in df.collect():
            ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
            want.update((r.doc_id, k // 512, k, tuple(ids[k : k + 512])) for k in range(0, len(ids), 512))
        assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
        rows = defaultdict(list)
        for r in got:
            rows[r.sequence_id].append((r.offset, r.length))
        for segments in rows.values():
            end = 0
            for offset, n in sorted(segments):
                assert offset == end
                end += n
            assert end <= 512
        assert len(rows) <= 1.02 * sum(r.length for r in got) / 512 + 1
    assert best_fit.pack(none, queries.word_vocabulary()).count() == 0


def test_sweeps_place_each_rank_once():
    random.seed(4)
    for _ in range(100):
        counts = {random.randint(1, 64): random.randint(1, 50) for _ in range(random.randint(1, 20))}
        ranks, used = defaultdict(list), defaultdict(list)
        for length, low, high, first, offset in best_fit.sweep(counts, 64):
            ranks[length] += range(low, high)
            for s in range(first, first + high - low):
                used[s].append((offset, length))
        assert all(sorted(ranks[k]) == list(range(n)) for k, n in counts.items())
        for segments in used.values():
            end = 0
            for offset, n in sorted(segments):
                assert offset == end and end + n <= 64
                end += n
        assert sorted(used) == list(range(len(used)))


def test_toxic_held_out(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    got = queries.QUERIES["op5_toxic_segments"](spark, big).toPandas().merge(spark.read.parquet(f"{big}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]).all()
    hits = held[held.predicted == 1]
    assert (hits.toxic == 1).mean() > 0.75 and held[held.toxic == 1].predicted.mean() > 0.5 and held[held.toxic == 0].predicted.mean() < 0.05


def test_maximal_segments_equal_the_recursive_definition():
    def brute(s, low, high):
        best, where = 0.0, None
        for a in range(low, high):
            for b in range(a + 1, high + 1):
                if sum(s[a:b]) > best + 1e-9:
                    best, where = sum(s[a:b]), (a, b)
        return [] if where is None else brute(s, low, where[0]) + [where] + brute(s, where[1], high)

    random.seed(6)
    for _ in range(300):
        s = [random.choice([-1.25, -2.5, 0.7, 1.3, 2.1, 3.9]) + random.random() / 100 for _ in range(random.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxic_segments.segments(np.array(s))] == brute(s, 0, len(s))


def test_scores_equal_the_definition_and_lengths_are_comparable(spark):
    def maximal(s, low, high):
        best, where = 0.0, None
        for a in range(low, high):
            for b in range(a + 1, high + 1):
                if sum(s[a:b]) > best + 1e-9:
                    best, where = sum(s[a:b]), (a, b)
        return [] if where is None else maximal(s, low, where[0]) + [best] + maximal(s, where[1], high)

    random.seed(8)
    plain, bad = [f"w{i}" for i in range(300)], ["vile", "rotten", "foul"]
    rows = []
    for i in range(700):
        own = random.choices(plain, k=random.choice([3, 20, 400]))
        if i % 7 == 0:
            at = random.randint(0, len(own))
            own[at:at] = random.choices(bad, k=4)
        elif i % 5 == 0:
            own.append(random.choice(bad))
        rows.append((i, " ".join(own), int(i % 7 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(3)
    model = toxic_segments.fit(df.drop("toxic"), df.select("doc_id", "toxic"), learn=F.col("label_id") % 3 != 0)
    got = {r.doc_id: r for r in toxic_segments.scored(df, model).collect()}
    for i, text, _ in rows:
        s = [model.scores.get(w, -model.drift) for w in text.split()]
        if len(s) < 40:
            told = sorted((model.lam * x - math.log(model.k * len(s)) for x in maximal(s, 0, len(s))), reverse=True) or [-math.log(model.k * len(s))]
            sums = [sum(told[: r + 1]) for r in range(len(told))]
            x = [1.0, max(-10.0, min(60.0, told[0])), max(-10.0, min(200.0, max(sums))), math.log(len(s))]
            assert abs(got[i].score - 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(x, model.weights))))))) < 1e-9
    for low, high in ((0, 10), (10, 100), (100, 1000)):  # held-out rows of every length
        held = [(got[i].score >= 0.3, toxic) for i, text, toxic in rows if i % 3 == 0 and low <= len(text.split()) < high]
        assert np.mean([p for p, t in held if t]) >= 0.9 and np.mean([p for p, t in held if not t]) <= 0.1


def test_toxic_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (6, 0), (6, 0), (9, 1)], "doc_id bigint, toxic int")
    model = toxic_segments.fit(odd, labels)
    got = toxic_segments.scored(odd, model).collect()
    assert len(got) == 15 and all(0 <= r.score <= 1 for r in got)
    assert toxic_segments.scored(none, model).count() == 0 and toxic_segments.without_toxic(odd, model).columns == odd.columns
    nothing = toxic_segments.fit(odd, labels.filter("false"))
    assert {r.score for r in toxic_segments.scored(odd, nothing).collect()} == {0.0}


def test_base_scores_and_code_length(documents, odd, none):
    for df in (documents, odd):
        learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
        got = context_tree.scored(df, learn).collect()
        low = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
        rows = [(r.doc_id, [*re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().translate(low)), b"\n"]) for r in df.collect()]
        c = Counter(t for i, ts in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for t in ts)
        n, v = sum(c.values()), len(c)
        want = sorted((i or 0, len(ts), sum(t in c for t in ts), round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 4)) for i, ts in rows)
        assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
        assert all(r.train_tokens == n and r.score < 0 for r in got)
        sent = context_tree.scored(df, learn, most_sent=3).collect()
        assert sorted(round(r.score, 6) for r in sent) == sorted(round(r.score, 6) for r in got)
    assert context_tree.scored(none, F.lit(True)).count() == 0


def test_tree_equals_a_recursive_tree():
    """Every decision of a small text against a direct recursion over contexts."""
    data = b"abracadabra abra cadabra\n" * 3
    codes, n = np.unique(context_tree.runs(data), return_counts=True)
    counts = defaultdict(lambda: [0, 0])
    padded = b"\n" * context_tree.DEPTH + data
    for at in range(context_tree.DEPTH, len(padded)):
        for k in range(8):
            decision, bit = (1 << k) | (padded[at] >> (8 - k)), (padded[at] >> (7 - k)) & 1
            for depth in range(context_tree.DEPTH + 1):
                counts[padded[at - depth : at], decision][bit] += 1
    children = defaultdict(set)
    for context, decision in counts:
        if context:
            children[context[1:], decision].add((context, decision))

    def kt(c):
        p = 0.0
        for bit in (0, 1):
            for i in range(c[bit]):
                p += math.log(i + 0.5)
        return p - math.lgamma(sum(c) + 1)

    def weight(node):
        own = kt(counts[node])
        if len(node[0]) == context_tree.DEPTH:
            return own
        return math.log(0.5) + np.logaddexp(own, sum(map(weight, children[node])))

    def predict(context, decision, bit, depth):
        node = (context[len(context) - depth :], decision)
        c = counts[node]
        own = (c[bit] + 0.5) / (sum(c) + 1)
        if depth == context_tree.DEPTH or (context[len(context) - depth - 1 :], decision) not in counts:
            return own
        stop = math.exp(kt(c) - np.logaddexp(kt(c), sum(map(weight, children[node]))))
        return stop * own + (1 - stop) * predict(context, decision, bit, depth + 1)

    rows = []
    sums = defaultdict(lambda: np.zeros(3))
    for tail in np.unique((codes >> 8) & 65535):
        mine = ((codes >> 8) & 65535) == tail
        tables, weights = context_tree.subtree(codes[mine], n[mine])
        for name, n0, n1, w in zip(tables[0][0], tables[0][1], tables[0][2], weights):
            sums[int(name >> 8) & 255, int(name) & 255] += (n0, n1, w)
    rows = [{"context": c, "decision": d, "n0": x[0], "n1": x[1], "weight": x[2]} for (c, d), x in sums.items()]
    top = context_tree.top_of(rows)
    for text in (b"abra cadabra\n", b"zebra abrab\n"):
        got = 0.0
        for code in context_tree.runs(text):
            mine = ((codes >> 8) & 65535) == ((code >> 8) & 65535)
            all_codes, at = np.unique(np.append(codes[mine], code), return_inverse=True)
            m = np.bincount(at, np.append(n[mine], 0))
            got += context_tree.log10_of_runs(all_codes, m, top)[np.searchsorted(all_codes, code)]
        seen, want = b"\n" * context_tree.DEPTH + text, 0.0
        for at in range(context_tree.DEPTH, len(seen)):
            for k in range(8):
                want += math.log10(predict(seen[at - context_tree.DEPTH : at], (1 << k) | (seen[at] >> (8 - k)), (seen[at] >> (7 - k)) & 1, 0))
        assert got == pytest.approx(want, abs=1e-6)


def test_base_phrases(documents, odd, none, spark):
    own = spark.createDataFrame(
        [(90, "CC BY cc-by, cc by"), (91, "The GENERAL public\nLicense general public license"), (92, "all rights reserved."), (93, "ccby cc byx All Rights  Reserved")],
        "doc_id bigint, text string",
    )
    for df in (documents, odd, own):
        want = []
        for r in df.collect():
            low = "".join(c.lower() if c in string.ascii_uppercase else c for c in r.text or "")
            words, places, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low), [], set()
            for phrase, label in license_scan.BASE:
                p = phrase.split()
                found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
                places += found
                labels |= {label} if found else set()
            want.append((r.doc_id or 0, len(words), len(places), min(places, default=-1), max(places, default=-1), sorted(labels)))
        got = license_scan.scan(df).collect()
        none_is = lambda x: -1 if x is None else x
        assert sorted((r.doc_id or 0, r.n_words, sum(r.places), none_is(r.first_word), none_is(r.last_word), r.base_labels) for r in got) == sorted(want)
        assert all(set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 for r in got)
    assert license_scan.scan(none).count() == 0


def test_rules_and_suppression(spark):
    assert len(rules()) > 300 and all(re.compile(r[5]) for r in rules())
    text = "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: MIT and BSD license, see the Eclipse Public License v 2.0"
    df = spark.createDataFrame([(1, text), (2, "no terms here"), (3, text * 50)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert {"apache-2.0", "mit", "bsd"} <= set(got[1].labels) and got[2].labels == [] and got[2].score == 0 and got[1].score > 0.9
    assert set(got[3].labels) == set(got[1].labels)
    low = text.lower()
    found = [(m.start(), m.end(), p, no) for no, p, gate, key, _, pattern in rules() if gate in low and key in low for m in re.finditer(pattern, low)]
    better = lambda a, b: b[2] <= a[2] and (b[0], -b[1], b[2], b[3]) < (a[0], -a[1], a[2], a[3]) and b[0] <= a[0] and b[1] >= a[1]
    want = sorted(a for a in found if not any(better(a, b) for b in found))
    assert sorted((d.start, d.end, d.priority, d.number) for d in got[1].detections) == want


def test_wrapped_and_commented_licence_headers(spark):
    texts = [
        ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided"),
        ("bsd", " * Redistribution and use in source\n * and binary forms, with or without\n *\n * modification,  are permitted"),
        ("gpl", "# you can redistribute it and/or modify\n# it under the terms of the GNU General\n# Public License as published"),
        ("lgpl", "// you can redistribute it and/or modify\r\n// it under the terms of the GNU Lesser General Public\r\n// License"),
        ("isc", ";; Permission to use, copy, modify, and distribute this software for any\n;; purpose with or without fee is hereby\n;; granted, provided"),
        ("bsd-3-clause", "Neither the name of the owner nor the\nnames of its contributors may be used to endorse\nor promote products"),
        ("apache-2.0", "-- Licensed under the Apache\n-- License, Version 2.0"),
        ("public-domain", "This file is in the public\n   domain."),
    ]
    got = license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id int, text string")).collect()
    by_number = {r[0]: r for r in rules()}
    for r in got:
        label, text = texts[r.doc_id]
        assert label in r.labels, (label, text)
        for d in r.detections:  # offsets are those of the text itself
            assert re.fullmatch(by_number[d.number][5], text.lower()[d.start : d.end])


def cheapest(roles):
    heap, seen = [(0, 0, 0)], set()
    while heap:
        cost, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(roles) and state == 3:
            return cost
        for b in chat_repair.NEXT[state]:
            if b != 1:
                heapq.heappush(heap, (cost + 2, i, b))
        if i < len(roles):
            for b in (1, 2, 3):
                k = cost + 3 * (roles[i] != b)
                if b in chat_repair.NEXT[state]:
                    heapq.heappush(heap, (k, i + 1, b))
                if b == state:
                    heapq.heappush(heap, (k + 1, i + 1, b))


def test_repairs_are_legal_and_cheapest(spark):
    random.seed(8)
    names = ["other", "system", "user", "assistant"]
    rows, convs = [], {}
    for c in range(60):
        convs[c] = [random.randrange(4) for _ in range(random.randint(1, 9) if c else 400)]  # conversation 0 spans all tasks
        rows += [(c, t, names[r], f"text {c} {t}", "x") for t, r in enumerate(convs[c])]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, place string")
    got = defaultdict(list)
    for r in chat_repair.repair(df).collect():
        got[r.conv_id].append(r)
    legal = re.compile(r"(<\|system\|>\n[^<]*<\|end\|>\n)?(<\|user\|>\n[^<]*<\|end\|>\n<\|assistant\|>\n[^<]*<\|end\|>\n)+")
    for c, roles in convs.items():
        turns = sorted(got[c], key=lambda r: r.place)
        assert [r.turn for r in turns] == list(range(len(roles)))
        assert sum(r.cost for r in turns) == cheapest(roles)
        text = "".join(r.rendered for r in turns)
        assert legal.fullmatch(text) and re.findall(r"text \d+ \d+", text) == [f"text {c} {t}" for t in range(len(roles))]


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a"), (1, 0, "USER ", "b"), (1, 0, "USER ", "b"), (1, None, "gpt", None), (2, 0, "assistant", "c" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat_repair.repair(df).collect()
    assert len(got) == 6 and all(r.rendered for r in got)
    assert chat_repair.repair(df.filter("false")).count() == 0


def test_pipeline_stages(spark, sf, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == documents.columns
        docs = after.cache()
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:])) and len(kept[1]) == docs.sparkSession.createDataFrame([(t,) for t in {r.text for r in documents.collect() if r.doc_id in kept[0]}], "t string").count()
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept[-1]


def test_pipeline_stages_with_odd_rows(spark, sf, odd, none):
    """Nulls, repeated rows, long and empty texts, clashing columns and no rows go through all stages."""
    sizes = []
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd.columns
        docs = spark.createDataFrame(docs.collect(), odd.schema)
        sizes.append(docs.count())
    # equal texts: four of PROSE, three empty ones, two of x; near copies: the changed PROSE, LONG with a tail, and blanks as good as empty
    assert sizes == [15, 9, 6, 6]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == 6
    empty = none
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, sf)
        assert empty.columns == odd.columns and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0
