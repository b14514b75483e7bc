"""Operator 7, language-model scoring by context-tree weighting over bytes.

A text is its words (lower-cased A-Z, split at ASCII white space) joined by one
space and closed by a line feed.  Each byte is eight binary decisions; every decision has
a tree over the ``DEPTH`` bytes before it.  A node holds how often 0 and 1 followed its
context in the training texts, its Krichevsky-Trofimov estimate, and the weighted
probability 1/2 KT + 1/2 (product of its children's), so all depths are mixed by
how well they would have coded the training texts.  A text's probability comes
from the trained tree: along the contexts of each decision the estimates are mixed with
the nodes' posterior weights, and the deepest context that was seen counts as a leaf.

The tree grows with the corpus and is built in parts: the corpus is counted as runs of
``DEPTH`` + 1 bytes (combined per chunk), and all runs whose last two context bytes are equal
make one subtree.  Only depths 0 and 1, at most 65,280 nodes, meet on the driver.  The same
subtrees give each different run of the corpus its log-probability.

Texts are read in chunks of ``CHUNK`` bytes.  The words' counts come back to a chunk by a join
on (chunk, word); so do the runs' log-probabilities when there are more than ``most_sent``
of them, else that table, of checked size, is sent to all tasks.

The unigram base is log10((c + 1) / (N + V + 1)) per token, one end token per text included.

Null and empty texts hold the end token alone.  Without training texts every decision has
probability 1/2.  Rows are scored one by one, repeated or not; ids are never read.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import HandOver, texts

DEPTH, CHUNK, PART, LOOKUP = 5, 32 << 20, 1 << 20, 1 << 18
END = b"\n"
_LOW = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def runs(data: bytes) -> np.ndarray:
    """One code per byte of ``data``: the ``DEPTH`` bytes before it and itself; texts start after line feeds."""
    b = np.frombuffer(END * DEPTH + data, np.uint8).astype(np.int64)
    out = np.zeros(len(data), np.int64)
    for k in range(DEPTH + 1):
        out = (out << 8) | b[k : k + len(data)]
    return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    low = np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - math.log(math.pi) - _lgamma(n0 + n1 + 1)


def _nodes(codes: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (context of ``depth`` bytes and decision, as one number) with their zeros and ones."""
    own = codes & ((1 << (8 * (depth + 1))) - 1)
    context, byte = own >> 8, own & 255
    keys = np.concatenate([(context << 8) | (1 << k) | (byte >> (8 - k)) for k in range(8)])
    ones = np.concatenate([(byte >> (7 - k)) & 1 for k in range(8)])
    names, at = np.unique(keys, return_inverse=True)
    times = np.tile(n.astype(np.float64), 8)
    n1 = np.bincount(at, times * ones, len(names))
    return names, np.bincount(at, times, len(names)) - n1, n1


def subtree(codes: np.ndarray, n: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Nodes of depths 2 to ``DEPTH`` below one pair of context bytes, each with stopping weight, and the log weights at depth 2."""
    tables, weights, below = [], np.zeros(0), None
    for depth in range(DEPTH, 1, -1):
        names, n0, n1 = _nodes(codes, n, depth)
        own = log_kt(n0, n1)
        if below is None:
            stop, weights = np.ones(len(names)), own
        else:
            parent = (((below >> 8) & ((1 << (8 * depth)) - 1)) << 8) | (below & 255)
            children = np.bincount(np.searchsorted(names, parent), weights, len(names))
            both = np.logaddexp(own, children)
            stop, weights = np.exp(own - both), math.log(0.5) + both
        below = names
        tables.append((names, n0, n1, stop))
    return tables[::-1], weights


def top_of(rows: list) -> dict[str, np.ndarray]:
    """Depths 0 and 1 from sums over the depth-2 nodes (context byte, decision): zeros, ones and stopping weights."""
    n0, n1, below = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        n0[r["context"], r["decision"]], n1[r["context"], r["decision"]], below[r["context"], r["decision"]] = r["n0"], r["n1"], r["weight"]
    own = log_kt(n0, n1)
    both = np.logaddexp(own, below)
    weight = np.where(n0 + n1 > 0, math.log(0.5) + both, 0.0).sum(0)
    own0 = log_kt(n0.sum(0), n1.sum(0))
    return {"n0": n0, "n1": n1, "stop": np.exp(own - both), "root0": n0.sum(0), "root1": n1.sum(0), "root_stop": np.exp(own0 - np.logaddexp(own0, weight))}


def log10_of_runs(codes: np.ndarray, n: np.ndarray, top: dict[str, np.ndarray]) -> np.ndarray:
    """log10 probability of the last byte of each run, all of one subtree; ``n`` are the training counts."""
    known = n > 0
    tables = subtree(codes[known], n[known])[0] if known.any() else []
    byte, last = codes & 255, (codes >> 8) & 255
    total = np.zeros(len(codes))
    for k in range(8):
        decision, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
        mix, deeper = np.full(len(codes), 0.5), np.zeros(len(codes), bool)
        levels = []
        for depth, (names, n0, n1, stop) in enumerate(tables, 2):
            key = (((codes >> 8) & ((1 << (8 * depth)) - 1)) << 8) | decision
            at = np.minimum(np.searchsorted(names, key), len(names) - 1)
            levels.append((names[at] == key, n0[at], n1[at], stop[at]))
        one0, one1 = top["n0"][last, decision], top["n1"][last, decision]
        levels.insert(0, (one0 + one1 > 0, one0, one1, top["stop"][last, decision]))
        zero0, zero1 = top["root0"][decision], top["root1"][decision]
        levels.insert(0, (zero0 + zero1 > 0, zero0, zero1, top["root_stop"][decision]))
        for hit, n0, n1, stop in reversed(levels):
            own = (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1)
            mix = np.where(hit, np.where(deeper, stop * own + (1 - stop) * mix, own), mix)
            deeper = deeper | hit
        total += np.log10(mix)
    return total


class Prices:
    """run -> log10 in open addressing, so that a lookup touches one or two places whatever the table's size."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        bits = max(8, int(math.ceil(math.log2(max(1, len(codes)) * 1.5))))
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.codes, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        left, slots = np.arange(len(codes)), self._slots(codes)
        while len(left):
            free = self.codes[slots[left]] == -1
            self.codes[slots[left[free]]] = codes[left[free]]  # of several for one slot the last stays
            settled = self.codes[slots[left]] == codes[left]
            self.values[slots[left[settled]]] = values[left[settled]]
            left = left[~settled]
            slots[left] = (slots[left] + 1) & self.last

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """All runs of the corpus have a price, so every search ends."""
        slots = self._slots(codes)
        miss = np.flatnonzero(self.codes[slots] != codes)
        while len(miss):
            slots[miss] = (slots[miss] + 1) & self.last
            miss = miss[self.codes[slots[miss]] != codes[miss]]
        return self.values[slots]


def _totals(texts_of: pa.ChunkedArray, prices: Prices) -> np.ndarray:
    """Sum of the runs' prices per text, looked up for many texts, or part of one, at a time."""
    out, waiting, size = np.zeros(len(texts_of)), [], 0

    def settle() -> None:
        codes = [c for _, c in waiting]
        starts = np.cumsum([0] + [len(c) for c in codes[:-1]])
        np.add.at(out, [i for i, _ in waiting], np.add.reduceat(prices.of(np.concatenate(codes)), starts))

    for i, value in enumerate(texts_of):
        data = value.as_buffer().to_pybytes()
        for at in range(0, len(data), LOOKUP):  # contexts of a later part are the bytes before it
            waiting.append((i, runs(data[max(0, at - DEPTH) : at + LOOKUP])[min(at, DEPTH) :]))
            size += len(waiting[-1][1])
            if size >= LOOKUP:
                settle()
                waiting, size = [], 0
    if waiting:
        settle()
    return out


def _chunked(docs: DataFrame) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, read = TaskContext.get().partitionId() << 30, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                chunks, data = [], []
                for text in part.column("text"):
                    own = b" ".join(text.as_buffer().to_pybytes().translate(_LOW).split()) + END
                    chunks.append(first + read // CHUNK)
                    data.append(own)
                    read += len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunks, pa.int64()), part.column("doc_id"), part.column("learn"), pa.array(data, pa.binary())], ["chunk", "doc_id", "learn", "data"]
                )

    return docs.mapInArrow(run, f"chunk bigint, doc_id {id_type}, learn boolean, data binary")


def _counted(rows: DataFrame) -> DataFrame:
    """Per chunk, every different run and word with its count in training texts."""

    def flush(chunk: int, words: Counter, parts: list) -> Iterator[pa.RecordBatch]:
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([m for _, m in parts]), len(codes)).astype(np.int64)
        for i in range(0, len(codes), 50_000):
            own = codes[i : i + 50_000]
            none = pa.nulls(len(own), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(own), pa.int64()), pa.array(own), none, pa.array(n[i : i + 50_000])], ["chunk", "run", "word", "n"])
        names, counts = list(words), list(words.values())
        for i in range(0, len(names), 50_000):
            own = names[i : i + 50_000]
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(own), pa.int64()), none, pa.array(own, pa.binary()), pa.array(counts[i : i + 50_000], pa.int64())], ["chunk", "run", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words, parts, waiting = None, Counter(), [], [[], []]
        size = 0

        def count() -> None:
            nonlocal waiting, size
            for learn in (0, 1):
                if waiting[learn]:
                    codes, n = np.unique(np.concatenate(waiting[learn]), return_counts=True)
                    parts.append((codes, n * learn))
            if sum(len(c) for c, _ in parts) > 1_500_000:  # equal runs of the chunk's parts meet now and then
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                parts[:] = [(codes, np.bincount(at, np.concatenate([m for _, m in parts]), len(codes)).astype(np.int64))]
            waiting, size = [[], []], 0

        for batch in batches:
            for chunk, learn, value in zip(batch.column("chunk").to_pylist(), batch.column("learn").to_pylist(), batch.column("data")):
                if chunk != last and last is not None:
                    count()
                    yield from flush(last, words, parts)
                    words, parts = Counter(), []
                last, data = chunk, value.as_buffer().to_pybytes()
                own = data.split()
                if learn:
                    words.update(own)
                    words[END] += 1
                else:
                    words.update(dict.fromkeys([*own, END], 0))
                for at in range(0, len(data), PART):  # contexts of a later part are the bytes before it
                    codes = runs(data[max(0, at - DEPTH) : at + PART])
                    waiting[int(bool(learn))].append(codes[min(at, DEPTH) :])
                size += len(data)
                if size >= PART:
                    count()
        if last is not None:
            count()
            yield from flush(last, words, parts)

    return rows.mapInArrow(run, "chunk bigint, run bigint, word binary, n bigint")


def _subtree_weights(table: pa.Table) -> pa.Table:
    codes, n = table.column("run").to_numpy(), table.column("n").to_numpy()
    tables, weights = subtree(codes, n)
    names, n0, n1, _ = tables[0]
    return pa.table({"context": pa.array((names >> 8) & 255, pa.int32()), "decision": pa.array(names & 255, pa.int32()), "n0": n0, "n1": n1, "weight": weights})


def scored(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", most_sent: int = 4_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score (both log10), bits_per_byte.

    ``learn`` tells the rows of ``docs`` to learn from.
    """
    spark, over = docs.sparkSession, HandOver(docs.sparkSession)
    rows = over.settle(_chunked(texts(docs, id_col, text_col, F.coalesce(learn, F.lit(False)).alias("learn"))), "rows")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    counted = over.settle(_counted(rows), "counted")
    of_words, of_runs = counted.filter("word IS NOT NULL"), counted.filter("run IS NOT NULL")
    words = over.settle(of_words.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"), "words")
    sums = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens, vocabulary = int(sums["n"] or 0), int(sums["v"])
    all_runs = over.settle(of_runs.groupBy("run").agg(F.sum("n").alias("n")).withColumn("tail", F.expr("shiftright(run, 8) & 65535")), "runs")
    weights = all_runs.filter("n > 0").groupBy("tail").applyInArrow(_subtree_weights, "context int, decision int, n0 double, n1 double, weight double")
    top = top_of(weights.groupBy("context", "decision").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "weight")]).collect())  # at most 65,280 rows

    def price(table: pa.Table) -> pa.Table:
        codes, n = table.column("run").to_numpy(), table.column("n").to_numpy()
        return pa.table({"run": codes, "log10": log10_of_runs(codes, n, top)})

    prices = over.settle(all_runs.groupBy("tail").applyInArrow(price, "run bigint, log10 double"), "prices")
    facts = of_words.select("chunk", "word").join(words.hint("merge"), "word").select("chunk", "word", "c", F.lit(None).cast("bigint").alias("run"), F.lit(None).cast("double").alias("log10"))
    sent = None
    if prices.count() <= most_sent:
        table = prices.toArrow()
        sent = spark.sparkContext.broadcast(Prices(table.column("run").to_numpy(), table.column("log10").to_numpy()))
    else:
        facts = facts.unionByName(of_runs.select("chunk", "run").join(prices.hint("merge"), "run").select("chunk", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("bigint").alias("c"), "run", "log10"))
    scale = math.log10(train_tokens + vocabulary + 1)

    def score(docs_of: pa.Table, known: pa.Table) -> pa.Table:
        own = known.filter(pa.compute.is_valid(known.column("word")))
        counts = dict(zip(own.column("word").to_pylist(), own.column("c").to_pylist()))
        if sent is None:
            mine = known.filter(pa.compute.is_valid(known.column("run")))
            codes, at = np.unique(mine.column("run").to_numpy(), return_index=True)
            price_of = Prices(codes, mine.column("log10").to_numpy()[at])
        else:
            price_of = sent.value
        totals = _totals(docs_of.column("data"), price_of)
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_tokens", "n_known", "base_score", "score")}
        for value, total in zip(docs_of.column("data"), totals.tolist()):
            data = value.as_buffer().to_pybytes()
            c = np.array([counts.get(w, 0) for w in data.split()] + [counts.get(END, 0)])
            for k, v in (("n_bytes", len(data)), ("n_tokens", len(c)), ("n_known", int((c > 0).sum())), ("base_score", float(np.log10(c + 1.0).sum() - scale * len(c))), ("score", total)):
                out[k].append(v)
        return pa.table({"doc_id": docs_of.column("doc_id"), "learn": docs_of.column("learn"), **out})

    kind = f"doc_id {id_type}, learn boolean, n_bytes bigint, n_tokens bigint, n_known bigint, base_score double, score double"
    found = rows.select("chunk", "doc_id", "learn", "data").groupBy("chunk").cogroup(facts.groupBy("chunk")).applyInArrow(score, kind)
    return found.withColumn("train_tokens", F.lit(train_tokens).cast("long")).withColumn("bits_per_byte", -F.col("score") * math.log2(10) / F.col("n_bytes"))
