"""Operator 13, ranked lexical search by range-maximum tables and best-first intervals.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.  An item's
score for a document sums, over the item's terms with repeats, the term's *impact* in it:
``w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` with ``m = 100 - 75 + (75 * n * N) div L`` and
``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``; N, L and df count all documents.

1. *Index.*  Each task writes blocks of documents: for every term of the items its posting list
   (documents in id order, occurrences).  A block holds at most ``block_postings`` entries
   (plus one document), N, L and df are sums over the blocks.
2. *Range maxima.*  A sparse table per posting list, all lists of a block in one array, gives the
   largest impact between any two documents and where it is in two look-ups.
3. *Best-first search.*  An interval of documents is bounded by the sum of its terms' range
   maxima.  The intervals with the largest bounds go first: the document of the largest impact
   is scored, and the parts left and right of it become intervals.  An interval ends when
   its bound is below the ``top``-th best score, or equal to it with larger ids only.
4. *Two rounds.*  The first takes ``SEED_ROUNDS`` steps in each block; the ``top``-th best of all
   scores it has seen is a true lower bound.  The second round starts from that bound and runs to the end, so
   blocks without a good document stop at once.  Then at most ``top`` rows of each block and item are ranked.

Items come to the driver in blocks of about ``item_bytes`` of text, one block at a time, each of
which reads the documents once; documents are never moved or collected.

Null and empty texts have no term: such a document is not counted, such an item has no rows.  A repeated
document row is a document of its own, so is a row without an id (ranked before equal scores, as
nulls sort first); a repeated item row is searched and ranked by itself.  Equal scores
go by id, then by chance among repeated ids.  Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import HandOver, texts

#: Intervals split in one step, and steps of the first round.
STEP = 32
SEED_ROUNDS = 6

_TERM_BYTES = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))
_FOLD = _TERM_BYTES.lower()


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Items:
    """A block of items: their vocabulary, and for each item its terms' numbers and repeats."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.wanted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for number, text in rows:
            counted = Counter(terms(text))
            if counted:
                own = [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in counted]
                self.wanted[number] = np.array(own), np.array([*counted.values()])


class Block:
    """Posting lists with impacts and their sparse table; ``search`` is the best-first search of one item."""

    def __init__(self, n: np.ndarray, df: np.ndarray, docs: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.size, term = max(1, len(n)), np.repeat(np.arange(len(df)), df)
        m = 25 + (75 * n * n_docs) // max(1, n_terms)
        self.starts = np.concatenate([[0], np.cumsum(df)])
        self.keys = term * self.size + docs
        self.impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
        best, span, longest = [np.arange(len(docs), dtype=np.int32)], 1, int(df.max(initial=1))
        while 2 * span <= longest:
            left, right = best[-1][:-span], best[-1][span:]
            best.append(np.concatenate([np.where(self.impact[right] > self.impact[left], right, left), best[-1][-span:]]))
            span *= 2
        self.best, self.level = np.stack(best), np.frexp(np.arange(longest + 1))[1] - 1

    def largest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the largest impact of entries low..high-1 is, and its value; 0 in empty ranges."""
        some = high > low
        k = self.level[np.where(some, high - low, 1)]
        x = self.best[k, np.where(some, low, 0)]
        y = self.best[k, np.where(some, high - (1 << k), 0)]
        at = np.where(self.impact[y] > self.impact[x], y, x)
        return at, np.where(some, self.impact[at], 0)

    def search(self, own: np.ndarray, repeats: np.ndarray, top: int, floor: int, rounds: int | None = None) -> list[tuple[int, int]]:
        """(score, document) of the ``top`` best with a score of ``floor`` or more, best first."""
        there = self.starts[own + 1] > self.starts[own]
        own, repeats = own[there], repeats[there]
        if not len(own):
            return []
        base, best = own * self.size, []

        def opened(low, high, first, last) -> tuple:
            at, value = self.largest(low, high)
            value = value * repeats
            split = self.keys[at[np.arange(len(at)), value.argmax(1)]] % self.size
            return low, high, first, last, split, value.sum(1)

        def alive(front: tuple) -> tuple:
            least, last_doc = (best[-1] if len(best) == top else (0, -1))
            bound = front[5]
            keep = (bound >= max(floor, 1)) & ((bound > least) | ((bound == least) & (front[2] < last_doc)))
            return tuple(x[keep] for x in front)

        front = alive(opened(self.starts[own][None], self.starts[own + 1][None], np.array([0]), np.array([self.size])))
        while len(front[5]) and rounds != 0:
            rounds = None if rounds is None else rounds - 1
            order = np.lexsort((front[2], -front[5]))
            low, high, first, last, split, _ = (x[order[:STEP]] for x in front)
            rest = tuple(x[order[STEP:]] for x in front)
            wanted = base + split[:, None]
            at = np.searchsorted(self.keys, wanted.ravel()).reshape(wanted.shape)
            here = (at < high) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)
            score = (np.where(here, self.impact[np.minimum(at, len(self.keys) - 1)], 0) * repeats).sum(1)
            best = sorted([*best, *((s, d) for s, d in zip(score.tolist(), split.tolist()) if s >= floor)], key=lambda x: (-x[0], x[1]))[:top]
            parts = opened(np.concatenate([low, at + here]), np.concatenate([at, high]), np.concatenate([first, split + 1]), np.concatenate([split, last]))
            front = alive(tuple(np.concatenate([x, y]) for x, y in zip(rest, parts)))
        return best


def _index(keyed: DataFrame, items: Items, block_postings: int) -> DataFrame:
    """Blocks: n_docs, n_terms, df (a number per term of the items), ids, n, docs, tf (packed, lists one after the other)."""
    id_type, vocabulary = keyed.schema["doc_id"].dataType.simpleString(), keyed.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = vocabulary.value, None
        get, size = known.get, len(known)
        n_docs = n_terms = held = 0
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal rows, held, n_docs, n_terms
            rows.sort(key=lambda r: (False, 0) if r[0] is None else (True, r[0]))
            of = np.array([t for r in rows for t in r[2]], np.int64)
            docs = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) for r in rows])
            tf = np.array([c for r in rows for c in r[2].values()], np.int32)
            order = np.argsort(of, kind="stable")
            df = np.bincount(of, minlength=size).astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), pa.array([df], pa.list_(pa.int32())), pa.array([[r[0] for r in rows]], pa.list_(kind)),
                 pa.array([np.array([r[1] for r in rows], np.int64).tobytes()], pa.binary()), pa.array([docs[order].tobytes()], pa.binary()), pa.array([tf[order].tobytes()], pa.binary())],
                ["n_docs", "n_terms", "df", "ids", "n", "docs", "tf"],
            )
            n_docs = n_terms = held = 0
            rows = []
            return out

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                words = terms(text.as_py())
                if words:
                    n_docs, n_terms = n_docs + 1, n_terms + len(words)
                    found = Counter(t for t in map(get, words) if t is not None)
                    if found:
                        rows.append((doc.as_py(), len(words), found))
                        held += len(found)
                        if held >= block_postings:
                            yield flush()
        if n_docs:
            yield flush()

    return keyed.mapInArrow(run, f"n_docs bigint, n_terms bigint, df array<int>, ids array<{id_type}>, n binary, docs binary, tf binary")


def _found(index: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, top: int, floors: dict[int, int], rounds: int | None) -> DataFrame:
    """number, doc_id, score: the best of each block."""
    sent = index.sparkSession.sparkContext.broadcast((items.wanted, weights, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, floors = sent.value
        for batch in batches:
            for at in range(batch.num_rows):
                df = batch.column("df")[at].values.to_numpy().astype(np.int64)
                n, docs, tf = (np.frombuffer(batch.column(c)[at].as_buffer(), k).astype(np.int64) for c, k in (("n", np.int64), ("docs", np.int32), ("tf", np.int32)))
                if not len(n):
                    continue
                block = Block(n, df, docs, tf, weights, n_docs, n_terms)
                got = [(number, d, s) for number, own in wanted.items() for s, d in block.search(*own, top, floors.get(number, 0), rounds)]
                number, doc, score = zip(*got) if got else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number, pa.int64()), batch.column("ids")[at].values.take(pa.array(doc, pa.int64())), pa.array(score, pa.int64())], ["number", "doc_id", "score"]
                )

    return index.select("df", "ids", "n", "docs", "tf").mapInArrow(run, f"number bigint, doc_id {index.schema['ids'].dataType.elementType.simpleString()}, score bigint")


def _item_blocks(numbered: DataFrame, item_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Blocks of (number, text), one at a time on the driver; together they are all rows."""
    total = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // item_bytes))
    for p in range(parts):
        yield [(r["number"], r["text"]) for r in numbered.filter(F.pmod(F.xxhash64("number"), F.lit(parts)) == p).select("number", "text").toLocalIterator()]


def search(
    docs: DataFrame, items: DataFrame, top: int = 10, block_postings: int = 1_000_000, item_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each item, best first."""
    keyed = texts(docs, id_col, text_col)
    over = HandOver(keyed.sparkSession)
    numbered = over.settle(
        items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("number")), "items"
    )
    best = Window.partitionBy("number").orderBy(F.desc("score"))
    found: DataFrame | None = None
    for k, rows in enumerate(_item_blocks(numbered, item_bytes)):
        block = Items(rows)
        if not block.wanted:
            continue
        index = over.settle(_index(keyed, block, block_postings), f"index-{k}")
        n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        df = np.zeros(len(block.vocabulary), np.int64)
        for r in index.select(F.posexplode("df").alias("term", "df")).filter("df > 0").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
            df[r["term"]] = r["df"]  # a number per term of the block of items
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        seen = _found(index, block, weights, n_docs, n_terms, top, {}, SEED_ROUNDS)
        floors = seen.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == top)
        floors = {r["number"]: r["score"] for r in floors.select("number", "score").toLocalIterator()}
        part = over.settle(_found(index, block, weights, n_docs, n_terms, top, floors, None), f"found-{k}")
        over.drop(f"index-{k}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = keyed.filter("false").select(F.lit(0).cast("long").alias("number"), "doc_id", F.lit(0).cast("long").alias("score"))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc("doc_id")))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(numbered.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
