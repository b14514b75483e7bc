"""Operator 9, benchmark decontamination: size-partitioned MinHash containment search.

*Size partitions.*  Items are partitioned by how many five-word runs they have, in
steps of the square root of two.  Within a partition with at most u runs, a text is
cut into windows of 2 u runs that start every u runs, so a passage as long as an
item lies in one window whole; a shorter text is one window.  With windows of a size
near the items', containment 0.8 becomes a Jaccard similarity of about 0.25 or
more, however long the document is.

*MinHash.*  ``hashes`` minima per window (minima of blocks of u runs, joined two
by two) are compared with the items' minima; one equal minimum makes a candidate.
Two sets of similarity 0.26, the least here, share none of 32 minima with probability 6e-5.
Equal minima need a run in common, so a document without any run of any item is
passed over first.

*Verification.*  The share of the item's different runs that the whole document has, exactly.

*Items of one to four words* have no run of five.  They are looked for as they are, among the
document's runs of just as many words, which are made only if there are such items.

Items are taken in blocks of about ``block_bytes`` of text by hash, one at a time on the driver; a block's
signatures, a few hundred bytes an item, are sent to all tasks, and the documents are read once per
block.  Documents never move.

Words are white-space separated and lower-cased.  Null and empty texts have no words and never
match.  Repeated rows give repeated results; an item or a document without an id keeps a null id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import texts
from auditlake.llm.shingles import WORDS, WordHashes, mix, shingles

HASHES = 32
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def _bound(runs: int) -> int:
    """The largest number of runs in the size partition of ``runs``."""
    step = int(np.ceil(2 * np.log2(max(runs, 1)) - 1e-9))
    return max(1, int(2 ** (step / 2) + 1e-9))


def _values(runs: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = (runs ^ seed) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * seed


class Items:
    """Signatures and runs of one block of items, by size partition."""

    def __init__(self, rows: list[tuple[object, str]]):
        hashes = WordHashes()
        words = [hashes.of(text.lower().split()) for _, text in rows]
        runs = [np.unique(shingles(w)) if len(w) >= WORDS else np.zeros(0, np.uint64) for w in words]
        self.ids = [i for i, _ in rows]
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # number of words -> run -> items
        for i, w in enumerate(words):
            if 0 < len(w) < WORDS:
                self.short[len(w)][int(shingles(w, len(w))[0])].append(i)
        self.short = {n: dict(of) for n, of in self.short.items()}
        self.runs = runs
        self.all_runs = np.unique(np.concatenate([*runs, np.zeros(0, np.uint64)]))
        self.gate_bits = np.uint64((1 << 24) - 1)
        self.gate = np.zeros(1 << 24, bool)
        for r in runs:
            self.gate[(r & self.gate_bits).astype(np.int64)] = True
        self.partitions: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by_size: dict[int, list[int]] = defaultdict(list)
        for i, r in enumerate(runs):
            if len(r):
                by_size[_bound(len(r))].append(i)
        for bound, members in by_size.items():
            signatures = np.array([[_values(runs[i], s).min() for s in _SEEDS] for i in members], dtype=np.uint64)
            tables = []
            for h in range(HASHES):
                order = np.argsort(signatures[:, h], kind="stable")
                tables.append((signatures[order, h], np.array(members, np.int64)[order]))
            self.partitions[bound] = tables

    def found_in(self, words: np.ndarray, least: float) -> list[tuple[int, float]]:
        """(item, share of its runs) for short items in the text and for candidates of the MinHash search that reach ``least``."""
        short = [(i, 1.0) for n, of in self.short.items() if n <= len(words) for run in np.unique(shingles(words, n)).tolist() if run in of for i in of[run]]
        return sorted(short) + self._long_in(shingles(words), least) if len(words) >= WORDS else sorted(short)

    def _long_in(self, text_runs: np.ndarray, least: float) -> list[tuple[int, float]]:
        candidates: set[int] = set()
        n = len(text_runs)
        likely = text_runs[self.gate[(text_runs & self.gate_bits).astype(np.int64)]]
        if not len(likely) or not np.isin(likely, self.all_runs).any():
            return []
        for bound, tables in self.partitions.items():
            starts = np.arange(0, n, bound)
            for (known, members), seed in zip(tables, _SEEDS):
                blocks = np.minimum.reduceat(_values(text_runs, seed), starts)
                windows = np.minimum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
                low = np.searchsorted(known, windows, "left")
                high = np.searchsorted(known, windows, "right")
                for at in np.flatnonzero(high > low):
                    candidates.update(members[low[at] : high[at]].tolist())
        if not candidates:
            return []
        own = np.unique(text_runs)
        shares = [(i, float(np.isin(self.runs[i], own, assume_unique=True).mean())) for i in sorted(candidates)]
        return [(i, s) for i, s in shares if s >= least]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of about ``block_bytes``, one block at a time on the driver."""
    items = texts(benchmark, item_id, item_text)
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    for p in range(parts if total else 0):
        yield [(r["doc_id"], r["text"]) for r in items.filter(part == p).toLocalIterator()]


def contained(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.8, block_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Pairs doc_id, item_id, containment."""
    keyed = texts(docs, id_col, text_col)
    id_type, item_type = keyed.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    kind = f"doc_id {id_type}, item_id {item_type}, containment double"
    out = keyed.sparkSession.createDataFrame([], kind)
    for rows in _blocks(benchmark, item_id, item_text, block_bytes):
        sent = keyed.sparkSession.sparkContext.broadcast(Items(rows))
        arrow_id = pa.int64() if item_type == "bigint" else None

        def run(batches: Iterator[pa.RecordBatch], sent=sent, arrow_id=arrow_id) -> Iterator[pa.RecordBatch]:
            items, hashes = sent.value, WordHashes()
            for batch in batches:
                doc, item, share = [], [], []
                for i, text in enumerate(batch.column("text")):
                    for k, s in items.found_in(hashes.of(text.as_py().lower().split()), least):
                        doc.append(i)
                        item.append(items.ids[k])
                        share.append(s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(item, arrow_id), pa.array(share, pa.float64())],
                    ["doc_id", "item_id", "containment"],
                )

        out = out.unionByName(keyed.mapInArrow(run, kind))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, block_bytes: int = 16 << 20, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of the rows that hold no item."""
    texts(docs, text_col, text_col)  # workers find this package
    for rows in _blocks(benchmark, item_id, item_text, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Items(rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, hashes = sent.value, WordHashes()
            for batch in batches:
                clean = [not items.found_in(hashes.of((t.as_py() or "").lower().split()), least) for t in batch.column(text_col)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
