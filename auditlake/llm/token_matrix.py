"""Operator 3, packed token-id matrices by best-fit-decreasing with a segment-tree search.

A document becomes byte-BPE ids and an end id; longer ones are cut into pieces of
``seq_len`` ids, so nothing is lost.  Each task packs its documents in blocks of at
most ``block_ids`` ids: pieces go from the longest down into the open row with the
least capacity that still holds them.  A segment tree over the capacities
1..``seq_len`` knows which of them have open rows; a search descends to the first
one from the wanted length on.  Blocks bound the memory, documents never move, and
at most one row per block is left poorly filled.

A row of the matrix is one output row, binary and padded to ``seq_len``: ``ids``
(little-endian, 16 bits if the vocabulary fits, else 32), ``cu_seqlens`` (0, ends of
segments), and ``position_ids`` (same width, back to 0 at every segment and in the padding).
``doc_ids``, ``pieces`` and ``starts`` name the segments.  Written by any Spark
writer; ``documents_of`` reads the ids back per document.

Null and empty texts are one end id.  Repeated rows are packed as often as they occur; a null
id stays null.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import texts


class CapacityTree:
    """Which capacities have open rows: every inner node counts the open rows below it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Capacity and number of the open row with the smallest capacity from ``least`` on."""
        node = self.leaves + least
        while not self.count[node]:  # up while nothing is there, then to the next subtree on the right
            while node & 1:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity, up = node - self.leaves, node
        while up:
            self.count[up] -= 1
            up >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; the longest pieces first, equal lengths in the given order."""
    tree, rows = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found:
            free, row = found
            rows[row].append(i)
        else:
            free, row = capacity, len(rows)
            rows.append([i])
        if free > lengths[i]:
            tree.add(free - lengths[i], row)
    return rows


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def packed(
    docs: DataFrame, vocabulary_path: str, pattern: str, end_id: int, seq_len: int = 2048, pad_id: int | None = None, block_ids: int = 4_000_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """sequence_id, n_ids, ids, cu_seqlens, position_ids, doc_ids, pieces, starts."""
    keyed = texts(docs, id_col, text_col)
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    pad = end_id if pad_id is None else pad_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, number = byte_bpe(vocabulary_path, pattern), TaskContext.get().partitionId() << 36
        kind = np.dtype("<u2") if max(end_id, pad, bpe.max_token_value) < 1 << 16 else np.dtype("<u4")
        doc_kind = None
        pieces: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, pieces
            rows = best_fit_decreasing([len(p[3]) for p in pieces], seq_len)
            for at in range(0, len(rows), 256):
                own = rows[at : at + 256]
                ids = np.full((len(own), seq_len), pad, kind)
                positions = np.zeros((len(own), seq_len), kind)
                ends, docs_of, piece_of, start_of, n = [], [], [], [], []
                for r, members in enumerate(own):
                    edges = [0]
                    for i in members:
                        piece = pieces[i][3]
                        ids[r, edges[-1] : edges[-1] + len(piece)] = piece
                        positions[r, edges[-1] : edges[-1] + len(piece)] = np.arange(len(piece))
                        edges.append(edges[-1] + len(piece))
                    ends.append(edges)
                    n.append(edges[-1])
                    docs_of.append([pieces[i][0] for i in members])
                    piece_of.append([pieces[i][1] for i in members])
                    start_of.append([pieces[i][2] for i in members])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(number, number + len(own)), pa.int64()), pa.array(n, pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary()),
                     pa.array(ends, pa.list_(pa.int32())), pa.array([x.tobytes() for x in positions], pa.binary()), pa.array(docs_of, pa.list_(doc_kind)),
                     pa.array(piece_of, pa.list_(pa.int32())), pa.array(start_of, pa.list_(pa.int64()))],
                    ["sequence_id", "n_ids", "ids", "cu_seqlens", "position_ids", "doc_ids", "pieces", "starts"],
                )
                number += len(own)
            pieces = []

        held = 0
        for batch in batches:
            doc_kind = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(bpe.encode_to_numpy(text.as_py(), disallowed_special=()).astype(kind), np.array([end_id], kind))
                pieces += [(doc, k, at, ids[at : at + seq_len]) for k, at in enumerate(range(0, len(ids), seq_len))]
                held += len(ids)
                if held >= block_ids:
                    yield from flush()
                    held = 0
        if pieces:
            yield from flush()

    return keyed.mapInArrow(
        run,
        f"sequence_id bigint, n_ids int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{id_type}>, pieces array<int>, starts array<bigint>",
    )


def documents_of(matrix: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, piece, start, ids of every segment (``width`` bytes per id)."""
    segment = F.posexplode(F.arrays_zip("doc_ids", "pieces", "starts")).alias("at", "s")
    low, high = F.expr("cu_seqlens[at]"), F.expr("cu_seqlens[at + 1]")
    return matrix.select("ids", "cu_seqlens", segment).select(
        F.col("s.doc_ids").alias("doc_id"), F.col("s.pieces").alias("piece"), F.col("s.starts").alias("start"),
        F.substring("ids", low * width + 1, (high - low) * width).alias("ids"),
    )
