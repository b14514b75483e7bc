"""Product-quantised inverted lists: nearest vectors from short codes, re-ranked exactly.

``fit`` learns cell centres and, per slice of the dimensions, a codebook of what
is left of a vector beside its centre, and a second one of what that leaves, on a bounded sample.
``indexed`` gives every vector a row (doc_id, cell, code): two bytes per slice, so a table of codes is a
fraction of the vectors.  ``search`` reads the codes of each query's nearest cells where they lie, keeps
the ``rerank`` best per query by the codes, and only for those fetches the whole vectors and
ranks by the exact similarity.  Queries go to the tasks in blocks whose bytes are
bounded; codes and vectors are never collected.

Vectors without an id, with another length, nulls or not-a-number can't be compared and
are left out, as in ``retrieval.top_k``; a zero vector is as far from everything as
an unrelated one.  Similarity is the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.retrieval import _ids, _matrix, _unit, usable

#: Bytes of query vectors that one pass sends to all tasks.
QUERY_BYTES = 32 << 20
#: Codes that a task decodes at once.
_CHUNK = 16_384


@dataclass(frozen=True)
class Index:
    centre: np.ndarray  # cells x size, unit rows
    books: np.ndarray  # 2 x slices x 256 x size / slices: of what the centre leaves, of what the first code leaves

    @property
    def size(self) -> int:
        return self.centre.shape[1]

    def nearest_cells(self, unit: np.ndarray, count: int) -> np.ndarray:
        return np.argsort(-(unit @ self.centre.T), axis=1, kind="stable")[:, :count].astype(np.int32)

    def encode(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        slices = self.books.shape[1]
        rest = (unit - self.centre[cell]).reshape(len(unit), slices, -1)
        code = np.empty((len(unit), 2 * slices), np.uint8)
        for level, books in enumerate(self.books):
            for k, book in enumerate(books):  # least squared distance
                near = ((book**2).sum(1)[None] - 2 * rest[:, k] @ book.T).argmin(1)
                code[:, level * slices + k] = near
                rest[:, k] -= book[near]
        return code

    def decode(self, code: np.ndarray, cell: np.ndarray) -> np.ndarray:
        first, second = np.split(code, 2, axis=1)
        return self.centre[cell] + np.concatenate([a[first[:, k]] + b[second[:, k]] for k, (a, b) in enumerate(zip(*self.books))], axis=1)


def _clusters(data: np.ndarray, count: int, rounds: int, unit: bool) -> np.ndarray:
    """Plain k-means from evenly spaced rows; an empty cluster keeps its centre."""
    centre = data[np.linspace(0, len(data) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        near = ((centre**2).sum(1)[None] - 2 * data @ centre.T).argmin(1)
        n = np.bincount(near, minlength=count)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, data)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
        if unit:
            centre = _unit(centre)
    return centre


def fit(docs: DataFrame, *, cells: int = 64, slices: int = 16, sample_rows: int = 50_000, rounds: int = 8) -> Index:
    """Learns the index on about ``sample_rows`` vectors (chosen by hash of the id); ``slices`` must divide the size."""
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("vector").isNotNull()).select("doc_id", "vector")
    n, size = rows.agg(F.count(F.lit(1)), F.mode(F.size("vector"), True)).first()
    if not n:
        raise ValueError("no vectors to learn from")
    rows = rows.filter(usable("doc_id", size))
    if n > sample_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < max(1, int(sample_rows / n * (1 << 20))))
    data = _unit(_matrix(rows.orderBy("doc_id").toPandas()["vector"]))
    centre = _clusters(data, min(cells, len(data)), rounds, unit=True)
    rest = (data - centre[(data @ centre.T).argmax(1)]).reshape(len(data), slices, -1)
    books = []
    for _ in range(2):
        books.append(np.stack([_clusters(rest[:, k], min(256, len(data)), rounds, unit=False) for k in range(slices)]))
        rest = np.stack([r - b[((b**2).sum(1)[None] - 2 * r @ b.T).argmin(1)] for r, b in zip(rest.transpose(1, 0, 2), books[-1])], axis=1)
    return Index(centre, np.stack(books))


def indexed(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, cell, code of every usable vector; write it once and search it often."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                unit = _unit(_matrix(part["vector"]))
                cell = held.value.nearest_cells(unit, 1)[:, 0]
                yield pd.DataFrame({"doc_id": part["doc_id"], "cell": cell, "code": [c.tobytes() for c in held.value.encode(unit, cell)]})

    usable_docs = docs.select("doc_id", "vector").filter(usable("doc_id", index.size))
    return usable_docs.mapInPandas(run, f"doc_id {kind}, cell int, code binary")


def _blocks(queries: DataFrame, index: Index, query_bytes: int) -> Iterator[pd.DataFrame]:
    """Queries in blocks of at most about ``query_bytes``, one at a time on the driver."""
    n = queries.count()
    parts = max(1, -(-n * index.size * 8 // query_bytes))
    for p in range(parts if n else 0):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).toPandas()
        if len(block):
            yield block


def candidates(queries: DataFrame, codes: DataFrame, index: Index, *, probes: int, rerank: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, doc_id: the ``rerank`` best of each query by the codes of its ``probes`` nearest cells."""
    spark = codes.sparkSession
    asked = queries.select("query_id", "vector").filter(usable("query_id", index.size))
    kinds = asked.schema["query_id"].dataType.simpleString(), codes.schema["doc_id"].dataType.simpleString()
    kind = f"query_id {kinds[0]}, doc_id {kinds[1]}, near double"
    best = spark.createDataFrame([], kind)
    for block in _blocks(asked, index, query_bytes):
        unit = _unit(_matrix(block["vector"])).astype(np.float32)
        held = spark.sparkContext.broadcast((_ids(block["query_id"]), unit, index.nearest_cells(unit, probes), index))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            q_ids, unit, cells, index = held.value
            probing = [np.flatnonzero((cells == c).any(1)) for c in range(len(index.centre))]
            found: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # per query: similarity by the codes, document
            for part in batches:
                d_ids, d_cells = _ids(part["doc_id"]), part["cell"].to_numpy()
                for c in np.unique(d_cells):
                    own, queries_of = np.flatnonzero(d_cells == c), probing[c]
                    for at in range(0, len(own), _CHUNK):
                        rows = own[at : at + _CHUNK]
                        code = np.frombuffer(b"".join(part["code"].iloc[rows]), np.uint8).reshape(len(rows), -1)
                        near = np.round(unit[queries_of] @ index.decode(code, d_cells[rows]).astype(np.float32).T, 5)  # copies are equal
                        for q, row in zip(queries_of, near):
                            old = found.get(q, (np.empty(0, np.float32), d_ids[:0]))
                            score, ids = np.concatenate([old[0], row]), np.concatenate([old[1], d_ids[rows]])
                            if len(score) > rerank:
                                least = np.partition(score, -rerank)[-rerank]
                                held_on = np.flatnonzero(score >= least)
                                top = held_on[np.lexsort((ids[held_on], -score[held_on]))[:rerank]]
                                score, ids = score[top], ids[top]
                            found[q] = score, ids
            for q, (score, ids) in found.items():
                yield pd.DataFrame({"query_id": np.repeat(q_ids[q], len(ids)), "doc_id": ids, "near": score.astype(np.float64)})

        best = best.unionByName(codes.select("doc_id", "cell", "code").mapInPandas(run, kind))
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "doc_id")
    return best.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= rerank).select("query_id", "doc_id")


def search(
    queries: DataFrame, docs: DataFrame, index: Index, codes: DataFrame | None = None, *, k: int, rerank: int = 100, probes: int | None = None,
    threshold: float = -2.0, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """query_id, doc_id, similarity, rank as ``retrieval.top_k`` gives them, among the candidates by the codes."""
    codes = indexed(docs, index) if codes is None else codes
    pairs = candidates(queries, codes, index, probes=len(index.centre) if probes is None else probes, rerank=rerank, query_bytes=query_bytes)
    whole = docs.filter(usable("doc_id", index.size)).select("doc_id", F.col("vector").cast("array<double>").alias("d"))
    asked = queries.filter(usable("query_id", index.size)).select("query_id", F.col("vector").cast("array<double>").alias("q"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y)
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    length = F.sqrt(dot("q", "q")) * F.sqrt(dot("d", "d"))
    scored = pairs.distinct().join(whole, "doc_id").join(asked, "query_id").select("query_id", "doc_id", F.round(F.when(length > 0, dot("q", "d") / length).otherwise(0.0), 9).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return scored.filter(F.col("similarity") >= threshold).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
