"""Operator 6, best-fit packing: bulk-synchronous best fit over all documents.

Documents become token ids plus an end id; longer ones are cut into pieces of
``seq_len`` ids, the rest stays whole.  Then all pieces are packed together:

1. *Sorted order.*  A piece's place in the order by length is its length and its
   rank among pieces of that length.  Ranks come from counts per (length, task),
   so nothing is sorted and no length, however common, meets in one task.
2. *Successor sweeps.*  Waiting pieces and open gaps are runs: (length, ranks
   from..to) and (gap, sequences from..to).  From the longest length down, the
   run takes its successor, the smallest gap that holds it.
3. *Conflicts.*  Where more pieces than gaps want the same run of gaps, the lower
   ranks get them; the others go on to the next successor.  What no gap holds
   opens new sequences.
4. *Update and repeat*: gaps that were used become shorter runs, and the next
   sweep sees them.

A sweep moves whole runs, so its state is bounded by ``seq_len`` (a few thousand
runs for 2,048) and not by the data; the rounds run over that small table.  Every
piece then finds its run by (length, rank) in one join over the cluster.

Nulls and empty texts are one piece holding the end id.  Repeated rows and rows
without an id are pieces of their own.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from auditlake.llm.common import HandOver, texts

PLAN = StructType(
    [StructField("length", IntegerType()), StructField("rank_from", LongType()), StructField("rank_to", LongType()),
     StructField("first_sequence", LongType()), StructField("offset", LongType())]
)


def pieces(docs: DataFrame, tokenizer_path: str, seq_len: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian uint32), task, nth (of its length in the task)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from auditlake.llm.word_bpe import word_bpe

        bpe, task, seen = word_bpe(tokenizer_path), TaskContext.get().partitionId(), {}
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[tuple] = []
                for doc, text in enumerate(part.column("text").to_pylist()):
                    ids = bpe.encode(text) + end
                    for start in range(0, len(ids), 4 * seq_len):
                        own = ids[start : start + 4 * seq_len]
                        n = len(own) // 4
                        seen[n] = seen.get(n, -1) + 1
                        rows.append((doc, start // (4 * seq_len), start // 4, n, own, task, seen[n]))
                doc, piece, start, n, own, tasks, nth = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(n, pa.int32()), pa.array(own, pa.binary()), pa.array(tasks, pa.int32()), pa.array(nth, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids", "task", "nth"],
                )

    return docs.mapInArrow(cut, f"doc_id {id_type}, piece int, start bigint, length int, ids binary, task int, nth bigint")


def sweep(counts: dict[int, int], seq_len: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank_from, rank_to, first_sequence, offset) that place ``counts`` pieces of each length."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    sequences, plan = 0, []
    for length in sorted(counts, reverse=True):
        rank, waiting = 0, counts[length]
        while waiting:
            gap = min((g for g in gaps if g >= length), default=0)
            if not gap:
                opened = -(-waiting // (seq_len // length))
                gaps[seq_len] = [(sequences, opened)]
                sequences += opened
                continue
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            taken = min(n, waiting)
            if taken < n:
                gaps.setdefault(gap, []).append((first + taken, n - taken))
            if gap > length:
                gaps.setdefault(gap - length, []).append((first, taken))
            plan.append((length, rank, rank + taken, first, seq_len - gap))
            rank, waiting = rank + taken, waiting - taken
    return plan


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its ids and its place: doc_id, piece, start, length, ids, sequence_id, offset."""
    spark = docs.sparkSession
    over = HandOver(spark)
    cut = over.settle(pieces(texts(docs, id_col, text_col), tokenizer_path, seq_len, end_id), "pieces")
    counts = over.settle(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most seq_len rows
    plan = F.broadcast(spark.createDataFrame(sweep(by_length, seq_len), PLAN))
    before = counts.select(
        F.col("length").alias("of_length"), F.col("task").alias("of_task"),
        F.expr("sum(n) OVER (PARTITION BY length ORDER BY task) - n").alias("before"),
    )
    ranked = cut.join(before, (cut["length"] == before["of_length"]) & (cut["task"] == before["of_task"])).select(
        "doc_id", "piece", "start", F.col("length").alias("n"), "ids", (F.col("before") + F.col("nth")).alias("rank")
    )
    hit = (F.col("n") == plan["length"]) & (F.col("rank") >= plan["rank_from"]) & (F.col("rank") < plan["rank_to"])
    return ranked.join(plan, hit).select(
        "doc_id", "piece", "start", F.col("n").cast("long").alias("length"), "ids",
        (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset",
    )
