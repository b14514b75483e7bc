"""Operator 4, suffix-array dedup: removes every byte covered by a string of ``length`` bytes that starts anywhere else too.

No suffix array of all text is needed to judge strings of a fixed length exactly:

1. *Anchors.*  Every string of ``length`` bytes names one of its own positions, the
   smallest hash of its 32-byte runs.  Equal strings name the same position in
   themselves, so they share the bytes around it, whatever stands before and
   after.  Strings that name the same position of a text form one entry; its key is a
   hash of over 200 bytes that all of them contain.
2. *Keys.*  Only entries whose key occurs twice can hold a repeated string; the
   others, most of all text, are never looked at again and their bytes don't move.
3. *Suffix order.*  Entries meet by key.  A task cuts their bytes into 50-byte symbols
   aligned at the anchor and orders all symbol suffixes of a block of keys by linear
   grouping (``suffix_groups``).  Common prefixes of neighbours, in bytes, then tell
   which strings are equal: for each remainder r, two strings are equal if their aligned
   parts share length - r bytes and the r bytes before are equal.
4. *Spans* go back to the texts, overlapping ones are joined, and what is left is kept.

Equal entries (copies) are combined in each task before they move.  Where one key has
more than ``MOST`` different entries, its strings are compared as digests, counted by a
combined aggregate, so that no key gathers in one task.

Null and empty texts, and texts shorter than ``length``, keep all their bytes.  Repeated
rows repeat each other's strings.  Rows without an id are handled like others.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import HandOver, texts
from auditlake.llm.shingles import mix
from auditlake.llm.suffix_groups import suffix_order

LENGTH = 400
GRAM, STEP = 32, 50
#: Different entries of one key that one task may order; entries of a block of keys.
MOST, BLOCK = 20_000, 8_000
_CHUNK = 1 << 21
_C = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def entries(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """key, anchor, and the smallest and largest distance from a string's start to its anchor."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 4
    eight = np.ndarray((n - 7,), "<u8", data, strides=(1,))
    half = (length - GRAM) // 2
    parts = []
    for at in range(0, n - length + 1, _CHUNK):
        count = min(_CHUNK, n - length + 1 - at)
        own = eight[at : at + count + length - 1 - 7]
        grams = len(own) - GRAM + 8
        h = mix(sum(own[8 * k : 8 * k + grams] * _C[k] for k in range(GRAM // 8)))
        best = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
        wide, want = 1, length - GRAM + 1
        while wide < want:
            more = min(wide, want - wide)
            best = np.minimum(best[:-more], best[more:])
            wide += more
        anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.diff(anchor)) + 1
        low, high = np.append(0, cut), np.append(cut, count) - 1
        x = anchor[low]
        parts.append((x + at, x - high, x - low))
    x, a0, a1 = (np.concatenate(p) for p in zip(*parts))
    out = []
    words = (length - half) // 8
    for side, mine, low, high, start in (
        (1, a0 <= half, a0, np.minimum(a1, half), x),
        (2, a1 > half, np.maximum(a0, half + 1), a1, x - half - 1),
    ):
        s = start[mine]
        key = np.full(len(s), np.uint64(side))
        for k in range(words):
            key = key * np.uint64(0x9E3779B97F4A7C15) + eight[s + 8 * k] * _C[k]
        out.append((mix(key).astype(np.int64), x[mine], low[mine], high[mine]))
    return tuple(np.concatenate(p) for p in zip(*out))


def _bytes_equal(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common leading bytes of rows a and b of a byte table."""
    differ = table[a] != table[b]
    return np.where(differ.any(1), differ.argmax(1), table.shape[1])


def repeated(contexts: list[bytes], a0: np.ndarray, a1: np.ndarray, twice: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the largest and smallest distance of a repeated string's start to the anchor; -1 for none.

    ``contexts[e]`` are the bytes from anchor - a1 to anchor - a0 + length; ``twice`` marks entries that occur twice as they are.
    """
    n = len(contexts)
    symbols_of, lead_of, rest_of, first_of = [], [], [], np.empty(n, np.int64)
    at = 0
    for e, data in enumerate(contexts):  # cut at the anchor's multiples of STEP; before the first one stands a short lead
        lead = int(a1[e]) % STEP
        body = [data[p : p + STEP] for p in range(lead, len(data), STEP)]
        symbols_of += body + [b""]
        lead_of += [data[:lead]] + body[:-1] + [b""]
        rest_of += [len(data) - p for p in range(lead, len(data), STEP)] + [0]
        first_of[e] = at
        at += len(body) + 1
    wide = np.zeros((at + 1, STEP), np.uint8)
    wide[:at] = np.array(symbols_of, f"S{STEP}").view(np.uint8).reshape(at, STEP)
    _, symbol = np.unique(wide.view(f"V{STEP}").ravel(), return_inverse=True)
    table = np.zeros((symbol.max() + 1, STEP), np.uint8)
    table[symbol] = wide
    ends = np.array([s == b"" for s in symbols_of], bool)
    text = np.append(np.where(ends, 1, symbol[:at] + 2), 0)
    order = suffix_order(text)[1:]
    p, q = order[:-1], order[1:]
    same, alive, t = np.zeros(len(p), np.int64), np.arange(len(p)), 0
    while len(alive) and t < length // STEP + 2:
        i, j = np.minimum(p[alive] + t, at), np.minimum(q[alive] + t, at)
        equal = (text[i] == text[j]) & (text[i] > 1)
        other = alive[~equal]
        same[other] += _bytes_equal(table, symbol[np.minimum(p[other] + t, at)], symbol[np.minimum(q[other] + t, at)])
        alive = alive[equal]
        same[alive] += STEP
        t += 1
    rest = np.append(np.array(rest_of), 0)
    same = np.minimum(same, np.minimum(rest[p], rest[q]))
    back = np.zeros((at, STEP), np.uint8)
    back[:] = np.array([s[::-1] for s in lead_of], f"S{STEP}").view(np.uint8).reshape(at, STEP)
    rows, before = np.unique(back.view(f"V{STEP}").ravel(), return_inverse=True)
    rows = rows.view(np.uint8).reshape(-1, STEP)
    if len(rows) > 1:  # void rows aren't in the bytes' order, equal prefixes must be neighbours
        by = np.lexsort(rows.T[::-1])
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        rows, before = rows[by], place[before]
    joined = np.append(0, _bytes_equal(rows, np.arange(len(rows) - 1), np.arange(1, len(rows)))) if len(rows) > 1 else np.zeros(1, np.int64)
    most, least = np.where(twice, a1, -1), np.where(twice, a0, -1)
    one = np.arange(n)
    group = np.empty(at + 1, np.int64)
    for r in range(STEP):
        group[order] = np.append(0, np.cumsum(same < length - r))
        left = np.cumsum(joined < r)[before] if r else np.zeros(at, np.int64)
        # strings that start r bytes before a boundary: distances a = r, r + STEP, ... within [a0, a1]
        low, high = np.maximum(0, -((r - a0) // STEP)), (a1 - r) // STEP
        number = np.maximum(0, high - low + 1)
        total = int(number.sum())
        if not total:
            continue
        who = np.repeat(one, number)
        q_of = np.arange(total) - np.repeat(np.cumsum(number) - number, number) + np.repeat(low, number)
        boundary = first_of[who] + a1[who] // STEP - q_of
        _, inverse, counts = np.unique(group[boundary] * (left.max() + 1) + left[boundary], return_inverse=True, return_counts=True)
        hit = counts[inverse] > 1
        w, a = who[hit], q_of[hit] * STEP + r
        np.maximum.at(most, w, a)
        free = least[w] < 0
        least[w[free]] = length
        np.minimum.at(least, w, a)
    return most, least


def _keyed(rows: DataFrame, length: int) -> DataFrame:
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys = [entries(t.as_buffer().to_pybytes(), length)[0] for t in part.column("text")]
                ids = pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [ids, part.column("doc_id"), part.column("text"), pa.array(keys, pa.list_(pa.int64()))], ["row_id", "doc_id", "text", "keys"]
                )

    return rows.mapInArrow(run, f"row_id bigint, doc_id {id_type}, text string, keys array<bigint>")


def _entries_of(held: DataFrame, length: int) -> DataFrame:
    """The entries with repeated keys; a task writes the bytes of equal entries twice at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: list[tuple] = []
                for row, text, wanted in zip(part.column("row_id").to_pylist(), part.column("text"), part.column("keys").to_pylist()):
                    data, wanted = text.as_buffer().to_pybytes(), set(wanted)
                    for key, x, a0, a1 in zip(*(c.tolist() for c in entries(data, length))):
                        if key in wanted:
                            own = data[x - a1 : x - a0 + length]
                            digest = hashlib.blake2b(own + a1.to_bytes(4, "little"), digest_size=16).digest()
                            if len(seen) > 200_000:
                                seen.clear()
                            seen[digest] += 1
                            out.append((row, x, digest, key, a0, a1, own if seen[digest] <= 2 else None))
                cols = list(zip(*out)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["row_id", "x", "entry", "key", "a0", "a1", "bytes"])

    return held.mapInArrow(run, "row_id bigint, x bigint, entry binary, key bigint, a0 int, a1 int, bytes binary")


def _ordered(entries_with_bytes: DataFrame, length: int) -> DataFrame:
    """entry, most, least for entries that hold repeated strings; whole keys per task, in blocks."""

    def block(rows: dict[bytes, list]) -> pa.RecordBatch:
        names = list(rows)
        a0, a1 = (np.array([rows[k][i] for k in names], np.int64) for i in (1, 2))
        most, least = repeated([rows[k][0] for k in names], a0, a1, np.array([rows[k][3] for k in names], bool), length)
        hit = np.flatnonzero(most >= 0)
        return pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in hit], pa.binary()), pa.array(most[hit].astype(np.int32)), pa.array(least[hit].astype(np.int32))], ["entry", "most", "least"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[bytes, list] = {}
        last = None
        for batch in batches:
            for entry, key, a0, a1, data in zip(*(batch.column(c).to_pylist() for c in ("entry", "key", "a0", "a1", "bytes"))):
                if key != last and len(rows) >= BLOCK:
                    yield block(rows)
                    rows = {}
                last = key
                if entry in rows:
                    rows[entry][3] = True
                else:
                    rows[entry] = [data, a0, a1, False]
        if rows:
            yield block(rows)

    return entries_with_bytes.repartition("key").sortWithinPartitions("key").mapInArrow(run, "entry binary, most int, least int")


def _counted(crowded: DataFrame, over: HandOver, length: int) -> DataFrame:
    """The same for keys with too many entries for one task: strings by digest, counted while they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry, a0, a1, data, times in zip(*(batch.column(c).to_pylist() for c in ("entry", "a0", "a1", "bytes", "n"))):
                a = np.arange(a0, a1 + 1)
                digests = [hashlib.blake2b(data[a1 - k : a1 - k + length], digest_size=16).digest() for k in a.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([entry] * len(a), pa.binary()), pa.array(a, pa.int32()), pa.array(digests, pa.binary()), pa.array([times] * len(a), pa.int64())], ["entry", "a", "string", "n"]
                )

    one = crowded.groupBy("entry", "a0", "a1", "bytes").agg(F.count(F.lit(1)).alias("n"))
    strings = over.settle(one.mapInArrow(run, "entry binary, a int, string binary, n bigint"), "strings")
    often = over.settle(strings.groupBy("string").agg(F.sum("n").alias("times")).filter("times > 1"), "often")
    return strings.join(often, "string").groupBy("entry").agg(F.max("a").alias("most"), F.min("a").alias("least"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes from..to), kept (the remaining bytes, or their SHA-256 with ``digest``)."""
    over = HandOver(docs.sparkSession)
    rows = over.settle(_keyed(texts(docs, id_col, text_col), length), "rows")
    keys = rows.select("row_id", F.explode("keys").alias("key"))
    twice = over.settle(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "twice")
    wanted = over.settle(keys.join(twice.hint("merge"), "key").groupBy("row_id").agg(F.collect_set("key").alias("keys")), "wanted")
    held = over.settle(rows.select("row_id", "text").join(wanted.hint("merge"), "row_id"), "held")
    found = over.settle(_entries_of(held, length), "entries")
    told = found.filter("bytes IS NOT NULL").select("entry", "key", "a0", "a1", "bytes")
    crowds = over.settle(told.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST).select("key"), "crowds")
    spans = over.settle(_ordered(told.join(crowds, "key", "left_anti"), length), "ordered")
    if not crowds.isEmpty():
        spans = spans.unionByName(over.settle(_counted(told.join(crowds, "key"), over, length), "counted"))
    spans = over.settle(
        found.select("row_id", "x", "entry").join(spans.hint("merge"), "entry")
        .groupBy("row_id").agg(F.collect_list(F.struct((F.col("x") - F.col("most")).alias("from"), (F.col("x") - F.col("least") + length).alias("to"))).alias("spans")), "spans",
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("from", pa.int64()), ("to", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out, kept = [], []
                for text, own in zip(part.column("text"), part.column("spans").to_pylist()):
                    data, whole, left, end = text.as_buffer().to_pybytes(), [], [], 0
                    for s in sorted((s["from"], s["to"]) for s in own):
                        if whole and s[0] <= whole[-1]["to"]:
                            whole[-1]["to"] = max(whole[-1]["to"], s[1])
                        else:
                            whole.append({"from": s[0], "to": s[1]})
                    for s in whole:
                        left.append(data[end : s["from"]])
                        end = s["to"]
                    left = b"".join([*left, data[end:]])
                    out.append(whole)
                    kept.append(hashlib.sha256(left).hexdigest() if digest else left)
                yield pa.RecordBatch.from_arrays([part.column("row_id"), pa.array(out, pa.list_(span)), pa.array(kept, pa.string() if digest else pa.binary())], ["row_id", "spans", "left"])

    kind = f"row_id bigint, spans array<struct<from:bigint,to:bigint>>, left {'string' if digest else 'binary'}"
    shortened = over.settle(held.select("row_id", "text").join(spans, "row_id").mapInArrow(cut, kind), "shortened")
    whole = F.sha2("text", 256) if digest else F.col("text").cast("binary")
    all_rows = rows.select("row_id", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), whole.alias("whole"))
    return all_rows.join(shortened, "row_id", "left").select(
        "doc_id", "n_bytes", F.coalesce("spans", F.expr("cast(array() as array<struct<from:bigint,to:bigint>>)")).alias("spans"),
        F.coalesce("left", "whole").alias("kept"),
    )
