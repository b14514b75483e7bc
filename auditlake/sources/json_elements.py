"""Elements of large JSON documents: one file is read by many tasks.

A document such as ``{"vulnerabilities": [{...}, {...}]}`` is read as text in byte ranges
(``separator`` is where records of the text reader end, it says nothing about the JSON).  A
first pass finds for every range how it changes the state of a reader, whether
a string is open and how deep the brackets are, for each state it may start with.  These
summaries, a row per range, are put one after the other on the driver; a second pass
then knows its state and cuts out the objects that open ``depth`` brackets deep.  An
element that lies across ranges is put together from its pieces, and nothing else moves.

An element cut off by the end of the file comes out as it is; ``parsed`` sets it and any other that
can't be read aside in ``_corrupt_record``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import cut_lineage, known_to_workers

_STRING = re.compile(r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"')
_TO_CLOSE = re.compile(r'[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"')
_TOKEN = re.compile(r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|"[\s\S]*+|[\[\]{}]')
_BRACKET = re.compile(r"[\[\]{}]")
OUTSIDE, INSIDE, ESCAPED = range(3)


def _string_end(text: str, state: int) -> tuple[int, int]:
    """Where the open string ends in ``text`` (its length if it doesn't), and the state after it."""
    start = 1 if state == ESCAPED and text else 0
    if state == ESCAPED and not text:
        return 0, ESCAPED
    if m := _TO_CLOSE.match(text, start):
        return m.end(), OUTSIDE
    return len(text), _open_state(text[start:])


def _open_state(inside: str) -> int:
    return ESCAPED if (len(inside) - len(inside.rstrip("\\"))) % 2 else INSIDE


def advance(text: str, state: int) -> tuple[int, int, str]:
    """State after ``text``, how many brackets from before it are closed, and those it leaves open."""
    if state != OUTSIDE:
        at, state = _string_end(text, state)
        if state != OUTSIDE:
            return state, 0, ""
        text = text[at:]
    bare = _STRING.sub("", text)
    if (at := bare.find('"')) >= 0:
        state, bare = _open_state(bare[at + 1 :]), bare[:at]
    closed, left = 0, []
    for m in _BRACKET.finditer(bare):
        if m.group() in "[{":
            left.append(m.group())
        elif left:
            left.pop()
        else:
            closed += 1
    return state, closed, "".join(left)


def joined(first: tuple[int, str], then: tuple[int, str]) -> tuple[int, str]:
    """(closed, left open) of two texts one after the other."""
    if then[0] <= len(first[1]):
        return first[0], first[1][: len(first[1]) - then[0]] + then[1]
    return first[0] + then[0] - len(first[1]), then[1]


def pieces(text: str, state: int, depth: int, inside: bool, target: int) -> tuple[list[tuple[int, int, bool, bool]], int, int, bool]:
    """(from, to, opened here, closed here) of every element or part of one in ``text``; state, depth and whether one is open behind it."""
    at, out, first = 0, [], 0 if inside else None
    opened = False
    if state != OUTSIDE:
        at, state = _string_end(text, state)
    if state == OUTSIDE:
        for m in _TOKEN.finditer(text, at):
            sign = m.group()
            if sign in "[{":
                if sign == "{" and depth == target:
                    first, opened = m.start(), True
                depth += 1
            elif sign in "]}":
                depth -= 1
                if depth == target and first is not None:
                    out.append((first, m.end(), opened, True))
                    first = None
            elif len(sign) < 2 or not _STRING.fullmatch(sign):
                state = _open_state(sign[1:])
    if first is not None:
        out.append((first, len(text), opened, False))
    return out, state, depth, first is not None


def elements(spark: SparkSession, path: str, *, depth: int = 2, separator: str = "},") -> DataFrame:
    """file, element (text) of every object that opens inside ``depth`` brackets; 2 for the records of a feed, 1 for a plain array."""
    known_to_workers(spark)
    read = spark.read.option("lineSep", separator).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
        """Records with the separator that stood before them."""
        last = None
        for batch in batches:
            for value, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start"))):
                yield file, start, value if start == 0 and last != (file, start) else separator + value
                last = file, start

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[tuple]] = {}
        for file, start, text in ranges(batches):
            ways = found.get((file, start), [(s, 0, "") for s in range(3)])
            steps = {state: advance(text, state) for state in {w[0] for w in ways}}
            found[file, start] = [(steps[w[0]][0], *joined(w[1:], steps[w[0]][1:])) for w in ways]
        kinds = {"file": pa.string(), "start": pa.int64(), **{n: pa.list_(k) for n, k in (("state", pa.int64()), ("closed", pa.int64()), ("left", pa.string()))}}
        rows = [(f, s, *map(list, zip(*ways))) for (f, s), ways in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], [*kinds])

    begins: dict[tuple[str, int], tuple[int, int, bool, int]] = {}  # state, depth, whether in an element, and the range that opened it
    file, state, stack, owner = None, OUTSIDE, "", -1
    changes = read.mapInArrow(summarise, "file string, start bigint, state array<bigint>, closed array<bigint>, left array<string>")
    for r in changes.orderBy("file", "start").toLocalIterator():
        if r["file"] != file:
            file, state, stack, owner = r["file"], OUTSIDE, "", -1
        begins[r["file"], r["start"]] = state, len(stack), stack[depth : depth + 1] == "{", owner
        if len(stack) - r["closed"][state] <= depth:
            owner = r["start"]
        state, stack = r["state"][state], joined((0, stack), (r["closed"][state], r["left"][state]))[1]
    sent = spark.sparkContext.broadcast(begins)  # a row per range of the files

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, now, rows = None, None, []
        held: list[str] = []  # of the element that is open
        whose = -1

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["file", "owner", "start", "nth", "text"])

        def close(complete: bool) -> None:
            """An element that lies within the range is a row by itself (owner null), else a piece."""
            nonlocal held
            if held:
                whole = complete and whose == here[1]
                rows.append((here[0], None if whole else whose, here[1], len(rows), "".join(held)))
                held = []

        for file, start, text in ranges(batches):
            if (file, start) != here:
                if here is not None:
                    close(False)
                here, (*now, whose) = (file, start), sent.value[file, start]
            found, *now = pieces(text, *now, depth)
            for first, last, opened, closed in found:
                if opened:
                    whose = start
                held.append(text[first:last])
                if closed:
                    close(True)
            if len(rows) >= 500:
                yield batch_of(rows)
                rows = []
        if here is not None:
            close(False)
        if rows:
            yield batch_of(rows)

    found = cut_lineage(read.mapInArrow(cut, "file string, owner bigint, start bigint, nth bigint, text string"))
    across = found.filter("owner IS NOT NULL").groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("p"))
    return found.filter("owner IS NULL").select("file", F.col("text").alias("element")).unionByName(across.select("file", F.array_join("p.text", "").alias("element")))


def parsed(found: DataFrame, schema: str, element: str = "element") -> DataFrame:
    """The fields of ``schema`` for every element; one that can't be read has nulls and its text in ``_corrupt_record``."""
    kind = f"{schema}, _corrupt_record string"
    return found.withColumn("_e", F.from_json(element, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})).select("file", "_e.*")
