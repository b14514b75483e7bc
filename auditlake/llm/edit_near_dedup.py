"""Operator 1, near-duplicate classes by Order MinHash and banded alignment.

*Sketch.*  A text's three-word runs are labelled with their occurrence number, so
that a repeated run counts each time.  For each of ``bands`` hash functions the
smallest labelled runs are taken and written in the order in which they stand in
the text: two for the wide key, six for the narrow one.  Texts that share runs in
the same order share keys, so a shared key speaks of a small edit distance.

*Links.*  Equal word sequences are one node from the start.  In every bucket of
a wide key all members are aligned with its smallest member.  Where the members
of a bucket still belong to several classes, they meet again under their narrow
keys.  Where a bucket of a wide key then still holds several classes, every pair of
different classes in it is compared, so no pair is left unchecked that shares a wide
key.  Of these pairs only those are aligned whose numbers of words, in all and
in ``BAG`` hashed parts of the vocabulary, allow the distance; pairs left out are
farther apart for certain.  Pairs are looked at and aligned where a bucket's rows lie, each pair in
one of its buckets, and only links that join something new leave as rows, fewer than the rows that
came.  A large bucket is dealt into cells of two blocks, so a row moves once for each block of
``BLOCK`` rows.  The comparisons themselves, and alignments of pairs that only the alignment can tell
apart, still grow with the square of a bucket's classes.

*Verification.*  Two texts are linked if their word edit distance is at most
(1 - ``similarity``) of the longer one's words, found by an alignment within a
band of that width (bit-parallel over the band); 0.8 by default.

Classes are the connected components of the links.  The row with the smallest id
stays.  Words are white-space separated and lower-cased.  Null and empty texts
have no words and are one class; a text of fewer than three words has one run.
Rows with a null id are classed like others and stay last; repeated rows share a
class.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import HandOver, numbered, texts
from auditlake.llm.components import components
from auditlake.llm.shingles import WordHashes, mix, shingles

BANDS, RUN, WIDE, NARROW, BAG = 32, 3, 2, 6, 2048
COARSE = (32, 256)  # parts that ``BAG`` is summed up to, to leave out most pairs by less work
BLOCK, ROW_BYTES = 4096, 4096  # rows of a bucket that meet another block's in one task, and bytes of text a row of them
_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_CHUNK = 1 << 15


def labelled(runs: np.ndarray) -> np.ndarray:
    """Hash of (run, occurrence number) in text order."""
    order = np.argsort(runs, kind="stable")
    same = runs[order]
    first = np.ones(len(runs), bool)
    first[1:] = same[1:] != same[:-1]
    if first.all():
        return runs
    at = np.arange(len(runs))
    number = np.empty(len(runs), np.uint64)
    number[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return np.where(number > 0, mix(runs + number * np.uint64(0x9E3779B97F4A7C15)), runs)


def sketch(runs: np.ndarray, bands: int = BANDS) -> tuple[list[int], list[int]]:
    """The wide and the narrow keys of all bands."""
    if not len(runs):
        return [], []
    runs, seeds = labelled(runs), _SEEDS[:bands, None]
    best = np.zeros((bands, 0), np.int64)
    for at in range(0, len(runs), _CHUNK):
        where = np.hstack([best, np.broadcast_to(np.arange(at, min(len(runs), at + _CHUNK)), (bands, min(len(runs), at + _CHUNK) - at))])
        values = (runs[where] ^ seeds) * np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
        values *= seeds
        if where.shape[1] > NARROW:
            pick = np.argpartition(values, NARROW - 1, axis=1)[:, :NARROW]
            where, values = np.take_along_axis(where, pick, 1), np.take_along_axis(values, pick, 1)
        best = np.take_along_axis(where, np.argsort(values, axis=1), 1)
    keys = []
    for size in (WIDE, NARROW):
        ordered = runs[np.sort(best[:, :size], axis=1)]
        key = _SEEDS[:bands] * np.uint64(size)
        for i in range(ordered.shape[1]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + ordered[:, i])
        keys.append(key.astype(np.int64).tolist())
    return keys[0], keys[1]


class Aligned:
    """Banded edit distance of one word sequence with many others."""

    def __init__(self, words: list[str]):
        self.n, self.bag = len(words), Counter(words)
        self.places: dict[str, int] = {}
        for i, w in enumerate(words):
            self.places[w] = self.places.get(w, 0) | 1 << i

    def within(self, other: list[str], most: int) -> bool:
        """Is the edit distance at most ``most``?

        One column per word of ``other``; the band's 2 ``most`` + 1 rows are the bits of
        integers, bit k being row column - most + k, so the next column's band is
        one row lower.
        """
        m, n = self.n, len(other)
        if abs(m - n) > most:
            return False
        full = (1 << (2 * most + 1)) - 1
        up, down = full & ~((1 << most) - 1), 0  # rows 1.. of column 0 rise by one each, written in the band of column 1
        top = 1 << (2 * most)
        distance, get = min(m, most), self.places.get
        for column, word in enumerate(other, 1):
            match = get(word, 0)
            if match:  # row r = bit r - 1 of ``match``, wanted at bit r - column + most
                shift = most + 1 - column
                match = ((match << shift) if shift >= 0 else (match >> -shift)) & full
            same = (((match & up) + up) ^ up) | match | down
            rise, fall = down | (full & ~(same | up)), same & up
            if column + most <= m:
                distance += not same & top
            else:
                row = 1 << (m - column + most) if m - column + most >= 0 else 0
                distance += bool(rise & row) - bool(fall & row)
            same = (same & full) >> 1
            up, down = fall | (full & ~(same | rise)), same & rise
        return distance <= most


def similar(a: Aligned, other: list[str], similarity: float) -> bool:
    longer = max(a.n, len(other))
    if longer == 0:
        return True
    most = int((1 - similarity) * longer + 1e-9)
    # each word that the other text lacks costs one edit
    return longer - sum((a.bag & Counter(other)).values()) <= most and a.within(other, most)


def bag(words: np.ndarray) -> bytes:
    """How many words fall into each of ``BAG`` parts of the vocabulary, 255 at most."""
    return np.minimum(np.bincount((words % np.uint64(BAG)).astype(np.int64), minlength=BAG), 255).astype(np.uint8).tobytes()


def _words(text: str) -> list[str]:
    return text.lower().split()


def sketched(docs: DataFrame, bands: int) -> DataFrame:
    """row_id (given or new), doc_id, text, text_id (of the word sequence), wide, narrow, n_words, bag."""
    given = "row_id" in docs.columns
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, row = WordHashes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, wide, narrow, sizes, bags = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    own = _words(text)
                    ids.append(hashlib.blake2b(" ".join(own).encode(), digest_size=16).digest())
                    hashed = hashes.of(own)
                    w, n = sketch(shingles(hashed, RUN), bands)
                    sizes.append(len(own))
                    bags.append(bag(hashed))
                    wide.append(w)
                    narrow.append(n)
                rows = part.column("row_id") if given else pa.array(range(row, row + len(ids)), pa.int64())
                row += len(ids)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows, part.column("doc_id"), part.column("text"), pa.array(ids, pa.binary()), pa.array(wide, longs), pa.array(narrow, longs), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())],
                    ["row_id", "doc_id", "text", "text_id", "wide", "narrow", "n_words", "bag"],
                )

    return docs.mapInArrow(run, f"row_id bigint, doc_id {id_type}, text string, text_id binary, wide array<bigint>, narrow array<bigint>, n_words bigint, bag binary")


def _verified(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar; ``nodes`` (row_id, text)."""
    sides = pairs.join(nodes.select(F.col("row_id").alias("b"), F.col("text").alias("text_b")), "b")
    sides = sides.join(nodes.select(F.col("row_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, aligned = None, None
        for batch in batches:
            keep, a = [], batch.column("a").to_pylist()
            for i, (one, ta, tb) in enumerate(zip(a, batch.column("text_a"), batch.column("text_b"))):
                if one != last:
                    last, aligned = one, Aligned(_words(ta.as_py()))
                if similar(aligned, _words(tb.as_py()), similarity):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return sides.mapInArrow(run, "a bigint, b bigint")


def _near_in_cell(cell: pa.Table, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """A row and those behind it, of other roots, whose numbers of words allow the distance; rows are ordered by ``n_words``.

    Rows of one block meet each other, those of two blocks only the other block's (``second``).
    Two rows that meet in several buckets (``keys``) are told in one of them, drawn by the pair.
    """
    ids, roots, n, second = (cell.column(c).to_numpy() for c in ("row_id", "root", "n_words", "second"))
    bags = np.frombuffer(b"".join(cell.column("bag").to_pylist()), np.uint8).reshape(-1, BAG)
    bucket, lists = cell.column("bucket")[0].as_py(), cell.column("keys").to_pylist()
    width = max(map(len, lists))
    keys = np.array([x + x[:1] * (width - len(x)) for x in lists], np.int64)
    two, total = bool(second.any()), bags.sum(1, dtype=np.int64)
    most = np.floor((1 - similarity) * n + 1e-9).astype(np.int64)
    ends = np.searchsorted(n - most, n, side="right")  # behind the last row whose length allows the distance
    tables = [np.ascontiguousarray(bags.reshape(len(ids), parts, -1).sum(2, dtype=np.int16).T) for parts in COARSE]  # parts summed up lack no more

    def allowed(others: np.ndarray, more: np.ndarray) -> np.ndarray:
        return others[np.maximum(more, more - (total[others] - total[at])) <= most[others]]

    def drawn(others: np.ndarray) -> np.ndarray:
        theirs = keys[others]
        draws = mix(theirs.view(np.uint64) ^ mix((ids[others] ^ ids[at]).view(np.uint64))[:, None])
        draws[~(theirs[:, :, None] == keys[at]).any(2)] = np.iinfo(np.uint64).max
        return others[theirs[np.arange(len(others)), draws.argmin(1)] == bucket]

    for at in range(len(ids) - 1):
        others = np.arange(at + 1, ends[at])
        fit = roots[others] != roots[at]
        others = others[fit & (second[others] != second[at])] if two else others[fit]
        for table in tables:
            if len(others):
                others = allowed(others, np.maximum(table[:, others] - table[:, at, None], 0).sum(0, dtype=np.int64))
        for some in np.split(others, range(512, len(others), 512)):
            if len(some):
                some = drawn(some)
            if len(some):
                some = allowed(some, np.maximum(bags[some].astype(np.int16) - bags[at], 0).sum(1, dtype=np.int64))
            if len(some):
                yield at, some


def _links_in_cell(cell: pa.Table, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Of the pairs of ``_near_in_cell`` similar ones that join all roots which such pairs join, fewer than the cell has rows."""
    roots, text, up = cell.column("root").to_pylist(), cell.column("text"), {}

    def top(x: int) -> int:
        while x in up:
            up[x] = x = up.get(up[x], up[x])
        return x

    for at, others in _near_in_cell(cell, similarity):
        aligned = None
        for other in others.tolist():
            x, y = top(roots[at]), top(roots[other])
            if x != y:
                aligned = aligned or Aligned(_words(text[at].as_py()))
                if similar(aligned, _words(text[other].as_py()), similarity):
                    up[x] = y
                    yield at, np.array([other])


def _cells(left: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """Buckets in cells: bucket, low, high, row_id, root, n_words, second, keys, and the columns of ``nodes``, by cell and n_words.

    ``left`` (bucket, row_id, root, n_words), ``nodes`` (row_id, bag and, if wanted, text).  Buckets of the same members are looked
    at once.  A bucket is dealt into blocks by rows and bytes, any two blocks are a cell, and a task holds one cell at a time.
    """
    n_bytes = F.octet_length("text") if "text" in nodes.columns else F.lit(0)
    sized = left.join(nodes.select("row_id", n_bytes.alias("n_bytes")), "row_id")
    sets = sized.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"), *[F.bit_xor(F.xxhash64("row_id", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    )
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("n_bytes") / (block * ROW_BYTES)))
    sets = sets.groupBy("n", "n_bytes", "h1", "h2").agg(F.min("bucket").alias("bucket")).select("bucket", blocks.alias("blocks"))
    dealt = left.join(sets, "bucket").withColumn("keys", F.collect_list("bucket").over(Window.partitionBy("row_id")))
    dealt = dealt.join(nodes, "row_id").withColumn("block", F.pmod(F.xxhash64("row_id"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    cell = ["bucket", "low", "high"]
    cells = dealt.select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "row_id", "root", "n_words",
        (F.col("block") > F.col("other")).alias("second"), "keys", *nodes.drop("row_id").columns,
    )
    return cells.repartition(*cell).sortWithinPartitions(*cell, "n_words")


def _by_cell(cells: DataFrame, pairs_of: Callable[[pa.Table, float], Iterator[tuple[int, np.ndarray]]], similarity: float) -> DataFrame:
    """The pairs (a, b), a < b, that ``pairs_of`` tells of each cell."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, last = [], None
        for batch in batches:
            names = [batch.column(c).to_numpy() for c in ("bucket", "low", "high")]
            starts = (np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1).tolist()
            for lo, hi in zip([0, *starts], [*starts, batch.num_rows]):
                if lo < hi:
                    name = [x[lo] for x in names]
                    if held and name != last:
                        yield pa.Table.from_batches(held)
                        held = []
                    held.append(batch.slice(lo, hi - lo))
                    last = name
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])

        for cell in whole(batches):
            ids = cell.column("row_id").to_numpy()
            for at, others in pairs_of(cell, similarity):
                found.append((np.minimum(ids[others], ids[at]), np.maximum(ids[others], ids[at])))
                size += len(others)
                if size > 1 << 15:
                    yield told()
                    found, size = [], 0
        if found:
            yield told()

    return cells.mapInArrow(run, "a bigint, b bigint")


def _near_bags(left: DataFrame, nodes: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """The pairs (a, b) of different roots in a bucket whose bags allow them to be similar; these grow with a bucket's square."""
    return _by_cell(_cells(left, nodes.select("row_id", "bag"), block), _near_in_cell, similarity)


def _linked(left: DataFrame, nodes: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Similar pairs (a, b) of different roots in a bucket, enough to join what all of them join; these grow with a bucket's rows.

    The pairs of ``_near_bags`` are aligned in the cell that tells them, unless links found there already join them.
    """
    return _by_cell(_cells(left, nodes.select("row_id", "bag", "text"), block), _links_in_cell, similarity)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends have different roots (a node without one is its own)."""
    ra, rb = (roots.select(F.col("node").alias(s), F.col("root").alias(f"r{s}")) for s in "ab")
    both = pairs.join(ra, "a", "left").join(rb, "b", "left")
    return both.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with their roots, of the buckets that hold several classes."""
    rooted = members.join(roots.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn("root", F.coalesce("root", "row_id"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("bucket")
    return rooted.join(mixed, "bucket")


def classes(docs: DataFrame, over: HandOver, similarity: float = 0.8, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text) as written rows, and the root of every row that isn't alone: (row_id, root)."""
    rows = over.settle(sketched(docs, bands), "sketched")
    # equal word sequences: one node each
    same = over.settle(rows.groupBy("text_id").agg(F.min("row_id").alias("node"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "same")
    copies = over.settle(rows.select("row_id", "text_id").join(same, "text_id").select("row_id", "node"), "copies")
    nodes = rows.join(copies.filter("row_id != node"), "row_id", "left_anti")
    wide = nodes.select("row_id", "n_words", F.posexplode("wide").alias("band", "bucket"))
    buckets = over.settle(wide.groupBy("bucket").agg(F.min("row_id").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "buckets")
    members = over.settle(wide.join(buckets, "bucket").select("bucket", "band", "lead", "row_id", "n_words"), "members")
    needed = members.select("row_id").distinct()
    held = over.settle(nodes.select("row_id", "text", "narrow", "n_words", "bag").join(needed, "row_id"), "held")
    # each member with its bucket's smallest: first the most frequent one, the others where these leave them apart
    pairs = over.settle(members.filter("lead != row_id").groupBy(F.col("lead").alias("a"), F.col("row_id").alias("b")).agg(F.count(F.lit(1)).alias("n")), "pairs")
    first = pairs.groupBy("b").agg(F.max(F.struct("n", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b")
    links = over.settle(_verified(first, held, similarity), "links0")
    parents = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    links = links.unionByName(over.settle(_verified(_apart(pairs.select("a", "b"), parents), held, similarity), "links1"))
    roots = over.settle(components(links, over, "c1"), "roots1")
    # buckets that still hold several classes: their members by the narrow key
    again = _mixed(members, roots).filter("row_id != lead").select("row_id", "band").distinct()
    keys = over.settle(again.join(held.select("row_id", "narrow"), "row_id").select("row_id", F.expr("narrow[band]").alias("bucket")).distinct(), "narrow")
    leads = over.settle(keys.groupBy("bucket").agg(F.min("row_id").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "leads")
    if not leads.isEmpty():
        stars = keys.join(leads, "bucket").filter("lead != row_id").select(F.col("lead").alias("a"), F.col("row_id").alias("b")).distinct()
        more = over.settle(_verified(_apart(stars, roots), held, similarity), "links2")
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = over.settle(components(links, over, "c2"), "roots2")
    # wide buckets that still hold several classes: every pair of different classes
    left = over.settle(_mixed(members, roots).select("bucket", "row_id", "root", "n_words"), "left")
    if not left.isEmpty():
        more = over.settle(_linked(left, held, similarity), "links3")
        if not more.isEmpty():
            roots = over.settle(components(links.unionByName(more), over, "c3"), "roots3")
    # a node's copies share its root
    of_copy = copies.join(roots.withColumnRenamed("node", "of"), copies["node"] == F.col("of"), "left").select("row_id", F.coalesce("root", copies["node"]).alias("root"))
    of_node = roots.select(F.col("node").alias("row_id"), "root").join(copies, "row_id", "left_anti")
    return rows, over.settle(of_copy.unionByName(of_node), "classed")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, class_id (the class's smallest id), class_size, kept."""
    over = HandOver(docs.sparkSession)
    rows, roots = classes(texts(docs, id_col, text_col), over, similarity, bands)
    return _labelled(rows.select("row_id", "doc_id"), roots, over).drop("row_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, bands: int = BANDS) -> DataFrame:
    """All columns of the rows that stay, one of each class."""
    over = HandOver(docs.sparkSession)
    numbered_rows = over.settle(numbered(docs, "__row"), "numbered")
    rows, roots = classes(texts(numbered_rows, id_col, text_col, F.col("__row").alias("row_id")), over, similarity, bands)
    gone = _labelled(rows.select("row_id", "doc_id"), roots, over).filter("NOT kept").select(F.col("row_id").alias("__row"))
    return numbered_rows.join(gone, "__row", "left_anti").select(*docs.columns)


def _labelled(rows: DataFrame, roots: DataFrame, over: HandOver) -> DataFrame:
    classed = over.settle(rows.join(roots, "row_id"), "members-of-classes")
    sums = over.settle(classed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "sums")
    joined = over.settle(classed.join(sums, "root"), "joined")
    stays = joined.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("row_id").alias("row_id"))
    joined = joined.join(stays.select("row_id", F.lit(True).alias("stays")), "row_id", "left").select("row_id", "class_id", "class_size", F.coalesce("stays", F.lit(False)).alias("kept"))
    return rows.join(joined, "row_id", "left").select(
        "row_id", "doc_id", F.when(F.col("kept").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("kept", F.lit(True)).alias("kept"),
    )
