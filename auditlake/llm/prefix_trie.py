"""Operator 12, the prefix trie of conversations, summed up in depth bands.

Conversations are ordered by turn (nulls first; equal turns by a digest of role and
text) and rebuilt: the first h turns of conversation ``c - c % 100`` (none if it is
missing), then the own turns after the first h, with h = crc32(c in decimal) % 6.  A node
is a different sequence of first d rebuilt turns.

1. *Places.*  Turns are range-sorted; a turn's place is its place in its range part
   plus what earlier parts hold of the conversation, so a conversation of any length is
   spread over tasks.  Texts don't move, only their digests and lengths.
2. *Nodes.*  A turn and its depth are hashed into five numbers of 36 bits; a prefix is
   the sum over its turns, made in blocks of ``BLOCK`` turns and carried from block to
   block.  Equal sums at equal depth are one node (180 bits, so different prefixes stay apart).
3. *Bands.*  Depths are cut into bands of ``height``.  Each node sends its values to its
   ancestors inside its band, at most ``height`` rows.  The bands' top nodes are a tree of
   1/height of the depth, summed up the same way, and so on until one band is left; then
   the finished totals of each band's top nodes go to all nodes on their way through the band above.
   That takes about 2 log(depth) / log(height) rounds, whatever the depth.
4. *Ends.*  Members that end at a node are range-sorted, packed into pieces of the list and
   hashed piece by piece, so no list is ever whole anywhere.

Null roles and texts are empty.  Rows without a conversation id belong to no conversation.
Repeated rows are turns of their own.  An empty table has no node, not even the root.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import HandOver, known_to_workers

#: Turns whose prefix sums are made in one go; conversation ids in one piece of a list.
BLOCK = 256
PIECE = 1000

_LANES = [f"x{k}" for k in range(5)]
_BITS = 36


def _placed(turns: DataFrame, over: HandOver) -> tuple[DataFrame, DataFrame]:
    """Turns with their place from 0 (conv_id, place, digest, chars), and conversations with their number of turns."""
    tag = F.monotonically_increasing_id()  # spreads copies of one row, which are interchangeable
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tag")]
    parts = turns.withColumn("tag", tag).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = over.settle(parts.select("conv_id", "digest", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "sorted")
    held = parts.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("before", before)
    placed = parts.join(held, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("at") - F.col("first_at")).alias("place"), "digest", "chars")
    return placed, held.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(conversations: DataFrame, over: HandOver) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth from 1, digest, chars), and all conversations (conv_id, length)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    placed, sizes = _placed(turns, over)
    placed = over.settle(placed, "placed")
    lent = (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h")
    sizes = sizes.select("conv_id", "n", lent, (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    sources = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.join(sources, "base", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = over.settle(convs.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    own = placed.join(convs.select("conv_id", "h", "head"), "conv_id").filter("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("head") + 1).alias("depth"), "digest", "chars")
    heads = placed.filter("place < 5 AND conv_id % 100 = 0").select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    heads = convs.select("conv_id", "base", "h").join(heads, "base").filter("place < h")
    return own.unionByName(heads.select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "chars")), convs.select("conv_id", "length")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every conversation's nodes from the root down: conv_id, depth, node, parent, chars, ends (0 or 1)."""
    hashed = F.sha2(F.concat(F.col("digest"), F.col("depth").cast("string")), 256)
    lanes = [F.conv(F.substring("own", 9 * k + 1, 9), 16, 10).cast("long").alias(x) for k, x in enumerate(_LANES)]
    terms = turns.withColumn("own", hashed).select("conv_id", "depth", F.expr(f"(depth - 1) div {BLOCK}").alias("block"), "chars", *lanes)
    sums = terms.groupBy("conv_id", "block").agg(*[(F.sum(x) % (1 << _BITS)).alias(f"all_{x}") for x in _LANES])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv_id", "block", *[F.coalesce(F.sum(f"all_{x}").over(earlier), F.lit(0)).alias(f"carried_{x}") for x in _LANES])
    inside = Window.partitionBy("conv_id", "block").orderBy("depth")
    summed = terms.select("*", *[F.sum(x).over(inside).alias(f"to_{x}") for x in _LANES]).join(carried, ["conv_id", "block"])

    def named(depth, lanes) -> F.Column:
        return F.unhex(F.sha2(F.concat_ws(":", depth, *[F.pmod(x, F.lit(1 << _BITS)) for x in lanes]), 256))

    here = named(F.col("depth"), [F.col(f"carried_{x}") + F.col(f"to_{x}") for x in _LANES])
    above = named(F.col("depth") - 1, [F.col(f"carried_{x}") + F.col(f"to_{x}") - F.col(x) for x in _LANES])
    steps = summed.select("conv_id", "depth", here.alias("node"), above.alias("parent"), "chars")
    root = named(F.lit(0).cast("long"), [F.lit(0).cast("long")] * len(_LANES))
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"))
    return steps.unionByName(tops).join(convs, "conv_id").select("conv_id", "depth", "node", "parent", "chars", (F.col("depth") == F.col("length")).cast("long").alias("ends"))


def subtree_sums(nodes: DataFrame, steps: DataFrame, values: list[str], height: int, deepest: int, over: HandOver, level: int = 0) -> DataFrame:
    """node and, for each of ``values``, its sum over the node's subtree.

    ``nodes``: node, conv_id (a conversation that has it), depth, values.  ``steps``: conv_id, depth, node for
    every node on those conversations' ways; depths are 0..``deepest`` without gaps.
    """
    band = F.expr(f"depth div {height}").alias("band")
    asked = nodes.select("conv_id", band)
    above = nodes.filter((F.col("depth") % height == 0) & (F.col("depth") > 0)).select("conv_id", F.expr(f"depth div {height} - 1").alias("band"))
    listed = F.sort_array(F.collect_list(F.struct("depth", "node")))  # at most ``height`` of them
    bands = steps.select("conv_id", "depth", "node", band).join(asked.union(above).distinct(), ["conv_id", "band"], "left_semi")
    bands = over.settle(bands.groupBy("conv_id", "band").agg(listed["node"].alias("way")), f"bands-{level}")

    within = nodes.select("conv_id", "depth", band, *values).join(bands, ["conv_id", "band"])
    sent = within.select(F.explode(F.expr(f"slice(way, 1, cast(depth % {height} + 1 AS int))")).alias("node"), *values)
    inside = over.settle(sent.groupBy("node").agg(*[F.sum(v).alias(v) for v in values]), f"inside-{level}")
    if deepest < height:
        return inside
    tops = nodes.filter(F.col("depth") % height == 0).select("node", "conv_id", F.expr(f"depth div {height}").alias("depth"))
    ways = steps.filter(F.col("depth") % height == 0).select("conv_id", F.expr(f"depth div {height}").alias("depth"), "node")
    done = subtree_sums(tops.join(inside, "node"), ways, values, height, deepest // height, over, level + 1)
    hung = tops.filter("depth > 0").join(done, "node").select("conv_id", (F.col("depth") - 1).alias("band"), *values)
    passed = hung.join(bands, ["conv_id", "band"]).select(F.explode("way").alias("node"), *values)
    return over.settle(inside.unionByName(passed).groupBy("node").agg(*[F.sum(v).alias(v) for v in values]), f"totals-{level}")


def ends_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 from (node, conv_id): conversation ids ascending, comma-joined."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []
        kind = {"node": pa.binary(), "first": pa.int64(), "ids": pa.string()}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kind.values())], [*kind])

        for batch in batches:
            rows = []
            for own, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if held and (own != node or len(held) == PIECE):
                    rows.append((node, held[0], ",".join(map(str, held))))
                    held = []
                node = own
                held.append(conv)
            if rows:
                yield out(rows)
        if held:
            yield out([(node, held[0], ",".join(map(str, held)))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])

        for batch in batches:
            rows = []
            for own, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if own == node:
                    state.update(b",")
                else:
                    if state:
                        rows.append((node, state.hexdigest()))
                    node, state = own, hashlib.sha256()
                state.update(ids.encode())
            if rows:
                yield out(rows)
        if state:
            yield out([(node, state.hexdigest())])

    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pack, "node binary, first bigint, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def trie(conversations: DataFrame, height: int = 8) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    known_to_workers(spark)
    over = HandOver(spark)
    turns, convs = rebuilt(conversations, over)
    steps = over.settle(paths(turns, convs), "paths")
    for name in ("sorted", "placed"):
        over.drop(name)
    nodes = steps.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("chars").alias("chars"), F.count(F.lit(1)).alias("n_convs")
    )
    nodes = over.settle(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    known = over.settle(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "known")
    own = known.select(
        "node", "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
    )
    deepest = known.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(own, steps.select("conv_id", "depth", "node"), ["n_leaves", "saved_tokens"], height, deepest, over)
    ended = ends_digests(steps.filter("ends = 1").select("node", "conv_id"))
    parents = known.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nobody = hashlib.sha256().hexdigest()
    return known.join(sums, "node").join(ended, "node", "left").join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256")
    )
