"""Operator 11, token counts: a two-tier lookup of pre-token lengths inside the tasks.

A text is cut into pre-tokens that the tokenizer never joins, so its count is the
sum of their counts.  Each text stays in the task that read it:

1. *Frequent pre-tokens.*  Every task sums up its pre-tokens in a bounded
   frequent-items summary (all documents are read; a summary keeps each pre-token
   with more than 1 / ``2 * table_size`` of its task's occurrences).  A summary is one row;
   they are merged ``FAN_IN`` at a time until one is left.  No pre-token is shuffled by itself.
2. *First tier.*  The driver encodes the ``table_size`` most frequent pre-tokens and
   sends their lengths to all tasks as one packed table, whose bytes are checked
   against ``most_bytes``.
3. *Second tier.*  A miss is encoded by the task and remembered by its worker, up to
   ``cache_size`` pre-tokens; beyond it the cache starts anew.

Tables and caches change the speed only, never a count.

Pre-tokens are cut before a space that follows another character and around line ends.
That this is safe is read from the model (``separable``): the normaliser must leave
characters alone (but for the mark that stands for a space), no piece may go on with
a mark after another character, and none may hold a line end.  With a model that
doesn't allow it texts are encoded whole.

A null text is an empty one, which has no token.  Repeated rows are counted as often
as they occur, a null id stays null, an empty table gives no rows.  Columns
beside the id and the text are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import HandOver, texts

#: Summaries that one merging task reads.
FAN_IN = 16
#: Longer pre-tokens are neither in the table nor in a cache: each is encoded where it stands.
LONGEST = 48
#: Texts whose misses are encoded together.
BLOCK = 100

#: Fixed value: the model's sign for a space.
_MARK = "▁"
_SPACED = re.compile(" +[^ ]*|[^ ]+")


@lru_cache(maxsize=2)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def separable(path: str) -> bool:
    """Whether the counts of pre-tokens add up to the count of a text."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    cleaning, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece.Type
    plain = not cleaning.precompiled_charsmap and cleaning.add_dummy_prefix and not cleaning.remove_extra_whitespaces and cleaning.escape_whitespaces
    bytewise = model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix and model.trainer_spec.model_type == 2
    return bool(plain and bytewise) and not any(
        p.type in (kinds.USER_DEFINED, kinds.UNUSED) or p.type == kinds.NORMAL and re.search(f"[^{_MARK}]{_MARK}|\n", p.piece) for p in model.pieces
    )


def pre_tokens(text: str) -> list[str]:
    """What to encode one by one: a word without its one space, or after a line end the end and the word.

    A line end counts as one token and isn't listed by itself; ``""`` is a lone space.
    """
    if not text:
        return []
    out: list[str] = []
    for k, line in enumerate(text.replace(_MARK, " ").split("\n")):
        if "  " in line or line[:1] == " ":
            out += [w[1:] if w[0] == " " else "\n" + w for w in _SPACED.findall(line if k else " " + line)]
        elif k and not line:
            continue
        else:
            words = line.split(" ")
            if k:
                words[0] = "\n" + words[0]
            out += words
    return out


def lengths_of(words: list[str], path: str) -> list[int]:
    """Tokens of each pre-token; the model puts a space before every text, and a line end after it isn't the pre-token's."""
    got = piece_model(path).encode(words, num_threads=1)
    return [1 if not w else len(ids) - 2 * (w[0] == "\n") for w, ids in zip(words, got)]


class Lengths:
    """Two tiers of pre-token lengths; pickled as one packed table without the cache."""

    def __init__(self, words: list[str], lengths: list[int], path: str, cache_size: int):
        self.known, self.path, self.cache_size = dict(zip(words, lengths)), path, cache_size
        self.all = dict(self.known)

    def __getstate__(self) -> tuple:
        return "\x00".join(self.known).encode(), array("H", self.known.values()).tobytes(), self.path, self.cache_size

    def __setstate__(self, state: tuple) -> None:
        words, lengths, path, cache_size = state
        lengths = array("H", lengths).tolist()
        self.__init__(words.decode().split("\x00") if lengths else [], lengths, path, cache_size)

    def bytes(self) -> int:
        words, lengths, *_ = self.__getstate__()
        return len(words) + len(lengths)

    def counts(self, found: list[str]) -> list[int]:
        cut = [pre_tokens(t) for t in found]
        missing = set().union(*cut).difference(self.all)
        if len(self.all) - len(self.known) + len(missing) > self.cache_size:
            self.all = dict(self.known)
            missing = set().union(*cut).difference(self.all)
        if missing:
            new = [*missing]
            self.all.update(zip(new, lengths_of(new, self.path)))
        length = self.all.__getitem__
        n = [t.count("\n") + sum(map(length, words)) for t, words in zip(found, cut)]
        for w in missing:
            if len(w) > LONGEST:
                del self.all[w]
        return n


class Summary:
    """Frequent items: at most ``2 * size`` counters at rest; what is taken off all of them bounds the error."""

    def __init__(self, size: int):
        self.size, self.counts = size, Counter()

    def add(self, words) -> None:
        self.counts.update(words)
        if len(self.counts) > 8 * self.size:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > 2 * self.size:
            off = sorted(self.counts.values(), reverse=True)[2 * self.size]
            self.counts = Counter({w: n - off for w, n in self.counts.items() if n > off})

    def row(self, part: int) -> pa.RecordBatch:
        self.shrink()
        top = sorted(self.counts.items(), key=lambda x: (-x[1], x[0]))
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))],
            ["part", "words", "counts"],
        )


_SUMMARY = "part bigint, words array<string>, counts array<bigint>"


def frequent(keyed: DataFrame, table_size: int) -> list[str]:
    """The most frequent pre-tokens of all texts, by merged summaries."""
    over = HandOver(keyed.sparkSession)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Summary(table_size)
        for batch in batches:
            for text in batch.column("text"):
                own.add(w for w in pre_tokens(text.as_py()) if len(w) <= LONGEST and "\x00" not in w)
        yield own.row(TaskContext.get().partitionId())

    def merge(key, table):
        own = Summary(table_size)
        for words, counts in zip(table.column("words"), table.column("counts")):
            own.add(dict(zip(words.as_py(), counts.as_py())))
        return pa.Table.from_batches([own.row(key[0].as_py())])

    found = over.settle(keyed.select("text").mapInArrow(sum_up, _SUMMARY), "summaries")
    left = (found.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        found = found.groupBy(F.expr(f"part div {FAN_IN}").alias("to")).applyInArrow(merge, _SUMMARY)
        left = -(-left // FAN_IN)
    last = found.select(F.slice("words", 1, table_size).alias("words")).first()
    over.drop("summaries")
    return list(last["words"]) if last else []


def token_counts(
    docs: DataFrame, model_path: str, limit: int = 4096, table_size: int = 16_384, cache_size: int = 200_000, most_bytes: int = 8 << 20,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    keyed = texts(docs, id_col, text_col)
    spark, id_type = keyed.sparkSession, keyed.schema["doc_id"].dataType.simpleString()
    whole = not separable(model_path)
    words = [] if whole else frequent(keyed, table_size)
    table = Lengths(words, lengths_of(words, model_path) if words else [], model_path, cache_size)
    if table.bytes() > most_bytes:
        raise ValueError(f"the table of frequent pre-tokens has {table.bytes()} bytes, more than {most_bytes}; take a smaller table_size")
    sent = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = part.column("text").to_pylist()
                n = [len(piece_model(model_path).encode(t)) for t in found] if whole else lengths.counts(found)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t.encode()) for t in found], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
                )

    counted = keyed.mapInArrow(count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
