"""Rules as data: which rules of a table match which texts.

A rule is a row (rule_id, pattern), with a language or without.  For every pattern the
literals are worked out of which a match must hold one (``required``); all literals of a block of
rules make one Aho-Corasick automaton, so a text is read once whatever the number of
rules, and only patterns whose literal occurs are run.  Patterns that need no literal of two characters
are run on every text.

Rules go to the tasks in blocks of at most ``RULE_BYTES`` of pattern text, one pass over the
texts per block; texts stay where they are and nothing is paired up before a match.  A pattern is
compiled when its literal first occurs, and matches leave a task in batches of about ``MOST_ROWS`` rows.
Patterns are Python regular expressions, so is what they mean.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import known_to_workers

RULE_BYTES = 8 << 20
#: Most alternatives a pattern's literals may have; beyond it the pattern counts as one without.
MOST_LITERALS = 64
LEAST_LENGTH = 2
#: Matches that a task holds before it hands them on.
MOST_ROWS = 1 << 16

# Both letters are equal to i in a pattern that ignores case, but not in folded text.
_DOTS = {0x130: "i", 0x131: "i"}


def folded(text: str) -> str:
    """Texts that a pattern may take for equal when it ignores case are equal here."""
    return text.translate(_DOTS).casefold()


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    if a is None or b is None:
        return b if a is None else a
    rank = lambda x: (min(map(len, x)), -len(x))
    return max(a, b, key=rank)


def _of_sequence(items) -> set[str] | None:
    """The best set of literals of which any match of the parsed sequence holds at least one."""
    best, run = None, ""
    for op, arg in [*items, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += folded(chr(arg))
            continue
        if run:
            best, run = _better(best, {run}), ""
        if name == "SUBPATTERN":
            best = _better(best, _of_sequence(arg[3]))
        elif name == "ATOMIC_GROUP":
            best = _better(best, _of_sequence(arg))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            best = _better(best, _of_sequence(arg[2]))
        elif name == "BRANCH":
            parts = [_of_sequence(x) for x in arg[1]]
            if all(parts) and len(union := set().union(*parts)) <= MOST_LITERALS:
                best = _better(best, union)
    return best


def required(pattern: str) -> set[str]:
    """Folded literals of which every match holds at least one; empty if no useful ones are known."""
    from re import _parser

    found = _of_sequence(_parser.parse(pattern))
    return found if found and min(map(len, found)) >= LEAST_LENGTH else set()


class RuleSet:
    """Patterns with their automaton; the automaton is made where it is used, only the rules are sent."""

    def __init__(self, rules: list[tuple[object, str, str | None]]):
        self.rules = rules
        self.ready = False

    def __getstate__(self):
        return self.rules

    def __setstate__(self, rules):
        self.__init__(rules)

    def _make(self) -> None:
        import ahocorasick

        by_pattern = defaultdict(list)
        for rule_id, pattern, language in self.rules:
            by_pattern[pattern].append((rule_id, language))
        self.owners = [*by_pattern.values()]
        self.patterns = [*by_pattern]
        self.compiled: list[re.Pattern | None] = [None] * len(self.patterns)
        by_literal, self.always = defaultdict(list), []
        for k, pattern in enumerate(by_pattern):
            literals = required(pattern)
            for literal in literals:
                by_literal[literal].append(k)
            if not literals:
                self.always.append(k)
        self.automaton = ahocorasick.Automaton()
        for literal, owners in by_literal.items():
            self.automaton.add_word(literal, owners)
        if by_literal:
            self.automaton.make_automaton()
        self.ready = True

    def _found(self, k: int, text: str) -> bool:
        if self.compiled[k] is None:
            self.compiled[k] = re.compile(self.patterns[k])
        return self.compiled[k].search(text) is not None

    def matching(self, text: str, language: str | None = None) -> list[object]:
        """Ids of the rules that match, for any language or for this one."""
        if not self.ready:
            self._make()
        tried = set(self.always)
        if len(self.automaton):
            for _, owners in self.automaton.iter(folded(text)):
                tried.update(owners)
        return [i for k in sorted(tried) if self._found(k, text) for i, lang in self.owners[k] if lang is None or lang == language]


def checked(rules: list[tuple[object, str, str | None]]) -> list[tuple[object, str, str | None]]:
    for rule_id, pattern, _ in rules:
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"rule {rule_id!r} is no regular expression: {e}") from e
    return rules


def _blocks(rules: DataFrame, rule_id: str, pattern: str, language: str | None, rule_bytes: int) -> Iterator[list[tuple]]:
    kept = rules.filter(F.col(pattern).isNotNull()).select(
        F.col(rule_id).alias("rule_id"), F.col(pattern).alias("pattern"), (F.col(language) if language else F.lit(None).cast("string")).alias("language")
    )
    total = kept.agg(F.sum(F.octet_length("pattern") + 32)).first()[0] or 0
    parts = max(1, -(-total // rule_bytes))
    for p in range(parts if total else 0):
        yield checked([tuple(r) for r in kept.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == p).toLocalIterator()])


def matches(batches: Iterator[pa.RecordBatch], rule_set: RuleSet, ids: list[str], kind: pa.DataType | None) -> Iterator[pa.RecordBatch]:
    """The ``ids`` of each text beside each rule that matches it; a batch ends with the text that fills it."""

    def rows(batch: pa.RecordBatch, at: list[int], found: list[object]) -> pa.RecordBatch:
        taken = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in ids), pa.array(found, kind)], [*ids, "rule_id"])

    for batch in batches:
        at, found = [], []
        for i, (body, lang) in enumerate(zip(batch.column("__text").to_pylist(), batch.column("__language").to_pylist())):
            hits = rule_set.matching(body, lang)
            at += [i] * len(hits)
            found += hits
            if len(found) >= MOST_ROWS:
                yield rows(batch, at, found)
                at, found = [], []
        yield rows(batch, at, found)


def match(
    texts: DataFrame, rules: DataFrame, ids: list[str], *, text: str = "text", language: str | None = None, rule_id: str = "rule_id", pattern: str = "pattern",
    rule_language: str | None = None, rule_bytes: int = RULE_BYTES,
) -> DataFrame:
    """The ``ids`` columns and rule_id, a row for each text and rule that matches it.

    A null text matches nothing and a null pattern is no rule.  A rule without a
    language holds for all; one with a language for texts of it (column ``language``).  Repeated
    texts and repeated rules each count for themselves.
    """
    known_to_workers(texts.sparkSession)
    spoken = F.col(language) if language else F.lit(None).cast("string")
    read = texts.filter(F.col(text).isNotNull()).select(*ids, F.col(text).alias("__text"), spoken.alias("__language"))
    kind = rules.schema[rule_id].dataType
    schema = texts.select(*ids).schema.add("rule_id", kind)
    out = texts.sparkSession.createDataFrame([], schema)
    for block in _blocks(rules, rule_id, pattern, rule_language, rule_bytes):
        sent = texts.sparkSession.sparkContext.broadcast(RuleSet(block))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return matches(batches, sent.value, ids, pa.int64() if kind.typeName() == "long" else None)

        out = out.unionByName(read.mapInArrow(run, schema))
    return out
