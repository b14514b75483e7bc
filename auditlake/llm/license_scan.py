"""Operator 8, licence scan by ordered signature rules; columns only, one narrow stage.

1. *Prefilter.*  A text without any gate word ("licen", "copyright", ...) runs no
   rule; otherwise a rule runs only where its gate and its keyword occur.
2. *Rules* run in their order over the lower-cased text and give intervals.
3. *Suppression.*  An interval that lies in another one of the same or a better
   priority falls away; of equal intervals the earlier rule stays.  Sorted by start,
   this is one pass that keeps the farthest end seen per priority.

Next to the rules, three fixed phrases are found by words, wherever their words
stand consecutively; their labels always stay.

The work of a row depends on its own text alone, so there is no shuffle and no
hot key; a text of very many detections costs its own task only.  Null counts as
empty: no words, no labels, score 0.  Rows are kept one by one, repeated or not.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.columns import settle
from auditlake.llm.common import texts
from auditlake.llm.license_rules import rules

#: Phrase and label.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Fixed value: what stands between words of lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: How sure one detection of a priority is that the text carries licence terms.
WEIGHT = {0: 0.95, 1: 0.8, 2: 0.4}


def _count(text: Column, what: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(what)))) / len(what)).cast("long")


def _spaced(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def _apart(keyword: str) -> str:
    """The keyword as it stands among the words, whatever separates them in the text."""
    return keyword.replace(" ", "  ")


def _detections() -> Column:
    """Intervals of all rules that pass the prefilter, in the order the suppression reads them."""
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("number", "priority", "gate", "keyword", "label", "pattern", "apart"), (*r, _apart(r[3])))]) for r in rules()])
    low, gates = F.col("low"), F.col("gates")

    def spans(rule: Column) -> Column:
        found, between = F.regexp_extract_all(low, rule["pattern"], F.lit(0)), F.split(low, rule["pattern"], -1)
        one = lambda start, end: F.struct(
            start.alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["number"].alias("number"), rule["label"].alias("label")
        )
        empty = F.expr("cast(array() as array<struct<start:int,end:int,priority:int,number:int,label:string>>)")
        step = lambda acc, i: F.struct(
            (acc["at"] + F.length(between[i]) + F.length(found[i])).alias("at"),
            F.concat(acc["spans"], F.array(one(acc["at"] + F.length(between[i]), acc["at"] + F.length(between[i]) + F.length(found[i])))).alias("spans"),
        )
        indexes = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(indexes, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])

    passing = F.filter(table, lambda r: F.array_contains(gates, r["gate"]) & (F.contains(low, r["keyword"]) | F.contains(F.col("words"), r["apart"])))
    return F.array_sort(
        F.flatten(F.transform(passing, spans)),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"])
        .when(a["priority"] != b["priority"], a["priority"] - b["priority"]).otherwise(a["number"] - b["number"]),
    )


def _kept(found: Column) -> Column:
    """Detections outside all earlier-starting ones of the same or a better priority."""
    kind = "array<struct<start:int,end:int,priority:int,number:int,label:string>>"
    start = F.struct(*[F.lit(-1).alias(f"end{p}") for p in range(3)], F.expr(f"cast(array() as {kind})").alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        better = F.when(d["priority"] == 0, acc["end0"]).when(d["priority"] == 1, acc["end1"]).otherwise(acc["end2"])
        ends = [F.when(d["priority"] <= p, F.greatest(acc[f"end{p}"], d["end"])).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in range(3)]
        return F.struct(*ends, F.when(better >= d["end"], acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"))

    return F.aggregate(found, start, step, lambda acc: acc["kept"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places per phrase, first_word, last_word, base_labels, labels, detections, score."""
    low = settle(texts(docs, id_col, text_col), low=F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).drop("text")
    trimmed = F.trim(F.regexp_replace("low", BETWEEN, "  "))
    gates = sorted({r[2] for r in rules()})
    low = settle(
        low, words=F.when(trimmed == "", F.lit("")).otherwise(F.concat(F.lit(" "), trimmed, F.lit(" "))),
        gates=F.filter(F.array(*map(F.lit, gates)), lambda g: F.contains(F.col("low"), g)),
    )
    wrapped = F.filter(F.array(*[F.when(F.contains("words", F.lit(_apart(g))), F.lit(g)) for g in gates if " " in g]), lambda g: g.isNotNull())
    low = settle(low.withColumnRenamed("gates", "plain"), gates=F.array_union("plain", wrapped)).drop("plain")
    places, firsts, lasts = [], [], []
    n_words = _count(F.col("words"), " ") / 2
    for phrase, _ in BASE:
        spaced = _spaced(phrase)
        there = F.contains("words", F.lit(spaced))
        places.append(F.when(there, _count(F.col("words"), spaced)).otherwise(F.lit(0)).cast("long"))
        firsts.append(F.when(there, (_count(F.substring_index("words", spaced, 1), " ") / 2).cast("long")))
        lasts.append(F.when(there, (n_words - len(phrase.split()) - _count(F.substring_index("words", spaced, -1), " ") / 2).cast("long")))
    found = settle(
        low, n_words=n_words.cast("long"), places=F.array(*places), first_word=F.least(*firsts), last_word=F.greatest(*lasts),
        detections=F.when(F.size("gates") == 0, F.expr("cast(array() as array<struct<start:int,end:int,priority:int,number:int,label:string>>)")).otherwise(_kept(_detections())),
    ).drop("low", "words", "gates")
    base = F.filter(F.array(*[F.when(F.col("places")[i] > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    doubt = F.aggregate("detections", F.lit(1.0), lambda acc, d: acc * F.when(d["priority"] == 0, 1 - WEIGHT[0]).when(d["priority"] == 1, 1 - WEIGHT[1]).otherwise(1 - WEIGHT[2]))
    any_base = F.aggregate("places", F.lit(0).cast("long"), lambda acc, n: acc + n) > 0
    return found.select(
        "doc_id", "n_words", "places", "first_word", "last_word", F.array_sort(base).alias("base_labels"),
        F.array_sort(F.array_union(base, F.transform("detections", lambda d: d["label"]))).alias("labels"), "detections",
        (1 - doubt * F.when(any_base, 1 - WEIGHT[1]).otherwise(1.0)).alias("score"),
    )
