"""Operator 5, toxicity by maximum-scoring segments.

*Model.*  From labelled rows: in how many toxic and other texts a word occurs,
as log-odds with an informative Dirichlet prior (``prior`` pseudo-texts, at most one for every
five rows, spread as the word's overall rate), kept where they are above ``lead`` and lie at least
``least_z`` standard errors from zero.  Every other word costs ``drift``, so that
segments end.

*Search.*  A linear scan finds all maximal scoring segments of a text's words.

*Calibration.*  The best segment of a clean text of n words follows an extreme-value law
P(score > x) = 1 - exp(-K n exp(-lambda x)).  Lambda solves sum p(w) exp(lambda s(w)) = 1
over clean words, K is its maximum-likelihood value over clean training texts.  By it
scores become comparable over lengths: x' = lambda x - ln(K n).  A text's best x', the sum statistic over
all its segments (the sum of the r largest x' for the r that makes it largest) and ln n give the score through a logistic fit on
the training rows.  A segment is reported as significant when it is expected less than
``significant`` times; that cut plays no part in the score.

Only ``most_rows`` labelled rows (by hash of the id, about that many) are learned
from, each different text once, which bounds the model and what the driver sees;
scoring covers every row and whole texts in one narrow stage.  Labels, language,
source and id are never inputs of a score.

Null and empty texts have no words and get the score of a text without segments.
Rows are scored one by one, repeated or not.  Labels that are null are left out;
if an id has several labels, toxic wins.  Without any usable label of either kind
nothing can be learned and every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import HandOver, texts

_EDGE = "".join(c for c in map(chr, range(33, 192)) if not c.isalnum())


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 0.1
    lam: float = 1.0
    k: float = 1.0
    significant: float = 0.05
    weights: tuple[float, ...] | None = None


def words(text: str) -> list[str]:
    return [w.strip(_EDGE) for w in text.lower().split()]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, score), in one pass over the positive entries."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.cumsum(scores)
    left, right = (total[up] - scores[up]).tolist(), total[up].tolist()
    stack: list[list] = []  # from, to, sum before, sum after, entry below with a smaller sum before
    for at, low, high in zip(up.tolist(), left, right):
        first, j = at, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append([first, at + 1, low, high, j])
                break
            first, low = stack[j][0], stack[j][2]
            below = stack[j][4]
            del stack[j:]
            j = below
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def _features(model: Model, text: str) -> tuple[int, float, float, list[tuple[int, int, float]]]:
    """Words, best comparable score, sum statistic, and the significant segments."""
    own = words(text)
    get, drift = model.scores.get, -model.drift
    found = segments(np.array([get(w, drift) for w in own]))
    n = max(1, len(own))
    chance = math.log(model.k * n)
    comparable = sorted((model.lam * s - chance for *_, s in found), reverse=True) or [-chance]
    total = comparable[0] + sum(x for x in comparable[1:] if x > 0)
    good = [x for x in found if model.lam * x[2] - chance > -math.log(model.significant)]
    return n, comparable[0], total, good


def _inputs(n: int, best: float, total: float) -> np.ndarray:
    return np.array([1.0, max(-10.0, min(60.0, best)), max(-10.0, min(200.0, total)), math.log(n)])


def score_of(model: Model, n: int, best: float, total: float) -> float:
    if model.weights is None:
        return 0.0
    return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(_inputs(n, best, total) @ np.array(model.weights)))))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a ridge-stabilised fit; the first column is constant, the others are scaled for the fit."""
    middle, width = x.mean(0), x.std(0) + 1e-9
    middle[0], width[0] = 0.0, 1.0
    x = (x - middle) / width
    w, ridge = np.zeros(x.shape[1]), 1e-3 * np.eye(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    w = w / width
    w[0] -= (w * middle).sum()
    return tuple(map(float, w))


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_rows: int = 20_000, prior: float = 500.0, lead: float = 1.0, least_z: float = 2.0, drift: float = 0.3, significant: float = 0.05,
) -> Model:
    """Learns from rows of ``labels`` (their id under ``id_col`` too); ``learn`` says which ids may be used."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    if learn is not None:
        known = known.filter(learn)
    n = known.count()
    if n > most_rows:
        known = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int(most_rows / n * (1 << 20)))
    keyed = texts(docs, id_col, text_col)
    rows = keyed.join(known, keyed["doc_id"] == known["label_id"]).select("text", "toxic").dropDuplicates(["text"])
    over = HandOver(docs.sparkSession)
    rows = over.settle(rows, "train")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                own = Counter(words(text))
                for w, n in [*own.items(), ("", 1)]:
                    x = seen.setdefault(w, [0, 0, 0])
                    x[0 if toxic else 1] += 1
                    x[2] += 0 if toxic else n
                x = seen.setdefault(" ", [0, 0, 0])
                x[2] += 0 if toxic else sum(own.values())
        cols = [list(seen), *([x[i] for x in seen.values()] for i in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["word", "df1", "df0", "tf0"])

    kind = "word string, df1 bigint, df0 bigint, tf0 bigint"
    counts = over.settle(rows.mapInArrow(count, kind).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("df1", "df0", "tf0")]), "counts")
    whole = {r["word"]: r for r in counts.filter("word IN ('', ' ')").collect()}
    model = Model(drift=drift, significant=significant)
    n1, n0 = (whole[""]["df1"], whole[""]["df0"]) if "" in whole else (0, 0)
    if not n1 or not n0:
        return model
    prior = min(prior, (n1 + n0) / 5)
    rate = (F.col("df1") + F.col("df0")) / (n1 + n0)
    a, b = F.col("df1") + prior * rate, F.col("df0") + prior * rate
    odds = F.log(a / (n1 + prior - a)) - F.log(b / (n0 + prior - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    told = counts.filter("word NOT IN ('', ' ')").select("word", "tf0", odds.alias("odds"), z.alias("z")).filter((F.col("z") >= least_z) & (F.col("odds") > lead))
    chosen = told.select("word", "tf0", "odds").collect()  # some of the words of about most_rows texts
    model.scores = {r["word"]: r["odds"] for r in chosen}
    clean = max(1, whole[" "]["tf0"])
    probs = [((r["tf0"] + 0.5) / clean, r["odds"]) for r in chosen]
    rest = max(0.0, 1 - sum(p for p, _ in probs))
    low, high = 0.0, 4.0
    for _ in range(60):  # the positive root; the sum is convex, 1 at 0 and falling there
        mid = (low + high) / 2
        low, high = (low, mid) if sum(p * math.exp(min(600.0, mid * s)) for p, s in probs) + rest * math.exp(-mid * drift) > 1 else (mid, high)
    model.lam = max(0.05, low)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_features(model, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.float64()),
                 pa.array([x[2] for x in own], pa.float64()), batch.column("toxic")], ["n", "best", "total", "toxic"],
            )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = n = 0
            for t in batch.column("text").to_pylist():
                own = words(t)
                top = max((s for *_, s in segments(np.array([model.scores.get(w, -drift) for w in own]))), default=0.0)
                total, n = total + max(1, len(own)) * math.exp(-model.lam * top), n + 1
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.float64()), pa.array([n], pa.int64())], ["total", "n"])

    law = rows.filter("toxic = 0").mapInArrow(best, "total double, n bigint").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).first()
    model.k = law["n"] / max(1e-12, law["total"])
    got = rows.mapInArrow(measure, "n bigint, best double, total double, toxic int").toPandas()  # at most about most_rows rows
    x = np.array([_inputs(*row) for row in zip(got["n"], got["best"], got["total"])])
    model.weights = _logistic(x, got["toxic"].to_numpy(dtype=float))
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, significant segments (words from..to, score), number of words."""
    keyed = texts(docs, id_col, text_col)
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = [_features(model, t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([score_of(model, *x[:3]) for x in own], pa.float64()),
                     pa.array([[{"first": a, "last": b - 1, "score": s} for a, b, s in x[3]] for x in own], pa.list_(span)),
                     pa.array([x[0] for x in own], pa.int64())], ["doc_id", "score", "segments", "n_words"],
                )

    return keyed.mapInArrow(run, f"doc_id {id_type}, score double, segments array<struct<first:int,last:int,score:double>>, n_words bigint")


def without_toxic(docs: DataFrame, model: Model, reject_at: float = 0.3, text_col: str = "text") -> DataFrame:
    """All columns of the rows whose score is below ``reject_at``."""
    known = docs.select("*")
    texts(docs, text_col, text_col)  # workers find this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = [_features(model, t or "") for t in part.column(text_col).to_pylist()]
                yield part.filter(pa.array([score_of(model, *x[:3]) < reject_at for x in own], pa.bool_()))

    return known.mapInArrow(run, docs.schema)
