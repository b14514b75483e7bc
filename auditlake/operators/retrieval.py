"""Similar known cases: vector top-k, BM25 inside each pool, rank fusion.

Vector top-k is exact.  Two ways give the same rows:

* few queries (bytes checked): the query matrix is broadcast, every task scores
  its part of the knowledge base in place and hands on k rows per query;
* otherwise both sides are cut into blocks of bounded size and each pair of
  blocks is one task that again hands on k rows per query.

Neither materialises query-document pairs beyond the top k of a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import rulebook as rb
from auditlake.session import at_most, cut_lineage

# Most bytes of query vectors and ids that are broadcast.
MAX_BROADCAST_BYTES = 64 << 20
# Most bytes of vectors in a block; each side is sent once per block of the other.
BLOCK_BYTES = 32 << 20
# Scores held at once by a task, of so many queries, and documents in its first chunk.
CHUNK_CELLS = 4_194_304
QUERY_ROWS = 1024
FIRST_CHUNK = 256


def _pair(q: DataFrame, d: DataFrame) -> str:
    kinds = (q.schema["query_id"].dataType.simpleString(), d.schema["doc_id"].dataType.simpleString())
    return f"query_id {kinds[0]}, doc_id {kinds[1]}, similarity double"


def _ids(column: pd.Series) -> np.ndarray:
    """Ids as an array that sorts as they do: integers, else text."""
    return column.to_numpy(np.int64) if pd.api.types.is_integer_dtype(column) else column.to_numpy(np.str_)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    norm[norm == 0] = 1.0
    return rows / norm


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in column])


def _similarity(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        sim = _unit(q) @ _unit(d).T
    else:  # one minus squared distance
        sim = 1.0 - ((q**2).sum(1)[:, None] + (d**2).sum(1)[None, :] - 2.0 * (q @ d.T))
    return np.round(sim, 9)


def _chunk_best(q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best documents of one chunk per query, ties by id."""
    by_id = np.argsort(d_ids, kind="stable")
    d_ids, d = d_ids[by_id], d[by_id]
    sim = _similarity(q, d, metric)
    best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
    return d_ids[best], np.take_along_axis(sim, best, axis=1)


class _Best:
    """The k best documents of some queries over all chunks seen.

    A chunk is scored roughly (single precision for the cosine) and only what may beat a query's
    kth best so far is scored exactly; a query with many such documents is scored as a whole.
    """

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = q, k, metric
        kind = np.float32 if metric == "cosine" else np.float64
        self.rough_q = (_unit(q) if metric == "cosine" else q).astype(kind)
        self.error = 4 * (q.shape[1] + 4) * float(np.finfo(kind).eps)
        self.least = np.full(len(q), -np.inf)
        self.row, self.ids, self.score = np.empty(0, np.int64), None, np.empty(0)

    def _rough(self, d: np.ndarray) -> tuple[np.ndarray, float]:
        """Similarities and how far they may be off."""
        if self.metric == "cosine":
            return self.rough_q @ d.astype(np.float32).T, self.error + 1e-8
        sides = (self.q**2).sum(1), (d**2).sum(1)
        sim = 1.0 - (sides[0][:, None] + sides[1][None, :] - 2.0 * (self.q @ d.T))
        return sim, self.error * (1.0 + 2.0 * float(sides[0].max() + sides[1].max())) + 1e-8

    def _exact(self, row: np.ndarray, d: np.ndarray, at: np.ndarray) -> np.ndarray:
        q, d = self.q[row], d[at]
        if self.metric == "cosine":
            return np.round(np.einsum("ij,ij->i", _unit(q), _unit(d)), 9)
        return np.round(1.0 - ((q**2).sum(1) + (d**2).sum(1) - 2.0 * np.einsum("ij,ij->i", q, d)), 9)

    def add(self, d_ids: np.ndarray, d: np.ndarray, rough_d: np.ndarray) -> None:
        sim, off = self._rough(rough_d)
        may = sim >= (self.least - off)[:, None]
        many = np.count_nonzero(may, axis=1) > 8 * self.k
        may[many] = False
        row, at = np.nonzero(may)
        found = [(row, d_ids[at], self._exact(row, d, at))]
        if len(whole := np.flatnonzero(many)):
            ids, score = _chunk_best(self.q[whole], d_ids, d, self.k, self.metric)
            found.append((np.repeat(whole, ids.shape[1]), ids.ravel(), score.ravel()))
        self._merge(*(np.concatenate(x) for x in zip(*found)))

    def _merge(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(row):
            return
        if self.ids is not None:
            row, ids, score = np.concatenate([self.row, row]), np.concatenate([self.ids, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        starts = np.searchsorted(row, np.arange(len(self.q)))
        nth = np.arange(len(row)) - starts[row]
        kept = nth < self.k
        last = nth == self.k - 1
        self.least[row[last]] = score[last]
        self.row, self.ids, self.score = row[kept], ids[kept], score[kept]


def _best_of(q_ids: np.ndarray, q: np.ndarray, parts: Iterator[pd.DataFrame], k: int, floor: float, metric: str) -> Iterator[pd.DataFrame]:
    """k best documents per query over all parts, holding only k per query and one chunk; a frame per block of queries."""
    blocks = [(at, _Best(q[at : at + QUERY_ROWS], k, metric)) for at in range(0, len(q), QUERY_ROWS)]
    seen = 0
    for part in parts:
        at = 0
        while at < len(part):
            # Chunks double, so what beats the best so far stays a few rows per query.
            chunk = part.iloc[at : at + min(max(seen, FIRST_CHUNK), CHUNK_CELLS // QUERY_ROWS)]
            ids, d = _ids(chunk["doc_id"]), _matrix(chunk["vector"])
            rough = _unit(d) if metric == "cosine" else d
            for _, best in blocks:
                best.add(ids, d, rough)
            at, seen = at + len(chunk), seen + len(chunk)
    for at, best in blocks:
        keep = best.score >= floor
        if keep.any():
            yield pd.DataFrame({"query_id": q_ids[at + best.row[keep]], "doc_id": best.ids[keep], "similarity": best.score[keep]})


def _vector_size(queries: DataFrame) -> int:
    sizes = queries.filter(F.col("vector").isNotNull()).groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sizes["n"] if sizes else 0


def usable(id_col: str, size: int) -> Column:
    """An id and a whole vector of that size."""
    whole = F.col("vector").isNotNull() & (F.size("vector") == size) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    return F.col(id_col).isNotNull() & F.coalesce(whole, F.lit(False))


def unusable(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """How many documents ``top_k`` leaves out: documents, unusable."""
    out = F.count_if(~usable("doc_id", _vector_size(queries)))
    return docs.agg(F.count(F.lit(1)).alias("documents"), out.alias("unusable"))


def top_k(
    queries: DataFrame, docs: DataFrame, *, k: int, threshold: float = -2.0, metric: str = "cosine",
    broadcast_bytes: int = MAX_BROADCAST_BYTES, block_rows: int | None = None,
) -> DataFrame:
    """query_id, doc_id, similarity, rank for ``queries(query_id, vector)`` and ``docs(doc_id, vector)``.

    Ids are integers or text.  Rows without an id or a vector, or with a null in
    the vector or another length than most queries have, can't be compared and
    are left out; ``unusable`` counts them.
    """
    q, d = queries.select("query_id", "vector"), docs.select("doc_id", "vector")
    size = _vector_size(q)
    q, d = q.filter(usable("query_id", size)), d.filter(usable("doc_id", size))
    if at_most(q, broadcast_bytes // (8 * size + 64)):
        partial = _top_broadcast(q, d, k, threshold, metric)
    else:
        partial = _top_blocks(q, d, k, threshold, metric, block_rows or max(1, BLOCK_BYTES // (8 * max(1, size))))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _top_broadcast(q: DataFrame, d: DataFrame, k: int, floor: float, metric: str) -> DataFrame:
    local = q.toPandas()
    if local.empty:
        return d.sparkSession.createDataFrame([], _pair(q, d))
    held = d.sparkSession.sparkContext.broadcast((_ids(local["query_id"]), _matrix(local["vector"])))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q_rows = held.value
        yield from _best_of(q_ids, q_rows, batches, k, floor, metric)

    return d.mapInPandas(score, _pair(q, d))


def _top_blocks(q: DataFrame, d: DataFrame, k: int, floor: float, metric: str, block_rows: int) -> DataFrame:
    q_blocks = max(1, math.ceil(q.count() / block_rows))
    d_blocks = max(1, math.ceil(d.count() / block_rows))
    q_side = q.select(
        "*", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(d_blocks - 1)).cast("array<bigint>")).alias("db"),
    )
    d_side = d.select(
        "*", F.pmod(F.xxhash64("doc_id"), F.lit(d_blocks)).alias("db"),
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<bigint>")).alias("qb"),
    )

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [] if a.empty else [*_best_of(_ids(a["query_id"]), _matrix(a["vector"]), iter([b]), k, floor, metric)]
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "similarity": []})

    return q_side.groupBy("qb", "db").cogroup(d_side.groupBy("qb", "db")).applyInPandas(score, _pair(q, d))


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact results that a pruned search found."""
    hit = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("exact"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def tokens(text: Column) -> Column:
    """Lower-cased words of at least two characters."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)([a-zA-Z_]\w+)"), 1), F.lower)


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """term, df, total: document frequency and occurrences over all documents.

    A document's words are sorted inside its row, where the first of equal
    words marks the document; one aggregate by term then gives both numbers, and
    a term of every document is one partial row per task.
    """
    words = docs.select(F.array_sort(tokens(F.col("document"))).alias("w"))
    marked = F.transform(
        "w",
        lambda x, i: F.struct(
            x.alias("term"),
            F.when((i > 0) & F.coalesce(F.try_element_at(F.col("w"), F.when(i > 0, i).otherwise(F.lit(1))) == x, F.lit(False)), 0)
            .otherwise(1).alias("opens"),
        ),
    )
    return words.select(F.explode(marked).alias("t")).groupBy("t.term").agg(
        F.sum("t.opens").alias("df"), F.count(F.lit(1)).alias("total")
    )


def bm25(pools: DataFrame, queries: DataFrame, docs: DataFrame, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of each query against the documents of its own pool.

    ``pools(query_id, doc_id, ...)`` holds a bounded number of candidates per
    query and is read several times, so hand in a materialised one (see
    ``hybrid``); statistics are those of the pool.  Text is tokenised once per
    distinct candidate document and only query terms are carried on.
    """
    pairs = pools.select("query_id", "doc_id")
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term"))
    used = pairs.select("doc_id").distinct()
    words = docs.join(used, "doc_id", "left_semi").select("doc_id", tokens(F.col("document")).alias("w"))
    lengths = words.select("doc_id", F.size("w").alias("doc_len"))
    tf = words.select("doc_id", F.explode("w").alias("term")).groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("tf")
    )
    # Pools are bounded (2k per query), so these windows hold few rows each and
    # spare joining the statistics back.
    of_query = Window.partitionBy("query_id")
    pool = pairs.join(lengths, "doc_id").withColumns(
        {"n": F.count(F.lit(1)).over(of_query), "avgdl": F.avg("doc_len").over(of_query)}
    )
    hits = pool.join(terms, "query_id").join(tf, ["doc_id", "term"])
    scored = hits.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("query_id", "term")))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = (
        idf * F.col("tf") * (k1 + 1)
        / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.greatest(F.lit(1.0), F.col("avgdl"))))
    )
    total = scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("bm25"))
    return pairs.join(total, ["query_id", "doc_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def fuse(ranked: DataFrame, *, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of vector rank and BM25 rank inside each pool.

    ``ranked(query_id, doc_id, rank, bm25)``; BM25 ties and fused ties keep the
    vector order.
    """
    by_words = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "rank")
    out = ranked.withColumn("bm25_rank", F.row_number().over(by_words))
    out = out.withColumn("rrf", F.round(1.0 / (constant + F.col("rank")) + 1.0 / (constant + F.col("bm25_rank")), 9))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "rank")
    return out.withColumn("final_rank", F.row_number().over(by_score)).filter(F.col("final_rank") <= k)


def hybrid(queries: DataFrame, docs: DataFrame, *, k: int = 5, threshold: float = 0.5, metric: str = "cosine", pool: DataFrame | None = None) -> DataFrame:
    """Vector pool of 2k per query, BM25 in the pool, fused top k.

    ``queries(query_id, vector, query_text)``, ``docs(doc_id, vector, document)``.
    ``pool`` is the exact vector search by default; with a large knowledge base hand in
    ``vector_index.search(..., k=2 * k)``, which reads short codes instead of all vectors.
    """
    # 2k rows per query: written once, so the knowledge base is searched once.
    pool = cut_lineage(top_k(queries, docs, k=2 * k, threshold=threshold, metric=metric) if pool is None else pool)
    scored = bm25(pool, queries, docs)
    return fuse(pool.join(scored, ["query_id", "doc_id"]), k=k)


def gated(slices: DataFrame) -> DataFrame:
    """Only borderline slices ask for cases."""
    return slices.filter(F.col("ast_confidence").between(0.4, 0.7))


# --- fixed values: closing words of a retrieval query per language -----------
LANGUAGE_TAIL = {
    "c": "C programming buffer memory string",
    "python": "Python code injection deserialization",
    "java": "Java web application vulnerability",
}


def query_text(code: Column, language: Column) -> Column:
    """Search text of a function: up to three sink names, two inputs, language words."""

    def first(items: list[tuple[str, str]], n: int) -> Column:
        hits = F.array_compact(F.array(*[F.when(code.contains(needle), F.lit(shown)) for needle, shown in items]))
        return F.slice(hits, 1, n)

    def base(name: str) -> str:
        return name.split(".")[-1].rstrip("(") if "." in name else name

    out = F.lit(None)
    for lang, tail in LANGUAGE_TAIL.items():
        sinks = [(base(f), f"{f}({c})") for c, fs in rb.SINKS[lang].items() for f in fs if base(f)]
        inputs = [s for kind in ("function_calls", "objects", "variables") for s in rb.SOURCES[lang].get(kind, [])]
        found = first(sinks, 3)
        given = first([(s, s) for s in inputs], 2)
        text = F.array_join(
            F.array_compact(
                F.array(
                    F.lit(f"{lang} security vulnerability"),
                    F.when(F.size(found) > 0, F.concat(F.lit("dangerous function: "), F.array_join(found, " "))),
                    F.when(F.size(given) > 0, F.concat(F.lit("user input: "), F.array_join(given, " "))),
                    F.lit(tail),
                )
            ),
            "; ",
        )
        out = F.when(language == lang, text).otherwise(out)
    return F.coalesce(out, F.concat(language, F.lit(" security vulnerability")))


def pattern_query(category: Column, focus_cwe: Column, blind_spot_risk: Column) -> Column:
    """Case lookup text from sink category, CWE focus and blind-spot risk."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("C "), F.coalesce(category, F.lit("")), F.lit(" vulnerability")),
        F.when(F.coalesce(focus_cwe, F.lit("")) != "", focus_cwe),
        F.when(
            F.coalesce(blind_spot_risk, F.lit("")) != "",
            F.concat(F.lit("blind spot "), blind_spot_risk, F.lit(" risk")),
        ),
    )


def cases_section(ranked: DataFrame, *, cases: int = 5, chars: int = 500, rank: str = "final_rank") -> DataFrame:
    """Numbered text of the first cases of each query."""
    head = ranked.filter(F.col(rank) <= cases)
    entry = F.concat(
        F.lit("\nCase "), F.col(rank).cast("string"), F.lit(" ["), F.col("case_id"), F.lit("]:\n"),
        F.substring("document", 1, chars),
    )
    return head.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), entry.alias("t")))), lambda x: x["t"]),
            "\n",
        ).alias("cases")
    )


def few_shot(ranked: DataFrame, *, examples: int = 2, chars: int = 400, rank: str = "final_rank") -> DataFrame:
    """First same-language cases as worked examples."""
    same = ranked.filter(F.col("case_language") == F.col("language"))
    w = Window.partitionBy("query_id").orderBy(rank)
    same = same.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= examples)
    entry = F.concat(
        F.lit("Example ["), F.col("case_id"), F.lit(" — "), F.coalesce("cwe_id", F.lit("N/A")), F.lit("]:\n"),
        F.substring("document", 1, chars),
    )
    return same.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_r", entry.alias("t")))), lambda x: x["t"]), "\n---\n"
        ).alias("examples")
    )


def prompt_cases(queries: DataFrame, docs: DataFrame, *, k: int = 3, threshold: float = 0.35, chars: int = 300) -> DataFrame:
    """(query_id, cases): up to ``k`` similar documents as lines ``cwe: text`` for a prompt.

    ``docs(doc_id, vector, document, cwe_id)``; the text is cut because the
    prompt is, the search runs over everything.
    """
    hits = top_k(queries, docs, k=k, threshold=threshold)
    line = F.concat(F.coalesce("cwe_id", F.lit("")), F.lit(": "), F.substring("document", 1, chars))
    rows = hits.join(docs.select("doc_id", "document", "cwe_id"), "doc_id")
    return rows.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n").alias("cases")
    )
