"""Product-quantised inverted lists against the exact search."""

import numpy as np
import pytest

from auditlake.operators import retrieval, vector_index


def frame(spark, id_col, rows, kind="bigint"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{id_col} {kind}, vector array<double>")


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24)) * 3
    near = rng.choice(12, 1500, p=[0.4] + [0.6 / 11] * 11)  # one cell holds over a third
    data = centres[near] + rng.normal(size=(1500, 24))
    return frame(spark, "doc_id", enumerate(data)).cache(), frame(spark, "query_id", enumerate(data[::50] + 0.1)).cache()


def test_few_cells_and_few_vectors_are_read(clustered):
    docs, queries = clustered
    index = vector_index.fit(docs, cells=12, slices=8, sample_rows=600)
    codes = vector_index.indexed(docs, index).cache()
    assert codes.count() == 1500  # every row, whatever the sample
    exact = retrieval.top_k(queries, docs, k=10)
    found = vector_index.search(queries, docs, index, codes, k=10, rerank=60, probes=4)
    assert retrieval.recall_at_k(found, exact).first().recall >= 0.9
    scores = {(r.query_id, r.doc_id): r.similarity for r in exact.collect()}
    assert all(abs(scores[r.query_id, r.doc_id] - r.similarity) < 1e-6 for r in found.collect() if (r.query_id, r.doc_id) in scores)


def test_reranking_everything_is_the_exact_search(clustered):
    docs, queries = clustered
    index = vector_index.fit(docs, cells=5, slices=4)
    got = vector_index.search(queries, docs, index, k=7, rerank=1500, query_bytes=2_000)  # three blocks of queries
    want = retrieval.top_k(queries, docs, k=7)
    assert sorted((r.query_id, r.rank, r.doc_id) for r in got.collect()) == sorted((r.query_id, r.rank, r.doc_id) for r in want.collect())


def test_odd_rows(spark):
    docs = frame(spark, "doc_id", [("a", [1, 0]), ("b", [0, 0]), ("c", None), (None, [1, 1]), ("d", [1, 1, 1]), ("e", [1, float("nan")]), ("f", [1, 1]), ("f", [1, 1])], "string")
    queries = frame(spark, "query_id", [("q", [2, 0]), ("r", None)], "string")
    index = vector_index.fit(docs, cells=3, slices=2)
    got = vector_index.search(queries, docs, index, k=5, rerank=10, threshold=0.5).collect()
    assert {(r.query_id, r.doc_id) for r in got} == {("q", "a"), ("q", "f")} and got[0].similarity == 1.0
    assert vector_index.search(queries.filter("false"), docs, index, k=5).count() == 0
    assert vector_index.search(queries, docs.filter("false"), index, k=5).count() == 0
    with pytest.raises(ValueError):
        vector_index.fit(docs.filter("false"))


def test_codes_tell_near_vectors_apart_among_many(spark):
    """Unclustered vectors, as the check grows them: the first code alone finds 0.9 of the ten nearest."""
    rng = np.random.default_rng(8)
    around = rng.normal(size=(300, 64))
    data = around[rng.integers(0, 300, 6000)] + 2 * rng.normal(size=(6000, 64))
    docs, queries = frame(spark, "doc_id", enumerate(data)).cache(), frame(spark, "query_id", enumerate(data[::60]))
    index = vector_index.fit(docs, cells=16, slices=16)
    found = vector_index.search(queries, docs, index, k=10, rerank=50)
    assert retrieval.recall_at_k(found, retrieval.top_k(queries, docs, k=10)).first().recall >= 0.97


def test_copies_beyond_the_reranked_rows_tie_by_id(spark):
    rng = np.random.default_rng(9)
    data = np.vstack([rng.normal(size=(300, 8)), np.tile(rng.normal(size=8), (400, 1))])[rng.permutation(700)]
    docs = frame(spark, "doc_id", enumerate(data)).repartition(3)
    queries = frame(spark, "query_id", enumerate(data))
    index = vector_index.fit(docs, cells=4, slices=4)
    found = vector_index.search(queries, docs, index, k=10, rerank=20)
    assert retrieval.recall_at_k(found, retrieval.top_k(queries, docs, k=10)).first().recall >= 0.99
