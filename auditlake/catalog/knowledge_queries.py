"""Knowledge documents, retrieval, dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake import schemas
from auditlake.catalog import derived, sqltext as sq
from auditlake.catalog.registry import query, table
from auditlake.functions import rulebook as rb
from auditlake.operators import dependencies as dp, knowledge as kb, retrieval as rt, vector_index as vi
from auditlake.session import cut_lineage, spread
from auditlake.sources import readers

# --- feeds --------------------------------------------------------------------


def _type_sql(table_: dict[str, str], key: str) -> str:
    return sq.case_map(table_, key, "'unknown'")


_KEV = f"""
kev0 AS (SELECT json(doc)->'$.vulnerabilities[0]' AS e FROM {derived.cte(derived.EXPLOITED)} x),
kev1 AS (SELECT e->>'$.cveID' AS cve, e->>'$.vendorProject' AS vendor, e->>'$.product' AS product, e->>'$.shortDescription' AS d, CAST(e->'$.cwes' AS VARCHAR[]) AS cwes,
                e->>'$.dateAdded' AS added, e->>'$.dueDate' AS due, e->>'$.notes' AS notes FROM kev0),
kev AS (SELECT 'kev_' || cve AS id, 'kev_vuln' AS type,
   '[ACTIVELY EXPLOITED IN THE WILD]' || chr(10) || 'CVE: ' || cve || chr(10) || 'Vendor: ' || vendor || chr(10) || 'Product: ' || product || chr(10)
   || 'CWE: ' || CASE WHEN len(cwes) = 0 THEN 'N/A' ELSE array_to_string(cwes, ', ') END || chr(10) || 'Added to KEV: ' || added || chr(10) || 'Remediation due: ' || due || chr(10)
   || chr(10) || 'Description:' || chr(10) || d || CASE WHEN notes = '' THEN '' ELSE chr(10) || chr(10) || 'Notes:' || chr(10) || notes END AS document,
   cve AS cve_id, CASE WHEN len(cwes) = 0 THEN 'N/A' ELSE array_to_string(cwes, ', ') END AS cwe_id, {_type_sql(rb.TYPE_BY_CWE_FEED, "cwes[1]")} AS vuln_type,
   'cisa_kev' AS source, true AS exploited, NULL::DOUBLE AS cvss_score, added AS published FROM kev1 WHERE trim(cve) <> '')"""

_NVD = f"""
nvd0 AS (SELECT json(doc)->'$.vulnerabilities[0].cve' AS c FROM {derived.cte(derived.FEED)} x),
nvd1 AS (SELECT c->>'$.id' AS cve, c->>'$.published' AS published, c->>'$.vulnStatus' AS status,
   CASE WHEN c->>'$.descriptions[1].lang' = 'en' THEN c->>'$.descriptions[1].value' ELSE c->>'$.descriptions[0].value' END AS d,
   list_filter([c->>'$.weaknesses[0].description[0].value', c->>'$.weaknesses[1].description[0].value', c->>'$.weaknesses[1].description[1].value', c->>'$.weaknesses[1].description[2].value'],
               lambda x: starts_with(x, 'CWE-')) AS ids,
   coalesce(c->'$.metrics.cvssMetricV31[0].cvssData', c->'$.metrics.cvssMetricV30[0].cvssData') AS m FROM nvd0),
nvd AS (SELECT 'nvd_' || cve AS id, 'nvd_cve' AS type,
   'CVE: ' || cve || chr(10) || 'CWE: ' || CASE WHEN len(ids) = 0 THEN 'N/A' ELSE array_to_string(ids[1:3], ', ') END || chr(10)
   || 'Severity: ' || coalesce(m->>'$.baseSeverity', '') || ' (' || coalesce(m->>'$.baseScore', '') || ')' || chr(10) || 'Status: ' || status || chr(10) || 'Published: ' || published || chr(10)
   || chr(10) || 'Description:' || chr(10) || d AS document, cve AS cve_id, CASE WHEN len(ids) = 0 THEN 'N/A' ELSE array_to_string(ids[1:3], ', ') END AS cwe_id,
   {_type_sql(rb.TYPE_BY_CWE_FEED, "ids[1]")} AS vuln_type, 'nvd' AS source, false AS exploited, CAST(m->>'$.baseScore' AS DOUBLE) AS cvss_score, published FROM nvd1)"""

_CVE = f"""
cve0 AS (SELECT *, row_number() OVER (PARTITION BY trim(cve_id) ORDER BY row_ord) AS rn FROM {derived.cte(derived.CVE_ROWS)} x WHERE starts_with(trim(cve_id), 'CVE-') AND length(trim(summary)) >= 30),
cve1 AS (SELECT cve_id, CASE WHEN cwe_id = '' THEN 'N/A' ELSE cwe_id END AS cwe, CASE WHEN project = '' THEN 'unknown' ELSE project END AS project, CASE WHEN lang = '' THEN 'c' ELSE lang END AS lang,
                score, publish_date, summary FROM cve0 WHERE rn = 1),
cve AS (SELECT 'bigvul_' || cve_id AS id, 'bigvul_case' AS type,
   'CVE: ' || cve_id || chr(10) || 'CWE: ' || cwe || chr(10) || 'Language: ' || lang || chr(10) || 'Project: ' || project || chr(10)
   || CASE WHEN score <> '' THEN 'CVSS: ' || score || chr(10) ELSE '' END || CASE WHEN publish_date <> '' THEN 'Published: ' || publish_date || chr(10) ELSE '' END
   || chr(10) || 'Description:' || chr(10) || summary AS document, cve_id, cwe AS cwe_id, {_type_sql(rb.TYPE_BY_CWE_LABELLED, "cwe")} AS vuln_type,
   project AS source, false AS exploited, TRY_CAST(score AS DOUBLE) AS cvss_score, publish_date AS published FROM cve1)"""

_DOC_COLS = "id, type, document, cve_id, cwe_id, vuln_type, source, exploited, cvss_score, published"
_DOC_LIST = [c.strip() for c in _DOC_COLS.split(",")]


def _exploited(spark, sf):
    rows = derived.derive(spark, sf, derived.EXPLOITED)
    entries = rows.select(F.from_json("doc", schemas.EXPLOITED_CATALOGUE).alias("j")).select(F.explode("j.vulnerabilities").alias("e"))
    return kb.exploited_documents(entries.select("e.*"))


def _feed(spark, sf):
    rows = derived.derive(spark, sf, derived.FEED)
    entries = rows.select(F.from_json("doc", schemas.CVE_FEED).alias("j")).select(F.explode("j.vulnerabilities").alias("e"))
    return kb.feed_documents(entries.select("e.cve"))


def _cve(spark, sf):
    return kb.labelled_cve_documents(derived.derive(spark, sf, derived.CVE_ROWS), order="row_ord")


@query("exploited_documents", f"WITH {_KEV} SELECT {_DOC_COLS} FROM kev")
def exploited_documents(spark, sf):
    return _exploited(spark, sf).select(*_DOC_LIST)


@query("feed_documents", f"WITH {_NVD} SELECT {_DOC_COLS} FROM nvd")
def feed_documents(spark, sf):
    return _feed(spark, sf).select(*_DOC_LIST)


@query("labelled_cve_documents", f"WITH {_CVE} SELECT {_DOC_COLS} FROM cve")
def labelled_cve_documents(spark, sf):
    return _cve(spark, sf).select(*_DOC_LIST)


@query(
    "cwe_documents",
    f"""
SELECT 'CWE-' || p_size AS id, 'CWE: ' || p_name || chr(10) || 'Description: about ' || p_brand || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Mitigation: check ' || p_type ELSE '' END AS document,
       {_type_sql(rb.TYPE_BY_CWE_FEED, "'CWE-' || p_size")} AS vuln_type FROM part""",
)
def cwe_documents(spark, sf):
    p = table(spark, sf, "part").select(
        F.concat(F.lit("CWE-"), "p_size").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("about "), "p_brand").alias("description"),
        F.lit("c").alias("language"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("check "), "p_type")).alias("mitigation"),
    )
    return kb.cwe_documents(p).select("id", "document", "vuln_type")


@query(
    "knowledge_base",
    f"""WITH {_KEV}, {_NVD}, {_CVE}, alldocs AS (SELECT {_DOC_COLS} FROM kev UNION ALL SELECT {_DOC_COLS} FROM nvd UNION ALL SELECT {_DOC_COLS} FROM cve)
SELECT type, vuln_type, exploited, count(*) AS docs, CAST(sum(length(document)) AS BIGINT) AS chars, round(avg(cvss_score), 6) AS mean_cvss FROM alldocs WHERE id <> '' GROUP BY ALL""",
)
def knowledge_base(spark, sf):
    docs = kb.build(_exploited(spark, sf), _feed(spark, sf), _cve(spark, sf))
    return docs.groupBy("type", "vuln_type", "exploited").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length("document")).alias("chars"), F.round(F.avg("cvss_score"), 6).alias("mean_cvss")
    )


# --- retrieval: documents with their vectors are the knowledge base, benchmark
# --- items with the vector of the same number are the queries -------------------

_COS = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query(
    "topk_cosine",
    f"""
WITH n AS (SELECT vec_id, embedding, sqrt({_COS.format(a="embedding", b="embedding")}) AS norm FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {_COS.format(a="a.embedding", b="b.embedding")} / (a.norm * b.norm) AS sim FROM n a CROSS JOIN n b)
SELECT query_id, doc_id, round(sim, 4) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, doc_id) AS rank FROM s) x WHERE rank <= 5""",
)
def topk_cosine(spark, sf):
    e = spread(table(spark, sf, "embeddings"))
    out = rt.top_k(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), k=5)
    return out.select("query_id", "doc_id", F.round("similarity", 4).alias("similarity"), "rank")


_POOL = f"""
kbv AS (SELECT d.doc_id, d.text AS document, d.lang, e.embedding, sqrt({_COS.format(a="e.embedding", b="e.embedding")}) AS norm FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)),
q AS (SELECT b.item_id AS query_id, b.text AS query_text, e.embedding, sqrt({_COS.format(a="e.embedding", b="e.embedding")}) AS norm FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
s AS (SELECT q.query_id, k.doc_id, round({_COS.format(a="q.embedding", b="k.embedding")} / (q.norm * k.norm), 9) AS sim FROM q CROSS JOIN kbv k),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM s WHERE sim >= 0.0) x WHERE rank <= 10),
docterms AS (SELECT doc_id, [lower(w) FOR w IN regexp_extract_all(document, '[a-zA-Z_][\\p{{L}}\\p{{N}}\\p{{M}}_]+')] AS w FROM kbv WHERE doc_id IN (SELECT doc_id FROM pool)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docterms) x GROUP BY ALL),
qt AS (SELECT DISTINCT query_id, lower(t) AS term FROM (SELECT query_id, unnest(regexp_extract_all(query_text, '[a-zA-Z_][\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS t FROM q) x),
st AS (SELECT p.query_id, count(*) AS n, avg(len(d.w)) AS avgdl FROM pool p JOIN docterms d ON d.doc_id = p.doc_id GROUP BY p.query_id),
hits AS (SELECT p.query_id, p.doc_id, t.term, t.tf, len(d.w) AS dl FROM pool p JOIN docterms d ON d.doc_id = p.doc_id JOIN qt ON qt.query_id = p.query_id JOIN tf t ON t.doc_id = p.doc_id AND t.term = qt.term),
df AS (SELECT query_id, term, count(*) AS df FROM hits GROUP BY ALL),
bm AS (SELECT p.query_id, p.doc_id, p.rank, p.sim, round(coalesce(sum(ln((st.n - df.df + 0.5) / (df.df + 0.5) + 1.0) * h.tf * 2.2::DOUBLE / (h.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * h.dl / greatest(1.0, st.avgdl)))), 0.0), 6) AS bm25
       FROM pool p LEFT JOIN hits h ON h.query_id = p.query_id AND h.doc_id = p.doc_id LEFT JOIN df ON df.query_id = h.query_id AND df.term = h.term LEFT JOIN st ON st.query_id = p.query_id
       GROUP BY p.query_id, p.doc_id, p.rank, p.sim)"""
_RRF = f"""{_POOL},
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, rank) AS bm25_rank FROM bm),
rr AS (SELECT *, round(1.0::DOUBLE / (60 + rank) + 1.0::DOUBLE / (60 + bm25_rank), 9) AS rrf FROM br),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, rank) AS final_rank FROM rr) x WHERE final_rank <= 5)"""


def _kb(spark, sf):
    """Every document with a vector; vectors are dealt out in turn, for there are fewer of them."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    d = spread(table(spark, sf, "documents")).select("doc_id", F.col("text").alias("document"), "lang")
    return d.withColumn("vec_id", F.col("doc_id") % e.count()).join(e, "vec_id").drop("vec_id")


def _items(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return b.join(e, "query_id")


def _pruned(spark, sf):
    """A query in twenty against every vector by codes of 16 bytes and 16 for what they leave, 50 whole vectors per query; and the exact ten nearest."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = e.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    index = vi.fit(e, cells=16, slices=16)
    codes = cut_lineage(vi.indexed(e, index))
    read = vi.candidates(q, codes, index, probes=16, rerank=50).count()
    return e, codes, read, rt.recall_at_k(vi.search(q, e, index, codes, k=10, rerank=50), rt.top_k(q, e, k=10))


@query(
    "topk_recall",
    """WITH n AS (SELECT count(*) AS vectors, count(*) FILTER (vec_id % 20 = 0) AS queries FROM embeddings)
SELECT queries, queries * 10 AS exact, true AS reaches_0_9, vectors AS indexed, queries * least(50, vectors) AS vectors_read, least(50, vectors) * 4 <= vectors AS at_most_a_quarter FROM n""",
)
def topk_recall(spark, sf):
    """Pruned search over every vector against the exact one: recall of the ten nearest, and how many whole vectors it read."""
    e, codes, read, recall = _pruned(spark, sf)
    n = e.count()
    return recall.select(
        "queries", "exact", (F.col("recall") >= 0.9).alias("reaches_0_9"), F.lit(codes.count()).cast("long").alias("indexed"),
        F.lit(read).cast("long").alias("vectors_read"), (F.lit(read) * 4 <= F.col("queries") * n).alias("at_most_a_quarter"),
    )


@query(
    "topk_pruned_figures",
    """WITH n AS (SELECT count(*) AS vectors, count(*) FILTER (vec_id % 20 = 0) AS queries FROM embeddings)
SELECT queries, 1.0::DOUBLE AS recall, round(least(50, vectors) / vectors, 6) AS share_read FROM n""",
)
def topk_pruned_figures(spark, sf):
    """The figures behind ``topk_recall``: recall to a tenth, and the share of query-vector pairs whose whole vector was read."""
    e, _, read, recall = _pruned(spark, sf)
    share = F.round(F.lit(read) / (F.col("queries") * e.count()), 6)
    return recall.select("queries", F.round("recall", 1).alias("recall"), share.alias("share_read"))


@query(
    "topk_blocks",
    f"""
WITH n AS (SELECT vec_id, embedding, sqrt({_COS.format(a="embedding", b="embedding")}) AS norm FROM embeddings),
s AS (SELECT concat('q', a.vec_id) AS query_id, concat('d', b.vec_id) AS doc_id, round({_COS.format(a="a.embedding", b="b.embedding")} / (a.norm * b.norm), 9) AS sim FROM n a CROSS JOIN n b WHERE a.vec_id % 20 = 0)
SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM s) x WHERE rank <= 5""",
)
def topk_blocks(spark, sf):
    """The exact way for many queries, with text ids."""
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "vec_id")
    q = e.filter("vec_id % 20 = 0").select(F.concat(F.lit("q"), "vec_id").alias("query_id"), "vector")
    return rt.top_k(q, e, k=5, broadcast_bytes=0, block_rows=300).select("query_id", "doc_id", "rank")


@query("bm25_pool", f"WITH {_POOL} SELECT query_id, doc_id, rank, round(bm25, 4) AS bm25 FROM bm")
def bm25_pool(spark, sf):
    q, d = _items(spark, sf), _kb(spark, sf)
    pool = cut_lineage(rt.top_k(q, d, k=10, threshold=0.0))
    return pool.join(rt.bm25(pool, q, d), ["query_id", "doc_id"]).select("query_id", "doc_id", "rank", F.round("bm25", 4).alias("bm25"))


@query("hybrid_retrieval", f"WITH {_RRF} SELECT query_id, doc_id, final_rank, bm25_rank, rank, round(rrf, 6) AS rrf FROM fused")
def hybrid_retrieval(spark, sf):
    out = rt.hybrid(_items(spark, sf), _kb(spark, sf), k=5, threshold=0.0)
    return out.select("query_id", "doc_id", "final_rank", "bm25_rank", "rank", F.round("rrf", 6).alias("rrf"))


@query("hybrid_pruned", "SELECT count(*) AS queries, true AS same_nine_in_ten FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)")
def hybrid_pruned(spark, sf):
    """Hybrid retrieval whose pool comes from the codes, against the exact one: the same cases."""
    q, d = _items(spark, sf), _kb(spark, sf)
    pool = vi.search(q, d, vi.fit(d, cells=16, slices=16), k=10, rerank=200, threshold=0.0)
    found, exact = (rt.hybrid(q, d, k=5, threshold=0.0, pool=p) for p in (pool, None))
    out = rt.recall_at_k(found, exact)
    return out.select("queries", (F.col("recall") >= 0.9).alias("same_nine_in_ten"))


@query(
    "cases_section",
    f"""WITH {_RRF}
SELECT f.query_id, string_agg(chr(10) || 'Case ' || f.final_rank || ' [doc' || f.doc_id || ']:' || chr(10) || substr(k.document, 1, 500), chr(10) ORDER BY f.final_rank) AS cases
FROM fused f JOIN kbv k ON k.doc_id = f.doc_id WHERE f.final_rank <= 3 GROUP BY f.query_id""",
)
def cases_section(spark, sf):
    kb_ = _kb(spark, sf)
    ranked = rt.hybrid(_items(spark, sf), kb_, k=5, threshold=0.0)
    texts = ranked.join(kb_.select("doc_id", "document"), "doc_id").withColumn("case_id", F.concat(F.lit("doc"), "doc_id"))
    return rt.cases_section(texts, cases=3)


@query(
    "few_shot_examples",
    f"""WITH {_RRF},
c AS (SELECT f.query_id, f.doc_id, f.final_rank, k.document, row_number() OVER (PARTITION BY f.query_id ORDER BY f.final_rank) AS r FROM fused f JOIN kbv k ON k.doc_id = f.doc_id
      JOIN documents o ON o.doc_id = f.query_id WHERE o.lang = k.lang)
SELECT query_id, string_agg('Example [doc' || doc_id || ' — N/A]:' || chr(10) || substr(document, 1, 400), chr(10) || '---' || chr(10) ORDER BY r) AS examples FROM c WHERE r <= 2 GROUP BY query_id""",
)
def few_shot_examples(spark, sf):
    kb_ = _kb(spark, sf)
    ranked = rt.hybrid(_items(spark, sf), kb_, k=5, threshold=0.0)
    own = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("language"))
    rows = ranked.join(kb_.select("doc_id", "document", F.col("lang").alias("case_language")), "doc_id").join(own, "query_id")
    rows = rows.withColumns({"case_id": F.concat(F.lit("doc"), "doc_id"), "cwe_id": F.lit(None).cast("string")})
    return rt.few_shot(rows)


@query(
    "corpus_statistics",
    """
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest([lower(w) FOR w IN regexp_extract_all(text, '[a-zA-Z_][\\p{L}\\p{N}\\p{M}_]+')]) AS term FROM documents) x GROUP BY ALL) y GROUP BY term""",
)
def corpus_statistics(spark, sf):
    return rt.corpus_statistics(spread(table(spark, sf, "documents")).select("doc_id", F.col("text").alias("document")))


# --- dependencies -------------------------------------------------------------------

_DEPS = f"deps AS {derived.cte(derived.DEPENDENCIES)}"
_BEFORE_SQL = "'^v?[0-9]+(?:[._-][0-9]+)*[._-]?(dev|alpha|a|beta|b|m|preview|pre|rc)[._-]?([0-9]*)'"
_KEYSQL = (
    "(array_to_string([lpad(x, 20, '0') FOR x IN regexp_split_to_array(regexp_replace(regexp_extract(lower({v}), '^v?([0-9]+(?:[._-][0-9]+)*)', 1), '([._-]0+)+$', ''), '[._-]')], '.')"
    " || CASE regexp_extract(lower({v}), " + _BEFORE_SQL + ", 1) WHEN '' THEN '-' ELSE '!' || CASE regexp_extract(lower({v}), " + _BEFORE_SQL + ", 1)"
    " WHEN 'dev' THEN '1' WHEN 'alpha' THEN '2' WHEN 'a' THEN '2' WHEN 'beta' THEN '3' WHEN 'b' THEN '3' WHEN 'm' THEN '4' WHEN 'rc' THEN '6' ELSE '5' END"
    " || lpad(regexp_extract(lower({v}), " + _BEFORE_SQL + ", 2), 20, '0') END)"
)
_NUM = "regexp_matches(lower({v}), '^v?[0-9]{{1,20}}([._-][0-9]{{1,20}})*([._-]?(dev|alpha|a|beta|b|m|preview|pre|rc)[._-]?[0-9]{{0,20}})?([+].*)?$')"
_ADV = f"""
adv0 AS (SELECT json(doc) AS j FROM {derived.cte(derived.ADVISORIES)} x),
adv AS (SELECT j->>'$.id' AS id, coalesce(j->>'$.aliases[0]', j->>'$.id') AS cve_id, substr(coalesce(j->>'$.summary', ''), 1, 200) AS summary,
   coalesce(j->>'$.database_specific.severity', 'UNKNOWN') AS severity, j->>'$.severity[1].score' AS cvss_score, coalesce(j->>'$.affected[0].ranges[0].events[0].fixed', j->>'$.affected[0].ranges[0].events[1].fixed', '') AS fixed_version,
   coalesce(j->>'$.references[0].url', '') AS url, j->>'$.affected[0].package.name' AS name, j->>'$.affected[0].package.ecosystem' AS ecosystem, j FROM adv0),
ranges AS (SELECT id, ecosystem, name, CASE WHEN j->>'$.affected[0].ranges[0].events[0].fixed' IS NULL THEN j->>'$.affected[0].ranges[0].events[0].introduced' ELSE j->>'$.affected[0].ranges[0].events[2].introduced' END AS introduced, fixed_version AS fixed FROM adv
           UNION ALL SELECT id, ecosystem, name, '5.10', NULL FROM adv WHERE NOT fixed_version LIKE '%post%'),
listed AS (SELECT id, ecosystem, name, j->>'$.affected[0].versions[0]' AS version FROM adv),
hits0 AS (
  SELECT d.ecosystem, d.name, d.version, r.id, CASE WHEN r.fixed LIKE '%post%' OR NOT {_NUM.format(v="d.version")} THEN 'unknown'
    WHEN {_KEYSQL.format(v="d.version")} >= {_KEYSQL.format(v="r.introduced")} AND (r.fixed IS NULL OR {_KEYSQL.format(v="d.version")} < {_KEYSQL.format(v="r.fixed")}) THEN 'affected' END AS status
  FROM deps d JOIN ranges r ON r.ecosystem = d.ecosystem AND r.name = d.name
  UNION ALL SELECT d.ecosystem, d.name, d.version, l.id, 'affected' FROM deps d JOIN listed l ON l.ecosystem = d.ecosystem AND l.name = d.name AND (l.version = d.version OR {_NUM.format(v="l.version")} AND {_NUM.format(v="d.version")} AND {_KEYSQL.format(v="l.version")} = {_KEYSQL.format(v="d.version")})),
hits AS (SELECT ecosystem, name, version, id, min(status) AS status FROM hits0 WHERE status IS NOT NULL GROUP BY ALL)"""


def _dependencies(spark, sf):
    return derived.derive(spark, sf, derived.DEPENDENCIES)


def _advisories(spark, sf):
    rows = derived.derive(spark, sf, derived.ADVISORIES)
    return rows.select(F.from_json("doc", schemas.ADVISORY).alias("a")).select("a.*")


@query("advisory_fields", f"WITH {_DEPS}, {_ADV} SELECT id, cve_id, summary, severity, cvss_score, fixed_version, url FROM adv")
def advisory_fields(spark, sf):
    return dp.flatten_advisories(_advisories(spark, sf))


@query("version_range_join", f"WITH {_DEPS}, {_ADV} SELECT * FROM hits")
def version_range_join(spark, sf):
    a = _advisories(spark, sf)
    return dp.match(_dependencies(spark, sf), dp.rules(a))


@query(
    "dependency_audit",
    f"""WITH {_DEPS}, {_ADV}
SELECT d.project, d.name, d.version, d.ecosystem, a.cve_id, a.severity, a.cvss_score, a.fixed_version, a.url, {_NUM.format(v="d.version")} AS version_comparable, h.status
FROM deps d JOIN hits h ON h.ecosystem = d.ecosystem AND h.name = d.name AND h.version = d.version JOIN adv a ON a.id = h.id""",
)
def dependency_audit(spark, sf):
    return dp.audit(_dependencies(spark, sf), _advisories(spark, sf)).select(
        "project", "name", "version", "ecosystem", "cve_id", "severity", "cvss_score", "fixed_version", "url", "version_comparable", "status"
    )


@query(
    "advisories_per_package",
    f"WITH {_DEPS}, {_ADV} SELECT ecosystem, name, count(DISTINCT id) AS advisories, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hits GROUP BY ecosystem, name",
)
def advisories_per_package(spark, sf):
    a = _advisories(spark, sf)
    hits = dp.match(_dependencies(spark, sf), dp.rules(a))
    return dp.hits_per_package(hits).withColumn("ids", F.array_join("ids", ","))


@query(
    "version_order",
    f"""WITH {_DEPS}
SELECT version, {_NUM.format(v="version")} AS comparable, CASE WHEN {_NUM.format(v="version")} THEN {_KEYSQL.format(v="version")} END AS version_key, count(*) AS uses FROM deps GROUP BY ALL""",
)
def version_order(spark, sf):
    d = _dependencies(spark, sf).groupBy("version").agg(F.count(F.lit(1)).alias("uses"))
    ok = dp.comparable(F.col("version"))
    return d.select("version", ok.alias("comparable"), F.when(ok, dp.version_key(F.col("version"))).alias("version_key"), "uses")


@query(
    "ttl_split",
    """
WITH e AS (SELECT user_id || ':' || event_type AS key, ts FROM events),
seen AS (SELECT key, bool_or(ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '2024-01-20 00:00:00') AS fresh FROM e GROUP BY key)
SELECT CASE WHEN s.fresh THEN 'hit' ELSE 'miss' END AS outcome, count(*) AS requests, count(DISTINCT e.key) AS keys FROM e JOIN seen s ON s.key = e.key GROUP BY 1""",
)
def ttl_split(spark, sf):
    """Requests answered by a cache entry of the last 24 hours, and the others."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    e = table(spark, sf, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), "ts")
    cache = e.filter(F.col("ts") <= now).withColumnRenamed("ts", "cached_at")
    marked = dp.marked_by_cache(e, cache, now).withColumn("outcome", F.when(F.col("fresh"), "hit").otherwise("miss"))
    per_key = marked.groupBy("outcome", "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("outcome").agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("keys"))


@query(
    "newest_cache_entry",
    """
SELECT key, event_id, value FROM (SELECT user_id || ':' || event_type AS key, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1""",
)
def newest_cache_entry(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("ts").alias("cached_at"), F.col("event_id").alias("payload"), "value"
    )
    return dp.newest_entry(e).select("key", F.col("payload").alias("event_id"), "value")


# Manifest lines: one line item is one line of a requirements file.
_LINES = """
SELECT l_orderkey AS project, l_linenumber AS line_no,
       CASE l_suppkey % 8 WHEN 0 THEN concat('# pkg', l_partkey, '==1.0') WHEN 1 THEN '' WHEN 2 THEN concat('pkg', l_partkey) WHEN 3 THEN concat('pkg', l_partkey, ' >= ', l_linenumber, '.0,<9')
            WHEN 4 THEN concat('pkg', l_partkey, '~=', l_linenumber) WHEN 5 THEN '-r base.txt' WHEN 6 THEN concat('  pkg', l_partkey, ' != 2 ') ELSE concat('pkg', l_partkey, '==', l_linenumber, '.1') END AS value
FROM {lineitem}
"""


@query(
    "requirement_lines",
    f"""
WITH l AS (SELECT project, line_no, trim(value) AS t FROM {derived.cte(_LINES)} x),
s AS (SELECT *, CASE WHEN contains(t, '==') THEN '==' WHEN contains(t, '>=') THEN '>=' WHEN contains(t, '<=') THEN '<=' WHEN contains(t, '~=') THEN '~=' WHEN contains(t, '!=') THEN '!=' WHEN contains(t, '>') THEN '>' END AS sep
      FROM l WHERE t <> '' AND NOT starts_with(t, '#') AND NOT starts_with(t, '-'))
SELECT project, line_no, trim(substr(t, 1, instr(t, sep) - 1)) AS name, trim(substr(t, instr(t, sep) + length(sep))) AS version, 'PyPI' AS ecosystem FROM s WHERE sep IS NOT NULL""",
)
def requirement_lines(spark, sf):
    return readers.requirement_lines(derived.derive(spark, sf, _LINES))


_SETUP = f"""
SELECT o_orderkey AS project, {derived.text("install_requires={'lib")} || o_custkey || {derived.text("': " + chr(34))} || (o_custkey % 9)
  || {derived.text(".1" + chr(34) + ", " + chr(34) + "other" + chr(34) + " >= '2'}")} AS content FROM {{orders}}
"""
_POM = f"""
SELECT o_orderkey AS project, {derived.text("<project><properties><v.a>")} || (o_custkey % 9) || {derived.text(".0</v.a><v.a>")} || (o_custkey % 9) || {derived.text(".5</v.a></properties>")}
  || {derived.text("<dependency>" + chr(10) + " <groupId>org.g")} || (o_custkey % 7) || {derived.text("</groupId><artifactId>a</artifactId><version>${v.a}</version></dependency>")}
  || {derived.text("<dependency><groupId>org.h</groupId><artifactId>b</artifactId><version>")} || (o_custkey % 5) || {derived.text(".2</version></dependency>")}
  || {derived.text("<dependency><groupId>org.k</groupId><artifactId>c</artifactId><version>${no.such}</version></dependency></project>")} AS content FROM {{orders}}
"""


@query(
    "setup_pairs",
    "SELECT o_orderkey AS project, unnest(['lib' || o_custkey, 'other']) AS name, unnest([(o_custkey % 9) || '.1', '2']) AS version FROM orders",
)
def setup_pairs(spark, sf):
    return readers.setup_pairs(derived.derive(spark, sf, _SETUP)).select("project", "name", "version")


@query(
    "pom_dependencies",
    "SELECT o_orderkey AS project, unnest(['org.g' || (o_custkey % 7) || ':a', 'org.h:b', 'org.k:c']) AS name, unnest([(o_custkey % 9) || '.5', (o_custkey % 5) || '.2', 'no.such']) AS version, 'Maven' AS ecosystem FROM orders",
)
def pom_dependencies(spark, sf):
    return readers.pom_dependencies(derived.derive(spark, sf, _POM))


@query(
    "prompt_cases",
    f"""WITH {_POOL},
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS r FROM s WHERE sim >= 0.05) x WHERE r <= 3)
SELECT n.query_id, string_agg(k.lang || ': ' || substr(k.document, 1, 300), chr(10) ORDER BY n.r) AS cases FROM near n JOIN kbv k ON k.doc_id = n.doc_id GROUP BY n.query_id""",
)
def prompt_cases(spark, sf):
    return rt.prompt_cases(_items(spark, sf), _kb(spark, sf).withColumnRenamed("lang", "cwe_id"), threshold=0.05)
