"""Registered queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.contamination import op3_benchmark_decontamination
from tallyloom.llm.lm_scoring import op6_lm_scoring
from tallyloom.llm.near_dedup import op7_minhash_near_dedup
from tallyloom.llm.packing import op10_best_fit_packing
from tallyloom.llm.pages import op8_html_extraction
from tallyloom.llm.personal import op13_personal_data
from tallyloom.llm.quality import op5_quality_classifier
from tallyloom.llm.substring_dedup import op1_substring_dedup
from tallyloom.llm.token_counts import op2_token_counts
from tallyloom.llm.vector_codes import op12_vector_code_compression
from tallyloom.llm.vector_dedup import op9_embedding_near_dedup
from tallyloom.llm.warc import op4_warc_derivatives
from tallyloom.llm.whitening import op11_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_token_counts,
        op3_benchmark_decontamination,
        op4_warc_derivatives,
        op5_quality_classifier,
        op6_lm_scoring,
        op7_minhash_near_dedup,
        op8_html_extraction,
        op9_embedding_near_dedup,
        op10_best_fit_packing,
        op11_embedding_whitening,
        op12_vector_code_compression,
        op13_personal_data,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

#: Token counts, page text, model scores, span removal, packing, the classifier, eigenvectors, codebooks and check digits
#: are beyond SQL; their tests hold them against the libraries, brute force or known answers.
ORACLES: dict[str, str] = {
    "op3_benchmark_decontamination": rf"""WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
        docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents), lengths AS (SELECT DISTINCT n FROM windows),
        grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
        found AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, k)),
        hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id""",
    "op7_minhash_near_dedup": rf"""WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, coalesce({_TOKENS}, []) AS w FROM documents),
        sets AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
        sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS joint FROM sets x JOIN sets y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN sizes s ON a = s.doc_id JOIN sizes t ON b = t.doc_id WHERE 100 * joint >= 75 * (s.n + t.n - joint)),
        reach AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON node = a),
        least AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM docs d JOIN least l ON d.doc_id = l.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id""",
    "op9_embedding_near_dedup": """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (SELECT vec_id, vec_id AS node FROM embeddings UNION SELECT reach.vec_id, b FROM reach JOIN links ON node = a), least AS (SELECT vec_id, min(node) AS component_id FROM reach GROUP BY vec_id)
        SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN least l ON e.vec_id = l.vec_id""",
}
