"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from assetloom.llm.bpe import op2_byte_bpe
from assetloom.llm.fim import op13_fill_in_middle
from assetloom.llm.fingerprints import op5_document_fingerprints
from assetloom.llm.jaccard import op8_jaccard_join
from assetloom.llm.langid import op7_language_id
from assetloom.llm.media import op4_media_columns
from assetloom.llm.negatives import op12_hard_negatives
from assetloom.llm.packing import op9_best_fit_packing
from assetloom.llm.quality import op10_quality_classifier
from assetloom.llm.repeats import op11_substring_dedup
from assetloom.llm.secrets import op6_secret_scan
from assetloom.llm.toolcalls import op1_tool_calls
from assetloom.llm.urls import op3_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_tool_calls,
        op2_byte_bpe,
        op3_url_filters,
        op4_media_columns,
        op5_document_fingerprints,
        op6_secret_scan,
        op7_language_id,
        op8_jaccard_join,
        op9_best_fit_packing,
        op10_quality_classifier,
        op11_substring_dedup,
        op12_hard_negatives,
        op13_fill_in_middle,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
SQL: dict[str, str] = {
    "op1_tool_calls": r"""WITH u AS (SELECT *, conv_id || ':' || turn AS call_id, coalesce(text, '') AS q, len(regexp_split_to_array(trim(coalesce(text, '')), '\s+')) AS words FROM conversations WHERE role = 'user'),
      ids AS (SELECT DISTINCT conv_id, turn, call_id FROM u WHERE call_id IS NOT NULL),
      runs AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM ids),
      levels AS (SELECT call_id, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level FROM runs),
      a AS (SELECT call_id, arg_min(content, k) AS content FROM (SELECT conv_id || ':' || (turn - 1) AS call_id, struct_pack(a := turn, b := coalesce(text, '')) AS k, struct_pack(t := text) AS content FROM conversations WHERE role = 'assistant') WHERE call_id IS NOT NULL GROUP BY 1),
      c AS (SELECT u.*, l.level, a.content, CASE WHEN u.turn >= 2 AND p.call_id IS NULL THEN 1 ELSE 0 END AS needs_missing,
          concat_ws('; ', CASE WHEN q = '' THEN '$.question: too short' END, CASE WHEN u.turn < 0 THEN '$.turn: too small' END, CASE WHEN words < 3 THEN '$.words: too small' END) AS errors
        FROM u LEFT JOIN levels l ON l.call_id = u.call_id LEFT JOIN a ON a.call_id = u.call_id LEFT JOIN ids p ON p.conv_id = u.conv_id AND p.turn = u.turn - 2)
      SELECT conv_id, turn, call_id, 'reply' AS name, CAST(level AS BIGINT) AS level, CAST(needs_missing AS BIGINT) AS needs_missing, content IS NOT NULL AS linked, errors = '' AS valid, errors,
        '{"arguments":{"question":' || to_json(q) || ',"turn":' || turn || ',"words":' || words || '},"id":' || to_json(call_id) || ',"name":"reply","result":' || coalesce(CAST(to_json(content.t) AS VARCHAR), 'null') || '}' AS json
      FROM c""",
    "op8_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
      s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
      l AS (SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * p.both >= 85 * (a.n + b.n - p.both)),
      r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
      SELECT r.x AS doc_id, CAST(coalesce(min(n.n), 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id, CAST((SELECT count(*) FROM l WHERE l.x = r.x) AS BIGINT) AS n_links FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY 1""",
    "op11_substring_dedup": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
      g AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
      t AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS s FROM g),
      c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM t WHERE s IN (SELECT s FROM t GROUP BY s HAVING count(*) > 1)),
      e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
      k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN c USING (doc_id, i) GROUP BY 1)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op12_hard_negatives": r"""WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
  p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5)
  SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
    FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score) WHERE rank <= 5""",
}
