"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from slotwise.llm import line_quality

LINE_QUALITY = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT row_id, doc_id, source, text,
         regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM docs
), placed AS (
  SELECT row_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM words
), windows AS (
  SELECT row_id, pos, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c
  FROM placed WINDOW w AS (PARTITION BY row_id ORDER BY pos)
), again AS (
  SELECT row_id, pos FROM windows WHERE c IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY row_id, a, b, c) > 1
), repeated AS (
  SELECT row_id, count(DISTINCT pos + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS t(k) GROUP BY row_id
), lines AS (
  SELECT row_id, source, text, unnest(lines) AS raw FROM words
), normal AS (
  SELECT row_id, source, text, len(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+')) AS n,
         lower(regexp_replace(trim(regexp_replace(raw, '[\\x20\\x09-\\x0D]+', ' ', 'g')), '[0-9]', '0', 'g')) AS line
  FROM lines
), frequent AS (
  SELECT source, line FROM normal GROUP BY source, line HAVING count(DISTINCT text) > {line_quality.MAX_DOCUMENTS}
), removed AS (
  SELECT n.row_id, sum(n.n) AS removed_words
  FROM normal n JOIN frequent f ON n.source IS NOT DISTINCT FROM f.source AND n.line = f.line
  GROUP BY n.row_id
), counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM words LEFT JOIN repeated USING (row_id) LEFT JOIN removed USING (row_id)
), failed AS (
  SELECT *, n_words < {line_quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND removed_words <= {line_quality.MAX_REMOVED} * n_words AS kept, removed_words
FROM failed
"""


NGRAM_JOIN = """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), tokens AS (
  SELECT row_id, list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda k: array_to_string(words[k:k + 4], ' '))) AS tokens
  FROM docs WHERE len(words) > 0
), spread AS (
  SELECT row_id, len(tokens) AS n, unnest(tokens) AS token FROM tokens
), shared AS (
  SELECT a.row_id AS a, b.row_id AS b, a.n AS an, b.n AS bn, count(*) AS overlap
  FROM spread a JOIN spread b ON a.token = b.token AND a.row_id <> b.row_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE overlap >= 0.8 * (an + bn - overlap) - 1e-9
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (
  SELECT r.a AS row_id, min(d.doc_id) AS low FROM reach r JOIN docs d ON d.row_id = r.b GROUP BY r.a
), counts AS (
  SELECT a AS row_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT doc_id, least(doc_id, low) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(doc_id = least(doc_id, low), least(doc_id, low) IS NULL) AS kept
FROM docs LEFT JOIN lowest USING (row_id) LEFT JOIN counts USING (row_id)
"""


EMBEDDING_DUP = """
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS row_id, vec_id, embedding::DOUBLE[] AS v,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS fit
  FROM embeddings
), links AS (
  SELECT a.row_id AS a, b.row_id AS b
  FROM vectors a JOIN vectors b ON a.row_id <> b.row_id AND a.fit AND b.fit AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (
  SELECT r.a AS row_id, min(v.vec_id) AS low FROM reach r JOIN vectors v ON v.row_id = r.b GROUP BY r.a
), counts AS (
  SELECT a AS row_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, low) AS component_id, coalesce(vec_id = least(vec_id, low), least(vec_id, low) IS NULL) AS kept
FROM vectors LEFT JOIN lowest USING (row_id) LEFT JOIN counts USING (row_id)
"""


TOKEN_COUNTS = """
WITH docs AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '^[^\\n]*\\n', '') AS shorter FROM documents
), marks AS (
  SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), counted AS (
  SELECT source, lang, quality, toxic,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_words,
         len(regexp_extract_all(shorter, '[^\\x20\\x09-\\x0D]+')) AS n_shorter,
         len(regexp_extract_all(text, '\\p{L}+|\\p{N}+|[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+')) AS n_pieces
  FROM docs LEFT JOIN marks USING (doc_id)
), kept AS (
  SELECT source, lang, 'words-1' AS tokenizer, CASE WHEN toxic = 1 THEN n_shorter ELSE n_words END AS n
  FROM counted WHERE quality IS NULL OR quality <> 0
  UNION ALL
  SELECT source, lang, 'pieces-1', n_pieces FROM counted
)
SELECT source, lang, tokenizer, count(*) AS n_documents, sum(n)::BIGINT AS n_tokens FROM kept GROUP BY ALL
"""


LEXICAL = """
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), items AS (
  SELECT row_number() OVER () AS item, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM benchmark
), corpus AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0
), postings AS (
  SELECT row_id, term, count(*)::BIGINT AS tf FROM (SELECT row_id, unnest(terms) AS term FROM docs) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, corpus GROUP BY term, n_docs
), impacts AS (
  SELECT row_id, term, 1000000000 * tf // (1000 * tf + 8 * (25 + 75 * len(terms) * n_docs // n_terms)) AS impact
  FROM postings JOIN docs USING (row_id), corpus
), wanted AS (
  SELECT item, term, count(*)::BIGINT AS times FROM (SELECT item, unnest(terms) AS term FROM items) GROUP BY ALL
), scores AS (
  SELECT item, row_id, sum(times * w * impact)::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row_id)::INTEGER AS rank, doc_id, score
FROM scores JOIN docs USING (row_id) JOIN items USING (item) WHERE score > 0
QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": NGRAM_JOIN,
        "op4_token_counts": TOKEN_COUNTS,
        "op7_line_quality": LINE_QUALITY,
        "op8_embedding_dup": EMBEDDING_DUP,
        "op12_lexical": LEXICAL,
    }
