"""SQL over whole tables for the queries that SQL can express: exhaustive search instead of the operators' methods."""

#: A word as the queries define it, in RE2: punctuation and symbols (and U+200C) dropped from lower-cased text, split at white space.
_WORDS = r"list_filter(string_split_regex(regexp_replace(lower(text), '[\p{P}\p{S}\x{200C}]+', '', 'g'), '[\s\p{Z}\x{85}\x{1C}-\x{1F}]+'), lambda w: w <> '')"


def _runs(table: str, key: str) -> str:
    """(key, run): distinct sequences of three words."""
    return f"""SELECT DISTINCT {key}, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] run
      FROM (SELECT {key}, {_WORDS} w FROM {table} WHERE text <> ''), unnest(range(1, len(w) - 1)) u(i)"""


def _cut(src: str, table: str, key: str, text: str) -> str:
    """Items above 2,000 characters and whether a stretch between boundaries is longer than that."""
    stretch = r"regexp_replace(regexp_replace(t, '([.?!।۔؟])(\s)', '\1' || chr(1) || '\2', 'g'), '\n', chr(10) || chr(1), 'g')"
    return f"""SELECT DISTINCT '{src}' src, {key} item_id, CASE WHEN list_max(list_transform(string_split({stretch}, chr(1)), lambda x: length({"trim(x, ' ' || chr(9) || chr(10))"}))) > 2000
        THEN 'hard' ELSE 'natural' END cut FROM (SELECT {key}, trim({text}, ' ') t FROM {table}) WHERE length(t) > 2000"""


#: Number of tokens of a document's text.
_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\p{Z}\s\x{0B}\x{1C}-\x{1F}\x{85}\p{L}\p{M}\p{N}]'))"
_SHARES = f"""WITH i AS ({_runs('exam_items', 'item_id')}), n AS (SELECT item_id, count(*) n FROM i GROUP BY item_id), d AS ({_runs('documents', 'doc_id')}),
      m AS (SELECT d.doc_id, i.item_id, count(*) m FROM d JOIN i ON d.run = i.run GROUP BY ALL)"""

ORACLE: dict[str, str] = {
    "p1_found": """WITH u AS (SELECT chunk_uid, any_value(embedding)::DOUBLE[] v FROM chunks WHERE embedding_dim = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_uid),
      d AS (SELECT a.chunk_uid q, b.chunk_uid r, list_cosine_similarity(a.v, b.v) c FROM u a JOIN u b ON a.chunk_uid <> b.chunk_uid),
      t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, r) k FROM d QUALIFY k <= 5)
      SELECT DISTINCT least(q, r) chunk_a, greatest(q, r) chunk_b FROM t WHERE c >= 0.85""",
    "p3_found": _cut("cleaned", "cleaned_documents", "doc_id", "cleaned_text") + " UNION " + _cut("chunk", "chunks", "chunk_uid", "text"),
    "p3_covered": """SELECT DISTINCT src, item_id, length(t) n_chars, true AS covered, true AS "within" FROM (SELECT 'cleaned' src, doc_id item_id, trim(cleaned_text, ' ') t FROM cleaned_documents
      UNION ALL SELECT 'chunk', chunk_uid, trim(text, ' ') FROM chunks) WHERE length(t) > 2000""",
    "p8_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > 2048",
    "p8_budget": f"SELECT sum((n + 2047) // 2048)::BIGINT pieces, sum(n)::BIGINT tokens, 0 above, 0 twice FROM (SELECT {_TOKENS} n FROM documents) WHERE n > 0",
    "p9_found": f"{_SHARES} SELECT doc_id, item_id FROM m JOIN n USING (item_id) WHERE m * 2 >= n",
    "p9_shares": f"{_SHARES} SELECT doc_id, item_id, round(m / n, 6) share FROM m JOIN n USING (item_id) WHERE m * 2 >= n",
}
