"""SQL over the same whole tables, for an independent check of the queries."""

from __future__ import annotations

from vellum.functions.answer import FILE_SUBJECTS, FOLLOW_UPS, HEADERS, REJECTED, REJECTIONS, SYSTEM_PROMPTS, UNKNOWN_ANSWER, USER_PROMPTS
from vellum.functions.enrich import CONTENT_TYPES, STOPWORDS
from vellum.functions.text import MARKERS
from vellum.operators.gates import PREFIXES
from vellum.sources.catalog import SUBJECTS

WS = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}\x{0B}]"


def _re(text: str, *steps: tuple[str, str]) -> str:
    """text with regular expressions replaced one after another, everywhere."""
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def _clean(text: str) -> str:
    start = _re(f"coalesce({text}, '')", (rf"\[{WS}*\]", " "), (rf"\({WS}*\)", " "), ("_{3,}", " "), (f"{WS}{{3,}}", " "))
    return f"trim({_re(f"replace(replace({start}, '|', 'I'), '0', 'O')", (f'{WS}+', ' '))})"


def _clean_hindi(text: str) -> str:
    digits = f"translate(coalesce({text}, ''), '०१२३४५६७८९', '0123456789')"
    nl = "' || chr(10) || '"
    out = _re(digits, (r"[ \t]{3,}", " "), (r"\n{4,}", nl * 3), (rf"\[{WS}*\]", ""), (rf"\({WS}*\)", ""), ("_{3,}", ""))
    out = f"regexp_replace({out}, '(?m)^{WS}*\\p{{Nd}}+{WS}*$', '', 'g')"
    out = f"regexp_replace({out}, '(?m)^{WS}*[ivxlcdm]+{WS}*$', '', 'g')"
    return _strip(_re(out, (" +", " "), (r"\n ", nl), (r" \n", nl)))


CHUNKS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_uid) rn FROM chunks) WHERE rn = 1)"
FEEDBACK = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feedback_id) rn FROM feedback) WHERE rn = 1)"
CLEANED = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id) rn FROM cleaned_documents) WHERE rn = 1)"


def _markers() -> str:
    parts = []
    for order, (kind, pattern) in enumerate(MARKERS):
        parts.append(f"""
          SELECT chunk_uid, {order} ord, '{kind}' kind, i, hits[i] marker,
                 list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT start_pos
          FROM (SELECT chunk_uid, regexp_extract_all(text, '{pattern}') hits, string_split_regex(text, '{pattern}') parts FROM c), unnest(range(1, len(hits) + 1)) u(i)""")
    return f"""WITH c AS (SELECT chunk_uid, text FROM {CHUNKS}), m AS ({' UNION ALL '.join(parts)})
      SELECT chunk_uid, (row_number() OVER (PARTITION BY chunk_uid ORDER BY start_pos, ord) - 1)::INT nth, kind, start_pos::INT start_pos,
             (start_pos + length(marker))::INT end_pos, marker FROM m"""


def _slug(s: str) -> str:
    return rf"regexp_replace(replace(replace(lower({s}), ' ', '-'), 'and', ''), '^-+|-+$', '', 'g')"


def _nullif_extract(text: str, pattern: str, flags: str = "i") -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', 1, '{flags}'), '')"


_WINDOW = "reverse(substr(text, s + 2000 - 200 + 1, 200))"
_FOUND = "greatest(" + ", ".join(f"CASE WHEN instr({_WINDOW}, {p}) > 0 THEN 200 - instr({_WINDOW}, {p}) - 1 ELSE -1 END" for p in ("' .'", "chr(10) || '.'", "chr(10) || '?'", "chr(10) || '!'")) + ")"


def _token_chunks(source: str) -> str:
    """Recursive cuts of (key, text) rows."""
    end = f"CASE WHEN s + 2000 < length(text) AND {_FOUND} >= 0 THEN s + 1800 + {_FOUND} + 1 ELSE s + 2000 END"
    return f"""WITH RECURSIVE src AS ({source}), cut(key, text, s, e) AS (
        SELECT key, text, s, {end} FROM (SELECT key, text, 0 s FROM src WHERE length(text) > 0)
        UNION ALL
        SELECT key, text, s, {end} FROM (SELECT key, text, e - 200 s FROM cut WHERE e < length(text))
      ), piece AS (SELECT key, s start_pos, e end_pos, {_strip('substr(text, s + 1, e - s)')} text FROM cut)"""


def _structure_chunks() -> str:
    return f"""b AS (SELECT doc_id, cleaned_text, list_concat([0], list_transform(structures, lambda x: x.start_pos), [length(cleaned_text)]) b,
                 list_concat(list_transform(structures, lambda x: x.kind), [NULL]) k FROM {CLEANED} WHERE len(structures) > 0),
      seg AS (SELECT doc_id, i - 1 ord, b[i] start_pos, b[i + 1] end_pos, k[i] structure_type,
                 {_strip('substr(cleaned_text, b[i] + 1, greatest(b[i + 1] - b[i], 0))')} text FROM b, unnest(range(1, len(k) + 1)) u(i))"""


def _content_type() -> str:
    cases = " ".join(f"WHEN regexp_matches(text, '{p}', 'i') THEN '{n}'" for n, p in CONTENT_TYPES)
    return f"CASE {cases} WHEN contains(lower(text), 'chapter') AND length(text) < 500 THEN 'chapter_heading' ELSE 'explanation' END"


def _knn(k: int, same_label: bool = False, tail: str = "") -> str:
    label = "AND r.label = q.label" if same_label else ""
    return f"""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) v FROM embeddings),
      d AS (SELECT q.vec_id q_id, q.label q_label, r.vec_id, r.label, round(list_distance(q.v, r.v) * list_distance(q.v, r.v), 6) distance
            FROM u q JOIN u r ON r.vec_id <> q.vec_id {label} WHERE q.vec_id % 20 = 0),
      h AS (SELECT *, 1.0 / (1.0 + distance) score, row_number() OVER (PARTITION BY q_id ORDER BY distance, vec_id)::INT "rank" FROM d QUALIFY "rank" <= {k}) {tail}"""


_KNN_OUT = 'SELECT q_id, vec_id, "rank", round(distance, 5) distance, round(score, 5) score FROM h'
_SUMMARY = """, s AS (SELECT q_id, count(*) hits, max(CASE WHEN "rank" = 1 THEN score END) top_score, avg(CASE WHEN "rank" <= 5 THEN score END) avg_top5, max(score) max_score,
        avg(score) avg_score, sum(length(coalesce(text, ''))) context_chars, sum(CASE WHEN "rank" <= 3 AND label <> q_label THEN 1 ELSE 0 END) mismatches
        FROM h LEFT JOIN documents ON doc_id = vec_id GROUP BY q_id)"""
#: Gate: condition under which it rejects, type, score, threshold.
_GATES = {
    "relevance": ("hits > 0 AND top_score < 0.45", "low_confidence", "top_score", 0.45),
    "subject": ("mismatches >= 2", "off_topic", "mismatches", 2),
    "confidence": ("hits = 0 OR coalesce(avg_top5, 0) < 0.38", "low_confidence", "coalesce(avg_top5, 0)", 0.38),
    "context": ("hits < 1 OR coalesce(context_chars, 0) < 100", "insufficient_context", "context_chars", 100),
    "topic": ("hits = 0 OR max_score < 0.3", "off_topic", "max_score", 0.3),
}


def _gate(name: str) -> str:
    bad, kind, score, least = _GATES[name]
    return _knn(30, tail=_SUMMARY) + f"""SELECT q_id, NOT ({bad}) passed, CASE WHEN {bad} THEN '{kind}' END rejection_type,
        CASE WHEN {bad} THEN round({score}::DOUBLE, 4) END gate_score, CASE WHEN {bad} THEN {least}::DOUBLE END threshold FROM s"""


def _picked(source: str) -> str:
    """source with stage, rejection_type, gate_score and threshold of the first gate that rejects."""
    pick = lambda f: "CASE " + " ".join(f"WHEN {bad} THEN {f(n, kind, score, least)}" for n, (bad, kind, score, least) in _GATES.items()) + " END"
    return f"""SELECT *, {pick(lambda n, k, s, t: f"'{k}'")} rejection_type, {pick(lambda n, k, s, t: f"'{n}'")} stage,
        {pick(lambda n, k, s, t: f"({s})::DOUBLE")} gate_score, {pick(lambda n, k, s, t: f"{t}::DOUBLE")} threshold FROM {source}"""


def _gates() -> str:
    return _knn(30, tail=_SUMMARY) + f"""SELECT q_id, hits, stage IS NULL passed, rejection_type, stage, round(gate_score, 4) gate_score, threshold, round(avg_score, 4) avg_score FROM ({_picked('s')})"""


def _sentences(text: str, longer: int) -> str:
    return f"list_filter(list_transform(string_split_regex({text}, '[.!?]+'), lambda x: {_strip('x')}), lambda x: length(x) > {longer})"


def _extractive(text: str, end: str) -> str:
    some, body = _sentences(_strip(text), 20), _strip(text)
    lines = f"CASE WHEN len({some}) > 0 THEN ({some})[1:3] WHEN {body} <> '' THEN [substr({body}, 1, 400)] ELSE []::VARCHAR[] END"
    return f"array_to_string(list_transform({lines}, lambda x: x || {end}), chr(10))"


def _page_range() -> str:
    return """CASE WHEN coalesce(len(page_numbers), 0) > 0 THEN
        CASE WHEN len(page_numbers) > 1 AND page_numbers[-1] IS NOT NULL AND page_numbers[-1] <> 0 AND page_numbers[-1] <> page_numbers[1]
             THEN page_numbers[1]::VARCHAR || '-' || page_numbers[-1]::VARCHAR ELSE coalesce(page_numbers[1]::VARCHAR, 'Unknown') END
      ELSE coalesce(nullif(primary_page::VARCHAR, '0'), 'Unknown') END"""


def _citation_chapter() -> str:
    digits = "regexp_extract(coalesce(filename, ''), '(jehp|jemh|jeff|jesc|jess)([0-9]+)', 2)"
    return f"""CASE WHEN chapter IS NOT NULL AND chapter <> 'Unknown' AND {_strip('chapter')} <> '' THEN
        CASE WHEN starts_with(lower(chapter), 'chapter') THEN chapter ELSE 'Chapter ' || chapter END
      WHEN {digits} = '' THEN 'Chapter Unknown'
      WHEN try_cast({digits} AS HUGEINT) % 100 = 0 THEN 'Introduction' ELSE 'Chapter ' || (try_cast({digits} AS HUGEINT) % 100)::VARCHAR END"""


def _file_subject(asked: str = "'asked'") -> str:
    cases = " ".join(f"WHEN contains(lower(filename), '{p}') THEN '{n}'" for p, n in FILE_SUBJECTS)
    return f"CASE {cases} WHEN coalesce(filename, '') <> '' THEN coalesce(subject, {asked}) ELSE {asked} END"


def _mismatch(asked: str = "", hit: str = "") -> str:
    prefix = "CASE " + " ".join(f"WHEN {asked}class::INT = {c} AND {asked}subject = '{s}' THEN '{p}'" for (c, s), p in PREFIXES.items()) + " END"
    return f"""CASE WHEN {asked}class::INT = 10 AND {asked}subject IN ('Hindi', 'English') THEN false WHEN {prefix} IS NOT NULL THEN NOT contains(lower(coalesce({hit}filename, '')), {prefix})
        ELSE coalesce({hit}subject, '') <> '' AND lower({hit}subject) <> lower({asked}subject) END"""


def _path(t: str = "") -> str:
    return f"""'class-' || {t}class::VARCHAR || '/' || CASE WHEN {t}class::VARCHAR = '10' THEN 'all-subjects-' || CASE {t}lang WHEN 'hi' THEN 'hindi' WHEN 'en' THEN 'english' ELSE {t}lang END
        ELSE {_slug(f'{t}subject')} || '-' || {t}lang END"""


def _unit(vector: str) -> str:
    return f"list_transform({vector}, lambda x: x / sqrt(greatest(list_sum(list_transform({vector}, lambda y: y * y)), 1e-300)))"


def _pipeline() -> str:
    """Questions (chunks whose key 20 divides) against the chunks of their own index, gates, extract and citation."""
    shelf = "'class ' || coalesce(q_class, '?') || ', ' || coalesce(q_subject, '?')"
    told = f"""CASE stage WHEN 'relevance' THEN 'No passage of ' || {shelf} || ', comes close enough to the question.' WHEN 'subject' THEN 'The passages found lie outside ' || {shelf} || '.'
        WHEN 'confidence' THEN 'The passages of ' || {shelf} || ', match too weakly on average.' WHEN 'context' THEN 'The passages of ' || {shelf} || ', hold too little text.'
        WHEN 'topic' THEN 'The question lies outside ' || {shelf} || '.' END"""
    answer = _extractive("text", "CASE WHEN q_lang = 'hi' THEN ' [Source 1]' ELSE '. [Source 1]' END")
    return f"""WITH c AS (SELECT k.chunk_uid, k.text, k.chapter, k.page_numbers, k.primary_page, k.filename, CASE WHEN k.embedding_dim = 64 THEN k.embedding::DOUBLE[] END e,
          b.class::VARCHAR class, b.subject, b.lang, {_path('b.')} path FROM {CHUNKS} k JOIN books b ON b.filename = k.filename),
      u AS (SELECT * EXCLUDE e, {_unit('e')} v FROM c),
      d AS (SELECT q.chunk_uid q_id, r.chunk_uid r_id, length(coalesce(r.text, '')) chars, {_mismatch('q.', 'r.')} mismatch, round(list_distance(q.v, r.v) * list_distance(q.v, r.v), 6) distance
            FROM u q JOIN u r ON q.path = r.path AND q.chunk_uid <> r.chunk_uid WHERE q.chunk_uid % 20 = 0 AND q.v IS NOT NULL AND r.v IS NOT NULL),
      h AS (SELECT *, 1.0 / (1.0 + distance) score, row_number() OVER (PARTITION BY q_id ORDER BY distance, r_id) k FROM d QUALIFY k <= 30),
      s AS (SELECT q_id, count(*) hits, max(CASE WHEN k = 1 THEN score END) top_score, avg(CASE WHEN k <= 5 THEN score END) avg_top5, max(score) max_score, avg(score) avg_score, sum(chars) context_chars,
            sum(CASE WHEN k <= 3 AND mismatch THEN 1 ELSE 0 END) mismatches, max(CASE WHEN k = 1 THEN r_id END) best FROM h GROUP BY q_id),
      a AS (SELECT q.chunk_uid q_id, q.class q_class, q.subject q_subject, q.lang q_lang, q.v IS NULL broken, coalesce(hits, 0) hits, top_score, avg_top5, max_score, avg_score, context_chars,
            coalesce(mismatches, 0) mismatches, best FROM u q LEFT JOIN s ON s.q_id = q.chunk_uid WHERE q.chunk_uid % 20 = 0),
      g AS ({_picked('a')}),
      f AS (SELECT g.*, b.text, b.chapter, b.filename, b.page_numbers, b.primary_page, b.class, b.subject FROM g LEFT JOIN u b ON b.chunk_uid = g.best),
      o AS (SELECT *, stage IS NULL ok, CASE WHEN text IS NULL THEN '{UNKNOWN_ANSWER}' ELSE {answer} END said FROM f)
      SELECT q_id, CASE WHEN ok THEN 'success' ELSE 'rejected' END status, CASE WHEN ok THEN said END answer, CASE WHEN ok THEN coalesce(class, q_class) END class, CASE WHEN ok THEN {_file_subject('q_subject')} END subject,
        CASE WHEN ok THEN {_citation_chapter()} END chapter, CASE WHEN ok THEN {_page_range()} END page,
        CASE WHEN ok THEN CASE WHEN said = '' THEN 0.0 WHEN len(regexp_extract_all(said, '\\[Source [0-9]+\\]')) = 0 THEN 0.3 ELSE 0.9 END::DOUBLE END grounding_score,
        CASE WHEN broken THEN 'error' ELSE stage END reason, CASE WHEN broken THEN 'The question has no vector to search with.' WHEN NOT ok THEN {told} END message,
        CASE WHEN broken THEN 'insufficient_context' ELSE rejection_type END rejection_type, CASE WHEN NOT broken THEN round(gate_score, 4) END gate_score, CASE WHEN NOT broken THEN threshold END threshold,
        hits retrieved_chunks, round(avg_score, 4) avg_retrieval_score, CASE WHEN ok THEN 'retrieval_only' END "mode" FROM o"""


_HINDI = "lower(coalesce(lang, '')) IN ('hi', 'hin', 'hindi')"


def _cleaned_scans() -> str:
    """(doc_id, t, hindi, chapter, ...): scans cleaned each in their own way, one row per delivery that differs."""
    first = lambda text, n, pattern: _nullif_extract(f"substr({text}, 1, {n})", pattern)
    stem = "regexp_extract(lower(filename), 'jesc([0-9]+)', 1)"
    return f"""SELECT *, coalesce(nullif(nullif(chapter, 'Unknown'), ''), {first('t', 500, r'chapter\s+([0-9]+)')}, {first('t', 500, r'chapter\s+([ivxlcdm]+)')},
          CASE WHEN {stem} <> '' THEN coalesce(nullif(ltrim({stem}, '0'), ''), '0') END) told, CASE WHEN NOT hindi THEN {first('t', 1000, r'section\s+([0-9]+\.?[0-9]*)')} END section,
          CASE WHEN NOT hindi THEN 'Science' WHEN contains(lower(filename), 'jhsc') THEN 'Science' WHEN contains(lower(filename), 'jhss') THEN 'Social Science' ELSE 'Unknown' END subject
        FROM (SELECT doc_id, full_text, filename, chapter, pages, {_HINDI} hindi, CASE WHEN {_HINDI} THEN {_clean_hindi('full_text')} ELSE {_clean('full_text')} END t FROM ocr_results)"""


def _ingest() -> str:
    """Scans cleaned, cut by markers where there are any and by size elsewhere, and what is told of chunks cut by size."""
    hits = []
    for order, (kind, pattern) in enumerate(MARKERS):
        hits.append(f"""SELECT doc_id, {order} ord, '{kind}' kind, list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT pos
          FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') hits, string_split_regex(t, '{pattern}') parts FROM k WHERE NOT hindi), unnest(range(1, len(hits) + 1)) u(i)""")
    token = _token_chunks("SELECT doc_id AS key, t AS text FROM k WHERE doc_id NOT IN (SELECT doc_id FROM st)").removeprefix("WITH RECURSIVE ")
    return f"""WITH RECURSIVE k AS (SELECT * FROM ({_cleaned_scans()}) QUALIFY row_number() OVER (PARTITION BY doc_id) = 1), m AS ({' UNION ALL '.join(hits)}),
      st AS (SELECT doc_id, list(pos ORDER BY pos, ord) starts, list(kind ORDER BY pos, ord) kinds FROM m GROUP BY doc_id),
      b AS (SELECT doc_id, t, list_concat([0], starts, [length(t)]) b, list_concat(kinds, [NULL]) kinds FROM st JOIN k USING (doc_id)),
      seg AS (SELECT doc_id, i, b[i] start_pos, b[i + 1] end_pos, kinds[i] structure_type, {_strip('substr(t, b[i] + 1, greatest(b[i + 1] - b[i], 0))')} text FROM b, unnest(range(1, len(kinds) + 1)) u(i)),
      {token},
      every AS (SELECT doc_id, i ord, start_pos, end_pos, structure_type, text, NULL::INT token_count FROM seg WHERE length(text) >= 50
        UNION ALL SELECT key, 0, start_pos, end_pos, NULL, text, (length(text) // 4)::INT FROM piece WHERE text <> ''),
      c AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, ord) - 1)::INT chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT total_chunks FROM every),
      w AS (SELECT doc_id, chunk_index, i, ws[i] word
        FROM (SELECT doc_id, chunk_index, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}')) ws FROM c WHERE token_count IS NOT NULL), unnest(range(1, len(ws) + 1)) u(i)),
      n AS (SELECT doc_id, chunk_index, word, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY count(*) DESC, min(i)) r FROM w WHERE word NOT IN ({', '.join(f"'{x}'" for x in STOPWORDS)}) GROUP BY doc_id, chunk_index, word),
      top AS (SELECT doc_id, chunk_index, string_agg(word, ' ' ORDER BY r) keywords FROM n WHERE r <= 5 GROUP BY ALL),
      p AS (SELECT doc_id, told, list_filter(list_transform(pages, lambda p: p.page_number), lambda x: x IS NOT NULL AND x <> 0) pn FROM k)
      SELECT c.doc_id, c.chunk_index, total_chunks, start_pos::INT start_pos, end_pos::INT end_pos, structure_type, text, length(text)::INT char_count, token_count,
        CASE WHEN token_count IS NOT NULL THEN {_content_type()} END content_type, CASE WHEN token_count IS NOT NULL THEN regexp_matches(text, '{_EQUATION}') END has_equations,
        CASE WHEN token_count IS NOT NULL THEN regexp_matches(text, '{_QUESTION}', 'i') END has_questions, CASE WHEN token_count IS NOT NULL THEN coalesce(keywords, '') END keywords,
        told chapter, pn[1] primary_page, array_to_string(pn, ',') page_numbers, 384 embedding_dim, 1.0::DOUBLE norm
      FROM c JOIN p ON p.doc_id = c.doc_id LEFT JOIN top ON top.doc_id = c.doc_id AND top.chunk_index = c.chunk_index"""


_EQUATION, _QUESTION = r"[=+\-*/()]|[0-9]+\.[0-9]+|→|—", r"\?|(question|exercise|activity)"


def _prompt(template: str, *values: str) -> str:
    parts = template.split("%s")
    return " || ".join([f"'{parts[0]}'", *(x for v, p in zip(values, parts[1:]) for x in (v, f"'{p}'"))])


#: The first five chunks of every document, their context and extract, as CTEs.
_FIVE = f"""r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_uid) k FROM {CHUNKS} QUALIFY k <= 5),
      c AS (SELECT doc_id, string_agg('[Source ' || k || '] Chapter: ' || coalesce(chapter, 'Unknown') || ', Page: ' || coalesce(primary_page::VARCHAR, 'Unknown') || chr(10) || {_strip("coalesce(text, '')")} || chr(10), chr(10) ORDER BY k) context FROM r GROUP BY doc_id),
      t AS (SELECT doc_id, k, {_strip('text')} b FROM r WHERE k <= 2 AND {_strip("coalesce(text, '')")} <> ''),
      n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) i, b, {_sentences('b', 20)} s FROM t),
      x AS (SELECT doc_id, string_agg('[' || i || '] ' || CASE WHEN len(s) > 0 THEN array_to_string(s[1:3], ' ') ELSE substr(b, 1, 300) END, chr(10) || chr(10) ORDER BY i) extract FROM n GROUP BY doc_id)"""
_TREE = """(SELECT class, subject s, CASE lang WHEN 'hi' THEN 'hindi' WHEN 'ur' THEN 'urdu' ELSE 'english' END l, length(filename) % 2 = 0 upper FROM books WHERE class IN (5, 6, 9, 10))"""


_RESULTS = f"""(SELECT feedback_id, helpful, coalesce(metadata.status, 'error') status, try_cast(regexp_extract(metadata.class, '([0-9]+)', 1) AS INT) class, metadata.lang lang FROM {FEEDBACK})"""
_INITCAP = "array_to_string(list_transform(string_split(lower(trim({0})), ' '), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ')"

ORACLE: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {_clean('text')} cleaned FROM documents",
    "clean_hindi_text": f"SELECT DISTINCT doc_id, {_clean_hindi('full_text')} cleaned FROM ocr_results",
    "script_ratio": r"""SELECT doc_id, coalesce(len(regexp_extract_all(text, '[\x{0900}-\x{097F}]')), 0)::INT n,
        CASE WHEN length(coalesce(text, '')) > 0 THEN round_even(len(regexp_extract_all(text, '[\x{0900}-\x{097F}]')) / length(text) * 100, 1) ELSE 0.0 END percentage FROM documents""",
    "structure_markers": _markers(),
    "chapter_section": f"""SELECT DISTINCT doc_id, coalesce({_nullif_extract('substr(c, 1, 500)', r'chapter\s+([0-9]+)')}, {_nullif_extract('substr(c, 1, 500)', r'chapter\s+([ivxlcdm]+)')}) chapter,
        {_nullif_extract('substr(c, 1, 1000)', r'section\s+([0-9]+\.?[0-9]*)')} section,
        CASE WHEN regexp_extract(lower(filename), 'jesc([0-9]+)', 1) <> '' THEN coalesce(nullif(ltrim(regexp_extract(lower(filename), 'jesc([0-9]+)', 1), '0'), ''), '0') END series_chapter
        FROM (SELECT doc_id, filename, {_clean('full_text')} c FROM ocr_results)""",
    "filename_parts": r"""SELECT filename, regexp_extract(filename, '([^/]+?)(\.[^./]*)?$', 1) stem,
        coalesce(try_cast(nullif(regexp_extract(regexp_extract(filename, '([^/]+?)(\.[^./]*)?$', 1), '([0-9]{2})$', 1), '') AS INT)::VARCHAR, 'Unknown') chapter,
        CASE WHEN contains(lower(filename), 'jhsc') THEN 'Science' WHEN contains(lower(filename), 'jhss') THEN 'Social Science' ELSE 'Unknown' END hindi_subject FROM books""",
    "footer_page_number": f"""WITH p AS (SELECT DISTINCT doc_id, u.page_number, u.text FROM ocr_results, unnest(pages) t(u)),
      l AS (SELECT doc_id, page_number, list_transform(list_reverse(string_split({_strip('text')}, chr(10)))[1:3],
               lambda x: regexp_extract(x, '(?:^|[^\\p{{L}}\\p{{N}}_])([0-9]{{1,3}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1)) f, {_strip("coalesce(text, '')")} t FROM p)
      SELECT DISTINCT doc_id, page_number, CASE WHEN t = '' THEN 'Unknown' ELSE coalesce(list_filter(f, lambda x: x <> '')[1], 'Unknown') END printed FROM l""",
    "joined_pages": """SELECT DISTINCT doc_id, t full_text, len(pages)::INT total_pages, length(t)::INT total_characters
      FROM (SELECT doc_id, pages, coalesce(array_to_string(list_filter(list_transform(pages, lambda p: p.text), lambda x: coalesce(x, '') <> ''), chr(10) || chr(10)), '') t FROM ocr_results)""",
    "subject_slugs": f"SELECT DISTINCT class, subject, lang, {_slug('subject')} slug, {_path()} path FROM books",
    "text_previews": """SELECT DISTINCT feedback_id, substr(question, 1, 50) || '...' short, CASE WHEN length(answer) > 300 THEN substr(answer, 1, 300) || '...' ELSE answer END long FROM feedback""",
    "chunk_by_tokens": _token_chunks("SELECT doc_id key, text FROM documents")
    + """SELECT key doc_id, (row_number() OVER (PARTITION BY key ORDER BY start_pos) - 1)::INT chunk_index, (count(*) OVER (PARTITION BY key))::INT total_chunks, start_pos::INT start_pos, end_pos::INT end_pos,
        length(text)::INT char_count, (length(text) // 4)::INT token_count, text FROM piece WHERE text <> ''""",
    "chunk_by_structure": f"""WITH {_structure_chunks()}
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, ord) - 1)::INT chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT total_chunks, start_pos::INT start_pos, end_pos::INT end_pos,
        structure_type, length(text)::INT char_count, text FROM seg WHERE length(text) >= 50""",
    "chunk_dispatch": _token_chunks(f"SELECT doc_id key, cleaned_text text FROM {CLEANED} WHERE coalesce(len(structures), 0) = 0")
    + f""", {_structure_chunks()}, a AS (SELECT key doc_id, length(text) n, NULL::VARCHAR t FROM piece WHERE text <> '' UNION ALL SELECT doc_id, length(text), structure_type FROM seg WHERE length(text) >= 50)
      SELECT doc_id, count(*) n, sum(n)::BIGINT chars, count(*)::INT total, count(t) typed FROM a GROUP BY doc_id""",
    "chunk_stats": f"SELECT lang, count(*) n, sum(length(text))::BIGINT chars, max(length(text))::INT longest, sum(length(text) // 4)::BIGINT tokens FROM {CHUNKS} GROUP BY lang",
    "content_types": f"""SELECT chunk_uid, {_content_type()} content_type, regexp_matches(text, '[=+\\-*/()]|[0-9]+\\.[0-9]+|→|—') has_equations,
        regexp_matches(text, '\\?|(question|exercise|activity)', 'i') has_questions FROM {CHUNKS}""",
    "keywords_top5": f"""WITH c AS (SELECT chunk_uid, text FROM {CHUNKS}), w AS (SELECT chunk_uid, i, ws[i] word
        FROM (SELECT chunk_uid, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}')) ws FROM c), unnest(range(1, len(ws) + 1)) u(i)),
      n AS (SELECT chunk_uid, word, row_number() OVER (PARTITION BY chunk_uid ORDER BY count(*) DESC, min(i)) r FROM w WHERE word NOT IN ({', '.join(f"'{s}'" for s in STOPWORDS)}) GROUP BY chunk_uid, word)
      SELECT c.chunk_uid, coalesce(k.keywords, '') keywords FROM c LEFT JOIN (SELECT chunk_uid, string_agg(word, ' ' ORDER BY r) keywords FROM n WHERE r <= 5 GROUP BY chunk_uid) k ON k.chunk_uid = c.chunk_uid""",
    "chunk_pages": """SELECT DISTINCT doc_id, array_to_string(n, ',') page_numbers, array_to_string(list_filter(list_transform(pages, lambda p: p.pdf_page_number), lambda x: coalesce(x, '') <> ''), ',') printed,
        n[1] primary_page, class, subject FROM (SELECT doc_id, metadata.pages pages, metadata.class class, metadata.subject subject, list_filter(list_transform(metadata.pages, lambda p: p.page_number), lambda x: x IS NOT NULL AND x <> 0) n FROM cleaned_documents)""",
    "index_catalog": f"""SELECT b.class, {_slug('b.subject')} subject_slug, b.lang, count(*) n, count(DISTINCT c.filename) files FROM {CHUNKS} c JOIN books b ON b.filename = c.filename GROUP BY ALL""",
    "folder_catalog": f"""WITH f AS (SELECT 'class-' || class::VARCHAR folder, subject s, CASE lang WHEN 'hi' THEN 'hindi' WHEN 'ur' THEN 'urdu' ELSE 'english' END l FROM books)
      SELECT DISTINCT folder, CASE WHEN contains(upper(folder), 'CLASS-X') OR contains(upper(folder), 'CLASS-10') THEN 10 WHEN contains(upper(folder), 'CLASS-V') OR contains(upper(folder), 'CLASS-5') THEN 5
        WHEN contains(upper(folder), 'CLASS 6') OR contains(upper(folder), 'CLASS-6') THEN 6 WHEN contains(upper(folder), 'CLASS 9') OR contains(upper(folder), 'CLASS-9') THEN 9 END class,
        {_INITCAP.format('s')} subject, {_INITCAP.format('l')} "language", CASE l WHEN 'hindi' THEN 'hi' WHEN 'urdu' THEN 'ur' ELSE 'en' END lang_code FROM f""",
    "l2_norms": """SELECT vec_id, round(n, 6) norm, round(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END, 6) unit_norm, round(embedding[1]::DOUBLE / n, 6) "first"
        FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) n FROM embeddings)""",
    "knn_exact_topk": _knn(30) + _KNN_OUT,
    "knn_label_filtered": _knn(10, same_label=True) + _KNN_OUT,
    "knn_ivf_full_probe": _knn(10) + _KNN_OUT,
    "gate_relevance": _gate("relevance"),
    "gate_subject_mismatch": _gate("subject"),
    "gate_confidence": _gate("confidence"),
    "gate_context_sufficiency": _gate("context"),
    "gate_topic": _gate("topic"),
    "gate_all_first_failure": _gates(),
    "subject_prefix_match": f"SELECT filename, {_mismatch()} mismatch, {_file_subject()} file_subject FROM books",
    "extractive_answers": f"""WITH a AS (SELECT chunk_uid, {_extractive('text', "CASE WHEN lower(lang) IN ('hi', 'hin', 'hindi') THEN ' [Source 1]' ELSE '. [Source 1]' END")} answer FROM {CHUNKS}),
      m AS (SELECT *, len(regexp_extract_all(answer, '\\[Source [0-9]+\\]'))::INT markers, len({_sentences('answer', 10)}) n FROM a),
      g AS (SELECT *, CASE WHEN answer = '' THEN 0.0 WHEN markers = 0 THEN 0.3 ELSE 0.9 END::DOUBLE grounding FROM m)
      SELECT chunk_uid, answer, markers, grounding, CASE WHEN grounding >= 0.9 THEN 'Fully Verified' WHEN grounding >= 0.7 THEN 'Verified' ELSE 'Partially Verified' END label,
        CASE WHEN answer = '' OR markers = 0 OR (n > 0 AND markers < 0.5 * n) THEN 'missing_citations' END citation_gate, CASE WHEN grounding < 0.65 THEN 'poor_grounding' END grounding_gate FROM g""",
    "citations": f"SELECT chunk_uid, {_page_range()} page, {_citation_chapter()} chapter, {_file_subject()} subject, class FROM {CHUNKS}",
    "citation_dedupe": f"""WITH f AS (SELECT doc_id, chunk_uid, class, subject, chapter, primary_page::VARCHAR page FROM {CHUNKS}
        QUALIFY row_number() OVER (PARTITION BY doc_id, coalesce(class, ''), coalesce(subject, ''), coalesce(chapter, ''), coalesce(primary_page::VARCHAR, '') ORDER BY chunk_uid) = 1)
      SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_uid))::INT number FROM f""",
    "answer_contexts": f"""WITH {_FIVE}
      SELECT c.doc_id, context, coalesce(x.extract, '') "extract", 'Answer.' || CASE WHEN coalesce(x.extract, '') <> '' THEN chr(10) || chr(10) || repeat('=', 50) || chr(10)
          || CASE WHEN c.doc_id % 2 = 0 THEN '{HEADERS['hi']}' ELSE '{HEADERS['en']}' END || chr(10) || x.extract ELSE '' END
        || chr(10) || chr(10) || repeat('-', 50) || chr(10) || CASE WHEN c.doc_id % 2 = 0 THEN '{FOLLOW_UPS['hi']}' ELSE '{FOLLOW_UPS['en']}' END complete FROM c LEFT JOIN x ON x.doc_id = c.doc_id""",
    "question_validation": f"""SELECT feedback_id, CASE WHEN coalesce(question, '') = '' THEN 'question_missing' WHEN length(trim(question)) < 10 THEN 'question_short'
        WHEN length(question) > 500 THEN 'question_long' WHEN k IS NULL OR k NOT IN ('5', '6', '7', '8', '9', '10') THEN 'class_unknown'
        WHEN coalesce(s, '') = '' THEN 'subject_missing' WHEN l IS NULL OR l NOT IN ('en', 'hi') THEN 'language_unknown' END error,
        CASE t {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in REJECTIONS.items())} ELSE '{REJECTED}' END message
      FROM (SELECT DISTINCT feedback_id, question, regexp_extract(metadata.class, '([0-9]+)', 1) k, metadata.subject s, metadata.lang l, metadata.rejection_type t FROM feedback)""",
    "response_validation": """SELECT feedback_id, CASE WHEN s = 'success' AND coalesce(answer, '') = '' THEN 'answer_missing' WHEN s = 'success' AND g IS NULL THEN 'citations_missing'
        WHEN s = 'rejected' AND coalesce(t, '') = '' THEN 'reason_missing' WHEN s IS NULL OR s NOT IN ('success', 'rejected') THEN 'status_unknown' END error
      FROM (SELECT DISTINCT feedback_id, answer, metadata, metadata.status s, metadata.grounding_score g, metadata.rejection_type t FROM feedback)""",
    "subjects_on_offer": f"""SELECT filename, class, EXISTS (SELECT 1 FROM (VALUES {', '.join(f"({c}, '{s.lower()}')" for c, names in SUBJECTS.items() for s in names)}) o(c, s) WHERE o.c = class AND o.s = lower(subject)) on_offer FROM books""",
    "feedback_log": """SELECT DISTINCT feedback_id, coalesce(nullif(answer, ''), 'REJECTED') answer, coalesce(trim(remark), '') remark, nullif(metadata.rejection_type, '') rejection_type,
        nullif(metadata.grounding_score, 0.0) grounding_score FROM feedback""",
    "feedback_windows": f"""SELECT strftime(asked_at::TIMESTAMP, '%Y-%m-%d') "day", coalesce(metadata.status, 'unknown') status,
        count(*) n, count(*) FILTER (WHERE coalesce(helpful, false)) helpful FROM {FEEDBACK} WHERE asked_at IS NOT NULL GROUP BY ALL""",
    "eval_status_counts": f"SELECT status, count(*) n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE percent FROM {_RESULTS} GROUP BY status",
    "eval_mode_distribution": f"""SELECT CASE WHEN metadata.grounding_score >= 0.9 THEN 'retrieval_only' WHEN metadata.grounding_score IS NOT NULL THEN 'llm' END "mode", count(*) n
        FROM {FEEDBACK} WHERE metadata.status = 'success' GROUP BY 1""",
    "eval_latency": "SELECT event_type, count(value) n, round(avg(value), 6) avg_s, min(value) min_s, max(value) max_s FROM events GROUP BY event_type",
    "eval_class_pivot": f"""SELECT class, count(*) FILTER (WHERE status = 'success') success, count(*) FILTER (WHERE status = 'rejected') rejected, count(*) FILTER (WHERE status = 'error') error, count(*) total,
        round(count(*) FILTER (WHERE status = 'success') * 100.0 / count(*), 4)::DOUBLE success_percent FROM {_RESULTS} WHERE class IS NOT NULL GROUP BY class""",
    "eval_passed": f"SELECT count(*) FILTER (WHERE helpful) passed, count(helpful) total FROM {_RESULTS}",
    "answer_prompts": f"""WITH {_FIVE}
      SELECT c.doc_id q_id, CASE WHEN c.doc_id % 2 = 0 THEN '{SYSTEM_PROMPTS['hi']}' ELSE '{SYSTEM_PROMPTS['en']}' END system,
        CASE WHEN c.doc_id % 2 = 0 THEN {_prompt(USER_PROMPTS['hi'], 'context', "'Question ' || c.doc_id::VARCHAR")} ELSE {_prompt(USER_PROMPTS['en'], 'context', "'Question ' || c.doc_id::VARCHAR")} END "user",
        coalesce(x.extract, '') "extract" FROM c LEFT JOIN x ON x.doc_id = c.doc_id""",
    "encode_hashing": r"""SELECT doc_id, 384 embedding_dim, 384 size, CASE WHEN regexp_matches(coalesce(text, ''), '[^\s\p{Z}\x{85}\x{1C}-\x{1F}\x{0B}]') THEN 1.0 ELSE 0.0 END::DOUBLE norm FROM documents""",
    "numbered_pages": f"""WITH p AS (SELECT DISTINCT doc_id, i page_number, string_split(full_text, chr(10) || chr(10))[i] text FROM ocr_results, unnest(range(1, len(string_split(full_text, chr(10) || chr(10))) + 1)) u(i) WHERE full_text <> ''),
      l AS (SELECT *, list_transform(list_reverse(string_split({_strip('text')}, chr(10)))[1:3],
               lambda x: regexp_extract(x, '(?:^|[^\\p{{L}}\\p{{N}}_])([0-9]{{1,3}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1)) f FROM p)
      SELECT DISTINCT doc_id, page_number::INT page_number, CASE WHEN {_strip('text')} = '' THEN 'Unknown' ELSE coalesce(list_filter(f, lambda x: x <> '')[1], 'Unknown') END pdf_page_number, length(text)::INT char_count FROM l""",
    "chunk_search": f"""WITH u AS (SELECT k.chunk_uid, b.lang, {_unit('k.embedding::DOUBLE[]')} v FROM {CHUNKS} k JOIN books b ON b.filename = k.filename WHERE k.embedding_dim = 64 AND k.embedding IS NOT NULL),
      d AS (SELECT q.chunk_uid q_id, r.chunk_uid, round(list_distance(q.v, r.v) * list_distance(q.v, r.v), 6) distance FROM u q JOIN u r ON q.lang = r.lang AND q.chunk_uid <> r.chunk_uid WHERE q.chunk_uid % 20 = 0)
      SELECT q_id, "rank", round(distance, 4) distance FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, chunk_uid)::INT "rank" FROM d) WHERE "rank" <= 5""",
    "knn_ivf_recall": "SELECT true enough, count(*) FILTER (WHERE vec_id % 20 = 0) * least(10, count(*) - 1) neighbours FROM embeddings",
    "request_projection": """SELECT DISTINCT feedback_id, trim(question) question, try_cast(regexp_extract(metadata.class, '([0-9]+)', 1) AS INT) class, metadata.subject subject, metadata.lang lang,
        strftime(asked_at::TIMESTAMP, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' sent_at FROM feedback""",
    "folder_subjects": f"""WITH t AS (SELECT * FROM {_TREE} QUALIFY upper = bool_or(upper) OVER (PARTITION BY class))
      SELECT class, {_INITCAP.format('s')} subject, {_INITCAP.format('l')} "language", CASE l WHEN 'hindi' THEN 'hi' WHEN 'urdu' THEN 'ur' ELSE 'en' END lang_code, count(*) pdf_count FROM t GROUP BY ALL""",
    "picked_subject": f"""WITH t AS (SELECT * FROM {_TREE} QUALIFY upper = bool_or(upper) OVER (PARTITION BY class))
      SELECT class, 'Science' subject, 'English' "language", 'en' lang_code, count(*) pdf_count FROM t WHERE lower(s) = 'science' AND l = 'english' GROUP BY class""",
    "index_selection": f"""WITH i AS (SELECT b.class::VARCHAR class, {_slug('b.subject')} subject_slug, b.lang FROM {CHUNKS} c JOIN books b ON b.filename = c.filename),
      s AS (SELECT 'one' selection, * FROM i WHERE class = '9' AND subject_slug = 'social-science' AND lang = 'en'
        UNION ALL SELECT 'first', * FROM i WHERE class = '8' AND lang = 'hi' AND subject_slug = (SELECT min(subject_slug) FROM i WHERE class = '8' AND lang = 'hi')
        UNION ALL SELECT 'whole', * FROM i WHERE class = '10' AND lang = 'en' UNION ALL SELECT 'language', * FROM i WHERE subject_slug = 'mathematics' AND lang = 'hi'
        UNION ALL SELECT 'named', * FROM i WHERE class = '10' AND lang = 'hi')
      SELECT selection, class, subject_slug, count(*) n FROM s GROUP BY ALL""",
    "eval_rate_limits": f"SELECT coalesce(nullif(metadata.rejection_type, ''), 'answered') outcome, count(*) n FROM {FEEDBACK} GROUP BY 1",
    "eval_response_time": """WITH f AS (SELECT DISTINCT feedback_id, asked_at, received_at, metadata FROM feedback), t AS (SELECT coalesce(metadata.status, 'error') status, (epoch_us(received_at) - epoch_us(asked_at)) / 1e6 s FROM f)
      SELECT status, count(s) n, round(avg(s), 6) avg_s, min(s) min_s, max(s) max_s FROM t GROUP BY status""",
    "eval_cases_of_class": "SELECT item_id, subject, lang FROM exam_items WHERE class = 9",
    "eval_subject_outcomes": """WITH o AS (SELECT DISTINCT doc_id, filename, error FROM ocr_results)
      SELECT b.subject, count(*) FILTER (WHERE error IS NULL) succeeded, count(*) FILTER (WHERE error IS NOT NULL) failed, CASE WHEN count(error) = 0 THEN 'SUCCESS' ELSE 'FAILED' END outcome
      FROM o JOIN books b ON b.filename = o.filename GROUP BY b.subject""",
    "cleaned_scans": f"""SELECT DISTINCT doc_id, t cleaned_text, CASE WHEN NOT hindi THEN ({' + '.join(f"coalesce(len(regexp_extract_all(t, '{p}')), 0)" for _, p in MARKERS)})::INT END structures, told chapter, section, '10' class, subject, filename,
        length(coalesce(full_text, ''))::INT char_count_original, length(t)::INT char_count_cleaned, coalesce(len(pages), 0)::INT total_pages, len(regexp_extract_all(t, '[\\x{{0900}}-\\x{{097F}}]'))::INT devanagari_chars,
        CASE WHEN length(t) > 0 THEN round_even(len(regexp_extract_all(t, '[\\x{{0900}}-\\x{{097F}}]')) / length(t) * 100, 1) ELSE 0.0 END devanagari_percentage FROM ({_cleaned_scans()})""",
    "ingest_documents": _ingest(),
    "answer_pipeline": _pipeline(),
}
