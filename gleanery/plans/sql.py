"""SQL fragments that the oracles share, for the same rules as the Column functions."""

from __future__ import annotations

from gleanery.functions import lexicon as lx

STOP = ", ".join(f"'{w}'" for w in lx.STOPWORDS)


def space(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^가-힣a-z0-9]+', ' ', 'g'))"


def tokens(x: str, least: int = 1) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: length(t) >= {max(1, least)} AND t NOT IN ({STOP}))"


def overlap(q: str, t: str) -> str:
    terms = f"list_distinct({tokens(q, 2)})"
    return f"(CASE WHEN len({terms}) = 0 THEN 0.0 ELSE len(list_filter({terms}, lambda t: contains({norm(t)}, t)))::DOUBLE / len({terms}) END)"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def intent(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({space(x)}, '{p}') THEN '{n}'" for n, p in lx.INTENTS)
    return f"(CASE {whens} ELSE 'general' END)"


def list_signal(x: str) -> str:
    t = space(x)
    bullets = count(x, r"[‣∎•○●-]\s*[^\n]+")
    return f"(least({count(t, '[,，]')}, 12) * 0.35::DOUBLE + least({bullets}, 8) * 0.25::DOUBLE + least({count(t, '[:：]')}, 4) * 0.4::DOUBLE + least({count(t, '[()]')}, 8) * 0.05::DOUBLE + least({count(t, '[①②③④⑤⑥⑦⑧⑨⑩]')}, 8) * 0.2::DOUBLE)"


def clean_unit(x: str) -> str:
    t = rf"regexp_replace({space(x)}, '^[‣∎•○●\-*\s]+', '')"
    t = rf"regexp_replace(trim({t}), '\s*,\s*,\s*', ', ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '\s+,', ',', 'g'), ',\s+', ', ', 'g')"
    return rf"trim(regexp_replace({t}, '\s{{2,}}', ' ', 'g'), ' ,')"


def canonical(x: str) -> str:
    return f"lower(regexp_replace({clean_unit(x)}, '[^가-힣a-zA-Z0-9]+', '', 'g'))"


def noise(x: str) -> str:
    visible = rf"regexp_replace({x}, '\s', '', 'g')"
    marks = r"""[가-힣a-zA-Z0-9().,:%/+\-\[\]{}<>·ㆍ''"!?？:;=~_#&*@₩☎ ]"""
    return f"(CASE WHEN length({visible}) = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - {count(visible, marks)}::DOUBLE / length({visible})) END)"


def estimate(x: str) -> str:
    other = rf"length(regexp_replace({x}, '[\x00-\x7F]', '', 'g'))"
    return f"CAST(greatest(1, floor((length({x}) - {other}) / 4.0) + floor({other} / 1.7) + 32) AS BIGINT)"


def heading_title(x: str) -> str:
    t = rf"regexp_replace({space(x)}, '(?i)^Q?\s*\d{{1,2}}\.\s*', '')"
    t = rf"regexp_replace(regexp_replace({t}, '[·.․…]+\s*\d{{1,2}}\s*$', ''), '\s+\d{{1,2}}\s*$', '')"
    return f"lower(regexp_replace({t}, '[^가-힣a-zA-Z0-9]+', '', 'g'))"


def answer_norm(x: str) -> str:
    marks = lx.ANSWER_MARKS.replace("'", "''")
    return space(f"regexp_replace(lower({x}), '{marks}', ' ', 'g')")


#: The lines of documents as blocks.
BLOCKS = f"""
blocks AS (
  SELECT doc_id AS page, source AS source_title, CAST(n - 1 AS INTEGER) AS block_no, doc_id * 4294967296 + n - 1 AS chunk_index, {clean('raw')} AS text
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL)
  WHERE length({clean('raw')}) >= 10)"""

#: Every benchmark item as a question.
QUESTIONS = r"""
questions AS (SELECT item_id AS qid, trim(regexp_replace(text, '\s+', ' ', 'g')) AS query FROM benchmark)"""

#: Every user turn with the assistant's turn that follows.
PAIRS = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

#: Term weights and scores of documents for questions.
BM25 = f"""
doc_tokens AS MATERIALIZED (SELECT doc_id, {tokens('text')} AS toks FROM documents WHERE text IS NOT NULL),
n AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM doc_tokens),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM doc_tokens) GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
tf AS MATERIALIZED (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM doc_tokens) GROUP BY doc_id, dl, term)"""


def bm25_list(queries: str, k: int) -> str:
    """CTEs from queries (qid, query) to ``sparse`` (qid, doc_id, score, rank)."""
    return f"""
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tokens('query')}) AS term FROM {queries}) GROUP BY qid, term),
scored AS MATERIALIZED (SELECT qid, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term), n GROUP BY qid, doc_id),
filled AS (SELECT qid, doc_id, score FROM scored UNION ALL
  SELECT q.qid, d.doc_id, 0.0 FROM {queries} q, (SELECT doc_id FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT {2 * k}) d WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.qid = q.qid AND s.doc_id = d.doc_id)),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM filled) WHERE rank <= {k})"""


def dense_list(queries: str, k: int) -> str:
    """CTE from queries (qid, embedding) to ``dense`` (qid, vec_id, score, rank)."""
    return f"""
products AS (SELECT q.qid, e.vec_id, round(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score FROM {queries} q, embeddings e WHERE e.embedding IS NOT NULL),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM products) WHERE rank <= {k})"""


def list_payload(x: str) -> str:
    t = clean_unit(x)
    after = f"trim(regexp_replace({t}, '^[^:：]*[:：]', ''))"
    t = f"(CASE WHEN regexp_matches({t}, '[:：]') AND length({after}) >= 2 THEN {after} ELSE {t} END)"
    return space(rf"regexp_replace(regexp_replace({t}, '\s*,\s*,\s*', ', ', 'g'), '^[,，\s]+|[,，\s]+$', '', 'g')")


def garbled(x: str) -> str:
    t, compact = space(x), rf"regexp_replace({space(x)}, '\s', '', 'g')"
    symbols, digits = count(compact, r"[<>{}\[\]=_/\\|~`^]"), count(compact, r"\d{5,}")
    urls = count(t, r"(?i)(?:https?|www|[0-9]{2}//|\.do|\.go|\.kr)")
    rare = count(t, r"""[^가-힣a-zA-Z0-9\s().,:%/+-\[\]{}<>·ㆍ''"!?？:;=~_#&*@₩☎]""")
    return f"(length({compact}) = 0 OR ({symbols} + {rare} + {digits} * 3 + {urls} * 2)::DOUBLE / greatest(length({compact}), 1) >= 0.055 OR (length({t}) > 250 AND ({digits} >= 2 OR {urls} >= 2)))"


def noisy(x: str) -> str:
    t = space(x)
    marks = count(t, r"[<>{}\[\]=_/\\|]")
    return f"(length({t}) = 0 OR (length({t}) > 600 AND {noise(t)} > 0.16) OR {noise(t)} >= 0.28 OR (length({t}) > 250 AND {marks}::DOUBLE / greatest(length({t}), 1) > 0.035))"


def requested(x: str) -> str:
    numerals = " ".join(f"WHEN '{w}' THEN {n}" for w, n in lx.NUMERALS.items())
    digits = rf"nullif(regexp_extract({space(x)}, '(\d+)\s*(?:{lx.COUNTERS})\s*이상', 1), '')"
    word = rf"regexp_extract({space(x)}, '({'|'.join(lx.NUMERALS)})\s*(?:{lx.COUNTERS})\s*이상', 1)"
    return f"CAST(coalesce(CAST({digits} AS INTEGER), CASE {word} {numerals} END) AS INTEGER)"


def critical(x: str) -> str:
    literals = ", ".join(f"'{w}'" for w in lx.CRITICAL)
    return f"list_distinct(list_concat(list_filter({tokens(x, 2)}, lambda t: regexp_matches(t, '\\d')), list_filter([{literals}], lambda t: contains({x}, t))))"


def items(x: str) -> str:
    """Items of a list unit, repeated ones too (see distinct_items)."""
    return rf"list_filter(list_transform(regexp_split_to_array({list_payload(x)}, '\s*,\s*|，|、'), lambda x: {clean_unit('x')}), lambda x: x NOT IN ('', ',', '，', 'ㆍ', '·') AND {canonical('x')} <> '')"


def n_items(x: str) -> str:
    """Number of distinct items of a list unit."""
    return f"len(list_distinct(list_transform({items(x)}, lambda x: {canonical('x')})))"


def polarity(question: str, text: str) -> str:
    asked, told = (f"regexp_matches({space(x)}, '{lx.NEGATION}')" for x in (question, text))
    return f"(CASE WHEN {asked} AND NOT {told} AND regexp_matches({text}, '{lx.POSITIVE_ONLY}') THEN -0.35 WHEN {asked} AND {told} THEN 0.12 ELSE 0.0 END)"


def unit_bonus(question: str, text: str) -> str:
    has = lambda pattern, x: f"CASE WHEN regexp_matches({text}, '{pattern}') THEN {x} ELSE 0.0 END"
    circled = f"CASE WHEN regexp_matches({text}, '[{lx.CIRCLED}]') AND {list_signal(text)} < 1.5 THEN 0.5 ELSE 0.0 END"
    return f"""(CASE {intent(question)} WHEN 'list' THEN {list_signal(text)} - {has('https?://', 0.7)} - {circled} WHEN 'procedure' THEN {has(lx.PROCEDURE_WORDS, 1.1)}
  WHEN 'definition' THEN {has(lx.DEFINITION_WORDS, 0.8)} - {has(lx.DEFINITION_STEPS, 0.4)} WHEN 'availability' THEN {has(lx.AVAILABILITY_WORDS, 0.9)} ELSE 0.0 END)"""
