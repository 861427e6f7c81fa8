"""Scalar text functions as Column expressions; nothing here leaves the JVM.

White space is matched as Unicode white space. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import lexicon as lx

WS = r"(?U)\s"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once; a lambda in f would otherwise compute it for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """no-break spaces and runs of blanks become one space, three or more line ends two."""
    text = F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), "[ \t]+", " ")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def normalize_space(text: Column) -> Column:
    """every run of white space becomes one space."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def normalize_for_tokenize(text: Column) -> Column:
    """lower case, anything but word characters becomes a space."""
    return F.trim(F.regexp_replace(F.lower(text), f"[^{lx.WORD}]+", " "))


def tokenize(text: Column, min_len: int = 1) -> Column:
    """word tokens in order, repeated ones too, without stop words and short ones."""
    return F.filter(F.split(normalize_for_tokenize(text), " "), lambda t: (F.length(t) >= max(1, min_len)) & ~t.isin(*lx.STOPWORDS))


def prefixed(text: Column, kind: str) -> Column:
    """the text as an embedding model takes it: kind is "passage" or "query"."""
    return F.concat(F.lit(f"{kind}: "), text)


def overlap_of(tokens: Column, normalized: Column) -> Column:
    """F6 for distinct query tokens and a normalized text: the share of tokens that the text contains."""
    share = lambda p: F.when(F.size(p["tokens"]) == 0, F.lit(0.0)).otherwise(F.size(F.filter(p["tokens"], lambda t: F.contains(p["text"], t))) / F.size(p["tokens"]))
    return bound(F.struct(tokens.alias("tokens"), normalized.alias("text")), share)


def query_overlap(question: Column, text: Column) -> Column:
    """share of the question's distinct tokens of two or more characters that the text contains."""
    return overlap_of(F.array_distinct(tokenize(question, 2)), normalize_for_tokenize(text))


def intent(question: Column) -> Column:
    """kind of answer that the question asks for."""
    q = normalize_space(question)
    out = None
    for name, pattern in lx.INTENTS:
        out = F.when(q.rlike(pattern), name) if out is None else out.when(q.rlike(pattern), name)
    return out.otherwise("general")


def is_list_style(question: Column) -> Column:
    """F8: whether the question asks for a list."""
    return intent(question) == "list"


def list_signal(text: Column) -> Column:
    """how much the text looks like a list."""
    t = normalize_space(text)
    n = lambda pattern, most: F.least(_count(t, pattern), F.lit(most))
    bullets = F.least(_count(text, f"[{lx.BULLETS}-](?U:\\s)*[^\n]+"), F.lit(8))
    return n("[,，]", 12) * 0.35 + bullets * 0.25 + n("[:：]", 4) * 0.4 + n("[()]", 8) * 0.05 + n(f"[{lx.CIRCLED}]", 8) * 0.2


def token_estimate(text: Column) -> Column:
    """estimated number of model tokens."""
    other = F.length(F.regexp_replace(text, "[\\x00-\\x7F]", ""))
    return F.greatest(F.lit(1), F.floor((F.length(text) - other) / 4) + F.floor(other / 1.7) + 32).cast("long")


def clean_unit(text: Column) -> Column:
    """a unit without bullets and with tidy commas."""
    t = F.regexp_replace(normalize_space(text), f"^[{lx.BULLETS}\\-*\\s]+", "")
    t = F.regexp_replace(strip(t), r"\s*,\s*,\s*", ", ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+,", ","), r",\s+", ", ")
    return F.regexp_replace(F.regexp_replace(t, r"\s{2,}", " "), "^[ ,]+|[ ,]+$", "")


def canonical(text: Column) -> Column:
    """letters and digits of the clean unit, in lower case."""
    return F.lower(F.regexp_replace(clean_unit(text), "[^가-힣a-zA-Z0-9]+", ""))


_CLEAN = "[가-힣a-zA-Z0-9" + "".join("\\" + c if c in "[]{}()-+*?.^$|/&~<>#'\":;,%!=_@ " else c for c in lx.CLEAN_MARKS) + "]"


def noise_ratio(text: Column) -> Column:
    """share of the visible characters that are neither word characters nor usual marks."""
    visible = F.regexp_replace(text, WS, "")
    total = F.length(visible)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - _count(visible, _CLEAN) / total))


def ocr_quality(text: Column) -> Column:
    """share of word characters, less noise and a penalty for length."""
    t = normalize_space(text)
    visible = F.length(F.regexp_replace(t, WS, ""))
    penalty = F.when(F.length(t) > 700, 0.4).when(F.length(t) > 300, 0.15).otherwise(0.0)
    return F.when(F.length(t) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), _count(t, "[가-힣a-zA-Z0-9]") / F.greatest(visible, F.lit(1)) - noise_ratio(t) - penalty))


def is_noisy(text: Column, threshold: float = 0.28) -> Column:
    """too noisy to be shown."""
    t = normalize_space(text)
    n, noise = F.length(t), noise_ratio(t)
    symbols = _count(t, r"[<>{}\[\]=_/\\|]") / F.greatest(n, F.lit(1))
    return (n == 0) | ((n > 600) & (noise > 0.16)) | (noise >= threshold) | ((n > 250) & (symbols > 0.035))


def is_garbled(text: Column) -> Column:
    """F16: too many broken tokens. In the class of usual marks, + to [ is a range, as in the rule it follows."""
    t = normalize_space(text)
    compact = F.regexp_replace(t, WS, "")
    n = F.length(compact)
    symbols = _count(compact, r"[<>{}\[\]=_/\\|~`^]")
    digits = _count(compact, r"(?U)\d{5,}")
    urls = _count(t, r"(?i)(?:https?|www|[0-9]{2}//|\.do|\.go|\.kr)")
    rare = _count(t, r"""[^가-힣a-zA-Z0-9\s().,:%/+-\[\]{}<>·ㆍ'"!?？:;=~_#&*@₩☎]""")
    ratio = (symbols + rare + digits * 3 + urls * 2) / F.greatest(n, F.lit(1))
    return (n == 0) | (ratio >= 0.055) | ((F.length(t) > 250) & ((digits >= 2) | (urls >= 2)))


def is_unacceptable_ocr(kind: Column, text: Column) -> Column:
    """an OCR unit that no answer may show."""
    t = normalize_space(text)
    return (kind == "ocr") & ((F.length(t) > 300) | is_noisy(t) | is_garbled(t))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; of a shorter text, the text."""
    return bound(text, lambda t: F.when(F.length(t) < 2, F.array(t)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2))))))


def bigram_similarity(a: Column, b: Column) -> Column:
    """F18 without its sequence ratio: 0 for an empty canonical text, 1 for containment, else the bigrams' Jaccard."""
    def like(p: Column) -> Column:
        ga, gb = bigrams(p["x"]), bigrams(p["y"])
        jaccard = F.size(F.array_intersect(ga, gb)) / F.size(F.array_union(ga, gb))
        return F.when((p["x"] == "") | (p["y"] == ""), 0.0).when(F.contains(p["x"], p["y"]) | F.contains(p["y"], p["x"]), 1.0).otherwise(jaccard)

    return bound(F.struct(canonical(a).alias("x"), canonical(b).alias("y")), like)


def unit_priority(kind: Column, role: Column, text: Column, score: Column) -> Column:
    """sort key of units for an answer (clean kinds, bodies, short ones and high scores first)."""
    of = lambda x, table, other: _case(x, table).otherwise(other)
    return F.struct(
        of(kind, lx.KIND_PRIORITY, 9).alias("kind"),
        F.when(role.isNull(), lx.ROLELESS).otherwise(of(role, lx.ROLE_PRIORITY, 4)).alias("role"),
        F.length(clean_unit(text)).alias("length"),
        (-score).alias("score"),
    )


def _case(x: Column, table: dict) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(x == key, value) if out is None else out.when(x == key, value)
    return out


def requested_count(question: Column) -> Column:
    """the least number of items that the question asks for, or null."""
    q = normalize_space(question)
    digits = F.regexp_extract(q, rf"(?U)(\d+)\s*(?:{lx.COUNTERS})\s*이상", 1)
    word = F.regexp_extract(q, rf"({'|'.join(lx.NUMERALS)})\s*(?:{lx.COUNTERS})\s*이상", 1)
    numeral = None
    for name, n in lx.NUMERALS.items():
        numeral = F.when(word == name, n) if numeral is None else numeral.when(word == name, n)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), numeral)


def first_wins(items: Column, key) -> Column:
    """The items of an array whose key did not come before, in order; empty keys go."""
    keyed = F.filter(F.transform(items, lambda x: F.struct(x.alias("x"), key(x).alias("k"))), lambda s: s["k"] != "")
    return bound(keyed, lambda kept: bound(F.transform(kept, lambda s: s["k"]), lambda keys: F.transform(F.filter(kept, lambda s, i: F.array_position(keys, s["k"]) == i + 1), lambda s: s["x"])))


def list_payload(text: Column) -> Column:
    """C14: what a list unit lists (after its first colon), as text."""
    t = clean_unit(text)
    after = strip(F.element_at(F.split(t, "[:：]", 2), -1))
    t = F.when(t.rlike("[:：]") & (F.length(after) >= 2), after).otherwise(t)
    return normalize_space(F.regexp_replace(F.regexp_replace(t, r"\s*,\s*,\s*", ", "), r"^[,，\s]+|[,，\s]+$", ""))


def list_items(text: Column) -> Column:
    """C14: the distinct items of a list unit, in order."""
    items = F.transform(F.split(list_payload(text), r"\s*,\s*|，|、"), clean_unit)
    return first_wins(F.filter(items, lambda x: ~x.isin("", ",", "，", "ㆍ", "·")), canonical)


def render_list(question: Column, text: Column) -> Column:
    """struct(answer, mode) of a list answer: its first items, at least six or as many as were asked for."""
    items = list_items(text)
    most = F.greatest(F.lit(6), F.coalesce(requested_count(question), F.lit(0)))
    joined = F.concat(F.array_join(F.slice(items, F.lit(1), most), ", "), F.when(F.size(items) > most, " 등").otherwise(""))
    many = F.size(items) >= 2
    return F.struct(F.when(many, joined).otherwise(list_payload(text)).alias("answer"), F.when(many, "label_value_list").otherwise("label_value_payload").alias("mode"))


def is_clean_source(kind: Column) -> Column:
    """F22."""
    return kind.isin("text", "section", "table")


def contains_all(text: Column, terms: Column) -> Column:
    """every term stands in the text; false without terms."""
    return (F.size(terms) > 0) & bound(normalize_for_tokenize(text), lambda n: F.forall(terms, lambda t: F.contains(n, normalize_for_tokenize(t))))


def critical_terms(question: Column) -> Column:
    """tokens with a digit, and the fixed literals, that an answer must repeat."""
    literals = F.array(*[F.lit(x) for x in lx.CRITICAL])
    return F.array_distinct(F.concat(F.filter(tokenize(question, 2), lambda t: t.rlike(r"(?U)\d")), F.filter(literals, lambda x: F.contains(question, x))))


def rendered_items(answer: Column) -> Column:
    """number of items in a rendered list."""
    pieces = F.filter(F.transform(F.split(answer, "[,，、]"), normalize_space), lambda x: ~x.isin("", "등", "없음"))
    return F.when(F.size(list_items(answer)) > 0, F.size(list_items(answer))).otherwise(F.size(pieces))


def structural_score(line: Column) -> Column:
    """how much a line looks like a part of a structure."""
    t = normalize_space(line)
    add = lambda pattern, x: F.when(t.rlike(pattern), x).otherwise(0.0)
    words = F.when((F.length(t) <= 80) & t.rlike(lx.STRUCTURE_WORDS), 0.7).otherwise(0.0)
    return F.when(t == "", 0.0).otherwise(add(lx.UNIT_START, 1.0) + add(r"[\[\(].{1,40}[\]\)]", 0.5) + add(r"[:：]\s*$", 0.3) + add(r"(?U)\b[A-Z][A-Z0-9/]{1,8}\b", 0.2) + words)


def contains_negation(text: Column) -> Column:
    """F27."""
    return normalize_space(text).rlike(lx.NEGATION)


def polarity(question: Column, text: Column) -> Column:
    """lowers texts that only affirm where the question denies."""
    q, t = contains_negation(question), contains_negation(text)
    return F.when(q & ~t & text.rlike(lx.POSITIVE_ONLY), -0.35).when(q & t, 0.12).otherwise(0.0)


def anchor_relevance(question: Column, anchor: Column) -> Column:
    """F29 for an anchor line: 0.55 overlap + 0.45 Jaccard of tokens; 0 without an anchor."""
    a, b = F.array_distinct(tokenize(question, 2)), F.array_distinct(tokenize(anchor, 2))
    jaccard = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    return F.when(F.coalesce(anchor, F.lit("")) == "", 0.0).otherwise(0.55 * query_overlap(question, anchor) + 0.45 * jaccard)


def anchor_of(kind: Column, role: Column, anchor_text: Column, text: Column) -> Column:
    """the anchor of a chunk: its anchor text, an anchor question's text, or a section's first line."""
    own = normalize_space(F.coalesce(anchor_text, F.lit("")))
    question = F.when(role == "anchor_question", normalize_space(text))
    first = F.when(kind == "section", normalize_space(F.element_at(F.split(text, "\r\n|\n|\r"), 1)))
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(question, F.lit("")), first, F.lit(""))


def answer_view(role: Column, answer_text: Column, text: Column) -> Column:
    """What a chunk can answer with: its answer text, nothing for anchors and contents, else its text."""
    own = F.coalesce(answer_text, F.lit(""))
    return F.when(own != "", clean_text(own)).when(role.isin("anchor_question", "toc"), "").otherwise(clean_text(text))


def page_string(page: Column, page_end: Column) -> Column:
    """F30."""
    return F.when((F.coalesce(page_end, F.lit(0)) != 0) & (page_end != page), F.concat(F.lit("p."), page.cast("string"), F.lit("-"), page_end.cast("string"))).otherwise(F.concat(F.lit("p."), page.cast("string")))


def json_object(text: Column) -> Column:
    """the text if it is JSON, else its outermost braces if they are, else null."""
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(ok(text), ok(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))))


def string_list(items: Column, most: int) -> Column:
    """F32: distinct non-empty strings, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(items, normalize_space), lambda x: x != "")), 1, most)


def as_bool(text: Column) -> Column:
    """F32: true for true, 1, yes and y."""
    return F.lower(F.trim(text)).isin("true", "1", "yes", "y")


def normalize_answer(text: Column) -> Column:
    """lower case, marks become spaces."""
    return normalize_space(F.regexp_replace(F.lower(text), lx.ANSWER_MARKS, " "))


def alias_hit(text: Column, aliases: Column) -> Column:
    """some alias stands in the text, with or without its spaces."""
    compact = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    known = F.filter(F.transform(aliases, normalize_answer), lambda a: a != "")
    hit = lambda p: F.exists(p["aliases"], lambda a: F.contains(p["text"], a) | F.contains(compact(p["text"]), compact(a)))
    return bound(F.struct(normalize_answer(text).alias("text"), known.alias("aliases")), hit)


def page_spec(text: Column) -> Column:
    """the sorted page numbers of "4-8" and "12": ranges (rising, at most 100 apart), then what is left."""
    numbers = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0)), lambda d: d.cast("int"))
    ends = F.transform(F.regexp_extract_all(text, F.lit(lx.PAGE_RANGE), F.lit(0)), numbers)
    fit = F.filter(ends, lambda e: (e[0] <= e[1]) & (e[1] - e[0] <= 100))
    single = numbers(F.regexp_replace(text, lx.PAGE_RANGE, " "))
    return F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(fit, lambda e: F.sequence(e[0], e[1]))), single)))


def heading_title(text: Column) -> Column:
    """A heading's title for comparison: no number, leader, page or marks."""
    t = F.regexp_replace(normalize_space(text), r"(?i)^Q?\s*\d{1,2}\.\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[·.․…]+\s*\d{1,2}\s*$", ""), r"\s+\d{1,2}\s*$", "")
    return F.lower(F.regexp_replace(t, "[^가-힣a-zA-Z0-9]+", ""))


def unit_score(question: Column, text: Column, kind: Column, rerank: Column, rrf: Column, position: Column) -> Column:
    """score of an answer unit before reranking."""
    n, signal, kind_of = F.length(text), list_signal(text), intent(question)
    has = lambda pattern, x: F.when(text.rlike(pattern), x).otherwise(0.0)
    ocr = -2.2 - F.when(n > 300, 1.5).otherwise(0.0) - F.when(n > 800, 2.0).otherwise(0.0) - noise_ratio(text) * 2.0 - F.when(is_noisy(text), 2.0).otherwise(0.0)
    bonus = (
        F.when(kind_of == "list", signal - has("https?://", 0.7) - F.when(text.rlike(f"[{lx.CIRCLED}]") & (signal < 1.5), 0.5).otherwise(0.0))
        .when(kind_of == "procedure", has(lx.PROCEDURE_WORDS, 1.1))
        .when(kind_of == "definition", has(lx.DEFINITION_WORDS, 0.8) - has(lx.DEFINITION_STEPS, 0.4))
        .when(kind_of == "availability", has(lx.AVAILABILITY_WORDS, 0.9))
        .otherwise(0.0)
    )
    base = query_overlap(question, text) * 4.0 + F.coalesce(rerank, F.lit(0.0)) * 0.2 + F.coalesce(rrf, F.lit(0.0)) * 1.5
    return base + F.when(kind == "ocr", ocr).otherwise(0.0) + bonus + F.when(n >= 25, 0.15).otherwise(0.0) - F.when(n > 1200, 0.4).otherwise(0.0) - position * 0.015
