"""Plain versions of the operators, and the odd rows that each must bear."""

import re
from itertools import combinations

from pyspark.sql import types as T

ODD = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("key", "id", "score", "n", "component", "line", "size", "first", "kind", "piece", "group", "_gone")]])


def odd_rows(spark, texts=None):
    """Nulls in every column, empty and long texts, repeated rows and keys, and columns that clash with inner names."""
    long = "one two three four five six seven " * 6000
    base = [
        (1, "The quick brown fox jumps over the lazy dog again and again today", "en"),
        (1, "The quick brown fox jumps over the lazy dog again and again today", "en"),
        (2, None, None),
        (3, "", "en"),
        (4, " \n\t ", "de"),
        (5, long, "en"),
        (6, "Der schnelle braune Fuchs springt über den faulen Hund immer wieder heute", "de"),
        (None, "a text that has no key at all but some words in it", None),
        (7, "12345 !!! 67", "de"),
        (8, "Ünï ʘ漢字 <|endoftext|> don't 'll x", "en"),
    ]
    rows = [(*r, *["x"] * 12) for r in (texts if texts is not None else base)]
    return spark.createDataFrame(rows, ODD)


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(keys, links):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def near_groups(rows, percent=85):
    sets = {k: shingles(t) for k, t in rows}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return components(sets, links)


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def without_repeated_lines(rows, min_words=8, exact_words=8):
    """(kept lines, number removed) of each document; rows in order of key."""
    plain = lambda x: " ".join(x.lower().split())
    seen, out = [], {}
    for key, text in sorted(rows):
        kept = []
        lines = text.split("\n")
        for line in lines:
            p = plain(line)
            n = len(p.split())
            if not p or n < exact_words:
                kept.append(line)
            else:
                like = within_one_edit if n >= min_words else str.__eq__
                if not any(like(p, q) for q in seen if len(q.split()) >= min_words or like == str.__eq__):
                    kept.append(line)
                seen.append(p)
        out[key] = ("\n".join(kept), len(lines) - len(kept))
    return out


def edit_distance_in(pattern, text):
    """Smallest edit distance of the pattern to any substring of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)
