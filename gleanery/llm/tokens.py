"""Token counts and ids of whole texts, each distinct pre-token encoded once.

A text is cut into pre-tokens (runs of letters, single digits, contractions, runs of other
marks). Pre-tokens never cross white space and are encoded independently of each other, so
the tokens of a text are the pieces of its pre-tokens. Within a block of documents the
distinct pre-tokens are encoded once, and are joined in memory to the pre-token frequencies
of each document. Nothing is shuffled, and the number of tokens is summed without ids.

The fast cut is used for characters below U+0180, where it is exact (case folding there is one
to one, and composed forms stay as they are); its pre-tokens go to the library's model alone, without
its normalizer and cuts. A white-space-delimited word with any other
character, or with the beginning of a special string, goes through the library unchanged.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gleanery.llm.common import resident, slices, texts

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_DIGITS = "0-9²³¹¼-¾"
_SPACE = "\t-\r \x85\xa0"
_PRE = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACE}{_LETTERS}{_DIGITS}]+")
_BREAK = re.compile("[ \t-\r]+")
#: The character that byte-level pieces have for each byte: its own where that can be printed, else one from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
#: U+0130 folds to two characters, of which one is above the range; "<|" begins the special strings.
_UNSURE = re.compile("[^\x00-įı-ſ]|<\\|")


class PreTokenCodec:
    """Encodes pre-tokens, keeping what it knows in two generations of bounded dictionaries.

    value: what is kept for the ids of a pre-token (a count, or packed ids).
    most: about how many bytes a generation holds before it grows old; the older one is then dropped.
    """

    def __init__(self, path: str, value: Callable[[list[int]], object], most: int = 24 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._pieces = self._library.model.tokenize
        # Pre-tokens of the fast cut are ready for the model, if the library does nothing else to any of their characters.
        known = [x for c in range(0x180) if not _UNSURE.search(chr(c)) for x in _PRE.findall(chr(c).lower())]
        self._direct = all(self._ids(x) == self._model_ids(x) for x in known)
        self._value = value
        self._most = most
        self._held = 0
        self._young: dict[str, object] = {}
        self._old: dict[str, object] = {}

    def _ids(self, word: str) -> list[int]:
        return self._library.encode(word.removeprefix(" "), add_special_tokens=False).ids

    def _model_ids(self, word: str) -> list[int]:
        plain = word.isascii() and word.isprintable()
        return [x.id for x in self._pieces(word if plain else word.encode().decode("latin-1").translate(_BYTES))]

    def _encode(self, word: str) -> object:
        return self._value(self._model_ids(word) if self._direct and word[0] != " " else self._ids(word))

    def learn(self, words) -> dict[str, object]:
        """A dictionary with (at least) all of ``words``."""
        young, old = self._young, self._old
        if self._held > self._most:
            self._old = old = young
            self._young = young = {}
            self._held = 0
        for word in words:
            if word not in young:
                known = old.get(word)
                young[word] = known = self._encode(word) if known is None else known
                self._held += 150 + len(word) + (len(known) if isinstance(known, bytes) else 0)
        return young

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pre-tokens of the text, in order; unsure words stay whole, marked by a leading space."""
        if not _UNSURE.search(text):
            return _PRE.findall(text.lower())
        out: list[str] = []
        for word in _BREAK.split(text):
            if _UNSURE.search(word):
                out.append(" " + word)
            else:
                out += _PRE.findall(word.lower())
        return out


def _codec(path: str, kind: str) -> PreTokenCodec:
    """One codec for each Python worker, kept between its tasks."""
    value = len if kind == "count" else (lambda ids: np.asarray(ids, dtype="<u4").tobytes())
    return resident(f"codec {kind} {path}", lambda: PreTokenCodec(path, value))


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", most: int = 2048) -> DataFrame:
    """Number of tokens of every text.

    Returns key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > most), one row for each input
    row, repeated rows included. A null text counts as empty: 0 bytes, 0 tokens. Columns other
    than key and text are ignored, whatever their names. path: a vocabulary file of ``tokenizers``
    that splits by words as this module does.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, "count")
        for part in slices(batches, "text"):
            frequencies = [Counter(codec.cut(x)) for x in texts(part.column("text"))]
            pieces = codec.learn(set().union(*frequencies))
            n = [sum(k * pieces[word] for word, k in f.items()) for f in frequencies]
            size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("key"), size, pa.array(n, pa.int64()), pa.array([x > most for x in n], pa.bool_())], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    frame = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return frame.withColumnRenamed("key", key)


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Ids of every text and then end_id, cut into pieces of at most ``capacity``.

    Returns key, piece (from 0), start (ids of the document before it), length, ids (packed
    little-endian unsigned 32-bit). A null or empty text is the end id alone.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, "ids")
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for part in slices(batches, "text"):
            keys, out = part.column("key").to_pylist(), ([], [], [], [], [])
            cuts = [codec.cut(x) for x in texts(part.column("text"))]
            known = codec.learn(set().union(*cuts)).__getitem__
            for k, words in zip(keys, cuts, strict=True):
                ids = b"".join(map(known, words)) + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (k, i, at // 4, len(piece) // 4, piece), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], part.schema.field("key").type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], ["key", "piece", "start", "length", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    frame = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(pieces, f"key {kind}, piece int, start long, length long, ids binary")
    return frame.withColumnRenamed("key", key)

