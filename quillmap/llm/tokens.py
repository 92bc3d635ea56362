"""Problem 6: encoding of a corpus with a public byte-level tokenizer.

Texts are cut into words by the tokenizer's pattern. A short word is merged over a contiguous rank array: the boundaries of its
parts and the rank of each adjacent pair are held side by side, the minimum is found by a scan, its boundary is deleted and
the two neighbouring ranks are refreshed. Long words, where scans would be quadratic, merge the same pairs from a heap.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; every operator takes another folder as a parameter.
FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern that cuts a text into words before merging, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the white space of Unicode, which the pattern's ``\s`` means.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NONE = 1 << 60
#: Words of more bytes than this merge from a heap.
SHORT = 100


def _pattern(letters: str, digits: str) -> str:
    """The published pattern with its classes spelt out; letters and digits come first, being the most frequent."""
    other = rf" ?[^{SPACE}{letters}{digits}]+"
    return rf" ?[{letters}]+| ?[{digits}]+|'s|'t|'re|'ve|'m|'ll|'d|{other}|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


#: For ASCII the standard module is more than twice as fast.
CUT_ASCII = re.compile(_pattern("A-Za-z", "0-9")).findall
CUT_ANY = regex.compile(_pattern(r"\p{L}", r"\p{N}")).findall
#: Line ends between two characters that aren't blank: words never reach across them.
LINE_ENDS = re.compile(r"(?<=\S)([\r\n]+)(?=\S)").split


def words_of(text: str) -> list[str]:
    """The words of a text in order. Lines are cut one by one, which gives the same words (see ``LINE_ENDS``)."""
    if text.isascii():
        return CUT_ASCII(text)
    out: list[str] = []
    for i, part in enumerate(LINE_ENDS(text)):
        if i % 2:
            # a run of line ends before a word: all but its last character is one word
            out += (part[:-1], part[-1]) if len(part) > 1 else (part,)
        else:
            out += CUT_ASCII(part) if part.isascii() else CUT_ANY(part)
    return out


class Encoder:
    """Ids of texts by one vocabulary. Words seen are kept, up to ``most_words``; then keeping starts anew."""

    def __init__(self, path: str, most_words: int = 400_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.words: dict[str, list[int]] = {}
        self.most_words = most_words

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        return self._scan(word) if len(word) <= SHORT else self._heap(word)

    def _scan(self, word: bytes) -> list[int]:
        ranks = self.ranks
        bounds = list(range(len(word) + 1))
        pair = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while pair:
            least = min(pair)
            if least == NONE:
                break
            at = pair.index(least)
            del bounds[at + 1], pair[at]
            if at < len(pair):
                pair[at] = ranks.get(word[bounds[at] : bounds[at + 2]], NONE)
            if at:
                pair[at - 1] = ranks.get(word[bounds[at - 1] : bounds[at + 1]], NONE)
        return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _heap(self, word: bytes) -> list[int]:
        ranks, n = self.ranks, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [ranks.get(word[i : i + 2], NONE) for i in range(n)]
        now[n - 1] = NONE
        heap = [(r, i) for i, r in enumerate(now) if r != NONE]
        heapq.heapify(heap)

        def refresh(i: int) -> None:
            j = after[i]
            now[i] = ranks.get(word[i : after[j]], NONE) if j < n else NONE
            if now[i] != NONE:
                heapq.heappush(heap, (now[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:
                continue
            gone = after[i]
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            now[gone] = NONE
            refresh(i)
            if before[i] >= 0:
                refresh(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : after[i]]])
            i = after[i]
        return out

    def _new(self, word: str) -> list[int]:
        if len(self.words) >= self.most_words:
            self.words.clear()
        # a lone surrogate has no UTF-8 form; it becomes a question mark
        ids = self.merge(word.encode("utf-8", "replace"))
        if len(word) <= SHORT:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, new, extend = self.words.get, self._new, out.extend
        for word in words_of(text):
            extend(get(word) or new(word))
        return out

    def count(self, text: str) -> int:
        get, new = self.words.get, self._new
        return sum([len(get(word) or new(word)) for word in words_of(text)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k", folder: str = FOLDER) -> str:
    return f"{folder}/{name}.tiktoken"


def token_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of every document, without special tokens; control words in a text are plain text.

    Null and empty texts give an empty list; blank texts are encoded like any other. Repeated rows and null ids stay as they
    are. A text is encoded whole, however long.
    """
    path = path or vocabulary()
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            flat: list[np.ndarray] = []
            ends, total, start = [0], 0, 0
            names = batch.column(0)
            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                ids = enc.encode(t) if t else []
                total += len(ids)
                flat.append(np.array(ids, dtype=np.int32))
                ends.append(total)
                if total > 4_000_000:
                    yield _lists(names.slice(start, i + 1 - start), flat, ends, doc_id)
                    flat, ends, total, start = [], [0], 0, i + 1
            if start < len(names):
                yield _lists(names.slice(start), flat, ends, doc_id)

    return docs.select(doc_id, F.col(text).alias("_text")).mapInArrow(run, f"`{doc_id}` {id_type}, ids array<int>")


def _lists(ids: pa.Array, flat: list[np.ndarray], ends: list[int], name: str) -> pa.RecordBatch:
    values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[name, "ids"])


def token_texts(rows: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of every list of ids: the way back from :func:`token_ids`.

    A null list gives a null text, an empty one an empty text. Bytes that aren't UTF-8, as where a list was cut within a letter, become U+FFFD.
    """
    path = path or vocabulary()
    id_type = rows.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: word for word, rank in encoder(path).ranks.items()}
        for batch in batches:
            texts = [None if own is None else b"".join([token[i] for i in own]).decode("utf-8", "replace") for own in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[doc_id, "text"])

    return rows.select(doc_id, F.col(ids).alias("_ids")).mapInArrow(run, f"`{doc_id}` {id_type}, text string")


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` of every document with ``tokens``, the number of its ids; 0 for null and empty texts."""
    path = path or vocabulary()
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = [enc.count(t) if t else 0 for t in (x.as_py() for x in batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
