"""Byte-pair encoding and decoding with a word-level vocabulary file.

Text is put in NFC and lower case, cut at white space, and each remaining word is cut into letters runs, single
digits, contractions and runs of other signs. A word starts as bytes; the pair of the lowest rank is joined until no
pair has a rank. Short words of one batch are joined side by side: a row holds the word's parts and, beside them, the
rank of each part with the next. Each turn takes the least rank of every row, deletes that boundary and looks up the
two ranks beside it. Words of more than :data:`SHORT` bytes keep their boundaries in a linked list with a heap, as a
scan of the whole row at each turn would cost the square of the length.

The file is the JSON of the ``tokenizers`` library and is loaded once in each Python worker.
"""

from __future__ import annotations

import heapq
import json
import re
import string
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SHORT = 40
#: Entries of a worker's word cache; beyond it the cache starts anew, so memory stays bounded on any corpus.
CACHE = 250_000
_NONE = np.int32(2**31 - 1)
_LOADED: dict[str, WordBpe] = {}
#: Lower case that Python's Unicode tables lack (Unicode 16 and 17), and the plain small sigma. Fixed values.
_LOWER = (
    {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
    | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
    | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
)
_LOWER_SIGNS = frozenset(map(chr, _LOWER))
#: Letters and digits of later Unicode versions than the library's patterns know, where they count as signs. Fixed values.
_LATER_RANGES = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_LATER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _LATER_RANGES) + "]")


def _western(text: str) -> bool:
    """Whether all signs are of Latin-1; a quick way past the tables above."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _byte_signs() -> list[str]:
    """The printable sign that stands for each byte in the file: itself, or the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in signs:
            signs[b] = chr(free)
            free += 1
    return [signs[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab: dict[str, int] = file["model"]["vocab"]
        suffix = file["model"]["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        self.size = size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], dtype=np.int64)
        self._ranked = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        by_key = np.array(sorted(self._ranked), dtype=np.int64)
        self._keys, self._ranks = by_key, np.array([self._ranked[int(k)] for k in by_key], dtype=np.int32)
        self._joined = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        signs = _byte_signs()
        self._inner = np.array([vocab[s] for s in signs], dtype=np.int32)
        self._last = np.array([vocab[s + suffix] for s in signs], dtype=np.int32)
        # ranks of two bytes, the second inside a word or (from 256 on) at its end
        ends = np.concatenate([self._inner, self._last])
        self._first = self._rank(np.repeat(self._inner, 512), np.tile(ends, 256))
        pattern = next(p for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self._words = regex.compile(pattern)
        self._special = special
        self._marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self._odd_space = re.compile("[\x1c-\x1f]")
        self.cache: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._ranks[at], _NONE)

    def _short(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of at most SHORT bytes, little-endian, side by side."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(size, kind="stable")
        for rows in np.array_split(order, max(1, len(order) // 4096)) if words else ():
            n, wide = size[rows], int(size[rows[-1]])
            flat = np.frombuffer(b"".join(words[i] for i in rows), dtype=np.uint8)
            cell = np.arange(wide) < n[:, None]
            parts = np.full((len(rows), wide + 1), -1, dtype=np.int32)
            parts[:, :-1][cell] = self._inner[flat]
            last = flat[np.cumsum(n) - 1]
            parts[np.arange(len(rows)), n - 1] = self._last[last]
            ranks = np.full((len(rows), wide), _NONE, dtype=np.int32)
            ends, pair = np.cumsum(n) - 1, flat[:-1].astype(np.int64) * 512 + flat[1:]
            pair[ends[n > 1] - 1] += 256
            inner = cell.copy()
            inner[np.arange(len(rows)), n - 1] = False
            ranks[inner] = self._first[np.delete(pair, ends[:-1])]
            left, n = rows, n.copy()
            while len(left):
                at = ranks.argmin(axis=1)
                line = np.arange(len(left))
                least = ranks[line, at]
                more = least < _NONE
                if not more.all():
                    whole = ~more
                    flat, row = parts[whole].astype("<u4").tobytes(), 4 * parts.shape[1]
                    for k, (i, size_i) in enumerate(zip(left[whole].tolist(), n[whole].tolist(), strict=True)):
                        out[i] = flat[k * row : k * row + 4 * size_i]
                    left, parts, ranks, n, at, least = left[more], parts[more], ranks[more], n[more], at[more], least[more]
                    line = np.arange(len(left))
                    if not len(left):
                        break
                parts[line, at] = self._joined[least]
                n -= 1
                wide = ranks.shape[1]
                cols = np.arange(wide)
                step = np.minimum(cols + (cols > at[:, None]), wide)
                parts = np.take_along_axis(parts, step, axis=1)
                parts = np.concatenate([parts, np.full((len(left), 1), -1, np.int32)], axis=1)
                ranks = np.take_along_axis(ranks, np.minimum(step, wide - 1), axis=1)
                ranks[:, -1] = _NONE
                ranks[line, at] = self._rank(parts[line, at], parts[line, at + 1])
                back = np.flatnonzero(at > 0)
                ranks[back, at[back] - 1] = self._rank(parts[back, at[back] - 1], parts[back, at[back]])
        return out

    def _long(self, word: bytes) -> bytes:
        parts = self._inner[np.frombuffer(word, dtype=np.uint8)].tolist()
        parts[-1] = int(self._last[word[-1]])
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranked, size = self._ranked, self.size
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranked.get(parts[i] * size + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(self._joined[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := ranked.get(parts[i] * size + parts[k])) is not None:
                    heapq.heappush(heap, (s, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (s := ranked.get(parts[h] * size + parts[i])) is not None:
                heapq.heappush(heap, (s, h, parts[h], parts[i]))
        return np.array([p for p in parts if p >= 0], dtype="<u4").tobytes()

    def _cut(self, chunk: str) -> list[str]:
        core = chunk.rstrip(string.punctuation)
        if core.isalpha() and _western(chunk):
            # a run of letters is one word, and so are the signs behind it
            return [core, chunk[len(core) :]] if len(core) < len(chunk) else [chunk]
        if not chunk.isascii() and not _western(chunk) and _LATER.search(chunk):
            # same length, so words are cut from the chunk itself
            known = _LATER.sub("\x01", chunk)
            return [chunk[m.start() : m.end()] for m in self._words.finditer(known)]
        return self._words.findall(chunk)

    def _learn(self, chunks: set[str]) -> None:
        """Puts the ids of unseen chunks (text between white space) into the cache."""
        cache = self.cache
        plain = {c for c in chunks if c.isascii() and c.isalpha()}
        odd = list(chunks - plain)
        cut = [self._cut(c) for c in odd]
        # a word alone is cut no further, so what is known of it as a chunk holds
        plain.update(w for w in set(chain.from_iterable(cut)) if w not in cache)
        words = list(plain)
        coded = [w.encode() for w in words]
        size = list(map(len, coded))
        if max(size, default=0) <= SHORT:
            cache.update(zip(words, self._short(coded), strict=True))
        else:
            for w, x in zip(words, coded, strict=True):
                if len(x) > SHORT:
                    cache[w] = self._long(x)
            short = [k for k, n in enumerate(size) if n <= SHORT]
            cache.update(zip([words[k] for k in short], self._short([coded[k] for k in short]), strict=True))
        known = cache.__getitem__
        cache.update([(c, b"".join(map(known, ws))) for c, ws in zip(odd, cut, strict=True) if len(ws) != 1])

    def _chunks(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if not _western(text) and not _LOWER_SIGNS.isdisjoint(text):
            # lower case goes by single characters: no final sigma; and by a later Unicode version than Python's
            text = text.translate(_LOWER)
        text = text.lower()
        return regex.split(r"\s+", text) if self._odd_space.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers; a null text is empty."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        found: list[list[bytes | None]] = []
        missed: list[tuple[int, list[int], list[str]]] = []
        for t in texts:
            parts: list[str | int] = []
            if t:
                if self._marks is not None and "<|" in t:
                    for s in self._marks.split(t):
                        if s in self._special:
                            parts.append(i := self._special[s])
                            cache[i] = np.array([i], dtype="<u4").tobytes()
                        else:
                            parts.extend(self._chunks(s))
                else:
                    parts = self._chunks(t)
            known = list(map(cache.get, parts))
            if None in known:
                # only these wait for their ids and are looked up again
                at = [k for k, x in enumerate(known) if x is None]
                missed.append((len(found), at, [parts[k] for k in at]))
            found.append(known)
        if missed:
            self._learn(set(chain.from_iterable(m[2] for m in missed)))
            for k, at, parts in missed:
                known = found[k]
                for i, p in zip(at, parts, strict=True):
                    known[i] = cache[p]
        return [b"".join(known) for known in found]

    def decode(self, ids: bytes) -> str:
        """The tokens of ``ids`` with a space between them, as the file names no decoder."""
        return b" ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I") if ids else ())).decode()


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row (doc_id, ids binary) per row of ``docs``: the ids of the whole text, little-endian unsigned 32-bit.

    With ``decoded`` a third column holds the text that these ids decode to. Null and empty texts give no ids and an
    empty decoded text. Repeated rows stay repeated, null doc_ids stay null, other columns are not read. Narrow: no
    shuffle, a task holds one slice of texts.
    """
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in slices(batches, "text", 1 << 20):
            ids = bpe.encode(b.column("text").to_pylist())
            out = {"doc_id": b.column("doc_id"), "ids": pa.array(ids, pa.binary())}
            if decoded:
                out["decoded"] = pa.array([bpe.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return wanted.mapInArrow(run, f"doc_id {kind}, ids binary" + (", decoded string" if decoded else ""))


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded string) per row of ``rows``: the tokens of the binary ids; null ids decode to an empty text."""
    wanted = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in slices(batches, "ids", 1 << 20):
            texts = [bpe.decode(x or b"") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "decoded": pa.array(texts, pa.string())})

    return wanted.mapInArrow(run, f"doc_id {kind}, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of whole texts, from :func:`encode`."""
    coded = encode(docs, path, decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
