"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A run of three letters is bound into one
vector, the product of the letters' vectors rotated by their place; a text is the sum of its runs, and a language the
sum of its texts. A text gets the language whose vector has the largest cosine with its own.

Sums over runs are products of a count matrix with the run vectors, so a batch of texts takes a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

DIMS = 512
SEED = 7
UNKNOWN = "und"
#: Languages that may be learned: the vectors of so many are held by the driver and every task.
MOST_LANGS = 10_000
#: A text of so many different runs with a cosine below CHANCE is of no known language: unrelated vectors have about 0.044.
LEAST_RUNS, CHANCE = 200, 0.1
#: Characters, run vectors, and counts of runs by text that are held at a time.
PIECE, RUNS, CELLS = 1 << 16, 4096, 1 << 20
_SPACE = 32


class _Runs:
    """Run vectors of a worker, one byte a component, made once for each run of letters; starts anew when full."""

    most = 40_000

    def __init__(self) -> None:
        self.is_letter = np.zeros(0x110000, bool)
        self.is_letter[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.place, self.vectors = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, DIMS), np.int8)

    @staticmethod
    def letter(codes: np.ndarray) -> np.ndarray:
        """The vectors of letters: for each code point and 64 dimensions a word of well mixed bits."""
        own, number = np.unique(codes, return_inverse=True)
        with np.errstate(over="ignore"):
            z = (own.astype(np.uint64)[:, None] * np.uint64(DIMS) + np.arange(DIMS // 64, dtype=np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
        bits = np.unpackbits(z.astype("<u8").view(np.uint8), axis=1).astype(np.int8)
        return (bits * np.int8(2) - np.int8(1))[number]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of sorted, distinct runs (three code points of 21 bits each), at most ``most`` at a time."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        unseen = keys if not len(self.keys) else keys[self.keys[at] != keys]
        if len(unseen):
            if len(self.keys) + len(unseen) > self.most and len(self.keys):
                self.clear()
                return self.of(keys)
            a, b, c = (self.letter(unseen >> k & 0x1FFFFF) for k in (42, 21, 0))
            self.keys = np.concatenate([self.keys, unseen])
            self.place = np.concatenate([self.place, np.arange(len(unseen)) + len(self.vectors)])
            self.vectors = np.concatenate([self.vectors, np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c])
            order = np.argsort(self.keys)
            self.keys, self.place = self.keys[order], self.place[order]
            at = np.searchsorted(self.keys, keys)
        return self.vectors[self.place[at]]


_RUNS: list[_Runs] = []


def _runs() -> _Runs:
    if not _RUNS:
        _RUNS.append(_Runs())
    return _RUNS[0]


def _pieces(texts: list[str | None]) -> Iterator[tuple[str, np.ndarray]]:
    """Lower-case text with a character before and behind, at most about PIECE at a time, and the number of the text
    that each character belongs to. Short texts stand side by side, long ones are cut."""
    held: list[str] = []
    sizes: list[tuple[int, int]] = []
    total = 0
    for k, t in enumerate([*texts, None]):
        low = t.lower() if t else ""
        if held and (total + len(low) > PIECE or k == len(texts)):
            owner, n = np.array(sizes).T
            yield " " + " ".join(held) + " ", np.concatenate([owner[:1], np.repeat(owner, n + 1)])
            held, sizes, total = [], [], 0
        if len(low) <= PIECE:
            if low:
                held.append(low)
                sizes.append((k, len(low)))
                total += len(low) + 1
            continue
        for at in range(0, len(low), PIECE):
            part = (low[at - 1] if at else " ") + low[at : at + PIECE + 1] + (" " if at + PIECE >= len(low) else "")
            yield part, np.full(len(part), k)


def bundled(texts: list[str | None], owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the run vectors of each text (or of all texts with the same ``owner``, a number from 0), in whole
    numbers, and how many letters each text has.

    Everything but letters parts words; words have a space before and behind, no run goes over a space. Memory is
    bounded by PIECE characters and RUNS run vectors at a time, however long a text is and however many runs it has.
    """
    runs = _runs()
    owner = np.arange(len(texts)) if owner is None else owner
    sums = np.zeros((int(owner.max(initial=-1)) + 1, DIMS))
    letters = np.zeros(len(texts), np.int64)
    for part, whose in _pieces(texts):
        codes = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        letter = runs.is_letter[codes]
        here = np.flatnonzero(letter[1:-1]) + 1
        if not len(here):
            continue
        codes = np.where(letter, codes, _SPACE)
        letters += np.bincount(whose[here], minlength=len(texts))
        mine, whose = np.unique(owner[whose[here]], return_inverse=True)
        used = np.flatnonzero(np.bincount(codes))
        small = np.zeros(int(used[-1]) + 1, np.int64)
        n = len(used)
        small[used] = np.arange(n)
        key = (small[codes[here - 1]] * n + small[codes[here]]) * n + small[codes[here + 1]]
        if n <= 160:
            there = np.flatnonzero(np.bincount(key, minlength=n**3))
            number = np.zeros(n**3, np.int64)
            number[there] = np.arange(len(there))
            number = number[key]
        else:
            there, number = np.unique(key, return_inverse=True)
        whole = used[there // (n * n)] << 42 | used[there // n % n] << 21 | used[there % n]
        most = min(RUNS, max(64, CELLS // len(mine)))
        for at in range(0, len(there), most):
            width = min(most, len(there) - at)
            inside = slice(None) if width == len(there) else (number >= at) & (number < at + width)
            count = np.bincount(whose[inside] * width + number[inside] - at, minlength=len(mine) * width)
            # whole numbers below 2**24, so exact
            sums[mine] += count.reshape(len(mine), width).astype(np.float32) @ runs.of(whole[at : at + width]).astype(np.float32)
    return sums, letters


def learn(rows: DataFrame) -> dict[str, list[int]]:
    """The vector of each language from ``rows`` (text, lang); rows with a null lang or text are left out.

    Tasks hand on sums of whole numbers, added by (language, dimension), so the result does not depend on the
    partitions. The driver gets one vector for each language, at most MOST_LANGS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, "text", 1 << 19):
            coded = b.column("lang").dictionary_encode()
            total, _ = bundled(b.column("text").to_pylist(), coded.indices.to_numpy())
            for lang, own in zip(coded.dictionary.to_pylist(), total, strict=True):
                sums[lang] = sums.get(lang, 0) + own
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * DIMS), "dim": pa.array(range(DIMS), pa.int32()), "value": pa.array(np.rint(total).astype(np.int64))})

    sums = rows.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, dim int, value long")
    whole = sums.groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    vectors = whole.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v")).select("lang", F.col("v.value").alias("v"))
    found = vectors.limit(MOST_LANGS + 1).collect()
    if len(found) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    return {r["lang"]: list(r["v"]) for r in found}


def detect(text: Column | str, languages: dict[str, list[int]]) -> Column:
    """A struct (lang_pred, score, reason): the language of the largest cosine, by name among equal ones, and that cosine, not
    below 0. ``und`` with score 0 if the text is null or has no letter, or no language was learned. The reason is null
    unless the text has no language to be told: "no text" (null or empty), "no letter", or "no known language" (runs as
    varied as LEAST_RUNS different ones, which are no more like any learned language than letters drawn at random)."""
    names = sorted(languages)
    profiles = np.array([languages[n] for n in names], np.float64).reshape(len(names), DIMS)
    profiles = (profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-300)).astype(np.float32)

    @F.pandas_udf("lang_pred string, score double, reason string")
    def guess(texts: pd.Series) -> pd.DataFrame:
        langs, scores, reasons = [], [], []
        values = [t if isinstance(t, str) else None for t in texts]
        at = 0
        while at < len(values):
            n = size = 0
            while at + n < len(values) and n < 256 and (not n or size < PIECE):
                size += len(values[at + n] or "")
                n += 1
            docs, letters = bundled(values[at : at + n])
            length = np.linalg.norm(docs, axis=1)
            cosine = docs @ profiles.T / np.maximum(length, 1e-30)[:, None]
            # run vectors are nearly orthogonal, so the length tells how evenly the runs are spread
            varied = DIMS * (letters / np.maximum(length, 1e-30)) ** 2 >= LEAST_RUNS
            for k in range(n):
                best = int(cosine[k].argmax()) if letters[k] and names else -1
                langs.append(names[best] if best >= 0 else UNKNOWN)
                scores.append(float(min(1.0, max(0.0, cosine[k, best]))) if best >= 0 else 0.0)
                far = best >= 0 and varied[k] and scores[-1] < CHANCE
                reasons.append("no known language" if far else None if letters[k] else "no letter" if values[at + k] else "no text")
            at += n
        return pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float), "reason": pd.Series(reasons, dtype=object)})

    # evaluated once, wherever its fields are used
    return guess.asNondeterministic()(text)


def held_out(doc_id: str, parts: int) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == 1


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; what is held out is not learned from.

    Null and empty texts get ``und``. Repeated rows are learned from and answered as often as they occur. Where nothing
    can be learned all get ``und``.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out("doc_id", 3).alias("held_out"))
    languages = learn(rows.filter("not held_out"))
    return rows.withColumn("found", detect("text", languages)).select("doc_id", "held_out", "found.lang_pred", "found.score")
