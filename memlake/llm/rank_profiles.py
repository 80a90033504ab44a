"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (1 to 3 letters, words padded by a blank), best
first. A text's profile is compared to each language's by the out-of-place distance: how far
every n-gram is from its place in the other list, the length of a profile if it is not in it.

N-grams are 63-bit numbers: three code points of 21 bits, 0 for the blank and ``NONE`` after the end of
shorter ones. Ties in frequency go to the smaller number, ties in distance to the smaller language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import free_name, map_pieces
from memlake.operators.ranking import top_k
from memlake.session import durable

LENGTH = 300
UNDECIDED = "und"
NONE = np.int64((1 << 21) - 1)
# n-grams a task counts at a time, and distinct ones it holds before it gives them out.
GRAMS_AT_ONCE, GRAMS_HELD = 500_000, 1_000_000

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter; made once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """All n-grams of a text, in no order; empty if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[codes], codes, 0).astype(np.int64)
    codes = np.concatenate([[0], codes, [0]])
    a, b = codes[:-1], codes[1:]
    ones = (codes[codes > 0] << np.int64(42)) | (NONE << np.int64(21)) | NONE
    twos = ((a << np.int64(42)) | (b << np.int64(21)) | NONE)[(a > 0) | (b > 0)]
    threes = ((codes[:-2] << np.int64(42)) | (codes[1:-1] << np.int64(21)) | codes[2:])[codes[1:-1] > 0]
    return np.concatenate([ones, twos, threes])


def profile(found: np.ndarray, length: int) -> np.ndarray:
    """The most frequent of ``found``, best first."""
    keys, counts = np.unique(found, return_counts=True)
    return keys[np.argsort(-counts, kind="stable")[:length]]


@dataclass(frozen=True)
class Profiles:
    """Places of all n-grams in all languages' profiles; ``length`` where one is missing."""

    languages: list[str]
    keys: np.ndarray
    places: np.ndarray
    length: int

    @staticmethod
    def of(ranked: list[tuple[str, int, int]], length: int) -> Profiles:
        """From (language, n-gram, place from 0)."""
        languages = sorted({language for language, _, _ in ranked})
        keys = np.unique(np.array([gram for _, gram, _ in ranked], np.int64))
        places = np.full((len(languages), len(keys) + 1), length, np.int64)
        row = {language: i for i, language in enumerate(languages)}
        for language, gram, place in ranked:
            places[row[language], np.searchsorted(keys, gram)] = place
        return Profiles(languages, keys, places, length)

    def best(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 minus its distance over the largest possible one."""
        found = grams(text or "")
        if not len(found) or not self.languages:
            return UNDECIDED, 0.0
        own = profile(found, self.length)
        column = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        column = np.where(self.keys[column] == own, column, len(self.keys))
        places = self.places[:, column]
        out = np.where(places == self.length, self.length, np.abs(places - np.arange(len(own))))
        distances, most = out.sum(axis=1), len(own) * self.length
        nearest = int(np.argmin(distances))
        return self.languages[nearest], float((most - distances[nearest]) / most)


class _Counts:
    def __init__(self) -> None:
        self.waiting: dict[str, list[np.ndarray]] = {}
        self.size, self.keys, self.counts = 0, {}, {}

    def add(self, language: str, found: np.ndarray) -> None:
        self.waiting.setdefault(language, []).append(found)
        self.size += len(found)
        if self.size >= GRAMS_AT_ONCE:
            self.merge()

    def merge(self) -> None:
        for language, parts in self.waiting.items():
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            if language in self.keys:
                both = np.concatenate([self.keys[language], keys])
                times = np.concatenate([self.counts[language], counts])
                keys, place = np.unique(both, return_inverse=True)
                counts = np.bincount(place, times, len(keys)).astype(np.int64)
            self.keys[language], self.counts[language] = keys, counts
        self.waiting, self.size = {}, 0

    def held(self) -> int:
        return sum(map(len, self.keys.values()))

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for language, keys in self.keys.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([language] * len(keys), pa.string()), "gram": pa.array(keys), "n": pa.array(self.counts[language], pa.int64())}
            )
        self.keys, self.counts = {}, {}


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(text, lang) to (lang, gram, n) over all rows; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for text, language in zip(batch.column("text"), batch.column("lang")):
                found = grams(text.as_py())
                if len(found):
                    counts.add(language.as_py(), found)
            if counts.held() > GRAMS_HELD:
                yield from counts.batches()
        yield from counts.batches()

    parts = labelled.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def language_profiles(labelled: DataFrame, length: int = LENGTH) -> Profiles:
    """Profiles of all languages of ``labelled`` (text, lang); rows with a null are left out.

    What reaches the driver is ``length`` numbers per language.
    """
    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = durable(gram_counts(known), "gram-counts")
    ranked = top_k(counts, ["lang"], [F.col("n").desc(), F.col("gram")], length)
    return Profiles.of([(r["lang"], r["gram"], r["rank"] - 1) for r in ranked.collect()], length)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns but the text) with lang_pred and score.

    A null text or one without letters is undecided with score 0, and so is everything
    if no language was learned. Rows stand for themselves.
    """
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score") and (keep or c != text)]
    # A text that is kept goes to the workers once.
    sent = text in kept and docs.schema[text].dataType.simpleString() == "string"
    model, own = docs.sparkSession.sparkContext.broadcast(profiles), text if sent else free_name(docs, "_text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        best = [model.value.best(x.as_py()) for x in batch.column(own)]
        columns = [batch.column(c) for c in kept]
        languages, scores = pa.array([x for x, _ in best], pa.string()), pa.array([x for _, x in best], pa.float64())
        return pa.RecordBatch.from_arrays([*columns, languages, scores], names=[*kept, "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept]
    kept = [f.name for f in docs.schema.fields if f.name in kept]
    columns = [F.col(f"`{c}`") for c in kept]
    source = docs.select(*columns) if sent else docs.select(*columns, F.col(text).cast("string").alias(own))
    return map_pieces(source, work, ", ".join([*fields, "lang_pred string", "score double"]))
