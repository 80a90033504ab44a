"""Benchmark decontamination by greedy string tiling.

A document is compared with a benchmark item by tiles: the longest stretch of words both
share is marked in both, then the longest of what is still unmarked, and so on down to a least
length. A tile may lie anywhere, so reordered passages count in full. An item is found in
a document if tiles cover enough of its words.

A tile of at least ``width`` words holds a run of ``width`` words (seed) of the item. So one scan
of the documents keeps only words inside such runs, tested against a bit filter of fixed size;
what is kept joins the items on the exact seeds, and pairs with too few shared seeds for the
coverage are dropped. Only the kept words of the remaining pairs are tiled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import WordHashes, bit_filter, free_name, passes_filter, shingle_hashes
from memlake.session import durable


@dataclass(frozen=True)
class TilingParams:
    """Tiles of at least ``width`` words (the whole of a shorter item) that cover at least ``percent`` of an item.

    ``filter_bits`` is the size of the broadcast filter, a power of two: more items than it was
    made for let more words through, which the join then drops.
    """

    width: int = 5
    percent: int = 80
    filter_bits: int = 1 << 23


# Fixed rule: A-Z lower-cased by the text, every other ASCII character that is no letter or digit parts words.
_WORDS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
# A prime and a base for the rolling hash.
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_WORDS).split()


def tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """(place in item, place in text, length) of greedily chosen tiles, longest first."""
    free_a, free_b = [True] * len(item), [True] * len(text)
    length, out = max(least, min(len(item), 32)), []
    while len(item) >= least > 0:
        found = _matches(item, text, free_a, free_b, length)
        longest = max((k for k, _, _ in found), default=0)
        if longest >= 2 * length:
            length = longest
            continue
        marked = False
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_a[i : i + k]) and all(free_b[j : j + k]):
                free_a[i : i + k] = [False] * k
                free_b[j : j + k] = [False] * k
                out.append((i, j, k))
                marked = True
        if marked:
            continue
        if length <= least:
            break
        length = max(least, length // 2)
    return out


def _matches(a: list[int], b: list[int], free_a: list[bool], free_b: list[bool], length: int) -> list[tuple[int, int, int]]:
    """Maximal matches of unmarked words, at least ``length`` long, found by running Karp-Rabin."""
    places = defaultdict(list)
    for j, value in _rolling(b, free_b, length):
        places[value].append(j)
    found = []
    for i, value in _rolling(a, free_a, length):
        for j in places.get(value, ()):
            if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                continue
            k = 0
            while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                k += 1
            if k >= length:
                found.append((k, i, j))
    return found


def _rolling(words: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(place, hash) of every run of ``length`` unmarked words; a word in and a word out at a time."""
    lead, value, run = pow(_BASE, length, _PRIME), 0, 0
    for end, word in enumerate(words):
        if not free[end]:
            value = run = 0
            continue
        value = (value * _BASE + word) % _PRIME
        run += 1
        if run > length:
            value = (value - words[end - length] * lead) % _PRIME
        if run >= length:
            yield end - length + 1, value


def _item_rows(items: DataFrame) -> DataFrame:
    """item_id, words (hashes) of the items that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [hashes(words_of(x.as_py())).view(np.int64) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.int64()))], names=["item_id", "words"])

    source = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = source.mapInArrow(run, "item_id long, words array<long>").where(F.size("words") > 0)
    return rows.groupBy("item_id", "words").agg(F.count("*").alias("rows")).drop("rows")


def _seed_rows(items: DataFrame, width: int) -> DataFrame:
    """(entry, seed, times) of every item; items shorter than ``width`` are one seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, seeds, times = [], [], []
            for entry, words in zip(batch.column("entry").to_pylist(), batch.column("words")):
                own, n = np.unique(shingle_hashes(np.array(words.as_py(), np.int64).view(np.uint64), width), return_counts=True)
                entries += [entry] * len(own)
                seeds += own.view(np.int64).tolist()
                times += n.tolist()
            yield pa.RecordBatch.from_pydict(
                {"entry": pa.array(entries, pa.string()), "seed": pa.array(seeds, pa.int64()), "times": pa.array(times, pa.int64())}
            )

    return items.select("entry", "words").mapInArrow(run, "entry string, seed long, times long")


def _kept_words(docs: DataFrame, filled: np.ndarray, widths: list[int]) -> DataFrame:
    """text_key, seeds, places, words of the texts with words inside runs that pass the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), sent.value

        for batch in batches:
            rows = []
            for key, text in zip(batch.column("text_key"), batch.column("text")):
                words = hashes(words_of(text.as_py()))
                inside, seeds = np.zeros(len(words) + 1, np.int64), []
                for width in widths:
                    if len(words) < width:
                        continue
                    runs = shingle_hashes(words, width)
                    hits = np.flatnonzero(passes_filter(runs, bits))
                    seeds.append(runs[hits])
                    np.add.at(inside, hits, 1)
                    np.add.at(inside, hits + width, -1)
                places = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
                if len(places):
                    rows.append((key.as_py(), np.unique(np.concatenate(seeds)).view(np.int64), places, words[places].view(np.int64)))
            keys, seeds, places, words = zip(*rows) if rows else ([], [], [], [])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict(
                {"text_key": pa.array(keys, pa.string()), "seeds": pa.array(seeds, longs), "places": pa.array(places, longs), "words": pa.array(words, longs)}
            )

    return docs.select("text_key", "text").mapInArrow(run, "text_key string, seeds array<long>, places array<long>, words array<long>")


def _tiled(pairs: DataFrame, width: int) -> DataFrame:
    """Pairs with places and words of the text and ``item`` words: covered words and number of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, counts = [], []
            for places, words, item in zip(*(batch.column(c) for c in ("places", "words", "item"))):
                places, words, item = places.as_py(), words.as_py(), item.as_py()
                text: list[int] = []
                for n, (place, word) in enumerate(zip(places, words)):
                    if n and place != places[n - 1] + 1:
                        # A gap: a number that no word hash (64 bits) is equal to.
                        text.append((1 << 70) + n)
                    text.append(word)
                found = tiles(item, text, min(width, len(item)))
                covered.append(sum(k for _, _, k in found))
                counts.append(len(found))
            columns = [batch.column("text_key"), batch.column("entry"), pa.array(covered, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["text_key", "entry", "covered", "n_tiles"])

    columns = ["text_key", "entry", "places", "words", "item"]
    return pairs.select(*columns).mapInArrow(run, "text_key string, entry string, covered long, n_tiles long")


def text_key(column: str = "text"):
    """What a text is known by: equal texts are tiled once."""
    return F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")))


def contaminated_texts(docs: DataFrame, items: DataFrame, params: TilingParams = TilingParams()) -> DataFrame:
    """text_key, item_id, n_item_words, covered, n_tiles, coverage of texts (``text``) that hold an item.

    Items (item_id, text) without words, null or empty, are never found, nor is anything in texts
    without words. Repeated rows of an item count once; rows of one item_id with different texts are
    different items and the best covered one is given. Other columns are ignored.
    """
    known = _item_rows(items)
    known = known.withColumn("entry", F.md5(F.to_json(F.struct("item_id", "words"))))
    known = durable(known, "items")
    seeds = durable(_seed_rows(known, params.width), "item-seeds")
    widths = sorted({r["w"] for r in known.select(F.least(F.size("words"), F.lit(params.width)).alias("w")).distinct().collect()})

    keyed = docs.select(text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    filled = bit_filter(seeds, "seed", params.filter_bits)
    kept = _kept_words(keyed, filled, widths)
    kept = durable(kept.groupBy("text_key").agg(*[F.first(c).alias(c) for c in ("seeds", "places", "words")]), "kept-words")

    sized = known.select("entry", "item_id", F.col("words").alias("item"), F.size("words").alias("n_item_words"))
    shared = kept.select("text_key", F.explode("seeds").alias("seed")).join(seeds, "seed")
    shared = shared.groupBy("text_key", "entry").agg(F.sum("times").alias("shared"))
    wide = F.least(F.lit(params.width), F.col("n_item_words"))
    enough = F.col("shared") * 100 * wide >= F.col("n_item_words") * params.percent
    pairs = durable(shared.join(sized, "entry").where(enough).select("text_key", "entry", "item"), "pairs")
    tiled = _tiled(pairs.join(kept.drop("seeds"), "text_key"), params.width)

    found = tiled.join(sized.drop("item"), "entry").where(F.col("covered") * 100 >= F.col("n_item_words") * params.percent)
    found = found.select("text_key", "item_id", F.struct((F.col("covered") / F.col("n_item_words")).alias("coverage"), "covered", "n_tiles", "n_item_words").alias("f"))
    best = found.groupBy("text_key", "item_id").agg(F.max("f").alias("f"))
    return best.select("text_key", "item_id", "f.n_item_words", "f.covered", "f.n_tiles", "f.coverage")


def contaminated_documents(docs: DataFrame, items: DataFrame, params: TilingParams = TilingParams()) -> DataFrame:
    """doc_id with the columns of ``contaminated_texts`` but its key; one row per document and item.

    Rows of one doc_id with several texts give the best coverage; a null doc_id is one document.
    """
    found = durable(contaminated_texts(docs, items, params), "contaminated")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"))
    joined = keyed.join(found, "text_key").groupBy("doc_id", "item_id")
    best = joined.agg(F.max(F.struct("coverage", "covered", "n_tiles", "n_item_words")).alias("f"))
    return best.select("doc_id", "item_id", "f.n_item_words", "f.covered", "f.n_tiles", "f.coverage")


def clean_documents(docs: DataFrame, items: DataFrame, params: TilingParams = TilingParams()) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns."""
    found = durable(contaminated_texts(docs, items, params).select("text_key").distinct(), "contaminated")
    key = free_name(docs, "_text_key")
    keyed = docs.withColumn(key, text_key())
    return keyed.join(found.select(F.col("text_key").alias(key)), key, "left_anti").select(*docs.columns)
