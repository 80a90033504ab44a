"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one Arrow piece handled at a time, so that long texts don't pile up in a worker.
PIECE_ROWS = 256

# The constants of the public splitmix64 mixer.
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with strokes before it until no column of ``df`` is called so."""
    while name in df.columns:
        name = f"_{name}"
    return name


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def map_pieces(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on pieces of at most ``PIECE_ROWS`` rows; empty pieces are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE_ROWS):
                yield work(batch.slice(start, PIECE_ROWS))

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit numbers (arithmetic wraps)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words (bytes), kept in a dictionary of bounded size."""

    def __init__(self, most: int = 100_000) -> None:
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            pass
        import xxhash

        if len(known) > self.most:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes, in order; a shorter text is one run."""
    width = min(width, len(words))
    if width == 0:
        return words[:0]
    count = len(words) - width + 1
    mixed = mix64(words[:count] + np.uint64(width))
    for i in range(1, width):
        mixed = mix64(mixed * _GOLDEN + words[i : i + count])
    return mixed


def filter_places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each value (unsigned 64-bit) in a bit filter of ``bits`` (a power of two)."""
    mask = np.uint64(bits - 1)
    return mix64(values ^ _GOLDEN) & mask, mix64(values) & mask


def bit_filter(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """The bits of all values of a long column; at most ``bits`` / 64 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("value").to_numpy().view(np.uint64)
            places = np.unique(np.concatenate(filter_places(own, bits)))
            set_bits = (np.uint64(1) << (places & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array(set_bits)], names=["word", "bits"])

    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("value"))
    made = values.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[made.column("word").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
    return out


def passes_filter(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Whether each value may be among those of the filter; no value of them is refused."""
    ok = np.ones(len(values), bool)
    for places in filter_places(values, len(filled) * 64):
        ok &= (filled[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) == 1
    return ok
