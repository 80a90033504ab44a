"""Audit of filters that may act in any order, by survival words.

Which of the filters a document fails decides which sets of filters it survives. With five filters there
are 32 sets, so this is a word of 32 bits: bit S is set if the document fails no filter of S. How many
documents survive each set is then the number of set bits at each place, which is counted for many words at a
time by carry-save addition: three words become a sum and a carry word of twice the weight, until a few
words are left whose bits are counted one by one.

Everything asked about an order follows from the 32 counts: what a step removes is the survivors of the
filters before it less those with it.

The fifth filter, identical text, looks at the whole table. Texts travel as SHA-256 digests. A text that
fills a large part of the table is spread over salted groups by its documents' ids: the smallest id is found
per salted group, then per text, and comes back to the salted groups.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import map_pieces
from memlake.operators.ranking import SALTS, skewed_join
from memlake.session import durable, shuffle_width

FILTERS = "ABCDE"
_SETS = 1 << len(FILTERS)
_ALL = _SETS - 1

# The limits of the filters on single texts.
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
MARKS = rb"[#$%&*|]"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
# Bytes that continue a character; all others begin a code point.
_FOLLOWING = bytes(range(0x80, 0xC0))

# Parts whose counts a task holds before it gives them out.
PARTS_HELD = 4096


def failed_alone(text: bytes, has_mark: Callable = re.compile(MARKS).search) -> int:
    """The filters A to D that a text (UTF-8) fails, as bits 0 to 3."""
    words = text.split()
    points = len(text.translate(None, _FOLLOWING))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS_PERCENT * points) << 2
        | (has_mark(text) is not None) << 3
    )


def survival_words(failed: np.ndarray) -> np.ndarray:
    """One 32-bit word per document: bit S is set if none of the filters of S failed."""
    sets = np.arange(_SETS)
    table = np.array([np.bitwise_or.reduce(np.uint32(1) << sets[sets & f == 0].astype(np.uint32)) for f in range(_SETS)], np.uint32)
    return table[failed]


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits set, by carry-save addition."""
    counts, weight, places = np.zeros(32, np.int64), 1, np.arange(32, dtype=np.uint32)
    while len(words):
        carried = []
        while len(words) >= 3:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            either = a ^ b
            carried.append((a & b) | (either & c))
            words = np.concatenate([either ^ c, words[3 * third :]])
        for word in words:
            counts += weight * ((word >> places) & np.uint32(1)).astype(np.int64)
        words = np.concatenate(carried) if carried else words[:0]
        weight *= 2
    return counts


def _signals(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, failed (bits of A to D)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        digests = pa.array([hashlib.sha256(text).digest() for text in texts], pa.binary())
        failed = pa.array([failed_alone(text) for text in texts], pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), digests, failed], names=["doc_id", "part", "digest", "failed"]
        )

    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), text.alias("text"))
    return map_pieces(chosen, work, "doc_id long, part string, digest binary, failed int")


def _with_repeats(signals: DataFrame) -> DataFrame:
    """Adds bit 4 where a smaller doc_id has the same text. A missing id is smaller than none, and no id is smaller than it."""
    salts = max(SALTS, shuffle_width(signals.sparkSession))
    salted = signals.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    own = salted.where(F.col("doc_id").isNotNull()).groupBy("digest", "salt").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    own = durable(own, "text-groups")
    text = own.groupBy("digest").agg(F.min("least").alias("first"), F.max("most").alias("last")).where("first < last")
    # At most one row per salted group; only texts of several ids take part.
    firsts = own.join(text, "digest").select("digest", "salt", "first")
    joined = skewed_join(salted.where(F.col("doc_id").isNotNull()), firsts, ["digest", "salt"], "left")
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    named = joined.select("doc_id", "part", F.col("failed").bitwiseOR(F.shiftleft(repeated, 4)).alias("failed"))
    return named.unionByName(signals.where(F.col("doc_id").isNull()).select("doc_id", "part", "failed"))


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic: whether any label row of the id says so."""
    is_good, is_toxic = F.col("quality") == 1, F.col("toxic") == 1
    marked = labels.where(F.col("doc_id").isNotNull() & (is_good | is_toxic)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = marked.agg(F.max(F.coalesce(is_good, F.lit(False))).alias("good"), F.max(F.coalesce(is_toxic, F.lit(False))).alias("toxic"))
    named = skewed_join(rows.where(F.col("doc_id").isNotNull()), known, ["doc_id"], "left")
    no = F.lit(False)
    named = named.select("part", "failed", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return named.unionByName(rows.where(F.col("doc_id").isNull()).select("part", "failed", no.alias("good"), no.alias("toxic")))


def _survivors(rows: DataFrame) -> DataFrame:
    """part, n_sets, good_sets, toxic_sets: survivors of each of the 32 sets, of all, good and toxic documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            counts = np.array([held[part] for part in held], np.int64).reshape(len(held), 3, _SETS)
            offsets = np.arange(0, len(held) * _SETS + 1, _SETS, dtype=np.int32)
            lists = [pa.ListArray.from_arrays(offsets, counts[:, i].ravel()) for i in range(3)]
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *lists], names=["part", "n_sets", "good_sets", "toxic_sets"])
            held.clear()
            return made

        for batch in batches:
            words = survival_words(batch.column("failed").to_numpy())
            good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))
            parts = batch.column("part").dictionary_encode()
            code = parts.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                if len(own):
                    counts = [positional_popcount(words[rows]) for rows in (own, own[good[own]], own[toxic[own]])]
                    part = parts.dictionary[code[own[0]].item()].as_py()
                    held[part] = held.get(part, 0) + np.array(counts)
            if len(held) >= PARTS_HELD:
                yield given()
        yield given()

    schema = "part string, n_sets array<long>, good_sets array<long>, toxic_sets array<long>"
    counted = rows.mapInArrow(run, schema)
    kinds = ("n_sets", "good_sets", "toxic_sets")
    sums = [F.array(*[F.sum(F.element_at(kind, i + 1)) for i in range(_SETS)]).alias(kind) for kind in kinds]
    return counted.groupBy("part").agg(*sums)


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step from 1, the step's filter as a bit, filters before it) of all orders."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, bit in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), step, 1 << bit, before))
            before |= 1 << bit
    return rows


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter does at every place of every order, per part (language; a missing one is '').

    docs: doc_id, text, lang; labels: doc_id, quality, toxic. Returns part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley, zeros included.

    A null text is an empty one, equal to other empty ones. Repeated rows count each; rows without id have no
    label and are never repeats. Of repeated labels any that says good (or toxic) counts. A text without
    words fails A only. No documents: no rows. Other columns are ignored.
    """
    signals = durable(_signals(docs), "filter-signals")
    survivors = durable(_survivors(_with_labels(_with_repeats(signals), labels)), "survivors")
    steps = docs.sparkSession.createDataFrame(_steps(), "filter_order string, step int, own int, before int")

    def of(kind: str, filters: Column) -> Column:
        return F.get(F.col(kind), filters)

    own = F.col("own")
    after = F.col("before").bitwiseOR(own)
    lost = lambda kind: of(kind, F.col("before")) - of(kind, after)
    # Every part has its counts beside each of the 32 sets, so that a step (600 in all) finds the set before it.
    placed = survivors.select("*", F.explode(F.sequence(F.lit(0), F.lit(_ALL))).alias("before")).join(F.broadcast(steps), "before")
    failing = of("n_sets", F.lit(0)) - of("n_sets", own)
    figures = placed.select(
        "part",
        "filter_order",
        "step",
        "own",
        of("n_sets", after).alias("kept"),
        lost("n_sets").alias("removed"),
        (failing - lost("n_sets")).alias("redundant"),
        (of("n_sets", F.lit(_ALL) - own) - of("n_sets", F.lit(_ALL))).alias("unique_fails"),
        lost("good_sets").alias("good_lost"),
        lost("toxic_sets").alias("toxic_lost"),
    )
    shapley = figures.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return figures.join(shapley, ["part", "own"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
