"""Context-tree weighting over bytes, learned from a corpus and applied to every text.

A text is its words joined by single blanks, then an end byte. Every byte is decided in
eight binary steps; the node of a step within the byte and the last ``depth`` bytes are its
context. Each context of each length keeps how often 0 and 1 followed it in training, and
contexts of all lengths are mixed as context-tree weighting prescribes:

    Pw(s) = 1/2 Pe(s) + 1/2 prod Pw(children of s),      Pw = Pe at full depth

with the Krichevsky-Trofimov estimate Pe, which depends on the two counts only. So the weights
follow from corpus counts by sums over children (from long contexts to short ones), and the
prediction for the next bit is the mixture over the path of its context:

    p(s) = q(s) KT(s) + (1 - q(s)) p(child of s),        q(s) = 1/2 Pe(s) / Pw(s)

Both are joins and aggregates over tables of contexts. A context seen in no training text has
counts 0, for which the same formulas give 1/2.

A first scan counts byte runs (context and next byte; combined inside each task before they
are shuffled) and cuts the words into blocks: one row for each distinct word of a block, so that
a frequent word costs one row per block, and one packed row with the places (segment, count)
of all its words, which is shuffled once. The table of run scores is broadcast to a second scan, in parts of a checked size: a larger
table takes more scans, never a larger broadcast. Texts are never shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.session import durable, fresh_path

# Words of this many bytes of text make a block.
BLOCK_BYTES = 32_000_000
PIECE_BYTES = 48_000
# Runs counted or looked up at a time in a task, and distinct runs a task holds before it gives them out.
RUNS_AT_ONCE, RUNS_HELD = 1_000_000, 2_000_000
# Runs broadcast at a time (16 bytes each).
BROADCAST_RUNS = 4_000_000
END, SPACE = b"\xff", re.compile(rb"[\x20\x09-\x0D]")

# Kinds of rows. A word's row has its number in the block in ``segment``.
GRAM, WORD, SEGMENT, PLACES = 0, 1, 2, 3
SCHEMA = (
    "kind int, block long, gram long, word binary, n long, places binary, "
    "segment int, row_key long, doc_id long, held_out boolean, n_bytes long, digest binary"
)


def pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` cut at white space into pieces of little more than ``PIECE_BYTES`` (at least one)."""
    start = 0
    while len(raw) - start > PIECE_BYTES:
        cut = SPACE.search(raw, start + PIECE_BYTES)
        if cut is None:
            break
        yield raw[start : cut.start()]
        start = cut.end()
    yield raw[start:]


def spelled(raw: bytes, depth: int) -> Iterator[tuple[list[bytes], np.ndarray, bool]]:
    """Words, byte runs and whether it is the last, of every piece of a text.

    A run holds the ``depth`` bytes before a byte (0 before the text) and the byte, lowest.
    """
    before, parts = b"\x00" * depth, list(pieces(raw))
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        words = part.lower().split()
        text = b"".join([w + b" " for w in words]) + (END if last else b"")
        codes = np.frombuffer(before + text, np.uint8).astype(np.uint64)
        runs = np.zeros(len(text), np.uint64)
        for j in range(depth + 1):
            runs = (runs << np.uint64(8)) | codes[j : j + len(text)]
        yield words, runs, last
        before = (before + text)[-depth:] if depth else b""


class RunCounts:
    """Distinct runs with their counts in training texts (0 for runs of held-out texts only)."""

    def __init__(self) -> None:
        self.parts: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.waiting, self.keys, self.counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, runs: np.ndarray, held: bool) -> None:
        self.parts[held].append(runs)
        self.waiting += len(runs)
        if self.waiting >= RUNS_AT_ONCE:
            self.merge()

    def merge(self) -> None:
        keys, counts = [self.keys], [self.counts]
        for held, runs in self.parts.items():
            if runs:
                found, times = np.unique(np.concatenate(runs), return_counts=True)
                keys.append(found)
                counts.append(times * (not held))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
        self.keys = keys[starts] if len(keys) else keys
        self.counts = np.add.reduceat(counts, starts) if len(keys) else counts
        self.parts, self.waiting = {True: [], False: []}, 0

    def batch(self) -> pa.RecordBatch:
        self.merge()
        made = _batch(GRAM, None, self.counts.astype(np.int64), gram=pa.array(self.keys.astype(np.int64)))
        self.keys, self.counts = self.keys[:0], self.counts[:0]
        return made


def pack_places(lengths: np.ndarray, segments: np.ndarray, times: np.ndarray) -> bytes:
    """Places of a block's words, word by word: ``lengths`` of them each, segments ascending within a word."""
    steps = np.diff(segments, prepend=0)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    steps[starts] = segments[starts]
    planes = lengths.astype("<u4").tobytes() + steps.astype("<u2").tobytes() + times.astype("<u2").tobytes()
    return zlib.compress(planes, 1)


def unpack_places(packed: bytes, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = zlib.decompress(packed)
    lengths = np.frombuffer(planes, "<u4", words).astype(np.int64)
    count = int(lengths.sum())
    steps = np.frombuffer(planes, "<u2", count, 4 * words).astype(np.int64)
    times = np.frombuffer(planes, "<u2", count, 4 * words + 2 * count)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    run = np.cumsum(steps)
    return lengths, run - np.repeat(run[starts] - steps[starts], lengths[lengths > 0]), times


@dataclass
class Block:
    """Words of the texts read so far, with the segment (piece of a text) they are in."""

    size: int = 0
    words: dict[bytes, int] = field(default_factory=dict)
    uses: list[np.ndarray] = field(default_factory=list)
    segments: list[tuple] = field(default_factory=list)

    def add(self, words: list[bytes], row: tuple, tokens: int, n_bytes: int) -> None:
        """``row`` is (row_key, doc_id, held_out, digest)."""
        known = self.words
        use = np.array([known.setdefault(word, len(known)) for word in words], np.uint64)
        self.uses.append((use << np.uint64(16)) | np.uint64(len(self.segments)))
        self.segments.append((*row, tokens, n_bytes))
        self.size += n_bytes

    def full(self) -> bool:
        return self.size >= BLOCK_BYTES or len(self.segments) > 60_000

    def batches(self, block: int) -> Iterator[pa.RecordBatch]:
        row_keys, doc_ids, held, digests, tokens, sizes = zip(*self.segments)
        both, times = np.unique(np.concatenate(self.uses), return_counts=True)
        keys, segments = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        trained = times * ~np.array(held)[segments]
        counts = np.add.reduceat(trained, starts) if len(keys) else trained
        yield _batch(
            WORD,
            block,
            counts.astype(np.int64),
            word=pa.array(list(self.words), pa.binary()),
            segment=pa.array(range(len(starts)), pa.int32()),
        )
        packed = pack_places(np.diff(np.append(starts, len(keys))), segments, times)
        yield _batch(PLACES, block, np.array([len(keys)]), places=pa.array([packed], pa.binary()))
        yield _batch(
            SEGMENT,
            block,
            np.array(tokens, np.int64),
            segment=pa.array(range(len(tokens)), pa.int32()),
            row_key=pa.array(row_keys, pa.int64()),
            doc_id=pa.array(doc_ids, pa.int64()),
            held_out=pa.array(held, pa.bool_()),
            n_bytes=pa.array(sizes, pa.int64()),
            digest=pa.array(digests, pa.binary()),
        )


def _batch(kind: int, block: int | None, n: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    size = len(n)
    columns |= {"kind": pa.array(np.full(size, kind, np.int32)), "n": pa.array(n), "block": pa.array([block] * size, pa.int64())}
    types = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_pydict({name: columns.get(name, pa.nulls(size, types[kind_])) for name, kind_ in fields})


def _digest(raw: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(raw)


def corpus_parts(docs: DataFrame, depth: int) -> DataFrame:
    """Rows of three kinds: run counts of a task, and the words and segments of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        counts, block, blocks, rows = RunCounts(), Block(), 0, 0
        for batch in batches:
            for doc_id, held, text in zip(*(batch.column(c) for c in ("doc_id", "held_out", "text"))):
                raw, held = (text.as_py() or "").encode(), held.as_py()
                row = (task + rows, doc_id.as_py(), held, _digest(raw))
                rows += 1
                for words, runs, last in spelled(raw, depth):
                    counts.add(runs, held)
                    block.add(words, row, len(words) + last, len(runs))
                    if block.full():
                        yield from block.batches(task + blocks)
                        block, blocks = Block(), blocks + 1
                if len(counts.keys) > RUNS_HELD:
                    yield counts.batch()
        if block.segments:
            yield from block.batches(task + blocks)
        yield counts.batch()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)


def run_sums(docs: DataFrame, scores: DataFrame, depth: int) -> DataFrame:
    """(digest, score): the sum of the run scores (gram, value) over every distinct text."""
    spark = docs.sparkSession
    parts = -(-scores.count() // BROADCAST_RUNS)
    sums = None
    for part in range(parts):
        own = scores.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part).toArrow()
        keys = own.column("gram").to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        model = spark.sparkContext.broadcast((keys[order], own.column("value").to_numpy()[order]))
        found = docs.select("text").mapInArrow(_summer(model, depth), "digest binary, score double")
        found = found.groupBy("digest").agg(F.first("score").alias("score"))
        sums = found if sums is None else sums.unionByName(found)
    return sums.groupBy("digest").agg(F.sum("score").alias("score")) if parts > 1 else sums


def _summer(model, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = model.value
        digests, waiting, size = [], [], 0

        def summed() -> pa.RecordBatch:
            both = np.sort(np.concatenate(waiting)) if waiting else np.zeros(0, np.uint64)
            runs, texts = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
            place = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
            value = np.where(keys[place] == runs, values[place], 0.0)
            score = np.bincount(texts, value, len(digests)).astype(np.float64)
            return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(score)], names=["digest", "score"])

        for batch in batches:
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode()
                total = np.zeros(1)
                for i, (_, runs, last) in enumerate(spelled(raw, depth)):
                    if last and i == 0:
                        waiting.append((runs << np.uint64(16)) | np.uint64(len(digests)))
                        digests.append(_digest(raw))
                        size += len(runs)
                    else:
                        place = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
                        total += np.where(keys[place] == runs, values[place], 0.0).sum()
                        if last:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([_digest(raw)], pa.binary()), pa.array(total)], names=["digest", "score"]
                            )
                if size >= RUNS_AT_ONCE // 2 or len(digests) > 60_000:
                    yield summed()
                    digests, waiting, size = [], [], 0
        if digests:
            yield summed()

    return run


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x >= 1/2, by Stirling's series at x + 8."""
    y = x + 8
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    half_log_2pi = 0.9189385332046727
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + half_log_2pi + series - F.log(product)


def kt_block(n0: Column, n1: Column) -> Column:
    """Logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in any order."""
    log_pi = 1.1447298858494002
    return F.when(
        n0 + n1 > 0,
        log_gamma(n0.cast("double") + 0.5) + log_gamma(n1.cast("double") + 0.5) - log_pi - log_gamma((n0 + n1 + 1).cast("double")),
    ).otherwise(F.lit(0.0))


def _bits(grams: DataFrame) -> DataFrame:
    """The eight binary steps of the last byte of every run."""
    steps = grams.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return steps.select(
        "gram",
        "n",
        F.expr("shiftright(gram, 8)").alias("ctx"),
        F.expr("cast(shiftleft(1, k) | shiftright(cast(gram & 255 as int), 8 - k) as int)").alias("node"),
        F.expr("cast(shiftright(cast(gram & 255 as int), 7 - k) & 1 as int)").alias("bit"),
    )


def run_scores(grams: DataFrame, depth: int) -> DataFrame:
    """(gram, n) with training counts to (gram, value): log10 of its last byte's probability after the others."""
    n0, n1 = F.col("n0"), F.col("n1")
    kt = (n1 + 0.5) / (n0 + n1 + 1.0)
    leaves = _bits(grams).groupBy("ctx", "node").agg(
        F.sum(F.col("n") * (1 - F.col("bit"))).alias("n0"), F.sum(F.col("n") * F.col("bit")).alias("n1")
    )
    level = durable(leaves.select("*", kt_block(n0, n1).alias("pw"), F.lit(1.0).alias("q")), "contexts")
    levels = [level]
    for length in range(depth - 1, -1, -1):
        shorter = F.col("ctx").bitwiseAND(F.lit(256**length - 1))
        merged = level.groupBy(shorter.alias("ctx"), "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below")
        )
        pe = F.col("pe")
        stop = 1 / (1 + F.exp(F.least(F.col("below") - pe, F.lit(700.0))))
        larger, smaller = F.greatest(pe, F.col("below")), F.least(pe, F.col("below"))
        pw = larger + F.log1p(F.exp(smaller - larger)) - float(np.log(2))
        merged = merged.withColumn("pe", kt_block(n0, n1)).select("ctx", "node", "n0", "n1", pw.alias("pw"), stop.alias("q"))
        level = durable(merged, "contexts")
        levels.insert(0, level)

    path = levels[0].select("ctx", "node", (F.col("q") * kt).alias("sum"), (1 - F.col("q")).alias("rest"))
    for length, level in enumerate(levels[1:], 1):
        above = path.toDF("above", "node", "sum", "rest")
        own = level.withColumn("above", F.col("ctx").bitwiseAND(F.lit(256 ** (length - 1) - 1)))
        path = own.join(above, ["above", "node"]).select(
            "ctx", "node", (F.col("sum") + F.col("rest") * F.col("q") * kt).alias("sum"), (F.col("rest") * (1 - F.col("q"))).alias("rest")
        )
    one = durable(path.select("ctx", "node", F.col("sum").alias("one")), "bit-probabilities")
    chosen = F.when(F.col("bit") == 1, F.col("one")).otherwise(1 - F.col("one"))
    return _bits(grams).join(one, ["ctx", "node"]).groupBy("gram").agg(F.sum(F.log10(chosen)).alias("value"))


def _sum_block(part: pa.Table) -> pa.Table:
    """Sums of one block's words by segment."""
    kind = part.column("kind").to_numpy()
    segments = part.filter(pa.array(kind == SEGMENT)).sort_by("segment")
    words = part.filter(pa.array(kind == WORD)).sort_by("segment")
    packed = part.filter(pa.array(kind == PLACES)).column("places")[0].as_py()
    lengths, where, times = unpack_places(packed, words.num_rows)
    value = np.repeat(words.column("value").to_numpy(), lengths)
    known = np.repeat(words.column("known").to_numpy().astype(np.int64), lengths)
    return pa.table(
        {
            **{c: segments.column(c) for c in ("row_key", "doc_id", "held_out", "digest", "n_bytes")},
            "n_tokens": segments.column("n"),
            "n_known": pa.array(np.bincount(where, known * times, segments.num_rows).astype(np.int64)),
            "base": pa.array(np.bincount(where, value * times, segments.num_rows).astype(np.float64)),
        }
    )


def score_texts(docs: DataFrame, depth: int = 4) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text, held_out), learned from the rows not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes,
    bits_per_byte. ``score`` is the log10 probability of the text's words, blanks and end. A null
    or empty text is the end alone. Without any training text every bit has probability 1/2.
    Every row is scored on its own, repeated ones too; a null held_out counts as held out. An empty
    table gives no rows; other columns are ignored.
    """
    if not 0 <= depth <= 5:
        raise ValueError("depth must be between 0 and 5")
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("held_out"), F.lit(True)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    spark = docs.sparkSession
    path = fresh_path(spark, "corpus-parts")
    corpus_parts(docs, depth).write.partitionBy("kind").parquet(path)
    stored = spark.read.schema(SCHEMA).parquet(path)
    of = lambda kind: stored.where(F.col("kind") == kind)

    grams = durable(of(GRAM).groupBy("gram").agg(F.sum("n").alias("n")), "byte-runs")
    scores = durable(run_scores(grams, depth), "run-scores")
    words = durable(of(WORD).groupBy("word").agg(F.sum("n").alias("n")), "words")

    totals = words.where("n > 0").agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = of(SEGMENT).where(~F.col("held_out")).select("row_key").distinct().count()
    all_tokens, vocabulary = totals["n"] + ends, totals["v"] + (ends > 0)
    scale = float(np.log10(all_tokens + 0.1 * (vocabulary + 1)))
    end = float(np.log10(ends + 0.1))

    log_words = words.select("word", F.log10(F.col("n") + 0.1).alias("value"), (F.col("n") > 0).alias("known"))
    in_blocks = of(WORD).select("kind", "block", "word", "segment").join(log_words, "word").drop("word")
    others = stored.where(F.col("kind").isin(SEGMENT, PLACES)).drop("gram", "word")
    by_block = in_blocks.unionByName(others, allowMissingColumns=True)
    base = by_block.groupBy("block").applyInArrow(
        _sum_block,
        "row_key long, doc_id long, held_out boolean, digest binary, n_bytes long, n_tokens long, n_known long, base double",
    )
    base = base.groupBy("row_key").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "held_out", "digest")],
        *[F.sum(c).alias(c) for c in ("n_bytes", "n_tokens", "n_known", "base")],
    )
    if not all_tokens and docs.isEmpty():
        return base.select(*_results(all_tokens, scale, end, ends, F.lit(0.0)))
    score = durable(run_sums(docs, scores, depth), "text-scores")
    return durable(base, "base-scores").join(score, "digest").select(*_results(all_tokens, scale, end, ends, F.col("score")))


def _results(all_tokens: int, scale: float, end: float, ends: int, score: Column) -> list[Column]:
    return [
        F.col("doc_id"),
        F.col("held_out"),
        F.col("n_tokens"),
        (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + end - F.col("n_tokens") * scale).alias("base_score"),
        score.alias("score"),
        F.col("n_bytes"),
        (score * -float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    ]
