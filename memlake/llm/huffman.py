"""Token ids as files of canonical, length-limited Huffman code.

A stored stream is a folder of three Parquet tables; Spark's writers make them, so a lost task leaves nothing
half written:

* ``codebook`` (id, length): code lengths found from the counts of all ids. Codes are canonical: numbered in
  order of (length, id), so the lengths are all a reader needs.
* ``blocks`` (slice, block, first, n_ids, n_bits, checkpoint_ids, checkpoints, payload, docs): up to ``block_ids``
  ids each, in order. A block decodes on its own; ``checkpoints`` has the bit where every ``checkpoint_ids``-th id
  begins, and ``docs`` the documents in it: their id, number in the slice, how many of their ids are here, and
  whether their first and last ids are. ``first`` counts the ids of the slice before the block.
* ``slices`` (slice, start): ids in all slices before. Slices are ranges of documents in order.

Code lengths come from package-merge, the optimum under the limit. Decoding looks up ``max_bits`` bits at a
time in a table of (id, length); all pieces between checkpoints are decoded side by side, one id of each a step.

How the work is spread: texts are encoded once; the ids are shuffled once, into ranges by document id (and,
for repeated ids, by length, checksum and row, so that no id makes a large range). A document of any length is cut into
blocks like all others; its checksum is combined from those of its pieces.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.session import durable, fresh_path, shuffle_width

if TYPE_CHECKING:
    from tokenizers import Tokenizer


@dataclass(frozen=True)
class HuffmanParams:
    """``max_bits`` (25 at most) must allow for all ids that occur: there are 2^max_bits codes."""

    max_bits: int = 18
    block_ids: int = 262_144
    checkpoint_ids: int = 256
    slice_ids: int = 16_000_000


# Characters of texts encoded at a time; words given to the library at a time, kept for later, and too long (in bytes) to keep.
CHARS_AT_ONCE = 6_000_000
WORDS_AT_ONCE, WORDS_KEPT, LONG_WORD = 500, 300_000, 100
# Stands between words that the library gets as one text: no text of words is longer than this (in characters).
MARK, MARKED_CHARS = "\x01", 100_000

# The tokenizer of a worker.
_encoders: dict[str, WordIds] = {}
# Ids below this are looked up directly, larger ones by search.
DIRECT_IDS = 1 << 22
# A code and the seven bits before its first byte's end fit four bytes.
MOST_BITS = 25


# --- code -------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Lengths of the optimal code of at most ``max_bits`` bits (package-merge); all counts are above 0."""
    n = len(counts)
    if max_bits > MOST_BITS:
        raise ValueError(f"codes have at most {MOST_BITS} bits")
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need more than {max_bits} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    # A package of the last level holds at most max_bits times all counts.
    exact = int(counts.sum()) * max_bits < 2**53
    leaves = counts[order].astype(np.float64 if exact else object)
    # Per level which items of the merged list are leaves; packages are pairs of the level below.
    levels, packages = [], leaves[:0]
    for _ in range(max_bits):
        merged = np.concatenate([leaves, packages])
        is_leaf = np.arange(len(merged)) < n
        placed = np.argsort(merged, kind="stable")
        merged, is_leaf = merged[placed], is_leaf[placed]
        levels.append(is_leaf)
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
    # The first 2n - 2 items of the last level; their packages are the first items of the level below.
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:taken].sum())
        lengths[:own] += 1
        taken = 2 * (taken - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


@dataclass(frozen=True)
class Code:
    """Canonical code: ids in ascending order, their lengths and codes."""

    ids: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray
    # Where an id stands among ``ids``, if ids are small numbers.
    place: np.ndarray | None

    @staticmethod
    def of(ids: np.ndarray, lengths: np.ndarray) -> Code:
        by_id = np.argsort(ids, kind="stable")
        ids, lengths = ids[by_id].astype(np.int64), lengths[by_id].astype(np.int64)
        order = np.lexsort((ids, lengths))
        longest = int(lengths.max(initial=0))
        # Code number of the n-th symbol: the sum of 2^-length of those before it, as a fraction.
        shares = np.int64(1) << (longest - lengths[order])
        codes = np.empty(len(ids), np.int64)
        codes[order] = (np.cumsum(shares) - shares) >> (longest - lengths[order])
        place = None
        if ids.max(initial=0) < DIRECT_IDS:
            place = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
            place[ids] = np.arange(len(ids))
        return Code(ids, lengths, codes, place)

    def table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """For every value of the next bits the id and the length of its code, and how many bits these are."""
        longest = int(self.lengths.max(initial=0))
        ids, sizes = np.zeros(1 << longest, np.int64), np.zeros(1 << longest, np.int64)
        order = np.argsort(self.codes << (longest - self.lengths), kind="stable")
        times = np.int64(1) << (longest - self.lengths[order])
        ids[: times.sum()] = np.repeat(self.ids[order], times)
        sizes[: times.sum()] = np.repeat(self.lengths[order], times)
        return ids, sizes, longest


def pack(ids: np.ndarray, code: Code, checkpoint_ids: int) -> tuple[bytes, int, np.ndarray]:
    """Payload, its bits, and the bit where every ``checkpoint_ids``-th id begins."""
    place = np.searchsorted(code.ids, ids) if code.place is None else code.place[ids]
    sizes = code.lengths[place]
    ends = np.cumsum(sizes)
    begins, bits = ends - sizes, int(ends[-1]) if len(ids) else 0
    # A code stands in the 32-bit word it begins in and, at most, the next one. Codes share no bit, so adding joins them.
    word = begins >> 5
    both = code.codes[place].astype(np.uint64) << (64 - sizes - (begins & 31)).astype(np.uint64)
    out = np.zeros((bits >> 5) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    if len(ids):
        out[word[first]] += np.add.reduceat(both >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(both & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: -(-bits // 8)], bits, begins[::checkpoint_ids].astype(np.int32)


def unpack(payload: bytes, n_ids: int, checkpoints: np.ndarray, checkpoint_ids: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of a block: the pieces between checkpoints side by side."""
    symbols, sizes, longest = table
    raw = np.frombuffer(payload, np.uint8)
    # Four bytes from each place on hold any code that begins in the first.
    wide = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.int64)
    wide = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((checkpoint_ids, len(at)), np.int64)
    last = n_ids - (len(at) - 1) * checkpoint_ids
    mask, limit = (1 << longest) - 1, len(wide) - 1
    for step in range(min(checkpoint_ids, n_ids)):
        if step == last:
            at = at[:-1]
        peeked = (wide[np.minimum(at >> 3, limit)] >> (32 - longest - (at & 7))) & mask
        out[step, : len(at)] = symbols[peeked]
        at = at + sizes[peeked]
    return out.T.ravel()[:n_ids]


# --- checksums ------------------------------------------------------------------------

# Fixed value: the CRC-32 polynomial, bits reversed.
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial; bit 31 is the constant term."""
    product = 0
    while a:
        if a & 0x80000000:
            product ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (_POLYNOMIAL if b & 1 else 0)
    return product


def combined_crc32(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two joined texts from their own: the first moves up by the second's bits."""
    shift, power, bits = 0x80000000, 0x40000000, 8 * second_bytes
    while bits:
        if bits & 1:
            shift = _times(shift, power)
        power = _times(power, power)
        bits >>= 1
    return _times(first, shift) ^ second


# --- ids of texts -----------------------------------------------------------------------


def stored(ids: np.ndarray) -> bytes:
    """Ids as little-endian numbers of 16 bits if these hold them, else of 32."""
    return (ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else ids).tobytes()


def loaded(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


class WordIds:
    """Ids of texts, found word by word; those of words met lately are kept, in bounded number.

    The library splits a text into words at white space before all else that looks at neighbours, so the ids of a text
    are those of its words (between ASCII blanks), one after the other.

    A text costs the library about as much as a word: unknown words are joined to one text, a mark between them. They are encoded
    one by one if the mark is in one of them, or is not found between all of them afterwards.
    """

    def __init__(self, model: Tokenizer) -> None:
        self.model, self.known, self.older = model, {}, {}
        self.mark = model.encode(MARK, add_special_tokens=False).ids

    def _encoded(self, words: list[str]) -> list[bytes]:
        out = []
        for start in range(0, len(words), WORDS_AT_ONCE):
            chosen = words[start : start + WORDS_AT_ONCE]
            out += self._encoded_together(chosen) or self._encoded_alone(chosen)
        return out

    def _encoded_alone(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def _encoded_together(self, words: list[str]) -> list[bytes] | None:
        text, marks = f" {MARK} ".join(words), len(words) - 1
        if len(self.mark) != 1 or len(text) > MARKED_CHARS or text.count(MARK) != marks:
            return None
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.mark[0])
        if len(ends) != marks:
            return None
        raw = ids.tobytes()
        return [raw[start:stop] for start, stop in zip([0, *(4 * ends + 4).tolist()], [*(4 * ends).tolist(), len(raw)])]

    def _of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        found = list(map(self.known.get, words))
        missing = [word for word, ids in zip(words, found) if ids is None]
        remembered = list(map(self.older.get, missing))
        encoded = iter(self._encoded([word for word, ids in zip(missing, remembered) if ids is None]))
        met = [next(encoded) if ids is None else ids for ids in remembered]
        if max(map(len, missing), default=0) <= LONG_WORD:
            self.known.update(zip(missing, met))
        else:
            self.known.update((word, ids) for word, ids in zip(missing, met) if len(word) <= LONG_WORD)
        if len(self.known) > WORDS_KEPT:
            self.known, self.older = {}, self.known
        rest = iter(met)
        return [next(rest) if ids is None else ids for ids in found]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text; every distinct word is looked up once."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        found = self._of(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        place = words.indices.to_numpy()
        own = sizes[place]
        ends = np.concatenate([[0], np.cumsum(own)])
        starts = (np.cumsum(sizes) - sizes)[place]
        whole = ids[np.repeat(starts - ends[:-1], own) + np.arange(ends[-1])]
        offsets = split.offsets.to_numpy()
        return np.split(whole, ends[offsets - offsets[0]][1:-1]) if len(texts) else []


def _encoder(content: str) -> WordIds:
    """Made once per worker."""
    if content not in _encoders:
        # One task, one core: the library's own threads stay off.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _encoders.clear()
        _encoders[content] = WordIds(Tokenizer.from_str(content))
    return _encoders[content]


def token_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """row, doc_id, n, crc, ids: the ids of every text, an end id after them.

    ``ids`` are as of ``stored``; ``crc`` is that of the ids as little-endian unsigned 32-bit numbers. ``row`` tells repeated rows apart. A null
    text is an empty one. The tokenizer must split at white space.
    """
    # The file is read on the driver (some MB) and sent to the tasks.
    with open(tokenizer, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(content.value), np.array([end_id], "<u4")
        for batch in batches:
            portion = np.cumsum(batch.column("n_chars").to_numpy()) // CHARS_AT_ONCE
            for start, stop in _runs(portion):
                piece = batch.slice(start, stop - start)
                ids = [np.append(own, end) for own in encode(piece.column("text"))]
                columns = [
                    piece.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([stored(x) for x in ids], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "crc", "ids"])

    text = F.coalesce(F.col("text"), F.lit(""))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
    found = chosen.mapInArrow(run, "doc_id long, n long, crc long, ids binary")
    return found.withColumn("row", F.monotonically_increasing_id())


def _runs(portion: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of equal neighbours."""
    edges = np.flatnonzero(np.diff(portion)) + 1
    return zip([0, *edges.tolist()] if len(portion) else [], [*edges.tolist(), len(portion)])


def id_counts(tokens: DataFrame) -> DataFrame:
    """id, n: how often each id occurs; a task gives out one row per distinct id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            own = [loaded(raw.as_buffer(), n) for n, raw in zip(batch.column("n").to_pylist(), batch.column("ids"))]
            found = np.bincount(np.concatenate(own) if own else counts[:0], minlength=len(counts))
            found[: len(counts)] += counts
            counts = found
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(counts[ids])], names=["id", "n"])

    return tokens.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- files --------------------------------------------------------------------------------

_DOCS = "array<struct<doc_id:bigint,doc:bigint,n:int,begins:boolean,ends:boolean>>"
_BLOCK = (
    "slice int, block long, first long, n_ids int, n_bits long, checkpoint_ids int, checkpoints array<int>, payload binary, "
    f"docs {_DOCS}"
)
_DOC_TYPE = pa.list_(
    pa.struct([("doc_id", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("begins", pa.bool_()), ("ends", pa.bool_())])
)


def write_ids(tokens: DataFrame, path: str, params: HuffmanParams = HuffmanParams()) -> None:
    """Store the ids of documents in ascending order of doc_id (missing ids first; equal ones by
    number of ids, checksum and row) below ``path``, a new folder. ``tokens`` as of ``token_ids``, from a written table."""
    spark = tokens.sparkSession
    # As many rows as the vocabulary has ids.
    counted = id_counts(tokens).orderBy("id").toArrow()
    ids, counts = counted.column("id").to_numpy(), counted.column("n").to_numpy()
    code = Code.of(ids, code_lengths(counts, params.max_bits))
    book = pa.table({"id": pa.array(code.ids), "length": pa.array(code.lengths.astype(np.int32))})
    spark.createDataFrame(book).coalesce(1).sortWithinPartitions("length", "id").write.parquet(f"{path}/codebook")

    order = ["doc_id", "n", "crc", "row"]
    slices = max(shuffle_width(spark), -(-int(counts.sum()) // params.slice_ids))
    placed = tokens.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    numbered = placed.select(F.spark_partition_id().alias("slice"), "doc_id", "n", "ids")
    numbered.mapInArrow(_blocks(code, params), _BLOCK).write.parquet(f"{path}/blocks")

    sizes = spark.read.parquet(f"{path}/blocks").groupBy("slice").agg(F.sum("n_ids").alias("n"))
    # One row per slice.
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts.coalesce(1).write.parquet(f"{path}/slices")


def _blocks(code: Code, params: HuffmanParams):
    """Documents of a slice, in order, to its blocks; a task holds the ids of one block and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = first = waiting = doc = 0
        parts: list[np.ndarray] = []
        docs: list[dict] = []

        def closed(own_slice: int) -> pa.RecordBatch:
            nonlocal number, first, waiting, parts, docs
            ids = np.concatenate(parts)
            payload, bits, checkpoints = pack(ids, code, params.checkpoint_ids)
            values = [own_slice, number, first, len(ids), bits, params.checkpoint_ids, checkpoints.tolist(), payload, docs]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), _DOC_TYPE]
            names = [field.split()[0] for field in _BLOCK.split(", ")]
            number, first, waiting, parts, docs = number + 1, first + len(ids), 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        own_slice = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("slice", "doc_id", "n")]
            for own_slice, doc_id, n, raw in zip(*columns, batch.column("ids")):
                ids = loaded(raw.as_buffer(), n)
                at = 0
                while at < len(ids):
                    taken = ids[at : at + params.block_ids - waiting]
                    docs.append({"doc_id": doc_id, "doc": doc, "n": len(taken), "begins": at == 0, "ends": at + len(taken) == len(ids)})
                    parts.append(taken)
                    at, waiting = at + len(taken), waiting + len(taken)
                    if waiting == params.block_ids:
                        yield closed(own_slice)
                doc += 1
        if waiting:
            yield closed(own_slice)

    return run


_PIECE = "slice int, doc long, doc_id long, first long, n long, crc long, whole boolean"


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """slice, doc, doc_id, first (ids of the slice before it), n, crc, whole: the part of every document in every block."""
    book = spark.read.parquet(f"{path}/codebook").toArrow()
    code = Code.of(book.column("id").to_numpy(), book.column("length").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = code.table()
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                ids = unpack(block["payload"], block["n_ids"], np.array(block["checkpoints"]), block["checkpoint_ids"], table).astype("<u4")
                docs = block["docs"]
                sizes = np.array([d["n"] for d in docs])
                begins = np.cumsum(sizes) - sizes
                rows = [
                    (block["slice"], d["doc"], d["doc_id"], block["first"] + int(at), d["n"], zlib.crc32(ids[at : at + d["n"]]), d["begins"] and d["ends"])
                    for d, at in zip(docs, begins)
                ]
                names = [field.split()[0] for field in _PIECE.split(", ")]
                types = [pa.int32(), *[pa.int64()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, _PIECE)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a stored stream."""
    pieces = durable(read_pieces(spark, path), "id-pieces")
    whole = pieces.where("whole").select("slice", "doc_id", "first", "n", "crc")

    def joined(table: pa.Table) -> pa.Table:
        parts = sorted(zip(*(table.column(c).to_pylist() for c in ("first", "n", "crc"))))
        crc = 0
        for _, n, own in parts:
            crc = combined_crc32(crc, own, 4 * n)
        head = table.slice(0, 1)
        return pa.table({
            "slice": head.column("slice"), "doc_id": head.column("doc_id"), "first": pa.array([parts[0][0]], pa.int64()),
            "n": pa.array([sum(n for _, n, _ in parts)], pa.int64()), "crc": pa.array([crc], pa.int64()),
        })

    # Few rows per document: one for each of its blocks.
    cut = pieces.where(~F.col("whole")).groupBy("slice", "doc").applyInArrow(joined, "slice int, doc_id long, first long, n long, crc long")
    starts = spark.read.parquet(f"{path}/slices")
    placed = whole.unionByName(cut).join(starts, "slice")
    return placed.select("doc_id", (F.col("start") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def stored_ids(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None, params: HuffmanParams = HuffmanParams()) -> DataFrame:
    """Encode, store below ``path`` (or a scratch folder) and read back: doc_id, start, n_tokens, ids_crc32.

    docs: doc_id, text. A null text is an empty one: the end id alone. Repeated rows are documents of
    their own, missing ids come first. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    tokens = durable(token_ids(docs, tokenizer, end_id), "token-ids")
    path = path or fresh_path(spark, "huffman")
    write_ids(tokens, path, params)
    return read_documents(spark, path)
