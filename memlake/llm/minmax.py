"""Near-duplicate documents by min-max hashing.

Every shingle is hashed once under each permutation and both the smallest and the largest
value are kept: two signature values per hash evaluation, each equal for two sets with
probability equal to their Jaccard similarity, and of lower variance together than two
minima of independent permutations. Bands of values give buckets; the buckets only propose
pairs, every link is confirmed on the full shingle sets.

How large groups are handled: documents with equal sets are one class from the start, and
all later work is on classes. A bucket proposes a star (every member with one centre), not
all pairs, for several rounds with other centres; after each round only pairs between
different components can still change the result, so buckets inside one component drop out.
What is still open after the rounds is compared in full, in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import WordHashes, bit_filter, map_pieces, mix64, passes_filter, shingle_hashes
from memlake.llm.components import connected_components
from memlake.session import durable


# Shingles on either side of one comparison of blocks (8 MB each).
BLOCK_SHINGLES = 1_000_000
# Members outside a bucket's largest component up to which its pairs are listed.
FEW_OUTSIDE = 8
# Classes asked for up to which their sets are picked where they lie (some 20 MB are sent).
FEW_ASKED = 200_000
# Size of the filter that names documents to a scan, for up to an eighth as many (a power of two).
FILTER_BITS = 1 << 23


@dataclass(frozen=True)
class MinMaxParams:
    """``percent``: linked from this Jaccard similarity on. A pair at 0.8 is missed by all bands with
    probability (1 - 0.8**rows) ** bands, 2.9e-6 at the defaults; more similar pairs far less often. Minimum and
    maximum of one permutation exclude each other on small sets: 4 of 5 shingles are missed with 4e-5, 8 of 10 with 9e-6.
    ``permutations`` hashes give twice as many values, of which bands * rows are used."""

    width: int = 2
    percent: int = 80
    permutations: int = 126
    bands: int = 42
    rows: int = 6
    star_rounds: int = 2
    seed: int = 7


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z lower-cased, words cut at ASCII space."""
    return np.unique(shingle_hashes(hashes((text or "").encode().lower().split()), width))


def digest(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


class Signer:
    """Signatures of shingle sets: the minimum and the maximum under each permutation."""

    CHUNK = 512

    def __init__(self, params: MinMaxParams) -> None:
        self.params = params
        ids = np.arange(1, params.permutations + 1, dtype=np.uint64) + np.uint64(params.seed) * np.uint64(1 << 32)
        self.factor = mix64(ids) | np.uint64(1)
        self.shift = mix64(self.factor)

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """Interleaved: minimum and maximum of the first permutation, of the second, ..."""
        low = high = None
        for start in range(0, len(shingles), self.CHUNK):
            images = shingles[start : start + self.CHUNK, None] * self.factor
            images += self.shift
            part_low, part_high = images.min(axis=0), images.max(axis=0)
            low = part_low if low is None else np.minimum(low, part_low)
            high = part_high if high is None else np.maximum(high, part_high)
        return np.stack([low, high], axis=1).reshape(-1)

    def bands(self, values: np.ndarray) -> np.ndarray:
        """One key per band, different for every band."""
        p = self.params
        grid = values[: p.bands * p.rows].reshape(p.bands, p.rows)
        keys = mix64(np.arange(p.bands, dtype=np.uint64) + np.uint64(p.seed))
        for i in range(p.rows):
            keys = mix64(keys ^ mix64(grid[:, i]))
        return keys

    @staticmethod
    def sketch(values: np.ndarray) -> bytes:
        """Eight bits of every value, to discard pairs far below the limit."""
        return mix64(values).astype(np.uint8).tobytes()


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What a row is told apart by, with an id or without: equal rows share it."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))


def signatures(docs: DataFrame, params: MinMaxParams, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key (of the row), n_shingles, digest, bands, sketch; the last three are null for an empty set."""

    def run(batches):
        hashes, signer = WordHashes(), Signer(params)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, bands, sketches = [], [], [], []
            for value in batch.column("text"):
                found = shingle_set(value.as_py(), params.width, hashes)
                counts.append(len(found))
                values = signer.values(found) if len(found) else None
                digests.append(digest(found) if len(found) else None)
                bands.append(signer.bands(values).view(np.int64) if len(found) else None)
                sketches.append(signer.sketch(values) if len(found) else None)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                names=["doc_id", "key", "n_shingles", "digest", "bands", "sketch"],
            )

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                yield work(batch.slice(start, 256))

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.withColumn("key", row_key()).mapInArrow(
        run, "doc_id long, key long, n_shingles long, digest binary, bands array<long>, sketch binary"
    )


def shingle_sets(texts: DataFrame, width: int, filled: np.ndarray | None = None) -> DataFrame:
    """(digest, shingles) of all texts, or of those whose row's key may be in the filter."""
    sent = texts.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        hashes, bits = WordHashes(), sent.value
        for batch in batches:
            # Equal rows once.
            keys, first = np.unique(batch.column("key").to_numpy(), return_index=True)
            if bits is not None:
                first = first[passes_filter(keys.view(np.uint64), bits)]
            batch = batch.take(pa.array(np.sort(first)))
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                found = [shingle_set(t.as_py(), width, hashes) for t in piece.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
                    names=["digest", "shingles"],
                )

    return texts.select(row_key().alias("key"), "text").mapInArrow(run, "digest binary, shingles array<long>")


def likely(pairs: DataFrame, params: MinMaxParams) -> DataFrame:
    """Drop pairs whose sketches agree in far fewer places than the limit allows.

    Eight bits agree by chance in 1 of 256 places. At the limit the share of agreeing places is
    0.8 with a deviation below 0.03; pairs under 0.6 are dropped.
    """
    least = (params.percent / 100 - 0.2) * 2 * params.permutations

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        def grid(name: str) -> np.ndarray:
            joined = b"".join(batch.column(name).to_pylist())
            return np.frombuffer(joined, np.uint8).reshape(batch.num_rows, -1)

        keep = (grid("sketch_a") == grid("sketch_b")).sum(axis=1) >= least
        kept = pa.array(keep)
        return pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["a", "b"])

    return map_pieces(pairs.select("a", "b", "sketch_a", "sketch_b"), work, "a binary, b binary")


def _with_class(pairs: DataFrame, classes: DataFrame, side: str, *columns: str) -> DataFrame:
    """Columns of one side's class, with the side's name behind them."""
    part = classes.select(F.col("digest").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
    return pairs.join(part, side)


def _alike_sizes(params: MinMaxParams) -> Column:
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return small * 100 >= large * params.percent


def confirmed(pairs: DataFrame, classes: DataFrame, sets: _Sets, params: MinMaxParams) -> DataFrame:
    """The pairs (a, b) of classes that reach the similarity on their full sets."""
    sized = _with_class(_with_class(pairs, classes, "a", "n", "sketch"), classes, "b", "n", "sketch")
    sized = sized.where(_alike_sizes(params))
    pairs = durable(likely(sized, params), "likely-pairs")

    asked = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct()
    known = sets.of(asked)

    # b is the centre of a star and may be in very many pairs: it comes last and is sent once per task.
    joined = _with_class(_with_class(pairs, known, "a", "shingles"), known, "b", "shingles")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - common
    return joined.where(common * 100 >= union * params.percent).select("a", "b")


class _Sets:
    """(digest, shingles) of the classes asked for so far, each made once from the text of one of its rows."""

    def __init__(self, classes: DataFrame, docs: DataFrame, params: MinMaxParams) -> None:
        self.classes, self.docs, self.params = classes, docs, params
        self.made: DataFrame | None = None

    def of(self, asked: DataFrame) -> DataFrame:
        """Sets of at least the classes ``asked`` (digest, distinct); of no others if these are few of those made."""
        few = self.made is not None and (asked := durable(asked, "asked-sets")).count() <= FEW_ASKED
        new = asked if self.made is None else asked.join(self.made.select("digest"), "digest", "left_anti")
        wanted = self.classes.join(new, "digest", "left_semi").select("digest", "key")
        wanted = durable(wanted, "wanted-sets")
        count = wanted.count()
        if self.made is None or count:
            if count <= FILTER_BITS // 8:
                # The texts are told apart where they are read; none is shuffled.
                found = shingle_sets(self.docs, self.params.width, bit_filter(wanted, "key", FILTER_BITS))
            else:
                found = shingle_sets(self.docs.withColumn("key", row_key()).join(wanted.select("key"), "key", "left_semi"), self.params.width)
            # Other rows that the filter lets through fall away here.
            found = found.join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
            found = durable(found, "shingle-sets")
            self.made = found if self.made is None else self.made.unionByName(found)
        # Sets are large: those made for other pairs are not shuffled again.
        return self.made.join(F.broadcast(asked), "digest", "left_semi") if few else self.made


def near_groups(docs: DataFrame, params: MinMaxParams = MinMaxParams()) -> DataFrame:
    """doc_id, key, n_shingles, component (what links connect; null without words), component_id (its smallest doc_id)
    for every row of ``docs``; ``key`` is the row's ``row_key``. Rows without id are linked like all others."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = durable(signatures(docs, params), "signatures")
    full = signed.where(F.col("n_shingles") > 0)
    first = F.min_by(F.struct(F.col("n_shingles").alias("n"), "bands", "sketch"), F.coalesce("doc_id", F.lit(2**63 - 1)))
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), first.alias("f"))
    classes = durable(classes.select("digest", "rep", "key", "f.n", "f.bands", "f.sketch"), "classes")

    labels = _component_labels(docs, classes, params)
    named = classes.select("digest", "rep").join(labels, "digest", "left")
    named = named.withColumn("label", F.coalesce("label", "digest"))
    smallest = durable(named.groupBy("label").agg(F.min("rep").alias("component_id")), "component-names")
    named = named.join(smallest, "label").select("digest", F.col("label").alias("component"), "component_id")
    named = durable(named, "class-components")

    rows = full.select("doc_id", "key", "n_shingles", "digest").join(named, "digest").drop("digest")
    none = F.lit(None).cast("binary").alias("component")
    alone = signed.where(F.col("n_shingles") == 0).select("doc_id", "key", "n_shingles", none, F.col("doc_id").alias("component_id"))
    return rows.unionByName(alone)


def near_duplicates(docs: DataFrame, params: MinMaxParams = MinMaxParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text, ...).

    Documents are linked when their sets of word shingles reach the similarity; a component
    is what links connect, named by its smallest doc_id. Null and empty texts have an empty set,
    no links, and are kept. Rows with equal sets are one class, so repeated rows share a
    component. Rows without doc_id belong to the component they are linked to; where none of
    its rows has an id, they are kept with a null component. Other columns are ignored.
    """
    out = near_groups(docs, params).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _component_labels(docs: DataFrame, classes: DataFrame, params: MinMaxParams) -> DataFrame:
    """(digest, label) of the classes that are linked to another."""
    banded = classes.select("digest", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select("band")
    banded = durable(banded.join(durable(shared, "shared-bands"), "band"), "banded")

    links = tested = labels = None
    sets = _Sets(classes, docs, params)
    for turn in range(params.star_rounds + 1):
        members = banded if labels is None else durable(_open_members(banded, labels, turn), "open-members")
        if labels is not None and members.isEmpty():
            break
        if turn < params.star_rounds:
            pairs = _stars(members, turn).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = durable(pairs, "pairs")
            tested = pairs if tested is None else tested.unionByName(pairs)
            found = durable(confirmed(pairs, classes, sets, params), "links")
        else:
            found = durable(_cross_links(members, classes, sets, params), "links")
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links).select(F.col("node").alias("digest"), F.col("component").alias("label"))
        labels = durable(labels, "labels")
    return labels


def _open_members(banded: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Members of buckets that hold more than one component, with their component and the bucket's centre of this round."""
    known = durable(banded.join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest")), "labelled")
    first = F.min(F.struct(_place(turn).alias("p"), "digest", "label")).alias("c")
    mixed = known.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), first)
    mixed = mixed.where(F.col("low") != F.col("high")).select("band", F.col("c.digest").alias("centre"), F.col("c.label").alias("centre_label"))
    return known.join(durable(mixed, "mixed-bands"), "band")


def _place(turn: int) -> Column:
    return F.xxhash64("digest", F.lit(turn))


def _stars(members: DataFrame, turn: int) -> DataFrame:
    """Every member of a bucket with the bucket's centre of this round, as (a, b = centre)."""
    if "label" in members.columns:
        met, apart = members, F.col("label") != F.col("centre_label")
    else:
        centres = members.groupBy("band").agg(F.min_by("digest", _place(turn)).alias("centre"))
        met, apart = members.join(durable(centres, "centres"), "band"), F.col("digest") != F.col("centre")
    return met.where(apart).select(F.col("digest").alias("a"), F.col("centre").alias("b"))


def _cross_links(members: DataFrame, classes: DataFrame, sets: _Sets, params: MinMaxParams) -> DataFrame:
    """Links between members of a bucket in different components, each proved on full sets.

    The members outside a bucket's largest component meet all members. Where they are at most
    ``FEW_OUTSIDE`` the pairs are listed (a bounded multiple of the members) and confirmed once over
    all buckets. Otherwise both sides meet in blocks of about ``BLOCK_SHINGLES``, and a block gives
    out links only, one for each member and component, never its pairs.
    """
    sized = durable(members.join(classes.select("digest", "n"), "digest"), "sized-members")
    counted = sized.groupBy("band", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    largest = counted.groupBy("band").agg(
        F.max(F.struct("c", "label", "s")).alias("top"), F.sum("c").alias("count"), F.sum("s").alias("all")
    )
    blocks = lambda shingles: F.ceil(shingles / BLOCK_SHINGLES).cast("int")
    shape = largest.select(
        "band",
        F.col("top.label").alias("top"),
        (F.col("count") - F.col("top.c") <= FEW_OUTSIDE).alias("listed"),
        blocks(F.col("all") - F.col("top.s")).alias("few"),
        blocks(F.col("all")).alias("many"),
    )
    placed = durable(sized.join(durable(shape, "bucket-shapes"), "band"), "placed-members")
    listed = confirmed(durable(_listed_pairs(placed.where("listed")), "pairs"), classes, sets, params)
    large = placed.where(~F.col("listed"))
    return listed if large.isEmpty() else listed.unionByName(_block_links(large, sets, params))


def _listed_pairs(placed: DataFrame) -> DataFrame:
    outer = placed.where(F.col("label") != F.col("top")).select("band", F.col("digest").alias("b"), F.col("label").alias("label_b"))
    inner = placed.select("band", F.col("digest").alias("a"), F.col("label").alias("label_a"))
    met = inner.join(outer, "band").where(F.col("label_a") != F.col("label_b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _block_links(placed: DataFrame, sets: _Sets, params: MinMaxParams) -> DataFrame:
    known = sets.of(placed.select("digest").distinct())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    drawn = lambda n, seed: F.pmod(F.xxhash64("digest", F.lit(seed)), F.col(n)).cast("int")
    parts = []
    for rows, i, j in (
        (placed.where(F.col("label") != F.col("top")), drawn("few", 1), every("many")),
        (placed, every("few"), drawn("many", 2)),
    ):
        part = rows.select("band", "digest", "label", i.alias("i"), j.alias("j"))
        part = part.join(known, "digest").select("band", "i", "j", "digest", "label", "shingles")
        parts.append(part.toDF(*[f"{c}_{len(parts)}" for c in part.columns]))
    outer, inner = parts
    percent = params.percent

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _links_of_blocks(_unpacked(left), _unpacked(right), percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    grouped = [part.groupBy(*part.columns[:3]) for part in (outer, inner)]
    return grouped[0].cogroup(grouped[1]).applyInArrow(meet, "a binary, b binary")


def _unpacked(part: pa.Table) -> tuple[list[bytes], list[bytes], list[np.ndarray]]:
    names, labels, sets = (part.column(i).combine_chunks() for i in (3, 4, 5))
    flat, ends = sets.flatten().to_numpy(zero_copy_only=False), np.cumsum([0] + [len(x) for x in sets])
    parts = [flat[a:b] for a, b in zip(ends, ends[1:])]
    return names.to_pylist(), labels.to_pylist(), parts


def _links_of_blocks(outer, inner, percent: int) -> list[tuple[bytes, bytes]]:
    """One linked pair for every outer member and other component, if there is one."""
    names, labels, sets = inner
    if not names or not outer[0]:
        return []
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    flat, owner = flat[order], owner[order]
    codes = {label: i for i, label in enumerate(dict.fromkeys(labels))}
    code = np.array([codes[x] for x in labels])
    found = []
    for name, label, own in zip(*outer):
        low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        hits = np.concatenate([owner[a:b] for a, b in zip(low, high) if a < b] or [owner[:0]])
        common = np.bincount(hits, minlength=len(sets))
        linked = (100 * common >= percent * (sizes + len(own) - common)) & (code != codes.get(label, -1))
        for place in {code[i]: i for i in np.flatnonzero(linked)}.values():
            found.append((name, names[place]))
    return found
