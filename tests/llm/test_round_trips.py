"""Clusters, filter orders and coded ids against plain versions."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memlake.llm import huffman
from memlake.llm.huffman import Code, HuffmanParams, code_lengths, combined_crc32, pack, stored_ids, token_ids, unpack, write_ids
from memlake.llm.simplex import LARGEST, BaseSimplex, SimplexParams, bounds, cluster_vectors, nearest, squares
from memlake.llm.survival import audit_filters, failed_alone, positional_popcount, survival_words
from memlake.session import durable, fresh_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SMALL = HuffmanParams(block_ids=64, checkpoint_ids=8, slice_ids=500)


# --- clusters ----------------------------------------------------------------------


def plain_clusters(vectors, count, rounds):
    """vec_id -> (cluster, distance), centroids; vectors are (vec_id, list)."""
    start = sorted(vectors, key=lambda x: (hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1]))
    centroids = [list(v) for _, v in start[:count]]

    def assign():
        apart = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in vectors]
        return [(min(range(len(centroids)), key=lambda i: (d[i], i)), min(d)) for d in apart]

    for _ in range(rounds):
        owners = assign()
        for i in range(len(centroids)):
            own = [v for (_, v), (c, _) in zip(vectors, owners) if c == i]
            if own:
                centroids[i] = [sum(x) // len(own) for x in zip(*own)]
    return [(vec_id, *a) for (vec_id, _), a in zip(vectors, assign())], centroids


def vector_frame(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, v array<long>")


@pytest.mark.parametrize("spread", [1, 40])
def test_clusters_equal_plain_ones(spark, spread):
    draw = random.Random(spread)
    vectors = [(i, [draw.randint(-spread, spread) for _ in range(5)]) for i in range(300)]
    vectors += [(300 + i, vectors[7][1]) for i in range(60)] + vectors[:3]
    found = cluster_vectors(vector_frame(spark, vectors), SimplexParams(clusters=9, rounds=4, width=5, pivots=4))
    expected, centroids = plain_clusters(vectors, 9, 4)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()) == sorted(expected)
    row = found.where("vec_id = 7").first()
    own = [d for _, c, d in expected if c == row["cluster"]]
    assert row["cluster_inertia"] == sum(own) and row["inertia"] == sum(d for _, _, d in expected)
    text = ",".join(map(str, centroids[row["cluster"]]))
    assert row["centroid_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_clusters_of_odd_tables(spark):
    params = SimplexParams(clusters=3, rounds=2, width=2, pivots=3)
    odd = [(None, [1, 1]), (1, None), (2, [1]), (3, [5, 5]), (3, [5, 5]), (4, [-5, 5])]
    found = cluster_vectors(vector_frame(spark, odd).withColumn("cluster", F.lit("x")), params).collect()
    # Of two equal centroids the first takes the rows near them and moves away; the second then fits the row they began with.
    assert sorted((r["vec_id"] or 0, r["distance"]) for r in found) == [(0, 0), (3, 0), (3, 0), (4, 0)]
    assert cluster_vectors(vector_frame(spark, [(None, [1, 1])]), params).collect() == []
    assert cluster_vectors(vector_frame(spark, []), params).collect() == []
    assert {r["cluster"] for r in cluster_vectors(vector_frame(spark, [(i, [7, 7]) for i in range(9)]), params).collect()} == {0}
    with pytest.raises(ValueError, match="whole numbers"):
        cluster_vectors(vector_frame(spark, [(1, [LARGEST + 1, 0])]), params)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 50, LARGEST]))
def test_simplex_bounds_hold(seed, size):
    draw = np.random.default_rng(seed)
    rows, centres = draw.integers(-size, size + 1, (30, 6)), draw.integers(-size, size + 1, (12, 6))
    # Pivots in one plane, or repeated, make no corner of their own.
    centres[6] = centres[0]
    base = BaseSimplex.of(centres, 8)
    lower, upper = bounds(base.apexes(rows), base.apexes(centres))
    exact = squares(rows, centres)
    assert (lower <= exact).all() and (exact <= upper).all() and len(base.pivots) <= 7
    found = nearest(rows, base.apexes(rows), centres, base.apexes(centres), True)
    apart = ((rows[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (found[0] == apart.argmin(axis=1)).all() and (found[1] == apart.min(axis=1)).all()


def test_bounds_spare_distances():
    """Rows of 8 dimensions among 64 need 9 pivots; rows that fill all dimensions nearly as many as these."""
    draw = np.random.default_rng(3)
    flat = draw.integers(-40, 41, (3000, 8)) @ draw.integers(-3, 4, (8, 64))
    full = draw.integers(-150, 151, (3000, 64))
    for rows, pivots, most in ((flat, 9, 1.1), (full, 60, 15)):
        centres = np.array([rows[i::40].mean(axis=0) for i in range(40)]).astype(np.int64) if pivots == 60 else rows[:40]
        base = BaseSimplex.of(rows[:512], 60)
        cluster, _, computed = nearest(rows, base.apexes(rows), centres, base.apexes(centres), True)
        assert len(base.pivots) == pivots and computed < most * len(rows)
        assert (cluster == squares(rows, centres).argmin(axis=1)).all()


# --- filter orders --------------------------------------------------------------------


def plain_audit(docs, labels):
    """The rows of the audit, filter by filter."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    judged = []
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and i > smallest[text],
        }
        judged.append((lang or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    rows = {}
    for part in {p for p, *_ in judged}:
        own = [x[1:] for x in judged if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, kept = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                failing = sum(f in x[0] for x in own)
                only = sum(x[0] == {f} for x in own)
                rows[part, "".join(order), step] = [
                    len(kept), len(gone), failing - len(gone), only, sum(x[1] for x in gone), sum(x[2] for x in gone)
                ]
                left = kept
    for part in {p for p, *_ in judged}:
        for f in "ABCDE":
            own = [key for key in rows if key[0] == part and key[1][key[2] - 1] == f]
            total = sum(rows[key][1] for key in own)
            for key in own:
                rows[key].append(total)
    return sorted((*key, *values) for key, values in rows.items())


def test_audit_equals_plain_one(spark):
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["AB", "ÄÖ", "x#", " ", "\x1c", "\u0085"]
    texts = [None, "", " \t", "A", "word " * 150, " ".join(f"u{i}" for i in range(20_000))]
    texts += [" ".join(draw.choices(vocabulary, k=draw.choice([5, 99, 100, 130, 300]))) for _ in range(60)]
    docs = [(draw.choice([None, *range(90)]), draw.choice(texts), draw.choice(["en", "de", None, ""])) for _ in range(400)]
    docs += [(1000 + i, "one text of a large part", "en") for i in range(300)] + [(None, "", "en")] * 5 + [(3, "A", "fr")] * 4
    labels = [(draw.choice([None, *range(1100)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit(1)).withColumn("salt", F.lit("s"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(2))
    found = audit_filters(frame.repartition(5), marks)
    assert sorted(tuple(r) for r in found.collect()) == plain_audit(docs, labels)
    assert audit_filters(frame.limit(0), marks).collect() == []


def test_limits_of_filters():
    words = [b"w%d" % i for i in range(100)]
    assert failed_alone(b" ".join(words)) == 0
    assert failed_alone(b" ".join(words[:99])) == 1
    assert failed_alone(b" ".join(words[:80] + words[:20])) == 0
    assert failed_alone(b" ".join(words[:79] + words[:21])) == 2
    assert failed_alone(b"\x0b ".join(words) + b"|") == 8
    # A tenth of the code points, not of the bytes.
    assert failed_alone("Aéééééééééé".encode()) == 1 and failed_alone("Aéééééééé".encode()) == 5


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_popcount(words):
    expected = [sum(word >> i & 1 for word in words) for i in range(32)]
    assert positional_popcount(np.array(words, np.uint32)).tolist() == expected


def test_words():
    found = survival_words(np.array([0, 31, 5]))
    assert found.tolist() == [2**32 - 1, 1, sum(1 << s for s in range(32) if not s & 5)]


# --- coded ids ----------------------------------------------------------------------------


def least_cost(counts, most):
    """The cheapest sorted lengths with a Kraft sum of at most 1, by trying all."""
    ordered = sorted(counts, reverse=True)
    choices = itertools.combinations_with_replacement(range(1, most + 1), len(counts))
    return min(sum(c * n for c, n in zip(ordered, lengths)) for lengths in choices if sum(2.0**-n for n in lengths) <= 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=2, max_size=7), st.integers(3, 5))
def test_lengths_are_the_cheapest(counts, most):
    lengths = code_lengths(np.array(counts), most)
    assert lengths.max() <= most and sum(2.0 ** -lengths) <= 1
    assert int((lengths * counts).sum()) == least_cost(counts, most)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400), st.integers(1, 70), st.sampled_from([1, 10**7]))
def test_blocks_round_trip(values, distance, step):
    ids = np.array(values, "<u4") * np.uint32(step)
    symbols, counts = np.unique(ids, return_counts=True)
    code = Code.of(symbols, code_lengths(counts, 12))
    payload, bits, checkpoints = pack(ids, code, distance)
    assert len(payload) == -(-bits // 8) and bits == code.lengths[np.searchsorted(code.ids, ids)].sum()
    assert (unpack(payload, len(ids), checkpoints, distance, code.table()) == ids).all()
    # Canonical: codes ascend with (length, id), and no code begins another.
    order = np.lexsort((code.ids, code.lengths))
    texts = [format(code.codes[i], f"0{code.lengths[i]}b") for i in order]
    assert texts == sorted(texts) and not any(b.startswith(a) for a, b in zip(texts, texts[1:]))


def test_large_counts_and_limits():
    counts = 2 ** np.arange(62, dtype=np.int64)[::-1]
    lengths = code_lengths(counts, 7)
    assert lengths.max() == 7 and sum(2.0 ** -lengths) <= 1 and (np.diff(lengths) >= 0).all()
    for n, bits in ((9, 3), (4, 26)):
        with pytest.raises(ValueError):
            code_lengths(np.ones(n, np.int64), bits)


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=200), st.binary(max_size=200))
def test_joined_checksums(a, b):
    assert combined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def plain_ids(rows):
    """(doc_id, start, n_tokens, ids_crc32), missing ids first, equal ones by length and checksum."""
    model = Tokenizer.from_file(TOKENIZER)
    made = []
    for doc_id, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        made.append((doc_id is not None, doc_id or 0, len(ids), zlib.crc32(ids.tobytes())))
    out, start = [], 0
    for named, doc_id, n, crc in sorted(made):
        out.append((doc_id if named else None, start, n, crc))
        start += n
    return out


TEXTS = [None, "", " \n", "A quick brown fox", "naïve ＡＢＣ 数据 🙂", "<|endoftext|> a", "it's " * 400, "x" * 3000, " ".join(f"word{i}" for i in range(900))]


ODD = "ab Zé\u0308 \u0301ΣΑΣ's ’s \u00a0\u2028\u3000\x1c\x85\u180e\u200b\ufeff 12３ 数据🙂\t\n\r\x0b\x0c\x00<|startoftext|>İſ!?--_"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(list(ODD)), st.sampled_from(["<|endoftext|>", "'ll", "ΣΣ", "e\u0301"]), st.characters(codec="utf-8")), max_size=40))
def test_ids_of_words_are_those_of_the_text(parts):
    text = "".join(parts)
    if not hasattr(test_ids_of_words_are_those_of_the_text, "model"):
        test_ids_of_words_are_those_of_the_text.model = Tokenizer.from_file(TOKENIZER)
    model = test_ids_of_words_are_those_of_the_text.model
    assert huffman.WordIds(model)(pa.array([text, text + " " + text]))[1].tolist() == model.encode(text + " " + text, add_special_tokens=False).ids


def test_ids_of_given_texts():
    """Whole texts of the given tables, and a memory that overflows."""
    model = Tokenizer.from_file(TOKENIZER)
    words = huffman.WordIds(model)
    table = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["text"]).column("text").to_pylist()[:200]
    expected = [e.ids for e in model.encode_batch_fast(table, add_special_tokens=False)]
    assert [x.tolist() for x in words(pa.array(table))] == expected
    words.known = {str(i) + " ": b"" for i in range(huffman.WORDS_KEPT + 1)}
    for _ in range(3):
        assert [x.tolist() for x in words(pa.array(table))] == expected and len(words.known) < huffman.WORDS_KEPT


def test_stored_ids_equal_plain_ones(spark):
    rows = [(i * 7 % 50 - 3, text) for i, text in enumerate(TEXTS * 5)] + [(None, "b"), (None, "a b"), (None, None), (4, "again"), (4, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("r")).withColumn("ids", F.lit(1))
    path = fresh_path(spark, "huffman-test")
    found = stored_ids(docs.repartition(6), TOKENIZER, path=path, params=SMALL)
    key = lambda r: (r[1], r[2])
    assert sorted((tuple(r) for r in found.collect()), key=key) == plain_ids(rows)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.agg(F.max("n_ids")).first()[0] == 64
    assert blocks.select("slice").distinct().count() > 3
    assert blocks.where(F.size("checkpoints") != F.ceil(F.col("n_ids") / 8)).count() == 0


def test_ids_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert stored_ids(docs, TOKENIZER).collect() == []


def test_one_document_over_many_slices_of_copies(spark):
    """A third of the rows has one id; ranges stay even."""
    rows = [(5, f"copy {i % 4}") for i in range(300)] + [(i, f"doc {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = fresh_path(spark, "huffman-test")
    tokens = durable(token_ids(docs, TOKENIZER, 1), "tokens")
    write_ids(tokens, path, HuffmanParams(block_ids=64, checkpoint_ids=8, slice_ids=300))
    sizes = [r["n"] for r in spark.read.parquet(f"{path}/blocks").groupBy("slice").agg(F.sum("n_ids").alias("n")).collect()]
    assert max(sizes) < 0.4 * sum(sizes)
    assert sorted((tuple(r) for r in huffman.read_documents(spark, path).collect()), key=lambda r: r[1]) == plain_ids(rows)



def test_unknown_words_are_encoded_together():
    """A text goes to the library per ``WORDS_AT_ONCE`` unknown words, not per word; words that hold the mark go alone."""
    model = Tokenizer.from_file(TOKENIZER)
    plain = [f"wörd{i}'s" for i in range(2 * huffman.WORDS_AT_ONCE)]
    given = []

    class Counted:
        def encode(self, *args, **kinds):
            return model.encode(*args, **kinds)

        def encode_batch_fast(self, texts, **kinds):
            given.extend(texts)
            return model.encode_batch_fast(texts, **kinds)

    # An empty text is one more word.
    for words, texts in ((plain[1:], 2), ([*plain[:5], "a\x01b", "\x01", "x" * 300], 9), (["y" * huffman.MARKED_CHARS, "z"], 3), ([], 1)):
        given.clear()
        found = huffman.WordIds(Counted())(pa.array([" ".join(words), ""], pa.string()))
        assert [x.tolist() for x in found] == [model.encode(" ".join(words), add_special_tokens=False).ids, []]
        assert len(given) == texts
