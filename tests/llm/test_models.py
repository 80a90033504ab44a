"""Pieces against the library, languages against held-out labels, search against brute force, archives by reading back."""

import gzip
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from memlake.llm.common import remainder
from memlake.llm.mtree import MTreeParams, build_pages, search_pages, top_products, whole_vectors
from memlake.llm.piece_fst import MODEL_PATH, PieceModel, decode_ids, encode_texts
from memlake.llm.rank_profiles import Profiles, grams, identify, language_profiles, profile
from memlake.llm.url_filter import UrlRule, judge_urls
from memlake.llm.warc import derivatives, responses, write_warc

SF_DIR = "/root/testdata/sf0.001"
ALPHABET = "abcdefghij ▁  \n\t,.0123<>éß世界\u200b😀ABCthe ing"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)


@pytest.fixture(scope="module")
def model():
    with open(MODEL_PATH, "rb") as file:
        return PieceModel(file.read())


def test_pieces_equal_the_library(model, library):
    draw = random.Random(1)
    whole = [p.replace("▁", " ") for p in model.pieces[300:]]
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(draw.choice(whole) for _ in range(draw.randint(1, 6))) for _ in range(3000)] + ["", " ", "   ", " a", "a "]
    for text in texts:
        assert list(model.encode(text)) == library.encode(text), text
        assert model.decode(model.encode(text)) == library.decode(library.encode(text))


def test_documents_equal_the_library(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", F.lit(1).alias("ids"))
    found = encode_texts(docs)
    assert found.columns == ["doc_id", "ids", "n_ids", "round_trip"]
    rows = {r["doc_id"]: r for r in found.collect()}
    for r in docs.collect():
        assert rows[r["doc_id"]]["ids"] == library.encode(r["text"]) and rows[r["doc_id"]]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in decode_ids(found.select("doc_id", "ids")).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_pieces_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a▁b"), (4, "z" * 5000), (5, " \n")]
    found = {r["doc_id"]: r for r in encode_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["ids"] == [] and found[1]["round_trip"] and found[2]["n_ids"] == 0
    assert not found[3]["round_trip"] and found[4]["round_trip"] and found[5]["round_trip"]
    assert decode_ids(spark.createDataFrame([(None,)], "ids array<int>")).collect()[0]["text"] is None


@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_unigram_model(prefix, squeeze):
    """A hand-made unigram model: the path with the best sum of scores, as the library finds it."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("▁", -3, 1), ("a", -4, 1), ("b", -4.5, 1), ("ab", -6, 1), ("▁a", -5, 1), ("ba", -5.5, 1), ("▁ab", -9.75, 1), ("bab", -7, 1)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = prefix
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    proto.normalizer_spec.escape_whitespaces = True
    raw = proto.SerializeToString()
    ours, theirs, draw = PieceModel(raw), sentencepiece.SentencePieceProcessor(model_proto=raw), random.Random(2)
    for _ in range(1000):
        text = "".join(draw.choice("aab  bc") for _ in range(draw.randint(0, 12)))
        assert list(ours.encode(text)) == theirs.encode(text), text


def test_one_path_of_a_bpe_lattice_is_finite(model, library):
    """Of all ways to spell a word in pieces the acceptor leaves one, and it is the library's."""
    draw, index = random.Random(4), {p: i for p, i in model.ids.items()}

    def spellings(word, last=-1):
        if not word:
            yield ()
        for size in range(1, len(word) + 1):
            number = index.get(word[:size])
            if number is not None and model.weigh((last << 24) + number) < float("inf"):
                for rest in spellings(word[size:], number):
                    yield (number, *rest)

    for _ in range(300):
        text = "".join(draw.choice("aeinrst") for _ in range(draw.randint(1, 9)))
        assert list(spellings(model.normalise(text))) == [tuple(library.encode(text))]


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", remainder("doc_id", 4) == 2)
    profiles = language_profiles(docs.where("NOT held"))
    judged = identify(docs.where("held").select("doc_id", "lang", "text"), profiles).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in judged) / len(judged) > 0.98
    assert all(0 <= r["score"] <= 1 for r in judged)


def test_profiles():
    text = "Ab a"
    plain = sorted(grams(text).tolist())
    codes, none = [0, ord("a"), ord("b"), 0, ord("a"), 0], (1 << 21) - 1
    want = [(c << 42) | (none << 21) | none for c in codes if c]
    want += [(a << 42) | (b << 21) | none for a, b in zip(codes, codes[1:]) if a or b]
    want += [(a << 42) | (b << 21) | c for a, b, c in zip(codes, codes[1:], codes[2:]) if b]
    assert plain == sorted(want) and not len(grams("12 -"))
    best = profile(np.array([5, 3, 3, 9, 9, 1]), 3).tolist()
    assert best == [3, 9, 1]
    both = Profiles.of([("x", 3, 0), ("x", 9, 1), ("y", 9, 0)], 3)
    assert both.best("") == ("und", 0.0) and both.best(None) == ("und", 0.0) and Profiles.of([], 3).best("abc") == ("und", 0.0)


def test_ties_go_to_the_smaller_language(spark):
    docs = spark.createDataFrame([("abc", "b"), ("abc", "a"), (None, "c"), ("xyz", None)], "text string, lang string")
    profiles = language_profiles(docs)
    assert profiles.languages == ["a", "b"]
    assert [r["lang_pred"] for r in identify(docs, profiles).collect()] == ["a", "a", "und", "a"]


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_search(seed):
    draw = np.random.default_rng(seed)
    rows = draw.integers(-50, 50, (500, 6))
    rows[::7] = rows[0]
    ids = draw.permutation(500)
    pages = build_pages(ids, rows, rows[3], 16)
    assert sorted(i for p in pages for i in p.ids) == list(range(500))
    for q in range(0, 500, 25):
        scores = rows @ rows[q]
        want = sorted(((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[q]))[:5]
        assert search_pages(pages, rows[3], int(ids[q]), rows[q], 5, -(10**18)) == [(-s, i) for s, i in want]
        floor = -want[2][0]
        assert search_pages(pages, rows[3], int(ids[q]), rows[q], 5, floor) == [(-s, i) for s, i in want if -s >= floor]


@pytest.mark.parametrize("params", [MTreeParams(sample_rows=20, subtree_rows=50, page_rows=8, query_block=3), MTreeParams(sample_rows=3)])
def test_top_products(spark, params):
    draw = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(draw.normal(size=(300, 5)))]
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows] + [(None, rows[1][1]), (1, rows[2][1]), (777, [2.0**40] * 5)]
    data = whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    queries = data.where("vec_id % 50 = 0 OR vec_id = 777").withColumnRenamed("vec_id", "query_id")
    found = sorted(tuple(r) for r in top_products(data, queries, params).collect())
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None]
    want = []
    for q, v in whole:
        if q % 50 == 0 or q == 777:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    assert found == sorted(want)


def test_few_vectors(spark):
    data = spark.createDataFrame([(0, [1]), (1, [2, 3])], "vec_id long, v array<long>")
    queries = data.withColumnRenamed("vec_id", "query_id")
    assert sorted(tuple(r) for r in top_products(data, queries).collect()) == [(0, 1, 1, 2), (1, 1, 0, 2)]


def read_warc(data: bytes):
    """Records by their lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        assert version == "WARC/1.1"
        header = dict(line.split(": ", 1) for line in lines)
        size = int(header["Content-Length"])
        yield header, data[end + 4 : end + 4 + size]
        assert data[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
        at = end + 8 + size


def test_archive_reads_back(spark, tmp_path):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").unionByName(
        spark.createDataFrame([(-1, None, None), (-2, "http://a/b", ""), (-3, "x", "<p>\r\n\r\né</p>")], "page_id long, url string, html string")
    )
    made = derivatives(responses(pages, "2024-01-01T00:00:00Z"))
    write_warc(made, str(tmp_path / "out"))
    found = [r for f in (tmp_path / "out").glob("*.gz") for r in read_warc(gzip.decompress(f.read_bytes()))]
    want = {r["record_id"]: r for r in made.collect()}
    assert len(found) == len(want) == 2 * pages.count()
    for header, block in found:
        row = want[header["WARC-Record-ID"]]
        assert block.decode() == row["block"] and header["WARC-Refers-To"] == row["refers_to"]
        assert header.get("WARC-Target-URI") == row["target_uri"] and header["WARC-Block-Digest"] == row["block_digest"]
        if row["warc_type"] == "metadata":
            assert "source-header: Content-Type: text/html; charset=utf-8\r\n" in row["block"]


def test_null_headers(spark):
    rows = [(1, "u", "d", None, None, "<p>a</p>")]
    found = spark.createDataFrame(rows, "page_id long, target_uri string, warc_date string, status_line string, headers array<struct<name:string,value:string>>, html string")
    assert [r["block"] for r in derivatives(found).where("warc_type = 'conversion'").collect()] == ["a"]


def test_aliases_follow_given_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.net/1", None), (2, "http://b.net/2", None), (3, "http://c.net/3", None)], "page_id long, url string, html string")
    rules = [UrlRule("block", "b.net", "/"), UrlRule("allow", "c.net", "/3")]
    hop = [("http://a.net/1", "http://b.net/2"), (None, "x")]
    verdicts = lambda edges: [r["verdict"] for r in judge_urls(pages, rules, spark.createDataFrame(edges, "a string, b string")).orderBy("page_id").collect()]
    assert verdicts(hop) == ["block", "block", "allow"]
    assert verdicts([*hop, ("http://c.net/3", "http://a.net/1")]) == ["allow", "block", "allow"]
