"""Context-tree weighting against a direct recursion."""

import math
from collections import defaultdict

import pytest

from memlake.llm import ctw
from memlake.llm.ctw import END, log_gamma, pack_places, pieces, score_texts, unpack_places


def spelled(text):
    words = (text or "").encode().lower().split()
    return b"".join(w + b" " for w in words) + END


def brute(rows, depth):
    """Scores by a tree of dictionaries; rows are (doc_id, text, held_out)."""
    counts = defaultdict(lambda: [0, 0])
    for _, text, held in rows:
        if held is False:
            for node, bit in steps(spelled(text), depth):
                for d in range(depth + 1):
                    counts[node[0][len(node[0]) - d :], node[1]][bit] += 1

    def pe(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(sum(n) + 1)

    def pw(context, step):
        n = counts.get((context, step), [0, 0])
        if len(context) == depth:
            return pe(n)
        below = sum(pw(key, s) for key, s in kids[context, step])
        return math.log(0.5) + max(pe(n), below) + math.log1p(math.exp(-abs(pe(n) - below)))

    kids = defaultdict(set)
    for context, step in list(counts):
        if context:
            kids[context[1:], step].add((context, step))
    known = {}

    def one(context, step, d):
        own = context[depth - d :]
        n = counts.get((own, step), [0, 0])
        kt = (n[1] + 0.5) / (sum(n) + 1)
        if d == depth:
            return kt
        if (own, step) not in known:
            known[own, step] = math.exp(math.log(0.5) + pe(n) - pw(own, step))
        q = known[own, step]
        return q * kt + (1 - q) * one(context, step, d + 1)

    out = {}
    for doc_id, text, _ in rows:
        total = 0.0
        for (context, step), bit in steps(spelled(text), depth):
            p = one(context, step, 0)
            total += math.log10(p if bit else 1 - p)
        out[doc_id] = total
    return out


def steps(data, depth):
    data = b"\x00" * depth + data
    for i in range(depth, len(data)):
        node = 1
        for k in range(7, -1, -1):
            bit = data[i] >> k & 1
            yield (data[i - depth : i], node), bit
            node = node << 1 | bit


ROWS = [
    (1, "The cat sat on the mat.", False),
    (2, "the  cat\tate", False),
    (3, "the dog sat", True),
    (4, None, True),
    (5, "", False),
    (6, "zebra ÉCLAIR über", True),
    (7, "the cat sat on the mat. the cat sat on the mat.", None),
    (8, "the dog sat", False),
]
SCHEMA = "doc_id long, text string, held_out boolean"


@pytest.mark.parametrize("depth", [0, 2, 4])
def test_scores(spark, depth):
    found = {r["doc_id"]: r for r in score_texts(spark.createDataFrame(ROWS, SCHEMA), depth).collect()}
    want = brute(ROWS, depth)
    assert all(abs(found[i]["score"] - want[i]) < 1e-6 for i in want)
    assert all(abs(r["bits_per_byte"] * r["n_bytes"] + r["score"] * math.log2(10)) < 1e-6 for r in found.values())


def test_base_score(spark):
    found = {r["doc_id"]: r for r in score_texts(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    count, total = defaultdict(int), 0
    for _, text, held in ROWS:
        if held is False:
            for token in [*(text or "").lower().split(), END]:
                count[token] += 1
                total += 1
    for doc_id, text, held in ROWS:
        tokens = [*(text or "").lower().split(), END]
        want = sum(math.log10((count.get(t, 0) + 0.1) / (total + 0.1 * (len(count) + 1))) for t in tokens)
        row = found[doc_id]
        assert abs(row["base_score"] - want) < 1e-9 and row["n_tokens"] == len(tokens) and row["train_tokens"] == total
        assert row["n_known"] == sum(t in count for t in tokens) and row["held_out"] == (held is not False)


def test_parts_and_pieces_change_nothing(spark, monkeypatch):
    """Small pieces, blocks and broadcasts give the same scores."""
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(40)), i % 3 == 0) for i in range(30)] + [(99, "x" * 500 + " y", True)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {r["doc_id"]: r for r in score_texts(docs).collect()}
    parts = ctw.run_sums

    def in_parts(docs, scores, depth):
        monkeypatch.setattr(ctw, "BROADCAST_RUNS", 100)
        return parts(docs, scores, depth)

    monkeypatch.setattr(ctw, "run_sums", in_parts)
    for r in score_texts(docs).collect():
        assert abs(r["score"] - want[r["doc_id"]]["score"]) < 1e-9 and abs(r["base_score"] - want[r["doc_id"]]["base_score"]) < 1e-9


def test_nothing_to_learn_from(spark):
    rows = [(1, "ab", True), (2, None, None)]
    found = {r["doc_id"]: r for r in score_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert abs(found[1]["score"] - 4 * 8 * math.log10(0.5)) < 1e-9 and abs(found[2]["score"] - 8 * math.log10(0.5)) < 1e-9
    assert found[1]["train_tokens"] == 0 and found[1]["n_known"] == 0


def test_repeated_rows(spark):
    rows = [(1, "a b", False), (1, "a b", False), (None, "a b", True)]
    found = score_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 3 and len({round(r["score"], 9) for r in found}) == 1


def test_pieces():
    text = b"ab " * 40_000
    assert b" ".join(pieces(text)) in (text, text[:-1]) and all(len(p) < 50_000 for p in pieces(text))
    assert list(pieces(b"")) == [b""] and list(pieces(b"x" * 100_000)) == [b"x" * 100_000]


def test_places_round_trip():
    import numpy as np

    lengths, segments, times = np.array([2, 0, 3]), np.array([1, 60_000, 0, 5, 6]), np.array([1, 9, 60_000, 1, 2])
    a, b, c = unpack_places(pack_places(lengths, segments, times), 3)
    assert a.tolist() == lengths.tolist() and b.tolist() == segments.tolist() and c.tolist() == times.tolist()


def test_log_gamma(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 2.5, 10.0, 1234.5, 1e9)], "x double")
    assert all(abs(r["y"] - math.lgamma(r["x"])) < 1e-9 * max(1, abs(r["y"])) for r in rows.withColumn("y", log_gamma(F.col("x"))).collect())
