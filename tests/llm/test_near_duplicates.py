"""Min-max hashing and components against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm import minmax
from memlake.llm.components import connected_components
from memlake.llm.minmax import MinMaxParams, Signer, near_duplicates


def union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    draw = random.Random(seed)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(250)]
    pairs += [(1000, x) for x in range(1001, 1300)] + [(x, x + 1) for x in range(2000, 2100)] + [(5, 5), (7, None), (None, None)]
    found = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    want = union_find([(a, b) for a, b in pairs if a is not None and b is not None and a != b])
    assert {r["node"]: r["component"] for r in found} == want and len(found) == len(want)


def shingles(text, width):
    words = (text or "").encode().lower().split()
    count = min(width, len(words))
    return frozenset(tuple(words[i : i + count]) for i in range(len(words) - count + 1)) if count else frozenset()


def brute(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    pairs = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    named = union_find(pairs)
    return {i: (len(sets[i]), named.get(i, i)) for i in sets}


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows, base = [], [draw.choice(words) for _ in range(80)]
    for i in range(160):
        text = list(base) if i % 2 else [draw.choice(words) for _ in range(draw.randrange(0, 60))]
        for _ in range(draw.randrange(0, 9)):
            if text:
                text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((i, " ".join(text)))
    return rows + [(i + 500, t) for i, t in rows[:40]] + [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two")]


@pytest.mark.parametrize("width", [2, 5])
def test_against_brute_force(spark, width):
    rows = corpus(width)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), MinMaxParams(width=width)).collect()
    want = brute(rows, width)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_texts_by_join_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(minmax, "FILTER_BITS", 64)
    rows = corpus(4)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, 2)


def test_blocks_give_the_same_links(spark, monkeypatch):
    """Without star rounds and with tiny blocks every link comes from the block comparison."""
    monkeypatch.setattr(minmax, "FEW_OUTSIDE", 0)
    monkeypatch.setattr(minmax, "BLOCK_SHINGLES", 300)
    rows = corpus(9)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), MinMaxParams(star_rounds=1)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, 2)


def test_missing_and_repeated_ids(spark):
    same = "one two three four five six"
    rows = [(4, same), (4, same), (None, same), (None, "alone here"), (9, same)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in found) == [
        (-1, -1, True), (-1, 4, False), (4, 4, True), (4, 4, True), (9, 4, False)
    ]


def test_signatures_are_unbiased():
    """Minimum and maximum agree as often as the sets do."""
    draw = np.random.default_rng(3)
    signer, agreed = Signer(MinMaxParams(permutations=126)), []
    for _ in range(40):
        common = draw.integers(0, 2**63, 300).astype(np.uint64)
        rest = draw.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.concatenate([common, rest[:150]]), np.concatenate([common, rest[150:]])
        agreed.append((signer.values(a) == signer.values(b)).mean())
    assert abs(np.mean(agreed) - 0.5) < 0.02


def test_one_group_holds_a_third(spark):
    """A third of all rows are copies: they are one class and take no part in the pairs."""
    rows = [(i, "same words in every copy of this text" if i % 3 == 0 else f"text number {i} of {i * 7} and {i * 13}") for i in range(300)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.where("kept").count() == 201
    assert found.where(F.col("component_id") == 0).count() == 100
    assert defaultdict(int, found.groupBy("kept").count().collect())[False] == 99
