"""How much components and confirmation write and read again."""

from __future__ import annotations

from memlake import session
from memlake.llm.components import connected_components
from memlake.llm.minmax import MinMaxParams, _Sets, signatures
from pyspark.sql import functions as F


def test_stars_are_found_done_at_once(spark):
    """Stars around their smallest node need no round, and no round to see that nothing changes."""
    edges = spark.createDataFrame([(0, i) for i in range(1, 9)] + [(20, i) for i in range(21, 25)] + [(0, 1)], "a long, b long")
    before = len(session._made.get(spark.sparkContext.applicationId, []))
    found = connected_components(edges)
    assert len(session._made[spark.sparkContext.applicationId]) - before <= 2
    assert {r.node: r.component for r in found.collect()} == {**{i: 0 for i in range(9)}, **{i: 20 for i in range(20, 25)}}


def test_sets_made_earlier_are_picked_by_few_asked(spark):
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i}") for i in range(6)], "doc_id long, text string")
    params = MinMaxParams()
    classes = signatures(docs, params).select("doc_id", "digest", "key").cache()
    sets = _Sets(classes, docs, params)
    assert sets.of(classes.select("digest")).count() == 6
    asked = classes.where("doc_id = 3").select("digest")
    again = sets.of(asked)
    # Before, all sets made so far were joined, and shuffled, once more.
    assert [bytes(r.digest) for r in again.collect()] == [bytes(asked.first().digest)]
    assert again.select(F.size("shingles")).first()[0] == 3
    classes.unpersist()
