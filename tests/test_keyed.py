"""Quads of blank nodes that are named within a few rows do not move; counts and pairs by slices are whole."""

import pytest
from pyspark.sql import functions as F

from quadrille.functions.terms import quads_of
from quadrille.operators import closure, summaries
from quadrille.operators.strategies import ByVoID
from quadrille.plans import storage

QUADS = """
<http://x/a1> <http://x/p> _:one
_:one <http://x/q> _:two
_:two <http://x/q> "v"
_:two <http://x/q> "w"
_:two <http://x/r> "w"
<http://x/a2> <http://x/p> _:both
<http://x/b1> <http://x/p> _:both
_:both <http://x/q> _:under
_:under <http://x/q> "v"
_:c1 <http://x/q> _:c2
_:c2 <http://x/q> _:c1
<http://x/b1> <http://x/p> _:c1
_:d1 <http://x/q> _:d2
_:d2 <http://x/q> _:d1
<http://y/none> <http://x/p> _:lost
_:lost <http://x/q> "v"
"""


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_keyed_counts_what_whole_groups_count(spark, monkeypatch, batch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, rounds = spark.conf.get(name), []
    follow = closure.owners
    monkeypatch.setattr(closure, "owners", lambda links, edges: rounds.append(edges.count()) or follow(links, edges))
    monkeypatch.setattr(storage, "SLICE", 8)
    try:
        spark.conf.set(name, batch)
        grouped = ByVoID([r"^(http://x/[a-z])[0-9]"]).grouped(quads_of(spark, QUADS).coalesce(1))
        got = {(r["dataset"], r["triples"], r["subjects"], r["objects"], r["properties"], r["classes"]) for r in summaries.void_counts(grouped)[0].collect()}
        by = {(r["dataset"], r["property"][-1], r["triples"], r["subjects"], r["objects"]) for r in summaries.void_counts(grouped)[1].where(F.col("dataset") == "http://x/a").collect()}
    finally:
        spark.conf.set(name, before)
    a1, a2, b = (5, 3, 4, 3, 0), (3, 3, 3, 2, 0), (6, 5, 5, 2, 0)
    # _:one and _:two, _:both and _:under; _:c1 and _:c2 with b alone; _:d1, _:d2 and _:lost with none
    assert got == {("http://x/a1", *a1), ("http://x/a2", *a2), ("http://x/b1", *b), ("http://x/b", *b), ("http://x/a", 8, 6, 6, 3, 0)}
    assert by == {("http://x/a", "p", 2, 2, 2), ("http://x/a", "q", 5, 4, 4), ("http://x/a", "r", 1, 1, 1)}
    # in one batch only what several link to and cycles are followed
    assert batch == "2" or rounds == [5]


def test_pairs_move_once_for_both_directions(spark):
    """Pairs are those of the plain way, where terms are equal or stand in several positions too, and fewer rows meet."""
    text = "<x:a> <x:p> <x:b>\n<x:b> <x:p> <x:a>\n<x:a> <x:p> <x:a>\n<x:p> <x:p> <x:c>\n<x:a> <x:z> <x:p>\n<x:z> <x:a> \"l\"\n<x:p> <x:p> <x:p>"
    rows = quads_of(spark, text).select(F.explode(F.array(F.lit("d1"), F.lit("d2"))).alias("dataset"), "s", "p", "o")
    got = summaries.bloom_pairs(rows)
    want = summaries._pairs(rows).distinct()
    assert sorted(got.collect()) == sorted(want.collect()) and got.columns == want.columns
    assert "bit_or" in got._jdf.queryExecution().toString()
