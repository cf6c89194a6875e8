"""Quads of blank nodes that are named close by do not move; those named far apart are joined, with the same results."""

import pytest
from pyspark.sql import functions as F

from quadrille.functions.terms import quads_of
from quadrille.operators import near
from quadrille.operators import transforms as X

QUADS = "\n".join(f"<http://x/a{i}#y> <http://x/p> _:b{i}\n_:b{i} <http://x/q> _:c{i}\n_:b{i} <http://x/r> \"{i}\"\n<http://x/z{i}> <http://x/p> <http://x/a{i}>" for i in range(20))
QUADS += '\n<http://x/again> <http://x/p> _:b3\n_:b0 <http://x/late> "v"\n<http://x/last> <http://x/p> _:none'


def _want() -> set:
    new = [f"http://x/a{i}#b{i}" for i in range(20)]
    out = {x for i in range(20) for x in ((f"http://x/a{i}#y", new[i]), (new[i], f"c{i}"), (new[i], str(i)), (f"http://x/z{i}", f"http://x/a{i}"))}
    return out | {("http://x/again", "b3"), (new[0], "v"), ("http://x/last", "http://x/last#none")}


@pytest.mark.parametrize("parts,block,stretch", [(1, 16_384, 1 << 22), (1, 4, 1 << 22), (1, 4, 10), (3, 16_384, 1 << 22)])
def test_blank_nodes_near_and_far(spark, monkeypatch, parts, block, stretch, tmp_path):
    quads_of(spark, QUADS).orderBy("seq").coalesce(1).write.parquet(str(tmp_path / "1"))
    df = spark.read.parquet(str(tmp_path / "1"))
    if parts > 1:
        df.repartition(parts).write.parquet(str(tmp_path / "n"))
        df = spark.read.parquet(str(tmp_path / "n"))
    seen, owned = [], near.owned
    monkeypatch.setattr(X, "owned", lambda *a: seen.append(owned(*a)) or seen[-1])
    # functions are sent to the workers with their module by value, so that these numbers go along
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(near)
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "STRETCH", stretch)
    try:
        out = X.BlankToFragment().apply(df)
        got = {(r.s.value, r.o.value) for r in out.collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(near)
    assert got == _want() and out.count() == 83 and out.columns == df.columns
    # a filter of the result takes no row away from those around
    assert out.where("p.value = 'http://x/r'").count() == 20
    far = seen[0][1].count()
    # _:b3 has two links; _:b0 is named at the end too, which is far for small blocks
    assert far == {16_384: 4, 4: 8}[block] if parts == 1 and stretch > 10 else far >= 8


def test_lines_do_not_move(spark):
    """Of the lifted lines only two that have the same keys are far, so that what is joined is a small table."""
    from conftest import SF_DIR
    from quadrille.sources.tables import lines

    df = X.BlankToNamed("^c", "http://ex.org/prices/").apply(lines(spark, SF_DIR))
    link = (F.col("s.kind") == "iri") & (F.col("o.kind") == "bnode")
    some, far = near.owned(df, F.when(F.col("s.kind") == "bnode", F.col("s.value")).when(link, F.col("o.value")), F.when(link, F.col("s.value")))
    assert some.count() + far.count() == df.count() and far.count() < 0.001 * df.count()


def test_unmapped_blank_nodes_are_errors(spark):
    """A subject without a link, or before it."""
    for text in ('_:a <http://x/p> "v"', '_:a <http://x/p> "v"\n<http://x/s> <http://x/p> _:a'):
        with pytest.raises(Exception, match="Unmapped blank node: a"):
            X.BlankToFragment().apply(quads_of(spark, text)).collect()
