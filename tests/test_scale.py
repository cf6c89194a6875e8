"""Plans that hold at any size."""

import pytest
from pyspark.sql import functions as F

from quadrille.functions.terms import quads_of


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_small_filters_have_small_rows(spark):
    """A filter of 256 bits is no bitmap of 4 KB while it is filled, and beyond ASCII it has the bits that whole bytes give."""
    from quadrille.operators.summaries import bloom_filters, bloom_positions

    rows = quads_of(spark, "ex:s ex:p ex:ö\nex:s ex:p ex:😀\nex:s ex:q \"l\"").withColumn("dataset", F.lit("ex:d"))
    assert "bitmap_construct_agg" not in plan_of(bloom_filters(rows, 256, 4))

    def want(members):
        out = bytearray(32)
        for m in members:
            hashes = []
            for h in (0x811C9DC5, 0x050C5D1F):
                for b in m.encode():
                    h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
                hashes.append(h)
            for i in range(4):
                at = (hashes[0] + i * hashes[1]) % 256
                out[at // 8] |= 1 << at % 8
        return bytes(out)

    got = {(r["family"], r["key"]): bytes(r["bitmap"]) for r in bloom_filters(rows, 256, 4, bloom_positions).collect()}
    assert got["projectedResource", "ex:s"] == want(["ex:p", "ex:q", "ex:ö", "ex:😀"])
    assert got["projectedProperty", "ex:p"] == want(["ex:s", "ex:ö", "ex:😀"])
    assert got["projectedProperty", "ex:q"] == want(["ex:s"])


@pytest.mark.parametrize("name", ["trf_blank_to_fragment", "str_resource_object", "trf_remap"])
def test_growing_tables_are_not_broadcast(spark, name):
    """Tables of few bytes, which Spark would broadcast, meet by merging, as large ones do whatever their files' size."""
    from conftest import SF_DIR
    from quadrille.queries import QUERIES

    plan = plan_of(QUERIES[name](spark, SF_DIR)).split("== Physical Plan ==")[1]
    assert "SortMergeJoin" in plan
    assert "BroadcastHashJoin" not in plan


def test_files_are_read_without_a_list(spark):
    """Files come by the sink's table, not as a folder that the driver lists and deals out four to a task."""
    from conftest import SF_DIR
    from quadrille.queries import QUERIES

    df = QUERIES["snk_files"](spark, SF_DIR)
    assert "FileScan text" not in plan_of(df) and "MapInArrow" in plan_of(df)
    assert df.rdd.getNumPartitions() < 20 < df.count()


def test_profiles_are_not_broadcast(spark, monkeypatch):
    """Of the type index's joins none broadcasts, and quads that tell no profile are in none."""
    from conftest import SF_DIR
    from quadrille.operators import transforms as X
    from quadrille.sources.tables import comments

    plans = []

    def seen(df, name):
        plans.append(plan_of(df).split("== Physical Plan ==")[1])
        return df

    monkeypatch.setattr(X, "materialize", seen)
    index = X.AppendSolidTypeIndex("vocabulary/Comment$", "vocabulary/hasCreator$", "settings/publicTypeIndex", "#comments", "comments/", True)
    whole = plan_of(index.apply(comments(spark, SF_DIR))).split("== Physical Plan ==")[1]
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0] + whole
    assert "Union" in whole


@pytest.mark.parametrize("name", ["trf_remap", "trf_varying"])
def test_quads_that_touch_no_resource_stay(spark, name, monkeypatch):
    """Of posts and lines only quads with a post as subject move, by a narrow key, and lie dealt: no exchange moves quads of blank nodes."""
    from conftest import SF_DIR
    from quadrille.operators import resources as R
    from quadrille.queries import QUERIES
    from quadrille.sources.tables import posts

    seen, dealt = [], R.dealt

    def kept(df, *args):
        seen.append(df)
        return dealt(df, *args)

    monkeypatch.setattr(R, "dealt", kept)
    plan = plan_of(QUERIES[name](spark, SF_DIR)).split("== Physical Plan ==")[1]
    moved, lines = seen[0], spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    own = posts(spark, SF_DIR).count() + lines
    # a sieve may take a few others for resources
    assert own <= moved.count() < own + 0.2 * lines
    assert moved.where("s.kind = 'bnode' and o.kind <> 'iri'").isEmpty()
    assert "Bucketed: true" in plan


def test_sieve(spark):
    """It passes all that it was made of and few others, and does not pass null."""
    from quadrille.plans.storage import sieve

    ids = spark.range(1000).select(F.concat(F.lit("ex:"), F.col("id")).alias("iri"))
    passes = sieve(ids, "iri")
    assert ids.where(passes(F.col("iri"))).count() == 1000
    assert spark.range(1000, 2000).where(passes(F.concat(F.lit("ex:"), F.col("id")))).count() < 150
    assert spark.range(1).select(passes(F.lit(None).cast("string")).alias("x")).first()["x"] is None
    assert spark.range(9).where(sieve(ids.where("false"), "iri")(F.lit("ex:1"))).isEmpty()


def test_objects_are_renamed_wherever_their_quads_lie(spark):
    """Quads with a resource as subject, as object and as both, and quads with neither."""
    from quadrille.operators.transforms import RemapResourceIdentifier

    text = """ex:r a ex:Post\nex:r ex:id "1"\nex:r ex:by ex:u\nex:q a ex:Post\nex:q ex:id "2"\nex:q ex:by ex:u\nex:q ex:like ex:r\n_:b ex:like ex:r\nex:x ex:like _:b\nex:r ex:has _:b"""
    out = RemapResourceIdentifier("#", "Post$", "ex:id$", "ex:by$").apply(quads_of(spark, text))
    got = sorted((r.s.value, r.p.value, r.o.value) for r in out.where("p.value in ('ex:like', 'ex:has')").collect())
    assert got == [("b", "ex:like", "ex:u#1"), ("ex:u#1", "ex:has", "b"), ("ex:u#2", "ex:like", "ex:u#1"), ("ex:x", "ex:like", "b")]
    assert out.columns == ["seq", "s", "p", "o", "g"] and out.count() == 10


def test_quads_between_two_variants_go_through_both(spark):
    """A quad whose subject and object belong to different transformers is renamed by each; others are not doubled."""
    from quadrille.operators.transforms import RemapResourceIdentifier, VaryingResource

    text = """ex:r a ex:Post\nex:r ex:id "1"\nex:r ex:by ex:a\nex:q a ex:Post\nex:q ex:id "2"\nex:q ex:by ex:b\nex:q ex:like ex:r\nex:r ex:like ex:q\n_:b ex:like ex:r\n_:b ex:like _:c"""
    each = [RemapResourceIdentifier(x, "Post$", "ex:id$", "ex:by$") for x in ("#A", "#B")]
    out = VaryingResource("Post$", "ex:by$", each).apply(quads_of(spark, text))
    assert out.columns == ["seq", "s", "p", "o", "g"] and out.count() == 10
    got = sorted((r.s.value, r.o.value) for r in out.where("p.value = 'ex:like'").collect())
    assert got == [("b", "c"), ("b", "ex:a#A1"), ("ex:a#A1", "ex:b#B2"), ("ex:b#B2", "ex:a#A1")]


def test_quads_that_tell_of_resources_are_sought_once(spark, monkeypatch):
    """Of all quads those that tell a type, an identifier or a target are written once; what is found reads them alone."""
    from conftest import SF_DIR
    from quadrille.operators import resources as R
    from quadrille.sources.tables import lines, posts

    seen, write = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda *a, **b: seen.append(write(*a, **b)) or seen[-1])
    n, df = posts(spark, SF_DIR).count() // 4, posts(spark, SF_DIR).unionByName(lines(spark, SF_DIR))
    found = R.resources(df, "Post$", "hasCreator$", "vocabulary/id$")
    assert seen[0].count() == 3 * n and found.where("done is not null").count() == n
    assert "lineitem" not in plan_of(found) and "orders" not in plan_of(found)
