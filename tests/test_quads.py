"""Operators on small quads, as multisets of strings."""

from collections import Counter

import pytest

from quadrille.functions.terms import quads_of, term_to_string
from quadrille.operators import matchers as M
from quadrille.operators import strategies as S
from quadrille.operators import templates as T
from quadrille.operators import transforms as X


def shown(df, *extra):
    rows = df.select(*extra, *[term_to_string(c).alias(c) for c in "spo"]).collect()
    return Counter(tuple(r) for r in rows)


def quads(*rows):
    return Counter(rows)


def docs(spark, strategy, text):
    return Counter(r[0] for r in strategy.assign(quads_of(spark, text)).select("doc").collect())


SUBJECT = {
    "no blank nodes": ("ex:s1 ex:p ex:o\nex:s1 ex:p ex:o\nex:s2 ex:p ex:o", {"ex:s1": 2, "ex:s2": 1}),
    "variables": ("?s1 ex:p ex:o", {}),
    "owned": ("ex:s1 ex:p _:b1\n_:b1 ex:p ex:o", {"ex:s1": 2}),
    "owned, reverse": ("_:b1 ex:p ex:o\nex:s1 ex:p _:b1", {"ex:s1": 2}),
    "chain, reverse": ("_:b3 ex:p ex:o\n_:b2 ex:p _:b3\n_:b1 ex:p _:b2\nex:s1 ex:p _:b1", {"ex:s1": 4}),
    "several documents": ("ex:s1 ex:p _:b1\nex:s2 ex:p _:b1\n_:b1 ex:p ex:o", {"ex:s1": 2, "ex:s2": 2}),
    "unowned": ("ex:s1 ex:p _:b1\n_:b2 ex:p ex:o", {"ex:s1": 1}),
    # of the set formulation: late owners own, a second link does not double, cycles end
    "late owner": ("ex:s1 ex:p _:b1\n_:b1 ex:p ex:o\nex:s2 ex:p _:b1", {"ex:s1": 2, "ex:s2": 2}),
    "linked twice": ("ex:s1 ex:p _:b1\nex:s1 ex:q _:b1\n_:b1 ex:p ex:o", {"ex:s1": 3}),
    "cycle": ("ex:s1 ex:p _:b1\n_:b1 ex:p _:b2\n_:b2 ex:p _:b1\n_:b1 ex:p _:b1", {"ex:s1": 4}),
}


@pytest.mark.parametrize("name", SUBJECT)
def test_by_subject(spark, name):
    text, expected = SUBJECT[name]
    assert docs(spark, S.BySubject(), text) == expected


def test_by_subject_relative_path(spark):
    assert docs(spark, S.BySubject(relative_path="interests"), "ex:s1/ ex:p ex:o\nex:s2 ex:p ex:o") == {"ex:s1/interests": 1, "ex:s2/interests": 1}


def test_by_object(spark):
    text = '_:b1 ex:p ex:o1\n_:b2 ex:p _:b1\nex:s ex:p _:b2\nex:s ex:p "x"'
    assert docs(spark, S.ByObject(), text) == {"ex:o1": 3}


def test_by_resource_object(spark):
    s = S.ByResourceObject("T$")
    assert docs(spark, s, "ex:s1 ex:T ex:o\nex:s1 ex:p2 ex:o\nex:s1 ex:p3 ex:o\nex:s1 ex:T ex:ox\nex:s2 ex:p ex:o") == {"ex:o": 4}
    assert docs(spark, s, "ex:s1 ex:p ex:o\nex:s1 ex:T ex:a\nex:s1 ex:T ex:b\nex:s1 ex:p ex:c") == {"ex:a": 3, "ex:b": 1}
    with pytest.raises(Exception, match="Expected a named node"):
        docs(spark, s, 'ex:s1 ex:T "x"')


def test_exception_and_composite(spark):
    entries = [S.ExceptionEntry(M.TermValueMatcher("subject", "s2$"), S.Constant("A")), S.ExceptionEntry(M.TermValueMatcher("subject", "s[23]$"), S.Constant("B"))]
    text = "ex:s1 ex:p1 ex:o1\nex:s2 ex:p2 ex:o2\nex:s3 ex:p3 ex:o3"
    assert docs(spark, S.ByException(S.BySubject(), entries), text) == {"ex:s1": 1, "A": 1, "B": 1}
    assert docs(spark, S.Composite([S.Constant("x")] * 3), text) == {"x": 9}
    assert docs(spark, S.Composite([]), text) == {}


def test_matchers(spark):
    df = quads_of(spark, "ex:s1 ex:p ex:early\nex:s1 a ex:Person\nex:s1 ex:p ex:late\n_:b a ex:Person\nex:s2 a ex:Other")
    assert M.ResourceTypeMatcher("Person$").keep(df).count() == 1
    assert M.ResourceTypeMatcher("Person$", True).keep(df).count() == 2
    assert M.ResourceTypeMatcher("Person$", True, strict=False).keep(df).count() == 3
    assert M.TermValueMatcher("object", "(Per)?son$|Other$", 0.0).keep(df).count() == 0
    assert M.TermValueMatcher("object", "Person$", 1.0).keep(df).count() == 2


def test_rewriting(spark):
    one = quads_of(spark, 'http://archive.test/files/card7201 ex:p "http://archive.test/files/card7201"')
    pods = X.ReplaceIri("^http://archive.test/files/card([0-9]*)$", "http://archive.test/shelves/$1/label#it")
    assert shown(pods.apply(one)) == quads(("http://archive.test/shelves/7201/label#it", "ex:p", '"http://archive.test/files/card7201"'))
    chain = X.Sequential([X.ReplaceIri("a", "b"), X.ReplaceIri("b", "c")])
    assert shown(chain.apply(quads_of(spark, "a: a: a:\nb: b: b:"))) == {("c:", "c:", "c:"): 2}
    assert X.Clone().apply(X.Clone().apply(one)).count() == 4
    blank = X.BlankToNamed("^b0_tagclass", "http://h/tag")
    assert shown(blank.apply(quads_of(spark, "_:b0_tagclass1 ex:p _:b1"))) == quads(("http://h/tag1", "ex:p", "_:b1"))
    servers = X.DistributeIri("^ex:([0-9]+)$", ["http://s1/$1", "http://s2/$1"])
    assert shown(servers.apply(quads_of(spark, "ex:6100 ex:p ex:6101"))) == quads(("http://s1/6100", "ex:p", "http://s2/6101"))
    with pytest.raises(ValueError, match="at least one group"):
        X.DistributeIri("^ex:", ["a"])
    with pytest.raises(Exception, match="must match a number"):
        X.DistributeIri("^ex:(.*)$", ["a"]).apply(quads_of(spark, "ex:x ex:p ex:o")).collect()
    ext = X.SetIriExtension("nq", "^ex:s")
    assert shown(ext.apply(quads_of(spark, 'ex:s.ttl ex:p "ex:s.ttl"\nex:s ex:p ex:o.ttl'))) == quads(("ex:s.nq", "ex:p", '"ex:s.ttl"'), ("ex:s.nq", "ex:p", "ex:o.ttl"))


def test_blank_to_fragment(spark):
    t = X.BlankToFragment()
    out = shown(t.apply(quads_of(spark, "ex:s#x ex:p _:o\n_:o ex:p2 ex:o2\n_:o ex:p3 ex:o3\nex:s2 ex:p _:o")))
    assert out == quads(("ex:s#x", "ex:p", "ex:s#o"), ("ex:s#o", "ex:p2", "ex:o2"), ("ex:s#o", "ex:p3", "ex:o3"), ("ex:s2", "ex:p", "_:o"))
    with pytest.raises(Exception, match="Unmapped blank node"):
        t.apply(quads_of(spark, "_:o ex:p ex:o")).collect()


REMAP = ("Post$", "id$", "hasCreator$")


def test_remap(spark):
    t = X.RemapResourceIdentifier("#Post", *REMAP)
    out = shown(t.apply(quads_of(spark, 'ex:s a ex:Post\nex:s ex:id "123"\nex:s ex:hasCreator ex:c\nex:f ex:containerOf ex:s')))
    assert out == quads(("ex:c#Post123", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "ex:Post"), ("ex:c#Post123", "ex:id", '"123"'), ("ex:c#Post123", "ex:hasCreator", "ex:c"), ("ex:f", "ex:containerOf", "ex:c#Post123"))
    # a reference made before the resource begins is not renamed, one made in flight is; not strict, both are
    text = 'ex:f ex:early ex:s\nex:s a ex:Post\nex:f ex:flight ex:s\nex:s ex:id "1"\nex:s ex:hasCreator ex:c'
    assert {k[1]: k[2] for k in shown(t.apply(quads_of(spark, text))) if k[0] == "ex:f"} == {"ex:early": "ex:s", "ex:flight": "ex:c#Post1"}
    loose = X.RemapResourceIdentifier("#Post", *REMAP, strict=False)
    assert {k[2] for k in shown(loose.apply(quads_of(spark, text))) if k[0] == "ex:f"} == {"ex:c#Post1"}
    relative = X.RemapResourceIdentifier("../posts/", *REMAP, T.GroupModifier("^.*/([^/]*)$"), True)
    text = "ex:s#abc a ex:Post\nex:s#abc ex:id http://atlas.test/Peru\nex:s#abc ex:hasCreator http://example.test/rooms/ann/door/key#it"
    assert {k[0] for k in shown(relative.apply(quads_of(spark, text)))} == {"http://example.test/rooms/ann/posts/Peru#abc"}


def test_remap_errors(spark):
    t = X.RemapResourceIdentifier("#Post", *REMAP)
    with pytest.raises(Exception, match="non-finalized"):
        t.apply(quads_of(spark, 'ex:s a ex:Post\nex:s ex:id "1"')).collect()
    with pytest.raises(Exception, match="Illegal overwrite"):
        t.apply(quads_of(spark, 'ex:s a ex:Post\nex:s ex:id "1"\nex:s ex:id "2"\nex:s ex:hasCreator ex:c')).collect()


def test_varying(spark):
    a, b = X.RemapResourceIdentifier("../posts/", *REMAP), X.RemapResourceIdentifier("../posts#", *REMAP)
    text = "".join(f'ex:{n} a ex:Post\nex:{n} ex:id "{i}"\nex:{n} ex:hasCreator http://e.org/{w}/profile/card\n' for n, i, w in (("x", 1, "aa"), ("y", 2, "ab"))) + "ex:x ex:replyOf ex:y"
    out = shown(X.VaryingResource("Post$", "hasCreator$", [a, b]).apply(quads_of(spark, text)))
    assert sum(out.values()) == 7
    (reply,) = [k for k in out if k[1] == "ex:replyOf"]
    assert sorted(["#" in reply[0], "#" in reply[2]]) == [False, True]


def test_append(spark):
    match = M.PredicateMatcher("p1$")
    text = "http://archive.test/a ex:p1 ex:o\nhttp://archive.test/a/ ex:p1 ex:o\nex:s ex:p2 ex:o"
    link = X.AppendQuadLink(match, "subject", "ex:index", "posts")
    made = [k for k in shown(link.apply(quads_of(spark, text))) if k[1] == "ex:index"]
    assert {k[2] for k in made} == {"http://archive.test/a/posts"} and len(made) == 2
    up = X.AppendResourceLink("Person$", "ex:up", "..", link_remove_trailing_slash=True)
    assert ("http://archive.test/a/b", "ex:up", "http://archive.test/a") in shown(up.apply(quads_of(spark, "http://archive.test/a/b a ex:Person")))
    twice = quads_of(spark, "ex:s ex:p1 ex:o\nex:s ex:p1 ex:o")
    back = X.AppendQuad(match, T.PositionTemplate("object"), T.IriTemplate("ex:back"), T.PositionTemplate("subject"), T.PositionTemplate("graph"))
    assert shown(X.Distinct(back).apply(twice)) == {("ex:s", "ex:p1", "ex:o"): 2, ("ex:o", "ex:back", "ex:s"): 1}
    scl = X.AppendResourceScl("Person$", "#policy-posts", "X")
    assert sum(shown(scl.apply(quads_of(spark, "ex:s a ex:Person"))).values()) == 3
    index = X.AppendSolidTypeIndex("Comment$", "hasCreator$", "../settings/publicTypeIndex", "#comments", "../comments/", True)
    out = shown(index.apply(quads_of(spark, "ex:c a ex:Comment\nex:c ex:hasCreator http://example.test/77/door/key#it")))
    assert sum(out.values()) == 8
    assert ("http://example.test/77/settings/publicTypeIndex#comments", "http://www.w3.org/ns/solid/terms#instanceContainer", "http://example.test/77/comments/") in out


def test_void_and_bloom_sizes(spark):
    void = S.ByVoID(["^(ex:[a-z0-9]+)$"])
    assert void.assign(quads_of(spark, SUBJECT["no blank nodes"][0])).count() == 28
    out = shown(void.assign(quads_of(spark, SUBJECT["owned"][0])))
    assert sum(out.values()) == 14
    bloom = S.ByBloom(["^(ex:[a-z0-9]+)$"], 256, 4, [])
    for name, n in (("no blank nodes", 66), ("owned", 33), ("unowned", 23)):
        assert bloom.assign(quads_of(spark, SUBJECT[name][0])).count() == n, name


def test_literals_in_templates(spark):
    df = quads_of(spark, "ex:s ex:p ex:o")
    both = df.select(term_to_string(T.LiteralTemplate("object", "ex:type", "en").term()), term_to_string(T.LiteralTemplate("object", None, "en").term())).first()
    assert tuple(both) == ('"ex:o"^^ex:type', '"ex:o"@en')


def test_bloom_membership(spark):
    """Every pair that went in is found, also in filters longer than one bitmap of Spark's."""
    from pyspark.sql import functions as F

    from quadrille.operators.summaries import bloom_filters, bloom_pairs, bloom_positions

    df = S.ByVoID(["^(ex:[a-z0-9]+)$"]).grouped(quads_of(spark, "\n".join(f"ex:s ex:p{i % 3} ex:o{i}" for i in range(40))))
    for bits in (256, 65_536):
        filters = bloom_filters(df, bits, 4)
        pairs = bloom_pairs(df).withColumn("at", bloom_positions(F.col("member"), bits, 4)).join(filters, ["dataset", "family", "key"]).collect()
        assert pairs and all(len(r["bitmap"]) == bits // 8 and all(r["bitmap"][i // 8] >> i % 8 & 1 for i in r["at"]) for r in pairs)
