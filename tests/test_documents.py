"""Sources of whole documents, escapes, closures, warnings, names of files."""

import gzip
import json
import random
from collections import Counter

import pytest

import quadrille.components  # noqa: F401  (registers all components)
from quadrille.functions.terms import quads_of, term_to_string
from quadrille.functions.text import js_replace, matches
from quadrille.operators import strategies as S
from quadrille.operators.closure import blank_links, owners
from quadrille.plans.registry import build
from quadrille.sources.documents import HtmlParser, JsonLdParser, RdfXmlParser
from quadrille.sources.rdf import FileSource, parse_lines

RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"


def shown(quads):
    """Quads as strings, without what names their graphs if that is the default one."""

    def one(t):
        kind, value, datatype, lang = t
        return {"iri": value, "bnode": f"_:{value}", "default": ""}.get(kind) if kind != "literal" else f'"{value}"' + (f"@{lang}" if lang else f"^^{datatype}" if datatype else "")

    return Counter(tuple(one(t) for t in q[: 3 if q[3][0] == "default" else 4]) for q in quads)


def test_rdf_xml():
    text = f"""<?xml version="1.0"?><!DOCTYPE r [<!ENTITY x "{XSD}">]>
    <rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/" xml:base="http://base/doc" xml:lang="EN">
      <e:Person rdf:about="#me" e:nick="kim"><e:name xml:lang="">Kim</e:name><e:age rdf:datatype="&x;integer">7</e:age><e:knows rdf:resource="/you"/></e:Person>
      <rdf:Description rdf:nodeID="b"><e:says>hi</e:says><e:at rdf:parseType="Resource"><e:x>1</e:x></e:at><e:in><e:Place/></e:in></rdf:Description>
      <rdf:Seq rdf:ID="s"><rdf:li>a</rdf:li><rdf:li rdf:nodeID="b"/></rdf:Seq>
      <rdf:Description rdf:about="l"><e:list rdf:parseType="Collection"><rdf:Description rdf:about="i"/></e:list><e:xml rdf:parseType="Literal">a<i>b</i></e:xml><e:p rdf:ID="r" e:q="v"/></rdf:Description>
    </rdf:RDF>"""
    got = shown(RdfXmlParser(text, "http://doc/", "").parse())
    me, lst = "http://base/doc#me", "http://base/l"
    want = {
        (me, RDF + "type", "http://e/Person"), (me, "http://e/nick", '"kim"@en'), (me, "http://e/name", '"Kim"'), (me, "http://e/age", f'"7"^^{XSD}integer'), (me, "http://e/knows", "http://base/you"),
        ("_:b", "http://e/says", '"hi"@en'), ("_:b", "http://e/at", "_:n1"), ("_:n1", "http://e/x", '"1"@en'), ("_:b", "http://e/in", "_:n2"), ("_:n2", RDF + "type", "http://e/Place"),
        ("http://base/doc#s", RDF + "type", RDF + "Seq"), ("http://base/doc#s", RDF + "_1", '"a"@en'), ("http://base/doc#s", RDF + "_2", "_:b"),
        (lst, "http://e/list", "_:n3"), ("_:n3", RDF + "first", "http://base/i"), ("_:n3", RDF + "rest", RDF + "nil"), (lst, "http://e/xml", f'"a<i>b</i>"^^{RDF}XMLLiteral'),
        (lst, "http://e/p", "_:n4"), ("_:n4", "http://e/q", '"v"@en'), ("http://base/doc#r", RDF + "type", RDF + "Statement"), ("http://base/doc#r", RDF + "subject", lst), ("http://base/doc#r", RDF + "predicate", "http://e/p"), ("http://base/doc#r", RDF + "object", "_:n4"),
    }
    assert set(got) == want and set(got.values()) == {1}
    assert shown(RdfXmlParser(f'<e:T xmlns:e="http://e/" xmlns:rdf="{RDF}" rdf:about="x"/>', "http://d/").parse()) == {("http://d/x", RDF + "type", "http://e/T"): 1}


def test_json_ld():
    doc = {
        "@context": {
            "@vocab": "http://v/", "e": "http://e/", "@language": "de", "id": "@id",
            "knows": {"@id": "e:knows", "@type": "@id"}, "age": {"@id": "e:age", "@type": XSD + "byte"}, "parent": {"@reverse": "e:child"},
            "items": {"@container": "@list"}, "label": {"@id": "e:label", "@container": "@language"}, "by": {"@id": "e:by", "@container": "@index"}, "gone": None, "plain": {"@language": None},
        },
        "@graph": [
            {"id": "#a", "@type": ["T", "e:U"], "name": "Ada", "knows": ["b", "_:c"], "age": 36, "gone": 1, "plain": "x", "big": 1.5, "yes": True, "none": None},
            {"@id": "d", "items": [1, {"@value": "z", "@language": "EN"}], "label": {"en": ["one", "two"], "@none": "three"}, "by": {"k": {"@id": "m"}}, "parent": {"@id": "p", "q": {"@value": "1", "@type": "e:t"}}},
            {"@id": "g", "@graph": [{"@id": "h", "e:in": {"@id": "i"}}]},
        ],
    }
    got = shown(JsonLdParser(json.dumps(doc), "http://base/x", "s_").parse())
    a, d = "http://base/x#a", "http://base/d"
    want = {
        (a, RDF + "type", "http://v/T"), (a, RDF + "type", "http://e/U"), (a, "http://v/name", '"Ada"@de'), (a, "http://e/knows", "http://base/b"), (a, "http://e/knows", "_:s_c"), (a, "http://e/age", f'"36"^^{XSD}byte'),
        (a, "http://v/plain", '"x"'), (a, "http://v/big", f'"1.5E0"^^{XSD}double'), (a, "http://v/yes", f'"true"^^{XSD}boolean'),
        (d, "http://v/items", "_:s_n1"), ("_:s_n1", RDF + "first", f'"1"^^{XSD}integer'), ("_:s_n1", RDF + "rest", "_:s_n2"), ("_:s_n2", RDF + "first", '"z"@en'), ("_:s_n2", RDF + "rest", RDF + "nil"),
        (d, "http://e/label", '"one"@en'), (d, "http://e/label", '"two"@en'), (d, "http://e/label", '"three"'), (d, "http://e/by", "http://base/m"),
        ("http://base/p", "http://e/child", d), ("http://base/p", "http://v/q", '"1"^^http://e/t'), ("http://base/h", "http://e/in", "http://base/i", "http://base/g"),
    }
    assert set(got) == want and set(got.values()) == {1}
    with pytest.raises(ValueError, match="not fetched"):
        JsonLdParser('{"@context": "http://schema.org/", "name": "x"}').parse()
    scoped = {"@context": {"T": {"@id": "http://e/T", "@context": {"n": "http://e/n"}}, "in": {"@id": "http://e/in", "@context": {"m": "http://e/m"}}}, "@id": "http://x", "@type": "T", "n": 1, "m": 2, "in": {"m": 3}}
    assert {q[1][1] for q in JsonLdParser(json.dumps(scoped)).parse()} == {RDF + "type", "http://e/n", "http://e/in", "http://e/m"}


def test_html():
    text = """<html lang="en"><head><base href="http://h/"><script type="application/ld+json">{"@id": "http://j", "http://p": {"@id": "http://k"}}</script></head>
    <body vocab="http://schema.org/" prefix="e: http://e/"><div resource="#me" typeof="Person e:Kind"><span property="name">Kim <b>L</b></span><a property="url" href="page">x</a>
    <meta property="e:born" content="2000" datatype="xsd:gYear"><p property="address" typeof="Place"><i property="city">Oslo</i></p></div>
    <p about="doc" rel="e:made" resource="other"></p></body></html>"""
    got = shown(HtmlParser(text, "http://base/").parse())
    me = "http://h/#me"
    assert got == Counter(
        [
            (me, RDF + "type", "http://schema.org/Person"), (me, RDF + "type", "http://e/Kind"), (me, "http://schema.org/name", '"Kim L"@en'), (me, "http://schema.org/url", "http://h/page"), (me, "http://e/born", f'"2000"^^{XSD}gYear'),
            (me, "http://schema.org/address", "_:n1"), ("_:n1", RDF + "type", "http://schema.org/Place"), ("_:n1", "http://schema.org/city", '"Oslo"@en'), ("http://h/doc", "http://e/made", "http://h/other"), ("http://j", "http://p", "http://k"),
        ]
    )


def test_files_by_extension(spark, tmp_path):
    (tmp_path / "a.rdf").write_text(f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/"><e:T rdf:about="http://s"/></rdf:RDF>')
    (tmp_path / "b.jsonld").write_text('{"@id": "http://s", "http://p": "x"}')
    (tmp_path / "c.html").write_text('<p about="http://s" property="http://p" content="y"></p>')
    with gzip.open(tmp_path / "d.nt.gz", "wt") as f:
        f.write('<http://s> <http://p> "z" .\n')
    rows = [FileSource(str(tmp_path / n)).read(spark).select(*[term_to_string(c) for c in "spo"]).collect() for n in ("a.rdf", "b.jsonld", "c.html", "d.nt.gz")]
    assert [tuple(r[0]) for r in rows] == [("http://s", RDF + "type", "http://e/T"), ("http://s", "http://p", '"x"'), ("http://s", "http://p", '"y"'), ("http://s", "http://p", '"z"')]
    with pytest.raises(ValueError, match="no parser"):
        FileSource("x.docx").read(spark)


def test_escapes(spark):
    """Also beyond the first plane, behind escaped backslashes, and among raw control characters."""
    cases = {r"x\U0001F600y": "x😀y", r"\u00e9\U000000e9": "éé", r"\\U0001F600 \\u00e9": r"\U0001F600 \u00e9", r"\\\U0001F600\\": "\\😀\\", r"\t\n\r\b\f\"\'": "\t\n\r\b\f\"'", "raw\ttab\\t\x01": "raw\ttab\t\x01", r"\U0010FFFF": "\U0010ffff"}
    lines = spark.createDataFrame([(i, f'<ex:s> <ex:p> "{k}" .') for i, k in enumerate(cases)], "line long, value string")
    assert [r["value"] for r in parse_lines(lines).orderBy("seq").select("o.value").collect()] == list(cases.values())
    iri = spark.createDataFrame([(0, r"<http://e/\u00e9\U0001F600> <ex:p> <ex:o> .")], "line long, value string")
    assert parse_lines(iri).first()["s"]["value"] == "http://e/é😀"
    for wrong in (r"\U00110000", r"\U0001", r"\x41", r"\u12"):
        with pytest.raises(Exception, match="Illegal escape"):
            parse_lines(spark.createDataFrame([(0, f'<ex:s> <ex:p> "{wrong}" .')], "line long, value string")).collect()


def test_owners_of_any_graph(spark):
    """Chains, trees, shared nodes and cycles, against a search from every key."""
    rng = random.Random(4)
    for n, m in ((12, 14), (30, 25), (40, 70)):
        links = {(f"b{rng.randrange(n)}", f"k{rng.randrange(4)}") for _ in range(5)}
        edges = {(f"b{rng.randrange(n)}", f"b{rng.randrange(n)}") for _ in range(m)} | {(f"c{i}", f"c{i + 1}") for i in range(40)} | {("b0", "c0"), ("x", "y"), ("y", "x")}
        want = set()
        for b, key in links:
            queue, seen = [b], {b}
            while queue:
                a = queue.pop()
                for c in {y for x, y in edges if x == a} - seen:
                    seen.add(c)
                    queue.append(c)
            want |= {(x, key) for x in seen}
        got = owners(spark.createDataFrame(sorted(links), "b string, key string"), spark.createDataFrame(sorted(edges), "a string, b string")).collect()
        assert Counter(map(tuple, got)) == Counter(want)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A list of 600 items is owned after about as many rounds as 600 has binary digits."""
    from quadrille.operators import closure

    written, plain = [], closure.materialize
    monkeypatch.setattr(closure, "materialize", lambda df, name: written.append(name) or plain(df, name))
    df = quads_of(spark, "ex:s ex:p _:b0\n" + "\n".join(f"_:b{i} ex:rest _:b{i + 1}" for i in range(600)))
    assert owners(*blank_links(df, "s", "o")).count() == 601 and len(written) < 16


def test_warnings(spark):
    df = quads_of(spark, "ex:s ex:p _:a\n_:a ex:p ex:o\n_:b ex:p ex:o\nex:t ex:T ex:o")
    told = lambda s: sorted(r[0] for r in s.unplaced(df).collect())
    assert told(S.BySubject()) == ["Quad with a blank node as subject that no IRI links to: _:b ex:p ex:o"]
    assert told(S.ByResourceObject("T$")) == [f"Resource without a target predicate: {x}" for x in ("a", "b", "ex:s")]
    assert S.Constant("x").unplaced(df) is None and S.Composite([S.Constant("x")]).unplaced(df) is None
    assert len(told(S.Composite([S.BySubject(), S.BySubject()]))) == 2


def test_run_warns_and_cleans_up(spark, tmp_path, capfd):
    import os

    from quadrille.plans.fragmenter import load
    from quadrille.plans.storage import shared_dir

    (tmp_path / "in.nt").write_text("".join(f"_:b{i} <http://e/p> <http://e/o> .\n" for i in range(25)) + '<http://e/s> <http://e/p> "x" .\n')
    source, sink = {"@type": "QuadSourceFile", "filePath": str(tmp_path / "in.nt")}, {"@type": "QuadSinkFile", "outputFormat": "application/n-triples", "iriToPath": {"^http://e/": f"{tmp_path}/out/"}}
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    load({"@type": "Fragmenter", "quadSource": source, "fragmentationStrategy": {"@type": "FragmentationStrategySubject"}, "quadSink": sink}).run(spark)
    said = [x for x in capfd.readouterr().err.splitlines() if "blank node" in x or "more" in x]
    assert len(said) == 21 and said[-1] == "and 5 more"
    assert (tmp_path / "out/s").read_text() == '<http://e/s> <http://e/p> "x" .\n' and set(os.listdir(folder)) == before


def test_hdt_names(tmp_path):
    sink = build({"@type": "QuadSinkHdt", "outputFormat": "application/n-quads", "iriToPath": {}, "fileExtension": "$.nq"})
    assert sink.conversion("/x/y/a$.nq")[4:] == ["/x/y:/data:rw", "rdfhdt/hdt-cpp", "rdf2hdt", "-p", "-i", "/data/a$.nq", "/data/a.hdt"]
    plain = build({"@type": "QuadSinkHdt", "outputFormat": "text/turtle", "iriToPath": {}, "generateIndexes": False, "command": ["c", "{source}", "{target}"]})
    assert plain.conversion("/x/a.ttl") == ["c", "/x/a.ttl", "/x/a.ttl.hdt"]


def test_extensions(spark):
    from pyspark.sql import functions as F

    from quadrille.sinks.files import file_path

    for extension, there in {".nq": True, ".a": False, ".Z": False, "$.n": False, ".": True, ".é": True, ".7": True, "x": True}.items():
        assert (spark.range(1).select(file_path(F.lit("http://e/f"), {"^http://e/": ""}, extension)).first()[0] != "f") == there, extension


def test_back_references(spark):
    from pyspark.sql import functions as F

    one = lambda text, column: spark.createDataFrame([(text,)], "v string").select(column).first()[0]
    assert one("xabab1aba", js_replace(F.col("v"), r"(a)(b)\1\2", "<$2$1>")) == "x<ba>1aba"
    assert one("aa1 a1", js_replace(F.col("v"), r"(a)(?:\1)1", "-")) == "- a1"
    assert one("xyyx", matches(F.col("v"), r"^(x)(y)\2\1$")) and not one("xyxy", matches(F.col("v"), r"^(x)(y)\2\1$"))
    assert one(r"a\1", js_replace(F.col("v"), r"\\1", "b")) == "ab"


def test_ships_itself(tmp_path):
    """With the package on the driver's path alone, workers find it once it has been shipped."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "a.ttl").write_text("<http://s> <http://p> <http://o> .")
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from quadrille.plans.ship import ship
from quadrille.sources.rdf import FileSource
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ship(spark)
ship(spark)
print("quads", FileSource({str(tmp_path / "a.ttl")!r}).read(spark).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "quads 1" in done.stdout, done.stderr[-2000:]


def test_subjects_with_many_targets(spark):
    """Hubs are filled forward by ranges, as others by intervals: the last target before a quad, or else the first."""
    rng = random.Random(9)
    rows, want = [], Counter()
    for s, n, share in (("hub", 400, 0.5), ("few", 60, 0.1), ("late", 300, 0.4), ("none", 5, 0.0)):
        rows += [(s, i, "ex:T" if rng.random() < share and not (s == "late" and i < 100) else "ex:p", f"ex:{s}{i}") for i in range(n)]
    for s in ("hub", "few", "late"):
        own = [r for r in rows if r[0] == s]
        first = next(r[3] for r in own if r[2] == "ex:T")
        now = None
        for _, i, p, o in own:
            want[(now or first, o)] += 1
            now = o if p == "ex:T" else now
    rng.shuffle(rows)
    iri = lambda x: ("iri", x, None, None)
    from quadrille.functions.terms import QUAD

    df = spark.createDataFrame([([i], iri(s), iri(p), iri(o), ("default", "", None, None)) for s, i, p, o in rows], QUAD)
    got = S.ByResourceObject("T$").assign(df).select("doc", "o.value").collect()
    assert Counter(map(tuple, got)) == want


def test_progress_log(spark, tmp_path, capsys):
    sink = build({"@type": "QuadSinkFile", "log": "true", "outputFormat": "application/n-triples", "iriToPath": {"^ex:": f"{tmp_path}/"}})
    sink.write(S.BySubject().assign(quads_of(spark, "ex:a ex:p ex:o\nex:a ex:p ex:o\nex:b ex:p ex:o")))
    assert capsys.readouterr().out == "Handled quads: 3 in 2 files\n"
    assert (tmp_path / "a").read_text().count("\n") == 2
