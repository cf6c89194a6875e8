"""Text functions, sources, sinks, configuration, streaming."""

import json
import os
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.functions.terms import format_quad, quads_of, term_to_string
from quadrille.functions.text import code_sum, fnv1a_32, js_replace, murmur3_32, resolve_iri
from quadrille.plans.fragmenter import load
from quadrille.sinks.files import file_path
from quadrille.sources.rdf import TurtleParser, parse_lines


def values(spark, rows, *columns):
    df = spark.createDataFrame([(x,) for x in rows], "v string")
    return [tuple(r) for r in df.select(*columns).collect()]


def murmur(text):
    data, h, m = text.encode("latin-1"), 0, 0xFFFFFFFF
    rot = lambda x, r: (x << r | x >> (32 - r)) & m
    for i in range(0, len(data) - len(data) % 4, 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & m
        h = (rot(h ^ rot(k, 15) * 0x1B873593 & m, 13) * 5 + 0xE6546B64) & m
    if len(data) % 4:
        h ^= rot(int.from_bytes(data[len(data) - len(data) % 4 :], "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(st.characters(min_codepoint=1, max_codepoint=126), max_size=40), min_size=1, max_size=20))
def test_hashes(spark, texts):
    texts = [*texts, "", "hel", "hell", "hello"]

    def fnv(t):
        h = 0x811C9DC5
        for b in t.encode():
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
        return h

    got = values(spark, texts, murmur3_32(F.col("v")), fnv1a_32(F.col("v")), code_sum(F.col("v")))
    assert got == [(murmur(t), fnv(t), sum(map(ord, t))) for t in texts]
    assert murmur("hello") == 0x248BFA47


@pytest.mark.parametrize(
    "regex, replacement, python",
    [("b", "X", "X"), ("^(a*)(.)", "$2$1$$", r"\2\1$"), ("(c)?b", "<$&>", r"<\g<0>>"), ("a$", "$9\\", "$9\\\\"), ("(a)(b)", "$10", r"\g<1>0"), (r"\/|[$&]", "/", "/")],
)
def test_js_replace(spark, regex, replacement, python):
    texts = ["", "abcabc", "aaab", "xba", "cb\na", "a/b$&"]
    pattern = re.compile(regex.replace("$", r"\Z") if regex.endswith("$") else regex)
    assert values(spark, texts, js_replace(F.col("v"), regex, replacement)) == [(pattern.sub(python, t, count=1),) for t in texts]


def test_resolve(spark):
    cases = [
        ("interests", "ex:s1/", "ex:s1/interests"),
        ("#Post123", "ex:c", "ex:c#Post123"),
        ("../posts/123", "http://example.test/rooms/ann/door/key#it", "http://example.test/rooms/ann/posts/123"),
        ("g;x=1/../y", "http://a/b/c/d;p?q", "http://a/b/c/y"),
        ("?y", "http://a/b/c/d;p?q", "http://a/b/c/d;p?y"),
        ("", "http://a/b#f", "http://a/b"),
        ("//g/x", "http://a/b", "http://g/x"),
        ("../../../g", "http://a/b/c/d", "http://a/g"),
        ("..", "http://a/b/c/", "http://a/b/"),
        (".", "http://a/b/c", "http://a/b/"),
        ("x", "http://a", "http://a/x"),
        ("urn:x:y", "http://a", "urn:x:y"),
    ]
    df = spark.createDataFrame([(r, b) for r, b, _ in cases], "r string, b string")
    assert [x[0] for x in df.select(resolve_iri(F.col("r"), F.col("b"))).collect()] == [e for _, _, e in cases]


def test_file_path(spark):
    mapping = {"^http://e.org/1": "a/", "^http://e.org/2": "b/", "^http://e.org/23": "c/"}
    got = values(spark, ["http://e.org/23/f#abc", "http://e.org/1x:y?"], file_path(F.col("v"), mapping, "$.nq"), file_path(F.col("v"), mapping, ".a"))
    assert got == [("c//f$.nq", "c//f"), ("a/x_y_$.nq", "a/x_y_")]
    with pytest.raises(Exception, match="No IRI mapping found"):
        values(spark, ["http://other/"], file_path(F.col("v"), mapping))


def strings(df):
    return Counter(tuple(r) for r in df.select(*[term_to_string(c) for c in "spog"]).collect())


def test_lines(spark):
    lines = ["# note", "", '<ex:s> <ex:p> "a\\"b\\n\\u00e9"@EN .', "_:x <ex:p> _:y <ex:g> . # end", '<ex:s><ex:p>"1"^^<ex:int>.']
    df = spark.createDataFrame(list(enumerate(lines)), "line long, value string")
    assert strings(parse_lines(df, 3)) == Counter([("ex:s", "ex:p", '"a"b\né"@en', ""), ("_:b3_x", "ex:p", "_:b3_y", "ex:g"), ("ex:s", "ex:p", '"1"^^ex:int', "")])
    with pytest.raises(Exception, match="Not a statement"):
        parse_lines(spark.createDataFrame([(0, "<ex:s> nonsense")], "line long, value string")).collect()


def test_turtle():
    text = """@prefix ex: <http://e/> . @base <http://base/x> . PREFIX : <#>
    ex:s a ex:T ; ex:p "v"@en-US, 'w'^^ex:d, 1, 2.5, 1e3, true ; . # note
    <rel> ex:list ( 1 [ ex:q \"\"\"long "text\"\"\" ] ) .
    [] ex:x _:b . [ ex:y :z ] .
    ex:g { ex:s ex:p ex:o . <a> ex:p <b> }"""
    got = TurtleParser(text, "http://doc/").parse()
    assert len(got) == 7 + 1 + 4 + 1 + 1 + 1 + 2
    assert got[1][2] == ("literal", "v", None, "en-us") and got[-1][0][1] == "http://base/a" and got[-1][3][1] == "http://e/g"
    with pytest.raises(ValueError):
        TurtleParser("<a> <b> .").parse()


def config(tmp_path, sink, **more):
    return {
        "@id": "urn:default",
        "@type": "Fragmenter",
        "quadSource": {"@type": "QuadSourceComposite", "sources": [{"@type": "QuadSourceFile", "filePath": str(tmp_path / "in.nt")}, {"@type": "QuadSourceFile", "filePath": str(tmp_path / "in.ttl")}]},
        "fragmentationStrategy": {"@type": "FragmentationStrategySubject"},
        "quadSink": sink,
        **more,
    }


def test_configuration_to_files(spark, tmp_path):
    (tmp_path / "in.nt").write_text('<http://e/1> <http://e/p> "a" .\n<http://e/1> <http://e/p> _:x .\n_:x <http://e/q> "b" .\n<http://e/2> <http://e/p> "c" .\n')
    (tmp_path / "in.ttl").write_text("@prefix e: <http://e/> . <http://e/2#f> a e:T .")
    out = tmp_path / "out"
    files = {"@type": "QuadSinkFile", "log": True, "outputFormat": "application/n-quads", "fileExtension": "$.nq", "iriToPath": {"^http://e/": f"{out}/"}}
    csv = {"@type": "QuadSinkFiltered", "filter": {"@type": "QuadMatcherPredicate", "predicateRegex": "/p$"}, "sink": [{"@type": "QuadSinkCsv", "file": f"{out}/x/q.csv", "columns": ["subject"]}]}
    callback = {"@type": "TransformCallbackMap", "file": f"{out}/map.csv", "fieldToMap": "subject", "columns": ["from", "to"], "matchers": [{"@type": "QuadMatcherResourceType", "typeRegex": "T$"}]}
    replace = {"@type": "QuadTransformerReplaceIri", "searchRegex": "^http://e/2", "replacementString": "http://e/two"}
    made = config(tmp_path, {"@type": "QuadSinkComposite", "sinks": [files, csv]}, transformers=[replace], transformCallback=[callback])
    (tmp_path / "c.json").write_text(json.dumps(made))
    load(str(tmp_path / "c.json")).run(spark)
    assert (out / "1$.nq").read_text() == '<http://e/1> <http://e/p> "a" .\n<http://e/1> <http://e/p> _:b0_x .\n_:b0_x <http://e/q> "b" .\n'
    assert (out / "two$.nq").read_text().splitlines() == ['<http://e/two> <http://e/p> "c" .', "<http://e/two#f> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e/T> ."]
    assert (out / "x/q.csv").read_text().splitlines() == ["subject", "http://e/1", "http://e/1", "http://e/two"]
    assert (out / "map.csv").read_text() == "from,to\nhttp://e/2#f,http://e/two#f\n"
    assert sorted(os.listdir(out)) == ["1$.nq", "map.csv", "two$.nq", "x"]


def test_configuration_errors(tmp_path):
    with pytest.raises(ValueError, match="unknown component"):
        load({"@type": "Nothing"})
    with pytest.raises(ValueError, match="no option"):
        load({"@type": "QuadMatcherPredicate", "regex": "x"})
    with pytest.raises(ValueError, match="HDT"):
        load({"@type": "QuadSinkHdt", "outputFormat": "text/html", "iriToPath": {}})


def test_hdt_command(spark, tmp_path):
    sink = {"@type": "QuadSinkHdt", "outputFormat": "application/n-quads", "iriToPath": {"^ex:": f"{tmp_path}/"}, "command": ["cp", "{source}", "{target}"], "conversionConcurrency": 2}
    from quadrille.operators.strategies import BySubject
    from quadrille.plans.registry import build

    build(sink).write(BySubject().assign(quads_of(spark, "ex:a ex:p ex:o\nex:b ex:p ex:o")))
    assert sorted(os.listdir(tmp_path)) == ["a.hdt", "b.hdt"]


def test_formats(spark):
    df = quads_of(spark, 'ex:s ex:p "a"\nex:s ex:p ex:o ex:g')
    for name, lines in {
        "application/n-quads": ['<ex:s> <ex:p> "a" .', "<ex:s> <ex:p> <ex:o> <ex:g> ."],
        "text/turtle": ['<ex:s> <ex:p> "a".', "<ex:s> <ex:p> <ex:o>."],
        "application/trig": ['<ex:s> <ex:p> "a".', "<ex:g> { <ex:s> <ex:p> <ex:o> }"],
    }.items():
        assert [r[0] for r in df.orderBy("seq").select(format_quad(name)).collect()] == lines


def test_stream(spark, tmp_path):
    from quadrille.operators import strategies as S
    from quadrille.operators import transforms as X
    from quadrille.streaming.stream import fragments, read_lines, write_table

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.nt").write_text("<http://e/1> <http://e/p> <http://e/2> .\n_:b <http://e/p> <http://e/2> .\n")
    stream = fragments(read_lines(spark, str(tmp_path / "in")), [X.ReplaceIri("^http://e/", "http://f/")], S.BySubject())
    query = write_table(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True)
    query.awaitTermination(60)
    assert [r["doc"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["http://f/1"]
    with pytest.raises(ValueError, match="must see all quads"):
        fragments(stream, [X.BlankToFragment()], S.BySubject())
    with pytest.raises(ValueError, match="must see all quads"):
        fragments(stream, [], S.ByVoID(["x"]))


def test_stream_refuses_blank_nodes(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from quadrille.operators import strategies as S
    from quadrille.streaming.stream import fragments, read_lines, write_table

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.nt").write_text('<http://e/1> <http://e/p> "x" .\n<http://e/1> <http://e/p> _:b .\n_:b <http://e/p> <http://e/2> .\n')
    for name, strategy in (("s", S.BySubject()), ("o", S.ByObject())):
        stream = fragments(read_lines(spark, str(tmp_path / "in")), [], strategy, blank="error")
        query = write_table(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"), once=True)
        with pytest.raises(StreamingQueryException, match="owners of a blank node"):
            query.awaitTermination(60)
    with pytest.raises(ValueError, match="drop or error"):
        fragments(stream, [], S.BySubject(), blank="x")
