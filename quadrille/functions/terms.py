"""RDF terms as structs, quads as rows.

A term is struct<kind, value, datatype, lang>; kind is iri, bnode, literal, var or default (the default graph, whose
value is the empty string, so that terms compare and hash without nulls in value). A quad is a row (seq, s, p, o, g);
seq, an array of longs, orders quads: every operator that makes several quads of one appends their places to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "value", "datatype", "lang")])
QUAD = T.StructType([T.StructField("seq", T.ArrayType(T.LongType()))] + [T.StructField(c, TERM) for c in "spog"])
FRAGMENT = T.StructType([T.StructField("doc", T.StringType()), *QUAD.fields])
POSITIONS = {"subject": "s", "predicate": "p", "object": "o", "graph": "g"}

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"


def _col(x: Column | str | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string")


def term(kind: Column | str, value: Column | str, datatype: Column | str | None = None, lang: Column | str | None = None) -> Column:
    return F.struct(_col(kind).alias("kind"), _col(value).alias("value"), _col(datatype).alias("datatype"), _col(lang).alias("lang"))


def iri(value: Column | str) -> Column:
    return term("iri", value)


def bnode(value: Column | str) -> Column:
    return term("bnode", value)


def literal(value: Column | str, datatype: Column | str | None = None, lang: Column | str | None = None) -> Column:
    return term("literal", value, datatype, lang)


def default_graph() -> Column:
    return term("default", "")


def quad(s: Column, p: Column, o: Column, g: Column | None = None) -> Column:
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"), (default_graph() if g is None else g).alias("g"))


def position(name: str) -> str:
    """The column of a position: subject, predicate, object or graph."""
    if name not in POSITIONS:
        raise ValueError(f"no quad position: {name!r}")
    return POSITIONS[name]


def is_iri(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c)["kind"] == "iri"


def is_bnode(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c)["kind"] == "bnode"


def is_type_quad() -> Column:
    """An IRI subject's rdf:type with an IRI object."""
    return is_iri("s") & (F.col("p.value") == RDF_TYPE) & is_iri("p") & is_iri("o")


def term_to_string(c: Column | str) -> Column:
    """IRI raw, bnode _:b, literal "v", "v"@lang or "v"^^datatype, variable ?v, default graph empty."""
    t = F.col(c) if isinstance(c, str) else c
    quoted = F.concat(F.lit('"'), t["value"], F.lit('"'))
    tagged = (
        F.when(t["lang"].isNotNull(), F.concat(quoted, F.lit("@"), t["lang"]))
        .when(t["datatype"].isNotNull() & (t["datatype"] != XSD + "string"), F.concat(quoted, F.lit("^^"), t["datatype"]))
        .otherwise(quoted)
    )
    return (
        F.when(t["kind"] == "literal", tagged).when(t["kind"] == "bnode", F.concat(F.lit("_:"), t["value"])).when(t["kind"] == "var", F.concat(F.lit("?"), t["value"])).otherwise(t["value"])
    )


def _escaped(value: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def format_term(c: Column | str) -> Column:
    """A term in N-Quads."""
    t = F.col(c) if isinstance(c, str) else c
    quoted = F.concat(F.lit('"'), _escaped(t["value"]), F.lit('"'))
    tagged = (
        F.when(t["lang"].isNotNull(), F.concat(quoted, F.lit("@"), t["lang"]))
        .when(t["datatype"].isNotNull() & (t["datatype"] != XSD + "string"), F.concat(quoted, F.lit("^^<"), t["datatype"], F.lit(">")))
        .otherwise(quoted)
    )
    return (
        F.when(t["kind"] == "literal", tagged)
        .when(t["kind"] == "bnode", F.concat(F.lit("_:"), t["value"]))
        .when(t["kind"] == "iri", F.concat(F.lit("<"), t["value"], F.lit(">")))
        .when(t["kind"] == "var", F.concat(F.lit("?"), t["value"]))
    )


#: The formats that lines of quads can have.
OUTPUT_FORMATS = ("application/n-quads", "application/n-triples", "text/turtle", "application/trig")


def format_quad(output: str = "application/n-quads") -> Column:
    """A quad as a line: N-Quads and N-Triples end in " .", Turtle and TriG lines in "."; N-Triples and Turtle have no
    graphs."""
    if output not in OUTPUT_FORMATS:
        raise ValueError(f"no such output format: {output}")
    triple = F.concat_ws(" ", format_term("s"), format_term("p"), format_term("o"))
    if output in ("application/n-triples",):
        return F.concat(triple, F.lit(" ."))
    if output in ("application/n-quads",):
        return F.concat(F.concat_ws(" ", triple, format_term("g")), F.lit(" ."))
    if output == "text/turtle":
        return F.concat(triple, F.lit("."))
    return F.when(F.col("g.kind") == "default", F.concat(triple, F.lit("."))).otherwise(F.concat(format_term("g"), F.lit(" { "), triple, F.lit(" }")))


def flat_map(df: DataFrame, quads: Column) -> DataFrame:
    """Each row's array of quads as rows; other columns go along, and places are appended to seq."""
    rest = [c for c in df.columns if c not in ("seq", "s", "p", "o", "g")]
    rows = df.select(*[F.col(f"`{c}`") for c in rest], "seq", F.posexplode(quads).alias("__pos", "__q"))
    return rows.select(*[F.col(f"`{c}`") for c in rest], F.concat("seq", F.array(F.col("__pos").cast("long"))).alias("seq"), "__q.s", "__q.p", "__q.o", "__q.g")


def this_quad() -> Column:
    return F.struct("s", "p", "o", "g")


def empty_quads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], QUAD)


def quads_of(spark: SparkSession, text: str) -> DataFrame:
    """Quads from a short notation, for tests and examples: three or four terms a line; <iri> or prefix:name, _:b,
    "literal" with @lang or ^^type, ?v, and a for rdf:type."""
    import re

    def one(x: str) -> tuple:
        if x == "a":
            return ("iri", RDF_TYPE, None, None)
        if x[0] == '"':
            m = re.fullmatch(r'"(.*)"(?:@([\w-]+)|\^\^<?([^>]*)>?)?', x, re.S)
            return ("literal", m[1], m[3], m[2])
        if x[:2] == "_:":
            return ("bnode", x[2:], None, None)
        return ("var", x[1:], None, None) if x[0] == "?" else ("iri", x.strip("<>"), None, None)

    rows = []
    for i, line in enumerate(x for x in text.strip().splitlines() if x.strip()):
        found = re.findall(r'"(?:[^"])*"(?:@[\w-]+|\^\^\S+)?|\S+', line)
        terms = [one(x) for x in found if x != "."]
        rows.append(([i], *terms, *([("default", "", None, None)] if len(terms) == 3 else [])))
    return spark.createDataFrame(rows, QUAD)
