"""RDF files as quads. N-Triples and N-Quads are read line by line, split across tasks; Turtle, TriG, RDF/XML, JSON-LD
and HTML, whose meaning depends on the whole document, file by file. Blank nodes are scoped to their file by a prefix b0_, b1_, .."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import QUAD, RDF_TYPE, XSD, default_graph, empty_quads, term
from ..plans.registry import component
from .documents import PARSERS

LINES = ("nt", "nq", "ntriples", "nquads")

_IRI, _BLANK, _LITERAL = r"<[^>]*>", r"_:[^\s<>\"]+", r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?'
_LINE = rf"^\s*({_IRI}|{_BLANK})\s*({_IRI})\s*({_IRI}|{_BLANK}|{_LITERAL})\s*({_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"


def _unescaped(value: Column) -> Column:
    """Escapes of N-Triples, which are those of JSON but for \\' and \\U; a wrong one is an error."""
    # an escaped backslash first, so that what follows it is not taken for an escape
    plain = F.regexp_replace(F.regexp_replace(value, r"\\\\", r"\\u005C"), r"\\'", "'")
    wrong = F.raise_error(F.concat(F.lit("Illegal escape: "), value)).cast("string")

    def wide(rest: Column) -> Column:
        """What stood behind \\U, with its eight digits as one or two escapes of JSON."""
        code = F.conv(F.substring(rest, 1, 8), 16, 10).cast("long")
        four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.hex(n), 4, "0"))
        low = code - 0x10000
        both = F.concat(four(F.lit(0xD800) + F.shiftright(low, 10)), four(F.lit(0xDC00) + low.bitwiseAND(F.lit(0x3FF))))
        made = F.when(code < 0x10000, four(code)).when(code <= 0x10FFFF, both)
        return F.concat(F.when(rest.rlike("^[0-9A-Fa-f]{8}"), made), F.substring(rest, 9, 1 << 30))

    parts = F.split(plain, r"\\U")
    json = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.coalesce(wide(x), F.lit("\\!"))), ""))
    parsed = F.from_json(F.concat(F.lit('{"v":"'), json, F.lit('"}')), "v string", {"allowUnquotedControlChars": "true"})["v"]
    return F.when(value.contains("\\"), F.coalesce(parsed, wrong)).otherwise(value)


def _term(text: Column, scope: Column) -> Column:
    inner = F.regexp_extract(text, r'^"((?:[^"\\]|\\.)*)"', 1)
    lang, datatype = F.nullif(F.regexp_extract(text, r'"@([A-Za-z0-9-]+)$', 1), F.lit("")), F.nullif(F.regexp_extract(text, r'"\^\^<([^>]*)>$', 1), F.lit(""))
    return (
        F.when(text.startswith("<"), term("iri", _unescaped(text.substr(F.lit(2), F.length(text) - 2))))
        .when(text.startswith("_:"), term("bnode", F.concat(scope, F.substring(text, 3, 1 << 30))))
        .when(text.startswith('"'), term("literal", _unescaped(inner), datatype, F.lower(lang)))
        .otherwise(default_graph())
    )


def parse_lines(lines: DataFrame, file: Column | int = 0) -> DataFrame:
    """Rows (value, line), line a rising number, as quads. Blank and comment lines count for nothing, others that are
    no statement are an error."""
    scope = F.concat(F.lit("b"), (F.lit(file) if isinstance(file, int) else file).cast("string"), F.lit("_"))
    rows = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    parts = [F.regexp_extract("value", _LINE, i) for i in range(1, 5)]
    wrong = F.raise_error(F.concat(F.lit("Not a statement: "), F.col("value"))).cast("string")
    subject = F.when(F.col("value").rlike(_LINE), parts[0]).otherwise(wrong)
    seq = F.array((F.lit(file) if isinstance(file, int) else file).cast("long"), F.col("line"))
    terms = [_term(x, scope).alias(c) for x, c in zip([subject, *parts[1:]], "spog", strict=True)]
    return rows.select(seq.alias("seq"), *terms)


class TurtleParser:
    """Quads of a Turtle or TriG document."""

    _TOKEN = re.compile(
        r"""(?P<blank>[\s]+|\#[^\n\r]*)
        |(?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
        |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
        |(?P<iri><[^\x00-\x20<>"{}|^`]*>)
        |(?P<directive>@(?:prefix|base)\b)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<typed>\^\^)
        |(?P<bnode>_:[\w\u00B7-\uFFFD](?:[\w.\-\u00B7-\uFFFD]*[\w\-\u00B7-\uFFFD])?)
        |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
        |(?P<name>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
        |(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]\(\)\{\}])""",
        re.X | re.S,
    )
    _ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)

    def __init__(self, text: str, base: str = "", scope: str = ""):
        self.base, self.scope, self.prefixes, self.made, self.out, self.graph = base, scope, {}, 0, [], ("default", "", None, None)
        self.tokens, at = [], 0
        while at < len(text):
            m = self._TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected text in Turtle: {text[at : at + 40]!r}")
            if m.lastgroup != "blank":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def _next(self) -> tuple[str, str]:
        token = self._peek()
        self.at += 1
        return token

    def _expect(self, mark: str) -> None:
        if (t := self._next())[1] != mark:
            raise ValueError(f"expected {mark!r} in Turtle, found {t[1]!r}")

    def _text(self, raw: str) -> str:
        plain = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
        return self._ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else plain.get(m[3], m[3]), raw)

    def _resolve(self, value: str) -> str:
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value) or not self.base:
            return value
        return self.base.split("#")[0] + value if value[:1] in ("", "#") else urljoin(self.base, value)

    def _fresh(self) -> tuple:
        self.made += 1
        return ("bnode", f"{self.scope}n{self.made}", None, None)

    def _emit(self, s, p, o) -> None:
        self.out.append((s, p, o, self.graph))

    def parse(self) -> list[tuple]:
        while self._peek()[0] != "end":
            kind, value = self._peek()
            word = value.lower()
            if kind == "directive" or kind == "word" and word in ("prefix", "base"):
                self._next()
                if word.endswith("prefix"):
                    name = self._next()[1]
                    self.prefixes[name[:-1]] = self._resolve(self._text(self._next()[1][1:-1]))
                else:
                    self.base = self._resolve(self._text(self._next()[1][1:-1]))
                if kind == "directive":
                    self._expect(".")
            elif value == "{" or kind == "word" and word == "graph":
                if word == "graph":
                    self._next()
                    self.graph = self._term()
                self._block()
            else:
                before = self.at
                if kind in ("iri", "name", "bnode"):
                    self._next()
                    if self._peek()[1] == "{":
                        self.at = before
                        self.graph = self._term()
                        self._block()
                        continue
                    self.at = before
                self._statement()
                self._expect(".")
        return self.out

    def _block(self) -> None:
        self._expect("{")
        while self._peek()[1] != "}":
            self._statement()
            if self._peek()[1] == ".":
                self._next()
        self._expect("}")
        self.graph = ("default", "", None, None)

    def _statement(self) -> None:
        lone = self._peek()[1] == "["
        subject = self._term()
        if not (lone and self._peek()[1] in (".", "}")):
            self._predicates(subject)

    def _predicates(self, subject) -> None:
        while True:
            kind, value = self._peek()
            if kind == "word" and value == "a":
                self._next()
                predicate = ("iri", RDF_TYPE, None, None)
            else:
                predicate = self._term()
            while True:
                self._emit(subject, predicate, self._term())
                if self._peek()[1] != ",":
                    break
                self._next()
            while self._peek()[1] == ";":
                self._next()
                if self._peek()[1] not in (";", ".", "]", "}"):
                    break
            else:
                return

    def _term(self) -> tuple:
        kind, value = self._next()
        if kind == "iri":
            return ("iri", self._resolve(self._text(value[1:-1])), None, None)
        if kind == "name":
            prefix, local = value.split(":", 1)
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix in Turtle: {prefix!r}")
            return ("iri", self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), None, None)
        if kind == "bnode":
            return ("bnode", self.scope + value[2:], None, None)
        if kind in ("string", "long"):
            text = self._text(value[3:-3] if kind == "long" else value[1:-1])
            if self._peek()[0] == "lang":
                return ("literal", text, None, self._next()[1][1:].lower())
            if self._peek()[0] == "typed":
                self._next()
                return ("literal", text, self._term()[1], None)
            return ("literal", text, None, None)
        if kind == "number":
            return ("literal", value, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None)
        if kind == "word" and value in ("true", "false"):
            return ("literal", value, XSD + "boolean", None)
        if value == "[":
            node = self._fresh()
            if self._peek()[1] != "]":
                self._predicates(node)
            self._expect("]")
            return node
        if value == "(":
            ns, first, last = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", None, None
            while self._peek()[1] != ")":
                node, item = self._fresh(), self._term()
                if last:
                    self._emit(last, ("iri", ns + "rest", None, None), node)
                self._emit(node, ("iri", ns + "first", None, None), item)
                first, last = first or node, node
            self._next()
            nil = ("iri", ns + "nil", None, None)
            if last:
                self._emit(last, ("iri", ns + "rest", None, None), nil)
            return first or nil
        raise ValueError(f"unexpected {value!r} in Turtle")


#: Parsers of whole documents by file extension.
DOCUMENTS = dict.fromkeys(("ttl", "turtle", "trig", "n3"), TurtleParser) | PARSERS


def _parse_documents(base: str | None, file: int, parser: type):
    kind = pa.struct([(c, pa.string()) for c in ("kind", "value", "datatype", "lang")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                quads = parser(content.decode(), base or path, f"b{file}_").parse()
                names = ("kind", "value", "datatype", "lang")
                for k in range(0, len(quads), 10_000):
                    some = quads[k : k + 10_000]
                    columns = [pa.array([dict(zip(names, q[i], strict=True)) for q in some], kind) for i in range(4)]
                    yield pa.record_batch([pa.array([[file, k + j] for j in range(len(some))], pa.list_(pa.int64())), *columns], ["seq", *"spog"])

    return parse


@component("QuadSourceFile")
@dataclass
class FileSource:
    """Quads of an RDF file, its syntax told by the extension (.gz and such in front for line formats). base_iri resolves
    relative IRIs, by default the file's own."""

    file_path: str
    base_iri: str | None = None

    def read(self, spark: SparkSession, file: int = 0) -> DataFrame:
        extension = re.sub(r"\.(gz|bz2|zst)$", "", self.file_path.lower()).rsplit(".", 1)[-1]
        if extension in LINES:
            # one task's ids rise, and tasks take a file's splits in order
            return parse_lines(spark.read.text(self.file_path).withColumn("line", F.monotonically_increasing_id()), file)
        if extension in DOCUMENTS:
            files = spark.read.format("binaryFile").load(self.file_path).select("path", "content")
            return files.mapInArrow(_parse_documents(self.base_iri, file, DOCUMENTS[extension]), QUAD)
        raise ValueError(f"no parser for files ending in .{extension}: {', '.join([*LINES, *DOCUMENTS])}")


@component("QuadSourceComposite")
@dataclass
class CompositeSource:
    """Quads of all sources, each source's after those of the ones before; none is empty. Nothing is removed."""

    sources: list[FileSource]

    def read(self, spark: SparkSession, file: int = 0) -> DataFrame:
        parts, n = [], file
        for source in self.sources:
            parts.append(source.read(spark, n))
            n += _files(source)
        return reduce(DataFrame.unionByName, parts) if parts else empty_quads(spark)


def _files(source) -> int:
    return sum(map(_files, source.sources)) if isinstance(source, CompositeSource) else 1


@component("QuadSourceTable")
@dataclass
class TableSource:
    """Quads of a Parquet table with the columns seq, s, p, o and g."""

    path: str

    def read(self, spark: SparkSession, file: int = 0) -> DataFrame:
        return spark.read.schema(QUAD).parquet(self.path)

