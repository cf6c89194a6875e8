"""Parsers of whole documents beside Turtle: RDF/XML, JSON-LD, and both JSON-LD and RDFa in HTML.

Each takes (text, base, scope) and has parse(), which returns quads as tuples of terms (kind, value, datatype, lang);
scope stands in front of the labels of blank nodes. Nothing is fetched: a remote JSON-LD context is an error.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

from ..functions.terms import RDF_TYPE, XSD

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_XML = "{http://www.w3.org/XML/1998/namespace}"


def iri(value: str) -> tuple:
    return ("iri", value, None, None)


def literal(value: str, datatype: str | None = None, lang: str | None = None) -> tuple:
    return ("literal", value, None if lang else datatype, lang.lower() if lang else None)


def resolve(value: str, base: str) -> str:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value) or not base:
        return value
    return base.split("#")[0] + value if value[:1] in ("", "#") else urljoin(base, value)


class _Parser:
    def __init__(self, text: str, base: str = "", scope: str = ""):
        self.text, self.base, self.scope, self.made, self.out, self.graph = text, base, scope, 0, [], ("default", "", None, None)

    def fresh(self) -> tuple:
        self.made += 1
        return ("bnode", f"{self.scope}n{self.made}", None, None)

    def bnode(self, label: str) -> tuple:
        return ("bnode", self.scope + label, None, None)

    def emit(self, s: tuple, p: str, o: tuple) -> None:
        self.out.append((s, iri(p), o, self.graph))

    def emit_list(self, items: list[tuple]) -> tuple:
        nodes = [self.fresh() for _ in items] + [iri(RDF + "nil")]
        for node, item, after in zip(nodes[:-1], items, nodes[1:], strict=True):
            self.emit(node, RDF + "first", item)
            self.emit(node, RDF + "rest", after)
        return nodes[0]


class RdfXmlParser(_Parser):
    """RDF/XML: node and property elements, all parse types, reification by rdf:ID, xml:base and xml:lang."""

    _NOT_PROPERTIES = tuple(f"{{{RDF}}}{x}" for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType"))

    def parse(self) -> list[tuple]:
        root = ElementTree.fromstring(self.text.encode())
        if root.tag == f"{{{RDF}}}RDF":
            base, lang = self._scope(root, self.base, None)
            for child in root:
                self._node(child, base, lang)
        else:
            self._node(root, self.base, None)
        return self.out

    @staticmethod
    def _scope(x, base: str, lang: str | None) -> tuple[str, str | None]:
        own = x.get(_XML + "base")
        return resolve(own, base) if own is not None else base, x.get(_XML + "lang", lang) or None

    @staticmethod
    def _name(tag: str) -> str:
        if not tag.startswith("{"):
            raise ValueError(f"a name without namespace in RDF/XML: {tag}")
        return tag[1:].replace("}", "", 1)

    def _attributes(self, x, s: tuple, lang: str | None, base: str) -> None:
        for key, value in x.attrib.items():
            if key.startswith(_XML) or key in self._NOT_PROPERTIES or not key.startswith("{"):
                continue
            p = self._name(key)
            self.emit(s, p, iri(resolve(value, base)) if p == RDF_TYPE else literal(value, None, lang))

    def _node(self, x, base: str, lang: str | None) -> tuple:
        base, lang = self._scope(x, base, lang)
        about, id_, label = (x.get(f"{{{RDF}}}{k}") for k in ("about", "ID", "nodeID"))
        s = iri(resolve(about, base)) if about is not None else iri(resolve("#" + id_, base)) if id_ is not None else self.bnode(label) if label is not None else self.fresh()
        if x.tag != f"{{{RDF}}}Description":
            self.emit(s, RDF_TYPE, iri(self._name(x.tag)))
        self._attributes(x, s, lang, base)
        self._properties(x, s, base, lang)
        return s

    def _properties(self, x, s: tuple, base: str, lang: str | None) -> None:
        n = 0
        for child in x:
            p = self._name(child.tag)
            if p == RDF + "li":
                n += 1
                p = f"{RDF}_{n}"
            own_base, own_lang = self._scope(child, base, lang)
            o = self._object(child, own_base, own_lang)
            self.emit(s, p, o)
            if (id_ := child.get(f"{{{RDF}}}ID")) is not None:
                statement = iri(resolve("#" + id_, own_base))
                self.emit(statement, RDF_TYPE, iri(RDF + "Statement"))
                for part, value in (("subject", s), ("predicate", iri(p)), ("object", o)):
                    self.emit(statement, RDF + part, value)

    def _object(self, x, base: str, lang: str | None) -> tuple:
        kind, resource, label, datatype = (x.get(f"{{{RDF}}}{k}") for k in ("parseType", "resource", "nodeID", "datatype"))
        if kind == "Resource":
            node = self.fresh()
            self._properties(x, node, base, lang)
            return node
        if kind == "Collection":
            return self.emit_list([self._node(child, base, lang) for child in x])
        if kind is not None:
            return literal((x.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in x), RDF + "XMLLiteral")
        if len(x):
            if len(x) > 1:
                raise ValueError(f"more than one node in the RDF/XML property {x.tag}")
            return self._node(x[0], base, lang)
        others = [k for k in x.attrib if k.startswith("{") and not k.startswith(_XML) and k not in self._NOT_PROPERTIES]
        if resource is not None or label is not None or others:
            node = iri(resolve(resource, base)) if resource is not None else self.bnode(label) if label is not None else self.fresh()
            self._attributes(x, node, lang, base)
            return node
        return literal(x.text or "", resolve(datatype, base) if datatype else None, None if datatype else lang)


class _Context:
    """An active JSON-LD context."""

    def __init__(self, base: str):
        self.base, self.vocab, self.lang, self.terms = base, None, None, {}

    def copy(self) -> _Context:
        out = _Context(self.base)
        out.vocab, out.lang, out.terms = self.vocab, self.lang, dict(self.terms)
        return out

    def keyword(self, key: str) -> str:
        """The keyword that a key stands for, or the key."""
        return key if key.startswith("@") else (self.terms.get(key) or {}).get("@id") if str((self.terms.get(key) or {}).get("@id", "")).startswith("@") else key

    def name(self, value: str, vocab: bool = True) -> str | None:
        """The IRI of a term (if vocab), compact IRI, or relative reference; None for a name that means nothing."""
        if vocab and value in self.terms:
            return (self.terms[value] or {}).get("@id")
        if value.startswith("@"):
            return value
        if ":" in value[1:]:
            prefix, rest = value.split(":", 1)
            if prefix == "_" or rest.startswith("//"):
                return value
            if self.terms.get(prefix):
                return self.terms[prefix]["@id"] + rest
            return value
        if vocab:
            return self.vocab + value if self.vocab is not None else None
        return resolve(value, self.base)

    def extended(self, local, start: _Context) -> _Context:
        out = self.copy()
        for c in local if isinstance(local, list) else [local]:
            if c is None:
                out = start.copy()
                continue
            if isinstance(c, str):
                raise ValueError(f"remote JSON-LD contexts are not fetched: {c}")
            if "@base" in c:
                out.base = resolve(c["@base"], out.base) if c["@base"] is not None else ""
            if "@vocab" in c:
                out.vocab = None if c["@vocab"] is None else out.name(c["@vocab"]) or c["@vocab"]
            if "@language" in c:
                out.lang = c["@language"]
            waiting = {k: v for k, v in c.items() if not k.startswith("@")}
            for term in list(waiting):
                out._define(term, waiting, ())
        return out

    def _define(self, term: str, waiting: dict, above: tuple) -> None:
        if term not in waiting:
            return
        if term in above:
            raise ValueError(f"a JSON-LD term that is defined by itself: {term}")
        told = waiting[term]
        told = {"@id": told} if isinstance(told, str) or told is None else dict(told)
        id_ = told.get("@reverse", told.get("@id", term))
        # what the name is made of is defined first
        for needed in {id_, str(id_).split(":", 1)[0], str(term).split(":", 1)[0], told.get("@type")}:
            if needed != term:
                self._define(needed, waiting, (*above, term))
        del waiting[term]
        self.terms.pop(term, None)
        if id_ is None:
            self.terms[term] = None
            return
        name = id_ if id_.startswith("@") else self.name(id_)
        if name is None:
            self.terms[term] = None
            return
        held = told.get("@container") or []
        kind = told.get("@type")
        self.terms[term] = {**told, "@id": name, "@container": [held] if isinstance(held, str) else held, "@type": self.name(kind) if kind else None, "reverse": "@reverse" in told}


class JsonLdParser(_Parser):
    """JSON-LD: contexts within the document (also scoped ones), coercion, containers (list, set, language, index, id, type,
    graph), reverse properties, nested and included nodes, lists, named graphs."""

    def parse(self) -> list[tuple]:
        start = _Context(self.base)
        self._any(json.loads(self.text), start, start)
        return self.out

    def _any(self, x, context: _Context, start: _Context) -> None:
        for item in x if isinstance(x, list) else [x]:
            if isinstance(item, dict):
                self._node(item, context, start)

    def _id(self, value: str, context: _Context, vocab: bool = False) -> tuple | None:
        name = context.name(value, vocab)
        if name is None:
            name = resolve(value, context.base)
        return None if name.startswith("@") else self.bnode(name[2:]) if name.startswith("_:") else iri(name)

    def _node(self, x: dict, context: _Context, start: _Context) -> tuple | None:
        if "@context" in x:
            context = context.extended(x["@context"], start)
        outer = context
        keys = [(k, context.keyword(k), v) for k, v in x.items() if k != "@context"]
        types = [t for k, w, v in keys if w == "@type" for t in (v if isinstance(v, list) else [v])]
        for t in sorted(t for t in types if isinstance(t, str)):
            if (context.terms.get(t) or {}).get("@context") is not None:
                context = context.extended(context.terms[t]["@context"], start)
        told = [v for _, w, v in keys if w == "@id"]
        whole = all(w in ("@graph", "@included") for _, w, _ in keys)
        s = self._id(told[0], outer) if told and isinstance(told[0], str) else None if whole and keys else self.fresh()
        if s is None and not whole:
            return None
        for t in types:
            if (o := self._id(t, outer, True)) is not None and o[1]:
                self.emit(s, RDF_TYPE, o)
        for key, word, value in keys:
            if word in ("@id", "@type", "@index"):
                continue
            if word == "@graph":
                before = self.graph
                self.graph = before if whole else s
                self._any(value, context, start)
                self.graph = before
            elif word == "@included":
                self._any(value, context, start)
            elif word == "@nest":
                for inner in value if isinstance(value, list) else [value]:
                    for k, v in inner.items():
                        self._property(s, k, v, context, start)
            elif word == "@reverse":
                for k, v in value.items():
                    self._property(s, k, v, context, start, True)
            elif not word.startswith("@"):
                self._property(s, key, value, context, start)
        return s

    def _property(self, s: tuple, key: str, value, context: _Context, start: _Context, turned: bool = False) -> None:
        term = context.terms.get(key) or {}
        p = context.name(key)
        if p is None or p.startswith(("@", "_:")) or ":" not in p:
            return
        if term.get("@context") is not None:
            context = context.extended(term["@context"], start)
        turned ^= bool(term.get("reverse"))
        held = term.get("@container") or []
        if "@json" == term.get("@type"):
            self.emit(s, p, literal(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False), RDF + "JSON"))
            return
        if isinstance(value, dict) and not ({"@value", "@list", "@set", "@id"} & {context.keyword(k) for k in value}):
            if "@language" in held:
                for lang, texts in value.items():
                    for t in texts if isinstance(texts, list) else [texts]:
                        if isinstance(t, str):
                            self.emit(s, p, literal(t, None, None if context.keyword(lang) == "@none" else lang))
                return
            if {"@index", "@id", "@type"} & set(held):
                value = [self._keyed(k, v, held, context) for k, many in value.items() for v in (many if isinstance(many, list) else [many])]
        if "@graph" in held:
            for item in value if isinstance(value, list) else [value]:
                self._put(s, p, self._node(item if context.keyword("@graph") in item else {"@graph": item, **({"@id": item.pop("@id")} if "@id" in item and "@index" not in held else {}), "@index": ""}, context, start), turned)
            return
        if "@list" in held and not (isinstance(value, dict) and "@list" in value):
            value = {"@list": value}
        for item in value if isinstance(value, list) else [value]:
            for o in self._objects(item, term, context, start):
                self._put(s, p, o, turned)

    def _put(self, s: tuple, p: str, o: tuple | None, turned: bool) -> None:
        if o is not None and not (turned and o[0] == "literal"):
            self.emit(o, p, s) if turned else self.emit(s, p, o)

    @staticmethod
    def _keyed(key: str, value, held: list, context: _Context):
        word = "@id" if "@id" in held else "@type" if "@type" in held else None
        if word is None or context.keyword(key) == "@none":
            return value
        value = {"@id": value} if isinstance(value, str) else dict(value)
        return {word: key, **value} if word == "@id" else {**value, "@type": [key, *([value["@type"]] if "@type" in value and isinstance(value["@type"], str) else value.get("@type", []))]}

    def _objects(self, x, term: dict, context: _Context, start: _Context) -> list[tuple]:
        if x is None:
            return []
        if isinstance(x, list):
            return [o for item in x for o in self._objects(item, term, context, start)]
        if isinstance(x, dict):
            words = {context.keyword(k): v for k, v in x.items()}
            if "@list" in words:
                items = words["@list"] if isinstance(words["@list"], list) else [words["@list"]]
                return [self.emit_list([o for item in items for o in self._objects({"@list": item} if isinstance(item, list) else item, term, context, start)])]
            if "@set" in words:
                return self._objects(words["@set"], term, context, start)
            if "@value" in words:
                if words["@value"] is None:
                    return []
                kind = words.get("@type")
                if kind == "@json":
                    return [literal(json.dumps(words["@value"], sort_keys=True, separators=(",", ":"), ensure_ascii=False), RDF + "JSON")]
                return [self._value(words["@value"], context.name(kind) if kind else None, words.get("@language"))]
            node = self._node(x, context, start)
            return [node] if node is not None else []
        kind = term.get("@type")
        if isinstance(x, str) and kind in ("@id", "@vocab"):
            node = self._id(x, context, kind == "@vocab")
            return [node] if node is not None else []
        lang = term["@language"] if "@language" in term else context.lang
        return [self._value(x, None if kind in ("@id", "@vocab", "@none") else kind, None if kind else lang)]

    @staticmethod
    def _value(x, datatype: str | None, lang: str | None) -> tuple:
        if isinstance(x, bool):
            return literal("true" if x else "false", datatype or XSD + "boolean")
        if isinstance(x, int) or isinstance(x, float) and x.is_integer() and abs(x) < 1e21 and datatype != XSD + "double":
            if datatype != XSD + "double":
                return literal(str(int(x)), datatype or XSD + "integer")
        if isinstance(x, (int, float)):
            digits, exponent = f"{x:.15E}".split("E")
            digits = digits.rstrip("0")
            return literal(f"{digits}{'0' if digits.endswith('.') else ''}E{int(exponent)}", datatype or XSD + "double")
        return literal(x, datatype, lang)


class HtmlParser(_Parser):
    """HTML: JSON-LD in script elements, and RDFa's attributes: vocab, prefix, typeof, about, resource, href, src, property, rel,
    rev, content, datatype, lang, inlist. An element's subject is that of the nearest one around it that has one."""

    _VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    #: Prefixes that every document has.
    _PREFIXES = {
        "dc": "http://purl.org/dc/terms/",
        "dcterms": "http://purl.org/dc/terms/",
        "foaf": "http://xmlns.com/foaf/0.1/",
        "og": "http://ogp.me/ns#",
        "owl": "http://www.w3.org/2002/07/owl#",
        "rdf": RDF,
        "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
        "schema": "http://schema.org/",
        "skos": "http://www.w3.org/2004/02/skos/core#",
        "xsd": XSD,
    }

    def parse(self) -> list[tuple]:
        root = {"tag": "", "attributes": {}, "children": []}
        stack, void = [root], self._VOID

        class Tree(HTMLParser):
            def handle_starttag(self, tag, attrs):
                x = {"tag": tag, "attributes": {k: v or "" for k, v in attrs}, "children": []}
                stack[-1]["children"].append(x)
                if tag not in void:
                    stack.append(x)

            def handle_startendtag(self, tag, attrs):
                stack[-1]["children"].append({"tag": tag, "attributes": {k: v or "" for k, v in attrs}, "children": []})

            def handle_endtag(self, tag):
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i]["tag"] == tag), None)
                if at:
                    del stack[at:]

            def handle_data(self, data):
                stack[-1]["children"].append(data)

        tree = Tree(convert_charrefs=True)
        tree.feed(self.text)
        tree.close()
        for x in self._every(root):
            if x["tag"] == "base" and "href" in x["attributes"]:
                self.base = resolve(x["attributes"]["href"], self.base)
                break
        self._walk(root, iri(self.base.split("#")[0]), None, dict(self._PREFIXES), None)
        for n, x in enumerate(x for x in self._every(root) if x["tag"] == "script" and x["attributes"].get("type", "").split(";")[0].strip().lower() == "application/ld+json"):
            self.out += JsonLdParser("".join(c for c in x["children"] if isinstance(c, str)), self.base, f"{self.scope}j{n}_").parse()
        return self.out

    def _every(self, x):
        yield x
        for c in x["children"]:
            if isinstance(c, dict):
                yield from self._every(c)

    def _text(self, x) -> str:
        return "".join(c if isinstance(c, str) else self._text(c) for c in x["children"])

    def _name(self, word: str, vocab: str | None, prefixes: dict) -> str | None:
        if ":" in word:
            prefix, rest = word.split(":", 1)
            return prefixes[prefix.lower()] + rest if prefix.lower() in prefixes and not rest.startswith("//") else word
        return vocab + word if vocab else None

    def _term(self, value: str, prefixes: dict) -> tuple:
        value = value.strip()
        if value[:1] == "[" and value[-1:] == "]":
            value = value[1:-1]
        if value.startswith("_:"):
            return self.bnode(value[2:] or "e")
        prefix = value.split(":", 1)[0].lower()
        if ":" in value and prefix in prefixes and not value.split(":", 1)[1].startswith("//"):
            return iri(prefixes[prefix] + value.split(":", 1)[1])
        return iri(resolve(value, self.base))

    def _walk(self, x: dict, subject: tuple, vocab: str | None, prefixes: dict, lang: str | None) -> None:
        a = x["attributes"]
        vocab = a["vocab"] or None if "vocab" in a else vocab
        if "prefix" in a:
            pairs = a["prefix"].split()
            prefixes = prefixes | {k.rstrip(":").lower(): v for k, v in zip(pairs[::2], pairs[1::2], strict=False)}
        lang = a.get("lang", a.get("xml:lang", lang)) or None
        names = lambda key: [n for w in a.get(key, "").split() if (n := self._name(w, vocab, prefixes))]
        target = next((self._term(a[k], prefixes) for k in ("resource", "href", "src") if k in a), None)
        properties, rels, revs = names("property"), names("rel") if "property" not in a or ":" in a.get("rel", "") else [], names("rev")
        inner = subject
        if "about" in a:
            inner = subject = self._term(a["about"], prefixes)
        if "typeof" in a:
            typed = subject if "about" in a else target or self.fresh()
            for t in names("typeof"):
                self.emit(typed, RDF_TYPE, iri(t))
            inner = typed
        elif "resource" in a and (properties or rels or revs or "about" not in a):
            inner = target
        elif (rels or revs) and target:
            inner = target
        for p in rels:
            if target or "typeof" in a:
                self.emit(subject, p, target or inner)
        for p in revs:
            if target or "typeof" in a:
                self.emit(target or inner, p, subject)
        if properties and not (rels or revs):
            if "content" in a or "datatype" in a:
                kind = self._name(a["datatype"], vocab, prefixes) if a.get("datatype") else None
                o = literal(a["content"] if "content" in a else self._text(x), kind, None if kind else lang)
            elif target is not None and "about" not in a or target is not None and "typeof" not in a:
                o = target
            elif "typeof" in a and "about" not in a:
                o = inner
            elif x["tag"] == "time":
                o = literal(a.get("datetime", self._text(x)))
            else:
                o = literal(self._text(x), None, lang)
            for p in properties:
                self.emit(subject, p, o)
        for c in x["children"]:
            if isinstance(c, dict):
                self._walk(c, inner, vocab, prefixes, lang)


#: By file extension.
PARSERS = {x: p for p, names in ((RdfXmlParser, "rdf rdfxml owl xml"), (JsonLdParser, "jsonld json"), (HtmlParser, "html htm xhtml xht")) for x in names.split()}
