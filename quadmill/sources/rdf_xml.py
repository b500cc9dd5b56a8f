"""RDF/XML and TriX documents to quads of canonical terms, over expat."""

from __future__ import annotations

import re
from xml.etree import ElementTree as ET
from xml.parsers import expat

from ..functions.iri import resolve_text
from ..plans.sparql_parser import CHARS, LETTER, RDF, XSD, fold_tag, quote
from .rdf_text import FIRST, NIL, REST, TYPE, Quad, RdfError

XML = "http://www.w3.org/XML/1998/namespace"
#: Names of the RDF namespace that can't be used as nodes or as properties.
NOT_NODES = {"RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype", "li", "aboutEach", "aboutEachPrefix", "bagID"}
NOT_PROPERTIES = {"RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype", "Description", "aboutEach", "aboutEachPrefix", "bagID"}
NAME = re.compile(rf"^[{LETTER}_](?:[{CHARS}.])*$")
SYNTAX = {"ID", "about", "parseType", "resource", "nodeID", "datatype", "aboutEach", "aboutEachPrefix", "bagID", "RDF"}


class Node:
    """An element with resolved names: (namespace, local) of itself and its attributes."""

    def __init__(self, name, attributes, at):
        self.name, self.attributes, self.at = name, attributes, at
        self.items: list = []  # text and elements

    @property
    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]

    @property
    def text(self) -> str:
        return "".join(x for x in self.items if isinstance(x, str))


def tree(content: bytes) -> Node:
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    top = Node(("", ""), {}, 0)
    stack = [top]

    def split(name: str) -> tuple[str, str]:
        ns, _, local = name.rpartition(" ")
        return ns, local

    def start(name, attributes):
        node = Node(split(name), {split(k): v for k, v in attributes.items()}, parser.CurrentByteIndex)
        stack[-1].items.append(node)
        stack.append(node)

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda name: stack.pop()
    parser.CharacterDataHandler = lambda data: stack[-1].items.append(data)
    try:
        parser.Parse(content, True)
    except expat.ExpatError as e:
        raise RdfError("RDFXML-SYNTAX-001", str(e), parser.CurrentByteIndex) from e
    return top.children[0]


class XmlParser:
    def __init__(self, content: bytes, base: str | None = None):
        self.root, self.base = tree(content), base
        self.out: list[Quad] = []
        self.n = 0
        self.ids: set[str] = set()

    def fail(self, node: Node, message: str):
        raise RdfError("RDFXML-SYNTAX-001", message, node.at)

    def fresh(self) -> str:
        self.n += 1
        return f"_:.{self.n}"

    def emit(self, s: str, p: str, o: str) -> None:
        self.out.append((s, p, o, None))

    def iri(self, base: str | None, value: str) -> str:
        return f"<{resolve_text(base, value) if base else value}>"

    def name_iri(self, node: Node, name: tuple[str, str]) -> str:
        if not name[0]:
            self.fail(node, "a name without a namespace")
        return f"<{name[0]}{name[1]}>"

    def scope(self, node: Node, base: str | None, lang: str | None) -> tuple[str | None, str | None]:
        if (own := node.attributes.get((XML, "base"))) is not None:
            base = resolve_text(base, own).split("#")[0] if base else own.split("#")[0]
        return base, node.attributes.get((XML, "lang"), lang)

    def literal(self, text: str, lang: str | None) -> str:
        return quote(text) + (f"@{fold_tag(lang)}" if lang else "")

    def new_id(self, node: Node, base: str | None, value: str) -> str:
        made = self.iri(base, "#" + value)
        if made in self.ids:
            self.fail(node, f"rdf:ID {value!r} is used twice")
        self.name(node, value)
        self.ids.add(made)
        return made

    def name(self, node: Node, value: str) -> str:
        if not NAME.match(value):
            self.fail(node, f"{value!r} is no name")
        return value

    def parse(self) -> list[Quad]:
        base, lang = self.scope(self.root, self.base, None)
        if self.root.name == (RDF, "RDF"):
            for node in self.root.children:
                self.node(node, base, lang)
        else:
            self.node(self.root, self.base, None)
        return self.out

    def plain_attributes(self, node: Node) -> dict[tuple[str, str], str]:
        out = {}
        for (ns, local), v in node.attributes.items():
            if ns in (XML, "") or (ns == RDF and local in SYNTAX):
                continue
            if ns == RDF and local == "li":
                self.fail(node, "rdf:li as an attribute")
            out[ns, local] = v
        return out

    def node(self, node: Node, base: str | None, lang: str | None) -> str:
        base, lang = self.scope(node, base, lang)
        if node.name[0] == RDF and node.name[1] in NOT_NODES:
            self.fail(node, f"rdf:{node.name[1]} as a node")
        own = {k: node.attributes[RDF, k] for k in ("about", "ID", "nodeID") if (RDF, k) in node.attributes}
        if len(own) > 1:
            self.fail(node, "more than one of rdf:about, rdf:ID and rdf:nodeID")
        for bad in ("aboutEach", "aboutEachPrefix", "bagID", "resource", "datatype", "parseType"):
            if (RDF, bad) in node.attributes:
                self.fail(node, f"rdf:{bad} on a node")
        if "about" in own:
            s = self.iri(base, own["about"])
        elif "ID" in own:
            s = self.new_id(node, base, own["ID"])
        else:
            s = f"_:{self.name(node, own['nodeID'])}" if "nodeID" in own else self.fresh()
        if node.name != (RDF, "Description"):
            self.emit(s, TYPE, self.name_iri(node, node.name))
        for name, v in self.plain_attributes(node).items():
            if name == (RDF, "type"):
                self.emit(s, TYPE, self.iri(base, v))
            else:
                self.emit(s, self.name_iri(node, name), self.literal(v, lang))
        if any(isinstance(x, str) and x.strip() for x in node.items):
            self.fail(node, "text inside a node")
        n = 0
        for child in node.children:
            if child.name == (RDF, "li"):
                n += 1
                p = f"<{RDF}_{n}>"
            else:
                if child.name[0] == RDF and child.name[1] in NOT_PROPERTIES:
                    self.fail(child, f"rdf:{child.name[1]} as a property")
                p = self.name_iri(child, child.name)
            self.property(s, p, child, base, lang)
        return s

    def property(self, s: str, p: str, node: Node, base: str | None, lang: str | None) -> None:
        base, lang = self.scope(node, base, lang)
        get = lambda k: node.attributes.get((RDF, k))
        kind = get("parseType")
        if sum(get(k) is not None for k in ("resource", "nodeID", "parseType", "datatype")) > 1:
            self.fail(node, "attributes that exclude each other")
        children = node.children
        if kind == "Resource":
            o = self.fresh()
            inner = Node((RDF, "Description"), {}, node.at)
            inner.items = node.items
            self.emit(s, p, o)
            self.inside(o, inner, base, lang)
        elif kind == "Collection":
            items = [self.node(c, base, lang) for c in children]
            nodes = [self.fresh() for _ in items]
            o = nodes[0] if nodes else NIL
            self.emit(s, p, o)
            for at, item, rest in zip(nodes, items, [*nodes[1:], NIL], strict=False):
                self.emit(at, FIRST, item)
                self.emit(at, REST, rest)
        elif kind is not None:
            o = f"{quote(self.all_text(node))}^^<{RDF}XMLLiteral>"
            self.emit(s, p, o)
        elif get("resource") is not None or get("nodeID") is not None or (self.plain_attributes(node) and not children):
            o = self.iri(base, get("resource")) if get("resource") is not None else f"_:{self.name(node, get('nodeID'))}" if get("nodeID") is not None else self.fresh()
            self.emit(s, p, o)
            for name, v in self.plain_attributes(node).items():
                self.emit(o, TYPE if name == (RDF, "type") else self.name_iri(node, name), self.iri(base, v) if name == (RDF, "type") else self.literal(v, lang))
        elif children:
            if len(children) > 1 or any(isinstance(x, str) and x.strip() for x in node.items):
                self.fail(node, "more than one thing inside a property")
            o = self.node(children[0], base, lang)
            self.emit(s, p, o)
        else:
            datatype = get("datatype")
            if datatype is not None:
                kind_iri = self.iri(base, datatype)
                o = quote(node.text) + ("" if kind_iri == f"<{XSD}string>" else f"^^{kind_iri}")
            else:
                o = self.literal(node.text, lang)
            self.emit(s, p, o)
        if get("ID") is not None:
            r = self.new_id(node, base, get("ID"))
            for name, v in (("type", f"<{RDF}Statement>"), ("subject", s), ("predicate", p), ("object", o)):
                self.emit(r, f"<{RDF}{name}>", v)

    def inside(self, s: str, node: Node, base: str | None, lang: str | None) -> None:
        n = 0
        for child in node.children:
            if child.name == (RDF, "li"):
                n += 1
                self.property(s, f"<{RDF}_{n}>", child, base, lang)
            else:
                self.property(s, self.name_iri(child, child.name), child, base, lang)

    def all_text(self, node: Node) -> str:
        """The literal's text; tags of inner elements are opened without attributes and not closed."""
        return "".join(x if isinstance(x, str) else f"<{x.name[1]}>" + self.all_text(x) for x in node.items)


def parse_rdf_xml(content: bytes, base: str | None = None) -> list[Quad]:
    return XmlParser(content, base).parse()


def parse_trix(content: bytes) -> list[Quad]:
    """graph elements with an optional name and triples of three terms."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        raise RdfError("TRIX-SYNTAX-001", str(e), 0) from e
    local = lambda e: e.tag.rpartition("}")[2]
    if local(root) not in ("TriX", "trix"):
        raise RdfError("TRIX-SYNTAX-001", "the root is no TriX", 0)

    def term(e: ET.Element) -> str:
        text = e.text or ""
        kind = local(e)
        if kind == "uri":
            return f"<{text.strip()}>"
        if kind == "id":
            return f"_:{text.strip()}"
        if kind == "plainLiteral":
            lang = e.get(f"{{{XML}}}lang")
            return quote(text) + (f"@{fold_tag(lang)}" if lang else "")
        if kind == "typedLiteral":
            datatype = e.get("datatype")
            if not datatype:
                raise RdfError("TRIX-SYNTAX-001", "a typed literal without a datatype", 0)
            return quote(text) + ("" if datatype == XSD + "string" else f"^^<{datatype}>")
        raise RdfError("TRIX-SYNTAX-001", f"unexpected {kind}", 0)

    out: list[Quad] = []
    for graph in root:
        if local(graph) != "graph":
            raise RdfError("TRIX-SYNTAX-001", f"unexpected {local(graph)}", 0)
        name = None
        for n, e in enumerate(graph):
            if local(e) == "triple":
                terms = [term(x) for x in e]
                if len(terms) != 3 or terms[0].startswith('"') or not terms[1].startswith("<"):
                    raise RdfError("TRIX-SYNTAX-001", "a triple of other than three fit terms", 0)
                out.append((*terms, name))
            elif n == 0:
                name = term(e)
            else:
                raise RdfError("TRIX-SYNTAX-001", f"unexpected {local(e)}", 0)
    return out
