"""N-Triples, N-Quads, Turtle, TriG and Notation3 documents to quads of canonical terms, in plain Python.

One document is parsed as a whole, by one worker; the first error rejects it.
"""

from __future__ import annotations

import re

from ..functions.iri import resolve_text
from ..plans.sparql_parser import CHARS, LETTER, LOCAL, PN, RDF, XSD, fold_tag, quote

Quad = tuple[str, str, str, str | None]
TYPE, FIRST, REST, NIL = (f"<{RDF}{x}>" for x in ("type", "first", "rest", "nil"))
IMPLIES = "<http://www.w3.org/2000/10/swap/log#implies>"
SAME = "<http://www.w3.org/2002/07/owl#sameAs>"


class RdfError(ValueError):
    def __init__(self, code: str, message: str, at: int):
        super().__init__(f"{code}: {message} at {at}")
        self.code, self.at = code, at


UCHAR = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
BODY = r"(?:[^{0}\\\r\n]|\\.)*"
TOKEN = re.compile(
    rf"""(?P<skip>(?:[ \t\r\n]+|\#[^\r\n]*)+)
    |(?P<iri><(?:[^\x00-\x20<>"{{}}|^`\\]|{UCHAR})*>)
    |(?P<str>'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'(?:[^'\\\r\n]|\\[^\r\n])*'|"(?:[^"\\\r\n]|\\[^\r\n])*")
    |(?P<word>@(?:prefix|base|keywords|forAll|forSome)\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bnode>_:[{LETTER}_0-9](?:[{CHARS}.]*[{CHARS}])?)
    |(?P<num>[+-]?(?:(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<pname>(?:{PN})?:(?:{LOCAL})?)
    |(?P<var>\?[A-Za-z_][A-Za-z0-9_]*)
    |(?P<name>[A-Za-z][A-Za-z0-9_\-]*)
    |(?P<op>\^\^|=>|<=|[{{}}()\[\].;,=^!])""",
    re.X | re.S,
)
# Plain statements, which one match takes whole: no escapes, no comments, no brackets.
NAME = r'<[^\x00-\x20<>"{}|^`\\]*>|(?:[A-Za-z][A-Za-z0-9_\-]*)?:[A-Za-z0-9_][A-Za-z0-9_\-]*'
LABEL, GAP = r"_:[A-Za-z0-9_][A-Za-z0-9_\-]*", r"[ \t\r\n]+"
VALUE = rf'(?:(?P<o>{NAME}|{LABEL})|(?P<lex>"[^"\\\r\n]*")(?:\^\^(?P<kind>{NAME})|@(?P<tag>[A-Za-z]+(?:-[A-Za-z0-9]+)*))?|(?P<int>[+-]?[0-9]+)(?=[ \t\r\n]))[ \t\r\n]*(?P<stop>[.;,])(?=[ \t\r\n]|\Z)[ \t\r\n]*'
PAIR = rf"(?P<p>a|{NAME}){GAP}{VALUE}"
WHOLE, MORE = re.compile(rf"(?P<s>{NAME}|{LABEL}){GAP}{PAIR}"), {";": re.compile(PAIR), ",": re.compile(VALUE)}
# Declarations of the usual form: an absolute IRI, no escapes, no comments.
DECLARED = re.compile(rf'@prefix{GAP}(?P<name>(?:[A-Za-z][A-Za-z0-9_\-]*)?):[ \t\r\n]*<(?P<iri>[A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20<>"{{}}|^`\\]*)>[ \t\r\n]*\.(?=[ \t\r\n]|\Z)[ \t\r\n]*')
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")
NEVER = re.compile(r'[\x00-\x20<>"{}|^`\\]')


class TextParser:
    """format: nt, nq, ttl, trig or n3."""

    def __init__(self, text: str, format: str, base: str | None = None):
        self.warnings: list[str] = []
        if text.startswith("﻿"):
            text = text[1:]
            self.warnings.append("ANY-BOM-001: byte order mark skipped")
        self.text, self.format, self.base = text, format, base
        self.lines = format in ("nt", "nq")
        self.code = {"nt": "NT", "nq": "NT", "ttl": "TTL", "trig": "TRIG", "n3": "N3"}[format]
        self.prefixes: dict[str, str] = {}
        self.out: list[Quad] = []
        self.graph: str | None = None
        self.fresh_n = 0
        self.labels: dict[str, str] = {}
        self.names: dict[str, str] = {}
        self.at, self.kind, self.tok = 0, "", ""
        self.end = 0
        self.advance()

    # -- tokens
    def advance(self) -> None:
        self.newline = False
        while True:
            if self.end >= len(self.text):
                self.kind, self.tok, self.at = "end", "", len(self.text)
                return
            m = TOKEN.match(self.text, self.end)
            if not m:
                raise RdfError(f"{self.code}-SYNTAX-001", f"unexpected {self.text[self.end]!r}", self.end)
            self.end = m.end()
            if m.lastgroup == "skip":
                self.newline = self.newline or "\n" in m[0] or "\r" in m[0]
                continue
            self.kind, self.tok, self.at = m.lastgroup, m[0], m.start()
            return

    def fail(self, message: str, code: str = "SYNTAX"):
        raise RdfError(f"{self.code}-{code}-001", message, self.at)

    def op(self, *texts: str) -> str | None:
        if self.kind == "op" and self.tok in texts:
            found = self.tok
            self.advance()
            return found
        return None

    def need(self, text: str) -> None:
        if not self.op(text):
            self.fail(f"expected {text!r}, found {self.tok!r}")

    # -- terms
    def unescape(self, text: str, uchar_only: bool = False) -> str:
        if "\\" not in text:
            return text

        def one(m: re.Match) -> str:
            if m[3] is not None:
                if uchar_only or m[3] not in ESCAPES:
                    self.fail(f"unknown escape \\{m[3]}", "LITESC")
                return ESCAPES[m[3]]
            n = int(m[1] or m[2], 16)
            if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF:
                self.fail("no such code point", "LITESC")
            return chr(n)

        return ESCAPE.sub(one, text)

    def iri_value(self, token: str) -> str:
        value = self.unescape(token[1:-1], True)
        if NEVER.search(value):
            self.fail("a character that no IRI may hold", "IRI")
        if ABSOLUTE.match(value):
            return value
        if self.lines:
            self.fail("a relative IRI", "IRI")
        if self.base is None:
            self.fail("a relative IRI without a base", "BASE")
        return resolve_text(self.base, value)

    def iri(self) -> str | None:
        if self.kind == "iri":
            value = self.iri_value(self.tok)
            self.advance()
            return f"<{value}>"
        if self.kind == "pname" and not self.lines:
            prefix, _, local = self.tok.partition(":")
            if prefix not in self.prefixes:
                if self.format == "n3" and prefix == "" and self.base:
                    self.prefixes[""] = self.base + "#"
                else:
                    self.fail(f"undeclared prefix {prefix!r}", "PFX")
            self.advance()
            return "<" + self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local) + ">"
        return None

    def fresh(self) -> str:
        self.fresh_n += 1
        return f"_:.{self.fresh_n}"

    def bnode(self) -> str | None:
        if self.kind == "bnode":
            label = self.tok
            if self.lines and ":" in label[2:]:
                self.fail("a colon in a label")
            self.advance()
            return label
        return None

    def literal(self) -> str | None:
        if self.kind == "str":
            token = self.tok
            if self.lines and (token[0] == "'" or token[:3] == '"""'):
                self.fail("a quoting that is not of this format")
            n = 3 if len(token) >= 6 and token[:3] in ('"""', "'''") else 1
            value = self.unescape(token[n:-n])
            self.advance()
            if self.kind == "lang":
                tag = fold_tag(self.tok[1:])
                self.advance()
                return f"{quote(value)}@{tag}"
            if self.op("^^"):
                datatype = self.iri() or self.fail("expected a datatype")
                return quote(value) + ("" if datatype == f"<{XSD}string>" else f"^^{datatype}")
            return quote(value)
        if self.lines:
            return None
        if self.kind == "num":
            token = self.tok
            self.advance()
            kind = "double" if "e" in token.lower() else "decimal" if "." in token else "integer"
            return f"{quote(token)}^^<{XSD}{kind}>"
        if self.kind == "name" and self.tok in ("true", "false"):
            token = self.tok
            self.advance()
            return f"{quote(token)}^^<{XSD}boolean>"
        return None

    # -- statements
    def parse(self) -> list[Quad]:
        while self.kind != "end":
            if self.lines:
                self.line_statement()
            else:
                self.statement()
        return self.out

    def line_statement(self) -> None:
        def same_line() -> None:
            if self.newline:
                self.fail("a statement over several lines")

        s = self.iri() or self.bnode() or self.fail("expected a subject")
        same_line()
        p = self.iri() or self.fail("expected a predicate")
        same_line()
        o = self.iri() or self.bnode() or self.literal() or self.fail("expected an object")
        same_line()
        g = (self.iri() or self.bnode()) if self.format == "nq" else None
        same_line()
        self.need(".")
        self.out.append((s, p, o, g))

    def emit(self, s: str, p: str, o: str) -> None:
        if s.startswith('"') or not p.startswith("<") and self.format != "n3":
            self.fail("a literal where none may stand")
        self.out.append((s, p, o, self.graph))

    def name(self, token: str) -> str:
        """The term of an IRI, a prefixed name or a label."""
        if token.startswith("_:"):
            return token
        found = self.names.get(token)
        if found is None:
            if token.startswith("<"):
                found = f"<{self.iri_value(token)}>"
            else:
                prefix, _, local = token.partition(":")
                if prefix not in self.prefixes:
                    self.fail(f"undeclared prefix {prefix!r}", "PFX")
                found = f"<{self.prefixes[prefix]}{local}>"
            if len(self.names) > 100_000:
                self.names.clear()
            self.names[token] = found
        return found

    def plain(self) -> bool:
        """Plain statements from here on, as many as there are; the first that goes on otherwise is left to the others."""
        m = WHOLE.match(self.text, self.at)
        if m is None:
            return False
        while m is not None:
            self.at = m.start()
            subject = self.name(m["s"])
            stop = ";"
            while True:
                if stop == ";":
                    p = TYPE if m["p"] == "a" else self.name(m["p"])
                if m["o"]:
                    o = self.name(m["o"])
                elif m["int"]:
                    o = f'"{m["int"]}"^^<{XSD}integer>'
                else:
                    kind = self.name(m["kind"]) if m["kind"] else None
                    o = m["lex"] + (f"^^{kind}" if kind and kind != f"<{XSD}string>" else f"@{fold_tag(m['tag'])}" if m["tag"] else "")
                self.out.append((subject, p, o, self.graph))
                stop, end = m["stop"], m.end()
                if stop == ".":
                    break
                m = MORE[stop].match(self.text, end)
                if m is None:
                    self.end = end
                    self.advance()
                    if stop == ",":
                        self.objects(subject, p, False)
                    if stop == ";" or self.op(";"):
                        while self.op(";"):
                            pass
                        self.predicates(subject)
                    self.need(".")
                    return True
            m = WHOLE.match(self.text, end)
        self.end = end
        self.advance()
        return True

    def declarations(self) -> bool:
        """Declarations of the usual form from here on, as many as there are."""
        m = DECLARED.match(self.text, self.at)
        if m is None:
            return False
        while m is not None:
            self.prefixes[m["name"]] = m["iri"]
            self.end = m.end()
            m = DECLARED.match(self.text, self.end)
        self.names.clear()
        self.advance()
        return True

    def directive(self) -> bool:
        word = self.tok.lower() if self.kind == "name" else self.tok
        at = self.kind == "word"
        if word in ("@prefix", "prefix") and self.kind in ("word", "name"):
            self.advance()
            if self.kind != "pname" or not self.tok.endswith(":"):
                self.fail("expected a prefix")
            name = self.tok[:-1]
            self.advance()
            if self.kind != "iri":
                self.fail("expected an IRI")
            self.prefixes[name] = self.iri_value(self.tok)
            self.advance()
        elif word in ("@base", "base") and self.kind in ("word", "name"):
            self.advance()
            if self.kind != "iri":
                self.fail("expected an IRI")
            self.base = self.iri_value(self.tok)
            self.advance()
        elif word in ("@keywords", "@forAll", "@forSome") and self.format == "n3":
            self.warnings.append(f"{word} is skipped")
            while self.kind != "end" and not (self.kind == "op" and self.tok == "."):
                self.advance()
        else:
            return False
        self.names.clear()
        if at:
            self.need(".")
        return True

    def statement(self) -> None:
        if self.format in ("ttl", "trig") and self.kind in ("iri", "pname", "bnode") and self.plain():
            return
        if self.kind == "word" and self.declarations() or self.directive():
            return
        if self.format == "trig":
            if self.kind == "name" and self.tok.upper() == "GRAPH":
                self.advance()
                self.block(self.graph_name() or self.fail("expected a graph"))
                return
            if self.kind == "op" and self.tok == "{":
                self.block(None)
                return
            if self.kind in ("iri", "pname", "bnode"):
                saved = (self.end, self.kind, self.tok, self.at, self.newline)
                name = self.graph_name()
                if self.kind == "op" and self.tok == "{":
                    self.block(name)
                    return
                self.end, self.kind, self.tok, self.at, self.newline = saved
            elif self.kind == "op" and self.tok == "[":
                saved = (self.end, self.kind, self.tok, self.at, self.newline)
                name = self.graph_name()
                if name and self.kind == "op" and self.tok == "{":
                    self.block(name)
                    return
                self.end, self.kind, self.tok, self.at, self.newline = saved
        self.triples()
        self.need(".")

    def graph_name(self) -> str | None:
        name = self.iri() or self.bnode()
        if name is None and self.op("["):
            return self.fresh() if self.op("]") else None
        return name

    def block(self, name: str | None) -> None:
        self.need("{")
        self.graph = name
        while not self.op("}"):
            self.triples()
            if not self.op(".") and not (self.kind == "op" and self.tok == "}"):
                self.fail("expected '.'")
        self.graph = None

    def triples(self) -> None:
        bare = self.kind == "op" and self.tok == "["
        subject, full = self.node(True)
        if not self.predicates(subject) and not (full and (bare or self.format == "n3")):
            self.fail("expected a predicate")

    def node(self, as_subject: bool = False) -> tuple[str, bool]:
        """A term; whether it was one that says something by itself."""
        term = self.iri() or self.bnode()
        if term:
            return self.n3_path(term), False
        if self.format == "n3" and self.kind == "var":
            label = f"_:{self.tok[1:]}.v"
            self.advance()
            return label, False
        term = self.literal()
        if term:
            if as_subject:
                self.fail("a literal as a subject")
            return term, False
        if self.op("["):
            node = self.fresh()
            if self.op("]"):
                return node, False
            self.predicates(node) or self.fail("expected a predicate")
            self.need("]")
            return node, True
        if self.op("("):
            items = []
            while not self.op(")"):
                items.append(self.node()[0])
            if not items:
                return NIL, False
            nodes = [self.fresh() for _ in items]
            for n, item, rest in zip(nodes, items, [*nodes[1:], NIL], strict=True):
                self.emit(n, FIRST, item)
                self.emit(n, REST, rest)
            return nodes[0], False
        if self.format == "n3" and self.op("{"):
            outer, self.graph = self.graph, self.fresh()
            name = self.graph
            while not self.op("}"):
                if not self.directive():
                    self.triples()
                    if not self.op(".") and not (self.kind == "op" and self.tok == "}"):
                        self.fail("expected '.'")
            self.graph = outer
            return name, True
        return self.fail(f"unexpected {self.tok!r}")

    def n3_path(self, term: str) -> str:
        """N3's forward and backward steps: x!p is what x has by p, x^p what has x by p."""
        while self.format == "n3" and self.kind == "op" and self.tok in ("!", "^"):
            way = self.op("!", "^")
            p = self.iri() or self.fail("expected an IRI")
            node = self.fresh()
            self.emit(*((term, p, node) if way == "!" else (node, p, term)))
            term = node
        return term

    def verb(self) -> tuple[str, bool] | None:
        """A predicate, and whether subject and object change places."""
        if self.kind == "name" and self.tok == "a":
            self.advance()
            return TYPE, False
        if self.format == "n3":
            if sign := self.op("=>", "<=", "="):
                return (SAME if sign == "=" else IMPLIES), sign == "<="
            if self.kind == "name" and self.tok in ("is", "has"):
                inverse = self.tok == "is"
                self.advance()
                p = self.iri() or self.fail("expected a predicate")
                if inverse:
                    if self.kind != "name" or self.tok != "of":
                        self.fail("expected 'of'")
                    self.advance()
                return p, inverse
            if self.kind in ("bnode", "var"):
                return self.node()[0], False
        p = self.iri()
        return (p, False) if p else None

    def objects(self, subject: str, p: str, swap: bool) -> None:
        while True:
            o = self.node()[0]
            self.emit(*((o, p, subject) if swap else (subject, p, o)))
            if not self.op(","):
                return

    def predicates(self, subject: str) -> bool:
        some = False
        while (verb := self.verb()) is not None:
            some = True
            self.objects(subject, *verb)
            if not self.op(";"):
                return True
            while self.op(";"):
                pass
        return some


def parse_text(text: str, format: str, base: str | None = None) -> tuple[list[Quad], list[str]]:
    p = TextParser(text, format, base)
    return p.parse(), p.warnings
