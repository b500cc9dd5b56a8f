"""SPARQL 1.1 query and update text to a syntax tree, with prefixes and base resolved.

Terms are ("iri" | "lit", canonical string) or ("var", name); blank nodes in patterns are hidden variables
whose names begin with a dot. Patterns and expressions are tuples whose first member names the kind.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.iri import resolve_text

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TYPE, FIRST, REST, NIL = (("iri", f"<{RDF}{x}>") for x in ("type", "first", "rest", "nil"))

#: The built-in functions and how many arguments each takes (least, most).
BUILTINS = {
    "STR": (1, 1), "LANG": (1, 1), "LANGMATCHES": (2, 2), "DATATYPE": (1, 1), "BOUND": (1, 1), "IRI": (1, 1), "URI": (1, 1), "BNODE": (0, 1), "RAND": (0, 0),
    "ABS": (1, 1), "CEIL": (1, 1), "FLOOR": (1, 1), "ROUND": (1, 1), "CONCAT": (0, 99), "STRLEN": (1, 1), "SUBSTR": (2, 3), "UCASE": (1, 1), "LCASE": (1, 1),
    "ENCODE_FOR_URI": (1, 1), "CONTAINS": (2, 2), "STRSTARTS": (2, 2), "STRENDS": (2, 2), "STRBEFORE": (2, 2), "STRAFTER": (2, 2), "YEAR": (1, 1), "MONTH": (1, 1),
    "DAY": (1, 1), "HOURS": (1, 1), "MINUTES": (1, 1), "SECONDS": (1, 1), "TIMEZONE": (1, 1), "TZ": (1, 1), "NOW": (0, 0), "UUID": (0, 0), "STRUUID": (0, 0),
    "MD5": (1, 1), "SHA1": (1, 1), "SHA256": (1, 1), "SHA384": (1, 1), "SHA512": (1, 1), "COALESCE": (1, 99), "IF": (3, 3), "STRLANG": (2, 2), "STRDT": (2, 2),
    "SAMETERM": (2, 2), "ISIRI": (1, 1), "ISURI": (1, 1), "ISBLANK": (1, 1), "ISLITERAL": (1, 1), "ISNUMERIC": (1, 1), "REGEX": (2, 3), "REPLACE": (3, 4),
}
AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}

#: Diagnostic codes of this front-end.
SYNTAX, EOF, PROLOGUE, BIND, DATA_FORM, AGG, PREFIX, NO_BASE, ESCAPE = (f"SPARQL-{x}-001" for x in ("SYNTAX", "EOF", "PROLOGUE", "BIND", "UPDATE", "AGG", "PFX", "BASE", "LITESC"))


class SparqlError(ValueError):
    def __init__(self, code: str, message: str, offset: int):
        super().__init__(f"{code}: {message} at {offset}")
        self.code, self.message, self.offset = code, message, offset


LETTER = r"A-Za-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000EFFFF"
CHARS = LETTER + r"_\-0-9·̀-ͯ‿-⁀"
PN = rf"[{LETTER}](?:[{CHARS}.]*[{CHARS}])?"
LOCAL = rf"(?:[{LETTER}_:0-9]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?#@%])(?:(?:[{CHARS}.:]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?#@%])*(?:[{CHARS}:]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?#@%]))?"
TOKEN = re.compile(
    rf"""(?P<skip>(?:[ \t\r\n]+|\#[^\r\n]*)+)
    |(?P<iri><[^\x00-\x20<>"{{}}|^`\\]*>)
    |(?P<var>[?$][{LETTER}_0-9][{LETTER}_0-9·̀-ͯ‿-⁀]*)
    |(?P<str>'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'(?:[^'\\\r\n]|\\.)*'|"(?:[^"\\\r\n]|\\.)*")
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bnode>_:[{LETTER}_0-9](?:[{CHARS}.]*[{CHARS}])?)
    |(?P<num>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
    |(?P<pname>(?:{PN})?:(?:{LOCAL})?)
    |(?P<word>[A-Za-z][A-Za-z0-9_]*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{{}}()\[\].;,/|^?*+!=<>\-])""",
    re.X | re.S,
)
#: What is remembered of a front-end's words: so many, none longer than that.
REMEMBERED, LONGEST = 1 << 14, 64
#: Words that are the same in all front-ends, which are tried first: brackets and stops, and short names that one of these or a blank ends.
COMMON = r"[{}()\[\];,]|[A-Za-z][A-Za-z0-9_]*+(?::[A-Za-z0-9_]*+)?(?=[ \t\r\n{}()\[\];,])|"


class Words(dict):
    """Words of one front-end, each with its kind and its key: in upper case if it may be a keyword, as it stands if an operator, else empty.

    What is skipped is None. A scan without groups finds them much faster; what kind one is of does not depend on where it stands, so it is asked for once.
    """

    def __init__(self, token: re.Pattern):
        self.token = token
        self.plain = re.compile(COMMON + re.sub(r"\(\?P<\w+>", "(?:", token.pattern), token.flags)

    def __missing__(self, text: str) -> tuple[str, str, str] | None:
        kind = self.token.match(text + " ").lastgroup  # the blank is what ends a language tag in a schema
        found = None if kind == "skip" else (kind, text, text.upper() if kind == "word" else text if kind == "op" else "")
        if len(text) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = found
        return found

    def cut(self, text: str) -> tuple[list[str], int]:
        """All words of a text, with what is skipped between them, and where the first stands that is none (the end, if all are)."""
        pieces = self.plain.findall(text)
        if sum(map(len, pieces)) == len(text):
            return pieces, len(text)
        at = 0
        for m in self.token.finditer(text):
            if m.start() != at:
                break
            at = m.end()
        return pieces, at

    def tokens(self, pieces: list[str]) -> list[tuple[str, str, str]]:
        """The words themselves, and two ends: a parser looks one word ahead."""
        return [*filter(None, map(self.__getitem__, pieces)), ("end", "", ""), ("end", "", "")]

    def offset(self, pieces: list[str], n: int) -> int:
        """Where the n-th word stands, which only errors ask for."""
        at = 0
        for text in pieces:
            if self[text]:
                if n == 0:
                    return at
                n -= 1
            at += len(text)
        return at


WORDS = Words(TOKEN)
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def quote(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def fold_tag(tag: str) -> str:
    """The base part in lower case; four letters Title, two letters or three digits UPPER, the rest lower."""
    first, *rest = tag.split("-")
    return "-".join([first.lower(), *(x.title() if len(x) == 4 and x.isalpha() else x.upper() if len(x) == 2 and x.isalpha() or len(x) == 3 and x.isdigit() else x.lower() for x in rest)])


def typed(lexical: str, datatype: str) -> tuple[str, str]:
    return "lit", quote(lexical) + ("" if datatype == XSD + "string" else f"^^<{datatype}>")


@dataclass
class Query:
    form: str
    where: tuple = ("group", [])
    project: list | None = None  # (name, expression or None); None: all
    distinct: bool = False
    reduced: bool = False
    template: list = field(default_factory=list)
    describe: list = field(default_factory=list)
    graphs: list = field(default_factory=list)
    named: list = field(default_factory=list)
    group: list | None = None
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    values: tuple | None = None


def unescape_codepoints(text: str) -> str:
    def one(m: re.Match) -> str:
        n = int(m[1] or m[2], 16)
        if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF:
            raise SparqlError(ESCAPE, "no such code point", m.start())
        return chr(n)

    return re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", one, text) if "\\" in text else text


class Parser:
    def __init__(self, text: str, base: str | None = None):
        self.text = unescape_codepoints(text)
        self.base, self.prefixes, self.hidden = base, {}, 0
        self.i = 0
        self.pieces, at = WORDS.cut(self.text)
        if at < len(self.text):
            raise SparqlError(SYNTAX, f"unexpected {self.text[at]!r}", at)
        self.tokens = WORDS.tokens(self.pieces)
        self.in_aggregate = False
        self.data_labels: set[str] = set()

    # -- tokens
    def peek(self, n: int = 0) -> tuple[str, str, str]:
        return self.tokens[self.i + n]

    def offset(self, n: int) -> int:
        return WORDS.offset(self.pieces, n)

    def fail(self, message: str, code: str | None = None):
        raise SparqlError(code or (EOF if self.peek()[0] == "end" else SYNTAX), message, self.offset(self.i))

    def op(self, *texts: str) -> str | None:
        key = self.tokens[self.i][2]
        if key in texts:
            self.i += 1
            return key
        return None

    def need(self, text: str) -> None:
        if not self.op(text):
            self.fail(f"expected {text!r}, found {self.peek()[1]!r}")

    word = op

    def is_word(self, *names: str) -> bool:
        return self.tokens[self.i][2] in names

    def need_word(self, name: str) -> None:
        if not self.word(name):
            self.fail(f"expected {name}")

    # -- terms
    def fresh(self) -> tuple[str, str]:
        self.hidden += 1
        return "var", f".b{self.hidden}"

    def iri_text(self, raw: str) -> tuple[str, str]:
        value = raw[1:-1]
        if self.base is not None:
            value = resolve_text(self.base, value)
        return "iri", f"<{value}>"

    def iri(self) -> tuple[str, str] | None:
        kind, text, _ = self.peek()
        if kind == "iri":
            self.i += 1
            return self.iri_text(text)
        if kind == "pname":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(PREFIX, f"undeclared prefix {prefix!r}", self.offset(self.i))
            self.i += 1
            return "iri", "<" + self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local) + ">"
        return None

    def need_iri(self) -> tuple[str, str]:
        return self.iri() or self.fail("expected an IRI")

    def var(self) -> tuple[str, str] | None:
        kind, text, _ = self.peek()
        if kind == "var":
            self.i += 1
            return "var", text[1:]
        return None

    def string(self) -> str | None:
        kind, text, _ = self.peek()
        if kind != "str":
            return None
        own = self.i
        self.i += 1
        n = 3 if text[:3] in ('"""', "'''") else 1

        def one(m: re.Match) -> str:
            if m[1] not in ESCAPES:
                raise SparqlError(ESCAPE, f"unknown escape \\{m[1]}", self.offset(own))
            return ESCAPES[m[1]]

        return re.sub(r"\\(.)", one, text[n:-n], flags=re.S)

    def literal(self) -> tuple[str, str] | None:
        text = self.string()
        if text is not None:
            kind, tag, _ = self.peek()
            if kind == "lang":
                self.i += 1
                return "lit", f"{quote(text)}@{fold_tag(tag[1:])}"
            if self.op("^^"):
                return typed(text, self.need_iri()[1][1:-1])
            return "lit", quote(text)
        kind, text, _ = self.peek()
        sign = ""
        if kind == "op" and text in "+-" and self.peek(1)[0] == "num":
            sign = text
            self.i += 1
            kind, text, _ = self.peek()
        if kind == "num":
            self.i += 1
            return typed(sign + text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "word" and text in ("true", "false"):
            self.i += 1
            return typed(text, XSD + "boolean")
        return None

    def bnode(self) -> tuple[str, str] | None:
        kind, text, _ = self.peek()
        if kind == "bnode":
            self.i += 1
            self.data_labels.add(text)
            return "var", "." + text[2:]
        return None

    # -- entry points
    def prologue(self) -> None:
        while True:
            if self.word("BASE"):
                kind, text, _ = self.peek()
                if kind != "iri":
                    self.fail("expected an IRI")
                self.i += 1
                self.base = resolve_text(self.base, text[1:-1]) if self.base else text[1:-1]
            elif self.word("PREFIX"):
                kind, text, _ = self.peek()
                if kind != "pname" or text.find(":") != len(text) - 1:
                    self.fail("expected a prefix")
                self.i += 1
                kind, raw, _ = self.peek()
                if kind != "iri":
                    self.fail("expected an IRI")
                self.i += 1
                self.prefixes[text[:-1]] = self.iri_text(raw)[1][1:-1]
            else:
                return

    def query(self) -> Query:
        self.prologue()
        q = self.one_query()
        q.values = self.values_block() if self.word("VALUES") else None
        if self.peek()[0] != "end":
            self.fail("text after the query")
        return q

    def one_query(self) -> Query:
        form = self.word("SELECT", "CONSTRUCT", "ASK", "DESCRIBE")
        if not form:
            self.fail("expected SELECT, CONSTRUCT, ASK or DESCRIBE")
        q = Query(form)
        short = False
        if form == "SELECT":
            self.select(q)
        elif form == "CONSTRUCT":
            short = not self.op("{")
            if not short:
                q.template = self.template("}")
        elif form == "DESCRIBE":
            if not self.op("*"):
                while t := self.var() or self.iri():
                    q.describe.append(t)
                if not q.describe:
                    self.fail("expected what to describe")
        self.dataset(q)
        has_where = self.word("WHERE")
        if form == "DESCRIBE" and not has_where and self.peek()[1] != "{":
            q.where = None
        elif form == "CONSTRUCT" and short:
            self.need("{")
            q.template = self.template("}")
            q.where = ("group", [("bgp", list(q.template))])
        else:
            q.where = self.group()
        self.modifiers(q)
        self.scope(q)
        return q

    def select(self, q: Query) -> None:
        what = self.word("DISTINCT", "REDUCED")
        q.distinct, q.reduced = what == "DISTINCT", what == "REDUCED"
        if self.op("*"):
            return
        q.project = []
        while True:
            if v := self.var():
                q.project.append((v[1], None))
            elif self.op("("):
                e = self.expression()
                self.need_word("AS")
                v = self.var() or self.fail("expected a variable")
                self.need(")")
                if any(n == v[1] for n, _ in q.project):
                    self.fail(f"?{v[1]} is projected twice", AGG)
                q.project.append((v[1], e))
            else:
                break
        if not q.project:
            self.fail("expected what to select")

    def dataset(self, q: Query) -> None:
        while self.word("FROM"):
            (q.named if self.word("NAMED") else q.graphs).append(self.need_iri()[1])

    def modifiers(self, q: Query) -> None:
        if self.word("GROUP"):
            self.need_word("BY")
            q.group = []
            while True:
                if v := self.var():
                    q.group.append((v[1], None))
                elif self.op("("):
                    e = self.expression()
                    name = (self.var() or self.fail("expected a variable"))[1] if self.word("AS") else None
                    self.need(")")
                    q.group.append((name, e))
                elif (e := self.call()) is not None:
                    q.group.append((None, e))
                else:
                    break
            if not q.group:
                self.fail("expected what to group by")
        if self.word("HAVING"):
            while (e := self.constraint()) is not None:
                q.having.append(e)
            if not q.having:
                self.fail("expected a condition")
        if self.word("ORDER"):
            self.need_word("BY")
            while True:
                way = self.word("ASC", "DESC")
                e = self.bracketted() if way else self.constraint()
                if e is None and not way and (v := self.var()):
                    e = v
                if e is None:
                    break
                q.order.append((e, way == "DESC"))
            if not q.order:
                self.fail("expected what to order by")
        while name := self.word("LIMIT", "OFFSET"):
            kind, text, _ = self.peek()
            if kind != "num" or not text.isdigit():
                self.fail("expected a whole number")
            self.i += 1
            setattr(q, name.lower(), int(text))

    def scope(self, q: Query) -> None:
        """The rules of grouping and of new names."""
        if q.form != "SELECT":
            return
        inside = visible(q.where) if q.where else set()
        aggregated = q.group is not None or any(e is not None and has_aggregate(e) for _, e in q.project or []) or any(has_aggregate(e) for e in q.having)
        if q.project is None:
            if q.group is not None:
                self.fail("SELECT * with GROUP BY", AGG)
            return
        for name, e in q.project:
            if e is not None and name in inside:
                self.fail(f"?{name} is already in scope", BIND)
        if aggregated:
            known = {n for n, _ in q.group or [] if n}
            for name, e in q.project:
                loose = free(e) - known if e is not None else {name} - known
                if e is not None and any(g == e for _, g in q.group or []):
                    loose = set()
                if loose:
                    self.fail(f"?{min(loose)} is neither grouped nor aggregated", AGG)
                known.add(name)

    # -- patterns
    def group(self) -> tuple:
        self.need("{")
        if self.word("SELECT"):
            self.i -= 1
            q = self.one_query()
            q.values = self.values_block() if self.word("VALUES") else None
            self.need("}")
            return "group", [("sub", q)]
        out: list = []
        while not self.op("}"):
            kind, text, _ = self.peek()
            if self.is_word("BASE", "PREFIX"):
                self.fail("a prologue inside a pattern", PROLOGUE)
            if kind == "op" and text == "{":
                sides = [self.group()]
                while self.word("UNION"):
                    sides.append(self.group())
                out.append(sides[0] if len(sides) == 1 else ("union", sides))
            elif self.word("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.word("MINUS"):
                out.append(("minus", self.group()))
            elif self.word("GRAPH"):
                name = self.var() or self.need_iri()
                out.append(("graph", name, self.group()))
            elif self.word("SERVICE"):
                silent = bool(self.word("SILENT"))
                name = self.var() or self.need_iri()
                out.append(("service", name, silent, self.group()))
            elif self.word("FILTER"):
                e = self.constraint()
                if e is None:
                    self.fail("expected a condition")
                out.append(("filter", e))
            elif self.word("BIND"):
                self.need("(")
                e = self.expression()
                self.need_word("AS")
                v = self.var() or self.fail("expected a variable")
                self.need(")")
                if v[1] in visible(("group", out)):
                    self.fail(f"?{v[1]} is already in scope", BIND)
                out.append(("bind", e, v[1]))
            elif self.word("VALUES"):
                out.append(("values", *self.values_block()))
            else:
                triples: list = []
                if not self.triples_of_subject(triples, True):
                    self.fail(f"unexpected {text!r}")
                if out and out[-1][0] == "bgp":
                    out[-1][1].extend(triples)
                else:
                    out.append(("bgp", triples))
                if self.peek()[1] != "}" and not self.op(".") and self.peek()[0] != "word" and self.peek()[1] != "{":
                    self.fail("expected '.'")
                continue
            self.op(".")
        return "group", out

    def values_block(self) -> tuple[list[str], list[list]]:
        if v := self.var():
            names, single = [v[1]], True
        else:
            self.need("(")
            names, single = [], False
            while v := self.var():
                names.append(v[1])
            self.need(")")
        self.need("{")
        rows = []
        while not self.op("}"):
            row = []
            if not single:
                self.need("(")
            while single and not row or not single and not self.op(")"):
                if self.word("UNDEF"):
                    row.append(None)
                else:
                    t = self.iri() or self.literal()
                    if t is None:
                        self.fail("expected a value")
                    row.append(t[1])
            if len(row) != len(names):
                self.fail("a row of VALUES has another length than its variables")
            rows.append(row)
        return names, rows

    def template(self, close: str) -> list:
        out: list = []
        while not self.op(close):
            if not self.triples_of_subject(out, False):
                self.fail("expected a triple")
            if self.peek()[1] != close and not self.op("."):
                self.fail("expected '.'")
        return out

    def node(self, out: list, paths: bool):
        """A term, a collection or a property list; adds what they stand for."""
        t = self.var() or self.iri() or self.bnode() or self.literal()
        if t:
            return t, False
        if self.op("["):
            node = self.fresh()
            if self.op("]"):
                return node, False
            self.properties(node, out, paths)
            self.need("]")
            return node, True
        if self.op("("):
            items = []
            while not self.op(")"):
                item = self.node(out, paths)
                if item is None:
                    self.fail("expected an item")
                items.append(item[0])
            if not items:
                return NIL, False
            nodes = [self.fresh() for _ in items]
            for n, item, rest in zip(nodes, items, [*nodes[1:], NIL], strict=True):
                out += [(n, ("path", FIRST), item), (n, ("path", REST), rest)]
            return nodes[0], True
        return None

    def triples_of_subject(self, out: list, paths: bool) -> bool:
        got = self.node(out, paths)
        if got is None:
            return False
        subject, full = got
        if not self.properties(subject, out, paths) and not full:
            self.fail("expected a predicate")
        return True

    def properties(self, subject, out: list, paths: bool) -> bool:
        some = False
        while True:
            verb = self.var() or (("path", self.path()) if paths else self.plain_verb())
            if verb is None or verb == ("path", None):
                return some
            some = True
            while True:
                got = self.node(out, paths)
                if got is None:
                    self.fail("expected an object")
                out.append((subject, verb, got[0]))
                if not self.op(","):
                    break
            if not self.op(";"):
                return True
            while self.op(";"):
                pass

    def plain_verb(self):
        if self.peek()[:2] == ("word", "a"):
            self.i += 1
            return "path", TYPE
        t = self.iri()
        return ("path", t) if t else None

    # -- paths
    def path(self):
        first = self.path_sequence()
        if first is None:
            return None
        while self.op("|"):
            first = ("alt", first, self.path_sequence() or self.fail("expected a path"))
        return first

    def path_sequence(self):
        first = self.path_step()
        if first is None:
            return None
        while self.op("/"):
            first = ("seq", first, self.path_step() or self.fail("expected a path"))
        return first

    def path_step(self):
        inverse = self.op("^")
        p = self.path_primary()
        if p is None:
            return self.fail("expected a path") if inverse else None
        if mod := self.op("?", "*", "+"):
            p = (mod, p)
        return ("inv", p) if inverse else p

    def path_primary(self):
        if self.peek()[:2] == ("word", "a"):
            self.i += 1
            return TYPE
        if t := self.iri():
            return t
        if self.op("("):
            p = self.path() or self.fail("expected a path")
            self.need(")")
            return p
        if self.op("!"):
            forward, backward = [], []

            def one() -> None:
                to = backward if self.op("^") else forward
                if self.peek()[:2] == ("word", "a"):
                    self.i += 1
                    to.append(TYPE[1])
                else:
                    to.append(self.need_iri()[1])

            if self.op("("):
                if not self.op(")"):
                    one()
                    while self.op("|"):
                        one()
                    self.need(")")
            else:
                one()
            return "not", forward, backward
        return None

    # -- expressions
    def bracketted(self):
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def constraint(self):
        return self.bracketted() if self.peek()[:2] == ("op", "(") else self.call()

    def call(self):
        kind, text, _ = self.peek()
        if kind == "word" and (text.upper() in BUILTINS or text.upper() in AGGREGATES or text.upper() in ("EXISTS", "NOT")):
            return self.primary()
        if kind in ("iri", "pname") and self.peek(1)[1] == "(":
            return self.primary()
        return None

    def expression(self):
        e = self.conjunction()
        while self.op("||"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.comparison()
        while self.op("&&"):
            e = ("and", e, self.comparison())
        return e

    def comparison(self):
        e = self.sum()
        if o := self.op("=", "!=", "<", ">", "<=", ">="):
            return "cmp", o, e, self.sum()
        negated = self.is_word("NOT") and self.peek(1)[1].upper() == "IN"
        if negated:
            self.i += 1
        if self.word("IN"):
            return "in", e, self.arguments(), negated
        return e

    def sum(self):
        e = self.product()
        while True:
            if o := self.op("+", "-"):
                e = ("math", o, e, self.product())
            else:
                return e

    def product(self):
        e = self.unary()
        while o := self.op("*", "/"):
            e = ("math", o, e, self.unary())
        return e

    def unary(self):
        if self.op("!"):
            return "not", self.unary()
        if o := self.op("+", "-"):
            return "sign", o, self.unary()
        return self.primary()

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.op(")"):
            if out:
                self.need(",")
            out.append(self.expression())
        return out

    def primary(self):
        kind, text, _ = self.peek()
        if kind == "op" and text == "(":
            return self.bracketted()
        if v := self.var():
            return v
        if kind in ("iri", "pname"):
            t = self.iri()
            if self.peek()[1] == "(":
                self.word("DISTINCT")
                return "call", t[1][1:-1], self.arguments()
            return t
        if (t := self.literal()) is not None:
            return t
        if kind == "word":
            name = text.upper()
            if name == "EXISTS" or name == "NOT" and self.peek(1)[1].upper() == "EXISTS":
                self.i += 1 + (name == "NOT")
                return "exists", self.group(), name == "NOT"
            if name in AGGREGATES:
                self.i += 1
                return self.aggregate(name)
            if name in BUILTINS:
                self.i += 1
                args = self.arguments()
                low, high = BUILTINS[name]
                if not low <= len(args) <= high:
                    self.fail(f"{name} takes {low} to {high} arguments")
                if name == "BOUND" and args[0][0] != "var":
                    self.fail("BOUND takes a variable")
                return "fn", name, args
        return self.fail(f"unexpected {text!r}")

    def aggregate(self, name: str):
        self.need("(")
        distinct = bool(self.word("DISTINCT"))
        if name == "COUNT" and self.op("*"):
            e = None
        else:
            e = self.expression()
            if has_aggregate(e):
                self.fail("an aggregate inside an aggregate", AGG)
        separator = " "
        if self.op(";"):
            if name != "GROUP_CONCAT":
                self.fail("only GROUP_CONCAT has a separator")
            self.need_word("SEPARATOR")
            self.need("=")
            separator = self.string()
            if separator is None:
                self.fail("expected a string")
        self.need(")")
        return "agg", name, distinct, e, separator

    # -- updates
    def update(self) -> list[tuple]:
        out = []
        while True:
            self.prologue()
            if self.peek()[0] == "end":
                return out
            out.append(self.operation())
            if not self.op(";"):
                if self.peek()[0] != "end":
                    self.fail("expected ';'")
                return out

    def target(self) -> str | None:
        """DEFAULT or a graph: None for the default one."""
        if self.word("DEFAULT"):
            return None
        self.word("GRAPH")
        return self.need_iri()[1]

    def operation(self) -> tuple:
        if self.word("LOAD"):
            silent, source = bool(self.word("SILENT")), self.need_iri()[1]
            into = None
            if self.word("INTO"):
                self.need_word("GRAPH")
                into = self.need_iri()[1]
            return "load", source, into, silent
        if what := self.word("CLEAR", "DROP"):
            silent = bool(self.word("SILENT"))
            if which := self.word("DEFAULT", "NAMED", "ALL"):
                return what.lower(), which, silent
            self.need_word("GRAPH")
            return what.lower(), self.need_iri()[1], silent
        if self.word("CREATE"):
            silent = bool(self.word("SILENT"))
            self.need_word("GRAPH")
            return "create", self.need_iri()[1], silent
        if what := self.word("COPY", "MOVE", "ADD"):
            silent, source = bool(self.word("SILENT")), self.target()
            self.need_word("TO")
            return what.lower(), source, self.target(), silent
        if self.is_word("INSERT") and self.peek(1)[1].upper() == "DATA":
            self.i += 2
            before = set(self.data_labels)
            self.data_labels = set()
            quads = self.quads(data=True)
            if before & self.data_labels:
                self.fail("a blank node label is used in two operations", DATA_FORM)
            self.data_labels |= before
            return "insert data", quads
        if self.is_word("DELETE") and self.peek(1)[1].upper() in ("DATA", "WHERE"):
            what = self.peek(1)[1].upper()
            self.i += 2
            quads = self.quads(data=what == "DATA")
            if any(t[0] == "var" and t[1].startswith(".") for q in quads for t in (q[0], q[2])):
                self.fail("blank nodes can't be deleted", DATA_FORM)
            if what == "DATA":
                return "delete data", quads
            return "modify", quads, [], None, [], [], ("group", [("bgp", [q[:3]]) if q[3] is None else ("graph", q[3], ("group", [("bgp", [q[:3]])])) for q in quads])
        with_ = self.need_iri()[1] if self.word("WITH") else None
        delete, insert = [], []
        if self.word("DELETE"):
            delete = self.quads()
            if any(t[0] == "var" and t[1].startswith(".") for q in delete for t in (q[0], q[2])):
                self.fail("blank nodes can't be deleted", DATA_FORM)
            if self.word("INSERT"):
                insert = self.quads()
        elif self.word("INSERT"):
            insert = self.quads()
        else:
            self.fail("expected an update")
        using, named = [], []
        while self.word("USING"):
            (named if self.word("NAMED") else using).append(self.need_iri()[1])
        self.need_word("WHERE")
        return "modify", delete, insert, with_, using, named, self.group()

    def quads(self, data: bool = False) -> list[tuple]:
        """(subject, verb, object, graph or None) of a quad block."""
        self.need("{")
        out: list[tuple] = []
        while not self.op("}"):
            if self.word("GRAPH"):
                name = self.var() or self.need_iri()
                if data and name[0] == "var":
                    self.fail("a variable graph in DATA", DATA_FORM)
                self.need("{")
                out += [(*t, name) for t in self.template("}")]
                self.op(".")
            else:
                some: list = []
                if not self.triples_of_subject(some, False):
                    self.fail("expected a triple")
                out += [(*t, None) for t in some]
                if self.peek()[1] not in ("}", "GRAPH") and not self.is_word("GRAPH") and not self.op("."):
                    self.fail("expected '.'")
        if data and any(t[0] == "var" and not t[1].startswith(".") for q in out for t in (q[0], q[1], q[2]) if t[0] == "var"):
            self.fail("a variable in DATA", DATA_FORM)
        return out


def visible(pattern: tuple) -> set[str]:
    """The variables that a pattern puts in scope."""
    kind = pattern[0]
    if kind == "bgp":
        return {t[1] for triple in pattern[1] for t in triple if t[0] == "var" and not t[1].startswith(".")}
    if kind in ("group", "union"):
        return set().union(*(visible(p) for p in pattern[1]))
    if kind == "optional":
        return visible(pattern[1])
    if kind == "graph":
        return visible(pattern[2]) | ({pattern[1][1]} if pattern[1][0] == "var" else set())
    if kind == "service":
        return visible(pattern[3])
    if kind == "bind":
        return {pattern[2]}
    if kind == "values":
        return set(pattern[1])
    if kind == "sub":
        q = pattern[1]
        return visible(q.where) if q.project is None else {n for n, _ in q.project}
    return set()


def has_aggregate(e) -> bool:
    if isinstance(e, tuple) and e and e[0] == "agg":
        return True
    return isinstance(e, (tuple, list)) and e[:1] not in (("exists",),) and any(has_aggregate(x) for x in e if isinstance(x, (tuple, list)))


def free(e) -> set[str]:
    """Variables outside aggregates."""
    if isinstance(e, tuple) and e:
        if e[0] == "var":
            return {e[1]}
        if e[0] in ("agg", "exists", "lit", "iri"):
            return set()
    return set().union(*(free(x) for x in e if isinstance(x, (tuple, list)))) if isinstance(e, (tuple, list)) else set()


def parse_query(text: str, base: str | None = None) -> Query:
    return Parser(text, base).query()


def parse_update(text: str, base: str | None = None) -> list[tuple]:
    return Parser(text, base).update()


def parse_request(text: str, base: str | None = None) -> tuple[str, object]:
    """("query", Query) or ("update", operations), whichever the text is."""
    p = Parser(text, base)
    p.prologue()
    is_query = p.is_word("SELECT", "CONSTRUCT", "ASK", "DESCRIBE")
    return ("query", parse_query(text, base)) if is_query else ("update", parse_update(text, base))
