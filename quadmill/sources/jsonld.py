"""JSON-LD documents to quads of canonical terms (the toRdf part without expansion's rarer keywords)."""

from __future__ import annotations

import json
import re

from ..functions.iri import resolve_text
from ..plans.sparql_parser import XSD, fold_tag, quote
from .rdf_text import FIRST, NIL, REST, TYPE, Quad, RdfError

ABSOLUTE = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def fail(message: str):
    raise RdfError("JSONLD-SYNTAX-001", message, 0)


class Context:
    def __init__(self, base: str | None = None):
        self.base, self.vocab, self.language = base, None, None
        self.terms: dict[str, dict | None] = {}

    def copy(self) -> Context:
        made = Context(self.base)
        made.vocab, made.language, made.terms = self.vocab, self.language, dict(self.terms)
        return made

    def extended(self, local, top_base: str | None) -> Context:
        now = self.copy()
        for c in local if isinstance(local, list) else [local]:
            if c is None:
                now = Context(top_base)
                continue
            if isinstance(c, str):
                continue  # remote contexts are not fetched
            if not isinstance(c, dict):
                fail("a context that is no object")
            if "@base" in c:
                now.base = c["@base"] if c["@base"] is None or not now.base else resolve_text(now.base, c["@base"])
            if "@vocab" in c:
                now.vocab = c["@vocab"]
            if "@language" in c:
                now.language = c["@language"]
            for term, value in c.items():
                if not term.startswith("@"):
                    now.define(term, value, c)
        return now

    def define(self, term: str, value, local: dict) -> None:
        if value is None:
            self.terms[term] = None
            return
        d = {"@id": value} if isinstance(value, str) else dict(value)
        made: dict = {}
        if "@reverse" in d:
            made["reverse"], made["id"] = True, self.expand(d["@reverse"], True, local)
        elif d.get("@id", term) != term or ":" in term:
            made["id"] = self.expand(d.get("@id", term), True, local, term)
        else:
            made["id"] = self.vocab + term if self.vocab is not None else None
        if "@type" in d:
            made["type"] = d["@type"] if d["@type"] in ("@id", "@vocab", "@json", "@none") else self.expand(d["@type"], True, local, term)
        if "@language" in d:
            made["language"] = d["@language"]
        container = d.get("@container")
        made["container"] = container[0] if isinstance(container, list) and container else container
        self.terms[term] = made

    def expand(self, value: str, vocab: bool, local: dict | None = None, own: str | None = None) -> str | None:
        if value.startswith("@") or value.startswith("_:"):
            return value
        if local and value in local and value not in self.terms and value != own:
            self.define(value, local[value], local)
        if ":" in value:
            prefix, _, rest = value.partition(":")
            if prefix == "_" or rest.startswith("//"):
                return value
            if local and prefix in local and prefix not in self.terms and prefix != own:
                self.define(prefix, local[prefix], local)
            if not rest.startswith("//") and self.terms.get(prefix) and self.terms[prefix]["id"]:
                return self.terms[prefix]["id"] + rest
            if ABSOLUTE.match(value):
                return value
        if vocab:
            if value in self.terms:
                return self.terms[value]["id"] if self.terms[value] else None
            if self.vocab is not None:
                return self.vocab + value
            return None
        return resolve_text(self.base, value) if self.base else value


class JsonLdParser:
    def __init__(self, content: bytes, base: str | None = None):
        try:
            self.data = json.loads(content)
        except ValueError as e:
            raise RdfError("JSONLD-JSON-001", f"malformed JSON: {e}", 0) from e
        self.base, self.out, self.n = base, [], 0

    def fresh(self) -> str:
        self.n += 1
        return f"_:.{self.n}"

    def parse(self) -> list[Quad]:
        for item in self.data if isinstance(self.data, list) else [self.data]:
            if not isinstance(item, dict):
                fail("a document that is no object")
            self.node(item, Context(self.base), None)
        return self.out

    def ref(self, iri: str | None) -> str | None:
        return None if iri is None else iri if iri.startswith("_:") else f"<{iri}>"

    def key(self, data: dict, ctx: Context, keyword: str):
        """The value of a keyword or of a term that stands for it."""
        if keyword in data:
            return data[keyword]
        return next((data[t] for t, d in ctx.terms.items() if d and d["id"] == keyword and t in data), None)

    def node(self, data: dict, ctx: Context, graph: str | None) -> str:
        if "@context" in data:
            ctx = ctx.extended(data["@context"], self.base)
        own = self.key(data, ctx, "@id")
        if own is not None and not isinstance(own, str):
            fail("@id that is no string")
        s = self.ref(ctx.expand(own, False)) if isinstance(own, str) else self.fresh()
        inside = self.key(data, ctx, "@graph")
        if inside is not None:
            named = s if own is not None or any(not k.startswith("@") for k in data) else graph
            for item in inside if isinstance(inside, list) else [inside]:
                self.node(item, ctx, named)
        types = self.key(data, ctx, "@type")
        for t in types if isinstance(types, list) else [types] if types is not None else []:
            if not isinstance(t, str):
                fail("@type that is no string")
            iri = self.ref(ctx.expand(t, True) or ctx.expand(t, False))
            iri = iri if iri and (iri.startswith("_:") or ABSOLUTE.match(iri[1:])) else None
            if iri:
                self.out.append((s, TYPE, iri, graph))
        for key, value in data.items():
            if key == "@reverse":
                for name, values in value.items():
                    p = self.ref(ctx.expand(name, True))
                    for v in values if isinstance(values, list) else [values]:
                        if p and p.startswith("<") and v is not None:
                            self.out.append((self.node(v, ctx, graph) if isinstance(v, dict) else self.ref(ctx.expand(v, False)), p, s, graph))
                continue
            if key.startswith("@"):
                continue
            d = ctx.terms.get(key) or {}
            p = ctx.expand(key, True)
            if p is None or p.startswith("@") or not (ABSOLUTE.match(p)):
                continue
            for o in self.objects(value, d, ctx, graph):
                self.out.append((o, f"<{p}>", s, graph) if d.get("reverse") else (s, f"<{p}>", o, graph))
        return s

    def objects(self, value, d: dict, ctx: Context, graph: str | None) -> list[str]:
        if d.get("container") == "@list":
            return [self.list(value if isinstance(value, list) else [value], d, ctx, graph)]
        if d.get("container") == "@language" and isinstance(value, dict):
            return [f"{quote(x)}@{fold_tag(tag)}" for tag, own in value.items() for x in (own if isinstance(own, list) else [own]) if x is not None]
        if isinstance(value, list):
            return [o for v in value for o in self.objects(v, {**d, "container": None}, ctx, graph)]
        if value is None:
            fail("null as a value")
        if isinstance(value, dict):
            if "@list" in value:
                own = value["@list"]
                return [self.list(own if isinstance(own, list) else [own], d, ctx, graph)]
            if "@set" in value:
                return self.objects(value["@set"], d, ctx, graph)
            if "@value" in value:
                return [self.value(value, d, ctx)] if value["@value"] is not None else []
            return [self.node(value, ctx, graph)]
        return [self.scalar(value, d, ctx)]

    def list(self, items: list, d: dict, ctx: Context, graph: str | None) -> str:
        terms = [o for v in items for o in self.objects(v, {**d, "container": None}, ctx, graph)]
        nodes = [self.fresh() for _ in terms]
        for at, item, rest in zip(nodes, terms, [*nodes[1:], NIL], strict=False):
            self.out += [(at, FIRST, item, graph), (at, REST, rest, graph)]
        return nodes[0] if nodes else NIL

    def lexical(self, v) -> tuple[str, str]:
        """The text of a JSON scalar and the type it has by itself."""
        if isinstance(v, bool):
            return ("true" if v else "false"), XSD + "boolean"
        if isinstance(v, int) and -(1 << 63) <= v < 1 << 63:
            return str(v), XSD + "integer"
        if isinstance(v, (int, float)):
            digits, _, e = f"{float(v):.16E}".partition("E")
            short = repr(float(v))
            for n in range(17):
                if float(f"{float(v):.{n}E}") == float(short):
                    digits = f"{float(v):.{n}E}".partition("E")[0]
                    break
            return f"{digits}E{int(e)}", XSD + "double"
        if isinstance(v, str):
            return v, XSD + "string"
        return fail("a value that is no scalar")

    def value(self, data: dict, d: dict, ctx: Context) -> str:
        text, kind = self.lexical(data["@value"])
        if "@language" in data:
            return f"{quote(text)}@{fold_tag(data['@language'])}" if data["@language"] else quote(text)
        if "@type" in data:
            kind = ctx.expand(data["@type"], True) or fail("an unknown type")
        return quote(text) + ("" if kind == XSD + "string" else f"^^<{kind}>")

    def scalar(self, v, d: dict, ctx: Context) -> str:
        kind = d.get("type")
        if isinstance(v, str) and kind in ("@id", "@vocab"):
            iri = ctx.expand(v, kind == "@vocab")
            return self.ref(iri if iri is not None else ctx.expand(v, False))  # type: ignore[return-value]
        text, own = self.lexical(v)
        if kind and not kind.startswith("@"):
            return quote(text) + ("" if kind == XSD + "string" else f"^^<{kind}>")
        if isinstance(v, str):
            lang = d.get("language", ctx.language)
            return f"{quote(text)}@{fold_tag(lang)}" if lang else quote(text)
        return f"{quote(text)}^^<{own}>"


def parse_jsonld(content: bytes, base: str | None = None) -> list[Quad]:
    return JsonLdParser(content, base).parse()
