"""SPARQL requests as facts: one literal for each part of the request, in the order of the text.

The subject is the same for all requests, so two of them are compared part by part. Names with prefixes stand as the
IRIs they mean, and property lists and collections as the triples they make.
"""

from __future__ import annotations

from .sparql_parser import XSD, Parser, Query, quote

SUBJECT, SPACE = "<urn:x-sparql-syntax:request>", "urn:x-sparql-syntax:"
BARE = [f"^^<{XSD}{x}>" for x in ("integer", "decimal", "double", "boolean")]
Parts = list[tuple[str, str]]


def term(t) -> str:
    if t is None:
        return "UNDEF"
    if isinstance(t, str):
        return t
    if t[0] == "var":
        return f"_:{t[1].lstrip('.')}" if t[1].startswith(".") else f"?{t[1]}"
    if t[0] == "lit":
        head, tail = t[1][: t[1].rindex('"') + 1], t[1][t[1].rindex('"') + 1 :]
        return head[1:-1] if tail in BARE else head.replace('"', '\\"', 1)[:-1] + '\\"' + tail
    return t[1]


def path(p) -> str:
    kind = p[0]
    if kind == "iri":
        return p[1]
    if kind == "inv":
        return f"^({path(p[1])})"
    if kind in ("seq", "alt"):
        return "(" + (" / " if kind == "seq" else " | ").join(map(path, flat(p, kind))) + ")"
    if kind == "not":
        return "!(" + " | ".join([*p[1], *(f"^{x}" for x in p[2])]) + ")"
    return f"({path(p[1])}{kind})"


def flat(p, kind: str) -> list:
    """The sides of a chain of one operator."""
    return [x for side in p[1:] for x in (flat(side, kind) if side[0] == kind else [side])]


def triple(t) -> str:
    verb = term(t[1]) if t[1][0] != "path" else path(t[1][1])
    return f"{term(t[0])} {verb} {term(t[2])}"


def expression(e) -> str:
    kind = e[0]
    if kind in ("var", "lit", "iri"):
        return term(e)
    if kind in ("or", "and"):
        return f"({expression(e[1])} {'||' if kind == 'or' else '&&'} {expression(e[2])})"
    if kind == "not":
        return f"!({expression(e[1])})"
    if kind == "sign":
        return f"({e[1]}{expression(e[2])})"
    if kind in ("cmp", "math"):
        return f"({expression(e[2])} {e[1]} {expression(e[3])})"
    if kind == "in":
        return f"({expression(e[1])} {'NOT IN' if e[3] else 'IN'} ({', '.join(map(expression, e[2]))}))"
    if kind == "exists":
        return f"{'NOT EXISTS' if e[2] else 'EXISTS'} {{ {inside(e[1])} }}"
    if kind == "agg":
        _, name, distinct, own, separator = e
        args = "*" if own is None else expression(own)
        return f"{name}({'DISTINCT ' if distinct else ''}{args}" + (f"; SEPARATOR={quote(separator)}" if name == "GROUP_CONCAT" and separator != " " else "") + ")"
    name = f"<{e[1]}>" if kind == "call" else e[1]
    return f"{name}({', '.join(map(expression, e[2]))})"


def values(names: list, rows: list) -> str:
    cells = ["(" + " ".join(map(term, row)) + ")" for row in rows]
    return " ".join(["(" + " ".join(f"?{n}" for n in names) + ")", *cells])


def inside(pattern) -> str:
    """What stands between the braces of a group."""
    return " . ".join(element(e) for e in (pattern[1] if pattern[0] == "group" else [pattern]))


def element(e) -> str:
    kind = e[0]
    if kind == "bgp":
        return " . ".join(map(triple, e[1]))
    if kind in ("optional", "minus"):
        return f"{kind.upper()} {{ {inside(e[1])} }}"
    if kind == "union":
        return " UNION ".join(f"{{ {inside(x)} }}" for x in e[1])
    if kind == "group":
        return f"{{ {inside(e)} }}"
    if kind == "filter":
        return f"FILTER({expression(e[1])})"
    if kind == "bind":
        return f"BIND({expression(e[1])} AS ?{e[2]})"
    if kind == "values":
        return f"VALUES {values(e[1], e[2])}"
    if kind == "graph":
        return f"GRAPH {term(e[1])} {{ {inside(e[2])} }}"
    if kind == "service":
        return f"SERVICE{' SILENT' if e[2] else ''} {term(e[1])} {{ {inside(e[3])} }}"
    return "SUBQUERY[" + " ".join([*subquery(e[1])]) + "]"


def projected(q: Query) -> list[str]:
    return ["*"] if q.project is None else [f"?{n}" if e is None else f"({expression(e)} AS ?{n})" for n, e in q.project]


def subquery(q: Query) -> list[str]:
    modifier = ["Distinct"] if q.distinct else ["Reduced"] if q.reduced else []
    return ["SELECT", *modifier, *projected(q), f"WHERE {{ {inside(q.where)} }}"]


def query_parts(q: Query) -> Parts:
    out = [("form", q.form)]
    out += [("select-modifier", "DISTINCT")] if q.distinct else [("select-modifier", "REDUCED")] if q.reduced else []
    out += [("projection", x) for x in projected(q)] if q.form == "SELECT" else []
    out += [("construct-template", triple(t)) for t in q.template]
    out += [("describe-target", term(t)) for t in q.describe]
    out += [("dataset", f"FROM {g}") for g in q.graphs] + [("dataset", f"FROM NAMED {g}") for g in q.named]
    out.append(("where", f"{{ {inside(q.where) if q.where else ''} }}"))
    for name, e in q.group or []:
        out.append(("group-by", f"?{name}" if e is None else f"({expression(e)} AS ?{name})" if name else expression(e)))
    out += [("having", expression(e)) for e in q.having]
    out += [("order-by", f"{'DESC' if down else 'ASC'} {expression(e)}") for e, down in q.order]
    out += [(k, str(v)) for k, v in (("limit", q.limit), ("offset", q.offset)) if v is not None]
    return out + ([("values", values(*q.values))] if q.values else [])


def graph(g: str | None) -> str:
    return "DEFAULT" if g is None else f"GRAPH {g}"


def quads(name: str, rows: list) -> Parts:
    """A part for each run of triples of one graph."""
    out: list[tuple[object, list[str]]] = []
    for *t, g in rows:
        if not out or out[-1][0] != g:
            out.append((g, []))
        out[-1][1].append(triple(t))
    return [(name, (f"GRAPH {term(g)} " if g else "") + f"{{ {' . '.join(ts)} }}") for g, ts in out]


def operation_parts(op: tuple) -> Parts:
    kind = op[0]
    if kind == "load":
        return [("op", f"LOAD{' SILENT' if op[3] else ''} {op[1]}" + (f" INTO GRAPH {op[2]}" if op[2] else ""))]
    if kind in ("clear", "drop", "create"):
        which = op[1] if op[1] in ("DEFAULT", "NAMED", "ALL") else graph(op[1])
        return [("op", f"{kind.upper()}{' SILENT' if op[2] else ''} {which}")]
    if kind in ("copy", "move", "add"):
        return [("op", f"{kind.upper()}{' SILENT' if op[3] else ''} {graph(op[1])} TO {graph(op[2])}")]
    if kind in ("insert data", "delete data"):
        return [("op", kind.upper().replace(" ", "_")), *quads(kind.replace(" ", "-"), op[1])]
    _, delete, insert, with_, using, named, where = op
    short = [e if e[0] == "bgp" else e[2][1][0] for e in where[1]] if not insert and not with_ and all(e[0] in ("bgp", "graph") for e in where[1]) else None
    if short is not None and [t for e in short for t in e[1]] == [q[:3] for q in delete]:
        return [("op", "DELETE_WHERE"), *quads("delete-where", delete)]
    out = [("op", "MODIFY")] + ([("modify-with", with_[1:-1])] if with_ else [])
    out += quads("modify-delete", delete) + quads("modify-insert", insert)
    out += [("modify-using", f"FROM {g}") for g in using] + [("modify-using", f"FROM NAMED {g}") for g in named]
    return [*out, ("modify-where", f"{{ {inside(where)} }}")]


def encode_sparql(text: str, base: str | None = None) -> list[tuple[str, str, str, None]]:
    whole = Parser(text, base)
    whole.prologue()
    is_query = whole.is_word("SELECT", "CONSTRUCT", "ASK", "DESCRIBE")
    made = whole.query() if is_query else whole.update()
    parts = [("kind", "query" if is_query else "update")]
    parts += [("base", whole.base)] if whole.base and whole.base != base else []
    parts += [("prefix", f"{name} -> {iri}") for name, iri in whole.prefixes.items()]
    parts += query_parts(made) if isinstance(made, Query) else [p for op in made for p in operation_parts(op)]
    return [(SUBJECT, f"<{SPACE}{name}>", quote(value), None) for name, value in parts]
