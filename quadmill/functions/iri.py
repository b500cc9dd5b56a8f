"""IRI algebra (RFC 3986 and 3987), as column expressions, and in plain Python for the front-ends."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern of RFC 3986, appendix B.
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
#: What IRIs may hold (RFC 3987), beside percent-encoded bytes.
UCS = r"\x{A0}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFEF}\x{10000}-\x{1FFFD}\x{20000}-\x{2FFFD}\x{30000}-\x{3FFFD}\x{40000}-\x{DFFFD}\x{E1000}-\x{EFFFD}"
UNRESERVED, SUB = r"A-Za-z0-9\-._~", r"!$&'()*+,;="
PRIVATE = r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}"
ENCODED = "%[0-9A-Fa-f]{2}"
SURROGATE = "(?i)%ED%[AB][0-9A-F]"


def split_text(iri: str) -> tuple[str | None, str | None, str, str | None, str | None]:
    return re.match(PARTS, iri, re.S).groups()  # type: ignore[union-attr, return-value]


def dots_text(path: str) -> str:
    rooted = path.startswith("/")
    out: list[str] = []
    parts = (path[1:] if rooted else path).split("/")
    for n, p in enumerate(parts):
        last = n == len(parts) - 1
        if p == "..":
            if out:
                out.pop()
                rooted = rooted or not out
            if last:
                out.append("")
        elif p == ".":
            if last:
                out.append("")
        else:
            out.append(p)
    return ("/" if rooted else "") + "/".join(out)


def join_text(scheme, authority, path, query, fragment) -> str:
    return (f"{scheme}:" if scheme is not None else "") + (f"//{authority}" if authority is not None else "") + path + (f"?{query}" if query is not None else "") + (f"#{fragment}" if fragment is not None else "")


def resolve_text(base: str, ref: str) -> str:
    """RFC 3986, 5.2.2, strict."""
    s, a, p, q, f = split_text(ref)
    if s is not None:
        return join_text(s, a, dots_text(p), q, f)
    bs, ba, bp, bq, _ = split_text(base)
    if a is not None:
        return join_text(bs, a, dots_text(p), q, f)
    if p == "":
        return join_text(bs, ba, bp, q if q is not None else bq, f)
    if not p.startswith("/"):
        p = "/" + p if ba is not None and bp == "" else bp[: bp.rfind("/") + 1] + p
    return join_text(bs, ba, dots_text(p), q, f)


def component(iri: Column, n: int) -> Column:
    """Scheme, authority, path, query or fragment, 1 to 5; null where there is none (the path is always there)."""
    text = F.regexp_extract(iri, "(?s)" + PARTS, n)
    if n == 3:
        return text
    there = {1: r"^[^:/?#]+:", 2: r"^(?:[^:/?#]+:)?//", 4: r"(?s)^[^?#]*\?", 5: "(?s)^[^#]*#"}[n]
    return F.when(iri.rlike(there), text)


def scheme(iri: Column) -> Column:
    return component(iri, 1)


def authority(iri: Column) -> Column:
    return component(iri, 2)


def user_info(iri: Column) -> Column:
    return F.when(F.contains(authority(iri), F.lit("@")), F.regexp_extract(authority(iri), "^([^@]*)@", 1))


def host(iri: Column) -> Column:
    return F.regexp_extract(authority(iri), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)


def port(iri: Column) -> Column:
    text = F.regexp_extract(authority(iri), r"^(?:[^@]*@)?(?:\[[^\]]*\]|[^:]*):(\d*)$", 1)
    return F.when(text != "", text)


def path(iri: Column) -> Column:
    return component(iri, 3)


def query(iri: Column) -> Column:
    return component(iri, 4)


def fragment(iri: Column) -> Column:
    return component(iri, 5)


def is_absolute(iri: Column) -> Column:
    return iri.rlike(SCHEME)


def is_valid(iri: Column) -> Column:
    """An absolute IRI whose parts hold only what RFC 3987 lets them, with real ports and no encoded surrogates."""
    pchar = rf"[{UNRESERVED}{SUB}:@{UCS}]|{ENCODED}"
    host_ok = rf"^(?:\[[0-9A-Fa-f:.vV{UNRESERVED}{SUB}]+\]|(?:[{UNRESERVED}{SUB}{UCS}]|{ENCODED})*)$"
    none_or = lambda c, p: F.coalesce(c.rlike(p), F.lit(True))
    port_text = F.regexp_extract(authority(iri), r"^(?:[^@]*@)?(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    return (
        is_absolute(iri)
        & none_or(user_info(iri), rf"^(?:[{UNRESERVED}{SUB}:{UCS}]|{ENCODED})*$")
        & none_or(host(iri), host_ok)
        & none_or(port_text, r"^\d*$")
        & F.coalesce(F.expr("true") & (port(iri).cast("int") <= 65535), F.lit(True))
        & path(iri).rlike(rf"^(?:{pchar}|/)*$")
        & none_or(query(iri), rf"^(?:{pchar}|[/?{PRIVATE}])*$")
        & none_or(fragment(iri), rf"^(?:{pchar}|[/?])*$")
        & ~iri.rlike(SURROGATE)
    )


def remove_dots(p: Column) -> Column:
    """remove_dot_segments as a fold over the segments."""
    parts = F.split(p, "/", -1)
    n = F.size(parts)

    def step(state: Column, x: Column) -> Column:
        i, out = state["i"] + 1, state["out"]
        last = i == n
        popped = F.when(F.size(out) > 1, F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.when((F.size(out) == 1) & (F.element_at(out, 1) != ""), F.array(F.lit(""))).otherwise(out))
        end = F.when(last, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        new = F.when(x == "..", F.concat(popped, end)).when(x == ".", F.concat(out, end)).otherwise(F.concat(out, F.array(x)))
        return F.struct(i.alias("i"), new.alias("out"))

    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(parts, start, step)["out"]
    text = F.array_join(done, "/")
    return F.when(~F.contains(p, F.lit(".")), p).when(F.startswith(p, F.lit("/")) & ~F.startswith(text, F.lit("/")), F.concat(F.lit("/"), text)).otherwise(text)


def build(s: Column, a: Column, p: Column, q: Column, f: Column) -> Column:
    part = lambda c, before, after="": F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    return F.concat(part(s, "", ":"), part(a, "//"), p, part(q, "?"), part(f, "#"))


def normalise(iri: Column) -> Column:
    """Scheme and host in lower case, no dot segments; percent-encoding is left as it is."""
    a = authority(iri)
    low = F.concat(F.coalesce(F.concat(user_info(iri), F.lit("@")), F.lit("")), F.lower(host(iri)), F.regexp_extract(a, r"^(?:[^@]*@)?(?:\[[^\]]*\]|[^:]*)(:.*)?$", 1))
    return build(F.lower(scheme(iri)), F.when(a.isNotNull(), low), remove_dots(path(iri)), query(iri), fragment(iri))


def resolve(base: Column, ref: Column) -> Column:
    s, a, p, q, f = (component(ref, n) for n in range(1, 6))
    bs, ba, bp, bq = (component(base, n) for n in range(1, 5))
    merged = F.when(ba.isNotNull() & (bp == ""), F.concat(F.lit("/"), p)).otherwise(F.concat(F.regexp_extract(bp, "(?s)^(.*/)?", 1), p))
    return (
        F.when(s.isNotNull(), build(s, a, remove_dots(p), q, f))
        .when(a.isNotNull(), build(bs, a, remove_dots(p), q, f))
        .when(p == "", build(bs, ba, bp, F.coalesce(q, bq), f))
        .otherwise(build(bs, ba, remove_dots(F.when(F.startswith(p, F.lit("/")), p).otherwise(merged)), q, f))
    )


def to_uri(iri: Column) -> Column:
    """Non-ASCII characters percent-encoded as UTF-8, hosts by IDNA; null where there is a control character."""

    @F.pandas_udf("string")
    def run(texts):  # type: ignore[no-untyped-def]
        def one(t: str | None) -> str | None:
            if t is None or re.search(r"[\x00-\x20\x7f]", t):
                return None
            s, a, p, q, f = split_text(t)
            if a and not a.isascii():
                m = re.match(r"^(?:([^@]*)@)?(\[[^\]]*\]|[^:]*)(:.*)?$", a)
                try:
                    name = m[2].encode("idna").decode()  # type: ignore[index]
                except UnicodeError:
                    return None
                a = (f"{m[1]}@" if m[1] is not None else "") + name + (m[3] or "")  # type: ignore[index]
            return "".join(c if ord(c) < 128 else "".join(f"%{b:02X}" for b in c.encode()) for c in join_text(s, a, p, q, f))

        return texts.map(one)

    return run(iri)
