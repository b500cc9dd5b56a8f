"""Removal of strings that repeat across documents, by a Burrows-Wheeler transform of what may repeat.

Every window of ``length`` bytes has an anchor: its least K-gram hash, the same in all its copies. A run is
the windows that share an anchor. (1) Runs are dealt by anchor hash as packed arrays. Runs with equal
bytes are one class: all but the class' smallest document lose them whole. A task that deals decides so of
what it holds itself, and only each class' smallest document goes on, so a passage in a third of all
documents sends one run for each FLUSH bytes of text. Classes that stay are open where they may share a window
with another document's: two that share one agree in all bytes around its anchor, so in two thirds of these
at least, those of one of its SIDES. (2) The bytes of open classes, one run each, meet by anchor and are examined by interval
expansion on the transform of a block of them; a window whose interval holds a smaller document is removed.
(3) Each document is cut by its removed ranges.

Equality of a class is told by its hashes (88 bits and more), so whole copies never reach the transform: it
examines what is left, the runs whose neighbours differ. An anchor with more than HOT classes is dealt by the
hash of each single window instead, so its runs spread over all tasks; a task sends a window once, for the
smallest document it has read, and where a block of one key outgrows BLOCK its equal strings become one.
Buckets are FINER a partition and slots of documents too, so what a task holds at once is a part of its share.

Defined results: null and empty texts have no bytes; rows with a null id take no part and stay whole;
rows with one id don't remove each other's strings; repeated rows are cut alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import shared_intervals
from .common import U64, Scratch, mix, parts, small_batches

K, CHUNK, BLOCK = 16, 1 << 16, 1 << 17
FLUSH, HOT, FINER, HELD, SIDES = 16 << 20, 2048, 4, 400_000, 3
OPEN = np.dtype([("key", "<u8"), ("start", "<u4"), ("n", "<u2"), ("hot", "u1")])
GONE = np.dtype([("start", "<u4"), ("end", "<u4")])
#: The same with the document they belong to: its id and its tag, 31 bits of a hash of id and text.
OWNER = [("doc", "<i8"), ("tag", "<i4")]
OWN_OPEN, OWN_GONE = np.dtype(OWNER + OPEN.descr), np.dtype(OWNER + GONE.descr)


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of a and b; order counts."""
    with np.errstate(over="ignore"):
        x = a * U64(0x9E3779B97F4A7C15)
        x += b
        x ^= x >> U64(29)
        x *= U64(0xBF58476D1CE4E5B9)
        return x


def hashes(text: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length, a power of two from 8 on, the hash of the string of that length at each place."""
    h, have, by = np.ndarray(max(0, len(text) - 7), dtype="<u8", buffer=text, strides=(1,)) * U64(0xD6E8FEB86659FD93), 8, {}
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    while True:
        by[have] = h
        if have >= max(lengths):
            return [by[n] for n in lengths]
        h, have = fold(h[:-have], h[have:]), 2 * have


def runs(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first window in it, windows, anchor hash, hash of the bytes, hashes of its SIDES) of each run.

    starts: of the documents in text, with the end. A hash of 0 stands for a side that is not whole in the run.
    """
    n = len(text) - length + 1
    if n <= 0:
        none = np.empty(0, dtype="<u4")
        return none, none, none.astype("<u2"), none.astype(U64), none.astype(U64), *[none.astype("<u2")] * SIDES
    block = 1 << (length.bit_length() - 1)
    gram, wide = hashes(text, (K, block))
    # The hash's upper bits, then the place: the least is the leftmost of equal ones.
    least = gram & ~U64(0xFFFFFF)
    least |= np.arange(len(gram), dtype=U64)
    w, have = length - K + 1, 1
    while have < w:
        step = min(have, w - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    new = least[1:n] != least[: n - 1]
    # Windows across the end of a document are runs of their own.
    edges = np.concatenate([starts[1:-1], np.maximum(starts[1:] - length + 1, starts[:-1])]) - 1
    new[edges[(edges >= 0) & (edges < n - 1)]] = True
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    count = np.diff(np.append(first, n))
    doc = np.searchsorted(starts, first, side="right") - 1
    real = first + length <= starts[doc + 1]
    first, count, doc = first[real], count[real], doc[real]
    place = (least[first] & U64(0xFFFFFF)).astype(np.int64)
    size = count - 1 + length
    # All of a run's bytes lie in a few blocks, the first and the last at its ends.
    whole = wide[first]
    steps = -(-(2 * length - K) // block) - 1
    for i in range(1, steps + 1):
        whole = fold(whole, wide[first + (size - block) * i // steps])

    def side(before: int, after: int) -> np.ndarray:
        """Of the bytes from some before the anchor to some after it."""
        inside = np.flatnonzero((place - before >= first) & (place + K + after <= first + size))
        at, parts = place[inside] - before, -(-(before + after) // K)
        own = gram[at]
        for i in range(1, parts + 1):
            own = fold(own, gram[at + (before + after) * i // parts])
        made = np.zeros(len(first), dtype="<u2")
        made[inside] = np.maximum((own >> U64(40)).astype("<u2"), 1)
        return made

    return doc.astype("<u4"), (first - starts[doc]).astype("<u4"), count.astype("<u2"), mix(gram[place]), mix(whole + size.astype(U64)), *(side(*x) for x in sides(length))


def sides(length: int) -> list[tuple[int, int]]:
    """(bytes before the anchor, bytes after it): each window holds all of one of them around its anchor, which one goes by the anchor's place in it."""
    most = length - K
    cuts = [(most + 1) * i // SIDES for i in range(SIDES + 1)]
    return [(lo, most + 1 - hi) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(values), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together: what is zero or steady packs well."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def turned(x: np.ndarray) -> np.ndarray:
    """The planes as rows."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T)


def unplanes(data: bytes, dtype: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def _elsewhere(gram: np.ndarray, whole: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """Which runs have the same bytes as one of a smaller document."""
    with np.errstate(over="ignore"):
        both = gram + whole * U64(0x9E3779B97F4A7C15)
    order = np.argsort(both)
    g, w = gram[order], whole[order]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])]))
    size = np.diff(np.append(first, len(order)))
    lost = np.zeros(len(order), dtype=bool)
    some = np.flatnonzero(np.repeat(size, size) > 1)
    if len(some):
        at, size = order[some], size[size > 1]
        least = np.minimum.reduceat(doc_id[at], np.concatenate([[0], np.cumsum(size)[:-1]]))
        lost[at] = doc_id[at] > np.repeat(least, size)
    return lost


def _deal(length: int, buckets: int):
    """Runs by bucket of their anchor, as one row of packed arrays for every FLUSH bytes and bucket; runs already lost are in rows of their own, without hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, TaskContext.get().partitionId()

        def rows(bucket: np.ndarray, ids, tags, doc, start, n, *hashed) -> list[list]:
            """Columns of a row for each bucket; runs are in the order of buckets, then of documents."""
            edge = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            new = edge | np.concatenate([[True], doc[1:] != doc[:-1]])
            where = start.astype(np.int64)
            where[1:] -= np.where(new[1:], 0, where[:-1].copy())
            first = np.flatnonzero(edge)
            last = np.append(first[1:], len(doc))
            of = np.cumsum(new) - 1  # a run's number among documents of a bucket

            def cut(lo: np.ndarray, hi: np.ndarray, *of_bytes: np.ndarray) -> list[bytes]:
                whole = np.concatenate(of_bytes)
                return [np.ascontiguousarray(whole[:, i:j]).tobytes() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]

            docs, firsts, lasts = doc[new], of[first], of[last - 1] + 1
            made = [new.view(np.uint8)[None], turned(where.astype("<u4")), turned(n)]
            if hashed:
                gram, whole, *own = hashed
                made += [turned((gram // U64(buckets)) & U64((1 << 40) - 1))[:5], turned(whole)[:6], *map(turned, own)]
            return [bucket[first].tolist(), [not hashed] * len(first), cut(firsts, lasts, turned(ids[docs]), turned(tags[docs])), cut(first, last, *made)]

        def out() -> pa.RecordBatch:
            nonlocal turn
            ids, tags = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            base = np.cumsum([0, *(len(x[0]) for x in held)])
            doc = np.concatenate([x[2] + np.uint32(b) for x, b in zip(held, base, strict=False)])
            made = [np.concatenate([x[i] for x in held]) for i in range(3, 7 + SIDES)]
            held.clear()
            gram, whole = made[2:4]
            lost = _elsewhere(gram, whole, ids[doc])
            columns = [[] for _ in range(4)]
            if lost.any():
                turn += 1
                some = np.flatnonzero(lost)
                columns = rows(np.full(len(some), turn % buckets), ids, tags, doc[some], *(x[some] for x in made[:2]))
            bucket = (gram % U64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
            bucket[lost] = 0
            kept = np.argsort(bucket, kind="stable")
            kept = kept[~lost[kept]]
            if len(kept):
                columns = [x + y for x, y in zip(columns, rows(bucket[kept], ids, tags, doc[kept], *(x[kept] for x in made)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "lost", "owners", "runs"])

        for batch in batches:
            ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            lengths = np.array(pc.binary_length(batch.column(2)).to_pylist(), dtype=np.int64)
            at = 0
            while at < len(lengths):
                to = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), CHUNK, side="right")))
                text, starts = _joined(batch.column(2).slice(at, to - at).to_pylist())
                # A text too long for the places in a hash is cut into overlapping parts.
                for lo in range(0, len(text) if to - at == 1 else 1, 8 * CHUNK):
                    piece, own = (text[lo : lo + 8 * CHUNK + length - 1], None) if to - at == 1 else (text, starts)
                    own = np.array([0, len(piece)]) if own is None else own
                    doc, start, *rest = runs(piece, own, length)
                    if len(doc):
                        held.append((ids[at:to], tags[at:to], doc, start + np.uint32(lo), *rest))
                size += len(text)
                at = to
                if size >= FLUSH:
                    if held:
                        yield out()
                    size = 0
        if held:
            yield out()

    return run


def _unpacked(rows: list[dict], hashed: bool) -> list[np.ndarray]:
    """ids, tags, start, n, and with hashes key, whole and sides of the runs of some rows of _deal."""

    def joined(name: str, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
        """Arrays of these kinds, of each of which so many planes are there."""
        whole = sum(n for _, n in kinds)
        planes = np.concatenate([np.frombuffer(r[name], dtype=np.uint8).reshape(whole, -1) for r in rows], axis=1)
        made, at = [], 0
        for kind, n in kinds:
            raw = np.zeros((planes.shape[1], np.dtype(kind).itemsize), dtype=np.uint8)
            raw[:, :n] = planes[at : at + n].T
            made.append(raw.reshape(-1).view(kind))
            at += n
        return made

    ids, tags = joined("owners", [("<i8", 8), ("<i4", 4)])
    new, where, n, *more = joined("runs", [("u1", 1), ("<u4", 4), ("<u2", 2)] + ([("<u8", 5), ("<u8", 6)] + [("<u2", 2)] * SIDES if hashed else []))
    doc = np.cumsum(new, dtype=np.int64) - 1  # each row begins with a document
    where = np.cumsum(where.astype(np.int64))
    carry = np.concatenate([[0], where])[np.flatnonzero(new)]
    return [ids[doc], tags[doc], where - carry[doc], n, *more]


def _by_class(key: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Runs in the order of their keys (40 bits), those of a class together."""
    both = (key << U64(24)) | (whole & U64(0xFFFFFF))
    order = np.argsort(both)
    b, w = both[order], whole[order]
    if ((b[1:] == b[:-1]) & (w[1:] != w[:-1])).any():  # a key's classes that agree in these bits
        order = np.lexsort((whole, key))
    return order


def _matched(length: int, buckets: int, slots: int):
    """What each document loses whole, and its open runs: packed rows, one for each slot of documents and HELD runs."""

    def settled(bucket: int, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        ids, tags, start, n, key, whole, *around = _unpacked(rows, True)
        order = _by_class(key, whole)
        # What shares no anchor with any other is neither lost nor open.
        alone = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        order = order[~(alone & np.append(alone[1:], True))]
        if not len(order):
            return np.empty(0, dtype=OWN_GONE), np.empty(0, dtype=OWN_OPEN)
        key_, whole_, doc_ = key[order], whole[order], ids[order]
        new_key = np.concatenate([[True], key_[1:] != key_[:-1]])
        new_class = new_key | np.concatenate([[True], whole_[1:] != whole_[:-1]])
        key_at, class_at = np.flatnonzero(new_key), np.flatnonzero(new_class)
        key_no, class_no = np.cumsum(new_key) - 1, np.cumsum(new_class) - 1
        lost = doc_ > np.minimum.reduceat(doc_, class_at)[class_no]
        classes = np.add.reduceat(new_class.astype(np.int64), key_at)
        several = (np.maximum.reduceat(doc_, key_at) > np.minimum.reduceat(doc_, key_at)) & (classes > 1)
        # A class is open once for each of its smallest document's runs.
        mask = ~lost & several[key_no]
        some = np.flatnonzero(mask)
        near = np.zeros(len(order), dtype=bool)
        for side in around:
            own = some[side[order[some]] > 0]
            both = (key_[own] << U64(16)) | side[order[own]].astype(U64)
            by = np.argsort(both)
            own, both = own[by], both[by]
            if len(own):
                first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                apart = np.maximum.reduceat(doc_[own], first) > np.minimum.reduceat(doc_[own], first)
                near[own] |= np.repeat(apart, np.diff(np.append(first, len(own))))
        mask &= near
        at = order[mask]
        open_ = np.empty(len(at), dtype=OWN_OPEN)
        open_["doc"], open_["tag"], open_["key"], open_["start"], open_["n"] = ids[at], tags[at], key[at] * U64(buckets) + U64(bucket), start[at], n[at]
        open_["hot"] = classes[key_no[mask]] > HOT
        return _ranges(ids, tags, start, n, order[lost]), open_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone, open_, held = [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal held
            cut = []
            for made in (gone, open_):
                rows = np.concatenate(made)
                slot = rows["tag"] % slots
                by = np.argsort(slot, kind="stable")
                cut.append((rows[by], np.searchsorted(slot[by], np.arange(slots + 1))))
                made.clear()
            held = 0
            some = np.flatnonzero(np.diff(cut[0][1]) + np.diff(cut[1][1]))
            columns = [[planes(x[e[i] : e[i + 1]]) if e[i + 1] > e[i] else None for i in some] for x, e in cut]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["slot", "gone", "open"])

        def done(bucket: int, rows: list[dict]) -> None:
            nonlocal held
            early, late = [r for r in rows if r["lost"]], [r for r in rows if not r["lost"]]
            if early:
                ids, tags, start, n = _unpacked(early, False)
                gone.append(_ranges(ids, tags, start, n, np.arange(len(ids))))
            lost, left = settled(bucket, late) if late else (np.empty(0, dtype=OWN_GONE), np.empty(0, dtype=OWN_OPEN))
            gone.append(lost)
            open_.append(left)
            held += sum(len(x[-1]) for x in (gone, open_)) + (len(gone[-2]) if early else 0)

        bucket, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != bucket and rows:
                    done(bucket, rows)
                    rows = []
                    if held >= HELD:
                        yield out()
                bucket = r["bucket"]
                rows.append(r)
        if rows:
            done(bucket, rows)
        if held:
            yield out()

    return run


def _ranges(ids: np.ndarray, tags: np.ndarray, start: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    made = np.empty(len(at), dtype=OWN_GONE)
    made["doc"], made["tag"], made["start"], made["end"] = ids[at], tags[at], start[at], start[at] + n[at].astype(np.int64)
    return made


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a slot: the ranges it loses, joined where they meet, and its open runs."""

    def done(gone: list[np.ndarray], open_: list[np.ndarray]) -> pa.RecordBatch:
        cuts: dict[tuple[int, int], dict[str, bytes]] = {}
        for name, made, kind, own in (("gone", gone, OWN_GONE, GONE), ("open", open_, OWN_OPEN, OPEN)):
            rows = np.concatenate(made) if made else np.empty(0, dtype=kind)
            rows = rows[np.lexsort((rows["start"], rows["tag"], rows["doc"]))]
            if name == "gone" and len(rows):
                apart = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tag"][1:] != rows["tag"][:-1]) | (rows["start"][1:] > rows["end"][:-1])
                first = np.flatnonzero(np.concatenate([[True], apart]))
                end = np.maximum.reduceat(rows["end"], first)
                rows = rows[first]
                rows["end"] = end
            new = np.flatnonzero(np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tag"][1:] != rows["tag"][:-1])])) if len(rows) else []
            bare = np.empty(len(rows), dtype=own)
            for c in own.names:
                bare[c] = rows[c]
            for i, j in zip(new, [*new[1:], len(rows)], strict=False):
                cuts.setdefault((int(rows["doc"][i]), int(rows["tag"][i])), {})[name] = bare[i:j].tobytes()
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in cuts], t) for i, t in ((0, pa.int64()), (1, pa.int32()))] + [pa.array([x.get(c) for x in cuts.values()], pa.binary()) for c in ("gone", "open")], names=["doc_id", "tag", "gone", "open"])

    slot, gone, open_ = None, [], []
    for batch in batches:
        for r in batch.to_pylist():
            if r["slot"] != slot and (gone or open_):
                yield done(gone, open_)
                gone, open_ = [], []
            slot = r["slot"]
            for made, name, kind in ((gone, "gone", OWN_GONE), (open_, "open", OWN_OPEN)):
                if r[name] is not None:
                    made.append(unplanes(r[name], kind))
    if gone or open_:
        yield done(gone, open_)


def _contexts(length: int):
    """The bytes of open runs: key, doc_id, tag, starts (packed), run. A row without bytes holds windows lost to one that the task had sent before."""

    names = ["key", "doc_id", "tag", "starts", "run"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: dict[bytes, tuple[int, int, bytes, list[bytes]]] = {}  # hash -> smallest document, its tag, the window, its starts
        rows: list[tuple] = []

        def send(h: bytes, x: tuple) -> None:
            rows.append((int.from_bytes(h[:8], "little", signed=True), x[0], x[1], b"".join(x[3]), x[2]))

        def lose(doc_id: int, tag: int, starts: list[bytes]) -> None:
            rows.append((tag, doc_id, tag, b"".join(starts), None))

        for batch in batches:
            for doc_id, tag, text, blob in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                own: dict[tuple[int, bytes], list[bytes]] = {}
                hot_own: dict[bytes, tuple[bytes, list[bytes]]] = {}
                for key, start, n, hot in np.frombuffer(blob, dtype=OPEN).tolist():
                    if hot:
                        for i in range(start, start + n):
                            w = text[i : i + length]
                            hot_own.setdefault(hashlib.blake2b(w, digest_size=16).digest(), (w, []))[1].append(i.to_bytes(4, "little"))
                    else:
                        own.setdefault((key, text[start : start + n - 1 + length]), []).append(start.to_bytes(4, "little"))
                for (key, string), starts in own.items():
                    rows.append((key if key < 1 << 63 else key - (1 << 64), doc_id, tag, b"".join(starts), string))
                gone: list[bytes] = []
                for h, (w, starts) in hot_own.items():
                    before = windows.get(h)
                    if before is None or doc_id < before[0]:
                        if before is not None:
                            lose(before[0], before[1], before[3])
                        windows[h] = (doc_id, tag, w, starts)
                    elif doc_id > before[0]:
                        gone += starts
                    else:  # another text of the same id
                        send(h, (doc_id, tag, w, starts))
                if gone:
                    lose(doc_id, tag, gone)
                if len(windows) >= 100_000:
                    for x in windows.items():
                        send(*x)
                    windows.clear()
                if len(rows) >= 20_000:
                    yield packed(rows)
                    rows = []
        for x in windows.items():
            send(*x)
        if rows:
            yield packed(rows)

    return run


def expand(texts: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of every window that also starts in a text of a smaller document."""
    if not texts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    sizes = np.array([len(t) for t in texts])
    text = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8) + np.uint8(1)  # UTF-8 has no FF, which becomes 0
    owner = np.repeat(np.unique(docs, return_inverse=True)[1].astype(np.int32), sizes + 1)
    order, lo, hi = shared_intervals(text, owner, length)
    if not len(lo):
        return lo, hi
    size = hi - lo
    ends = np.cumsum(size)
    at = order[np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)]
    least = np.minimum.reduceat(owner[at], ends - size)
    at = np.sort(at[owner[at] > np.repeat(least, size)])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    which = np.searchsorted(starts, at, side="right") - 1
    return which, at - starts[which]


def _expanded(length: int):
    schema = ["doc_id", "tag", "gone"]

    def lost(doc_id: np.ndarray, tag: np.ndarray, starts: list[bytes], lo: np.ndarray, hi: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
        """Ranges lo to hi of the strings ``which``, at each of their starts."""
        count = np.array([len(x) // 4 for x in starts], dtype=np.int64)
        flat, base = np.frombuffer(b"".join(starts), dtype="<u4").astype(np.int64), np.concatenate([[0], np.cumsum(count)])
        times = count[which]
        each = np.repeat(np.arange(len(which)), times)
        at = flat[np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times) + base[which][each]] if len(each) else flat[:0]
        data = np.empty(len(each), dtype=GONE)
        data["start"], data["end"] = at + lo[each], at + hi[each]
        own = which[each]
        return pa.RecordBatch.from_arrays([pa.array(doc_id[own], pa.int64()), pa.array(tag[own], pa.int32()), pa.array([x.tobytes() for x in data], pa.binary())], names=schema)

    def columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        return table.column("doc_id").to_numpy(), table.column("tag").to_numpy(), table.column("starts").to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forward(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """Windows that were lost on the way."""
            some = table.filter(pc.is_null(table.column("run")))
            if some.num_rows:
                none = np.zeros(some.num_rows, dtype=np.int64)
                yield lost(*columns(some), none, none + 1, np.arange(some.num_rows))

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from forward(table)
            table = table.filter(pc.is_valid(table.column("run")))
            doc_id, tag, starts = columns(table)
            which, place = expand(table.column("run").to_pylist(), doc_id, length)
            if len(which):
                first = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1)]))
                last = np.concatenate([first[1:] - 1, [len(which) - 1]])
                yield lost(doc_id, tag, starts, place[first], place[last] + 1, which[first])

        def combined(table: pa.Table) -> tuple[pa.Table, list[pa.RecordBatch]]:
            """Equal strings become one, that of the smallest document; the others lose it whole."""
            out = list(forward(table))
            table = table.filter(pc.is_valid(table.column("run")))
            doc_id, tag, starts = columns(table)
            strings = table.column("run").to_pylist()
            least: dict[bytes, int] = {}
            for x, d in zip(strings, doc_id.tolist(), strict=True):
                least[x] = min(d, least.get(x, d))
            keep = np.fromiter((d == least[x] for x, d in zip(strings, doc_id.tolist(), strict=True)), dtype=bool, count=len(strings))
            which = np.flatnonzero(~keep)
            if len(which):
                size = np.array([len(strings[i]) - length + 1 for i in which])
                out.append(lost(doc_id, tag, starts, np.zeros(len(which), dtype=np.int64), size, which))
            return table.filter(pa.array(keep)), out

        held, size, most = [], 0, 2 * BLOCK
        for batch in batches:
            key = batch.column(0).to_numpy()
            if not len(key):
                continue
            lengths = np.array(pc.fill_null(pc.binary_length(batch.column(4)), 0).to_pylist())
            new = np.concatenate([[bool(held) and held[-1].column(0)[-1].as_py() != key[0]], key[1:] != key[:-1]])
            at = 0
            for i in np.flatnonzero(new):
                if size + lengths[at:i].sum() >= BLOCK:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    if held:
                        yield from done(pa.Table.from_batches(held))
                    held, size, at, most = [], 0, i, 2 * BLOCK
            if at < len(key):
                held.append(batch.slice(at))
                size += int(lengths[at:].sum())
            if size >= most:  # one key alone, or nearly
                left, out = combined(pa.Table.from_batches(held))
                yield from out
                held = left.combine_chunks().to_batches() or [batch.slice(len(key) - 1)]
                size = sum(len(x) for x in left.column("run").to_pylist())
                most = max(most, 2 * size)
        if held:
            yield from done(pa.Table.from_batches(held))

    return run


def _cut(length: int):
    """n_bytes, n_removed, n_spans and what is kept of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, whole, more in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                text = text or b""
                gone = sorted(struct.iter_unpack("<II", b"".join([whole or b"", *(more or [])])))
                kept, removed, spans, at, to = [], 0, 0, 0, 0  # what is cut last goes from at to to
                for start, end in gone:
                    if start > to or not spans:
                        kept.append(text[to:start])
                        removed, spans, at = removed + to - at, spans + 1, start
                    to = max(to, end + length - 1)
                kept.append(text[to:])
                made.append((len(text), removed + to - at, spans, b"".join(kept)))
            columns = list(zip(*made, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    n = parts(spark)
    buckets = slots = n * FINER
    id_ = F.col("doc_id").cast("long").alias("id")  # under another name, else Spark drops it from one of the deals of texts and makes both
    texts = docs.select(id_, F.xxhash64("doc_id", "text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("tag"), F.col("text").cast("binary").alias("text"))
    long_ = texts.where(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    dealt = long_.mapInArrow(_deal(length, buckets), "bucket int, lost boolean, owners binary, runs binary")
    matched = dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_matched(length, buckets, slots), "slot int, gone binary, open binary")
    merged = matched.repartition(n, "slot").sortWithinPartitions("slot").mapInArrow(_merged, "doc_id long, tag int, gone binary, open binary")
    # Written, as both of what follows read it: else the runs would be dealt twice.
    by_doc = Scratch(spark).write(merged)
    # Both joins ask for rows with an id, so they read one and the same deal of the texts.
    placed = texts.where(F.col("id").isNotNull()).repartition(n, "id", "tag")
    nothing = F.lit(None)
    bare = texts.where(F.col("id").isNull()).select("id", "text", nothing.cast("binary").alias("gone"), nothing.cast("array<binary>").alias("more"))
    opened = by_doc.where(F.col("open").isNotNull()).select(id_, "tag", "open")
    contexts = placed.join(opened, ["id", "tag"]).select("id", "tag", "text", "open").mapInArrow(_contexts(length), "key long, doc_id long, tag int, starts binary, run binary")
    found = contexts.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_expanded(length), "doc_id long, tag int, gone binary")
    more = found.groupBy(id_, "tag").agg(F.collect_list("gone").alias("more"))
    met = placed.join(by_doc.select(id_, "tag", "gone"), ["id", "tag"], "left").join(more, ["id", "tag"], "left")
    return met.select("id", "text", "gone", "more").unionAll(bare).mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
