"""Fill-in-the-middle by rank and select over packed boundaries.

A text is cut into units, [A-Za-z]+ or one other code point. One bit for each byte tells whether a unit begins there;
a batch of texts is one bit vector with a directory of popcounts (``bits.Bits``). The popcount between a text's ends
is its number of units, and select on two ranks gives the bytes where prefix and middle end. A second vector
of the beginnings of code points turns cuts into lengths. No unit is ever a Python object, and beside
the batch itself two bits a byte are held.

Defined results: a null or empty text has no units and stays plain; a null id is the empty string where cuts are
drawn; each row is cut by itself, repeated rows alike; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import Bits
from .common import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that are marked at a time, a multiple of 8.
PIECE = 1 << 20


def draws(id_: Column, seed: int = 1, n: int = 4) -> list[Column]:
    """The first 8-digit groups of the hex sha256 of ``seed:id``, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def boundaries(data: np.ndarray, begins: np.ndarray) -> tuple[Bits, Bits]:
    """Where units begin, and where code points do. begins: the first byte of each text that has any, ascending."""
    units, points, last = [], [], False
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE]
        point = (piece & 0xC0) != 0x80
        letter = ((piece | 0x20) - np.uint8(97)) < 26
        within = letter.copy()
        within[1:] &= letter[:-1]
        within[:1] &= last
        within[begins[np.searchsorted(begins, at) : np.searchsorted(begins, at + PIECE)] - at] = False
        last = bool(letter[-1])
        points.append(np.packbits(point, bitorder="little"))
        units.append(np.packbits(point & ~within, bitorder="little"))
    none = [np.empty(0, dtype=np.uint8)]
    return Bits(np.concatenate(units or none)), Bits(np.concatenate(points or none))


def _cut(plain_percent: int, spm_percent: int):
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null(b"").cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, dtype=np.uint8)[ends[0] : ends[-1]] if raw is not None else np.empty(0, dtype=np.uint8)
            ends = ends - ends[0]
            units, points = boundaries(data, ends[:-1][ends[1:] > ends[:-1]])
            ranks = units.rank(ends)
            n = np.diff(ranks)
            h1, h2, h3, h4 = (batch.column(i).to_numpy() for i in range(2, 6))
            sides = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
            cuts = np.broadcast_to(ends[1:], sides.shape).copy()  # a cut after all units
            inner = sides < n
            cuts[inner] = units.select((ranks[:-1] + sides)[inner])
            chars = np.diff(points.rank(np.concatenate([ends[:-1], *cuts])).reshape(3, -1), axis=0)
            forms, outputs, held = [], [], memoryview(data)
            for i in range(len(texts)):
                text = bytes(held[ends[i] : ends[i + 1]])
                if not text or p in text or s in text or m in text or h3[i] % 100 >= 100 - plain_percent:
                    forms.append("plain")
                    outputs.append(text)
                    continue
                a, b = cuts[:, i] - ends[i]
                spm = h4[i] % 100 < spm_percent
                forms.append("spm" if spm else "psm")
                outputs.append(b"".join((s, text[b:], p, text[:a], m, text[a:b]) if spm else (p, text[:a], s, text[b:], m, text[a:b])))
            plain = np.array([f == "plain" for f in forms], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(forms, pa.string()), *(pa.array(c, mask=plain) for c in chars), pa.array(outputs, pa.binary())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output: a row for each row of docs.

    docs: doc_id and text. Texts that hold a mark already stay plain, and so do plain_percent of the others.
    """
    small_batches(docs.sparkSession)
    id_ = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)))
    made = rows.mapInArrow(_cut(plain_percent, spm_percent), f"doc_id {id_}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; each mark stands once in an output that isn't plain."""
    after = lambda mark: F.substring_index(output, mark, -1)
    psm = F.concat(F.substring_index(after(PREFIX), SUFFIX, 1), after(MIDDLE), F.substring_index(after(SUFFIX), MIDDLE, 1))
    spm = F.concat(F.substring_index(after(PREFIX), MIDDLE, 1), after(MIDDLE), F.substring_index(after(SUFFIX), PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
