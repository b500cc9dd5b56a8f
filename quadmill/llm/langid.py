"""Language identification by compression.

Each learned language has a zstandard raw-content dictionary, filled from a bounded sample of labelled
documents. A text, as its lower-cased words, is compressed piece by piece with every dictionary; the
language whose dictionary gives the fewest bytes wins. Pieces are short, so that a long text is explained
by the dictionaries and not by itself; all pieces of the whole text count. A piece is measured by what it adds
to a passage of the language, as the coder counts whole bytes and a short piece alone is too little for it. PADS passages
take turns; a text of fewer pieces goes round again until each passage has had one, and the mean of a piece's measures
counts. This holds for texts of all lengths. The answer is rejected
where it saves less than the part ``margin`` of the runner-up's bytes. Of texts under STEADY bytes the margin
is larger, as chance leads go with one over the root of the length.

Fitting reads labelled rows twice: counts by language, then about SAMPLE documents of each language,
picked by hash at a rate that follows from its count, and of each STRATA pieces, one at a hashed place of each of STRATA
equal parts of the whole text; a text of up to SAMPLE_CHARS characters comes whole. What reaches the driver is bounded by about
1.5 * languages * SAMPLE * SAMPLE_CHARS whatever the table's size. All sampled documents get an equal share of
the dictionary, again by STRATA pieces of what was read; what short ones leave goes to the others. The bound is one on rows and on the
dictionary's size: no part of a text is left out by rule.

Defined results: null texts and texts without a letter are ``und`` with score 0; without a learned
language everything is ``und``; labels that are null or belong to null ids are not learned; ties go to the
smaller language name; repeated rows get equal answers; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SAMPLE, SAMPLE_CHARS, STRATA = 400, 4000, 8
DICTIONARY_BYTES, PIECE = 200_000, 1500
#: Between the leads of labelled rows and those of random letters at sf0.1, where both were measured.
MARGIN, STEADY = 0.02, 800
PADS, PAD_BYTES = 4, 400
UND = "und"
LETTER = regex.compile(r"\p{L}")
LETTERS = re.compile(r"[^\W\d_]+")
PARAMETERS = {"window_log": 18, "chain_log": 16, "hash_log": 17, "search_log": 2, "min_match": 4, "target_length": 4, "strategy": zstandard.STRATEGY_GREEDY}
Model = dict[str, tuple[bytes, list[bytes]]]


def fit(docs: DataFrame, learnable: Column, sample: int = SAMPLE) -> Model:
    """Language -> the contents of its dictionaries, from rows where learnable holds."""
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    n = F.char_length("text")

    def piece(i: Column) -> Column:
        begin, end = F.floor(i * n / STRATA), F.floor((i + 1) * n / STRATA)
        take = F.least(end - begin, F.lit(SAMPLE_CHARS // STRATA))
        return F.substring("text", (begin + F.pmod(F.xxhash64("doc_id", i), end - begin - take + 1) + 1).cast("int"), take.cast("int"))

    read = F.transform(F.sequence(F.lit(0), F.lit(STRATA - 1)), piece)
    pieces = F.when(n > SAMPLE_CHARS, F.array_join(read, " ")).otherwise(F.array_join(read, ""))
    rate = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, 1.5 * sample / n) * (1 << 30))))))
    picked = rows.where(place < rate[F.col("lang")]).select("lang", pieces.alias("text"), place.alias("place"), "doc_id").collect()
    model: Model = {}
    for lang in sorted(counts):
        own = [words(t) for _, t in sorted({(r.place, r.text) for r in picked if r.lang == lang})[:sample]]
        model[lang] = content(own)
    return {lang: made for lang, made in model.items() if len(made[0]) >= 8}


def words(text: str) -> bytes:
    return " ".join(LETTERS.findall(text.lower())).encode()


def shared_out(sizes: list[int], room: int) -> int:
    """The most bytes of one text, so that all texts together fill the room."""
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) > room:
            return room // (len(sizes) - i)
        room -= n
    return max(sizes, default=0)


def spread(text: bytes, room: int) -> bytes:
    """The text, or room bytes of pieces from all its parts."""
    if len(text) <= room:
        return text
    ends = [room * i // STRATA for i in range(STRATA + 1)]
    starts = (len(text) * i // STRATA for i in range(STRATA))
    return b"".join(text[at : at + e - b - 1] + b" " for at, b, e in zip(starts, ends, ends[1:], strict=False) if e > b)


def content(own: list[bytes]) -> tuple[bytes, list[bytes]]:
    """The dictionary, which all texts share, and the passages; these come from texts beside the dictionary's where there are enough."""
    joined = b" ".join(own)
    apart = max(0, min(len(joined) // 4, PADS * PAD_BYTES))
    rest, at = [], 0
    for text in own:
        rest.append(text[max(0, apart - at) :])
        at += len(text) + 1
    most = shared_out([len(x) + 1 for x in rest], DICTIONARY_BYTES)
    return b" ".join(spread(x, max(0, most - 1)) for x in rest), [p for i in range(PADS) if (p := joined[: max(apart, 1)][i * PAD_BYTES : (i + 1) * PAD_BYTES])] or [b""]


def least_lead(n: int, margin: float) -> float:
    """The lead that a text of n bytes needs."""
    return margin * max(1.0, math.sqrt(STEADY / max(1, n)))


class Compressors:
    def __init__(self, model: Model):
        self.names, self.own = sorted(model), []
        how = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **PARAMETERS)
        for name in self.names:
            data, pads = model[name]
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=how)
            one = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how)
            self.own.append((one.compress, [(p, len(one.compress(p))) for p in pads]))

    def sizes(self, text: bytes) -> np.ndarray:
        """Compressed bytes for each language."""
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        turns = -(-PADS // max(1, len(pieces)))  # of each piece
        out = []
        for compress, pads in self.own:
            total = 0
            for i, piece in enumerate(pieces):
                for t in range(turns):
                    pad, alone = pads[(i * turns + t) % len(pads)]
                    total += len(compress(pad + b" " + piece)) - alone
            out.append(total / turns)
        return np.array(out)


def _identified(model: Model, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Compressors(model)
        for batch in batches:
            lang, score, rejected = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                if not own.names or text is None or not LETTER.search(text):
                    lang.append(UND)
                    score.append(0.0)
                    rejected.append(True)
                    continue
                bare = words(text)
                sizes = own.sizes(bare)
                best = int(sizes.argmin())
                others = np.delete(sizes, best)
                lead = float((others.min() - sizes[best]) / max(1.0, others.min())) if len(others) else 1.0
                lang.append(own.names[best])
                score.append(lead / (lead + 0.02) if lead > 0 else 0.0)
                rejected.append(lead < least_lead(len(bare), margin))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["n", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, key: Column, margin: float = MARGIN) -> DataFrame:
    """n (the key, a long), lang_pred, score (0 to 1: how clear the lead is), rejected."""
    small_batches(docs.sparkSession)
    return docs.select(key.cast("long").alias("n"), F.col("text").cast("string").alias("text")).mapInArrow(_identified(model, margin), "n long, lang_pred string, score double, rejected boolean")


def _filtered(model: Model, margin: float, at: int):
    inner = _identified(model, margin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(np.arange(batch.num_rows), pa.int64())
            (told,) = inner(iter([pa.RecordBatch.from_arrays([ids, batch.column(at).cast(pa.string())], names=["n", "text"])]))
            yield batch.filter(pa.array([not x for x in told.column(3).to_pylist()], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """The rows of docs whose language is told, with all their columns."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_filtered(model, margin, docs.columns.index("text")), docs.schema)
