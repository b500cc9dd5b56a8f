"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Two permutations make every signature coordinate: the first scatters the shingles, the second is
applied after a circular shift by the coordinate's number (C-MinHash, Li and Li 2022). Bands of four
coordinates give buckets; links are confirmed on the full shingle sets.

Work never grows with the square of a bucket. Documents with equal sets are one class, and only the
class' smallest document goes on. Each bucket is first tied as a star to its smallest member; then
only pairs that lie in different components are looked at: the likeliest few of each document first,
then all the others. Of a large bucket the members outside its largest component visit all its chunks, while
the others stay in theirs. No pair of a bucket goes unexamined unless both are in one component by then, or their
longer signatures (FINE coordinates) agree in so few that a similarity at the threshold is SIGMAS standard
deviations off. Classes of 1/HEAVY of all documents or more, of which there are HEAVY at most, meet their members
by a broadcast.

Defined results: null or wordless texts have no shingles and are linked with nothing; a text with fewer
words than a shingle is one shingle; null ids are returned with a null component and are not kept; rows
with one id are one document; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, gram_hashes, mix, parts, small_batches, word_hashes
from .graph import components, nearby

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Of the longer signature that candidates are compared by before their sets are; sigmas of doubt that it leaves.
FINE, SIGMAS = 1024, 4.5
CHUNK, HEAVY = 1024, 1000
U32 = np.uint32
SHIFTS = np.arange(FINE, dtype=U32)[:, None]


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Distinct hashed shingles, sorted. Splits at ASCII white space; lower-cases A-Z alone."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=U64)
    hashed = word_hashes(words)
    return np.unique(mix(gram_hashes(hashed, min(k, len(hashed))) ^ U64(len(words) if len(words) < k else 0)))


def signature(found: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    """The minimum under each shift of the second permutation; the first is in the upper half of the hash."""
    first = (found >> U64(32)).astype(U32)
    least = np.full(n, 0xFFFFFFFF, dtype=U32)
    with np.errstate(over="ignore"):
        for at in range(0, len(first), 1024):
            x = first[None, at : at + 1024] + SHIFTS[:n]
            x ^= x >> U32(16)
            x *= U32(0x7FEB352D)
            x ^= x >> U32(15)
            x *= U32(0x846CA68B)
            np.minimum(least, x.min(axis=1), out=least)
    return least


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    wide = coordinates.astype(U64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=U64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            key = mix(key * U64(0x9E3779B97F4A7C15) + wide[:, j])
    return key.view(np.int64)


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n, one, two, keys = [], [], [], []
            for text in texts:
                found = shingles(text.as_py(), k)
                n.append(len(found))
                with np.errstate(over="ignore"):
                    one.append(np.bitwise_xor.reduce(mix(found ^ U64(0x5851F42D4C957F2D))).view(np.int64) if len(found) else 0)
                    two.append(mix(found).sum(dtype=U64).view(np.int64) if len(found) else 0)
                keys.append(band_keys(signature(found)) if len(found) else np.empty(0, dtype=np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([shingles(x.as_py(), k).tobytes() for x in some.column(1)], pa.binary())], names=["doc_id", "found"])

    return run


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The size, the longer signature in bytes and the keys of the bands of each set."""
    for batch in batches:
        found = [np.frombuffer(x.as_py(), dtype=U64) for x in batch.column(1)]
        long = [signature(x, FINE) for x in found]
        fine = [(x >> U32(8)).astype(np.uint8).tobytes() for x in long]
        bands = [band_keys(x[:COORDINATES]).tobytes() for x in long]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, found), pa.int64()), pa.array(fine, pa.binary()), pa.array(bands, pa.binary())], names=["doc_id", "n_shingles", "fine", "bands"])


def _linked(percent: int):
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, seen = [], None, None
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                if (raw := x.as_py()) is not last:
                    last, seen = raw, np.frombuffer(raw, dtype=U64)
                other = np.frombuffer(y.as_py(), dtype=U64)
                small, big = (seen, other) if len(seen) < len(other) else (other, seen)
                if 100 * len(small) < percent * len(big):
                    good.append(False)
                    continue
                at = np.searchsorted(big, small)
                at[at == len(big)] = 0
                both = int((big[at] == small).sum())
                good.append(100 * both >= percent * (len(small) + len(big) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _crossing(percent: int, top: int | None):
    """Pairs of a visitor and a resident of one bucket that lie in different components and may reach the threshold; top: of each visitor, only its likeliest."""
    share = percent / 100

    def enough(n: int) -> float:
        return n * (share - SIGMAS * np.sqrt(share * (1 - share) / n))

    def group(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        doc, comp, n, visits, fine, bands, band, major = *(rows[c] for c in ("doc_id", "component", "n_shingles", "visits", "fine", "bands")), int(rows["band"][0]), rows["major"][0]
        short = np.ascontiguousarray(fine[:, :COORDINATES])
        a, b = [], []
        for x in np.flatnonzero(visits):
            fit = ~visits & (comp != comp[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
            fit &= (comp == major) | (doc > doc[x])  # two visitors meet twice
            at = np.flatnonzero(fit)
            if len(at) and band:
                at = at[~(bands[at, :band] == bands[x, :band]).any(axis=1)]  # they met in an earlier band
            if len(at):
                at = at[(short[at] == short[x]).sum(axis=1) >= enough(COORDINATES)]
                alike = (fine[at] == fine[x]).sum(axis=1)
                near = alike >= enough(FINE)
                at, alike = at[near], alike[near]
                if top and len(at) > top:
                    at = at[np.argsort(-alike, kind="stable")[:top]]
                a.append(np.full(len(at), doc[x]))
                b.append(doc[at])
        return (np.concatenate(a), np.concatenate(b)) if a else (doc[:0], doc[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = {c: whole.column(c).to_numpy(zero_copy_only=False) if c != "visits" else np.array(whole.column(c).to_pylist(), dtype=bool) for c in names}
            rows["fine"] = np.frombuffer(b"".join(whole.column("fine").to_pylist()), dtype=np.uint8).reshape(-1, FINE)
            rows["bands"] = np.frombuffer(b"".join(whole.column("bands").to_pylist()), dtype=np.int64).reshape(-1, BANDS)
            new = starts(whole)
            out = [group({c: v[i:j] for c, v in rows.items()}) for i, j in zip([0, *new], [*new, whole.num_rows], strict=True) if j - i > 1]
            if sum(len(x) for x, _ in out):
                a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        def starts(whole: pa.Table) -> np.ndarray:
            keys = [whole.column(c).to_numpy() for c in ("key", "ci", "cj")]
            return np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1

        names, held = ("key", "band", "ci", "cj", "visits", "doc_id", "component", "major", "n_shingles"), None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(new := starts(held)):  # a group has two chunks at most, so what is held stays small
                yield from done(held.slice(0, new[-1]).combine_chunks())
                held = held.slice(new[-1])
        if held is not None:
            yield from done(held.combine_chunks())

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept: a row for each row of docs.

    docs: doc_id and text; words: of a shingle; percent: 100 times the least Jaccard similarity of a link.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = scratch.write(text.mapInArrow(_signed(words), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"))
    least = F.lit(max(2, -(-signed.count() // HEAVY)))
    classes = signed.where("n_shingles > 0").groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep"), (F.count("*") >= least).alias("heavy"))
    reps = signed.join(classes.select(F.col("rep").alias("doc_id"), "n_shingles", "k1", "k2"), ["doc_id", "n_shingles", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    reps = scratch.write(reps.select("doc_id", "bands"))

    buckets = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    stars = buckets.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("far"), F.count("*").alias("size")).where("lead <> far")
    shared = scratch.write(buckets.join(stars, "key").select("key", "band", "doc_id", "lead", "size"))
    members = scratch.write(shared.select("doc_id").distinct())
    sets = scratch.write(text.join(members, "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, found binary").dropDuplicates(["doc_id", "found"]))

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("doc_id").alias("a"), F.col("found").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("found").alias("y"))
        return scratch.write(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(_linked(percent), "a long, b long"))

    edges = verified(shared.where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct())
    labels = scratch.write(nearby(edges))  # what it leaves apart is only looked at again
    fine = None  # the second round looks at no other documents than the first
    for top in (3, None):
        own = members.join(labels, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
        marked = shared.join(own, "doc_id").select("key", "band", "doc_id", "component", "size")
        of_component = marked.groupBy("key", "component").count()
        mixed = of_component.groupBy("key").agg(F.max(F.struct("count", "component")).alias("most"), F.sum("count").alias("all"), F.count("*").alias("n")).where("n > 1")
        mixed = mixed.select("key", F.col("most.component").alias("major"), (F.col("all") - F.col("most.count")).alias("visitors"))
        open_ = scratch.write(marked.join(mixed, "key"))
        if fine is None:
            fine = scratch.write(sets.join(open_.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_fine, "doc_id long, n_shingles long, fine binary, bands binary"))
        homes, tours = F.ceil(F.col("size") / CHUNK), F.ceil(F.col("visitors") / CHUNK)
        every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
        at_home, on_tour = F.pmod(F.xxhash64("doc_id"), homes).cast("int"), F.pmod(F.xxhash64("doc_id", F.lit(1)), tours).cast("int")
        residents = open_.select("*", F.lit(False).alias("visits"), at_home.alias("ci"), every(tours).alias("cj"))
        visitors = open_.where(F.col("component") != F.col("major")).select("*", F.lit(True).alias("visits"), every(homes).alias("ci"), on_tour.alias("cj"))
        dealt = (
            residents.unionByName(visitors).join(fine, "doc_id")  # each text of an id
            .select("key", "band", "ci", "cj", "visits", "doc_id", "component", "major", "n_shingles", "fine", "bands")
        )
        pairs = dealt.repartition(parts(spark), "key", "ci", "cj").sortWithinPartitions("key", "ci", "cj", "doc_id").mapInArrow(_crossing(percent, top), "a long, b long")
        more = verified(pairs)
        if top or not more.isEmpty():
            new = scratch.write(edges.union(more))
            scratch.drop(edges, labels)
            edges = new
            labels = scratch.write(components(edges, scratch))
        scratch.drop(open_, more)
    scratch.drop(shared, sets, edges, members)

    by = ["n_shingles", "k1", "k2"]
    reached = scratch.write(classes.join(labels, F.col("rep") == F.col("node"), "left").select(*by, F.coalesce("component", "rep").alias("component_id"), "heavy"))
    # Rows with one id are one document, whatever their texts.
    rows, heavy = signed.select("doc_id", *by), F.broadcast(reached.where("heavy").drop("heavy"))
    out = rows.join(heavy, by).unionByName(rows.join(heavy, by, "left_anti").join(reached.where("not heavy").drop("heavy"), by, "left"))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs less all near copies: of each group the document of the smallest id stays.

    Rows without an id stay. Where one id has several rows, each of its texts is a document, which counts as one of
    a larger id than any other, and equal rows of it (by id and text) become one.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))  # so no name of docs meets one of these
    id_, text = F.col("row").getField("doc_id").cast("long"), F.col("row").getField("text")
    named = rows.withColumn("own", id_)
    several = scratch.write(named.where("own IS NOT NULL").groupBy("own").count().where("count > 1").select("own"))
    if not several.isEmpty():
        text_own = F.xxhash64(id_, text).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
        some = named.join(several, "own", "left_semi").select("row", text_own.alias("own")).dropDuplicates(["own"])
        named = scratch.write(named.join(several, "own", "left_anti").select("row", "own").unionByName(some))
    told = near_duplicates(named.select(F.col("own").alias("doc_id"), text.alias("text")), words, percent)
    gone = told.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("own"))
    return named.join(gone, "own", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
