"""Texts of a Jaccard similarity of 0.8 or more on five-word shingles, for operator 8.

Candidates come from MinHash bands: of ``BANDS * ROWS`` hash functions, each band
joins the least values of ``ROWS``. A pair at the very threshold of 0.8 agrees in
no band with a probability of 0.672 ** 40 = 1.2e-7, a closer one with less.
Sketches (a byte of each of the first 64 functions) then spare pairs that agree in
fewer than ``LEAST_EQUAL`` of 64 slots, 6e-6 of those at 0.8. Every other
candidate is verified by the exact similarity of the whole texts' shingles.

Only components are wanted. So candidates whose fingerprints are in one component
already are left as well, and there are two rounds. In the first, each text of a
band's bucket is paired with the bucket's first, which joins large groups of near
copies by as many pairs as they have texts. In the second, what is still apart in
a bucket is compared within it: a task holds the shingle sets of a bucket's texts
that have a likely partner, and gives out one link for two components that meet,
never the pairs. A bucket of more than ``PER_BLOCK`` shingles is cut into parts,
and each two parts are a group of their own, so no task holds more than two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_batches
from ..storage import discard, written
from .common import shuffles
from .components import components

BANDS, ROWS, SLOTS, LEAST_EQUAL = 40, 5, 64, 36
MOST = np.uint32((1 << 32) - 1)
_RNG = np.random.Generator(np.random.PCG64(8))
#: Of each hash function: what the hash is xored with, and an odd multiplier.
XORS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
TIMES = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
SPREAD = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
STEP, BLOCK = 512, 1 << 16
MAX_BROADCAST_PAIRS = 1_000_000
#: Bytes of a text's row with sketch and bands, and of its rows in the buckets.
TEXT_BYTES, BUCKET_BYTES = 3 * 8 + SLOTS + 8 * BANDS, 3 * 8 * BANDS
#: Shingles of the texts in one part of a bucket.
PER_BLOCK = 1 << 19


@dataclass(frozen=True)
class Wider:
    """Links between texts of this exact similarity on five-word shingles, or more (not below 0.8, for which the bands are made)."""

    similarity: float = 0.8


def least_hashes(hashes: np.ndarray | None, least: np.ndarray | None = None) -> np.ndarray:
    """The least value of each hash function over 64-bit hashes, and over those before."""
    out = np.full(BANDS * ROWS, MOST) if least is None else least
    if hashes is not None:
        h = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(h), STEP):
            out = np.minimum(out, ((h[at : at + STEP] ^ XORS) * TIMES).min(1))
    return out


def sketch_of(least: np.ndarray) -> bytes:
    return ((least[:SLOTS] * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def with_bands(found: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Sketches and band keys."""
    least = np.array(found, np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
    mixed = ((least + np.uint64(1)) * SPREAD).sum(2, dtype=np.uint64)
    keys = (mixed ^ (mixed >> np.uint64(31))) * SPREAD[:, 0]
    offsets = np.arange(len(found) + 1, dtype=np.int32) * BANDS
    return pa.array(map(sketch_of, found), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Runs of rows of one value of the first column, ascending: it and the other columns.
    Longs are arrays, sketches (binaries of ``SLOTS``) lines of a matrix, longer binaries
    lists of arrays of hashes."""

    def plain(c: pa.Array):
        if not pa.types.is_binary(c.type):
            return c.to_numpy(zero_copy_only=False)
        return np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SLOTS)

    def joined(parts: list):
        return np.concatenate(parts) if isinstance(parts[0], np.ndarray) else [x for p in parts for x in p]

    group, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        g, *more = ([np.frombuffer(x, "<u8") for x in c.to_pylist()] if n == "hashes" else plain(c) for n, c in zip(names, batch.columns, strict=True))
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if g[lo] != group and held:
                yield int(group), [joined(x) for x in zip(*held, strict=True)]
                held = []
            group = g[lo]
            held.append([x[lo:hi] for x in more])
    if held:
        yield int(group), [joined(x) for x in zip(*held, strict=True)]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets (key, node, fp, label, sketch) to pairs of the first text and the others that
    are apart from it and whose sketches are not too unlike."""
    for _, (node, fp, label, sketch) in grouped(batches):
        i = np.lexsort((node, label))[0]
        j = np.flatnonzero((label != label[i]) & ((sketch == sketch[i]).sum(1) >= LEAST_EQUAL))
        if len(j):
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            fps = np.where(node[j] > node[i], fp[i], fp[j]), np.where(node[j] > node[i], fp[j], fp[i])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, *fps)], ["a", "b", "u", "v"])


def few_labels(label: np.ndarray) -> np.ndarray:
    """Rows of all labels but the most frequent one."""
    kinds, at, n = np.unique(label, return_inverse=True, return_counts=True)
    return np.flatnonzero(at != n.argmax()) if len(kinds) > 1 else np.zeros(0, int)


def _partners(i: int, label: np.ndarray, part: np.ndarray, cross: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Rows that are apart from row ``i``, to be compared in this group, and likely."""
    j = np.flatnonzero((label != label[i]) & ((part != part[i]) | ~cross.astype(bool)))
    return j[(sketch[j] == sketch[i]).sum(1) >= LEAST_EQUAL]


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (g, node, label, part, crossed, sketch) to the rows (g, part, crossed, node) that have a partner."""
    for g, (node, label, part, cross, sketch) in grouped(batches):
        has = np.zeros(len(node), bool)
        for i in few_labels(label):
            j = _partners(i, label, part, cross, sketch)
            has[j] = True
            has[i] |= len(j) > 0
        if has.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(has.sum(), g)), *(pa.array(x[has]) for x in (part, cross, node))], ["g", "part", "crossed", "node"])


def _linked(similarity: float):
    """Groups (g, node, fp, label, part, crossed, sketch, hashes) to links (u, v) between the
    components that hold similar texts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, fp, label, part, cross, sketch, hashes) in grouped(batches):
            size = np.array([len(h) for h in hashes])
            kinds, column = np.unique(np.concatenate(hashes), return_inverse=True)
            ends = np.cumsum(size)
            own = [column[e - n : e] for e, n in zip(ends, size, strict=True)]
            has, u, v = np.zeros(len(kinds), bool), [], []
            for i in few_labels(label):
                j = _partners(i, label, part, cross, sketch)
                j = j[(np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]) - 1e-9) & (size[j] > 0)]
                if not len(j):
                    continue
                has[own[i]] = True
                starts = np.concatenate([[0], np.cumsum(size[j])[:-1]])
                both = np.add.reduceat(has[np.concatenate([own[k] for k in j])], starts, dtype=np.int64)
                has[own[i]] = False
                for k in j[both >= similarity * (size[i] + size[j] - both) - 1e-9]:
                    if label[k] != label[i]:
                        u.append(fp[i])
                        v.append(fp[k])
                        label = np.where(label == label[k], label[i], label)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v)], ["u", "v"])

    return kernel


def _verify(similarity: float, shingle: int):
    """Rows (a, b, u, v, text), two a pair and side by side, to the links (u, v) whose texts are similar."""
    from .simhash import shingle_set

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, known = None, None
        for batch in batches:
            a, b, u, v = (batch.column(k).to_pylist() for k in range(4))
            good: list[int] = []
            for k in range(batch.num_rows):
                now = shingle_set(batch.column(4)[k].as_py(), shingle)
                if before == (a[k], b[k]):
                    both = len(np.intersect1d(known, now, assume_unique=True))
                    if both >= similarity * (len(known) + len(now) - both) - 1e-9:
                        good.append(k)
                before, known = (a[k], b[k]), now
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in good], pa.int64()) for x in (u, v)], ["u", "v"])

    return kernel


def _sets(shingle: int):
    """Rows (node, text) to (node, hashes): the distinct shingles."""
    from .simhash import shingle_set

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingle_set(t.as_py(), shingle).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["node", "hashes"])

    return kernel


def few(rows: DataFrame, n: int) -> DataFrame:
    """A broadcast up to a number of rows of a few longs."""
    return F.broadcast(rows) if n <= MAX_BROADCAST_PAIRS else rows


def _with_labels(own: DataFrame, links: DataFrame, n: int) -> DataFrame:
    labels = components(links, n=links.count()).withColumnRenamed("node", "at")
    of = own.join(labels, F.col("fp") == F.col("at"), "left").select("node", "fp", F.coalesce("label", "fp").alias("label"), "n", "sketch", "bands")
    return written(of, "labelled", n * TEXT_BYTES)


def _met(of: DataFrame, n: int) -> DataFrame:
    """(key, node) of the buckets that hold more than one component."""
    dealt = of.select("node", "label", "n", F.explode("bands").alias("key"))
    mixed = dealt.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("all")).where("lo <> hi")
    return written(dealt.join(mixed.select("key", "all"), "key").select("key", "node", "all"), "met", n * BUCKET_BYTES)


def _first_round(texts: DataFrame, of: DataFrame, n: int, wider: Wider, shingle: int, parts: int) -> DataFrame:
    """Links of texts to the first of a bucket that they share with it."""
    met = _met(of, n)
    buckets = met.join(of.select("node", "fp", "label", "sketch"), "node").select("key", "node", "fp", "label", "sketch")
    buckets = buckets.repartition(parts, "key").sortWithinPartitions("key")
    pairs = written(map_batches(buckets, _pairs, "a long, b long, u long, v long").distinct(), "pairs")
    met_pairs = pairs.count()
    sides = pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "u", "v")
    wanted = texts.join(few(sides.select("node").distinct(), met_pairs), "node", "left_semi").dropDuplicates(["node"])
    told = wanted.join(few(sides, met_pairs), "node").select("a", "b", "u", "v", "text")
    told = told.repartition(parts, "a", "b").sortWithinPartitions("a", "b")
    found = written(map_batches(told, _verify(wider.similarity, shingle), "u long, v long"), "similar")
    for done in (met, pairs):
        discard(done)
    return found


def _second_round(texts: DataFrame, of: DataFrame, n: int, wider: Wider, shingle: int, parts: int) -> DataFrame:
    """Links between texts that are still apart in a bucket."""
    met = _met(of, n)
    cut = met.withColumn("c", F.ceil(F.col("all") / PER_BLOCK).cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("node"), "c").cast("long"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c").cast("long") - 1)))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    cut = cut.select(F.when(F.col("c") == 1, F.col("key")).otherwise(F.xxhash64("key", lo, hi)).alias("g"), "part", (lo != hi).cast("long").alias("crossed"), "node")
    seen = cut.join(of.select("node", "label", "sketch"), "node").select("g", "node", "label", "part", "crossed", "sketch")
    seen = seen.repartition(parts, "g").sortWithinPartitions("g")
    likely = written(map_batches(seen, _likely, "g long, part long, crossed long, node long"), "likely")
    wanted = likely.select("node").distinct()
    sets = texts.join(few(wanted, likely.count()), "node", "left_semi").dropDuplicates(["node"])
    sets = written(map_batches(sets.select("node", "text"), _sets(shingle), "node long, hashes binary"), "sets")
    held = likely.join(of.select("node", "fp", "label", "sketch"), "node").join(sets, "node").select("g", "node", "fp", "label", "part", "crossed", "sketch", "hashes")
    held = held.repartition(parts, "g").sortWithinPartitions("g")
    found = written(map_batches(held, _linked(wider.similarity), "u long, v long"), "similar")
    for done in (met, likely, sets):
        discard(done)
    return found


def similar_links(texts: DataFrame, rows: DataFrame, links: DataFrame, wider: Wider, shingle: int) -> DataFrame:
    """``links`` (u, v) of fingerprints, and more, so that all texts of the similarity
    are joined. ``texts``: (node, text); ``rows``: (fp, node, n, sketch, bands)."""
    parts = max(shuffles(rows.sparkSession), 8)
    own = written(rows.groupBy("node").agg(*(F.min(c).alias(c) for c in ("fp", "n", "sketch", "bands"))), "texts", rows.count() * TEXT_BYTES)
    n = own.count()
    for another in (_first_round, _second_round):
        of = _with_labels(own, links, n)
        links = links.unionByName(another(texts, of, n, wider, shingle, parts))
        discard(of)
    return links
