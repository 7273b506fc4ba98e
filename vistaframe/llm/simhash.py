"""Operator 8: SimHash near-duplicates by a binary-trie self-join.

Fingerprints (64 bits over four-word shingles) are made in Arrow batches.
Distinct ones form a binary trie; pairs of its nodes are walked together,
adding up differing bits, and a pair of nodes is left as soon as its errors
exceed the budget. Two facts keep that walk narrow:

* a pair within 4 bits has at most 2 errors in its upper 32 bits, or at most
  1 in its lower 32. So the trie is walked in two bit orders, upper half first
  with a budget of 2 there, lower half first with 1, and 4 over all (and so for
  any split of a budget over parts of the bits);
* node pairs whose leaves all lie in one component already are left as well:
  only components are wanted, and a first walk with a budget of 1 has joined
  the dense groups.

The top of the trie is dealt out by Spark: a node pair at ``depth`` bits is a
group, and a fingerprint goes to each group whose budget it can still meet.
A group gives out at most one link a fingerprint (to the least of its local
component), never all pairs. Copies share one fingerprint and are not paired.

Four bits find copies that are all but equal. A ``Wider`` rule adds links between
texts whose similarity on five-word shingles is 0.8 or more, whatever their bits:
``similar.py`` finds and verifies them. The pipeline uses it.

Defined results: no word gives fingerprint zero, which links like any other;
fewer than four words are one shingle; a null text is empty; a null doc_id
belongs to a component but never names it unless there is no other; repeated
rows share a fingerprint, and rows of one doc_id with different texts are judged
each by its text; a pair at exactly the budget is linked; a very long text is
hashed whole, a bounded number of shingles at a time; an empty table gives no
rows; further columns are not carried (``drop_near_duplicates`` carries all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_batches
from ..storage import written
from .common import column, shuffles, table
from .components import components
from .similar import Wider, grouped, least_hashes, similar_links, sketch_of, with_bands

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Odd multipliers that spread bits.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Fingerprints under one node of the trie's dealt top, about, and that top's least depth.
PER_NODE, LEAST_DEPTH = 1 << 18, 6
BLOCK, LEAF, CHUNK = 1 << 20, 64, 1 << 18
MAX_BROADCAST_ROWS = 1_000_000
#: Bytes of a row of a few longs.
ROW_BYTES = 32


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, a bounded number at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space, only
    if not words:
        return
    grams = iter([b" ".join(words)]) if len(words) <= shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    while part := [digest(g, SEED) for g in islice(grams, CHUNK)]:
        yield np.array(part, "<u8")


def longer(h: np.ndarray, last: np.ndarray | None, alone: bool) -> np.ndarray:
    """Hashes of shingles one word longer, from those of neighbours; ``alone``: a text's only one stands for itself."""
    h = h if last is None else np.append(last, h)
    pair = h if alone else (h[:-1] * MIX[0]) ^ ((h[1:] >> np.uint64(31)) * MIX[1]) ^ h[1:]
    return (pair ^ (pair >> np.uint64(29))) * MIX[2]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles of one word more than ``shingle``."""
    h = np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, shingle)])
    return np.unique(longer(h, None, len(h) == 1)) if len(h) else h


def signature(text: str | None, shingle: int = SHINGLE, sketched: bool = False) -> tuple[int, bytes | None]:
    """The fingerprint as a signed 64-bit integer and, if asked for, the sketch."""
    fp, least, _ = signed(text, shingle, sketched)
    return fp, sketch_of(least) if sketched else None


def signed(text: str | None, shingle: int = SHINGLE, hashed: bool = False) -> tuple[int, np.ndarray | None, int]:
    """The fingerprint, if asked for the least hashes of the shingles one word longer, and the number of shingles."""
    n, bits, last, least = 0, np.zeros(64, np.int64), None, least_hashes(None)
    for h in shingle_hashes(text, shingle):
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
        if hashed:
            least = least_hashes(longer(h, last, n == 1), least)
            last = h[-1:]
    fp = int(np.packbits(2 * bits > n, bitorder="little").view("<i8")[0]) if n else 0
    return fp, least if hashed else None, n


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return signature(text, shingle)[0]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", sketched: bool = False, noded: bool = False) -> DataFrame:
    """(doc_id, fp) for every row, fp a long; with ``noded`` also node (a hash of the
    text), with ``sketched`` node, n (shingles), sketch and bands."""
    noded = noded or sketched

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(t.as_py(), shingle, sketched) for t in batch.column(2)]
            out = [batch.column(0), pa.array([x[0] for x in found], pa.int64())]
            names = ["doc_id", "fp"]
            if noded:
                out, names = [*out, batch.column(1)], [*names, "node"]
            if sketched:
                out = [*out, pa.array([x[2] for x in found], pa.int64()), *with_bands([x[1] for x in found])]
                names = [*names, "n", "sketch", "bands"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, fp long" + ", node long" * noded + ", n long, sketch binary, bands array<long>" * sketched
    return map_batches(docs.select(F.col("doc_id").cast("long"), node_of(text), F.col(text)), kernel, schema)


def node_of(text: str = "text") -> Column:
    """A text as a long: its hash."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("node")


class Linker:
    """Local components of sorted fingerprints, while links come in."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._recount()

    def _recount(self) -> None:
        self.change = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else self.label

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            if not (a != b).any():
                break
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
        self.label = label
        self._recount()

    def joined(self, alo, ahi, blo, bhi) -> np.ndarray:
        """Whether all leaves of both nodes are in one component."""
        c = self.change
        return (c[ahi - 1] == c[alo]) & (c[bhi - 1] == c[blo]) & (self.label[alo] == self.label[blo])


@dataclass
class Order:
    """A bit order (rotation to the left) and the errors allowed in its first bits."""

    turn: int
    length: int
    budget: int


def orders_for(bits: int) -> list[Order]:
    """Split the 64 bits so that a pair within ``bits`` meets the first budget of one
    order: if each part had more errors than its budget, there were over ``bits``."""
    parts = 2 if bits <= 5 else 3
    each, more = divmod(bits + 1 - parts, parts)
    lengths = [64 // parts + (i < 64 % parts) for i in range(parts)]
    return [Order(sum(lengths[:i]), lengths[i], each + (i < more)) for i in range(parts) if each + (i < more) >= 0]


def rotated(x: np.ndarray, turn: int) -> np.ndarray:
    return (x << np.uint64(turn)) | (x >> np.uint64(64 - turn)) if turn else x


def walk(keys: np.ndarray, first: tuple[int, int], second: tuple[int, int], order: Order, budget: int, depth: int, linker: Linker) -> None:
    """Walk the node pairs below two nodes (ranges of the sorted ``keys``, equal for a
    node with itself) and link the leaves within ``budget``. ``depth``: bits that
    all keys of a node share."""
    zeros: dict[int, np.ndarray] = {}

    def below(d: int) -> np.ndarray:
        if d not in zeros:
            zeros[d] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1) == 0)])
        return zeros[d]

    start_err = int(np.bitwise_count((keys[first[0]] ^ keys[second[0]]) >> np.uint64(64 - depth))) if depth else 0
    if start_err > min(budget, order.budget):
        return
    one = np.array([1])
    stack = [(depth, one * first[0], one * first[1], one * second[0], one * second[1], one * start_err)]
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        todo = ~linker.joined(alo, ahi, blo, bhi)
        alo, ahi, blo, bhi, err = (x[todo] for x in (alo, ahi, blo, bhi, err))
        size = (ahi - alo) * (bhi - blo)
        leaf = (size <= LEAF) | (d >= 64)
        if leaf.any():
            compare(keys, alo[leaf], ahi[leaf], blo[leaf], bhi[leaf], budget, linker)
        alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        z = below(d)
        amid, bmid = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        itself = (alo == blo) & (ahi == bhi)
        most = min(budget, order.budget) if d < order.length else budget
        parts = []
        for a0, a1, b0, b1, more, twice in ((alo, amid, blo, bmid, 0, False), (amid, ahi, bmid, bhi, 0, False), (alo, amid, bmid, bhi, 1, False), (amid, ahi, blo, bmid, 1, True)):
            ok = (a0 < a1) & (b0 < b1) & (err + more <= most)
            if twice:
                ok &= ~itself
            parts.append([x[ok] for x in (a0, a1, b0, b1, err + more)])
        new = [np.concatenate(x) for x in zip(*parts, strict=True)]
        for at in range(0, len(new[0]), BLOCK):
            stack.append((d + 1, *(x[at : at + BLOCK] for x in new)))


def compare(keys, alo, ahi, blo, bhi, budget: int, linker: Linker) -> None:
    """Compare all leaves of small node pairs, in blocks."""
    nb = bhi - blo
    size = (ahi - alo) * nb
    ends = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4 * BLOCK, "right")))
        s = size[lo:hi]
        of = np.repeat(np.arange(lo, hi), s)
        k = np.arange(len(of)) - np.repeat(np.cumsum(s) - s, s)
        i, j = alo[of] + k // nb[of], blo[of] + k % nb[of]
        new = linker.label[i] != linker.label[j]
        i, j = i[new], j[new]
        good = np.bitwise_count(keys[i] ^ keys[j]) <= budget
        if good.any():
            linker.add(i[good], j[good])
        lo = hi


def _links(depth: int, orders: list[Order], budget: int):
    """Groups of rows (group, key), ascending by group, to links (u, v) of signed fingerprints."""

    def of_group(group: int, keys: np.ndarray) -> pa.RecordBatch:
        order = orders[group % len(orders)]
        keys = np.sort(keys)
        linker = Linker(len(keys))
        top = keys >> np.uint64(64 - depth)
        cut = int(np.searchsorted(top, top[-1])) if top[0] != top[-1] else 0
        first, second = ((0, cut), (cut, len(keys))) if cut else ((0, len(keys)),) * 2
        for most in sorted({min(1, budget), budget}):
            walk(keys, first, second, order, most, depth, linker)
        child = np.flatnonzero(linker.label != np.arange(len(keys)))
        fps = rotated(keys, (64 - order.turn) % 64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fps[linker.label[child]]), pa.array(fps[child])], ["u", "v"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, (keys,) in grouped(batches):
            yield of_group(group, keys.view(np.uint64))

    return kernel


def link_fingerprints(fps: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) that join all of the distinct fingerprints ``fps`` (fp) which chains
    of near pairs join. ``n``: about how many there are."""
    orders = orders_for(max_bits)
    depth = max(LEAST_DEPTH, int(np.ceil(np.log2(max(n, 1) / PER_NODE))))
    dealt = None
    for number, order in enumerate(orders):
        masks = [m for m in range(1 << depth) if m.bit_count() <= order.budget]
        key = F.col("fp") if not order.turn else F.shiftleft("fp", order.turn).bitwiseOR(F.shiftrightunsigned("fp", 64 - order.turn))
        top = F.shiftrightunsigned(key, 64 - depth)
        other = top.bitwiseXOR(F.col("m"))
        masked = fps.select("fp", F.explode(F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")).alias("m"))
        pair = F.call_function("shiftleft", F.least(top, other), F.lit(depth)) + F.greatest(top, other)
        rows = masked.select((len(orders) * pair + number).alias("g"), key.alias("key"))
        dealt = rows if dealt is None else dealt.unionByName(rows)
    dealt = dealt.repartition(max(shuffles(fps.sparkSession), 8), "g").sortWithinPartitions("g")
    return map_batches(dealt, _links(depth, orders, max_bits), "u long, v long")


def _classes(docs: DataFrame, max_bits: int, shingle: int, wider: Wider | None, name: Column, noded: bool) -> tuple[DataFrame, int]:
    """The rows of ``fingerprints`` and ``named``, the least ``name`` of each row's component; and
    the bytes of a table of some longs for each row."""
    rows = written(fingerprints(docs, shingle, sketched=wider is not None, noded=noded), "fingerprints")
    size = rows.count() * ROW_BYTES  # of the tables of a row for each fingerprint, at most
    distinct = written(rows.groupBy("fp").agg(F.min(name).alias("least")), "distinct", size)
    links = link_fingerprints(distinct.select("fp"), distinct.count(), max_bits)
    most = None
    if wider:
        links = similar_links(docs.select(node_of(), "text"), rows, written(links, "links"), wider, shingle)
        most = links.count()
    labels = components(links, n=most)
    of = distinct.join(labels, distinct["fp"] == labels["node"]).select("fp", "label", "least")
    named = of.groupBy("label").agg(F.min("least").alias("named"))
    linked = of.join(named, "label").select("fp", "named")
    # a table of its own, so that the last join has an exchange on either side and adaptive
    # execution may split a fingerprint that many copies share
    known = written(distinct.join(linked, "fp", "left").select("fp", F.coalesce("named", "least").alias("named")), "known", size)
    return rows.join(known, "fp", "left").select("doc_id", *(["node"] if noded else []), "fp", "named"), size


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, wider: Wider | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    return _classes(docs, max_bits, shingle, wider, F.col("doc_id"), False)[0].withColumnRenamed("named", "component_id")


def drop_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, wider: Wider | None = None) -> DataFrame:
    """The documents, all their columns, with one row of each component: that of the
    least doc_id (a null one only where there is no other), and of those the one of
    the least hash of the text. Rows are told apart by doc_id and text, so rows of
    one doc_id, or of none, stay as long as their texts are unlike; of rows alike in
    both any one stays."""
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    found, size = _classes(docs, max_bits, shingle, wider, first, True)
    stays = F.col("doc_id").eqNullSafe(F.col("named")["doc_id"]) & (F.col("node") == F.col("named")["node"])
    keys = found.select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"), stays.alias("__stays"))
    keys = keys.groupBy("__id", "__node", "__stays").agg(F.count("*").alias("__n")).where("not __stays or __n > 1")
    keys = written(keys, "components", size)
    n = keys.count()
    few = F.broadcast if n <= MAX_BROADCAST_ROWS else lambda df: df  # of two longs each
    met = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (node_of() == F.col("__node"))
    kept = docs.join(few(keys.where("not __stays")), met, "left_anti")
    again = keys.where("__stays")
    if not again.limit(1).count():
        return kept
    once = kept.join(few(again), met, "left_semi")
    names = [f"__{i}" for i in range(len(docs.columns))]
    once = once.select(*(column(c).alias(a) for c, a in zip(docs.columns, names, strict=True)), F.col("doc_id").cast("long").alias("__id"), node_of().alias("__node"))
    once = once.dropDuplicates(["__id", "__node"]).select(*(F.col(a).alias(c) for c, a in zip(docs.columns, names, strict=True)))
    return kept.join(few(again), met, "left_anti").unionByName(once)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
