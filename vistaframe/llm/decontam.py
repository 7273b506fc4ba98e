"""Operator 4: benchmark decontamination, in DataFrame functions alone.

The benchmark's windows of ten words (a shorter item is one window) form a
hash set, broadcast while its measured size stays below ``max_broadcast_mb``
and joined by shuffle beyond. Training documents are scanned window by
window, by array functions within the row: a bitmap over the hashes of the
windows' first words drops nearly all positions, and only what passes it
leaves the row as text and meets the hash set. The join is on the window's
text itself, so each hit is verified by the join.

Only passing windows and one row per document are shuffled; no document's
text is.

Defined results: a null or empty text has no words, no hit and no item; a
null or empty item has no window; windows of equal text count for all their
items; repeated rows are judged each for itself; an empty benchmark hits
nothing; further columns are carried only if ``keep`` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from .common import NOT_ALNUM, ascii_lower, column, table, words_of
from .lets import indices, let

WINDOW, FIRST = 10, 4
#: Bits of the bitmap for each window, and its least and greatest size in 64-bit words.
BITS_PER_WINDOW, LEAST_LONGS, MOST_LONGS = 64, 1 << 6, 1 << 16
MAX_BROADCAST_MB, MAX_BROADCAST_ROWS = 64, 1_000_000
#: Runs between words, in a text whose letters keep their case; the share of a document's words that may be cut.
SEPARATOR, MAX_SHARE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", 0.2


def bench_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: length, text, items (array)."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(ascii_lower(F.col("text")), NOT_ALNUM).alias("w"))
    n = F.least(F.size("w"), F.lit(window))
    starts = words.where(F.size("w") > 0).select("item", "w", n.alias("length"), F.explode(indices(F.size("w") - n + 1)).alias("at"))
    texts = starts.select("item", "length", F.array_join(F.slice("w", F.col("at") + 1, F.col("length")), " ").alias("window"))
    return texts.groupBy("length", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _slots(first: Column, longs: int) -> tuple[Column, Column]:
    """Where a window's first words stand in the bitmap: 64-bit word and bit."""
    h = F.xxhash64(first)
    return F.shiftrightunsigned(h, 16).bitwiseAND(F.lit(longs - 1)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")


def _bitmap(windows: DataFrame, first: int, longs: int) -> Column:
    """The bitmap over the first words of all windows, as an array literal."""
    heads = windows.select(F.array_join(F.slice(F.split("window", " "), 1, first), " ").alias("head")).distinct()
    slot, bit = _slots(F.col("head"), longs)
    rows = heads.groupBy(slot.alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).collect()
    bits = [0] * longs
    for slot_, value in rows:
        bits[slot_] = value
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")  # folded into one literal


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), max_broadcast_mb: float = MAX_BROADCAST_MB, every: bool = True) -> DataFrame:
    """One row per document: the columns of ``keep``, n_words, hits (array of
    start and length in words, ascending), items (distinct ids of items with
    occurring windows, sorted as strings). Without ``every``, documents no window
    of which passes the bitmap have no row."""
    windows = written(bench_windows(benchmark, window), "windows")
    sizes = windows.groupBy("length").agg(F.count("*").alias("n"), F.sum(F.octet_length("window") + 16 * F.size("items") + 64).alias("bytes")).collect()
    lengths, total = sorted(r["length"] for r in sizes), sum(r["n"] for r in sizes)
    small = sum(r["bytes"] for r in sizes) <= max_broadcast_mb * 1e6
    longs = LEAST_LONGS
    while longs < MOST_LONGS and longs * 64 < total * BITS_PER_WINDOW:
        longs *= 2

    bitmaps = {k: _bitmap(windows.where(F.col("length") == k), min(k, FIRST), longs) for k in lengths}

    def of_length(w: Column, length: int) -> Column:
        def passes(i: Column) -> Column:
            slot, bit = _slots(F.concat_ws(" ", *(F.get(w, i + k) for k in range(min(length, FIRST)))), longs)
            return F.call_function("shiftrightunsigned", F.get(bitmaps[length], slot), bit).bitwiseAND(F.lit(1).cast("long")) == 1

        cut = lambda i: F.struct(i.alias("start"), F.lit(length).alias("length"), F.array_join(F.slice(w, i + 1, F.lit(length)), " ").alias("window"))
        return F.transform(F.filter(indices(F.size(w) - (length - 1)), passes), cut)

    def candidates(w: Column) -> Column:
        return F.concat(*(of_length(w, k) for k in lengths)) if lengths else F.array().cast("array<struct<start:int,length:int,window:string>>")

    names = [column(c).alias(f"__{i}") for i, c in enumerate(keep)]
    scanned = docs.select(*names, F.monotonically_increasing_id().alias("__row"), F.inline(F.array(let(words_of(ascii_lower(F.col("text")), NOT_ALNUM), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), candidates(w).alias("found"))))))
    passed = scanned.select(*(f"__{i}" for i in range(len(keep))), "__row", "n_words", (F.inline_outer if every else F.inline)("found"))
    other = windows.select(F.col("length"), F.col("window"), F.col("items"))
    met = passed.join(F.broadcast(other) if small else other, ["length", "window"], "left")
    hit = F.when(F.col("items").isNotNull(), F.struct("start", "length"))
    # one row per document already leaves each map task, but for those whose windows went to a shuffled join
    by = met.groupBy("__row", *(f"__{i}" for i in range(len(keep))), "n_words").agg(F.sort_array(F.collect_list(hit)).alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return by.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)), "n_words", "hits", "items")


def words_hit(hits: Column) -> Column:
    """Words inside any of the hits; these ascend by start."""
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["start"] + x["length"]).alias("end"))
    return F.aggregate(hits, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all their columns, without those that hold a benchmark window.
    Rows are told apart by doc_id and text: one with a hit takes no other text along.
    What goes is broadcast up to ``MAX_BROADCAST_ROWS``, so texts stay where they are."""
    bad = find_hits(docs.select("doc_id", "text", digest().alias("__digest")), benchmark, window, ("doc_id", "__digest"), every=False)
    bad = written(bad.where(F.size("hits") > 0).select(F.col("doc_id").alias("__of"), F.col("__digest").alias("__at")).distinct(), "contaminated")
    if bad.count() <= MAX_BROADCAST_ROWS:  # of two longs each
        bad = F.broadcast(bad)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__of"]) & (digest() == bad["__at"]), "left_anti")


def digest() -> Column:
    """A text's hash; a null text's is that of the empty one."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def without_words(text: Column, hits: Column) -> Column:
    """The text without the words inside hits and what follows each up to the next word."""
    parts = F.split(text, SEPARATOR, -1)
    gaps = F.regexp_extract_all(text, F.lit(SEPARATOR), F.lit(0))

    def rebuilt(words: Column, gap: Column, lead: Column) -> Column:
        def piece(i: Column) -> Column:
            gone = F.exists(hits, lambda h: (h["start"] <= i) & (i < h["start"] + h["length"]))
            return F.when(gone, "").otherwise(F.concat(F.get(words, i), F.coalesce(F.get(gap, i + lead), F.lit(""))))

        return F.concat(F.when(lead == 1, F.get(gap, F.lit(0))).otherwise(""), F.array_join(F.transform(indices(F.size(words)), piece), ""))

    lead = F.when(text.rlike(f"^{SEPARATOR}"), 1).otherwise(0)
    return let(F.array_remove(parts, ""), lambda w: let(gaps, lambda g: rebuilt(w, g, lead)))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_share: float = MAX_SHARE) -> DataFrame:
    """The documents, all their columns, without the words of benchmark windows; those
    with more than ``max_share`` of their words in windows go. n_chars, if there, follows."""
    found = find_hits(docs.select("doc_id", "text", digest().alias("__digest")), benchmark, window, ("doc_id", "__digest"), every=False).where(F.size("hits") > 0)
    found = found.groupBy(F.col("doc_id").alias("__of"), F.col("__digest").alias("__at")).agg(F.first("n_words").alias("__n"), F.first("hits").alias("__hits"))
    met = docs.join(found, docs["doc_id"].eqNullSafe(found["__of"]) & (digest() == found["__at"]), "left")
    kept = met.where(F.col("__hits").isNull() | (words_hit(F.col("__hits")) <= max_share * F.col("__n")))
    cut = kept.withColumn("__cut", F.when(F.col("__hits").isNull(), F.col("text")).otherwise(without_words(F.col("text"), F.col("__hits"))))
    new = {"text": F.col("__cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__hits").isNull(), F.col("n_chars")).otherwise(F.length("__cut").cast(docs.schema["n_chars"].dataType))
    return cut.select(*(new.get(c, column(c)).alias(c) for c in docs.columns))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", words_hit(F.col("hits")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


OP4_SQL = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
h AS (SELECT p.rid, p.i, p.k, bw.item FROM p JOIN bw ON p.k = bw.k AND p.g = bw.g),
n AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM h) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""
