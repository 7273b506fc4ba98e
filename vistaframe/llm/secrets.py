"""Operator 5: secret scan over a trigram inverted index, in DataFrame functions alone.

1. Each rule's regex implies a Boolean query over trigrams (``trigram_query``).
2. The index holds, for each trigram that some rule asks for and each block of
   documents, the posting list of the block's documents that contain it. Blocks
   keep every list bounded (about ``per_block`` documents).
3. A rule's candidates in a block are unions of intersections of its postings.
4. Candidates are verified with the regex itself. A rule without mandatory
   trigrams is run over every text.

Postings hold a 64-bit hash of the doc_id, so null ids and repeated rows are
found as well; a collision only adds a candidate, which verification drops.

Defined results: a null or empty text has no spans; matches of a kind are
leftmost and do not overlap, kinds may overlap each other; spans are in code
points, end exclusive; repeated rows are scanned each for itself; an empty
table gives no rows; ``keep`` names the columns to carry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, table
from .lets import indices, let
from .secret_rules import ALL, RULES, Rule, trigram_query

PER_BLOCK = 4096
#: Candidates (a long and a few bytes each) that are broadcast at most; beyond, the join shuffles.
MAX_BROADCAST_ROWS = 1_000_000
SPANS = "array<struct<start:int,kind:int,end:int>>"
MASK = "[SECRET]"


def build_index(docs: DataFrame, trigrams: Sequence[str], blocks: int) -> DataFrame:
    """(block, trigram, posting): the inverted index of ``docs`` for these trigrams."""
    wanted = F.split(F.lit("\x01".join(trigrams)), "\x01")
    lower = F.lower(F.coalesce(F.col("text"), F.lit("")))
    key = F.xxhash64("doc_id")
    present = docs.select(key.alias("key"), F.explode(let(lower, lambda t: F.filter(wanted, lambda g: F.contains(t, g)))).alias("trigram"))
    return present.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("key").alias("posting"))


def _candidates(rule: Rule, postings: Column) -> Column:
    """Keys of a block's documents that meet the rule's query; ``postings``: trigram to list."""

    def of(trigram: str) -> Column:
        return F.coalesce(postings[trigram], F.array().cast("array<bigint>"))

    out = None
    for clause in sorted(map(sorted, trigram_query(rule.pattern))):
        both = of(clause[0])
        for trigram in clause[1:]:
            both = F.array_intersect(both, of(trigram))
        out = both if out is None else F.array_union(out, both)
    return out


def candidates(docs: DataFrame, rules: Sequence[Rule] = RULES, per_block: int = PER_BLOCK) -> DataFrame:
    """(key, kinds): documents that may match, with the places of the rules to verify."""
    asked = [(k, r) for k, r in enumerate(rules) if trigram_query(r.pattern) != ALL]
    trigrams = sorted({g for _, r in asked for c in trigram_query(r.pattern) for g in c})
    blocks = max(1, -(-docs.count() // per_block))
    index = build_index(docs, trigrams, blocks)
    by_block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "posting"))).alias("m"))
    found = F.array(*(F.struct(F.lit(k).alias("kind"), _candidates(r, F.col("m")).alias("keys")) for k, r in asked))
    rows = by_block.select(F.inline(found)).select("kind", F.explode("keys").alias("key"))
    return rows.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _matches(text: Column, rule: Rule, kind: int) -> Column:
    """Spans of one rule: the pieces between matches and the matches give the places."""
    pattern = F.lit(rule.pattern)
    none = F.array().cast(SPANS)

    def places(pieces: Column, found: Column, held: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            start = a["pos"] + F.length(F.get(pieces, i))
            return let(
                F.struct(start.alias("s"), (start + F.length(F.get(found, i))).alias("e")),
                lambda x: F.struct(x["e"].alias("pos"), F.when(F.length(F.get(held, i)) >= rule.least, F.concat(a["out"], F.array(F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"))))).otherwise(a["out"]).alias("out")),
            )

        zero = F.struct(F.lit(0).cast("int").alias("pos"), none.alias("out"))
        return F.aggregate(indices(F.size(found)), zero, lambda a, i: step(a, i).cast(f"struct<pos:int,out:{SPANS}>"), lambda a: a["out"])

    split, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    spans = let(split, lambda p: let(whole, lambda w: places(p, w, w) if not rule.group else let(held, lambda h: places(p, w, h))))
    return F.when(text.rlike(rule.pattern), spans).otherwise(none)


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = ("doc_id",), per_block: int = PER_BLOCK) -> DataFrame:
    """The columns of ``keep`` and ``spans``: structs of start, kind (place in
    ``rules``) and end, ascending."""
    found = candidates(docs.select("doc_id", "text"), rules, per_block).persist()
    few = found.count() <= MAX_BROADCAST_ROWS
    names = [column(c).alias(f"__{i}") for i, c in enumerate(keep)]
    texts = docs.select(*names, F.xxhash64("doc_id").alias("__key"), F.coalesce(F.col("text"), F.lit("")).alias("__t"))
    other = found.select(F.col("key").alias("__of"), "kinds")
    met = texts.join(F.broadcast(other) if few else other, F.col("__key") == F.col("__of"), "left")

    def spans(text: Column) -> Column:
        parts = []
        for k, r in enumerate(rules):
            here = _matches(text, r, k)
            parts.append(here if trigram_query(r.pattern) == ALL else F.when(F.array_contains("kinds", F.lit(k)), here).otherwise(F.array().cast(SPANS)))
        return F.sort_array(F.concat(*parts))

    return met.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)), spans(F.col("__t")).alias("spans"))


def spans_text(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def redact(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``mask``."""

    def step(a: Column, x: Column) -> Column:
        fresh = F.concat(a["out"], F.substring(text, a["pos"] + 1, x["start"] - a["pos"]), F.lit(mask))
        return F.when(x["start"] >= a["pos"], F.struct(x["end"].alias("pos"), fresh.alias("out"))).otherwise(F.struct(F.greatest(a["pos"], x["end"]).alias("pos"), a["out"].alias("out")))

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents, all their columns, with secrets masked and n_chars (if there) counted anew."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*(column(c).alias(n) for c, n in zip(docs.columns, names, strict=True)), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    found = scan_secrets(plain, rules, [*names, "text"])
    masked = found.select(*names, redact(F.col("text"), F.col("spans")).alias("masked"), (F.size("spans") > 0).alias("changed"))
    out = []
    for c, n in zip(docs.columns, names, strict=True):
        new = {"text": F.col("masked"), "n_chars": F.when(F.col("changed"), F.length("masked").cast(docs.schema[c].dataType)).otherwise(F.col(n))}
        out.append(new.get(c, F.col(n)).alias(c))
    return masked.select(*out)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _sql(rules: Sequence[Rule] = RULES) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    lists = []
    for k, r in enumerate(rules):
        p = quoted(r.pattern)
        lists.append(
            f"(SELECT coalesce(list({{'s': s, 'k': {k}, 'e': e}}), []) FROM (SELECT coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s, s + length(ms[i]) AS e "
            f"FROM (SELECT string_split_regex(t, {p}) AS ps, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {r.group}) AS gs), unnest(range(1, len(ms) + 1)) AS u(i) WHERE length(gs[i]) >= {r.least}))"
        )
    kinds = "[" + ", ".join(quoted(r.kind) for r in rules) + "]"
    said = lambda x: f"array_to_string(list_transform({x}, lambda y: {kinds}[y.k + 1] || ':' || y.s || ':' || y.e), ',')"
    n = lambda k: f"len(list_filter(a, lambda y: y.k = {k}))::BIGINT"
    joined = " || ".join(lists)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, list_sort({joined}) AS a FROM d) "
        f"SELECT doc_id, {n(0)} AS n_assign, {n(1)} AS n_access, {n(2)} AS n_hex, sha256({said('list_filter(a, lambda y: y.k < 3)')}) AS base_sha256, {said('a')} AS spans FROM f"
    )


OP5_SQL = _sql()
