"""Operator 2: line-first quality rules, in DataFrame functions alone.

Each line that holds a word is judged by itself:

* symbols: three or more of ``#*$%&|<>``, more than one in 20 characters;
* marks: three or more of ``!?``, more than one in 20 characters;
* punctuation: 60 characters or more without any mark that ends a clause;
* navigation: three or more separators between blanks;
* boilerplate: a known phrase in a line of less than 200 characters.

Lines that fail are removed. A document that has lost more than 30 % of the
characters of its lines is rejected, as is one that fails the base rules.

Defined results: a null or empty text has no words and fails the base rules
(fewer than 50 words); a very long text is judged whole; repeated rows are
judged each for itself; an empty table gives no rows. Further columns of the
input are dropped, unless ``keep`` names them.

All work is within a row: no shuffle, and no state beyond one document. The
words of a window are compared by a 64-bit hash, within one document only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, table, words_of
from .lets import covered, indices, let

MIN_WORDS, MAX_REPEATED, MAX_LOST = 50, 50, 30
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[!?]"
CLAUSE_ENDS = r"[.!?:;…。！？]"
SEPARATORS = r" [|»›·•>] "
BOILERPLATE = (
    "all rights reserved|privacy policy|terms of (use|service)|cookie policy|we use cookies|accept cookies|enable javascript|"
    "javascript is disabled|licensed under|subscribe to our|sign up for|click here|share on (facebook|twitter)|powered by|skip to content"
)


def count_of(text: Column, one_character: str) -> Column:
    return F.size(F.split(text, one_character, -1)) - 1


def line_fails(line: Column) -> Column:
    n = F.length(line)
    symbols, marks = count_of(line, SYMBOLS), count_of(line, MARKS)
    return (
        let(symbols, lambda x: (x >= 3) & (20 * x > n))
        | let(marks, lambda x: (x >= 3) & (20 * x > n))
        | ((n >= 60) & ~line.rlike(CLAUSE_ENDS))
        | (count_of(line, SEPARATORS) >= 3)
        | ((n < 200) & line.rlike(f"(?i){BOILERPLATE}"))
    )


def _repeated(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in these words."""

    def marked(s: Column) -> Column:
        twice = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["i"]))

    windows = F.transform(indices(F.size(words) - 2), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    # get(s, -1) and get(s, n) are null, and null == h is null: no match at the ends unless the other side matches
    return covered(let(F.sort_array(windows), marked), 3)


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of ``keep``, the base counts, ``clean_text`` and the verdict."""
    whole = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")

    def lines_of(lines: Column) -> Column:
        good = F.filter(lines, lambda x: ~line_fails(x))
        return let(
            good,
            lambda g: F.struct(
                F.size(lines).cast("long").alias("n_lines"),
                F.size(g).cast("long").alias("n_lines_kept"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                F.length(F.array_join(lines, "")).cast("long").alias("line_chars"),
                F.length(F.array_join(g, "")).cast("long").alias("clean_chars"),
                F.array_join(g, "\n").alias("clean_text"),
            ),
        )

    def words_row(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), _repeated(words).cast("long").alias("n_repeat_words"))

    kept = [column(c).alias(f"__{i}") for i, c in enumerate(keep)]
    step = docs.select(*kept, whole.alias("__t")).select("*", F.inline(F.array(let(words_of(F.col("__t")), words_row))), count_of(F.col("__t"), SYMBOLS).cast("long").alias("n_symbols"))
    step = step.select("*", F.inline(F.array(let(F.filter(F.split("__t", "\n", -1), has_word), lines_of))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    lost = 100 * (F.col("line_chars") - F.col("clean_chars")) > MAX_LOST * F.col("line_chars")
    return step.select(
        *(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~lost).alias("kept"), "n_lines", "n_lines_kept", "line_chars", "clean_chars", "clean_text",
    )


def op2_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("clean_text")


OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
hit AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
g AS (SELECT rid, list_filter(lines, lambda x: NOT (
        (len(regexp_extract_all(x, '[#*$%&|<>]')) >= 3 AND 20 * len(regexp_extract_all(x, '[#*$%&|<>]')) > length(x))
        OR (len(regexp_extract_all(x, '[!?]')) >= 3 AND 20 * len(regexp_extract_all(x, '[!?]')) > length(x))
        OR (length(x) >= 60 AND NOT regexp_matches(x, '{CLAUSE_ENDS}'))
        OR len(regexp_extract_all(x, '{SEPARATORS}')) >= 3
        OR (length(x) < 200 AND regexp_matches(x, '(?i){BOILERPLATE}')))) AS good FROM w),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(good)::BIGINT AS n_lines_kept,
        length(array_to_string(lines, ''))::BIGINT AS line_chars, length(array_to_string(good, ''))::BIGINT AS clean_chars
      FROM w JOIN g USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * (line_chars - clean_chars) > {MAX_LOST} * line_chars) AS kept, n_lines, n_lines_kept, line_chars, clean_chars
FROM f
"""
