"""Operator 7: token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an
insert adds a document and its tokens, a delete takes them away, a revised
count does both. A batch is pre-aggregated, written aside, and committed by
one rename to a folder that bears its id and stays; a batch that is there already
is not applied again, so a retried or repeated commit changes nothing. ``compact``
folds committed batches into a snapshot that knows their ids; commits and other
compactions may run beside it.

Only additive aggregates cross the network (map-side sums first), so a source
with a third of all rows is one row for each task.

Defined results: null source, language or text are values of their own (a null
text has 0 tokens); very long texts are counted whole; repeated rows count each; groups that come to nothing are
left out; an empty batch commits and adds nothing; further columns are ignored.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_batches
from ..storage import delete, exists, names_in, rename_once, shared_dir, written
from .common import table, words_of
from .tokens import VOCABULARY, ids_of, vocabulary_path

KEYS = ("source", "lang", "version")
WORDS, BPE = "words@1", "byte_bpe_50k@1"
BATCH_SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, words, bpe): both counts of each whole text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(vocabulary)
        for batch in batches:
            *own, text = batch.columns
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(ids_of(t.as_py(), path)) for t in text], pa.int64())], ["doc_id", "source", "lang", "words", "bpe"])

    rows = docs.select(F.col("doc_id").cast("long"), "source", "lang", F.size(words_of(F.col("text"))).cast("long").alias("words"), "text")
    return map_batches(rows, kernel, "doc_id long, source string, lang string, words long, bpe long")


def inserts(rows: DataFrame, version: str, tokens: str, sign: int = 1) -> DataFrame:
    """Signed deltas of documents (source, lang and a count)."""
    return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).cast("long").alias("n_docs"), (sign * F.col(tokens)).cast("long").alias("n_tokens"))


def deletes(rows: DataFrame, version: str, tokens: str) -> DataFrame:
    return inserts(rows, version, tokens, -1)


def revisions(rows: DataFrame, old: tuple[str, str], new: tuple[str, str]) -> DataFrame:
    """Counts revised from one (version, column) to another."""
    return deletes(rows, *old).unionByName(inserts(rows, *new))


class TokenRollup:
    """A rollup kept in a folder of a file system whose rename is atomic and does not
    overwrite. ``batches/<id>`` stays for good as the mark of a commit; snapshots bear
    consecutive numbers and hold sums and the ids of all batches in them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, batch: str) -> str:
        return f"{self.path}/batches/{quote(batch, safe='')}"

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before (by this or another run)."""
        if exists(self.spark, self._at(batch)):
            return False
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).coalesce(8).write.parquet(f"{aside}/sums")
        return rename_once(self.spark, aside, self._at(batch))

    def _ids(self, number: int, kind: str = "ids") -> DataFrame:
        """Batches in a snapshot; ``folded``: those that it was the first to hold."""
        if number < 0:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(f"{self.path}/snapshots/{number:012d}/{kind}")

    def _state(self) -> tuple[int, list[str], DataFrame]:
        """Number of the newest snapshot (-1: none), the batches committed since, and
        the sums of just these two."""
        listed = names_in(self.spark, f"{self.path}/batches")
        found = names_in(self.spark, f"{self.path}/snapshots")
        number = int(found[-1]) if found else -1
        batches = self.spark.createDataFrame([(b,) for b in listed], "batch string")
        fresh = sorted(r[0] for r in batches.join(self._ids(number), "batch", "left_anti").collect())
        paths = [f"{self.path}/snapshots/{found[-1]}/sums"] if found else []
        paths += [f"{self.path}/batches/{b}/sums" for b in fresh]
        read = self.spark.read.schema(BATCH_SCHEMA)
        rows = read.parquet(*paths) if paths else self.spark.createDataFrame([], BATCH_SCHEMA)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return number, fresh, sums.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches."""
        return self._state()[2]

    def compact(self) -> bool:
        """Fold the batches committed so far into the next snapshot; False if another
        compaction was first, which leaves everything to that one. Files that the new
        snapshot replaces stay until the next compaction, for those who still read them."""
        number, fresh, sums = self._state()
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        folded = self.spark.createDataFrame([(b,) for b in fresh], "batch string")
        sums.coalesce(8).write.parquet(f"{aside}/sums")
        folded.coalesce(1).write.parquet(f"{aside}/folded")
        self._ids(number).unionByName(folded).write.parquet(f"{aside}/ids")
        if not rename_once(self.spark, aside, f"{self.path}/snapshots/{number + 1:012d}"):
            return False
        for row in self._ids(number, "folded").toLocalIterator():
            delete(self.spark, f"{self.path}/batches/{row[0]}/sums")
        if number > 0:
            delete(self.spark, f"{self.path}/snapshots/{number - 1:012d}")
        return True


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents by word counts, revise them to BPE counts, delete those
    labelled of low quality, and repeat a batch, which changes nothing."""
    ledger = written(count_tokens(table(spark, sf_dir, "documents")), "ledger")
    labels = table(spark, sf_dir, "labels")
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    atexit.register(delete, spark, rollup.path)
    rollup.commit("load", inserts(ledger, WORDS, "words"))
    rollup.commit("retokenize", revisions(ledger, (WORDS, "words"), (BPE, "bpe")))
    low = labels.where("quality = 0").select("doc_id").distinct()
    rollup.commit("purge", deletes(ledger.join(low, "doc_id", "left_semi"), BPE, "bpe"))
    rollup.commit("load", inserts(ledger, WORDS, "words"))
    return rollup.totals()
