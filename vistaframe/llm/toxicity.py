"""Operator 6: toxicity by multiple-instance learning.

Only documents are labelled; sentences are scored. A sentence's probability is
logistic in the weights of its words; a document's is the noisy-or of its
sentences, ``1 - prod(1 - p)``. The weights are fitted to document labels
through that formula (full-batch AdaGrad with an L2 penalty), so credit goes to
the sentences that can explain a label, and the same scores later locate them.
A word's weight is the sum of those of the word and of its first letters, so
forms that training never saw are judged by their stem.

Scores must not climb with length alone. The fit's bias gives a sentence without
a feature a small probability, which explains labels that no sentence does; it is
taken out of every sentence's probability when texts are scored. And faint ones add
up only within a passage of ``PASSAGE`` sentences: a document's score is that of its
most harmful passage, wherever that begins; a shorter document is one passage.

The fit uses a bounded sample: at most ``per_class`` labelled documents of each
label, those of least hash of doc_id, of at most ``max_chars`` characters each.
Everything else runs over all whole texts, row by row, without a shuffle.

Labels, lang, source and doc_id are no inputs of a score. Rows with
``crc32(doc_id as text) % 5 = 0`` are held out of the fit, and null ids too.

Defined results: a null or empty text has no sentence and scores 0; a very long
text is scored whole, and by its most harmful passage, so harmless sentences add
nothing however many they are; of rows of one doc_id the fit takes the least text;
ties in the sample go by doc_id; a doc_id labelled both ways, or with null, is not used; repeated rows score alike;
without any usable label of both kinds all scores are 0; an empty table gives
no rows; ``keep`` names the columns to carry.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_batches
from .common import column, table

PER_CLASS, MAX_CHARS, FOLDS = 2500, 20_000, 5
PREFIXES, LEAST_DOCS, LEAST_LIFT = range(3, 9), 3, 2
ROUNDS, RATE, PENALTY, BIAS = 300, 1.0, 1e-5, -7.0
WORD, STOP = re.compile(r"[^\W_]+"), re.compile(r"[.!?]")
SETTLE = 25
PASSAGE = 64
#: Added to the weight of a token that ends a sentence.
ENDS = 1e6
MOST_TOKENS_KEPT = 100_000


class Model(NamedTuple):
    """Weights, above zero only, of whole words and of beginnings (of longer words)."""

    words: dict[str, float]
    beginnings: dict[str, float]
    bias: float


def tokens_of(text: str | None) -> list[str]:
    """Tokens in lower case, between white space; a line's end is a token that ends a sentence."""
    return (text or "").lower().replace("\n", " . ").split()


def features_of(token: str) -> list[str]:
    """A token's words, marked by ``=``, and their beginnings, short of the whole."""
    out = []
    for word in WORD.findall(token):
        out.append("=" + word)
        out += [word[:k] for k in PREFIXES if k < len(word)]
    return out


def fit(texts: list[str | None], labels: list[int], rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Fit the weights to document labels through the noisy-or.

    Weights stay at or above zero: words can only speak for toxicity, so a long
    sentence of harmless words cannot outvote one that is not.
    """
    if len(set(labels)) < 2:
        return Model({}, {}, -np.inf)
    # a token is held as text once; documents are arrays of numbers
    of: dict[str, int] = {}
    docs = [np.fromiter((of.setdefault(t, len(of)) for t in tokens_of(text)), np.int32) for text in texts]
    tokens, y = list(of), np.array(labels, float)
    # a weight at or above zero needs a feature that toxic documents have more often
    lift = LEAST_LIFT * y.sum() / (len(y) - y.sum())
    often: Counter[str] = Counter()
    for own, label in zip(docs, labels, strict=True):
        if label:
            often.update({f for t in np.unique(own) for f in features_of(tokens[t])})
    often = Counter({f: n for f, n in often.items() if n >= LEAST_DOCS})
    had = [[f for f in features_of(t) if f in often] for t in tokens]
    seldom: Counter[str] = Counter()
    for own, label in zip(docs, labels, strict=True):
        if not label:
            seldom.update({f for t in np.unique(own) for f in had[t]})
    known = {f: k for k, f in enumerate(sorted(f for f, n in often.items() if n >= lift * seldom[f]))}
    slots = [np.array([known[f] for f in fs if f in known], np.int32) for fs in had]
    width = np.array([len(k) for k in slots], int)
    stops = np.array([bool(STOP.search(t)) for t in tokens], bool)
    # sentences without a feature are alike: each document counts its own
    x, s, doc, plain, n = [], [], [], np.zeros(len(y)), 0
    for d, own in enumerate(docs):
        if not len(own):
            continue
        sentence = np.concatenate([[0], np.cumsum(stops[own])[:-1]])
        hit = width[own] > 0
        used, at = np.unique(np.repeat(sentence[hit], width[own[hit]]), return_inverse=True)
        if len(used):
            x.append(np.concatenate([slots[t] for t in own[hit]]))
            s.append(at + n)
            doc.append(np.full(len(used), d))
        plain[d] = sentence[-1] + 1 - len(used)
        n += len(used)
    x, s, doc = (np.concatenate(v).astype(int) if v else np.zeros(0, int) for v in (x, s, doc))
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both labels weigh alike
    w, b, seen_w, seen_b = np.zeros(len(known)), BIAS, np.full(len(known), 1e-8), 1e-8
    for turn in range(1, rounds + 1):
        z = b + np.bincount(s, w[x], n)
        p, p_plain = (1 / (1 + np.exp(-np.clip(v, -40, 40))) for v in (z, np.float64(b)))
        none = np.exp(-np.bincount(doc, np.logaddexp(0, z), len(y)) - plain * np.logaddexp(0, b))
        pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * share
        g = pull[doc] * p
        gw, gb = np.bincount(x, g[s], len(known)) + penalty, g.sum() + (pull * plain).sum() * p_plain
        seen_w += gw**2
        seen_b += gb**2
        w = np.maximum(0, w - rate * gw / np.sqrt(seen_w))
        b -= rate * gb / np.sqrt(seen_b)
        if turn % SETTLE == 0:  # features at zero that would rather fall stay there
            live = ((w > 0) | (gw < 0))[x]
            x, s = x[live], s[live]
            used, s = np.unique(s, return_inverse=True)
            plain += np.bincount(np.delete(doc, used), minlength=len(y))
            doc, n = doc[used], len(used)
    kept = {f: float(w[k]) for f, k in known.items() if w[k] > 0}
    return Model({f[1:]: v for f, v in kept.items() if f[0] == "="}, {f: v for f, v in kept.items() if f[0] != "="}, float(b))


def noisy_or(p: np.ndarray) -> float:
    """The probability that one at least of independent events occurs."""
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def document_score(p: np.ndarray) -> float:
    """The greatest noisy-or of ``PASSAGE`` sentences in a row."""
    if len(p) <= PASSAGE:
        return noisy_or(p)
    sums = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
    return float(-np.expm1((sums[PASSAGE:] - sums[:-PASSAGE]).min()))


class Scorer(dict):
    """Scores texts; as a dict it keeps the weights of tokens met before, up to a bound."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, token: str) -> float:
        words, beginnings, _ = self.model
        out = 0.0
        for word in WORD.findall(token):
            out += words.get(word, 0.0)
            for k in PREFIXES:
                if k >= len(word):
                    break
                out += beginnings.get(word[:k], 0.0)
        if STOP.search(token):
            out += ENDS
        if len(self) > MOST_TOKENS_KEPT:
            self.clear()
        self[token] = out
        return out

    def sentence_scores(self, text: str | None) -> np.ndarray:
        """A probability for each sentence, zero without a feature."""
        tokens = tokens_of(text)
        if not tokens or not np.isfinite(self.model.bias):
            return np.zeros(0)
        weight = np.fromiter(map(self.__getitem__, tokens), float, len(tokens))
        ends = weight >= ENDS / 2
        weight[ends] -= ENDS
        starts = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
        z = np.add.reduceat(weight, starts) + self.model.bias
        p, floor = (1 / (1 + np.exp(-np.clip(v, -40, 40))) for v in (z, np.float64(self.model.bias)))
        return (p - floor) / (1 - floor)

    def score(self, text: str | None) -> float:
        return document_score(self.sentence_scores(text))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that the fit never sees; a null id is one of them."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> tuple[list, list]:
    """The bounded sample: texts and labels, both held-out rows and ids labelled both ways apart."""
    free = labels.where(~held_out())
    one = free.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most and toxic in (0, 1)")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ranked = lambda rows: rows.withColumn("nth", F.row_number().over(Window.partitionBy("toxic").orderBy(*order)))
    chosen = ranked(one).where(F.col("nth") <= 2 * per_class).select("doc_id", "toxic")
    # 4 * per_class ids at most; some have no document, or a longer one. One scan finds both labels
    met = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(chosen), "doc_id")
    met = ranked(met.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))).where(F.col("nth") <= per_class)
    rows = met.orderBy("toxic", *order).select("text", "toxic").collect()
    return [r[0] for r in rows], [r[1] for r in rows]


def score_toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), locate: bool = False) -> DataFrame:
    """The columns of ``keep``, ``score``, and with ``locate`` the ordinals of the
    sentences that score half or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of words of the bounded sample
    own = docs.select(*(column(c).alias(f"__{i}") for i, c in enumerate(keep)))
    kept = list(own.schema.fields)
    at_text = keep.index("text") if "text" in keep else len(keep)  # a text that is kept goes out and comes in once
    if at_text == len(keep):
        own = docs.select(*(column(c).alias(f"__{i}") for i, c in enumerate(keep)), F.col("text").alias("__text"))
    schema = T.StructType(kept).add("__score", "double").add("__offending", T.ArrayType(T.IntegerType()))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.sentence_scores(t.as_py()) for t in batch.column(at_text)]
            at = [np.flatnonzero(p >= 0.5).tolist() if locate else None for p in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(map(document_score, found), pa.float64()), pa.array(at, pa.list_(pa.int32()))], schema.names)

    out = map_batches(own, kernel, schema)
    named = [F.col(f"__{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*named, F.col("__score").alias("score"), *([F.col("__offending").alias("offending")] if locate else []))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    return fit(*training_rows(docs, labels, per_class, max_chars))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all their columns, that score below one half."""
    names = ["text" if c == "text" else f"__{i}" for i, c in enumerate(docs.columns)]
    plain = docs.select(*(column(c).alias(n) for c, n in zip(docs.columns, names, strict=True)))
    scored = score_toxicity(plain, learn(docs, labels), tuple(names)).where("score < 0.5")
    return scored.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")), locate=True)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
