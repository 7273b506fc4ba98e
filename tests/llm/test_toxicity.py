import random
import zlib

import numpy as np
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from vistaframe.llm.queries import QUERIES
from vistaframe.llm.toxicity import Scorer, drop_toxic, fit, learn, score_toxicity, tokens_of, training_rows

RNG = random.Random(1)
WORDS = [f"w{i}" for i in range(400)]


def sentence(bad=False):
    words = RNG.choices(WORDS, k=RNG.randint(4, 12))
    if bad:
        words.insert(RNG.randrange(len(words)), RNG.choice(["vile", "rotten", "grimlek" + RNG.choice(WORDS)]))
    return " ".join(words) + "."


def document(toxic, n=8):
    bad = RNG.randrange(n)
    return " ".join(sentence(toxic and i == bad) for i in range(n))


LABELS = [i % 3 == 0 for i in range(600)]
TEXTS = [document(x) for x in LABELS]


@pytest.fixture(scope="module")
def model():
    return fit(TEXTS, [int(x) for x in LABELS])


def test_held_out_accuracy_and_location(model):
    scorer, right, placed = Scorer(model), 0, 0
    for i in range(200):
        toxic = i % 2 == 0
        text = document(toxic)
        p = scorer.sentence_scores(text)
        right += (scorer.score(text) >= 0.5) == toxic
        if toxic:
            sentences = text.split(". ")
            placed += any(w in sentences[int(p.argmax())] for w in ("vile", "rotten", "grimlek"))
    assert right >= 190 and placed >= 95


def test_noisy_or(model):
    scorer = Scorer(model)
    text = "w1 w2. vile w3. w4"
    p = scorer.sentence_scores(text)
    assert len(p) == 3 and np.isclose(scorer.score(text), 1 - np.prod(1 - p)) and scorer.score("") == scorer.score(None) == 0
    assert tokens_of("A b\nC.") == ["a", "b", ".", "c."]


def test_no_usable_labels(docs_of, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in score_toxicity(docs_of(["a", None]), learn(docs_of(["a"]), labels)).collect()} == {0.0}
    assert drop_toxic(docs_of([]), labels).count() == 0


def test_training_rows_are_bounded_and_held_out_ones_apart(docs_of, spark):
    docs = docs_of([*enumerate(TEXTS), (0, "again"), (None, "null id")])
    labels = spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(LABELS)] + [(None, 1, 1), (7, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    texts, toxic = training_rows(docs, labels, per_class=50)
    assert len(texts) == 100 and sum(toxic) == 50
    held = {TEXTS[i] for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert not held & set(training_rows(docs, labels)[0]) and "null id" not in training_rows(docs, labels)[0]
    assert TEXTS[7] not in training_rows(docs, labels)[0]  # labelled both ways


def test_stage_keeps_columns_and_clean_rows(docs_of, spark):
    docs = docs_of([*enumerate(TEXTS), *[(900 + i, t) for i, (_, t) in enumerate(ODD)]]).withColumn("score", F.lit(1)).withColumn("__0", F.lit(2))
    labels = spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(LABELS)], "doc_id long, quality int, toxic int")
    out = drop_toxic(docs, labels)
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == docs.columns
    assert sum(i in kept for i in range(600) if not LABELS[i]) >= 395 and sum(i in kept for i in range(600) if LABELS[i]) <= 10
    assert {900 + i for i in range(len(ODD))} <= kept
    found = score_toxicity(docs, learn(docs, labels), ("doc_id",), locate=True).where("doc_id = 0").first()
    assert found["score"] >= 0.5 and len(found["offending"]) == 1


def test_accuracy_on_the_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in QUERIES["op6_toxicity"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(out[r["doc_id"]]["predicted"], r["toxic"]) for r in labels if out[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) >= 0.85
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())


def test_length_alone_is_not_toxic(model):
    scorer, rng = Scorer(model), random.Random(4)
    clean = " ".join(" ".join(rng.choices(WORDS, k=8)) + "." for _ in range(120_000))
    assert len(clean) > 3_000_000 and scorer.sentence_scores(clean).max() < 0.5 and scorer.score(clean) < 0.5
    assert scorer.score("plain talk. " * 300_000) == 0
    assert scorer.score(clean + " vile.") >= 0.5


def test_faint_sentences_do_not_add_up():
    from vistaframe.llm.toxicity import Model

    scorer = Scorer(Model({"dim": 5.0, "vile": 12.0}, {}, -8.0))
    assert 0.02 < scorer.sentence_scores("dim.")[0] < 0.05
    text = ("dim. " + "plain. " * 99) * 4000
    assert scorer.score(text) < 0.05 and scorer.score(text + "vile.") >= 0.5
    assert scorer.score("dim. " * 20) > 0.5  # within a passage they do
