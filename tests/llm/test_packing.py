import zlib

import numpy as np
import public_tokenizers
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vistaframe.llm.packing import OpenWindows, op3_packing, pack, padding
from vistaframe.llm.token_output import pack_decreasing, packed_rows, write_packed
from vistaframe.llm.tokens import ids_of, vocabulary_path

EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def exact(text):
    return EXACT.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [None, "", "a", "Hello  world\n\n x", "<|endoftext|> inside <|endoftext|>", "漢字 😀 é ñ ß", "x" * 5000, " " * 3000 + "end", "1234567890 " * 50, "   odd\x00\x1f blanks", "don't DON'T it's"])
def test_ids_equal_those_of_the_library(text):
    assert ids_of(text, vocabulary_path()).tolist() == exact(text)


def test_ids_on_the_documents(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert ids_of(r["text"], vocabulary_path()).tolist() == exact(r["text"])


def check(pieces, texts, size):
    """Every id in one piece, sequences without gaps and within the size."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for doc_id, text in texts.items():
        want = [*exact(text), 0]
        own = sorted(by_doc.pop(doc_id), key=lambda p: p["start"])
        at = 0
        for p in own:
            assert p["start"] == at and p["doc_tokens"] == len(want)
            assert p["ids_crc32"] == zlib.crc32(np.array(want[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(want)
    assert not by_doc
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= size


def test_whole_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(op3_packing(spark, sf).collect(), texts, 1024)


def test_many_small_partitions_are_merged(docs_of):
    texts = {i: f"text {i} " * (1 + 37 * i % 90) for i in range(120)}
    out = pack(docs_of(list(texts.items())).repartition(17), windows=3, fan_in=4).withColumn("ids_crc32", F.crc32("ids"))
    check(out.collect(), texts, 1024)
    p = padding(out).first()
    assert p["padding"] < 1024 + 0.08 * p["tokens"]


def test_odd_rows_and_empty_table(docs_of):
    out = pack(docs_of(ODD).withColumn("part", F.lit(1)).withColumn("open", F.lit(True)))
    assert out.agg(F.sum("length")).first()[0] == sum(len(exact(t)) + 1 for _, t in ODD)
    assert out.where("doc_id = 1").select("length", "doc_tokens").first() == (1, 1)
    assert pack(docs_of([])).count() == 0 and packed_rows(docs_of([])).count() == 0


def test_best_fit_and_fullest_first():
    w, emitted = OpenWindows(10, 2, 0), []
    for n in (6, 7, 3, 5, 4):
        emitted += [(k, [p[2] for p in held]) for k, held in w.place((0, 0, n, None, n))]
    # 3 fills the window of 7; 5 opens the second; 4 fills that of 6
    assert emitted == [(1, [7, 3]), (0, [6, 4])]
    assert [[p[2] for p in held] for _, held in w.rest()] == [[5]]
    w = OpenWindows(10, 2, 0)
    out = [x for n in (6, 7, 8) for x in w.place((0, 0, n, None, n))]
    assert [[p[2] for p in held] for _, held in out] == [[7]]  # none fits 8: the fullest goes


def test_decreasing_against_a_plain_search():
    rng = np.random.default_rng(0)
    for size in (1, 2, 7, 16, 100, 1023, 1024):
        for _ in range(20):
            lengths = rng.integers(1, size + 1, rng.integers(0, 60)).tolist()
            rows = pack_decreasing(lengths, size)
            room = []
            for n in sorted(lengths, reverse=True):
                fits = [r for r in room if r >= n]
                if fits:
                    room[room.index(min(fits))] -= n
                else:
                    room.append(size - n)
            assert sorted(size - sum(lengths[k] for k in r) for r in rows) == sorted(room)
            assert sorted(k for r in rows for k in r) == list(range(len(lengths)))


def test_binary_rows_round_trip(docs_of, tmp_path):
    out = write_packed(docs_of(ODD[:4] + [(5, "long " * 3000), (6, "é漢 " * 40)]), str(tmp_path / "p"), size=256, chunk_tokens=2000).collect()
    found = {}
    for r in out:
        ids = np.frombuffer(r["input_ids"], "<u2")
        cu = r["cu_seqlens"]
        assert len(ids) == 256 and cu[0] == 0 and cu[-1] == r["n_tokens"] and (ids[cu[-1] :] == 50256).all()
        assert r["position_resets"] == cu[:-1]
        for d, s, a, b in zip(r["doc_ids"], r["starts"], cu, cu[1:], strict=False):
            found.setdefault(d, {})[s] = ids[a:b].tolist()
    for d, text in ((1, None), (4, "one"), (5, "long " * 3000), (6, "é漢 " * 40)):
        assert sum((found[d][s] for s in sorted(found[d])), []) == [*exact(text), 50256]
