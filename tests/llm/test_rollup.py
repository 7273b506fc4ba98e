from collections import Counter

import public_tokenizers
from odd_rows import ODD
from tokenizers import Tokenizer

from vistaframe.llm.queries import QUERIES
from vistaframe.llm.token_rollup import BPE, WORDS, TokenRollup, count_tokens, deletes, inserts, revisions

EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def n_bpe(text):
    return len(EXACT.encode(text or "", add_special_tokens=False).ids)


def totals(rollup):
    return {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    low = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] == 0}
    n, t = Counter(), Counter()
    for d in docs:
        if d["doc_id"] not in low:
            n[d["source"], d["lang"]] += 1
            t[d["source"], d["lang"]] += n_bpe(d["text"])
    out = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in QUERIES["op7_token_rollup"](spark, sf).collect()}
    assert out == {k: (n[k], t[k]) for k in n}


def test_signed_batches_commit_once(spark, docs_of, tmp_path):
    ledger = count_tokens(docs_of([("a b c",)[0], "d e", None, "f"])).persist()
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    assert totals(rollup) == {}
    assert rollup.commit("b/1", inserts(ledger, WORDS, "words")) and not rollup.commit("b/1", inserts(ledger, WORDS, "words"))
    first = totals(rollup)
    assert sum(v[0] for v in first.values()) == 4 and sum(v[1] for v in first.values()) == 6
    assert TokenRollup(spark, str(tmp_path / "r")).commit("b/1", inserts(ledger, WORDS, "words")) is False
    rollup.commit("up", revisions(ledger, (WORDS, "words"), (BPE, "bpe")))
    assert {k[2] for k in totals(rollup)} == {BPE}
    rollup.compact()
    before = totals(rollup)
    assert not rollup.commit("up", inserts(ledger, BPE, "bpe")) and not rollup.commit("b/1", inserts(ledger, BPE, "bpe"))
    rollup.commit("none", inserts(ledger.limit(0), BPE, "bpe"))
    assert totals(rollup) == before
    rollup.commit("gone", deletes(ledger, BPE, "bpe"))
    rollup.compact()
    assert totals(rollup) == {}


def test_a_broken_write_leaves_nothing(spark, docs_of, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    ledger = count_tokens(docs_of(["a b"]))
    (tmp_path / "r/aside/half").mkdir(parents=True)  # what a dead driver leaves
    assert totals(rollup) == {}
    assert rollup.commit("b", inserts(ledger, WORDS, "words")) and sum(v[1] for v in totals(rollup).values()) == 2


def test_odd_rows(docs_of):
    rows = count_tokens(docs_of(ODD).selectExpr("*", "1 as bpe", "2 as words")).collect()
    assert sorted(r["bpe"] for r in rows) == sorted(n_bpe(t) for _, t in ODD)
    assert sorted(r["words"] for r in rows) == sorted(len((t or "").split()) for _, t in ODD)
    assert count_tokens(docs_of([])).count() == 0


def deltas(spark, n, tokens):
    return spark.createDataFrame([("s", "en", "v", n, tokens)], "source string, lang string, version string, n_docs long, n_tokens long")


def test_commits_and_compactions_run_beside_each_other(spark, tmp_path, monkeypatch):
    """A batch committed while compaction lists or writes, and a second compactor that wins."""
    from vistaframe.llm import token_rollup

    path = str(tmp_path / "r")
    rollup, other = TokenRollup(spark, path), TokenRollup(spark, path)
    rollup.commit("a", deltas(spark, 1, 5))
    names, rename = token_rollup.names_in, token_rollup.rename_once
    late = iter([lambda: other.commit("b", deltas(spark, 1, 7))])

    def listed(session, folder):
        found = names(session, folder)
        for act in late:
            act()
        return found

    monkeypatch.setattr(token_rollup, "names_in", listed)  # b comes in after the batches were listed
    assert rollup.compact()
    assert totals(other) == {("s", "en", "v"): (2, 12)}

    late_too = iter([lambda: (other.commit("c", deltas(spark, 1, 11)), other.compact())])

    def renamed(session, source, target):
        if "/snapshots/" in target:
            for act in late_too:
                act()
        return rename(session, source, target)

    monkeypatch.setattr(token_rollup, "rename_once", renamed)  # another compactor is first
    assert not rollup.compact()
    assert totals(rollup) == {("s", "en", "v"): (3, 23)}
    for _ in range(3):
        assert rollup.compact()
        assert totals(rollup) == {("s", "en", "v"): (3, 23)}
    assert not any(rollup.commit(b, deltas(spark, 1, 1)) for b in "abc")
    assert len(names(spark, f"{path}/snapshots")) == 2  # the newest and the one before
    assert not (tmp_path / "r/batches/a/sums").exists() and (tmp_path / "r/batches/a").exists()


def test_readers_of_the_state_before_are_served(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    rollup.commit("a", deltas(spark, 1, 5))
    before = rollup.totals()
    rollup.commit("b", deltas(spark, 1, 7))
    rollup.compact()
    assert before.first()["n_tokens"] == 5 and totals(rollup) == {("s", "en", "v"): (2, 12)}
