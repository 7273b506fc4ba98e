import random

import numpy as np
import pytest
import xxhash
from odd_rows import ODD
from pyspark.sql import functions as F

from vistaframe.llm.components import components
from vistaframe.llm.simhash import drop_near_duplicates, fingerprint, link_fingerprints, near_duplicates


def plain_fingerprint(text):
    words, now = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, now = words + [now] * bool(now), ""
        else:
            now += c.lower() if "A" <= c <= "Z" else c
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def linked(fps, most=4):
    """Least member of each value's component, over all pairs."""
    fps = sorted(set(fps))
    x, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= most) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {f: find(i) for i, f in enumerate(fps)}


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "a b c d", "A b C d e f", "ÄÖ é 漢字 x y z w v " * 5, "rep " * 50])
def test_fingerprint(text):
    assert fingerprint(text) % (1 << 64) == plain_fingerprint(text)


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4, 6])
def test_trie_finds_every_link(spark, most):
    rng = random.Random(most)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(25):  # groups of near copies, chains, and strangers
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.choice([0, 3, 40])):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, most + 2)))
            fps.add(f)
    fps |= {(1 << 40) | x for x in range(600)}  # dense: many within the budget
    signed = [(f - (1 << 64) * (f >> 63),) for f in fps]
    rows = spark.createDataFrame(signed, "fp long")
    got = {r["node"] % (1 << 64): r["label"] for r in components(link_fingerprints(rows, len(fps), most)).collect()}
    want = linked(fps, most)
    groups = lambda of: sorted(sorted(k for k in of if of[k] == v) for v in set(of.values()))
    assert groups({f: str(got.get(f, ("alone", f))) for f in fps}) == groups({f: str(v) for f, v in want.items()})


def test_links_are_no_more_than_a_forest_a_group(spark):
    rows = spark.createDataFrame([((1 << 40) | x,) for x in range(1024)], "fp long")
    assert link_fingerprints(rows, 1024).count() < 30 * 1024


def near_copies(seed=5):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(3000)}" for _ in range(1500)]
    changed = list(words)
    changed[-1] = "other"  # one shingle of many
    return " ".join(words), " ".join(changed), " ".join(f"v{rng.randrange(3000)}" for _ in range(1500))


def test_documents(docs_of):
    a, b, c = near_copies()
    docs = docs_of([(109, a), (103, b), (105, c), (107, a), (None, a), *ODD])
    out = near_duplicates(docs).collect()
    fps = [r["fp"] % (1 << 64) for r in out]
    texts = [a, b, c, a, a, *(t for _, t in ODD)]
    assert sorted(fps) == sorted(map(plain_fingerprint, texts))
    want = linked(fps)
    for r in out:
        same = [x["doc_id"] for x in out if want[x["fp"] % (1 << 64)] == want[r["fp"] % (1 << 64)] and x["doc_id"] is not None]
        assert r["component_id"] == min(same, default=None)
    assert {r["component_id"] for r in out if r["doc_id"] in (109, 103, 107)} == {103}


def test_one_of_each_group_stays(docs_of):
    a, b, c = near_copies()
    docs = docs_of([(9, a), (3, b), (5, c), (7, a), (3, b), (8, None), (2, "")]).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("label", F.lit("x"))
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 3, 5]


def test_empty(docs_of):
    assert near_duplicates(docs_of([])).count() == 0 and drop_near_duplicates(docs_of([])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    out = {r["node"]: r["label"] for r in components(edges).collect()}
    assert all(out[i] == 0 for i in range(61)) and out[101] == 100 and len(out) == 63


@pytest.mark.parametrize("bits", range(0, 16))
def test_orders_cover_every_pair_within_the_budget(bits):
    from vistaframe.llm.simhash import orders_for

    rng, orders = random.Random(bits), orders_for(bits)
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), bits))
        assert any(((x << o.turn | x >> (64 - o.turn)) % (1 << 64) >> (64 - o.length)).bit_count() <= o.budget for o in orders)


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_wider_rule_finds_near_copies_and_leaves_others(docs_of):
    from vistaframe.llm.simhash import Wider, signature

    rng, texts, group = random.Random(2), [], []
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for edits in (0, 3, 6, 40):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
            group.append((g, edits))
    errors = [sum(x == y for x, y in zip(signature(a, sketched=True)[1], signature(b, sketched=True)[1], strict=True)) / 64 - jaccard(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(texts), wider=Wider()).collect()}
    near = [out[4 * g] == out[4 * g + k] for g in range(60) for k in (1, 2) if jaccard(texts[4 * g], texts[4 * g + k]) >= 0.83]
    assert np.mean(near) >= 0.85
    assert all(out[i] // 4 == i // 4 for i in out) and sum(out[4 * g] == out[4 * g + 3] for g in range(60)) <= 2


def test_sketches_of_short_texts():
    from vistaframe.llm.simhash import signature

    for t in (None, "", "a", "a b c d", "a b c d e", "a b c d e f"):
        fp, sketch = signature(t, sketched=True)
        assert len(sketch) == 64 and fp == fingerprint(t)
    assert signature("a b c d e f", sketched=True)[1] != signature("a b c d e g", sketched=True)[1]


def lone_pairs(n=120, seed=11):
    """Pairs of similarity 0.80 to 0.90, of 30 to 900 words, edited here and there, no two pairs alike."""
    rng, texts = random.Random(seed), []
    while len(texts) < 2 * n:
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 100, 300, 900]))]
        words = list(base)
        for _ in range(rng.randint(1, max(1, len(base) // 30))):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], [f"x{rng.randrange(10**6)}"], [words[at], f"x{rng.randrange(10**6)}"]])
        a, b = " ".join(base), " ".join(words)
        if 0.8 <= jaccard(a, b) < 0.9:
            texts += [a, b]
    return texts


def test_lone_near_copies_at_the_threshold_are_all_found(docs_of):
    from vistaframe.llm.simhash import Wider

    texts = lone_pairs()
    bits = [((fingerprint(a) ^ fingerprint(b)) % (1 << 64)).bit_count() for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert max(bits) >= 12  # beyond any walk of the trie that is affordable
    kept = {r["doc_id"] for r in drop_near_duplicates(docs_of(texts), wider=Wider()).collect()}
    assert kept == {i for i in range(len(texts)) if i % 2 == 0}


def test_pairs_below_the_threshold_stay(docs_of):
    from vistaframe.llm.simhash import Wider

    rng, texts = random.Random(3), []
    while len(texts) < 120:
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        words = list(base)
        for at in rng.sample(range(200), rng.randint(5, 9)):
            words[at] = "x"
        a, b = " ".join(base), " ".join(words)
        if 0.65 <= jaccard(a, b) < 0.8 and ((fingerprint(a) ^ fingerprint(b)) % (1 << 64)).bit_count() > 4:
            texts += [a, b]
    assert drop_near_duplicates(docs_of(texts), wider=Wider()).count() == 120


def test_all_texts_of_a_shared_fingerprint_count(docs_of):
    from vistaframe.llm.simhash import Wider

    parts = [" ".join(f"{c}{i}" for i in range(80)) for c in "vw"]
    same = ["rep " * 400 + p for p in parts]
    assert fingerprint(same[0]) == fingerprint(same[1]) and jaccard(*same) < 0.1
    assert all(jaccard(a, b) >= 0.8 and (fingerprint(a) ^ fingerprint(b)) % (1 << 64) for a, b in zip(same, parts, strict=True))
    assert drop_near_duplicates(docs_of([*same, *parts]), wider=Wider()).count() == 1


def test_rows_go_and_not_ids(spark):
    """Null and repeated ids: an unrelated text is never lost."""
    from vistaframe.llm.simhash import Wider

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a, 1), (None, b, 2), (None, c, 3), (5, a, 4), (5, d, 5), (1, b, 6), (3, b, 7), (3, c, 8), (3, c, 8), (7, None, 9), (None, "", 10), (None, None, 11)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, `text.x` int")
    for wider in (None, Wider()):
        out = sorted((r["doc_id"], r["text"], r["text.x"]) for r in drop_near_duplicates(docs, wider=wider).collect())
        assert out == [(1, b, 6), (3, c, 8), (5, a, 4), (5, d, 5), (7, None, 9)]


def test_query_returns_the_contract(spark, sf):
    from vistaframe.llm.queries import QUERIES

    out = QUERIES["op8_simhash"](spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in out.collect()}
    fps = {i: fingerprint(t) % (1 << 64) for i, t in docs.items()}
    label = {i: i for i in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in rows.items()} == {i: (f"{fps[i]:016x}", root(i)) for i in ids}


@pytest.mark.parametrize("per_block", [1 << 19, 700])
def test_second_round_against_brute_force(docs_of, monkeypatch, per_block):
    """A dense group whose texts are mostly apart: links as by comparing all pairs, in whole
    buckets and in buckets cut into parts."""
    from vistaframe.llm import similar
    from vistaframe.llm.simhash import Wider

    monkeypatch.setattr(similar, "PER_BLOCK", per_block)
    rng, base = random.Random(9), [f"w{k}" for k in range(90)]
    texts = []
    for k in range(70):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5])):
            words[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            near = jaccard(texts[i], texts[j]) >= 0.8 or ((fingerprint(texts[i]) ^ fingerprint(texts[j])) % (1 << 64)).bit_count() <= 4
            if near and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(texts), wider=Wider()).collect()}
    assert [out[i] for i in range(len(texts))] == label and 1 < len(set(label)) < len(texts)
