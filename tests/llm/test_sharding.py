import zlib
from collections import Counter, defaultdict

import pytest
from odd_rows import ODD

from vistaframe.llm.sharding import grants, shard


def laws(rows, texts, shards):
    assert len(rows) == len(texts)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values(), default=0) - min((counts.get(s, 0) for s in range(shards)), default=0) <= 1
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_balance_and_links(docs_of, shards):
    texts = [f"alone {i}" for i in range(700)] + [f"pair {i // 2}" for i in range(200)] + ["hot"] * 350 + [f"ten {i // 10}" for i in range(100)]
    rows = shard(docs_of(texts), shards).collect()
    laws(rows, texts, shards)
    spread = defaultdict(set)
    for r in rows:
        spread[texts[r["doc_id"]]].add(r["shard"])
    pairs = [s for t, s in spread.items() if t.startswith(("pair", "ten"))]
    assert sum(len(s) > 1 for s in pairs) <= 0.15 * len(pairs)
    assert len(spread["hot"]) <= max(2, 350 * shards // len(texts) + 5)


def test_odd_rows_and_empty_table(docs_of):
    rows = shard(docs_of(ODD).withColumnRenamed("lang", "key").withColumnRenamed("source", "label")).collect()
    laws(rows, [t for _, t in ODD], 24)
    assert shard(docs_of([])).count() == 0


def test_one_text_only(docs_of):
    laws(shard(docs_of(["same"] * 100), 7).collect(), ["same"] * 100, 7)


def test_grants_keep_loads_within_the_quota():
    load, wishes = [10, 10, 10], {(0, 1): 10, (2, 1): 10, (1, 0): 3}
    part = grants(load, wishes, 12)
    after = [load[s] + sum(v * part[b] for (a, b), v in wishes.items() if b == s) - sum(v * part[b] for (a, b), v in wishes.items() if a == s) for s in range(3)]
    assert max(after) <= 12.1 and part[0] == 1


def test_few_wishes_among_many_rows_are_heard(spark):
    from vistaframe.llm.sharding import propagate

    cells = spark.createDataFrame([(f"k{i}".encode(), s, 1) for i in range(4) for s in (i, i + 1)], "key binary, init int, n long")
    found = defaultdict(set)
    for r in propagate(cells, 10_000_000, 8).collect():
        found[bytes(r["key"])].add(r["label"])
    assert all(len(s) == 1 for s in found.values())


def test_query_returns_the_contract(spark, sf):
    import zlib
    from collections import Counter

    from vistaframe.llm.queries import QUERIES

    rows = QUERIES["op10_sharding"](spark, sf).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in docs.items()}
    assert len(rows) == len(docs) and {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(24)) and max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(24) for k in range(counts.get(s, 0))]
