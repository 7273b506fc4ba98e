import pytest
from pyspark.sql import functions as F

from vistaframe.operators.matching import ratio_similarity
from vistaframe.plans import tasks
from vistaframe.sources import features, metadata, reports
from vistaframe.streaming.upserts import feature_stream, upsert_stream

CSV = """id,age,gender,skinColor,accessories,nailPolish,aspectOfHand,imageName
1,20,male,fair,0,0,dorsal left,H1.jpg
1,20,male,fair,1,0,palmar right,H2.jpg
2,31,female,dark,0,0,dorsal right,H3.jpg
2,31,female,dark,1,1,palmar left,H4.jpg
2,31,female,dark,1,1,palmar left,H4.jpg
"""


@pytest.fixture()
def raw(spark, tmp_path):
    (tmp_path / "meta.csv").write_text(CSV)
    return metadata.read_raw(spark, str(tmp_path / "meta.csv"))


def ids(frame):
    return sorted(r["imageid"] for r in frame.collect())


def test_filters(raw):
    assert ids(metadata.images_with(raw, "Male")) == ["H1", "H2", "H3", "H4", "H4"]  # a substring test
    assert ids(metadata.images_with(raw, "male", equals=True)) == ["H1", "H2"]
    assert ids(metadata.images_with(raw, "left")) == ["H1", "H4", "H4"]
    assert ids(metadata.images_with(raw, "with accessories")) == ["H1", "H3"]
    assert ids(metadata.images_with(raw, "with accessories", polarity="documented")) == ["H2", "H4", "H4"]
    with pytest.raises(ValueError):
        metadata.images_with(raw, "thumb")


def test_parse_and_one_hot(spark, raw, tmp_path):
    meta = metadata.parsed(raw)
    assert meta.columns == ["subjectid", "image_id", "gender", "aspect", "orient", "accessories"]
    assert metadata.unique_images(meta).count() == 4
    metadata.save_metadata(meta, str(tmp_path / "m"))
    metadata.save_metadata(meta, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    hot = {r["image_id"]: r for r in metadata.one_hot(metadata.unique_images(meta), key="image_id").collect()}
    assert (hot["H1"]["left"], hot["H1"]["accessories"], hot["H1"]["no_accessories"], hot["H4"]["female"]) == (1, 0, 1, 1)
    assert metadata.with_label(meta, "0").count() == 2
    with pytest.raises(ValueError):
        metadata.with_label(meta, "big")


def test_subject_tasks(spark, raw):
    rows = spark.createDataFrame([("H1", [0.0, 0.0]), ("H2", [2.0, 0.0]), ("H3", [1.0, 4.0]), ("H4", [1.0, 2.0])], "imageid string, vec array<double>")
    found = tasks.similar_subjects(rows, metadata.parsed(raw)).collect()
    assert [(r["a"], r["rank"], r["b"], r["sim"]) for r in sorted(found, key=lambda r: r["a"])] == [("1", 1, "2", 0.25), ("2", 1, "1", 0.25)]
    decided = tasks.classify_label(rows, metadata.parsed(raw), "palmar")
    assert decided.count() == 4


def test_store(spark, tmp_path):
    store = features.FeatureStore(spark, str(tmp_path / "s"))
    row = lambda *r: spark.createDataFrame(r, features.SCHEMA)
    assert store.load("l").count() == 0
    store.upsert(row(("a", [1.0]), ("b", [2.0])), "l")
    store.upsert(row(("b", [3.0]), ("c", [4.0]), ("c", [5.0])), "l")
    assert sorted((r["imageid"], r["vec"][0]) for r in store.load("l").collect()) == [("a", 1.0), ("b", 3.0), ("c", 4.0)]
    assert store.load("l", "pca", "with accessories").count() == 0
    assert store.lookup("b", "l").first()["vec"] == [3.0]
    asked = spark.createDataFrame([("a",), ("z",)], "imageid string")
    assert ids(store.known(asked, "l")) == ["a"] and ids(store.unknown(asked, "l")) == ["z"]
    for bad in (("q",), ("l", "ica")):
        with pytest.raises(ValueError):
            store.load(*bad)


def test_stream(spark, tmp_path):
    row = lambda *r: spark.createDataFrame(r, features.SCHEMA)
    row(("a", [1.0])).write.parquet(str(tmp_path / "in/1"))
    store = features.FeatureStore(spark, str(tmp_path / "s"))
    for number in (2, 3):
        upsert_stream(feature_stream(spark, str(tmp_path / "in/*")), store, "h", str(tmp_path / "c")).awaitTermination(60)
        row(("a", [float(number)]), (f"n{number}", [0.0])).write.parquet(str(tmp_path / f"in/{number}"))
    assert sorted((r["imageid"], r["vec"][0]) for r in store.load("h").collect()) == [("a", 2.0), ("n2", 0.0)]


def test_ratio_similarity(spark):
    d = spark.createDataFrame([("t", 0, [0.0, 0.0]), ("t", 1, [10.0, 0.0]), ("u", 0, [1.0, 1.0]), ("v", 0, [1.0, 0.0]), ("v", 1, [1.0, 0.0])], "imageid string, pos int, vec array<double>")
    q = spark.createDataFrame([(0, [0.5, 0.0]), (1, [5.0, 0.0])], "pos int, vec array<double>")
    out = {r["imageid"]: (r["good"], r["n"], r["score"]) for r in ratio_similarity(d, q).collect()}
    assert out == {"t": (1, 2, 0.5), "u": (0, 2, 0.0), "v": (0, 2, 0.0)}  # one neighbour, and a tie, are no match


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5)], "i string, s double")
    reports.write_lines(rows, reports.score_line(F.col("i"), F.col("s")), str(tmp_path / "r"))
    reports.write_json(rows, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == "a: 0.5" and spark.read.json(str(tmp_path / "j")).count() == 1
    old = spark.createDataFrame([("x", [["1.0", "2.0"]])], "imageid string, image_data array<array<string>>")
    assert features.legacy_vectors(old).first()["vec"] == [1.0, 2.0]


def test_store_rewrites_touched_buckets_only_and_vacuums(spark, tmp_path):
    store = features.FeatureStore(spark, str(tmp_path / "s"), 4)
    row = lambda *r: spark.createDataFrame(r, features.SCHEMA)
    store.upsert(row(*((f"i{k}", [float(k)]) for k in range(40))), "l")
    folder = tmp_path / "s/model=l/technique=-/label=-"
    first = {p.name for p in folder.glob("v-*")}
    store.upsert(row(("i7", [-1.0])), "l")
    (second,) = {p.name for p in folder.glob("v-*")} - first
    assert len(list((folder / second).glob("bucket=*"))) == 1  # one of four
    assert {r["imageid"]: r["vec"][0] for r in features.FeatureStore(spark, str(tmp_path / "s"), 9).load("l").collect()} == {f"i{k}": -1.0 if k == 7 else float(k) for k in range(40)}
    assert store.lookup("i7", "l").first()["vec"] == [-1.0] and len(store.lookup("i7", "l").inputFiles()) == 1
    for k in range(3):
        store.upsert(row(*((f"i{j}", [float(k)]) for j in range(40))), "l")
    store.vacuum("l")
    assert len(list(folder.glob("v-*"))) == 1 and len(list(folder.glob("current-*"))) == 1
    store.upsert(row(("z", [0.0])), "l")
    assert store.load("l").count() == 41
    store.upsert(spark.createDataFrame([], features.SCHEMA), "l")
    assert store.load("l").count() == 41


def test_a_rename_happens_once(spark, tmp_path):
    from vistaframe.storage import read_bytes, rename_once, write_bytes

    a, b, to = (str(tmp_path / x) for x in ("a", "b", "in/c"))
    write_bytes(spark, a, b"1")
    write_bytes(spark, b, b"2")
    assert rename_once(spark, a, to) and not rename_once(spark, b, to)
    assert read_bytes(spark, to) == b"1" and not (tmp_path / "b").exists()


def test_tasks_that_write(spark, tmp_path):
    """Metadata from a file, one feature to a report, the report of latent semantics."""
    from vistaframe.session import EngineConfig

    lines = ["id,age,gender,skin,accessories,polish,aspectOfHand,imageName"] + [f"s{k},2{k},{'male' if k % 2 else 'female'},x,{k % 2},0,dorsal left,Hand_{k}.jpg" for k in range(4)]
    (tmp_path / "m.csv").write_text("\n".join(lines))
    for _ in range(2):  # loading twice changes nothing
        tasks.load_metadata(spark, EngineConfig(metadata_csv=str(tmp_path / "m.csv")), str(tmp_path / "meta"))
    meta = spark.read.parquet(str(tmp_path / "meta"))
    assert meta.count() == 4 and meta.where("gender = 'male'").count() == 2 and meta.first()["aspect"] == "dorsal"
    store = features.FeatureStore(spark, str(tmp_path / "s"))
    store.upsert(spark.createDataFrame([(f"Hand_{k}", [float(k), 1.0, 2.0]) for k in range(4)], features.SCHEMA), "l")
    assert tasks.fetch_feature(store, "Hand_2", "l", str(tmp_path / "one")).first()["vec"] == [2.0, 1.0, 2.0]
    assert spark.read.json(str(tmp_path / "one")).first()["imageid"] == "Hand_2"
    found = tasks.latent_semantics(store.load("l"), "svd", 2, "l")
    tasks.save_report(found, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r/images")).count() == 8 and spark.read.text(str(tmp_path / "r/features")).count() == 2
