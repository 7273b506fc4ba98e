import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vistaframe.operators import codebook, factor, histograms, linear, oneclass, ranking
from vistaframe.plans import tasks
from vistaframe.plans.tasks import latent_semantics, similar_in_latent_space
from vistaframe.sources.features import FeatureStore
from vistaframe.sources.models import ModelStore


def table(spark, x):
    return spark.createDataFrame([(str(i), [float(v) for v in row]) for i, row in enumerate(x)], "imageid string, vec array<double>")


def matrix(frame, n):
    rows = {r["imageid"]: r["vec"] for r in frame.collect()}
    return np.array([rows[str(i)] for i in range(n)])


RNG = np.random.default_rng(3)
X = RNG.normal(size=(40, 6)) @ RNG.normal(size=(6, 6)) + 2


def test_pca_against_numpy(spark):
    found = factor.pca(table(spark, X), 3)
    c = X - X.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    scores = matrix(found.reduced, 40)
    assert np.allclose(abs(scores), abs(u[:, :3] * s[:3]), atol=1e-8)
    assert np.allclose(found.scale, s[:3] ** 2 / 39)
    assert np.allclose(matrix(found.ranking, 40), scores / found.scale)
    assert (found.basis[np.arange(3), abs(found.basis).argmax(1)] > 0).all()


def test_svd_against_numpy(spark):
    found = factor.svd(table(spark, X), 3)
    u, s, vt = np.linalg.svd(X, full_matrices=False)
    assert np.allclose(found.scale, s[:3])
    assert np.allclose(abs(matrix(found.ranking, 40)), abs(u[:, :3]), atol=1e-8)
    assert np.allclose(abs(matrix(found.reduced, 40)), abs(u[:, :3] * s[:3]), atol=1e-8)


def test_nmf_loss_falls_and_factors_are_not_negative(spark):
    x = RNG.random((50, 3)) ** 2 @ RNG.random((3, 8))  # of rank 3, so little is left
    found = factor.nmf(table(spark, x), 3, rounds=30)
    assert (found.basis >= 0).all() and (matrix(found.ranking, 50) >= 0).all()
    assert all(b <= a * 1.0001 for a, b in zip(found.scale, found.scale[1:], strict=False)) and found.scale[-1] < 0.1 * found.scale[0]
    assert np.allclose(matrix(found.reduced, 50), x @ found.basis.T)


def test_lda_rows_are_distributions(spark):
    found = factor.lda(table(spark, np.exp(RNG.normal(size=(30, 5)))), 2, rounds=5)
    assert np.allclose(matrix(found.ranking, 30).sum(1), 1)


def test_scaling_is_by_population_deviation_and_keeps_constants(spark):
    x = np.column_stack([X[:, 0], np.full(40, 7.0)])
    out = matrix(linear.standard_scale(table(spark, x)), 40)
    assert np.allclose(out[:, 0], X[:, 0] / X[:, 0].std()) and (out[:, 1] == 7).all()


def test_empty_tables(spark):
    empty = table(spark, np.zeros((0, 2)))
    assert linear.gram_sums(empty).n == 0
    assert linear.standard_scale(empty).count() == 0


def test_one_class_machine():
    x = RNG.normal(size=(200, 3))
    m = oneclass.fit_one_class(x)
    inside = m.decision(x) >= -1e-6
    assert 0.85 <= inside.mean() <= 0.95  # nu bounds the outliers
    assert m.decision(np.array([[9.0, 9.0, 9.0]]))[0] < 0
    assert np.isclose(m.alpha.sum(), 1) and (m.alpha <= 1 / (0.1 * 200) + 1e-9).all()


def test_codebook_and_rule(spark):
    assert codebook.words_for(299) == 149 and codebook.words_for(300) == 300
    d = spark.createDataFrame([("a", [0.0, 0.0]), ("a", [0.1, 0.0]), ("b", [5.0, 5.0]), ("b", [0.0, 0.1])], "imageid string, vec array<double>")
    model = codebook.learn_codebook(d)
    for norm, total in (("literal", 0.5), ("count", 1.0)):
        sums = [sum(r["vec"]) for r in codebook.encode(d, model, norm).collect()]
        assert np.allclose(sums, total)
    near = histograms.nearest_words(d, codebook.centres(model, spark))
    assert {r["word"] for r in near.collect()} == {0, 1}


def test_rank_is_whole_and_ties_go_by_key(spark):
    rows = spark.createDataFrame([(g, i, float(i % 5)) for g in (1, 2) for i in range(97)], "g int, id int, w double")
    out = ranking.ranked(rows, "g", [F.col("w").desc(), F.col("id")]).collect()
    for g in (1, 2):
        own = sorted((r["rank"], -r["w"], r["id"]) for r in out if r["g"] == g)
        assert [x[0] for x in own] == list(range(1, 98)) and [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_latent_semantics_and_fold_in(spark):
    rows = table(spark, X)
    found = latent_semantics(rows, "SVD", 2, negative="none")
    assert found.images.count() == 80 and found.features.count() == 2
    best = {r["semantic"]: (r["imageid"], r["score"]) for r in found.features.collect()}
    for s in (1, 2):
        d = X @ found.factors.basis[s - 1]
        assert best[s][0] == str(d.argmax()) and np.isclose(best[s][1], d.max())
    part = rows.where("imageid <> '0'")
    fitted = factor.svd(part, 2)
    near = similar_in_latent_space(fitted.reduced, "0", rows, fitted.basis, 4).collect()
    assert near[0]["imageid"] == "0" and near[0]["score"] == 0 and len(near) == 4


def test_nearest_to_each_against_numpy(spark):
    from vistaframe.operators import neighbours

    x = np.vstack([X, X[:2], np.zeros((1, 6))])  # ties, and a row without a norm
    rows = table(spark, x)
    for measure, more in (("cosine", 1), ("cosine_similarity", -1), ("euclidean", 1), ("manhattan", 1), ("l2", 1)):
        d = neighbours.distances(x, x, measure) * more
        for block in (2, 100):
            got = {(r["q_id"], r["rank"]): (r["imageid"], r["score"]) for r in neighbours.nearest_to_each(rows.repartition(3), rows.where("imageid in ('0', '5', '41', '42')"), measure, 4, block).collect()}
            for q in (0, 5, 41, 42):
                want = sorted((v, str(i)) for i, v in enumerate(d[q]) if i != q and not np.isnan(v))[:4]
                assert [got[str(q), k + 1][0] for k in range(len(want))] == [i for _, i in want] or np.allclose([got[str(q), k + 1][1] * more for k in range(len(want))], [v for v, _ in want], atol=1e-12)
    one = {r["imageid"]: r["score"] for r in neighbours.nearest(rows, rows.where("imageid = '5'"), "euclidean", 4).collect()}
    each = {r["imageid"]: r["score"] for r in neighbours.nearest_to_each(rows, rows.where("imageid = '5'"), "euclidean", 4).collect()}
    assert one.keys() == each.keys() and all(np.isclose(one[i], each[i]) for i in one)


@pytest.mark.parametrize("bad", [[("a", [1.0, 2.0, 3.0]), ("b", [1.0, 2.0, 3.0, 4.0, 5.0])], [("a", [1.0, None]), ("b", [1.0, 2.0])], [("a", [1.0]), ("b", [1.0, 2.0, 3.0])]])
def test_unequal_vectors_and_null_elements_are_an_error(spark, bad):
    rows = spark.createDataFrame(bad, "imageid string, vec array<double>")
    for parts in (1, 2):
        for run in (lambda r: factor.pca(r, 1), lambda r: factor.svd(r, 1), lambda r: factor.nmf(r, 1), linear.standard_scale):
            with pytest.raises((PySparkException, ValueError), match="unequal lengths|null element"):
                run(rows.repartition(parts))


def test_stored_models_give_the_same_scores(spark, tmp_path):
    store, models = FeatureStore(spark, str(tmp_path / "f")), ModelStore(spark, str(tmp_path / "m"))
    rows = table(spark, X)
    store.upsert(rows, "l")
    assert models.load("l_svd") is None
    with pytest.raises(ValueError):
        tasks.similar_by_stored_model(store, models, "0", "l", "svd")
    for k in (3, 2):  # the newest counts
        found = latent_semantics(rows.where("imageid <> '0'"), "SVD", k, "l", store=store, models=models)
    kept = ModelStore(spark, str(tmp_path / "m")).load("l_svd")
    assert np.array_equal(kept["basis"], found.factors.basis) and np.array_equal(kept["scale"], found.factors.scale)
    near = tasks.similar_by_stored_model(store, models, "0", "l", "svd", k=4).collect()
    reduced = X @ found.factors.basis.T
    want = np.argsort(np.linalg.norm(reduced - reduced[0], axis=1))[:4]
    assert [r["imageid"] for r in near] == [str(i) for i in want]


def test_descriptors_are_folded_in_by_the_stored_codebook(spark, tmp_path):
    store, models = FeatureStore(spark, str(tmp_path / "f")), ModelStore(spark, str(tmp_path / "m"))
    rng = np.random.default_rng(5)
    bags = [(str(i), p, [float(v) for v in rng.normal(size=4) + 6 * ((i + p * (i % 3)) % 4)]) for i in range(24) for p in range(10)]
    store.upsert_descriptors(spark.createDataFrame(bags, "imageid string, pos int, vec array<double>"))
    known = store.load_descriptors().where("imageid <> '5'")
    found = latent_semantics(None, "svd", 3, "s", descriptors=known, store=store, words=8, models=models)
    kept = models.load("s_svd")
    d = {i: np.array([b[2] for b in bags if b[0] == str(i)]) for i in range(24)}

    def reduced(i):
        word = np.linalg.norm(d[i][:, None] - kept["codebook"][None], axis=2).argmin(1)
        return np.bincount(word, minlength=8) / d[i].size @ kept["basis"].T

    assert np.allclose(matrix(found.factors.reduced.unionByName(spark.createDataFrame([("5", [0.0] * 3)], "imageid string, vec array<double>")), 24)[0], reduced(0))
    near = tasks.similar_by_stored_model(store, models, "5", "s", "svd", k=6).collect()
    own = sorted((round(float(np.linalg.norm(reduced(i) - reduced(5))), 9), str(i)) for i in range(24))[:6]
    assert near[0]["imageid"] == "5" and np.allclose([r["score"] for r in near], [x for x, _ in own], atol=1e-8)


def test_a_stored_machine_decides_alike(spark, tmp_path):
    models, rows = ModelStore(spark, str(tmp_path / "m")), table(spark, X)
    meta = spark.createDataFrame([(str(i), str(i), "male" if i < 20 else "female", "dorsal", "left", "0") for i in range(40)], "subjectid string, image_id string, gender string, aspect string, orient string, accessories string")
    first = {r["imageid"]: r["decision"] for r in tasks.classify_label(rows, meta, "male", models).collect()}
    again = {r["imageid"]: r["decision"] for r in tasks.classify_by_stored(rows, models, "male").collect()}
    assert first.keys() == again.keys() and all(np.isclose(first[i], again[i]) for i in first)
