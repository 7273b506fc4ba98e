import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vistaframe.functions import text as N
from vistaframe.functions import vectors as V

VECTORS = [([1.0, 2.0, 3.0], [4.0, -5.0, 6.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([], []), ([1e-3, 7.0], [1e-3, 7.0])]


def test_distances(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(VECTORS)], "i int, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    out = {r["i"]: r for r in rows.select("i", V.dot(a, b).alias("dot"), V.cosine_distance(a, b).alias("cos"), V.cosine_similarity(a, b).alias("sim"), V.manhattan(a, b).alias("man"), V.euclidean(a, b).alias("euc"), V.l2_float(a, b).alias("l2"), V.closeness(V.euclidean(a, b)).alias("close")).collect()}
    x, y = map(np.array, VECTORS[0])
    assert math.isclose(out[0]["cos"], 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    assert math.isclose(out[0]["man"], abs(x - y).sum()) and math.isclose(out[0]["euc"], np.linalg.norm(x - y)) and math.isclose(out[0]["l2"], np.linalg.norm(x - y), rel_tol=1e-6)
    assert out[1]["cos"] is None and out[1]["sim"] is None  # a zero norm
    assert all(out[2][c] is None for c in ("dot", "cos", "man", "euc"))  # unequal lengths
    assert out[3]["dot"] == 0 and out[3]["euc"] == 0
    assert out[4]["euc"] == 0 and out[4]["close"] == 1 and abs(out[4]["cos"]) < 1e-12


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=1, max_size=8))
def test_distance_laws(spark, pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    r = spark.range(1).select(*(f(F.array(*map(F.lit, x)), F.array(*map(F.lit, y))).alias(n) for n, f, x, y in (("ab", V.euclidean, a, b), ("ba", V.euclidean, b, a), ("aa", V.euclidean, a, a), ("m", V.manhattan, a, b)))).first()
    assert r["ab"] == r["ba"] and r["aa"] == 0 and r["m"] >= r["ab"] - 1e-9


def test_elementwise(spark):
    r = spark.range(1).select(V.exp_negated(F.array(F.lit(0.0), F.lit(1000.0), F.lit(-1000.0))).alias("e"), V.divided(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(0.0))).alias("d"), V.projected(F.array(F.lit(1.0), F.lit(2.0)), [[1, 0], [1, 1]]).alias("p")).first()
    assert r["e"] == [1.0, 0.0, math.inf] and r["d"] == [0.5, None] and r["p"] == [1.0, 3.0]


@pytest.mark.parametrize(("text", "expected"), [("[1.0, 2.5]", [1.0, 2.5]), ("{1.0, 2.5}", [1.0, 2.5]), ("[[1.0], [2.0, 3.0]]", [1.0, 2.0, 3.0]), ("None", None), (None, None), ("[]", [])])
def test_vector_text(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(N.vector_from_text(F.col("t")).alias("v")).first()[0] == expected


def test_nan_text(spark):
    v = spark.createDataFrame([("[1.0, nan]",)], "t string").select(N.vector_from_text(F.col("t"))).first()[0]
    assert v[0] == 1.0 and math.isnan(v[1])


def test_names(spark):
    rows = spark.createDataFrame([("/a/b/Hand_01.tar.jpg", "dorsal left")], "p string, a string")
    r = rows.select(N.file_stem(F.col("p")).alias("s"), N.before_dot(N.base_name(F.col("p"))).alias("d"), N.without_suffix(F.col("p")).alias("c"), N.first_word(F.col("a")).alias("w"), N.second_word(F.col("a")).alias("o"), N.image_path("/x/", F.lit("q")).alias("i")).first()
    assert (r["s"], r["d"], r["c"], r["w"], r["o"], r["i"]) == ("Hand_01.tar", "Hand_01", "/a/b/Hand_01.tar", "dorsal", "left", "/x/q.jpg")
    assert N.label_key("with accessories") == "with_accessories"
