"""Queries over the driver's tables, and the same in SQL for DuckDB.

``embeddings`` stand in for a feature table (its label for the subject),
``documents`` and ``labels`` for metadata, ``part`` and ``pages`` for names,
``lineitem`` and ``events`` for windows of values; pixels come from a formula.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as N
from ..functions import vectors as V
from ..functions.pixels import gray, yuv
from ..operators import codebook, factor, histograms, linear, moments, neighbours, oneclass, ranking, subjects
from ..operators.extractors import gradients, textures
from ..operators.keypoints import keypoints
from ..operators.matching import ratio_similarity
from ..sources import metadata
from ..sources.features import upserted
from ..sources.images import synthetic_pixels
from ..sources.reports import score_line
from . import tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

E = "embedding::DOUBLE[]"
GRID = """px AS (SELECT i AS image_id, r AS "row", c AS col, (r * 3 + c * 5 + i * 11) % 256 AS b, (r * 7 + c * 2 + i * 29) % 256 AS g, (r * c + 13 * i) % 256 AS r
  FROM (SELECT unnest(range(0, 2)) AS i), (SELECT unnest(range(0, 250)) AS r), (SELECT unnest(range(0, 130)) AS c)),
yuv AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS luma FROM px),
byte AS (SELECT image_id, "row", col, b, g, r, least(255, greatest(0, floor(luma + 0.5::DOUBLE)))::INT AS y, least(255, greatest(0, floor(0.492::DOUBLE * (b - luma) + 128 + 0.5::DOUBLE)))::INT AS u,
  least(255, greatest(0, floor(0.877::DOUBLE * (r - luma) + 128 + 0.5::DOUBLE)))::INT AS v FROM yuv)"""
#: Three fixed basis vectors of 64 elements.
BASIS = [[float(((s + 1) * (p + 3)) % 7 - 3) for p in range(64)] for s in range(3)]
BASIS_SQL = "basis AS (SELECT s, list_transform(range(0, 64), lambda p: (((s + 1) * (p + 3)) % 7 - 3)::DOUBLE) AS h FROM (SELECT unnest(range(0, 3)) AS s))"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(imageid, vec, label)."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("imageid"), V.doubles(F.col("embedding")).alias("vec"), "label")


def subject_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select(F.col("label").alias("subjectid"), "imageid", "vec")


def r6(c):
    return F.round(c, 6) + F.lit(0.0)  # no negative zero


# scans and the store


@query(f"SELECT vec_id AS imageid, len(embedding)::INT AS dims, round(list_sum({E}), 6) + 0::DOUBLE AS total FROM embeddings")
def feature_scan(spark, sf_dir):
    return features(spark, sf_dir).select("imageid", F.size("vec").alias("dims"), r6(V.total(F.col("vec"))).alias("total"))


@query(f"SELECT vec_id AS imageid, round(sqrt(list_sum(list_transform({E}, lambda x: x * x))), 6) AS norm FROM embeddings WHERE vec_id = 7")
def feature_point_lookup(spark, sf_dir):
    return features(spark, sf_dir).where("imageid = 7").select("imageid", r6(V.norm(F.col("vec"))).alias("norm"))


@query("SELECT vec_id AS imageid FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def feature_exists_semi(spark, sf_dir):
    return features(spark, sf_dir).select("imageid").join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("imageid")), "imageid", "left_semi")


@query("SELECT vec_id AS imageid FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def feature_missing_anti(spark, sf_dir):
    return features(spark, sf_dir).select("imageid").join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("imageid")), "imageid", "left_anti")


@query(
    f"""WITH old AS (SELECT vec_id AS imageid, round(list_sum({E}), 6) + 0::DOUBLE AS total FROM embeddings), new AS (SELECT doc_id AS imageid, (100 * quality + toxic)::DOUBLE AS total FROM labels)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE imageid NOT IN (SELECT imageid FROM new)"""
)
def feature_upsert(spark, sf_dir):
    old = features(spark, sf_dir).select("imageid", r6(V.total(F.col("vec"))).alias("total"))
    new = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("imageid"), (100 * F.col("quality") + F.col("toxic")).cast("double").alias("total"))
    return upserted(old, new)


@query(f"SELECT vec_id AS imageid, len({E})::INT AS dims, round(list_sum({E}), 4) AS total, starts_with(t, '{{') AS braces FROM (SELECT *, '{{' AS t FROM embeddings)")
def vector_text_round_trip(spark, sf_dir):
    text = features(spark, sf_dir).select("imageid", N.vector_to_text(F.col("vec")).alias("t"))
    back = N.vector_from_text(F.col("t"))
    return text.select("imageid", F.size(back).alias("dims"), F.round(V.total(back), 4).alias("total"), F.col("t").startswith("{").alias("braces"))


@query("SELECT DISTINCT label::VARCHAR AS value FROM embeddings ORDER BY 1")
def distinct_subjects(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("value")).distinct()


# names and metadata


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS aspect, split_part(p_name, ' ', 2) AS orient, split_part(p_name, '.', 1) AS stem, CASE WHEN length(p_name) > 4 THEN left(p_name, length(p_name) - 4) ELSE '' END AS cut, replace(p_type, ' ', '_') AS key FROM part")
def meta_parse_strings(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", N.first_word(F.col("p_name")).alias("aspect"), N.second_word(F.col("p_name")).alias("orient"), N.before_dot(F.col("p_name")).alias("stem"), N.without_suffix(F.col("p_name")).alias("cut"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("key"))


@query(r"SELECT page_id, split_part(url, '/', -1) AS base, CASE WHEN strpos(substr(split_part(url, '/', -1), 2), '.') > 0 THEN regexp_replace(split_part(url, '/', -1), '\.[^.]*$', '') ELSE split_part(url, '/', -1) END AS stem FROM pages")
def file_stems(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", N.base_name(F.col("url")).alias("base"), N.file_stem(F.col("url")).alias("stem"))


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'red')")
def meta_filter_contains(spark, sf_dir):
    return read(spark, sf_dir, "part").where(F.col("p_name").contains("red")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red')")
def meta_filter_equals(spark, sf_dir):
    return read(spark, sf_dir, "part").where(F.array_contains(F.split("p_name", " "), "red")).select("p_partkey")


@query("SELECT doc_id FROM labels WHERE toxic::VARCHAR::INT = 1")
def meta_filter_int(spark, sf_dir):
    return read(spark, sf_dir, "labels").where(F.col("toxic").cast("string").cast("int") == 1).select("doc_id")


DOC_SPEC = (("left", "lang", "en"), ("right", "lang", "de"), ("dorsal", "lang", "fr"), ("palmar", "lang", "es"), ("accessories", "toxic", 1), ("no_accessories", "toxic", 0), ("male", "quality", 1), ("female", "quality", 0))


def doc_one_hot(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    return metadata.one_hot(rows, DOC_SPEC, "doc_id")


@query("SELECT doc_id, " + ", ".join(f"CASE WHEN {c} = {v!r} THEN 1 ELSE 0 END AS {n}" for n, c, v in DOC_SPEC) + " FROM documents JOIN labels USING (doc_id)")
def meta_onehot(spark, sf_dir):
    return doc_one_hot(spark, sf_dir)


@query("SELECT vec_id AS imageid, label FROM embeddings JOIN labels ON vec_id = doc_id WHERE toxic = 1")
def features_with_label(spark, sf_dir):
    m = read(spark, sf_dir, "labels").where("toxic = 1")
    return features(spark, sf_dir).join(m, F.col("imageid") == F.col("doc_id")).select("imageid", "label")


# distances


def top_sql(score: str, order: str = "", k: int = 5, where: str = "WHERE a.vec_id <> 0") -> str:
    return f"SELECT a.vec_id AS imageid, round({score}, 6) AS score FROM (SELECT vec_id, {E} AS v FROM embeddings) a, (SELECT {E} AS q FROM embeddings WHERE vec_id = 0) {where} ORDER BY {score} {order}, a.vec_id LIMIT {k}"


def top(spark, sf_dir, measure, k=5, include=False):
    rows = features(spark, sf_dir).select("imageid", "vec")
    return neighbours.nearest(rows, rows.where("imageid = 0"), measure, k, include).select("imageid", r6("score").alias("score"))


COSINE_SQL = "list_dot_product(a.v, q) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(q, q)))"
MANHATTAN_SQL = "list_sum(list_transform(list_zip(a.v, q), lambda p: abs(p[1] - p[2])))"


@query(top_sql(f"1 - {COSINE_SQL}"))
def cosine_topk(spark, sf_dir):
    return top(spark, sf_dir, "cosine")


@query(top_sql(COSINE_SQL, "DESC"))
def cosine_similarity_topk(spark, sf_dir):
    return top(spark, sf_dir, "cosine_similarity")


@query(top_sql(MANHATTAN_SQL))
def manhattan_topk(spark, sf_dir):
    return top(spark, sf_dir, "manhattan")


@query(top_sql("list_distance(a.v, q)", k=11, where=""))
def euclid_topk(spark, sf_dir):
    return top(spark, sf_dir, "euclidean", 11, True)


@query(top_sql("list_distance(a.v, q)"))
def l2_topk(spark, sf_dir):
    return top(spark, sf_dir, "l2")


@query(
    f"""WITH a AS (SELECT vec_id, {E} AS v FROM embeddings), p AS (SELECT q.vec_id AS q_id, a.vec_id AS imageid, list_dot_product(a.v, q.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(q.v, q.v))) AS s
FROM a, a q WHERE q.vec_id % 50 = 0 AND a.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, imageid) AS rank FROM p)
SELECT q_id, rank::INT AS rank, imageid, round(s, 6) AS score FROM r WHERE rank <= 5"""
)
def cosine_similarity_pairs(spark, sf_dir):
    rows = features(spark, sf_dir).select("imageid", "vec")
    return neighbours.nearest_to_each(rows, rows.where("imageid % 50 = 0"), "cosine_similarity").select("q_id", "rank", "imageid", r6("score").alias("score"))


@query(
    f"""WITH d AS (SELECT label AS imageid, vec_id AS pos, {E} AS v FROM embeddings), p AS (SELECT t.imageid, q.pos AS q_pos, list_distance(q.v, t.v) AS d FROM d q, d t WHERE q.imageid = 0 AND t.imageid <> 0),
r AS (SELECT imageid, q_pos, list(d ORDER BY d)[1:2] AS two FROM p GROUP BY ALL)
SELECT imageid, count(*) FILTER (two[1] < 0.95::DOUBLE * two[2])::BIGINT AS good, count(*)::BIGINT AS n, round(count(*) FILTER (two[1] < 0.95::DOUBLE * two[2]) / count(*), 6) AS score FROM r GROUP BY imageid"""
)
def sift_ratio_similarity(spark, sf_dir):
    d = features(spark, sf_dir).select(F.col("label").alias("imageid"), F.col("imageid").alias("pos"), "vec")
    return ratio_similarity(d.where("imageid <> 0"), d.where("imageid = 0"), 0.95).select("imageid", "good", "n", r6("score").alias("score"))


# subjects


@query("SELECT label AS subjectid, count(*)::BIGINT AS n, array_to_string(list(vec_id ORDER BY vec_id), ',') AS images FROM embeddings GROUP BY label")
def subject_array_agg(spark, sf_dir):
    rows = features(spark, sf_dir).select("imageid")
    meta = read(spark, sf_dir, "embeddings").select(F.col("label").alias("subjectid"), F.col("vec_id").alias("image_id"))
    out = subjects.collected(rows, meta)
    return out.select("subjectid", F.size("images").cast("long").alias("n"), F.array_join("images", ",").alias("images"))


CENTROIDS_SQL = f"el AS (SELECT label, i, avg(({E})[i]) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i), cen AS (SELECT label, list(x ORDER BY i) AS v FROM el GROUP BY label)"


@query(f"WITH {CENTROIDS_SQL} SELECT label AS subjectid, (i - 1)::INT AS pos, round(x, 6) + 0::DOUBLE AS value FROM el")
def subject_centroid(spark, sf_dir):
    return subjects.centroid_elements(subject_rows(spark, sf_dir)).select("subjectid", "pos", r6("value").alias("value"))


MATRIX_SQL = f"{CENTROIDS_SQL}, sim AS (SELECT a.label AS a, b.label AS b, 1 / (1 + list_distance(list_transform(a.v, lambda x: x::FLOAT::DOUBLE), list_transform(b.v, lambda x: x::FLOAT::DOUBLE))) AS s FROM cen a, cen b)"


def matrix(spark, sf_dir):
    return subjects.similarity_matrix(subjects.centroids(subject_rows(spark, sf_dir)))


@query(f"WITH {MATRIX_SQL} SELECT a, b, round(s, 6) AS sim FROM sim")
def subject_similarity_matrix(spark, sf_dir):
    return matrix(spark, sf_dir).select("a", "b", r6("sim").alias("sim"))


@query(f"WITH {MATRIX_SQL}, r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM sim WHERE a <> b) SELECT a, rank::INT AS rank, b, round(s, 6) AS sim FROM r WHERE rank <= 3")
def subject_similarity_top3(spark, sf_dir):
    return subjects.most_similar(subjects.centroids(subject_rows(spark, sf_dir))).select("a", "rank", "b", r6("sim").alias("sim"))


# vectors


@query(f"SELECT vec_id AS imageid, (i - 1)::INT AS pos, round(exp(-({E})[i]), 6) AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i)")
def exp_normalize(spark, sf_dir):
    return features(spark, sf_dir).select("imageid", F.posexplode(V.exp_negated(F.col("vec"))).alias("pos", "x")).select("imageid", "pos", r6("x").alias("value"))


@query(f"WITH e AS (SELECT vec_id AS imageid, (i - 1)::INT AS pos, ({E})[i] AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) SELECT imageid, pos, round(x / stddev_pop(x) OVER (PARTITION BY pos), 5) + 0::DOUBLE AS value FROM e")
def std_scale(spark, sf_dir):
    return linear.standard_scale(features(spark, sf_dir)).select("imageid", F.posexplode("vec").alias("pos", "x")).select("imageid", "pos", (F.round("x", 5) + F.lit(0.0)).alias("value"))


@query(f"SELECT label AS imageid, (count(*) * 64)::INT AS n, round(sum(list_sum({E})), 6) + 0::DOUBLE AS total FROM embeddings GROUP BY label")
def flatten_features(spark, sf_dir):
    bags = features(spark, sf_dir).groupBy("label").agg(F.flatten(F.sort_array(F.collect_list("vec"))).alias("flat"))
    return bags.select(F.col("label").alias("imageid"), F.size("flat").alias("n"), r6(V.total(F.col("flat"))).alias("total"))


@query(f"SELECT (i - 1)::INT AS pos, count(*)::BIGINT AS n, round(sum(({E})[i]), 6) + 0::DOUBLE AS total FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i")
def explode_descriptors(spark, sf_dir):
    return features(spark, sf_dir).select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.count("*").alias("n"), r6(F.sum("x")).alias("total"))


@query(f"WITH {BASIS_SQL} SELECT vec_id AS imageid, (s + 1)::INT AS semantic, round(list_dot_product({E}, h), 6) + 0::DOUBLE AS value FROM embeddings, basis")
def project_onto_basis(spark, sf_dir):
    p = features(spark, sf_dir).select("imageid", V.projected(F.col("vec"), BASIS).alias("p"))
    return ranking.loadings(p, "imageid", "p").select("imageid", "semantic", r6("weight").alias("value"))


GRAM_SQL = f"WITH e AS (SELECT vec_id, i, ({E})[i] AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), n AS (SELECT count(*) AS n FROM embeddings), m AS (SELECT i, avg(x) AS m FROM e GROUP BY i)"


@query(f"{GRAM_SQL} SELECT (a.i - 1)::BIGINT AS i, (b.i - 1)::BIGINT AS j, round(sum(a.x * b.x), 6) + 0::DOUBLE AS value FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i")
def gram_matrix(spark, sf_dir):
    return linear.matrix_rows(spark, linear.gram_sums(features(spark, sf_dir)).gram).select("i", "j", r6("value").alias("value"))


@query(f"{GRAM_SQL} SELECT (a.i - 1)::BIGINT AS i, (b.i - 1)::BIGINT AS j, round(sum((a.x - ma.m) * (b.x - mb.m)) / ((SELECT n FROM n) - 1), 6) + 0::DOUBLE AS value FROM e a JOIN e b USING (vec_id) JOIN m ma ON ma.i = a.i JOIN m mb ON mb.i = b.i GROUP BY a.i, b.i")
def covariance_matrix(spark, sf_dir):
    return linear.matrix_rows(spark, linear.gram_sums(features(spark, sf_dir)).covariance).select("i", "j", r6("value").alias("value"))


@query(f"WITH el AS (SELECT i, avg(({E})[i]) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i), c AS (SELECT list(x ORDER BY i) AS m FROM el) SELECT vec_id AS imageid, round(list_distance({E}, m), 6) AS distance FROM embeddings, c")
def centroid_distance(spark, sf_dir):
    return oneclass.centroid_distances(features(spark, sf_dir)).select("imageid", r6("distance").alias("distance"))


# windows and pixels


def skew_sql(x: str) -> str:
    return f"round(coalesce(avg(({x} - m_{x}) ** 3) / pow(nullif(avg(({x} - m_{x}) ** 2), 0), 1.5), 0), 4)"


@query(
    f"""WITH w AS (SELECT l_orderkey // 100 AS win, l_quantity AS q, l_extendedprice AS p, l_discount AS d FROM lineitem), c AS (SELECT *, avg(q) OVER (PARTITION BY win) AS m_q, avg(p) OVER (PARTITION BY win) AS m_p, avg(d) OVER (PARTITION BY win) AS m_d FROM w)
SELECT win, round(avg(q), 4) AS mean_q, round(avg(p), 4) AS mean_p, round(avg(d), 4) AS mean_d, round(stddev_pop(q), 4) AS sd_q, round(stddev_pop(p), 4) AS sd_p, round(stddev_pop(d), 4) AS sd_d, {skew_sql('q')} AS skew_q, {skew_sql('p')} AS skew_p, {skew_sql('d')} AS skew_d FROM c GROUP BY win"""
)
def window_moments(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 100").alias("win"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"))
    m = moments.window_moments(rows, ["win"], ["q", "p", "d"])
    return m.select("win", *(F.round(c, 4).alias(c) for c in m.columns if c != "win"))


@query(f"WITH {GRID} SELECT image_id, \"row\"::INT AS \"row\", col::INT AS col, y, u, v, y AS gray FROM byte")
def yuv_convert(spark, sf_dir):
    y, u, v = yuv(F.col("b"), F.col("g"), F.col("r"))
    return synthetic_pixels(spark).select("image_id", "row", "col", y.alias("y"), u.alias("u"), v.alias("v"), gray(F.col("b"), F.col("g"), F.col("r")).alias("gray"))


@query(
    f"""WITH {GRID}, t AS (SELECT image_id, "row" // 100 AS tr, col // 100 AS tc, y, u, v FROM byte), c AS (SELECT *, avg(y) OVER w AS m_y, avg(u) OVER w AS m_u, avg(v) OVER w AS m_v FROM t WINDOW w AS (PARTITION BY image_id, tr, tc)),
m AS (SELECT image_id, tr, tc, avg(y) AS a1, avg(u) AS a2, avg(v) AS a3, stddev_pop(y) AS a4, stddev_pop(u) AS a5, stddev_pop(v) AS a6, {skew_sql('y')} AS a7, {skew_sql('u')} AS a8, {skew_sql('v')} AS a9 FROM c GROUP BY ALL),
f AS (SELECT image_id, flatten(list([a1, a2, a3, a4, a5, a6, a7, a8, a9] ORDER BY tr, tc)) AS v FROM m GROUP BY image_id)
SELECT image_id::VARCHAR AS imageid, (i - 1)::INT AS pos, round(v[i], 4) AS value FROM (SELECT image_id, v, unnest(range(1, len(v) + 1)) AS i FROM f)"""
)
def image_moments(spark, sf_dir):
    return moments.colour_moments(synthetic_pixels(spark)).select("imageid", F.posexplode("vec").alias("pos", "x")).select("imageid", "pos", F.round("x", 4).alias("value"))


@query(f"WITH {GRID} SELECT image_id, (\"row\" // 10)::INT AS br, (col // 10)::INT AS bc, round(sum(y) / 100, 6) AS mean FROM byte GROUP BY ALL")
def block_mean(spark, sf_dir):
    px = synthetic_pixels(spark).withColumn("y", gray(F.col("b"), F.col("g"), F.col("r")))
    return moments.block_means(px, "y").select("image_id", "br", "bc", r6("mean").alias("mean"))


@query(
    """WITH e AS (SELECT user_id % 10 AS grp, event_id * 7 % 26 AS code FROM events), b AS (SELECT unnest(range(0, 26)) AS bin), g AS (SELECT DISTINCT grp FROM e)
SELECT g.grp, bin::INT AS bin, round((SELECT count(*) FROM e WHERE e.grp = g.grp AND e.code = b.bin) / ((SELECT count(*) FROM e WHERE e.grp = g.grp) + 1e-7), 6) AS share FROM g, b"""
)
def lbp_histogram(spark, sf_dir):
    codes = read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("grp"), (F.col("event_id") * 7 % 26).alias("code"))
    h = histograms.code_histogram(codes, "grp", "code")
    return h.select("grp", F.posexplode("vec").alias("bin", "x")).select("grp", "bin", r6("x").alias("share"))


@query(
    """WITH v AS (SELECT 'l_quantity' AS name, l_quantity::DOUBLE AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem),
r AS (SELECT name, min(x) AS lo, max(x) AS hi FROM v GROUP BY name), p AS (SELECT name, least(floor((x - lo) / (hi - lo) * 10), 9)::INT AS bin FROM v JOIN r USING (name)), b AS (SELECT unnest(range(0, 10))::INT AS bin)
SELECT r.name, b.bin, count(p.bin)::BIGINT AS n FROM r CROSS JOIN b LEFT JOIN p ON p.name = r.name AND p.bin = b.bin GROUP BY ALL"""
)
def hist10(spark, sf_dir):
    return histograms.range_histogram(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


BOVW_SQL = f"""WITH {CENTROIDS_SQL}, d AS (SELECT vec_id, label AS imageid, {E} AS v FROM embeddings), p AS (SELECT vec_id, d.imageid, cen.label AS word, list_distance(d.v, cen.v) AS dist FROM d, cen),
near AS (SELECT imageid, word FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, word) = 1), n AS (SELECT imageid, count(*) AS n FROM near GROUP BY imageid)
SELECT n.imageid, w.word::INT AS word, round((SELECT count(*) FROM near x WHERE x.imageid = n.imageid AND x.word = w.word) / (n.n * {{size}}), 8) AS share FROM n, (SELECT unnest(range(0, 10)) AS word) w"""


def bovw(spark, sf_dir, normalization):
    rows = features(spark, sf_dir)
    book = subjects.centroids(subject_rows(spark, sf_dir)).select(F.col("subjectid").alias("cluster"), F.col("vec").alias("center"))
    words = histograms.nearest_words(rows.select(F.col("label").alias("imageid"), "vec"), book)
    h = histograms.word_histogram(words, 10, normalization)
    return h.select("imageid", F.posexplode("vec").alias("word", "x")).select("imageid", "word", F.round("x", 8).alias("share"))


@query(BOVW_SQL.format(size=64))
def bovw_histogram(spark, sf_dir):
    return bovw(spark, sf_dir, "literal")


@query(BOVW_SQL.format(size=1))
def bovw_histogram_by_count(spark, sf_dir):
    return bovw(spark, sf_dir, "count")


# rankings


RANK_SQL = f"WITH {BASIS_SQL}, w AS (SELECT (s + 1)::INT AS semantic, vec_id AS imageid, round(list_dot_product({E}, h), 6) + 0::DOUBLE AS weight FROM embeddings, basis), r AS (SELECT *, row_number() OVER (PARTITION BY semantic ORDER BY weight DESC, imageid) AS rank FROM w)"


def loaded(spark, sf_dir):
    """Weights rounded before they are ranked, so that both engines see the same ties."""
    p = V.projected(F.col("vec"), BASIS)
    return features(spark, sf_dir).select("imageid", F.transform(p, r6).alias("vec"))


@query(f"{RANK_SQL} SELECT semantic, rank::BIGINT AS rank, imageid, weight FROM r")
def latent_rank_images(spark, sf_dir):
    return ranking.ranked_loadings(loaded(spark, sf_dir)).select("semantic", F.col("rank").cast("long").alias("rank"), "imageid", "weight")


@query(f"{RANK_SQL} SELECT semantic, rank::INT AS rank, imageid, weight FROM r WHERE rank <= 5")
def latent_top5_images(spark, sf_dir):
    return ranking.top_loadings(loaded(spark, sf_dir))


@query(f"{RANK_SQL} SELECT semantic, imageid, weight AS score FROM r WHERE rank = 1")
def latent_best_by_dot(spark, sf_dir):
    return ranking.best_for_each(features(spark, sf_dir), BASIS).select("semantic", "imageid", r6("score").alias("score"))


@query(f"{RANK_SQL} SELECT semantic, imageid, weight AS score FROM r WHERE rank = 1")
def latent_best_image(spark, sf_dir):
    return ranking.top_loadings(loaded(spark, sf_dir), 1).select("semantic", "imageid", F.col("weight").alias("score"))


@query(
    """WITH w AS (SELECT (s + 1)::INT AS semantic, f AS feature, ((j * 5 + s * 3) % 8)::DOUBLE / 8 AS weight FROM (SELECT unnest(range(0, 3)) AS s),
(SELECT unnest(['left', 'right', 'dorsal', 'palmar', 'accessories', 'no_accessories', 'male', 'female']) AS f, unnest(range(0, 8)) AS j))
SELECT semantic, row_number() OVER (PARTITION BY semantic ORDER BY weight DESC, feature)::BIGINT AS rank, feature, weight FROM w"""
)
def latent_rank_features(spark, sf_dir):
    rows = [(n, [((j * 5 + s * 3) % 8) / 8 for s in range(3)]) for j, (n, _, _) in enumerate(metadata.ONE_HOT)]
    found = ranking.ranked_loadings(spark.createDataFrame(rows, "feature string, vec array<double>"), "feature")
    return found.select("semantic", F.col("rank").cast("long").alias("rank"), "feature", "weight")


@query(f"{RANK_SQL} SELECT semantic, imageid || ': ' || rank AS line FROM r WHERE rank <= 5")
def report_lines(spark, sf_dir):
    return ranking.top_loadings(loaded(spark, sf_dir)).select("semantic", score_line(F.col("imageid"), F.col("rank")).alias("line"))


@query(f"WITH t AS ({top_sql(f'1 - {COSINE_SQL}')}) SELECT row_number() OVER (ORDER BY score, imageid)::INT AS rank, imageid, score FROM t UNION ALL SELECT 0, 0, 0")
def similar_images_with_query(spark, sf_dir):
    return neighbours.with_query_first(top(spark, sf_dir, "cosine"), 0).select("rank", "imageid", "score")


@query(f"SELECT count(*)::BIGINT AS images, sum(len({E}))::BIGINT AS elements, count(DISTINCT label)::BIGINT AS subjects FROM embeddings")
def dataset_counts(spark, sf_dir):
    return features(spark, sf_dir).agg(F.count("*").alias("images"), F.sum(F.size("vec")).cast("long").alias("elements"), F.count_distinct("label").alias("subjects"))


# learnt models: tests hold their invariants


def positive(spark, sf_dir) -> DataFrame:
    return features(spark, sf_dir).select("imageid", V.exp_negated(F.col("vec")).alias("vec"))


def reduced(found: factor.Factors, ranking_too: bool = True) -> DataFrame:
    out = ranking.loadings(found.reduced).select("imageid", "semantic", F.col("weight").alias("value"))
    if not ranking_too:
        return out
    return out.join(ranking.loadings(found.ranking), ["imageid", "semantic"]).select("imageid", "semantic", "value", "weight")


@query()
def pca_scores(spark, sf_dir):
    return reduced(factor.pca(features(spark, sf_dir), 4))


@query()
def svd_scores(spark, sf_dir):
    return reduced(factor.svd(features(spark, sf_dir), 4))


@query()
def nmf_factors(spark, sf_dir):
    return reduced(factor.nmf(positive(spark, sf_dir), 4))


@query()
def lda_topics(spark, sf_dir):
    return reduced(factor.lda(positive(spark, sf_dir), 4))


@query()
def kmeans_codebook(spark, sf_dir):
    d = features(spark, sf_dir).select(F.col("label").alias("imageid"), "vec")
    model = codebook.learn_codebook(d, 50)
    return codebook.encode(d, model, "count").select("imageid", F.posexplode("vec").alias("word", "share"))


@query()
def subject_nmf(spark, sf_dir):
    return tasks.subject_semantics(matrix(spark, sf_dir), 3)


@query()
def metadata_nmf(spark, sf_dir):
    names = [n for n, _, _ in DOC_SPEC]
    return tasks.metadata_semantics(doc_one_hot(spark, sf_dir), 3, names, "doc_id")[0]


@query()
def metadata_feature_nmf(spark, sf_dir):
    names = [n for n, _, _ in DOC_SPEC]
    return tasks.metadata_semantics(doc_one_hot(spark, sf_dir), 3, names, "doc_id")[1]


@query()
def latent_semantics_task(spark, sf_dir):
    rows = features(spark, sf_dir).select(F.col("imageid").cast("string").alias("imageid"), "vec")
    return tasks.latent_semantics(rows, "svd", 4).images


@query()
def foldin_similarity(spark, sf_dir):
    rows = features(spark, sf_dir).select("imageid", "vec")
    fitted = rows.where("imageid <> 0")
    found = factor.svd(fitted, 4)
    return tasks.similar_in_latent_space(found.reduced, 0, rows, found.basis)


@query()
def one_class_svm(spark, sf_dir):
    rows = features(spark, sf_dir)
    return oneclass.classify(rows.select("imageid", "vec"), rows.where("label = 0").select("imageid", "vec"))[0]


def synthetic_images(spark, height: int = 250, width: int = 330) -> DataFrame:
    px = synthetic_pixels(spark, height, width)
    triple = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in ("b", "g", "r")))
    lines = px.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("row", "col", triple.alias("p")))).alias("p"))
    data = F.unhex(F.array_join(F.transform("p", lambda x: x["p"]), ""))
    return lines.select(F.col("image_id").cast("string").alias("image_id"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(3).alias("channels"), data.alias("data"))


@query()
def image_lbp(spark, sf_dir):
    return textures(synthetic_images(spark)).select("imageid", F.posexplode("vec").alias("pos", "value"))


@query()
def image_hog(spark, sf_dir):
    return gradients(synthetic_images(spark)).select("imageid", F.posexplode("vec").alias("pos", "value"))


@query()
def image_keypoints(spark, sf_dir):
    return keypoints(synthetic_images(spark)).select("imageid", "pos", F.posexplode("vec").alias("at", "value"))
