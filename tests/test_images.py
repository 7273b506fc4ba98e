import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaframe.operators import extractors, histograms, keypoints, moments
from vistaframe.plans import tasks
from vistaframe.session import EngineConfig
from vistaframe.sources import images
from vistaframe.sources.features import FeatureStore


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[r].tobytes() for r in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("png")
    r, c = np.indices((210, 120))
    png(d / "flat.png", np.full((210, 120, 3), 90, np.uint8))
    png(d / "ramp.png", np.stack([r, c, r + c], 2).astype(np.uint8))
    png(d / "check.png", np.repeat((((r // 5 + c // 5) % 2) * 255)[:, :, None], 3, 2).astype(np.uint8))
    (d / "note.txt").write_text("not an image")
    return str(d)


def test_pixels_and_moments(spark, folder):
    rows = images.read_images(spark, folder, "*.png")
    assert images.count_images(spark, folder, "*.png") == 3 and rows.count() == 3
    px = images.pixels(rows.where("image_id = 'ramp'"))
    p = px.where("row = 7 and col = 11").first()
    assert (p["r"], p["g"], p["b"]) == (7, 11, 18) and px.count() == 210 * 120
    vec = {r["imageid"]: r["vec"] for r in moments.colour_moments(images.pixels(rows)).collect()}
    assert all(len(v) == 9 * 6 for v in vec.values())  # 3 by 2 tiles, the last of each partial
    assert vec["flat"][:9] == [90.0, 128.0, 128.0, 0, 0, 0, 0, 0, 0]
    r, c = np.indices((210, 120))
    y = np.floor(0.299 * r + 0.587 * c + 0.114 * ((r + c) % 256) + 0.5)[:100, :100]
    assert np.isclose(vec["ramp"][0], y.mean()) and np.isclose(vec["ramp"][3], y.std()) and np.isclose(vec["ramp"][6], ((y - y.mean()) ** 3).mean() / y.std() ** 3)


def test_uniform_patterns():
    flat = extractors.uniform_patterns(np.full((20, 20), 50, np.uint8))
    assert (flat[4:-4, 4:-4] == 24).all()  # every point is as bright as the centre
    spot = np.zeros((15, 15), np.uint8)
    spot[7, 7] = 255
    assert extractors.uniform_patterns(spot)[7, 7] == 0
    for v in (extractors.texture_vector(np.zeros((210, 120), np.uint8)), extractors.texture_vector(np.arange(9900, dtype=np.uint8).reshape(99, 100))):
        sums = np.array(v).reshape(-1, 26).sum(1)
        assert np.allclose(sums, 1, atol=1e-5)


def test_gradients_follow_edges():
    image = np.zeros((400, 400), np.uint8)
    image[:, 200:] = 200  # one upright edge: all change is along the columns, orientation 0
    v = np.array(extractors.gradient_vector(image)).reshape(-1, 9)
    assert len(v) == 4 * 4 * 4 and v[:, 1:].max() == 0 and v[:, 0].max() > 0.3
    assert extractors.gradient_vector(np.zeros((90, 90), np.uint8)) == []  # one cell makes no block


def test_extractors_run_on_files(spark, folder):
    rows = images.read_images(spark, folder, "*.png")
    t = {r["imageid"]: r["vec"] for r in extractors.textures(rows).collect()}
    assert {len(v) for v in t.values()} == {26 * 6}
    assert extractors.gradients(rows).count() == 3


def test_ingest_is_an_upsert(spark, folder, tmp_path):
    config = EngineConfig(image_dir=folder, image_glob="*.png", store=str(tmp_path / "store"))
    tasks.ingest(spark, config, ("m", "l"))
    store = FeatureStore(spark, config.store)
    before = {r["imageid"]: r["vec"] for r in store.load("m").collect()}
    tasks.ingest(spark, config, ("m",))
    assert {r["imageid"]: r["vec"] for r in store.load("m").collect()} == before and len(before) == 3
    found = tasks.similar_images(store.load("m"), "ramp", k=2).collect()
    assert len(found) == 2 and found[0]["score"] <= found[1]["score"] and "ramp" not in {r["imageid"] for r in found}
    tasks.ingest(spark, config, ("s",))
    bags = store.load_descriptors()
    n = bags.count()
    tasks.ingest(spark, config, ("s",))
    assert store.load_descriptors().count() == n
    with pytest.raises(ValueError):
        tasks.extract(images.read_images(spark, folder, "*.png"), "x")


def test_block_means_fill_edges_with_zero(spark):
    px = spark.range(15).select(F.lit("a").alias("image_id"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), F.lit(10).alias("v"))
    assert {r["bc"]: r["mean"] for r in moments.block_means(px, "v").collect()} == {0: 1.0, 1: 0.5}


def test_dataset_histograms(spark):
    rows = spark.createDataFrame([("a", [float(x) for x in range(18)])], "imageid string, vec array<double>")
    out = tasks.dataset_histograms(rows).collect()
    assert len(out) == 30 and {n: sum(r["n"] for r in out if r["name"] == n) for n in ("mean", "sd", "skew")} == {"mean": 6, "sd": 6, "skew": 6}
    one = spark.createDataFrame([(4.0,)] * 3, "x double")
    assert [r["n"] for r in histograms.range_histogram(one, ["x"]).orderBy("bin").collect()] == [0, 0, 0, 0, 0, 3, 0, 0, 0, 0]


def blobs(shift=(0, 0), turn=False):
    rng = np.random.default_rng(4)
    r, c = np.indices((120, 140))
    x = np.zeros((120, 140))
    for _ in range(14):
        y0, x0, s, a = rng.uniform(25, 90), rng.uniform(25, 110), rng.uniform(2, 6), rng.uniform(80, 200) * rng.choice([-1, 1])
        x += a * np.exp(-((r - y0 - shift[0]) ** 2 / (2 * s**2) + (c - x0 - shift[1]) ** 2 / (2 * (1.4 * s) ** 2)))
    x = np.clip(x + 128, 0, 255).astype(np.uint8)
    return np.rot90(x).copy() if turn else x


def matched(a, b, ratio=0.8):
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    d.sort(axis=1)
    return (d[:, 0] < ratio * d[:, 1]).mean(), np.median(d[:, 0])


def test_keypoints_survive_shifts_and_turns():
    a, b, c = (np.array(keypoints.describe(x)) for x in (blobs(), blobs((4, 6)), blobs(turn=True)))
    assert a.shape[1] == 128 and len(a) >= 10 and a.min() >= 0 and a.max() <= 255
    other = np.array(keypoints.describe(np.random.default_rng(0).integers(0, 255, (120, 140)).astype(np.uint8)))
    assert matched(a, b)[0] > 0.8 and matched(a, c)[0] > 0.7
    assert matched(a, b)[1] < matched(a, other)[1] / 2 and matched(a, c)[1] < matched(a, other)[1] / 2
    assert keypoints.describe(np.full((60, 60), 100, np.uint8)) == []
    assert keypoints.describe(np.zeros((3, 5), np.uint8)) == []
