"""Growth points, crops, regions and picture files on constructed plants."""

import numpy as np
import pytest

from tessera.operators import growth as G
from tessera.sources import images as I


def rosette(size=96, leaves=6, at=(50, 44)):
    y, x = np.mgrid[:size, :size]
    mask = np.hypot(y - at[0], x - at[1]) < 7
    for k in range(leaves):
        turn = 2 * np.pi * k / leaves
        along = (x - at[1]) * np.cos(turn) + (y - at[0]) * np.sin(turn)
        across = -(x - at[1]) * np.sin(turn) + (y - at[0]) * np.cos(turn)
        mask |= (along > 0) & (along < 34) & (np.abs(across) < 4)
    rgb = np.where(mask[:, :, None], [40, 140, 40], [120, 100, 80]).astype(np.uint8)
    rgb[np.hypot(y - at[0], x - at[1]) < 6] = (150, 210, 70)
    depth = np.where(mask, 900 - 30 * np.exp(-((y - at[0]) ** 2 + (x - at[1]) ** 2) / 200), 950.0)
    return G.Plant(mask, rgb, depth, "wild_radish")


def test_growth_point_of_a_rosette():
    plant = rosette()
    p = G.growth_point(plant)
    assert np.hypot(p["u"] - 44, p["v"] - 50) < 3
    assert set(p["peaks"]) == set(G.EVIDENCE) and p["confidence"] > 0.5
    plant.depth = None
    assert "canopy_height" not in G.growth_point(plant)["peaks"]
    assert G.growth_point(G.Plant(np.zeros((8, 8), bool), np.zeros((8, 8, 3), np.uint8))) is None
    assert set(G.growth_point(rosette(), {"mine": lambda plant: plant.mask.astype(float)})["peaks"]) == {"mine"}


def test_points_from_rows_of_evidence(spark):
    """The Spark stage gives what the function on one plant gives."""
    plants = [rosette(), rosette(80, 5, (36, 40)), rosette()]
    plants[2].depth = None
    rows = [(k, *p.mask.shape, bytearray(p.mask.astype(np.uint8).tobytes()), bytearray(p.rgb.tobytes()), None if p.depth is None else bytearray(p.depth.astype(np.float32).tobytes()), p.class_name) for k, p in enumerate(plants)]
    rows.append((9, 4, 4, bytearray(16), bytearray(48), None, "grass_weed"))
    df = spark.createDataFrame(rows, "plant long, height int, width int, mask binary, rgb binary, depth binary, class_name string")
    got = {r.plant: r for r in G.growth_points(G.evidence_rows(df)).collect()}
    assert set(got) == {0, 1, 2}
    for k, p in enumerate(plants):
        want = G.growth_point(p)
        assert np.hypot(got[k].u - want["u"], got[k].v - want["v"]) < 0.5 and abs(got[k].confidence - want["confidence"]) < 0.05
        assert got[k].visibility == want["visibility"] and got[k].n_lines == len(want["peaks"])


def test_skeleton():
    bar = np.zeros((15, 40), bool)
    bar[5:10, 3:37] = True
    bones = G.thin(bar)
    assert (bones & ~bar).sum() == 0 and 20 < bones.sum() <= 36 and bones.sum(0).max() == 1


def test_crops_keep_points():
    crop = G.square_crop(30, 20, 10, 16, 64, 2.0, 100, 80)
    a = np.zeros((80, 100))
    a[28, 35] = 1
    out = G.warp(a, crop, 64)
    ys, xs = np.nonzero(out)
    assert abs(ys.mean() - (28 * crop[0] + crop[2])) < 1 and abs(xs.mean() - (35 * crop[0] + crop[1])) < 1
    same = G.warp(np.full((80, 100), 7.0), (1.0, 0.0, 0.0), 50, smooth=True)
    assert np.allclose(same, 7)


def test_local_height():
    plant = rosette()
    ring = dict(inner=1.2, outer=1.9, least=20, low=0.0, high=100.0)
    height, valid = G.local_height(plant.depth, plant.mask, **ring)
    assert valid.all() and height[50, 44] == pytest.approx(0.8, abs=0.02) and height[0, 0] == 0
    assert not G.local_height(np.zeros((96, 96)), plant.mask, **ring)[1].any()
    assert G.geometry_channels(plant.mask, None, **ring).shape == (3, 96, 96)


def test_regions():
    ring = np.zeros((20, 20), bool)
    ring[4:14, 4:14] = True
    ring[8:10, 8:10] = False
    assert G.fill_holes(ring, 4)[8, 8] and not G.fill_holes(ring, 3)[8, 8] and not G.fill_holes(ring, 999)[0, 0]
    outer, hole = G.outlines(ring)
    assert len(outer) == 8 and len(hole) == 8
    two = np.zeros((30, 60), bool)
    y, x = np.mgrid[:30, :60]
    two |= np.hypot(y - 15, x - 16) < 13
    two |= np.hypot(y - 15, x - 40) < 13
    seeds = G.peaks(G.distance_to(~two), two, 13)
    label = G.watershed(two, seeds)
    assert len(seeds) == 2 and (label[two] > 0).all() and label[15, 10] != label[15, 46]
    assert (G.fuse(two, two, 2) == two).all() and (G.fuse(two, np.zeros_like(two), 2) == two).all()
    assert G.box_grow(two, 2).sum() > two.sum()


@pytest.mark.parametrize("shape,kind", [((5, 7), np.uint8), ((5, 7), np.uint16), ((6, 4, 3), np.uint8), ((3, 3, 4), np.uint8)])
def test_png_round_trip(shape, kind):
    a = np.random.default_rng(1).integers(0, np.iinfo(kind).max + 1, shape).astype(kind)
    assert (I.read_png(I.write_png(a)) == a).all()


def test_png_filters():
    import zlib

    rng = np.random.default_rng(2)
    want = rng.integers(0, 256, (5, 12)).astype(int)
    rows = []
    for k in range(5):
        up = want[k - 1] if k else np.zeros(12, int)
        left = np.concatenate([[0, 0, 0], want[k][:-3]])
        corner = np.concatenate([[0, 0, 0], up[:-3]])
        if k == 4:
            p = left + up - corner
            d = [abs(p - left), abs(p - up), abs(p - corner)]
            guess = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        else:
            guess = [0 * up, left, up, (left + up) // 2][k]
        rows.append(bytes([k]) + bytes(((want[k] - guess) % 256).tolist()))
    chunk = lambda kind, body: len(body).to_bytes(4) + kind + body + zlib.crc32(kind + body).to_bytes(4)
    data = I.SIGNATURE + chunk(b"IHDR", (4).to_bytes(4) + (5).to_bytes(4) + bytes([8, 2, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (I.read_png(data).reshape(5, 12) == want).all()


def test_picture_rows(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(I.write_png(rosette().rgb))
    (tmp_path / "b.png").write_bytes(b"no picture")
    d = np.full((40, 40), 1234, np.uint16)
    (tmp_path / "d.png").write_bytes(I.write_png(d))
    got = {r.path.rsplit("/", 1)[1]: r for r in I.read_pictures(spark, str(tmp_path)).collect()}
    assert got["a.png"].veg_frac > 0.1 and got["a.png"].height == 96 and got["a.png"].error is None
    assert got["b.png"].error == "not a PNG file" and got["b.png"].sharpness is None
    files = spark.read.format("binaryFile").load(f"{tmp_path}/d.png")
    points = files.selectExpr("path", "20.0D as u", "20.0D as v")
    assert I.depth_at(files, points).first().depth == 1234.0
    bad = spark.read.format("binaryFile").load(f"{tmp_path}/b.png")
    r = I.depth_at(bad, bad.selectExpr("path", "20.0D as u", "20.0D as v")).first()
    assert r.depth is None and r.error == "not a PNG file"
