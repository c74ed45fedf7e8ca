"""JPEG images against their pixels, code lengths against the rules, and videos put together by offsets."""

import random

import numpy as np
import pytest

from cadenza.sources import jpeg


def picture(h, w, seed=0):
    y, x = np.mgrid[0:h, 0:w]
    draw = np.random.default_rng(seed)
    return np.clip(np.stack([128 + 90 * np.sin(x / 7 + k + seed) + 30 * np.cos(y / 5 - k) for k in range(3)], axis=-1) + draw.normal(0, 2, (h, w, 3)), 0, 255).astype(np.uint8)


def psnr(a, b):
    return 10 * np.log10(255**2 / max(1e-9, np.mean((a.astype(float) - b) ** 2)))


@pytest.mark.parametrize("shape", [(8, 8), (16, 24), (1, 1), (13, 37), (64, 64)])
def test_images_within_40_db(shape):
    image = picture(*shape)
    raw = jpeg.encode(image)
    assert jpeg.size_of(raw) == shape and raw.endswith(b"\xff\xd9") and psnr(jpeg.decode(raw), image) > 40
    grey = image[:, :, 0]
    assert psnr(jpeg.decode(jpeg.encode(grey, 100)), grey) > 45
    assert len(jpeg.encode(image, 20)) <= len(raw) and jpeg.decode(jpeg.encode(image, 20)).shape == image.shape


@pytest.mark.parametrize("image", [np.zeros((16, 16, 3), np.uint8), np.full((9, 9), 255, np.uint8), np.random.default_rng(0).integers(0, 256, (32, 32, 3), dtype=np.uint8), np.tile(np.array([[0, 255]], np.uint8), (16, 8))])
def test_flat_and_hard_images(image):
    got = jpeg.decode(jpeg.encode(image, 100))
    assert got.shape == image.shape and psnr(got, image + 1e-3) > 40


def test_zigzag_and_codes():
    assert jpeg.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.zigzag().tolist()) == list(range(64))
    for counts in ({5: 1}, {k: 2**k for k in range(30)}, {k: random.Random(k).randrange(1, 99) for k in range(160)}):
        lengths = jpeg.code_lengths(counts)
        assert set(lengths) == set(counts) and max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) < 1
        table = jpeg.codes(lengths)
        words = [format(c, f"0{n}b") for c, n in table.values()]
        assert not any("0" not in w for w in words) and not any(a != b and b.startswith(a) for a in words for b in words)
        assert list(lengths.values()) == sorted(lengths.values())


def test_videos(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jpeg, "PART", 3)
    rows = [(v, k, bytearray(jpeg.encode(picture(9, 17, k)))) for v, n in (("a", 11), ("b", 1)) for k in range(n)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "video string, k long, jpeg binary").repartition(4)
    out = {r["path"].rsplit("/", 1)[-1]: r for r in jpeg.encode_video(df, str(tmp_path / "out")).collect()}
    assert set(out) == {"a-000.avi", "b-000.avi"} and not (tmp_path / "out" / "_parts").exists()
    raw = (tmp_path / "out" / "a-000.avi").read_bytes()
    assert out["a-000.avi"]["n_frames"] == 11 and out["a-000.avi"]["n_bytes"] == len(raw) == int.from_bytes(raw[4:8], "little") + 8
    assert jpeg.read_avi(raw) == [bytes(j) for v, k, j in sorted((r for r in rows if r[0] == "a"), key=lambda r: r[1])]
    monkeypatch.setattr(jpeg, "VOLUME", 1500)
    several = jpeg.encode_video(df, str(tmp_path / "more")).collect()
    assert len(several) > 3 and sum(r["n_frames"] for r in several) == 12
    read = [j for r in sorted(several, key=lambda r: r["path"]) if "/a-" in r["path"] for j in jpeg.read_avi(open(r["path"], "rb").read())]
    assert read == jpeg.read_avi(raw)
    odd = spark.createDataFrame([("a", 99, bytearray(jpeg.encode(picture(8, 8))))], "video string, k long, jpeg binary")
    with pytest.raises(Exception, match="several sizes"):
        jpeg.encode_video(df.union(odd), str(tmp_path / "odd"))


def test_an_animation_is_made_of_rows_packed_elsewhere():
    from cadenza.sources import images

    frames = np.random.default_rng(1).integers(0, 256, (5, 3, 4, 4)).astype(np.uint8)
    found = images.read_animation(images.animation([images.packed(f) for f in frames], (3, 4), 200))
    assert next(found).shape == (4, 4, 4) and all((f[:3] == own).all() for f, own in zip(found, frames[1:]))


def test_videos_of_more_frames_than_a_sample_holds(spark, tmp_path, monkeypatch):
    # Places come from ranges, whose bounds come from a sample, here of a row or two a partition; volumes and parts follow from them.
    monkeypatch.setattr(jpeg, "PART", 16)
    images = [bytes(jpeg.encode(picture(8, 8, k))) for k in range(7)]
    rows = [(v, k, bytearray(images[(k * k + len(v)) % 7])) for v in ("a", "bb", "ccc") for k in range(400)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "video string, k long, jpeg binary").repartition(8)
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", 1)
    try:
        out = {r["path"].rsplit("/", 1)[-1]: r for r in jpeg.encode_video(df, str(tmp_path / "out")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.rangeExchange.sampleSizePerPartition")
    assert {name: r["n_frames"] for name, r in out.items()} == {f"{v}-000.avi": 400 for v in ("a", "bb", "ccc")}
    for v in ("a", "bb", "ccc"):
        assert jpeg.read_avi((tmp_path / "out" / f"{v}-000.avi").read_bytes()) == [images[(k * k + len(v)) % 7] for k in range(400)]
