"""Measures of page images on PNG files that are written here."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import images as I
from quire.operators import filters


def png(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + r.tobytes() for r in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def page(w=120, h=160, ground=255, box=None, ink=(200, 30, 30)):
    out = np.full((h, w, 3), ground, np.uint8)
    if box:
        out[box[1] : box[3], box[0] : box[2]] = ink
    return out


@pytest.fixture(scope="module")
def images(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    ramp = np.repeat(np.linspace(0, 255, 160).astype(np.uint8)[None, :, None], 90, 0).repeat(3, 2)
    for name, rgb in {"white": page(), "ink": page(box=(30, 40, 90, 120)), "ramp": ramp, "back": ramp[:, ::-1]}.items():
        (folder / f"{name}.png").write_bytes(png(np.ascontiguousarray(rgb)))
    (folder / "broken.png").write_bytes(b"no image")
    return I.read_images(spark, str(folder))


def by_name(df):
    return {r.origin.rsplit("/", 1)[1].split(".")[0]: r for r in df.collect()}


def test_statistics(images):
    got = by_name(I.page_stats(images))
    assert set(got) == {"white", "ink", "ramp", "back"}
    assert got["white"].stats.asDict() == {"white_ratio": 1.0, "black_ratio": 0.0, "edge_ratio": 0.0, "saturation_mean": 0.0, "value_mean": 255.0, "gray_std": 0.0}
    ink = got["ink"].stats
    assert ink.white_ratio == pytest.approx(0.75) and ink.saturation_mean == pytest.approx(0.25 * round(255 * 170 / 200), abs=0.01)
    assert ink.edge_ratio * 120 * 160 == pytest.approx(2 * (60 + 80), abs=8)
    why = I.page_stats(images).select("origin", filters.garbage_reason(F.lit(1000), F.col("stats")).alias("reason"), filters.colour_page(F.col("stats")).alias("colour"))
    assert {k: (r.reason, r.colour) for k, r in by_name(why).items()} == {"white": ("blank", False), "ink": (None, True), "ramp": (None, False), "back": (None, False)}


def test_blank_and_fingerprints(images):
    assert {k: r.blank for k, r in by_name(I.blank_pages(images)).items()} == {"white": True, "ink": False, "ramp": False, "back": False}
    got = by_name(I.fingerprints(images))
    ones = lambda words: sum(bin(w & (1 << 64) - 1).count("1") for w in words)
    assert got["ramp"].aspect == 1778 and ones(got["ramp"].difference) == 0 and ones(got["back"].difference) == 256
    assert ones(got["ramp"].average) == 128 and got["ramp"].average[0] == 0x00FF00FF00FF00FF
    flat = by_name(I.gray_histograms(images))["white"].histogram
    assert flat[255] == 1.0 and sum(flat) == 1.0


def test_boxes(images):
    got = by_name(I.page_boxes(images))["ink"]  # the blur reaches 2 points, the smoothed projection 3 more
    assert all(abs(a - b) <= 5 for a, b in zip((got.left, got.top, got.right, got.bottom), (30, 40, 90, 120), strict=True)) and got.foreground == pytest.approx(0.25, abs=0.03)
    large = page(1500, 2400, box=(300, 400, 1200, 2000))
    assert all(abs(a - b) <= 12 for a, b in zip(I.foreground_box(large)[:4], (300, 400, 1200, 2000), strict=True))
    assert I.foreground_box(page(40, 30))[:4] == (0, 0, 40, 30)
    assert I.foreground_box(page(1, 1))[:4] == (0, 0, 1, 1)


def test_resampling_keeps_means():
    for kernel in ("area", "linear", "lanczos"):
        w = I.resampling(100, 7, kernel)
        assert w.shape == (7, 100) and np.allclose(w.sum(axis=1), 1)
    assert (I.resized(np.full((50, 30), 77.0), 5, 9, "lanczos") == 77).all()
