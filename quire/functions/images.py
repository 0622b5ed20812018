"""Page images through Spark's image source, measured in Arrow batches: statistics, fingerprints, blank pages, crop boxes.

Spark decodes; the tables here hold one row for each image (`origin`, `width`, `height` and measures), so pixels
never leave the task that decoded them.  Images that Spark can't decode have no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.series import projection_run

# Luma weights, edge thresholds, preview size, foreground thresholds, blur.
LUMA, LUMA_SHIFT = (19595, 38470, 7471), 16
EDGE_LOW, EDGE_HIGH = 100, 200
PREVIEW_LONG_EDGE, SATURATED, DARK = 1000, 8, 175
BLUR = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)
WHITE, BLACK = 245, 10

STATS = "white_ratio double, black_ratio double, edge_ratio double, saturation_mean double, value_mean double, gray_std double"


def read_images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(origin, width, height, channels, data): decoded images below a folder, bottom-up order of channels as Spark has it (BGR)."""
    images = spark.read.format("image").option("dropInvalid", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return images.select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def pixels(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Rows x columns x RGB."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]


def luma(rgb: np.ndarray) -> np.ndarray:
    total = sum(rgb[:, :, k].astype(np.uint32) * LUMA[k] for k in range(3))
    return ((total + (1 << LUMA_SHIFT - 1)) >> LUMA_SHIFT).astype(np.uint8)


def saturation(rgb: np.ndarray) -> np.ndarray:
    """HSV saturation in 0..255."""
    high, low = rgb.max(axis=2).astype(float), rgb.min(axis=2)
    return np.rint(np.divide(255 * (high - low), high, out=np.zeros_like(high), where=high > 0)).astype(np.uint8)


def resampling(size: int, target: int, kernel: str) -> np.ndarray:
    """The target x size weights of a resize along one axis: "area", "linear" or "lanczos", widened when it shrinks."""
    scale = size / target
    if kernel == "area":
        edges = np.arange(target + 1) * scale
        at = np.arange(size)
        weights = np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None)
        return weights / weights.sum(axis=1, keepdims=True)
    wide = max(scale, 1.0)
    x = (np.arange(size) + 0.5 - (np.arange(target)[:, None] + 0.5) * scale) / wide
    weights = np.clip(1 - np.abs(x), 0, None) if kernel == "linear" else np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resized(plane: np.ndarray, width: int, height: int, kernel: str) -> np.ndarray:
    across = np.clip(np.rint(plane @ resampling(plane.shape[1], width, kernel).T), 0, 255)
    return np.clip(np.rint(resampling(plane.shape[0], height, kernel) @ across), 0, 255).astype(np.uint8)


def _filtered(plane: np.ndarray, down: tuple, across: tuple, edge: str) -> np.ndarray:
    """A separable filter of odd lengths; the borders are mirrored ("reflect") or repeated ("edge")."""
    a, b = len(down) // 2, len(across) // 2
    padded = np.pad(plane.astype(np.float32), ((a, a), (b, b)), mode=edge)
    rows = sum(w * padded[k : k + plane.shape[0]] for k, w in enumerate(down))
    return sum(w * rows[:, k : k + plane.shape[1]] for k, w in enumerate(across))


def edges(gray: np.ndarray, low: float = EDGE_LOW, high: float = EDGE_HIGH) -> np.ndarray:
    """Edge pixels: Sobel gradients in L1, thinned across the edge, weak ones only where they are joined to strong ones."""
    dx, dy = _filtered(gray, (1, 2, 1), (-1, 0, 1), "edge"), _filtered(gray, (-1, 0, 1), (1, 2, 1), "edge")
    size = np.abs(dx) + np.abs(dy)
    ring = np.pad(size, 1)

    def beside(down: int, right: int) -> np.ndarray:
        return ring[1 + down : 1 + down + size.shape[0], 1 + right : 1 + right + size.shape[1]]

    flat, steep = np.abs(dy) < 0.4142 * np.abs(dx), np.abs(dy) > 2.4142 * np.abs(dx)
    same = dx * dy >= 0
    before = np.select([flat, steep, same], [beside(0, -1), beside(-1, 0), beside(-1, -1)], beside(-1, 1))
    after = np.select([flat, steep, same], [beside(0, 1), beside(1, 0), beside(1, 1)], beside(1, -1))
    straight = flat | steep
    thin = (size > low) & (size > before) & np.where(straight, size >= after, size > after)
    found = thin & (size > high)
    front = found
    while front.any():
        ring_of = np.pad(front, 1)
        reach = np.zeros_like(front)
        for i in range(3):
            for j in range(3):
                reach |= ring_of[i : i + front.shape[0], j : j + front.shape[1]]
        front = reach & thin & ~found
        found = found | front
    return found


def stats_of(rgb: np.ndarray) -> tuple:
    """The measures of STATS (IM1)."""
    gray = luma(rgb)
    return (float((gray >= WHITE).mean()), float((gray <= BLACK).mean()), float(edges(gray).mean()), float(saturation(rgb).mean()), float(rgb.max(axis=2).mean()), float(gray.std()))


def histogram_of(rgb: np.ndarray) -> list[float]:
    """Gray counts of 256 levels, scaled to length 1, as cover dedup compares them (WI4)."""
    counts = np.bincount(luma(rgb).ravel(), minlength=256).astype(float)
    return (counts / np.linalg.norm(counts)).tolist()


def fingerprint_of(rgb: np.ndarray) -> tuple:
    """Aspect in thousandths, and difference and average hashes of 256 bits, as four longs each, first bits first (IM3)."""
    gray = luma(rgb).astype(float)
    steps = resized(gray, 17, 16, "lanczos").astype(int)
    even = resized(gray, 16, 16, "lanczos").astype(int)
    bits = ((steps[:, :-1] > steps[:, 1:]).ravel(), even.ravel() >= even.mean())
    words = [np.packbits(b).view(">u8").astype(np.uint64).view(np.int64).tolist() for b in bits]
    return round(rgb.shape[1] * 1000 / max(rgb.shape[0], 1)), *words


def nearly_white(rgb: np.ndarray) -> bool:
    """A page that a renderer left blank: 64 x 64 levels of mean 250 or more that hardly differ (FI12)."""
    small = resized(luma(rgb).astype(float), 64, 64, "linear")
    share = np.bincount(small.ravel()) / small.size
    share = share[share > 0]
    return bool(small.mean() >= 250 and (int(small.max()) - int(small.min()) <= 5 or -(share * np.log2(share)).sum() < 0.25))


def foreground_box(rgb: np.ndarray) -> tuple:
    """left, top, right, bottom of the page on its scan, and the share of coloured or dark points (IM4)."""
    height, width = rgb.shape[:2]
    scale = min(1.0, PREVIEW_LONG_EDGE / max(width, height))
    planes = [rgb[:, :, k].astype(float) for k in range(3)]
    if scale < 1:
        planes = [resized(p, max(1, round(width * scale)), max(1, round(height * scale)), "area") for p in planes]
    border = "reflect" if min(planes[0].shape) > 2 else "edge"
    soft = np.stack([np.rint(_filtered(p, BLUR, BLUR, border)) for p in planes], axis=2).astype(np.uint8)
    inked = (saturation(soft) > SATURATED) | (luma(soft) < DARK)
    left, right = projection_run(inked.mean(axis=0))
    top, bottom = projection_run(inked.mean(axis=1))
    return max(0, int(left / scale)), max(0, int(top / scale)), min(width, int(np.ceil(right / scale))), min(height, int(np.ceil(bottom / scale))), float(inked.mean())


def _measured(images: DataFrame, of, schema: str) -> DataFrame:
    """(origin, width, height, *schema): `of` the pixels of each image; nothing but the measures leaves the task."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for frame in frames:
            rows = [of(pixels(*x)) for x in zip(frame["data"], frame["width"], frame["height"], frame["channels"], strict=True)]
            yield pd.concat([frame[["origin", "width", "height"]], pd.DataFrame(rows, columns=names, index=frame.index)], axis=1)

    return images.select("origin", "width", "height", "channels", "data").mapInPandas(run, f"origin string, width int, height int, {schema}")


def page_stats(images: DataFrame) -> DataFrame:
    """The statistics struct `stats` of each image, as filters.garbage_reason and filters.protected_page take it (IM1, IM2)."""
    flat = _measured(images, stats_of, STATS)
    return flat.select("origin", "width", "height", F.struct(*[c.split()[0] for c in STATS.split(", ")]).alias("stats"))


def gray_histograms(images: DataFrame) -> DataFrame:
    return _measured(images, lambda rgb: (histogram_of(rgb),), "histogram array<double>")


def fingerprints(images: DataFrame) -> DataFrame:
    return _measured(images, fingerprint_of, "aspect int, difference array<bigint>, average array<bigint>")


def blank_pages(images: DataFrame) -> DataFrame:
    return _measured(images, lambda rgb: (nearly_white(rgb),), "blank boolean")


def page_boxes(images: DataFrame) -> DataFrame:
    """Crop boxes before consensus, as series.consensus_boxes takes them."""
    return _measured(images, foreground_box, "left int, top int, right int, bottom int, foreground double")
