"""Image measurements as numpy kernels over rasters, run in Arrow batches by `measure`.

A raster is (height, width, 3) bytes in order red, green, blue. Every kernel takes whole arrays; the composed scores are
Column expressions over what these return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.functions.scalars import round_up, screen_aspect
from lumisift.functions.scores import composed_scores


def clamp01(v: float) -> float:
    return float(min(1.0, max(0.0, v)))


def to_gray(rgb: np.ndarray) -> np.ndarray:
    """Rec. 709 luminance, rounded to bytes."""
    return np.floor(rgb.astype(np.float64) @ np.array([0.2126, 0.7152, 0.0722]) + 0.5).clip(0, 255)


def resize_gray(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean of each cell's box; cells smaller than a pixel take it whole."""

    def edges(size: int, n: int):
        lo = np.minimum(size - 1, np.floor(np.arange(n) * (size / n)).astype(int))
        hi = np.minimum(size, np.maximum(lo + 1, np.floor((np.arange(n) + 1) * (size / n)).astype(int)))
        return lo, hi

    h, w = gray.shape
    sums = np.zeros((h + 1, w + 1))
    sums[1:, 1:] = gray.astype(np.float64).cumsum(0).cumsum(1)
    (y0, y1), (x0, x1) = edges(h, height), edges(w, width)
    box = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    return (box / np.outer(y1 - y0, x1 - x0)).astype(np.float32)


def _laplacian(gray: np.ndarray) -> np.ndarray:
    g = gray.astype(np.float64)
    return 4 * g[1:-1, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:] - g[:-2, 1:-1] - g[2:, 1:-1]


def laplacian_variance(gray: np.ndarray) -> float:
    return float(_laplacian(gray).var()) if min(gray.shape) >= 3 else 0.0


def local_sharpness(gray: np.ndarray, block: int = 24) -> float:
    """95th percentile of the blocks' laplacian variances."""
    h, w = (n // block for n in gray.shape)
    if not h or not w:
        return laplacian_variance(gray)
    scores = np.sort([laplacian_variance(gray[y * block : (y + 1) * block, x * block : (x + 1) * block]) for y in range(h) for x in range(w)])
    return float(scores[min(len(scores) - 1, int(len(scores) * 0.95))])


def luminance(gray: np.ndarray) -> dict[str, float]:
    hist = np.bincount(gray.astype(np.int64).ravel(), minlength=256)
    n, reached = gray.size, np.cumsum(np.bincount(gray.astype(np.int64).ravel(), minlength=256))
    at = lambda p: int(np.searchsorted(reached, p * n, side="left"))
    return {
        "lum_mean": float(gray.mean()), "lum_sd": float(gray.std()), "lum_p05": at(0.05), "lum_p50": at(0.5), "lum_p95": at(0.95),
        "dark_frac": float(hist[:40].sum() / n), "bright_frac": float(hist[220:].sum() / n),
    }


def bimodality(gray: np.ndarray) -> float:
    """Largest variance between two classes of luminance, over that of black and white."""
    hist = np.bincount(gray.astype(np.int64).ravel(), minlength=256).astype(np.float64)
    n, below = hist.sum(), np.cumsum(hist)
    mass, total = np.cumsum(hist * np.arange(256)), (hist * np.arange(256)).sum()
    ok = (below > 0) & (below < n)
    if not ok.any():
        return 0.0
    b, m = below[ok], mass[ok]
    return clamp01(float(((b / n) * (1 - b / n) * (m / b - (total - m) / (n - b)) ** 2).max()) / 128**2)


def _hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel()).tobytes().hex()


def dhash(gray: np.ndarray) -> str:
    s = resize_gray(gray, 9, 8)
    return _hex(s[:, :-1] > s[:, 1:])


def ahash(gray: np.ndarray) -> str:
    s = resize_gray(gray, 8, 8)
    return _hex(s > s.astype(np.float64).mean())


def color(rgb: np.ndarray) -> dict[str, float]:
    x = rgb.reshape(-1, 3).astype(np.int64)
    high, low = x.max(1), x.min(1)
    saturation = np.divide(high - low, high, out=np.zeros(len(x)), where=high > 0)
    bins = np.bincount(((x[:, 0] >> 4) << 8) | ((x[:, 1] >> 4) << 4) | (x[:, 2] >> 4), minlength=4096)
    used = int((bins >= max(1, len(x) * 0.0004)).sum())
    return {"sat_mean": float(saturation.mean()), "sat_high_frac": float((saturation > 0.35).mean()), "gray_frac": float((high - low < 18).mean()), "palette_frac": used / 4096}


def flat_ratio(gray: np.ndarray, block: int = 8, least: float = 12) -> float:
    h, w = (n // block for n in gray.shape)
    if not h or not w:
        return 0.0
    cells = gray[: h * block, : w * block].astype(np.float64).reshape(h, block, w, block)
    return float((cells.var(axis=(1, 3)) < least).mean())


def axial_ratio(gray: np.ndarray) -> float:
    """Share of edge strength within 12 degrees of an axis."""
    if min(gray.shape) < 3:
        return 0.0
    g = gray.astype(np.float64)
    across = g[:-2] + 2 * g[1:-1] + g[2:]
    down = g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    ax, ay = np.abs(across[:, 2:] - across[:, :-2]), np.abs(down[2:] - down[:-2])
    strength = np.where(ax + ay >= 40, ax + ay, 0)
    axial = (ay <= ax * np.tan(np.radians(12))) | (ax <= ay * np.tan(np.radians(12)))
    return float(strength[axial].sum() / strength.sum()) if strength.sum() else 0.0


def text_score(gray: np.ndarray) -> float:
    """Rows of many strong changes between dark and light, and how they come in runs."""
    h, w = gray.shape
    if w < 16 or h < 16:
        return 0.0
    on = gray > 128
    changes = (on[:, 1:] != on[:, :-1]) & (np.abs(np.diff(gray.astype(np.float64), axis=1)) > 30)
    texty = (changes.sum(1) / w).astype(np.float32) > 0.06
    runs = int((texty & ~np.concatenate([[False], texty[:-1]])).sum())
    return clamp01(texty.mean() * 0.6 + min(1, runs / max(4, h / 10)) * 0.4)


def band_uniformity(gray: np.ndarray, start: float, end: float) -> float:
    h = gray.shape[0]
    band = gray[max(0, int(np.floor(h * start))) : min(h, int(np.ceil(h * end)))]
    return clamp01(1 - float(band.astype(np.float64).var()) / 400) if len(band) else 0.0


def _skin(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., i].astype(np.float64) for i in range(3))
    plausible = (rgb.max(-1) - rgb.min(-1).astype(np.float64) >= 15) & (r - g >= 8) & (r > b)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    cb, cr = 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b
    chroma = (y > 32) & (cb >= 74) & (cb <= 138) & (cr >= 130) & (cr <= 182)
    total = r + g + b
    nr, ng = np.divide(r, total, out=np.zeros_like(r), where=total > 0), np.divide(g, total, out=np.zeros_like(r), where=total > 0)
    share = (total >= 60) & (nr >= 0.33) & (nr <= 0.52) & (ng >= 0.24) & (ng <= 0.365)
    return plausible & (chroma | share)


def _neighbours(mask: np.ndarray, outside: bool) -> list[np.ndarray]:
    p = np.pad(mask, 1, constant_values=outside)
    return [p[1:-1, 1:-1], p[1:-1, :-2], p[1:-1, 2:], p[:-2, 1:-1], p[2:, 1:-1]]


def dilate(mask: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce(_neighbours(mask, False))


def erode(mask: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce(_neighbours(mask, True))


def regions(mask: np.ndarray) -> Iterator[tuple[int, slice, slice]]:
    """(area, rows, columns) of the 4-connected regions, in order of their first pixel: labels sink to the least one beside them."""
    h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:
        p = np.pad(label, 1, constant_values=h * w)
        low = np.where(mask, np.minimum.reduce([label, p[1:-1, :-2], p[1:-1, 2:], p[:-2, 1:-1], p[2:, 1:-1]]), h * w)
        flat = np.append(low.ravel(), h * w)
        low = np.where(mask, np.minimum(low, flat[low]), h * w)  # a label's own label
        if (low == label).all():
            break
        label = low
    for k in np.unique(label[mask]):
        ys, xs = np.nonzero(label == k)
        yield len(ys), slice(ys.min(), ys.max() + 1), slice(xs.min(), xs.max() + 1)


def skin_face(rgb: np.ndarray) -> dict:
    """A face guessed from regions of skin colour: face_score, skin_frac, face_box (x, y, width, height; shares).

    The bounds and weights here and in _skin are fixed values.
    """
    h, w = rgb.shape[:2]
    means = rgb.reshape(-1, 3).astype(np.float64).mean(0)
    gains = np.clip(np.divide(means.mean(), means, out=np.ones(3), where=means > 1), 0.75, 1.35)
    mask = _skin(rgb) | _skin(np.minimum(255, rgb * gains))
    out = {"face_score": 0.0, "skin_frac": float(mask.mean()), "face_box": None}
    if out["skin_frac"] < 0.004:
        return out
    mask = erode(erode(dilate(dilate(dilate(erode(mask))))))
    gray, least, largest = to_gray(rgb), max(5, int(np.floor(min(w, h) * 0.05 + 0.5))), 0.0
    for area, ys, xs in regions(mask):
        bh, bw, share = ys.stop - ys.start, xs.stop - xs.start, area / (w * h)
        largest = max(largest, share)
        aspect, fill = bw / bh, area / (bw * bh)
        if share < 0.0015 or min(bw, bh) < least or not 0.35 <= aspect <= 3 or fill < 0.3:
            continue
        inside = gray[ys, xs]
        dark = float((inside < inside.mean() * 0.62).mean())
        score = clamp01(
            0.24 * (1 - min(1, abs(aspect - 0.8) / 1.1)) + 0.18 * clamp01((fill - 0.3) / 0.5) + 0.34 * clamp01((dark - 0.008) / 0.11) + 0.24 * clamp01(min(share / 0.012, (0.85 - share) / 0.4))
        )
        if score > out["face_score"]:
            out |= {"face_score": score, "face_box": [xs.start / w, ys.start / h, bw / w, bh / h]}
    out["face_score"] = max(out["face_score"], clamp01((largest - 0.01) / 0.09) * 0.7)
    return out


def shrunk(rgb: np.ndarray, most: int) -> np.ndarray:
    """Box-averaged so that no side is over `most` (8 at least); never enlarged."""
    h, w = rgb.shape[:2]
    scale = min(1.0, most / max(h, w))
    if scale == 1.0:
        return rgb
    nh, nw = max(8, round(h * scale)), max(8, round(w * scale))
    return np.stack([np.floor(resize_gray(rgb[..., i], nw, nh) + 0.5) for i in range(3)], -1).astype(np.uint8)


#: Longest sides for the measurements and for the guess of a face.
ANALYSIS_SIDE, FACE_SIDE = 224, 160

MEASURES = """src_side int, nat_w int, nat_h int, lap_var double, local_sharp double, lum_mean double, lum_sd double, lum_p05 int, lum_p50 int, lum_p95 int,
dark_frac double, bright_frac double, sat_mean double, sat_high_frac double, gray_frac double, palette_frac double, flat_ratio double, axial_ratio double, text_score double,
bimodality double, top_bar double, bottom_bar double, dhash string, ahash string, face_score double, skin_frac double, face_box array<double>, face_method string, face_count int, face_area double""".replace("\n", " ")


def measurements(rgb: np.ndarray) -> dict:
    """All raw measurements of one raster."""
    nat_h, nat_w = rgb.shape[:2]
    img = shrunk(rgb, ANALYSIS_SIDE)
    gray = to_gray(img)
    face = skin_face(shrunk(rgb, FACE_SIDE))
    return {
        "src_side": max(img.shape[:2]), "nat_w": nat_w, "nat_h": nat_h, "lap_var": laplacian_variance(gray), "local_sharp": local_sharpness(gray), **luminance(gray), **color(img),
        "flat_ratio": flat_ratio(gray), "axial_ratio": axial_ratio(gray), "text_score": text_score(gray), "bimodality": bimodality(gray), "top_bar": band_uniformity(gray, 0, 0.045),
        "bottom_bar": band_uniformity(gray, 0.955, 1), "dhash": dhash(gray), "ahash": ahash(gray), **face, "face_method": "heuristic", "face_count": int(face["face_score"] >= 0.5), "face_area": 0.0,
    }


def measure(images: DataFrame) -> DataFrame:
    """images (id, width, height, channels, data blue first) -> id, MEASURES, error: a row that can't be measured keeps its reason."""
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                try:
                    x = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                    rgb = x[..., 2::-1] if r.channels >= 3 else np.repeat(x, 3, axis=2)
                    out.append({"id": r.id, **measurements(rgb), "error": None})
                except (ValueError, TypeError) as e:
                    out.append({"id": r.id, **dict.fromkeys(names), "error": f"decode: {e}"[:200]})
            yield pd.DataFrame(out, columns=["id", *names, "error"])

    return images.select("id", "width", "height", "channels", "data").mapInPandas(rows, f"id string, {MEASURES}, error string")


def with_detections(measured: DataFrame, found: DataFrame, method: str = "ultraface") -> DataFrame:
    """Faces of a detector (photo_id, face_score, face_count, face_box, face_area) in place of the guess, which stays where it said nothing.

    Applied for a native detector first and a trained one after it, the better tier wins.
    """
    names = ("face_score", "face_count", "face_box", "face_area")
    tier = found.select(F.col("photo_id").alias("id"), *[F.col(n).alias(f"_{n}") for n in names], F.lit(method).alias("_method"))
    out = measured.join(tier, "id", "left")
    hit = F.col("_method").isNotNull()
    changes = {n: F.when(hit, F.col(f"_{n}")).otherwise(F.col(n)) for n in names}
    changes |= {"face_method": F.coalesce("_method", "face_method"), "skin_frac": F.when(hit, F.lit(0.0)).otherwise(F.col("skin_frac"))}
    return out.withColumns(changes).drop("_method", *[f"_{n}" for n in names])


#: Digits that persisted measurements keep.
DIGITS = {
    "lap_var": 1, "local_sharp": 1, "lum_mean": 2, "lum_sd": 2, "dark_frac": 4, "bright_frac": 4, "sat_mean": 4, "gray_frac": 4, "palette_frac": 4, "flat_ratio": 4,
    "axial_ratio": 4, "text_score": 4, "bimodality": 4, "face_area": 4, "skin_frac": 4, "top_bar": 3, "bottom_bar": 3, "face_score": 3,
}


def features(measured: DataFrame) -> DataFrame:
    """Measurements with the composed scores, aspect and its score, rounded as they are kept."""
    out = measured.withColumn("aspect_score", screen_aspect(F.col("nat_w"), F.col("nat_h"))).withColumn("aspect", F.col("nat_w") / F.col("nat_h"))
    out = out.withColumns(composed_scores())  # on raw measurements
    out = out.withColumns({k: round_up(F.col(k), d) for k, d in DIGITS.items()} | {"aspect_score": round_up(F.col("aspect_score"), 3)})
    return out.withColumn("face_box", F.transform("face_box", lambda x: round_up(x, 4)))
