"""Face detections: decoding, suppression, geometry and a pluggable reading of photos."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least score of a listed face and of one that is read, its least width in pixels and as a share, overlap and count limits, sizes of the networks' inputs, the margin of a crop.
LEAST_SCORE, READ_SCORE, LEAST_WIDTH, LEAST_SIDE, OVERLAP, MOST = 0.6, 0.75, 24, 0.012, 0.35, 64
DETECT_SIZE, FACE_SIZE, MARGIN = (320, 240), 112, 0.25


def iou(a: Column, b: Column) -> Column:
    """Overlap of two corner boxes (arrays x1, y1, x2, y2); touching ones have none."""
    side = lambda i: F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i])
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    w, h = side(0), side(1)
    inter = w * h
    union = area(a) + area(b) - inter
    return F.when((w <= 0) | (h <= 0) | (union <= 0), F.lit(0.0)).otherwise(inter / union)


def _iou(box: np.ndarray, kept: np.ndarray) -> np.ndarray:
    w = np.minimum(box[2], kept[:, 2]) - np.maximum(box[0], kept[:, 0])
    h = np.minimum(box[3], kept[:, 3]) - np.maximum(box[1], kept[:, 1])
    inter = np.where((w > 0) & (h > 0), w * h, 0)
    area = lambda x: np.maximum(0, x[..., 2] - x[..., 0]) * np.maximum(0, x[..., 3] - x[..., 1])
    union = area(box) + area(kept) - inter
    return np.divide(inter, union, out=np.zeros(len(kept)), where=union > 0)


def suppress(boxes: np.ndarray, scores: np.ndarray, overlap: float = OVERLAP, most: int = MOST) -> list[int]:
    """Places of the boxes kept, best first; equal scores keep their order."""
    kept: list[int] = []
    for i in np.argsort(-scores, kind="stable"):
        if len(kept) >= most:
            break
        if not kept or (_iou(boxes[i], boxes[kept]) <= overlap).all():
            kept.append(int(i))
    return kept


def decode(scores: np.ndarray, boxes: np.ndarray, least: float = LEAST_SCORE, overlap: float = OVERLAP, most: int = MOST, side: float = LEAST_SIDE) -> tuple[np.ndarray, np.ndarray]:
    """Flat network output (score pairs, corner boxes) -> boxes and scores of faces."""
    n = min(len(scores) // 2, len(boxes) // 4)
    s, b = np.asarray(scores, float)[: 2 * n].reshape(n, 2)[:, 1], np.clip(np.asarray(boxes, float)[: 4 * n].reshape(n, 4), 0, 1)
    w, h = b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]
    ok = (s >= least) & (w > 0) & (h > 0) & (w >= side) & (h >= side)
    b, s = b[ok], s[ok]
    kept = suppress(b, s, overlap, most)
    return b[kept], s[kept]


def decode_detections(raw: DataFrame, **options) -> DataFrame:
    """raw (photo_id, scores, boxes) -> (photo_id, place, box, score): suppression runs photo by photo within Arrow batches."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                b, s = decode(np.asarray(r.scores), np.asarray(r.boxes), **options)
                out += [(r.photo_id, i, x.tolist(), float(v)) for i, (x, v) in enumerate(zip(b, s))]
            yield pd.DataFrame(out, columns=["photo_id", "place", "box", "score"])

    return raw.select("photo_id", "scores", "boxes").mapInPandas(rows, "photo_id string, place int, box array<double>, score double")


def summarise(faces: DataFrame) -> DataFrame:
    """Per photo: best score, count, the best box as x, y, width, height, and the area of all, at most 1."""
    b = F.col("box")
    best = F.min_by(F.struct("box", "score"), F.struct(-F.col("score"), F.col("place")))
    return faces.groupBy("photo_id").agg(
        F.least(F.lit(1.0), F.max("score")).alias("face_score"),
        F.count("*").cast("int").alias("face_count"),
        best.alias("_b"),
        F.least(F.lit(1.0), F.sum((b[2] - b[0]) * (b[3] - b[1]))).alias("face_area"),
    ).select("photo_id", "face_score", "face_count", F.array(F.col("_b.box")[0], F.col("_b.box")[1], F.col("_b.box")[2] - F.col("_b.box")[0], F.col("_b.box")[3] - F.col("_b.box")[1]).alias("face_box"), "face_area")


def input_tensor(rgb: np.ndarray, size: tuple[int, int] = DETECT_SIZE) -> tuple[np.ndarray, dict]:
    """Letterboxed planes around grey, and the padding that undoes it."""
    (net_w, net_h), (h, w) = size, rgb.shape[:2]
    scale = min(net_w / w, net_h / h)
    dw, dh = max(1, int(np.floor(w * scale + 0.5))), max(1, int(np.floor(h * scale + 0.5)))
    ox, oy = (net_w - dw) // 2, (net_h - dh) // 2
    ys = np.minimum(h - 1, np.floor(np.arange(dh) / scale).astype(int))
    xs = np.minimum(w - 1, np.floor(np.arange(dw) / scale).astype(int))
    out = np.zeros((3, net_h, net_w), np.float32)
    out[:, oy : oy + dh, ox : ox + dw] = ((rgb[ys][:, xs].astype(np.float32) - 127) / 128).transpose(2, 0, 1)
    return out, {"ox": ox, "oy": oy, "dw": dw, "dh": dh, "net_w": net_w, "net_h": net_h}


def unpad(boxes: np.ndarray, pad: dict) -> np.ndarray:
    """Boxes of the letterboxed input as shares of the photo; empty ones go."""
    scale, shift = np.array([pad["net_w"], pad["net_h"]] * 2, float), np.array([pad["ox"], pad["oy"]] * 2, float)
    b = np.clip((np.asarray(boxes, float).reshape(-1, 4) * scale - shift) / np.array([pad["dw"], pad["dh"]] * 2, float), 0, 1)
    return b[(b[:, 2] > b[:, 0]) & (b[:, 3] > b[:, 1])]


def crop_rect(box: Column, width: Column, height: Column, margin: float = MARGIN) -> Column:
    """The square around a face, and the part of it that lies in the photo."""
    half_up = lambda x: F.floor(x + F.lit(0.5)).cast("int")
    x1, y1, x2, y2 = box[0] * width, box[1] * height, box[2] * width, box[3] * height
    half = F.greatest(x2 - x1, y2 - y1) * F.lit(1 + margin) / 2
    left, top, side = half_up((x1 + x2) / 2 - half), half_up((y1 + y2) / 2 - half), F.greatest(F.lit(1), half_up(half * 2))
    sx, sy = F.greatest(F.lit(0), left), F.greatest(F.lit(0), top)
    return F.struct(
        left.alias("left"), top.alias("top"), side.alias("side"), sx.alias("sx"), sy.alias("sy"),
        F.greatest(F.lit(0), F.least(left + side, width) - sx).alias("sw"), F.greatest(F.lit(0), F.least(top + side, height) - sy).alias("sh"),
        (sx - left).alias("dx"), (sy - top).alias("dy"), (F.lit(float(FACE_SIZE)) / side).alias("scale"),
    )


def face_tensor(rgb: np.ndarray) -> np.ndarray:
    return ((rgb.astype(np.float32) - 127.5) / 127.5).transpose(2, 0, 1)


def face_width(box: Column, width: Column) -> Column:
    return (box[2] - box[0]) * width


def read_photos(photos: DataFrame, detect: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], embed: Callable[[np.ndarray, np.ndarray], np.ndarray | None]) -> DataFrame:
    """photos (id, width, height, channels, data) -> (photo_id, ok, error, skipped, id, box, score, vector).

    detect gives boxes and scores of a raster, embed the vector of a raster's box; a photo of which any step fails is unread.
    One row without a face stands for a photo in which nobody is.
    """
    schema = "photo_id string, ok boolean, error string, skipped int, id string, box array<double>, score double, vector array<float>"
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                try:
                    rgb = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)[..., 2::-1]
                    boxes, scores = detect(rgb)
                    wide = [i for i, (b, s) in enumerate(zip(boxes, scores)) if s >= READ_SCORE and (b[2] - b[0]) * r.width >= LEAST_WIDTH]
                    narrow = sum(s >= READ_SCORE for s in scores) - len(wide)
                    vectors = [embed(rgb, boxes[i]) for i in wide]
                    if any(v is None for v in vectors):
                        raise RuntimeError("recognition unavailable")
                except Exception as e:  # foreign models: any failure leaves the photo unread
                    out.append((r.id, False, str(e)[:200], 0, None, None, None, None))
                    continue
                found = [(r.id, True, None, int(narrow), f"{r.id}#{k}", [float(x) for x in boxes[i]], float(scores[i]), np.asarray(v, np.float32).tolist()) for k, (i, v) in enumerate(zip(wide, vectors))]
                out += found or [(r.id, True, None, int(narrow), None, None, None, None)]
            yield pd.DataFrame(out, columns=names)

    return photos.select("id", "width", "height", "channels", "data").mapInPandas(rows, schema)
