"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained on pieces of labelled texts, a bounded sample. A text is compressed piece by piece with either;
the difference of the two sizes per byte of text is its raw score, and a logistic curve fitted on other labelled texts
(weighted to the shares of all labels) makes it a probability. Labels of held-out rows are never read, and label, lang,
source and doc_id are never inputs of a score.

Null and empty texts have difference zero and get the curve's value there. Without labels of both classes every score is the
share of label 1 (a half without any). Rows of labels with nulls are left out; repeated documents each have their result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import byte_rows, table

#: Labelled documents of a class that dictionaries, and as many others that the curve, are fitted on at most.
SAMPLE_DOCS = 3_000
#: Pieces of a class that a dictionary is trained on at most, and their bytes.
SAMPLE_PIECES, PIECE = 12_000, 2_048
DICTIONARY = 112_640
LEVEL = 3


def _pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


@dataclass
class Model:
    """dictionaries: of bad and good text, or None without both classes."""

    dictionaries: tuple[bytes, bytes] | None
    slope: float = 0.0
    offset: float = 0.0

    def compressors(self):
        made = []
        for d in self.dictionaries or ():
            z = zstandard.ZstdCompressionDict(d)
            z.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=z, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made

    @staticmethod
    def difference(text: bytes, compressors) -> float:
        """Compressed bytes with the bad dictionary less those with the good one, per byte of text."""
        if not text or not compressors:
            return 0.0
        bad, good = (sum(len(c.compress(p)) for p in _pieces(text)) for c in compressors)
        return (bad - good) / len(text)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of least weighted log loss, slightly regularised (Newton steps on the standardised input)."""
    mean, sd = x.mean(), x.std() or 1.0
    z = np.stack([(x - mean) / sd, np.ones_like(x)])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b @ z, -40, 40)))
        gradient = z @ (w * (p - y)) + 1e-3 * b
        hessian = (z * (w * p * (1 - p))) @ z.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        b -= step
        if abs(step).max() < 1e-9:
            break
    return float(b[0] / sd), float(b[1] - b[0] * mean / sd)


def _bucket(salt: int):
    return F.abs(F.xxhash64("doc_id", F.lit(salt)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """labels must hold only rows that may be learned from. Repeated rows count once; a doc_id with both labels teaches nothing."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    shares = {r.label: r.n for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        p = (shares.get(1, 0) + 0.5) / (total + 1)
        return Model(None, 0.0, float(np.log(p / (1 - p))))
    sample = None
    for use in (0, 1):  # 0: dictionaries, 1: curve
        for k in (0, 1):
            part = labels.filter((F.col("label") == k) & (_bucket(1) % 2 == use)).orderBy(_bucket(2), "doc_id").limit(SAMPLE_DOCS).withColumn("use", F.lit(use))
            sample = part if sample is None else sample.unionByName(part)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def cut(batches):
        for batch in batches:
            for doc, text, k in zip(batch.column("doc_id").to_pylist(), byte_rows(batch.column("text")), batch.column("label").to_pylist()):
                if pieces := _pieces(text):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc] * len(pieces), pa.int64()), "label": pa.array([k] * len(pieces), pa.int32()), "piece": pieces})

    pieces = chosen.filter("use = 0").select("doc_id", "text", "label").mapInArrow(cut, "doc_id long, label int, piece binary")
    dictionaries = []
    for k in (0, 1):
        samples = [bytes(r.piece) for r in pieces.filter(F.col("label") == k).orderBy(F.xxhash64("piece"), "piece").limit(SAMPLE_PIECES).collect()]
        try:
            dictionaries.append(zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8, f=20, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too few samples to train on: they are the dictionary themselves
            dictionaries.append(b"".join(samples)[-DICTIONARY:] or b" " * 8)
    model = Model(tuple(dictionaries))
    points = _differences(chosen.filter("use = 1").select("doc_id", "text", "label"), model, "label int").select("x", "label").toPandas()
    counts = points.label.value_counts()
    if len(counts) < 2:
        p = (shares.get(1, 0) + 0.5) / (total + 1)
        model.offset = float(np.log(p / (1 - p)))
        return model
    w = points.label.map(lambda k: shares[k] / total / counts[k]).to_numpy() * len(points)
    model.slope, model.offset = _logistic(points.x.to_numpy(), points.label.to_numpy(float), w)
    return model


def _differences(docs: DataFrame, model: Model, further: str = "") -> DataFrame:
    """docs' columns but text, and x."""
    names = [c for c in docs.columns if c != "text"]

    def rows(batches):
        compressors = model.compressors()
        for batch in batches:
            x = [model.difference(t, compressors) for t in byte_rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.float64())], names=[*names, "x"])

    return docs.mapInArrow(rows, f"{', '.join(f'{c} {dict(docs.dtypes)[c]}' for c in names)}, x double")


def classify(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Per row: doc_id, score, predicted."""
    scored = _differences(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    z = F.least(F.lit(40.0), F.greatest(F.lit(-40.0), F.lit(model.slope) * F.col("x") + F.lit(model.offset)))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return scored.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit(docs, labels.filter(remainder != 2))
    return classify(docs, model).select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "score", "predicted")
