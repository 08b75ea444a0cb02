"""Quality classifier (6): compression with two zstandard dictionaries.

One dictionary is trained on good texts and one on bad ones.  A text is
compressed with each; the difference of the compressed sizes over the larger
one is the only evidence.  A logistic calibration, fitted on labelled texts
that built neither dictionary, turns it into the probability of label 1.

The model is fitted on a bounded sample, taken in order of a hash of the id, so
it is the same at every size of the corpus: at most SAMPLE labelled texts of
each label, of TEXT_BYTES each at most (longer ones are passed over) and
SAMPLE_BYTES in all, of which every other one, up to DICT_BYTES, builds the
dictionary and the rest calibrate.  All texts are scored whole.

Defined cases: a null text is empty and scored as such; labels without text,
null labels and null ids teach nothing; of several labels of an id the greater
counts, of several texts of an id the least; with texts of one label only, or
none, every score is the smoothed share of label 1.  Rows stay, with any id; a
null one is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelfactor.llm import _words as W
from panelfactor.llm._spark import arrow, documents

#: bounds of what is learnt from
SAMPLE, DICT_BYTES, SAMPLE_BYTES, TEXT_BYTES = 4000, 4 << 20, 16 << 20, 1 << 20
DICT_SIZE, LEVEL = 112_640, 3
FOLDS, HELD_OUT = 3, 1


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray | None
    scale: np.ndarray | None
    weights: np.ndarray | None
    share: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        x = (evidence(texts, self.compressors()) - self.mean) / self.scale
        return _sigmoid(x @ self.weights[:-1] + self.weights[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def evidence(texts: list[bytes], compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    good, bad = ([len(c.compress(t)) for t in texts] for c in compressors)
    good, bad = np.array(good, float), np.array(bad, float)
    return ((bad - good) / np.maximum(1, np.maximum(bad, good)))[:, None]


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_SIZE, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[:DICT_SIZE] or b"\n" * 8


def _fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4) -> np.ndarray:
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = _sigmoid(z @ w)
        grad = z.T @ (p - y) + penalty * len(y) * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + penalty * len(y) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(good: list[bytes], bad: list[bytes]) -> Model:
    """Every other text builds the dictionaries, up to DICT_BYTES each; the rest calibrate."""
    share = (len(good) + 1) / (len(good) + len(bad) + 2)
    if len(good) < 2 or len(bad) < 2:
        return Model(b"", b"", None, None, None, share)
    parts = []
    for texts in (good, bad):
        take, size = [], 0
        for t in texts[::2]:
            if size >= DICT_BYTES:
                break
            take.append(t)
            size += len(t)
        parts.append(_dictionary(take))
    model = Model(parts[0], parts[1], None, None, None, share)
    rest = good[1::2] + bad[1::2]
    x = evidence(rest, model.compressors())
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = _fit_logistic((x - model.mean) / model.scale, y)
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` texts of each label, of rows outside the held-out fold."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    known = known.where(F.crc32(F.col("id").cast("string")) % FOLDS != HELD_OUT)
    known = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("turn", F.xxhash64("id"))
    picked = [known.where(F.col("label") == k).orderBy("turn", "id").limit(sample) for k in (0, 1)]
    few = F.broadcast(picked[0].union(picked[1]))  # 2 * sample rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").join(few, "id")
    # one text for an id, and a bounded number of bytes on the driver
    one = texts.where(F.octet_length("text") <= TEXT_BYTES).groupBy("label", "turn", "id").agg(F.min("text").alias("text"))
    room = Window.partitionBy("label").orderBy("turn", "id").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(room), F.lit(0))).where(F.col("before") < SAMPLE_BYTES)
    rows = sorted((r.label, r.turn, r.id, r.text.encode()) for r in one.collect())
    return train([r[3] for r in rows if r[0] == 1], [r[3] for r in rows if r[0] == 0])


def _score(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in W.slices(batch, "text"):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(model.scores(texts), pa.float64())], names=[*part.schema.names, "_score"])

    return work


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with column `out`: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.toDF(*("text" if c == text_col else f"c{k}" for k, c in enumerate(docs.columns)))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return arrow(plain, _score(shared), f"{fields}, _score double").toDF(*docs.columns, out)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model).select(F.col("doc_id").cast("long").alias("doc_id"), "score")
    held_out = F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT
    held_out = F.coalesce(held_out, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
