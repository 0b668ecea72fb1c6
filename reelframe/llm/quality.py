"""Quality scores from compression with dictionaries of good and of bad text.

A zstandard dictionary is trained on good and one on bad labelled text. A text is compressed in blocks of ``BLOCK``
bytes with either; the difference of the sizes, as a share of the text's own, goes through a logistic calibration that
is fitted on other labelled rows.

Training takes at most ``PER_CLASS`` documents of each label, chosen by hash over all labelled rows. One half of them
gives about ``BLOCKS`` blocks for the dictionary, an equal number from each document, spread over its length; the other
half calibrates, on whole texts that the tasks compress. Only blocks and differences reach the driver. Scoring reads
whole texts.

Defined results: null text is empty text, which gets the score of the calibration at no difference. Where a label
has no training text, every score is 0.5. Equal rows get equal scores. Labels other than 0 and 1 are ignored; a
document with both counts as 1. Of training rows with one doc_id the least text counts. Columns besides those named are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fold_is, hold, labelled_sample, pieces, table

PER_CLASS = 4096
BLOCK = 1024
DICTIONARY = 32 << 10
#: Documents, about, whose whole texts a dictionary is trained on.
DOCUMENTS = 800
LEVEL = 3


def blocks(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def dictionary(parts: list[bytes]) -> bytes:
    """A trained dictionary; the blocks themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, k=200, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICTIONARY]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    plain = content[:4] != b"\x37\xa4\x30\xec"  # the mark of trained dictionaries
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT if plain else zstandard.DICT_TYPE_FULLDICT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def differences(texts: list[str], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """How much smaller each text gets with the good dictionary than with the bad one, as a share of its bytes."""
    out = np.zeros(len(texts))
    for i, t in enumerate(texts):
        less = size = 0
        for part in blocks(t):
            less += len(bad.compress(part)) - len(good.compress(part))
            size += len(part)
        out[i] = less / (size + 8)  # a few bytes are added so that short texts stay near 0
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method on standardised features."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve(z.T @ (z * (weight * p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w)), z.T @ (weight * (y - p)) - ridge * w)
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


class Model:
    """The dictionaries' contents and the calibration's weight and bias; without contents, every score is 0.5."""

    def __init__(self, contents: tuple[bytes, bytes] | None = None, weight: float = 0.0, bias: float = 0.0):
        self.contents, self.weight, self.bias = contents, weight, bias

    def differences(self, texts: list[str]) -> np.ndarray:
        return differences(texts, *map(compressor, self.contents))

    def score(self, texts: list[str]) -> np.ndarray:
        if self.contents is None:
            return np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.differences(texts) * self.weight + self.bias, -30, 30)))


def _mapped(docs: DataFrame, name: str, of) -> DataFrame:
    """docs with one more column: a number for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = [x or "" for x in column(part, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(of(texts))], [*part.schema.names, name])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{name} double"]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    sample = labelled_sample(labels, label, per_class)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y", "rows").agg(F.min("text").alias("text"))
    rows = hold(rows.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)) == 0))
    size = {(r.y, r.held): r.n for r in rows.groupBy("y", "held").agg(F.count("*").alias("n")).collect()}
    if len({y for y, _ in size}) < 2:
        return Model()
    both = len(size) == 4  # few rows do both jobs
    raw = F.encode("text", "UTF-8")
    parts = rows.where(~F.col("held")) if both else rows
    step = {y: -(-size.get((y, False), size.get((y, True))) // DOCUMENTS) for y in (0, 1)}
    parts = parts.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.when(F.col("y") == 1, step[1]).otherwise(step[0])) == 0)
    parts = parts.select("doc_id", "y", raw.alias("raw"), F.ceil(F.octet_length("text") / BLOCK).cast("int").alias("n")).where("n > 0")
    each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda p: F.substring("raw", (p * BLOCK + 1).cast("int"), F.lit(BLOCK)))
    parts = parts.select("doc_id", "y", F.posexplode(each).alias("i", "part"))
    found = {y: [bytes(r.part) for r in parts.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "i").select("part").collect()] for y in (1, 0)}
    if not found[1] or not found[0]:
        return Model()
    model = Model((dictionary(found[1]), dictionary(found[0])))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = rows.where("held") if both else rows
    seen = _mapped(held.select("y", "rows", "text"), "x", lambda texts: shared.value.differences(texts)).select("y", "rows", "x").toPandas()
    # weighted to the share of good rows that all labelled rows have
    x, y, rows = (seen[c].to_numpy(float) for c in ("x", "y", "rows"))
    good = rows[y == 1].sum() / rows.sum()
    weight = np.where(y == 1, good / (y == 1).sum(), (1 - good) / (y == 0).sum()) * len(y)
    (w,), bias = logistic(x[:, None], y, weight)
    return Model(model.contents, float(w), bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, then score, which must not be among them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _mapped(docs, "score", lambda texts: shared.value.score(texts))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").where(~fold_is("doc_id", 3, 1)))
    scored = score(docs.select("doc_id", fold_is("doc_id", 3, 1).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
