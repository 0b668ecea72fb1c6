"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words that occur far more often in toxic than in other training documents. Features of a text
are lexicon density, distinct lexicon words, lexicon words near second-person words, capitals, punctuation, digits,
obfuscation (words with digits or signs inside, and words that match the lexicon once such signs are read as letters),
and length. Lexicon and trees are fitted on three quarters of the sample, the calibration on the rest.

Training takes at most ``PER_CLASS`` documents of each label, chosen by hash over all labelled rows and weighted by
the rows that they stand for. Both training and scoring read whole texts.

Defined results: null text is empty text, scored by its zero features. Where a label has no training text, every
score is 0. Equal rows get equal scores. Labels other than 0 and 1 are ignored; a document with both counts as 1.
Of training rows with one doc_id the least text counts. Columns besides those named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, column, fold_is, hold, labelled_sample, pieces, table, word_hashes

PER_CLASS = 4096
#: Share of toxic documents that a lexicon word occurs in at least, how many at least, and the least ratio of its shares.
LEXICON_SHARE, LEXICON_DOCS, LEXICON_RATIO = 0.01, 4, 8.0
LEXICON_SIZE = 2000
#: Words on either side in which a second-person word counts as near.
NEAR = 5
TREES, DEPTH = 20, 4
#: Second-person words of the languages at hand.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú usted ustedes ti tus vosotros eres".split()
#: Signs that are read as letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _folds() -> tuple[np.ndarray, np.ndarray]:
    plain = np.zeros(256, np.uint8)
    for lo, hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        plain[lo:hi] = np.arange(lo, hi)
    plain[0x41:0x5B] = plain[0x61:0x7B]
    read = plain.copy()
    for sign, letter in SIGNS.items():
        read[ord(sign)] = ord(letter)
    return plain, read


PLAIN, READ = _folds()


def _hash(words: list[str]) -> np.ndarray:
    raw, at = buffers(pa.array(words, pa.string()))
    return np.unique(word_hashes(raw, at, PLAIN)[0])


def _in(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.searchsorted(keys, values)
    return keys[np.minimum(at, len(keys) - 1)] == values


def features(raw: np.ndarray, at: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    n = len(at) - 1
    total = lambda flags, edges: np.diff(np.concatenate(([0], np.cumsum(flags)))[edges])
    words, starts, ends, heads = word_hashes(raw, at, PLAIN)
    hit = _in(words, lexicon)
    you = np.concatenate(([0], np.cumsum(_in(words, _hash(SECOND_PERSON)))))
    place = np.arange(len(words))
    first, last = np.repeat(heads[:-1], np.diff(heads)), np.repeat(heads[1:], np.diff(heads))
    near = hit & (you[np.minimum(place + NEAR + 1, last)] > you[np.maximum(place - NEAR, first)])
    which = np.unique(np.stack([np.searchsorted(heads, place[hit], "right") - 1, words[hit].view(np.int64)]), axis=1)[0]
    read, _, _, read_heads = word_hashes(raw, at, READ)
    sign = np.zeros(256, bool)
    sign[[*map(ord, SIGNS), ord("*")]] = True
    letter = (PLAIN >= 0x61) & (PLAIN > 0)
    letters = letter[raw]
    inner = np.zeros(len(raw), bool)
    if len(raw) > 2:
        inner[1:-1] = sign[raw[1:-1]] & letters[:-2] & letters[2:]
        full = np.flatnonzero(np.diff(at))
        inner[at[full]] = inner[at[full + 1] - 1] = False  # neighbours in other texts don't count
    size, count = np.maximum(np.diff(at), 1), np.maximum(np.diff(heads), 1)
    hits = total(hit, heads)
    hidden = np.maximum(total(_in(read, lexicon), read_heads) - hits, 0)
    capital = (raw >= 0x41) & (raw <= 0x5A)
    mark = (raw > 0x20) & (raw < 0x7F) & (PLAIN[raw] == 0)
    digit = (raw >= 0x30) & (raw <= 0x39)
    columns = [hits / count, np.minimum(hits, 50), np.bincount(which, minlength=n), total(near, heads) / count, hidden / count, hidden, total(inner, at) / count, total(capital, at) / size, total(mark, at) / size, total(raw == 0x21, at) / size, total(digit, at) / size, np.log1p(count)]
    return np.stack(columns, 1).astype(np.float64)


def _words(sample: DataFrame) -> DataFrame:
    """Distinct words of each document as hashes, with its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words, _, _, heads = word_hashes(*buffers(column(part, "text")), PLAIN)
                pairs = np.unique(np.stack([np.repeat(np.arange(part.num_rows), np.diff(heads)), words.view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1]), column(part, "y").take(pa.array(pairs[0]))], ["word", "y"])

    return sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, "word long, y int")


def _featured(docs: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """The columns of docs but text, then the array of features as "dense"."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                x = features(*buffers(column(part, "text")), shared.value)
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in names), pa.array(list(x), pa.list_(pa.float64()))], [*names, "dense"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "dense array<double>"]))


class Model:
    """Lexicon, trees and calibration; without both labels, none."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS):
        ids = labelled_sample(labels, label, per_class)
        sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y", "rows").agg(F.min("text").alias("text"))
        sample = hold(sample.select("text", "y", F.col("rows").cast("double").alias("weight"), (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0).alias("held")))
        parts = {(r.y, r.held): r.n for r in sample.groupBy("y", "held").agg(F.count("*").alias("n")).collect()}
        self.lexicon, self.trees = np.zeros(0, np.uint64), None
        if len({y for y, _ in parts}) < 2:
            return
        apart = len(parts) == 4  # few rows do both jobs
        learned = sample.where(~F.col("held")) if apart else sample
        size = {y: parts.get((y, False), 0) + (0 if apart else parts.get((y, True), 0)) for y in (0, 1)}
        share = lambda y: (F.sum(F.when(F.col("y") == y, 1).otherwise(0)) + 0.5) / (size[y] + 1)
        counted = _words(learned).groupBy("word").agg(F.sum("y").alias("n"), (share(1) / share(0)).alias("ratio"))
        strong = counted.where((F.col("n") >= max(LEXICON_DOCS, LEXICON_SHARE * size[1])) & (F.col("ratio") >= LEXICON_RATIO))
        self.lexicon = np.unique(np.array([r.word for r in strong.orderBy(F.desc("ratio"), "word").limit(LEXICON_SIZE).collect()], np.int64).view(np.uint64))
        rows = hold(_featured(sample, self.lexicon).select("y", "weight", "held", array_to_vector("dense").alias("features")))
        fit, held = (rows.where(~F.col("held")), rows.where("held")) if apart else (rows, rows)
        boost = GBTClassifier(labelCol="y", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5, minInstancesPerNode=5)
        self.trees = boost.fit(fit.withColumn("y", F.col("y").cast("double")))
        margin = self._margin(held).select(F.col("y").cast("double").alias("label"), "weight", "margin")
        self.calibration = IsotonicRegression(weightCol="weight", featuresCol="margin", predictionCol="score").fit(margin)

    def _margin(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")

    def score(self, docs: DataFrame) -> DataFrame:
        """The columns of docs but text, then score."""
        names = [c for c in docs.columns if c != "text"]
        if self.trees is None:
            return docs.select(*names, F.lit(0.0).alias("score"))
        rows = _featured(docs, self.lexicon).withColumn("features", array_to_vector("dense"))
        return self.calibration.transform(self._margin(rows)).select(*names, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = Model(docs, table(spark, sf_dir, "labels").where(~fold_is("doc_id", 5, 0)))
    scored = model.score(docs.select("doc_id", fold_is("doc_id", 5, 0).alias("held_out"), "text"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
