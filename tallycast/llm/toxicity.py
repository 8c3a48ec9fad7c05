"""Toxicity of documents: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, functions as F

from tallycast.llm.bitmap import bitmap, marked
from tallycast.llm.graph import written
from tallycast.llm.language_id import held_out
from tallycast.llm.text import _STEPS, as_bytes, chunks, lists, map_arrow, mix

GRAMS = (3, 4, 5, 6)
BINS = 1 << 20
FEATURES = 1 << 12
SMOOTHING = 1.0
MAX_LABELLED = 20_000
CHUNK = 1 << 18  # bytes of text that a task takes apart at a time
PENALTY, ITERATIONS = 1e-3, 60
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def gram_bins(held: list[tuple], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bin and value of every distinct character n-gram of many texts ``(key, bytes)``, by text.

    Characters are bytes; A-Z are lower-cased, line ends are spaces and every text has a space before and after it, so that n-grams see the ends of
    words. The value is the root of the n-gram's occurrences per thousand characters. ``chosen`` maps bins to features, or to -1 for bins that do not matter.
    """
    data = _LOWER[np.frombuffer(b" " + b"  ".join(text for _, text in held) + b" ", dtype=np.uint8)].astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(text) + 2 for _, text in held])
    owner = np.repeat(np.arange(len(held)), sizes)
    found = []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(data) < n:
                continue
            sums = sum(data[i : len(data) - n + 1 + i] * _STEPS[i + n] for i in range(n))
            bins = (mix(sums + np.uint64(n)) % np.uint64(BINS)).astype(np.int64)
            at = np.flatnonzero(owner[: len(bins)] == owner[n - 1 :])
            bins = bins[at]
            if chosen is not None:
                bins = chosen[bins]
                at, bins = at[bins >= 0], bins[bins >= 0]
            found.append(owner[at] * BINS + bins)
    both, counts = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.int64), return_counts=True)
    texts = both // BINS
    return texts, both % BINS, np.sqrt(1000 * counts / sizes[texts])


@dataclass
class ToxicityModel:
    """The feature of each bin or -1, the weight of each feature with its ratio multiplied in, and the offset; one share without labels."""

    chosen: np.ndarray | None
    weights: np.ndarray
    offset: float
    share: float

    def scores(self, held: list[tuple]) -> np.ndarray:
        texts, features, values = gram_bins(held, self.chosen)
        margin = np.bincount(texts, weights=self.weights[features] * values, minlength=len(held)) + self.offset
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def log_count_ratios(sums: np.ndarray, documents: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The naive Bayes log ratio of each feature, toxic to clean, and how many standard errors of its presence lie between the classes.

    Rows are the classes clean and toxic: ``sums`` of the values of a feature, ``documents`` with it, ``sizes`` of the classes.
    """
    shares = np.log((sums + SMOOTHING) / (sizes[:, None] + 2 * SMOOTHING))
    present = (documents + SMOOTHING) / (sizes[:, None] + 2 * SMOOTHING)
    error = np.sqrt((present * (1 - present) / (sizes[:, None] + 2 * SMOOTHING)).sum(axis=0))
    return shares[1] - shares[0], (present[1] - present[0]) / error


def _class_sums(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per class and bin the sum of values and the number of documents. Tasks hand over the bins they met, summed by Spark."""

    def counted(rows):
        sums, documents = np.zeros((2, BINS)), np.zeros((2, BINS), dtype=np.int64)
        for held in chunks(((label, text or b"") for label, text in rows), CHUNK):
            texts, bins, values = gram_bins(held)
            labels = np.array([label for label, _ in held], dtype=np.int64)[texts]
            sums += np.bincount(labels * BINS + bins, weights=values, minlength=2 * BINS).reshape(2, BINS)
            documents += np.bincount(labels * BINS + bins, minlength=2 * BINS).reshape(2, BINS)
        some = np.flatnonzero(documents.any(axis=0))
        yield [some, sums[0, some], sums[1, some], documents[0, some], documents[1, some]]

    names = ("clean", "toxic", "n_clean", "n_toxic")
    parts = map_arrow(labelled.select("label", "text"), counted, "bin long, clean double, toxic double, n_clean long, n_toxic long")
    table = parts.groupBy("bin").agg(*[F.sum(name).alias(name) for name in names]).toArrow()
    out = np.zeros((4, BINS))
    out[:, table.column("bin").to_numpy()] = [table.column(name).to_numpy() for name in names]
    return out[:2], out[2:]


def train_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Fit on the whole texts of at most 20,000 labelled documents outside the held-out fifth, drawn by a hash of the id.

    The sums of an n-gram's values in the documents of each class give its log-count ratio. The 4096 bins whose presence differs
    most between the classes, by its standard error, become features: the value times the ratio. Logistic regression weighs them. An id with
    several labels counts as the majority, toxic at a tie, and of rows that share an id the one of the least text hash is used. Null labels and ids teach nothing. With labels of
    one class or none every score is the share of toxic labels, 0 without labels.
    """
    one_each = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        (F.avg(F.col("toxic").cast("double")) >= 0.5).cast("int").alias("label")).where(~held_out("id"))
    one_each = written(one_each, "labels")
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), as_bytes("text").alias("text"))
    total = one_each.count()
    place = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    picked = written(one_each.where(place < max_labelled / max(total, 1)), "picked")
    few = marked(known, written(bitmap(picked, "id", 22), "bitmap"), "id", 22).where("marked").join(picked, "id")
    few = few.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    labelled = written(few.select("id", "label", F.coalesce("text", F.lit(b"")).alias("text")), "labelled")
    n, n_toxic = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n_toxic in (0, n):
        return ToxicityModel(None, np.zeros(0), 0.0, n_toxic / n if n else 0.0)
    sums, documents = _class_sums(labelled)
    ratio, distance = log_count_ratios(sums, documents, np.array([n - n_toxic, n_toxic], dtype=float))
    distance[documents.sum(axis=0) == 0] = 0
    best = np.argsort(-np.abs(distance), kind="stable")[:FEATURES]
    best = best[np.abs(distance[best]) > 0]
    chosen = np.full(BINS, -1, dtype=np.int32)
    chosen[best] = np.arange(len(best))

    def featured(rows):
        for held in chunks(((label, text) for label, text in rows), CHUNK):
            texts, features, values = gram_bins(held, chosen)
            n_features = np.bincount(texts, minlength=len(held))
            yield [pa.array([float(label) for label, _ in held]), lists(features.astype(np.int32), n_features), lists(values * scale[features], n_features)]

    scale = ratio[best]
    rows = written(map_arrow(labelled.select("label", "text"), featured, "label double, at array<int>, value array<double>"), "features")
    sparse = F.udf(lambda at, value: Vectors.sparse(len(scale), at, value), VectorUDT())  # of the bounded sample alone
    fit = LogisticRegression(maxIter=ITERATIONS, regParam=PENALTY, standardization=False).fit(rows.select("label", sparse("at", "value").alias("features")))
    return ToxicityModel(chosen, fit.coefficients.toArray() * ratio[best], float(fit.intercept), n_toxic / n)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``[doc_id, held_out, score, predicted]`` for every row; the score is a probability of being toxic.

    Null and empty texts have no n-gram but their two spaces and get a score too. Repeated and null ids keep their rows, ties have equal scores, texts are
    read whole, other columns are ignored and an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def scored(rows):
        for held in chunks(((key, text or b"") for key, text in rows), CHUNK):
            own = shared.value
            yield [pa.array([key for key, _ in held], pa.int64()), np.full(len(held), own.share) if own.chosen is None else own.scores(held)]

    out = map_arrow(docs.select(F.col("doc_id").cast("long").alias("id"), as_bytes("text").alias("text")), scored, "id long, score double")
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
