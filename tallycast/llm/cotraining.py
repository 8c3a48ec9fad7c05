"""Document quality by co-training a text view and a metadata view."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tallycast.llm.bitmap import bitmap, marked
from tallycast.llm.graph import written
from tallycast.llm.language_id import held_out
from tallycast.llm.text import as_bytes, chunks, words

WORD_BINS, NAME_BINS = 256, 64
MAX_LABELLED = 20_000
ROUNDS, EXCHANGED, CONFIDENT = 3, 400, 0.9
PENALTY, ITERATIONS = 0.001, 30
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARK = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def text_features(texts: list[bytes]) -> np.ndarray:
    """Per text: hashed word shares, and shares of capitals, digits, marks, repeated words and repeated lines, lengths."""
    n = len(texts)
    start, end, hashes, offsets = words(texts)
    out = np.zeros((n, WORD_BINS + 8))
    counts = np.diff(offsets)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    owner = np.repeat(np.arange(n), counts)
    bins = (hashes % np.uint64(WORD_BINS)).astype(np.int64) + owner * WORD_BINS
    many = np.maximum(counts, 1)
    out[:, :WORD_BINS] = np.sqrt(np.bincount(bins, minlength=n * WORD_BINS).reshape(n, WORD_BINS) / many[:, None])
    alike = np.bincount(owner[1:], weights=(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]), minlength=n)
    letters = np.bincount(owner, weights=end - start, minlength=n)
    repeated = np.zeros((n, 5))
    for i in some:
        text = texts[i]
        own = np.sort(hashes[offsets[i] : offsets[i + 1]])
        lines = text.split(b"\n")
        repeated[i] = [*((len(text) - len(text.translate(None, kind))) / len(text) for kind in (_UPPER, _DIGIT, _MARK)),
                       np.count_nonzero(own[1:] == own[:-1]) / len(own), 1 - len(set(lines)) / len(lines)]
    tail = np.column_stack([repeated[:, :4], alike / np.maximum(counts - 1, 1), repeated[:, 4], letters / many / 10, np.log1p(counts) / 10])
    out[some, WORD_BINS:] = tail[some]
    return out


@lru_cache(maxsize=1 << 16)
def _name_bin(name: bytes) -> int:
    return int(words([name])[2].sum(dtype=np.uint64) % np.uint64(NAME_BINS))


def metadata_features(source: list[str | None], lang: list[str | None], n_chars: list[int | None]) -> np.ndarray:
    """Per document: hashed source and language, and the stated length; nulls are values of their own."""
    out = np.zeros((len(source), NAME_BINS + 2))
    for i, values in enumerate(zip(source, lang)):
        for kind, value in zip("sl", values):
            for part in (kind if value is None else f"{kind} {value}").encode().split(b"\n"):
                out[i, _name_bin(part.replace(b" ", b"="))] += 1
    out[:, NAME_BINS] = [np.log1p(max(n or 0, 0)) / 10 for n in n_chars]
    out[:, NAME_BINS + 1] = [n is None for n in n_chars]
    return out


@dataclass
class QualityModel:
    """Weights, offset, and slope and shift of the calibration, per view; the log odds of the labels; one share without labels."""

    views: dict[str, tuple[np.ndarray, float, float, float]]
    prior: float
    share: float

    def logits(self, view: str, features: np.ndarray) -> np.ndarray:
        weights, offset, slope, shift = self.views[view]
        return slope * (features @ weights + offset) + shift


def _featured(docs: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` columns with the arrays ``text_view`` and ``meta_view``."""
    carried = docs.select(F.struct(*kept).alias("kept"), as_bytes("text").alias("text"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            rows = np.concatenate([text_features([t for _, t in held]) for held in chunks((None, t) for t in texts)]) if texts else np.zeros((0, 1))
            meta = metadata_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), pa.array(list(rows), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.float64()))],
                names=["kept", "text_view", "meta_view"])

    kind = carried.schema["kept"].dataType.simpleString()
    return carried.mapInArrow(run, f"kept {kind}, text_view array<double>, meta_view array<double>").select("kept.*", "text_view", "meta_view")


def _fit(rows: DataFrame, view: str, penalty: float = PENALTY):
    data = rows.select(array_to_vector(view).alias("features"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(maxIter=ITERATIONS, regParam=penalty, standardization=True).fit(data)


def _scored(model, rows: DataFrame, view: str) -> DataFrame:
    out = model.transform(rows.withColumn("features", array_to_vector(view)))
    return out.select("id", F.element_at(vector_to_array("probability"), 2).alias("p"), F.element_at(vector_to_array("rawPrediction"), 2).alias("margin"))


def _pool(known: DataFrame, labels: DataFrame, models: dict) -> DataFrame:
    """``[id, row, text_view, meta_view]``: the probability that each view gives every document without a label.

    Of rows that share an id the one of the least hash ``row`` counts. Features are not stored, only the probabilities.
    """
    weights = {view: (model.coefficients.toArray(), float(model.intercept)) for view, model in models.items()}
    carried = known.select("id", "row", as_bytes("text").alias("text"), "source", "lang", "n_chars")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            coefficients, offset = weights["text_view"]
            text = np.concatenate([text_features([t for _, t in held]) @ coefficients for held in chunks((None, t) for t in texts)]) + offset
            coefficients, offset = weights["meta_view"]
            meta = metadata_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars"))) @ coefficients + offset
            chances = [pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50)))) for z in (text, meta)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), *chances], names=["id", "row", "text_view", "meta_view"])

    scored = carried.mapInArrow(run, "id long, row long, text_view double, meta_view double")
    one_each = scored.groupBy("id").agg(F.min(F.struct("row", "text_view", "meta_view")).alias("first"))
    return one_each.join(labels, "id", "left_anti").select("id", "first.*")


def _confident(pool: DataFrame, view: str, n: int) -> DataFrame:
    """The n surest good and the n surest bad rows of a view among all of the pool, as ``[id, row, label]``."""
    good = pool.where(F.col(view) >= CONFIDENT).orderBy(F.desc(view), "id").limit(n).select("id", "row", F.lit(1.0).alias("label"))
    bad = pool.where(F.col(view) <= 1 - CONFIDENT).orderBy(view, "id").limit(n).select("id", "row", F.lit(0.0).alias("label"))
    return good.unionByName(bad)


def _lent(known: DataFrame, sure: dict) -> dict:
    """The features and labels that each view is lent by the other."""
    picked = written(sure["text_view"].unionByName(sure["meta_view"]).select("id", "row").distinct(), "picked")
    few = marked(known, written(bitmap(picked, "id", 22), "bitmap"), "id", 22).where("marked")
    few = few.join(picked, ["id", "row"], "left_semi").dropDuplicates(["id"])
    featured = written(_featured(few, ["id"]), "lent")
    return {view: featured.join(sure[other].select("id", "label"), "id").select(view, "label")
            for view, other in (("text_view", "meta_view"), ("meta_view", "text_view"))}


def train_quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> QualityModel:
    """Co-training on at most 20,000 labelled documents, drawn by a hash of the id, and all unlabelled ones.

    Both views start from the labelled documents outside the held-out fifth. In every round each view scores all unlabelled
    documents and hands its surest rows, up to 400 more of each class a round at a probability of 0.9, to the other view as labels. The held-out fifth of the
    labelled rows then calibrates each view by its margin. With labels of one class only, or none, every score is the
    share of good labels, 0.5 without labels.
    """
    one_each = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        (F.avg("quality") >= 0.5).cast("double").alias("label"))
    one_each = written(one_each, "labels")
    total, good = one_each.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not total or good in (0, total):
        return QualityModel({}, 0.0, 0.5 if not total else good / total)
    draw = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    chosen = written(one_each.where(draw(1) < MAX_LABELLED / total), "chosen")
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    known = known.withColumn("row", F.xxhash64("text", "source", "lang", "n_chars"))
    few = marked(known, written(bitmap(chosen, "id", 22), "bitmap"), "id", 22).where("marked").dropDuplicates(["id"])
    labelled = few.join(chosen, "id").withColumn("held_out", held_out("id"))
    labelled = written(_featured(labelled, ["id", "label", "held_out"]), "labelled")
    train, check = labelled.where("not held_out"), labelled.where("held_out")
    if train.select("label").distinct().count() < 2:
        return QualityModel({}, 0.0, good / total)
    views = ("text_view", "meta_view")
    lent, models = {}, {}
    for turn in range(rounds + 1):
        for view in views:
            rows = train.select(view, "label")
            if view in lent:
                rows = rows.unionByName(lent[view])
            models[view] = _fit(rows, view)
        if turn < rounds:
            pool = written(_pool(known, one_each, models), "pool")
            lent = _lent(known, {view: written(_confident(pool, view, EXCHANGED * (turn + 1)), "pseudo_labels") for view in views})
    fitted = {}
    two_classes = check.select("label").distinct().count() == 2
    for view, model in models.items():
        slope, shift = 1.0, 0.0
        if two_classes:
            margins = _scored(model, check, view).join(check.select("id", "label"), "id").select(F.array("margin").alias("margin"), "label")
            scale = _fit(margins, "margin", 0.01)
            slope, shift = float(scale.coefficients[0]), float(scale.intercept)
        fitted[view] = (model.coefficients.toArray(), float(model.intercept), slope, shift)
    share = good / total
    return QualityModel(fitted, float(np.log(share / (1 - share))), share)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``[doc_id, held_out, score, text_score, meta_score, good]`` for every document.

    The views are taken as independent given the quality: their calibrated log odds add up, less the odds of the labels
    counted twice. ``good`` is a score of at least 0.5. Null texts and metadata have features of their own; repeated and
    null ids keep their rows; other columns are ignored. Whole texts are read.
    """
    carried = docs.select(F.col("doc_id").cast("long").alias("id"), as_bytes("text").alias("text"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not model.views or not n:
                scores = [np.full(n, model.share)] * 3
            else:
                texts = [t or b"" for t in batch.column("text").to_pylist()]
                text = np.concatenate([model.logits("text_view", text_features([t for _, t in held])) for held in chunks((None, t) for t in texts)])
                meta = model.logits("meta_view", metadata_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars"))))
                scores = [1 / (1 + np.exp(-np.clip(z, -50, 50))) for z in (text + meta - model.prior, text, meta)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, scores)], names=["id", "score", "text_score", "meta_score"])

    out = carried.mapInArrow(run, "id long, score double, text_score double, meta_score double")
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "text_score", "meta_score", (F.col("score") >= 0.5).alias("good"))
