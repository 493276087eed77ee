"""Quality classifier: Bradley-Terry ranking of documents from preference pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.common import row_index
from ..session import materialize
from .common import PrefixHash, as_bytes, chunks, numbered, word_bounds

FEATURES = ("symbols", "bangs", "bars", "capitals", "digits", "markup", "repeat_1", "repeat_2", "repeat_3", "long_words",
            "log_words", "line_rate", "empty")
CUT = 0.3  # the score from which a document is predicted good


def _class_of() -> np.ndarray:
    c = np.zeros(256, np.uint8)
    for k, chars in enumerate((b"#$%&*~^@=_", b"!", b"|", bytes(range(65, 91)), b"0123456789", b"<>{}[]\\/", b"\n"), 1):
        c[list(chars)] = k
    c[97:123] = 8
    c[128:192] = 9  # second and later bytes of a character
    return c


CLASSES = _class_of()


def text_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text: rates over characters or words, 0 for empty texts."""
    n = len(off) - 1
    kind = CLASSES[data]
    count = np.zeros((10, n))
    for k in range(1, 10):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == k, out=total[1:])
        count[k] = total[off[1:]] - total[off[:-1]]
    chars = np.maximum(np.diff(off) - count[9], 1)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    s, e, row = word_bounds(~space, off)
    words = np.bincount(row, minlength=n).astype(float)
    h = PrefixHash(data).of(s, e)
    again = []
    for lag in (1, 2, 3):
        same = (h[lag:] == h[:-lag]) & (row[lag:] == row[:-lag]) if len(h) > lag else np.zeros(0, bool)
        again.append(np.bincount(row[lag:][same], minlength=n) / np.maximum(words, 1) if len(h) > lag else np.zeros(n))
    long_words = np.bincount(row[(e - s) > 20], minlength=n) / np.maximum(words, 1)
    out = [count[1] / chars, count[2] / chars, count[3] / chars, count[4] / np.maximum(count[4] + count[8], 1), count[5] / chars,
           count[6] / chars, *again, long_words, np.log1p(words) / 10, count[7] / np.maximum(words, 1), (words == 0) * 1.0]
    return np.sqrt(np.stack(out, axis=1))


def with_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and the array ``__features`` of every row's whole text (null counts as empty)."""
    names = list(keep)
    at = names.index(text) if text in names else len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = as_bytes(b.column(at))
            for i, j in chunks(off):
                f = text_features(data[off[i]:off[j]], off[i:j + 1] - off[i])
                rows = pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), f.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(len(names))), rows], [*names, "__features"])

    picked = docs.select(*names) if text in names else docs.select(*names, text)
    schema = T.StructType([*picked.schema.fields[:len(names)], T.StructField("__features", T.ArrayType(T.DoubleType()))])
    return picked.mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    threshold: float

    def score(self, features: str = "__features") -> Column:
        """Score in (0, 1); CUT stands for the chosen quantile of the ranking."""
        raw = sum((F.get(features, F.lit(k)) * F.lit(w) for k, w in enumerate(self.weights)), F.lit(0.0))
        return 1 / (1 + F.exp(-(raw - F.lit(self.threshold) + F.lit(math.log(CUT / (1 - CUT))))))


DIRECT = 1_000_000  # scores whose quantiles are interpolated in one map; of more, order statistics of a sketch over all rows


def fit(labelled: DataFrame, label: str = "quality", key: str = "doc_id", pairs_per_row: int = 8) -> Model:
    """Learn scores from preferences: each document of the more frequent label is paired with ``pairs_per_row`` of the other.

    ``labelled`` has ``__features``, ``key`` and ``label``; rows with a null are left out, all others are used.  Rows of
    either label are numbered in the order of a hash of their key, and pairs meet in a join on these numbers.  The logistic
    loss on feature differences is minimised by Spark's logistic regression without intercept.  The threshold is the score
    quantile, among 400 levels, with the fewest wrong labels of all rows; between levels that are equally good the middle is
    taken.  Without both labels all weights are 0 and every document gets CUT.
    """
    rows = labelled.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).alias("y"), "__features")
    rows = materialize(rows.withColumn("__h", F.xxhash64(key)), "labelled")
    by_label = dict(rows.groupBy("y").count().collect())
    good, bad = by_label.get(1, 0), by_label.get(0, 0)
    if not good or not bad:
        return Model((0.0,) * len(FEATURES), 0.0)
    few, many, n_few = (0, 1, bad) if bad < good else (1, 0, good)
    left, right = (row_index(rows.where(F.col("y") == y), ["__h", key, "__features"], "i", small=50_000) for y in (many, few))
    left = left.select(F.col("__features").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(pairs_per_row - 1))).alias("s"), "i")
    left = left.withColumn("j", F.pmod(F.col("i") * pairs_per_row + F.col("s") * 7919, F.lit(n_few)))
    right = right.select(F.col("__features").alias("g"), F.col("i").alias("j"))
    better, worse = ("f", "g") if many == 1 else ("g", "f")
    sign = F.when(F.pmod(F.col("i") + F.col("s"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    pairs = left.join(right, "j").withColumn("sign", sign).select(
        F.expr(f"zip_with({better}, {worse}, (a, b) -> (a - b) * sign)").alias("d"), F.expr("double(sign > 0)").alias("label"))
    pairs = materialize(pairs.select(array_to_vector("d").alias("features"), "label"), "pairs")
    lr = LogisticRegression(fitIntercept=False, regParam=1e-3, maxIter=60, standardization=True)
    w = tuple(float(x) for x in lr.fit(pairs).coefficients)
    scored = rows.select("y", sum((F.get("__features", F.lit(k)) * F.lit(x) for k, x in enumerate(w)), F.lit(0.0)).alias("r"))
    levels = F.lit([k / 400 for k in range(401)])
    cuts = F.percentile("r", levels) if good + bad <= DIRECT else F.percentile_approx("r", levels, 100_000)
    cuts = sorted(set(scored.agg(cuts).first()[0]))
    side = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="r", outputCol="k").transform(scored)  # cuts not above r
    seen = {(r["y"], int(r["k"])): r["n"] for r in side.groupBy("y", "k").agg(F.count("*").alias("n")).collect()}
    wrong, errors = bad, []  # cut k rejects the rows below it
    for k in range(len(cuts)):
        wrong += seen.get((1, k), 0) - seen.get((0, k), 0)
        errors.append(wrong)
    best = [k for k, x in enumerate(errors) if x == min(errors)]
    k = best[len(best) // 2]
    below = cuts[k - 1] if k else cuts[k]
    return Model(w, (cuts[k] + below) / 2)


def held_out(key: str = "doc_id") -> Column:
    """One fold of five by CRC-32 of the key as text; rows without a key are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Labels of held-out documents, null labels and labels without a document are not used.  Repeated documents are
    scored each; a repeated label counts once when it agrees.  Null and empty texts have the features of an empty text.
    Other columns of ``docs`` play no part.
    """
    scored, model = _scored(docs.select("doc_id", "text"), labels, ["doc_id"])
    out = scored.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def _scored(docs: DataFrame, labels: DataFrame, keep: list[str]) -> tuple[DataFrame, Model]:
    feats = materialize(with_features(docs, keep), "features")
    used = labels.select("doc_id", "quality").where(~held_out()).distinct()
    return feats, fit(feats.select("doc_id", "__features").join(used, "doc_id"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their columns, whatever their names; each is scored where it lies."""
    _, model = _scored(docs.select("doc_id", "text"), labels, ["doc_id"])
    rows = numbered(docs, "doc_id", "text")
    return with_features(rows, rows.columns).where(model.score() >= CUT).drop("__features").toDF(*docs.columns)
