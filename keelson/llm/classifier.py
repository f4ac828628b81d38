"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

``features`` turns whole texts into a vector of statistics (DataFrame functions). Fitting standardises it over the
training rows, maps it to DIM random cosine features of a Gaussian kernel, sums the normal equations per partition and
fold and solves them with a ridge. For calibration each training row gets its raw score from the equations without its own
fold of FOLDS; these scores, in BINS equal bins, are made monotone by pooling adjacent violators. All folds together
give the final weights.

The labels of at most MAX_TRAIN documents, the lowest by a hash of doc_id, are used for fitting; every document is
scored. Only the text is an input of a score. Null text is empty; labels that are null, or whose document is missing, are
left out, and rows that share a labelled doc_id all count; without training rows every score is 0.5. Repeated rows are
scored each, very long texts whole, an empty table gives an empty one, and clashing columns named score or predicted are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules as rules
from .tables import Work
from .text import table, words

DIM, RIDGE, BINS, SEED = 192, 1e-3, 512, 7
MAX_TRAIN, FOLDS = 200_000, 3
CLIP = 6.0


def features(docs: DataFrame) -> DataFrame:
    """Adds x, the vector of statistics, and drops text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    keep = [c for c in docs.columns if c != "text"]
    d = rules.text_statistics(docs.select(F.struct(*keep).alias("_row"), t.alias("text")))
    w = words(F.col("text"))
    n = F.col("n_words") + 1.0
    chars = F.length("text").cast("bigint")
    more = {
        "_distinct": F.size(F.array_distinct(w)) / n,
        "_length": F.log(n),
        "_digits": (chars - F.length(F.translate("text", "0123456789", ""))) / (F.col("word_chars") + 20.0),
        "_stops": F.log1p(10.0 * (chars - F.length(F.translate("text", ".,;:?", ""))) / n),
        "_line": F.log1p(F.col("n_lines") / n),
    }
    cols = rules.vector() | more
    return d.select("_row.*", F.array(*[c.cast("double") for c in cols.values()]).alias("x"))


@dataclass
class Model:
    """Sizes are fixed by DIM, BINS and the number of statistics, whatever the input."""

    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.sqrt(2.0 / DIM) * np.cos(z @ self.freq + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def pool_adjacent(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic means of ordered bins."""
    blocks: list[list[float]] = []
    for s, n in zip(sums, counts, strict=True):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.repeat([s / n for s, n, _ in blocks], [int(k) for _, _, k in blocks])


def _stack(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), dtype=float).reshape(len(x), -1)


def fit(train: DataFrame) -> Model | None:
    """train: x, y (0 or 1) and fold (0 to FOLDS - 1). Read three times."""
    p = len((train.select("x").first() or [[]])[0])
    if not p:
        return None
    m = train.agg(*[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(p)], *[F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(p)]).first()
    rng = np.random.default_rng(SEED)
    mean, scale = np.array([m[f"m{i}"] for i in range(p)]), np.array([max(m[f"s{i}"] or 0.0, 1e-6) for i in range(p)])
    model = Model(mean, scale, rng.normal(size=(p, DIM)) / np.sqrt(p), rng.uniform(0, 2 * np.pi, DIM), np.zeros(DIM + 1), np.zeros(1), np.zeros(1))

    def normal(batches):
        a = np.zeros((FOLDS, DIM + 1, DIM + 2))
        for b in batches:
            z, y, fold = model.lift(_stack(b["x"])), b["y"].to_numpy(float), b["fold"].to_numpy()
            for f in range(FOLDS):
                own = z[fold == f]
                a[f, :, :-1] += own.T @ own
                a[f, :, -1] += own.T @ y[fold == f]
        yield pd.DataFrame({"i": np.tile(range(DIM + 1), FOLDS), "fold": np.repeat(range(FOLDS), DIM + 1), "a": list(a.reshape(-1, DIM + 2))})

    def total(b):
        return pd.DataFrame({"i": b["i"][:1], "fold": b["fold"][:1], "a": [np.sum(_stack(b["a"]), axis=0)]})

    kind = "i int, fold int, a array<double>"
    rows = train.select("x", "y", "fold").mapInPandas(normal, kind).groupBy("i", "fold").applyInPandas(total, kind).collect()
    a = np.array([r.a for r in sorted(rows, key=lambda r: (r.fold, r.i))]).reshape(FOLDS, DIM + 1, DIM + 2)

    def solved(a: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a[:, :-1] + RIDGE * max(a[-1, -2], 1.0) * np.eye(DIM + 1), a[:, -1])

    model.weights = solved(a.sum(axis=0))
    without = np.array([solved(a.sum(axis=0) - a[f]) for f in range(FOLDS)])

    def bins(batches):
        for b in batches:
            raw = (model.lift(_stack(b["x"])) * without[b["fold"].to_numpy()]).sum(axis=1)
            yield pd.DataFrame({"k": np.clip(((raw + 0.5) / 2.0 * BINS).astype(int), 0, BINS - 1), "raw": raw, "y": b["y"].astype(float)})

    binned = train.select("x", "y", "fold").mapInPandas(bins, "k int, raw double, y double").groupBy("k").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.avg("raw").alias("raw")).orderBy("k").collect()
    model.knots = np.array([r.raw for r in binned])
    model.values = pool_adjacent(np.array([r.y for r in binned]), np.array([r.n for r in binned]))
    return model


def score(feats: DataFrame, model: Model | None) -> DataFrame:
    """Adds score and predicted, drops x."""
    keep = [c for c in feats.columns if c not in ("x", "score", "predicted")]
    if model is None:
        s = F.lit(0.5)
    else:
        held = feats.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def of(x: pd.Series) -> pd.Series:
            return pd.Series(held.value.score(_stack(x)))

        s = of("x")
    return feats.withColumn("score", s).select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id: str = "doc_id"):
    """Fold 1 of 3 by the checksum of the id's digits."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text and more) with score and predicted instead of text; labels: doc_id, quality."""
    work = Work(docs.sparkSession, "classifier")
    feats = work.save(features(docs), "features")
    usable = labels.filter(F.col("quality").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("y"))
    usable = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(MAX_TRAIN)
    fold = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    train = work.save(feats.select("doc_id", "x").join(usable, "doc_id").select("x", "y", fold), "train")
    return score(feats, fit(train))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
