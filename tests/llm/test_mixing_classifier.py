import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import classifier, mixing

DATA = "/root/testdata/sf0.01"


def test_apportion_gives_highest_quotients():
    rnd = random.Random(4)
    for _ in range(200):
        votes = [rnd.choice([0, 1, 5, 5, 1000, rnd.random() * 50]) for _ in range(rnd.randrange(1, 9))]
        seats = rnd.randrange(60)
        want = [0] * len(votes)
        heap = [(-v, i) for i, v in enumerate(votes) if v > 0]
        heapq.heapify(heap)
        for _ in range(seats if heap else 0):
            _, i = heap[0]
            want[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * want[i] + 1), i))
        assert mixing.apportion(votes, seats) == want


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([0, 10]) == [0, 15] and mixing.targets([]) == [] and mixing.targets([0]) == [0]


def test_mix_of_documents(spark):
    rows = mixing.op9_source_mix(spark, DATA).collect()
    by = {}
    src = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source").collect()}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        x = by.setdefault(src[r.doc_id], [0, 0, r.source_size, r.target])
        x[0] += r.size
        x[1] += r.taken
    for size, taken, source_size, target in by.values():
        assert size == source_size and abs(taken - target) <= 3 * mixing.BLOCK
    assert sum(x[3] for x in by.values()) == pytest.approx(1.5 * sum(x[0] for x in by.values()))
    assert sorted(rows) == sorted(mixing.op9_source_mix(spark, DATA).collect())


def test_mixed_texts_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(n)) if n else None, s, "x") for i, (n, s) in enumerate([(500, "a"), (0, "a"), (90, None), (90, None), (7, ""), (1000, "b"), (3, "b")])]
    df = spark.createDataFrame([*rows, rows[2]], "doc_id bigint, text string, source string, size string")
    df = df.withColumns({c: F.lit("z") for c in ("name", "row", "k", "h", "shard", "words", "cut", "copy", "_source")})
    taken, got = {}, {}
    for r in mixing.mix(df).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    for r in mixing.mixed_documents(df).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert r["size"] == "x"
    assert got == {k: v for k, v in taken.items() if v}
    assert mixing.mix(df.limit(0)).count() == 0


def brute_taken(rows):
    """taken of (doc_id, text, source, hash) rows, word by word."""
    size = {k: len(mixing.WORD.findall(r[1] or "")) for k, r in enumerate(rows)}
    names = sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    goals = mixing.targets([sum(size[k] for k, r in enumerate(rows) if r[2] == s) for s in names])
    quotas, out = mixing.apportion(goals, round(sum(goals) / mixing.BLOCK)), {}
    for k, s in enumerate(names):
        own = sorted((r[3], r[0] or -1, size[i], i) for i, r in enumerate(rows) if r[2] == s)
        n = -(-len(own) // mixing.SHARD_DOCS)
        streams = [[(i, z) for h, _, z, i in own if (h >> 20) % n == x] for x in range(n)]
        full = [x for x in range(n) if streams[x]]
        for x, q in zip(full, mixing.apportion([sum(z for _, z in streams[x]) for x in full], quotas[k]), strict=True):
            words = [i for i, z in streams[x] for _ in range(z)]
            passes, chosen, blocks, step, shift = mixing.plan_shard(len(words), q, mixing.SEED + k + x)
            for i, z in streams[x]:
                out[i] = passes * z
            for at, i in enumerate(words):
                out[i] += (at // mixing.BLOCK * step + shift) % blocks < chosen
    return [out[k] for k in range(len(rows))]


def test_taken_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 9)
    rnd = random.Random(3)
    rows = [(rnd.choice([i, i, i, None, 7]), rnd.choice([None, "", "a\tb"] + [" ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randrange(300)))] * 9), rnd.choice(["a", "a", "a", "b", "ä", "", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    hashed = [tuple(r) for r in df.withColumn("h", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text")).collect()]
    want = sorted(((r[0], len(mixing.WORD.findall(r[1] or "")), n) for r, n in zip(hashed, brute_taken(hashed), strict=True)), key=str)
    got = sorted(((r.doc_id, r["size"], r.taken) for r in mixing.mix(df).collect()), key=str)
    assert got == want and sum(x[2] for x in got) > 0


def test_classifier_on_held_out_rows(spark):
    got = classifier.op10_quality_classifier(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = got.filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (3, "x " * 5000, 0.3), (3, "x " * 5000, 0.3), (None, "a b", 0.4)], "doc_id bigint, text string, score double")
    none = spark.createDataFrame([(1, None), (9, 1)], "doc_id bigint, quality int")
    assert [r.score for r in classifier.classify(docs, none).collect()] == [0.5] * 5
    some = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)], "doc_id bigint, quality int")
    assert classifier.classify(docs, some).count() == 5 and classifier.classify(docs.limit(0), some).count() == 0


def test_fit_against_plain_numpy(spark):
    """Weights by least squares over all rows, and calibration scores by models without the row's fold."""
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(300, 4))
    y = (x[:, 0] + 0.5 * rnd.normal(size=300) > 0).astype(int)
    fold = rnd.integers(0, classifier.FOLDS, 300)
    rows = [(list(map(float, a)), int(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)]
    m = classifier.fit(spark.createDataFrame(rows, "x array<double>, y int, fold int"))
    z = m.lift(x)

    def ridge(z, y):
        n = np.sqrt(classifier.RIDGE * len(z))
        return np.linalg.lstsq(np.vstack([z, n * np.eye(z.shape[1])]), np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]

    assert np.allclose(m.weights, ridge(z, y), atol=1e-6)
    raw = np.array([z[i] @ ridge(z[fold != f], y[fold != f]) for i, f in enumerate(fold)])
    bins = np.clip(((raw + 0.5) / 2 * classifier.BINS).astype(int), 0, classifier.BINS - 1)
    assert np.allclose(m.knots, [raw[bins == k].mean() for k in np.unique(bins)], atol=1e-6)
    assert np.allclose(m.values, classifier.pool_adjacent(np.array([y[bins == k].sum() for k in np.unique(bins)]), np.array([(bins == k).sum() for k in np.unique(bins)])))
    scores = m.score(x)
    assert np.all(np.diff(scores[np.argsort(m.raw(x))]) >= 0) and 0.7 < np.mean((scores >= 0.5) == y)


def test_pool_adjacent():
    out = classifier.pool_adjacent(np.array([0.0, 2, 1, 3, 3]), np.array([3.0, 3, 3, 3, 3]))
    assert np.all(np.diff(out) >= 0) and np.allclose(out, [0, 0.5, 0.5, 1, 1])
