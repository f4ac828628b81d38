import random
import re

import numpy as np

from keelson.llm import quality_rules as q

SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)]


def corpus():
    rnd = random.Random(1)
    vocab = ["lorem", "ipsum", "é", "dolor.", "sit", "ämet,", "on", "to", "🚀🚀"]
    texts = ["", None, "one", " \t\n", "a\n\na\r\na", "x " * 40, "a b c d e f a b c d e", "\x0b#*\x0c<>", "a b c d e a b c d e a b c d e"]
    texts += [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(3, 90))) + rnd.choice(["", "\nx\nx", " # # |"]) for _ in range(60)]
    texts += [" ".join(f"w{i % 700}" for i in range(30000))]
    return texts


def test_counts_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, None, "s", "clash") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: [r[c] for c in q.BASE] for r in q.judge(df, ["doc_id"]).collect()}
    for i, t in enumerate(texts[:-1]):
        assert got[i] == brute(t), t
    assert got[len(texts) - 1] == [30000, sum(len(f"w{i % 700}") for i in range(30000)), 0, 0, 30000]


def test_planted_outliers_go_and_clean_rows_stay(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(12, 200))]
        junk = i % 5 == 0
        rows.append((i, " ".join(w + "###" * junk for w in words), rnd.choice(["en", None]), rnd.choice(["a", "b"]) if i < 390 else f"rare{i}", None))
    got = q.judge(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()
    assert len(got) == 400 and all(r.kept == (r.doc_id % 5 != 0) for r in got if r.doc_id < 390)


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "w " * 3, "en", "a", None), (2, " ".join(f"w{i}" for i in range(20)), "en", "a", None)] * 2, SCHEMA)
    assert sorted((r.doc_id, r.base_failed, r.kept) for r in q.judge(df, ["doc_id"]).collect()) == [(1, True, False)] * 2 + [(2, False, True)] * 2
    assert q.judge(df.limit(0), ["doc_id"]).count() == 0


def lower(fit):
    inv = np.zeros((len(q.NAMES),) * 2)
    for (i, j), x in zip(q.CELLS, fit["_l"], strict=True):
        inv[i, j] = x
    return inv


def test_factors_in_columns(spark):
    a = np.random.default_rng(0).normal(size=(7, 7))
    cov = a @ a.T + np.eye(7)
    row = {"grp": "g", "start": 0} | {f"m{i}": float(i) for i in range(7)} | {f"c{i}_{j}": float(cov[i, j]) for i, j in q.CELLS}
    fit = q.factored(spark.createDataFrame([row])).first()
    floored = cov + np.diag([x * x for x in q.FLOORS.values()])
    inv = lower(fit)
    assert np.allclose(inv.T @ inv, np.linalg.inv(floored)) and np.isclose(fit.det, np.linalg.slogdet(floored)[1]) and fit["_c"] == list(range(7))


def test_chi_squared():
    assert abs(q.chi_squared_beyond(14.067, 7) - 0.05) < 1e-4 and abs(q.chi_squared_quantile(0.975, 7) - 16.013) < 1e-2
    assert 1.2 < q.consistency(0.75, 7) < 1.45 and 44 < q.CUTOFF < 47


def brute_mcd(x):
    """Converged concentration steps from many random starts, corrected and reweighted, with the same floors."""
    p, floor = x.shape[1], np.diag([f * f for f in q.FLOORS.values()])
    rnd = np.random.default_rng(1)
    h, best = int(np.ceil(q.SUPPORT * len(x))), None
    dist = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    for _ in range(60):
        some = x[rnd.choice(len(x), 30, replace=False)]
        m, c = some.mean(0), np.cov(some.T) + floor
        for _ in range(30):
            inside = x[np.argsort(dist(m, c))[:h]]
            m, c = inside.mean(0), np.cov(inside.T) + floor
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = det, m, c
    inside = x[dist(*best[1:]) <= q.consistency(q.SUPPORT, p) * q.chi_squared_quantile(q.REWEIGHT, p)]
    return dist(inside.mean(0), q.consistency(q.REWEIGHT, p) * np.cov(inside.T) + floor)


def test_distances_match_brute_force(spark):
    """Verdicts of the query's own groups against many-start estimates in numpy."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    stats = q.text_statistics(docs).select("doc_id", "lang", "source", *q.COUNTS)
    rows = stats.select("doc_id", "lang", "source", *[c.alias(n) for n, c in q.vector().items()]).toPandas()
    got = {r.doc_id: r for r in q.judge(docs, ["doc_id"]).collect()}
    groups = [g for _, g in rows.groupby(["lang", "source"]) if len(g) >= q.MIN_GROUP]
    far = bad = n = 0
    for g in sorted(groups, key=len)[-6:]:
        want = brute_mcd(g[q.NAMES].to_numpy())
        have = np.array([got[i].distance for i in g.doc_id])
        bad += ((want > q.CUTOFF) != (have > q.CUTOFF)).sum()
        far += (want > q.CUTOFF).sum()
        n += len(g)
        bulk = want < np.quantile(want, 0.7)
        assert np.corrcoef(np.log(want[bulk] + 1), np.log(have[bulk] + 1))[0, 1] > 0.9
    assert far and bad <= 0.01 * n


def test_many_groups_have_their_own_estimates(spark):
    """Sixty sources, half of which are written in capitals: no source is judged by another's habits."""
    rnd = random.Random(5)
    rows = []
    for s in range(60):
        for k in range(42):
            w = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(12, 40))]
            text = " ".join(w) + (" ### $$$" * len(w) if k == 0 else "")
            rows.append((s * 100 + k, text.upper() if s % 2 else text, "en", f"s{s}", None))
    got = q.judge(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()
    assert all(r.kept == (r.doc_id % 100 != 0) for r in got)
