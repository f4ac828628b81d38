import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from keelson.llm import ngram_lm as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


def toks(t):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] + ["</>"]


def katz(counts):
    """Good-Turing discounts up to a count of 5, from the counts themselves."""
    n = Counter(counts.values())
    d = {r: 1.0 for r in counts.values()}
    for r in [r for r in d if r <= 5]:
        d[r] = (r - 0.5) / r
        if all(n[x] for x in range(1, 7)):
            top = 6 * n[6] / n[1]
            found = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if top < 1 else 0
            d[r] = found if 0 < found < 1 else d[r]
    return d


class Brute:
    """The same model by dictionaries, from texts alone."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            w = toks(t)
            self.uni.update(w)
            self.bi.update(zip(w, w[1:], strict=False))
        self.n = sum(self.uni.values())
        d1, d2 = katz(self.uni), katz(self.bi)
        self.one = {w: d1[c] * c / self.n for w, c in self.uni.items()}
        self.unknown = 1 - sum(self.one.values())
        followers = {}
        for (h, w), c in self.bi.items():
            followers.setdefault(h, {})[w] = c
        self.next, self.backoff, self.held = {}, {}, 0
        for h, seen in followers.items():
            whole = sum(seen.values())
            free = all(d2[c] == 1 for c in seen.values())
            self.held += free
            self.next[h] = {w: d2[c] * c / (whole + free) for w, c in seen.items()}
            self.backoff[h] = (1 - sum(self.next[h].values())) / (1 - sum(self.p(w) for w in seen))

    def p(self, w, h=None):
        if h is None:
            return self.one.get(w, self.unknown)
        seen = self.next.get(h, {})
        return seen[w] if w in seen else self.backoff.get(h, 1.0) * self.p(w)


@pytest.fixture(scope="module")
def case(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    return rows, held, Brute([r.text for r in rows if not held[r.doc_id]])


@pytest.mark.parametrize("fan", [12, 2])
def test_scores_match_dictionaries(spark, case, monkeypatch, fan):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 2000)
    monkeypatch.setattr(lm, "FAN_BITS", fan)
    rows, held, b = case
    got = {r.doc_id: r for r in lm.op4_katz_lm(spark, DATA).collect()}
    assert len(got) == len(rows) and b.held
    ours = base = 0
    for r in rows:
        g, w = got[r.doc_id], toks(r.text)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], len(w), sum(b.uni[x] > 0 for x in w), b.n)
        assert g.base_score == pytest.approx(sum(math.log10((b.uni[x] + 1) / (b.n + len(b.uni) + 1)) for x in w))
        assert g.score == pytest.approx(math.log10(b.p(w[0])) + sum(math.log10(b.p(x, h)) for h, x in zip(w, w[1:], strict=False)))
        if g.held_out:
            ours, base = ours + g.score, base + g.base_score
    assert ours > base


def test_distributions_sum_to_one(case):
    b = case[2]
    words = [*b.uni, "never seen"]
    assert sum(b.p(w) for w in words) == pytest.approx(1)
    for h in sorted(b.next, key=lambda h: -b.uni[h])[:5]:
        assert b.backoff[h] > 0 and sum(b.p(w, h) for w in words) == pytest.approx(1)


def test_messages_grow_with_chunks(spark, monkeypatch):
    for n in (1, 16, 17, 4096, 4097, 100_000, 2**24, 2**24 + 1):
        levels = lm.plan_levels(n)
        assert max(x.bits for x in levels) <= lm.FAN_BITS and levels[-1].groups == 1 and len(levels) == 1 + (n > 4096) + (n > 2**24)
        nodes = [x.groups << (x.before + x.bits) for x in levels]
        assert all(k <= max(16, 2 * n) for k in nodes[:-1]) and nodes[-1] <= max(16, 2 * n)
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 2000)
    monkeypatch.setattr(lm, "FAN_BITS", 2)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", lm.training_row().alias("train"))
    chunks = lm.make_chunks(docs).cache()
    n = chunks.count()
    levels = lm.plan_levels(n)
    sent = lm.send_counts(chunks, levels[0])
    assert n > 16 and len(levels) > 2 and sent.count() == 2 * 4 * n
    assert sent.select("node").distinct().count() <= levels[0].groups * 4 <= n + 4


def test_codes():
    rng = np.random.default_rng(1)
    for a in (np.zeros(0, np.uint64), np.array([0], np.uint64), rng.integers(0, 2**64, 999, dtype=np.uint64), rng.integers(0, 300, 50).astype(np.uint64)):
        assert (lm.unpack(lm.pack(a)) == a).all() and (lm.unsqueeze(lm.squeeze(a)) == a).all() and (lm.unpack_sorted(lm.pack_sorted(np.sort(a))) == np.sort(a)).all()


def test_edges(spark):
    rows = [(1, None, True), (None, "", True), (3, "A a\x0bB " * 3000, True), (3, "q", False), (3, "q", False)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, train boolean, score double")
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in lm.score(df).collect())
    assert got == [("1", 1, 1), ("3", 2, 1), ("3", 2, 1), ("3", 9001, 9001), ("None", 1, 1)]
    none = lm.score(df.filter("not train")).collect()
    assert [(r.n_known, r.train_tokens, r.score) for r in none] == [(0, 0, 0.0)] * 2
    assert lm.score(df.limit(0)).count() == 0
