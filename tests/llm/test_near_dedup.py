import random
import re

import numpy as np
import pytest

from keelson.llm import near_dedup as nd
from keelson.llm.components import components
from keelson.llm.tables import Work

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = SPLIT.findall(low)
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        sets[i] = s
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids, index = sorted(sets), {}
    for i in ids:
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    for i in ids:
        for j in {j for s in sets[i] for j in index[s] if j > i}:
            n = len(sets[i] & sets[j])
            if 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def same(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_tables_match_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = nd.op1_near_dedup(spark, d).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


@pytest.mark.parametrize("seed", [0, 1])
def test_hot_groups_match_brute_force(spark, seed):
    """A large group of edits around the threshold, and many texts that share a passage."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for _ in range(150):
        w = list(base)
        for _ in range(rnd.randrange(0, 5)):
            w[rnd.randrange(len(w))] = word()
        rows.append(w)
    for _ in range(120):
        n = rnd.choice([4, 10, 20, 60])
        rows.append([word() for _ in range(n)] + passage + [word() for _ in range(n // 2)])
    rows += [base, base, ["one"], ["One"], ["a", "b"], passage]
    rnd.shuffle(rows)
    same(spark, [(i * 7 + 3, " ".join(w)) for i, w in enumerate(rows)] + [(1, ""), (2, None), (4, " \n")])


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (2, "x " * 40000), (3, "X\t" * 40000)], "doc_id bigint, text string")
    got = sorted(map(tuple, nd.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True), (2, 1, 2, True), (3, 1, 2, False)], key=str)
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(1, 3000)] + [(9000, 5000), (5000, 7000), (7000, 7000)] + [(20000, i) for i in range(20001, 23000)]
    rnd.shuffle(links)
    for tasks, rows in ((1, links), (40, links), (3, links[:1]), (3, [])):
        work = Work(spark, "test")
        got = {r.id: r.label for r in components(spark.createDataFrame(rows, "a bigint, b bigint").repartition(tasks), work, "c").collect()}
        work.drop()
        root = {i: i for x in rows for i in x}

        def find(i, root=root):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for x, y in rows:
            root[find(x)] = find(y)
        assert set(got) == set(root)
        pairs = {(got[i], find(i)) for i in root}
        assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}) and all(find(v) == find(k) for k, v in got.items())


def test_cuts_between_partitions_lose_nothing():
    """Blocks as judged in pieces are those of the whole order, or count as large; pairs are the same."""
    rnd = np.random.default_rng(4)
    keys = rnd.integers(0, 3, (400, 1 + 4 * nd.DEPTH)).astype(np.uint8)
    keys[:, 1 : 4 * nd.DEPTH] = 0
    keys[:, 1 + 3] = rnd.integers(0, 9, 400)
    ids = np.arange(400) * 3
    order = np.lexsort((ids, *keys.T[::-1]))
    whole = nd.Neighbours(keys[order], ids[order], np.full(400, 10))
    a, b, large = whole.judge(0, 400)
    for size in (1, 3, 6, 7, 12, 13, 25, 100, 400):
        parts = [whole.cut(slice(k, k + size)) for k in range(0, 400, size)]
        pairs, big = set(), []
        for k, p in enumerate(parts):
            if len(p) > 2 * nd.BLOCK:
                x, y, z = p.judge(nd.BLOCK, len(p) - nd.BLOCK)
                pairs |= set(zip(x, y, strict=True))
                big += z.tolist()
            left, right = p.cut(slice(-2 * nd.BLOCK, None)), (parts[k + 1] if k + 1 < len(parts) else p.cut(slice(0, 0))).cut(slice(2 * nd.BLOCK))
            x, y, z = left.joined(right).judge(max(0, len(left) - nd.BLOCK), len(left) + min(nd.BLOCK, len(right)))
            pairs |= set(zip(x, y, strict=True))
            big += z.tolist()
        first = parts[0]
        x, y, z = first.judge(0, min(nd.BLOCK, len(first)))
        pairs |= set(zip(x, y, strict=True))
        big += z.tolist()
        assert set(large.tolist()) <= set(big)
        assert {p for p in zip(a, b, strict=True) if not {*p} & set(big)} <= pairs


def test_recall_of_asked_ids(spark):
    """Of the larger table, ids divisible by 20 against all rows: every link, by an inverted index."""
    d = "/root/testdata/sf0.1"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in nd.op1_near_dedup(spark, d).collect()}
    sets, index = {}, {}
    for i, t in rows:
        w = SPLIT.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {hash(tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    n = 0
    for i in (i for i in sets if i % 20 == 0):
        hits = {}
        for s in sets[i]:
            for j in index[s]:
                hits[j] = hits.get(j, 0) + 1
        for j, k in hits.items():
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                n += i != j
                assert got[i] == got[j]
    assert n > 100
