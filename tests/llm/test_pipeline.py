"""The stages against plain rebuilding of their decisions on the small tables."""

import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from keelson.llm import classifier, near_dedup, packing, quality_rules

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cols, rows = docs.columns, {}
    steps = []
    for k, (_, f) in enumerate(cp.STAGES):
        f(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        steps.append((docs, docs := spark.read.parquet(str(tmp_path / str(k)))))
        rows[k] = docs.collect()
        if k < 4:
            assert docs.columns == cols and rows[k]
    ids = [{r.doc_id for r in rows[k]} for k in range(4)]
    before = steps[0][0]
    assert ids[0] == {r.doc_id for r in classifier.op10_quality_classifier(spark, DATA).filter("predicted = 1").collect()}
    assert ids[1] == {r.doc_id for r in quality_rules.judge(steps[1][0], ["doc_id"]).filter("kept").collect()}
    assert ids[2] == {r.doc_id for r in near_dedup.near_duplicates(steps[2][0]).filter("kept").collect()}
    assert len(rows[2]) == len(ids[2]) < len(ids[1]) < before.count()
    words = lambda rs: sum(len(r.text.split()) for r in rs)
    assert ids[3] <= ids[2] and abs(words(rows[3]) - 1.5 * words(rows[2])) < 0.02 * words(rows[3])
    enc = packing.encoder()
    assert sum(r.length for r in rows[4]) == sum(len(enc.ids(r.text)) + 1 for r in rows[3])
    final = cp.run(spark, DATA)
    assert final.columns == packing.COLUMNS and final.count() > 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def one_of_each_group(rows):
    """doc_ids that stay, from all pairs of full shingle sets."""
    sets = {}
    for r in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(r.text or "")]
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return [i for i in ids if top[i] == i]


def test_near_dedup_and_packing_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    want = one_of_each_group(rows)
    assert len(want) < len(rows)
    kept = cp.by_near_dedup(spark, docs, DATA).collect()
    assert sorted(kept) == sorted(r for r in rows if r.doc_id in set(want))

    plain = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    pieces, places = {}, {}
    for r in cp.by_packing(spark, spark.createDataFrame([*kept, kept[0]], docs.schema), DATA).collect():
        pieces.setdefault((r.doc_id, r.document), []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    texts = {r.doc_id: r.text for r in kept}
    assert sorted(i for i, _ in pieces) == sorted([*want, kept[0].doc_id])
    for (i, _), own in pieces.items():
        ids = np.array([*plain.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for own in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)])]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024


def test_verdicts_of_the_filters_take_effect(spark):
    """What the base rules reject never stays, whatever the method says of the rest; planted junk goes, prose stays."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in cp.by_rules(spark, docs, DATA).collect()}
    for r in docs.collect():
        w = WORD.findall(r.text or "")
        windows = {}
        for k in range(len(w) - 4):
            windows.setdefault(tuple(w[k : k + 5]), []).append(k)
        repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
        if len(w) < 10 or 100 * len(repeated) > 20 * len(w):
            assert r.doc_id not in kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = {r.doc_id for r in cp.by_classifier(spark, docs, DATA).collect()}
    right = [(i in good) == (q == 1) for i, q in labels.items()]
    assert np.mean(right) == pytest.approx(1, abs=0.06)


ODD = [
    (1, "a b c d e f g h", "en", "s", 15),
    (1, "a b c d e f g h", "en", "s", 15),
    (1, "one two three four five six seven", "en", "s", 33),
    (None, "a b c d e f g h", None, None, 15),
    (None, "p q r s t u v", None, None, 13),
    (2, None, "en", "s", None),
    (3, "", "de", None, 0),
    (4, "x " * 60_000, "en", "s", 120_000),
]
CLASHES = ["name", "row", "nth", "copy", "cut", "grp", "x", "score", "n_words", "kept", "h", "_t"]


def odd(spark, rows=ODD):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit(c) for c in CLASHES})


def test_near_dedup_keeps_rows_not_ids(spark):
    got = cp.by_near_dedup(spark, odd(spark), DATA)
    assert got.columns == odd(spark).columns
    assert sorted(((r.doc_id, (r.text or "")[:9], r.name) for r in got.collect()), key=str) == sorted([(1, "a b c d e", "name"), (1, "one two t", "name"), (None, "p q r s t", "name"), (2, "", "name"), (3, "", "name"), (4, "x x x x x", "name")], key=str)


def test_stages_on_odd_tables(spark):
    for rows in (ODD, []):
        for name, f in cp.STAGES:
            got = f(spark, odd(spark, rows), DATA)
            assert name == "packing" or got.columns == odd(spark).columns
            out = got.collect()
            if not rows:
                assert not out
            elif name == "source_mixing":
                assert {r.text for r in out} & {r[1] for r in ODD} and all(r.cut == "cut" for r in out)
            elif name == "packing":
                assert len({r.document for r in out}) == len(ODD) == len({(r.document, r.doc_id) for r in out})


def test_mixing_names_rows(spark):
    """Rows of one id keep their own texts, and words taken are those of the operator."""
    from keelson.llm import mixing

    rows = [(k % 3 or None, " ".join(f"w{k}x{j}" for j in range(40 + 30 * k)), "en", "ab"[k % 2], k) for k in range(12)]
    docs = odd(spark, [*rows, rows[0]])
    got = {}
    for r in cp.by_mixing(spark, docs, DATA).collect():
        words = r.text.split()
        assert len({w.split("x")[0] for w in words}) == 1
        got[words[0].split("x")[0]] = got.get(words[0].split("x")[0], 0) + len(words)
    want = {}
    for r in mixing.mix(docs.withColumn("first", docs.text.substr(1, 3))).collect():
        k = r.first.split("x")[0]
        want[k] = want.get(k, 0) + r.taken
    assert got == {k: v for k, v in want.items() if v}
