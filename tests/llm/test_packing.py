import random
import zlib

import numpy as np
import pytest

from keelson.llm import packing


def check(pieces, docs, window=1024):
    """Exact round trip; returns the share of padding."""
    seqs, by = {}, {}
    for p in pieces:
        seqs.setdefault(p[5], []).append(p)
        by.setdefault(p[0], []).append(p)
    for i, ids in docs.items():
        at = 0
        for p in sorted(by[i], key=lambda p: p[1]):
            assert p[1] == at and p[4] == len(ids) and p[3] == zlib.crc32(ids[at : at + p[2]].astype("<u4"))
            at += p[2]
        assert at == len(ids)
    total = pad = 0
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p[6]):
            assert p[6] == at and p[2] > 0
            at += p[2]
        assert at <= window
        total += at
        pad += 0 if at & (at - 1) == 0 else window - at
    return pad / max(total, 1)


def test_round_trip_and_padding(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    enc = packing.encoder()
    docs = {r.doc_id: np.append(enc.ids(r.text), 0).astype("uint32") for r in df.collect()}
    assert check([tuple(r) for r in packing.pack(df).collect()], docs) < 0.02


def test_ids_equal_the_reference_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    enc, plain = packing.encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["", " ", "a b", "x<|endoftext|>y", "<|endoftext|> é <|endoftext", "日本語 текст", "tab\t\r\n  end  ", "it's I'LL 1²³ ½", "\x00\x1f\x85", "é   🚀"]
    for t in texts:
        assert enc.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids
    assert enc.ids("x<|endoftext|>y").tolist() == [87, 50256, 88]


def test_edges(spark):
    enc = packing.encoder()
    long = "word. " * 30000
    rows = [(1, None), (2, ""), (3, long), (4, "x" * 9000), (5, "a b"), (6, "a. <|endoftext|> b")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, sequence_id string").coalesce(1)
    docs = {i: np.append(enc.ids(t or ""), 0).astype("uint32") for i, t in rows}
    assert check([tuple(r) for r in packing.pack(df).collect()], docs) < 0.01
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_of_least_cost(seed):
    rnd = random.Random(seed)
    at = np.unique([0, *np.cumsum([rnd.randrange(1, 5) for _ in range(40)])])
    pen, powers, w = np.array([rnd.choice([0.0, 2.0, 12.0]) for _ in at]), (4, 8), 16

    def cost(i, j):
        n = at[j] - at[i]
        return (0 if n in powers else w - n) + pen[j] + packing.SEQUENCE

    best = [0.0]
    for j in range(1, len(at)):
        best.append(min(best[i] + cost(i, j) for i in range(j) if at[j] - at[i] <= w))
    cuts = [0, *packing.best_cuts(at, pen, powers, w)]
    assert sum(cost(i, j) for i, j in zip(cuts, cuts[1:], strict=False)) == pytest.approx(best[-1])


def test_small_blocks_carry_on():
    rnd, ends = random.Random(1), np.arange(50) % 7 == 0
    p = packing.Packer(0, ends, block=3000)
    docs = {i: np.array([rnd.randrange(50) for _ in range(rnd.randrange(1, 2500))], np.uint32) for i in range(40)}
    out = [x for i, ids in docs.items() for x in p.add(i, ids)] + p.flush(True)
    assert check(out, docs) < 0.02
    assert [x[0] for x in out] == sorted(x[0] for x in out)
