import hashlib
import random

from keelson.llm import fingerprints as fp


def shingles(t):
    w = (t or "").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_query_pairs_and_estimates(spark, tmp_path):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcdefghijklmnop") * rnd.randrange(1, 4) for _ in range(rnd.choice([0, 1, 3, 60, 400, 900]))) for _ in range(40)]
    texts[5], texts[6], texts[9] = None, "é🚀x", texts[8]
    ids = rnd.sample(range(10**6), 40)
    (spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet")))
    got = {r.doc_id: r for r in fp.op5_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(zip(ids, texts, strict=True), reverse=True)
    assert len(got) == 40
    off = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % 40][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, est in ((edited, got[i].near_edited), (nxt, got[i].near_next)):
            a, b = shingles(t), shingles(other)
            off.append(est - (len(a & b) / len(a | b) if a | b else 1.0))
    assert max(map(abs, off)) < 0.2 and abs(sum(off) / len(off)) < 0.02
    assert got[ids[8]].fingerprint == got[ids[9]].fingerprint and got[ids[5]].fingerprint == ""


def test_ties_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "c"), (1, "a b", "c"), (None, None, "c"), (2, "x", "c")], "doc_id bigint, text string, fingerprint string")
    rows = fp.fingerprint(df).collect()
    assert len(rows) == 4 and len({r.fingerprint for r in rows}) == 3 and all(len(r.fingerprint) in (0, fp.BINS) for r in rows)


def test_repeated_and_null_ids(spark, tmp_path):
    """Rows of one id follow each other in some fixed order; equal rows come together."""
    long = "".join(chr(97 + k % 26) + " " * (k % 7 == 0) for k in range(300_000))
    rows = [(5, "a b c d"), (5, "e f g"), (5, "a b c d"), (None, "x y"), (None, None), (None, "x y"), (9, "ab" * 5), (-4, long)]
    spark.createDataFrame([(*r, "z", "z") for r in rows], "doc_id bigint, text string, key string, fp string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in fp.op5_fingerprints(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in fp.op5_fingerprints(spark, str(tmp_path)).collect())

    def edits(order):
        out = []
        for k, (i, t) in enumerate(order):
            t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
            e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
            out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
        return sorted(out, key=str)

    five = [[(5, "a b c d")] * 2 + [(5, "e f g")], [(5, "e f g")] + [(5, "a b c d")] * 2]
    null = [[(None, "x y")] * 2 + [(None, None)], [(None, None)] + [(None, "x y")] * 2]
    assert sorted((r[:3] for r in got), key=str) in [edits([rows[6], *a, rows[7], *b]) for a in five for b in null]
    empty = tmp_path / "e"
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(empty / "documents.parquet"))
    assert fp.op5_fingerprints(spark, str(empty)).count() == 0


def test_one_document_follows_itself(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g h")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = fp.op5_fingerprints(spark, str(tmp_path)).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b c d a b c d").hexdigest()
