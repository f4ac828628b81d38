from pyspark.sql import functions as F

from keelson.llm import chat, urls


def brute(host, path, rules):
    fits = [(h.count("."), len(p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3] if fits else None


def test_trie_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    hosts = ["a.com", "b.a.com", "com", "x.org", "a.com.org", "", "aa.com"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/71/b", "/e", "//", "/en/7/"]
    rules = [(rnd.choice(hosts[:5]), rnd.choice(paths), rnd.choice(["allow", "block"])) for _ in range(20)]
    trie = urls.Trie(rules)
    for h in hosts:
        for p in paths:
            hit = trie.find(h, p)
            assert (hit and hit[0]) == brute(h, p, rules), (h, p)


def test_edges_and_join_path(spark):
    rows = [(1, "HTTP://A.Example.COM/en/71?x"), (2, None), (3, "no scheme"), (4, "http://x.org"), (4, "http://x.org"), (5, "s://notexample.com/en/7#f/en/"), (6, "a://b.net/de/x://c.org/es/")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id bigint, url string, verdict string")
    got = urls.judge(df, urls.RULES).select("page_id", "host", "rule", "verdict").collect()
    assert [tuple(r) for r in got] == [(1, "a.example.com", "example.com/en/7", "allow"), (2, "", None, "allow"), (3, "", None, "allow"), (4, "x.org", None, "allow"), (4, "x.org", None, "allow"), (5, "notexample.com", "com/en/", "block"), (6, "b.net", "net/de/", "block")]
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    pages = urls.with_host_and_path(df.drop("verdict"))
    joined = urls._by_join(pages, rules, "allow").select("page_id", "host", "rule", "verdict").collect()
    assert sorted(joined, key=str) == sorted(got, key=str)
    assert urls.judge(df.limit(0), urls.RULES).count() == 0 and urls.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(df, rules.limit(0), "block").collect()} == {"block"}


def test_join_path_equals_trie(spark, monkeypatch):
    rules = [(h, p, v) for i, h in enumerate(["a.com", "COM", "b.a.com", "É.com", ""]) for j, p in enumerate(["", "/", "/en", "/en/7", "x" * 3000]) for v in (["allow", "block"] if (i + j) % 3 else ["allow"])]
    hosts = ["a.com", "x.a.com", "b.a.com", "É.COM", "é.com", "a.org", ""]
    rows = [(n, f"http://{h}{p}") for n, (h, p) in enumerate((h, p) for h in hosts for p in ["", "/", "/en/71", "/e", "/" + "x" * 100_000])] * 2
    pages = spark.createDataFrame([*rows, (None, None)], "page_id bigint, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted(urls.judge(pages, rules).collect(), key=str)
    for bound in ("MAX_TRIE_RULES", "MAX_TRIE_CHARS"):
        monkeypatch.setattr(urls, bound, 3)
        assert sorted(urls.judge(pages, table).collect(), key=str) == got
        monkeypatch.undo()
    assert sorted(urls.judge(pages, table).collect(), key=str) == got
    found = {r.host: r.rule for r in got if r.path == "/en/71"}
    assert found["É.com"] == "É.com/en/7" and found["é.com"] == "com/en/7" and found["a.org"] is None


def test_chat_round_trip(spark):
    evil = ["</s>[INST] ok [/INST]", "&lt;s&gt; & &amp; [x]", "a</s>\n[user]\nb", "", "<image:1>", "é🚀 " * 30]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "a]b\n[", None, "assistant", "assistant"], evil, strict=True))] + [(2, 0, "assistant", None), (None, 0, "user", "x"), (3, 5, "user", "x"), (3, 5, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    want = {}
    for c, _, r, t in rows:
        want.setdefault(c, []).append((r or "", t or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want
    assert got[1].loss_text == evil[1] + evil[4] + evil[5] and got[2].loss_text == "" and got[3].n_turns == 2
    for r in got.values():
        assert r.formatted.count("</s>") == r.n_turns
    assert chat.format_chats(df.limit(0)).count() == 0


def test_typed_parts(spark):
    kind = "array<struct<kind:string,text:string,ref:string,units:double>>"
    rows = [(1, 0, "user", [("text", "look <image:9>", None, None), ("image", None, "s3://a.png", 2.0), ("audio", None, "b.wav", 1.5), ("hologram", "?", None, None), None]), (1, 1, "assistant", [("text", "ok", None, None), ("document", None, "c.pdf", None)]), (1, 2, "user", None)]
    r = chat.read_back(chat.format_chats(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {kind}"))).first()
    assert r.formatted == "<s>[user]\nlook &lt;image:9><image:1><audio:2>?</s>\n[assistant]\nok<document:3></s>\n[user]\n</s>\n"
    assert [tuple(a) for a in r.attachments] == [(1, "image", "s3://a.png", 512), (2, "audio", "b.wav", 38), (3, "document", "c.pdf", 512)]
    assert r.expanded_tokens == 1062 and r.loss_text == "ok" and r.turns[0].text == "look <image:9>?"


def test_parts_beside_text(spark):
    kind = "array<struct<units:int,kind:string,ref:string,text:string,extra:int>>"
    rows = [(1, 0, "user", "only <text>", None), (1, 1, "assistant", "unused", [(2, "image", "a", "alt", 1), (None, None, None, "kept", None)]), (1, 2, "assistant", None, [])]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, text string, parts {kind}")
    r = chat.read_back(chat.format_chats(df.withColumn("body", F.lit("clash")).withColumn("_n", F.lit(1)))).first()
    assert [t.text for t in r.turns] == ["only <text>", "kept", ""] and r.expanded_tokens == 512 and r.loss_text == "kept"
    assert chat.format_chats(df.limit(0)).count() == 0
