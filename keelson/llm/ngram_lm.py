"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, bigrams over unigrams.

A text's tokens are its words, A-Z lower-cased, then END. With c counts in the training tokens and N their number:

    P(w)      = d(c) c / N for known words; the mass that discounting frees is the one unknown word's
    P(w | h)  = d(c(h w)) c(h w) / c(h) if c(h w) > 0, else a(h) P(w)
    a(h)      = (1 - sum of the first kind) / (1 - sum of P(w) over the same w)

d is Katz's discount up to a count of K and 1 above. A history whose bigrams all have d = 1 would leave nothing for its
backoff; it alone is divided by c(h) + 1. Every bigram of the training texts is in the model, each distribution sums to 1,
and a text's first token has no history.

Tables, all partitioned and none on the driver: documents are read once into chunks of about CHUNK_TOKENS tokens
(token numbers and the chunk's sorted word hashes), saved in the shared folder. A chunk deals its distinct words and
bigrams, each once, with its training count, to at most 2**FAN_BITS nodes by their top hash bits. Up to that many chunks
one level of nodes adds all counts up. Beyond, a node merges about 2**FAN_BITS senders and deals the merged keys on by
their next bits, until a level has each hash range in one node: so rows grow in proportion to chunks (times the levels,
two up to 16 million chunks), no node holds more than a chunk's worth of keys, and no word, however common, weighs more
than a row per sender. The last level answers each sender in its own order, naming one owner for each bigram; nodes pass
answers down, keeping one owner. Owners send their part of a history's two sums the same way and get a(h) back. Then
chunks score their texts, recursing from bigram to unigram by array look-up. The driver sees the counts of counts, N and V.

Words and bigrams are compared by 64-bit hashes. A null text is empty (END alone), repeated rows are texts of their own, a
text of any length lies in one chunk, an empty table gives an empty one, without training rows all tokens are unknown, and
other columns are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import MULT, WordHasher, finish
from .tables import Work
from .text import table

CHUNK_TOKENS, K, FAN_BITS = 2_000_000, 5, 12
END = np.uint64(0x0123456789ABCDEF)
WORDS, PAIRS, SUMS, TOTALS = 0, 1, 2, 3
CHUNK = "chunk bigint, docs binary, held binary, lens binary, vocab binary, tokens binary"
MESSAGE = "node bigint, sender bigint, kind int, keys binary, content binary"
ANSWER = "receiver bigint, node bigint, kind int, content binary, totals array<bigint>"
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs."""
    width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
    return bytes([width]) + a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8, offset=1).reshape(-1, b[0])
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : b[0]] = raw
    return out.view("<u8").ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def squeeze(a: np.ndarray) -> bytes:
    """pack, byte planes apart, compressed."""
    raw = pack(a)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0]).T
    return raw[:1] + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unsqueeze(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    return unpack(b[:1] + planes.T.tobytes())


def _rows(ddl: str, rows: list[tuple]) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.table({n: pa.array([r[k] for r in rows], kinds[t]) for k, (n, t) in enumerate(fields)})


def training_row(fold: int = 2, of: int = 7):
    """False for the held-out fold, by the checksum of the id's digits."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of != fold, F.lit(True))


# chunks


def make_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of docs (doc_id, text, train)."""

    def close(ids: list, train: list, parts: list, n: int) -> pa.RecordBatch:
        flat = np.concatenate(parts)
        vocab, tokens = np.unique(flat, return_inverse=True)
        chunk = TaskContext.get().partitionId() * 2**24 + n
        known = np.array([i if i is not None else -(2**63) for i in ids], np.int64)
        lens = np.array([len(p) for p in parts], np.uint64)
        row = (chunk, known.tobytes(), np.array([not t for t in train], np.uint8).tobytes(), pack(lens), pack_sorted(vocab), squeeze(tokens.astype(np.uint64)))
        return _rows(CHUNK, [row]).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        ids, train, parts, size, n = [], [], [], 0, 0
        for b in batches:
            for i, t, is_train in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("train").to_pylist(), strict=True):
                ids.append(i)
                train.append(is_train)
                parts.append(np.append(hasher(t.as_py()), END))
                size += len(parts[-1])
                if size >= CHUNK_TOKENS:
                    yield close(ids, train, parts, n)
                    ids, train, parts, size, n = [], [], [], 0, n + 1
        if parts:
            yield close(ids, train, parts, n)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "train").mapInArrow(run, CHUNK)


class Chunk:
    """Decoded chunk: token numbers into vocab; pairs are tokens that have a predecessor in their text."""

    def __init__(self, r: dict):
        self.docs = np.frombuffer(r["docs"], np.int64)
        self.held = np.frombuffer(r["held"], np.uint8).astype(bool)
        self.lens = unpack(r["lens"]).astype(np.int64)
        self.vocab = unpack_sorted(r["vocab"])
        self.tokens = unsqueeze(r["tokens"]).astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.doc_of = np.repeat(np.arange(len(self.lens)), self.lens)
        first = np.zeros(len(self.tokens), bool)
        first[self.starts] = True
        self.second = np.nonzero(~first)[0]
        self.train = ~self.held[self.doc_of]
        self.group = int(finish(np.array([r["chunk"]], np.uint64))[0])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct bigram hashes, number of each pair among them)."""
        with np.errstate(over="ignore"):
            keys = finish(self.vocab[self.tokens[self.second - 1]] * MULT + finish(self.vocab[self.tokens[self.second]]))
        return np.unique(keys, return_inverse=True)


# messages between chunks and nodes


class Level(NamedTuple):
    """Nodes of a level: `before` + `bits` top bits of the hash, for each of `groups` groups of senders."""

    before: int
    bits: int
    groups: int


def plan_levels(n_chunks: int) -> list[Level]:
    """Levels until one group is left, none with a fan-out above 2**FAN_BITS."""
    need = max(min(4, FAN_BITS), (n_chunks - 1).bit_length())
    cuts = [*range(0, need, FAN_BITS), need]
    return [Level(a, b - a, max(1, -(-n_chunks >> b))) for a, b in zip(cuts, cuts[1:], strict=False)]


def deal(level: Level, sender: int, prefix: int, group: int, kind: int, keys: np.ndarray, values: np.ndarray) -> list[tuple]:
    """A message for each hash range of the level under the prefix that all the sorted keys share."""
    shift = 64 - level.before - level.bits
    edges = np.array([((prefix << level.bits) + x) << shift for x in range(1, 1 << level.bits)], np.uint64)
    cut = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    rows = []
    for x in range(1 << level.bits):
        at = slice(cut[x], cut[x + 1])
        content = values[:, at].tobytes() if kind == SUMS else pack(values[at])
        rows.append((((prefix << level.bits) + x) * level.groups + group % level.groups, sender, kind, pack_sorted(keys[at]), content))
    return rows


class Merged:
    """The messages of one kind at a node: distinct sorted keys with the sums of their values, and a way to answer."""

    def __init__(self, messages: list[dict], kind: int):
        own = sorted((r for r in messages if r["kind"] == kind), key=lambda r: r["sender"])
        keys = [unpack_sorted(r["keys"]) for r in own]
        self.node, self.kind, self.senders = own[0]["node"], kind, [r["sender"] for r in own]
        self.keys, self.first, self.number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        self.ends = np.cumsum([len(k) for k in keys])
        if kind == SUMS:
            values = np.concatenate([np.frombuffer(r["content"]).reshape(2, -1) for r in own], axis=1)
            self.sums = np.stack([np.bincount(self.number, weights=v, minlength=len(self.keys)) for v in values])
        else:
            counts = np.concatenate([unpack(r["content"]) for r in own])
            self.sums = np.bincount(self.number, weights=counts, minlength=len(self.keys)).astype(np.uint64)

    def answer(self, values: np.ndarray) -> list[tuple]:
        """Rows for all senders of the values by key. Of a bigram's senders the first alone stays its owner (last bit)."""
        out = values[self.number]
        if self.kind == PAIRS:
            owned = out[self.first]
            out = out & ~np.uint64(1)
            out[self.first] = owned
        starts = [0, *self.ends[:-1]]
        encode = np.ndarray.tobytes if self.kind == SUMS else squeeze
        return [(s, self.node, self.kind, encode(out[i:j]), None) for s, i, j in zip(self.senders, starts, self.ends, strict=True)]


def answered(rows: list[dict], kind: int) -> np.ndarray:
    """What the nodes answered to a sender, in the order of its keys."""
    own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["node"])
    return np.concatenate([np.frombuffer(r["content"]) if kind == SUMS else unsqueeze(r["content"]) for r in own])


def exchange(messages: DataFrame, levels: list[Level], kinds: tuple[int, ...], top: Callable, save: Callable) -> DataFrame:
    """Answers to the senders of messages: up to the last level, whose `top` gives them, and down again."""

    def forward(level: Level, above: Level) -> Callable:
        def run(t: pa.Table) -> pa.Table:
            got, rows = t.to_pylist(), []
            for kind in kinds:
                m = Merged(got, kind)
                rows += deal(above, m.node, m.node // level.groups, m.node % level.groups, kind, m.keys, m.sums)
            return _rows(MESSAGE, rows)

        return run

    def back(t: pa.Table, answers: pa.Table) -> pa.Table:
        got, given = t.to_pylist(), answers.to_pylist()
        return _rows(ANSWER, [row for kind in kinds for row in Merged(got, kind).answer(answered(given, kind))])

    sent = [messages]
    for level, above in zip(levels, levels[1:], strict=False):
        sent[-1] = save(sent[-1])
        sent.append(sent[-1].groupBy("node").applyInArrow(forward(level, above), MESSAGE))
    answers = sent.pop().groupBy("node").applyInArrow(top, ANSWER)
    totals = None
    if sent:
        answers = save(answers)
        totals = answers.filter(F.col("kind") == TOTALS)
    while sent:
        answers = sent.pop().groupBy("node").cogroup(answers.filter(F.col("kind") != TOTALS).groupBy("receiver")).applyInArrow(back, ANSWER)
    return answers if totals is None else answers.unionByName(totals)


def send_counts(chunks: DataFrame, level: Level) -> DataFrame:
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                c = Chunk(r)
                keys, number = c.pairs()
                words = np.bincount(c.tokens, weights=c.train, minlength=len(c.vocab)).astype(np.uint64)
                pairs = np.bincount(number, weights=c.train[c.second], minlength=len(keys)).astype(np.uint64)
                rows = [row for kind, k, n in ((WORDS, c.vocab, words), (PAIRS, keys, pairs)) for row in deal(level, r["chunk"], 0, c.group, kind, k, n)]
                yield from _rows(MESSAGE, rows).to_batches()

    return chunks.mapInArrow(run, MESSAGE)


def add_counts(t: pa.Table) -> pa.Table:
    """Answers: for words the training count; for bigrams twice it, plus 1 for the owner; and a row of totals a node."""
    got, rows, totals = t.to_pylist(), [], []
    for kind in (WORDS, PAIRS):
        m = Merged(got, kind)
        seen = m.sums > 0
        totals += [int(m.sums.sum()), int(seen.sum()), *np.bincount(np.minimum(m.sums, K + 2).astype(np.int64), minlength=K + 3)[1 : K + 2].tolist()]
        rows += m.answer(m.sums * np.uint64(2) + seen.astype(np.uint64) if kind == PAIRS else m.sums)
    return _rows(ANSWER, [*rows, (-1, m.node, TOTALS, None, totals)])


# the model


def discounts(n: list[int]) -> np.ndarray:
    """Katz's d for counts 0..K+1 from counts of counts n[0] (ones) to n[K]; 1 above K."""
    d = np.ones(K + 2)
    d[0] = 0.0
    for r in range(1, K + 1):
        d[r] = (r - 0.5) / r
        if all(n[: K + 1]):
            tail = (K + 1) * n[K] / n[0]
            katz = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) if tail < 1 else 0.0
            if 0 < katz < 1:
                d[r] = katz
    return d


class Model:
    """Scalars of the model: N, V, discounts of words and bigrams, and the unknown word's mass."""

    def __init__(self, totals: list[int]):
        half = len(totals) // 2
        self.n, self.v, counts = totals[0], totals[1], totals[2:half]
        self.words, self.pairs = discounts(counts), discounts(totals[half + 2 :])
        freed = sum((1 - self.words[r]) * r * counts[r - 1] for r in range(1, K + 1))
        self.unknown = freed / self.n if self.n else 1.0
        self.scale = 1.0
        if self.n and self.unknown <= 0:
            self.unknown, self.scale = 1 / (self.n + 1), self.n / (self.n + 1)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(c))
        return np.where(c > 0, self.scale * self.words[np.minimum(c, K + 1).astype(np.int64)] * c / self.n, self.unknown)

    def kept(self, c: np.ndarray) -> np.ndarray:
        """Discounted bigram counts."""
        return self.pairs[np.minimum(c, K + 1).astype(np.int64)] * c


def sum_histories(model: Model, level: Level) -> Callable:
    """Per chunk: its known histories, with the parts of both sums for the bigrams that it owns: counts freed by
    discounting, and lower-order probability."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return _rows(MESSAGE, [])
        r, given = chunk.to_pylist()[0], answers.to_pylist()
        c, words, pairs = Chunk(r), answered(given, WORDS).astype(np.int64), answered(given, PAIRS).astype(np.int64)
        keys, number = c.pairs()
        example = np.zeros(len(keys), np.int64)
        example[number] = c.second
        own = np.nonzero(pairs & 1)[0]
        h, w, n = c.tokens[example[own] - 1], c.tokens[example[own]], pairs[own] >> 1
        sums = np.stack([np.bincount(h, weights=x, minlength=len(words)) for x in (n - model.kept(n), model.unigram(words[w]))])
        known = np.nonzero(words)[0]
        return _rows(MESSAGE, deal(level, r["chunk"], 0, c.group, SUMS, c.vocab[known], sums[:, known]))

    return run


def weigh(t: pa.Table) -> pa.Table:
    """Backoff counts of a node's histories: a(h) times what h is divided by. Negative where nothing was freed and one
    event is held instead."""
    m = Merged(t.to_pylist(), SUMS)
    freed, lower = m.sums
    return _rows(ANSWER, m.answer(np.where(freed > 0, freed, -1.0) / np.maximum(1 - lower, 1e-12)))


def score_chunk(model: Model) -> Callable:
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return _rows(RESULT, [])
        given = answers.to_pylist()
        c, words, pairs = Chunk(chunk.to_pylist()[0]), answered(given, WORDS).astype(np.int64), answered(given, PAIRS).astype(np.int64)
        known = np.nonzero(words)[0]
        backoff, divisor = np.ones(len(words)), np.ones(len(words))
        left = answered(given, SUMS)
        divisor[known] = words[known] + (left < 0)
        backoff[known] = np.abs(left) / divisor[known]
        count = words[c.tokens]
        p = model.unigram(count)
        _, number = c.pairs()
        pair, h = pairs[number] >> 1, c.tokens[c.second - 1]
        p[c.second] = np.where(pair > 0, model.kept(pair) / divisor[h], backoff[h] * p[c.second])
        n = len(c.lens)
        base = np.log10((count + 1) / (model.n + model.v + 1))
        columns = (np.bincount(c.doc_of, minlength=n), np.bincount(c.doc_of, weights=count > 0, minlength=n).astype(np.int64), np.full(n, model.n), np.bincount(c.doc_of, weights=base, minlength=n), np.bincount(c.doc_of, weights=np.log10(p), minlength=n))
        ids = pa.array(c.docs, mask=c.docs == -(2**63))
        return pa.table([ids, pa.array(c.held), *map(pa.array, columns)], names=[f.split()[0] for f in RESULT.split(", ")])

    return run


def score(docs: DataFrame) -> DataFrame:
    """RESULT rows for docs (doc_id, text, train): the model learns from rows with train and scores all."""
    spark = docs.sparkSession
    work, saved = Work(spark, "lm"), itertools.count()

    def save(df: DataFrame) -> DataFrame:
        return work.save(df, f"step-{next(saved)}", "none")

    chunks = save(make_chunks(docs))
    n_chunks = chunks.select("chunk").count()
    if not n_chunks:
        return spark.createDataFrame([], RESULT)
    levels = plan_levels(n_chunks)
    answers = save(exchange(send_counts(chunks, levels[0]), levels, (WORDS, PAIRS), add_counts, save))
    sums = answers.filter(F.col("kind") == TOTALS).select(F.posexplode("totals").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    model = Model([r.n for r in sorted(sums.collect())])
    answers = answers.filter(F.col("kind") != TOTALS)
    grouped = chunks.groupBy("chunk")
    parts = grouped.cogroup(answers.groupBy("receiver")).applyInArrow(sum_histories(model, levels[0]), MESSAGE)
    weights = exchange(parts, levels, (SUMS,), weigh, save)
    return grouped.cogroup(answers.unionByName(weights).groupBy("receiver")).applyInArrow(score_chunk(model), RESULT)


def op4_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text", training_row().alias("train")))
