"""Order-preserving packing of documents into token windows by dynamic programming.

Each partition packs its documents in their order, in blocks of about BLOCK_TOKENS tokens with the unfinished last
window carried on, so memory is bounded by a block and the longest document, and nothing is shuffled. Candidate cuts
are document ends (free), sentence ends (CUT_SENTENCE) and, as a fallback, every GRID tokens (CUT_INSIDE). A window
costs its padding to WINDOW, nothing if its length is a power of two, plus its cut's penalty and SEQUENCE, all in
tokens. The least cost ending at a candidate is a sliding-window minimum over earlier candidates, kept in a monotone
queue, so the work is linear in the candidates.

Tokens come from ``encoder``; the default is the byte-level BPE of 50,257 entries as its tokenizer file has it, special
strings included, with SEPARATOR after each document. Each input row has a number of its own, document, which tells
repeated rows apart. Plain Latin text is encoded with the same vocabulary by tiktoken (four times faster,
equal ids by test), any other text by tokenizers. Null and empty texts are the separator alone. Repeated rows are
documents of their own, an empty table gives an empty one, extra columns are left out, whatever their names. A very
long text is cut like any other; one document and a block are in memory at once.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .text import table

WINDOW, SEPARATOR = 1024, 0
CUT_SENTENCE, CUT_INSIDE, SEQUENCE, GRID = 2.0, 12.0, 24.0, 32
BLOCK_TOKENS = 1 << 18
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, document bigint"
COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
OUT = pa.schema([(c, pa.int64()) for c in COLUMNS])
#: Anything but printable Latin letters, digits, punctuation and plain white space.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")


class Encoder:
    """Ids of the byte-level BPE; sentence_end[id] tells tokens that close a sentence or a line."""

    def __init__(self):
        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
        self.special = [x.content for x in self.exact.get_added_tokens_decoder().values()]
        self.sentence_end = np.zeros(self.exact.get_vocab_size() + 1, bool)
        for raw, i in ranks.items():
            self.sentence_end[i] = raw.rstrip(b" ").endswith((b".", b"!", b"?")) or b"\n" in raw

    def ids(self, text: str) -> np.ndarray:
        if UNUSUAL.search(text) or any(x in text for x in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)


@lru_cache(maxsize=1)
def encoder() -> Encoder:
    return Encoder()


def best_cuts(at: np.ndarray, penalty: np.ndarray, powers: tuple[int, ...], window: int = WINDOW) -> list[int]:
    """Indices into `at` (rising, from 0, gaps within the window) of the window ends of least total cost."""
    extra: dict[int, list[int]] = {}
    for p in powers:
        pos = np.searchsorted(at, at - p)
        for j in np.nonzero((at >= p) & (at[pos] == at - p))[0]:
            extra.setdefault(int(j), []).append(int(pos[j]))
    a, pen, m = at.tolist(), (penalty + SEQUENCE).tolist(), len(at)
    cost, back, queue = [0.0] * m, [0] * m, deque()
    for j in range(1, m):
        key = cost[j - 1] + a[j - 1]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, a[j - 1], j - 1))
        low = a[j] - window
        while queue[0][1] < low:
            queue.popleft()
        least, _, i = queue[0]
        least -= low
        if j in extra:
            for k in extra[j]:
                if cost[k] < least:
                    least, i = cost[k], k
        cost[j], back[j] = least + pen[j], i
    cuts, j = [], m - 1
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class Packer:
    """Takes documents one by one and yields pieces, rows of SCHEMA."""

    def __init__(self, first_sequence: int, sentence_end: np.ndarray, window: int = WINDOW, block: int = BLOCK_TOKENS):
        self.sequence, self.sentence_end, self.window, self.block = first_sequence, sentence_end, window, block
        self.docs: list[tuple[int, np.ndarray, int, int]] = []
        self.held, self.document = 0, first_sequence

    def add(self, doc_id: int, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, ids, 0, self.document))
        self.document += 1
        self.held += len(ids)
        return self.flush(False) if self.held >= self.block else []

    def flush(self, last: bool) -> list[tuple]:
        if not self.docs:
            return []
        tokens = np.concatenate([ids[done:] for _, ids, done, _ in self.docs])
        ends = np.cumsum([len(ids) - done for _, ids, done, _ in self.docs])
        size = len(tokens)
        penalty = np.full(size + 1, np.inf)
        penalty[0 : size + 1 : GRID] = CUT_INSIDE
        if last:
            penalty[max(0, size - self.window) :] = CUT_INSIDE
        penalty[1:][self.sentence_end[tokens]] = CUT_SENTENCE
        penalty[ends] = penalty[0] = 0.0
        at = np.nonzero(np.isfinite(penalty))[0]
        powers = tuple(1 << k for k in range(self.window.bit_length() - 1)) if last else (self.window // 2, self.window // 4)
        cuts = [int(at[j]) for j in best_cuts(at, penalty[at], powers, self.window)]
        if not last:
            cuts.pop()
        return self._emit(tokens, ends, cuts)

    def _emit(self, tokens: np.ndarray, ends: np.ndarray, cuts: list[int]) -> list[tuple]:
        out, d, begin, used = [], 0, 0, 0
        raw = tokens.astype("<u4")
        lo = 0
        for cut in cuts:
            at = begin
            while at < cut:
                doc_id, ids, done, document = self.docs[d]
                stop = min(cut, int(ends[d]))
                out.append((doc_id, done + at - lo, stop - at, zlib.crc32(raw[at:stop]), len(ids), self.sequence, at - begin, document))
                at = stop
                if stop == ends[d]:
                    d, lo = d + 1, stop
            begin = used = cut
            self.sequence += 1
        rest = self.docs[d:]
        if rest:
            doc_id, ids, done, document = rest[0]
            rest[0] = (doc_id, ids, done + used - lo, document)
        self.docs, self.held = rest, len(tokens) - used
        return out


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=OUT)


def pack_partition(batches: Iterator[pa.RecordBatch], first_sequence: int) -> Iterator[pa.RecordBatch]:
    enc = encoder()
    packer = Packer(first_sequence, enc.sentence_end)
    end = np.array([SEPARATOR], np.uint32)
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            if rows := packer.add(doc_id, np.concatenate([enc.ids(text.as_py() or ""), end])):
                yield _table(rows)
    if rows := packer.flush(True):
        yield _table(rows)


def pack(docs: DataFrame) -> DataFrame:
    """Pieces of docs (doc_id, text): each id of each document in exactly one."""

    def run(batches):
        # 2**33 sequences and documents for each partition
        return pack_partition(batches, TaskContext.get().partitionId() << 33)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
