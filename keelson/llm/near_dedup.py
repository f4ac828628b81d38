"""MinHash near-duplicate detection with an LSH forest.

1. Each whole text gives its set of hashed 5-word shingles, a 128-bit digest of the set and TREES x DEPTH minhashes.
   Documents with one set are a class, represented by its smallest doc_id; only representatives go on.
2. Each tree sorts the representatives by its DEPTH minhashes: one range partitioning by (tree, minhashes, id), so a
   prefix that very many share is split like any other. Neighbours by longest common prefix are candidates, to a depth
   that adapts to the region: in the shallowest prefix block of at most BLOCK members all pairs are taken; in blocks
   that stay larger only the next row is. Rows beside a cut are judged with the rows beyond it.
3. Candidates whose sizes and signatures allow 0.75 (SIGNATURE_FLOOR) are confirmed on full sets, and components are
   formed.
4. A representative that lies in first-level blocks of fewer than BLOCK members in fewer than SAFE_TREES trees could
   have missed partners. Those are compared exactly: two sets at 0.75 share one of each other's first quarter of
   shingles in any common order, here rare ones first. Shingles met in one component alone need no work.

Loss: a pair at 0.75 collides in a tree with a probability of 0.75. A tree counts as safe for a document only with room for
one member more, so a partner that collides there is always a candidate. Whatever the group sizes, a link is then
lost if it collides in none of SAFE_TREES trees, 0.25 ** 12 = 6e-8 for minhashes that are independent, or if its signatures
agree in less than SIGNATURE_FLOOR of 64 places, another 2e-11. Blocks beside a cut count as unsafe where their size isn't known.

Sets are never kept for all documents: those of candidates are made in a second reading and saved once. Rows sharing a
doc_id are one vertex; null and empty texts link with nothing; null ids only belong to their class, and are kept if it
has no other id. A very long text is one set, whatever its length. An empty table gives an empty one; clashing
columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components, relabel
from .shingles import MULT, WordHasher, finish, shingle_set
from .tables import Work
from .text import table

TREES, DEPTH, BLOCK, SAFE_TREES = 16, 4, 6, 12
SIGNATURE_FLOOR, PART = 24 / 64, 256
PAIR, LARGE, EDGE = 0, 1, 2
FOUND = "kind int, a bigint, b bigint, side int, key binary, n bigint"
BITMAP, SEED = 1 << 23, 11
NUM, DEN = 75, 100
_rng = np.random.default_rng(SEED)
MUL = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
ADD = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """TREES x DEPTH least values, 32 bits each; order by tree."""
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            x = shingles[at : at + 2048]
            out = np.minimum(out, ((x[None, :] * MUL[:, None] + ADD[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union of two sorted sets."""
    both = len(a) + len(b)
    inter = both - len(np.union1d(a, b))
    return inter > 0 and DEN * inter >= NUM * (both - inter)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, sig). digest is null for a text without words."""

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            n, digest, sig = [], [], []
            for t in b.column("text"):
                s = shingle_set(hasher(t.as_py()))
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(minhashes(s).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, digest binary, sig binary")


def _bit(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (finish(ids.astype(np.uint64) * MULT) % np.uint64(BITMAP)).astype(np.int64)


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """BITMAP flags, packed: which hashes of ids occur. Built by partition and merged by slice; its size is fixed."""
    width = BITMAP // 8 // 16

    def flags(batches):
        bits = np.zeros(BITMAP, bool)
        for b in batches:
            bits[_bit(b.column("id").to_numpy())] = True
        packed = np.packbits(bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([packed[k * width : (k + 1) * width].tobytes() for k in range(16)], pa.binary())], ["k", "bits"])

    def merge(t):
        bits = np.bitwise_or.reduce([np.frombuffer(c.as_py(), np.uint8) for c in t.column("bits")])
        return pa.table({"k": pa.array([t.column("k")[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    kind, out = "k int, bits binary", np.zeros(BITMAP // 8, np.uint8)
    for r in ids.select("id").mapInArrow(flags, kind).groupBy("k").applyInArrow(merge, kind).collect():
        out[r.k * width : (r.k + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return out


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents in ids (id, distinct), from their texts.

    A bitmap of id hashes passes few other texts, so texts aren't shuffled; the join then makes the choice exact.
    """
    passing = docs.sparkSession.sparkContext.broadcast(id_bitmap(ids))

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            at = _bit(b.column("id").to_numpy())
            b = b.filter(pa.array((passing.value[at >> 3] << (at & 7) & 128) > 0))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingle_set(hasher(t.as_py())).tobytes() for t in b.column("text")], pa.binary())], ["id", "shingles"])

    some = docs.select(F.col("doc_id").alias("id"), "text").filter("id is not null").mapInArrow(run, "id bigint, shingles binary")
    return some.join(ids, "id", "left_semi")


class Neighbours:
    """Rows of one or more trees in order: keys as bytes (tree, then DEPTH minhashes), ids and set sizes."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        self.keys, self.ids, self.sizes = keys, ids, sizes

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table, id_: str = "id") -> Neighbours:
        raw = b"".join(batch.column("key").to_pylist())
        return cls(np.frombuffer(raw, np.uint8).reshape(-1, 1 + 4 * DEPTH), *(batch.column(c).to_numpy() for c in (id_, "n")))

    def __len__(self) -> int:
        return len(self.ids)

    def cut(self, rows: slice) -> Neighbours:
        return Neighbours(self.keys[rows], self.ids[rows], self.sizes[rows])

    def joined(self, other: Neighbours) -> Neighbours:
        return Neighbours(*(np.concatenate(x) for x in zip((self.keys, self.ids, self.sizes), (other.keys, other.ids, other.sizes), strict=True)))

    def judge(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows lo to hi: candidates a < b with rows behind them, and the ids that have no room in their first-level
        block. A block that touches an end of the table may go on beyond it and counts as large."""
        m = len(self)
        runs, depth, large = [np.arange(m)], np.full(m, DEPTH + 1), np.zeros(m, bool)
        for d in range(DEPTH, 0, -1):
            run = np.concatenate([[0], np.cumsum((self.keys[1:, : 1 + 4 * d] != self.keys[:-1, : 1 + 4 * d]).any(axis=1))])
            size = np.bincount(run)
            size[[0, -1]] = m + BLOCK
            depth = np.where(size[run] <= BLOCK, d, depth)
            large = size[run] >= BLOCK
            runs.insert(0, run)
        runs = np.array(runs)
        at = np.arange(lo, hi)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(1, BLOCK):
            i = at[at + k < m]
            near = runs[depth[i] - 1, i] == runs[depth[i] - 1, i + k]
            if k == 1:
                near |= runs[0, i] == runs[0, i + 1]
            i = i[near]
            n1, n2 = self.sizes[i], self.sizes[i + k]
            i = i[(DEN * np.minimum(n1, n2) >= NUM * np.maximum(n1, n2)) & (self.ids[i] != self.ids[i + k])]
            a.append(np.minimum(self.ids[i], self.ids[i + k]))
            b.append(np.maximum(self.ids[i], self.ids[i + k]))
        return np.concatenate(a), np.concatenate(b), self.ids[lo:hi][large[lo:hi]]

    def found(self, lo: int, hi: int) -> pa.Table:
        """judge() as FOUND rows."""
        a, b, big = self.judge(lo, hi)
        kinds = np.concatenate([np.full(len(a), PAIR, np.int32), np.full(len(big), LARGE, np.int32)])
        columns = [pa.array(kinds), pa.array(np.concatenate([a, big])), pa.array(np.concatenate([b, big])), *(pa.nulls(len(kinds), t) for t in (pa.int32(), pa.binary(), pa.int64()))]
        return pa.Table.from_arrays(columns, names=["kind", "a", "b", "side", "key", "n"])

    def edge(self, cut: int, side: int) -> pa.Table:
        """The rows as FOUND rows that stand beside a cut between partitions."""
        m = len(self)
        keys = pa.array([x.tobytes() for x in self.keys], pa.binary())
        columns = [pa.array(np.full(m, x, t)) for x, t in ((EDGE, np.int32), (cut, np.int64))]
        return pa.Table.from_arrays([*columns, pa.array(self.ids), pa.array(np.full(m, side, np.int32)), keys, pa.array(self.sizes)], names=["kind", "a", "b", "side", "key", "n"])


def forest_candidates(reps: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b, ids that need the exact step) of representatives (id, n, sig)."""

    def walk(batches):
        part, head, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            held = Neighbours.of(batch) if held is None else held.joined(Neighbours.of(batch))
            if len(held) > 2 * BLOCK:
                head = head or held.cut(slice(2 * BLOCK))
                yield from held.found(BLOCK, len(held) - BLOCK).to_batches()
                held = held.cut(slice(-2 * BLOCK, None))
        if held is not None:
            yield from (head or held).edge(part, 1).to_batches()
            yield from held.edge(part + 1, 0).to_batches()

    def beside_cut(t: pa.Table) -> pa.Table:
        left, right = (Neighbours.of(t.filter(pa.compute.equal(t.column("side"), k)).sort_by([("key", "ascending"), ("b", "ascending")]), "b") for k in (0, 1))
        return left.joined(right).found(max(0, len(left) - BLOCK), len(left) + min(BLOCK, len(right)))

    keys = F.array(*[F.concat(F.lit(bytearray([t])), F.substring("sig", 1 + 4 * DEPTH * t, 4 * DEPTH)) for t in range(TREES)])
    rows = reps.select("id", "n", F.explode(keys).alias("key")).repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    found = work.save(rows.mapInArrow(walk, FOUND), "forest")
    cuts = found.filter(F.col("kind") == EDGE).groupBy("a").applyInArrow(beside_cut, FOUND)
    counted = found.filter(F.col("kind") != EDGE).unionByName(cuts).groupBy("kind", "a", "b").agg(F.count("*").alias("trees"))
    counted = work.save(counted, "candidates")
    work.drop("forest")
    risky = counted.filter((F.col("kind") == LARGE) & (F.col("trees") > TREES - SAFE_TREES)).select(F.col("a").alias("id"))
    return counted.filter(F.col("kind") == PAIR).select("a", "b"), risky


def with_estimates(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose signatures agree enough, with the share of equal minhashes."""

    def run(batches):
        for b in batches:
            x = [np.frombuffer(b"".join(v.as_py() for v in b.column(c)), np.uint32).reshape(-1, TREES * DEPTH) for c in ("sa", "sb")]
            same = (x[0] == x[1]).mean(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(same)], ["a", "b", "near"]).filter(pa.array(same >= SIGNATURE_FLOOR))

    one = reps.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    two = reps.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, near double")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that are links on their full sets."""

    def run(batches):
        for b in batches:
            ok = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column("sa"), b.column("sb"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def exact_links(sets: DataFrame, risky: DataFrame, labels: DataFrame, work: Work) -> DataFrame:
    """Links (a, b) between different components among the risky ids, by prefix filtering and blocks.

    The common order is by document count, then hash. A shingle of one document can't make a pair, but takes its place
    at the front of that document's order; one met in a single component is not looked at further. Components that
    share a shingle of this front form a region, outside of which nothing of theirs can link. In a region, the
    documents outside its largest component are compared with all, PART by PART; a task gives one link for each document
    and each other component that it meets. Time is the product of the two counts, at a few hundred thousand pairs a
    second; rows moved are that over PART.
    """
    named = risky.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))

    def spread(batches):
        for b in batches:
            parts = [np.frombuffer(s.as_py(), np.int64) for s in b.column("shingles")]
            sizes = [len(x) for x in parts]
            ids, labels_ = (np.repeat(b.column(c).to_numpy(), sizes) for c in ("id", "label"))
            n = np.repeat(np.array(sizes, np.int64), sizes)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, labels_, n, flat)], ["id", "label", "n", "shingle"])

    rows = sets.join(named, "id").select("id", "label", "shingles").mapInArrow(spread, "id bigint, label bigint, n bigint, shingle bigint")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("m > 1")
    rows = rows.join(counts, "shingle")
    w = Window.partitionBy("id")
    first = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1
    place = F.col("n") - F.count("*").over(w) + F.row_number().over(w.orderBy("m", "shingle"))
    rows = rows.withColumn("_place", place).filter((F.col("_place") <= first) & (F.col("lo") != F.col("hi"))).select("id", "label", "lo").distinct()
    rows = work.save(rows, "fronts")
    regions = components(rows.select(F.col("lo").alias("a"), F.col("label").alias("b")).filter("a <> b").distinct(), work, "regions")
    regions = regions.select(F.col("id").alias("label"), F.col("label").alias("region"))
    members = work.save(rows.select("id", "label").distinct().join(regions, "label"), "members")
    largest = members.groupBy("region", "label").agg(F.count("*").alias("m")).groupBy("region").agg(F.sum("m").alias("m"), F.max_by("label", F.struct("m", "label")).alias("usual"), F.max("m").alias("most"))
    parts = [F.ceil(F.col(c) / PART).cast("int") for c in ("m", "odd")]
    spans = largest.withColumn("odd", F.col("m") - F.col("most")).filter("odd > 0").select("region", "usual", parts[0].alias("rows"), parts[1].alias("cols"))
    full = members.join(spans, "region").join(sets, "id")
    up_to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    row, col = F.pmod(F.xxhash64("id"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("cols")).cast("int")
    asked = full.filter("label <> usual").select("region", up_to("rows").alias("row"), col.alias("col"), "id", "label", "shingles", F.lit(True).alias("asks"))
    given = full.select("region", row.alias("row"), up_to("cols").alias("col"), "id", "label", "shingles", F.lit(False).alias("asks"))
    return asked.unionByName(given).groupBy("region", "row", "col").applyInArrow(compare_blocks, "a bigint, b bigint")


def compare_blocks(t: pa.Table) -> pa.Table:
    """Links of the rows that ask with the others, through an inverted index of the others."""
    asks = t.filter(t.column("asks"))
    given = t.filter(pa.compute.invert(t.column("asks")))
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in given.column("shingles")]
    sizes = np.array([len(x) for x in sets], np.int64)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if sets and asks.num_rows:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        ids, labels = given.column("id").to_numpy(), given.column("label").to_numpy()
        for i, label, x in zip(asks.column("id").to_pylist(), asks.column("label").to_pylist(), asks.column("shingles"), strict=True):
            x = np.frombuffer(x.as_py(), np.uint64)
            lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
            n = hi - lo
            hits = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            inter = np.bincount(owner[hits], minlength=len(sets))
            ok = np.nonzero((inter > 0) & (DEN * inter >= NUM * (len(x) + sizes - inter)) & (labels != label))[0]
            ok = ok[np.unique(labels[ok], return_index=True)[1]]
            a.append(np.minimum(ids[ok], i))
            b.append(np.maximum(ids[ok], i))
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def links(docs: DataFrame, reps: DataFrame, work: Work) -> DataFrame:
    """(id, label) for representatives (id, n, sig) that are linked with another; label is a member of the component."""
    pairs, risky = forest_candidates(reps, work)
    pairs = work.save(with_estimates(pairs, reps), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(risky).distinct()
    sets = work.save(sets_of(docs, ids), "sets", "none")
    labels = components(work.save(confirmed(pairs, sets), "confirmed"), work, "labels")
    if not risky.limit(1).count():
        return labels
    found = work.save(exact_links(sets, risky, labels, work).distinct(), "exact")
    work.drop("sets")
    if not found.limit(1).count():
        return labels
    # Components stay; the new links only join them.
    joined = components(relabel(found, labels), work, "joined").select(F.col("id").alias("label"), F.col("label").alias("_first"))
    both = labels.unionByName(relabeled_ids(found, labels))
    return both.join(joined, "label", "left").select("id", F.coalesce("_first", "label").alias("label"))


def relabeled_ids(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids of new links that had no component, each as its own label."""
    ids = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return ids.join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs' doc_id with n_shingles, component_id and kept: a row for each row of docs."""
    work = Work(docs.sparkSession, "near")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sig = work.save(signatures(docs), "signatures", "none")
    classes = work.save(sig.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes", "none")
    labels = work.save(links(docs, classes.filter("id is not null").select("id", "n", "sig"), work), "linked")
    least = work.save(labels.groupBy("label").agg(F.min("id").alias("component_id")), "least")
    work.drop("candidates", "pairs", "sets", "confirmed", "labels", "fronts", "regions", "members", "exact", "joined")
    named = labels.join(least, "label").select("id", "component_id")
    top = classes.select("digest", "id").join(named, "id", "left").select("digest", F.coalesce("component_id", "id").alias("component_id"))
    out = sig.drop("sig").join(top, "digest", "left")
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), comp.eqNullSafe(F.col("doc_id")).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
