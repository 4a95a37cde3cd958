"""Near-duplicate detection: chosen-path set similarity join on minwise tokens, links confirmed on full shingle sets.

1. Each document becomes its set of word shingles (hashed to 64 bits) and a sketch of minwise tokens. Equal sets form a
   class by a grouped minimum, so exact copies never meet in pairs.
2. Chosen path: in each of ``trees`` independent trees a document follows, from the root, the branches named by its
   minwise token at coordinates that a hash of the node selects, 1/similarity of them on average. Nodes with one member
   vanish; nodes above ``limit`` branch on; in small nodes members are compared exhaustively by sketch. What remains
   above the limit after ``depth`` levels is compared block by block, so nothing is dropped.
3. A node yields a spanning forest of its candidate graph (sketch similarity above the threshold less a margin). The
   forests' components are candidate clusters, a superset of the true ones; no node emits all its pairs.
4. In each cluster the full sets decide: exact intersections, blocks of bounded size, again a spanning forest; blocks
   meet the cluster's first block, and only what stays apart from its largest component meets all. The components are
   the result.

Recall: a pair at the threshold s meets in a tree of two levels with probability above 1/2, so 16 independent trees miss it with
probability under 2e-5; the sketch margin of 3.7 standard deviations adds 1e-4. Confirmation admits no false link.

Defined cases: null text or a text without words has an empty set, is linked with nothing and is its own component; a
text with fewer words than a shingle has its whole word sequence as its one shingle; rows that share a doc_id count as
one document with several texts; a null doc_id has its class's component, or null if that class has no id, and isn't
kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, column_bytes, likely_members, lower_ascii, materialize, mix64, word_hashes, word_spans
from .graph_cc import components

T = 128
_A = np.random.RandomState(7).randint(1, 2**31, T).astype(np.uint32) * np.uint32(2) + np.uint32(1)


@dataclass(frozen=True)
class Params:
    words: int = 5
    num: int = 80  # links need 100 * intersection >= num * union
    trees: int = 16
    limit: int = 4096
    depth: int = 5
    block: int = 1024
    block_shingles: int = 3_000_000
    margin: float = 3.7

    @property
    def s(self) -> float:
        return self.num / 100

    @property
    def agree(self) -> int:
        """Equal sketch coordinates that make a candidate."""
        return max(1, int(np.floor(T * (self.s - self.margin * np.sqrt(self.s * (1 - self.s) / T)))))


def shingle_sets(col, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of an Arrow string array."""
    buf, offs = column_bytes(col)
    buf = lower_ascii(buf)
    starts, ends, first = word_spans(buf, offs)
    h = word_hashes(buf, starts, ends)
    out = []
    if len(h) >= words:
        mixed = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            mixed = mix64(mixed * GOLDEN + h[k : k + len(mixed)])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(mixed[a : b - words + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for k in range(a, b):
                one = mix64(one * GOLDEN + h[k : k + 1])
            out.append(mix64(one + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def keys(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set."""
    if not len(s):
        return 0, 0
    a = np.add.reduce(mix64(s + np.uint64(1)))
    b = np.bitwise_xor.reduce(mix64(s * GOLDEN + np.uint64(len(s))))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sketch(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(T, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 2048):
        np.minimum(low, (x[a : a + 2048, None] * _A).min(axis=0), out=low)
    return low


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                sets = shingle_sets(batch.column(1).slice(lo, 1024), p.words)
                ks, sk = [keys(s) for s in sets], [sketch(s) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 1024), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in ks], pa.int64()), pa.array([k[1] for k in ks], pa.int64()), pa.array([x.tobytes() for x in sk], pa.binary()), pa.array([x.astype(np.uint8).tobytes() for x in sk], pa.binary())], ["doc_id", "n", "k1", "k2", "sketch", "tiny"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sketch binary, tiny binary")


def _branch(node: np.ndarray, row: np.ndarray, sk: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray]:
    """One level: each (node, row) goes on by the one or two coordinates that the node's hash selects."""
    out_node, out_row = [], []
    for j in range(2):
        pick = mix64(node + np.array([j + 1], np.uint64) * GOLDEN)
        on = np.ones(len(node), bool) if j == 0 else (mix64(pick) >> np.uint64(11)).astype(np.float64) / 2**53 < 1 / s - 1
        c = (pick[on] % np.uint64(T)).astype(np.int64)
        value = sk[row[on], c].astype(np.uint64)
        out_node.append(mix64(node[on] * GOLDEN + mix64(value + (c.astype(np.uint64) << np.uint64(32)) + np.uint64(1))))
        out_row.append(row[on])
    return np.concatenate(out_node), np.concatenate(out_row)


def _emit(ids: np.ndarray, node: np.ndarray, row: np.ndarray):
    import pyarrow as pa

    both = np.unique(np.stack([node.view(np.int64), row], 1), axis=0) if len(node) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(ids[both[:, 1]])], ["node", "c"])


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, T)


def roots(reps: DataFrame, p: Params) -> DataFrame:
    """The first two levels of every tree at once: (node, c)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                ids, sk = part.column(0).to_numpy(), _matrix(part.column(1))
                n = len(ids)
                node = np.repeat(mix64(np.arange(1, p.trees + 1).astype(np.uint64) * GOLDEN), n)
                row = np.tile(np.arange(n), p.trees)
                for _ in range(2):
                    node, row = _branch(node, row, sk, p.s)
                yield _emit(ids, node, row)

    return reps.select("c", "sketch").mapInArrow(run, "node long, c long")


def deeper(rows: DataFrame, p: Params) -> DataFrame:
    """One more level of the members (node, c, sketch) of large nodes."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                node = batch.column(0).to_numpy().view(np.uint64)
                yield _emit(batch.column(1).to_numpy(), *_branch(node, np.arange(len(node)), _matrix(batch.column(2)), p.s))

    return rows.select("node", "c", "sketch").mapInArrow(run, "node long, c long")


def forest(sk: np.ndarray, agree: int, half: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the graph of rows with at least ``agree`` equal bytes; each row is expanded once, against the
    rows not reached yet. half: compare only rows that differ in it."""
    left, edges = np.arange(len(sk)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            ok = (sk[left] == sk[i]).sum(axis=1) >= agree
            if half is not None:
                ok &= half[left] != half[i]
            hit = left[ok].tolist()
            if hit:
                edges += [(i, j) for j in hit]
                queue += hit
                left = left[~ok]
    return edges


def _groups(batches, width: int):
    """Whole groups (equal leading key columns) of a stream sorted by them."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(width)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (held[0][0] != key[a]).any():
                yield pa.Table.from_batches([x for _, x in held])
                held = []
            held.append((key[a], batch.slice(a, b - a)))
    if held:
        yield pa.Table.from_batches([x for _, x in held])


EDGES = "a long, b long"


def _edges(pairs: list[tuple[int, int]], ids: np.ndarray):
    import pyarrow as pa

    at = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], ["a", "b"])


def compare_nodes(leaves: DataFrame, p: Params) -> DataFrame:
    """Candidate edges of nodes (node, part_a, part_b, half, c, tiny)."""

    def run(batches):
        ids_out, pairs = [], []
        for g in _groups(batches, 3):
            ids = g.column("c").to_numpy()
            sk = np.frombuffer(b"".join(g.column("tiny").to_pylist()), np.uint8).reshape(-1, T)  # low bytes suffice to compare
            half = g.column("half").to_numpy() if g.column("part_a")[0] != g.column("part_b")[0] else None
            got = forest(sk, p.agree, half)
            if got:
                base = sum(map(len, ids_out))
                ids_out.append(ids)
                pairs += [(a + base, b + base) for a, b in got]
            if len(pairs) > 20000:
                yield _edges(pairs, np.concatenate(ids_out))
                ids_out, pairs = [], []
        if pairs:
            yield _edges(pairs, np.concatenate(ids_out))

    keyed = leaves.repartition("node", "part_a", "part_b").sortWithinPartitions("node", "part_a", "part_b")
    return keyed.select("node", "part_a", "part_b", "half", "c", "tiny").mapInArrow(run, EDGES)


def block_pairs(rows: DataFrame, group: str, block: str, blocks: str) -> DataFrame:
    """Replicate each row to the pairs (part_a <= part_b) of blocks of its group that include its own block."""
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)).alias("_o")
    out = rows.select("*", other)
    return out.withColumns({"part_a": F.least(block, "_o").cast("long"), "part_b": F.greatest(block, "_o").cast("long"), "half": F.col(block).cast("long")}).drop("_o")


def candidate_edges(reps: DataFrame, p: Params) -> DataFrame:
    """Edges whose components hold every pair that any tree finds similar by sketch."""
    sketches = reps.select("c", "sketch")
    rows, found = materialize(roots(reps, p), "nodes"), None
    for level in range(p.depth + 1):
        sized = rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        rows = rows.join(sized, "node")
        done = rows if level == p.depth else rows.filter(F.col("size") <= p.limit)
        found = done if found is None else found.union(done)
        if level == p.depth:
            break
        big = rows.filter(F.col("size") > p.limit)
        if big.isEmpty():
            break
        rows = materialize(deeper(big.join(sketches, "c"), p), "nodes")
    blocks = F.ceil(F.col("size") / p.limit).cast("int")
    cut = found.withColumn("blocks", blocks).withColumn("block", F.pmod(F.hash("c"), "blocks"))
    leaves = block_pairs(cut, "node", "block", "blocks").join(reps.select("c", "tiny"), "c")
    return compare_nodes(leaves, p)


def exact_forest(sets: list[np.ndarray], num: int, half: np.ndarray | None) -> list[tuple[int, int]]:
    """Spanning forest of the pairs with 100 * intersection >= num * union, by exact intersections."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    if n <= 6:
        near = np.zeros((n, n), bool)
        for i in range(n):
            for j in range(i):
                if 100 * min(size[i], size[j]) >= num * max(size[i], size[j]):
                    k = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    near[i, j] = near[j, i] = 100 * k >= num * (size[i] + size[j] - k)
    else:
        flat = np.concatenate(sets)
        _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[code] > 1  # what only one set holds is in no intersection
        row, code = np.repeat(np.arange(n), size)[shared], code[shared]
        _, code = np.unique(code, return_inverse=True)
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        inter = np.zeros((n, n), np.float32)
        width = 2048
        for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            a, b = np.searchsorted(code, [lo, lo + width])
            m = np.zeros((n, width), np.float32)
            m[row[a:b], code[a:b] - lo] = 1
            inter += m @ m.T
        k = inter.astype(np.int64)
        near = 100 * k >= num * (size[:, None] + size[None, :] - k)
    if half is not None:
        near &= half[:, None] != half[None, :]
    np.fill_diagonal(near, False)
    left, edges = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            ok = near[i, left]
            hit = left[ok].tolist()
            edges += [(i, j) for j in hit]
            queue += hit
            left = left[~ok]
    return edges


def _exact_edges(docs: DataFrame, placed: DataFrame, p: Params) -> DataFrame:
    """Exact edges inside the groups (cluster, part_a, part_b) of placed (and half, c, k1, k2); half -1: all pairs, else
    only pairs of different halves."""
    mine = placed.select("c").distinct()
    texts = likely_members(docs.select(F.col("doc_id").cast("long").alias("c"), "text"), mine).join(mine, "c", "left_semi")

    def run(batches):
        ids_out, pairs_out = [], []
        for g in _groups(batches, 3):
            sets = shingle_sets(g.column("text"), p.words)
            want = list(zip(g.column("k1").to_pylist(), g.column("k2").to_pylist(), strict=True))
            own = [i for i, s in enumerate(sets) if keys(s) == want[i]]  # rows that share a doc_id may hold other texts
            ids, half = g.column("c").to_numpy()[own], g.column("half").to_numpy()[own]
            got = exact_forest([sets[i] for i in own], p.num, half if (half >= 0).any() else None)
            if got:
                base = sum(map(len, ids_out))
                ids_out.append(ids)
                pairs_out += [(a + base, b + base) for a, b in got]
            if len(pairs_out) > 20000:
                yield _edges(pairs_out, np.concatenate(ids_out))
                ids_out, pairs_out = [], []
        if pairs_out:
            yield _edges(pairs_out, np.concatenate(ids_out))

    rows = placed.join(texts, "c").repartition("cluster", "part_a", "part_b").sortWithinPartitions("cluster", "part_a", "part_b")
    return rows.select("cluster", "part_a", "part_b", "half", "c", "k1", "k2", "text").mapInArrow(run, EDGES)


def _blocks(p: Params) -> F.Column:
    """Blocks of a group of members with n shingles each."""
    return F.greatest(F.ceil(F.count("*") / p.block), F.ceil(F.sum("n") / p.block_shingles)).cast("int")


def confirm(docs: DataFrame, clusters: DataFrame, p: Params) -> DataFrame:
    """Exact edges that connect what is connected inside candidate clusters (c, n, k1, k2, cluster).

    A cluster of several blocks is first compared block by block with its first block only, so each text is sent once, and
    those of one block as often as there are blocks. Members that this doesn't connect to the cluster's largest component
    are then compared with every member of their cluster; all other pairs are connected already.
    """
    sizes = clusters.groupBy("cluster").agg(_blocks(p).alias("blocks"))
    cut = clusters.join(sizes, "cluster").withColumn("block", F.pmod(F.hash("c"), "blocks"))
    cut = materialize(cut, "clusters")
    cols = ["cluster", F.lit(0).cast("long").alias("part_a"), F.col("part_b").cast("long").alias("part_b"), F.lit(-1).cast("long").alias("half"), "c", "k1", "k2"]
    first = cut.filter("blocks = 1 or block > 0").withColumn("part_b", F.col("block")).select(*cols)
    leaders = cut.filter("blocks > 1 and block = 0").withColumn("part_b", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1))).select(*cols)
    found = materialize(_exact_edges(docs, first.unionByName(leaders), p), "links")
    large = cut.filter("blocks > 1")
    if large.isEmpty():
        return found
    parts = components(found, "links").select(F.col("node").alias("c"), "component")
    large = materialize(large.join(parts, "c", "left").select("c", "n", "k1", "k2", "cluster", F.coalesce("component", "c").alias("component")), "large-clusters")
    most = large.groupBy("cluster", "component").agg(F.count("*").alias("members"))
    most = most.groupBy("cluster").agg(F.max_by("component", F.struct("members", -F.col("component"))).alias("main"))
    left = materialize(large.join(most, "cluster").filter("component <> main").drop("main"), "left-over")
    if left.isEmpty():
        return found
    few = left.groupBy("cluster").agg(_blocks(p).alias("few"))
    both = few.join(large.groupBy("cluster").agg(_blocks(p).alias("all")), "cluster")

    def dealt(rows, own, other, half):
        part = F.pmod(F.hash("c"), F.col(own))
        a, b = ("x", "y") if half == 0 else ("y", "x")
        out = rows.join(both, "cluster").select("cluster", "c", "k1", "k2", part.alias("x"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("y"))
        return out.select("cluster", F.col(a).cast("long").alias("part_a"), F.col(b).cast("long").alias("part_b"), F.lit(half).cast("long").alias("half"), "c", "k1", "k2")

    rest = dealt(left, "few", "all", 0).unionByName(dealt(large, "all", "few", 1))
    return found.unionByName(_exact_edges(docs, materialize(rest, "left-over"), p))


_SALTS = 16


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, **more) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    p = Params(words=words, num=num, **more)
    sigs = materialize(signatures(docs, p), "signatures")
    classes = sigs.filter("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("c"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    reps = sigs.join(classes.select(F.col("c").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"]).select(F.col("doc_id").alias("c"), "n", "k1", "k2", "sketch", "tiny").dropDuplicates(["c", "k1", "k2"])
    reps = materialize(reps, "reps")
    clusters = components(candidate_edges(reps, p), "candidates")
    members = reps.select("c", "n", "k1", "k2").join(clusters.select(F.col("node").alias("c"), F.col("component").alias("cluster")), "c")
    final = components(confirm(docs, materialize(members, "clusters"), p), "links")
    # a copy's class is looked up by key; hot keys are salted
    salted = classes.join(final.select(F.col("node").alias("c"), "component"), "c", "left").select("k1", "k2", F.coalesce("component", "c").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    rows = sigs.select("doc_id", "n", "k1", "k2", F.when(F.col("n") > 0, F.pmod(F.hash("doc_id"), F.lit(_SALTS))).alias("salt"))
    joined = rows.join(salted, ["k1", "k2", "salt"], "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
