"""Best-fit packing by length patterns: non-negative least squares on the length histogram, rounding, residuals.

1. Tokenise; cut documents longer than a sequence; count the pieces of each length (a histogram of at most
   ``capacity`` entries, whatever the size of the corpus).
2. Enumerate patterns of length classes that fill a sequence (up to three documents, or copies of one length with one or
   two others), fit their repeat counts to the histogram by non-negative least squares, and round to the nearest.
3. Pack the pieces that rounding left over, best fit decreasing, into the slack of patterned sequences and new ones.
   This too works on runs of equal sequences, so its cost depends on the histogram, not on the corpus.
4. Give each piece its place: its rank among pieces of its length picks the run, by binary search.

Defined cases: null or empty text is the end id alone; null or repeated doc_ids are packed like any row; ties between pieces
of one length go by partition and order of arrival; very long texts are cut into many pieces; extra columns, whatever their
names, are ignored; an empty table gives no rows; a document of exactly ``capacity`` tokens is one piece.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, materialize, trim

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, k long"
#: Bytes of text that a task encodes at a time, and distinct chunks that a worker keeps between them: encoding takes some
#: hundred bytes for each byte of text, a kept chunk some two hundred.
SLICE, CHUNKS = 6 << 20, 600_000
#: The same where workers and the JVM still hold memory from earlier stages: half of the memory for twice the time.
SLIM = (1 << 20, 100_000)
#: Share of a pattern's fitted repeats that is made; what is left over fills the slack of rounding lengths up to classes.
PATTERNED = 0.97
#: Classes from which on pieces are long enough for patterns where all lengths in patterns do worse.
SHORTEST = 9
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def nnls(a: np.ndarray, b: np.ndarray, w: np.ndarray, most: int = 2000) -> np.ndarray:
    """Weighted non-negative least squares by active sets; columns of a are patterns. At most as many columns as rows are
    positive, so few patterns carry the fit and rounding loses little."""
    aw, bw = a * w[:, None], b * w
    x, free = np.zeros(a.shape[1]), np.zeros(0, np.int64)
    if not len(x):
        return x
    near = 1e-9 * max(1.0, float(np.abs(aw.T @ bw).max(initial=0.0)))
    for _ in range(most):
        gain = aw.T @ (bw - aw @ x)
        gain[free] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= near:
            break
        free = np.append(free, j)
        while True:
            sub = aw[:, free]
            gram = sub.T @ sub
            got = np.linalg.solve(gram + np.eye(len(free)) * (1e-12 * np.trace(gram)), sub.T @ bw)
            bad = got <= 0
            if not bad.any():
                x[:] = 0
                x[free] = got
                break
            if got[-1] <= 0 and free[-1] == j and x[j] == 0:  # no progress in this direction
                free = free[:-1]
                return x
            step = float(np.min(x[free][bad] / (x[free][bad] - got[bad])))
            x[free] += step * (got - x[free])
            x[free[x[free] <= 1e-12]] = 0
            free = free[x[free] > 0]
    return x


def patterns(classes: int) -> list[tuple[int, ...]]:
    """Multisets of classes 1..classes that sum to ``classes`` exactly, the largest first: all of one to three classes,
    and all of one class, or none, with as many of a smaller one as fit and what then is left."""
    out = {(classes,)}
    for a in range(1, classes // 2 + 1):
        out.add((classes - a, a))
    for a in range(1, classes // 3 + 1):
        for b in range(a, (classes - a) // 2 + 1):
            out.add((classes - a - b, b, a))
    for c in range(1, classes // 3 + 1):
        for big in (0, *range(c + 1, classes - 2 * c + 1)):
            k, rest = divmod(classes - big, c)
            out.add(tuple(sorted([c] * k + [x for x in (big, rest) if x], reverse=True)))
    return sorted(out)


class _Runs:
    """Runs of sequences with equal content. slack -> list of [first_sequence, count, used]."""

    def __init__(self, capacity: int):
        self.capacity, self.next, self.open, self.placed = capacity, 0, {}, []

    def new(self, count: int) -> list:
        self.next += count
        return [self.next - count, count, 0]

    def place(self, length: int, rank: int, run: list, offset: int) -> None:
        """Pieces rank..rank+count-1 of this length go to the run's sequences at the offset."""
        self.placed.append((length, rank, run[1], run[0], offset))

    def keep(self, run: list) -> None:
        slack = self.capacity - run[2]
        if slack:
            self.open.setdefault(slack, []).append(run)


def plan(hist: np.ndarray, capacity: int, classes: int = 128) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, count, first sequence, offset) that place all hist[length] pieces; sequences used.

    Patterns over all lengths, over those of SHORTEST classes or more (shorter pieces then fill what is left of sequences,
    as rounding them up to a class would waste most of it), and over none: the first plan of those with fewest sequences."""
    hist = hist.astype(np.int64)
    plans = [_plan(hist, capacity, classes, least) for least in (1, SHORTEST, classes + 1)]
    return min(plans, key=lambda p: p[1])


def _plan(hist: np.ndarray, capacity: int, classes: int, least: int) -> tuple[np.ndarray, int]:
    """The plan with patterns of pieces of the class ``least`` or a larger one."""
    rank = np.zeros(capacity + 1, np.int64)
    runs = _Runs(capacity)
    classes = max(1, min(classes, capacity))
    width = -(-capacity // classes)
    # 1. whole-sequence pieces stand alone
    if hist[capacity]:
        run = runs.new(int(hist[capacity]))
        runs.place(capacity, 0, run, 0)
        rank[capacity] = hist[capacity]
    left = hist.copy()
    left[capacity] = 0
    if left.any():
        # 2. classes by rounding up: any piece of a class fits where the class does
        cls = np.minimum((np.arange(capacity + 1) + width - 1) // width, classes)
        by = np.bincount(cls, weights=left, minlength=classes + 1)[1:]
        by[: least - 1] = 0
        pats = [p for p in patterns(classes) if min(p) >= least]
        a = np.zeros((classes, len(pats)))
        for j, p in enumerate(pats):
            for c in p:
                a[c - 1, j] += 1
        fit = np.floor(PATTERNED * nnls(a, by, 1 / np.sqrt(np.maximum(by, 1)))).astype(np.int64)

        def longest(at_most: int) -> int:
            while at_most and not left[at_most]:
                at_most -= 1
            return at_most

        for j in np.argsort([-max(p) for p in pats], kind="stable"):
            stock = np.bincount(cls, weights=left, minlength=classes + 1)[1:].astype(np.int64)
            need = np.bincount(pats[j], minlength=classes + 1)[1:]
            use = int(min([fit[j], *(stock[c] // need[c] for c in np.flatnonzero(need))]))
            if use <= 0:
                continue
            made = [runs.new(use)]
            # fill one slot of every sequence in turn, splitting runs where a length runs out; the last slot takes the
            # longest piece that still fits, so that rounding lengths up to classes wastes little
            for slot, c in enumerate(pats[j]):
                nxt = []
                for run in made:
                    room = capacity - run[2]
                    while run[1]:
                        x = longest(room if slot == len(pats[j]) - 1 else min(room, c * width))
                        if not x:
                            nxt.append([run[0], run[1], run[2]])
                            break
                        n = int(min(run[1], left[x]))
                        runs.place(x, int(rank[x]), [run[0], n, 0], run[2])
                        nxt.append([run[0], n, run[2] + x])
                        rank[x] += n
                        left[x] -= n
                        run[0], run[1] = run[0] + n, run[1] - n
                made = nxt
            for run in made:
                runs.keep(run)
        # 3. residuals, longest first, each into the tightest open sequence
        for x in range(capacity - 1, 0, -1):
            while left[x]:
                fits = [s for s in runs.open if s >= x]
                if fits:
                    s = min(fits)
                    run = runs.open[s].pop()
                    if not runs.open[s]:
                        del runs.open[s]
                else:
                    per = capacity // x
                    run = runs.new(int(-(-left[x] // per)))
                n = int(min(run[1], left[x]))
                # as many copies as the sequence holds: after one copy, it is still the tightest for the next
                copies = max(1, min((capacity - run[2]) // x, int(left[x]) // n if n else 1))
                if n < run[1]:
                    runs.keep([run[0] + n, run[1] - n, run[2]])
                for _ in range(copies):
                    runs.place(x, int(rank[x]), [run[0], n, 0], run[2])
                    rank[x] += n
                    left[x] -= n
                    run[2] += x
                runs.keep([run[0], n, run[2]])
    rows = np.array(runs.placed, np.int64).reshape(-1, 5)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))], runs.next


def cut_batches(batches, pid: int, tokenizer: str, end_id: int, capacity: int, slim: bool = False):
    """The pieces of a partition's batches (doc_id, text)."""
    import pyarrow as pa

    from .fasttok import encoder

    enc, seen = None, np.zeros(capacity + 1, np.int64)
    end = np.uint32(end_id).tobytes()
    most, chunks = SLIM if slim else (SLICE, CHUNKS)
    trim()  # what earlier stages have freed in this worker
    for batch in (part for whole in batches for part in by_bytes(whole, 1, most)):
        enc = enc or encoder(tokenizer, chunks)
        ids, offs = enc.encode(batch.column(1))
        raw = memoryview(ids.astype("<u4", copy=False).tobytes())
        total = np.diff(offs) + 1
        count = -(-total // capacity)
        row = np.repeat(np.arange(len(total)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        length = np.minimum(capacity, total[row] - start)
        crc = np.empty(len(row), np.int64)
        at, last = offs[row] + start, piece == count[row] - 1
        for i, (a, n, z) in enumerate(zip(at.tolist(), length.tolist(), last.tolist(), strict=True)):
            crc[i] = zlib.crc32(end, zlib.crc32(raw[4 * a : 4 * (a + n - 1)])) if z else zlib.crc32(raw[4 * a : 4 * (a + n)])
        order = np.argsort(length, kind="stable")
        lo = np.searchsorted(length[order], length, side="left")
        k = np.empty(len(row), np.int64)
        k[order] = np.arange(len(row))
        k += seen[length] - lo
        seen += np.bincount(length, minlength=capacity + 1)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(row), pid, np.int32)), pa.array(k)], ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "k"])


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, slim: bool = False) -> DataFrame:
    """A row per piece. k is its rank among the pieces of its length in its partition pid."""

    def cut(batches):
        from pyspark import TaskContext

        yield from cut_batches(batches, TaskContext.get().partitionId(), tokenizer, end_id, capacity, slim)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, slim: bool = False) -> DataFrame:
    """Pack all documents; a row per piece with its sequence and place. slim: with less memory, and more time."""
    spark = docs.sparkSession
    pieces = materialize(tokenised_pieces(docs, tokenizer, end_id, capacity, slim), "pieces")
    counts = pieces.groupBy("length", "pid").agg((F.max("k") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    hist = np.zeros(capacity + 1, np.int64)
    for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        hist[r.length] = r.n
    rows, _ = plan(hist, capacity)
    shift = np.int64(1) << np.int64(46)
    keys = rows[:, 0] * shift + rows[:, 1]
    shared = spark.sparkContext.broadcast((keys, rows))  # bounded by the histogram: at most a few times `capacity`**1.5 runs

    def locate(batches):
        import pyarrow as pa

        keys, rows = shared.value
        for batch in batches:
            b = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            seq = rows[at, 3] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["piece"], b["start"], b["length"], b["ids_crc32"], pa.array(seq), pa.array(rows[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # bases has a row per length and partition, so it grows with the corpus: it isn't broadcast
    placed = pieces.join(bases.select("length", "pid", "base").hint("merge"), ["length", "pid"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k")).alias("rank"))
    return placed.mapInArrow(locate, PACKED)
