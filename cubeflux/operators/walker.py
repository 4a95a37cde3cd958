"""Random walker: the probability that a walk over the weighted graph meets a label's seeds first, for each free pixel.

It is the solution of a sparse symmetric system, the graph's Laplacian with the seeds held fixed, here for all labels at
once by preconditioned conjugate gradients over blocks of pixels. A block (a tile of an image) is a row that holds its part
of the vectors; its own part of the matrix, at most some thousand pixels, is solved exactly as the preconditioner, so an
image of one tile takes one step and others as many as it takes to carry values from tile to tile. A step exchanges what
stands at the tiles' borders in one shuffle, sums the dot products of all blocks, and writes the state: a lost executor
costs the tasks it ran. The driver sees two numbers for each label and step.

Where no seed is in reach, all probabilities are 0 and the label is 0. Edges of weight 0 or less are no edges.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeflux.shared import materialize

SIDE = 32
MAX_STEPS = 2000


def tiles(width: int, side: int = SIDE):
    """The block of a pixel's id in an image of this width."""
    across = -(-width // side)
    return lambda i: F.expr(f"({i} div {width} div {side}) * {across} + ({i} % {width}) div {side}")


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _table(rows: list[tuple], names: list[str], kinds: list):
    import pyarrow as pa

    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _block_of(table, labels: int) -> tuple[dict, list[tuple[int, np.ndarray]]]:
    """A block's part of the system from its edges (u, v, w, lu, lv, bu, bv, block; labels are null where free): the free
    pixels, the matrix within (rows, cols, weights), its diagonal, the right-hand side, and the edges out of it."""
    b = table.column("block")[0].as_py()
    u, v, bu, bv = (table.column(c).to_numpy() for c in ("u", "v", "bu", "bv"))
    w = table.column("w").to_numpy()
    lu, lv = (table.column(c).fill_null(0).to_numpy() for c in ("lu", "lv"))
    near, far = np.concatenate([u, v]), np.concatenate([v, u])  # each edge seen from both ends
    own, other = np.concatenate([bu, bv]), np.concatenate([bv, bu])
    mine, theirs = np.concatenate([lu, lv]), np.concatenate([lv, lu])
    w = np.concatenate([w, w])
    here = (own == b) & (mine == 0)
    near, far, other, theirs, w = near[here], far[here], other[here], theirs[here], w[here]
    ids, at = np.unique(near, return_inverse=True)
    right = np.zeros((len(ids), labels))
    seeded = theirs > 0
    np.add.at(right, (at[seeded], theirs[seeded] - 1), w[seeded])
    inside = (other == b) & ~seeded
    out = (other != b) & ~seeded
    system = {"ids": ids, "diagonal": np.bincount(at, w, len(ids)), "right": right, "row": at[inside], "col": np.searchsorted(ids, far[inside]), "w": w[inside], "out_row": at[out], "out_id": far[out], "out_w": w[out]}
    return system, [(int(k), np.unique(near[out & (other == k)])) for k in np.unique(other[out])]


def _solve(s: dict, r: np.ndarray) -> np.ndarray:
    """The block's own matrix solved. The diagonal is raised by a little where nothing holds a part of it. Pixels in the
    order of their ids have their neighbours within some rows of the matrix, a tile's width: cut into chunks of so many, it
    has none but next to the diagonal, and elimination goes from chunk to chunk. It is diagonally dominant: no pivots."""
    n = len(s["ids"])
    m = max(1, int(np.abs(s["row"] - s["col"]).max(initial=0)))
    chunks = -(-n // m)
    own, left = np.zeros((chunks, m, m)), np.zeros((chunks, m, m))  # of a chunk: with itself, and with the one before it
    at = np.arange(chunks * m)
    own[at // m, at % m, at % m] = 1.0  # rows beyond the last pixel
    own[at[:n] // m, at[:n] % m, at[:n] % m] = s["diagonal"] * (1 + 1e-13)
    i, j = s["row"] // m, s["col"] // m
    for part, here in ((own, i == j), (left, i == j + 1)):
        np.add.at(part, (i[here], s["row"][here] % m, s["col"][here] % m), -s["w"][here])
    y = np.zeros((chunks, m, r.shape[1]))
    y.reshape(chunks * m, -1)[:n] = r
    for k in range(1, chunks):
        both = np.linalg.solve(own[k - 1], np.concatenate([left[k].T, y[k - 1]], axis=1))
        own[k] -= left[k] @ both[:, :m]
        y[k] -= left[k] @ both[:, m:]
    for k in range(chunks - 1, -1, -1):
        y[k] = np.linalg.solve(own[k], y[k] - left[k + 1].T @ y[k + 1] if k + 1 < chunks else y[k])
    return y.reshape(chunks * m, -1)[:n]


def _times(s: dict, x: np.ndarray, halo: dict[str, np.ndarray]) -> np.ndarray:
    """The rows of the whole matrix for this block times x; halo: the values of pixels outside."""
    out = s["diagonal"][:, None] * x
    np.subtract.at(out, s["row"], s["w"][:, None] * x[s["col"]])
    if len(s["out_row"]):
        k = np.searchsorted(halo["ids"], s["out_id"])
        np.subtract.at(out, s["out_row"], s["out_w"][:, None] * halo["z"][k])
    return out


STATE = "block long, system binary, state binary, sends array<struct<block:long,ids:binary>>, halo array<struct<block:long,data:binary>>"
DOTS = ", gamma array<double>, delta array<double>, rest array<double>"


def _kinds():
    import pyarrow as pa

    sends = pa.list_(pa.struct([("block", pa.int64()), ("ids", pa.binary())]))
    halo = pa.list_(pa.struct([("block", pa.int64()), ("data", pa.binary())]))
    return [pa.int64(), pa.binary(), pa.binary(), sends, halo]


NAMES = ["block", "system", "state", "sends", "halo"]


def _outgoing(system: dict, sends: list[dict], z: np.ndarray) -> list[dict]:
    """What each neighbour needs of z."""
    out = []
    for s in sends:
        ids = np.frombuffer(s["ids"], np.int64)
        out.append({"block": s["block"], "data": _pack(ids=ids, z=z[np.searchsorted(system["ids"], ids)])})
    return out


def _started(edges: DataFrame, labels: int) -> DataFrame:
    """The state of each block before the first step: x = 0, so the residual is the right-hand side."""

    def run(table):
        system, to = _block_of(table, labels)
        b = table.column("block")[0].as_py()
        if not len(system["ids"]):
            return _table([], NAMES, _kinds())
        r = system["right"]
        z = _solve(system, r)
        none = np.zeros_like(r)
        sends = [{"block": k, "ids": ids.astype(np.int64).tobytes()} for k, ids in to]
        return _table([(b, _pack(**system), _pack(x=none, r=r, z=z, p=none, s=none), sends, _outgoing(system, sends, z))], NAMES, _kinds())

    sides = edges.select("*", F.explode(F.array_distinct(F.array("bu", "bv"))).alias("block"))
    return sides.groupBy("block").applyInArrow(run, STATE)


def _multiplied(state: DataFrame) -> DataFrame:
    """state with w = A z and the blocks' dot products. Blocks get their neighbours' z in one shuffle."""

    def run(one, near):
        import pyarrow as pa

        b, packed, vectors, sends, _ = (one.column(c)[0].as_py() for c in NAMES)
        system, v = _unpack(packed), _unpack(vectors)
        got = [_unpack(d) for d in near.column("data").to_pylist()]
        ids = np.concatenate([g["ids"] for g in got]) if got else np.empty(0, np.int64)
        by = np.argsort(ids)
        halo = {"ids": ids[by], "z": np.concatenate([g["z"] for g in got])[by] if got else None}
        w = _times(system, v["z"], halo)
        dots = [(v["r"] * v["z"]).sum(axis=0), (w * v["z"]).sum(axis=0), (v["r"] ** 2).sum(axis=0)]
        return _table([(b, packed, _pack(**v, w=w), sends, [], *(d.tolist() for d in dots))], [*NAMES, "gamma", "delta", "rest"], [*_kinds(), *[pa.list_(pa.float64())] * 3])

    sent = state.select(F.explode("halo").alias("h")).select("h.block", "h.data")
    return state.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, STATE + DOTS)


def _stepped(state: DataFrame, alpha: np.ndarray, beta: np.ndarray) -> DataFrame:
    """One step along the search directions; no row moves."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                b, packed, vectors, sends, _ = (batch.column(batch.schema.get_field_index(c))[k].as_py() for c in NAMES)
                system, v = _unpack(packed), _unpack(vectors)
                p, s = v["z"] + beta * v["p"], v["w"] + beta * v["s"]
                r = v["r"] - alpha * s
                z = _solve(system, r)
                made = _pack(x=v["x"] + alpha * p, r=r, z=z, p=p, s=s)
                yield from _table([(b, packed, made, sends, _outgoing(system, sends, z))], NAMES, _kinds()).to_batches()

    return state.select(*NAMES).mapInArrow(run, STATE)


def random_walker(edges: DataFrame, seeds: DataFrame, block, tolerance: float = 1e-10) -> DataFrame:
    """(vec_id, label, probabilities) of every pixel with an edge, and of the seeds. edges: u, v, weight; seeds: vec_id,
    label from 1, the smallest where one is given twice; block: the Column of a pixel's block from its column name, of some
    thousand pixels at most. Done when the residual is below the tolerance, relative to the right-hand side, for each
    label."""
    seeds = materialize(seeds.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("label").cast("int").alias("label")), "walker-seeds")
    labels = seeds.agg(F.max("label")).first()[0] or 0
    every = edges.select(F.explode(F.array(F.col("u").cast("long"), F.col("v").cast("long"))).alias("vec_id")).union(seeds.select("vec_id")).distinct()
    one_hot = F.transform(F.sequence(F.lit(1), F.lit(max(labels, 1))), lambda k: (k == F.col("label")).cast("double"))
    fixed = seeds.select("vec_id", "label", one_hot.alias("probabilities"))
    none = F.array_repeat(F.lit(0.0), labels)
    if not labels:
        return every.select("vec_id", F.lit(0).alias("label"), none.alias("probabilities"))
    ends = edges.filter("weight > 0 and u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("weight").cast("double").alias("w"))
    ends = ends.join(seeds.select(F.col("vec_id").alias("u"), F.col("label").alias("lu")), "u", "left").join(seeds.select(F.col("vec_id").alias("v"), F.col("label").alias("lv")), "v", "left")
    ends = ends.filter("lu is null or lv is null").withColumn("bu", block("u").cast("long")).withColumn("bv", block("v").cast("long"))
    state = materialize(_started(ends, labels), "walker-state")
    before = alpha = None
    limit = None
    for _ in range(MAX_STEPS):
        state = materialize(_multiplied(state), "walker-product")
        sums = [F.array(*(F.sum(F.get(c, F.lit(k))) for k in range(labels))).alias(c) for c in ("gamma", "delta", "rest")]
        dots = state.agg(*sums).first()  # one row
        gamma, delta, rest = (np.array([x or 0.0 for x in d]) for d in dots)
        limit = rest * tolerance**2 if limit is None else limit
        if (rest <= limit).all():
            break
        on = (rest > limit) & (gamma > 0)
        beta = np.where(on, gamma / np.where(before > 0, before, 1.0), 0.0) if before is not None else np.zeros(labels)
        below = delta - (beta * gamma / np.where(alpha != 0, alpha, 1.0) if alpha is not None else 0.0)
        alpha = np.where(on, gamma / np.where(below != 0, below, 1.0), 0.0)
        before = gamma
        state = _stepped(state, alpha, beta)  # cheap, so it is done again for what goes to the neighbours
    else:
        raise RuntimeError(f"the residual is above the tolerance after {MAX_STEPS} steps")

    def found(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                ids = _unpack(batch.column(0)[k].as_py())["ids"]
                x = np.clip(_unpack(batch.column(1)[k].as_py())["x"], 0.0, 1.0)
                reached = x.sum(axis=1) > 0.5  # the labels' probabilities add up to 1, or to 0 out of reach
                x[~reached] = 0.0
                label = np.where(reached, x.argmax(axis=1) + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(label), pa.array(x.tolist(), pa.list_(pa.float64()))], ["vec_id", "label", "probabilities"])

    free = state.select("system", "state").mapInArrow(found, "vec_id long, label int, probabilities array<double>")
    known = materialize(free.unionByName(fixed), "walker-found")
    return every.join(known, "vec_id", "left").select("vec_id", F.coalesce("label", F.lit(0)).alias("label"), F.coalesce("probabilities", none).alias("probabilities"))

