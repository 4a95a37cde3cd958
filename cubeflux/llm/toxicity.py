"""Toxicity by compression distance: one zstandard dictionary trained on toxic text, one on ordinary text.

A window is WIDTH consecutive bytes of the lower-cased text, one every STRIDE bytes and at its end, so every byte of every
text is in one and a run of up to WIDTH - STRIDE + 1 bytes lies whole in one. Its distance is its compressed length with
the ordinary dictionary less that with the toxic one.

Fit, on a bounded sample of labelled rows (at most ``sample`` toxic and ORDINARY times as many ordinary documents, and
WINDOWS windows of each, all chosen by hashes): zstandard's trainer makes a dictionary of ordinary windows, the base of
both. Each side adds a dictionary trained on its own text: first on any of its windows, then, ROUNDS times, on those of
its windows whose distance speaks most for it. What both kinds of text share is thus in both, and only what they don't
share makes a difference in length. Documents are described by how many of their windows pass each threshold in CUTS,
their largest distance and their number of windows; a logistic model calibrates these into the score. The dictionaries
learn from two thirds of the sample and the model from the other third, so no document calibrates its own text.

Defined cases: null or empty text has no windows and gets the calibrated score of such a document; no label-1 or no
label-0 row in either part of the sample gives every document the training rate (0 if there is none); a null doc_id is
never learnt from; repeated rows score equally; ties at the sample's bound are broken by hash and id; very long texts
have many windows; labels without a document are ignored, and of several labels of a doc_id the largest counts; an empty
table gives no rows; extra columns stay, and one that is named score or predicted is renamed with the ending ``_input``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, set_aside, trim

#: Labelled documents to fit on: at most SAMPLE toxic and ORDINARY times as many ordinary ones; and windows of each kind.
SAMPLE, ORDINARY, WINDOWS = 4000, 3, 80_000
WIDTH, STRIDE = 48, 20
#: Bytes of the common dictionary and of each side's own, and rounds of training of the latter.
BASE, OWN, ROUNDS = 131072, 1024, 6
#: Distances at which windows are counted.
CUTS = (2, 3, 4, 5, 6, 8)


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: tuple[float, ...] = ()
    rate: float = 0.0


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def windows(text: str | None) -> list[bytes]:
    data = (text or "").lower().encode()
    if len(data) <= WIDTH:
        return [data] if data else []
    last = len(data) - WIDTH
    return [data[k : k + WIDTH] for k in (*range(0, last, STRIDE), last)]


class Scorer:
    def __init__(self, model: Model):
        import zstandard as z

        self.model = model
        params = z.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, search_log=4, min_match=3, target_length=32, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS)
        self.pair = []
        for content in (model.ordinary, model.toxic):
            if content:
                d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                self.pair.append(z.ZstdCompressor(compression_params=params, dict_data=d).compress)

    def distances(self, pieces: list[bytes]) -> np.ndarray:
        ordinary, toxic = self.pair
        return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in pieces), np.int64, len(pieces))

    def features(self, text: str | None) -> list[float]:
        pieces = windows(text)
        if len(self.pair) < 2 or not pieces:
            return [0.0] * (len(CUTS) + 2)
        d = self.distances(pieces)
        counts = [float(np.log1p((d >= c).sum())) for c in CUTS]
        return [*counts, float(max(0, d.max())), float(np.log1p(len(pieces)))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.model.weights:
            return np.full(len(texts), self.model.rate)
        x = np.array([self.features(t) for t in texts], float).reshape(-1, len(CUTS) + 2)
        w = np.array(self.model.weights)
        return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge; the first weight is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def trained(size: int, pieces: list[bytes], **how: int) -> bytes:
    """Content of a dictionary of at most so many bytes."""
    import zstandard as z

    try:
        return z.train_dictionary(size + 400, pieces, **how).as_bytes()[-size:]  # without its entropy tables
    except z.ZstdError:  # too little text for zstandard's trainer: the text itself is the dictionary
        return b"".join(pieces)[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """Both dictionaries, from windows of either kind of text."""
    base = trained(BASE, ordinary)
    own_toxic, own_ordinary = toxic, ordinary
    for k in range(ROUNDS + 1):
        t, o = (trained(OWN, x, k=16, d=6) for x in (own_toxic, own_ordinary))  # segments of 16 bytes
        n = min(len(t), len(o))
        model = Model(toxic=t[-n:] + base, ordinary=o[-n:] + base)
        if k == ROUNDS:
            return model
        scorer = Scorer(model)
        dt, do = scorer.distances(toxic), scorer.distances(ordinary)
        most = max(100, len(toxic) // 50)
        own_toxic = [toxic[i] for i in np.argsort(-dt, kind="stable")[:most]]
        most = max(100, len(ordinary) // 50)
        own_ordinary = [ordinary[i] for i in np.argsort(do, kind="stable")[:most]] + [ordinary[i] for i in np.argsort(-do, kind="stable")[:most]]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the rows of documents with a label that aren't held out."""
    import random

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    plain = Model(rate=n1 / (n0 + n1) if n0 + n1 else 0.0)
    if not n1 or not n0:
        return plain
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = known.filter("toxic = 1").orderBy(*order).limit(sample).union(known.filter("toxic = 0").orderBy(*order).limit(ORDINARY * sample))
    chosen = materialize(chosen, "toxicity-sample")
    # at most (1 + ORDINARY) * sample ids, so they may go to every task
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # copies of a text count once and stay together, else what they repeat looks like a habit of their kind
    train = materialize(train.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(3))), "toxicity-train")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = list(set(windows(text)))
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(mine), pa.int32()), pa.array(mine, pa.binary())], ["toxic", "piece"])

    pieces = train.filter("part > 0").select("toxic", "text").mapInArrow(cut, "toxic int, piece binary").distinct()
    pieces = materialize(pieces.withColumn("at", F.xxhash64("piece")), "toxicity-windows")
    side = []
    for y in (1, 0):
        got = [bytes(r.piece) for r in pieces.filter(F.col("toxic") == y).orderBy("at", "piece").limit(WINDOWS).select("piece").collect()]  # WINDOWS * WIDTH bytes
        random.Random(y).shuffle(got)
        side.append(got)
    if not side[0] or not side[1]:
        return plain
    model = dictionaries(*side)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def described(batches):
        import pyarrow as pa

        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(shared.value)
            x = [scorer.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    rows = train.filter("part = 0").select("toxic", "text").mapInArrow(described, "toxic int, x array<double>").collect()  # a third of the sample
    x, y = np.array([r.x for r in rows]), np.array([float(r.toxic) for r in rows])
    k1, k0 = y.sum(), len(y) - y.sum()
    if not k1 or not k0:
        return plain
    w = logistic(x, y)
    # the classes were sampled at different rates: put the constant right
    w[0] += np.log(n1 / n0) - np.log(k1 / k0)
    model.weights, model.rate = tuple(float(v) for v in w), plain.rate
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of docs and score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size and nine weights
    rows = set_aside(docs, "score", "predicted")

    def run(batches):
        import pyarrow as pa

        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(shared.value)
            at = batch.schema.get_field_index("text")
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                s = scorer.scores(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*part.schema.names, "score", "predicted"])
            trim()

    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(rows, fit(docs, labels), threshold)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
