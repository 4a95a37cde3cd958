"""What the third round's findings changed in the training-data operators."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from cubeflux.llm import bm25, common, fasttok, packing
from cubeflux.llm.queries import BYTE_BPE, WORD_BPE, tokenizer_path


def test_a_process_keeps_its_encoder_and_knows_words_once():
    path = tokenizer_path(BYTE_BPE)
    e = fasttok.encoder(path)
    assert fasttok.encoder(path) is e
    texts = [" zorvath zorvath. zorvath, zorvath! zorvath7 (zorvath)", "it's zorvath's 'zorvath' \x1fzorvath zorvaté1", "", "\t zorvath\n"]
    fresh = fasttok.ChunkEncoder(path)
    ids, offs = fresh.encode(pa.array(texts[:1]))
    assert sum(b"zorvath" in c for c in fresh.chunks) == 2  # with and without a blank, whatever sign follows
    ids, offs = fresh.encode(pa.array(texts))
    tok = Tokenizer.from_file(path)
    for k, text in enumerate(texts):
        assert ids[offs[k] : offs[k + 1]].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_a_task_finds_a_blocks_words_once(spark, tmp_path):
    """Query files come with their different words, which every shard then looks up once, with the same results."""
    rows = [(i, f"common word{i % 5} rare{i // 2} other{i % 40}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = bm25.query_files(docs, bm25.statistics(docs), 200, tmp_path.as_uri())
    shard = bm25.Shard(np.arange(200), pa.array([t for _, t in rows]), 4.0)
    for qid, word, idf, known in bm25._Queries(tmp_path.as_uri(), names).blocks():
        assert (known[0][known[1]] == word).all() and (np.diff(known[0].astype(object)) > 0).all()
        floor = np.zeros(len(set(qid.tolist())))
        for a, b in zip(shard.search(qid, word, idf, 10, floor, True), shard.search(qid, word, idf, 10, floor, True, known), strict=True):
            assert (a == b).all()


def test_a_worker_gives_freed_memory_back():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    some = [bytes(60_000) for _ in range(3000)]  # too small to be mapped on their own
    del some[::2]
    last = bytes(60_000)
    full = held()
    del some[:-1]
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"])], ["text"])
    assert len(list(common.by_bytes(batch, 0))) == 1
    assert held() < full - (60 << 20) and len(last) == 60_000


def test_packing_encodes_a_bounded_slice_at_a_time(monkeypatch):
    """Encoding takes many times its text's memory, and a batch has as many texts as Spark gives it."""
    path, seen, plain = tokenizer_path(WORD_BPE), [], fasttok.ChunkEncoder.encode
    monkeypatch.setattr(fasttok.ChunkEncoder, "encode", lambda self, col: (seen.append(col.nbytes), plain(self, col))[1])
    texts = [f"some words of row {i} " * (1 + i % 900) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["doc_id", "text"])
    out = pa.Table.from_batches(packing.cut_batches(iter([batch]), 0, path, 1, 4096))
    assert sum(seen) > 2 * packing.SLICE and max(seen) < 1.1 * packing.SLICE
    total = np.bincount(out.column("doc_id").to_numpy(), weights=out.column("length").to_numpy())
    tok = Tokenizer.from_file(path)
    assert [len(tok.encode(texts[i], add_special_tokens=False).ids) + 1 for i in range(0, 2000, 97)] == total[::97].tolist()
    length, k = (out.column(c).to_numpy() for c in ("length", "k"))
    assert all(sorted(k[length == n]) == list(range((length == n).sum())) for n in np.unique(length))


def test_the_pipelines_packing_is_slim_and_gives_the_same_pieces(monkeypatch):
    """Packing is the pipeline's last stage: its workers encoded as much at a time as where they hold nothing else."""
    import corpus_pipeline

    asked = {}
    monkeypatch.setattr(packing, "pack", lambda docs, tokenizer, **more: asked.update(more))
    corpus_pipeline.pack_sequences(None, None, "")
    assert asked == {"slim": True}
    path, seen, plain = tokenizer_path(WORD_BPE), [], fasttok.ChunkEncoder.encode
    texts = [f"some words of row {i} " * (1 + i % 300) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["doc_id", "text"])
    want = pa.Table.from_batches(packing.cut_batches(iter([batch]), 0, path, 1, 4096)).to_pydict()
    monkeypatch.setattr(fasttok.ChunkEncoder, "encode", lambda self, col: (seen.append(col.nbytes), plain(self, col))[1])
    got = pa.Table.from_batches(packing.cut_batches(iter([batch]), 0, path, 1, 4096, True)).to_pydict()
    assert max(seen) < 1.1 * packing.SLIM[0] and fasttok._ENCODERS[path].limit == packing.SLIM[1]
    fields = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert all(got[c] == want[c] for c in fields)
    for out in (got, want):  # ranks of equal lengths go by order of arrival, which slices don't change
        out["ranks"] = sorted(zip(out["length"], out["k"], strict=True))
    assert got["ranks"] == want["ranks"]
