"""Benchmark decontamination by a positional inverted index of the training text.

``build`` dealt over all tasks: a segment is some whole documents, SEGMENT_BYTES of text or one longer document. Its words
are sorted into a term dictionary and, for each term, the ascending positions where it stands; a gap between documents
keeps phrases from running across them. Segments are stored in the shared folder, a file for each task; what travels is a
row for each segment. Every word of every document is indexed.

``phrases`` sends each segment, wherever it lies, the test phrases in blocks. A phrase starts from the list of its rarest
term in that segment: those positions less the term's offset in the phrase are candidates, which the lists of the other
terms, rarest first and moved by their offsets, cut down by binary search; a phrase with a term that the segment lacks ends at
once. What is left are all exact occurrences. ``near`` finds, from the same lists, the shortest stretches of at most so
many words that hold all of a query's words in any order.

Memory: a task holds one segment and one block of phrases; no document, item or phrase is left out, and nothing of the
corpus goes to the driver but one row a partition. A block's terms are looked up by hash and then compared byte for byte, so an
answer isn't a matter of hashes, unless two words of one segment share 64 bits. A lost executor costs the segments it was at.

Words: A-Z is lower-cased, then runs of ASCII letters, digits and characters past ASCII. A test phrase is a window of
``words`` consecutive words of an item; an item of fewer, but not none, is one phrase.

Defined cases: null texts have no words; an item without words is in no document; rows are judged one by one, so repeated
rows and ids come back as often as they are given; a null doc_id comes back null, a null item_id reads ``null`` in lists of ids;
rows that share an item_id are one item with the phrases of all; a phrase in several items counts for each; very long texts are whole;
an empty table of documents gives no rows, an empty benchmark hits nothing; no other columns are read.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, by_bytes, column_bytes, lower_ascii, materialize, part_count, ranges, shared_dir, word_hashes

SEGMENT_BYTES = 8 << 20
#: Phrases of a block, and words of a file of items.
BLOCK_WORDS = 1 << 17
SEGMENTS = "file string, at long, size long"
#: ASCII bytes that words hold once lower-cased; all others past ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased texts and the index of each text's first word; none spans two texts."""
    solid = np.zeros(len(buf) + 2, bool)
    solid[1:-1] = _WORD[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    starts = starts[starts < len(buf)]
    return starts, ends, np.searchsorted(starts, offs)


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _dictionary(hashes: np.ndarray, first: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Terms by hash with their bytes; first: a word that holds each."""
    lens = (ends - starts)[first]
    return {"terms": hashes, "bytes": buf[ranges(starts[first], lens)], "upto": np.append(0, np.cumsum(lens))}


def index(ids: np.ndarray, known: np.ndarray, texts) -> dict[str, np.ndarray]:
    """The positional inverted index of a segment: ``terms`` (hashes, ascending) with ``bytes`` and ``upto``, ``lists``
    (where each term's positions start) and ``positions``; ``docs`` is where each document's positions start. A document's
    last position is the gap after it."""
    raw, offs = column_bytes(texts)
    buf = lower_ascii(raw)
    starts, ends, first = words_of(buf, offs)
    count = np.diff(first)
    docs = np.append(0, np.cumsum(count + 1))
    at = ranges(docs[:-1], count).astype(np.uint32 if docs[-1] < 1 << 32 else np.uint64)
    h = word_hashes(buf, starts, ends)
    by = np.argsort(h, kind="stable")  # positions stay ascending in each list
    sorted_h = h[by]
    new = np.flatnonzero(np.append(True, sorted_h[1:] != sorted_h[:-1])) if len(h) else np.empty(0, np.int64)
    terms = _dictionary(sorted_h[new], by[new], buf, starts, ends)
    return {"ids": ids, "known": known, "docs": docs, "lists": np.append(new, len(h)).astype(np.int64), "positions": at[by], **terms}


def build(docs: DataFrame, folder: str) -> DataFrame:
    """Write the index of docs(doc_id, text); a row for each segment."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name, at = f"index-{TaskContext.get().partitionId():06d}.bin", 0
        rows: list[tuple[int, int]] = []
        held, size = [], 0

        def flush(f):
            nonlocal at
            t = pa.Table.from_batches(held)
            ids = t.column(0).combine_chunks()
            data = _pack(**index(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), t.column(1)))
            f.write(data)
            rows.append((at, len(data)))
            at += len(data)

        with Store(folder).writer(name) as f:
            for batch in batches:
                for part in by_bytes(batch, 1, SEGMENT_BYTES // 8):
                    held.append(part)
                    size += part.nbytes
                    if size >= SEGMENT_BYTES:
                        flush(f)
                        held, size = [], 0
            if held:
                flush(f)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([a for a, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], ["file", "at", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, SEGMENTS), "index-segments")


def query_files(items: DataFrame, folder: str) -> list[str]:
    """Write the words of items(id string, text) in files of whole items, some BLOCK_WORDS words each; their names."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        k = 0
        for batch in batches:
            for part in by_bytes(batch, 1, 4 * BLOCK_WORDS):
                raw, offs = column_bytes(part.column(1))
                buf = lower_ascii(raw)
                starts, ends, first = words_of(buf, offs)
                h = word_hashes(buf, starts, ends)
                terms, one, word = np.unique(h, return_index=True, return_inverse=True)
                name = f"items-{TaskContext.get().partitionId():06d}-{k}.npz"
                k += 1
                ids = [x or "null" for x in part.column(0).to_pylist()]
                with Store(folder).writer(name) as f:
                    f.write(_pack(ids=np.array(ids, dtype=np.str_), first=first, word=word.astype(np.int64), **_dictionary(terms, one, buf, starts, ends)))
                yield pa.RecordBatch.from_pydict({"file": [name]})

    made = items.select(F.col("id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "file string")
    return sorted(r.file for r in made.collect())  # a name for each file


class Segment:
    """A stored segment and its searches. Queries are blocks as ``query_files`` writes them."""

    def __init__(self, data: bytes):
        z = _unpack(data)
        self.ids, self.known, self.docs = z["ids"], z["known"], z["docs"]
        self.terms, self.bytes, self.upto = z["terms"], z["bytes"], z["upto"]
        self.lists, self.positions = z["lists"], z["positions"]
        self.length = int(self.docs[-1])
        # one ascending array for all lists, so that one binary search asks many lists at once
        self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.lists)) * self.length + self.positions.astype(np.int64)

    def numbers(self, block: dict[str, np.ndarray]) -> np.ndarray:
        """The segment's term for each term of a block, -1 if it has none."""
        if not len(self.terms):
            return np.full(len(block["terms"]), -1)
        at = np.minimum(np.searchsorted(self.terms, block["terms"]), len(self.terms) - 1)
        found = np.flatnonzero(self.terms[at] == block["terms"])
        out = np.full(len(at), -1)
        mine, theirs = self.bytes.tobytes(), block["bytes"].tobytes()
        for i, k in zip(found.tolist(), at[found].tolist(), strict=True):
            if mine[self.upto[k] : self.upto[k + 1]] == theirs[block["upto"][i] : block["upto"][i + 1]]:
                out[i] = k
        return out

    def sizes(self, term: np.ndarray) -> np.ndarray:
        return np.where(term < 0, 0, self.lists[term + 1] - self.lists[term])

    def holds(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a term stands at a position."""
        ok = at < self.length
        key = term * self.length + at
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return ok & (self.keys[k] == key)

    def phrases(self, word: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every occurrence of phrases of so many words; word: the segment's terms, start: where in
        it each phrase starts."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(start) or not len(self.keys):
            return none
        term = word[start[:, None] + np.arange(length)]
        size = self.sizes(term)
        alive = np.flatnonzero(size.min(axis=1) > 0)
        if not len(alive):
            return none
        order = np.argsort(size[alive], axis=1, kind="stable")  # rarest first
        term = term[alive]
        row = np.arange(len(alive))
        rare = term[row, order[:, 0]]
        n = self.lists[rare + 1] - self.lists[rare]
        who = np.repeat(row, n)
        at = self.positions[ranges(self.lists[rare], n)].astype(np.int64) - order[who, 0]
        keep = at >= 0
        who, at = who[keep], at[keep]
        for k in range(1, length):
            offset = order[who, k]
            keep = self.holds(term[who, offset], at + offset)
            who, at = who[keep], at[keep]
        return alive[who], at

    def near(self, term: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the shortest stretches of at most ``within`` words of one document that hold all of these
        terms: those in which no shorter one lies."""
        term = np.unique(term)
        size = self.sizes(term)
        if not len(term) or size.min() == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lists = [self.positions[self.lists[t] : self.lists[t + 1]].astype(np.int64) for t in term[np.argsort(size)]]
        rare = lists[0]
        start = np.unique(np.concatenate(lists))
        close = np.minimum(np.searchsorted(rare, start), len(rare) - 1)  # the rarest term's next place
        start = start[(rare[close] >= start) & (rare[close] < start + within)]
        end = start.copy()
        for places in lists:
            k = np.searchsorted(places, start)
            inside = k < len(places)
            start, end, k = start[inside], end[inside], k[inside]
            end = np.maximum(end, places[k])
            keep = end < start + within
            start, end = start[keep], end[keep]
        keep = np.searchsorted(self.docs, start, side="right") == np.searchsorted(self.docs, end, side="right")
        start, end = start[keep], end[keep]
        last = np.append(end[1:] != end[:-1], True)[: len(end)]  # of those that end alike the last is the shortest
        return start[last], end[last]


def windows(block: dict[str, np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first word and length of each phrase of a block's items."""
    n = np.diff(block["first"])
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    item = np.repeat(np.arange(len(n)), count)
    return item, ranges(block["first"][:-1], count), np.minimum(n, words)[item]


class _Blocks:
    """The query files; they are read again for each segment but for the first, which are kept up to a bound."""

    KEPT = 64 << 20

    def __init__(self, folder: str, names: list[str]):
        self.store, self.names, self.kept, self.size = Store(folder), names, {}, 0

    def __iter__(self):
        for name in self.names:
            got = self.kept.get(name)
            if got is None:
                data = self.store.read(name)
                got = _unpack(data)
                if self.size + len(data) <= self.KEPT:
                    self.kept[name] = got
                    self.size += len(data)
            yield got


def _segments(found: DataFrame) -> DataFrame:
    """The rows of segments, dealt to all tasks."""
    return found.repartition(part_count(found.sparkSession), "file", "at")


def phrase_matches(segments: DataFrame, folder: str, names: list[str], words: int) -> DataFrame:
    """doc_id, n_words, n_hit and items (the ids, sorted as strings, of the items found) of each document."""

    def run(batches):
        import pyarrow as pa

        store, blocks = Store(folder), _Blocks(folder, names)
        for batch in batches:
            for name, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seg = Segment(store.read(name, at, size))
                turn = np.zeros(seg.length + 1, np.int64)  # +1 where an occurrence starts, -1 after its end
                found: list[set[str]] = [set() for _ in range(len(seg.ids))]
                for block in blocks:
                    word = seg.numbers(block)[block["word"]]
                    item, start, length = windows(block, words)
                    for n in np.unique(length).tolist():
                        own = np.flatnonzero(length == n)
                        who, where = seg.phrases(word, start[own], n)
                        np.add.at(turn, where, 1)
                        np.add.at(turn, where + n, -1)
                        doc = np.searchsorted(seg.docs, where, side="right") - 1
                        pairs = np.unique(doc * len(block["ids"]) + item[own][who])
                        for p in pairs.tolist():
                            found[p // len(block["ids"])].add(str(block["ids"][p % len(block["ids"])]))
                hit = np.append(0, np.cumsum(np.cumsum(turn[:-1]) > 0))
                n_words = np.diff(seg.docs) - 1
                lists = [sorted(x) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(seg.ids, pa.int64(), mask=~seg.known), pa.array(n_words), pa.array(hit[seg.docs[1:]] - hit[seg.docs[:-1]]), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])

    return _segments(segments).mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>")


def near_matches(segments: DataFrame, folder: str, names: list[str], within: int) -> DataFrame:
    """doc_id, id, start and end (words of the document, from 0) of each shortest stretch of at most ``within`` words that
    holds all words of a query."""

    def run(batches):
        import pyarrow as pa

        store, blocks = Store(folder), _Blocks(folder, names)
        for batch in batches:
            for name, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seg = Segment(store.read(name, at, size))
                for block in blocks:
                    word = seg.numbers(block)[block["word"]]
                    first = block["first"]
                    for k, i in enumerate(block["ids"].tolist()):
                        start, end = seg.near(word[first[k] : first[k + 1]], within)
                        doc = np.searchsorted(seg.docs, start, side="right") - 1
                        yield pa.RecordBatch.from_arrays([pa.array(seg.ids[doc], pa.int64(), mask=~seg.known[doc]), pa.array([i] * len(doc), pa.string()), pa.array(start - seg.docs[doc]), pa.array(end - seg.docs[doc])], ["doc_id", "id", "start", "end"])

    return _segments(segments).mapInArrow(run, "doc_id long, id string, start long, end long")


def proximity(docs: DataFrame, queries: DataFrame, within: int = 20) -> DataFrame:
    """Proximity matches of queries(id, text) in docs(doc_id, text)."""
    folder = shared_dir(docs.sparkSession, "index")
    return near_matches(build(docs, folder), folder, query_files(queries, folder), within)


def sha256(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items of each document."""
    folder = shared_dir(docs.sparkSession, "index")
    names = query_files(benchmark.select(F.col("item_id").alias("id"), "text"), folder)
    found = phrase_matches(build(docs, folder), folder, names, words)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def oracle_sql(words: int = 10) -> str:
    """The same by comparing the texts, each word between separators, with each window."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as (select row_number() over () as row_no, doc_id, {split} as w from documents),
b as (select coalesce(item_id::varchar, 'null') as item, {split} as w from benchmark),
v as (select distinct item, array_to_string(w[k:least(k + {words} - 1, len(w))], ' ') as phrase, least(len(w), {words}) as n
    from (select item, w, unnest(range(1, greatest(len(w) - {words} + 1, 1) + 1)) as k from b where len(w) > 0)),
sizes as (select distinct n from v),
g as (select row_no, n, k, array_to_string(w[k:k + n - 1], ' ') as phrase from (select row_no, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)),
m as (select row_no, k, g.n, item from g join v on v.n = g.n and v.phrase = g.phrase),
h as (select row_no, count(distinct p) as n_hit from (select row_no, unnest(range(k, k + n)) as p from m) group by row_no),
i as (select row_no, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by row_no)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (row_no) left join i using (row_no)"""
