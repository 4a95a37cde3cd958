"""Line deduplication by an exact set-similarity join.

A line is the set of its words. A line goes if an earlier line, in the order of (doc_id, line number), has a Jaccard
similarity of at least ``num``/100; lines with equal sets are one class, so copies never form pairs.

1. Words are ordered by rarity: a sketch of fixed size counts them, and equal counts are ordered by hash. Any one order
   gives the same result; a truer one only makes shorter posting lists.
2. A line's words are put in that order. Its prefix goes to an inverted index with position, size and a 64-bit parity bitmap of
   its words; equal lines of a slice of the corpus go there once.
3. In a posting list, pairs pass the length, positional and bitmap filters (a bit is the parity of the words that hash to
   it, so two sets differ in at least as many words as bits); none loses a true pair. The rows of a list
   lie in the order of their documents. A row reports at most CAP partners of a list, the earliest, and says so if there may be
   more; lists over BLOCK rows are cut into blocks, each compared with the list's earliest block only, and their rows
   say so too.
4. Candidates are verified on their full sets of word hashes (64 bits). One verified pair settles a class: its earliest
   candidate is tried first, then its others.
5. Classes with more candidates than were reported, and not settled, are compared with every earlier class, block by
   block. So nothing is dropped, and a group of copies makes pairs in proportion to its size, not to its square.

Defined cases: null text is an empty text of one empty line; lines without words are never removed; rows that share a
doc_id are told apart by their text, and equal rows are treated alike; a null doc_id comes last; very long lines are
sets like any other; extra columns stay as they are, and one that is named as a result column is renamed with the ending
``_input``; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GOLDEN, by_bytes, column_bytes, is_member, lower_ascii, materialize, member_bits, mix64, ranges, release, set_aside, trim, word_hashes, word_spans

#: Slots of the sketch of word counts.
SLOTS = 1 << 21
#: Rows of a posting list that are compared with each other in one task.
BLOCK = 20_000
#: Partners that a row reports from one posting list.
CAP = 24
#: Parts of the index that are made and compared one after the other.
ROUNDS = 2
#: Rows of lists that are compared at once.
_CHUNK = 20_000
#: Lists of more rows are compared row by row.
_SMALL = 256
#: Lines of at most so many words have bitmaps of 64 bits, others of 128.
_NARROW = 32
#: Classes and early lines with more than a SHARE-th of all rows are joined by broadcast: there are at most SHARE of them.
SHARE = 10_000
_LAST = 2**63 - 1
_ORDER, _N, _POS = 18, 24, 20  # bits of a packed posting: order of the document, size, position; bit 62 marks leaders


def line_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number within the row, first byte and end of each line (without its break)."""
    breaks = np.flatnonzero(buf == 10)
    upto = np.searchsorted(breaks, offs)
    per = np.diff(upto) + 1  # a row of k line breaks has k + 1 lines
    row = np.repeat(np.arange(len(per)), per)
    line = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start, end = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    head = line == 0
    start[head], start[~head] = offs[:-1], breaks + 1
    last = np.append(head[1:], True) if len(row) else head
    end[last], end[~last] = offs[1:], breaks
    return row, line, start, end


class Sets:
    """The sets of words of pieces of text: hashes ``h`` of piece after piece, ``n`` of each, beginning at ``first``,
    ordered by the words' level and hash; ``k1`` and ``k2`` identify a set."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, levels: np.ndarray | None = None):
        starts, ends, _ = word_spans(buf, np.append(start, len(buf)))
        h = word_hashes(buf, starts, ends)
        of = np.searchsorted(start, starts, side="right") - 1
        level = np.zeros(len(h), np.uint64) if levels is None else levels[(h & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64)
        bits = max(1, int(len(start)).bit_length())
        key = of.astype(np.uint64) << np.uint64(64 - bits) | level << np.uint64(56 - bits) | h >> np.uint64(bits + 8)
        order = np.argsort(key)
        key, h, of = key[order], h[order], of[order]
        same = key[1:] == key[:-1]
        if (same & (h[1:] != h[:-1])).any():  # two words that agree in the part of their hash that was sorted by
            order = np.lexsort((h, level[order], of))
            h, of = h[order], of[order]
            same = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        keep = np.append(True, ~same) if len(h) else np.zeros(0, bool)
        self.h, of = h[keep], of[keep]
        self.n = np.bincount(of, minlength=len(start)).astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        some = np.flatnonzero(self.n)
        self.k1, self.k2 = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        if len(some):
            self.k1[some] = np.add.reduceat(mix64(self.h + np.uint64(1)), self.first[some])
            self.k2[some] = np.bitwise_xor.reduceat(mix64(self.h * GOLDEN + np.uint64(7)), self.first[some])


def word_levels(docs: DataFrame) -> np.ndarray:
    """The level (a logarithm of the count) of each slot of a sketch of the words of all documents."""

    def run(batches):
        import pyarrow as pa

        count = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in by_bytes(batch, 0):
                buf, offs = column_bytes(part.column(0))
                buf = lower_ascii(buf)
                starts, ends, _ = word_spans(buf, offs)
                count += np.bincount((word_hashes(buf, starts, ends) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(count)
        for lo in range(0, len(some), 1 << 16):
            at = some[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], ["slot", "n"])

    counted = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = counted.select("slot", F.least(F.floor(F.log2("n") * 4), F.lit(255)).cast("short").alias("level")).toArrow()  # at most SLOTS rows
    levels = np.zeros(SLOTS, np.uint8)
    levels[got.column("slot").to_numpy()] = got.column("level").to_numpy()
    return levels


def place_key(doc: np.ndarray, rk: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of a line's place, the same wherever it is computed."""
    return mix64(mix64(doc.view(np.uint64) + GOLDEN) ^ mix64(rk.view(np.uint64) * GOLDEN + line.astype(np.uint64)))


def lines_of(docs: DataFrame, levels, num: int, low: float, high: float) -> DataFrame:
    """A row per line: doc_id, rk, line, n, k1, k2 and, once per slice for each class, packed (order, size), bits, the
    words of its prefix and how many of them, at its end, may have lists over BLOCK rows (``often``)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in by_bytes(batch, 2):
                buf, offs = column_bytes(part.column(2))
                buf = lower_ascii(buf)
                row, line, start, _ = line_bounds(buf, offs)
                s = Sets(buf, start, levels.value)
                # sets that only an equal set can match need no postings
                able = (s.n > 0) & ((100 * s.n >= num * (s.n + 1)) | (-(-2 * num * s.n // (100 + num)) < s.n))
                _, once = np.unique(s.k1[able], return_index=True)
                pick = np.sort(np.flatnonzero(able)[once])
                n = s.n[pick]
                p = n + (-num * n // 100) + 1  # n - ceil(num * n / 100) + 1
                size = np.zeros(len(row), np.int64)
                size[pick] = p
                upto = np.zeros(len(row) + 1, np.int32)
                np.cumsum(size, out=upto[1:])
                bits = np.zeros((2, len(row)), np.uint64)
                if len(pick):
                    where = mix64(s.h[ranges(s.first[pick], n)]) >> np.uint64(57)
                    one, half = np.uint64(1) << (where & np.uint64(63)), where >> np.uint64(6)
                    for k in range(2):
                        bits[k, pick] = np.bitwise_xor.reduceat(np.where(half == k, one, np.uint64(0)), np.cumsum(n) - n)
                    fold = pick[n <= _NARROW]
                    bits[0, fold] ^= bits[1, fold]
                    bits[1, fold] = 0
                ids = part.column(0)
                doc = ids.fill_null(_LAST).to_numpy()
                order = np.clip((doc.astype(np.float64) - low) / max(1.0, high - low) * ((1 << _ORDER) - 1), 0, (1 << _ORDER) - 1).astype(np.int64)
                packed = order[row] << (_N + _POS) | np.minimum(s.n, (1 << _N) - 1) << _POS
                prefix = s.h[ranges(s.first[pick], p)]
                long_lists = levels.value[(prefix & np.uint64(SLOTS - 1)).astype(np.int64)] >= np.floor(4 * np.log2(BLOCK))
                often = np.zeros(len(row), np.int32)
                often[pick] = np.bincount(np.repeat(np.arange(len(pick)), p), weights=long_lists, minlength=len(pick)).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(upto), pa.array(prefix.view(np.int64)))
                take = pa.array(row)
                cols = [ids.take(take), part.column(1).take(take), *(pa.array(x) for x in (line.astype(np.int32), np.minimum(s.n, 2**31 - 1).astype(np.int32), s.k1.view(np.int64), s.k2.view(np.int64), packed, *bits.view(np.int64), often)), words]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rk", "line", "n", "k1", "k2", "packed", "bits", "bits2", "often", "prefix"])

    return docs.select("doc_id", "rk", "text").mapInArrow(run, "doc_id long, rk long, line int, n int, k1 long, k2 long, packed long, bits long, bits2 long, often int, prefix array<long>")


def postings(lines: DataFrame) -> DataFrame:
    """(key, packed, bits, bits2, k1) of every prefix word; packed gets the word's position."""
    word = lines.filter(F.size("prefix") > 0).select("k1", "packed", "bits", "bits2", F.posexplode("prefix").alias("pos", "key"))
    return word.select("key", F.col("packed").bitwiseOR(F.least("pos", F.lit((1 << _POS) - 1)).cast("long")).alias("packed"), "bits", "bits2", "k1")


class _List:
    """Rows of posting lists, as arrays."""

    def __init__(self, packed, bits, bits2, k1):
        self.order, self.n, self.pos = packed >> (_N + _POS), packed >> _POS & ((1 << _N) - 1), packed & ((1 << _POS) - 1)
        self.low, self.high, self.k1 = bits.view(np.uint64), bits2.view(np.uint64), k1
        self.short = self.n <= _NARROW

    def similar(self, i, j, num: int) -> np.ndarray:
        """Where (in j) rows i, one or as many as j, and j pass all filters, the cheap ones first."""
        a, b = self.n[i], self.n[j]
        at = np.flatnonzero((100 * np.minimum(a, b) >= num * np.maximum(a, b)) & (self.k1[i] != self.k1[j]))
        one = np.ndim(i) == 0
        j = j[at]
        i = np.broadcast_to(i, len(j)) if one else i[at]
        low, high = self.low[i] ^ self.low[j], self.high[i] ^ self.high[j]
        wide = np.bitwise_count(low).astype(np.int64) + np.bitwise_count(high)
        a, b = self.n[i], self.n[j]
        need = -(-num * (a + b) // (100 + num))
        differ = np.where(self.short[i] | self.short[j], np.bitwise_count(low ^ high), wide)
        ok = (differ <= a + b - 2 * need) & (np.minimum(a - self.pos[i], b - self.pos[j]) >= need)
        return at[ok]


def near_rows(key, rows: _List, num: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of short lists, one after the other, that pass the filters."""
    first, second, live, d = [], [], np.arange(max(0, len(key) - 1)), 1
    while len(live):
        live = live[live + d < len(key)]
        live = live[key[live] == key[live + d]]
        hit = live[rows.similar(live, live + d, num)]
        first.append(hit)
        second.append(hit + d)
        d += 1
    return (np.concatenate(first), np.concatenate(second)) if first else (np.empty(0, np.int64), np.empty(0, np.int64))


def near_rows_of_long(rows: _List, num: int, leaders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one long list; each row has at most CAP partners, the earliest. Only the first ``leaders`` rows
    are partners. And the rows with perhaps more."""
    m, first, second = len(rows.k1), [], []
    left, live = np.full(m, CAP), np.arange(m)
    full = np.zeros(m, bool)
    for i in range(min(leaders, m)):
        live = live[np.searchsorted(live, i, side="right") :]
        if not len(live):
            break
        hit = live[rows.similar(i, live, num)]
        if len(hit):
            first.append(np.full(len(hit), i))
            second.append(hit)
            left[hit] -= 1
            if (left[hit] == 0).any():
                full[hit[left[hit] == 0]] = True
                live = live[left[live] > 0]
    # a row of the same order may be the earlier one in truth
    full |= np.isin(rows.order, rows.order[full])
    empty = np.empty(0, np.int64)
    return (np.concatenate(first), np.concatenate(second), full) if first else (empty, empty, full)


def whole_lists(batches, width: int = 1):
    """Columns (arrays) of whole groups of rows with equal leading columns, from a sorted stream."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
        other = np.zeros(len(cols[0]), bool)
        for c in cols[:width]:
            other |= c != c[-1]
        at = np.flatnonzero(other)
        cut = int(at[-1]) + 1 if len(at) else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if held is not None:
        yield held


PAIRS = "x long, y long, more boolean"


def _pairs(x, y, more):
    """(x, y, false) of pairs, x < y; (x, x, true) of rows with perhaps more partners."""
    import pyarrow as pa

    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
    more = np.unique(more)
    return pa.RecordBatch.from_arrays([pa.array(np.append(both[:, 0], more)), pa.array(np.append(both[:, 1], more)), pa.array(np.arange(len(both) + len(more)) >= len(both))], ["x", "y", "more"])


def candidate_pairs(posts: DataFrame, num: int) -> DataFrame:
    """PAIRS of the lists of posts (key, packed, bits, bits2, k1). A list is compared with itself; rows marked by bit 62 are
    compared with those that aren't only."""

    def run(batches):
        for key, packed, bits, bits2, k1 in whole_lists(batches):
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(at, len(key)))
            marked = packed >> 62 & 1 == 1
            packed = packed & ~(1 << 62)
            one_by_one = (size > _SMALL) | marked[at + size - 1]
            some = np.flatnonzero(np.repeat(~one_by_one, size))
            ends = np.append(np.flatnonzero(np.append(True, key[some][1:] != key[some][:-1])), len(some)) if len(some) else np.zeros(1, np.int64)
            lo = 0
            while lo < len(ends) - 1:  # whole lists, about _CHUNK rows together
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _CHUNK, side="right")) - 1)
                s = some[ends[lo] : ends[hi]]
                rows = _List(packed[s], bits[s], bits2[s], k1[s])
                i, j = near_rows(key[s], rows, num)
                keep, more = capped(i, j, rows.order)
                yield _pairs(rows.k1[i[keep]], rows.k1[j[keep]], rows.k1[more])
                lo = hi
            for a, n in zip(at[one_by_one].tolist(), size[one_by_one].tolist(), strict=True):
                rows, own = _List(packed[a : a + n], bits[a : a + n], bits2[a : a + n], k1[a : a + n]), marked[a : a + n]
                leaders = n - int(own.sum())
                i, j, full = near_rows_of_long(rows, num, leaders)
                if leaders < n:
                    i, j, full = i[own[j]], j[own[j]], own  # a row with only the leaders tried may have more partners
                yield _pairs(rows.k1[i], rows.k1[j], rows.k1[full])
        trim()

    dealt = posts.repartition("key").sortWithinPartitions("key", "packed")
    return dealt.mapInArrow(run, PAIRS)


def capped(i: np.ndarray, j: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (i, j) of rows, i < j, are among the CAP first of j; and the rows that may have more."""
    by = np.lexsort((i, j))
    start = np.flatnonzero(np.append(True, j[by][1:] != j[by][:-1])) if len(j) else np.zeros(0, np.int64)
    rank = np.arange(len(j)) - np.repeat(start, np.diff(np.append(start, len(j))))
    keep = np.zeros(len(j), bool)
    keep[by] = rank < CAP
    lost = ~keep
    tied = lost & (order[i] == order[j])
    return keep, np.unique(np.concatenate([j[lost], i[tied]]))


def long_lists(lines: DataFrame) -> DataFrame:
    """(key, rows, least, most) of the posting lists over BLOCK rows, counted among the words that may have them."""
    some = lines.filter("often > 0").select(F.explode(F.expr("slice(prefix, -often, often)")).alias("key"), "packed")
    return some.groupBy("key").agg(F.count("*").alias("rows"), F.min("packed").alias("least"), F.max("packed").alias("most")).filter(F.col("rows") > BLOCK)


def blocked(posts: DataFrame, sizes: DataFrame) -> DataFrame:
    """posts with lists over BLOCK rows cut: about BLOCK of the earliest rows stay the list, and go along with each block
    of the others, which are marked by bit 62, under keys of their own."""
    lists = posts.join(sizes, "key", "left")
    # a list's earliest rows: those below the place that BLOCK rows would reach if documents were dealt evenly over the range
    span = (F.col("most") - F.col("least") + 1).cast("double")
    early = (F.col("packed") - F.col("least")).cast("double") / span * F.col("rows") < BLOCK
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    rest = ["packed", "bits", "bits2", "k1"]
    cut = lists.filter("rows is not null").withColumns({"early": early, "blocks": blocks})
    others = cut.filter("not early").select(F.xxhash64("key", F.pmod(F.hash("k1"), "blocks")).alias("key"), F.col("packed").bitwiseOR(F.lit(1 << 62)).alias("packed"), "bits", "bits2", "k1")
    leaders = cut.filter("early").select("key", *rest, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    leaders = leaders.select(F.xxhash64("key", "block").alias("key"), *rest)
    return lists.filter("rows is null").select("key", *rest).unionByName(cut.filter("early").select("key", *rest)).unionByName(others).unionByName(leaders)


def sets_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(k1, words) of the lines at places (d, rk, line), and of few others: other lines aren't even split into words."""

    def key(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place_key(*(c.to_numpy() for c in batch.columns)).view(np.int64))], ["key"])

    flags = member_bits(places.mapInArrow(key, "key long"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in by_bytes(batch, 2):
                buf, offs = column_bytes(part.column(2))
                row, line, start, end = line_bounds(buf, offs)
                doc, rk = (part.column(k).fill_null(v).to_numpy()[row] for k, v in ((0, _LAST), (1, 0)))
                some = np.flatnonzero(is_member(flags.value, place_key(doc, rk, line).view(np.int64)))
                n = end[some] - start[some]
                s = Sets(lower_ascii(buf[ranges(start[some], n)]), np.cumsum(n) - n)
                k1, once = np.unique(s.k1.view(np.int64), return_index=True)
                once = once[s.n[once] > 0]
                upto = np.zeros(len(once) + 1, np.int32)
                np.cumsum(s.n[once], out=upto[1:])
                words = pa.ListArray.from_arrays(pa.array(upto), pa.array(s.h[ranges(s.first[once], s.n[once])].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(s.k1[once].view(np.int64)), words], ["k1", "words"])

    return docs.select("doc_id", "rk", "text").mapInArrow(run, "k1 long, words array<long>")


def verified(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """(late) of the pairs (early, late) whose sets of words are similar. An early class of very many pairs is salted."""
    most = BLOCK
    big = pairs.groupBy("early").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("early", F.ceil(F.col("n") / most).cast("int").alias("copies"))
    a, b = sets.select(F.col("k1").alias("early"), F.col("words").alias("wx")), sets.select(F.col("k1").alias("late"), F.col("words").alias("wy"))
    pairs, on = pairs.select("early", "late"), ["early"]
    if not big.isEmpty():
        copies = F.coalesce("copies", F.lit(1))
        pairs = pairs.join(big, "early", "left").select("early", "late", F.pmod(F.hash("late"), copies).alias("salt"))
        a = a.join(big, "early", "left").select("early", "wx", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
        on = ["early", "salt"]
    inter = F.size(F.array_intersect("wx", "wy"))
    near = pairs.join(b, "late").join(a, on).filter(100 * inter >= num * (F.size("wx") + F.size("wy") - inter))
    return near.select("late").distinct()


def _oriented(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(early, late, place of the early one) of pairs (x, y)."""
    fx, fy = (classes.select(F.col("k1").alias(k), F.col("first").alias(f"f{k}")) for k in "xy")
    x_first = F.col("fx") < F.col("fy")
    return pairs.join(fx, "x").join(fy, "y").select(F.when(x_first, F.col("x")).otherwise(F.col("y")).alias("early"), F.when(x_first, F.col("y")).otherwise(F.col("x")).alias("late"), F.least("fx", "fy").alias("place"))


def _places(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("early").alias("k1")).union(pairs.select(F.col("late").alias("k1"))).distinct()
    return classes.join(ends, "k1", "left_semi").select("first.d", "first.rk", "first.line")


def rest_of_pairs(posts: DataFrame, late: DataFrame, num: int) -> DataFrame:
    """(x, y): all candidate partners of the classes in late (k1), whatever their number, block by block."""
    mine = materialize(posts.join(late, "k1", "left_semi"), "line-mine")
    keys = materialize(mine.groupBy("key").agg(F.count("*").alias("mine")), "line-keys")
    posts = materialize(posts.join(keys.select("key"), "key", "left_semi"), "line-theirs")  # written, so that its size is known
    sized = posts.join(keys, "key").groupBy("key").agg(F.count("*").alias("all"), F.first("mine").alias("mine"))
    sized = materialize(sized.select("key", F.ceil(F.col("mine") / BLOCK).cast("int").alias("mine"), F.ceil(F.col("all") / BLOCK).cast("int").alias("all")), "line-rest")

    def dealt(rows, own, other, side):
        part = F.pmod(F.hash("k1"), F.col(own))
        out = rows.join(sized, "key").select("key", "packed", "bits", "bits2", "k1", part.alias("_own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("_other"))
        a, b = ("_own", "_other") if side == 0 else ("_other", "_own")
        return out.select("key", F.col(a).alias("a"), F.col(b).alias("b"), F.lit(side).alias("side"), "packed", "bits", "bits2", "k1")

    both = dealt(mine, "mine", "all", 0).unionByName(dealt(posts, "all", "mine", 1))

    def run(batches):
        for key, a, b, side, packed, bits, bits2, k1 in whole_lists(batches, 3):
            at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            rows, x, y, made = _List(packed, bits, bits2, k1), [], [], 0
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(key)], strict=True):
                others = lo + np.flatnonzero(side[lo:hi] == 1)
                for i in (lo + np.flatnonzero(side[lo:hi] == 0)).tolist():
                    hit = others[rows.similar(i, others, num)]
                    x.append(np.full(len(hit), k1[i]))
                    y.append(k1[hit])
                    made += len(hit)
                    if made > 1 << 20:
                        yield _pairs(np.concatenate(x), np.concatenate(y), np.empty(0, np.int64))
                        x, y, made = [], [], 0
            if x:
                yield _pairs(np.concatenate(x), np.concatenate(y), np.empty(0, np.int64))

    cut = both.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return cut.mapInArrow(run, PAIRS).select("x", "y").distinct()


def duplicate_lines(docs: DataFrame, num: int = 80) -> DataFrame:
    """(doc_id, rk, line) of the lines to remove. docs: doc_id, rk, text."""
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(word_levels(docs))  # SLOTS bytes
    ids = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    lines = materialize(lines_of(docs, levels, num, float(ids.low or 0), float(ids.high or 0)), "lines")
    place = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), F.coalesce("rk", F.lit(0)).alias("rk"), "line")
    classes = materialize(lines.filter("n > 0").groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("lines")), "line-classes")
    posts = postings(lines)
    sizes, found = materialize(long_lists(lines), "line-lists"), None
    cut = not sizes.isEmpty()
    for k in range(ROUNDS):  # one part of the index after the other, so that not all of it lies on the disks at once
        some = posts.filter(F.pmod(F.hash("key"), F.lit(ROUNDS)) == k)
        part = materialize(candidate_pairs(blocked(some, sizes) if cut else some, num), "line-pairs")
        found = part if found is None else found.unionByName(part)
        release(spark)
    found = materialize(found.groupBy("x", "y").agg(F.max("more").alias("more")), "line-pairs")
    ordered = materialize(_oriented(found.filter("not more").select("x", "y"), classes), "line-ordered")
    sets = materialize(sets_of(docs, _places(ordered, classes)).dropDuplicates(["k1"]), "line-sets")
    # one verified pair settles a class: first its earliest candidate, then all pairs of the classes still open
    settled = materialize(verified(ordered.groupBy("late").agg(F.min_by("early", "place").alias("early")), sets, num), "line-settled")
    settled = materialize(settled.union(verified(ordered.join(settled, "late", "left_anti"), sets, num)), "line-settled")
    release(spark)
    more = found.filter("more").select(F.col("x").alias("k1")).join(settled.select(F.col("late").alias("k1")), "k1", "left_anti")
    if not more.isEmpty():
        more = materialize(more, "line-open")
        rest = _oriented(rest_of_pairs(posts, more, num), classes).join(more.select(F.col("k1").alias("late")), "late", "left_semi")
        rest = materialize(rest, "line-ordered")
        sets = materialize(sets_of(docs, _places(rest, classes)).dropDuplicates(["k1"]), "line-sets")
        settled = settled.union(verified(rest, sets, num)).distinct()
    near = settled.select(F.col("late").alias("k1"), F.lit(True).alias("near"))
    judged = classes.join(near, "k1", "left").filter("lines > 1 or near").select("k1", "k2", "first", "lines", F.coalesce("near", F.lit(False)).alias("near"))
    judged = materialize(judged, "line-judged")
    total = classes.agg(F.sum("lines")).first()[0] or 0
    hot = F.col("lines") * SHARE > F.lit(total)
    frequent = F.broadcast(judged.filter(hot).drop("lines"))  # at most SHARE rows
    rows = lines.filter("n > 0").select("doc_id", "rk", "line", "k1", "k2").withColumn("place", place)
    rare = rows.join(frequent.select("k1", "k2"), ["k1", "k2"], "left_anti").join(judged.filter(~hot).drop("lines"), ["k1", "k2"])
    hit = rows.join(frequent, ["k1", "k2"]).unionByName(rare).filter(F.col("near") | (F.col("place") != F.col("first")))
    return hit.select("doc_id", "rk", "line")


def _cut(text: str | None, removed: list[int]) -> str:
    gone = set(removed)
    return "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in gone)


def dedup_lines(docs: DataFrame, num: int = 80) -> DataFrame:
    """All columns of docs with the removed lines cut from text, and n_lines, removed (their numbers, from 0)."""
    docs = set_aside(docs, "n_lines", "removed")
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rk"))
    gone = duplicate_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rk"), "text"), num)
    key = F.xxhash64(F.coalesce("doc_id", F.lit(_LAST)), "rk").alias("key")
    per = materialize(gone.groupBy("doc_id", "rk").agg(F.array_sort(F.collect_set("line")).alias("removed")), "line-gone")
    flags = member_bits(per.select(key))
    names = docs.columns
    at = names.index("text")
    result = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("removed", T.ArrayType(T.IntegerType()))])

    def mark(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(is_member(flags.value, batch.column(0).to_numpy()))], [*batch.schema.names, "likely"])
        trim()

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            gone, cols = batch.column(1).to_pylist(), batch.column(0).flatten()
            texts = cols[at].to_pylist()
            n = pa.array([(t or "").count("\n") + 1 for t in texts], pa.int32())
            new = pa.array([_cut(t, g) if g else t for t, g in zip(texts, gone, strict=True)], cols[at].type)
            out = [*cols[:at], new, *cols[at + 1 :], n, pa.array([g or [] for g in gone], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(out, [*names, "n_lines", "removed"])
        trim()

    # only rows that have, or seem to have, lines to lose meet the list of lines; the others don't move
    keyed = own.select(key, "doc_id", "rk", "row")
    marked = keyed.mapInArrow(mark, T.StructType([*keyed.schema.fields, T.StructField("likely", T.BooleanType())]))
    whole = marked.filter("not likely").select("row.*", (F.length(F.coalesce("row.text", F.lit(""))) - F.length(F.replace(F.coalesce("row.text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).alias("n_lines"), F.array().cast("array<int>").alias("removed"))
    per = per.select(F.col("doc_id").alias("d"), F.col("rk").alias("r"), "removed")
    met = marked.filter("likely").join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("r")), "left").select("row", "removed")
    return whole.unionByName(met.mapInArrow(cut, result))
