"""Merkle manifest of a dataset: a root hash that stands for every row, and for each row the path that proves it.

H is the lowercase hex SHA-256 of its inputs put together, digests as hex text. A row's leaf is H of its fields, each ``-``
if null, else its UTF-8 byte count, ``:`` and its value (integers as decimals). The leaves of a language, ascending by
doc_id, form a tree of runs of eight; what remains is its subroot. The subroots, by language, form the tree of the root.

Blocks of DuckDB: leaves are numbered within their language and dealt into aligned buckets of 4096 leaves, a power of
eight, so a bucket is a whole subtree. A task takes a bucket as an Arrow table and runs one DuckDB query over it: a
string_agg in order and a sha256 for each level. The first pass gives the buckets' roots; Spark puts those together, eight
by eight, and hands back to each bucket the siblings above it; in the second pass DuckDB joins a leaf with its siblings
in the bucket, appends those above, hashes the proof and folds the leaf up to the bucket's root, from where the siblings
above take it to the root.

Numbering: rows are dealt by ranges of (language, doc_id, leaf) and written; a row's number is its place in its range and
the counts of the ranges before it, so no window runs over a language. Only ids and digests move, no text.

Defined cases: nulls count as ``-`` in a leaf; a null lang is a tree of its own and comes first, null doc_ids come first in
theirs and are never tampered with; rows that share a doc_id are a leaf each, in the order of their leaves, and equal rows
are interchangeable; empty and very long texts are like any other; an empty table gives no rows; no other column is read,
so extra columns of any name do no harm. A language of one row has its leaf as subroot, a single language its subroot as root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, part_count
from .divergence import lower_ascii

FAN = 8
#: Levels inside a bucket, of FAN^LEVELS leaves.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(columns[c]) for c in FIELDS)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and changed: the leaf of the row after tampering, null where there is none."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    rows = docs.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in FIELDS))
    own = {c: F.col(c) for c in FIELDS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return rows.select("doc_id", "lang", leaf(own).alias("leaf"), F.when(tampered, leaf(own | {"text": lower_ascii(F.col("text"))})).alias("changed"))


def numbered(rows: DataFrame, size: int) -> DataFrame:
    """tree (the language's number), n (its leaves), i (the leaf's number in it), bucket (of size leaves), doc_id, leaf, changed."""
    parts = part_count(rows.sparkSession)
    # tie tells rows apart that are equal, so that ranges can cut between them too
    keys = ["lang", "doc_id", "leaf", "tie"]
    order = [F.col(k).asc_nulls_first() for k in keys]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")
    place = F.monotonically_increasing_id()  # the partition's number times 2^33, and the row's place in it
    dealt = materialize(dealt.withColumn("place", place), "merkle-ranges").withColumn("part", F.shiftright("place", 33))

    held = dealt.groupBy("lang", "part").agg(F.count("*").alias("held"), F.min("place").alias("from"))
    held = materialize(held, "merkle-counts")  # at most a row for each range and language
    langs = held.groupBy("lang").agg(F.sum("held").alias("n"))
    langs = materialize(langs.withColumn("tree", F.row_number().over(Window.orderBy(F.col("lang").asc_nulls_first())) - 1), "merkle-langs")
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    same = F.col("lang").eqNullSafe(F.col("of_lang"))
    starts = starts.join(langs.select(F.col("lang").alias("of_lang"), "tree", "n"), same).select("tree", "n", F.col("part").alias("of_part"), "before", "from", "of_lang")
    starts = materialize(starts, "merkle-starts")
    here = dealt.join(starts, same & (F.col("part") == F.col("of_part")))
    here = here.withColumn("i", F.col("place") - F.col("from") + F.col("before"))
    return here.select("tree", "n", "i", F.expr(f"i div {size}").alias("bucket"), "doc_id", "leaf", "changed")


def levels_of(n: int, most: int) -> int:
    """Levels, at most so many, of a bucket in a tree of n leaves: while several nodes remain in the tree."""
    k = 0
    while k < most and n > FAN**k:
        k += 1
    return k


def _nodes(levels: int) -> list[str]:
    """b0 .. b<levels>: the nodes (i, h) of each level, from a bucket's leaves."""
    made = ["b0 as materialized (select i, leaf as h from bucket)"]
    for k in range(levels):
        made.append(f"b{k + 1} as materialized (select i // {FAN} as i, sha256(string_agg(h, '' order by i)) as h from b{k} group by 1)")
    return made


def root_sql(levels: int) -> str:
    """The root of an aligned bucket."""
    return f"with {', '.join(_nodes(levels))} select h from b{levels}"


def proof_sql(levels: int, above: int) -> str:
    """Of each leaf: the proof's hash and the root folded from the changed leaf, else the leaf. outer: l and r, the
    siblings to the left and right in the levels above the bucket, lowest first."""
    made = _nodes(levels)
    for k in range(levels):
        made.append(f"r{k} as materialized (select i // {FAN} as run, list(h order by i) as hs from b{k} group by 1)")
        made.append(f"s{k} as materialized (select i, array_to_string(hs[:i % {FAN}], '') as l, array_to_string(hs[i % {FAN} + 2:], '') as r from b{k} join r{k} on run = i // {FAN})")
    made.append("f0 as (select i, doc_id, leaf, coalesce(changed, leaf) as fold, '' as proof from bucket)")
    for k in range(levels):
        made.append(f"f{k + 1} as (select f.i, doc_id, leaf, sha256(s.l || fold || s.r) as fold, proof || s.l || s.r as proof from f{k} f join s{k} s on s.i = f.i // {FAN**k})")
    last = f"f{levels}"
    for k in range(above):
        step = f"g{k + 1}"
        made.append(f"{step} as (select f.i, doc_id, leaf, sha256(o.path[{k + 1}].l || fold || o.path[{k + 1}].r) as fold, proof || o.path[{k + 1}].l || o.path[{k + 1}].r as proof from {last} f, outer_path o)")
        last = step
    return f"with {', '.join(made)} select doc_id, leaf, sha256(proof) as proof_sha256, fold as folded_root from {last}"


def _duck(sql: str, **tables):
    """The Arrow table that a query gives over Arrow tables, by a connection of one thread that the process keeps."""
    global _CONNECTION
    if _CONNECTION is None:
        import duckdb

        _CONNECTION = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    for name, t in tables.items():
        _CONNECTION.register(name, t)
    try:
        return _CONNECTION.sql(sql).to_arrow_table()
    finally:
        for name in tables:
            _CONNECTION.unregister(name)


_CONNECTION = None


def bucket_roots(rows: DataFrame, levels: int) -> DataFrame:
    """tree, i (the bucket's number), h."""

    def run(key, bucket):
        import pyarrow as pa

        n = bucket.column("n")[0].as_py()
        h = _duck(root_sql(levels_of(n, levels)), bucket=inside(bucket, FAN**levels)).column("h")
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int64()), "h": h.cast(pa.string())})

    return rows.select("tree", "n", "i", "bucket", "leaf").groupBy("tree", "bucket").applyInArrow(run, "tree int, i long, h string")


def inside(bucket, size: int):
    """The bucket, of so many leaves, with its leaves numbered from 0."""
    import pyarrow as pa
    import pyarrow.compute as pc

    at = bucket.schema.get_field_index("i")
    i = pc.subtract(bucket.column(at), pa.scalar(bucket.column("bucket")[0].as_py() * size, pa.int64()))
    return bucket.set_column(at, "i", i)


def combined(nodes: DataFrame) -> list[DataFrame]:
    """The levels of trees of nodes (tree, i, h), eight to one, until each tree has one: each level as tree, i, h, and m,
    the nodes that the tree has there. A level holds the trees that go on; the last one what remains of each."""
    made, tops = [], []
    now = nodes
    while True:
        sized = now.groupBy("tree").agg(F.count("*").alias("m"))
        now = materialize(now.select("tree", "i", "h").join(sized, "tree"), "merkle-level")
        tops.append(now.filter("m = 1"))
        more = now.filter("m > 1")
        if more.isEmpty():
            break
        made.append(more)
        run = F.array_sort(F.collect_list(F.struct("i", "h")))  # eight at most
        now = more.groupBy("tree", F.expr(f"i div {FAN}").alias("up")).agg(F.sha2(F.array_join(F.transform(run, lambda x: x["h"]), "").cast("binary"), 256).alias("h")).withColumnRenamed("up", "i")
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return [*made, materialize(top.select("tree", "h"), "merkle-tops")]


def outer_paths(levels: list[DataFrame], start: DataFrame) -> DataFrame:
    """tree, i, path: of each lowest node, the siblings of each level, lowest first, and then start's path (tree, path).

    From the top down: a node's path is its own siblings and the path of the node above, which at most eight share."""
    paths = None
    tops = start.withColumn("i", F.lit(0).cast("long")).select("tree", "i", "path")
    for level in reversed(levels):
        # a tree's top is the start of its path, whatever level it is reached on
        above = tops if paths is None else paths.unionByName(tops.join(paths.select("tree").distinct(), "tree", "left_anti"))
        up = F.expr(f"i div {FAN}")
        run = level.groupBy("tree", up.alias("up")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("run"))
        side = run.join(above.withColumnRenamed("i", "up"), ["tree", "up"]).select("tree", F.posexplode("run").alias("at", "x"), "run", "path")
        hs = F.transform("run", lambda x: x["h"])
        own = F.struct(F.array_join(F.slice(hs, F.lit(1), F.col("at")), "").alias("l"), F.array_join(F.slice(hs, F.col("at") + 2, F.lit(FAN)), "").alias("r"))
        paths = materialize(side.select("tree", F.col("x.i").alias("i"), F.concat(F.array(own), "path").alias("path")), "merkle-paths")
    if paths is None:
        return tops
    return paths.unionByName(tops.join(paths.select("tree").distinct(), "tree", "left_anti"))


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row. levels: of the trees, inside a bucket."""
    rows = materialize(numbered(leaves(docs), FAN**levels), "merkle-rows")
    inner = combined(materialize(bucket_roots(rows, levels), "merkle-roots"))
    subroots = inner[-1]
    forest = combined(subroots.select(F.lit(0).alias("tree"), F.col("tree").cast("long").alias("i"), "h"))
    none = F.array().cast(PATH)
    to_root = outer_paths(forest[:-1], forest[-1].select("tree", none.alias("path")))
    to_root = to_root.select(F.col("i").cast("int").alias("tree"), "path")
    top = forest[-1].select("h").first()  # one row, none of an empty table
    outer = outer_paths(inner[:-1], to_root)
    outer = outer.join(subroots.select("tree", F.col("h").alias("subroot")), "tree").withColumn("root", F.lit(top.h if top else None).cast("string"))
    outer = materialize(outer.select("tree", F.col("i").alias("bucket"), "path", "subroot", "root"), "merkle-outer")

    def run(bucket, above):
        import pyarrow as pa

        n, path = bucket.column("n")[0].as_py(), above.column("path")
        got = _duck(proof_sql(levels_of(n, levels), len(path[0])), bucket=inside(bucket, FAN**levels), outer_path=above.select(["path"]))
        root, subroot = above.column("root")[0].as_py(), above.column("subroot")[0].as_py()
        text = {c: got.column(c).cast(pa.string()) for c in ("leaf", "proof_sha256", "folded_root")}
        folded = text["folded_root"].to_pylist()
        same = [pa.array([x] * len(folded), pa.string()) for x in (subroot, root)]
        return pa.table({"doc_id": got.column("doc_id").cast(pa.int64()), "leaf": text["leaf"], "subroot": same[0], "root": same[1], "proof_sha256": text["proof_sha256"], "folded_root": text["folded_root"], "verified": pa.array([x == root for x in folded], pa.bool_())})

    result = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.groupBy("tree", "bucket").cogroup(outer.groupBy("tree", "bucket")).applyInArrow(run, result)


def oracle_sql(levels: int = 8) -> str:
    """The same for up to 8^levels rows of a language, and as many languages: every level is a step of its own."""
    step = "case when {x} % 2 = 1 then xor({x} // 2, 3988292384::bigint) else {x} // 2 end"
    table = f"list_transform(range(256), lambda k: list_reduce(list_prepend(k, [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: {step.format(x='a')}))"
    digits = "list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {digits}), lambda a, b: xor(a // 256, tab[xor(a, b) % 256 + 1])), 4294967295::bigint)"
    text = {c: c for c in FIELDS}

    def h(columns: dict[str, str]) -> str:
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({columns[c]}::varchar))::varchar || ':' || {columns[c]}::varchar, '-')" for c in FIELDS) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    made = [
        f"crc as (select {table} as tab)",
        f"d as (select row_number() over (order by lang nulls first, doc_id nulls first, {h(text)}) as row_no, doc_id, lang, {h(text)} as leaf, case when {crc} % 3 = 0 then {h(text | {'text': lower})} end as changed from documents, crc)",
        "a0 as (select row_no, dense_rank() over (order by lang nulls first) - 1 as tree, row_number() over (partition by lang order by row_no) - 1 as i, doc_id, leaf, coalesce(changed, leaf) as fold, '' as proof from d)",
    ]

    def tree(name: str, rows: str, first: str) -> str:
        """Steps up the levels of nodes first (tree, i, h), with each row of rows (tree, i, fold, proof) on its path."""
        nodes = first
        for k in range(levels):
            up, new = f"{name}n{k}", f"{name}r{k}"
            made.append(f"{up}s as (select tree, i, h, count(*) over (partition by tree) as m from {nodes})")
            made.append(f"{up}l as (select tree, i // 8 as run, list(h order by i) as hs from {up}s where m > 1 group by all)")
            made.append(f"{up} as (select tree, run as i, sha256(array_to_string(hs, '')) as h from {up}l union all select tree, i, h from {up}s where m = 1)")
            left, right = "array_to_string(hs[:r.i % 8], '')", "array_to_string(hs[r.i % 8 + 2:], '')"
            made.append(f"{new} as (select r.* exclude (i, fold, proof), r.i // 8 as i, case when hs is null then fold else sha256({left} || fold || {right}) end as fold, case when hs is null then proof else proof || {left} || {right} end as proof from {rows} r left join {up}l l on l.tree = r.tree and l.run = r.i // 8)")
            nodes, rows = up, new
        made.append(f"{name}top as (select tree, h from {nodes})")
        return rows

    last = tree("a", "a0", "(select tree, i, leaf as h from a0)")
    made.append(f"z0 as (select 0 as tree, r.tree as i, r.row_no, r.doc_id, r.leaf, r.fold, r.proof, t.h as subroot from {last} r join atop t on t.tree = r.tree)")
    last = tree("z", "z0", "(select 0 as tree, tree as i, h from atop)")
    return f"with {', '.join(made)} select doc_id, leaf, subroot, t.h as root, sha256(proof) as proof_sha256, fold as folded_root, fold = t.h as verified from {last}, ztop t"
