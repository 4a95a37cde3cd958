"""Graph superpixels (Felzenszwalb and Huttenlocher) in rounds of joins, with the result of the sequential algorithm.

Sequentially, edges are taken from the lightest up, and one joins its two regions if it is no heavier than either's limit,
weight of the last edge that joined it plus c / size. Here a region looks at the lightest edge that leaves it. Nothing can
change the region before that edge's turn, so if the edge is above the region's limit the region is finished, with all its
edges; and an edge that is the lightest for both its regions is decided at once. Edges rank by (weight, a hash, u, v): the
order is total, and the hash keeps equal weights from forming long chains of regions that wait for each other. A round
matches a good part of the regions, and of parallel edges only the lightest stays. A picture whose weights rise steadily
from one end to the other makes long chains: then rounds are as many as those are long, or until REST edges remain.

Afterwards regions below the least size are joined along ascending edges: a small region's lightest edge always joins it,
at once if the other region is large or has the same lightest edge.

What is left of a graph once it is at most REST edges is finished by one task, which takes the edges in their order: a bound,
not a switch, as the result is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeflux.shared import materialize, numbered

#: Edges that one task may finish.
REST = 100_000
ENDS = ("a", "size_a", "limit_a", "b", "size_b", "limit_b")
EDGES = "a long, size_a long, limit_a double, b long, size_b long, limit_b double, weight double, tie long, u long, v long"
MOVED = "tree long, root long"
ORDER = ("weight", "tie", "u", "v")


def _lightest(edges: DataFrame) -> DataFrame:
    """Edges between regions a < b, of parallel ones the lightest."""
    turn = F.col("a") > F.col("b")
    other = {"a": "b", "b": "a", "size_a": "size_b", "size_b": "size_a", "limit_a": "limit_b", "limit_b": "limit_a"}
    kept = edges.filter("a <> b").select(*(F.when(turn, F.col(other[c])).otherwise(F.col(c)).alias(c) for c in ENDS), F.struct(*ORDER).alias("e"))
    best = kept.groupBy("a", "b").agg(F.min("e").alias("e"), *(F.first(c).alias(c) for c in ENDS if c not in ("a", "b")))
    return best.select(*ENDS, "e.*")


def _picks(edges: DataFrame, who: Column | None = None) -> DataFrame:
    """(tree, size, limit, to, size_to, limit_to, e): the lightest edge of each region (with ``who``: of those it holds for)."""
    def seen(one: str, two: str) -> DataFrame:
        return edges.select(F.col(one).alias("tree"), F.struct(*ORDER, F.col(two).alias("to"), F.col(f"size_{one}").alias("size"), F.col(f"limit_{one}").alias("limit"), F.col(f"size_{two}").alias("size_to"), F.col(f"limit_{two}").alias("limit_to")).alias("z"))

    both = seen("a", "b").unionByName(seen("b", "a"))
    both = both if who is None else both.filter(who)
    best = both.groupBy("tree").agg(F.min("z").alias("z"))
    return best.select("tree", "z.to", "z.size", "z.limit", "z.size_to", "z.limit_to", F.struct(*(F.col(f"z.{c}").alias(c) for c in ORDER)).alias("e"))


def _mutual(picks: DataFrame) -> DataFrame:
    """picks and ``same``: the other region picks the same edge."""
    back = picks.select(F.col("to").alias("tree"), F.col("tree").alias("to"), F.lit(True).alias("same"))
    return picks.join(back, ["tree", "to"], "left").na.fill(False, ["same"])


def _renamed(edges: DataFrame, news: DataFrame) -> DataFrame:
    """Edges after a round. news: tree, root, now_size, now_limit, gone, of the regions that change."""
    for end in ("a", "b"):
        own = news.select(F.col("tree").alias(end), F.col("root").alias("to"), "now_size", "now_limit", "gone")
        edges = edges.join(own, end, "left").filter("not coalesce(gone, false)")
        new = {end: F.coalesce("to", end), f"size_{end}": F.coalesce("now_size", f"size_{end}"), f"limit_{end}": F.coalesce("now_limit", f"limit_{end}")}
        edges = edges.select(*(new.get(c, F.col(c)).alias(c) for c in ENDS), *ORDER)
    return edges


def _grow_round(edges: DataFrame, c: float) -> tuple[DataFrame, DataFrame]:
    """News of a round: regions at their limit are gone, pairs that pick each other are one."""
    picks = materialize(_picks(edges), "regions-picks")
    full = F.col("e.weight") > F.col("limit")
    joins = F.col("same") & ~full & (F.col("e.weight") <= F.col("limit_to"))
    seen = _mutual(picks)
    size = F.when(joins, F.col("size") + F.col("size_to")).otherwise(F.col("size"))
    limit = F.when(joins, F.col("e.weight") + F.lit(c) / (F.col("size") + F.col("size_to"))).otherwise(F.col("limit"))
    news = seen.filter(full | joins).select("tree", F.when(joins, F.least("tree", "to")).otherwise(F.col("tree")).alias("root"), size.alias("now_size"), limit.alias("now_limit"), full.alias("gone"))
    news = materialize(news, "regions-news")
    return news, _lightest(_renamed(edges, news))


def _fill_round(edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """News of a round: a small region joins a large one, or one that picks it too."""
    picks = materialize(_picks(edges, F.col("z.size") < least), "regions-picks")
    seen = _mutual(picks)
    large = F.col("size_to") >= least
    size = F.col("size") + F.col("size_to")
    news = seen.filter(large | F.col("same")).select("tree", F.when(large, F.col("to")).otherwise(F.least("tree", "to")).alias("root"), size.alias("now_size"), F.col("limit").alias("now_limit"), F.lit(False).alias("gone"))
    news = materialize(news, "regions-news")
    return news, _lightest(_renamed(edges, news)).filter((F.col("size_a") < least) | (F.col("size_b") < least))


def _finish(edges: DataFrame, decide: Callable, after: Callable) -> DataFrame:
    """(tree, root) of a graph of at most REST edges, by one task that takes the edges in order. decide: whether two
    regions (size, limit) join at a weight; after: the limit of both together."""

    def run(table):
        import pyarrow as pa

        t = table.sort_by([(c, "ascending") for c in ORDER]).to_pydict()
        parent: dict[int, int] = {}
        held: dict[int, tuple[int, float]] = {}
        for end in "ab":
            for i, n, h in zip(t[end], t[f"size_{end}"], t[f"limit_{end}"], strict=True):
                parent[i], held[i] = i, (n, h)

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for a, b, w in zip(t["a"], t["b"], t["weight"], strict=True):
            a, b = sorted((find(a), find(b)))
            if a != b and decide(held[a], held[b], w):
                n = held[a][0] + held[b][0]
                parent[b], held[a] = a, (n, after(w, n))
        moved = [(i, r) for i in parent if (r := find(i)) != i]
        return pa.table({"tree": pa.array([i for i, _ in moved], pa.int64()), "root": pa.array([r for _, r in moved], pa.int64())})

    return edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, MOVED)


def _followed(rounds: list[DataFrame]) -> DataFrame | None:
    """(tree, root) over all rounds: where each region that moved is in the end."""
    found = None
    for moved in reversed(rounds):
        if found is not None:
            later = found.select(F.col("tree").alias("root"), F.col("root").alias("end"))
            moved = moved.join(later, "root", "left").select("tree", F.coalesce("end", "root").alias("root")).unionByName(found)
            moved = materialize(moved, "regions-moved")
        found = moved  # a round's own table is written already
    return found


def _phase(edges: DataFrame, step: Callable, decide: Callable, after: Callable, rest: int) -> DataFrame | None:
    rounds = []
    now = materialize(edges, "regions-edges")
    while (left := now.count()) > rest:
        news, following = step(now)
        rounds.append(news.filter("tree <> root").select("tree", "root"))
        now = materialize(following, "regions-edges")
    if left:
        rounds.append(materialize(_finish(now, decide, after), "regions-rest"))
    return _followed(rounds)


def _placed(nodes: DataFrame, moved: DataFrame | None) -> DataFrame:
    """nodes (vec_id, root) with their root after moves (tree, root)."""
    if moved is None:
        return nodes
    to = moved.select(F.col("tree").alias("root"), F.col("root").alias("to"))
    return nodes.join(to, "root", "left").select("vec_id", F.coalesce("to", "root").alias("root"))


def superpixels(pixels: DataFrame, edges: DataFrame, c: float = 500.0, min_size: int = 50, rest: int = REST) -> DataFrame:
    """(vec_id, label) of every pixel; segments are numbered from 0 by their first pixel. edges: u, v, weight."""
    tie = F.xxhash64("u", "v")
    ids = [F.col(x).cast("long").alias(x) for x in ("u", "v")]
    plain = materialize(edges.select(*ids, F.col("weight").cast("double").alias("weight")), "regions-graph")
    ends = [F.col("u").alias("a"), F.lit(1).cast("long").alias("size_a"), F.lit(float(c)).alias("limit_a"), F.col("v").alias("b"), F.lit(1).cast("long").alias("size_b"), F.lit(float(c)).alias("limit_b")]
    first = _lightest(plain.select(*ends, "weight", tie.alias("tie"), "u", "v"))
    moved = _phase(first, lambda e: _grow_round(e, c), lambda p, q, w: w <= p[1] and w <= q[1], lambda w, n: w + c / n, rest)
    nodes = pixels.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec_id").cast("long").alias("root"))
    nodes = materialize(_placed(nodes, moved), "regions-nodes")
    if min_size > 1:
        sizes = nodes.groupBy("root").agg(F.count("*").alias("size"))
        held = materialize(nodes.join(sizes, "root"), "regions-sizes")
        grown = plain
        for end, id_ in (("a", "u"), ("b", "v")):
            grown = grown.join(held.select(F.col("vec_id").alias(id_), F.col("root").alias(end), F.col("size").alias(f"size_{end}"), F.lit(0.0).alias(f"limit_{end}")), id_)
        small = (F.col("size_a") < min_size) | (F.col("size_b") < min_size)
        second = _lightest(grown.select(*ENDS, "weight", tie.alias("tie"), "u", "v").filter(small))
        moved = _phase(second, lambda e: _fill_round(e, min_size), lambda p, q, w: p[0] < min_size or q[0] < min_size, lambda w, n: 0.0, rest)
        nodes = materialize(_placed(nodes, moved), "regions-nodes")
    firsts = nodes.groupBy("root").agg(F.min("vec_id").alias("first"))
    order = numbered(firsts, "label", "first").select("root", F.col("label").cast("int").alias("label"))
    return nodes.join(order, "root").select("vec_id", "label")
