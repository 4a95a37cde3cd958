"""Seeded maximum spanning forest in rounds of joins: no edge leaves the executors.

Every tree without a label picks its strongest outgoing edge, which belongs to the forest, and all trees that picks connect
become one. Edges rank by (weight, u, v), so the forest is one and only, whatever order trees grow in: growing from
the seeds (Prim) and taking the edges from the strongest down (Kruskal) find the same. A labelled tree is a root from the
start: two of them never merge, an edge between them is no longer looked at.

A round aggregates the edges by tree, halves the number of unlabelled trees at least, and keeps of parallel edges only the
strongest, so on a lattice all rounds together read a few times the edges. Which root a tree went to is kept for each
round, and labels go back through those tables, so pixels take part in the first and the last step only. Once at most REST
edges are left one task takes them in their order: a bound, not a switch, as the forest is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeflux.shared import materialize

#: Edges that one task may finish.
REST = 100_000


def _between(edges: DataFrame) -> DataFrame:
    """Edges between trees a < b, of parallel ones the strongest. edges: a, b, with_a and with_b (labelled), weight, u, v."""
    turn = F.col("a") > F.col("b")

    def pick(one: str, other: str) -> Column:
        return F.when(turn, F.col(other)).otherwise(F.col(one)).alias(one)

    kept = edges.filter("a <> b and not (with_a and with_b)")
    kept = kept.select(pick("a", "b"), pick("b", "a"), pick("with_a", "with_b"), pick("with_b", "with_a"), F.struct("weight", "u", "v").alias("e"))
    return kept.groupBy("a", "b").agg(F.max("e").alias("e"), F.first("with_a").alias("with_a"), F.first("with_b").alias("with_b")).select("a", "b", "with_a", "with_b", "e.*")


def _picks(edges: DataFrame) -> DataFrame:
    """(tree, root, done) of each unlabelled tree: where its strongest edge leads. Of two trees that pick each other the
    smaller one is the root. done: the root is one."""
    strongest = F.max(F.struct("weight", "u", "v", "to", "with_to")).alias("e")
    ways = edges.select(F.col("a").alias("tree"), F.col("b").alias("to"), "with_a", F.col("with_b").alias("with_to"), "weight", "u", "v").filter("not with_a")
    back = edges.select(F.col("b").alias("tree"), F.col("a").alias("to"), "with_b", F.col("with_a").alias("with_to"), "weight", "u", "v").filter("not with_b")
    best = ways.drop("with_a").unionByName(back.drop("with_b")).groupBy("tree").agg(strongest)
    best = materialize(best.select("tree", "e.to", "e.with_to"), "forest-best")
    mutual = best.select(F.col("to").alias("tree"), F.col("tree").alias("to"), F.lit(True).alias("mutual"))
    both = best.join(mutual, ["tree", "to"], "left")
    top = F.coalesce("mutual", F.lit(False)) & (F.col("tree") < F.col("to"))
    return both.select("tree", F.when(top, F.col("tree")).otherwise(F.col("to")).alias("root"), (top | F.col("with_to")).alias("done"))


def _roots(picks: DataFrame) -> DataFrame:
    """(tree, root, done) with every root the end of its chain, by pointer jumping: each round doubles what it skips."""
    now = materialize(picks, "forest-roots")
    while True:
        todo = now.filter("not done")
        if todo.isEmpty():
            return now
        # a pointer that is a root leads to itself, a labelled tree has none and was done before
        ahead = now.select(F.col("tree").alias("root"), F.col("root").alias("next"), (F.col("done") | (F.col("root") == F.col("tree"))).alias("then"))
        moved = todo.join(ahead, "root").select("tree", F.col("next").alias("root"), F.col("then").alias("done"))
        now = materialize(now.filter("done").unionByName(moved), "forest-roots")


def _finish(edges: DataFrame) -> DataFrame:
    """(tree, root) of at most REST edges, taken from the strongest down by one task."""

    def run(table):
        import pyarrow as pa

        t = table.sort_by([(c, "descending") for c in ("weight", "u", "v")]).to_pydict()
        parent: dict[int, int] = {}
        labelled = set()
        for end in "ab":
            for i, on in zip(t[end], t[f"with_{end}"], strict=True):
                parent[i] = i
                if on:
                    labelled.add(i)

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for a, b in zip(t["a"], t["b"], strict=True):
            a, b = find(a), find(b)
            if a != b and not (a in labelled and b in labelled):
                a, b = (b, a) if b in labelled else (a, b)
                parent[b] = a
        own = [i for i in parent if i not in labelled]
        return pa.table({"tree": pa.array(own, pa.int64()), "root": pa.array([find(i) for i in own], pa.int64())})

    return edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "tree long, root long")


def seeded_forest(edges: DataFrame, seeds: DataFrame, rest: int = REST) -> DataFrame:
    """(vec_id, label) of every pixel that has an edge or is a seed; 0 where no seed reaches.

    edges: u, v, weight; seeds: vec_id, label (1 or more). A seed given twice takes its smallest label.
    """
    seeds = materialize(seeds.groupBy(F.col("vec_id").cast("long").alias("tree")).agg(F.min("label").cast("int").alias("label")), "forest-seeds")
    one = seeds.select(F.col("tree").alias("a"), F.lit(True).alias("with_a"))
    other = one.select(F.col("a").alias("b"), F.col("with_a").alias("with_b"))
    first = edges.select(F.col("u").cast("long").alias("a"), F.col("v").cast("long").alias("b"), F.col("weight").cast("double").alias("weight"), "u", "v")
    first = first.join(one, "a", "left").join(other, "b", "left").na.fill(False, ["with_a", "with_b"])
    nodes = edges.select(F.explode(F.array(F.col("u").cast("long"), F.col("v").cast("long"))).alias("tree")).distinct()
    now, rounds = materialize(_between(first), "forest-edges"), []
    while (left := now.count()) > rest:
        went = _roots(_picks(now))
        rounds.append(went)
        # a root of an unlabelled tree is done though it has no label: it goes on as itself
        ended = went.select("tree", "root").join(seeds.select(F.col("tree").alias("root"), F.lit(True).alias("labelled")), "root", "left").na.fill(False, ["labelled"])
        ended = materialize(ended, "forest-ends")
        to_a = ended.select(F.col("tree").alias("a"), F.col("root").alias("root_a"), F.col("labelled").alias("now_a"))
        to_b = ended.select(F.col("tree").alias("b"), F.col("root").alias("root_b"), F.col("labelled").alias("now_b"))
        led = now.join(to_a, "a", "left").join(to_b, "b", "left")
        led = led.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"), F.coalesce("now_a", "with_a").alias("with_a"), F.coalesce("now_b", "with_b").alias("with_b"), "weight", "u", "v")
        now = materialize(_between(led), "forest-edges")
    if left:
        rounds.append(materialize(_finish(now), "forest-rest"))
    found = seeds
    for went in reversed(rounds):
        inner = went.select("tree", "root").join(found.select(F.col("tree").alias("root"), "label"), "root").select("tree", "label")
        found = materialize(inner.unionByName(seeds), "forest-labels")
    every = nodes.union(seeds.select("tree")).distinct()
    return every.join(found, "tree", "left").select(F.col("tree").alias("vec_id"), F.coalesce("label", F.lit(0)).cast("int").alias("label"))
