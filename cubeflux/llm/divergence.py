"""Source divergence audit: how the word use of a language's sources differs, and the words that stand out in each.

Plain relational: the terms of a text are exploded with their count in it, counted per (lang, source, term), and a
language keeps the terms of at least ``least`` of its documents. Groups crossed with the kept terms make the zeros
explicit; a self-join on (lang, term) meets two sources of a language at each term, sums give the divergence of the pair,
and ranks finish the report. Smoothed shares are integers of a thousand million, so all arithmetic is exact.

Rows: part ``pair``, an item for each other source of the language, value the sum over all kept terms of f(p, q); part
``term``, the kept terms that the source uses more than the language does, value f of its share and the language's, ranks
to ``top``. f(p, q) = floor((p - q)^2 / (p + q)).

Defined cases: null text, lang or source is the empty string; each row is a document, also one that repeats another;
a group without terms still has its pairs, of value 0 where the language keeps no term; equal values rank by item, bytewise;
texts are taken whole; no other column is read, so extra columns of any name do no harm; an empty table gives no rows.

Groups and terms meet by language, of which there are few, so that join is salted by term, and the pairs of sources by
source: a language that holds most rows is spread over all tasks. Everything before is summed map-side, per task and
(lang, source, term). Top ranks are cut before the shuffle of the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, part_count

#: A term is a run of ASCII letters and of characters past ASCII. The matches are what stands between runs of all else:
#: Spark's regexp_extract_all copies the whole text for each match, so its work is quadratic in long texts; split's isn't.
TERM, BETWEEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shares are counted in units of one over this.
UNIT = 1_000_000_000


def lower_ascii(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else; lower() is the fast way where there is nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold it)."""
    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = clean.select("lang", "source", F.sort_array(F.split(lower_ascii(F.col("text")), BETWEEN)).alias("t"))
    # equal terms of a text stand side by side: where each run of them starts, and how far the next start is
    starts = F.filter(F.transform("t", lambda v, i: F.when(v.eqNullSafe(F.get("t", i - 1)), -1).otherwise(i)), lambda i: i >= 0)
    runs = F.transform("at", lambda i, k: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.size("t")) - i).alias("n")))
    flat = rows.select("lang", "source", "t", starts.alias("at")).select("lang", "source", F.inline(runs)).filter("term <> ''")
    return flat.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def by_lang(many: DataFrame, few: DataFrame, over: str) -> DataFrame:
    """many joined with few on lang, dealt by the column over of many as well: one language doesn't meet in one task."""
    salts = part_count(many.sparkSession)
    left = many.withColumn("salt", F.pmod(F.xxhash64(over), F.lit(salts)).cast("int"))
    right = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["lang", "salt"]).drop("salt")


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 v)), exact for counts of any size: decimals where longs don't reach."""
    below = total + 2 * v
    wide = (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    long = F.call_function("div", (n + 2) * F.lit(UNIT).cast("long"), below)
    return F.when(n < 9 * UNIT, long).otherwise(F.call_function("div", wide, below.cast("decimal(20,0)"))) + 1


def f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank."""
    counts = materialize(term_counts(docs), "divergence-counts")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = materialize(groups, "divergence-groups")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang")).filter(F.col("docs") >= least)
    kept = materialize(kept.select("lang", "term", "of_lang"), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("lang_total"))
    used = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "divergence-used")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = materialize(groups.join(totals, ["lang", "source"], "left").na.fill({"total": 0}).join(langs, "lang"), "divergence-sizes")

    # groups crossed with kept terms: every zero is a row
    cells = by_lang(kept, sized, "term").join(used, ["lang", "source", "term"], "left").na.fill({"n": 0})
    cells = cells.withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    dense = materialize(cells.select("lang", "source", "term", "n", "p", share(F.col("of_lang"), F.col("lang_total"), F.col("v")).alias("q")), "divergence-cells")

    one, two = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
    met = one.join(two, ["lang", "term"]).filter("source < item")  # f is the same both ways round
    sums = met.groupBy("lang", "source", "item").agg(F.sum(f(F.col("p"), F.col("other"))).alias("value"))
    sums = materialize(sums, "divergence-sums")
    turned = sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = by_lang(groups, groups.withColumnRenamed("source", "item"), "source").filter("source <> item")
    pairs = pairs.join(sums.unionByName(turned), ["lang", "source", "item"], "left").na.fill({"value": 0})
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    term = dense.filter("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f(F.col("p"), F.col("q")).alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = term.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return pair.withColumn("rank", F.row_number().over(best)).unionByName(ranked)


def oracle_sql(least: int = 10, top: int = 10) -> str:
    return f"""
with d as (select row_number() over () as row_no, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as terms from documents),
t as (select row_no, lang, source, unnest(terms) as term from d),
kept as (select lang, term, count(*) as of_lang from t group by all having count(distinct row_no) >= {least}),
langs as (select lang, count(*) as v, sum(of_lang) as lang_total from kept group by all),
used as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
sized as (select g.lang, g.source, coalesce(sum(n), 0) as total from g left join used using (lang, source) group by all),
cells as (select s.lang, s.source, k.term, coalesce(u.n, 0) as n,
    (1 + ({UNIT}::hugeint * (coalesce(u.n, 0) + 2)) // (s.total + 2 * l.v))::hugeint as p,
    (1 + ({UNIT}::hugeint * (k.of_lang + 2)) // (l.lang_total + 2 * l.v))::hugeint as q
    from sized s join kept k using (lang) join langs l using (lang) left join used u on u.lang = s.lang and u.source = s.source and u.term = k.term),
sums as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
    from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
    from g a join g b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
    union all select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from cells where n > 0 and p > q),
ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from r)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {top}"""
