"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

All steps are DataFrame functions. Documents are first reduced to cells (source, language, topic) with token counts, so a
source that holds a third of all rows is a few rows from there on. Raking multiplies the cells' token weights until the
source, language and topic marginals meet their targets, each half step one window over the cells. The ratio of a
cell's weight to its tokens, scaled so that the expected kept tokens meet the budget with no probability above one, is
the probability of its documents.

A budget and the targets can't always be had together: a cell has no more than its tokens. ``mix`` keeps the budget by
default: it cuts probabilities at one after the raking, so with the production parameters small sources, languages and
topics stay below their targets (op1_mixing; its SQL does the same). With ``exact``, as in the pipeline, it keeps the
targets: capping and raking alternate at the largest budget up to the given one at which every marginal can be met, plain
raking goes on until all marginals are within CLOSE of their targets (FURTHER rounds at most), and what still passes one
lowers the budget. A document's uniform number is the MD5 of its id, so samples are reproducible.

Targets default to tempered shares of the corpus (token share to a power below one). A target that no cell can meet
leaves the fit at its last iterate.

Defined cases: a null source, language or topic is the empty string; null or empty text has no tokens and a cell without
tokens has the factor one; a null doc_id is hashed as the empty string; rows that share a doc_id share their fate;
extra columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, uniform

DIMS = ("source", "lang", "topic")
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
ROUNDS = 12
CAPPING = 8
#: Deviation from a target at which exact raking stops, and its most rounds without capping.
CLOSE, FURTHER = 1e-3, 60
#: Share of all tokens to keep.
BUDGET = 0.5


def n_tokens(text) -> F.Column:
    """Words between ASCII white space."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def topic_of(text) -> F.Column:
    """A coarse topic from a text's form; a stand-in where no topic column is given."""
    return F.when(text.contains("|"), "table").when(text.contains("!!"), "shouting").when(text.contains("$$$") | text.contains("###"), "symbols").otherwise("prose")


def prepared(docs: DataFrame) -> DataFrame:
    """docs with _source, _lang, _topic and _tokens."""
    topic = F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else topic_of(F.coalesce("text", F.lit("")))
    return docs.withColumns({"_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_topic": topic, "_tokens": n_tokens(F.col("text"))})


def tempered_targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, share): token shares to a power, normalised."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t"))
    raised = sums.select(dim, F.pow("t", F.lit(power)).alias("p"))
    return raised.select(dim, (F.col("p") / F.nullif(F.sum("p").over(Window.partitionBy(F.lit(1))), F.lit(0.0))).alias(f"{dim}_share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """cells with a token weight w that meets the marginals. targets: dim -> (dim, dim_share)."""
    now = cells
    for dim in DIMS:
        t = targets[dim] if targets and dim in targets else tempered_targets(cells, dim, POWERS[dim])
        now = now.join(t, dim, "left")
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    now = materialize(now.withColumn("total", total.cast("double")).withColumn("w", F.col("tokens").cast("double")), "cells")
    for k in range(rounds):
        for dim in DIMS:
            held = F.sum("w").over(Window.partitionBy(dim))
            now = now.withColumn("w", F.when(held > 0, F.col("w") * F.coalesce(f"{dim}_share", F.lit(0.0)) * F.col("total") / held).otherwise(F.col("w")))
        if k % 4 == 3 or k == rounds - 1:  # bound the plan's depth
            now = materialize(now, "cells")
    return now.withColumn("factor", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0))


def calibration(cells: DataFrame, budget: float = BUDGET) -> float:
    """The scale c with sum(tokens * min(1, c * factor)) = budget * sum(tokens); each step is one row of sums."""
    c = None
    for _ in range(CAPPING):
        over = F.lit(False) if c is None else F.lit(c) * F.col("factor") >= 1
        r = cells.agg(
            F.sum("tokens").alias("all"),
            F.sum(F.when(over, F.col("tokens")).otherwise(0)).alias("whole"),
            F.sum(F.when(over, 0.0).otherwise(F.col("factor") * F.col("tokens"))).alias("free"),
        ).first()
        if not r["free"]:
            break
        c = (budget * r["all"] - r["whole"]) / r["free"]
    return 1.0 if c is None else c


def attain(raked: DataFrame, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """raked cells with probabilities up to one whose expected kept tokens have the target marginals."""
    now, bound = raked, budget
    for dim in DIMS:  # a value's share of the kept tokens is its target, and no more than its tokens can be kept
        sums = raked.groupBy(dim).agg(F.sum("tokens").alias("t"), F.first(f"{dim}_share").alias("s"), F.first("total").alias("all"))
        least = sums.filter("t > 0 and s > 0").agg(F.min(F.col("t") / (F.col("s") * F.col("all")))).first()[0]
        bound = bound if least is None else min(bound, least)
    now = now.withColumn("w", F.col("w") * bound)
    scaled = F.coalesce(F.lit(bound) * F.col("total"), F.lit(0.0))
    for k in range(rounds + FURTHER):
        if k >= rounds and k % 4 == 0:
            now = materialize(now, "cells")
            off = [now.groupBy(dim).agg(F.sum("w").alias("w"), (F.first(f"{dim}_share") * F.first(scaled)).alias("goal")).filter("w > 0 and goal > 0").agg(F.max(F.abs(F.col("w") / F.col("goal") - 1))).first()[0] for dim in DIMS]
            if max(x or 0.0 for x in off) <= CLOSE:
                break
        if k < rounds:
            now = now.withColumn("w", F.least("w", F.col("tokens").cast("double")))
        for dim in DIMS:
            held = F.sum("w").over(Window.partitionBy(dim))
            now = now.withColumn("w", F.when(held > 0, F.col("w") * F.coalesce(f"{dim}_share", F.lit(0.0)) * scaled / held).otherwise(F.col("w")))
        if k < rounds and k % 4 == 3:  # bound the plan's depth
            now = materialize(now, "cells")
    now = materialize(now, "cells")
    most = now.filter("tokens > 0").agg(F.max(F.col("w") / F.col("tokens"))).first()[0]
    scale = 1.0 / max(1.0, most or 1.0)
    return now.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("w") * scale / F.col("tokens"))).otherwise(bound * scale))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, exact: bool = False) -> DataFrame:
    """All columns of docs, and mix_topic, mix_tokens, probability, sampled. exact: the targets come before the budget."""
    rows = prepared(docs)
    cells = rows.groupBy(*(F.col(f"_{d}").alias(d) for d in DIMS)).agg(F.sum("_tokens").alias("tokens"))
    cells = materialize(rake(materialize(cells, "cells"), targets), "raked")
    if exact:
        cells = attain(cells, budget)
    else:
        cells = cells.withColumn("probability", F.least(F.lit(1.0), F.lit(calibration(cells, budget)) * F.col("factor")))
    small = cells.select(*(F.col(d).alias(f"_{d}") for d in DIMS), "probability")
    own = [x for x in docs.columns if x not in ("probability", "sampled", "mix_topic", "mix_tokens")]
    joined = rows.drop("probability").join(small, [f"_{d}" for d in DIMS])
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return joined.select(*own, F.col("_topic").alias("mix_topic"), F.col("_tokens").alias("mix_tokens"), "probability", (u < F.col("probability")).alias("sampled"))


def oracle_sql() -> str:
    """The same in DuckDB, the iterations unrolled."""
    ctes = [
        r"""rows_ as (select doc_id, coalesce(source,'') source, coalesce(lang,'') lang,
  case when contains(coalesce(text,''),'|') then 'table' when contains(coalesce(text,''),'!!') then 'shouting'
       when contains(coalesce(text,''),'$$$') or contains(coalesce(text,''),'###') then 'symbols' else 'prose' end topic,
  coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), 0)::bigint tokens from documents)""",
        "cells as (select source, lang, topic, sum(tokens)::bigint tokens from rows_ group by all)",
    ]
    for d in DIMS:
        ctes.append(f"t_{d} as (select {d}, p / nullif(sum(p) over (), 0) share from (select {d}, pow(sum(tokens)::double, {POWERS[d]}) p from cells group by {d}))")
    ctes.append("w0 as (select c.*, (sum(c.tokens) over ())::double total, c.tokens::double w, a.share source_share, b.share lang_share, d.share topic_share from cells c join t_source a using (source) join t_lang b using (lang) join t_topic d using (topic))")
    k = 0
    for _ in range(ROUNDS):
        for d in DIMS:
            ctes.append(f"w{k + 1} as materialized (select * exclude (w), case when sum(w) over (partition by {d}) > 0 then w * coalesce({d}_share, 0) * total / sum(w) over (partition by {d}) else w end w from w{k})")
            k += 1
    ctes.append(f"f as materialized (select source, lang, topic, tokens, case when tokens > 0 then w / tokens else 1.0 end factor from w{k})")
    ctes.append(f"c0 as (select {BUDGET} * sum(tokens) / sum(factor * tokens) c from f)")
    for i in range(1, CAPPING):
        ctes.append(f"c{i} as materialized (select coalesce(({BUDGET} * sum(tokens) - sum(case when c * factor >= 1 then tokens else 0 end)) / nullif(sum(case when c * factor >= 1 then 0 else factor * tokens end), 0), any_value(c)) c from f, c{i - 1})")
    ctes.append(f"p as (select source, lang, topic, least(1.0, c * factor) probability from f, c{CAPPING - 1})")
    return "with " + ",\n".join(ctes) + "\nselect doc_id, source, lang, topic, tokens as n_tokens, round(probability, 6) as probability, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0) < probability as sampled from rows_ join p using (source, lang, topic)"
