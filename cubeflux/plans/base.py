"""What the registered queries share: the cubes on the Spark side, and the same as common table expressions for SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubeflux.model import from_embeddings, from_lineitem, scaled255

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

PX = "px as (select vec_id, (vec_id // 25)::int as y, (vec_id % 25)::int as x, label::int as label, embedding::double[] as s from embeddings)"
P255 = PX + ", p255 as (select vec_id, y, x, label, list_transform(s, lambda v: (v + 1.0) * 255.0 / 2.0 + 0.0) as s from px)"
SAMPLES = "samples as (select vec_id, y, x, label, unnest(range(len(s)))::int as band, unnest(s) as value from px)"


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def cube(spark, sf_dir):
    return from_embeddings(spark, sf_dir)


def cube255(spark, sf_dir):
    return scaled255(from_embeddings(spark, sf_dir))


def lineitem_cube(spark, sf_dir):
    return from_lineitem(spark, sf_dir)


def long_form(df, column, name: str = "value"):
    """vec_id, band, value of an array column, rounded."""
    return df.select("vec_id", F.posexplode(column).alias("band", name)).withColumn(name, F.round(F.col(name).cast("double"), 6))


def long_sql(expr: str, base: str = "px", ctes: str | None = None, name: str = "value") -> str:
    return f"with {ctes or (P255 if base == 'p255' else PX)}, q as (select vec_id, {expr} as t from {base}) select vec_id, unnest(range(len(t)))::int as band, round(unnest(t)::double, 6) as {name} from q"
