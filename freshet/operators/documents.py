"""Nested documents (JSON texts) as long tables of their leaves, and the run outputs that checks and spans refer to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import written

#: Where a run's document keeps its outputs and inputs, in the order in which they are looked through.
RUN_ROOTS = ("key_outputs", "evidence.data", "evidence.uncertainty", "inputs")
#: Fixed value: the key with a leading underscore that is looked into like any other.
OPEN_KEY = "_uncertainty"


#: Levels that a round of json_leaves goes down.
LEVELS = 6


def json_leaves(docs: DataFrame, keys: list[str], document: str, most_depth: int | None = None, lists: bool = True) -> DataFrame:
    """Every leaf of a column of JSON texts: keys, path, depth, in_list, kind, number, text.

    path is dotted, list places (from 0) stand in it as numbers: `lines.0.qty`. kind is number, string, boolean or null;
    number and text hold its value (a number's or boolean's text is its JSON). in_list tells whether a list lies on the path,
    depth how many steps it has. A document that is a plain value has one leaf with an empty path; empty objects and lists
    have none; texts that are no JSON, and NULL, have none. Repeated rows each give their leaves. lists=False leaves out what
    is in a list, for those who do not read it.

    Documents are parsed once to VARIANT. A round takes all documents LEVELS levels down (to most_depth at most) in one pass
    and is written; what opens no further is a leaf, and only what may be nested deeper is carried on.
    """
    parsed = F.explode(F.array(F.try_parse_json(F.col(document))))  # a generator's value is made once, whatever reads it
    front = docs.select(*keys, parsed.alias("v")).select(*keys, "v", F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit(False).alias("in_list"), F.lit(False).alias("leaf")).where("v IS NOT NULL")
    names = [*keys, "path", "depth", "in_list", "kind", "number", "text"]
    shape = F.schema_of_variant("v")
    kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "VOID", "null").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").otherwise("number")
    number = F.when(F.col("kind") == "number", F.try_variant_get("v", "$", "double"))
    text = F.when(F.col("kind") == "string", F.try_variant_get("v", "$", "string")).when(F.col("kind") != "null", F.to_json("v"))
    parts, depth = [], 0
    while True:
        levels = LEVELS if most_depth is None else min(LEVELS, most_depth - depth)
        for _ in range(levels):
            front = _opened(front, keys, lists)
        depth += levels
        last = F.col("leaf") if depth != most_depth else F.lit(True)
        each = front.withColumn("kind", F.when(last, kind))
        level = written(each.select(*keys, "path", "depth", "in_list", F.when(F.col("kind").isNull(), F.col("v")).alias("v"), "kind", number.alias("number"), F.when(F.col("kind").isNotNull(), text).alias("text")), "leaves")
        parts.append(level.where("kind NOT IN ('object', 'array')").select(*names))
        front = level.where("kind IS NULL").select(*keys, "v", "path", "depth", "in_list", F.lit(False).alias("leaf"))
        if depth == most_depth or front.isEmpty():
            return reduce(DataFrame.unionByName, parts)


def _opened(front: DataFrame, keys: list[str], lists: bool) -> DataFrame:
    """Values with what is in them, one level down; what opens to nothing stays, as a leaf (or an empty object or list)."""
    kept = ", ".join(f"n.`{k}`" for k in keys)
    step = "coalesce(e.key, cast(e.pos AS string))"
    inside = "" if lists else "WHERE e.pos IS NULL OR e.key IS NOT NULL"
    return front.sparkSession.sql(f"SELECT {kept}, CASE WHEN e.pos IS NULL THEN n.v ELSE e.value END AS v, CASE WHEN e.pos IS NULL THEN n.path WHEN n.path = '' THEN {step} ELSE concat(n.path, '.', {step}) END AS path, n.depth + CASE WHEN e.pos IS NULL THEN 0 ELSE 1 END AS depth, n.in_list OR (e.pos IS NOT NULL AND e.key IS NULL) AS in_list, e.pos IS NULL AS leaf FROM {{front}} n, LATERAL variant_explode_outer(CASE WHEN NOT n.leaf THEN n.v END) AS e {inside}", front=front)


def json_value(document: Column, path: str, kind: str = "string") -> Column:
    """The value at one dotted path, with list places as numbers; NULL if there is none, or none of this type."""
    steps = [f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split(".")]
    return F.try_variant_get(F.try_parse_json(document), "$" + "".join(steps), kind)


def values_at(asked: DataFrame, leaves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path) of each row looked up in the leaves: kind, number and text join it, NULL where there is no such leaf."""
    return asked.join(leaves.select(*keys, "path", "kind", "number", "text"), [*keys, "path"], "left")


def run_outputs(leaves: DataFrame, key: str = "run_id", most: int = 600) -> DataFrame:
    """The numbers of run documents that a marked number or an evidence span may name: key, path, value.

    Finite numbers under RUN_ROOTS, at most four objects deep and outside lists; keys with a leading underscore are passed
    over, but for OPEN_KEY. `evidence.data.x` goes by the name `key_outputs.x`, and of two leaves of a name the root that
    comes first counts. A run lists its first `most` names, by root and then by path.
    """
    root = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(RUN_ROOTS))):
        root = F.when(F.startswith(F.col("path"), F.lit(name + ".")), i).otherwise(root)
    below = F.size(F.split("path", r"\.")) - F.get(F.array(*[F.lit(r.count(".") + 1) for r in RUN_ROOTS]), F.col("root"))
    hidden = F.exists(F.slice(F.split("path", r"\."), 2, 99), lambda s: s.startswith("_") & (s != OPEN_KEY))
    rows = leaves.withColumn("root", root).where((F.col("kind") == "number") & ~F.col("in_list") & F.col("root").isNotNull())
    rows = rows.where((below <= 4) & ~hidden & S.finite(F.col("number")).isNotNull())
    name = F.when(F.col("root") == 1, F.concat(F.lit("key_outputs."), F.substr("path", F.lit(len("evidence.data.") + 1)))).otherwise(F.col("path"))
    first = rows.withColumn("path", name).groupBy(key, "path").agg(F.min(F.struct("root", "number")).alias("x"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("x.root", "path")))
    return ranked.where(F.col("n") <= most).select(key, "path", F.col("x.number").alias("value"))
