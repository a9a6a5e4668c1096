"""Contexts: the JSON document of keys and values that a workflow carries.

Everything happens within a row, so that no workflow's size can make a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bytes of a text, object or list in a context; most bytes of all values that an error keeps.
MOST_VALUE, BUDGET = 16 * 1024, 16 * 1024
OMITTED = "<<omitted>>"
_TYPES = {"BIGINT": "integer", "STRING": "string", "BOOLEAN": "boolean", "DOUBLE": "float", "VOID": "null"}


def entries(context: Column) -> Column:
    """Keys in their order with their values' canonical JSON, type and bytes."""
    every = F.map_entries(F.from_json(context, "map<string,variant>"))

    def described(e: Column) -> Column:
        kind, json = F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID")), F.coalesce(F.to_json(e["value"]), F.lit("null"))
        named = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind.startswith("DECIMAL"), "float")
        for variant, name in _TYPES.items():
            named = named.when(kind == variant, name)
        return F.struct(e["key"].alias("key"), json.alias("json"), named.otherwise(kind).alias("type"), F.octet_length(json).alias("bytes"))

    return F.coalesce(F.transform(every, described), F.array().cast("array<struct<key:string,json:string,type:string,bytes:int>>"))


def nodes(wf: DataFrame) -> DataFrame:
    """A row per key of every context: ``id``, ``place``, ``key``, ``value`` (JSON), ``type``, ``bytes``, and whether the value may be stored."""
    d = wf.select("id", F.posexplode(entries(F.col("context"))).alias("place", "e")).select("id", "place", "e.key", F.col("e.json").alias("value"), "e.type", "e.bytes")
    return d.withColumn("valid", ~F.col("type").isin("string", "object", "array") | (F.col("bytes") <= MOST_VALUE))


def sizes(wf: DataFrame) -> DataFrame:
    """Keys and bytes of every context, written as compact JSON."""
    of = F.aggregate("e", F.lit(0), lambda n, x: n + F.octet_length(F.to_json(F.struct(x["key"].alias("k")))) - F.lit(len('{"k":}')) + x["bytes"] + 1)
    pairs = of + F.size("e")  # a colon each, and a comma after all but the last
    return wf.select("id", entries(F.col("context")).alias("e")).select("id", F.size("e").alias("keys"), F.when(F.size("e") == 0, 2).otherwise(pairs + 1).alias("bytes"))


def within_budget(wf: DataFrame, budget: int = BUDGET, omitted: str = OMITTED) -> DataFrame:
    """What an error keeps of its workflow's context: values in order as far as a budget of bytes goes.

    A value is kept if it fits into what is left; one that doesn't is replaced by
    ``omitted`` and uses nothing up, so that later, smaller values may still fit.
    That is a fold, no running sum: what is left depends on earlier decisions.
    """
    state = "struct<room:int,kept:array<boolean>>"

    def step(a: Column, x: Column) -> Column:
        fits = x["bytes"] <= a["room"]
        return F.struct((a["room"] - F.when(fits, x["bytes"]).otherwise(0)).alias("room"), F.array_append(a["kept"], fits).alias("kept")).cast(state)

    kept = F.aggregate("e", F.struct(F.lit(budget).alias("room"), F.array().cast("array<boolean>").alias("kept")).cast(state), step, lambda a: a["kept"])
    rows = wf.select("id", entries(F.col("context")).alias("e")).select("id", F.posexplode(F.arrays_zip(F.col("e").alias("x"), kept.alias("kept"))).alias("place", "z"))
    return rows.select("id", "place", F.col("z.x.key").alias("key"), F.col("z.kept").alias("kept"), F.when(F.col("z.kept"), F.col("z.x.json")).otherwise(omitted).alias("value"))


def fetch(context: Column, key: str, default: Column | None = None) -> Column:
    """Value of a key in a map; the default only where the key is missing, not where its value is null."""
    found = F.try_element_at(context, F.lit(key))
    return found if default is None else F.when(F.map_contains_key(context, key), found).otherwise(default)


def merge(context: Column, more: Column) -> Column:
    """Both maps' pairs; ``more`` wins."""
    return F.map_concat(F.map_filter(context, lambda k, _: ~F.map_contains_key(more, k)), more)


def merge_once(context: Column, more: Column) -> Column:
    """Both maps' pairs; what is there stays."""
    return F.map_concat(context, F.map_filter(more, lambda k, _: ~F.map_contains_key(context, k)))


def put(context: Column, key: str, value: Column) -> Column:
    return merge(context, F.create_map(F.lit(key), value))


def put_once(context: Column, key: str, value: Column) -> Column:
    return merge_once(context, F.create_map(F.lit(key), value))
