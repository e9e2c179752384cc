"""Typed mutations, in whatever order they come, as versions with the times in which they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import carried

#: Verbs: a whole document, some of its fields, its removal.
PUT, PATCH, DELETE = "put", "patch", "delete"


def typed(mutations: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Valid mutations and the others with a reason.

    mutations: id, at, seq, op, payload (JSON). Valid ones have an id, a time, a known op, a payload that is an object (none for
    delete) of known fields with values of their types; they get ``doc`` (a struct of the schema) and ``has`` (the fields that
    the payload names, so that a null that is given differs from a field that isn't).
    """
    doc = F.from_json("payload", schema)
    names = F.json_object_keys("payload")
    wrong = F.filter(F.array(*(F.when(F.array_contains(names, f.name) & F.get_json_object("payload", f"$.{f.name}").isNotNull() & doc[f.name].isNull(), F.lit(f.name)) for f in schema)), lambda x: x.isNotNull())
    reason = (
        F.when(F.col("id").isNull() | F.col("at").isNull(), "no id or time")
        .when(~F.coalesce(F.col("op").isin(PUT, PATCH, DELETE), F.lit(False)), "unknown op")
        .when((F.col("op") != DELETE) & names.isNull(), "no object")
        .when((F.col("op") != DELETE) & (F.size(F.array_except(names, F.array(*(F.lit(f.name) for f in schema)))) > 0), "unknown field")
        .when((F.col("op") != DELETE) & (F.size(wrong) > 0), F.concat(F.lit("wrong type: "), F.array_join(wrong, ", ")))
    )
    checked = mutations.withColumn("reason", reason)
    good = checked.filter("reason is null").drop("reason")
    return good.withColumns({"doc": F.when(F.col("op") != DELETE, doc), "has": F.when(F.col("op") != DELETE, names)}), checked.filter("reason is not null")


def versions(mutations: DataFrame, schema: T.StructType) -> DataFrame:
    """id, the schema's fields, exists, valid_from, valid_to (null: still) for valid mutations, see typed().

    Mutations of an id count in order of (at, seq), whenever they come: late corrections and replays of any part in any order
    give the same history. Of several with the same at and seq the greatest counts, so that a repeated one counts once. A
    put sets all fields (those it doesn't name to null), a patch those that it names, a delete ends what there is; a patch of
    what doesn't exist begins it. Of several mutations at one time only the last makes a version. Fields are carried on by
    ranges of time, so that no id's history meets in one task.
    """
    once = mutations.groupBy("id", "at", "seq").agg(F.max(F.struct("op", "payload", "doc", "has")).alias("m")).select("id", "at", "seq", "m.op", "m.doc", "m.has")

    def said(f: str) -> Column:
        value = F.struct(F.col("doc")[f].alias("v"))
        gone = F.struct(F.lit(None).cast(schema[f].dataType).alias("v"))
        return F.when(F.col("op") == DELETE, gone).when((F.col("op") == PUT) | F.array_contains("has", f), value)

    rows = once.withColumns({f"_{f}": said(f) for f in schema.names}).drop("doc", "has")
    rows = carried(rows, "id", ["at", "seq"], {f"_{f}": f for f in schema.names}, "versions")
    rows = rows.withColumn("_next", F.col("at")).drop(*(f"_{f}" for f in schema.names))
    rows = carried(rows, "id", ["at", "seq"], {"_next": "valid_to"}, "next-version", newest_first=True, own=False)
    rows = rows.filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at")))
    return rows.select("id", *(F.col(f)["v"].alias(f) for f in schema.names), (F.col("op") != DELETE).alias("exists"), F.col("at").alias("valid_from"), "valid_to")


def as_of(history: DataFrame, at: Column) -> DataFrame:
    """What exists at a time: the versions that hold then, without those of removed ids."""
    return history.filter(F.col("exists") & (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
