"""Validation of structured-data items by expressions over JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required properties by lower-case type.
REQUIRED = {
    "product": ["name"],
    "article": ["headline"],
    "newsarticle": ["headline"],
    "blogposting": ["headline"],
    "breadcrumblist": ["itemlistelement"],
    "recipe": ["name"],
    "event": ["name", "startdate"],
    "faqpage": ["mainentity"],
    "qapage": ["mainentity"],
    "localbusiness": ["name", "address"],
    "organization": ["name"],
    "person": ["name"],
    "videoobject": ["name", "thumbnailurl", "uploaddate"],
    "jobposting": ["title", "dateposted", "hiringorganization"],
}
_OBJECTS = "array<string>"


def _starts(text: Column, sign: str) -> Column:
    return F.coalesce(F.ltrim(text).startswith(sign), F.lit(False))


def items(raw: Column) -> Column:
    """The objects of an item: those of its @graph or list, or itself; empty for other shapes."""
    graph = F.from_json(F.get_json_object(raw, "$['@graph']"), _OBJECTS)
    objects = lambda a: F.filter(a, lambda x: _starts(x, "{"))
    one = F.when(F.coalesce(F.size(graph), F.lit(0)) > 0, objects(graph)).otherwise(F.array(raw))
    empty = F.array().cast(_OBJECTS)
    return F.when(_starts(raw, "{"), one).when(_starts(raw, "["), objects(F.from_json(raw, _OBJECTS))).otherwise(empty)


def types(item: Column) -> Column:
    """The declared types of an object, of @type or else type."""
    t = F.coalesce(F.get_json_object(item, "$['@type']"), F.get_json_object(item, "$.type"))
    many = F.filter(F.from_json(t, _OBJECTS), lambda x: x.isNotNull() & (x != ""))
    return F.when(t.isNull(), F.array().cast(_OBJECTS)).when(_starts(t, "["), many).otherwise(F.array(t))


def problems(item: Column) -> Column:
    """What an object lacks: its type, or properties that its types require (names in any case)."""
    present = F.transform(F.json_object_keys(item), lambda k: F.lower(k))
    known = F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    each = F.transform(types(item), lambda t: F.transform(F.filter(F.coalesce(known[F.lower(t)], F.array().cast(_OBJECTS)), lambda p: ~F.array_contains(present, p)), lambda p: F.concat(t, F.lit(": missing required property '"), p, F.lit("'"))))
    return F.when(F.size(types(item)) == 0, F.array(F.lit("missing @type"))).otherwise(F.flatten(each))


def checked(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """rows with schema_type, validation_status (ok, warning, error) and validation_issues of a JSON text column."""
    found = F.flatten(F.transform(items(F.col(raw)), problems))
    d = rows.withColumn("validation_issues", F.coalesce(found, F.array().cast(_OBJECTS)))
    bad = F.exists("validation_issues", lambda x: x == "missing @type")
    status = F.when(F.size("validation_issues") == 0, "ok").when(bad, "error").otherwise("warning")
    return d.withColumn("validation_status", status).withColumn("schema_type", F.when(_starts(F.col(raw), "{"), F.nullif(F.array_join(types(F.col(raw)), ", "), F.lit(""))))
