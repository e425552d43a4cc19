"""Newline-delimited JSON under a declared schema, and objects whose fields drift.

``read_declared`` checks every record against declared types and modes: a REQUIRED field that is missing or
null, a REPEATED one that is no array (or holds a null), a RECORD that is no object and a value of another type
each make a bad record, with the field named. ``shredded`` takes the used fields out of objects that were not
declared at all, each row by the types it happens to have. Both parse a line once, into a VARIANT.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.sinks import materialize

# declared type -> Spark type, and how the type of a parsed JSON value may begin
TYPES = {
    "STRING": ("string", ("STRING",)),
    "INTEGER": ("bigint", ("BIGINT",)),
    "FLOAT": ("double", ("BIGINT", "DOUBLE", "DECIMAL")),
    "BOOLEAN": ("boolean", ("BOOLEAN",)),
    "RECORD": (None, ("OBJECT",)),
}
MODES = ("NULLABLE", "REQUIRED", "REPEATED")
ERRORS = "_errors"


@dataclass(frozen=True)
class Declared:
    """A field: name, type, mode and, for a RECORD, its fields."""

    name: str
    type: str = "STRING"
    mode: str = "NULLABLE"
    fields: tuple["Declared", ...] = ()

    def __post_init__(self) -> None:
        if self.type not in TYPES or self.mode not in MODES or (self.type == "RECORD") != bool(self.fields):
            raise ValueError(f"bad declaration of {self.name!r}: {self.type} {self.mode}")
        if any(c in self.name for c in "'\"[]\\"):
            raise ValueError(f"bad field name {self.name!r}")


def _get(v: Column, name: str) -> Column:
    """The value of a field as a variant; NULL if it is missing, null, or ``v`` is no object."""
    got = F.try_variant_get(v, f"$['{name}']", "variant")
    return F.when(~F.is_variant_null(got), got)


def _is(v: Column, kind: str) -> Column:
    found = F.schema_of_variant(v)
    return F.greatest(*[F.startswith(found, F.lit(x)) for x in TYPES[kind][1]], F.lit(False))


def _one(v: Column, field: Declared, path: str) -> tuple[Column, Column]:
    """The typed value of a present ``v`` and the array of what is wrong with it."""
    wrong = F.array(F.lit(f"{path}: not {field.type}"))
    none = F.array().cast("array<string>")
    if field.type != "RECORD":
        return F.try_variant_get(v, "$", TYPES[field.type][0]), F.when(_is(v, field.type), none).otherwise(wrong)
    parts = [(f, *_field(v, f, f"{path}.{f.name}")) for f in field.fields]
    inner = F.concat(*[e for _, _, e in parts])
    return F.struct(*[x.alias(f.name) for f, x, _ in parts]), F.when(_is(v, "RECORD"), inner).otherwise(wrong)


def _field(v: Column, field: Declared, path: str) -> tuple[Column, Column]:
    """The typed value of a field of ``v`` and the array of what is wrong with it."""
    got, none = _get(v, field.name), F.array().cast("array<string>")
    if field.mode == "REPEATED":
        items = F.try_variant_get(got, "$", "array<variant>")
        good = F.startswith(F.schema_of_variant(got), F.lit("ARRAY"))
        empty = lambda x: F.coalesce(F.is_variant_null(x), F.lit(True))
        each = lambda x: F.when(empty(x), F.array(F.lit(f"{path}[]: null"))).otherwise(_one(x, field, f"{path}[]")[1])
        errors = F.array_distinct(F.flatten(F.transform(items, each)))
        wrong = F.when(got.isNull(), none).when(good, errors).otherwise(F.array(F.lit(f"{path}: not REPEATED")))
        return F.coalesce(F.transform(items, lambda x: _one(x, field, path)[0]), F.array()), wrong
    value, wrong = _one(got, field, path)
    missing = F.array(F.lit(f"{path}: required")) if field.mode == "REQUIRED" else none
    return F.when(got.isNotNull(), value), F.when(got.isNull(), missing).otherwise(wrong)


def checked(lines: DataFrame, fields: list[Declared], line_col: str = "value") -> DataFrame:
    """The declared columns of JSON lines, and _errors: what is wrong, "field: reason" (none: empty). Blank lines are left out; a
    line that is no JSON object has the one error "record: not an object". Fields that are not declared are ignored."""
    v = F.col("_v")
    parts = [(f, *_field(v, f, f.name)) for f in fields]
    parsed = lines.where(F.trim(line_col) != "").select(F.try_parse_json(line_col).alias("_v"))
    is_object = F.coalesce(_is(v, "RECORD"), F.lit(False))
    errors = F.when(is_object, F.concat(*[e for _, _, e in parts])).otherwise(F.array(F.lit("record: not an object")))
    return parsed.select(*[x.alias(f.name) for f, x, _ in parts], errors.alias(ERRORS))


def read_declared(spark: SparkSession, path: str | list[str], fields: list[Declared], max_bad_records: int = 0) -> DataFrame:
    """The good records, if no more than ``max_bad_records`` are bad; else a ValueError that names the fields with errors, the most
    frequent first. Records are checked once, over all fields, and saved, whatever columns the caller reads."""
    saved = materialize(checked(spark.read.text(path), fields), "declared-json")
    bad = saved.where(F.size(ERRORS) > 0)
    n = bad.count()
    if n > max_bad_records:
        worst = bad.select(F.explode(ERRORS).alias("e")).groupBy("e").count().orderBy(F.desc("count"), "e").limit(10).collect()
        raise ValueError(f"{n} bad records exceed the limit of {max_bad_records}: " + "; ".join(f"{r['e']} ({r['count']})" for r in worst))
    return saved.where(F.size(ERRORS) == 0).drop(ERRORS)


# where drifting dumps have a post's fields: the first of these that is there and has a fitting type
TEXT_AT = {"author": ("author", "author.name"), "subreddit": ("subreddit", "subreddit.name"), "title": ("title",), "selftext": ("selftext", "body.text"),
           "body": ("body", "body.text")}
TIME_AT = ("created_utc", "created")


def shredded(lines: DataFrame, names: list[str], line_col: str = "value") -> DataFrame:
    """The named fields of raw posts whose objects changed over time: an author may be a text or an object with a name, a
    time a whole number, a decimal one or digits in a text. What fits no form is NULL, as are lines that are no JSON."""
    v = F.col("_v")

    def at(path: str) -> Column:
        out = v
        for name in path.split("."):
            out = _get(out, name)
        return out

    text = lambda x: F.when(_is(x, "STRING"), F.try_variant_get(x, "$", "string"))
    number = lambda x: F.when(_is(x, "FLOAT"), F.try_variant_get(x, "$", "double").cast("bigint")).when(
        _is(x, "STRING"), F.try_variant_get(x, "$", "string").try_cast("double").try_cast("bigint"))
    cols = [F.coalesce(*[number(at(p)) for p in TIME_AT]) if n == "created_utc" else F.coalesce(*[text(at(p)) for p in TEXT_AT[n]]) for n in names]
    return lines.select(F.try_parse_json(line_col).alias("_v")).select(*[c.alias(n) for c, n in zip(cols, names)])
