"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_identifier(name: Column) -> Column:
    """Words of an identifier: at dots and underscores, and where camel case turns."""
    x = F.regexp_replace(name, r"[._]+", " ")
    x = F.regexp_replace(x, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    x = F.regexp_replace(x, r"(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def name_tokens(name: Column) -> Column:
    """Distinct parts of a name at dots, underscores and white space."""
    return F.array_distinct(F.filter(F.split(name, r"[._\s]+"), lambda x: x != ""))


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def extension(file: Column) -> Column:
    return F.regexp_extract(file, r"(\.[^./]+)$", 1)


def is_shouting(name: Column) -> Column:
    return (F.upper(name) == name) & (F.lower(name) != name)


def is_type_name(name: Column) -> Column:
    return name.rlike(r"^_*\p{Lu}")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def identifier(name: Column) -> Column:
    """A name as an identifier of Mermaid and DOT."""
    return F.regexp_replace(name, r"[^a-zA-Z0-9_]", "_")


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), (F.length(text) / 4).cast("int"))


def location(file: Column, line: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"))


def snippet(doc: Column) -> Column:
    return F.substring(F.trim(F.substring_index(F.trim(doc), "\n", 1)), 1, 80)


def key_values(text: Column) -> Column:
    """KEY=VALUE pairs, one a comma, as a map. A value may hold = and, where no KEY= follows, commas."""
    parts = F.filter(F.split(text, r",(?=\s*[\w.-]+=)"), lambda x: x.contains("="))
    return F.map_from_entries(F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), x.substr(F.length(F.substring_index(x, "=", 1)) + 2, F.length(x)))))
