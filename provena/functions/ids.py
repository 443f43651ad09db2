"""Ids that are integers or strings: a struct of type and text, which orders by type and then by text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_TYPE = "struct<id_type: string, id: string>"


def int_id(c: Column) -> Column:
    return F.struct(F.lit("int").alias("id_type"), c.cast("string").alias("id"))


def str_id(c: Column) -> Column:
    return F.struct(F.lit("str").alias("id_type"), c.alias("id"))


def number_of(c: Column) -> Column:
    """The integer of an integer id."""
    return F.when(c["id_type"] == "int", c["id"].try_cast("bigint"))


def id_token(c: Column) -> Column:
    """Compact JSON such as ``["int",1]`` or ``["str","a"]``."""
    text = F.when(c["id_type"] == "int", c["id"]).otherwise(json_string(c["id"]))
    return F.concat(F.lit('["'), c["id_type"], F.lit('",'), text, F.lit("]"))


def json_string(c: Column) -> Column:
    """A JSON string literal of the text."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def id_repr(c: Column) -> Column:
    """The id as a Python literal: ``1`` or ``'a'``."""
    return F.when(c["id_type"] == "int", c["id"]).otherwise(text_repr(c["id"]))


def text_repr(c: Column) -> Column:
    """A text as a Python literal, in single quotes unless it holds some and no double ones."""
    plain = c
    for sign, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(sign), F.lit(written))
    double = c.contains("'") & ~c.contains('"')
    single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(single)


def ids_json(c: Column) -> Column:
    """Compact JSON of a list of ids: ``[["int","1"],["str","a"]]``."""
    return F.to_json(F.transform(c, lambda x: F.array(x["id_type"], x["id"])))


def lookup_id(wanted: Column, known: Column) -> Column:
    """Rank of a match between a wanted and a known id: 0 exact, 1 across types by number text, null none."""
    crossed = (wanted["id_type"] != known["id_type"]) & (wanted["id"] == known["id"]) & wanted["id"].rlike("^[0-9]+$")
    return F.when(wanted == known, 0).when(crossed, 1)
