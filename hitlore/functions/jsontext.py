"""JSON objects in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def single_object(text: Column) -> Column:
    """The fields of a text that is one JSON object without repeated keys and nothing beside it, as map<string,variant>; else NULL.

    The text is parsed inside brackets, so that what follows the object is an error; two objects in a text are two elements.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.try_variant_get(boxed, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(boxed, "$[0]", "map<string,variant>"))


def is_single_object(text: Column) -> Column:
    """Whether single_object has fields to give, without taking them out."""
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = boxed.isNotNull() & F.try_variant_get(boxed, "$[1]", "variant").isNull()
    return F.coalesce(alone & text.rlike(r"\A[ \t\n\r]*\{"), F.lit(False))
