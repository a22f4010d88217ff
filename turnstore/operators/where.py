"""The filter language of document queries: {field: value}, or {"$and": [filters]}, compiled to a column."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstore.schemas import INDEXED


def parse_where(where: dict | None) -> list[tuple[str, str | int | float]]:
    """The equality predicates of a filter, all of which must hold; ValueError for anything else."""
    if where is None:
        return []
    if not isinstance(where, dict) or len(where) != 1:
        raise ValueError(f"a filter has one key: {where!r}")
    field, value = next(iter(where.items()))
    if field == "$and":
        if not isinstance(value, list) or not value:
            raise ValueError("$and takes a list of filters")
        return [p for part in value for p in parse_where(part)]
    if field.startswith("$"):
        raise ValueError(f"unsupported operator {field}")
    if not isinstance(value, (str, int, float)):
        raise ValueError(f"unsupported value for {field}: {value!r}")
    return [(field, value)]


def predicate(field: str, value: str | int | float) -> Column:
    """Equality that is strict about strings and numbers; a field that is missing equals nothing."""
    text = isinstance(value, str)
    if field in INDEXED:
        return F.col(field) == F.lit(value if text or isinstance(value, float) else int(value)) if text == (INDEXED[field] == "string") else F.lit(False)
    held = F.col("extras")[field]
    if text:
        return held == F.lit(json.dumps(value, ensure_ascii=False))
    number = F.when(held == "true", 1.0).when(held == "false", 0.0).otherwise(held.try_cast("double"))
    return number == F.lit(float(value))


def compile_where(where: dict | None) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(predicate(f, v), F.lit(False)) if f not in INDEXED else predicate(f, v) for f, v in parse_where(where)), F.lit(True))
