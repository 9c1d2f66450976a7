"""Objects and arrays out of texts that hold broken or fenced JSON.

The native parser is tried first; only rows that it rejects go to Python, in batches.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def balanced(text: str, opening: str) -> object:
    """The first part from an opening bracket to its match that parses; strings and escapes count. None without one."""
    closing = {"{": "}", "[": "]"}[opening]
    at = text.find(opening)
    while at >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(at, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif c == "\\":
                skip = quoted
            elif c == '"':
                quoted = not quoted
            elif not quoted and c == opening:
                depth += 1
            elif not quoted and c == closing:
                depth -= 1
                if not depth:
                    try:
                        return json.loads(text[at : i + 1])
                    except ValueError:
                        break
        at = text.find(opening, at + 1)
    return None


def repaired(text: str | None, opening: str = "{") -> str | None:
    """JSON text of the object (or array) inside; an object found where an array is wanted becomes its only element."""
    if not text:
        return None
    for part in [*FENCE.findall(text), text]:
        try:
            found = json.loads(part.strip())
        except ValueError:
            found = None
        inner = found if isinstance(found, dict if opening == "{" else list) else balanced(part, opening)
        if inner is not None:
            return json.dumps(inner)
        if opening == "[":
            one = found if isinstance(found, dict) else balanced(part, "{")
            if isinstance(one, dict):
                return json.dumps([one])
    return None


def _udf(opening: str):
    @F.pandas_udf("string")
    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: repaired(t, opening))

    return repair


def json_object(c: Column) -> Column:
    """JSON text of an object; null if none can be found."""
    good = F.startswith(F.schema_of_variant(F.try_parse_json(c)), F.lit("OBJECT"))
    return F.when(F.coalesce(good, F.lit(False)), c).otherwise(_udf("{")(F.when(~F.coalesce(good, F.lit(False)), c)))


def json_array(c: Column) -> Column:
    good = F.startswith(F.schema_of_variant(F.try_parse_json(c)), F.lit("ARRAY"))
    return F.when(F.coalesce(good, F.lit(False)), c).otherwise(_udf("[")(F.when(~F.coalesce(good, F.lit(False)), c)))


def scores(c: Column, names: list[str], low: float = 0.0, high: float = 10.0, default: float = 5.0) -> Column:
    """struct of one number for each name, numeric strings taken, clamped; the default where it is missing or no number."""
    value = lambda n: F.get_json_object(c, f"$.{n}")
    number = lambda n: F.when(F.rlike(value(n), F.lit(r"^\s*[+-]?[0-9]+(\.[0-9]+)?\s*$")), value(n).try_cast("double"))
    clamped = lambda n: F.when(number(n).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), number(n))))
    return F.struct(*[F.coalesce(clamped(n), F.lit(default)).alias(n) for n in names])
