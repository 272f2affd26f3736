"""JSON texts as values: strict parsing, and equality that ignores the order of keys and of array members."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_value(value: object, key: str | None = None) -> object:
    """A value in a form in which equal values are equal: arrays sorted, spaces of expressions out, 1 and 1.0 and True apart."""
    if isinstance(value, dict):
        return ["object", *sorted(([k, canonical_value(v, k)] for k, v in value.items()), key=lambda x: x[0])]
    if isinstance(value, list):
        return ["array", *sorted((canonical_value(v) for v in value), key=lambda x: json.dumps(x, ensure_ascii=False))]
    if isinstance(value, str) and key == "expression":
        value = "".join(value.split())
    return [type(value).__name__, value]


def canonical_text(text: str | None) -> str | None:
    try:
        return json.dumps(canonical_value(json.loads(text)), ensure_ascii=False) if text is not None else None
    except ValueError:
        return None


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return pd.Series([canonical_text(x if isinstance(x, str) else None) for x in texts], dtype=object)


def canonical_json(c: Column) -> Column:
    """Canonical text of a JSON document; null if it is none."""
    return _canonical(c)


def strict_json(c: Column) -> Column:
    """The document as VARIANT, null if it isn't valid JSON to its end."""
    clean = F.trim(c)
    closed = F.when(F.startswith(clean, F.lit("{")), F.endswith(clean, F.lit("}"))).when(F.startswith(clean, F.lit("[")), F.endswith(clean, F.lit("]"))).otherwise(F.lit(True))
    return F.when(closed, F.try_parse_json(clean))
