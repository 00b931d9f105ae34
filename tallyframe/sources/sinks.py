"""Writers: each commits as a whole."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """df with arrays, maps and structs as JSON text, for CSV."""
    deep = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, deep) else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, once: bool = False) -> None:
    """A CSV table with a header; once: refuses to replace an earlier one."""
    flat(df).write.mode("errorifexists" if once else "overwrite").csv(path, header=True)


def _not_finite(c: Column, kind: T.DataType) -> Column | None:
    """Whether a value holds a NaN or infinite number; None where its type has no place for one."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.isnan(c) | (F.abs(c) == float("inf"))
    if isinstance(kind, T.ArrayType):
        return None if _not_finite(c, kind.elementType) is None else F.exists(c, lambda x: F.coalesce(_not_finite(x, kind.elementType), F.lit(False)))
    if isinstance(kind, T.MapType):
        inner = [_not_finite(F.map_keys(c), T.ArrayType(kind.keyType)), _not_finite(F.map_values(c), T.ArrayType(kind.valueType))]
    elif isinstance(kind, T.StructType):
        inner = [_not_finite(c.getField(f.name), f.dataType) for f in kind.fields]
    else:
        return None
    found = [F.coalesce(x, F.lit(False)) for x in inner if x is not None]
    return reduce(or_, found) if found else None


def write_json(df: DataFrame, path: str, once: bool = False) -> None:
    """Strict JSON lines: a NaN or infinite number, however deep in arrays, structs and maps, stops the write."""
    bad = {f.name: _not_finite(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    checked = [
        F.col(f"`{f.name}`") if bad[f.name] is None else F.when(F.coalesce(bad[f.name], F.lit(False)), F.raise_error(F.lit(f"{f.name} is not finite")).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema.fields
    ]
    df.select(*checked).write.mode("errorifexists" if once else "overwrite").json(path)


def dump_once(path: str, obj: object) -> None:
    """A plan or receipt as strict JSON in a file that must not exist; an equal one may."""
    text = json.dumps(obj, ensure_ascii=False, allow_nan=False, indent=1, sort_keys=True)
    try:
        with open(path, "x", encoding="utf-8") as f:
            f.write(text)
    except FileExistsError:
        with open(path, encoding="utf-8") as f:
            if f.read() != text:
                raise ValueError(f"{path} holds another plan") from None


def softmax_spec(features: Iterable[str], classes: Iterable[str], mean: Iterable[float], scale: Iterable[float], weights: Iterable[Iterable[float]], bias: Iterable[float]) -> dict:
    """A softmax model as plain JSON values; all must be finite."""
    spec = {"kind": "softmax", "features": list(features), "classes": list(classes), "mean": list(mean), "scale": list(scale), "weights": [list(w) for w in weights], "bias": list(bias)}
    for v in (*spec["mean"], *spec["scale"], *spec["bias"], *(x for w in spec["weights"] for x in w)):
        if not math.isfinite(v):
            raise ValueError("a parameter is not finite")
    return spec
