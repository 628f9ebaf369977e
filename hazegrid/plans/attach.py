"""Joining small per-key tables back to rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.session import checkpointed

BROADCAST_BYTES = 64 * 1024 * 1024
SPREAD = 64


def keeps_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Operators name their own columns with a leading underscore. Columns of the caller that begin so are
    called otherwise inside and get their names back in the result, as do the arguments that name them."""

    @wraps(operator)
    def run(df: DataFrame, *args, **named) -> DataFrame:
        odd: dict[str, str] = {}
        for c in df.columns:
            if c.startswith("_"):
                odd[c] = next(n for i in range(len(df.columns) + 1) if (n := f"own{i}{c}") not in df.columns)
        if not odd:
            return operator(df, *args, **named)

        def swap(v):
            if isinstance(v, str):
                return odd.get(v, v)
            if isinstance(v, Mapping):
                return {swap(k): swap(x) for k, x in v.items()}
            return type(v)(map(swap, v)) if isinstance(v, (list, tuple)) else v

        out = operator(df.withColumnsRenamed(odd), *map(swap, args), **{k: swap(v) for k, v in named.items()})
        back = {c: reduce(lambda name, pair: name.replace(pair[1], pair[0]), odd.items(), c) for c in out.columns}
        return out.toDF(*[back[c] for c in out.columns])

    return run


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys, null being equal to null; the key columns are the left ones."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_right_{k}" for k in keys])


def measured_bytes(df: DataFrame) -> int:
    """Size of a stored table: every value written out as text, and some overhead each."""
    sizes = [F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)) + 16 for f in df.schema.fields]
    return df.agg(F.sum(reduce(lambda a, b: a + b, sizes))).first()[0] or 0


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Left-join ``small`` (unique on ``keys``) to ``df``; null keys meet null keys.

    Without keys ``small`` is one row; its values become literals of the plan. With keys it is
    computed once into the checkpoint folder and measured: up to 64 MB it is broadcast and the
    rows never move. Beyond that the rows are hashed on (keys, salt) against
    a copy of ``small`` per salt, so that one hot key still spreads over many tasks.
    """
    if not keys:
        row = small.first()
        values = [_literal(row[f.name], f.dataType).alias(f.name) for f in small.schema.fields]
        return df.select("*", *values)
    small = checkpointed(small)
    if measured_bytes(small) <= BROADCAST_BYTES:
        return join_null_safe(df, F.broadcast(small), keys, how)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))))
    return join_null_safe(salted, copies, [*keys, "_salt"], how).drop("_salt")


def _literal(value, kind: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.array(*[_literal(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value).cast(kind)

