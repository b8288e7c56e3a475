"""Changes to tables as functions from the old rows and a batch to the new rows, and checks of batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def replace(old: Column, new: Column) -> Column:
    return new


def add(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


def least(old: Column, new: Column) -> Column:
    return F.least(old, new)


def greatest(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def keep(old: Column, new: Column) -> Column:
    return old


def fill(old: Column, new: Column) -> Column:
    """The new value where there is one."""
    return F.coalesce(new, old)


def upsert(old: DataFrame, batch: DataFrame, keys: list[str], resolve: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """old with the batch merged in: rows of new keys are added, rows of known keys are resolved column by column (replaced by default).

    Null keys are equal to each other. The batch must have each key once; columns that it lacks keep their old values and are null in added rows.
    """
    resolve = resolve or {}
    on = None
    for k in keys:
        same = F.col(f"o.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    o = old.withColumn("__o", F.lit(True)).alias("o")
    b = batch.withColumn("__b", F.lit(True)).alias("b")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.when(F.col("o.__o"), F.col(f"o.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        elif c not in batch.columns:
            out.append(F.col(f"o.{c}").alias(c))
        else:
            both = resolve.get(c, replace)(F.col(f"o.{c}"), F.col(f"b.{c}"))
            out.append(F.when(F.col("b.__b").isNull(), F.col(f"o.{c}")).when(F.col("o.__o").isNull(), F.col(f"b.{c}")).otherwise(both).cast(old.schema[c].dataType).alias(c))
    return o.join(b, on, "full").select(out)


def new_rows(old: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch whose key old hasn't."""
    known = old.select(*[F.col(k).alias(f"__{k}") for k in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    return batch.join(known, on, "left_anti")


def insert_new(old: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of the batch whose key it hasn't."""
    return old.unionByName(new_rows(old, batch, keys))


def update(old: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return old.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c in values else F.col(c) for c in old.columns])


def delete(old: DataFrame, where: Column) -> DataFrame:
    return old.where(~F.coalesce(where, F.lit(False)))


class ConstraintError(ValueError):
    """A batch breaks a constraint."""


def check(batch: DataFrame, name: str, condition: Column) -> None:
    """Raise if the condition is false for a row; unknown passes."""
    if not batch.where(~condition).isEmpty():
        raise ConstraintError(f"check {name} fails")


def foreign_key(batch: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> None:
    """Raise if a row's key, with no null in it, isn't in the parent."""
    own = batch.select(*columns).dropna()
    theirs = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_columns, columns, strict=True)])
    if not own.join(theirs, columns, "left_anti").isEmpty():
        raise ConstraintError(f"foreign key {columns} has rows without a parent")


def unique(batch: DataFrame, columns: list[str], old: DataFrame | None = None) -> None:
    """Raise if a key occurs twice in the batch and old."""
    rows = batch.select(*columns) if old is None else batch.select(*columns).unionByName(old.select(*columns))
    if not rows.groupBy(*columns).count().where("count > 1").isEmpty():
        raise ConstraintError(f"key {columns} isn't unique")
