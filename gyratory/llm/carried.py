"""Rows that go through an operator with their own columns out of its way."""

from __future__ import annotations

import uuid
from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def carried(docs: DataFrame, *needed: str, once: Collection[str] = ()) -> tuple[DataFrame, str]:
    """(`needed` columns and one struct of all columns of `docs`, the struct's name): no other column can meet a name that an operator uses inside.

    Columns named in `once` are not in the struct; `restored` has to be given them.
    """
    name = f"_all_{uuid.uuid4().hex}"
    return docs.select(*[_named(c) for c in needed], F.struct(*[_named(c) for c in docs.columns if c not in once]).alias(name)), name


def restored(rows: DataFrame, name: str, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that `carried` put away, in their order; those in `changed` take the given values instead, new ones come last."""
    own = [changed.get(c, F.col(name).getField(c)).alias(c) for c in columns]
    return rows.select(*own, *[v.alias(c) for c, v in changed.items() if c not in columns])
