"""Rows carried through an operator without their column names getting in its way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, named doc_."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc_")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): all other columns as one struct."""
    others = [F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, *([] if others else [F.lit(None).alias("none")])).alias("rest"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, from rows with those of :func:`packed` or :func:`whole_row`."""
    if "doc_" in rows.columns:
        return rows.select(*[F.col("doc_").getField(c).alias(c) for c in docs.columns])
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


def unused(columns: list[str], name: str) -> str:
    """``name``, or it with as many underscores more as no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
