"""Names and schemas of added columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from all that are taken (in any case)."""
    held = {t.lower() for t in taken}
    found = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        found.append(name)
    return found


def extended(df: DataFrame, columns: Iterable[str], added: str) -> StructType:
    """Columns of ``df`` as they are, followed by those of a schema text."""
    return StructType([*(df.schema[c] for c in columns), *StructType.fromDDL(added).fields])
