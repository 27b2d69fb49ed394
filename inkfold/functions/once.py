"""Keep an expensive column from being computed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def compute_once(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns settled at this point of the plan.

    The optimizer moves a filter below the projection that makes its column, and
    puts a copy of the whole expression there (and one for each use in it).  For a
    JSON parse or an article extraction that costs far more than the filter saves.
    A one-element generator is a border it does not move filters across; it adds no
    shuffle and stays in the same stage.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline_outer(F.array(F.struct(*names))))
