"""Row predicates written in Python, for what SQL cannot express."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def python_predicate(test: Callable, attrs: Sequence[str], vectorized: bool = False) -> Column:
    """A Boolean column of ``test`` over Series (vectorized) or over ``{attribute: value}`` of each row.

    Batches travel through Arrow. NULL arrives as None in rows, as pandas has it in Series.
    """
    names = list(attrs)

    @F.pandas_udf("boolean")
    def keep(*columns: pd.Series) -> pd.Series:
        if vectorized:
            return pd.Series(test(*columns)).fillna(False).astype("bool")
        plain = [c.astype(object).where(c.notna(), None) for c in columns]
        return pd.Series([bool(test(dict(zip(names, row)))) for row in zip(*plain)], dtype="bool")

    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    return keep(*[F.col(q) for q in quoted])
