"""Arrow-batched name helpers. They run on distinct names only."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def title_name(names: pd.Series) -> pd.Series:
    """Strip and capitalise after every non-letter ('x-ray' -> 'X-Ray')."""
    return names.map(lambda v: None if v is None else v.strip().title())


@F.pandas_udf(T.DoubleType())
def name_ratio(candidates: pd.Series, names: pd.Series) -> pd.Series:
    """Matching-block similarity of two names, 0 to 1."""
    return pd.Series(
        [difflib.SequenceMatcher(None, c, n).ratio() for c, n in zip(candidates, names)], dtype="float64"
    )
