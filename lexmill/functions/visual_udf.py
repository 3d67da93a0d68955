"""Column form of the per-value consistent form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexmill.functions.lookalike import consistent


@F.pandas_udf(StringType())
def consistent_udf(texts: pd.Series) -> pd.Series:
    """Consistent form of each text; null for null. Give it suspect texts only."""
    return texts.map(consistent, na_action="ignore")
