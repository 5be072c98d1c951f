"""Functions without an expression form, in Arrow batches."""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

from lakeask.plans.replies import text_list


def sequence_ratio():
    """Ratcliff-Obershelp similarity of two texts."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio


def recover_json_array():
    """Tolerant reading of a list of texts from a model's reply."""

    @F.pandas_udf("array<string>")
    def recover(replies: pd.Series) -> pd.Series:
        return pd.Series([text_list(r) for r in replies], dtype=object)

    return recover
