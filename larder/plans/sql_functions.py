"""The text functions under names of SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.page import decoded, page_text, page_text_by_density
from larder.functions.text import clean_exactly, unescape_and_compose
from larder.operators.chunking import OVERLAP, SIZE, split_text


def register(spark: SparkSession) -> None:
    """``main_text(html)``, ``dense_text(html)``, ``decoded_text(bytes)``, ``clean_text(text)``, ``composed_text(text)`` and ``chunks_of(text)``, an
    array that ``explode`` or ``posexplode`` turns into rows, for this session's SQL. Null gives null, or no chunk."""
    cut = F.pandas_udf(lambda texts: pd.Series([split_text(t, SIZE, OVERLAP) for t in texts], dtype=object), T.ArrayType(T.StringType()))
    for name, function in (("main_text", page_text), ("dense_text", page_text_by_density), ("decoded_text", decoded), ("clean_text", clean_exactly), ("composed_text", unescape_and_compose), ("chunks_of", cut)):
        spark.udf.register(name, function)
