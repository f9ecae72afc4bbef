"""Base58 text of binary keys."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed alphabet of the encoding.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


@lru_cache(maxsize=65_536)  # the same keys come again and again
def encode(data: bytes) -> str:
    """Big-endian number in base 58; every leading zero byte becomes a leading '1'."""
    number, digits = int.from_bytes(data, "big"), []
    while number:
        number, d = divmod(number, 58)
        digits.append(ALPHABET[d])
    zeros = len(data) - len(data.lstrip(b"\0"))
    return ALPHABET[0] * zeros + "".join(reversed(digits))


@F.pandas_udf(StringType())
def base58(values: pd.Series) -> pd.Series:
    return values.map(lambda b: None if b is None else encode(bytes(b)))
