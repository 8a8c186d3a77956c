"""Deterministic experiment assignment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from footfall.schema import CONTROL, TREATMENT

# Hexadecimal digits that stand for an odd number.
ODD_HEX_DIGITS = ("1", "3", "5", "7", "9", "b", "d", "f")


def md5_variant(user_id: Column, control: str = CONTROL, treatment: str = TREATMENT) -> Column:
    """Variant by the parity of the user's md5 digest read as one big integer.

    A number written in base 16 is odd exactly when its last digit is, so the
    128-bit integer never has to be built.
    """
    last_digit = F.right(F.md5(user_id.cast("string")), F.lit(1))
    return F.when(last_digit.isin(*ODD_HEX_DIGITS), treatment).otherwise(control)
