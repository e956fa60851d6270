"""Check digits of machine-readable zones and national numbers, as unrolled sums that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS_AND_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _value(data: Column, i: int) -> Column:
    """0 to 35 for the character at i; 0 for the filler and past the end."""
    return F.greatest(F.instr(F.lit(DIGITS_AND_LETTERS), F.substring(data, i + 1, 1)) - 1, F.lit(0))


def weighted_sum(data: Column, length: int) -> Column:
    """The sum of the first characters' values with weights 7, 3, 1, 7, ..."""
    present = [F.when(F.length(data) > i, _value(data, i) * (7, 3, 1)[i % 3]).otherwise(0) for i in range(length)]
    return sum(present[1:], present[0])


def check_digit(data: Column, length: int) -> Column:
    """The check digit of data of at most so many characters, as a number."""
    return weighted_sum(data, length) % 10


def check_digit_valid(data: Column, digit: Column, length: int, strict: bool = True) -> Column:
    """Whether the digit is data's check digit. Strict: other characters than A-Z, 0-9 and < make it false."""
    good = digit.rlike(r"^\d$") & (check_digit(data, length) == F.try_to_number(digit, F.lit("9")).cast("int"))
    return F.coalesce(good & data.rlike("^[A-Z0-9<]*$") if strict else good, F.lit(False))


def ecuador_valid(number: Column) -> Column:
    """Ten digits, the last the modulo 10 check of the first nine (doubled at odd places, less 9 from 10 on)."""

    def term(i: int) -> Column:
        v = F.try_to_number(F.substring(number, i + 1, 1), F.lit("9")).cast("int") * (2 - i % 2)
        return F.when(v >= 10, v - 9).otherwise(v)

    total = sum((term(i) for i in range(1, 9)), term(0))
    return F.coalesce(number.rlike(r"^\d{10}$") & ((10 - total % 10) % 10 == F.try_to_number(F.substring(number, 10, 1), F.lit("9")).cast("int")), F.lit(False))
