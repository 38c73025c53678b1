"""Masking of personal data: the four column masks and the pass over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The white space that separates words of a name.
NAME_BREAK = (
    "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
)


def mask_aadhaar(value: Column) -> Column:
    """Keep the last four of twelve digits; fewer than four characters give null.

    Only ASCII digits count as digits.
    """
    digits = F.translate(value, " -", "")
    is_number = (F.length(digits) == 12) & ~digits.rlike("[^0-9]")
    return (
        F.when(value.isNull() | (F.length(value) < 4), F.lit(None).cast("string"))
        .when(is_number, F.concat(F.lit("XXXX-XXXX-"), F.right(digits, F.lit(4))))
        .otherwise(F.lit("INVALID_AADHAAR"))
    )


def mask_phone(value: Column) -> Column:
    """Keep the last four characters of a number of at least eight; digits are not checked."""
    bare = F.translate(value, "+- ", "")
    hidden = F.repeat(F.lit("X"), F.length(bare) - 4)
    return F.when(F.length(bare) < 8, F.lit("INVALID_PHONE")).otherwise(
        F.concat(hidden, F.right(bare, F.lit(4)))
    )


def mask_email(value: Column) -> Column:
    """Keep the first letter and everything after the first ``@``; no ``@`` gives null."""
    at = F.instr(value, "@")
    domain = value.substr(at + 1, F.length(value))
    return (
        F.when(at.between(1, 2), F.concat(F.lit("*@"), domain))
        .when(at > 2, F.concat(F.left(value, F.lit(1)), F.lit("***@"), domain))
    )


def mask_name(value: Column) -> Column:
    """``ravi kumar`` becomes ``R. K.``; an empty name becomes a single full stop."""
    words = F.filter(F.split(value, NAME_BREAK), lambda word: word != "")
    initials = F.transform(words, lambda word: F.upper(F.left(word, F.lit(1))))
    return F.concat(F.array_join(initials, ". "), F.lit("."))


#: input column -> (output column, mask); output columns go last, in this order.
MASKS = {
    "aadhaar": ("aadhaar_masked", mask_aadhaar),
    "phone": ("phone_masked", mask_phone),
    "email": ("email_masked", mask_email),
    "name": ("name_initials", mask_name),
}
