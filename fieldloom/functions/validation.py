"""Validation rules: kind of answer to a boolean column; blank answers are for the caller to judge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits_only, fold_digits


def _matches(pattern: str, prepare: Callable[[Column], Column] = F.trim) -> Callable[[Column], Column]:
    return lambda value: prepare(value).rlike(pattern)


_D = r"[0-9]+(_[0-9]+)*"
#: A number as it may be written: digits in groups, a point, an exponent, or the words for infinite and none.
NUMBER = rf"(?i)^[+-]?(nan|inf|infinity|({_D}(\.({_D})?)?|\.{_D})(e[+-]?{_D})?)$"


def number(value: Column) -> Column:
    """The number written, null if none is."""
    plain = F.trim(fold_digits(value))
    return F.when(plain.rlike(NUMBER), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))


def amount(value: Column) -> Column:
    for sign in (",", "₹", "Rs.", "Rs"):
        value = F.replace(value, F.lit(sign), F.lit(""))
    return number(value)


def is_date(value: Column) -> Column:
    """d/m/Y, d-m-Y, d.m.Y, Y-m-d or d/m/y of a day that exists."""
    v = fold_digits(F.trim(value))
    shapes = [(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy")]
    out = F.lit(False)
    for shape, form in shapes:
        out = F.when(v.rlike(shape), F.try_to_timestamp(v, F.lit(form)).isNotNull()).otherwise(out)
    return out


def in_range(value: Column, low: Column, high: Column) -> Column:
    """Whether a number lies between bounds, of which null ones don't count."""
    return value.isNotNull() & ~F.coalesce(value < low, F.lit(False)) & ~F.coalesce(value > high, F.lit(False))


def _mobile(value: Column) -> Column:
    d = digits_only(value)
    return F.when((F.length(d) == 12) & d.startswith("91"), F.substring(d, 3, 10)).otherwise(d).rlike("^[6-9][0-9]{9}$")


#: What each kind admits.
KINDS: dict[str, Callable[[Column], Column]] = {
    "date": is_date,
    "integer": _matches(r"^\p{Nd}+$", lambda v: fold_digits(F.trim(v))),
    "decimal": lambda v: number(F.replace(v, F.lit(","), F.lit(""))).isNotNull(),
    "amount": lambda v: F.coalesce(amount(v) >= 0, F.lit(False)),
    "year": _matches(r"^\d{4}$", lambda v: fold_digits(F.trim(v))),
    "mobile_in": _mobile,
    "phone": lambda v: F.length(digits_only(v)).between(6, 15),
    "pincode_in": _matches("^[1-9][0-9]{5}$", digits_only),
    "aadhaar_in": _matches("^[2-9][0-9]{11}$", digits_only),
    "pan_in": _matches("^[A-Z]{5}[0-9]{4}[A-Z]$", lambda v: F.upper(F.replace(v, F.lit(" "), F.lit("")))),
    "ifsc_in": _matches("^[A-Z]{4}0[A-Z0-9]{6}$", lambda v: F.upper(F.replace(v, F.lit(" "), F.lit("")))),
    "bank_account": lambda v: F.length(digits_only(v)).between(8, 20),
    "email": _matches(r"^[^@\s]+@[^@\s.]+\.[^@\s]{2,}$"),
    "blood_group": _matches("(?i)^(A|B|AB|O)[+-]$", lambda v: F.replace(F.trim(v), F.lit(" "), F.lit(""))),
    "alphanumeric": _matches(r"^[A-Za-z0-9][A-Za-z0-9/\-\s]*$"),
    "person_name": _matches(r"^[^\p{Nd}@#$%^&*_=+<>{}\[\]|\\]+$"),
}


def valid(kind: Column, value: Column) -> Column:
    """Whether the answer is what its kind asks for; kinds without a rule admit all, and null is blank: false."""
    out = F.lit(True)
    for name, rule in KINDS.items():
        out = F.when(kind == name, rule(value)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def default_kind(field_type: Column) -> Column:
    """The kind of answers that a field's type stands for."""
    return F.when(field_type == "date", "date").when(field_type == "multiline", "multiline").when(field_type.isin("checkbox", "radio"), "choice").when(field_type == "signature", "signature").otherwise("text")


def verdict(kind: Column, value: Column, options: Column, required: Column, optional: Column, max_length: Column, low: Column, high: Column) -> Column:
    """struct(ok, code): whether an answer stands, and the key of the notice or complaint that goes with it.

    ``options``: number of options chosen. Rules in order: signatures are given by hand; blank answers count only where required; choices
    and what the office fills stand; then length, the kind's rule, and bounds of numbers. Null flags are false, null bounds don't count.
    """
    out = lambda ok, code: F.struct(F.lit(ok).alias("ok"), F.lit(code).cast("string").alias("code"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    blank = (F.trim(F.coalesce(value, F.lit(""))) == "") & (F.coalesce(options, F.lit(0)) == 0)
    of = F.when(kind == "integer", number(value)).when(kind == "decimal", number(F.replace(value, F.lit(","), F.lit(""))))
    bounded = F.when(kind.isin("integer", "decimal"), in_range(of, low, high)).otherwise(True)
    return (
        F.when(kind == "signature", out(True, "sign_by_hand"))
        .when(blank & yes(required) & ~yes(optional), out(False, "required"))
        .when(blank | (kind == "choice"), out(True, None))
        .when(kind == "office_use", out(True, "office_use"))
        .when(yes(F.length(value) > max_length), out(False, "too_long"))
        .when(kind == "attachment", out(True, "attachment"))
        .when(~valid(kind, value), F.struct(F.lit(False).alias("ok"), F.concat(F.lit("bad_"), kind).alias("code")))
        .when(~bounded, out(False, "out_of_range"))
        .otherwise(out(True, None))
    )
