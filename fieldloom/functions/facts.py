"""Facts of identity cards read from their text, as columns over the array of its lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bound

# Patterns of numbers on cards, words of printed headings, labels of facts.
AADHAAR = r"(?<![0-9])([2-9][0-9]{3})[ -]?([0-9]{4})[ -]?([0-9]{4})(?![0-9])"
PAN = r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"
EPIC = r"\b([A-Z]{3}[0-9]{7})\b"
DATE = r"\b([0-9]{2})[/.-]([0-9]{2})[/.-]([0-9]{4})\b"
PIN = r"(?<![0-9])([1-9][0-9]{5})(?![0-9])"
HEADING = r"(?i)government|india|uidai|income tax|department|authority|identification|aadhaar|aadhar|unique|permanent account|male|female|address|dob"
CARE_OF = r"(?i)^(?:s/o|d/o|c/o|son of|daughter of)"
NAME_LABELS = ["name", "full name", "applicant name", "applicant's name", "नाम", "पूरा नाम"]
FATHER_LABELS = ["father's name", "father name", "fathers name", "पिता का नाम"]
BIRTH_LABELS = ["dob", "d.o.b", "date of birth", "birth date", "जन्म तिथि", "जन्म दिनांक"]
ADDRESS_LABELS = ["address", "पता"]
#: Lines of one to six words, and of two to six.
FEW_WORDS = r"^\s*+\S++(?:\s++\S++){0,5}+\s*+$"
SEVERAL_WORDS = r"^\s*+\S++(?:\s++\S++){1,5}+\s*+$"
FACTS = ["kind", "full_name", "father_name", "gender", "date_of_birth", "aadhaar_number", "pan_number", "voter_id", "address", "pincode"]
OTHER_PERSONS = ["father", "mother", "spouse", "husband", "wife", "nominee", "guardian", "witness", "relative"]


def lines_of(text: Column) -> Column:
    """Tidy lines that are not empty."""
    tidy = lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[ |]+|[ |]+$", "")
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), tidy), lambda x: x != "")


def first_of(values: Column) -> Column:
    """The first value of an array that is not null."""
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _after(lines: Column, at: Column, n: int = 1 << 30) -> Column:
    """Up to n lines behind the one at a place."""
    return F.slice(lines, at + 2, n)


def _bare(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), ":+$", ""))


def kind(text: Column) -> Column:
    return bound(F.lower(F.coalesce(text, F.lit(""))), _kind)


def _names_pan(low: Column) -> Column:
    return low.contains("permanent account") | (low.contains("pan") & low.rlike(r"\bpan\b"))


def _kind(low: Column) -> Column:
    return (
        F.when(contains_any(low, ["aadhaar", "aadhar", "uidai", "unique identification"]), "Aadhaar")
        .when(_names_pan(low), "PAN")
        .when(contains_any(low, ["election commission", "elector", "epic"]), "voter card")
        .otherwise("supporting document")
    )


def acceptable(line: Column) -> Column:
    """Whether a line may be a person's name."""
    return line.rlike(FEW_WORDS) & ~line.rlike(r":$|\p{Nd}") & ~line.rlike(HEADING)


def labelled(lines: Column, labels: list[str]) -> Column:
    """What a label names: what stands behind it in its line or, if it has a line of its own, the next line that may be a name.

    The first line that is a label decides; a line that ends in a colon before any name leaves it without value.
    """

    def value(line: Column, at: Column) -> Column:
        later = F.get(F.filter(_after(lines, at), lambda x: acceptable(x) | x.endswith(":")), F.lit(0))
        rest = F.trim(F.regexp_replace(line, "^[^:]*:", ""))
        prefixed = lambda bare: reduce(Column.__or__, [bare.startswith(x + ":") for x in labels])
        one = lambda v: F.struct(v.alias("value"))
        named = one(bound(later, lambda x: F.when(~x.endswith(":"), x)))
        return bound(_bare(line), lambda bare: F.when(bare.isin(*labels), named).when(prefixed(bare) & acceptable(rest), one(rest)))

    return first_of(F.transform(lines, value))["value"]


def date_in(line: Column) -> Column:
    return F.when(line.rlike(DATE), F.concat_ws("/", *[F.regexp_extract(line, DATE, i) for i in (1, 2, 3)]))


def birth(lines: Column) -> Column:
    """The date in a line that names the date of birth or in the two behind it; else the only date there is."""

    def near(line: Column, at: Column) -> Column:
        named = bound(F.lower(line), lambda low: contains_any(low, BIRTH_LABELS))
        return F.when(named, F.coalesce(date_in(line), first_of(F.transform(_after(lines, at, 2), date_in))))

    dates = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(DATE), F.lit(0))))
    return F.coalesce(first_of(F.transform(lines, near)), bound(dates, lambda d: F.when(F.size(d) == 1, date_in(F.get(d, F.lit(0))))))


def _is_address(line: Column) -> Column:
    return bound(_bare(line), lambda bare: bare.isin(*ADDRESS_LABELS) | bare.startswith("address"))


def _place(lines: Column, test: Callable[[Column], Column]) -> Column:
    """Place of the first line that passes, from 0; null if none does."""
    return first_of(F.transform(lines, lambda x, i: F.when(test(x), i)))


def first_person(lines: Column) -> Column:
    """The first line of two words or more before the address that may be a name."""
    before = F.slice(lines, 1, F.coalesce(_place(lines, _is_address), F.size(lines)))
    fits = lambda x: x.rlike(SEVERAL_WORDS) & ~x.rlike(CARE_OF + r"\b") & acceptable(x) & ~F.regexp_replace(F.lower(x), ":+$", "").isin(*NAME_LABELS)
    return F.get(F.filter(before, fits), F.lit(0))


def care_of(lines: Column) -> Column:
    rest = lambda x: F.trim(F.regexp_extract(x, CARE_OF + r"\s*[:\-]?\s*(.+)$", 1))
    return F.get(F.filter(F.transform(lines, rest), acceptable), F.lit(0))


def address(lines: Column) -> Column:
    """struct(address, pincode): from the address line up to a PIN code or identity number, which ends it."""
    ends = lambda x: x.rlike(AADHAAR) | F.upper(x).rlike(PAN)

    def told(head: Column, rest: Column, stop: Column, last: Column, pin: Column) -> Column:
        before = F.regexp_replace(F.regexp_extract(last, r"^(.*?)" + PIN, 1), r"^[ ,-]+|[ ,-]+$", "")
        middle = F.filter(F.slice(rest, 1, F.coalesce(stop, F.size(rest))), lambda x: acceptable(x) | x.rlike(r"\p{Nd}"))
        parts = F.concat(F.array(F.when(head.contains(":"), F.trim(F.regexp_replace(head, "^[^:]*:", "")))), middle, F.array(F.when(pin.isNotNull() & ~before.rlike(HEADING), before)))
        joined = F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), ", ")
        return F.struct(F.nullif(joined, F.lit("")).alias("address"), pin.alias("pincode"))

    def behind(start: Column) -> Column:
        last = lambda rest, stop: bound(F.get(rest, stop), lambda x: bound(F.when(~ends(x), found(x, PIN)), lambda pin: told(F.get(lines, start), rest, stop, x, pin)))
        return bound(F.slice(lines, start + 2, 1 << 30), lambda rest: bound(_place(rest, lambda x: ends(x) | x.rlike(PIN)), lambda stop: last(rest, stop)))

    return bound(_place(lines, _is_address), lambda start: F.when(start.isNotNull(), behind(start)))


def facts(text: Column) -> dict[str, Column]:
    """Column of each fact, null where the text does not tell it; a null text has none. For all of them at once see :func:`with_facts`."""
    return {k: told(text)[k] for k in FACTS}


def with_facts(cards: DataFrame, text: str, *others: str) -> DataFrame:
    """The columns ``others`` of ``cards``, and each fact that its column ``text`` tells; the lines are found once a row."""
    return cards.select(*others, told(F.col(text)).alias("_told")).select(*others, "_told.*")


def told(text: Column) -> Column:
    """struct of all facts."""
    return bound(lines_of(text), lambda lines: bound(F.array_join(lines, "\n"), lambda blob: bound(F.lower(blob), lambda low: bound(_kind(low), lambda of: _told(lines, blob, low, of)))))


def _told(lines: Column, blob: Column, low: Column, of: Column) -> Column:
    person = lambda v: bound(v, lambda x: F.when(~x.rlike(HEADING), x))
    said = lambda sex: low.contains(sex) & low.rlike(rf"\b{sex}\b")
    number = lambda flat: F.when(of.isin("Aadhaar", "supporting document") & flat.rlike(AADHAAR), F.concat_ws(" ", *[F.regexp_extract(flat, AADHAAR, i) for i in (1, 2, 3)]))
    columns = {
        "kind": of,
        "full_name": person(F.coalesce(labelled(lines, NAME_LABELS), first_person(lines))),
        "father_name": person(F.coalesce(labelled(lines, FATHER_LABELS), care_of(lines))),
        "gender": F.when(said("female") | contains_any(low, ["महिला", "स्त्री"]), "Female").when(said("male") | low.contains("पुरुष"), "Male"),
        "date_of_birth": birth(lines),
        "aadhaar_number": bound(F.regexp_replace(blob, r"\s+", " "), number),
        "pan_number": F.when((of == "PAN") | _names_pan(low), found(F.upper(blob), PAN)),
        "voter_id": F.when(of == "voter card", found(F.upper(blob), EPIC)),
    }
    places = address(lines)
    return bound(places, lambda place: F.struct(*[c.alias(k) for k, c in columns.items()], place["address"].alias("address"), place["pincode"].alias("pincode")))


def age(birth: Column, today: Column) -> Column:
    """Completed years; null for dates that don't exist, lie ahead or are over 120 years back."""
    born = F.try_to_timestamp(F.regexp_replace(birth, "[.-]", "/"), F.lit("d/M/yyyy")).cast("date")
    years = F.year(today) - F.year(born) - F.when((F.month(today) * 100 + F.day(today)) < (F.month(born) * 100 + F.day(born)), 1).otherwise(0)
    return F.when((born <= today) & (years <= 120), years)
