"""Script-aware text functions, as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of each script, in order of precedence, and the language a script stands for.
SCRIPTS = {
    "devanagari": r"\x{0900}-\x{097F}",
    "kannada": r"\x{0C80}-\x{0CFF}",
    "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
    "bengali": r"\x{0980}-\x{09FF}",
    "telugu": r"\x{0C00}-\x{0C7F}",
    "tamil": r"\x{0B80}-\x{0BFF}",
    "gujarati": r"\x{0A80}-\x{0AFF}",
    "malayalam": r"\x{0D00}-\x{0D7F}",
    "odia": r"\x{0B00}-\x{0B7F}",
    "gurmukhi": r"\x{0A00}-\x{0A7F}",
}
LATIN = "A-Za-z"
LANGUAGES = {"devanagari": "hi", "kannada": "kn", "arabic": "ur", "latin": "en", "bengali": "bn", "telugu": "te", "tamil": "ta", "gujarati": "gu", "malayalam": "ml", "odia": "or", "gurmukhi": "pa"}
REGIONAL = "[" + "".join(SCRIPTS.values()) + "]"
TOKEN = "[a-z0-9" + "".join(SCRIPTS.values()) + "]+"
#: Digits of four families, each zero to nine.
DIGITS = "".join(chr(z + i) for z in (0x0966, 0x0CE6, 0x0660, 0x06F0) for i in range(10))
STOP_INITIALISMS = ["THE", "AND", "FOR", "NOT"]
#: Arabic letters that stand for one another, and marks that don't count when labels are compared.
SAME_LETTERS = ("\u0622\u0623\u0625\u0671\u0649\u064a\u06d2\u06d3\u0643\u0629\u0647\u06c3\u0624", "\u0627\u0627\u0627\u0627\u06cc\u06cc\u06cc\u06cc\u06a9\u06c1\u06c1\u06c1\u0648")
MARKS = r"[\x{093A}-\x{094F}\x{0951}-\x{0957}\x{0962}\x{0963}\x{0900}-\x{0903}\x{0CBE}-\x{0CCD}\x{0CD5}\x{0CD6}\x{0C82}\x{0C83}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}\x{200C}\x{200D}]"
LEADERS = ".…·•_⋯‥"
KEPT_LATIN = ["epic", "sir", "blo", "ac", "no", "dob"]


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def collapsed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}]+", " "))


def tokens(text: Column) -> Column:
    """Tokens of the lower-cased text, in order; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def script_count(text: Column, script: str) -> Column:
    """Letters of a script; texts without any regional letter are scanned once for all regional scripts."""
    text = F.coalesce(text, F.lit(""))
    count = F.regexp_count(text, F.lit(f"[{SCRIPTS.get(script, LATIN)}]"))
    return F.when(text.rlike(REGIONAL), count).otherwise(0) if script in SCRIPTS else count


def dominant_script(text: Column) -> Column:
    """The regional script with most letters, the first of equals; else latin, else unknown."""
    text = F.coalesce(text, F.lit(""))
    ranked = F.array(*[F.struct(F.regexp_count(text, F.lit(f"[{letters}]")).alias("n"), F.lit(-i).alias("before"), F.lit(s).alias("script")) for i, (s, letters) in enumerate(SCRIPTS.items())])
    return F.when(text.rlike(REGIONAL), F.array_max(ranked)["script"]).when(text.rlike(f"[{LATIN}]"), "latin").otherwise("unknown")


def language(script: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), script)


def fold_digits(text: Column) -> Column:
    return F.translate(text, DIGITS, "0123456789" * 4)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(fold_digits(text), "[^0-9]", "")


def initialisms(text: Column) -> Column:
    """Distinct capital words of 2 to 6 letters, as they first come."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    found = F.filter(words, lambda w: w.rlike("^[A-Z]{2,6}$"))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_INITIALISMS)))


def tidy_caption(text: Column) -> Column:
    """Without repeats of the token before and, in captions of a regional script, without stray short Latin words."""
    return bound(text, _tidied)


def _tidied(text: Column) -> Column:
    parts = F.filter(F.split(collapsed(text), " "), lambda t: t != "")
    once = bound(parts, lambda p: F.filter(p, lambda t, i: (i == 0) | (t != F.get(p, i - 1))))
    core = lambda t: F.regexp_replace(t, r"^[()\[\]:/.,]+|[()\[\]:/.,]+$", "")
    scrap = lambda t: core(t).rlike("^[A-Za-z]{1,3}$") & ~F.lower(core(t)).isin(*KEPT_LATIN)
    return F.array_join(F.when(dominant_script(text) == "latin", once).otherwise(F.filter(once, lambda t: ~scrap(t))), " ")


def cut_at_word(text: Column, width: int) -> Column:
    """At most ``width`` characters, cut at a blank where there is one."""
    tidy = collapsed(text)
    return F.when(F.length(tidy) <= width, tidy).otherwise(F.regexp_replace(F.substring(tidy, 1, width), r" [^ ]*$", ""))


def without_leaders(text: Column) -> Column:
    """Without dots, dashes and blanks of a leader at the end."""
    return F.rtrim(F.regexp_replace(F.trim(text), f"[{LEADERS}]+$", ""))


def question_caption(text: Column) -> Column:
    """The caption of a line that invites an answer: one with a colon at its end or else its start, without it; null for others."""
    return _asked(without_leaders(text))


def _asked(bare: Column) -> Column:
    at_end, at_start = bare.rlike("[:：]$"), bare.rlike("^[:：]")
    return blank_to_null(F.when(at_end, F.regexp_replace(bare, "[:：]$", "")).when(at_start, F.regexp_replace(bare, "^[:：]", "")))


def element_caption(text: Column) -> Column:
    """:func:`question_caption` of an array's element: inside a lambda Spark computes a repeated part anew each time."""
    return bound(without_leaders(text), _asked)


def leader_run(text: Column) -> Column:
    """The longest run of three or more leader signs, the first of equals; null without any."""
    runs = F.regexp_extract_all(text, F.lit(f"[{LEADERS}]{{3,}}"), F.lit(0))
    return F.array_max(F.transform(runs, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("before"), r.alias("run"))))["run"]


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def parenthetical_hint(after: Column) -> Column:
    """The caption in the first parentheses behind a leader, if it is short and closes within 80 signs; ``after``: the text that follows."""
    inner = F.regexp_replace(without_leaders(F.regexp_extract(after, r"^[^(]{0,80}\(([^)]*)\)", 1)), r"[\s:：]+$", "")
    return F.when((F.length(inner) >= 3) & (F.length(inner) <= 80) & (n_words(inner) <= 12), inner)


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def unaccented(text: pd.Series) -> pd.Series:
    """Decomposed, without marks that are not Arabic."""
    kept = lambda c: unicodedata.category(c) != "Mn" or "\u0600" <= c <= "\u06ff" or "\u0750" <= c <= "\u077f" or "\ufb50" <= c <= "\ufdff" or "\ufe70" <= c <= "\ufeff"
    return text.map(lambda t: "".join(filter(kept, unicodedata.normalize("NFD", t))), na_action="ignore")


def match_tokens(text: Column) -> Column:
    """Tokens of labels as they are compared: case, accents, vowel signs and variants of letters don't count. For labels and dictionaries, not for long texts."""
    plain = F.regexp_replace(F.translate(F.lower(collapsed(compatible(F.coalesce(text, F.lit(""))))), *SAME_LETTERS), MARKS, "")
    return F.regexp_extract_all(unaccented(plain), F.lit(TOKEN), F.lit(0))


def match_fold(text: Column) -> Column:
    return F.array_join(match_tokens(text), " ")


def message(template: Column, values: dict[str, Column]) -> Column:
    """A template with each ``{name}`` replaced; a null value leaves its place as it is."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("{" + name + "}")))
    return out


def speech_parts(parts: Column, lang: Column) -> Column:
    """Parts joined for reading aloud: those in the script of the language or, if none is, all."""
    parts = F.filter(parts, lambda p: blank_to_null(p).isNotNull())
    own = F.filter(parts, lambda p: in_script(p, lang))
    return F.array_join(F.when(F.size(own) > 0, own).otherwise(parts), " ")


def wrapped(text: Column, width: Column, sign: float = 0.5, size: Column | float = 1.0) -> Column:
    """Lines of whole words, as many to a line as ``width`` holds when each sign is ``sign * size`` wide; a longer word has a line of its own."""
    most = F.greatest(F.floor(width / (F.lit(sign) * size)).cast("int"), F.lit(1))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    fits = lambda line, w: (F.length(line) + 1 + F.length(w)) <= most
    add = lambda lines, w: F.when((F.size(lines) > 0) & fits(F.element_at(lines, -1), w), F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.concat(F.element_at(lines, -1), F.lit(" "), w)))).otherwise(F.concat(lines, F.array(w)))
    return F.aggregate(words, F.array().cast("array<string>"), add)


def fitting_size(text: Column, width: Column, height: Column, sign: float = 0.5, leading: float = 1.2) -> Column:
    """The largest type size of 22, 21.5, ... 6 at which the wrapped text stays inside the box; null if none does."""
    sizes = F.array(*[F.lit(22 - k / 2) for k in range(33)])
    widest = lambda lines: F.array_max(F.transform(lines, F.length))
    ok = lambda s: F.aggregate(F.array(wrapped(text, width, sign, s)), F.lit(False), lambda _, lines: (F.size(lines) * s * leading <= height) & (F.coalesce(widest(lines), F.lit(0)) * s * sign <= width))
    return F.get(F.filter(sizes, ok), F.lit(0))


def in_script(text: Column, lang: Column) -> Column:
    """Whether most letters are of the script that the language is written in; mr and as share theirs with hi and bn."""
    lang = F.when(lang == "mr", "hi").when(lang == "as", "bn").otherwise(lang)
    return F.coalesce(language(dominant_script(text)) == lang, F.lit(False))


def pdf_word(raw: Column) -> Column:
    """A word of a PDF with presentation forms as letters and without what can't be printed."""
    return F.trim(F.regexp_replace(compatible(raw), r"[\p{C}\p{Zl}\p{Zp}[\p{Zs}&&[^ ]]]", ""))


def keep_pdf_word(text: Column) -> Column:
    """Whether a word counts: it has a letter, a colon, or three leader signs."""
    return F.coalesce(text.rlike(r"[\p{L}:：]") | (F.regexp_count(text, F.lit(f"[{LEADERS}]")) >= 3), F.lit(False))
