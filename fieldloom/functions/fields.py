"""Rules on fields of a form, as columns: who fills them, which are required, what their wording and shape say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LEADERS, blank_to_null, dominant_script, match_tokens, n_words, question_caption

# Signs and words of required fields, of questions about a field, of scripts' forms, and of types.
REQUIRED = r"(?i)[*＊✱⁎⋆★☆]|必|आवश्यक|ಅಗತ್ಯ|ضروری|\b(required|mandatory|compulsory|must\s+fill|must\s+enter)\b|अनिवार्य|ಕಡ್ಡಾಯ|لازمی"
WHERE = ["where", "location", "highlight", "कहाँ", "कहां", "स्थान", "ಎಲ್ಲಿ", "ಸ್ಥಳ", "کہاں", "مقام"]
FILL_FOR_ME = ["fill this", "my name", "what should i write as my", "enter my", "fill it for me", "भर दो", "मेरा नाम", "ಭರ್ತಿ ಮಾಡಿ", "ನನ್ನ ಹೆಸರು", "بھر دو", "میرا نام"]
FORM_WORDS = [("devanagari", "hi", ["आवेदक", "मतदाता"]), ("kannada", "kn", ["ಮತದಾರ", "ಅರ್ಜಿ"]), ("latin", "en", ["epic", "applicant", "electoral"])]
SIGNATURE = ["signature", "applicant signature", "sign here", "thumb impression", "हस्ताक्षर", "अंगूठे का निशान", "ಸಹಿ", "ಹೆಬ್ಬೆಟ್ಟಿನ ಗುರುತು", "دستخط", "انگوٹھے کا نشان"]
DATES = ["date of birth", "dob", "date", "dated", "दिनांक", "तारीख", "जन्म तिथि", "ದಿನಾಂಕ", "ತಾರೀಖು", "ಜನ್ಮ ದಿನಾಂಕ", "تاریخ", "تاریخ پیدائش"]
ADDRESSES = ["address", "residential address", "permanent address", "पता", "स्थायी पता", "ವಿಳಾಸ", "ಶಾಶ್ವತ ವಿಳಾಸ", "پتہ", "مستقل پتہ"]
OFFICE = ["office use", "official use", "for office", "कार्यालय उपयोग", "ಕಚೇರಿ ಬಳಕೆ", "دفتری استعمال"]
MARK_TYPES = ["checkbox", "radio"]


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def _yes(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def is_applicant_blank(field_type: Column, filled_by: Column, optional: Column, kind: Column) -> Column:
    """Whether the applicant must see to the field: not signatures, nor what the office fills or the rule calls optional. Nulls are no reason against."""
    return ~(_yes(field_type == "signature") | _yes(filled_by == "office") | _yes(optional) | _yes(kind == "office_use"))


def looks_required(label: Column) -> Column:
    return _yes(F.trim(label).rlike(REQUIRED))


def required(applicant: Column, given: Column, label: Column, caption: Column) -> Column:
    """Whether an answer is required: never of others than the applicant; else as given or marked in the wording; where nothing is said, yes."""
    return F.when(~applicant, False).when(given, True).when(looks_required(label) | looks_required(caption), True).when(~given, False).otherwise(True)


def needs_description(is_field: Column, concept: Column, needs_detail: Column, fill_by: Column) -> Column:
    return _yes(is_field) & (concept.isNull() | _yes(needs_detail) | _yes(fill_by != "applicant"))


def plausible_label(label: Column) -> Column:
    """Whether re-read text can be a label and not rules, smudges or run-together words."""
    letters = F.regexp_replace(F.regexp_replace(label, r"\p{Cf}", ""), r"[^\p{L}]", " ")
    share = F.regexp_count(label, F.lit(r"[\p{L}\p{M}]")) / F.regexp_count(label, F.lit(r"\S"))
    bars = label.contains("|") | (F.regexp_count(label, F.lit("_")) > 2)
    return _yes(F.length(label).between(3, 60) & ~bars & F.exists(match_tokens(label), lambda t: F.length(t) >= 2) & ~letters.rlike(r"(?<![^ ])[A-Za-z]{16,}(?![^ ])") & (share >= 0.7))


def intent(question: Column) -> Column:
    """What a question about a field asks: its place, an invented answer, or guidance."""
    low = F.lower(F.coalesce(question, F.lit("")))
    return F.when(_any(low, WHERE), "region").when(_any(low, FILL_FOR_ME), "refusal").otherwise("guidance")


def holds_answer(prompt: Column, answers: Column) -> Column:
    """Whether a prompt has any answer of three signs or more in it."""
    return F.exists(answers, lambda a: (F.length(F.trim(a)) >= 3) & F.lower(prompt).contains(F.lower(a)))


def form_language(text: Column) -> Column:
    """Language of the one form whose words the text has; null for others."""
    script, low = dominant_script(text), F.lower(text)
    out = F.when((script == "arabic") & text.contains("ووٹر") & (text.contains("درخواست") | text.contains("اعلامیہ")), "ur")
    for of, lang, words in FORM_WORDS:
        out = F.when((script == of) & F.forall(F.array(*map(F.lit, words)), lambda w: low.contains(w)), lang).otherwise(out)
    return out


def field_type_for(entry_type: Column, detected: Column) -> Column:
    """The dictionary decides the type but for marks, which are measured on the page."""
    entry = F.when(entry_type == "table", "table_cell").when(entry_type.isin("text", "multiline", "date", "checkbox", "radio", "signature", "table_cell"), entry_type).otherwise("text")
    return F.when(detected.isin(*MARK_TYPES) | entry.isin(*MARK_TYPES), detected).otherwise(entry)


def has_term(label: Column, terms: list[str]) -> Column:
    """Terms of up to four signs must stand as words, longer ones anywhere."""
    short, long = [t for t in terms if len(t) <= 4], [t for t in terms if len(t) > 4]
    out = _any(label, long)
    return out | label.rlike(r"(?<![\p{L}\p{M}\p{N}_])(" + "|".join(short) + r")(?![\p{L}\p{M}\p{N}_])") if short else out


def refined_type(label: Column, detected: Column, height: Column) -> Column:
    """Type by the wording: signature, date, or several lines for addresses and tall boxes; marks and signatures keep theirs."""
    low = F.lower(F.coalesce(label, F.lit("")))
    tall = (_any(low, ADDRESSES) | (height > 0.06)) & ~detected.isin(*MARK_TYPES, "signature")
    return F.when(has_term(low, SIGNATURE), "signature").when(has_term(low, DATES), "date").when(tall, "multiline").otherwise(detected)


def has_leader(text: Column) -> Column:
    return _yes(text.rlike(f"[{LEADERS}]{{3,}}"))


def short_caption(text: Column, width: Column, widest: Column) -> Column:
    """Whether a line invites an answer: it has a leader, or a colon and less than 0.45 of the widest line's width."""
    return has_leader(text) | (question_caption(text).isNotNull() & _yes((widest > 0) & (width < 0.45 * widest)))


def free_is_a_blank(text: Column, cell_width: Column, free: Column) -> Column:
    """Whether the free part of a caption's cell is a place to write."""
    caption, words = question_caption(text), n_words(text)
    short = caption.isNotNull() & (n_words(caption) <= 12) & (F.length(caption) <= 80)
    long_label = F.length(F.coalesce(caption, F.trim(text))) >= 24
    return F.when(free < 40, False).when(caption.isNull() & (words > 8), False).when(short, True).when(free >= 0.35 * cell_width, True).otherwise(long_label & (free >= 100))


def declaration_mark(section: Column, nearby: Column) -> Column:
    """Whether a mark stands under a declaration and asks nothing."""
    section, nearby = F.trim(F.coalesce(section, F.lit(""))), F.trim(F.coalesce(nearby, F.lit("")))
    return ((F.length(section) > 40) & (n_words(section) >= 6) & (F.length(nearby) < 2)) | (F.length(nearby) > 48) | (n_words(nearby) > 8)


def plausible_size(field_type: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Marks of 10 to 36 pixels, others wide enough to write in and not too high."""
    mark = width.between(10, 36) & height.between(10, 36)
    other = (width >= F.greatest(F.lit(80), F.floor(page_width * 0.12))) & (height >= 16) & (height <= F.floor(page_height * 0.22))
    return F.when(field_type.isin(*MARK_TYPES), mark).otherwise(other)


def suggested(answer: Column, suggestion: Column) -> Column:
    """An answer, or where it is blank the suggestion."""
    return F.coalesce(blank_to_null(answer), suggestion)
