"""Personal data replaced by surrogates, in DataFrame operations only.

Entities are found by one regular expression: e-mail addresses, bank account (IBAN), IP and social
security numbers, payment cards, telephone numbers, secret keys, and names of persons after a title. Each gets a keyed surrogate
of its own kind: other digits for digits, letters for letters of the same case and script, with
separators, country prefixes and lengths as they stand. Card numbers count only with a right check digit, and bank accounts with right
check digits; so do their surrogates have, and cards keep their brand's first two digits. Long hexadecimal numbers are secrets only
behind a word such as key or token. Names are made of syllables of the script,
with an ending of the gender that the title or a known given name shows.

Coreference: mentions with one normal form (case, separators and titles don't count; given name and
surname are replaced each by itself) have one surrogate in all documents. Of the name words after a title the last
is the surname. A document's names are also replaced where they stand without title, as whole words with a capital. Distinctness: surrogates
that collide with one another or with any entity of the corpus are drawn anew with the next
attempt's key, until none is left; from ``LONGER`` attempts on they grow longer, so that this ends.

Surrogates are drawn by HMAC-SHA-512 under a secret key, which the caller gives or the setting ``CONF_KEY``; without either there is an error.

Defined results: null texts stay null and have no entities; texts without entities stay as they are.
Repeated rows are treated alike. All columns are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Setting that holds the key; and the key of the registered query, which makes its results repeatable and protects nothing.
CONF_KEY = "spark.fieldloom.pii.key"
QUERY_KEY = "for repeatable results only"
LONGER = 6

# Titles with the gender they show, and given names by gender.
MALE_TITLES = "Mr Herr Sir Señor Monsieur Signor Г-н Господин".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Señora Señorita Signora Г-жа Госпожа".split()
OTHER_TITLES = "Dr Prof".split()
MALE_NAMES = "john james robert michael david thomas peter paul hans karl jean pierre jose juan carlos luis antonio ivan sergei dmitri иван сергей дмитрий".split()
FEMALE_NAMES = "mary anna maria linda susan sarah elizabeth emma julia claire marie sophie carmen lucia elena olga natalia katharina анна ольга елена".split()
# Syllables of surrogate names by script, and endings by gender; surnames have their own.
LATIN = "ba co da fe ga hi jo ka li mo na pe ri so tu va".split()
CYRILLIC = "ба ко да фе га хи жо ка ли мо на пе ри со ту ва".split()
ENDINGS = {"latin": {"m": "n", "f": "lia", "u": "sel", "s": "rson"}, "cyrillic": {"m": "н", "f": "лия", "u": "сь", "s": "рсен"}}

_NAME = r"[\p{Lu}][\p{L}\p{M}'’-]{1,40}"
#: Where a word begins or ends.
_EDGE = r"(?<=[\p{L}\p{M}'’-])(?![\p{L}\p{M}'’-])|(?<![\p{L}\p{M}'’-])(?=[\p{L}\p{M}'’-])"
#: Of a word: quotes before it, the name, and possessive ending and quotes after it.
_CORE = r"^(['’-]*)(.*?)((?:['’][sS])?['’-]*)$"
#: Kinds in order of precedence, with their patterns (Java syntax).
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,6}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{N}]|\.\d)",
    "ssn": r"(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "card": r"(?<![\p{L}\p{N}.-])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\p{L}\p{N}]|-\d)",
    "phone": r"(?<![\p{L}\p{N}+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\p{L}\p{N}]|-\d)",
    "secret": r"(?<![\p{L}\p{N}])(?:(?<=(?:[tT]oken|TOKEN|[sS]ecret|SECRET|[kK]ey|KEY|[pP]assword|[pP]asswd|[pP]wd|PASSWORD)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?)[0-9a-f]{32,64}|AKIA[0-9A-Z]{16})(?![\p{L}\p{N}])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)})\.? {_NAME}(?: {_NAME}){{0,9}}",
}
#: What a mention of a kind begins with, looked at before its longer pattern is tried.
_BEGINS = {"iban": "(?=[A-Z]{2}[0-9])", "ip": "(?=[0-9])", "ssn": "(?=[0-9])", "card": "(?=[0-9])", "phone": "(?=[0-9+(])", "secret": "(?=[0-9a-f]{32}|AKIA)", "person": f"(?=[{''.join(sorted({t[0] for t in MALE_TITLES + FEMALE_TITLES + OTHER_TITLES}))}])"}
#: Any mention. None begins behind a digit, and behind a letter only those that begin with a digit; so most places are left at the first look.
ANY = r"(?:(?<![\p{L}\p{N}])|(?=[0-9])(?<!\p{N}))(?:" + "|".join(_BEGINS.get(kind, "") + pattern for kind, pattern in PATTERNS.items()) + ")"


def luhn_sum(digits: Column) -> Column:
    """Sum of a card number's digits, every second from the last but one doubled, modulo 10; 0 for right ones."""
    signs = F.reverse(F.split(digits, ""))
    doubled = F.transform(signs, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), c.cast("int") + 1)))
    return F.aggregate(doubled, F.lit(0), lambda s, v: s + v) % 10


def mod_97(account: Column) -> Column:
    """Remainder of an IBAN without blanks, its first four signs put last, letters as numbers from 10 on; 1 for right ones."""
    signs = F.split(F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4))), "")
    value = F.transform(signs, lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda r, v: F.when(v > 9, (r * 100 + v) % 97).otherwise((r * 10 + v) % 97))


def kind_of(mention: Column) -> Column:
    """The kind of a mention: the first whose pattern it is; null for cards and accounts whose check digits are wrong."""
    out = F.lit(None)
    checked = {"card": luhn_sum(F.regexp_replace(mention, "[^0-9]", "")) == 0, "iban": mod_97(F.replace(mention, F.lit(" "), F.lit(""))) == 1}
    for kind, pattern in reversed(PATTERNS.items()):
        # what stands before a secret is not in the mention
        found = mention.rlike("^(?:[0-9a-f]{32,64}|AKIA[0-9A-Z]{16})$" if kind == "secret" else f"^(?:{pattern})$")
        out = F.when(found, F.when(checked[kind], kind) if kind in checked else F.lit(kind)).otherwise(out)
    return out


def _has(name: str, kinds: list[str]) -> Column:
    return F.col(name).isin(*kinds)


def _parts(mention: Column, kind: Column) -> Column:
    """Of a mention: array of (kind, normal form, gender) that are replaced, one for each name of a person."""
    words = F.split(mention, " ")
    title = F.regexp_replace(F.element_at(words, 1), r"\.", "")
    first = F.lower(F.element_at(words, 2))
    gender = F.when(title.isin(*MALE_TITLES) | first.isin(*MALE_NAMES), "m").when(title.isin(*FEMALE_TITLES) | first.isin(*FEMALE_NAMES), "f").otherwise("u")
    entity = lambda k, normal, g: F.struct(k.alias("kind"), normal.alias("normal"), g.alias("gender"))
    none = F.lit("")
    surname = entity(F.lit("surname"), F.lower(F.regexp_extract(F.element_at(words, -1), _CORE, 2)), none)
    # all words but the title and the last are given names
    given = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: entity(F.lit("given"), F.lower(F.regexp_extract(w, _CORE, 2)), gender))
    person = F.concat(given, F.array(surname))
    digits = F.regexp_replace(mention, r"[^0-9+]", "")
    normal = F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "email", F.lower(mention)).when(kind == "iban", F.regexp_replace(mention, " ", "")).otherwise(mention)
    return F.when(kind == "person", person).when(kind.isNull(), F.slice(F.array(surname), 1, 0)).otherwise(F.array(entity(kind, normal, none)))


def hmac_sha512(key: bytes, message: Column) -> Column:
    """HMAC of a text under a key, as hex."""
    block = (hashlib.sha512(key).digest() if len(key) > 128 else key).ljust(128, b"\0")
    inner, outer = (bytearray(b ^ pad for b in block) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 512))), 512)


def _stream(key: str, attempt: int) -> Column:
    """768 hex digits drawn from key, kind, normal form and attempt."""
    base = F.concat_ws("|", "kind", "normal", F.lit(str(attempt)))
    return F.concat(*[hmac_sha512(key.encode(), F.concat_ws("|", base, F.lit(str(i)))) for i in range(6)])


def _byte(at: Column) -> Column:
    """A byte of the stream."""
    return F.conv(F.substr(F.col("stream"), at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letters(first: int, count: int, at: Column) -> Column:
    return F.char(F.lit(first) + F.pmod(_byte(at), F.lit(count)))


def _same_classes(text: Column, fixed: Column) -> Column:
    """Other characters of the same classes, but for the first ``fixed`` ones."""
    cyrillic = F.lit("абвгдежзиклмнопрстуфхцчшэюя")

    def other(char: Column, at: Column) -> Column:
        b = F.pmod(at, F.lit(384))
        return (
            F.when(at < fixed, char)
            .when(char.rlike("[0-9]"), F.pmod(_byte(b), F.lit(10)).cast("string"))
            .when((F.col("kind") == "secret") & char.rlike("[a-f]"), _letters(97, 6, b))
            .when(char.rlike(r"\p{IsCyrillic}"), F.substr(cyrillic, F.pmod(_byte(b), F.lit(27)) + 1, F.lit(1)))
            .when(char.rlike(r"\p{Lu}"), _letters(65, 26, b))
            .when(char.rlike(r"\p{L}"), _letters(97, 26, b))
            .otherwise(char)
        )

    return F.array_join(F.transform(F.split(text, ""), other), "")


def _name(attempt: int) -> Column:
    cyrillic = F.col("normal").rlike(r"\p{IsCyrillic}")
    syllables = lambda table: F.concat(*[F.element_at(F.array(*map(F.lit, table)), F.pmod(_byte(F.lit(i)), F.lit(len(table))) + 1) for i in range(2 + attempt)])
    role = F.when(F.col("kind") == "surname", "s").otherwise(F.col("gender"))
    ending = lambda script: F.element_at(F.create_map(*[F.lit(x) for pair in ENDINGS[script].items() for x in pair]), role)
    return F.when(cyrillic, F.concat(syllables(CYRILLIC), ending("cyrillic"))).otherwise(F.concat(syllables(LATIN), ending("latin")))


def _candidate(attempt: int) -> Column:
    """The surrogate of an entity, in normal form."""
    octets = F.concat_ws(".", *[(F.pmod(_byte(F.lit(2 * i)), F.lit(253)) + 1).cast("string") for i in range(4)])
    normal = F.col("normal")
    prefix = F.when(normal.startswith("+"), F.greatest(F.length(normal) - 10, F.lit(2))).otherwise(0)
    fixed = F.when(F.col("kind") == "phone", prefix).when(F.col("kind") == "iban", 2).when(F.col("kind") == "card", 2).when((F.col("kind") == "secret") & normal.startswith("AKIA"), 4).otherwise(0)
    local = F.concat(*[F.lit("x"), F.substr(F.col("stream"), F.lit(700), F.lit(12))])
    email = F.concat(_same_classes(F.regexp_replace(normal, r"\.[^.]*$", ""), F.lit(0)), F.lit("."), F.substring_index(normal, ".", -1))
    if attempt >= LONGER:
        email = F.concat(local, email)
    out = F.when(F.col("kind") == "ip", octets).when(F.col("kind") == "email", email).when(_has("kind", ["given", "surname"]), _name(attempt))
    same = _same_classes(normal, fixed)
    # right check digits: of a card the last, of an account the third and fourth
    card = F.substr(same, F.lit(1), F.length(same) - 1)
    card = F.concat(card, F.pmod(10 - luhn_sum(F.concat(card, F.lit("0"))), F.lit(10)).cast("string"))
    blank = F.concat(F.substr(same, F.lit(1), F.lit(2)), F.lit("00"), F.substr(same, F.lit(5)))
    account = F.concat(F.substr(same, F.lit(1), F.lit(2)), F.lpad((98 - mod_97(blank)).cast("string"), 2, "0"), F.substr(same, F.lit(5)))
    same = F.when(F.col("kind") == "card", card).when(F.col("kind") == "iban", account).otherwise(same)
    if attempt >= LONGER:
        same = F.concat(same, F.regexp_replace(F.substr(F.col("stream"), F.lit(700), F.lit(attempt)), "[a-f]", "7"))
    return out.otherwise(same)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, normal, gender, surrogate: a different one for each, none of which is an entity itself.

    Each attempt keeps, of equal candidates, that of the smallest entity, and draws the rest anew.
    """
    left, placed, attempt = entities.select("kind", "normal", "gender"), None, 0
    while True:
        drawn = left.withColumn("stream", _stream(key, attempt)).withColumn("surrogate", _candidate(attempt)).drop("stream")
        kept = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("normal", "gender")).alias("x")).select("kind", "x.normal", "x.gender", "surrogate")
        kept = kept.join(entities.select("kind", F.col("normal").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if placed is not None:
            kept = kept.join(placed.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        kept = shared.written(kept.select("kind", "normal", "gender", "surrogate"), f"pii-attempt-{attempt}")
        placed = kept if placed is None else placed.unionByName(kept)
        left = shared.written(left.join(kept, ["kind", "normal"], "left_anti"), f"pii-left-{attempt}")
        if left.isEmpty():
            return placed
        attempt += 1


def _in_format(mention: Column, kind: Column, own: Column) -> Column:
    """The mention with the surrogate of its parts, in its own format. ``own``: map from kind and normal form to surrogate."""
    parts = _parts(mention, kind)
    found = F.transform(parts, lambda p: F.element_at(own, F.concat(p["kind"], F.lit("|"), p["normal"])))
    first = F.element_at(found, 1)
    words = F.split(mention, " ")
    # names: the case of the mention's word
    cased = F.zip_with(F.slice(words, 2, F.size(words)), found, lambda old, new: F.concat(F.when((old == F.upper(old)) & (F.length(old) > 1), F.upper(new)).otherwise(F.initcap(new)), F.regexp_extract(old, _CORE, 3)))
    person = F.concat_ws(" ", F.element_at(words, 1), F.concat_ws(" ", cased))
    # numbers: the surrogate's signs at the places of the mention's, and what is left of it after the last
    chars = F.split(mention, "")
    sign = "[0-9A-Z+]"
    number = F.transform(chars, lambda c, i: F.when(c.rlike(sign), F.substr(first, F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), "[^0-9A-Z+]", "")), F.lit(1))).otherwise(c))
    rest = F.substr(first, F.length(F.regexp_replace(mention, "[^0-9A-Z+]", "")) + 1, F.lit(200))
    email = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(first)).otherwise(first)
    return F.when(kind == "person", person).when(kind == "email", email).when(kind.isin("card", "ssn", "phone", "iban"), F.concat(F.array_join(number, ""), rest)).otherwise(first)


def _named(gap: Column, own: Column) -> Column:
    """Text between mentions, with the surrogates of the document's names wherever they stand as whole words with a capital."""
    own_of = lambda n: F.coalesce(F.element_at(own, F.concat(F.lit("surname|"), n)), F.element_at(own, F.concat(F.lit("given|"), n)))

    def other(word: Column) -> Column:
        """The word itself, or, of a name, its surrogate in the word's case between the quotes and ending around it."""
        core = F.regexp_extract(word, _CORE, 2)
        new = own_of(F.lower(core))
        cased = F.when((core == F.upper(core)) & (F.length(core) > 1), F.upper(new)).otherwise(F.initcap(new))
        return F.when(core.rlike(r"^\p{Lu}"), F.concat(F.regexp_extract(word, _CORE, 1), cased, F.regexp_extract(word, _CORE, 3)))

    # a name with hyphens as a whole, else by its parts
    parted = lambda w: F.array_join(F.transform(F.split(w, "(?=-)|(?<=-)"), lambda x: F.coalesce(other(x), x)), "")
    # only words with a capital can be names
    word = lambda w: F.when(w.rlike(r"\p{Lu}"), F.coalesce(other(w), F.when(w.contains("-"), parted(w)), w)).otherwise(w)
    named = F.array_join(F.transform(F.split(gap, _EDGE), word), "")
    persons = F.coalesce(F.exists(F.map_keys(own), lambda k: k.startswith("surname|")), F.lit(False))
    return F.when(persons, named).otherwise(gap)


def pseudonymised(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in its texts, and columns n_entities (mentions) and entity_kinds (sorted, distinct).

    Columns of these names in ``docs`` are replaced.
    """
    key = key or docs.sparkSession.conf.get(CONF_KEY, None)
    if not key:
        raise ValueError(f"give a secret key, or set {CONF_KEY}")
    names = [c for c in docs.columns if c not in ("n_entities", "entity_kinds")]
    numbered = docs.select(names).toDF(*[f"c{i}" for i in range(len(names))])
    text = F.col(f"c{names.index(text_col)}")
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    hit = F.coalesce(text.rlike(ANY), F.lit(False))
    clean = numbered.where(~hit).select(*back, F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("entity_kinds"))
    touched = numbered.where(hit).withColumn("mentions", F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).withColumn("key", F.sha2(text, 256))
    touched = touched.withColumn("kinds", F.transform("mentions", kind_of))
    touched = shared.written(touched, "pii-touched", compression="zstd")
    pairs = F.explode(F.array_distinct(F.flatten(F.zip_with("mentions", "kinds", _parts)))).alias("x")
    inside = shared.written(touched.select("key", pairs).select("key", "x.*").distinct(), "pii-inside")
    entities = shared.written(inside.groupBy("kind", "normal").agg(F.min("gender").alias("gender")), "pii-entities")
    placed = surrogates(entities, key).select("kind", "normal", "surrogate")
    maps = inside.select("key", "kind", "normal").distinct().join(placed, ["kind", "normal"]).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("|"), "normal"), "surrogate"))).alias("own"))
    maps = shared.written(maps, "pii-maps")
    gaps = F.transform(F.split(text, ANY, -1), lambda g: _named(g, F.col("own")))
    new = F.zip_with("mentions", "kinds", lambda m, k: F.when(k.isNull(), m).otherwise(_in_format(m, k, F.col("own"))))
    woven = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")
    done = touched.join(maps, "key", "left").withColumn(f"c{names.index(text_col)}", woven)
    return clean.unionByName(done.select(*back, F.size(F.array_compact("kinds")).cast("long").alias("n_entities"), F.array_sort(F.array_distinct(F.array_compact("kinds"))).alias("entity_kinds")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet"), key=spark.conf.get(CONF_KEY, None) or QUERY_KEY)
    return found.select("doc_id", "text", "n_entities", F.array_join("entity_kinds", ",").alias("entity_kinds"))
