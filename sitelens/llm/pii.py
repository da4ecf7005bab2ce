"""Surrogates for personal data, in DataFrame operations only.

Entities are found by pattern, and each value is replaced by a surrogate drawn from a
keyed digest of its type and itself: equal values get equal surrogates everywhere
(coreference), and the surrogate has the value's type, script, letter case, length and
punctuation. Titled names are replaced word by word from lists by gender and script, and
later mentions of such a word alone, in the same text, follow, unless it is an ordinary
word or a month as well. Card and account numbers have to pass their check sums, and so
do their surrogates.

Two values must not meet in one surrogate, and a surrogate must not be some other real
value. A check over all distinct values of the corpus finds such collisions; the least
value of a contested surrogate keeps it, the others draw again until none is contested.
Only these redrawn values have to be looked up, all others are computed where they stand.
Where real values fill a good part of all that a format can write, drawing would not end:
there a keyed permutation of the format gives every value its surrogate, distinct by
construction and never itself, though it may be another's real value.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fits, private, table

#: Whoever runs this on real data passes a secret of their own.
DEFAULT_KEY = "example-key"
#: Up to so many redrawn values are put into the plan; beyond, they are joined.
MOST_LITERALS = 2_000
#: Real values may be this share of what a digit format can write; beyond, the format is permuted.
DENSE = 0.25
#: After so many rounds in a row that settle nothing, the formats of what is left are permuted.
IDLE_DRAWS = 8

_LETTER_OR_DIGIT = r"\p{L}\p{N}"
_ALONE, _END = rf"(?<![{_LETTER_OR_DIGIT}])", rf"(?![{_LETTER_OR_DIGIT}])"
_IPV4, _HEX = r"(?:\d{1,3}\.){3}\d{1,3}", "[0-9A-Fa-f]"
#: A time of day is no address.
_CLOCK = r"\d{1,2}:\d{2}:\d{2}(?![\w:])"
#: Titles by gender.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"),
    "n": ("Dr", "Prof", "Доктор"),
}
_TITLE = "(?:" + "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)) + r")\.?"
_NAME_WORD = r"\p{Lu}[\p{L}'’-]*+"
#: In order of precedence at one place.
PATTERNS = {
    "email": rf"(?<![{_LETTER_OR_DIGIT}._%+-])[{_LETTER_OR_DIGIT}._%+-]++@(?:[{_LETTER_OR_DIGIT}-]++\.)++[{_LETTER_OR_DIGIT}-]++",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ -]?)?\(\d{2,4}\) ?\d{3,4}-\d{4}(?!\d)|(?<![\w+-])\d{3}-\d{3}-\d{4}(?![\d-])"
    r"|(?:(?<![A-Za-z0-9_])|(?=[+(]))(?:\+\d{1,2}\s?)?(?:\(\d{3}\)|\d{3}\)?)[-.\s]?\d{3}[-.\s]?\d{4}(?!\w)"
    r"|(?<![\w+])\+(?:\d(?:[ .-]|[ .-]?\(|\)[ .-]?)?+){6,14}\d(?!\d)|(?<![\w+])\+\d{1,3}(?:[ -]\d{2,4}){2,4}(?!\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": rf"(?<![\w:])(?:{_HEX}{{0,4}}:){{2,6}}{_IPV4}(?!\w)|(?<!\w){_IPV4}(?!\w)"
    rf"|(?<![\w:])(?=(?:{_HEX}{{1,4}}:){{1,7}}:|::)(?=:{{0,2}}{_HEX})(?:{_HEX}{{0,4}}:){{2,7}}{_HEX}{{0,4}}(?![\w:])"
    rf"|(?<!\w)(?!{_CLOCK})(?:{_HEX}{{1,4}}:){{2,7}}{_HEX}{{1,4}}(?!\w)",
    "secret": rf"{_ALONE}(?:[0-9a-f]{{32,}}|[0-9A-F]{{32,}}|AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,}}){_END}",
    "card": rf"{_ALONE}\d{{13,19}}{_END}|(?<!\w)(?:\d{{4}}(?:[ -]\d{{4}}){{3}}|\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}})(?!\w)",
    "iban": rf"{_ALONE}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
    "name": rf"(?<!\p{{L}}){_TITLE} {_NAME_WORD}(?: {_NAME_WORD})?",
}
ANY = "|".join(PATTERNS.values())
#: Texts that have none of these are passed by: every pattern needs a digit, an @, one of the marks or hexadecimal letters.
_MARKS = ("::", "sk-", "AKIA", *(f"gh{c}_" for c in "pousr"), *(t for ts in TITLES.values() for t in ts))
_MARKS = tuple(m for m in _MARKS if not any(o in m for o in _MARKS if o != m))


def may_hold(text: Column) -> Column:
    """Whether a text can have an entity: plain searches, which cost a small part of what the patterns do."""
    found = text.rlike("[0-9@]")
    for mark in _MARKS:
        found = found | F.contains(text, F.lit(mark))
    return found | text.rlike("[A-Fa-f]{32}") | (F.contains(text, F.lit(":")) & text.rlike("[A-Fa-f]:[A-Fa-f]"))


#: Names that are ordinary words or months too: alone, later in a text, they are left as they are.
ORDINARY = (
    "April August Mai May June Juli July Juin Mars Mark Will Art Bill Chase Dawn Faith Frank Grace Grant Hope Joy Rich Rose Day Long Young White Black Brown Green Gray Grey "
    "King Price Winter Summer Sommer Herbst Montag Freitag Sonntag Sunday Friday Klein Lang Weiss Schwarz Braun Grand Petit Blanc Noir Roman Вера Роман Белых Черных Долгих"
).split()

#: Replacement names, by class and script.
NAMES: dict[tuple[str, str], str] = {
    ("given_m", "latin"): "Adam Aaron Bruno Carl Daniel Edgar Felix Gavin Hugo Ivan Jonas Karim Leon Marco Nils Oscar Pablo Quentin Ralf Simon Tomas Ulrich Victor Walter",
    ("given_f", "latin"): "Alma Amelie Bella Clara Diana Elena Fiona Greta Hanna Irene Julia Karla Laura Maria Nadia Olivia Paula Rosa Sofia Tamara Ursula Vera Wanda Yvonne",
    ("given_n", "latin"): "Alexis Andrea Ashley Cameron Charlie Dana Eden Frankie Jamie Jordan Kim Logan Morgan Nico Parker Quinn Riley Robin Sam Sasha Taylor Toni Val Yael",
    ("family", "latin"): "Abbott Alder Becker Bishop Calder Cortez Delgado Draper Ellison Farrow Fischer Garner Hartman Ibarra Jansen Keller Lambert Marlow Navarro Olsen Palmer Quiroga Renard Salinas Thorne Urban Vidal Weston Yardley Ziegler",
    ("given_m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид Максим Никита Олег Павел Роман Степан",
    ("given_f", "cyrillic"): "Алина Вера Галина Дарья Елена Жанна Зоя Инна Карина Лариса Марина Нина Ольга Полина Раиса Светлана",
    ("given_n", "cyrillic"): "Саша Женя Валя Шура",
    ("family", "cyrillic"): "Белых Вальчук Гончар Долгих Журба Зинчук Коваль Лысенко Мельник Носенко Орлик Приходько Ревенко Синчук Ткачук Черных",
}
_SYLLABLES = {"latin": "ba den fel gor han kel lin mar nov per ras sen tor val wen zen", "cyrillic": "бан вел гор дин кел лин мар нов рас сен тор"}
_ALPHABETS = [
    ("[0-9]", "0123456789"),
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{IsLatin}&&\p{Lu}]", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"),
    (r"\p{IsLatin}", "àáâäçèéêëìíîïñòóôöùúûü"),
    (r"\p{IsHan}", "安白陈丁方高何江李林马宁潘秦任孙田王许杨"),
    (r"\p{L}", "αβγδεζηθικλμνξοπρστυφχψω"),
]


def entity_type(value: Column) -> Column:
    """The type of a whole matched value; null for bare digits that are no card and codes that are no account number."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(value.rlike(rf"^(?:{pattern})\z"), name).otherwise(kind)
    # Bare digits have nothing but the issuer's first digits and the check sum to show for themselves.
    no_card = value.rlike(r"^\d+\z") & ~(value.rlike(r"^(?:[3-6]|2[2-7])") & (_luhn(value) == 0))
    none = F.lit(None).cast("string")
    return F.when(kind == "card", F.when(~no_card, kind)).when(kind == "iban", F.when(_mod97(value) == 1, kind)).when(kind.isNotNull(), kind).otherwise(none)


def _byte(digest: Column, k: Column | int) -> Column:
    """The k-th byte (from 0, wrapping at 32) of a hexadecimal digest."""
    at = (k if isinstance(k, Column) else F.lit(k)) % 32
    return F.conv(F.substring(digest, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _letters(value: Column, digest: Column, alphabets=_ALPHABETS) -> Column:
    """Each letter or digit becomes another of its script, case and kind."""

    def one(c: Column, k: Column) -> Column:
        n = (_byte(digest, k) + k).cast("int")
        out = c
        for pattern, alphabet in reversed(alphabets):
            out = F.when(c.rlike(pattern), _pick(alphabet, n)).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The check sum (0 to 9) of a string of digits whose last is the check digit."""
    backwards = F.split(F.reverse(digits), "")
    values = F.transform(backwards, lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def _mod97(value: Column) -> Column:
    """The remainder of an account number, country and check digits moved to its end, letters counted from 10."""
    plain = F.replace(value, F.lit(" "))
    turned = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), lambda a, c: step(a, c).cast("int"))


def _iban(value: Column, digest: Column) -> Column:
    """Country and grouping stay, the check digits are those of the drawn number."""
    country, body = F.substring(value, 1, 2), _letters(F.substring(value, F.lit(5), F.length(value)), digest)
    check = F.lpad((F.lit(98) - _mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
    return F.concat(country, check, body)


def _card(value: Column, digest: Column) -> Column:
    """Digits and grouping; the issuer's first two digits stay; a number that passes the check sum gets one that passes."""
    drawn = F.concat(F.substring(value, 1, 2), _letters(F.substring(value, F.lit(3), F.length(value)), digest))
    head = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    rest = _luhn(F.concat(F.regexp_replace(head, "[^0-9]", ""), F.lit("0")))
    fixed = F.concat(head, ((F.lit(10) - rest) % 10).cast("string"))
    return F.when(_luhn(F.regexp_replace(value, "[^0-9]", "")) == 0, fixed).otherwise(drawn)


def _email(value: Column, digest: Column, draw: Column) -> Column:
    """Local part and host labels are drawn; the registered domain becomes ``example``, the ending stays."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    labels = F.split(domain, r"\.")
    hosts = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0)))
    more = F.when(draw > 1, F.concat(F.conv(F.substring(digest, F.lit(41), F.least(draw * 4, F.lit(14))), 16, 10), draw.cast("string"))).otherwise(F.lit(""))
    host = F.when(F.size(hosts) > 0, F.concat(_letters(F.array_join(hosts, "."), F.reverse(digest)), F.lit("."))).otherwise(F.lit(""))
    return F.concat(_letters(local, digest), more, F.lit("@"), host, F.lit("example."), F.element_at(labels, -1))


def _country_code(value: Column) -> Column:
    return F.regexp_extract(value, r"^\+(?:\d{1,3}(?!\d)|[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})", 0)


#: The end of a phone number whose exchange is kept.
FICTIONAL = r"555-\d{4}\z"


def _phone(value: Column, digest: Column) -> Column:
    """All digits but the country code; an exchange of 555 stays."""
    code = _country_code(value)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    drawn = _letters(rest, digest)
    fictional = F.concat(F.regexp_extract(drawn, r"^(.*?)\d{3}-\d{4}\z", 1), F.lit("555-"), F.substring(drawn, F.length(drawn) - 3, F.lit(4)))
    return F.concat(code, F.when(rest.rlike(FICTIONAL), fictional).otherwise(drawn))


def _ip(value: Column, digest: Column, draw: Column) -> Column:
    """Valid octets; hexadecimal groups keep their form, and a redraw has all eight of them."""
    octets = F.concat_ws(".", *[(_byte(digest, k) % 254 + 1).cast("string") for k in range(4)])
    groups = [("[0-9]", "0123456789"), ("[a-f]", "abcdef"), ("[A-F]", "ABCDEF")]
    head = F.regexp_extract(value, "^.*:", 0)
    long = F.concat_ws(":", *[F.substring(digest, k, 4) for k in range(1, 33, 4)])
    return F.when(head == "", octets).when(draw > 0, long).when(F.contains(value, F.lit(".")), F.concat(_letters(head, digest, groups), octets)).otherwise(_letters(value, digest, groups))


def _secret(value: Column, digest: Column) -> Column:
    """Hexadecimal stays hexadecimal; a known prefix stays."""
    prefix = F.regexp_extract(value, r"^(?:AKIA|gh[pousr]_|sk-)", 0)
    rest = F.substring(value, F.length(prefix) + 1, F.length(value))
    low = [("[0-9a-f]", "0123456789abcdef")]
    high = [("[0-9A-F]", "0123456789ABCDEF")]
    return F.when(prefix != "", F.concat(prefix, _letters(rest, digest))).when(value.rlike("[a-f]"), _letters(value, digest, low)).otherwise(_letters(value, digest, high))


def _name_word(value: Column, kind: Column, digest: Column, draw: Column) -> Column:
    """A listed name of the class and script; redraws add syllables. Upper case stays so."""

    def of(script: str) -> Column:
        base = F.lit(None).cast("string")
        for cls in ("given_m", "given_f", "given_n", "family"):
            names = NAMES[cls, script].split()
            base = F.when(kind == cls, F.get(F.array(*map(F.lit, names)), _byte(digest, 0) % len(names))).otherwise(base)
        syllables = F.array(*map(F.lit, _SYLLABLES[script].split()))
        count = len(_SYLLABLES[script].split())
        tail = F.transform(F.sequence(F.lit(1), F.greatest(draw, F.lit(1))), lambda k: F.get(syllables, _byte(digest, k) % count))
        return F.concat(base, F.when(draw > 0, F.array_join(tail, "")).otherwise(F.lit("")))

    other = _letters(F.concat(value, F.repeat(F.substring(value, F.lit(-1), F.lit(1)), draw)), digest)  # a redraw is longer
    name = F.when(value.rlike(r"^[\p{IsLatin}'’-]+\z"), of("latin")).when(value.rlike(r"^[\p{IsCyrillic}'’-]+\z"), of("cyrillic")).otherwise(other)
    return F.when((F.length(value) > 1) & (F.upper(value) == value), F.upper(name)).otherwise(name)


def surrogate(value: Column, kind: Column, draw: Column, key: str) -> Column:
    """The draw-th (from 0) surrogate of a value of a type."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, value, draw.cast("string")), 256)
    return (
        F.when(kind == "email", _email(value, digest, draw))
        .when(kind == "phone", _phone(value, digest))
        .when(kind == "ip", _ip(value, digest, draw))
        .when(kind == "card", _card(value, digest))
        .when(kind == "secret", _secret(value, digest))
        .when(kind == "iban", _iban(value, digest))
        .when(kind == "ssn", _letters(value, digest))
        .otherwise(_name_word(value, kind, digest, draw))
    )


def _name_parts(span: Column) -> Column:
    """(value, kind) of the words of a titled name, the title left out."""
    words = F.split(span, " ")
    title = F.regexp_replace(F.get(words, 0), r"\.\z", "")
    gender = F.when(title.isin(*TITLES["m"]), "given_m").when(title.isin(*TITLES["f"]), "given_f").otherwise("given_n")
    part = lambda k, kind: F.struct(F.get(words, k).alias("value"), kind.alias("kind"))
    family = F.lit("family")
    return F.when(F.size(words) > 2, F.array(part(1, gender), part(2, family))).otherwise(F.array(part(1, family)))


def _typed(spans: Column) -> Column:
    """(span, kind, parts) of each match; parts are the (value, kind) that are replaced."""

    def of(span: Column) -> Column:
        kind = entity_type(span)
        whole = F.array(F.struct(span.alias("value"), kind.alias("kind")))
        parts = F.when(kind.isNull(), F.slice(whole, 1, 0)).when(kind == "name", _name_parts(span)).otherwise(whole)
        return F.struct(span.alias("span"), kind.alias("kind"), parts.alias("parts"))

    return F.transform(spans, of)


def _entities(spans: Column) -> Column:
    """(value, kind) of all entities of an array of matches."""
    return F.flatten(F.transform(_typed(spans), lambda x: x["parts"]))


def _spans(text: Column) -> Column:
    return F.when(may_hold(text), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))


def _format(value: Column, kind: Column) -> Column:
    """What a permuted surrogate shares with its value: the text around the digits drawn; null if there is nothing to permute."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]\d|\d)"
    code = _country_code(value)
    rest = F.regexp_replace(F.substring(value, F.length(code) + 1, F.length(value)), "[0-9]", "0")
    fictional = F.concat(F.substring(rest, F.lit(1), F.length(rest) - 8), F.lit("555-0000"))  # what _phone keeps is not drawn
    rest = F.when((kind == "phone") & value.rlike(FICTIONAL), fictional).otherwise(rest)
    phone = F.when(kind == "phone", F.concat(code, F.lit("|"), rest))
    return F.when(kind.isin("phone", "ssn"), F.coalesce(phone, rest)).when((kind == "ip") & value.rlike(rf"^(?:{octet}\.){{3}}{octet}\z"), F.lit("octets"))


def _with_halves(values: DataFrame) -> DataFrame:
    """Add the value's drawn digits, or octets, as two numbers, low below ``low_end`` and high below ``high_end``."""
    octets = F.transform(F.split("value", r"\."), lambda x: x.cast("long"))
    rest = F.when(F.col("kind") == "phone", F.substring(F.col("value"), F.length(_country_code(F.col("value"))) + 1, F.length("value"))).otherwise(F.col("value"))
    rest = F.when(F.col("kind") == "phone", F.regexp_replace(rest, r"555-(\d{4})\z", "$1")).otherwise(rest)
    out = values.withColumn("digits", F.regexp_replace(rest, "[^0-9]", "")).withColumn("cut", F.floor(F.length("digits") / 2).cast("int"))
    number = lambda text: F.coalesce(F.when(text != "", text).cast("long"), F.lit(0))
    ip, ten = F.col("kind") == "ip", F.lit(10.0)
    return out.select(
        *out.columns,
        F.when(ip, F.get(octets, 0) * 256 + F.get(octets, 1)).otherwise(number(F.substring("digits", F.lit(1), F.col("cut")))).alias("low"),
        F.when(ip, F.get(octets, 2) * 256 + F.get(octets, 3)).otherwise(number(F.substring(F.col("digits"), F.col("cut") + 1, F.length("digits")))).alias("high"),
        F.when(ip, 65536).otherwise(F.pow(ten, F.col("cut"))).cast("long").alias("low_end"),
        F.when(ip, 65536).otherwise(F.pow(ten, F.length("digits") - F.col("cut"))).cast("long").alias("high_end"),
    )


def permuted(values: DataFrame, key: str) -> DataFrame:
    """(value, kind, surrogate) by a keyed permutation of each (kind, format) without fixed points.

    Rounds that add a keyed digest of one half to the other are a permutation P; the
    surrogate of x is what P takes one place further than x.
    """
    out = _with_halves(values)

    def noise(k: int, half: str) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), "kind", "format", F.lit(k), half), 256)
        return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")

    halves = [("low", "high", "low_end"), ("high", "low", "high_end")] * 2
    for k, (to, by, end) in enumerate(halves):
        out = out.withColumn(to, (F.col(to) + noise(k, by)) % F.col(end))
    carry = F.floor((F.col("high") + 1) / F.col("high_end"))
    out = out.withColumn("low", (F.col("low") + carry) % F.col("low_end")).withColumn("high", (F.col("high") + 1) % F.col("high_end"))
    for k, (to, by, end) in reversed(list(enumerate(halves))):
        out = out.withColumn(to, F.pmod(F.col(to) - noise(k, by), F.col(end)))
    half = lambda name, size: F.when(size > 0, F.lpad(F.col(name).cast("string"), size, "0")).otherwise(F.lit(""))
    out = out.withColumn("drawn", F.concat(half("low", F.col("cut")), half("high", F.length("digits") - F.col("cut"))))
    shape = F.substring_index("format", "|", -1)
    code = F.when(F.col("kind") == "phone", F.substring_index("format", "|", 1)).otherwise(F.lit(""))
    count = lambda k: F.length(F.regexp_replace(F.substring(shape, F.lit(1), k + 1), "[^0]", ""))
    filled = F.transform(F.split(shape, ""), lambda c, k: F.when(c == "0", F.substring(F.col("drawn"), count(k), F.lit(1))).otherwise(c))
    octets = F.concat_ws(".", *[(F.floor(F.col(h) / 256) if k == 0 else F.col(h) % 256).cast("string") for h in ("low", "high") for k in (0, 1)])
    return out.select("value", "kind", F.when(F.col("kind") == "ip", octets).otherwise(F.concat(code, F.array_join(filled, ""))).alias("surrogate"))


def _formed(known: DataFrame) -> DataFrame:
    return known.withColumn("format", _format(F.col("value"), F.col("kind"))).filter("format is not null")


def _dense(known: DataFrame) -> DataFrame:
    """(value, kind, format) of the values whose formats are filled too far to draw from."""
    formed = _formed(known)
    size = F.when(F.col("kind") == "ip", F.lit(2.0**32)).otherwise(F.pow(F.lit(10.0), F.length(F.regexp_replace(F.substring_index("format", "|", -1), "[^0]", ""))))
    full = formed.groupBy("kind", "format").agg(F.count("*").alias("n")).filter(F.col("n") > DENSE * size).drop("n")
    return durable(formed.join(durable(full), ["kind", "format"], "left_semi").select("value", "kind", "format"))


def _aliases(known: DataFrame) -> DataFrame:
    """(value, kind, as): given names after a title without gender that the corpus has with titles of one gender."""
    named = known.filter(F.col("kind").isin("given_m", "given_f", "given_n"))
    of = named.groupBy("value").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))  # three at most
    of = of.filter((F.size("kinds") == 2) & F.array_contains("kinds", "given_n"))
    return of.select("value", F.lit("given_n").alias("kind"), F.get("kinds", F.lit(0)).alias("as"))


def redraws(docs: DataFrame, key: str, text: str = "text", draw: Callable = surrogate) -> DataFrame | None:
    """(value, kind, surrogate) of the values that have another surrogate than their first draw; None if there are none.

    A given name after a title without gender has the surrogate that it has with a title of
    the one gender that the corpus knows for it. Formats in which draws settle nothing more
    are permuted as a whole, so every value gets a surrogate.
    """
    found = docs.select(F.explode(F.array_distinct(_entities(_spans(F.col(text))))).alias("e")).select("e.*")
    known = durable(found.distinct())
    real = known.select(F.col("value").alias("taken")).distinct()
    aliases = durable(_aliases(known))
    named = not aliases.isEmpty()
    left, settled, moved = known, None, None
    if named:
        left = durable(known.join(aliases, ["value", "kind"], "left_anti"))
    dense = _dense(known)
    if not dense.isEmpty():
        settled = moved = durable(permuted(dense, key))
        left = durable(left.join(dense.select("value", "kind"), ["value", "kind"], "left_anti"))
    k = idle = 0
    while not left.isEmpty():
        drawn = left.withColumn("surrogate", draw(F.col("value"), F.col("kind"), F.lit(k), key))
        least = drawn.groupBy("surrogate").agg(F.min(F.struct("value", "kind")).alias("least"))
        won = least.select("surrogate", "least.*").join(real, F.col("surrogate") == F.col("taken"), "left_anti")
        if settled is not None:
            won = won.join(settled.select(F.col("surrogate").alias("taken")), F.col("surrogate") == F.col("taken"), "left_anti")
        won = durable(won.select("value", "kind", "surrogate"))
        settled = won if settled is None else settled.unionByName(won)
        moved = moved if k == 0 else won if moved is None else moved.unionByName(won)
        left = durable(left.join(won, ["value", "kind"], "left_anti"))
        idle = idle + 1 if won.isEmpty() else 0
        if idle >= IDLE_DRAWS:
            full = durable(_formed(left).select("kind", "format").distinct())
            whole = durable(_formed(known).join(full, ["kind", "format"], "left_semi").select("value", "kind", "format"))
            turned, idle = durable(permuted(whole, key)), 0
            others = lambda rows: rows.join(whole.select("value", "kind"), ["value", "kind"], "left_anti")
            settled = durable(others(settled).unionByName(turned))
            moved = turned if moved is None else durable(others(moved).unionByName(turned))
            left = durable(others(left))
        k += 1
    if named:
        shared = settled.select("value", F.col("kind").alias("as"), "surrogate")
        shared = durable(aliases.join(shared, ["value", "as"]).select("value", "kind", "surrogate"))
        moved = shared if moved is None else moved.unionByName(shared)
    return None if moved is None or moved.isEmpty() else moved


def _drawn(typed: Column, replace: Callable[[Column, Column], Column]) -> Column:
    """(span, kind, parts, to): the replacements of each match's parts, the one place where they are computed."""
    to = lambda x: F.transform(x["parts"], lambda p: replace(p["value"], p["kind"]))
    return F.transform(typed, lambda x: F.struct(x["span"].alias("span"), x["kind"].alias("kind"), x["parts"].alias("parts"), to(x).alias("to")))


def _names(drawn: Column) -> Column:
    """(value, to) of the name words of a text that are followed when they stand alone."""
    pairs = lambda x: F.zip_with(x["parts"], x["to"], lambda p, t: F.struct(p["value"].alias("value"), t.alias("to")))
    every = F.flatten(F.transform(F.filter(drawn, lambda x: x["kind"] == "name"), pairs))
    return F.filter(every, lambda n: ~n["value"].isin(ORDINARY))


def _rebuilt(text: Column, drawn: Column, names: Column) -> Column:
    """The text with its matches, and later mentions of its names, replaced."""

    def span(x: Column) -> Column:
        named = F.concat_ws(" ", F.substring_index(x["span"], " ", 1), F.array_join(x["to"], " "))
        return F.when(x["kind"].isNull(), x["span"]).when(x["kind"] == "name", named).otherwise(F.get(x["to"], 0))

    def between(piece: Column) -> Column:
        tokens = F.regexp_extract_all(piece, F.lit(r"\p{L}[\p{L}'’-]*|[^\p{L}]+"), 0)
        follow = F.transform(tokens, lambda t: F.coalesce(F.get(F.filter(names, lambda n: n["value"] == t), 0)["to"], t))
        return F.when(F.size(names) > 0, F.array_join(follow, "")).otherwise(piece)

    joined = F.zip_with(F.split(text, ANY, -1), drawn, lambda p, x: F.concat(between(p), F.coalesce(span(x), F.lit(""))))
    return F.array_join(joined, "")


def with_surrogates(docs: DataFrame, key: str = DEFAULT_KEY, text: str = "text", entities: str | None = None) -> DataFrame:
    """docs with the text column's personal data replaced; ``entities`` names a column for
    the sorted array of (value, kind) that were replaced, if wanted.

    Null and empty texts stay as they are; so does a text without entities. The rows and
    all other columns stay, whatever their names, repeated rows included; equal texts get
    equal results. An empty table stays empty.
    """
    again = redraws(docs, key, text)
    spans, typed, drawn, names, own, own_key = private(docs, "_spans", "_typed", "_drawn", "_names", "_own", "_own_key")
    out = docs.withColumn(spans, _spans(F.coalesce(F.col(text), F.lit(""))))
    first = functools.partial(surrogate, draw=F.lit(0), key=key)
    if again is None:
        replace = first
    elif fits(again, MOST_LITERALS):
        rows = [(f"{r.kind}|{r.value}", r.surrogate) for r in again.collect()]
        known = F.map_from_arrays(F.lit([a for a, _ in rows]), F.lit([b for _, b in rows]))

        def replace(value: Column, kind: Column) -> Column:
            return F.coalesce(F.try_element_at(known, F.concat_ws("|", kind, value)), first(value, kind))

    else:
        # Values go to the redrawn ones and come back by text, so that the texts themselves don't move twice.
        texts = docs.select(F.sha2(F.col(text), 256).alias("k"), F.explode(F.array_distinct(_entities(_spans(F.col(text))))).alias("e"))
        met = texts.select("k", "e.*").distinct().join(again, ["value", "kind"])
        maps = met.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "value"), "surrogate"))).alias(own))
        # A written table: a text that many rows share can then be split in the join.
        maps = durable(maps.withColumnRenamed("k", own_key))
        out = out.join(maps, F.sha2(F.col(text), 256) == F.col(own_key), "left").drop(own_key)

        def replace(value: Column, kind: Column) -> Column:
            return F.coalesce(F.try_element_at(F.col(own), F.concat_ws("|", kind, value)), first(value, kind))

    # One projection after the other, so that each is computed once.
    out = out.withColumn(typed, _typed(F.col(spans))).withColumn(drawn, _drawn(F.col(typed), replace)).withColumn(names, _names(F.col(drawn)))
    if entities:
        out = out.withColumn(entities, F.array_sort(F.array_distinct(F.flatten(F.transform(typed, lambda x: x["parts"])))))
    changed = F.when(F.size(spans) > 0, _rebuilt(F.col(text), F.col(drawn), F.col(names))).otherwise(F.col(text))
    return out.withColumn(text, changed).drop(spans, typed, drawn, names, own)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the replaced text, n_entities and kinds of every document; see with_surrogates."""
    seen = with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), entities="found")
    kinds = F.array_join(F.array_distinct(F.array_sort(F.transform("found", lambda e: e["kind"]))), ",")
    return seen.select("doc_id", "text", F.size("found").cast("long").alias("n_entities"), kinds.alias("kinds"))
