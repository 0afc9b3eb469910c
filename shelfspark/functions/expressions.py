"""Column expressions that the operators share."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.dates import fuzzy_date

DIMENSIONS = ("emotional_impact", "intellectual_depth", "writing_quality", "rereadability", "pacing", "readability", "plot_complexity", "humor")
#: Shelves whose rows count as readers, and as having read.
READER_SHELVES = ("want_to_read", "reading", "read")
READ_SHELVES = ("read", "reading")


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def total_ratings() -> Column:
    return _zero("rating_count") + _zero("ol_rating_count")


def rating_points() -> Column:
    """Both averages times their counts."""
    return _zero("avg_rating").cast("double") * _zero("rating_count") + _zero("ol_avg_rating").cast("double") * _zero("ol_rating_count")


def combined_rating(on_zero: float | None = 0.0) -> Column:
    """Average over both kinds of ratings; on_zero where there are none."""
    value = F.try_divide(rating_points(), total_ratings().cast("double"))
    return value if on_zero is None else F.coalesce(value, F.lit(on_zero))


def library_readers() -> Column:
    return _zero("ol_want_to_read_count") + _zero("ol_currently_reading_count") + _zero("ol_already_read_count")


def listable() -> Column:
    """Books that lists may show."""
    return F.col("primary_cover_url").isNotNull() & (F.col("language") == "en")


def bayesian(n: Column, average: Column, mean: float = 3.0, weight: float = 10.0) -> Column:
    """Average drawn towards the mean as if by `weight` more ratings."""
    return (n * average + weight * mean) / (n + weight)


def average_of_halves(halves: Column, n: Column) -> Column:
    """Average of ratings in half points, given twice their sum, rounded half up to two places in whole numbers."""
    return F.floor((halves * 100 + n) / (n * 2)).cast("double") / 100.0


def seeded_order(key: Column, seed: int) -> Column:
    """A shuffle that is the same for the same seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def six(value: Column) -> Column:
    return F.round(value.cast("double"), 6)


# ---- text and id helpers


def _accented() -> tuple[str, str]:
    """Small Latin letters with accents, and the letters that they are made of, by Unicode's own decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for block in (range(0xE0, 0x250), range(0x1E00, 0x1F00)) for c in block if chr(c).islower()]
    found = [(c, base) for c, base in pairs if base != c and base.isascii() and base.isalpha()]
    return "".join(c for c, _ in found), "".join(base for _, base in found)


ACCENTED, PLAIN = _accented()
#: Small letters in Latin script, of several letters or none that Unicode takes apart.
LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i", "ħ": "h", "ŋ": "ng", "ŧ": "t", "ĸ": "k", "ĳ": "ij"}
#: Greek and Cyrillic small letters in Latin ones.
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split()))
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґў", "a b v g d e io zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia i i ie g u".split()))


def fold_accents(text: Column) -> Column:
    """Lower case, Latin letters without their accents: one letter for each."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def transliterated(text: Column) -> Column:
    """Lower case in ASCII letters as far as Latin, Greek and Cyrillic script go; other scripts are left as they are.
    Texts within ASCII take no part in the replacements."""
    low = F.lower(text)
    table = LETTERS | GREEK | CYRILLIC
    single = {k: v for k, v in table.items() if len(v) == 1}
    accents = {unicodedata.normalize("NFC", base + mark): base for base in "αεηιουωиеу" for mark in "\u0301\u0308\u0306" if len(unicodedata.normalize("NFC", base + mark)) == 1 and unicodedata.normalize("NFC", base + mark) not in table}
    out = F.translate(low, "".join(accents), "".join(accents.values()))
    for letter, letters in table.items():
        if len(letters) > 1:
            out = F.replace(out, F.lit(letter), F.lit(letters))
    out = F.translate(out, ACCENTED + "".join(single), PLAIN + "".join(single.values()))
    out = F.regexp_replace(out, r"\p{Mn}", "")
    return F.when(low.rlike(r"[^\x00-\x7F]"), out).otherwise(low)


def slug_ascii(text: Column, most: int = 200) -> Column:
    """Slug of a text: other scripts and accented letters in ASCII letters where there are any; an empty result is
    replaced by a hash of the text."""
    plain = F.regexp_replace(transliterated(F.coalesce(text, F.lit(""))), r"[^a-z0-9_\s-]", "")
    dashed = F.substring(F.regexp_replace(F.regexp_replace(plain, r"[-\s]+", "-"), r"^-+|-+$", ""), 1, most)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).when(dashed == "", F.substring(F.md5(text), 1, 16)).otherwise(dashed)


#: Fixed value: a series' name, and its number where there is one.
SERIES = r"^(.+?)(?:\s*[#,]\s*(\d+(?:\.\d+)?))?$"


def series_name(text: Column) -> Column:
    return F.regexp_extract(text, SERIES, 1)


def series_number(text: Column) -> Column:
    found = F.regexp_extract(text, SERIES, 2)
    return F.when(found != "", found.try_cast("double"))


def clamp_position(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when((number >= 0) & (number <= 999.99), number)


def parse_date(text: Column) -> Column:
    """Year alone is its first of January; missing parts are 1; what none of the formats reads is left to fuzzy_date()."""
    low = F.lower(F.trim(text))
    known = F.when(~low.isin("", "null", "unknown", "n/a", "none"), F.trim(text))
    tried = [F.try_to_timestamp(known, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "yyyy-MM", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy", "MMMM yyyy", "yyyy/MM/dd")]
    year = F.when(known.rlike(r"^\d{4}$"), F.make_date(known.try_cast("int"), F.lit(1), F.lit(1)))
    return F.coalesce(year, *tried, fuzzy_date(known))


def work_number(key: Column) -> Column:
    """The number in ids like OL123W; null for others."""
    found = F.regexp_extract(key, r"OL(\d+)[A-Z]$", 1)
    return F.when(found != "", found.try_cast("long"))


def is_qid(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^Q\d+$"), F.lit(False))


def truthy_count(*values: Column) -> Column:
    """How many of the values are there: not null, not empty, not zero."""
    return sum((F.coalesce(v, F.lit(False)).cast("int") for v in values), F.lit(0))


def filled(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def book_format(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.contains("hardcover") | low.contains("hardback"), "hardcover")
        .when(low.contains("paperback") | low.contains("softcover"), "paperback")
        .when(low.contains("ebook") | low.contains("kindle"), "ebook")
        .when(low.contains("audio"), "audiobook")
        .otherwise("paperback")
    )


def year_of(text: Column) -> Column:
    return F.substring(text, 1, 4).try_cast("int")


def title_label(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def username_candidate(text: Column) -> Column:
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_]", "_")
    clean = F.substring(F.regexp_replace(F.regexp_replace(clean, "_+", "_"), "^_+|_+$", ""), 1, 40)
    return F.when(clean == "", F.lit("user")).otherwise(clean)


def rarity(average: Column) -> Column:
    """Tier by average alone."""
    return (
        F.when(average >= 4.75, "legendary").when(average >= 4.5, "ultra_rare").when(average >= 4.0, "super_rare").when(average >= 3.25, "rare").when(average >= 2.25, "uncommon").otherwise("common")
    )
