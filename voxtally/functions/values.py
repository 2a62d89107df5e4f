"""Rating and date parsing as column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, functions as F

from voxtally import fixed
from voxtally.functions.exprs import constant, let, strip, trim_to_null

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_INFINITE = r"(?i)^[+-]?inf(inity)?$"

# Names of months, and words that mean nothing in a date.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
FILLERS = ("of", "at", "on", "and", "ad", "st", "nd", "rd", "th")


def date_places(signature: str) -> tuple[int, int, int] | None:
    """Where year, month and day are among the parts of a date (0-based, -1: not given), by the class of each part; null: no date.

    Classes: ``M`` a month's name, ``Y`` a number of four digits, and of shorter numbers ``n`` up to 12, ``d`` up to 31, ``z`` beyond. A month's name or a number that
    can only be a year settles the rest; plain numbers are month first, day first where the first can't be a month.
    """
    size, name = len(signature), signature.find("M")
    years = [i for i, c in enumerate(signature) if c in "Yz"]
    if signature.count("M") > 1 or len(years) > 1:
        return None
    if size == 1:
        return (0, -1, -1) if signature == "Y" else None
    rest = [i for i in range(size) if i != name]
    if size == 2:
        if not years:
            return None
        month = name if name >= 0 else rest[1 - rest.index(years[0])]
        return (years[0], month, -1) if signature[month] in "Mn" else None
    if name >= 0:
        year = years[0] if years else rest[0] if name == 2 else rest[1]
        return year, name, next(i for i in rest if i != year)
    if years == [0]:
        return (0, 1, 2) if signature[1] == "n" else None
    if years == [1]:
        return None
    return (2, 1, 0) if signature[0] == "d" else (2, 0, 1)


def _date_table() -> dict[str, list[int]]:
    found = {"".join(c): date_places("".join(c)) for n in (1, 2, 3) for c in product("MYndz", repeat=n)}
    return {signature: list(places) for signature, places in found.items() if places}


# What is taken off before the parts are looked at: a time of day, a day of the week, the ending of an ordinal number.
_CLOCK = r"(?i)(?:[T ,]\s*)(?:at\s+)?(?:\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?\s*(?:[ap]\.?m\.?)?|\d{1,2}\s*[ap]\.?m\.?)\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})?$"
_CLOCK_INSIDE = r"(?i)(?:^|\s)\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:\s*[ap]\.?m\.?)?(?=\s)"
_COMPACT_CLOCK = r"^(\d{8})(?:T?\d{6}|T?\d{4})Z?$"
_WEEKDAY = r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+"
_ORDINAL = r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b(?:\s+of)?"
_PART = r"(?:(?:[0-9]{4}|[0-9]{1,2})(?![0-9])|[A-Za-z]+)"
_PARTS = rf"^{_PART}(?:(?:[\s,./;'-]+|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])){_PART})*+[.,]?$"
# Two-digit years from here on are of the last century.
_CENTURY = 69


def is_number(column: Column) -> Column:
    return F.rlike(strip(column), F.lit(_NUMBER))


def parse_rating(raw: Column) -> Column:
    """The rating as double when it is a number within range, else null."""
    number = F.when(is_number(raw), strip(raw).try_cast("double"))
    return F.when(number.between(fixed.MIN_RATING, fixed.MAX_RATING), number)


def rating_error(raw: Column) -> Column:
    """Message for an unusable rating; null when missing or fine.  ``nan`` counts as missing."""
    given = trim_to_null(raw).isNotNull() & (F.lower(strip(raw)) != "nan")
    said = F.concat(F.lit("Rating '"), raw)
    outside = F.concat(said, F.lit(f"' is outside the allowed range {fixed.MIN_RATING:g}-{fixed.MAX_RATING:g}."))
    numeric = is_number(raw) | F.rlike(strip(raw), F.lit(_INFINITE))
    return F.when(given & ~numeric, F.concat(said, F.lit("' is not numeric."))).when(
        given & parse_rating(raw).isNull(), outside
    )


def parse_date(raw: Column) -> Column:
    """Calendar day of a free-form date text, null when unreadable or outside 1677-09-22 … 2262-04-11.

    One scan cuts the text into numbers and words; the classes of these parts are a signature, and a table tells for each
    signature where year, month and day are. What is not given is 1.
    """
    months = constant(MONTHS, "map<string,int>")
    table = constant(_date_table(), "map<string,array<int>>")

    def part(token: Column) -> Column:
        number = token.try_cast("int")
        name = F.try_element_at(months, token)
        kind = (
            F.when(name.isNotNull(), "M").when(number.isNull(), "x").when(F.length(token) == 4, "Y")
            .when(number == 0, "x").when(number <= 12, "n").when(number <= 31, "d").otherwise("z")
        )
        kind = F.when((number == 0) & (F.length(token) == 2), "z").otherwise(kind)  # the year 2000
        value = F.coalesce(name, number)
        return F.struct(kind.alias("kind"), value.alias("value"), (F.length(token) <= 2).alias("short"))

    def read(parts: Column) -> Column:
        signature = F.array_join(F.transform(parts, lambda p: p["kind"]), "")
        return let(F.struct(parts.alias("p"), F.try_element_at(table, signature).alias("at")), place)

    def place(given: Column) -> Column:
        def value(k: int) -> Column:
            at = given["at"][k]
            return F.when(at >= 0, F.get(given["p"], at)["value"]).otherwise(1)

        year = value(0)
        short = F.get(given["p"], given["at"][0])["short"]
        full = F.when(short, year + F.when(year < _CENTURY, 2000).otherwise(1900)).otherwise(year)
        day = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", full, value(1), value(2)), F.lit("yyyy-MM-dd"))
        return F.when(given["at"].isNotNull(), F.to_date(day))

    def scan(text: Column) -> Column:
        tokens = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[0-9]+|[a-z]+"), F.lit(0)), lambda t: ~t.isin(*FILLERS))
        compact = F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd")))
        return F.when(F.rlike(text, F.lit("^[0-9]{8}$")), compact).when(F.rlike(text, F.lit(_PARTS)) & ~F.rlike(text, F.lit(r"^\d+\.\d+$")), let(F.transform(tokens, part), read))

    bare = F.regexp_replace(F.regexp_replace(strip(raw), _WEEKDAY, ""), _CLOCK, "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, _CLOCK_INSIDE, " "), _COMPACT_CLOCK, "$1"), _ORDINAL, "$1")
    date = let(strip(bare), scan)
    # Most dates are plain ISO ones; those need none of the above, which is not evaluated for them.
    trimmed = strip(raw)
    date = F.when(F.rlike(trimmed, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), trimmed.try_cast("date")).otherwise(date)
    earliest, latest = F.lit("1677-09-22").cast("date"), F.lit("2262-04-11").cast("date")
    return let(date, lambda d: F.when(d.between(earliest, latest), d))


def date_error(raw: Column, parsed: Column | None = None) -> Column:
    """Message for an unreadable date; ``parsed`` is the outcome of ``parse_date`` where it is at hand."""
    text = trim_to_null(raw)
    day = parse_date(raw) if parsed is None else parsed
    return F.when(text.isNotNull() & day.isNull(), F.concat(F.lit("Date '"), text, F.lit("' could not be parsed.")))
