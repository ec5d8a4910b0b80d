"""Scalar text functions, all built-in Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes that may stand before a DOI.
DOI_PREFIXES = (
    "https://doi.org/",
    "http://doi.org/",
    "https://dx.doi.org/",
    "http://dx.doi.org/",
    "doi:",
)
# Spellings of true and false, lower case.
TRUE_WORDS = ("yes", "y", "true", "=true", "=true()", "t", "on", "1", "include")
FALSE_WORDS = ("no", "n", "false", "=false", "=false()", "f", "off", "0", "exclude", "")
# Texts that stand for a missing value.
NON_VALUES = ("", "\r", "\n", "\t", " ", "nan")
# Stored decision words and the states they mean.
DECISION_STATES = {"": "undecided", "include": "included", "exclude": "excluded"}
STORED_DECISIONS = {"undecided": "", "included": "include", "excluded": "exclude"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(values: Mapping[str, str]) -> Column:
    """A map column from a small Python dict."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def strip(c: Column | str) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(_col(c).cast("string"), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column | str) -> Column:
    """Null, empty or only white space; stops at the first other character."""
    return ~F.coalesce(_col(c).cast("string").rlike(r"(?U)\S"), F.lit(False))


def is_usable(c: Column | str) -> Column:
    return ~is_blank(c)


def non_blank(c: Column | str) -> Column:
    """The value, or null when it is blank."""
    return F.when(is_usable(c), _col(c))


def first_non_blank(*cols: Column | str) -> Column:
    return F.coalesce(*[non_blank(c) for c in cols])


def clean_value(c: Column | str) -> Column:
    """Lower case, without quotes and white space at the ends; empty is null.

    A null stays null: a missing field is no evidence for or against a match.
    """
    lowered = F.lower(_col(c).cast("string"))
    return F.nullif(F.btrim(lowered, F.lit("\"' \t\n\r")), F.lit(""))


def normalize_doi(c: Column | str) -> Column:
    """Trim, lower-case, drop one known prefix; nothing left is null."""
    pattern = "^(" + "|".join(p.replace(".", r"\.") for p in DOI_PREFIXES) + ")"
    return F.nullif(F.regexp_replace(F.lower(strip(c)), pattern, ""), F.lit(""))


def comparison_key(columns: Sequence[str], present: Sequence[str]) -> Column:
    """Trimmed, lower-cased values joined by ``_``; absent columns count as ''."""
    parts = [
        F.coalesce(F.lower(strip(c)), F.lit("")) if c in present else F.lit("") for c in columns
    ]
    return F.concat_ws("_", *parts)


def tokens(c: Column | str) -> Column:
    """Distinct lower-case words, in order of first appearance."""
    words = F.split(F.lower(_col(c).cast("string")), r"(?U)\W+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def parse_list(c: Column | str, separator: str = ";") -> Column:
    """Split, trim, drop empty items; null gives an empty list."""
    items = F.split(_col(c).cast("string"), separator)
    trimmed = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.coalesce(trimmed, F.array().cast("array<string>"))


def join_list(c: Column | str, separator: str = ";") -> Column:
    return F.array_join(_col(c), separator)


def split_reasons(c: Column | str) -> Column:
    """Split every reason of a list on commas and trim."""
    return F.flatten(F.transform(_col(c), lambda r: F.transform(F.split(r, ","), strip)))


def ordered_distinct(c: Column | str) -> Column:
    """Trim, lower-case, drop blanks, keep the first of equal items."""
    cleaned = F.transform(_col(c), lambda r: F.lower(strip(r)))
    return F.array_distinct(F.filter(cleaned, lambda r: r != ""))


def parse_date(c: Column | str, strict: bool = False) -> Column:
    """Timestamp of a full or partial ISO date; digits alone are a year.

    Missing values give null. Other text gives null too, or stops the job when
    ``strict`` is set.
    """
    text = _col(c).cast("string")
    missing = text.isNull() | text.isin(*NON_VALUES)
    year = F.try_make_timestamp_ntz(
        text.try_cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)
    )
    value = F.when(text.rlike(r"^\d+$"), year).when(
        text.rlike(r"^\d{4}-\d{2}"), text.try_cast("timestamp_ntz")
    )
    if strict:
        problem = F.raise_error(F.concat(F.lit("invalid publication date: "), text))
        value = F.coalesce(value, problem.cast("timestamp_ntz"))
    return F.when(~missing, value)


def year_of(c: Column | str) -> Column:
    """Year of a ``yyyy-MM-dd`` text; null when it is none."""
    return F.year(F.try_to_date(_col(c), "yyyy-MM-dd"))


def monday_of(c: Column | str) -> Column:
    """``yyyyMMdd`` of the Monday of the week."""
    return F.date_format(F.date_trunc("week", _col(c)), "yyyyMMdd")


def to_bool(c: Column | str, strict: bool = False) -> Column:
    """Boolean of its many spellings; null is false, other text null or an error."""
    word = F.lower(strip(c))
    value = F.when(word.isNull() | word.isin(*FALSE_WORDS), F.lit(False)).when(
        word.isin(*TRUE_WORDS), F.lit(True)
    )
    if strict:
        problem = F.raise_error(F.concat(F.lit("can't convert to bool: "), word))
        value = F.coalesce(value, problem.cast("boolean"))
    return value


def decision_word(c: Column | str) -> Column:
    """Decision cell in comparable form: trimmed, lower case, blank is ''."""
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def decision_state(c: Column | str) -> Column:
    return literal_map(DECISION_STATES)[decision_word(c)]


def stored_decision(c: Column | str) -> Column:
    return literal_map(STORED_DECISIONS)[_col(c)]


def doi_url(c: Column | str) -> Column:
    return F.concat(F.lit("https://doi.org/"), _col(c))


def local_file_name(url: Column | str) -> Column:
    """``<last path part>-<md5 of the url>.pdf``, percent signs decoded."""
    link = _col(url)
    last = F.element_at(F.split(link, "/"), -1)
    # A plus sign is a plain character in a path, unlike in a form value.
    name = F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))
    return F.concat(F.regexp_replace(name, r"\.pdf$", ""), F.lit("-"), F.md5(link), F.lit(".pdf"))


def url_scheme(url: Column | str) -> Column:
    return F.lower(F.nullif(F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), F.lit("")))


def local_path(url: Column | str) -> Column:
    """Path of a ``file:`` url on this host; null for any other url."""
    host = F.regexp_extract(_col(url), r"^(?i:file)://([^/?#]*)", 1)
    path = F.regexp_extract(_col(url), r"^(?i:file):(?://[^/?#]*)?([^?#]*)", 1)
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when((url_scheme(url) == "file") & host.isin("", "localhost"), decoded)
