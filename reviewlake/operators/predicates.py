"""Search conditions over publication fields, composed in Python.

A :class:`Clause` is bound to a table with :meth:`Clause.on` and becomes one
boolean Column, which Catalyst is free to push down, simplify and reorder::

    hits = corpus.where(
        all_of(term("graph*"), negate(term("survey")), near("deep", "learning", 2))
        .in_fields("title", "abstract")
        .on(corpus)
    )
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Case-insensitive, dot matches newlines, Unicode word classes.
FLAGS = "(?siU)"
WILDCARDS = frozenset("*?+()")


@dataclass(frozen=True)
class Scope:
    """What a clause may read: inherited fields, existing columns, strictness."""

    fields: tuple[str, ...]
    columns: frozenset[str]
    strict: bool

    def usable(self, own: Sequence[str]) -> list[str]:
        wanted = tuple(own) or self.fields
        missing = [f for f in wanted if f not in self.columns]
        if missing and self.strict:
            raise ValueError(f"unsupported fields: {', '.join(missing)}")
        return [f for f in wanted if f in self.columns]


@dataclass(frozen=True)
class Clause:
    """A condition that is not yet bound to the columns of a table."""

    bind: Callable[[Scope], Column | None]
    fields: tuple[str, ...] = ()

    def in_fields(self, *fields: str) -> Clause:
        """Give a field scope to every inner clause without its own."""
        return Clause(self.bind, tuple(fields))

    def resolve(self, scope: Scope) -> Column | None:
        inner = Scope(self.fields or scope.fields, scope.columns, scope.strict)
        return self.bind(inner)

    def on(self, df: DataFrame, fields: Sequence[str] = (), strict: bool = False) -> Column:
        """Boolean Column for ``df``; a clause on absent fields is dropped.

        When nothing is left every row is kept.
        """
        bound = self.resolve(Scope(tuple(fields), frozenset(df.columns), strict))
        return F.lit(True) if bound is None else bound

    def __and__(self, other: Clause) -> Clause:
        return all_of(self, other)

    def __or__(self, other: Clause) -> Clause:
        return any_of(self, other)

    def __invert__(self) -> Clause:
        return negate(self)


def wildcard_pattern(value: str) -> str:
    """Regular expression of a search value.

    ``*`` stands for word characters, ``?`` for at most one of them, ``+`` for
    any text; parentheses group; a space is any white space character.
    """
    special = {"*": r"\w*", "?": r"\w?", "+": ".+", "(": "(", ")": ")", " ": r"\s"}
    return "".join(special.get(ch, re.escape(ch)) for ch in value)


def _over_fields(own: Sequence[str], test: Callable[[Column], Column]) -> Clause:
    def bind(scope: Scope) -> Column | None:
        # Left nullable, so that comparisons reach the scan: a filter drops null
        # like false, and a negation turns null into false first.
        found = [test(F.col(f)) for f in scope.usable(own)]
        return reduce(lambda a, b: a | b, found) if found else None

    return Clause(bind)


def term(value: str, *fields: str) -> Clause:
    """The value occurs in one of the fields, ignoring case."""
    if not WILDCARDS & set(value) and not any(ch.isspace() for ch in value):
        needle = value.lower()
        return _over_fields(fields, lambda c: F.contains(F.lower(c), F.lit(needle)))
    pattern = FLAGS + wildcard_pattern(value)
    return _over_fields(fields, lambda c: c.rlike(pattern))


def strict_match(value: str, *fields: str) -> Clause:
    return term(value, *fields)


def loose_match(value: str, *fields: str) -> Clause:
    return term(value, *fields)


def regex(pattern: str, *fields: str) -> Clause:
    """A pattern of the user, taken as it is."""
    return _over_fields(fields, lambda c: c.rlike(FLAGS + pattern))


def approx(value: str, *fields: str, max_edits: int | None = None) -> Clause:
    """Like :func:`term`; with ``max_edits`` a word may differ by that many edits."""
    if max_edits is None:
        return term(value, *fields)

    def test(c: Column) -> Column:
        words, wanted = F.split(F.lower(c), r"(?U)\W+"), F.lit(value.lower())
        # The bounded distance is -1 beyond the bound.
        return F.exists(words, lambda w: F.levenshtein(w, wanted, max_edits) >= 0)

    return _over_fields(fields, test)


def near(left: str, right: str, distance: int, *fields: str) -> Clause:
    """Both values with at most ``distance`` words between them, in any order."""
    a, b = wildcard_pattern(left), wildcard_pattern(right)
    gap = rf"(?:\W+\w+){{0,{distance}}}\W+"
    either = rf"{FLAGS}(?:\b(?:{a})\b{gap}\b(?:{b})\b|\b(?:{b})\b{gap}\b(?:{a})\b)"

    def test(c: Column) -> Column:
        # The two plain tests are cheap and spare most rows the proximity test.
        return c.rlike(FLAGS + a) & c.rlike(FLAGS + b) & c.rlike(either)

    return _over_fields(fields, test)


def exact(value: object, *fields: str) -> Clause:
    """Filter target: a field equals the value (pushed down to the scan)."""
    return _over_fields(fields, lambda c: c == F.lit(value))


def all_of(*clauses: Clause) -> Clause:
    return _combine(clauses, lambda a, b: a & b)


def any_of(*clauses: Clause) -> Clause:
    return _combine(clauses, lambda a, b: a | b)


def _combine(clauses: Iterable[Clause], op: Callable[[Column, Column], Column]) -> Clause:
    parts = tuple(clauses)

    def bind(scope: Scope) -> Column | None:
        bound = [c for c in (p.resolve(scope) for p in parts) if c is not None]
        return reduce(op, bound) if bound else None

    return Clause(bind)


def negate(clause: Clause) -> Clause:
    """True where the clause does not hold; a missing field does not hold."""

    def bind(scope: Scope) -> Column | None:
        bound = clause.resolve(scope)
        return None if bound is None else ~F.coalesce(bound, F.lit(False))

    return Clause(bind)


def _bound(text: str, last_day: bool) -> Column:
    """A year alone widens to its first or last day."""
    if re.fullmatch(r"\d{4}", text):
        text = f"{text}-12-31" if last_day else f"{text}-01-01"
    return F.lit(text).cast("date")


def _date_range(field: str, low: str | None, high: str | None) -> Clause:
    def test(c: Column) -> Column:
        tests = []
        if low is not None:
            tests.append(c >= _bound(low, last_day=False))
        if high is not None:
            # Written as "before the next day", so timestamps late on the last
            # day count and the bare column stays comparable in the scan.
            tests.append(c < F.date_add(_bound(high, last_day=True), 1))
        return reduce(lambda a, b: a & b, tests)

    return _over_fields((field,), test)


def between(field: str, low: str, high: str) -> Clause:
    return _date_range(field, low, high)


def after(field: str, low: str) -> Clause:
    return _date_range(field, low, None)


def before(field: str, high: str) -> Clause:
    return _date_range(field, None, high)


def year_range(first: int, last: int, field: str = "year") -> Clause:
    return _over_fields((field,), lambda c: c.between(first, last))


def _one_of(values: Sequence[str], field: str) -> Clause:
    if not values:
        return Clause(lambda scope: None)
    return _over_fields((field,), lambda c: c.isin(*values))


def subject_areas(*values: str, field: str = "subject") -> Clause:
    return _one_of(values, field)


def doc_types(*values: str, field: str = "evidence_type") -> Clause:
    return _one_of(values, field)


def languages(*values: str, field: str = "language") -> Clause:
    return _one_of(values, field)


def keywords(*values: str, field: str = "keywords") -> Clause:
    """One of the keywords occurs in the keyword field."""
    if not values:
        return Clause(lambda scope: None)
    return any_of(*[term(v, field) for v in values])


def title(value: str) -> Clause:
    return term(value, "title")


def abstract(value: str) -> Clause:
    return term(value, "abstract")


def title_abs(value: str) -> Clause:
    return term(value, "title", "abstract")


def title_abs_keys(value: str) -> Clause:
    return term(value, "title", "abstract", "keywords")


def select_where(df: DataFrame, clause: Clause, strict: bool = False) -> DataFrame:
    """Keep the rows the clause holds for."""
    return df.where(clause.on(df, strict=strict))
