"""Structured filters.  Two families with different rules, and both take columns, so that a batch of
queries against a catalog is one join on a predicate.

``passes`` is the two-valued filter of search constraints; null attributes count as empty.
``matches`` is the compiled condition of a database: three-valued, absent conditions are null or empty.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds by name.
KINDS = {"必修": 1, "選修": 2, "通識": 3, "體育": 4}


def _given(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def _holds(values: Column, x: Column) -> Column:
    return F.coalesce(F.array_contains(values, x), F.lit(False))


# ---- the search filter -----------------------------------------------------------------------------------------


def weekday_included(sessions: Column, days: Column) -> Column:
    """Some session lies on one of the days; without sessions it fails."""
    return F.coalesce(F.exists(sessions, lambda s: F.array_contains(days, s["weekday"])), F.lit(False))


def weekday_excluded(sessions: Column, days: Column) -> Column:
    """No session lies on one of the days."""
    return ~weekday_included(sessions, days)


def hours_overlap(sessions: Column, low: Column, high: Column) -> Column:
    """Some session ends after ``low`` and starts before ``high`` (either may be null); without sessions it passes."""
    inside = F.exists(sessions, lambda s: F.coalesce(s["end_hour"] > low, F.lit(True)) & F.coalesce(s["start_hour"] < high, F.lit(True)))
    return F.coalesce(F.size(sessions) <= 0, F.lit(True)) | F.coalesce(inside, F.lit(False))


def outside_ranges(sessions: Column, ranges: Column) -> Column:
    """Fails only if all sessions, and at least one, lie inside one of the ranges (array of low, high)."""
    inside = F.exists(ranges, lambda r: F.forall(sessions, lambda s: (s["start_hour"] >= r["low"]) & (s["end_hour"] <= r["high"])))
    return ~(F.coalesce(F.size(sessions) > 0, F.lit(False)) & F.coalesce(inside, F.lit(False)))


def value_in(x: Column, include: Column, exclude: Column) -> Column:
    return (~_given(include) | _holds(include, x)) & ~_holds(exclude, x)


def in_range(x: Column, low: Column, high: Column) -> Column:
    """A null value counts as 0, a null bound as none."""
    x = F.coalesce(x, F.lit(0.0))
    return F.coalesce(x >= low, F.lit(True)) & F.coalesce(x <= high, F.lit(True))


def contains_any(x: Column, words: Column) -> Column:
    return F.coalesce(F.exists(words, lambda w: F.contains(F.coalesce(x, F.lit("")), w)), F.lit(False))


def has_constraints(c: Column) -> Column:
    arrays = ("weekday_include", "weekday_exclude", "hour_exclude_ranges", "lang_include", "lang_exclude", "kind_include", "kind_exclude", "unit_include", "unit_exclude")
    bounds = ("hour_min", "hour_max", "point_min", "point_max")
    return reduce(Column.__or__, [*(_given(c[a]) for a in arrays), *(c[b].isNotNull() for b in bounds)])


def passes(sessions: Column, lang: Column, kind: Column, point: Column, unit: Column, c: Column) -> Column:
    """Whether a document meets constraints ``c`` (a struct as ``schema.CONSTRAINTS``)."""
    return (
        (~_given(c["weekday_include"]) | weekday_included(sessions, c["weekday_include"]))
        & (~_given(c["weekday_exclude"]) | weekday_excluded(sessions, c["weekday_exclude"]))
        & hours_overlap(sessions, c["hour_min"], c["hour_max"])
        & (~_given(c["hour_exclude_ranges"]) | outside_ranges(sessions, c["hour_exclude_ranges"]))
        & value_in(F.coalesce(lang, F.lit("")), c["lang_include"], c["lang_exclude"])
        & value_in(F.coalesce(kind, F.lit(0)), c["kind_include"], c["kind_exclude"])
        & in_range(point, c["point_min"], c["point_max"])
        & (~_given(c["unit_include"]) | contains_any(unit, c["unit_include"]))
        & ~contains_any(unit, c["unit_exclude"])
    )


# ---- the compiled conditions -----------------------------------------------------------------------------------


def lang_clause(lang: Column, values: Column) -> Column:
    return F.array_contains(values, lang)


def weekday_clause(weekdays: Column, values: Column) -> Column:
    return F.arrays_overlap(weekdays, values)


def hour_clause(sessions: Column, bounds: Column) -> Column:
    """Some session overlaps [low, high); without sessions false."""
    return F.exists(sessions, lambda s: (s["start_hour"] < F.get(bounds, F.lit(1))) & (s["end_hour"] > F.get(bounds, F.lit(0))))


def kind_numbers(names: Column) -> Column:
    """Kinds by name as numbers; unknown names are skipped."""
    table = F.create_map(*(x for name, number in KINDS.items() for x in (F.lit(name), F.lit(number))))
    return F.filter(F.transform(names, lambda n: F.try_element_at(table, n)), lambda n: n.isNotNull())


def unit_clause(unit: Column, words: Column) -> Column:
    """LIKE any of '%word%'; percent signs and underscores of a word keep their meaning."""
    return F.exists(words, lambda w: F.like(unit, F.concat(F.lit("%"), w, F.lit("%"))))


def _side(doc: dict[str, Column], c: Column, negated: bool) -> list[Column]:
    clauses = [
        (_given(c["course_lang"]), lang_clause(doc["lang"], c["course_lang"])),
        (_given(c["weekday"]), weekday_clause(doc["weekdays"], c["weekday"])),
        (F.coalesce(F.size(c["hour_range"]) == 2, F.lit(False)), hour_clause(doc["sessions"], c["hour_range"])),
        (c["point"].isNotNull(), doc["point"] == c["point"]),
        (_given(kind_numbers(c["kind"])), F.array_contains(kind_numbers(c["kind"]), doc["kind"])),
        (_given(c["lmt_kind"]), F.array_contains(c["lmt_kind"], doc["lmt_kind"])),
        (_given(c["unit"]), unit_clause(doc["unit"], c["unit"])),
    ]
    return [~given | (~clause if negated else clause) for given, clause in clauses]


def matches(doc: dict[str, Column], must: Column, must_not: Column) -> Column:
    """The conjunction of all clauses of ``must`` and of the negated clauses of ``must_not``; true without any."""
    return reduce(Column.__and__, [*_side(doc, must, False), *_side(doc, must_not, True)])


def _literal_side(doc: dict[str, Column], given: Mapping[str, Any], negated: bool) -> list[Column]:
    values = lambda name: list(given.get(name) or ())
    array = lambda name: F.array(*map(F.lit, values(name)))
    kinds = [KINDS[name] for name in values("kind") if name in KINDS]
    clauses = [doc[attribute].isin(wanted) for attribute, wanted in (("lang", values("course_lang")), ("kind", kinds), ("lmt_kind", values("lmt_kind"))) if wanted]
    if values("weekday"):
        clauses.append(weekday_clause(doc["weekdays"], array("weekday")))
    if len(values("hour_range")) == 2:
        clauses.append(hour_clause(doc["sessions"], array("hour_range")))
    if given.get("point") is not None:
        clauses.append(doc["point"] == given["point"])
    if values("unit"):
        clauses.append(reduce(Column.__or__, [F.like(doc["unit"], F.lit(f"%{word}%")) for word in values("unit")]))
    return [~clause if negated else clause for clause in clauses]


def literal_matches(doc: dict[str, Column], must: Mapping[str, Any], must_not: Mapping[str, Any] | None = None) -> Column:
    """``matches`` for one pair of conditions that is known when the plan is made: mappings with the fields of ``schema.CONDITIONS``.

    Lists, equalities and words become predicates that a source understands, so a scan of Parquet or a database gets them.
    ``doc`` needs the attributes that the conditions name.
    """
    clauses = [*_literal_side(doc, must, False), *_literal_side(doc, must_not or {}, True)]
    return reduce(Column.__and__, clauses) if clauses else F.lit(True)


def has_conditions(*sides: Column) -> Column:
    arrays = ("course_lang", "weekday", "hour_range", "kind", "lmt_kind", "unit")
    return reduce(Column.__or__, [x for c in sides for x in (*(_given(c[a]) for a in arrays), c["point"].isNotNull())])
