"""What a search of a source may ask for, checked before any data is read."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


class SearchError(ValueError):
    """A search that a source does not allow."""


@dataclass(frozen=True)
class Text:
    most: int = 256


@dataclass(frozen=True)
class Choice:
    of: tuple[str, ...]
    default: str


@dataclass(frozen=True)
class Number:
    default: int
    most: int


@dataclass(frozen=True)
class Tags:
    most: int = 5
    longest: int = 35


@dataclass(frozen=True)
class Window:
    """Two dates, first and last, at most `days` apart."""

    first: str
    last: str
    days: int = 30


# The fields that each source's search knows.
SEARCHES = {
    "repositories": {"q": Text(), "sort": Choice(("stars", "forks", "help-wanted-issues", "updated"), "updated"), "order": Choice(("asc", "desc"), "desc"), "per_page": Number(100, 100)},
    "work_items": {"q": Text(), "sort": Choice(("comments", "created", "updated"), "updated"), "order": Choice(("asc", "desc"), "desc"), "per_page": Number(100, 100)},
    "packages": {"text": Text(), "size": Number(100, 250)},
    "questions": {"site": Text(80), "tags": Tags(), "dates": Window("from_date", "to_date"), "sort": Choice(("activity", "creation", "votes"), "creation"), "order": Choice(("asc", "desc"), "asc"), "page_size": Number(100, 100)},
}


def _checked(name: str, field, query: dict) -> dict:
    if isinstance(field, Window):
        try:
            first, last = (date.fromisoformat(query[k]) for k in (field.first, field.last))
        except (KeyError, TypeError, ValueError) as e:
            raise SearchError(f"{field.first} and {field.last} have to be dates") from e
        if not 0 <= (last - first).days <= field.days:
            raise SearchError(f"{field.first} to {field.last} has to span 1 to {field.days + 1} days")
        return {field.first: first.isoformat(), field.last: last.isoformat()}
    value = query.get(name, getattr(field, "default", None))
    match field:
        case Text(most):
            good = isinstance(value, str) and 0 < len(value.strip()) <= most
            value = value.strip() if good else value
        case Choice(of, _):
            good = value in of
        case Number(_, most):
            good = isinstance(value, int) and not isinstance(value, bool) and 1 <= value <= most
        case Tags(most, longest):
            good = isinstance(value, list) and 1 <= len(value) <= most and all(isinstance(t, str) and 0 < len(t.strip()) <= longest and ";" not in t for t in value)
            value = sorted({t.strip().casefold() for t in value}) if good else value
    if not good:
        raise SearchError(f"{name} is not allowed to be {value!r}")
    return {name: value}


def checked_search(source: str, query: dict) -> dict:
    """The query with its defaults, in one spelling; an error for unknown sources and fields and for values out of bounds."""
    if source not in SEARCHES:
        raise SearchError(f"no source {source!r}")
    fields = SEARCHES[source]
    known = {k for name, f in fields.items() for k in ((f.first, f.last) if isinstance(f, Window) else (name,))}
    if unknown := sorted(set(query) - known):
        raise SearchError(f"unknown fields: {', '.join(unknown)}")
    out: dict = {}
    for name, field in fields.items():
        out |= _checked(name, field, query)
    return out
