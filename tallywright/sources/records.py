"""Records from text that should be JSON: repair, salvage and positional rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.numbers import parse_number
from tallywright.functions.text import blank_to_null
from tallywright.functions.vocabulary import ROW_FIELDS

TEXT_FIELDS = ("broker", "accountType", "name", "assetClass", "currency")
_STRINGS = "map<string,string>"


def fragment(raw: Column) -> Column:
    """What lies between the first '[' and the last ']', inside a fenced block if there is one."""
    fenced = F.coalesce(blank_to_null(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)), raw)
    return blank_to_null(F.regexp_extract(fenced, r"(?s)\[.*\]", 0))


def repaired(json: Column) -> Column:
    """Without plus signs before numbers, thousands commas after colons and trailing commas."""
    out = F.regexp_replace(json, r"([:\[,]\s*)\+(\d)", "$1$2")
    for _ in range(5):  # one comma a pass: up to 18 digits
        out = F.regexp_replace(out, r"(:\s*-?\d+),(\d{3})(?!\d)", "$1$2")
    return F.regexp_replace(out, r",\s*([\]}])", "$1")


def _whole(json: Column) -> Column:
    return F.from_json(json, f"array<{_STRINGS}>")


#: Levels of braces that salvage takes as one object.
DEPTH = 6


def balanced(depth: int = DEPTH) -> str:
    """Pattern of an object whose braces pair up, up to ``depth`` levels; braces inside strings do not count.

    Repeats are possessive, so a text that never pairs up is given up at once.
    """
    text = r'"(?:[^"\\]|\\.)*+"'
    inner = ""
    for _ in range(depth):
        inner = r"\{(?:[^{}\"]|" + text + (f"|{inner}" if inner else "") + r")*+\}"
    return inner


def _named(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of ``value``, which is worked out once a row and not wherever it is used."""
    return F.transform(F.array(value), made)[0]


def _objects(found: Column, clean: Column) -> Column:
    pieces = F.regexp_extract_all(clean, F.lit(balanced()), F.lit(0))
    salvaged = F.filter(F.transform(pieces, lambda p: F.from_json(p, _STRINGS)), lambda m: m.isNotNull() & (F.size(m) > 0))
    good = lambda rows: _named(rows, lambda r: F.when(F.size(r) > 0, F.when(F.forall(r, lambda m: m.isNotNull()), r)))
    return F.coalesce(good(_whole(found)), good(_whole(clean)), salvaged, F.array().cast(f"array<{_STRINGS}>"))


def _positional(clean: Column, fields: tuple[str, ...]) -> Column:
    pieces = F.regexp_extract_all(clean, F.lit(r"\[[^\[\]]*\]"), F.lit(0))
    rows = F.filter(F.transform(pieces, lambda p: F.from_json(p, "array<string>")), lambda r: F.size(r) == len(fields))
    made = F.transform(rows, lambda r: F.map_from_arrays(F.array(*map(F.lit, fields)), r))
    return F.coalesce(made, F.array().cast(f"array<{_STRINGS}>"))


def objects(raw: Column) -> Column:
    """Array of the objects in ``raw`` as maps of strings, nested values as their JSON; one bad object does not lose the others."""
    return _named(fragment(raw), lambda f: _named(repaired(f), lambda c: _objects(f, c)))


def positional(raw: Column, fields: tuple[str, ...] = ROW_FIELDS) -> Column:
    """Array of maps for innermost arrays of the right length; others go."""
    return _named(repaired(fragment(raw)), lambda c: _positional(c, fields))


def rows(raw: Column) -> Column:
    """All records of ``raw``: objects first, then positional rows, numbers parsed."""
    both = _named(fragment(raw), lambda f: _named(repaired(f), lambda c: F.concat(_objects(f, c), _positional(c, ROW_FIELDS))))

    def typed(m: Column) -> Column:
        value = lambda f: F.try_element_at(m, F.lit(f))
        return F.struct(*[(value(f) if f in TEXT_FIELDS else parse_number(value(f))).alias(f) for f in ROW_FIELDS])

    return F.transform(both, typed)
