"""String, JSON and type expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_part(text: Column, delimiter: str, n: int) -> Column:
    """The ``n``-th piece, counted from 1; NULL when there is none."""
    return F.try_element_at(F.split(text, f"\\Q{delimiter}\\E"), F.lit(n))


def to_type(value: Column, type_name: str) -> Column:
    """Cast that yields NULL for text which does not fit the type."""
    return value.try_cast(type_name)


def concat(*parts: Column | str) -> Column:
    """Join columns (as text) and literal strings; a NULL column makes the result NULL."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def locate(part: str, text: Column, start: int = 1, occurrence: int = 1) -> Column:
    """1-based place of the ``occurrence``-th match at or after ``start``; 0 if none."""
    place = F.locate(part, text, start)
    for _ in range(occurrence - 1):
        place = F.when(place > 0, F.call_function("locate", F.lit(part), text, place + 1))
        place = F.coalesce(place, F.lit(0))
    return F.when(text.isNotNull(), place)


def regex_clean(text: Column, pattern: str, replacement: str) -> Column:
    """Replace every match."""
    return F.regexp_replace(text, pattern, replacement)


def regex_pick(text: Column, pattern: str, group: int = 1) -> Column:
    """One group of the first match; empty when nothing matches."""
    return F.regexp_extract(text, pattern, group)


def mask(text: Column) -> Column:
    """Upper-case letters to X, lower-case to x, digits to n, all others to -."""
    return F.mask(text, F.lit("X"), F.lit("x"), F.lit("n"), F.lit("-"))


def surrogate_key(*columns: Column) -> Column:
    """MD5 of the comma-joined values; NULLs are left out."""
    return F.md5(F.concat_ws(",", *[c.cast("string") for c in columns]))


def b64_encode(text: Column) -> Column:
    return F.base64(text.cast("binary"))


def b64_decode(text: Column) -> Column:
    return F.unbase64(text).cast("string")


def json_field(text: Column, path: str, type_name: str = "string") -> Column:
    """Field of a JSON text; NULL for a missing path or a value of another type."""
    return F.get_json_object(text, path).try_cast(type_name)


def json_fields(text: Column, schema: str) -> Column:
    """Several fields in one parse; read them with ``.getField``."""
    return F.from_json(text, schema)
