"""Text rules that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six ASCII white-space characters: tab, line feed, vertical tab, form feed, carriage return, space.
WHITE = "\t\n\x0b\x0c\r "


def whole(text: str = "text") -> Column:
    """The text, a null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; letters outside ASCII stay as they are."""
    return F.translate(text, UPPER, LOWER)


def id_bucket(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n
