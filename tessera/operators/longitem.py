"""Byte ranges of binary items, character ranges of strings; offsets count from 0 and are clipped to the item's end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty() -> Column:
    """A new item without a byte."""
    return F.lit(b"")


def read(item: Column, offset: int, length: int) -> Column:
    return F.substring(item, offset + 1, length)


def rest(item: Column, offset: int) -> Column:
    return item.substr(F.lit(offset + 1), F.length(item))


def insert_before(item: Column, offset: int, part: Column) -> Column:
    return F.concat(read(item, 0, offset), part, rest(item, offset))


def insert_after(item: Column, offset: int, part: Column) -> Column:
    return insert_before(item, offset + 1, part)


def overwrite(item: Column, offset: int, part: Column) -> Column:
    """part in place of what stands there; the item's length stays."""
    return F.concat(read(item, 0, offset), F.substring(part, 1, 2147483647).substr(F.lit(1), F.greatest(F.length(item) - offset, F.lit(0))), rest_from(item, F.lit(offset) + F.length(part)))


def rest_from(item: Column, offset: Column) -> Column:
    return item.substr(offset + 1, F.length(item))


def delete(item: Column, offset: int, length: int) -> Column:
    return F.concat(read(item, 0, offset), rest(item, offset + length))


def length_to_nul(item: Column) -> Column:
    """Characters before the first NUL, all if there is none. For bytes use bytes_to_nul()."""
    at = F.instr(item, "\0")
    return F.when(at > 0, at - 1).otherwise(F.length(item))


def bytes_to_nul(item: Column) -> Column:
    """Bytes of a binary item before its first zero byte, all if there is none: found in its hex digits, two a byte."""
    return F.length(F.regexp_extract(F.hex(item), "^(?:(?!00)..)*+", 0)) / 2


def alternate_sentences(text: Column) -> Column:
    """Every second sentence, from the first on; sentences end at full stops."""
    return F.array_join(F.filter(F.split(text, r"\."), lambda s, i: i % 2 == 0), ".")
