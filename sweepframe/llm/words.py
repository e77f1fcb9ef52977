"""The word of this package: a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return."""

import itertools
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[ \t-\r]")


def word_count(text: Column) -> Column:
    """Words of the whole text; null: 0. (The possessive quantifier finds the same runs and never backs up.)"""
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


def word_lists(body: bytes, chunk: int = 4 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in order, in lists of about chunk bytes; no word is cut. (bytes.split() knows just these six characters.)"""
    at = 0
    while at < len(body):
        end = min(at + chunk, len(body))
        if end < len(body):
            found = _SPACE.search(body, end)
            end = found.start() if found else len(body)
        yield body[at:end].split()
        at = end


def free_names(docs: DataFrame, *names: str, but: str = "") -> list[str]:
    """The names, each with a number behind it that makes it new to the table, and other than `but`."""
    taken = {c.lower() for c in [*docs.columns, but]}
    return [next(n for i in itertools.count() if (n := f"__{name}{i}").lower() not in taken) for name in names]
