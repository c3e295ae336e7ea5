"""Unicode normalisation of obfuscated text.

Every code point maps on its own, so the whole chain is one translation table
that fills itself as characters appear.  Most of it follows from Unicode data:
compatibility decomposition, mark removal and the layout of the enclosed and
regional letters.  Only lookalikes of other scripts are listed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from murmura.functions.lookalikes import AFTER, letters, more

# ASCII signs and digits that stand for letters.
SIGNS = {"'": None, "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "*": "a", ":": "i"}
ZERO_WIDTH = {0x200B, 0x200C, 0x200D, 0xFEFF}


class Table(dict):
    """Code point -> replacement, filled on demand for ``str.translate``."""

    def __init__(self):
        super().__init__()
        self.before = more() | letters()
        self.after = more() | AFTER
        self.signs = dict(SIGNS)

    def __missing__(self, code: int):
        self[code] = out = self._map(code)
        return out

    def _map(self, code: int) -> str | None:
        if code in ZERO_WIDTH:
            return None
        for first in (0x1F1E6, 0x1F130, 0x1F150, 0x1F170, 0x1F110):  # regional, squared, negative and parenthesised letters
            if first <= code < first + 26:
                return chr(97 + code - first)
        plain = unicodedata.normalize("NFKD", self.before.get(chr(code), chr(code)))
        if code > 0xFFFF and not any(c.isascii() and c.isalnum() for c in plain):
            return None  # what lies beyond the basic plane and isn't a letter form goes
        out = []
        for c in plain:
            if unicodedata.category(c).startswith("M"):
                continue
            for d in self.after.get(c, c).lower():
                d = self.after.get(d, d)
                d = self.signs.get(d, d)
                if d is not None and not unicodedata.category(d).startswith("M"):
                    out.append(d)
        return "".join(out) or None


def normalizer():
    """A function of one text for use within a task."""
    table = Table()
    plain = {code: table[code] for code in range(128)}

    def normalize(text: str | None) -> str | None:
        if text is None:
            return None
        return text.translate(plain if text.isascii() else table)

    return normalize


@pandas_udf(T.StringType())
def _normalize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    run = normalizer()  # one table for all batches of a task
    for texts in batches:
        yield texts.map(run)


def normalize(text: Column) -> Column:
    """Canonical form of any text; null stays null.  One Arrow pass."""
    return _normalize(text)


def normalize_ascii(text: Column) -> Column:
    """``normalize`` for texts of ASCII and precomposed Latin letters, without leaving the JVM."""
    kept = [(k, v) for k, v in SIGNS.items() if v is not None]
    accented = [chr(c) for c in range(0xC0, 0x180) if chr(c).lower() == chr(c) and len(Table()[c] or "") == 1 and Table()[c].isascii()]
    source = "".join(k for k, _ in kept) + "".join(accented)
    target = "".join(v for _, v in kept) + "".join(Table()[ord(c)] for c in accented)
    dropped = "".join(k for k, v in SIGNS.items() if v is None)
    return F.translate(F.lower(text), source + dropped, target)


def register(spark) -> None:
    """Makes ``normalize_text`` usable from SQL."""
    spark.udf.register("normalize_text", _normalize)
