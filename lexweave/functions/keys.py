"""Column expressions for identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the size rules.
BLANKS = " \t\n\r"


def norm_key(c: Column | str) -> Column:
    """An identifier in comparable form: no surrounding white space, upper case; null and blank give null."""
    c = F.col(c) if isinstance(c, str) else c
    k = F.upper(F.btrim(c, F.lit(BLANKS + " ")))
    return F.when(k != "", k)


def digest(c: Column | str) -> Column:
    """128 bits of SHA-256 of a text as BINARY; null stays null. Stands for the text wherever only equality counts."""
    return F.unhex(F.substring(F.sha2(F.col(c) if isinstance(c, str) else c, 256), 1, 32))
