"""Column expressions over texts: article references, whitespace, histories, breadcrumbs, lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the shape of an article number (upper case on purpose).
KEY_BODY = r"[LRAD]\*?\s?\.?\s?\d+(?:-\d+)*"
#: The same without giving back a segment once it's read, and without a letter or digit after it.
KEY_STRICT = r"[LRAD]\*?\s?\.?\s?\d+(?:-\d+)*+(?![\w-])"
#: Fixed values of a conversation's trimming and of a condensed question.
MAX_TURNS, MAX_TURN_CHARS, MAX_CONDENSED_CHARS = 6, 2000, 300


def collapse(c: Column) -> Column:
    """Runs of white space (Unicode) as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def lookup_key(c: Column) -> Column:
    """The comparable key of an article number, null where the whole value isn't one (annexes, other prose).

    Blanks, dots and the asterisk go, dashes stay. White space other than the plain blank is matched but not removed.
    """
    x = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(x.rlike(f"(?U)^{KEY_BODY}$"), F.translate(F.upper(x), " .*", ""))


def _as_key(x: Column) -> Column:
    return F.translate(F.upper(x), " .*", "")


def first_reference(c: Column, strict: bool = False) -> Column:
    """The key of the first article reference in a text, or null. strict: a reference is never cut short by what follows
    it (`L113-15-2bis` and `L113-2é` hold none), where the plain scan gives `L113-15` and `L113`."""
    found = F.regexp_extract(c, rf"(?U)\b{KEY_STRICT}" if strict else rf"(?U)\b{KEY_BODY}\b", 0)
    return F.when(found != "", _as_key(found))


def all_references(c: Column, strict: bool = False) -> Column:
    """The distinct keys of all article references in a text, in order of appearance; null text gives an empty array."""
    pattern = rf"(?U)\b{KEY_STRICT}" if strict else rf"(?U)\b{KEY_BODY}\b"
    return F.coalesce(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), _as_key)), F.array().cast("array<string>"))


def trim_history(history: Column, turns: int = MAX_TURNS, chars: int = MAX_TURN_CHARS) -> Column:
    """The last turns of an ARRAY<STRUCT<role, content>>, in order, each content cut; null gives an empty array."""
    last = F.slice(history, F.greatest(F.size(history) - F.lit(turns - 1), F.lit(1)), turns)
    return F.transform(last, lambda t: F.struct(t["role"].alias("role"), F.substring(t["content"], 1, chars).alias("content")))


def sanitize_condensed(raw: Column, candidate: Column, limit: int = MAX_CONDENSED_CHARS) -> Column:
    """A rewritten question without outer white space, or null: if it's empty, has a line break, is too long or names an
    article that the raw turn doesn't."""
    x = F.regexp_replace(candidate, r"(?U)^\s+|\s+$", "")
    added = F.array_except(all_references(x), all_references(raw))
    return F.when((F.length(x) > 0) & ~F.contains(x, F.lit("\n")) & (F.length(x) <= limit) & (F.size(added) == 0), x)


def strip_breadcrumb_root(c: Column) -> Column:
    """A breadcrumb `a > b > c` without its first level."""
    parts = F.transform(F.split(c, ">"), lambda p: F.btrim(p))
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " > ")


def terms(c: Column, least: int = 3) -> Column:
    """Lower-case terms of letters and digits, with repeats, of `least` characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-zà-ÿ0-9]+"), F.lit(0)), lambda t: F.length(t) >= least)


def verbatim(spans: Column, texts: Column) -> Column:
    """The distinct non-empty spans that occur in one of the texts, in order."""
    return F.array_distinct(F.filter(spans, lambda s: (F.length(s) > 0) & F.exists(texts, lambda t: F.contains(t, s))))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """`{{name}}` replaced by columns, one name after the other."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return out


def clean_lines(c: Column) -> Column:
    """The non-empty lines of a text without bullets and blanks at their ends."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.btrim(x, F.lit(" -•\t"))), lambda x: x != "")


def numbered(items: Column) -> Column:
    """A numbered list, one item a paragraph."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n\n")


def epoch_ms_date(c: Column) -> Column:
    return F.to_date(F.timestamp_millis(c))


def http_date(c: Column) -> Column:
    """The day of an HTTP date header."""
    return F.to_date(F.regexp_extract(c, r"\d{2} \w{3} \d{4}", 0), "dd MMM yyyy")


def enriched(parts: Sequence[Column], separator: str = "\n") -> Column:
    """The non-empty parts, joined: the text that is embedded where context is put before it."""
    return F.concat_ws(separator, *(F.when(p != "", p) for p in parts))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))
