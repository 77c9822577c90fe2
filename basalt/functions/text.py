"""Text functions as Columns. Null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All that ends a line for the user; code positions count \n alone.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
BLANKS = r"(?U)[\s\x1C-\x1F]+"


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def lines(text: Column) -> Column:
    """The lines of a text, without one for what follows a last line end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def squeezed(line: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(line, BLANKS, " "))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character; 0 for the empty text."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def masked(value: Column) -> Column:
    """All stars up to 8 characters; else the first and last four stay."""
    n = F.length(value)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(value, F.lit(4))))


def html_escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def markdown_escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def client_ip(forwarded: Column, peer: Column, hops: Column) -> Column:
    """The address that `hops` trusted proxies saw: of the comma-separated list the entry that many from its end, else the peer."""
    entries = F.filter(F.transform(F.split(forwarded, ","), lambda x: F.trim(x)), lambda x: x != "")
    entry = F.get(entries, F.greatest(F.size(entries) - hops, F.lit(0)))
    return F.coalesce(F.when(hops > 0, entry), peer, F.lit("unknown"))


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(done / total * 100 + 0.5))).otherwise(0).cast("int")
