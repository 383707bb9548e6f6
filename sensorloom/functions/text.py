"""Text predicates with the contract's exact meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the contract's form of an identifier.
IDENTIFIER = r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z"

# One group of the lenient UUID form: any hex digits whose value fits a signed long.
_HEX = r"0*(?:[0-7][0-9A-Fa-f]{15}|[0-9A-Fa-f]{1,15})"
LENIENT_UUID = rf"\A(?=.{{0,36}}\z){_HEX}(?:-{_HEX}){{4}}\z"


def is_blank(c: Column) -> Column:
    """Only white space. A visible first ASCII character settles nearly every row."""
    return ~F.ascii(c).between(33, 126) & c.rlike(r"\A\p{javaWhitespace}*\z")


def longer_than(c: Column, limit: int) -> Column:
    """Length counted in UTF-16 units; the cheap byte length decides nearly every row."""
    return (F.octet_length(c) > limit) & (F.octet_length(F.encode(c, "UTF-16BE")) > 2 * limit)


def bad_text(c: Column, limit: int) -> Column:
    """Null, blank or too long."""
    return c.isNull() | is_blank(c) | longer_than(c, limit)


def bad_identifier(c: Column) -> Column:
    return bad_text(c, 64) | ~c.rlike(IDENTIFIER)


def bad_uuid(c: Column) -> Column:
    return c.isNull() | ~c.rlike(LENIENT_UUID)


def literal_prefix(pattern: str) -> str:
    """The text that everything a regular expression matches as a whole begins with; may be shorter than the longest."""
    if "|" in pattern or pattern.startswith("(?"):
        return ""
    out, at = [], 0
    while at < len(pattern):
        char = pattern[at]
        if char == "\\":
            if at + 1 == len(pattern) or pattern[at + 1].isalnum():  # a class, an anchor or a reference
                break
            char, at = pattern[at + 1], at + 1
        elif char in "^$.[]()*+?{}":
            break
        out.append(char)
        at += 1
    # a quantifier may leave out the character before it
    return "".join(out[:-1] if at < len(pattern) and pattern[at] in "*?{" else out)
