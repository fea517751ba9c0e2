"""Regular expressions with the white space, word borders and line rules of ECMAScript, in Java's syntax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space characters (fixed values): inside a class, as a class, and without the line feed.
WS_IN = r"\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{WS_IN}]"
WS_NO_FEED = WS.replace(r"\x09-\x0D", r"\x09\x0B-\x0D")
#: The same characters as a string.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Any character but line ends; end of text.
ANY, END = r"[^\n\r\x{2028}\x{2029}]", r"\z"
NOT_AFTER_WORD, NOT_BEFORE_WORD = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def quote(text: str) -> str:
    """A pattern that matches the text itself, inside and outside classes."""
    return "".join("\\" + c if c.isascii() and not c.isalnum() and not c.isspace() else c for c in text)


def literal(text: str) -> str:
    """A replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def sub(text: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(text, pattern, to)


def trim(text: Column) -> Column:
    return sub(text, rf"\A{WS}+|{WS}+{END}")


def group(text: Column, pattern: str, n: int = 1) -> Column:
    return F.regexp_extract(text, pattern, n)


def some(text: Column | None) -> Column:
    """Null for the empty string."""
    return F.nullif(text, F.lit(""))


def in_list(text: Column, values: tuple[str, ...]) -> Column:
    return text.isin(*values) if values else F.lit(False)
