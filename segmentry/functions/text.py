"""Character classes pinned once, and text expressions built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a host language's strip() and split() have it: Unicode white space and the four separators 1C-1F.
SPACE = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
LETTER = "\\p{L}"
WORD = "[\\p{L}\\p{N}_]"


#: The signs of ``SPACE`` one by one.
BLANKS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Looks at the edges only, whatever the length."""
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), f"{SPACE}+", " ")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def has_words(c: Column, n: int) -> Column:
    """Whether there are n words at least; reads no further than to the n-th."""
    other = "[^" + SPACE[1:]
    return c.rlike(f"^{SPACE}*+(?:{other}++{SPACE}++){{{n - 1}}}{other}") if n > 0 else c.isNotNull()


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def whole(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def quoted(term: Column) -> Column:
    """A term as a literal pattern."""
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def whole_word(term: Column) -> Column:
    """A pattern for a term between non-word characters, without case."""
    return F.concat(F.lit(f"(?iu)(?<!{WORD})"), quoted(term), F.lit(f"(?!{WORD})"))


def safe_cell(c: Column) -> Column:
    """A cell that no spreadsheet reads as a formula."""
    return F.when(c.rlike("^[\\s]*[=+\\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def html_escape(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def language_tag(c: Column) -> Column:
    """xx-YY form of a language tag."""
    parts = F.split(F.replace(F.trim(c), F.lit("_"), F.lit("-")), "-")
    rest = F.transform(F.slice(parts, 2, 8), lambda p: F.when(F.length(p) == 2, F.upper(p)).when(F.length(p) == 4, F.initcap(p)).otherwise(F.lower(p)))
    return F.array_join(F.concat(F.array(F.lower(parts[0])), rest), "-")
