"""Text as columns: white space, markup, addresses, sentences, cells. Every function takes and gives a Column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import vocabulary as V


def js(pattern: str) -> str:
    """A pattern whose word boundaries are those of JavaScript: between ASCII word characters and all else."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x) -> Column:
    return F.coalesce(col(x), F.lit(""))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normal_space(x) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text(x), r"(?U)\s+", " "))


#: Named entities, in order of replacement.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")]


def decode_entities(x) -> Column:
    """Numeric entities (invalid ones vanish), then the named ones."""
    pieces = F.split(text(x), r"(?=&#[xX]?[0-9a-fA-F]{1,8};)")

    def char(code: Column) -> Column:
        # A code point as UTF-32, read as text; surrogates and what lies beyond are invalid.
        fine = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(code.between(1, 127), F.chr(code)).when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit(""))

    def decoded(p: Column, number: Column) -> Column:
        code = F.when(F.lower(number).startswith("x"), F.conv(F.substring(number, 2, 8), 16, 10)).otherwise(F.when(number.rlike("^[0-9]+$"), number)).cast("long")
        return F.concat(let(code, char), F.substring(p, F.char_length(number) + 4, F.char_length(p)))

    def one(p: Column) -> Column:  # the pattern runs once for each piece, whatever uses what it finds
        return let(F.regexp_extract(p, r"^&#([xX]?[0-9a-fA-F]{1,8});", 1), lambda number: F.when(number == "", p).otherwise(decoded(p, number)))

    out = F.array_join(F.transform(pieces, one), "")
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return out


BLOCK_TAG = r"(?i)</?(?:p|div|li|ul|ol|br|h[1-6]|tr|td|th|table|section|article|header|footer)\b[^>]*>"


def strip_html(x) -> Column:
    """Block tags part words, other tags vanish, then entities are decoded and white space is normal."""
    return normal_space(decode_entities(F.regexp_replace(F.regexp_replace(text(x), BLOCK_TAG, " "), r"<[^>]*>", "")))


def html_blocks(x) -> Column:
    """Lines of text: list items after a bullet, headings after ##, every other block on its own line; empty lines go."""
    out = decode_entities(x)
    for pattern, value in ((r"(?i)<li\b[^>]*>", "\n• "), (r"(?i)<h[1-6]\b[^>]*>", "\n## "), (BLOCK_TAG, "\n"), (r"<[^>]*>", "")):
        out = F.regexp_replace(out, pattern, value)
    lines = F.transform(F.split(decode_entities(out), "\n"), normal_space)
    return F.array_join(F.filter(lines, lambda line: ~line.isin("", "•", "##")), "\n")


def page_text(x) -> Column:
    """A page's visible text: scripts, styles and drawings out, blocks as lines, other tags as blanks."""
    out = F.regexp_replace(text(x), r"(?is)<(script|style|noscript|svg)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(F.regexp_replace(out, BLOCK_TAG, "\n"), r"<[^>]*>", " ")
    lines = F.transform(F.split(decode_entities(out), "\n"), normal_space)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def readable(x) -> Column:
    """A page's markup as plain text for reading: items after a dash, at most one empty line, an unclosed tag at the end goes."""
    out = F.regexp_replace(text(x), r"(?is)<\s*(script|style)[^>]*>.*?<\s*/\s*\1\s*>", "")
    for pattern, value in ((r"(?i)<\s*br\s*/?>", "\n"), (r"(?i)<\s*/\s*(?:p|div|li|h[1-6]|ul|ol|tr|section)\s*>", "\n"), (r"(?i)<\s*li[^>]*>", "\n- "), (r"<[^>]*>", ""), (r"<[^>]*$", "")):
        out = F.regexp_replace(out, pattern, value)
    out = decode_entities(out)
    for pattern, value in ((r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"(?U)^\s+|\s+$", "")):
        out = F.regexp_replace(out, pattern, value)
    return out


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def nfkc(x) -> Column:
    """Compatibility composition. Spark has none, so rows with other than ASCII characters go through Arrow; the rest never leave the JVM."""
    other = text(x).rlike(r"[^\x00-\x7f]")
    return F.coalesce(_nfkc(F.when(other, text(x))), text(x))


def emails(x) -> Column:
    """Addresses in lower case, sorted, each once; punctuation at the end goes."""
    found = F.regexp_extract_all(text(x), F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: F.lower(F.regexp_replace(m, r"[.,;:]+$", "")))))


def mailto(x) -> Column:
    """The address of a mailto link, in lower case; null for other links."""
    plain = F.replace(F.replace(F.lower(F.split_part(text(x), F.lit("?"), F.lit(1))), F.lit("%40"), F.lit("@")), F.lit("%2e"), F.lit("."))
    return F.when(plain.startswith("mailto:"), F.trim(F.substring(plain, 8, 10_000)))


def sentences(x, ends: str = ".!?") -> Column:
    parts = F.split(text(x), rf"(?<=[{ends}])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def clip(x, most: int = 280) -> Column:
    return F.when(F.char_length(col(x)) > most, F.concat(F.substring(col(x), 1, most - 3), F.lit("..."))).otherwise(col(x))


def component(x) -> Column:
    """For keys: letters and digits in lower case, all else one blank."""
    return F.lower(F.trim(F.regexp_replace(text(x), r"[^\p{L}\p{N}]+", " ")))


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text(x)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def plain_addresses(x) -> Column:
    """Addresses written as `name [at] host [dot] tld` become real ones; a bare ` at ` or ` dot ` only between address parts."""
    out = F.regexp_replace(text(x), r"(?i)\s*[\[(]\s*at\s*[\])]\s*", "@")
    out = F.regexp_replace(out, r"(?i)\s*[\[(]\s*dot\s*[\])]\s*", ".")
    out = F.regexp_replace(out, r"(?i)([a-z0-9._%+-]+)\s+at\s+([a-z0-9-]+)\s+dot\s+([a-z]{2,})\b", "$1@$2.$3")
    return F.regexp_replace(out, r"(?i)([a-z0-9._%+-]+@[a-z0-9-]+)\s+dot\s+([a-z]{2,})\b", "$1.$2")


def csv_cell(x) -> Column:
    """A quoted cell; text that a spreadsheet would take for a formula gets an apostrophe."""
    safe = F.when(text(x).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text(x))).otherwise(text(x))
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def initials(x) -> Column:
    words = F.slice(F.filter(F.split(normal_space(x), " "), lambda w: w != ""), 1, 2)
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def tint(x, colours: int = 8) -> Column:
    """A stable colour number of a name: 31-fold rolling hash of its characters."""
    codes = F.transform(F.split(text(x), ""), lambda c: F.ascii(c).cast("long"))
    return F.pmod(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 2147483648), F.lit(colours)).cast("int")


def any_of(x, words: list[str]) -> Column:
    """Whether any of the words occurs, ignoring case."""
    low = F.lower(text(x))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def first_case(x, cases: list[tuple[str, str]], otherwise) -> Column:
    """The label of the first pattern that matches."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for label, pattern in reversed(cases):
        out = F.when(text(x).rlike(js(pattern)), F.lit(label)).otherwise(out)
    return out


def apply_addresses(x) -> Column:
    return F.regexp_extract_all(text(x), F.lit(V.EMAIL), F.lit(0))
