"""Text functions as column expressions; whitespace and letters are those of Unicode."""

from __future__ import annotations

import json
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named character references of HTML, with and without their semicolon, and numeric ones that browsers read as Windows-1252; both from the standard library.
NAMED = {name: char for name, char in html5.items()}
RENUMBERED = {n: unescape(f"&#{n};") for n in (0, *range(0x80, 0xA0))}
#: Names that may stand without a semicolon.
_BARE = "|".join(sorted((n for n in NAMED if not n.endswith(";")), key=lambda n: (-len(n), n)))
_CLOSED = "#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;"
REFERENCE = rf"&(?:{_CLOSED}|(?:{_BARE}))"
_ATTRIBUTES = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
#: Markup from left to right: a comment, a script or style with all that it holds, a tag (its quoted attributes may hold any character), a declaration or an
#: instruction. What begins first holds what lies within it, so a script tag in a comment or an attribute opens nothing.
MARKUP = rf"(?is)<!--.*?-->|<(script|style)(?=[\s/>]){_ATTRIBUTES}(?<!/)>.*?(?:</\1\s*>|\z)|</?[a-z]{_ATTRIBUTES}>|<[!?][^>]*+>"


def once(c: Column) -> Column:
    """A generator of the one value: later uses read it, where a plain column would be computed again for each."""
    return F.explode(F.array(c))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """The words between white space, as an array; none for empty text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def squeeze(c: Column) -> Column:
    return F.array_join(words(c), " ")


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def filled_or_empty(*columns: Column) -> Column:
    return F.coalesce(first_filled(*columns), F.lit(""))


def slug(c: Column, size: int = 60) -> Column:
    """Lower-case runs of letters and digits joined by hyphens, cut to ``size``."""
    return F.substring(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-")), 1, size)


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first, everything else lower case."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap), "")


def display(c: Column) -> Column:
    """Extracted text for display: one line, no leading bullets or page marks, a capital first and a stop at the end."""
    flat = F.ltrim(squeeze(F.coalesce(c, F.lit(""))), F.lit("•·-– "))
    bare = strip(F.regexp_replace(flat, r"(?U)^\|?\s*\d{4}\s+Form\s+10-K\s*\|?\s*\d*\s*", ""))
    first = F.left(bare, F.lit(1))
    capital = F.when(first.rlike(r"^\p{Ll}"), F.concat(F.upper(first), F.substring(bare, F.lit(2), F.length(bare)))).otherwise(bare)
    return F.when((capital == "") | capital.rlike(r"[.!?:\"']$"), capital).otherwise(F.concat(F.rtrim(capital, F.lit(",;")), F.lit(".")))


def risk_name(c: Column, names: dict[str, str] | None = None) -> Column:
    """The display name of a risk: from ``names`` by its lower-case key, else in title case."""
    key = F.lower(strip(c))
    default = title_case(strip(c))
    if not names:
        return default
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), default)


def capability_name(c: Column) -> Column:
    return title_case(strip(F.coalesce(c, F.lit(""))))


def clip(c: Column, size: int, mark: str = "...") -> Column:
    """Longer texts cut to ``size`` with ``mark`` at the end."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size - len(mark)), F.lit(mark))).otherwise(c)


def complete_sentences(c: Column) -> Column:
    """An answer without its unfinished last sentence, if a stop lies in its second half."""
    last = F.length(c) - F.locate(".", F.reverse(c)) + 1
    cut = F.contains(c, F.lit(".")) & (last - 1 > F.length(c) * 0.5)
    return F.when(~c.rlike("[.!?\"]$") & cut, F.substring(c, F.lit(1), last)).otherwise(c)


def _numbered(ref: Column) -> Column:
    """The character of a numeric reference: some by Windows-1252, others that are none by the replacement character."""
    digits = F.regexp_extract(ref, "[0-9a-fA-F]+(?=;?$)", 0)
    number = F.coalesce(F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"), F.lit(0x110000))
    known = F.create_map(*[F.lit(x) for pair in RENUMBERED.items() for x in pair])

    def char(n: Column) -> Column:
        usual = F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        none = n.between(1, 8) | (n == 0xB) | n.between(0xE, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
        return F.coalesce(F.try_element_at(known, n.cast("int")), F.when(none & (n <= 0x10FFFF), "").otherwise(usual))

    return let(number, char)


def decode_entities(c: Column, bare: bool = True) -> Column:
    """Character references decoded once each: named ones of HTML, also those that need no semicolon, and numbers. Unknown ones stay.

    Without ``bare``, a name that has no semicolon stays as it is, as in libxml2 2.9: text cut within ``&amp;`` keeps its rest.
    """
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")
    pattern = REFERENCE if bare else f"&(?:{_CLOSED})"

    def named(ref: Column) -> Column:
        known = F.try_element_at(names, F.substring(ref, F.lit(2), F.length(ref)))
        if not bare:
            return F.coalesce(known, ref)
        # an unknown name with a semicolon may begin with one that needs none
        start = F.regexp_extract(ref, rf"^&({_BARE})", 1)
        rest = F.substring(ref, F.length(start) + 2, F.length(ref))
        return F.coalesce(known, F.when(start != "", F.concat(F.try_element_at(names, start), rest)), ref)

    def woven(text: Column) -> Column:
        common = lambda r: F.when(r == "&amp;", "&").when(r == "&nbsp;", "\u00a0").when(r == "&lt;", "<").when(r == "&gt;", ">").when(r == "&quot;", '"')
        chars = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda r: common(r).when(r.startswith("&#"), _numbered(r)).otherwise(named(r)))
        return F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), chars, lambda p, x: F.array(p, F.coalesce(x, F.lit(""))))), "")

    return let(c, lambda text: F.when(F.contains(text, F.lit("&")) & text.rlike(pattern), woven(text)).otherwise(text))


def html_text(c: Column, bare: bool = True) -> Column:
    """The text of a page: no scripts, styles or comments; a line for each text between tags; no blank lines. ``bare`` as in :func:`decode_entities`."""
    lines = F.split(decode_entities(F.regexp_replace(c, MARKUP, "\n"), bare), r"\R")
    return F.array_join(F.filter(F.transform(lines, strip), lambda x: x != ""), "\n")
