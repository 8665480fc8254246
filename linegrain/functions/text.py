"""Text and token rules as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import string
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark an editorial note instead of a sequence.
STOP_TOKENS = [
    "VACAT", "VACANT", "DEEST", "SUPRA", "INFRA", "MUTILA", "LINE", "STATEMENT", "LOGOGRAM",
    "NUMBER", "FRACTION", "SIDE", "NOTES", "TOTAL", "REST", "VEST", "BIS", "TER",
]
# Words that rule out a catalogue sequence.
CATALOG_STOP_TOKENS = ["NO", "OF", "IMPRESSIONS", "FRACTION", "SIGN", "SIGNS"]
# What HTML reads as a character reference.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"

# Classes name their characters one by one: Java looks single ones up in a table and tries ranges one after the other.
SPACE = r" \t\n\x0B\f\r"  # what \s means
CAPITAL_OR_DIGIT = string.ascii_uppercase + string.digits
TOKEN = rf"[^{SPACE}+-]+"
SHAPE = rf"^[\[\]]*\*?[{CAPITAL_OR_DIGIT}?]+[\[\]]*$"
CATALOG_SHAPE = r"^[\[\]]*(\?|(AB|A)[0-9]+[A-Z0-9?]*|\*[0-9]+[A-Z0-9?]*)[\[\]]*$"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def _last_number(s: Column) -> Column:
    """The last word of collapsed text if it is a number, else NULL."""
    last = F.substring_index(s, " ", -1)
    return F.when(last.rlike("^[0-9]+$"), last)


def surface_part(text: Column) -> Column:
    """The text without a closing stand-alone number."""
    return collapsed_surface(collapse(text))


def collapsed_surface(s: Column) -> Column:
    """:func:`surface_part` of text that is collapsed."""
    return F.rtrim(F.left(s, F.length(s) - F.coalesce(F.length(_last_number(s)), F.lit(0))))


def quantity_part(text: Column) -> Column:
    """The closing stand-alone number, NULL when there is none or it is beyond 64 bits."""
    return collapsed_quantity(collapse(text))


def collapsed_quantity(s: Column) -> Column:
    """:func:`quantity_part` of text that is collapsed."""
    return _last_number(s).try_cast("bigint")


def quantity_digits(text: Column) -> Column:
    """The closing stand-alone number as digits, however many, without leading zeros; NULL when there is none."""
    digits = _last_number(collapse(text))
    return F.when(digits.isNotNull(), F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(text), F.lit(TOKEN), 0)


def groups(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(text), F.lit(rf"[^{SPACE}]+"), 0)


def _old_code(i: int) -> str:
    """What a page means by character code ``i`` of the range that Windows used."""
    return bytes([i]).decode("cp1252", "ignore") or chr(i)


def _character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numeric(body: Column) -> Column:
    """The character of ``#…``, as HTML reads it; ``body`` has no closing semicolon."""
    hexed = F.lower(F.substring(body, 2, 1)) == "x"
    digits = F.ltrim(F.when(hexed, F.substr(body, F.lit(3))).otherwise(F.substr(body, F.lit(2))), F.lit("0"))
    # more digits than any code point has are out of range
    short = F.when(F.length(digits) <= 10, F.concat(F.lit("0"), digits))
    code = F.coalesce(
        F.when(hexed, F.conv(short, 16, 10)).otherwise(short).try_cast("bigint"), F.lit(1 << 40)
    )
    # In a page, codes 128 to 159 are those of Windows; five have no character there.
    old = F.element_at(F.array(*[F.lit(_old_code(i)) for i in range(0x80, 0xA0)]), (code - 0x7F).cast("int"))
    nothing = (
        code.between(0x1, 0x8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    return (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd"))
        .when(code.between(0x80, 0x9F), old)
        .when(nothing, F.lit(""))
        .otherwise(_character(code))
    )


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that stands once in the plan, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unescape(text: Column) -> Column:
    """Every named and numeric character reference decoded, in one pass."""
    # Control characters part the table of standard names; no name or character holds them.
    table = F.str_to_map(
        F.lit("\x02".join(f"{k}\x01{v}" for k, v in html5.items())), F.lit("\x02"), F.lit("\x01")
    )
    # Names that need no semicolon may be the beginning of a longer word.
    lengths = sorted({len(k) for k in html5 if not k.endswith(";")}, reverse=True)

    def decoded(found: Column, names: Column) -> Column:
        name = F.substr(found, F.lit(2))
        begun = [
            F.when(F.length(name) > n, F.concat(names[F.left(name, F.lit(n))], F.substr(name, F.lit(n + 1))))
            for n in lengths
        ]
        named = F.coalesce(names[name], *begun, found)
        return F.when(name.startswith("#"), _numeric(F.rtrim(name, F.lit(";")))).otherwise(named)

    def whole(t: Column, names: Column) -> Column:
        pieces = F.split(t, REFERENCE)
        found = F.concat(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)), F.array(F.lit("")))
        parts = F.zip_with(pieces, found, lambda a, b: F.concat(a, F.when(b == "", b).otherwise(decoded(b, names))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(parts, "")).otherwise(t)

    return bound(text, lambda t: bound(table, lambda names: whole(t, names)))


def clean_html(fragment: Column) -> Column:
    s = F.regexp_replace(fragment, r"(?i)<br\s*/?>", " ")
    s = F.regexp_replace(s, r"(?i)</?(?:sub|sup)[^>]*>", "")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    return collapse(F.replace(unescape(s), F.lit("\u00a0"), F.lit(" ")))


def artifact_key(text: Column) -> Column:
    return collapse(F.regexp_replace(F.upper(clean_html(text)), r"[^A-Z0-9 ]+", " "))


def line_key(text: Column, fallback: Column) -> Column:
    s = collapse(F.replace(clean_html(text), F.lit("•"), F.lit(" ")))
    return F.coalesce(F.nullif(s, F.lit("")), fallback)


def canonical_sequence(text: Column) -> Column:
    s = F.upper(clean_html(text))
    s = F.regexp_replace(s, r"\{[^{}]*\}", " ")
    s = F.regexp_replace(s, r"[•·|/…]", " ")
    s = F.regexp_replace(s, r"(?<![\p{L}\p{N}_])[0-9]+(?![\p{L}\p{N}_])", " ")
    s = F.regexp_replace(s, rf"[^{CAPITAL_OR_DIGIT}*?+\-\[\] ]+", " ")
    return collapse(s)


def shape_ok(token: Column) -> Column:
    return token.rlike(SHAPE)


def strip_brackets(token: Column) -> Column:
    return F.regexp_replace(token, r"^[\[\]]+|[\[\]]+$", "")


def plausible(toks: Column, shaped: Column | None = None) -> Column:
    """Whether a token array looks like a sequence and not like a remark; ``shaped``: its tokens of good shape, if counted."""
    n = F.size(toks)
    shaped = F.size(F.filter(toks, shape_ok)) if shaped is None else shaped
    core = strip_brackets(F.get(toks, F.lit(0)))
    lone_ok = core.startswith("*") | core.rlike("[0-9]") | (F.length(core) >= 3)
    stopped = F.arrays_overlap(toks, F.array(*map(F.lit, [*STOP_TOKENS, "IMPRESSIONS"])))
    no_of = F.array_contains(toks, "NO") & F.array_contains(toks, "OF") & (n >= 3)
    enough = shaped >= F.greatest(F.lit(1), F.ceil(F.lit(0.6) * n))
    return (n > 0) & ~stopped & ~no_of & enough & ((n > 1) | lone_ok)


def catalog_sequence(toks: Column) -> Column:
    stopped = F.arrays_overlap(toks, F.array(*map(F.lit, CATALOG_STOP_TOKENS)))
    return (F.size(toks) > 0) & ~stopped & F.forall(toks, lambda t: t.rlike(CATALOG_SHAPE))


def slug(name: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^_+|_+$", ""), F.lit("")), F.lit("external"))


def ngrams(toks: Column, n: int) -> Column:
    """Contiguous n-grams as space-joined text; none when shorter than ``n``."""
    starts = F.sequence(F.lit(1), F.size(toks) - (n - 1))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(toks, i, n), " "))
    return F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>"))
