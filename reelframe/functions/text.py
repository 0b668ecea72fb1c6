"""Column helpers for text: folding, shortening, tokens, slugs, and the French/English test."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words by which English and French are told apart.
ENGLISH = "the and with from into after before while about their there where which that this these those his her its film story crew mission planet space american directed written starring returns discovers becomes".split()
FRENCH = "le la les des une un dans avec pour par sur film histoire mission équipage planète espace américain réalisé écrit mettant retourne découvre devient alors après avant pendant qui que dont son sa ses".split()


def _decomposed(form: str, keep: Callable[[str], bool]) -> dict[str, str]:
    """What is left of each character that its decomposition changes, by the rule which parts are kept."""
    made = ((chr(c), unicodedata.normalize(form, chr(c))) for c in range(0x80, 0x20000) if not 0xAC00 <= c < 0xE000)
    return {c: left for c, parts in made if parts != c and (left := "".join(filter(keep, parts))) != c}


#: ASCII parts of the characters that decompose into some, and base letters of those that carry combining marks.
_ASCII = {c: t for c, t in _decomposed("NFKD", str.isascii).items() if t}
_BASE = {c: t for c, t in _decomposed("NFD", lambda c: unicodedata.category(c) != "Mn").items() if len(t) == 1}


def _single(text: Column, table: dict[str, str]) -> Column:
    one = {c: t for c, t in table.items() if len(t) == 1}
    return F.translate(text, "".join(one), "".join(one.values()))


#: What is left of characters that become several: up to the letter-like symbols, and Latin ligatures.
_SPELT = {c: t for c, t in _ASCII.items() if len(t) > 1 and (c < "\u2200" or "\ufb00" <= c <= "\ufb06")}


#: Different signs that aren't ASCII, up to which each is replaced by itself.
FEW = 40


def ascii_only(text: Column) -> Column:
    """Text in ASCII: letters without their marks, everything else left out.

    Ligatures, fractions and the like are spelt out up to the letter-like symbols; squared units and circled numbers of
    East Asian sets are left out."""
    spelt = F.str_to_map(F.lit("\u0001".join(c + "\u0002" + t for c, t in _SPELT.items())), F.lit("\u0001"), F.lit("\u0002"))  # one literal

    def known(t: Column, odd: Column) -> Column:
        # a text has few different signs that aren't ASCII: replacing each is far quicker than looking at every letter
        plain = F.split(_single(F.array_join(odd, ""), _ASCII), "")
        pairs = F.arrays_zip(odd.alias("c"), plain.alias("p"))
        some = F.aggregate(pairs, t, lambda done, x: F.replace(done, x["c"], F.coalesce(spelt[x["c"]], F.when(F.octet_length(x["p"]) == 1, x["p"]), F.lit(""))))
        each = F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(spelt[c], c)), "")
        many = _single(F.when(F.exists(odd, lambda c: spelt[c].isNotNull()), each).otherwise(t), _ASCII)
        return F.when(F.size(odd) <= FEW, some).otherwise(F.regexp_replace(many, r"[^\x00-\x7F]", ""))

    odd = lambda t: F.array_distinct(F.split(F.regexp_replace(t, r"[\x00-\x7F]+", ""), ""))
    return F.transform(F.transform(F.array(text), lambda t: F.struct(t.alias("t"), odd(t).alias("odd"))), lambda x: known(x["t"], x["odd"]))[0]


def unmarked(text: Column) -> Column:
    """Letters of all scripts without combining marks."""
    return F.regexp_replace(_single(text, _BASE), r"\p{Mn}+", "")


def squashed(text: Column) -> Column:
    """Runs of white space, no-break spaces included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold(text: Column) -> Column:
    """Lower-case ASCII letters and digits; everything else separates words."""
    return F.trim(F.regexp_replace(F.lower(ascii_only(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", " "))


def folded(text: str) -> str:
    """fold() of a text that is known when the query is built."""
    plain = "".join(c if c.isascii() else t if len(t := _ASCII.get(c, "")) <= 1 else _SPELT.get(c, "") for c in text)
    return " ".join(re.findall("[a-z0-9]+", plain.lower()))


def fold_keeping_signs(text: Column) -> Column:
    """Lower-case ASCII with its punctuation."""
    return F.lower(squashed(ascii_only(F.coalesce(text, F.lit("")))))


def fold_marks(text: Column) -> Column:
    """Lower case without combining marks; letters of other scripts stay, a curly apostrophe becomes straight."""
    return F.translate(unmarked(F.lower(F.coalesce(text, F.lit("")))), "’", "'")


def tokens(text: Column) -> Column:
    """Distinct ASCII words of folded text, first seen first."""
    return F.array_distinct(F.regexp_extract_all(fold_marks(text), F.lit("[a-z0-9]+"), 0))


def flat_head(text: Column, limit: int) -> Column:
    """squashed(), or its beginning if that alone is longer than limit: little of a long text is gone through."""
    some = F.transform(F.array(text), lambda t: F.struct(t.alias("t"), squashed(F.substring(t, 1, 4 * limit)).alias("head")))
    return F.transform(some, lambda x: F.when((F.length(x["head"]) > limit) | (F.length(x["t"]) <= 4 * limit), x["head"]).otherwise(squashed(x["t"])))[0]


def shorten(text: Column, limit: int) -> Column:
    """At most limit characters and an ellipsis, cut at a word's end."""
    flat = flat_head(F.coalesce(text, F.lit("")), limit)
    cut = F.regexp_replace(F.substring(flat, 1, limit), r" [^ ]*$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(cut, "[ .,;:]+$", ""), F.lit("…")))


def slug(text: Column, default: str = "film") -> Column:
    made = F.lower(F.trim(F.regexp_replace(ascii_only(F.coalesce(text, F.lit(""))), "[^a-zA-Z0-9]+", "-"), F.lit("-")))
    return F.when(made == "", default).otherwise(made)


def photo_id(path: Column) -> Column:
    """Slug of the file's stem and eight digits of the path's SHA-1."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat_ws("-", slug(stem, "photo"), F.substring(F.sha1(F.encode(path, "utf-8")), 1, 8))


def first_truthy(*values: Column) -> Column:
    """The first text that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def holds_any(text: Column, terms: list[str]) -> Column:
    """Whether folded text holds a folded term, inside longer words too."""
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(folded(t)))
    return found


def looks_english(text: Column) -> Column:
    words = F.regexp_extract_all(unmarked(F.lower(F.coalesce(text, F.lit("")))), F.lit("[a-z']+"), 0)
    count = lambda listed: F.size(F.filter(words, lambda w: w.isin(listed)))
    en, fr = count(ENGLISH), count(FRENCH)
    return ((en >= 2) & (en >= fr + 1)) | ((fr == 0) & (en >= 1) & (F.size(words) > 12))


def url_of_poster(file: Column, prefix: str = "https://commons.wikimedia.org/wiki/Special:FilePath/") -> Column:
    encoded = F.url_encode(F.replace(file, F.lit(" "), F.lit("_")))
    for code, sign in (("%28", "("), ("%29", ")"), ("%2C", ","), ("%21", "!"), ("%27", "'"), ("%2F", "/"), ("%3A", ":")):
        encoded = F.replace(encoded, F.lit(code), F.lit(sign))
    return F.when(blank(file), "").otherwise(F.concat(F.lit(prefix), encoded))


def listed(value: Column, kind: str) -> Column:
    """A scalar or a list as a list of trimmed texts without empty ones; a scalar that is null or empty is no entry.

    kind is the column's type: text, an array, a variant that holds either, or another scalar."""
    if kind.startswith("array"):
        many = value.cast("array<string>")
    elif kind == "variant":
        one = F.schema_of_variant(value).startswith("ARRAY")
        many = F.when(one, F.try_variant_get(value, "$", "array<string>")).otherwise(F.array(F.try_variant_get(value, "$", "string")))
    else:
        many = F.array(value.cast("string"))
    trimmed = F.transform(many, lambda v: F.trim(v))
    return F.coalesce(F.filter(trimmed, lambda v: v.isNotNull() & (v != "")), F.array().cast("array<string>"))


def joined(rows: DataFrame, fields: list[str]) -> Column:
    """Texts and lists of the named columns, those that the rows have, in one text."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return F.array_join(F.flatten(F.array(*(listed(F.col(f), kinds[f]) for f in fields if f in kinds))), " ")
