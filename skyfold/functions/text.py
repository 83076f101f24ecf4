"""Name keys, slugs, normalisation and label lookups as column expressions."""

from __future__ import annotations

import html
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters trimmed, stop words, marker text, id format.
CATALOG_TRIM = " .,;:"
CELL_TRIM = " .*"
STOP_WORDS = (
    "the", "a", "an", "is", "are", "for", "to", "of", "and", "or",
    "in", "on", "at", "with", "from", "by", "if", "it", "be", "as",
    "that", "this", "not", "do", "use", "where", "when", "only",
)
NOTE_MARKER = " [forecast fields: model import]"
BULLETS = "•‣●▪·⁃"
CATALOG_ID_PREFIX = "icar_"
ACTION_TEMPLATES_HI = {
    "additional_contingency": "अतिरिक्त आकस्मिक उपाय (%d वस्तुएँ) उपलब्ध हैं — अपने स्थानीय KVK विस्तार अधिकारी से सलाह लें।",
    "additional_preparatory": "अतिरिक्त तैयारी के उपाय (%d वस्तुएँ) उपलब्ध हैं — अपने स्थानीय KVK विस्तार अधिकारी से सलाह लें।",
}
ACTION_TEMPLATES = {
    "additional_contingency": "Additional contingency measures (%d items) are available — consult your local KVK extension officer.",
    "additional_preparatory": "Additional preparatory measures (%d items) are available — consult your local KVK extension officer.",
}


def alnum_key(c: Column) -> Column:
    """Letters and digits only, lower case; joins names that differ in spacing."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def merge_key(c: Column) -> Column:
    """Trimmed lower-case key used when records are merged."""
    return F.lower(F.trim(c))


def word_slug(c: Column) -> Column:
    """Words of letters and digits joined by underscores; commas split words."""
    words = F.filter(F.split(F.trim(F.regexp_replace(c, ",", " ")), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, alnum_key), "_")


@cache
def _ascii_forms() -> dict[str, str]:
    """The ASCII characters of every character's compatibility decomposition, where it has some."""
    forms = {}
    for point in range(0x80, 0x110000):
        plain = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode("ascii")
        if plain:
            forms[chr(point)] = plain
    return forms


def _fold_ascii(c: Column) -> Column:
    """Compatibility folding to ASCII, characters without an ASCII form left out.

    A decomposition never moves ASCII characters, so it is a lookup of every character:
    one ASCII character for most, texts with others (ligatures, fractions) are taken apart.
    """
    forms = _ascii_forms()
    single = {k: f for k, f in forms.items() if len(f) == 1}
    several = {k: f for k, f in forms.items() if len(f) > 1}
    spans: list[list[int]] = []
    for point in sorted(map(ord, several)):
        # few wide spans are searched fast; what else lies in them passes the lookup as it is
        if spans and point >= 0x2000 and point - spans[-1][1] <= 64 or spans and point == spans[-1][1] + 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    rare = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]"
    apart = F.regexp_replace(c, f"({rare})", "\ue000$1\ue000")
    table = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    spelled = F.array_join(F.transform(F.split(apart, "\ue000", -1), lambda part: F.coalesce(F.try_element_at(table, part), part)), "")
    known = F.when(F.translate(c, "".join(several), "") != c, spelled).otherwise(c)
    folded = F.translate(known, "".join(single), "".join(single.values()))
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"[^\x00-\x7F]+", "")).otherwise(c)


def ascii_slug(c: Column) -> Column:
    """Accents folded, other runs to one underscore."""
    return F.trim(F.regexp_replace(F.lower(_fold_ascii(c)), r"[^a-z0-9]+", "_"), F.lit("_"))


def focus_slug(names: Column) -> Column:
    """Slug of a list of state names: ``_a_b-c``; empty for an empty list."""
    parts = F.transform(
        names, lambda n: F.trim(F.regexp_replace(F.lower(n), r"[^\p{L}\p{N}]", "_"), F.lit("_"))
    )
    return F.when(F.size(names) > 0, F.concat(F.lit("_"), F.array_join(parts, "-"))).otherwise("")


def action_id(c: Column) -> Column:
    """Stable id: lower case, other runs to underscores, at most 120 characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), F.lit("_")), 1, 120)


_SPACES = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WHITESPACE = f"{_SPACES}+"
# whitespace other than one plain space; a letter fails the first test of a class, before the list of spaces is gone through
_UNEVEN = f"[[^ -~]&&{_SPACES}][[^!-~]&&{_SPACES}]*| [[^!-~]&&{_SPACES}]+"


def squeeze(c: Column) -> Column:
    """Collapse whitespace and trim; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _UNEVEN, " "))


def squeeze_lower(c: Column) -> Column:
    return F.lower(squeeze(c))


def catalog_key(c: Column) -> Column:
    """Key of a text in the translation catalog."""
    plain = F.replace(F.replace(c, F.lit("’"), F.lit("'")), F.lit("\uf020"), F.lit(" "))
    return F.lower(F.trim(squeeze(plain), F.lit(CATALOG_TRIM)))


def catalog_id(c: Column) -> Column:
    """Hash id of a new catalog entry."""
    return F.concat(F.lit(CATALOG_ID_PREFIX), F.substring(F.sha1(catalog_key(c)), 1, 16))


def split_camel(c: Column) -> Column:
    """Spaced form of joined names, with joined ``and`` set apart and ``&`` spelled out."""
    s = F.replace(c, F.lit("&"), F.lit(" and "))
    s = F.regexp_replace(s, r"(?<=[a-z])(?=[A-Z])", " ")
    s = F.regexp_replace(s, r"\b([A-Z][a-z]+)and\b", "$1 and")
    return squeeze(s)


def clean_roster_name(c: Column) -> Column:
    """Title case for all-capital names and ``&`` spelled out."""
    s = F.trim(c)
    has_letter = s.rlike(r"\p{L}")
    s = F.when((s == F.upper(s)) & has_letter, F.initcap(F.lower(s))).otherwise(s)
    s = F.replace(F.replace(s, F.lit(" & "), F.lit(" and ")), F.lit("&"), F.lit(" and "))
    return squeeze(s)


@F.pandas_udf(T.StringType())
def _decoded(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore").str.replace("\xa0", " ")


def unescape_html(c: Column) -> Column:
    """All named and numbered character references; a fixed space becomes a plain one.

    The table of names has no built-in, so texts with a reference go through one Arrow batch call.
    """
    return F.when(F.contains(c, F.lit("&")), _decoded(c)).otherwise(c)


def absolute_url(base: Column, href: Column) -> Column:
    """A link's address seen from the page ``base``: full, host-relative or beside the page."""
    origin = F.regexp_extract(base, r"^[a-zA-Z][\w+.-]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^[a-zA-Z][\w+.-]*://[^/?#]*(/(?:[^?#]*/)?)?", 1)
    return (
        F.when(href.rlike(r"^[a-zA-Z][\w+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^[a-zA-Z][\w+.-]*:", 0), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), href))
    )


def anchor_text(c: Column) -> Column:
    """Anchor text without pipe separators and edge dashes."""
    return F.trim(F.trim(squeeze(F.replace(unescape_html(c), F.lit("|"), F.lit(" "))), F.lit(" -–")))


def path_segment(href: Column, pattern: str) -> Column:
    """Decoded, lower-case path segment captured by ``pattern`` without a ``(pdf)`` suffix."""
    seg = F.regexp_extract(href, pattern, 1)
    seg = F.try_url_decode(F.regexp_replace(seg, r"\+", "%2B"))
    return F.lower(squeeze(F.regexp_replace(seg, r"(?i)\(pdf\)", "")))


def significant_words(c: Column) -> Column:
    """Distinct lower-case words longer than two characters that are not stop words."""
    words = F.split(F.lower(c), r"\s+")
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(
        F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stops, w))
    )


def set_note(existing: Column, addition: Column) -> Column:
    """Replace whatever follows the import marker in a note."""
    base = F.rtrim(F.substring_index(F.coalesce(existing, F.lit("")), NOTE_MARKER, 1))
    return F.concat(base, F.lit(NOTE_MARKER + ": "), addition)


def note_base(existing: Column) -> Column:
    return F.rtrim(F.substring_index(F.coalesce(existing, F.lit("")), NOTE_MARKER, 1))


def any_phrase(c: Column, phrases: tuple[str, ...]) -> Column:
    """Lower-cased text contains one of the phrases."""
    low = F.lower(c)
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(low, F.lit(p))
    return hit


def translate_label(c: Column, mapping: dict[str, str]) -> Column:
    """Lookup with the value itself as fallback."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def replace_all(c: Column, mapping: dict[str, str]) -> Column:
    """Successive literal replacements in the mapping's order."""
    for k, v in mapping.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c
