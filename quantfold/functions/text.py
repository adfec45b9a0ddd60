"""String expressions: word counts, truncation, currency mentions, response parsing.

Everything here is a native Spark expression (regex and higher-order array
functions); no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mathx import col_

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
#
# Currency codes in ranking order (ties in return ranking are broken by this
# order): USD, EUR, JPY, GBP, CAD, AUD, CHF, SEK, NOK, NZD.
#
# Currency synonyms are searched case-insensitively as unanchored patterns, in
# the order below (it is also the order of the detected-currency list).
#
# Evaluation code order: EUR, USD, GBP, JPY, AUD, CAD, CHF, NZD, NOK, SEK.
# Label domain: appreciation, depreciation, unchanged.
# ---------------------------------------------------------------------------
RANK_CODES = ["USD", "EUR", "JPY", "GBP", "CAD", "AUD", "CHF", "SEK", "NOK", "NZD"]

CURRENCY_SYNONYMS: dict[str, list[str]] = {
    "EUR": [r"EUR", r"Euro"],
    "USD": [r"USD", r"Dollar", r"Dollars", r"US Dollar", r"US-Dollar", r"U\.S\. Dollar",
            r"US Dollars", r"US-Dollars", r"U\.S\. Dollars", r"Greenback"],
    "JPY": [r"JPY", r"Yen", r"Japanese Yen"],
    "GBP": [r"GBP", r"Pound", r"Pounds", r"Sterling", r"British Pound", r"British Pounds"],
    "AUD": [r"AUD", r"Australian Dollar", r"Australian Dollars", r"Aussie"],
    "CAD": [r"CAD", r"Canadian Dollar", r"Canadian Dollars"],
    "CHF": [r"CHF", r"Swiss Franc", r"Swiss Francs", r"Swissie"],
    "NZD": [r"NZD", r"New Zealand Dollar", r"New Zealand Dollars", r"Kiwi"],
    "NOK": [r"NOK", r"Norwegian Krone", r"Norwegian Kroner"],
    "SEK": [r"SEK", r"Swedish Krona", r"Swedish Kronor"],
}

EVAL_CODES = ["EUR", "USD", "GBP", "JPY", "AUD", "CAD", "CHF", "NZD", "NOK", "SEK"]
LABELS = ["appreciation", "depreciation", "unchanged"]

#: White space as Python's str methods see it: Unicode's and the separators U+001C-U+001F.
WS = r"[\s\x{1c}-\x{1f}]"
NOT_WS = r"[^\s\x{1c}-\x{1f}]"


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing (Unicode) whitespace."""
    return F.regexp_replace(col_(c), rf"(?U)^{WS}+|{WS}+$", "")


def word_count(c) -> Column:
    """Number of whitespace-separated words (``len(str.split())``); NULL stays NULL."""
    parts = F.split(col_(c), rf"(?U){WS}+")
    return F.size(F.filter(parts, lambda w: w != F.lit(""))).cast("bigint")


def has_min_words(c, n: int) -> Column:
    """``word_count(c) >= n`` without splitting the whole text: an anchored regex
    that stops after the n-th word.  NULL text gives NULL (filtered out)."""
    if n <= 0:
        return col_(c).isNotNull()
    return col_(c).rlike(rf"(?U)^{WS}*(?:{NOT_WS}+{WS}+){{{n - 1}}}{NOT_WS}")


def truncate_chars(c, n: int) -> Column:
    """Keep the first ``n`` characters (code points)."""
    return F.substring(col_(c), 1, n)


def drop_first_word(c) -> Column:
    """Text after the first single space, stripped; the whole string if there is none."""
    return strip_ws(F.regexp_replace(col_(c), r"^[^ ]* ", ""))


def synonym_regex(patterns: list[str], word_boundary: bool = False) -> str:
    alt = "|".join(patterns)
    if word_boundary:
        alt = rf"\b(?:{alt})\b"
    return f"(?iu)(?:{alt})"


def _literal(pattern: str) -> str | None:
    """The plain ASCII text a pattern matches, or None if it uses regex syntax."""
    import re

    if re.search(r"[\\^$.|?*+()\[\]{}]", re.sub(r"\\[.\-]", "", pattern)) or not pattern.isascii():
        return None
    return re.sub(r"\\([.\-])", r"\1", pattern)


def mentioned_currencies(c, synonyms: dict[str, list[str]] | None = None,
                         word_boundary: bool = False) -> Column:
    """Array of codes whose synonym regex matches anywhere in the text, in dict order.

    Matching is unanchored by default (as in the reference: "Euro" matches
    "Europe"); ``word_boundary=True`` anchors on word boundaries.  Literal
    ASCII synonyms are matched as substrings of the lower-cased text (the
    same hits as a case-insensitive search, without a regex engine pass
    over every character); other patterns use a case-insensitive regex.
    """
    syn = synonyms or CURRENCY_SYNONYMS
    x = col_(c)
    low = F.lower(x)
    hits = []
    for code, pats in syn.items():
        lits = [_literal(p) for p in pats]
        if not word_boundary and all(lits):
            cond = None
            words = list(dict.fromkeys(t.lower() for t in lits))
            for lit in [w for w in words if not any(o != w and o in w for o in words)]:  # a longer one adds no hit
                e = low.contains(lit)
                cond = e if cond is None else (cond | e)
        else:
            cond = x.rlike(synonym_regex(pats, word_boundary))
        hits.append(F.when(cond, F.lit(code)))
    return F.filter(F.array(*hits), lambda v: v.isNotNull())


def _strip_quotes(c: Column) -> Column:
    # Python: label.strip().strip('"').strip("'")
    return F.regexp_replace(F.regexp_replace(strip_ws(c), r'^"+|"+$', ""), r"^'+|'+$", "")


def parse_response(c, strip_quotes: bool = True) -> Column:
    """Model response text -> map<string,string>.  Without ``strip_quotes`` labels keep their quotes, so ``"x"`` is a class of its own.

    One ``key: label`` per non-blank line.  Any non-blank line that does not
    split into exactly two parts on ``:`` invalidates the whole response and
    yields an empty map; keys and labels are stripped, surrounding double then
    single quotes removed; on duplicate keys the last line wins.
    """
    lines = F.transform(F.split(F.coalesce(col_(c), F.lit("")), "\n", -1), strip_ws)
    split = F.transform(F.filter(lines, lambda ln: ln != F.lit("")), lambda ln: F.split(ln, ":", -1))
    empty = F.create_map().cast("map<string,string>")

    def last_wins(pairs: Column) -> Column:
        return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(
            F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["k"] == p["k"])))

    def parsed(parts: Column) -> Column:
        pairs = F.transform(parts, lambda p: F.struct(strip_ws(p[0]).alias("k"), (_strip_quotes if strip_quotes else strip_ws)(p[1]).alias("v")))
        bad = (F.size(parts) == 0) | F.exists(parts, lambda p: F.size(p) != 2)
        return F.when(bad, empty).otherwise(_bound(pairs, last_wins))

    return _bound(split, parsed)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as the variable of a one-element transform."""
    return F.transform(F.array(value), use)[0]


def lookup_label(m, key, default: str = "unchanged") -> Column:
    """Map lookup with a default (missing prediction -> unchanged)."""
    k = F.lit(key) if isinstance(key, str) else key
    return F.coalesce(F.try_element_at(col_(m), k), F.lit(default))


TOKEN_PATTERN = r"\S+\s*"


def token_array(c, pattern: str = TOKEN_PATTERN) -> Column:
    """Regex tokens of a text (default: a word with its trailing whitespace)."""
    return F.regexp_extract_all(col_(c), F.lit(pattern), 0)


def token_count(c, pattern: str = TOKEN_PATTERN) -> Column:
    return F.size(token_array(c, pattern)).cast("bigint")


def truncate_tokens(c, n: int, pattern: str = TOKEN_PATTERN) -> Column:
    """Keep the first ``n`` tokens (the text is unchanged when it has fewer)."""
    toks = token_array(c, pattern)
    return F.when(F.size(toks) > n, strip_ws(F.array_join(F.slice(toks, 1, n), ""))).otherwise(col_(c))
