"""Column expressions for text: tokenizers, script classes, cleaning rules.

Everything here is a built-in Spark expression (whole-stage codegen, no
Python).  Patterns are written for ``java.util.regex``; the classes below are
the ones that agree with Python's ``\\w``, ``\\s`` and ``\\d`` over all scalars.
Null in gives null out for every function unless its docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns of the cleaning rules.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NON_WS = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
INVISIBLE = r"[\u200b\u200c\u200e\u200f\u2066-\u2069\ufeff]"
TACHKIL = r"[\u064b-\u065f\u0670]"
TATWEEL = r"\u0640+"
EMOJI = r"\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{1F1E6}-\x{1F1FF}\u2600-\u27bf"
GRAPHEME = rf"[{EMOJI}]\ufe0f?(?:\u200d[{EMOJI}]\ufe0f?)*"
URL = rf"(?i)(?:https?://{NON_WS}+|www\.{NON_WS}+)"
MENTION = r"@[\p{L}\p{N}_.]+"
CLOCK = r"(^|[^\p{L}\p{N}_])\p{Nd}{1,2}:\p{Nd}{2}(?::\p{Nd}{2})?(?![\p{L}\p{N}_])"
QUOTE_HEADER = rf"اقتباس:{WS}*\nالمشاركة الأصلية كتبت بواسطة{WS}+{NON_WS}+"
WIDGET = r"(?s)أكبر تواجد بالمنتدى كان.*"
BBCODE = rf"\[/?(?!URL\])[a-zA-Z]+(?:=[^\]]*)?{WS}*\]"
ARABIC_WIDE = r"\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufefe"
ARABIC_TWEET = r"\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff"
ARABIC_MID = r"\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff"
ARABIC_NARROW = r"\u0600-\u06ff"
LATIN_WIDE = r"a-zA-Z\u00c0-\u024f"
LATIN = r"a-zA-Z"

_KEEP_ZWJ = "\ue000"


def strip(c: Column) -> Column:
    """Unicode strip (Spark's ``trim`` only removes U+0020)."""
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def words(c: Column) -> Column:
    """White-space tokens; the empty array for a blank text, null for null."""
    return F.filter(F.split(c, rf"{WS}+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    """Number of white-space tokens as BIGINT."""
    return F.size(words(c)).cast("bigint")


def word_runs(c: Column) -> Column:
    """Lower-cased maximal runs of letters, numbers and underscore."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"({WORD}+)"), 1)


def vocabulary_tokens(c: Column) -> Column:
    """``word_runs`` without all-digit tokens and the placeholder words."""
    return F.filter(word_runs(c), lambda x: ~x.rlike(r"^\p{N}+$") & ~x.isin("url", "mention"))


def ascii_words(c: Column) -> Column:
    """``[a-z0-9]+`` runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def arabic_words(c: Column) -> Column:
    """Runs of U+0600-06FF."""
    return F.regexp_extract_all(c, F.lit(rf"([{ARABIC_NARROW}]+)"), 1)


# --- cleaning rules, one function each; order is fixed by the pipelines -----


def strip_invisible(c: Column) -> Column:
    """Drop invisible and bidi characters; a joiner stays only between emoji."""
    c = F.regexp_replace(c, INVISIBLE, "")
    c = F.regexp_replace(c, rf"([{EMOJI}])\u200d(?=[{EMOJI}])", f"$1{_KEEP_ZWJ}")
    return F.translate(F.regexp_replace(c, "\u200d", ""), _KEEP_ZWJ, "\u200d")


def strip_tachkil(c: Column) -> Column:
    """Remove Arabic diacritics (digits U+0660-0669 are untouched)."""
    return F.regexp_replace(c, TACHKIL, "")


def strip_tatweel(c: Column) -> Column:
    """Remove U+0640."""
    return F.regexp_replace(c, TATWEEL, "")


def replace_mentions(c: Column) -> Column:
    """``@name`` becomes `` [MENTION] ``."""
    return F.regexp_replace(c, MENTION, " [MENTION] ")


def replace_urls(c: Column) -> Column:
    """Links become `` [URL] ``."""
    return F.regexp_replace(c, URL, " [URL] ")


def strip_clock_times(c: Column) -> Column:
    """``12:34`` and ``1:02:33`` become a space."""
    return F.regexp_replace(c, CLOCK, "$1 ")


def collapse_elongation(c: Column) -> Column:
    """Three or more of one letter become two."""
    return F.regexp_replace(c, rf"({LETTER})\1{{2,}}", "$1$1")


def collapse_punctuation(c: Column) -> Column:
    """Dot runs become three dots, runs of ``! ? ؟ , ،`` two."""
    return F.regexp_replace(F.regexp_replace(c, r"\.{2,}", "..."), r"([!?\u061f,\u060c])\1{2,}", "$1$1")


def collapse_emoji(c: Column) -> Column:
    """Runs of three or more emoji graphemes keep the first two."""
    return F.regexp_replace(c, rf"({GRAPHEME})({GRAPHEME})(?:{GRAPHEME})+", "$1$2")


def normalize_whitespace(c: Column) -> Column:
    """Blank runs become one blank, three or more newlines two; stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def strip_widget(c: Column) -> Column:
    """Remove the who-is-online block to the end of the text."""
    return F.regexp_replace(c, WIDGET, "")


def strip_quote_header(c: Column) -> Column:
    """Remove reply-quote headers (single pass, quoted text stays)."""
    return F.regexp_replace(c, QUOTE_HEADER, " ")


def strip_bbcode(c: Column) -> Column:
    """Remove BBCode tags; the literal ``[URL]`` stays."""
    return F.regexp_replace(c, BBCODE, " ")


def residual_letters(c: Column) -> Column:
    """Code points left after removing emoji and everything that is no word character."""
    no_emoji = F.regexp_replace(c, rf"[{EMOJI}]", "")
    return F.length(strip(F.regexp_replace(no_emoji, r"[^\p{L}\p{N}_\u0600-\u06ff]", "")))


def shingle_form(c: Column) -> Column:
    """Stripped, lower-cased, white space single: the text that is shingled."""
    return F.regexp_replace(F.lower(strip(c)), rf"{WS}+", " ")


def char_shingles(c: Column, n: int = 4) -> Column:
    """Distinct character n-grams of ``shingle_form``; whole text if not longer than n, empty if empty."""
    t = shingle_form(c)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n))))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= n, F.array(t)).otherwise(many)


# --- classification ---------------------------------------------------------


def token_class(c: Column) -> Column:
    """arabic / latin / mixed / digits_symbols over the wide ranges."""
    ar, la = c.rlike(f"[{ARABIC_WIDE}]"), c.rlike(f"[{LATIN_WIDE}]")
    return F.when(ar & la, "mixed").when(ar, "arabic").when(la, "latin").otherwise("digits_symbols")


def script_narrow(c: Column) -> Column:
    """arabic / latin / mixed / other over U+0600-06FF and ASCII letters."""
    ar, la = c.rlike(f"[{ARABIC_NARROW}]"), c.rlike(f"[{LATIN}]")
    return F.when(ar & la, "mixed").when(ar, "arabic").when(la, "latin").otherwise("other")


def script_tweet(c: Column) -> Column:
    """Script of a short text; ``other_empty`` without letters of either."""
    ar, la = c.rlike(f"[{ARABIC_TWEET}]"), c.rlike(f"[{LATIN_WIDE}]")
    return F.when(ar & la, "mixed").when(ar, "arabic").when(la, "latin").otherwise("other_empty")


def script_ratio_bucket(c: Column, low: float = 0.15, high: float = 0.85) -> Column:
    """Bucket by the Arabic share of letters; bounds are inclusive."""
    ar, la = F.regexp_count(c, F.lit(f"[{ARABIC_MID}]")), F.regexp_count(c, F.lit(f"[{LATIN}]"))
    share = ar / (ar + la)
    return (
        F.when(c.isNull(), None).when(ar + la == 0, "no_letters").when(share >= high, "arabic").when(share <= low, "latin").otherwise("mixed")
    )


def class_sizes(c: Column) -> dict[str, Column]:
    """Token counts by ``token_class`` without exploding."""
    w = words(c)

    def of(kind: str) -> Column:
        return F.size(F.filter(w, lambda x: token_class(x) == kind)).cast("bigint")

    return {kind: of(kind) for kind in ("arabic", "latin", "mixed", "digits_symbols")}


def document_script(c: Column) -> Column:
    """arabic, latin or mixed by the classes of the tokens; null without alphabetic tokens."""
    n = class_sizes(c)
    return (
        F.when((n["mixed"] > 0) | ((n["arabic"] > 0) & (n["latin"] > 0)), "mixed").when(n["arabic"] > 0, "arabic").when(n["latin"] > 0, "latin")
    )


def document_dominance(c: Column, share: float = 0.7) -> Column:
    """Arabic, Latin, Code-Switched, Symbols or Empty by token shares."""
    n, total = class_sizes(c), word_count(c)
    return (
        F.when(c.isNull() | (total == 0), "Empty")
        .when(n["arabic"] / total >= share, "Arabic")
        .when(n["latin"] / total >= share, "Latin")
        .when(n["arabic"] + n["latin"] + n["mixed"] > 0, "Code-Switched")
        .otherwise("Symbols")
    )


# --- identifiers ------------------------------------------------------------


def video_id(c: Column) -> Column:
    """Video id from watch, short-link, shorts, embed and live URLs or a bare id; null otherwise."""
    host = F.lower(F.try_parse_url(c, F.lit("HOST")))
    path = F.try_parse_url(c, F.lit("PATH"))
    short = F.regexp_extract(path, r"^/*([^/]+)", 1)
    named = F.regexp_extract(path, r"^/(?:shorts|embed|live|v)/([^/]+)", 1)
    return F.nullif(
        F.when(host.rlike(r"(^|\.)youtu\.be$"), short)
        .when(host.rlike(r"(^|\.)youtube\.com$"), F.coalesce(F.try_parse_url(c, F.lit("QUERY"), F.lit("v")), F.nullif(named, F.lit(""))))
        .when(c.rlike(r"^[\p{L}\p{N}_-]+$"), c),
        F.lit(""),
    )


def channel_ref(c: Column) -> Column:
    """struct(channel_id, handle) from a channel URL, ``UC…`` id, ``@handle`` or bare handle."""
    t = F.regexp_replace(strip(c), "/+$", "")
    cid = F.coalesce(F.nullif(F.regexp_extract(t, r"/channel/(UC[\w-]+)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^(UC[\w-]{20,})$", 1), F.lit("")))
    handle = F.coalesce(
        F.nullif(F.regexp_extract(t, rf"/@({NON_WS}+?)(?:/.*)?$", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, r"/(?:c|user)/([^/?]+)", 1), F.lit("")),
        F.regexp_replace(t, "^@", ""),
    )
    return F.struct(cid.alias("channel_id"), F.when(cid.isNull(), handle).alias("handle"))


def comma_decimal(c: Column) -> Column:
    """``0,5`` as DOUBLE; null when it is no number."""
    return F.regexp_replace(strip(c), ",", ".").try_cast("double")


def sentinel_null(c: Column, sentinel: str = "nan") -> Column:
    """Null instead of a missing-value string."""
    return F.nullif(c, F.lit(sentinel))
