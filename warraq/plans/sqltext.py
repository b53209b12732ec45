"""SQL fragments of the oracles: the same character classes in RE2 spelling."""

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
EMOJI = r"\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{1F1E6}-\x{1F1FF}\x{2600}-\x{27bf}"
AR_WIDE = r"\x{600}-\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8ff}\x{fb50}-\x{fdff}\x{fe70}-\x{fefe}"
AR_TWEET = r"\x{600}-\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8ff}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}"
AR_MID = r"\x{600}-\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8ff}"
AR_NARROW = r"\x{600}-\x{6ff}"
LA_WIDE = r"a-zA-Z\x{c0}-\x{24f}"


def words(c: str) -> str:
    """White-space tokens."""
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda x: x <> '')"


def strip(c: str) -> str:
    """Unicode strip."""
    return rf"regexp_replace({c}, '\A{WS}+|{WS}+\z', '', 'g')"


def vocabulary(c: str) -> str:
    """Vocabulary tokens."""
    return rf"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda x: NOT regexp_full_match(x, '\p{{N}}+') AND x NOT IN ('url', 'mention'))"


def token_class(c: str) -> str:
    """arabic / latin / mixed / digits_symbols."""
    ar, la = f"regexp_matches({c}, '[{AR_WIDE}]')", f"regexp_matches({c}, '[{LA_WIDE}]')"
    return f"CASE WHEN {ar} AND {la} THEN 'mixed' WHEN {ar} THEN 'arabic' WHEN {la} THEN 'latin' ELSE 'digits_symbols' END"


def two_class(c: str, ar: str, la: str, other: str) -> str:
    """Script of a text by two classes."""
    a, b = f"regexp_matches({c}, '[{ar}]')", f"regexp_matches({c}, '[{la}]')"
    return f"CASE WHEN {a} AND {b} THEN 'mixed' WHEN {a} THEN 'arabic' WHEN {b} THEN 'latin' ELSE '{other}' END"


def clean_light(c: str) -> str:
    """Marks, mentions, links, clock times, blanks: the rules SQL can say."""
    c = rf"regexp_replace({c}, '[\x{{64b}}-\x{{65f}}\x{{670}}]', '', 'g')"
    c = rf"regexp_replace({c}, '@[\p{{L}}\p{{N}}_.]+', ' [MENTION] ', 'g')"
    c = rf"regexp_replace({c}, '(?i)(?:https?://[^\t-\r\x{{1c}}-\x{{20}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|www\.[^\t-\r\x{{1c}}-\x{{20}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+)', ' [URL] ', 'g')"
    return c


def blanks(c: str) -> str:
    """Blank runs and newlines, stripped."""
    return strip(rf"regexp_replace(regexp_replace({c}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
