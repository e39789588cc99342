"""Text functions on columns. All native except ``similarity``."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace as Python's str.split() sees it.
SPACE = r"[\s\x1C-\x1F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Sentence terminals with their closing marks.
TERMINAL = r"""[.!?。！？]+["'”’»」』)\]]*"""
# Speakers a group may carry; anything else becomes M1.
SPEAKERS = ["M1", "F1", "M2", "F2", "N"]
# An English line ending in one of these words is cut off.
FRAGMENT_WORDS = ["the", "a", "an", "and", "or", "to", "of", "if", "with", "for"]
# Narration tags kept as they are.
SAFE_TAGS = [
    "sigh", "laughing", "laughs", "uhm", "sarcasm", "robotic", "shouting", "whispering",
    "extremely fast", "short pause", "medium pause", "long pause",
]
# Narration moods collected from tags.
MOODS = [
    "mystery", "sensory", "tension", "suspense", "wonder", "urgent", "melancholic", "scared",
    "curious", "bored", "neutral", "warm", "formal", "reassuring", "energetic", "solemn",
    "intimate", "dramatic",
]
# Spellings of the same tag.
TAG_ALIASES = {"laughs": "laughing", "laugh": "laughing", "whisper": "whispering", "shout": "shouting"}
HAN = r"[\u4e00-\u9fff]"
# A private-use character that marks where to cut.
_CUT = "\ue000"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(_SPACES))


def words(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), f"{SPACE}+"), lambda w: w != "")


def squeeze(c: Column | str) -> Column:
    return F.array_join(words(c), " ")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def clean_line(c: Column | str) -> Column:
    """Line without markup, and the speaker named in a leading tag."""
    bare = F.regexp_replace(strip(c), r"<[^>]+>|\{[^}]+\}", "")
    tag = r"^\s*[\[(]([A-Za-z0-9_]+)[\])]\s*:?\s*"
    speaker = F.upper(F.regexp_extract(bare, tag, 1))
    return F.struct(
        squeeze(F.regexp_replace(bare, tag, "")).alias("text"),
        F.nullif(speaker, F.lit("")).alias("speaker"),
    )


def split_sentences(c: Column | str) -> Column:
    """Sentences with their punctuation; a dot inside a number does not end one."""
    marked = F.regexp_replace(squeeze(c), rf"({TERMINAL})(?=\s|\z)", f"$1{_CUT}")
    return F.filter(F.transform(F.split(marked, _CUT), lambda s: F.trim(s)), lambda s: s != "")


def has_terminal(c: Column | str) -> Column:
    return strip(c).rlike(rf"{TERMINAL}\z")


def join_text(left: Column | str, right: Column | str) -> Column:
    """Join two fragments; ellipses at the seam go away."""
    a, b = strip(left), strip(right)
    a = F.when(a.endswith("...") | a.endswith("…"), F.regexp_replace(a, r"[. …]+\z", "")).otherwise(a)
    b = F.when(b.startswith("...") | b.startswith("…"), F.regexp_replace(b, r"\A[. …]+", "")).otherwise(b)
    return strip(F.concat(a, F.lit(" "), b))


def norm_for_match(c: Column | str) -> Column:
    """Letters, digits and underscore only, case folded."""
    kept = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[^\p{L}\p{N}_]", "")
    return F.regexp_replace(F.lower(kept), "ß", "ss")


def norm_ocr(c: Column | str) -> Column:
    """No whitespace at all and no punctuation at the edges."""
    solid = F.regexp_replace(F.coalesce(_col(c), F.lit("")), SPACE, "")
    return F.regexp_replace(solid, r"\A[，。！？,.?!;；:：]+|[，。！？,.?!;；:：]+\z", "")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, which has no native counterpart."""
    return pd.Series(
        [None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)],
        dtype="float64",
    )


@F.pandas_udf(T.BooleanType())
def alike(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Whether the similarity reaches ``least``. Signs that both have bound it, which rules most pairs out."""

    def reaches(x: str, y: str, need: float) -> bool:
        shared = sum(min(x.count(c), y.count(c)) for c in set(x))
        return 2.0 * shared / (len(x) + len(y)) >= need and SequenceMatcher(None, x, y).ratio() >= need

    return pd.Series([None if not x or not y else reaches(x, y, need) for x, y, need in zip(a, b, least)], dtype="object")


def may_be_same(a: Column, b: Column) -> Column:
    """Whether the lengths of two normalised texts allow ``same_normalised``."""
    least = F.least(F.length(a), F.length(b))
    return (least >= 2) & (least * 2 / (F.length(a) + F.length(b)) >= _needed(a, b))


def _needed(a: Column, b: Column) -> Column:
    return F.when(F.least(F.length(a), F.length(b)) <= 4, F.lit(0.90)).otherwise(F.lit(0.84))


def same_normalised(a: Column, b: Column) -> Column:
    """``same_text`` for texts that ``norm_for_match`` has been through."""
    near = F.coalesce(alike(F.when((a != b) & may_be_same(a, b), a), b, _needed(a, b)), F.lit(False))
    return may_be_same(a, b) & ((a == b) | near)


def same_text(expected: Column | str, observed: Column | str) -> Column:
    """Fuzzy equality for recognised text; short strings must be closer.

    Equal strings and pairs whose lengths already rule a match out are decided natively; only
    the others reach the similarity function, behind a bound by the signs that both have.
    """
    return same_normalised(norm_for_match(expected), norm_for_match(observed))


def safe_stem(c: Column | str, length: int = 80, fallback: str = "video") -> Column:
    """File stem that is valid on every system."""
    given = F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(fallback))
    name = F.regexp_extract(F.regexp_replace(given, "/+$", ""), r"(?s)([^/]*)\z", 1)
    stem = F.regexp_replace(name, r"(?s)\A(.+)\.[^.]+\z", "$1")
    clean = F.regexp_replace(stem, "[^A-Za-z0-9À-ỹ一-龥_ .-]+", "_")
    clean = F.regexp_replace(clean, r"\A[ ._]+|[ ._]+\z", "")
    return F.left(F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback)), F.lit(length))


def safe_name(c: Column | str) -> Column:
    clean = F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[^A-Za-z0-9._-]+", "_")
    clean = F.regexp_replace(clean, r"\A[._]+|[._]+\z", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("video"))


def norm_path_name(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"""[\\/:*?"<>| \n\r]+""", "")


def path_title(c: Column | str) -> Column:
    short = F.left(norm_path_name(c), F.lit(40))
    return F.when(strip(short) == "", F.lit("无标题")).otherwise(short)


def path_nick(c: Column | str) -> Column:
    return F.left(norm_path_name(c), F.lit(20))


def escape_markdown(c: Column | str) -> Column:
    return F.coalesce(F.regexp_replace(_col(c), r"([_*\[\]`])", r"\\$1"), F.lit(""))


def strip_controls(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def han_count(c: Column | str, han: str = HAN) -> Column:
    return F.regexp_count(_col(c), F.lit(han))


def has_han(c: Column | str, han: str = HAN) -> Column:
    return _col(c).rlike(han)


def is_cover_text(c: Column | str, han: str = HAN) -> Column:
    return han_count(c, han) >= 2


def cps(text: Column | str, duration_ms: Column | str) -> Column:
    """Characters per second; the duration counts as 1 ms at least."""
    return F.length(strip(text)) / F.greatest(_col(duration_ms) / F.lit(1000.0), F.lit(0.001))


def last_word_fragment(c: Column | str) -> Column:
    text = strip(c)
    last = F.lower(F.regexp_replace(F.try_element_at(words(c), F.lit(-1)), "[^A-Za-z]", ""))
    return (text.endswith("...") | text.endswith("…") | F.coalesce(last.isin(FRAGMENT_WORDS), F.lit(False)))


# Causes in their order of preference; each has word groups, and a message with all words of a group has the cause.
MODEL_CAUSES = {
    "key": [["api_key"], ["api key"], ["invalid", "key"]],
    "quota": [["quota"], ["rate limit"], ["resource_exhausted"]],
    "permission": [["permission"], ["forbidden"]],
    "model": [["not found", "model"]],
    "size": [["too large"], ["payload"]],
    "timeout": [["timeout"], ["deadline"]],
    "connection": [["connection"], ["network"]],
}
DOWNLOAD_CAUSES = {
    "login": [["cookies"], ["login"]],
    "not_found": [["not found"], ["unavailable"]],
    "geo": [["geo"], ["region"]],
}
# Names whose values are credentials, and the longest message shown.
CREDENTIALS = ["api_key", "api-key", "apikey", "key", "token", "authorization"]
SHOWN = 800


def _cause(c: Column | str, causes: dict[str, list[list[str]]]) -> Column:
    """The first cause with a group of which the message has every word, else ``other``."""
    message = F.lower(_col(c))
    met = [
        F.when(reduce(or_, (reduce(and_, (message.contains(word) for word in group)) for group in groups)), cause)
        for cause, groups in causes.items()
    ]
    return F.coalesce(*met, F.lit("other"))


def classify_model_error(c: Column | str) -> Column:
    """Cause of a failed model call."""
    return _cause(c, MODEL_CAUSES)


def classify_download_error(c: Column | str) -> Column:
    """Cause of a failed download."""
    return _cause(c, DOWNLOAD_CAUSES)


def redact(c: Column | str, secrets: list[str] | None = None) -> Column:
    """Hide known secrets and the values of credentials, then shorten."""
    message = F.coalesce(_col(c), F.lit(""))
    for secret in secrets or []:
        message = F.replace(message, F.lit(secret), F.lit("[REDACTED]"))
    value = rf"""(?i)((?:{'|'.join(CREDENTIALS)})\s*[=:]\s*)[^\s,}}"]+"""
    return F.left(F.regexp_replace(message, value, "$1[REDACTED]"), F.lit(SHOWN))


def performance_markup(c: Column | str) -> Column:
    """Keep safe narration tags, collect moods once, drop all other tags."""
    text = strip(F.coalesce(_col(c), F.lit("")))
    pattern = r"\[([^\[\]]{1,40})\]"

    def canonical(tag: Column) -> Column:
        plain = F.translate(F.lower(strip(tag)), "_-", "  ")
        named = plain
        for alias, target in TAG_ALIASES.items():
            named = F.when(plain == alias, F.lit(target)).otherwise(named)
        return named

    tags = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), canonical)
    shown = F.transform(tags, lambda t: F.when(t.isin(SAFE_TAGS), F.concat(F.lit("["), t, F.lit("]"))).otherwise(""))
    pieces = F.split(text, pattern, -1)
    rebuilt = F.array_join(F.zip_with(pieces, shown, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    return F.struct(
        strip(F.regexp_replace(rebuilt, "[ \t]{2,}", " ")).alias("text"),
        F.array_distinct(F.filter(tags, lambda t: t.isin(MOODS))).alias("cues"),
    )


def valid_id(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"\A[A-Za-z0-9_-]{6,64}\z"), F.lit(False))
