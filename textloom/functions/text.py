"""Text functions as Column builders. Lengths are code points; null stays null."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The rules of the cleaning steps. (?U) makes \w and \s follow Unicode.
TAG = r"<[^>]+>"
#: In this order, so that "&amp;lt;" becomes "&lt;" and not "<".
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"))
URL = r"(?U)https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+[/\w\-._~:/?#\[\]@!$&'()*+,;=%]*"
EMAIL = r"(?U)[\w\.-]+@[\w\.-]+\.\w+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
SPACE = r"(?U)\s+"
HAN = r"[\x{4e00}-\x{9fff}]"
HAN_EXTENDED = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"
#: Stands between the sides of a pair in its hash.
PAIR_MARK = "|||"


#: A character that may not be its own normal form, or may join the one before: not ASCII, plain Latin, Cyrillic or unified ideographs.
ODD = r"[^\x00-\x7F\x{C0}-\x{131}\x{134}-\x{13E}\x{400}-\x{482}\x{4E00}-\x{9FFF}]"
#: Texts that are Python's at once.
TOGETHER = 64


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    parts = (texts.slice(i, TOGETHER).to_pylist() for i in range(0, len(texts), TOGETHER))
    return pa.concat_arrays([pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in part], pa.string()) for part in parts] or [pa.array([], pa.string())])


def normalize_nfkc(c: Column) -> Column:
    """Unicode NFKC. Texts of characters that are their own normal form never leave the JVM."""
    odd = c.rlike(ODD)
    # Functions of Python get all rows, so others are null there.
    return F.when(odd, _nfkc(F.when(odd, c))).otherwise(c)


def strip_html(c: Column) -> Column:
    """Tags go, then six entities are decoded, so encoded tags survive as text."""
    out = F.regexp_replace(c, TAG, "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, "")


def strip_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, "")


def strip_control(c: Column) -> Column:
    """Control characters go; tab and line ends stay."""
    return F.regexp_replace(c, CONTROL, "")


def collapse_space(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def clean_text(c: Column, nfkc: bool = True, html: bool = True, urls: bool = True) -> Column:
    """NFKC, tags, URLs and mail addresses, control characters, white space: in this order."""
    out = normalize_nfkc(c) if nfkc else c
    out = strip_html(out) if html else out
    out = strip_emails(strip_urls(out)) if urls else out
    return collapse_space(strip_control(out))


def wmt_normalize(c: Column, spaced: bool = True, nfkc: bool = True) -> Column:
    """NFKC, then all characters of Unicode category C go (line ends and tabs too), then white space: one space, or none."""
    out = F.regexp_replace(normalize_nfkc(c) if nfkc else c, r"\p{C}", "")
    return collapse_space(out) if spaced else F.regexp_replace(out, SPACE, "")


def words(c: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def cjk_count(c: Column) -> Column:
    """Han characters of the basic block and extension A."""
    return F.regexp_count(c, F.lit(HAN_EXTENDED))


def contains_han(c: Column) -> Column:
    return c.rlike(HAN)


def mostly_han(c: Column, share: float = 0.3) -> Column:
    """More than share of the characters are of the basic Han block."""
    return F.regexp_count(c, F.lit(HAN)) > F.lit(share) * F.length(c)


def tokens(c: Column) -> Column:
    """Characters without spaces where a text is mostly Han, else words."""
    return F.when(mostly_han(c), F.split(F.replace(c, F.lit(" "), F.lit("")), "")).otherwise(words(c))


def pair_hash(src: Column, tgt: Column) -> Column:
    """MD5 that two equal pairs share; spaces at the ends don't count."""
    return F.md5(F.concat(F.trim(src), F.lit(PAIR_MARK), F.trim(tgt)).cast("binary"))


def cache_key(text: Column, direction: Column | None = None) -> Column:
    return F.md5((text if direction is None else F.concat_ws(":", direction, text)).cast("binary"))


def prefix(c: Column, n: int = 50) -> Column:
    return F.substring(c, 1, n)


def preview(c: Column, n: int = 50) -> Column:
    """The first n characters, with dots if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def language_by_script(c: Column) -> Column:
    """zh where a text is mostly Han, xx where it has no letter, else en: the native stand-in for a language detector."""
    return F.when(mostly_han(c), "zh").when(~c.rlike(r"\p{L}"), "xx").otherwise("en")


def detect_language(c: Column, detector) -> Column:
    """Languages by a callable str -> str in Arrow batches; where it raises, null."""

    def one(text: str) -> str | None:
        try:
            return detector(text)
        except Exception:  # noqa: BLE001  the callable is the user's; a text that it can't judge counts as unknown
            return None

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return run(c)


def format_time(seconds: Column) -> Column:
    """Seconds with one digit below a minute, minutes below an hour, else hours."""
    s = seconds.cast("double")
    return F.when(s < 60, F.format_string("%.1fs", s)).when(s < 3600, F.format_string("%.1fm", s / 60)).otherwise(F.format_string("%.1fh", s / 3600))


def clock(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def term_line(source: Column, target: Column) -> Column:
    """A glossary line: "a" -> "b" with an arrow."""
    return F.format_string('"%s" → "%s"', source, target)
