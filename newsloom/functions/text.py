"""Text functions as Column expressions; one narrow Arrow UDF for characters that no built-in decomposes."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _ranges(points: list[int]) -> str:
    out, k = [], 0
    while k < len(points):
        a = b = points[k]
        while k + 1 < len(points) and points[k + 1] == b + 1:
            k, b = k + 1, b + 1
        out.append(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if b > a else f"\\x{{{a:x}}}")
        k += 1
    return "".join(out)


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, str]:
    """(characters, the one character that each decomposes to, a pattern that finds at least those that become several)."""
    one, to, several = [], [], []
    for cp in (*range(0x80, 0xD800), *range(0xF900, 0x10000)):
        c = chr(cp)
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if d == c or unicodedata.combining(c):
            continue
        if len(d) == 1:
            one.append(c)
            to.append(d)
        else:
            several.append(cp)
    # a short pattern: what Latin text and its punctuation hold is listed, all else may be rare
    low = _ranges([c for c in several if c < 0x250])
    return "".join(one), "".join(to), rf"[{low}]|[^\x{{0}}-\x{{24f}}\x{{2013}}-\x{{2014}}\x{{2018}}-\x{{201e}}\x{{20ac}}]"


def strip_marks_py(text: str) -> str:
    if text.isascii():
        return text
    return _BEYOND_ASCII.sub(lambda m: "".join(c for c in m[0] if not unicodedata.combining(c)), unicodedata.normalize("NFKD", text))


_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")
_NO_WORD = re.compile(r"[^\w\s]+")
_ASCII_SIGNS = {k: None for k in range(128) if not (chr(k).isalnum() or chr(k).isspace() or chr(k) == "_")}


def normalize_py(text: str) -> str:
    """normalize_text in plain Python: for rare characters, tests, and what works on Python strings anyway."""
    bare = text.translate(_ASCII_SIGNS) if text.isascii() else _NO_WORD.sub("", strip_marks_py(text))
    return " ".join(bare.split()).lower()


def _decompose_rare(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else strip_marks_py(t))

    return run(text)


def normalize_text(text: Column) -> Column:
    """Compatibility decomposition, marks and punctuation dropped, white space as one space, lower case.

    ASCII texts take a short way; of others only those with rare characters meet the UDF.
    """
    one, to, several = _decompositions()
    ascii_only = text.rlike(r"^\p{ASCII}*$")
    rare = _decompose_rare(F.when(~ascii_only & text.rlike(several), text))
    bare = F.regexp_replace(F.coalesce(rare, F.translate(text, one, to)), r"\p{M}+", "")
    bare = F.regexp_replace(bare, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]+", "")
    general = F.regexp_replace(bare, r"(?U)[\s\x1c-\x1f]+", " ")
    short = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_\s\x1c-\x1f]+", ""), r"[\s\x1c-\x1f]+", " ")
    return F.lower(F.trim(F.when(ascii_only, short).otherwise(general)))


def tokens(normalized: Column) -> Column:
    """Words of normalised text; an underscore is a token of its own, so that no phrase spans it."""
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(normalized, "_", " _ "), " +", " ")), " ")


def clean_newlines(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def sanitize(value: Column, kind: str) -> Column:
    """Nested values as JSON, null as the empty string, others as strings."""
    return F.coalesce(F.to_json(value) if kind.startswith(("struct", "array", "map")) else value.cast("string"), F.lit(""))


def keep_tokens(text: Column, stop: list[str]) -> Column:
    """Words that are letters and digits only and no stop words."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    stops = F.array(*[F.lit(s) for s in stop])
    return F.filter(words, lambda w: w.rlike(r"^[\p{L}\p{N}]+$") & ~F.array_contains(stops, F.lower(w)))


def backoff(wait: Column, attempt: Column, most: float = 300.0) -> Column:
    return F.least(wait * F.pow(F.lit(2.0), attempt), F.lit(most))


def moments(at: Column) -> dict[str, Column]:
    """The forms that times are stored in: formatted text, epoch seconds and year."""
    return {"crawled_at": F.date_format(at, "yyyy-MM-dd HH:mm:ss"), "epoch": F.unix_seconds(at), "year": F.year(at)}


def years(since: int, now: Column) -> Column:
    """All years from a first one to that of now."""
    return F.sequence(F.lit(since), F.year(now))
