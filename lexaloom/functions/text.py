"""Text functions: each takes and returns Columns, and has a plain-Python twin
where the driver needs one (the query compiler)."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The token alphabet, the headings that end an article, the stemmer's endings.
TOKEN_CHARS = "0-9A-Za-zА-Яа-яЁё"
TAIL_HEADINGS = ("Ссылки", "Примечания", "Литература", "Источники", "См. также", "Внешние ссылки")
REFLEXIVE = ("ся", "сь")
ENDINGS = (
    "иями", "ями", "ами", "ыми", "ими",
    "ого", "его", "ому", "ему",
    "ых", "их", "ах", "ях", "ов", "ев", "ом", "ем", "ам", "ям", "ую", "юю", "ая", "яя", "ое", "ее", "ый", "ий", "ые", "ие",
    "а", "я", "о", "е", "ы", "и", "у", "ю",
)
SIGNS = ("ь", "ъ")
#: Bytes that must be left of a word after an ending is cut off.
STEM_BYTES = 6

TOKEN_PATTERN = f"[{TOKEN_CHARS}]+"
#: Unicode white space, as str.strip() removes it.
WHITE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, f"\\A[{WHITE}]+|[{WHITE}]+\\z", "")


def valid_text(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD, which separates tokens."""
    return F.make_valid_utf8(content.cast("string"))


def tokens(text: Column) -> Column:
    """Maximal runs of token characters in order, lower-cased after they are cut out
    (so that letters outside the alphabet never fold into it). Null: no tokens."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.transform(found, F.lower)


def _cut(word: Column, endings: tuple[str, ...]) -> Column:
    cut = F.regexp_replace(word, f"(?:{'|'.join(endings)})$", "")
    return F.when(F.octet_length(cut) >= STEM_BYTES, cut).otherwise(word)


def stems(words: Column) -> Column:
    """Stems of an array of lower-case tokens. Three cuts, each only if STEM_BYTES
    bytes remain: a reflexive ending, the longest ending that fits (no shorter one
    instead), a sign. Tokens with a digit, without Cyrillic or of few bytes stay; an array of such tokens only is returned as it is."""

    def stays(w: Column) -> Column:
        ascii_only = F.octet_length(w) == F.char_length(w)
        return (F.octet_length(w) < STEM_BYTES) | ascii_only | w.rlike("[0-9]") | ~w.rlike("[а-яё]")

    def without(endings: tuple[str, ...]):
        return lambda w: F.when(stays(w), w).otherwise(_cut(w, endings))

    cut = F.transform(F.transform(F.transform(words, without(REFLEXIVE)), without(ENDINGS)), without(SIGNS))
    return F.when(F.exists(words, lambda w: ~stays(w)), cut).otherwise(words)


def stem(word: Column) -> Column:
    return F.element_at(stems(F.array(word)), 1)


def stem_word(word: str) -> str:
    """The driver's twin of :func:`stem`."""
    if re.search("[0-9]", word) or not re.search("[а-яё]", word):
        return word
    for endings in (REFLEXIVE, ENDINGS, SIGNS):
        cut = re.sub(f"(?:{'|'.join(endings)})$", "", word)
        if len(cut.encode()) >= STEM_BYTES:
            word = cut
    return word


def clean_tail(text: Column) -> Column:
    """Cut at the earliest of the closing headings and stripped; texts without one stay as they are."""
    marker = "\\n(?:" + "|".join(re.escape(h).replace("\\ ", " ") for h in TAIL_HEADINGS) + ")\\n"
    return F.when(text.rlike(marker), strip(F.regexp_replace(text, f"(?s){marker}.*\\z", ""))).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Scripts, styles and tags become blanks, breaks and paragraph ends line feeds;
    entities are left alone. Null is empty."""
    out = F.coalesce(html, F.lit(""))
    for pattern, instead in (
        ("(?is)<script.*?>.*?</script>", " "), ("(?is)<style.*?>.*?</style>", " "), ("(?i)<br\\s*/?>", "\n"), ("(?i)</p\\s*>", "\n"),
        ("<[^>]+>", " "), ("\\xA0", " "), ("[ \\t\\r\\f\\x0B]+", " "),
    ):
        out = F.regexp_replace(out, pattern, instead)
    return F.regexp_replace(strip(out), "\n{3,}", "\n\n")


def html_bytes_to_text(html: Column) -> Column:
    """As html_to_text, of bytes whose invalid parts are left out."""
    return html_to_text(F.replace(valid_text(html), F.lit("�"), F.lit("")))


def human_bytes(n: Column) -> Column:
    """`N B`, from 1024 on with the size in KB, MB or GB of 1024 each."""
    size = n.cast("double")
    power = F.when(size < 1024**2, 1).when(size < 1024**3, 2).otherwise(3)
    unit = F.element_at(F.array(F.lit("KB"), F.lit("MB"), F.lit("GB")), power)
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(F.format_string("%d B (%.2f %s)", n, size / F.pow(F.lit(1024.0), power), unit))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def leading_doc_id(name: Column) -> Column:
    """The number that a file name begins with (eight digits at most), else 0."""
    return F.coalesce(F.regexp_extract(name, "^[0-9]{1,8}", 0).try_cast("int"), F.lit(0))


def backoff_seconds(tries: Column) -> Column:
    """Seconds until the next try after a failure, ``tries`` failures before it: 2, 4, 8, ... 3600 at most."""
    return F.least(F.lit(3600.0), F.pow(F.lit(2.0), F.least(tries + 1, F.lit(12)))).cast("long")


def page_url(pattern: str, page_id: Column) -> Column:
    return F.replace(F.lit(pattern), F.lit("{pageid}"), page_id.cast("string"))


# Start and multiplier of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)


def fnv1a64_hex(text: Column) -> Column:
    """16 hexadecimal digits of the 64-bit FNV-1a hash of the UTF-8 bytes; SQL has no wrapping multiplication."""
    @F.pandas_udf("string")
    def hashed(values: pd.Series) -> pd.Series:
        # one byte of all values at a time; values of fewer bytes drop out, the longest first
        raw = [v.encode() for v in values.fillna("")]
        order = np.argsort([-len(r) for r in raw], kind="stable")
        sizes = np.array([len(raw[i]) for i in order], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(raw[i] for i in order), np.uint8).astype(np.uint64)
        h = np.full(len(raw), FNV_OFFSET, np.uint64)
        for k in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -k, side="left"))
            h[:n] = (h[:n] ^ flat[starts[:n] + k]) * FNV_PRIME
        out = np.empty(len(raw), object)
        out[order] = [f"{x:016x}" for x in h.tolist()]
        return pd.Series(out, index=values.index).where(values.notna(), None)

    return hashed(text)
