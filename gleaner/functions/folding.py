"""Text folding as built-in column expressions: accents, case, white space, keys and tokens.

The variants differ on purpose (in what becomes of ß and œ, of punctuation, of non-ASCII letters), so each
has a function of its own.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python's white space, as a Java character class.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"


@cache
def _marks() -> re.Pattern:
    """The combining characters, as a pattern."""
    runs, last = [], None
    for i in range(0x110000):
        if unicodedata.combining(chr(i)):
            if last is not None and i == last + 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
            last = i
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]+")


def _unmarked(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return _marks().sub("", unicodedata.normalize("NFKD", text))


#: For each byte its lower-case letter or digit, else a space.
_KEPT = bytes(ord(c) if (c := chr(i).lower()).isascii() and c.isalnum() else 32 for i in range(256))


def _words(raw: bytes) -> str:
    """The runs of letters and digits of ASCII text, lower-cased, one space between."""
    return b" ".join(raw.translate(_KEPT).split()).decode()


def ascii_key_of(text: str | None) -> str | None:
    """ascii_key() of a Python string."""
    if text is None:
        return None
    return _words(text.encode() if text.isascii() else unicodedata.normalize("NFKD", text).encode("ascii", "ignore"))


def phrase_key_of(text: str | None) -> str | None:
    """phrase_key() of a Python string."""
    return None if text is None else _words(_unmarked(text.casefold()).encode("ascii", "replace"))


def clean_lines_of(text: str | None) -> str | None:
    """clean_lines() of a Python string."""
    if text is None:
        return None
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    text = text.replace("\ufeff", "").replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")
    lines = [x for x in (re.sub(r"[ \t\f\v]+", " ", x).strip() for x in text.split("\n")) if not _BRAND.fullmatch(x)]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


_BRAND = re.compile(r"Powered by TCPDF(?: \(www\.tcpdf\.org\))?", re.IGNORECASE)


def _text_function(f):
    """A column function that applies f to each text in Arrow batches, none to a null."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return run


_drop_marks, _ascii_key, _phrase_key, _clean_lines = map(_text_function, (_unmarked, ascii_key_of, phrase_key_of, clean_lines_of))
_folded = _text_function(lambda t: _unmarked(t.casefold()))
_nfkc = _text_function(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t))


def drop_marks(c: Column) -> Column:
    """NFKD without combining marks. No built-in function decomposes; a use of one text is evaluated once."""
    return _drop_marks(c)


def nfkc(c: Column) -> Column:
    """The compatibility composition: ligatures, full-width letters and the like in their plain form."""
    return _nfkc(c)


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


#: The same characters, one by one.
_SPACES = "".join(c for c in map(chr, range(0x10000)) if c.isspace())


def strip(c: Column) -> Column:
    """Without white space at both ends; only the ends are read."""
    return F.btrim(c, F.lit(_SPACES))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"{SPACE}+", " "))


def squeeze_blanks(c: Column) -> Column:
    """Blanks inside lines squeezed and both ends stripped; line feeds stay."""
    return strip(F.regexp_replace(c, r"[ \t\r\f\x0B]+", " "))


def ascii_key(c: Column) -> Column:
    """Letters and digits of the ASCII form, lower-cased, one space between; ß and œ vanish."""
    return _ascii_key(c)


def topic_key(c: Column) -> Column:
    """As ascii_key, but spaces at the ends stay."""
    ascii_ = F.regexp_replace(drop_marks(c), r"[^\x00-\x7F]+", "")
    return F.regexp_replace(F.lower(ascii_), "[^a-z0-9]+", " ")


def question_fold(c: Column) -> Column:
    """Marks dropped, lower case, white space squeezed; punctuation, ß and œ stay."""
    return squeeze(F.lower(drop_marks(c)))


def phrase_key(c: Column) -> Column:
    """Case-folded (ß is ss), marks dropped, all but letters and digits to one space."""
    return _phrase_key(c)


@F.pandas_udf(T.ArrayType(T.StringType()))
def phrase_keys(phrases: pd.Series) -> pd.Series:
    """phrase_key() of each phrase of an array; null phrases are left out."""
    return phrases.map(lambda x: [phrase_key_of(p) for p in x if p is not None], na_action="ignore")


def keyframe_key(c: Column) -> Column:
    ascii_ = F.regexp_replace(drop_marks(c), r"[^\x00-\x7F]+", "")
    return F.lower(F.regexp_replace(ascii_, r"\s+", " "))


def tokens(c: Column, pattern: str = "[a-z0-9]+", least: int = 2, stop: tuple[str, ...] = ()) -> Column:
    """The set of folded tokens of at least `least` characters, without stop words."""
    found = F.regexp_extract_all(_folded(F.coalesce(c, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))
    found = F.filter(found, lambda t: F.length(t) >= least)
    if stop:
        found = F.filter(found, lambda t: ~t.isin(*stop))
    return F.array_distinct(found)


#: Stop words of titles, of calibration texts and of screen labels.
TITLE_STOP = ("a", "au", "aux", "avec", "comment", "dans", "de", "des", "du", "et", "faire", "la", "le", "les", "pour", "un", "une")
CALIBRATION_STOP = ("avec", "cette", "dans", "depuis", "ensuite", "etape", "faire", "pour", "sous", "vous")
LABEL_STOP = ("avec", "dans", "pour", "sous", "texte", "bouton", "champ", "selectionnes")


def title_tokens(c: Column) -> Column:
    return tokens(c, "[a-z0-9]+", 2, TITLE_STOP)


def calibration_tokens(c: Column) -> Column:
    return tokens(c, "[a-z0-9]+", 3, CALIBRATION_STOP)


def label_tokens(c: Column) -> Column:
    return tokens(c, "[a-z]+", 4, LABEL_STOP)


def slug(c: Column, default: str = "video", most: int = 64) -> Column:
    ascii_ = F.regexp_replace(drop_marks(c), r"[^\x00-\x7F]+", "")
    made = F.substring(F.lower(F.regexp_replace(F.regexp_replace(ascii_, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")), 1, most)
    return F.when(made == "", default).otherwise(made)


def clean_lines(c: Column) -> Column:
    """NFKC, typographic noise out, lines and paragraphs kept: blanks squeezed in lines, blank runs to one."""
    return _clean_lines(c)


def chunk_hash(c: Column) -> Column:
    return F.sha2(strip(casefold(nfkc(c))), 256)


def spatial_terms(c: Column) -> Column:
    """The directions that a text names, in English or French, as a sorted set."""
    # fixed values: the words of each direction
    names = {
        "gauche": "left", "left": "left", "droite": "right", "right": "right", "haut": "top", "superieur": "top", "superieure": "top", "top": "top",
        "bas": "bottom", "inferieur": "bottom", "inferieure": "bottom", "bottom": "bottom", "centre": "center", "milieu": "center", "center": "center",
    }
    found = tokens(c, "[a-z]+", 1)
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda t: table[t]), lambda t: t.isNotNull())))


