"""Text functions that need Unicode tables: vectorised UDFs over Arrow batches."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_NOTE = re.compile(r"[⁰¹²³⁴-⁹]+|\((?:[a-c]|[1-3])\)(?=\s|$|[.,;])")
_SPACED = re.compile(r"(?<![A-Za-z0-9])((?:[A-Za-z0-9] ){3,}[A-Za-z0-9])(?![A-Za-z0-9])")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility form, character references read."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", html.unescape(t)))


@F.pandas_udf(StringType())
def strip_diacritics(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def _idna2008(d: str) -> str | None:
    import idna

    try:
        return idna.encode(d, uts46=True).decode("ascii")
    except idna.IDNAError:
        return None


def _idna2003(d: str) -> str | None:
    try:
        return d.encode("idna").decode("ascii")
    except UnicodeError:
        return None


@F.pandas_udf(StringType())
def idna2008(s: pd.Series) -> pd.Series:
    """Domain in ASCII by UTS 46; null where that can't be."""
    return s.map(lambda d: None if d is None else _idna2008(d.lower()))


@F.pandas_udf(StringType())
def idna2003(s: pd.Series) -> pd.Series:
    return s.map(lambda d: None if d is None else _idna2003(d.lower()))


def drop_footnotes(text: str) -> str:
    """Superscripts and (a) marks go, but not those inside addresses."""
    out, at = [], 0
    for m in _EMAIL.finditer(text):
        out += (_NOTE.sub("", text[at : m.start()]), m[0])
        at = m.end()
    return "".join((*out, _NOTE.sub("", text[at:])))


@F.pandas_udf(StringType())
def remove_footnotes(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else drop_footnotes(t))


def collapse_spaced(text: str) -> str:
    """Letters set apart by single blanks, to a fixed point, whatever the length."""
    while True:
        new = _SPACED.sub(lambda m: m[1].replace(" ", ""), text)
        if new == text:
            return new
        text = new


@F.pandas_udf(StringType())
def collapse_spaced_tokens(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else collapse_spaced(t))


def parse_mail_date(s: str | None):
    """RFC 2822 date in UTC, or None."""
    from datetime import timezone
    from email.utils import parsedate_to_datetime

    try:
        d = parsedate_to_datetime(s)
    except (TypeError, ValueError):
        return None
    return d.astimezone(timezone.utc).replace(tzinfo=None) if d.tzinfo else d


def preprocess(c):
    """Footnotes, de-obfuscation before and after the compatibility form and marks, broken lines, glued addresses."""
    from contactloom.functions import text as T

    shown = T.deobfuscate(T.normalize_marks(nfkc(T.deobfuscate(remove_footnotes(c)))))
    return T.separate_addresses(T.join_fragments(T.join_hyphen_breaks(shown)))
