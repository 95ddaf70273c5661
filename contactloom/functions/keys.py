"""Keys of addresses.  They are not equivalent; choose one per operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom.functions import values as V
from contactloom.functions.text import domain_after_first, domain_part, local_part, normalize_confusables, preclean


def _split(c: Column) -> tuple[Column, Column]:
    a = F.lower(F.trim(c))
    return local_part(a), domain_after_first(a)


def _join(c: Column, local: Column, domain: Column) -> Column:
    return F.when(c.contains("@"), F.concat(local, F.lit("@"), domain)).otherwise(F.lower(F.trim(c)))


def _no_tag(local: Column) -> Column:
    return F.substring_index(local, "+", 1)


def _no_dots(local: Column) -> Column:
    return F.replace(local, F.lit("."), F.lit(""))


def provider_key(c: Column) -> Column:
    """Tags off at twelve providers, dots off at gmail and yandex; googlemail is gmail."""
    local, domain = _split(c)
    d = F.when(domain == "googlemail.com", "gmail.com").otherwise(domain)
    local = F.when(d.isin(V.PLUS_TAG), _no_tag(local)).otherwise(local)
    return _join(c, F.when(d.isin(V.IGNORE_DOTS), _no_dots(local)).otherwise(local), d)


def gmail_key(c: Column) -> Column:
    """Only gmail's dots and tags."""
    local, domain = _split(c)
    return _join(c, F.when(domain.isin(V.GMAIL), _no_dots(_no_tag(local))).otherwise(local), F.when(domain.isin(V.GMAIL), "gmail.com").otherwise(domain))


def stoplist_key(c: Column) -> Column:
    """gmail's dots, then tags; all else as it is."""
    local, domain = _split(c)
    return _join(c, F.when(domain.isin(V.GMAIL), _no_tag(_no_dots(local))).otherwise(local), F.when(domain.isin(V.GMAIL), "gmail.com").otherwise(domain))


def flagged_key(c: Column, gmail_dots: bool = True, gmail_plus: bool = True, other_plus: bool = False) -> Column:
    """C4: what to take off is chosen."""
    local, domain = _split(c)
    gmail = domain.isin(V.GMAIL)
    if gmail_plus:
        local = F.when(gmail, _no_tag(local)).otherwise(local)
    if gmail_dots:
        local = F.when(gmail, _no_dots(local)).otherwise(local)
    if other_plus:
        local = F.when(~gmail, _no_tag(local)).otherwise(local)
    return _join(c, local, F.when(gmail, "gmail.com").otherwise(domain))


def history_key(c: Column) -> Column:
    """Tags stay outside gmail."""
    return flagged_key(c)


def cooldown_key(c: Column) -> Column:
    """Gmail only."""
    return gmail_key(c)


def extraction_key(c: Column) -> Column:
    """C7 for ASCII: the first address in a text, gmail's rules."""
    return gmail_key(F.regexp_extract(preclean(c), "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[A-Za-z0-9]", 0))


def plain_key(c: Column) -> Column:
    """Case and blanks only."""
    return F.lower(F.trim(c))


def blocked_key(c: Column) -> Column:
    """Confusables, case; null unless it has the shape of an address."""
    a = F.lower(F.trim(normalize_confusables(c)))
    a = F.when(a.contains("<"), F.regexp_extract(a, "<([^<>]*)>", 1)).otherwise(a)
    return F.when(F.regexp_like(a, F.lit("^[a-z0-9._%+-]+@[a-z0-9-]+(\\.[a-z0-9-]+)+$")), a)


def blocklist_key(c: Column) -> Column:
    """C3 without leading dots and without one or two digits before a letter."""
    out = F.regexp_replace(stoplist_key(c), F.lit("^\\.+"), F.lit(""))
    return F.regexp_replace(out, F.lit("^[0-9]{1,2}([a-z])"), F.lit("$1"))


def service_key(c: Column) -> Column:
    """C11 for ASCII."""
    return stoplist_key(c)


def group_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def transport_address(c: Column) -> Column:
    """The local part untouched, the domain in lower case."""
    a = F.trim(c)
    return F.when(a.contains("@"), F.concat(F.substring(a, 1, F.length(a) - F.length(F.substring_index(a, "@", -1))), domain_part(a))).otherwise(a)


def edit_key(c: Column) -> Column:
    """C14: cleaned, footnote marks off, C2."""
    return gmail_key(F.regexp_replace(preclean(c), F.lit("^[¹²³⁰⁴-⁹]+"), F.lit("")))
