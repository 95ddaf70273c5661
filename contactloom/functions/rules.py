"""Validation and classification as ordered conditional expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom.functions import values as V
from contactloom.functions.text import domain_after_first, domain_part, local_part


def any_of(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def tld(domain: Column) -> Column:
    return F.when(domain.contains("."), F.lower(F.substring_index(domain, ".", -1)))


def is_valid_address(c: Column) -> Column:
    """V1: ASCII local part, Latin or Cyrillic last label."""
    return F.regexp_like(c, F.lit("^[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-zА-Яа-яЁё]{2,}$"))


def is_valid_local(local: Column) -> Column:
    """V2."""
    return (
        F.length(local).between(1, 64)
        & ~local.startswith(".")
        & ~local.endswith(".")
        & ~local.contains("..")
        & F.regexp_like(local, F.lit("^[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+$"))
    )


def is_valid_domain(domain: Column) -> Column:
    """V3: lengths, hyphens, characters, and a known last label."""
    label = lambda x: F.length(x).between(1, 63) & ~x.startswith("-") & ~x.endswith("-") & F.regexp_like(x, F.lit("^[A-Za-z0-9-]+$"))
    return (F.length(domain) <= 253) & F.forall(F.split(domain, "\\."), label) & F.coalesce(tld(domain).isin(V.KNOWN_TLDS), F.lit(False))


def strict_reason(c: Column) -> Column:
    """V4: the first reason why an address is refused, or null."""
    a = F.trim(c)
    local, domain = local_part(a), domain_after_first(a)
    labels = F.split(domain, "\\.")
    return (
        F.when(F.length(a) - F.length(F.replace(a, F.lit("@"), F.lit(""))) != 1, "no_at_sign")
        .when((local == "") | (domain == ""), "empty_local_or_domain")
        .when(~F.regexp_like(local, F.lit("^[\\x00-\\x7F]*$")), "local_not_ascii")
        .when(local.startswith(".") | local.endswith("."), "local_edge_dot")
        .when(local.contains(".."), "local_consecutive_dots")
        .when(~F.regexp_like(local, F.lit("^[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+$")), "local_bad_chars")
        .when(~domain.contains("."), "domain_bad_shape")
        .when(F.exists(labels, lambda x: F.length(x) > 63), "domain_label_size")
        .when(F.length(domain) > 253, "domain_too_long")
        .when(F.exists(labels, lambda x: x == "") | (F.length(F.substring_index(domain, ".", -1)) < 2), "domain_bad_shape")
        .when(F.exists(labels, lambda x: x.startswith("-") | x.endswith("-")), "domain_label_dash")
        .when(~F.regexp_like(domain, F.lit("^[a-z0-9.-]+$")), "domain_bad_shape")
    )


def is_allowed_tld(domain: Column, allowed=("ru", "com")) -> Column:
    """V5."""
    return F.coalesce(tld(domain).isin(*allowed), F.lit(False))


def is_foreign_tld(domain: Column, allowed=("ru", "com")) -> Column:
    """V5: false where there is no last label at all."""
    return F.coalesce(~tld(domain).isin(*allowed), F.lit(False))


def tld_class(c: Column, domestic=("ru", "su", "by", "kz"), generic=("com", "org", "net")) -> Column:
    """V6."""
    t = tld(domain_after_first(c))
    return F.when(t.isin(*domestic), "domestic").when(t.isin(*generic), "generic").otherwise("foreign")


def domain_class(c: Column) -> Column:
    """V7: personal providers first, then local endings."""
    a = F.lower(F.trim(c))
    d = F.regexp_extract(a, "^[^@ \\t\\r\\n]+@([a-z0-9.-]+\\.[a-z0-9-]+)$", 1)
    return (
        F.when(F.coalesce(d, F.lit("")) == "", "unknown").when(d.isin(V.GLOBAL_MAIL), "global_mail").when(F.substring_index(d, ".", -1).isin(V.RU_LIKE), "ru_like").otherwise("foreign_corporate")
    )


def is_foreign_address(c: Column) -> Column:
    """V8: by endings, with domains that count as local."""
    d = F.coalesce(domain_part(c), F.lit(""))
    return ~(d.isin(V.LOCAL_EXTRA) | reduce(lambda a, b: a | b, [d.endswith(e) for e in V.LOCAL_ENDINGS]))


def role_score(local: Column, domain: Column, context: Column) -> Column:
    """V9: struct of class, score and reason.

    A whole local part, a fragment, or a word of it that names a role decides, in
    this order; otherwise the words of the domain, the shape of a person's name
    and the context move the score from a half.
    """
    low = F.lower(F.trim(F.coalesce(local, F.lit(""))))
    words = F.array(*[F.lit(w) for w in (*V.ROLE_WORDS, *V.ROLE_FRAGMENTS)])
    parts = lambda c: F.split(F.lower(c), "[._+-]")
    bad = (low == "") | low.contains("@")
    whole = F.regexp_like(low, F.lit(f"^(?:{V.ROLE_LOCAL})$"))
    inside = F.regexp_like(low, F.lit(f"(?<![A-Za-zА-Яа-яЁё0-9])(?:{'|'.join(V.ROLE_FRAGMENTS)})(?![A-Za-zА-Яа-яЁё])"))
    token = F.arrays_overlap(parts(low), words)
    ctx = F.lower(F.coalesce(context, F.lit("")))
    at_domain = F.arrays_overlap(parts(F.trim(F.coalesce(domain, F.lit("")))), words)
    named = F.regexp_like(low, F.lit(V.NAME_SHAPE))
    author = F.regexp_like(ctx, F.lit(V.AUTHOR_CONTEXT))
    dept = F.regexp_like(ctx, F.lit(V.ROLE_CONTEXT))
    add = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + add(at_domain, -0.15) + add(named, 0.25) + add(author, 0.15) + add(dept, -0.2)))
    score = F.round(score, 3)
    reason = F.concat_ws(",", F.when(at_domain, F.lit("role-domain")), F.when(named, F.lit("fio-like")), F.when(author, F.lit("author-context")), F.when(dept, F.lit("dept-context")))
    role = whole | inside | token
    final = F.when(bad, F.lit(0.5)).when(role, F.lit(0.0)).otherwise(score)
    return F.struct(
        F.when(bad, "unknown").when(role | (score <= 0.35), "role").when(score >= 0.65, "personal").otherwise("unknown").alias("role_class"),
        final.alias("role_score"),
        F.when(bad, "invalid-local").when(whole, "role-local").when(inside, "role-fragment").when(token, "role-local").when(reason == "", "baseline").otherwise(reason).alias("role_reason"),
    )


def is_role(c: Column) -> Column:
    """V10."""
    return role_score(local_part(c), domain_part(c), F.lit(""))["role_class"] == "role"


def name_score(local: Column, first: Column, last: Column) -> Column:
    """How well a local part fits a name, by the best of its usual spellings."""
    low = F.lower(local)
    f, s = F.lower(first), F.lower(last)
    i = F.substring(f, 1, 1)
    exact = reduce(lambda a, b: a | b, [low == F.concat(x, F.lit(sep), y) for sep in (".", "_", "-", "") for x, y in ((f, s), (s, f))])
    initial = reduce(lambda a, b: a | b, [low == F.concat(x, F.lit(sep), y) for sep in (".", "_", "-", "") for x, y in ((i, s), (s, i))])
    return F.when(exact, 1.0).when(low.contains(F.concat(f, s)) | low.contains(F.concat(s, f)), 0.97).when(initial, 0.92).when(low == s, 0.9).when((F.length(s) >= 4) & low.contains(s), 0.88).otherwise(0.0)


def source_context(snippet: Column) -> Column:
    """V12."""
    s = F.lower(snippet)
    return (
        F.when(s.contains("mailto:"), "mailto")
        .when(any_of(s, ["corresponding author", "for correspondence"]), "corresponding")
        .when(any_of(s, ["author", "автор"]), "author")
        .when(any_of(s, ["<footer", "copyright", "©"]), "footer")
        .when(any_of(s, ["contact", "контакт"]), "contacts")
        .otherwise("unknown")
    )


def is_suspicious_local(local: Column) -> Column:
    """Five digits first, or mostly digits."""
    return F.regexp_like(local, F.lit("^[0-9]{5}")) | (F.regexp_count(local, F.lit("[0-9]")) > F.length(local) * 0.7)


def is_numeric_local(local: Column) -> Column:
    return F.regexp_like(local, F.lit("^[0-9]+$"))


def has_service_prefix(c: Column) -> Column:
    """V14."""
    return F.regexp_like(F.lower(c), F.lit("^(admin|contact|info|mail|office|postmaster|sales|support|test|webmaster)"))


def is_left_boundary(ch: Column) -> Column:
    """Blanks, punctuation and bullets, but not what holds parts of an address together; nothing is one, too."""
    return F.coalesce(ch == "", F.lit(True)) | (F.regexp_like(ch, F.lit("^[\\p{Z}\\p{P}•·⋅◦]$")) & ~F.regexp_like(ch, F.lit("^[._%+\\-'~=/]$")))


def has_prefix_row(text: Column) -> Column:
    """A document numbers its addresses: three marked ones at least, or two marks that occur twice each.

    A mark is the first character of a local part that has a boundary on its left.
    """
    shape = F.lit("(.)([A-Za-z0-9])([A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+)@")
    pairs = F.arrays_zip(F.regexp_extract_all(text, shape, F.lit(1)).alias("left"), F.regexp_extract_all(text, shape, F.lit(2)).alias("mark"))
    marks = F.transform(F.filter(pairs, lambda p: is_left_boundary(p["left"])), lambda p: p["mark"])
    again = F.filter(F.array_distinct(marks), lambda m: F.size(F.filter(marks, lambda x: x == m)) >= 2)
    return F.coalesce((F.size(marks) >= 3) | (F.size(again) >= 2), F.lit(False))


def candidate_score(domain: Column) -> Column:
    """One for a known last label."""
    return F.when(tld(domain).isin(V.KNOWN_TLDS), 1).otherwise(0)


def smtp_code(code: Column, message: Column) -> Column:
    """The code, or the first number of three digits in the message."""
    text = F.regexp_extract(F.coalesce(message, F.lit("")), "(^|[^0-9A-Za-z_])([0-9]{3})($|[^0-9A-Za-z_])", 2)
    return F.coalesce(code.cast("int"), F.nullif(text, F.lit("")).cast("int"))


def bounce_class(code: Column, message: Column) -> Column:
    """5xx hard, 4xx soft, else by phrases, hard ones first."""
    n, m = smtp_code(code, message), F.lower(F.coalesce(message, F.lit("")))
    return F.when(n.between(500, 599), "hard").when(n.between(400, 499), "soft").when(any_of(m, V.HARD_PHRASES), "hard").when(any_of(m, V.SOFT_PHRASES), "soft").otherwise("unknown")


def outcome_of(reason: Column, default: str = "error") -> Column:
    """An outcome itself, else the first rule of parts that fits."""
    v = F.lower(F.trim(F.coalesce(reason, F.lit(""))))
    return (
        F.when(v == "", default)
        .when(v.isin(V.OUTCOMES), v)
        .when(v.contains("cooldown"), "cooldown")
        .when(any_of(v, ["stop", "block", "foreign", "suppressed"]), "blocked")
        .when(any_of(v, ["duplicate", "daily_limit", "history", "unchanged", "skip"]), "unchanged")
        .when(any_of(v, ["bounce", "validator", "undeliverable", "invalid", "smtp_error"]), "undeliverable")
        .when(any_of(v, ["error", "exception", "timeout"]), "error")
        .otherwise(default)
    )


def decision(valid: Column, role: Column, blocked: Column, cooling: Column, policy: Column | None = None) -> Column:
    """The first reason not to send wins."""
    out = F.when(~valid, "SKIP_INVALID").when(role, "SKIP_ROLE").when(blocked, "SKIP_BLOCKED")
    if policy is not None:
        out = out.when(policy, "SKIP_DOMAIN_POLICY")
    return out.when(cooling, "SKIP_COOLDOWN").otherwise("SEND_NOW")


def looks_like_address(c: Column) -> Column:
    """V23."""
    return F.regexp_like(c, F.lit("^[^@ \\t\\r\\n]+@[^@ \\t\\r\\n]+\\.[^@ \\t\\r\\n]+$"))


def has_url_but_no_address(c: Column) -> Column:
    return F.regexp_like(c, F.lit("(?i)(https?://|www\\.)[^ ]+")) & ~c.contains("@")


def is_useful_section(prefix: Column) -> Column:
    """V24."""
    return F.regexp_like(F.lower(prefix), F.lit("(contact|about|team|staff|people|faculty|author|editor|company|kontakt)"))


def path_allowed(url: Column, prefixes: list[str]) -> Column:
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    return reduce(lambda a, b: a | b, [F.when(path == "", "/").otherwise(path).startswith(p) for p in prefixes]) if prefixes else F.lit(True)


def needs_ocr(text: Column, n_bytes: Column, least: int = 20, ratio: float = 0.001) -> Column:
    """Empty, short, or little text for its bytes."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t == "") | (F.length(t) < least) | (F.length(t) < n_bytes * ratio)


def zip_member_reason(name: Column, size: Column, packed: Column, encrypted: Column, depth: int = 3, ratio: int = 5000, big: int = 50 << 20) -> Column:
    """Why a member of an archive is refused, or null."""
    deep = F.length(name) - F.length(F.replace(name, F.lit("/"), F.lit("")))
    return (
        F.when(encrypted, "encrypted")
        .when(name.startswith("/") | name.contains(".."), "unsafe_path")
        .when(F.regexp_like(F.lower(name), F.lit("\\.(exe|dll|bat|cmd|js|vbs|scr|msi|com|jar)$")), "denied_suffix")
        .when(deep > depth, "too_deep")
        .when((size > big) & (size > packed * ratio), "bomb_ratio")
    )
