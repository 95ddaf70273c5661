"""Text cleaning as Column expressions; all run inside whole-stage code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that look alike, invisible characters, dot-like marks.
CONFUSABLES_FROM = "аеорсукхвмтнАВЕКМНОРСТХ"
CONFUSABLES_TO = "aeopsykxvmthABEKMHOPCTX"
HOMOGLYPHS_FROM = "аоесрхуАОЕСРХ"
HOMOGLYPHS_TO = "aoecpxyAOECPX"
INVISIBLE = "[­​-‏‪-‮⁠⁦-⁩﻿]"
SPACES = "[   -   　]"
DASHES_FROM, DASHES_TO = "‐‑‒–—―−", "-------"
QUOTES_FROM, QUOTES_TO = "«»„“”‚‘’", "\"\"\"\"\"'''"
FULLWIDTH_FROM, FULLWIDTH_TO = "＠．", "@."
DOT_LIKE = "[·•∙‧⸳・]"
DECOR = "[·•∙⋅]"
JUNK = "[ \t\r\n ­.\\-–—·•_*~=:;|/\\\\<>()\\[\\]{}\"'`«»„“”‚‘’]+"
TAIL = "[.,;:!?)\\]}>»”’\"']+$"
CYRILLIC_DIGRAPHS = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ё": "yo"}
CYRILLIC_FROM, CYRILLIC_TO = "абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye"
#: The ordered repairs of scanned addresses: (pattern, replacement).
OCR_RULES = (
    (f"(@[A-Za-z0-9.\\-]+)[ \\t]*{DECOR}?[ \\t]*\\.[ \\t]*([A-Za-z]{{2,}})", "$1.$2"),
    (f"(@[A-Za-z0-9\\-]+)[ \\t]*{DECOR}[ \\t]*([A-Za-z]{{2,}})", "$1.$2"),
    ("(@[A-Za-z0-9\\-]+)[ \\t]+(ru|com|org|net|edu)($|[^A-Za-z0-9.])", "$1.$2$3"),
    ("(@[A-Za-z0-9\\-]+)[ \\t]*,[ \\t]*(ru|com|org|net|edu)($|[^A-Za-z0-9.])", "$1.$2$3"),
    ("(@[A-Za-z0-9\\-]+)[ \\t]*[\\r\\n]+[ \\t]*(ru|com|org|net|edu)($|[^A-Za-z0-9.])", "$1.$2$3"),
    ("\\.[ \\t]*r[ \\t]*u($|[^A-Za-z])", ".ru$1"),
)


def chain(c: Column, *rules: tuple[str, str]) -> Column:
    """Regular replacements, one after the other."""
    return reduce(lambda x, r: F.regexp_replace(x, F.lit(r[0]), F.lit(r[1])), rules, c)


def strip_invisibles(c: Column) -> Column:
    return chain(c, (INVISIBLE, ""))


def normalize_confusables(c: Column) -> Column:
    """Cyrillic letters that look Latin become Latin."""
    return F.translate(c, CONFUSABLES_FROM, CONFUSABLES_TO)


def normalize_marks(c: Column) -> Column:
    """Homoglyphs, special spaces, invisible marks, dashes, quotes, full-width @ and dot."""
    out = F.translate(strip_invisibles(chain(c, (SPACES, " "))), HOMOGLYPHS_FROM, HOMOGLYPHS_TO)
    return F.translate(out, DASHES_FROM + QUOTES_FROM + FULLWIDTH_FROM, DASHES_TO + QUOTES_TO + FULLWIDTH_TO)


def preclean(c: Column) -> Column:
    """Cleaning before extraction: marks, line ends, blanks round @, dot-like characters."""
    out = normalize_confusables(strip_invisibles(c))
    return chain(out, (SPACES, " "), ("\r\n?", "\n"), ("[ \t]*@[ \t]*", "@"), (DOT_LIKE, "."), ("[ \t]+", " "))


def deobfuscate(c: Column) -> Column:
    """(at), [at], {at}, <at>, &commat; and the same for dot; words only between blanks."""
    return chain(
        c,
        ("(?i)[ \t]*[(\\[{<][ \t]*(?:at|собака)[ \t]*[)\\]}>][ \t]*", "@"),
        ("(?i)[ \t]*[(\\[{<][ \t]*(?:dot|точка)[ \t]*[)\\]}>][ \t]*", "."),
        ("(?i)&commat;", "@"),
        ("(?i)&#0*64;", "@"),
        ("(?i)&period;", "."),
        ("(?i)([a-z0-9])[ \t]+at[ \t]+([a-z0-9.-]+)[ \t]+dot[ \t]+([a-z]{2,})", "$1@$2.$3"),
    )


def ocr_fix(c: Column) -> Column:
    return chain(c, *OCR_RULES)


def ocr_fix_count(c: Column) -> Column:
    """How many replacements `ocr_fix` makes."""
    total = F.lit(0).cast("long")
    for pattern, to in OCR_RULES:
        total = total + F.regexp_count(c, F.lit(pattern)).cast("long")
        c = F.regexp_replace(c, F.lit(pattern), F.lit(to))
    return total


def join_fragments(c: Column) -> Column:
    """Addresses broken at the end of a line: after @, dot or hyphen, and stray dots before @."""
    return chain(c, ("@[ \t]*\r?\n[ \t]*", "@"), ("([A-Za-z0-9])\\.[ \t]*\r?\n[ \t]*([a-z])", "$1.$2"), ("-[ \t]*\r?\n[ \t]*", "-"), ("\\.@", "@"))


def join_hyphen_breaks(c: Column) -> Column:
    """Words that a soft or hard hyphen breaks over a line."""
    return chain(c, ("([A-Za-z])[­-][ \t]*\r?\n[ \t]*([a-z])", "$1$2"))


def one_line(c: Column) -> Column:
    """Words broken by a hyphen joined, lines to blanks, no blanks round dots and after @, a blank before an address that is glued to a word or mark."""
    word, address = "[\\p{L}\\p{N}_]", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
    return chain(
        c,
        (f"({word})-\\s*\n\\s*({word})", "$1$2"),
        ("\\s*\n\\s*", " "),
        (f"({word})[\u00ad\u200b-\u200d]\\s*({word})", "$1$2"),
        ("([A-Za-z0-9])\\s*\\.\\s*([A-Za-z0-9])", "$1.$2"),
        ("@\\s+([A-Za-z0-9])", "@$1"),
        (f"([\\p{{L}}\\p{{N}})\\]»”'\":=])(?<![A-Za-z0-9._%+-])({address})", "$1 $2"),
        ("[ \t]{2,}", " "),
    )


def clean_pdf_text(c: Column) -> Column:
    return chain(join_hyphen_breaks(c), ("­", ""), (SPACES, " "), ("\r\n?", "\n"), ("[ \t]+", " "))


def separate_addresses(c: Column) -> Column:
    """A blank before an address that is glued to a closing mark."""
    return chain(c, ("([)»”\":=])([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+)", "$1 $2"))


def fix_address_text(c: Column) -> Column:
    return join_fragments(deobfuscate(preclean(c)))


def strip_html(c: Column) -> Column:
    """Text of markup: scripts and styles out, block ends as line ends, tags out, common references."""
    return F.trim(
        chain(
            c,
            ("(?is)<script[^>]*>.*?</script>", " "),
            ("(?is)<style[^>]*>.*?</style>", " "),
            ("(?i)<(?:br|/p|/li|/div|/h[1-6])[^>]*>", "\n"),
            ("<[^>]+>", " "),
            ("&nbsp;", " "),
            ("&lt;", "<"),
            ("&gt;", ">"),
            ("&quot;", "\""),
            ("&#39;", "'"),
            ("&amp;", "&"),
            ("[ \t]+", " "),
            (" ?\n[ \n]*", "\n"),
        )
    )


def trim_junk(c: Column) -> Column:
    """Marks and blanks at both ends."""
    return chain(c, ("^" + JUNK, ""), (JUNK + "$", ""))


def strip_trailing_marks(c: Column) -> Column:
    return chain(c, (TAIL, ""))


def strip_phone_prefix(c: Column) -> Column:
    """A telephone number that is glued to the front of a name."""
    return chain(c, ("^\\+?[0-9][0-9\\- ]{6,}[0-9]([A-Za-z])", "$1"))


def decode_cfemail(c: Column) -> Column:
    """Hex string whose bytes are XORed with the first one."""
    code = lambda i: F.conv(F.substring(c, i, F.lit(2)), 16, 10).cast("int")
    key = code(F.lit(1))
    n = F.floor(F.length(c) / 2).cast("int")
    chars = F.transform(F.sequence(F.lit(2), n), lambda i: F.chr(code(i * 2 - 1).bitwiseXOR(key)))
    return F.when(n >= 2, F.array_join(chars, ""))


def decode_base64(c: Column) -> Column:
    """Text of 8 to 200 characters of base64 that holds an @, else null."""
    ok = F.length(c).between(8, 200) & F.regexp_like(c, F.lit("^[A-Za-z0-9+/]+={0,2}$")) & (F.length(c) % 4 == 0)
    text = F.when(ok, F.decode(F.unbase64(F.when(ok, c)), "UTF-8"))
    return F.when(text.contains("@"), text)


def local_part(c: Column) -> Column:
    """Before the first @."""
    return F.substring_index(c, "@", 1)


def domain_part(c: Column) -> Column:
    """After the last @, in lower case; null without one."""
    return F.when(c.contains("@"), F.lower(F.substring_index(c, "@", -1)))


def domain_after_first(c: Column) -> Column:
    return F.when(c.contains("@"), F.lower(F.substring(c, F.instr(c, "@") + 1, F.length(c))))


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, without fragment."""
    base = chain(c, ("#.*$", ""))
    head = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    return F.when(head != "", F.concat(F.lower(head), F.substring(base, F.length(head) + 1, F.length(base)))).otherwise(base)


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def top_prefix(c: Column) -> Column:
    """First part of a path, as /part/, or / alone."""
    part = F.regexp_extract(c, "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?/([^/?#]+)", 1)
    return F.when(part != "", F.concat(F.lit("/"), part, F.lit("/"))).otherwise(F.lit("/"))


def content_hash(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *parts))


def send_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def mask_address(c: Column) -> Column:
    """First character of the local part, then the domain."""
    return F.when(c.contains("@"), F.concat(F.substring(c, 1, 1), F.lit("***@"), F.substring_index(c, "@", -1))).otherwise(F.lit("***"))


def postclean(c: Column) -> Column:
    """Commas and doubled dots in a domain's end."""
    return chain(c, (",(ru|com|org|net)$", ".$1"), ("\\.{2,}", "."), ("[.,;:]+$", ""))


def transliterate(c: Column) -> Column:
    out = F.lower(c)
    for a, b in CYRILLIC_DIGRAPHS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, CYRILLIC_FROM + "ьъ", CYRILLIC_TO)


def slug(c: Column) -> Column:
    """Letters and digits of the transliterated text."""
    return chain(transliterate(c), ("[^a-z0-9]+", ""))


def fix_domain_typo(c: Column, typos: dict[str, str] | None = None) -> Column:
    from contactloom.functions.values import DOMAIN_TYPOS

    pairs = typos or DOMAIN_TYPOS
    fixed = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[domain_part(c)]
    return F.when(fixed.isNotNull(), F.concat(local_part(c), F.lit("@"), fixed)).otherwise(c)


def trim_appended(c: Column) -> Column:
    """Letters that are glued behind one of the usual last labels of a domain."""
    return chain(c, ("(?i)(\\.(?:ru|com|org|net))(?:ru|com|org|net|russia|biz|info|online|tel|fax|phone|www|http)+$", "$1"))


def unglue(c: Column) -> Column:
    """The first address within a longer token."""
    return F.nullif(F.regexp_extract(c, "[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,}", 0), F.lit(""))


def context(text: Column, pos: Column, length: Column, width: int = 16) -> Column:
    """`width` characters on either side of a hit at 1-based pos."""
    first = F.greatest(F.lit(1), pos - width)
    return F.substring(text, first.cast("int"), (pos + length + width - first).cast("int"))


def timeout_seconds(mb: Column, base: float = 15, per: float = 0.6, low: float = 15, high: float = 90) -> Column:
    """Time allowed for a document by its size, rounded half to even."""
    return F.bround(F.greatest(F.lit(low), F.least(F.lit(high), base + per * mb)))
