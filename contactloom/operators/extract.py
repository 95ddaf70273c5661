"""Generators: one text in, hits out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions import text as T
from contactloom.functions import values as V
from contactloom.functions.rules import is_valid_domain, is_valid_local, tld

#: An address in clean text.
ADDRESS = "[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,}"
#: Longest text and token that are looked at by the guarded finder.
MAX_TEXT, MAX_TOKEN = 1 << 20, 512


def addresses(c: Column) -> Column:
    """Array of the addresses of a text, in order; a text without @ isn't scanned."""
    return F.when(c.contains("@"), F.regexp_extract_all(c, F.lit(ADDRESS), F.lit(0))).otherwise(F.array().cast("array<string>"))


def places(c: Column) -> Column:
    """Array of the 1-based places of a text's addresses, as `addresses` gives them."""
    # each hit with the part before it; what follows the last hit falls off
    steps = F.zip_with(F.split(c, ADDRESS), addresses(c), lambda between, x: F.struct(F.length(between).alias("gap"), F.length(x).alias("n")))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("all"))
    add = lambda a, s: F.struct((a["next"] + s["gap"] + s["n"]).alias("next"), F.concat(a["all"], F.array(a["next"] + s["gap"])).alias("all"))
    return F.aggregate(F.filter(steps, lambda s: s["n"].isNotNull()), start, add, lambda a: a["all"])


def hits(df: DataFrame, text: str = "text", clean=None, at: bool = False) -> DataFrame:
    """(…, pos, email) of each address, positions from 0, lower case; with `at` its 1-based place, found once for a text."""
    c = F.col(text) if clean is None else clean(F.col(text))
    # the cheap test first: rows without @ don't reach the generator
    found = df.filter(F.col(text).contains("@") | F.lit(clean is not None)).withColumn("_all", addresses(c))
    if at:
        found = found.withColumn("_all", F.arrays_zip(F.col("_all").alias("email"), places(c).alias("at")))
        # the plain generator would find everything a second time, in a filter that goes down to the scan's tasks
        found = found.select(*df.columns, F.posexplode_outer("_all").alias("pos", "_hit")).filter("pos is not null")
        return found.select(*df.columns, "pos", F.lower("_hit.email").alias("email"), F.col("_hit.at").alias("at"))
    return found.select(*df.columns, F.posexplode("_all").alias("pos", "email")).withColumn("email", F.lower("email"))


def unified(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Distinct addresses of the cleaned and de-obfuscated text; nothing is glued over blanks."""
    both = hits(df, text, lambda c: T.deobfuscate(T.preclean(c)))
    return both.select(key, "email").distinct()


def first_hits(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Each address of a text once, with its first place, known endings only."""
    found = hits(df, text, T.join_fragments)
    found = found.filter(tld(T.domain_part(F.col("email"))).isin(V.KNOWN_TLDS))
    return found.groupBy(key, "email").agg(F.min("pos").alias("pos"))


def with_ocr(docs: DataFrame, key: str, least: int) -> DataFrame:
    """Q7: distinct addresses of documents' texts; where there are fewer than `least`, those of the recognised text, too.

    docs: `key`, text and ocr_text (null where none was made).
    """
    plain = harvest(docs, key).select(key, "email")
    n = docs.select(key).join(plain.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left")
    few = docs.join(n.filter(F.coalesce("n", F.lit(0)) < least).select(key), key, "left_semi").filter("ocr_text is not null")
    more = harvest(few.select(key, T.clean_pdf_text(F.col("ocr_text")).alias("text")), key)
    return plain.unionByName(more.select(key, "email")).distinct()


def manual(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """<address>, mailto:, bare; each address once, by branch and place."""
    t = F.col(text)
    branch = lambda n, p, g: df.select(key, F.lit(n).alias("branch"), F.posexplode(F.regexp_extract_all(t, F.lit(p), F.lit(g))).alias("pos", "raw"))
    every = branch(0, f"<({ADDRESS})>", 1).unionByName(branch(1, f"(?i)mailto:({ADDRESS})", 1)).unionByName(branch(2, ADDRESS, 0))
    every = every.withColumn("email", F.lower(T.strip_trailing_marks(F.col("raw"))))
    every = every.filter(is_valid_local(T.local_part(F.col("email"))))
    first = every.groupBy(key, "email").agg(F.min(F.struct("branch", "pos")).alias("at"))
    return first.select(key, "email", F.col("at.branch").alias("branch"), F.col("at.pos").alias("pos"))


def guarded(c: Column) -> Column:
    """Addresses of the tokens of bounded length in the first part of a text."""
    tokens = F.filter(F.split(F.substring(c, 1, MAX_TEXT), "[ \\t\\r\\n]+"), lambda x: (F.length(x) <= MAX_TOKEN) & x.contains("@"))
    return F.filter(F.transform(tokens, lambda x: F.regexp_extract(x, ADDRESS, 0)), lambda x: x != "")


def harvest(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Addresses of the text as it is and of the text with blanks round marks taken out."""
    tight = T.chain(F.col(text), ("[ \\t]*([@])[ \\t]*", "$1"), ("([A-Za-z0-9])[ \\t]+\\.[ \\t]*(ru|com|org|net)", "$1.$2"))
    both = F.array_union(addresses(F.col(text)), addresses(tight))
    return df.select(key, F.explode(both).alias("email")).select(key, F.lower("email").alias("email")).distinct()


def obfuscated(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Hits that only de-obfuscation shows, with guards on both parts."""
    plain = addresses(F.col(text))
    found = F.array_except(addresses(T.deobfuscate(F.col(text))), plain)
    h = df.select(key, F.explode(found).alias("email")).withColumn("email", F.lower("email"))
    local, domain = T.local_part(F.col("email")), T.domain_part(F.col("email"))
    ok = (F.length(local) >= 2) & F.regexp_like(local, F.lit("[a-z]")) & F.length(tld(domain)).between(2, 24)
    return h.filter(ok & F.forall(F.split(domain, "\\."), lambda x: F.regexp_like(x, F.lit("[a-z]"))))


def mailto(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Addresses of mailto links; + stays +."""
    raw = F.explode(F.regexp_extract_all(F.col(html), F.lit("(?i)href=[\"']mailto:([^\"'?]+)"), F.lit(1)))
    d = df.filter(F.lower(html).contains("mailto:")).select(key, raw.alias("raw"))
    return d.select(key, F.lower(F.try_url_decode(F.replace("raw", F.lit("+"), F.lit("%2B")))).alias("email"))


def cfemails(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """T20 on pages: data-cfemail attributes."""
    raw = F.explode(F.regexp_extract_all(F.col(html), F.lit("data-cfemail=\"([0-9a-fA-F]+)\""), F.lit(1)))
    return df.filter(F.col(html).contains("data-cfemail")).select(key, raw.alias("hex")).select(key, T.decode_cfemail(F.col("hex")).alias("email"))


def bundles(df: DataFrame, key: str, text: str = "html") -> DataFrame:
    """base64 literals of scripts."""
    raw = F.explode(F.regexp_extract_all(F.col(text), F.lit("(?:atob|Buffer\\.from)\\([\"']([A-Za-z0-9+/=]+)[\"']"), F.lit(1)))
    return df.filter(F.col(text).contains("atob") | F.col(text).contains("Buffer.from")).select(key, raw.alias("b64")).select(key, T.decode_base64(F.col("b64")).alias("email")).filter("email is not null")


#: JSON in pages: linked data, and the state that frameworks leave for their scripts.
JSON_BLOCKS = (
    "(?is)<script[^>]+type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>",
    "(?is)<script[^>]+id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>",
    "(?is)window\\.__NUXT__\\s*=\\s*(\\{.*?\\});",
    "(?is)window\\.__INITIAL_STATE__\\s*=\\s*(\\{.*?\\});",
)


def json_strings(c: Column) -> Column:
    """The string values of a JSON text at every depth, in order, escapes read; keys aren't values, and what isn't JSON has none."""
    tokens = F.regexp_extract_all(F.when(F.try_parse_json(c).isNotNull(), c), F.lit('"(?:[^"\\\\]|\\\\.)*+"\\s*+:?'), F.lit(0))
    values = F.filter(tokens, lambda x: ~x.endswith(":"))
    return F.transform(values, lambda x: F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0)))


def embedded_json(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Addresses in the strings of LD-JSON and framework state: as they are, de-obfuscated, or in base64."""
    blocks = F.concat(*[F.regexp_extract_all(F.col(html), F.lit(p), F.lit(1)) for p in JSON_BLOCKS])
    # the cheap test first: pages without the names of such blocks don't reach the patterns
    low = F.lower(html)
    df = df.filter(low.contains("ld+json") | low.contains("__next_data__") | low.contains("__nuxt__") | low.contains("__initial_state__"))
    s = df.select(key, F.explode(blocks).alias("json")).select(key, F.explode(json_strings(F.col("json"))).alias("s"))
    s = s.withColumns({"plain": T.preclean(F.col("s")), "decoded": T.decode_base64(F.col("s"))})
    none = F.array().cast("array<string>")
    found = F.concat(addresses(F.col("plain")), addresses(T.deobfuscate(F.col("plain"))), F.coalesce(addresses(F.col("decoded")), none))
    return s.select(key, F.explode(found).alias("email")).select(key, F.lower("email").alias("email")).distinct()


def page_hits(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Mailto, protected, visible and obfuscated addresses of a page, by origin."""
    shown = pages.select(key, T.strip_html(F.col(html)).alias("text"))
    parts = {
        "mailto": mailto(pages, key, html),
        "cfemail": cfemails(pages, key, html),
        "text": hits(shown, "text").select(key, "email"),
        "obfuscated": obfuscated(shown, key),
        "ldjson": embedded_json(pages, key, html),
        "bundle": bundles(pages, key, html),
    }
    out = None
    for origin, d in parts.items():
        d = d.select(key, "email", F.lit(origin).alias("origin"))
        out = d if out is None else out.unionByName(d)
    return out.distinct()


def tiered(page: DataFrame, key: str, order: dict[str, int]) -> DataFrame:
    """Hits of the first tier of a page that has any."""
    tier = F.coalesce(*[F.when(F.col("origin") == k, v) for k, v in order.items()], F.lit(len(order)))
    t = page.withColumn("tier", tier)
    least = t.groupBy(key).agg(F.min("tier").alias("tier"))
    return t.join(least, [key, "tier"])


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Hrefs in order."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit("href=\"([^\"]*)\""), F.lit(1))).alias("pos", "href"))


def name_pairs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Capitalised words side by side and initials with a name, in both orders, letters of any script.

    A run of words gives each two neighbours, a run of three its ends, too.
    """
    w = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
    head, tail = r"(?<![\p{L}\p{M}.-])", r"(?![\p{L}\p{M}-])"
    t = F.col(text)
    words = df.select(key, F.explode(F.regexp_extract_all(t, F.lit(rf"(?<![\p{{L}}\p{{M}}-]){w}(?:[ \t]+{w})+{tail}"), F.lit(0))).alias("run")).select(key, F.split("run", "[ \\t]+").alias("a"))
    ends = F.when(F.size("a") == 3, F.array(F.struct(F.get("a", F.lit(0)).alias("first"), F.get("a", F.lit(2)).alias("last"))))
    next_to = F.transform(F.sequence(F.lit(1), F.size("a") - 1), lambda i: F.struct(F.get("a", i - 1).alias("first"), F.get("a", i).alias("last")))
    found = words.select(key, F.explode(F.concat(next_to, F.coalesce(ends, F.array().cast("array<struct<first:string,last:string>>")))).alias("p")).select(key, "p.first", "p.last")
    for shape in (rf"(?<![\p{{L}}\p{{M}}-]){w}[ \t]+\p{{Lu}}\.", rf"{head}\p{{Lu}}\.[ \t]*(?:\p{{Lu}}\.[ \t]*)?{w}{tail}"):
        m = df.select(key, F.explode(F.regexp_extract_all(t, F.lit(shape), F.lit(0))).alias("m"))
        found = found.unionByName(m.select(key, F.regexp_extract("m", r"(\p{Lu})\.", 1).alias("first"), F.regexp_extract("m", w, 0).alias("last")))
    return found.unionByName(found.select(key, F.col("last").alias("first"), F.col("first").alias("last"))).distinct()


def corrections(lines: DataFrame, key: str, text: str = "line") -> DataFrame:
    """Old -> new, old: new or old, new; a dash or an empty right side deletes."""
    parts = F.split(F.trim(F.col(text)), "[ \\t]*(?:->|=>|→|[:,])[ \\t]*", 2)
    old, new = F.lower(F.get(parts, F.lit(0))), F.get(parts, F.lit(1))
    drop = new.isNull() | F.lower(F.trim(new)).isin("", "-", "—", "delete", "drop", "удалить")
    return lines.filter(F.trim(F.col(text)) != "").select(key, old.alias("old_email"), F.when(~drop, F.trim(new)).alias("new_email"), F.when(drop, "drop").otherwise("replace").alias("action"))


def extract_valid(df: DataFrame, key: str, text: str = "text", limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Valid addresses of a text, `limit` at most by place, and how many of each reason were refused."""
    from pyspark.sql.window import Window

    from contactloom.functions.rules import strict_reason

    h = hits(df, text).withColumn("reason", F.when(~is_valid_domain(T.domain_part(F.col("email"))), "domain_bad_shape").otherwise(strict_reason(F.col("email"))))
    good = h.filter("reason is null").groupBy(key, "email").agg(F.min("pos").alias("pos"))
    good = good.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("pos", "email"))).filter(F.col("rn") <= limit).drop("rn")
    return good, h.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
