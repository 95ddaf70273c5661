"""Queries on addresses: cleaning, keys, rules and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.functions import keys as K
from contactloom.functions import rules as RU
from contactloom.functions import text as T
from contactloom.functions import values as V
from contactloom.operators import extract as X
from contactloom.plans.registry import M, R, messy, query, recipients, sql_any, sql_in
from contactloom.session import table

AT = "'[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,}'"
DOMAIN = "lower(split_part(trim(email), '@', 2))"
LOCAL = "lower(split_part(trim(email), '@', 1))"
NO_TAG, NO_DOTS = f"split_part({LOCAL}, '+', 1)", f"replace({LOCAL}, '.', '')"


@query(
    f"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, {AT})) AS e, generate_subscripts(regexp_extract_all(text, {AT}), 1) - 1 AS pos FROM documents)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, lower(e) AS email FROM h"""
)
def extract_emails(spark, d):
    """Every address of the documents, by place."""
    return X.hits(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "pos", "email")


@query(f"WITH h AS (SELECT lower(unnest(regexp_extract_all(text, {AT}))) AS e FROM documents) SELECT split_part(e, '@', 2) AS domain, count(*) AS n FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def extract_domain_counts(spark, d):
    """A1, O2: top domains of extracted addresses."""
    from contactloom.operators.reports import top

    h = X.hits(table(spark, d, "documents").select("doc_id", "text"))
    return top(h.select(T.domain_part(F.col("email")).alias("domain")), "domain", 20)


def _class_sql(domain: str) -> str:
    return f"CASE WHEN {domain} = '' THEN 'unknown' WHEN {domain} IN ({sql_in(V.GLOBAL_MAIL)}) THEN 'global_mail' WHEN split_part({domain}, '.', -1) IN ({sql_in(V.RU_LIKE)}) THEN 'ru_like' ELSE 'foreign_corporate' END"


@query(
    f"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, {AT})) AS email, generate_subscripts(regexp_extract_all(text, {AT}), 1) AS pos FROM documents),
    k AS (SELECT *, CASE WHEN {DOMAIN} IN ('gmail.com','googlemail.com') THEN concat(replace({NO_TAG}, '.', ''), '@gmail.com') ELSE lower(email) END AS key FROM h),
    f AS (SELECT key, arg_min(email, (doc_id, pos)) AS email FROM k GROUP BY 1)
    SELECT {_class_sql(DOMAIN)} AS domain_class, count(*) AS n FROM f GROUP BY 1"""
)
def entry_domain_classes(spark, d):
    """Flagship: documents, addresses, key, first of each key, class, count."""
    h = X.hits(table(spark, d, "documents").select("doc_id", "text"))
    first = h.groupBy(K.gmail_key(F.col("email")).alias("key")).agg(F.min(F.struct("doc_id", "pos", "email")).alias("f"))
    return first.groupBy(RU.domain_class(F.col("f.email")).alias("domain_class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {R} SELECT pos, concat(CASE WHEN {DOMAIN} IN ({sql_in(V.IGNORE_DOTS)}) THEN replace({NO_TAG}, '.', '') WHEN {DOMAIN} IN ({sql_in(V.PLUS_TAG)}) THEN {NO_TAG} ELSE {LOCAL} END, '@', CASE {DOMAIN} WHEN 'googlemail.com' THEN 'gmail.com' ELSE {DOMAIN} END) AS key FROM r"
)
def canonical_provider(spark, d):
    """C1."""
    return recipients(spark, d).select("pos", K.provider_key(F.col("email")).alias("key"))


_GMAIL_SQL = f"CASE WHEN {DOMAIN} IN ('gmail.com','googlemail.com') THEN concat(replace({NO_TAG}, '.', ''), '@gmail.com') ELSE lower(trim(email)) END"


@query(f"WITH {R} SELECT pos, {_GMAIL_SQL} AS key FROM r")
def canonical_gmail_only(spark, d):
    """C2."""
    return recipients(spark, d).select("pos", K.gmail_key(F.col("email")).alias("key"))


@query(f"WITH {R} SELECT pos, {_GMAIL_SQL} AS key FROM r")
def canonical_stoplist(spark, d):
    """C3."""
    return recipients(spark, d).select("pos", K.stoplist_key(F.col("email")).alias("key"))


@query(
    f"""WITH {R} SELECT pos, {_GMAIL_SQL} AS history, CASE WHEN {DOMAIN} IN ('gmail.com','googlemail.com') THEN concat({LOCAL}, '@gmail.com') ELSE concat({NO_TAG}, '@', {DOMAIN}) END AS other_plus,
    {_GMAIL_SQL} AS cooldown, {_GMAIL_SQL} AS extraction, lower(trim(email)) AS plain, {_GMAIL_SQL} AS service, {_GMAIL_SQL} AS edit, concat(split_part(email, '@', 1), '@', {DOMAIN}) AS transport FROM r"""
)
def canonical_others(spark, d):
    """C4-C8, C11, C12, C14."""
    e = F.col("email")
    return recipients(spark, d).select(
        "pos",
        K.history_key(e).alias("history"),
        K.flagged_key(e, gmail_dots=False, gmail_plus=False, other_plus=True).alias("other_plus"),
        K.cooldown_key(e).alias("cooldown"),
        K.extraction_key(e).alias("extraction"),
        K.plain_key(e).alias("plain"),
        K.service_key(e).alias("service"),
        K.edit_key(e).alias("edit"),
        K.transport_address(e).alias("transport"),
    )


@query(
    f"""WITH {M}, a AS (SELECT pos, lower(trim(email)) AS a, {_GMAIL_SQL} AS s FROM m)
    SELECT pos, CASE WHEN regexp_full_match(a, '[a-z0-9._%+-]+@[a-z0-9-]+(\\.[a-z0-9-]+)+') THEN a END AS blocked_key, regexp_replace(regexp_replace(s, '^\\.+', ''), '^[0-9]{{1,2}}([a-z])', '\\1') AS blocklist_key
    FROM a WHERE length(a) - length(replace(a, '@', '')) = 1"""
)
def canonical_blocked(spark, d):
    """C9, C10, on addresses with faults."""
    m = messy(spark, d).filter("length(email) - length(replace(email, '@', '')) = 1")
    return m.select("pos", K.blocked_key(F.col("email")).alias("blocked_key"), K.blocklist_key(F.col("email")).alias("blocklist_key"))


_REASON = """CASE WHEN length(a) - length(replace(a, '@', '')) <> 1 THEN 'no_at_sign'
  WHEN l = '' OR dd = '' THEN 'empty_local_or_domain'
  WHEN NOT regexp_matches(l, '^[\\x00-\\x7F]*$') THEN 'local_not_ascii'
  WHEN l LIKE '.%' OR l LIKE '%.' THEN 'local_edge_dot'
  WHEN contains(l, '..') THEN 'local_consecutive_dots'
  WHEN NOT regexp_full_match(l, '[A-Za-z0-9!#$%&''*+/=?^_`{|}~.-]+') THEN 'local_bad_chars'
  WHEN NOT contains(dd, '.') THEN 'domain_bad_shape'
  WHEN len(list_filter(string_split(dd, '.'), lambda x: length(x) > 63)) > 0 THEN 'domain_label_size'
  WHEN length(dd) > 253 THEN 'domain_too_long'
  WHEN list_contains(string_split(dd, '.'), '') OR length(split_part(dd, '.', -1)) < 2 THEN 'domain_bad_shape'
  WHEN len(list_filter(string_split(dd, '.'), lambda x: x LIKE '-%' OR x LIKE '%-')) > 0 THEN 'domain_label_dash'
  WHEN NOT regexp_full_match(dd, '[a-z0-9.-]+') THEN 'domain_bad_shape' END"""
_SPLIT = "a AS (SELECT pos, trim(email) AS a, split_part(trim(email), '@', 1) AS l, lower(substr(trim(email), strpos(trim(email), '@') + 1)) AS dd FROM m)"


@query(f"WITH {M}, {_SPLIT} SELECT coalesce({_REASON}, 'ok') AS reason, count(*) AS n FROM a GROUP BY 1")
def strict_reason_codes(spark, d):
    """Reasons of refusal, counted."""
    r = F.coalesce(RU.strict_reason(F.col("email")), F.lit("ok"))
    return messy(spark, d).groupBy(r.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {R} SELECT {_class_sql(DOMAIN)} AS cls, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT 'unknown', 0")
def classify_domain(spark, d):
    """Classes, zero-filled."""
    from contactloom.operators.reports import zero_filled

    c = recipients(spark, d).select(RU.domain_class(F.col("email")).alias("cls"))
    return zero_filled(c, "cls", ["ru_like", "global_mail", "foreign_corporate", "unknown"])


@query(
    f"""WITH {R} SELECT pos, CASE split_part({DOMAIN}, '.', -1) WHEN 'ru' THEN 'domestic' WHEN 'com' THEN 'generic' ELSE 'foreign' END AS tld_class,
    split_part({DOMAIN}, '.', -1) IN ('ru', 'com') AS allowed, split_part({DOMAIN}, '.', -1) NOT IN ('ru', 'com') AS foreign_tld,
    NOT ({DOMAIN} = 'gmail.com' OR {DOMAIN} LIKE '%.ru') AS foreign_address, split_part({DOMAIN}, '.', -1) IN ({sql_in(V.KNOWN_TLDS)}) AS known FROM r"""
)
def tld_class(spark, d):
    """V3, V5, V6, V8, V18."""
    e = F.col("email")
    dom = T.domain_part(e)
    return recipients(spark, d).select(
        "pos", RU.tld_class(e).alias("tld_class"), RU.is_allowed_tld(dom).alias("allowed"), RU.is_foreign_tld(dom).alias("foreign_tld"), RU.is_foreign_address(e).alias("foreign_address"), (RU.candidate_score(dom) == 1).alias("known")
    )


@query(
    f"""WITH {M}, {_SPLIT} SELECT pos, regexp_full_match(a, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-zА-Яа-яЁё]{{2,}}') AS valid,
    length(l) BETWEEN 1 AND 64 AND l NOT LIKE '.%' AND l NOT LIKE '%.' AND NOT contains(l, '..') AND regexp_full_match(l, '[A-Za-z0-9!#$%&''*+/=?^_`{{|}}~.-]+') AS local_ok,
    regexp_full_match(a, '[^@ \\t\\r\\n]+@[^@ \\t\\r\\n]+\\.[^@ \\t\\r\\n]+') AS shaped,
    regexp_matches(l, '^[0-9]{{5}}') OR len(regexp_extract_all(l, '[0-9]')) > length(l) * 0.7 AS suspicious, regexp_full_match(l, '[0-9]+') AS numeric_local,
    regexp_matches(lower(a), '^(admin|contact|info|mail|office|postmaster|sales|support|test|webmaster)') AS service FROM a"""
)
def address_predicates(spark, d):
    """V1, V2, V13, V14, V23."""
    a = F.trim("email")
    local = T.local_part(a)
    return messy(spark, d).select(
        "pos",
        RU.is_valid_address(a).alias("valid"),
        RU.is_valid_local(local).alias("local_ok"),
        RU.looks_like_address(a).alias("shaped"),
        RU.is_suspicious_local(local).alias("suspicious"),
        RU.is_numeric_local(local).alias("numeric_local"),
        RU.has_service_prefix(a).alias("service"),
    )


_WORDS_SQL = sql_in((*V.ROLE_WORDS, *V.ROLE_FRAGMENTS))
#: Local parts of many kinds, domains and contexts by number, in both languages.
_ROLE_LOCAL = "CASE pos % 11 WHEN 0 THEN 'Otdel.kadrov' WHEN 1 THEN 'no_reply' WHEN 2 THEN 'labor-1' WHEN 3 THEN 'a.it.b' WHEN 4 THEN 'editors' WHEN 5 THEN 'кафедра7' ELSE split_part(email, '@', 1) END"
_ROLE_DOMAIN = "CASE pos % 4 WHEN 0 THEN 'mail.univ.ru' ELSE 'example.org' END"
_ROLE_CTX = "CASE pos % 5 WHEN 0 THEN 'Corresponding  author' WHEN 1 THEN 'Department of physics' WHEN 2 THEN 'автор, кафедра' WHEN 3 THEN 'Приёмная комиссия' ELSE '' END"
_ROLE_IN = f"""x AS (SELECT pos, lower(trim({_ROLE_LOCAL})) AS l, {_ROLE_DOMAIN} AS dom, lower({_ROLE_CTX}) AS ctx FROM r),
    f AS (SELECT pos, regexp_full_match(l, '{V.ROLE_LOCAL}') AS w, regexp_matches(l, '(^|[^A-Za-zА-Яа-яЁё0-9])({"|".join(V.ROLE_FRAGMENTS)})($|[^A-Za-zА-Яа-яЁё])') AS p,
      list_has_any(regexp_split_to_array(l, '[._+-]'), [{_WORDS_SQL}]) AS t, list_has_any(regexp_split_to_array(dom, '[._+-]'), [{_WORDS_SQL}]) AS d,
      regexp_matches(l, '{V.NAME_SHAPE}') AS n, regexp_matches(ctx, '{V.AUTHOR_CONTEXT}') AS a, regexp_matches(ctx, '{V.ROLE_CONTEXT}') AS c FROM x),
    s AS (SELECT pos, CASE WHEN w OR p OR t THEN 0.0::DOUBLE ELSE round(0.5::DOUBLE - if(d, 0.15, 0)::DOUBLE + if(n, 0.25, 0)::DOUBLE + if(a, 0.15, 0)::DOUBLE - if(c, 0.2, 0)::DOUBLE, 3) END AS score,
      CASE WHEN w THEN 'role-local' WHEN p THEN 'role-fragment' WHEN t THEN 'role-local' WHEN NOT (d OR n OR a OR c) THEN 'baseline'
        ELSE concat_ws(',', if(d, 'role-domain', NULL), if(n, 'fio-like', NULL), if(a, 'author-context', NULL), if(c, 'dept-context', NULL)) END AS reason FROM f)"""
_ROLE_CLASS = "CASE WHEN score <= 0.35 THEN 'role' WHEN score >= 0.65 THEN 'personal' ELSE 'unknown' END"


@query(f"WITH {R}, {_ROLE_IN} SELECT pos, score AS role_score, {_ROLE_CLASS} AS role_class, reason AS role_reason FROM s")
def role_score(spark, d):
    """V9, V10, D15."""
    x = recipients(spark, d).select("pos", F.expr(_ROLE_LOCAL).alias("l"), F.expr(_ROLE_DOMAIN).alias("dom"), F.expr(_ROLE_CTX).alias("ctx"))
    return x.select("pos", RU.role_score(F.col("l"), F.col("dom"), F.col("ctx")).alias("r")).select("pos", "r.role_score", "r.role_class", "r.role_reason")


@query(
    f"""WITH {R}, {_ROLE_IN}, c AS (SELECT pos % 10 AS k, score, {_ROLE_CLASS} AS cls FROM s)
    SELECT k, CASE WHEN bool_or(cls = 'role') THEN 'role' ELSE arg_max(cls, score) END AS cls, CASE WHEN bool_or(cls = 'role') THEN min(score) FILTER (cls = 'role') ELSE max(score) END AS score FROM c GROUP BY k"""
)
def role_statistics(spark, d):
    """A10: a role row if there is one, else the best row of a key."""
    from contactloom.operators.reports import worst_or_best

    s = role_score(spark, d).select((F.col("pos") % 10).alias("k"), F.col("role_class").alias("cls"), F.col("role_score").alias("score"))
    return worst_or_best(s, "k", "cls", "score")


@query(
    f"""WITH {R}, n AS (SELECT * FROM (VALUES ('ivan','petrov'),('jane','doe'),('j','doe'),('anna','user')) t(f, s)),
    x AS (SELECT pos, regexp_replace(lower(split_part(split_part(email, '@', 1), '+', 1)), '[0-9]+$', '') AS l FROM r),
    c AS (SELECT pos, CASE WHEN l IN (f||'.'||s, s||'.'||f, f||'_'||s, s||'_'||f, f||'-'||s, s||'-'||f, f||s, s||f) THEN 1.0 WHEN contains(l, f||s) OR contains(l, s||f) THEN 0.97
      WHEN l IN (f[1]||'.'||s, s||'.'||f[1], f[1]||'_'||s, s||'_'||f[1], f[1]||'-'||s, s||'-'||f[1], f[1]||s, s||f[1]) THEN 0.92 WHEN l = s THEN 0.9 WHEN length(s) >= 4 AND contains(l, s) THEN 0.88 ELSE 0.0 END AS v FROM x, n)
    SELECT pos, CAST(max(v) AS DOUBLE) AS score FROM c GROUP BY pos"""
)
def name_match_score(spark, d):
    """Best score of each address over a list of names (of a fixed size)."""
    names = [("ivan", "petrov"), ("jane", "doe"), ("j", "doe"), ("anna", "user")]
    local = F.regexp_replace(F.lower(F.substring_index(T.local_part(F.col("email")), "+", 1)), "[0-9]+$", "")
    return recipients(spark, d).select("pos", F.greatest(*[RU.name_score(local, F.lit(f), F.lit(s)) for f, s in names]).cast("double").alias("score"))


@query(
    f"""WITH {M} SELECT pos, regexp_replace(trim(email), '^\\+?[0-9][0-9\\- ]{{6,}}[0-9]([A-Za-z])', '\\1') AS phone, regexp_replace(trim(email), '[.,;:!?)\\]}}>»”’"'']+$', '') AS tail,
    regexp_replace(regexp_replace(regexp_replace(email, ',(ru|com|org|net)$', '.\\1'), '\\.{{2,}}', '.', 'g'), '[.,;:]+$', '') AS postclean,
    regexp_replace(email, '(?i)(\\.(?:ru|com|org|net))(?:ru|com|org|net|russia|biz|info|online|tel|fax|phone|www|http)+$', '\\1') AS trimmed,
    concat(substr(email, 1, 1), '***@', split_part(email, '@', -1)) AS masked, split_part(email, '@', 1) AS local_part, lower(split_part(email, '@', -1)) AS domain_last,
    nullif(regexp_extract(email, '[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{{2,}}'), '') AS unglued FROM m"""
)
def token_repairs(spark, d):
    """T18, T19, T22, T23, T27, T28, T32."""
    e = F.col("email")
    return messy(spark, d).select(
        "pos",
        T.strip_phone_prefix(F.trim(e)).alias("phone"),
        T.strip_trailing_marks(F.trim(e)).alias("tail"),
        T.postclean(e).alias("postclean"),
        T.trim_appended(e).alias("trimmed"),
        T.mask_address(e).alias("masked"),
        T.local_part(e).alias("local_part"),
        T.domain_part(e).alias("domain_last"),
        T.unglue(e).alias("unglued"),
    )


_SCAN = """CASE c_custkey % 6 WHEN 0 THEN concat('user', c_custkey, '@domain ru') WHEN 1 THEN concat('user', c_custkey, '@domain,ru') WHEN 2 THEN concat('user', c_custkey, '@domain·ru')
 WHEN 3 THEN concat('user', c_custkey, '@domain . com') WHEN 4 THEN concat('user', c_custkey, '@mail.r u') ELSE concat('user', c_custkey, '@domain', chr(10), 'ru') END"""
_DECOR, _CUT = "[·•∙⋅]", "(ru|com|org|net|edu)($|[^A-Za-z0-9.])"
_OCR = [
    (f"(@[A-Za-z0-9.\\-]+)[ \\t]*{_DECOR}?[ \\t]*\\.[ \\t]*([A-Za-z]{{2,}})", "\\1.\\2"),
    (f"(@[A-Za-z0-9\\-]+)[ \\t]*{_DECOR}[ \\t]*([A-Za-z]{{2,}})", "\\1.\\2"),
    (f"(@[A-Za-z0-9\\-]+)[ \\t]+{_CUT}", "\\1.\\2\\3"),
    (f"(@[A-Za-z0-9\\-]+)[ \\t]*,[ \\t]*{_CUT}", "\\1.\\2\\3"),
    (f"(@[A-Za-z0-9\\-]+)[ \\t]*[\\r\\n]+[ \\t]*{_CUT}", "\\1.\\2\\3"),
    ("\\.[ \\t]*r[ \\t]*u($|[^A-Za-z])", ".ru\\1"),
]


def _replaced(x: str, rules) -> str:
    for p, to in rules:
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return x


@query(f"SELECT c_custkey AS pos, {_replaced('(' + _SCAN + ')', _OCR)} AS fixed FROM customer")
def ocr_fix(spark, d):
    """Repairs of scanned addresses."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), T.ocr_fix(F.expr(_SCAN.replace("chr(10)", "char(10)"))).alias("fixed"))


@query("SELECT c_custkey % 6 AS kind, CAST(sum(1) AS BIGINT) AS repairs FROM customer GROUP BY 1")
def ocr_fix_counts(spark, d):
    """Replacements counted by kind."""
    c = table(spark, d, "customer").select((F.col("c_custkey") % 6).alias("kind"), T.ocr_fix_count(F.expr(_SCAN.replace("chr(10)", "char(10)"))).alias("n"))
    return c.groupBy("kind").agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("repairs"))


_SPOILT = "CASE c_custkey % 5 WHEN 0 THEN 'u.vanov@mаil.ru' WHEN 1 THEN 'сергей@поле.рф' WHEN 2 THEN 'Хata@Тор.com' WHEN 3 THEN 'plain@site.com' ELSE 'вера@mоsкva.ru' END"


@query(f"SELECT c_custkey AS pos, translate({_SPOILT}, '{T.CONFUSABLES_FROM}', '{T.CONFUSABLES_TO}') AS latin, translate({_SPOILT}, '{T.HOMOGLYPHS_FROM}', '{T.HOMOGLYPHS_TO}') AS homoglyphs FROM customer")
def confusables(spark, d):
    """T3, T1 (the part that is a translation)."""
    c = F.expr(_SPOILT)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), T.normalize_confusables(c).alias("latin"), T.normalize_marks(c).alias("homoglyphs"))


_PAIRS = list(T.CYRILLIC_DIGRAPHS.items())


def _translit_sql(x: str) -> str:
    x = f"lower({x})"
    for a, b in _PAIRS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"translate({x}, '{T.CYRILLIC_FROM}ьъ', '{T.CYRILLIC_TO}')"


@query(f"SELECT c_custkey AS pos, {_translit_sql(_SPOILT)} AS latin, regexp_replace({_translit_sql(_SPOILT)}, '[^a-z0-9]+', '', 'g') AS slug FROM customer")
def translit_ascii(spark, d):
    """T24."""
    c = F.expr(_SPOILT)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), T.transliterate(c).alias("latin"), T.slug(c).alias("slug"))


_HIDDEN = "CASE c_custkey % 5 WHEN 0 THEN 'a [at] b (dot) ru' WHEN 1 THEN 'jane(at)univ[dot]edu' WHEN 2 THEN 'ivan at mail dot ru' WHEN 3 THEN 'a&commat;b&period;com' ELSE 'look at this dot' END"
_DEOBF = [
    ("(?i)[ \\t]*[(\\[{<][ \\t]*(?:at|собака)[ \\t]*[)\\]}>][ \\t]*", "@"),
    ("(?i)[ \\t]*[(\\[{<][ \\t]*(?:dot|точка)[ \\t]*[)\\]}>][ \\t]*", "."),
    ("(?i)&commat;", "@"),
    ("(?i)&#0*64;", "@"),
    ("(?i)&period;", "."),
    ("(?i)([a-z0-9])[ \\t]+at[ \\t]+([a-z0-9.-]+)[ \\t]+dot[ \\t]+([a-z]{2,})", "\\1@\\2.\\3"),
]


@query(f"SELECT c_custkey AS pos, {_replaced('(' + _HIDDEN + ')', _DEOBF)} AS shown FROM customer")
def deobfuscate(spark, d):
    """T6-T8."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), T.deobfuscate(F.expr(_HIDDEN)).alias("shown"))


@query(f"""WITH x AS (SELECT c_custkey AS pos, {_replaced('(' + _HIDDEN + ')', _DEOBF)} AS s FROM customer) SELECT pos, lower(unnest(regexp_extract_all(s, {AT}))) AS email FROM x WHERE pos % 5 <> 4""")
def obfuscated_hits(spark, d):
    """Addresses that only de-obfuscation shows; single letters as local part are refused elsewhere."""
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.expr(_HIDDEN).alias("text"))
    return X.unified(t, "k").withColumnRenamed("k", "pos")


@query("SELECT c_custkey AS pos, CASE WHEN c_custkey % 2 = 0 THEN 'a@b.ru' ELSE 'contact@site.com' END AS email FROM customer")
def cfemail_decode(spark, d):
    """T20."""
    # bytes of the address under the key in the first byte
    enc = lambda s, k: f"{k:02x}" + "".join(f"{ord(c) ^ k:02x}" for c in s)
    hexed = F.when(F.col("c_custkey") % 2 == 0, F.lit(enc("a@b.ru", 66))).otherwise(F.lit(enc("contact@site.com", 19)))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), T.decode_cfemail(hexed).alias("email"))


@query(f"WITH {R} SELECT pos, CASE WHEN octet_length(encode(email)) % 3 >= 0 AND length(to_base64(encode(email))) BETWEEN 8 AND 200 THEN email END AS email FROM r")
def base64_decode(spark, d):
    """T21."""
    return recipients(spark, d).select("pos", T.decode_base64(F.base64(F.encode("email", "UTF-8"))).alias("email"))


_TLD_IN = "CASE c_custkey % 8 WHEN 0 THEN 'rn' WHEN 1 THEN 'con' WHEN 2 THEN 'orq' WHEN 3 THEN 'nel' WHEN 4 THEN 'ru' WHEN 5 THEN 'zzzz' WHEN 6 THEN 'ed' ELSE 'cam' END"


@query(f"WITH t AS (SELECT c_custkey AS pos, {_TLD_IN} AS tld FROM customer) SELECT pos, tld, CASE WHEN tld IN ({sql_in(V.KNOWN_TLDS)}) THEN tld ELSE (SELECT min(o) FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in V.OCR_TLDS)}) v(o) WHERE levenshtein(o, t.tld) = 1) END AS fixed FROM t")
def tld_repair_levenshtein(spark, d):
    """The first, by alphabet, of eleven endings at edit distance one; the list is a literal, so nothing is joined."""
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.expr(_TLD_IN).alias("tld"))
    near = F.array_min(F.filter(F.array(*[F.lit(x) for x in V.OCR_TLDS]), lambda x: F.levenshtein(F.col("tld"), x) == 1))
    return t.select("pos", "tld", F.when(F.col("tld").isin(V.KNOWN_TLDS), F.col("tld")).otherwise(near).alias("fixed"))


@query("WITH x AS (SELECT c_custkey AS pos, CASE c_custkey % 4 WHEN 0 THEN 'a@gmail.ru' WHEN 1 THEN 'b@gnail.com' WHEN 2 THEN 'c@yadnex.ru' ELSE 'd@ok.ru' END AS e FROM customer) SELECT pos, CASE e WHEN 'a@gmail.ru' THEN 'a@gmail.com' WHEN 'b@gnail.com' THEN 'b@gmail.com' WHEN 'c@yadnex.ru' THEN 'c@yandex.ru' ELSE e END AS fixed FROM x")
def domain_typos(spark, d):
    """T25."""
    e = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'a@gmail.ru' WHEN 1 THEN 'b@gnail.com' WHEN 2 THEN 'c@yadnex.ru' ELSE 'd@ok.ru' END")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), T.fix_domain_typo(e).alias("fixed"))


@query("SELECT doc_id, regexp_replace(regexp_replace(replace(regexp_replace(text, '([A-Za-z])[­-][ \\t]*\\r?\\n[ \\t]*([a-z])', '\\1\\2', 'g'), '­', ''), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g') AS text FROM documents")
def pdf_text_clean(spark, d):
    """T15 on documents."""
    return table(spark, d, "documents").select("doc_id", T.clean_pdf_text(F.col("text")).alias("text"))


@query(
    "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '@[ \\t]*\\r?\\n[ \\t]*', '@', 'g'), '([A-Za-z0-9])\\.[ \\t]*\\r?\\n[ \\t]*([a-z])', '\\1.\\2', 'g'), '-[ \\t]*\\r?\\n[ \\t]*', '-', 'g'), '\\.@', '@', 'g') AS joined FROM documents"
)
def fragment_joins(spark, d):
    """T14 on documents."""
    return table(spark, d, "documents").select("doc_id", T.join_fragments(F.col("text")).alias("joined"))


@query("SELECT doc_id, trim(text) = '' OR length(trim(text)) < 20 OR length(trim(text)) < octet_length(encode(text)) * 0.9 AS needs FROM documents")
def ocr_needed(spark, d):
    """S10."""
    return table(spark, d, "documents").select("doc_id", RU.needs_ocr(F.col("text"), F.octet_length("text"), 20, 0.9).alias("needs"))


@query("SELECT o_orderkey AS id, round_even(greatest(15, least(90, 15 + 0.6 * (o_totalprice / 4000))), 0) AS seconds FROM orders")
def adaptive_timeout(spark, d):
    """Z7."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.timeout_seconds(F.col("o_totalprice") / 4000).alias("seconds"))


@query(
    f"""WITH {R} SELECT pos, sha1(concat_ws('|', lower(email), source, pos)) AS content_hash, sha256(concat_ws('|', lower(email), source)) AS send_key FROM r"""
)
def content_hash(spark, d):
    """T30."""
    return recipients(spark, d).select("pos", T.content_hash(F.lower("email"), F.col("source"), F.col("pos").cast("string")).alias("content_hash"), T.send_key(F.lower("email"), F.col("source")).alias("send_key"))


@query(f"WITH {R}, x AS (SELECT pos, concat('write to <', email, '> or mailto:', lower(email), ' now') AS t FROM r), e AS (SELECT pos, lower(email) AS email FROM r) SELECT pos, email, 0 AS branch, 0 AS pos_in FROM e WHERE email NOT LIKE '.%'")
def manual_extract(spark, d):
    """The branch that comes first wins."""
    t = recipients(spark, d).select("pos", F.concat(F.lit("write to <"), "email", F.lit("> or mailto:"), F.lower("email"), F.lit(" now")).alias("text"))
    return X.manual(t.withColumnRenamed("pos", "k"), "k").select(F.col("k").alias("pos"), "email", "branch", F.col("pos").alias("pos_in"))


@query(f"WITH x AS (SELECT doc_id, unnest(string_split_regex(substr(text, 1, 1048576), '[ \\t\\r\\n]+')) AS t FROM documents WHERE contains(text, '@')) SELECT doc_id, count(*) AS n FROM x WHERE length(t) <= 512 AND regexp_matches(t, {AT}) GROUP BY 1")
def guarded_find(spark, d):
    """Hits of bounded tokens, counted."""
    t = table(spark, d, "documents").select("doc_id", F.size(X.guarded(F.col("text"))).cast("long").alias("n"))
    return t.filter("n > 0")


@query("SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN 'replace' WHEN 1 THEN 'drop' WHEN 2 THEN 'replace' ELSE 'drop' END AS action, CASE n_nationkey % 4 WHEN 0 THEN 'new@x.ru' WHEN 2 THEN 'c@d.ru' END AS new_email, CASE WHEN n_nationkey % 4 = 2 THEN 'a@b.ru' ELSE concat('old', n_nationkey, '@x.ru') END AS old_email FROM nation")
def corrections_parse(spark, d):
    """X15."""
    line = F.expr("CASE n_nationkey % 4 WHEN 0 THEN concat('old', n_nationkey, '@x.ru -> new@x.ru') WHEN 1 THEN concat('old', n_nationkey, '@x.ru -> -') WHEN 2 THEN 'A@b.ru, c@d.ru' ELSE concat('old', n_nationkey, '@x.ru') END")
    return X.corrections(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), line.alias("line")), "k").select("k", "action", "new_email", "old_email")


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[A-ZА-ЯЁ][a-zа-яё]+(?:-[A-ZА-ЯЁ][a-zа-яё]+)? [A-ZА-ЯЁ][a-zа-яё]+(?:-[A-ZА-ЯЁ][a-zа-яё]+)?')) AS pair FROM documents WHERE lang = 'en'")
def name_pairs(spark, d):
    """Pairs of capitalised words, as they stand."""
    t = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "text")
    w = "[A-ZА-ЯЁ][a-zа-яё]+(?:-[A-ZА-ЯЁ][a-zа-яё]+)?"
    return t.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{w} {w}"), F.lit(0))).alias("pair"))


@query()
def name_pairs_all(spark, d):
    """Names of all documents in both orders, with initials; DuckDB's regex knows no look-behind."""
    return X.name_pairs(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


_BOUNCE = "CASE c_custkey % 6 WHEN 0 THEN '550 user not found' WHEN 1 THEN '450 greylisted' WHEN 2 THEN 'Mailbox Unavailable' WHEN 3 THEN 'temporary failure' WHEN 4 THEN 'error 421, try again later' ELSE 'strange reply' END"


@query(f"WITH x AS (SELECT c_custkey AS pos, {_BOUNCE} AS msg FROM customer) SELECT pos, TRY_CAST(nullif(regexp_extract(msg, '(^|[^0-9A-Za-z_])([0-9]{{3}})($|[^0-9A-Za-z_])', 2), '') AS INTEGER) AS code, CASE pos % 6 WHEN 0 THEN 'hard' WHEN 1 THEN 'soft' WHEN 2 THEN 'hard' WHEN 3 THEN 'soft' WHEN 4 THEN 'soft' ELSE 'unknown' END AS cls FROM x")
def bounce_class(spark, d):
    """V20."""
    msg, none = F.expr(_BOUNCE), F.lit(None).cast("int")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), RU.smtp_code(none, msg).alias("code"), RU.bounce_class(none, msg).alias("cls"))


@query("SELECT c_custkey AS pos, CASE c_custkey % 5 WHEN 0 THEN 'mailto' WHEN 1 THEN 'corresponding' WHEN 2 THEN 'footer' WHEN 3 THEN 'contacts' ELSE 'unknown' END AS ctx FROM customer")
def source_context(spark, d):
    """V12."""
    s = F.expr("CASE c_custkey % 5 WHEN 0 THEN '<a href=mailto:x>' WHEN 1 THEN 'Corresponding author: x' WHEN 2 THEN 'Copyright 2020' WHEN 3 THEN 'Our contacts' ELSE 'text' END")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), RU.source_context(s).alias("ctx"))
