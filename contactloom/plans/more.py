"""Further queries: cleaning of whole texts, link policies, log maintenance, messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.functions import rules as RU
from contactloom.functions import text as T
from contactloom.functions import values as V
from contactloom.operators import extract as X
from contactloom.operators import history as H
from contactloom.operators import windows as W
from contactloom.plans.addresses import _GMAIL_SQL, AT, DOMAIN
from contactloom.plans.registry import R, query, recipients, sql_in
from contactloom.session import table


def _sub(x: str, *rules: tuple[str, str]) -> str:
    for p, to in rules:
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return x


_VISIBLE = _sub("text", (T.INVISIBLE, ""))
_PRECLEAN = _sub(f"translate({_VISIBLE}, '{T.CONFUSABLES_FROM}', '{T.CONFUSABLES_TO}')", (T.SPACES, " "), ("\\r\\n?", "\n"), ("[ \\t]*@[ \\t]*", "@"), (T.DOT_LIKE, "."), ("[ \\t]+", " "))


@query(f"SELECT doc_id, {_PRECLEAN} AS text FROM documents")
def preclean_text(spark, d):
    """T4, T5 on documents."""
    return table(spark, d, "documents").select("doc_id", T.preclean(F.col("text")).alias("text"))


_MARKS = f"translate({_sub(_sub('text', (T.SPACES, ' ')), (T.INVISIBLE, ''))}, '{T.HOMOGLYPHS_FROM}', '{T.HOMOGLYPHS_TO}')"


@query(f"SELECT doc_id, translate({_MARKS}, '{T.DASHES_FROM}{T.QUOTES_FROM}{T.FULLWIDTH_FROM}', '{T.DASHES_TO}{T.QUOTES_TO.replace(chr(39), chr(39) * 2)}{T.FULLWIDTH_TO}') AS text FROM documents")
def normalize_marks(spark, d):
    """T1 (the part without Unicode tables), T26."""
    return table(spark, d, "documents").select("doc_id", T.normalize_marks(F.col("text")).alias("text"))


@query(f"WITH {R}, x AS (SELECT pos, concat('see ', replace(email, '@', ' @ '), ' today') AS t FROM r) SELECT pos, lower(regexp_extract(regexp_replace(t, '[ \\t]*([@])[ \\t]*', '\\1', 'g'), {AT})) AS email FROM x")
def harvest(spark, d):
    """Addresses with blanks round the @."""
    t = recipients(spark, d).select("pos", F.concat(F.lit("see "), F.replace("email", F.lit("@"), F.lit(" @ ")), F.lit(" today")).alias("text"))
    return X.harvest(t, "pos").select("pos", "email")


@query(f"WITH {R}, x AS (SELECT pos, concat('please write to the office, ', email, ', before the end of May') AS t, email FROM r) SELECT pos, substr(t, greatest(1, strpos(t, email) - 16), strpos(t, email) + length(email) + 16 - greatest(1, strpos(t, email) - 16)) AS ctx FROM x")
def context_window(spark, d):
    """Sixteen characters on either side."""
    t = recipients(spark, d).withColumn("t", F.concat(F.lit("please write to the office, "), "email", F.lit(", before the end of May")))
    return t.select("pos", T.context(F.col("t"), F.expr("instr(t, email)"), F.length("email")).alias("ctx"))


@query(f"WITH {R} SELECT c_nationkey, count(*) FILTER ({DOMAIN} NOT LIKE '%.ru') AS n, coalesce(array_to_string((list_sort(list_distinct(list(lower(email)) FILTER ({DOMAIN} NOT LIKE '%.ru'))))[1:3], ' '), '') AS samples FROM r GROUP BY 1")
def tld_filter_samples(spark, d):
    """Refused endings of each group, counted, with three samples; no text where nothing is refused."""
    other = ~T.domain_part(F.col("email")).endswith(".ru")
    r = recipients(spark, d).withColumn("low", F.when(other, F.lower("email")))
    return r.groupBy("c_nationkey").agg(F.count("low").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("low")), 1, 3), " ").alias("samples"))


@query("SELECT page_id, regexp_matches(url, '^https?://') AS scheme_ok, split_part(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1), '.', -1) IN ('com', 'org') AS tld_ok, length(html) <= 1000000 AS size_ok FROM pages")
def fetch_policy(spark, d):
    """Scheme, ending and size rules on pages."""
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_like(u, F.lit("^https?://")).alias("scheme_ok"), RU.is_allowed_tld(T.url_host(u), ("com", "org")).alias("tld_ok"), (F.length("html") <= 1_000_000).alias("size_ok"))


@query("WITH x AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host, concat('<url><loc>', url, CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' ELSE '.html' END, '</loc></url>') AS x FROM pages), l AS (SELECT page_id, host, regexp_extract(x, '<loc>([^<]*)</loc>', 1) AS loc FROM x) SELECT page_id, host, loc FROM l WHERE regexp_matches(loc, '\\.(pdf|docx?|xlsx?|txt)$') QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) <= 30")
def sitemap_documents(spark, d):
    """Document links of site maps, thirty a host (the cap is the operator)."""
    p = table(spark, d, "pages")
    xml = F.concat(F.lit("<url><loc>"), "url", F.expr("CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' ELSE '.html' END"), F.lit("</loc></url>"))
    loc = F.explode(F.regexp_extract_all(xml, F.lit("<loc>([^<]*)</loc>"), F.lit(1)))
    x = p.select("page_id", T.url_host(F.col("url")).alias("host"), loc.alias("loc")).filter(F.regexp_like("loc", F.lit("\\.(pdf|docx?|xlsx?|txt)$")))
    return W.capped(x, "host", ["page_id"], 30)


@query(f"WITH h AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, {AT}))) AS email, generate_subscripts(regexp_extract_all(text, {AT}), 1) - 1 AS pos FROM documents) SELECT doc_id, email, CAST(min(pos) AS INTEGER) AS pos FROM h WHERE split_part(split_part(email, '@', 2), '.', -1) IN ({sql_in(V.KNOWN_TLDS)}) AND split_part(email, '@', 1) NOT LIKE '.%' AND split_part(email, '@', 1) NOT LIKE '%.' AND NOT contains(email, '..') GROUP BY 1, 2")
def extract_valid(spark, d):
    """Valid addresses by place."""
    return X.extract_valid(table(spark, d, "documents").select("doc_id", "text"), "doc_id")[0].select("doc_id", "email", "pos")


@query("SELECT concat_ws(',', c_custkey, c_mktsegment, c_nationkey) AS line FROM customer")
def csv_lines(spark, d):
    """K8: rows as CSV text."""
    from contactloom.sources.sinks import csv_rows

    return csv_rows(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"))


@query(f"WITH {R} SELECT email, source AS reason, 'blocked' AS section FROM r WHERE pos % 2 = 0")
def preview_rows(spark, d):
    """K6: rows without a reason are left out."""
    from contactloom.sources.sinks import preview_stats

    r = recipients(spark, d).select("email", F.when(F.col("pos") % 2 == 0, F.col("source")).otherwise(F.lit("")).alias("reason"), F.lit("blocked").alias("section"))
    return preview_stats(r)


@query("SELECT o_orderkey, c_acctbal < 0 AS unsubscribed FROM orders JOIN customer ON c_custkey = o_custkey")
def unsubscribe_update(spark, d):
    """Every log row of an address is flagged."""
    out = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("f"))
    return table(spark, d, "orders").join(out, "o_custkey", "left").select("o_orderkey", F.coalesce("f", F.lit(False)).alias("unsubscribed"))


@query("WITH s AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS ok, max(ts) FILTER (event_type = 'error') AS bad, arg_max(event_id, ts) FILTER (event_type = 'error') AS id FROM events GROUP BY 1) SELECT user_id, bad + INTERVAL 1 HOUR AS next_retry_at FROM s WHERE bad IS NOT NULL AND (ok IS NULL OR ok < bad) AND bad + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-29' AND id % 4 < 3")
def retries_due(spark, d):
    """H9: soft bounces to try again; a later success removes them."""
    from contactloom.streaming.logs import due_retries

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "soft")
    e = e.select("user_id", "ts", status.alias("status"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("next_retry_at"), (F.col("event_id") % 4).alias("retry_count"), F.lit(3).alias("max_retries"))
    return due_retries(e, "2024-01-29", "user_id")


@query("SELECT user_id, event_type, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS k FROM events GROUP BY 1, 2")
def latest_preferences(spark, d):
    """M8: the last setting of each pair, from JSON text."""
    from contactloom.operators.dedupe import latest

    e = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.get_json_object("props", "$.k").alias("k"))
    return latest(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "k")


@query("WITH a AS (SELECT concat('u', user_id, '@x.ru') AS email_norm, event_type AS group_key, date_trunc('second', ts) AS sent_at, 0 AS o FROM events WHERE event_type = 'purchase'), b AS (SELECT concat('u', o_custkey, '@x.ru'), o_orderstatus, o_orderdate, 1 FROM orders) SELECT email_norm, lower(group_key) AS group_key, sent_at, max(o) AS origin FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2, 3")
def migrate_logs(spark, d):
    """M1, M2: one history from both logs."""
    from contactloom.sources.logs import migrate

    iso = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    e = table(spark, d, "events").filter("event_type = 'purchase'")
    a = e.select(F.expr("concat('u', user_id, '@x.ru')").alias("email"), F.col("event_type").alias("group"), F.lit("sent").alias("status"), iso("ts").alias("ts"))
    b = table(spark, d, "orders").select(F.expr("concat('u', o_custkey, '@x.ru')").alias("email"), F.col("o_orderstatus").alias("source"), F.lit("ok").alias("status"), iso("o_orderdate").alias("last_sent_at"))
    return migrate(a, b, F.lit("2024-06-01").cast("timestamp"))


@query(f"WITH {R}, t AS (SELECT pos, {_GMAIL_SQL} AS key, sha256(concat_ws('|', {_GMAIL_SQL}, pos % 5)) AS token FROM r) SELECT pos FROM t WHERE (key, token) IN (SELECT key, sha256(concat_ws('|', key, 0)) FROM t)")
def token_verification(spark, d):
    """Semi join on address and token."""
    from contactloom.functions.keys import gmail_key

    k = recipients(spark, d).withColumn("key", gmail_key(F.col("email")))
    token = lambda n: T.send_key(F.col("key"), n.cast("string"))
    issued = k.select("key", token(F.lit(0)).alias("token")).distinct()
    return k.select("pos", "key", token(F.col("pos") % 5).alias("token")).join(issued, ["key", "token"], "left_semi").select("pos")


@query("SELECT c_custkey AS id, c_custkey % 2 = 0 AS is_bounce, CASE WHEN c_custkey % 2 = 0 THEN concat('user', c_custkey, '@x.ru') END AS original_to, CASE WHEN c_custkey % 2 = 0 THEN '5.1.1' END AS dsn_status, c_custkey % 2 = 1 AS wants_out, TIMESTAMP '2024-05-01 07:00:00' AS sent_at FROM customer")
def bounce_messages(spark, d):
    """Raw messages to rows."""
    from contactloom.sources.mail import messages

    raw = F.expr(
        """CASE WHEN c_custkey % 2 = 0 THEN concat_ws(char(10), 'From: MAILER-DAEMON <postmaster@x.ru>', 'Date: Wed, 01 May 2024 10:00:00 +0300', 'Content-Type: multipart/report; boundary=b', '', '--b',
        'Content-Type: message/delivery-status', '', 'Reporting-MTA: dns; x', '', concat('Final-Recipient: rfc822; user', c_custkey, '@x.ru'), 'Action: failed', 'Status: 5.1.1', '', '--b--', '')
        ELSE concat_ws(char(10), 'From: jane@z.ru', 'Date: Wed, 01 May 2024 07:00:00 +0000', 'Subject: unsubscribe', '', 'please', '') END"""
    )
    m = messages(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), raw.cast("binary").alias("raw")))
    return m.select("id", "is_bounce", "original_to", "dsn_status", "wants_out", "sent_at")


@query("SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) < TIMESTAMP '2001-02-03' IS NOT FALSE AND c_acctbal >= 0 AS ready FROM customer")
def send_list(spark, d):
    """Q6, Q8, M4: who may be sent to: not blocked, nothing recent."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("last_at"))
    j = table(spark, d, "customer").join(last, "c_custkey", "left")
    recent = H.under_window(F.col("last_at"), F.lit("2001-08-02").cast("timestamp"), 180, "inclusive")
    return j.select("c_custkey", (~recent & (F.col("c_acctbal") >= 0)).alias("ready"))
