"""Queries on lists and logs: duplicates, joins, windows, reports, times."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.functions import keys as K
from contactloom.functions import rules as RU
from contactloom.functions import text as T
from contactloom.operators import dedupe as D
from contactloom.operators import graph as G
from contactloom.operators import history as H
from contactloom.operators import reports as P
from contactloom.operators import windows as W
from contactloom.plans.addresses import _GMAIL_SQL, DOMAIN
from contactloom.plans.registry import R, query, recipients
from contactloom.session import table

NOW = "2001-08-02"
KEYED = f"k AS (SELECT *, {_GMAIL_SQL} AS key FROM r)"


def keyed(spark, d):
    return recipients(spark, d).withColumn("key", K.gmail_key(F.col("email")))


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def history(spark, d):
    return table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("timestamp").alias("sent_at"), F.col("o_orderstatus").alias("grp"), "o_orderkey")


# ------------------------------------------------------------ duplicates and sets


@query(f"WITH {R}, {KEYED} SELECT key, email, pos FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) = 1")
def dedupe_first_original(spark, d):
    """D1, D3, W1."""
    return D.first_original(recipients(spark, d), K.gmail_key(F.col("email")))


@query(f"WITH {R}, {KEYED} SELECT key, array_to_string(list_sort(list_distinct(list(lower(trim(email))))), ',') AS variants, count(DISTINCT lower(trim(email))) AS n FROM k GROUP BY 1")
def dedupe_variant_map(spark, d):
    """D2."""
    return D.variant_map(recipients(spark, d), K.gmail_key(F.col("email")))


@query(f"WITH {R}, {KEYED} SELECT pos, key, CAST(row_number() OVER w AS INTEGER) AS rank, first_value(source) OVER w AS first_source FROM k WINDOW w AS (PARTITION BY key ORDER BY pos)")
def dedupe_cross_source(spark, d):
    """D4, D5."""
    return D.across_sources(recipients(spark, d), K.gmail_key(F.col("email"))).select("pos", "key", "rank", "first_source")


@query(f"WITH {R}, {KEYED} SELECT count(*) AS total, count(DISTINCT key) AS n_unique, count(*) - count(DISTINCT key) AS duplicates, count(DISTINCT source) AS sources FROM k")
def ingest_statistics(spark, d):
    """A14, D5."""
    return keyed(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_distinct("key").alias("n_unique"), (F.count(F.lit(1)) - F.count_distinct("key")).alias("duplicates"), F.count_distinct("source").alias("sources"))


_PRE = "CASE l_partkey % 5 WHEN 0 THEN '¹' WHEN 1 THEN '1' WHEN 2 THEN '7 ' WHEN 3 THEN 'see' ELSE '' END"
_FOOT = f"""SELECT concat('doc', l_orderkey % 50) AS base, CAST(l_linenumber AS BIGINT) AS page, concat(CASE WHEN l_partkey % 3 = 0 THEN '1' ELSE '' END, 'user', l_suppkey % 7) AS local, 'mail.ru' AS domain, {_PRE} AS pre FROM lineitem"""


def _foot(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.expr("concat('doc', l_orderkey % 50)").alias("base"), F.col("l_linenumber").cast("long").alias("page"), F.expr("concat(CASE WHEN l_partkey % 3 = 0 THEN '1' ELSE '' END, 'user', l_suppkey % 7)").alias("local"), F.lit("mail.ru").alias("domain"), F.expr(_PRE).alias("pre")
    ).distinct()


@query(
    f"""WITH h AS (SELECT DISTINCT *, right(rtrim(pre), 1) IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9', '⁰', '¹', '²', '³', '⁴', '⁵', '⁶', '⁷', '⁸', '⁹') AS m FROM ({_FOOT}))
    SELECT base, page, local, pre FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.base = h.base AND g.domain = h.domain AND length(g.local) > 1 AND left(g.local, 1) BETWEEN '0' AND '9'
      AND substr(g.local, 2) = h.local AND abs(g.page - h.page) <= 1 AND (g.m OR h.m))"""
)
def footnote_merge(spark, d):
    """Equi and range anti join."""
    return D.merge_footnotes(_foot(spark, d)).select("base", "page", "local", "pre")


@query(
    f"""WITH h AS (SELECT DISTINCT * FROM ({_FOOT})), c AS (SELECT *, CASE WHEN pre LIKE '%¹' AND local LIKE '1%' THEN substr(local, 2) END AS cut FROM h)
    SELECT base, page, coalesce(cut, local) AS local, cut IS NOT NULL AS repaired FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.local = c.cut AND h.domain = c.domain)"""
)
def footnote_singletons(spark, d):
    """D7, M12."""
    return D.repair_singletons(_foot(spark, d)).select("base", "page", "local", "repaired")


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_log_latest(spark, d):
    """D9."""
    return D.latest(events(spark, d).select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "ts")


@query("SELECT user_id, max(ts) AS ts FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def upsert_greatest(spark, d):
    """H6, M2."""
    e = events(spark, d)
    return H.upsert_greatest(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), "user_id", "ts")


@query("SELECT DISTINCT s_nationkey AS nation FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 500)")
def block_list_added(spark, d):
    """D10, M5."""
    return D.added(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), table(spark, d, "customer").filter("c_acctbal < 500").select(F.col("c_nationkey").alias("nation")), "nation")


_SIDE = "SELECT DISTINCT user_id, CAST(date_trunc('day', ts) AS DATE) AS day FROM events WHERE event_type = '{}'"


@query(f"WITH a AS ({_SIDE.format('click')}), b AS ({_SIDE.format('purchase')}) SELECT *, 'click' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'purchase' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def reconcile_diff(spark, d):
    """D11, M9, O6."""
    e = events(spark, d).select("user_id", P.local_day(F.col("ts"), "UTC").alias("day"), "event_type")
    side = lambda t: e.filter(F.col("event_type") == t).drop("event_type")
    return D.differences(side("click"), side("purchase"), "click", "purchase")


@query(
    f"""WITH {R}, f AS (SELECT pos, {DOMAIN} AS domain, NOT ({DOMAIN} = 'gmail.com' OR {DOMAIN} LIKE '%.ru') AS fo, regexp_matches(lower(email), '^[0-9]') AS su FROM r),
    n AS (SELECT domain, count(*) AS n FROM f GROUP BY 1) SELECT CASE WHEN fo THEN 'foreign' WHEN su THEN 'suspicious' WHEN n > 200 THEN 'cooldown' ELSE 'ready' END AS cls, count(*) AS n FROM f JOIN n USING (domain) GROUP BY 1"""
)
def partition_classes(spark, d):
    """D12, D14."""
    e = F.col("email")
    r = recipients(spark, d).select("pos", T.domain_part(e).alias("domain"), RU.is_foreign_address(e).alias("foreign"), F.regexp_like(F.lower(e), F.lit("^[0-9]")).alias("suspicious"))
    return D.domain_classes(r, 200).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ joins


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def block_anti(spark, d):
    """Anti join."""
    return H.not_in(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def block_semi(spark, d):
    """Semi join."""
    return H.blocked_in(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT o_custkey, max(o_orderdate) AS last_at, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_group FROM orders GROUP BY 1")
def last_send_any_group(spark, d):
    """J4, M3."""
    return H.last_send(history(spark, d), "o_custkey", "sent_at", "grp", "o_orderkey")


@query("SELECT o_custkey, o_orderstatus AS grp, max(o_orderdate) AS last_at FROM orders GROUP BY 1, 2")
def last_send_per_group(spark, d):
    """W2."""
    return H.last_per_group(history(spark, d), "o_custkey", "sent_at", "grp")


_AGE = f"epoch(TIMESTAMP '{NOW}') - epoch(l)"


@query(
    f"""WITH x AS (SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS l FROM customer)
    SELECT c_custkey, coalesce({_AGE} < 180 * 86400, false) AS strict, coalesce({_AGE} <= 180 * 86400, false) AS inclusive, coalesce({_AGE} < 181 * 86400, false) AS grace,
    CASE WHEN l IS NULL THEN 0 ELSE greatest(0, 180 - CAST(floor(({_AGE}) / 86400) AS BIGINT)) END AS days_left FROM x"""
)
def cooldown_split(spark, d):
    """Three boundary rules."""
    last = history(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("sent_at").alias("l"))
    now = F.lit(NOW).cast("timestamp")
    x = table(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left")
    u = {r: H.under_window(F.col("l"), now, 180, r).alias(r) for r in ("strict", "inclusive", "grace")}
    return x.select("c_custkey", *u.values(), H.days_left(F.col("l"), now, 180).alias("days_left"))


@query(
    f"""WITH x AS (SELECT o_custkey, max(o_orderdate) AS l FROM orders GROUP BY 1), s AS (SELECT o_custkey, CAST(greatest(0, epoch(l) + 180 * 86400 - epoch(TIMESTAMP '{NOW}')) AS BIGINT) AS s FROM x)
    SELECT o_custkey, concat(s // 86400, 'd ', (s % 86400) // 3600, 'h ', (s % 3600) // 60, 'm') AS remain FROM s"""
)
def remaining_time(spark, d):
    """Z8."""
    last = history(spark, d).groupBy("o_custkey").agg(F.max("sent_at").alias("l"))
    return last.select("o_custkey", H.remaining_text(F.col("l"), F.lit(NOW).cast("timestamp"), 180).alias("remain"))


@query("SELECT event_id, ts, (SELECT max(c.ts) FROM events c WHERE c.user_id = p.user_id AND c.event_type = 'click' AND c.ts <= p.ts) AS matched FROM events p WHERE event_type = 'purchase'")
def asof_last_event(spark, d):
    """As-of join of purchases to clicks."""
    e = events(spark, d)
    p = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    c = e.filter("event_type = 'click'").select("user_id", "ts", F.col("ts").alias("v"))
    return H.asof(p, c, "user_id", "ts", "v").select("event_id", "ts", "matched")


@query("WITH g AS (SELECT o_orderkey, epoch(o_orderdate) - epoch(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS g FROM orders) SELECT o_orderkey, CAST(floor(g / 86400) AS BIGINT) AS gap_days, coalesce(g < 180 * 86400, false) AS violates FROM g")
def interval_violation(spark, d):
    """W4."""
    return H.gaps(history(spark, d), "o_custkey", "sent_at", "o_orderkey", 180).select("o_orderkey", "gap_days", "violates")


@query(
    """WITH RECURSIVE s AS (SELECT o_custkey, o_orderdate AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS n FROM orders),
    f AS (SELECT o_custkey, t AS last, n, true AS ok FROM s WHERE n = 1 UNION ALL
      SELECT s.o_custkey, CASE WHEN epoch(s.t) - epoch(f.last) >= 180 * 86400 THEN s.t ELSE f.last END, s.n, epoch(s.t) - epoch(f.last) >= 180 * 86400 FROM f JOIN s ON s.o_custkey = f.o_custkey AND s.n = f.n + 1)
    SELECT o_custkey, last AS accepted_at FROM f WHERE ok"""
)
def reserve_sequential(spark, d):
    """Fold over each key's times."""
    return H.reserve(history(spark, d), "o_custkey", "sent_at", 180)


@query(
    """WITH e AS (SELECT n_nationkey AS key, n_nationkey AS pos, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE concat('new', n_nationkey, '@x.ru') END AS new_email FROM nation WHERE n_nationkey % 2 = 0)
    SELECT c_custkey, CASE WHEN e.key IS NULL THEN concat('c', c_custkey, '@x.ru') ELSE new_email END AS email FROM customer LEFT JOIN e ON e.key = c_nationkey WHERE e.key IS NULL OR new_email IS NOT NULL"""
)
def edits_apply(spark, d):
    """J6, M7."""
    e = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key"), F.col("n_nationkey").alias("pos"), F.expr("CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE concat('new', n_nationkey, '@x.ru') END").alias("new_email"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("key"), F.expr("concat('c', c_custkey, '@x.ru')").alias("email"))
    return H.apply_edits(c, e).select("c_custkey", "email")


@query(
    """WITH a AS (SELECT o_custkey AS k, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ', ') AS s FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
    b AS (SELECT o_custkey AS k, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ', ') AS s FROM orders GROUP BY 1)
    SELECT c_custkey AS k, coalesce(a.s, b.s, 'unknown') AS sources FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey"""
)
def provenance(spark, d):
    """J7."""
    o = table(spark, d, "orders").withColumn("k", F.col("o_custkey"))
    a = o.filter("o_orderstatus = 'P'").select("k", F.col("o_orderpriority").alias("source"))
    return H.provenance(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), a, o.select("k", F.col("o_orderstatus").alias("source")), "k")


_FLAGS = f"""f AS (SELECT pos, c_nationkey, {_GMAIL_SQL} AS key, email, split_part(lower(email), '@', 1) AS l, {DOMAIN} AS dom,
   pos IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS blocked, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = pos) AS last FROM r)"""
_COOL = f"coalesce(epoch(TIMESTAMP '{NOW}') - epoch(last) < 181 * 86400, false)"


@query(f"WITH {R}, {_FLAGS} SELECT CASE WHEN l IN ('info', 'no-reply') THEN 'SKIP_ROLE' WHEN blocked THEN 'SKIP_BLOCKED' WHEN {_COOL} THEN 'SKIP_COOLDOWN' ELSE 'SEND_NOW' END AS decision, count(*) AS n FROM f GROUP BY 1")
def decision_chain(spark, d):
    """First reason wins."""
    h = history(spark, d)
    b = h.filter("grp = 'P'").select(F.col("o_custkey").alias("pos"), F.lit(True).alias("b")).distinct()
    last = h.groupBy(F.col("o_custkey").alias("pos")).agg(F.max("sent_at").alias("last"))
    e = F.col("email")
    j = recipients(spark, d).join(b, "pos", "left").join(last, "pos", "left")
    cool = H.under_window(F.col("last"), F.lit(NOW).cast("timestamp"), 180, "grace")
    dec = RU.decision(RU.is_valid_address(e), T.local_part(F.lower(e)).isin("info", "no-reply"), F.coalesce("b", F.lit(False)), cool)
    return j.groupBy(dec.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {R}, {KEYED}, b AS (SELECT DISTINCT key FROM k WHERE pos % 17 = 0), s AS (SELECT DISTINCT key FROM k WHERE pos % 19 = 0),
    l AS (SELECT key, max(o_orderdate) AS last FROM k JOIN orders ON o_custkey = pos GROUP BY 1)
    SELECT CASE WHEN key IN (FROM b) THEN 'blocked' WHEN key IN (FROM s) THEN 'suppressed' WHEN NOT ({DOMAIN} = 'gmail.com' OR {DOMAIN} LIKE '%.ru') THEN 'foreign' WHEN {_COOL} THEN 'cooldown' ELSE 'ready' END AS decision, count(*) AS n
    FROM k LEFT JOIN l USING (key) GROUP BY 1"""
)
def mass_prepare_digest(spark, d):
    """Decisions of a mailing, counted."""
    k = recipients(spark, d).withColumn("key", K.history_key(F.col("email")))
    last = k.join(history(spark, d).withColumnRenamed("o_custkey", "pos"), "pos").groupBy("key").agg(F.max("sent_at").alias("last_at"))
    p = H.prepare(recipients(spark, d), k.filter("pos % 17 = 0"), k.filter("pos % 19 = 0"), last, F.lit(NOW).cast("timestamp"), 180)
    return p.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {R}, {_FLAGS}, s AS (SELECT CASE WHEN blocked THEN 'blocked' WHEN NOT (dom = 'gmail.com' OR dom LIKE '%.ru') THEN 'foreign' WHEN l IN ('info', 'no-reply') THEN 'rejected' WHEN regexp_matches(l, '^[0-9]') THEN 'suspicious' ELSE 'valid' END AS section, key, pos FROM f)
    SELECT section, count(*) AS n, count(DISTINCT key) AS n_keys FROM s GROUP BY 1 UNION ALL SELECT 'duplicates', count(*), count(DISTINCT key) FROM (SELECT key FROM f QUALIFY count(*) OVER (PARTITION BY key) > 1)"""
)
def preview_sections(spark, d):
    """Q4, K4, K6: sections of a preview."""
    b = history(spark, d).filter("grp = 'P'").select(F.col("o_custkey").alias("pos"), F.lit(True).alias("b")).distinct()
    e = F.col("email")
    k = keyed(spark, d).join(b, "pos", "left")
    sec = F.when(F.col("b"), "blocked").when(RU.is_foreign_address(e), "foreign").when(T.local_part(F.lower(e)).isin("info", "no-reply"), "rejected").when(F.regexp_like(e, F.lit("^[0-9]")), "suspicious").otherwise("valid")
    one = k.groupBy(sec.alias("section")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"))
    dup = keyed(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").agg(F.lit("duplicates").alias("section"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("n_keys"))
    return one.unionByName(dup.select("section", "n", "n_keys"))


# ------------------------------------------------------------ windows


@query("SELECT event_id, row_number() OVER w AS place, row_number() OVER w <= 2 AS passes FROM events WINDOW w AS (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id)")
def rate_plan_minute(spark, d):
    """W5."""
    return W.rate_plan(events(spark, d), "event_type", "ts", "event_id", 2).select("event_id", "place", "passes")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS n_recent FROM events")
def sliding_minute_count(spark, d):
    """W6."""
    return W.sliding_count(events(spark, d), "event_type", "ts", 3600).select("event_id", "n_recent")


_RUN = "i AS (SELECT *, sum(CASE WHEN {0} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM events), q AS (SELECT *, CAST(sum(CASE WHEN {0} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) AS BIGINT) AS run FROM i)"


@query("WITH " + _RUN.format("event_type <> 'click'") + " SELECT event_id, run FROM q")
def nohit_run(spark, d):
    """W10."""
    return W.runs(events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") != "click").select("event_id", "run")


@query("WITH " + _RUN.format("event_type = 'error'") + " SELECT event_id, CAST(CASE WHEN run > 0 THEN greatest(2, least(pow(2, run - 1), 60)) ELSE 0 END AS BIGINT) AS delay FROM q")
def backoff_run(spark, d):
    """W9."""
    return W.runs(events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", W.backoff(F.col("run"), 2, 60).alias("delay"))


@query("WITH RECURSIVE s AS (SELECT user_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), w AS (SELECT user_id, n, greatest(0.0::DOUBLE, least(5.0::DOUBLE, CASE WHEN f THEN 1.0::DOUBLE ELSE -0.25::DOUBLE END)) AS v FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.n, greatest(0.0::DOUBLE, least(5.0::DOUBLE, v + CASE WHEN f THEN 1.0::DOUBLE ELSE -0.25::DOUBLE END)) FROM w JOIN s ON s.user_id = w.user_id AND s.n = w.n + 1) SELECT user_id, round(arg_max(v, n), 6) AS delay FROM w GROUP BY 1")
def adaptive_delay(spark, d):
    """W8."""
    return W.adaptive_delay(events(spark, d), "user_id", "event_id", F.col("event_type") == "error", 1.0, 0.25, 5.0)


@query("SELECT event_id, ts FROM events WHERE ts = (SELECT max(ts) FROM events)")
def last_batch_rows(spark, d):
    """W11."""
    return W.last_batch(events(spark, d), "ts").select("event_id", "ts")


@query("WITH g AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) AS BIGINT) AS gap FROM events) SELECT event_id, gap FROM g WHERE gap < 60")
def min_gap(spark, d):
    """W12."""
    return W.too_close(events(spark, d), "event_type", "ts", "event_id", 60).select("event_id", "gap")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host FROM pages QUALIFY row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) ORDER BY page_id) <= 5")
def domain_page_cap(spark, d):
    """The cap is the operator."""
    p = table(spark, d, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))
    return W.capped(p, "host", ["page_id"], 5)


@query(
    """WITH g AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS page, max(CAST(l_quantity AS BIGINT) % 3) AS hits FROM lineitem GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page % 3 <> 0, page) AS rank FROM g),
    c AS (SELECT *, coalesce(sum(hits) OVER w, 0) AS found, coalesce(max(CASE WHEN hits > 0 THEN rank END) OVER w, 0) AS last_hit FROM p WINDOW w AS (PARTITION BY doc ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT doc, page, rank FROM c WHERE found < 3 AND rank - last_hit <= 2"""
)
def sampled_page_scan(spark, d):
    """Early stop as a filter on running sums."""
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("page"), (F.col("l_quantity").cast("long") % 3).alias("hits"))
    p = p.groupBy("doc", "page").agg(F.max("hits").alias("hits"))
    return W.sampled_scan(p, "doc", "page", "hits", 3, 2, 3).select("doc", "page", "rank")


@query("WITH g AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) AS g FROM events) SELECT event_id, user_id FROM g WHERE g IS NULL OR g >= 86400")
def idempotent_24h(spark, d):
    """H2, H3, H8."""
    return W.idempotent(events(spark, d), "user_id", "ts", "event_id", 86400).select("event_id", "user_id")


@query("SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 20 AS BIGINT) AS chunk FROM customer")
def chunks(spark, d):
    """O7."""
    return W.chunked(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", ["c_custkey"], 20).select("c_custkey", "chunk")


# ------------------------------------------------------------ reports


@query("SELECT 'type' AS dim, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2")
def grouping_sets_summary(spark, d):
    """Several dimensions in one pass."""
    return P.summary(events(spark, d).withColumnRenamed("event_type", "type"), "type", "user_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_users(spark, d):
    """O2: top-k with a stated tie rule."""
    return P.top(events(spark, d), "user_id", 20)


@query("SELECT CAST(date_trunc('week', ts + INTERVAL 3 HOUR) AS DATE) AS week, count_if(event_type IN ('purchase', 'click')) AS ok, count_if(event_type = 'error') AS err FROM events GROUP BY 1")
def week_report(spark, d):
    """Local weeks from Monday."""
    e = events(spark, d).withColumn("week", F.to_date(F.date_trunc("week", F.from_utc_timestamp("ts", "Europe/Moscow"))))
    return P.ok_err(e, F.col("event_type").isin("purchase", "click"), F.col("event_type") == "error", "week")


@query("WITH u AS (SELECT ts, event_type AS s FROM events UNION ALL SELECT o_orderdate, 'purchase' FROM orders) SELECT count_if(s IN ('purchase', 'click')) AS ok, count_if(s = 'error') AS err FROM u WHERE ts >= TIMESTAMP '2024-01-09 21:00:00' AND ts < TIMESTAMP '2024-01-10 21:00:00'")
def union_logs_day_report(spark, d):
    """Two logs, one local day."""
    u = events(spark, d).select("ts", F.col("event_type").alias("s")).unionByName(history(spark, d).select(F.col("sent_at").alias("ts"), F.lit("purchase").alias("s")))
    return P.ok_err(u.filter(P.in_day(F.col("ts"), "2024-01-10", "Europe/Moscow")), F.col("s").isin("purchase", "click"), F.col("s") == "error")


@query("WITH p AS (SELECT unnest(['day', 'week', 'month', 'year']) AS period, unnest([1, 7, 30, 365]) AS days) SELECT period, count(*) AS n, count_if(event_type = 'purchase') AS ok FROM events, p WHERE epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) >= 0 AND epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) < days * 86400 GROUP BY 1")
def rolling_report(spark, d):
    """A5."""
    return P.rolling(events(spark, d), "ts", "2024-01-31", {"day": 1, "week": 7, "month": 30, "year": 365}, F.col("event_type") == "purchase")


@query("SELECT CAST(ts AS DATE) AS day, count_if(event_type = 'click') AS click, count_if(event_type = 'purchase') AS purchase, count_if(event_type = 'error') AS error, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def status_pivot(spark, d):
    """A4."""
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    n = lambda t: F.count_if(F.col("event_type") == t).alias(t)
    return e.groupBy("day").agg(n("click"), n("purchase"), n("error"), F.count_distinct("user_id").alias("users"))


_REASONS = "CASE o_orderkey % 7 WHEN 0 THEN 'sent' WHEN 1 THEN 'skip_cooldown' WHEN 2 THEN 'foreign_domain' WHEN 3 THEN 'Duplicate today' WHEN 4 THEN 'hard bounce' WHEN 5 THEN 'smtp timeout' ELSE '' END"


@query(f"SELECT CASE o_orderkey % 7 WHEN 0 THEN 'sent' WHEN 1 THEN 'cooldown' WHEN 2 THEN 'blocked' WHEN 3 THEN 'unchanged' WHEN 4 THEN 'undeliverable' ELSE 'error' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def outcome_histogram(spark, d):
    """A6, V21."""
    return table(spark, d, "orders").groupBy(RU.outcome_of(F.expr(_REASONS)).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS hits, arg_max(CAST(500 + event_id % 50 AS BIGINT), (ts, event_id)) AS last_code FROM events WHERE event_type = 'error' GROUP BY 1")
def bounce_counter(spark, d):
    """A12."""
    e = events(spark, d).filter("event_type = 'error'").withColumn("code", 500 + F.col("event_id") % 50)
    return P.bounce_counter(e, "user_id", "ts", "event_id", "code")


@query("SELECT c_nationkey, mode(c_mktsegment ORDER BY c_mktsegment) AS common, median(c_acctbal) AS middle FROM customer GROUP BY 1")
def mode_and_median(spark, d):
    """A16, A17, S11."""
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.mode("c_mktsegment", True).alias("common"), F.median("c_acctbal").alias("middle"))


@query("SELECT format('{} sent, {} failed, {} users', count_if(event_type = 'purchase'), count_if(event_type = 'error'), count(DISTINCT user_id)) AS line FROM events")
def summary_text(spark, d):
    """A15."""
    n = lambda t: F.count_if(F.col("event_type") == t)
    return events(spark, d).agg(F.format_string("%d sent, %d failed, %d users", n("purchase"), n("error"), F.count_distinct("user_id")).alias("line"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 20")
def page_offset(spark, d):
    """Limit and offset are the operator."""
    return P.page_window(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate")), [F.desc("o_orderdate"), F.asc("o_orderkey")], 20, 10)


@query("SELECT DISTINCT c_nationkey FROM customer ORDER BY 1 LIMIT 3")
def sample_preview(spark, d):
    """O1, O3."""
    return table(spark, d, "customer").select("c_nationkey").distinct().orderBy("c_nationkey").limit(3)


@query("SELECT c_nationkey, count(*) AS n, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS neg FROM customer GROUP BY ROLLUP (c_nationkey)")
def rollup_counts(spark, d):
    """An extension of A1: subtotals."""
    return table(spark, d, "customer").rollup("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("neg"))


# ------------------------------------------------------------ times


_STAMP = "CASE o_orderkey % 5 WHEN 0 THEN '2024-05-01T10:00:00+03:00' WHEN 1 THEN '2024-05-01T12:00:00' WHEN 2 THEN 'yesterday' WHEN 3 THEN '1714550400' ELSE '2024-04-30T21:00:00Z' END"


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN TIMESTAMP '2024-05-01 07:00:00' WHEN 1 THEN TIMESTAMP '2024-05-01 12:00:00' WHEN 3 THEN TIMESTAMP '2024-05-01 08:00:00' WHEN 4 THEN TIMESTAMP '2024-04-30 21:00:00' END AS ts, CASE o_orderkey % 5 WHEN 0 THEN TIMESTAMP '2024-05-01 07:00:00' WHEN 1 THEN TIMESTAMP '2024-05-01 09:00:00' WHEN 3 THEN TIMESTAMP '2024-05-01 08:00:00' WHEN 4 THEN TIMESTAMP '2024-04-30 21:00:00' END AS ts_moscow FROM orders")
def iso_parse(spark, d):
    """Junk is null; naive text in UTC or a local zone; epoch seconds."""
    from contactloom.sources.logs import parse_time

    c = F.expr(_STAMP)
    return table(spark, d, "orders").select("o_orderkey", parse_time(c).alias("ts"), parse_time(c, "Europe/Moscow").alias("ts_moscow"))


_RANGE = "CASE o_orderkey % 5 WHEN 0 THEN '2024-05-01' WHEN 1 THEN '01.05.2024-07.05.2024' WHEN 2 THEN '2024' WHEN 3 THEN '2024-02' ELSE 'soon' END"


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN DATE '2024-05-01' WHEN 1 THEN DATE '2024-05-01' WHEN 2 THEN DATE '2024-01-01' WHEN 3 THEN DATE '2024-02-01' END AS first, CASE o_orderkey % 5 WHEN 0 THEN DATE '2024-05-01' WHEN 1 THEN DATE '2024-05-07' WHEN 2 THEN DATE '2024-12-31' WHEN 3 THEN DATE '2024-02-29' END AS last FROM orders")
def date_range_parse(spark, d):
    """Z3."""
    from contactloom.functions.dates import date_range

    return table(spark, d, "orders").select("o_orderkey", date_range(F.expr(_RANGE)).alias("r")).select("o_orderkey", "r.first", "r.last")


@query("SELECT CAST(ts + INTERVAL 3 HOUR AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def local_midnight(spark, d):
    """Z6."""
    return events(spark, d).groupBy(P.local_day(F.col("ts"), "Europe/Moscow").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(spark, d):
    """H7."""
    return events(spark, d).groupBy("event_type", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("window.start").alias("start"), "n")


@query("SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE AS start, count(*) AS n FROM events, (VALUES (0), (1)) v(o) GROUP BY 1, 2")
def sliding_window(spark, d):
    """H7."""
    return events(spark, d).groupBy("event_type", F.window("ts", "1 hour", "30 minutes")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("window.start").alias("start"), "n")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def session_windows(spark, d):
    """H11, an extension."""
    return events(spark, d).groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).select("user_id", "start", "n")


# ------------------------------------------------------------ pages and links


def _strip_sql(x: str) -> str:
    rules = [("(?is)<script[^>]*>.*?</script>", " "), ("(?is)<style[^>]*>.*?</style>", " "), ("(?i)<(?:br|/p|/li|/div|/h[1-6])[^>]*>", "\n"), ("<[^>]+>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"), ("[ \t]+", " "), (" ?\n[ \n]*", "\n")]
    for p, to in rules:
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return f"trim({x})"


@query(f"SELECT page_id, {_strip_sql('html')} AS text FROM pages")
def html_strip_text(spark, d):
    """T17, M15."""
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href, CAST(generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) - 1 AS INTEGER) AS pos FROM pages")
def html_links(spark, d):
    """X14."""
    from contactloom.operators.extract import links

    return links(table(spark, d, "pages").select("page_id", "html"))


@query("WITH l AS (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages) SELECT concat('/', regexp_extract(h, '^/([^/?#]+)', 1), '/') AS prefix, count(*) AS n FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def link_prefix_topk(spark, d):
    """A11, T29, V24."""
    from contactloom.operators.extract import links

    return P.top(links(table(spark, d, "pages").select("page_id", "html")).select(T.top_prefix(F.col("href")).alias("prefix")), "prefix", 12)


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS canonical, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host, regexp_matches(url, '^[a-z]+://[^/]*/(en|fr)') AS allowed FROM pages")
def url_canonical(spark, d):
    """T29, V24."""
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.canonical_url(u).alias("canonical"), T.url_host(u).alias("host"), RU.path_allowed(u, ["/en", "/fr"]).alias("allowed"))


@query(
    """WITH RECURSIVE e AS (SELECT page_id AS src, 2 * page_id AS dst FROM pages UNION ALL SELECT page_id, 2 * page_id + 1 FROM pages),
    b AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM b JOIN e ON src = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM b GROUP BY 1"""
)
def crawl_bfs(spark, d):
    """Bounded breadth-first search."""
    p = table(spark, d, "pages").select("page_id")
    e = p.select(F.col("page_id").alias("src"), F.explode(F.array(F.col("page_id") * 2, F.col("page_id") * 2 + 1)).alias("dst"))
    return G.crawl(e, spark.range(1, 2).select(F.col("id").alias("node")), 3)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, d):
    """X10."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT c_custkey AS k, 'contact@site.com' AS email, 'ldjson' AS origin FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'a+b@site.com', 'mailto' FROM customer WHERE c_custkey % 4 = 1 UNION ALL SELECT c_custkey, 'contact@site.com', 'bundle' FROM customer WHERE c_custkey % 4 = 2 UNION ALL SELECT c_custkey, 'seen@site.com', 'text' FROM customer WHERE c_custkey % 4 = 3")
def page_hit_origins(spark, d):
    """Hits of pages by origin, first tier with any."""
    from contactloom.operators.extract import page_hits, tiered

    html = F.expr(
        """CASE c_custkey % 4 WHEN 0 THEN '<script type="application/ld+json">{"email":"contact@site.com"}</script>' WHEN 1 THEN '<a href="mailto:a+b@site.com?subject=x">write</a>'
        WHEN 2 THEN '<script>var a = atob("Y29udGFjdEBzaXRlLmNvbQ==")</script>' ELSE '<p>seen@site.com</p>' END"""
    )
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), html.alias("html"))
    order = {"text": 0, "mailto": 0, "cfemail": 0, "obfuscated": 0, "ldjson": 1, "bundle": 2}
    return tiered(page_hits(p, "k"), "k", order).select("k", "email", "origin")


@query(
    """SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linenumber = 7 THEN 'encrypted' WHEN l_linenumber = 6 THEN 'denied_suffix' WHEN l_linenumber = 5 THEN 'too_deep'
    WHEN l_linenumber IN (2, 3) THEN 'unsafe_path' WHEN l_linenumber = 4 AND l_suppkey % 3 = 0 THEN 'bomb_ratio' END AS reason FROM lineitem"""
)
def zip_guard(spark, d):
    """Every reason to refuse a member; a large one is a bomb only if it unpacks from next to nothing."""
    li = table(spark, d, "lineitem")
    name = F.expr("CASE l_linenumber WHEN 2 THEN 'a/../../etc/passwd' WHEN 3 THEN '/root/a.txt' WHEN 5 THEN 'a/b/c/d/e.txt' WHEN 6 THEN 'a/Run.EXE' WHEN 7 THEN '../a.exe' ELSE 'a/b/c/doc.txt' END")
    size = F.expr("CASE WHEN l_linenumber = 4 AND l_suppkey % 3 <> 2 THEN 60 * 1024 * 1024 ELSE 100 END")
    packed = F.expr("CASE WHEN l_linenumber = 4 AND l_suppkey % 3 = 1 THEN 20000 ELSE 1 END")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), RU.zip_member_reason(name, size, packed, F.col("l_linenumber") == 7).alias("reason"))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' ELSE 'xlsx' END AS kind, CASE c_custkey % 3 WHEN 1 THEN 'b.txt' END AS member, CASE c_custkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 END AS page, CASE c_custkey % 3 WHEN 2 THEN 'B12' END AS cell FROM customer")
def source_reference(spark, d):
    """Parts of a source reference."""
    from contactloom.sources.files import source_ref

    ref = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'pdf:/p#page=5' WHEN 1 THEN 'zip:a.zip|b.txt#page=2' ELSE 'xlsx:/f!Sheet:B12' END")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), source_ref(ref).alias("r")).select("id", "r.kind", "r.member", "r.page", "r.cell")


_MX = "CASE s_nationkey % 6 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'Univ.EDU' WHEN 2 THEN 'company.ru' WHEN 3 THEN 'yandex.ru' ELSE 'other.org' END"


@query(
    f"""WITH {R}, m AS (SELECT lower({_MX}) AS domain, bool_or(s_suppkey % 2 = 0 AND NOT {_MX} IN ('Univ.EDU', 'company.ru')) AS has_mx FROM supplier GROUP BY 1)
    SELECT pos, lower(split_part(email, '@', 2)) AS domain, coalesce(has_mx, true) AS keep FROM r LEFT JOIN m ON m.domain = lower(split_part(email, '@', 2))"""
)
def mx_filter(spark, d):
    """Addresses of domains that were looked up and have no mail exchange go; those of unknown domains stay."""
    found = (F.col("s_suppkey") % 2 == 0) & ~F.expr(_MX).isin("Univ.EDU", "company.ru")
    facts = table(spark, d, "supplier").groupBy(F.lower(F.expr(_MX)).alias("domain")).agg(F.bool_or(found).alias("has_mx"))
    r = recipients(spark, d).withColumn("domain", T.domain_part(F.col("email")))
    return r.join(facts, "domain", "left").select("pos", "domain", F.coalesce("has_mx", F.lit(True)).alias("keep"))


