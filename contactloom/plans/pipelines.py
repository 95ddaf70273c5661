"""End-to-end queries: text to classified addresses, and files to text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.functions import keys as K
from contactloom.functions import rules as RU
from contactloom.functions import text as T
from contactloom.functions import values as V
from contactloom.operators import extract as X
from contactloom.plans import relations  # noqa: F401  registers the batch twin of a stream
from contactloom.plans.registry import ADDRESS, ORACLE_SQL, query, sql_in
from contactloom.session import table


def classify_hits(hits: DataFrame, key: str, mx: DataFrame | None = None) -> DataFrame:
    """Q1: one row for each hit with its final address, reason and stage of refusal, and role.

    hits: `key`, pos, email, text, and the hit's place `at` if it is known.  Stages run in order: shape,
    ending, typo, mail exchange, role, foreign, duplicate; the first that refuses is named.  A null `key`
    has no duplicates.
    """
    # each hit is judged by what stands around itself
    at = F.col("at") if "at" in hits.columns else F.get(X.places(F.col("text")), F.col("pos"))
    h = hits.withColumn("snippet", T.context(F.col("text"), at, F.length("email"), 180)).select(key, "pos", "email", "snippet")
    # what later steps use several times is a column of its own, evaluated once for a hit
    h = h.withColumn("clean", T.postclean(T.trim_appended(T.strip_phone_prefix(F.col("email")))))
    h = h.withColumn("fixed", T.fix_domain_typo(F.col("clean"))).withColumn("final", K.transport_address(F.col("fixed"))).withColumn("domain", T.domain_part(F.col("final")))
    if mx is not None:
        h = h.join(mx.select("domain", "has_mx"), "domain", "left")
    else:
        h = h.withColumn("has_mx", F.lit(None).cast("boolean"))
    h = h.withColumn("local", T.local_part(F.col("final")))
    h = h.withColumns({"role": RU.role_score(F.col("local"), F.col("domain"), F.col("snippet")), "key": K.gmail_key(F.col("final")), "shape": RU.strict_reason(F.col("final"))})
    h = h.withColumns({c: F.col(f"role.{c}") for c in ("role_class", "role_score", "role_reason")})
    refused = (
        F.when(F.col("shape").isNotNull(), "shape")
        .when(~F.coalesce(RU.tld(F.col("domain")).isin(V.KNOWN_TLDS), F.lit(False)), "tld")
        .when(~F.coalesce("has_mx", F.lit(True)), "mx")
        .when(F.col("role_class") == "role", "role")
    )
    h = h.withColumn("refused", refused)
    stage = F.col("refused")
    reason = F.when(stage == "shape", F.col("shape")).when(stage == "tld", "unknown_tld").when(stage == "mx", "no_mx").when(stage == "role", F.col("role_reason"))
    # one window, so hits are judged once; hits of a null key lie apart and have no first one
    alone = F.when(F.col(key).isNull(), F.xxhash64("email", "pos"))
    first = F.when(F.col(key).isNotNull(), F.min(F.when(stage.isNull(), F.col("pos"))).over(Window.partitionBy(key, "key", alone)))
    h = h.withColumns({"reason": reason, "first": first})
    dup = stage.isNull() & F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    return h.select(
        key, "pos", "email", "final", "key", RU.domain_class(F.col("final")).alias("domain_class"), "role_class", "role_score",
        F.when(dup, "duplicate").otherwise(stage).alias("stage"), F.when(dup, "duplicate").otherwise(F.col("reason")).alias("reason"),
    )


_TEXT = f"concat('Contact: ', {ADDRESS}, ' or ', lower({ADDRESS}), ', info@site.zzz')"
_AT = "'[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,}'"


def _extract_texts(customers: DataFrame) -> DataFrame:
    """A text of each customer; the work is in the texts, so keys are dealt to as many tasks as a shuffle has, however few files there are."""
    n = int(customers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return customers.select("c_custkey").repartition(n).select(F.col("c_custkey").alias("doc"), F.expr(_TEXT).alias("text"))


@query(
    f"""WITH t AS (SELECT c_custkey AS doc, {_TEXT} AS text FROM customer), h AS (SELECT doc, lower(unnest(regexp_extract_all(text, {_AT}))) AS e, generate_subscripts(regexp_extract_all(text, {_AT}), 1) - 1 AS pos FROM t),
    s AS (SELECT doc, pos, CASE WHEN split_part(e, '.', -1) NOT IN ({sql_in(V.KNOWN_TLDS)}) THEN 'tld' WHEN contains(e, 'no-reply') OR split_part(e, '@', 1) = 'info' OR list_contains(string_split(split_part(e, '@', 2), '.'), 'mail') THEN 'role' WHEN pos > 0 THEN 'duplicate' ELSE 'kept' END AS stage FROM h)
    SELECT stage, count(*) AS n FROM s GROUP BY 1"""
)
def extract_pipeline(spark, d):
    """Q1, Q2: text to classified addresses with the stage that refuses, counted."""
    t = _extract_texts(table(spark, d, "customer"))
    c = classify_hits(X.hits(t, at=True), "doc")
    return c.groupBy(F.coalesce("stage", F.lit("kept")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p.page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages) p GROUP BY 1")
def url_ingest_summary(spark, d):
    """Q5: links of each page, counted."""
    return X.links(table(spark, d, "pages").select("page_id", "html")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


def ingest_summary(pages: DataFrame, blocked: DataFrame) -> DataFrame:
    """Q5: url, pages, total_in, ok and blocked of each url of `pages` (page_id, url, html), with zeros where nothing is found.

    total_in: hits by page, origin and address; ok: distinct keys of valid addresses; blocked: those
    of them whose key is in `blocked` (key).  Rows without a url are one url, null.
    """
    p = pages.select(F.struct("page_id", T.canonical_url(F.col("url")).alias("url")).alias("page"), "html")
    h = X.page_hits(p, "page").withColumn("final", K.transport_address(T.fix_domain_typo(T.postclean(T.trim_appended(T.strip_phone_prefix(F.col("email")))))))
    valid = RU.strict_reason(F.col("final")).isNull() & F.coalesce(RU.tld(T.domain_part(F.col("final"))).isin(V.KNOWN_TLDS), F.lit(False))
    h = h.select(F.col("page.url").alias("url"), F.when(valid, K.gmail_key(F.col("final"))).alias("key"))
    counted = h.groupBy("url", "key").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.join(blocked.select("key", F.lit(1).alias("b")).distinct(), "key", "left")
    zero = F.lit(0).cast("long")
    rows = counted.select("url", zero.alias("pages"), F.col("n").alias("total_in"), F.when(F.col("key").isNotNull(), 1).otherwise(0).alias("ok"), F.coalesce("b", F.lit(0)).alias("blocked"))
    rows = rows.unionByName(p.select(F.col("page.url").alias("url"), F.lit(1).alias("pages"), zero.alias("total_in"), zero.alias("ok"), zero.alias("blocked")))
    return rows.groupBy("url").agg(*[F.sum(c).cast("long").alias(c) for c in ("pages", "total_in", "ok", "blocked")])


@query()
def url_ingest(spark, d):
    """Q5: addresses of every url's pages, found, distinct and blocked; blocked are recipients with an order of status F."""
    gone = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("pos"))
    keys = relations.keyed(spark, d).join(gone, "pos", "left_semi").select("key")
    return ingest_summary(table(spark, d, "pages"), keys)


@query()
def crawl_pages(spark, d):
    """From the first page of each host along its links; each page reached, with its distinct addresses."""
    from contactloom.operators.graph import crawl_links

    pages = table(spark, d, "pages")
    url = T.canonical_url(F.col("url"))
    start = pages.groupBy(T.url_host(url).alias("host")).agg(F.min(F.struct(F.length(url), url.alias("url"))).alias("s")).select(F.col("s.url").alias("url"))
    reached = crawl_links(pages, start)
    hits = X.page_hits(pages.select(url.alias("url"), "html").join(reached.select("url"), "url", "left_semi"), "url")
    found = hits.groupBy("url").agg(F.count_distinct("email").alias("n_emails"))
    return reached.join(found, "url", "left").select("start", "url", "depth", "place", F.coalesce("n_emails", F.lit(0)).cast("long").alias("n_emails"))


@query()
def unicode_preprocess(spark, d):
    """The whole preprocessor on documents, hashed."""
    from contactloom.functions.unicode import preprocess

    return table(spark, d, "documents").select("doc_id", F.sha1(preprocess(F.col("text"))).alias("sha"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'xn--e1alid.xn--p1ai' WHEN 1 THEN 'xn--strae-oqa.de' ELSE 'mail.ru' END AS idna2008, CASE c_custkey % 3 WHEN 0 THEN 'xn--e1alid.xn--p1ai' WHEN 1 THEN 'strasse.de' ELSE 'mail.ru' END AS idna2003 FROM customer")
def idna_keys(spark, d):
    """Domains in ASCII by both rules."""
    from contactloom.functions.unicode import idna2003, idna2008

    dom = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'поле.рф' WHEN 1 THEN 'straße.de' ELSE 'mail.ru' END")
    return table(spark, d, "customer").select("c_custkey", idna2008(dom).alias("idna2008"), idna2003(dom).alias("idna2003"))


@query(
    """SELECT concat(page_id, '.zip') AS path, 'page.html' AS member, 'html' AS kind, CAST(length(coalesce(html, '')) AS INTEGER) AS n_chars, NULL AS error FROM pages
    UNION ALL SELECT concat(page_id, '.zip'), 'run.exe', 'zip', NULL, 'denied_suffix' FROM pages"""
)
def archive_units(spark, d):
    """Text units of archives that hold each page's text."""
    import io
    import zipfile

    import pandas as pd

    from contactloom.sources.files import extract_units

    def zipped(batches):
        for b in batches:
            out = []
            for i, h in zip(b["page_id"], b["html"], strict=True):
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w") as z:
                    z.writestr("page.html", h or "")
                    z.writestr("run.exe", b"x")
                out.append((f"{i}.zip", buf.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    files = table(spark, d, "pages").select("page_id", "html").mapInPandas(zipped, "path string, content binary")
    return extract_units(files).select("path", "member", "kind", F.length("text").alias("n_chars"), "error")


@query(ORACLE_SQL["reserve_sequential"])
def stream_reservations(spark, d):
    """H4: the same rows through a stream of stateful reservations."""
    import uuid

    from contactloom.operators.state import shared_folder
    from contactloom.streaming.logs import reserve

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # files of a log, read in one trigger
    table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderdate").cast("timestamp").alias("ts")).write.parquet(f"{folder}/in")
    s = reserve(spark.readStream.schema("key string, ts timestamp").parquet(f"{folder}/in"), 180)
    s.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, accepted_at timestamp").parquet(f"{folder}/out").select(F.col("key").cast("long").alias("o_custkey"), "accepted_at")
