"""Queries on documents of many formats and on logs that are written and read again.

Their inputs are built from keys, and the SQL states the rows that each must give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from contactloom.functions import rules as RU
from contactloom.functions import values as V
from contactloom.operators import dedupe as D
from contactloom.operators import extract as X
from contactloom.plans.registry import query, sql_in
from contactloom.plans.relations import _FOOT, _foot
from contactloom.session import table

_JSON_PAGES = r"""CASE c_custkey % 6
  WHEN 0 THEN concat('<script type="application/ld+json">{"@graph":[{"a@key.com":1,"contactPoint":[{"email":"P', c_custkey, '@site.com","n":[7,null,{"deep":["x", "two y@site.org here"]}]}]}]}</script>')
  WHEN 1 THEN concat('<script id="__NEXT_DATA__" type="application/json">{"props":{"list":["ab', c_custkey, '@site.org","q\"uote"]}}</script>')
  WHEN 2 THEN '<script>window.__NUXT__ = {"a":{"b":"jane [at] univ (dot) edu"}};</script>'
  WHEN 3 THEN '<script>window.__INITIAL_STATE__={"m":["Y29udGFjdEBzaXRlLmNvbQ=="]};</script>'
  WHEN 4 THEN '<script type="application/ld+json">{"email":"broken@site.com",</script>'
  ELSE '<script>{"email":"other@site.com"}</script>' END"""


@query(
    """SELECT c_custkey AS k, concat('p', c_custkey, '@site.com') AS email FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT c_custkey, 'y@site.org' FROM customer WHERE c_custkey % 6 = 0
    UNION ALL SELECT c_custkey, concat('ab', c_custkey, '@site.org') FROM customer WHERE c_custkey % 6 = 1 UNION ALL SELECT c_custkey, 'jane@univ.edu' FROM customer WHERE c_custkey % 6 = 2
    UNION ALL SELECT c_custkey, 'contact@site.com' FROM customer WHERE c_custkey % 6 = 3"""
)
def json_walk(spark, d):
    """Addresses of all strings of the JSON in pages, at any depth, keys left out."""
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.expr(_JSON_PAGES.replace("\\", "\\\\")).alias("html"))
    return X.embedded_json(pages, "k")


_MARKS = "'0', '1', '2', '3', '4', '5', '6', '7', '8', '9', '⁰', '¹', '²', '³', '⁴', '⁵', '⁶', '⁷', '⁸', '⁹'"
#: Hits of the footnote queries, with some on an unknown ending and some with a short number for a name.
_HITS = "SELECT base, page, CASE WHEN page = 6 THEN right(base, 1) ELSE local END AS local, CASE WHEN page = 5 THEN 'mail.zzz' ELSE domain END AS domain, pre FROM ({0})"


@query(
    f"""WITH h AS (SELECT DISTINCT *, right(rtrim(pre), 1) IN ({_MARKS}) AS m FROM ({_HITS.format(_FOOT)})),
    d6 AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.base = h.base AND g.domain = h.domain AND length(g.local) > 1 AND left(g.local, 1) BETWEEN '0' AND '9'
      AND substr(g.local, 2) = h.local AND abs(g.page - h.page) <= 1 AND (g.m OR h.m))),
    c AS (SELECT *, CASE WHEN pre LIKE '%¹' AND local LIKE '1%' THEN substr(local, 2) END AS cut FROM d6),
    d7 AS (SELECT base, page, domain, pre, coalesce(cut, local) AS local, cut IS NOT NULL AS repaired FROM c WHERE NOT EXISTS (SELECT 1 FROM d6 WHERE d6.local = c.cut AND d6.domain = c.domain)),
    d3 AS (SELECT *, concat(local, '@', domain) AS email FROM d7 QUALIFY row_number() OVER (PARTITION BY local, domain ORDER BY base, page, local, pre) = 1)
    SELECT base, page, email, pre, repaired FROM d3 WHERE split_part(domain, '.', -1) IN ({sql_in(V.KNOWN_TLDS)}) AND NOT regexp_full_match(local, '[0-9]{{1,2}}')"""
)
def hit_postprocess(spark, d):
    """D6, D7, D3 and V17 as one operator."""
    h = _foot(spark, d).select("base", "page", F.expr("CASE WHEN page = 6 THEN right(base, 1) ELSE local END").alias("local"), F.expr("CASE WHEN page = 5 THEN 'mail.zzz' ELSE domain END").alias("domain"), "pre")
    return D.postprocess(h.distinct()).select("base", "page", "email", "pre", "repaired")


_ROWS = "CASE c_custkey % 5 WHEN 0 THEN '(aivan@x.ru (bpetr@x.ru (canna@x.ru' WHEN 1 THEN '•a1@x.ru, •a2@x.ru; b1@x.ru' WHEN 2 THEN 'ivan@x.ru' WHEN 3 THEN '.aivan@x.ru _bpetr@x.ru =canna@x.ru' ELSE '(aivan@x.ru and (apetr@x.ru' END"


@query("SELECT c_custkey, c_custkey % 5 IN (0, 1) AS prefixed FROM customer")
def prefix_mode(spark, d):
    """Documents that number their addresses."""
    return table(spark, d, "customer").select("c_custkey", RU.has_prefix_row(F.expr(_ROWS)).alias("prefixed"))


def office_files(batches):
    """A file of each of six formats by key, as bytes: DOCX, XLSX, PPTX, ODT, RTF, CSV in cp1251."""
    import io
    import zipfile

    import pandas as pd

    def packed(members: dict[str, str]) -> bytes:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            for name, text in members.items():
                z.writestr(name, text)
        return buf.getvalue()

    def file(k: int) -> tuple[str, bytes]:
        kind = k % 6
        if kind == 0:
            body = f"<w:p><w:r><w:t>one{k}</w:t></w:r><w:r><w:t>@a.ru</w:t></w:r></w:p><w:p><w:r><w:br w:type='page'/><w:t>two</w:t></w:r></w:p>"
            return f"{k}.docx", packed({"word/document.xml": f"<w:document xmlns:w='w'><w:body>{body}</w:body></w:document>"})
        if kind == 1:
            book = "<workbook xmlns:r='r'><sheets><sheet name='Second' r:id='r2'/><sheet name='First' r:id='r1'/></sheets></workbook>"
            rels = "<R><Relationship Id='r1' Target='worksheets/sheet1.xml'/><Relationship Id='r2' Target='worksheets/sheet2.xml'/></R>"
            one, two = f"<s><c r='A1' t='s'><v>0</v></c><c r='B2'><v>{k}</v></c></s>", "<s><c r='C3' t='inlineStr'><is><t>in@b.ru</t></is></c></s>"
            members = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": "<sst><si><t>shared@b.ru</t></si></sst>", "xl/worksheets/sheet1.xml": one, "xl/worksheets/sheet2.xml": two}
            return f"{k}.xlsx", packed(members)
        if kind == 2:
            return f"{k}.pptx", packed({"ppt/slides/slide1.xml": f"<s><t>slide{k}</t><t>c@d.ru</t></s>"})
        if kind == 3:
            return f"{k}.odt", packed({"content.xml": f"<o><h>Head</h><p>odt{k} <span>in</span> span</p></o>"})
        if kind == 4:
            return f"{k}.rtf", (r"{\rtf1\ansi \b rtf" + str(k) + r"\b0\par \'ef\'f0\'e8}").encode()
        return f"{k}.csv", f"почта;a{k}@b.ru\n".encode("cp1251")

    for b in batches:
        yield pd.DataFrame([file(int(k)) for k in b["c_custkey"]], columns=["path", "content"])


@query(
    """SELECT concat(k, '.docx') AS path, 'docx' AS kind, '#page=1' AS unit, concat('one', k, '@a.ru') AS text FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 6 = 0) UNION ALL
    SELECT concat(c_custkey, '.docx'), 'docx', '#page=2', 'two' FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT concat(c_custkey, '.xlsx'), 'xlsx', '!First!A1', 'shared@b.ru' FROM customer WHERE c_custkey % 6 = 1 UNION ALL
    SELECT concat(c_custkey, '.xlsx'), 'xlsx', '!First!B2', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 6 = 1 UNION ALL SELECT concat(c_custkey, '.xlsx'), 'xlsx', '!Second!C3', 'in@b.ru' FROM customer WHERE c_custkey % 6 = 1 UNION ALL
    SELECT concat(c_custkey, '.pptx'), 'pptx', '#page=1', concat('slide', c_custkey, chr(10), 'c@d.ru') FROM customer WHERE c_custkey % 6 = 2 UNION ALL SELECT concat(c_custkey, '.odt'), 'odt', '', concat('Head', chr(10), 'odt', c_custkey, ' in span') FROM customer WHERE c_custkey % 6 = 3 UNION ALL
    SELECT concat(c_custkey, '.rtf'), 'rtf', '', concat('rtf', c_custkey, chr(10), 'при') FROM customer WHERE c_custkey % 6 = 4 UNION ALL SELECT concat(c_custkey, '.csv'), 'csv', '', concat('почта;a', c_custkey, '@b.ru', chr(10)) FROM customer WHERE c_custkey % 6 = 5"""
)
def office_units(spark, d):
    """Text units of office files, and of text in another charset."""
    from contactloom.sources.files import extract_units

    files = table(spark, d, "customer").select("c_custkey").mapInPandas(office_files, "path string, content binary")
    return extract_units(files).select("path", "kind", "unit", "text")


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS email, CASE o_orderstatus WHEN 'F' THEN 'error' ELSE 'sent' END AS status, CASE o_orderstatus WHEN 'F' THEN repeat('x', 300) END AS reason, count(*) AS n
    FROM orders GROUP BY ALL UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'csv', NULL, 1 FROM customer"""
)
def log_round_trip(spark, d):
    """Events appended as JSON lines in two batches, a log written as CSV, and both read again."""
    import uuid

    from contactloom.operators.state import shared_folder
    from contactloom.sources import logs, sinks

    folder = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    failed = F.col("o_orderstatus") == "F"
    events = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("email"), F.when(failed, "error").otherwise("sent").alias("status"), F.when(failed, F.repeat(F.lit("x"), 400)).alias("reason"), failed.alias("bad"))
    for part in (events.filter("bad"), events.filter("not bad")):
        sinks.append_events(part.drop("bad"), f"{folder}/events")
    sinks.write_log(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("to"), F.lit("csv").alias("result")), f"{folder}/sent")
    sent = logs.read_csv_log(spark, f"{folder}/sent").select("email", "status", F.lit(None).cast("string").alias("reason"))
    both = logs.union_logs(logs.read_jsonl(spark, f"{folder}/events").select("email", "status", "reason"), sent)
    return both.groupBy("email", "status", "reason").agg(F.count(F.lit(1)).alias("n"))


_RAW = """CASE c_custkey % 5 WHEN 0 THEN 'ivan¹ [at] mail (dot) ru' WHEN 1 THEN 'a&amp;b ﬁx' WHEN 2 THEN concat('p1@mail.ru', chr(10), 'p2@mail.ru') WHEN 3 THEN 'see (a) x@y.ru' ELSE 'ｊｏｅ@mail.ru' END"""


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'ivan@mail.ru' WHEN 1 THEN 'a&b fix' WHEN 2 THEN concat('p1@mail.ru', chr(10), 'p2@mail.ru') WHEN 3 THEN 'see  x@y.ru' ELSE 'joe@mail.ru' END AS text FROM customer")
def preprocess_samples(spark, d):
    """The whole preprocessor on texts with known results."""
    from contactloom.functions.unicode import preprocess

    return table(spark, d, "customer").select("c_custkey", preprocess(F.expr(_RAW)).alias("text"))


_LINES = """CASE c_custkey % 7 WHEN 0 THEN concat('co-', chr(10), 'operation') WHEN 1 THEN concat('one  ', chr(10), ' two') WHEN 2 THEN 'Россияnik@site.ru' WHEN 3 THEN 'E-mail:ivanov@site . ru'
  WHEN 4 THEN 'write to x@ y.org  now' WHEN 5 THEN '(a)b.c@d.com' ELSE 'plain a.b@c.ru' END"""


@query(
    """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'cooperation' WHEN 1 THEN 'one two' WHEN 2 THEN 'Россия nik@site.ru' WHEN 3 THEN 'E-mail: ivanov@site.ru' WHEN 4 THEN 'write to x@y.org now'
    WHEN 5 THEN '(a) b.c@d.com' ELSE 'plain a.b@c.ru' END AS text FROM customer"""
)
def one_line_text(spark, d):
    """Texts with known results."""
    from contactloom.functions import text as T

    return table(spark, d, "customer").select("c_custkey", T.one_line(F.expr(_LINES)).alias("text"))


_NAMES = "CASE c_custkey % 9 WHEN 0 THEN 'https://a.org/x.pdf' WHEN 1 THEN 'a/B.PDF' WHEN 2 THEN 'a.docx' WHEN 3 THEN 'a.xlsx' WHEN 4 THEN 'a.tsv' WHEN 5 THEN 'a.zip' WHEN 6 THEN 'a.HTM' WHEN 7 THEN 'a' ELSE 'a.txt' END"


@query("SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'url' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' WHEN 3 THEN 'xlsx' WHEN 4 THEN 'csv' WHEN 5 THEN 'zip' WHEN 6 THEN 'html' ELSE 'text' END AS kind FROM customer")
def source_kinds(spark, d):
    """Which reader a source goes to."""
    from contactloom.sources.files import suffix_kind

    return table(spark, d, "customer").select("c_custkey", suffix_kind(F.expr(_NAMES)).alias("kind"))


@query(
    """SELECT c_custkey AS doc, concat('a', c_custkey, '@x.ru') AS email FROM customer WHERE c_custkey % 4 <> 3 UNION ALL SELECT c_custkey, 'b@x.ru' FROM customer WHERE c_custkey % 4 = 1
    UNION ALL SELECT c_custkey, 'scan@y.org' FROM customer WHERE c_custkey % 4 IN (0, 3)"""
)
def pdf_addresses(spark, d):
    """Documents with fewer than two addresses in their text give those of the recognised text, too."""
    text = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('a', c_custkey, '@x.ru') WHEN 1 THEN concat('A', c_custkey, '@x.ru, b@x.ru') WHEN 2 THEN concat('a', c_custkey, '@x.ru') ELSE 'nothing' END")
    ocr = F.expr("CASE WHEN c_custkey % 4 <> 2 THEN 'scan@y.org' END")
    return X.with_ocr(table(spark, d, "customer").select(F.col("c_custkey").alias("doc"), text.alias("text"), ocr.alias("ocr_text")), "doc", 2)


@query(
    """SELECT c_custkey AS k, CAST(c_custkey % 2 AS BIGINT) AS hits_mailto, CAST(c_custkey % 3 AS BIGINT) AS hits_text, CAST(0 AS BIGINT) AS hits_bundle FROM customer WHERE c_custkey % 2 + c_custkey % 3 > 0"""
)
def hit_origin_counts(spark, d):
    """Hits of pages by origin, zero-filled."""
    from contactloom.operators.reports import origin_counts

    html = F.expr("concat(CASE WHEN c_custkey % 2 = 1 THEN '<a href=\"mailto:m@x.ru\">w</a>' ELSE '' END, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '<p>t1@x.ru</p>' ELSE '<p>t1@x.ru</p> <p>t2@x.ru</p>' END)")
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), html.alias("html"))
    return origin_counts(X.page_hits(pages, "k"), "k", ["mailto", "text", "bundle"])


@query("SELECT l_orderkey AS archive, CAST(sum(l_linenumber) AS BIGINT) AS found, CAST(sum(l_suppkey) AS BIGINT) AS rejected FROM lineitem GROUP BY 1")
def archive_statistics(spark, d):
    """Statistics of archives from those of their members."""
    from contactloom.operators.reports import merge_member_stats

    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("archive"), F.col("l_linenumber").alias("found"), F.col("l_suppkey").alias("rejected"), F.col("l_partkey").alias("files_processed"), F.col("l_linestatus").alias("last_file"))
    return merge_member_stats(m, "archive")
