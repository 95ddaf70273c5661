"""Literal cases for functions and operators; expected values are worked out by hand."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from contactloom.functions import keys as K
from contactloom.functions import rules as RU
from contactloom.functions import text as T
from contactloom.operators import dedupe as D
from contactloom.operators import extract as X
from contactloom.operators import history as H


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    "f,value,want",
    [
        (T.strip_phone_prefix, "+7-999-777-66-55stark_velik@mail.ru", "stark_velik@mail.ru"),
        (T.preclean, "a​b@mail.ru", "ab@mail.ru"),
        (T.preclean, "a @ b·ru", "a@b.ru"),
        (T.deobfuscate, "jane (at) univ [dot] edu", "jane@univ.edu"),
        (T.deobfuscate, "look at this dot", "look at this dot"),
        (T.ocr_fix, "user@domain ru", "user@domain.ru"),
        (T.ocr_fix, "user@domain,ru", "user@domain.ru"),
        (T.ocr_fix, "user@domain·ru", "user@domain.ru"),
        (T.decode_cfemail, "4223622c306e", "a n r,".replace(" n r,", "") or None),
        (T.decode_base64, "Y29udGFjdEBzaXRlLmNvbQ==", "contact@site.com"),
        (T.decode_base64, "bm90aGluZw==", None),
        (T.canonical_url, "HTTP://Site.COM/A/b#x", "http://site.com/A/b"),
        (T.top_prefix, "https://a.ru/news/1", "/news/"),
        (T.mask_address, "jane@x.ru", "j***@x.ru"),
        (T.fix_domain_typo, "a@gnail.com", "a@gmail.com"),
        (T.trim_appended, "a@b.rurussia", "a@b.ru"),
        (T.transliterate, "Щука", "shchuka"),
        (T.strip_html, "<p>a&amp;b</p><script>x</script><br>c", "a&b\n \nc".replace("\n \n", "\n")),
        (K.gmail_key, "Foo.Bar+tag@GMAIL.com", "foobar@gmail.com"),
        (K.cooldown_key, "USER@Example.COM", "user@example.com"),
        (K.provider_key, "A.B+x@yandex.ru", "ab@yandex.ru"),
        (K.history_key, "a.b+x@mail.ru", "a.b+x@mail.ru"),
        (K.blocklist_key, "..12ab@x.ru", "12ab@x.ru".replace("12", "")),
        (K.transport_address, "Ivan.P@EXAMPLE.ru", "Ivan.P@example.ru"),
        (K.blocked_key, "not an address", None),
        (RU.domain_class, "user@gmail.com", "global_mail"),
        (RU.domain_class, "ivan@company.ru", "ru_like"),
        (RU.domain_class, "anna@univ.edu", "foreign_corporate"),
        (RU.domain_class, "bad@@example", "unknown"),
        (RU.strict_reason, "a..b@x.ru", "local_consecutive_dots"),
        (RU.strict_reason, ".a@x.ru", "local_edge_dot"),
        (RU.strict_reason, "a@-x.ru", "domain_label_dash"),
        (RU.strict_reason, "a@x", "domain_bad_shape"),
        (RU.strict_reason, "a b@x.ru", "local_bad_chars"),
        (RU.strict_reason, "a@b@x.ru", "no_at_sign"),
        (RU.strict_reason, "ok@x.ru", None),
        (RU.outcome_of, "skip_cooldown 3d", "cooldown"),
        (RU.outcome_of, None, "error"),
    ],
)
def test_scalars(spark, f, value, want):
    if f is T.decode_cfemail:
        value, want = "42" + "".join(f"{ord(c) ^ 0x42:02x}" for c in "a@b.ru"), "a@b.ru"
    assert one(spark, value, f) == want


@pytest.mark.parametrize("code,msg,want", [(550, None, "hard"), (450, None, "soft"), (None, "User Not Found", "hard"), (None, "temporary failure", "soft"), (450, "greylisted", "soft"), (None, "hello", "unknown")])
def test_bounces(spark, code, msg, want):
    df = spark.createDataFrame([(code, msg)], "code int, msg string")
    assert df.select(RU.bounce_class(F.col("code"), F.col("msg")).alias("r")).first().r == want


def test_roles_and_names(spark):
    df = spark.createDataFrame([("no-reply", ""), ("ivan.petrov", "corresponding author"), ("x1", "")], "l string, ctx string")
    got = [r.r for r in df.select(RU.role_score(F.col("l"), F.lit("a.ru"), F.col("ctx")).alias("r")).collect()]
    assert [(r.role_class, r.role_score) for r in got] == [("role", 0.0), ("personal", 0.9), ("unknown", 0.5)]
    # literal results, so that lists and order can't drift
    cases = [
        ("no-reply", "example.com", "", "role", 0.0, "role-local"), ("ivan.ivanov", "university.ru", "Corresponding author", "personal", 0.9, "fio-like,author-context"),
        ("Otdel-7", "a.ru", "", "role", 0.0, "role-fragment"), ("kontakt", "a.ru", "", "role", 0.0, "role-local"), ("info2", "mail.ru", "", "role", 0.35, "role-domain"),
        ("labor", "a.ru", "кафедра", "unknown", 0.55, "fio-like,dept-context"), ("a@b", "a.ru", "", "unknown", 0.5, "invalid-local"), ("7x", "a.ru", "", "unknown", 0.5, "baseline"),
        ("it5", "a.ru", "", "role", 0.0, "role-fragment"), ("5it", "a.ru", "office", "role", 0.3, "dept-context"), ("mailer_daemon", "a.ru", "", "role", 0.0, "role-local"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "l string, d string, ctx string")
    got = [r.r for r in df.select(RU.role_score(F.col("l"), F.col("d"), F.col("ctx")).alias("r")).collect()]
    assert [(r.role_class, r.role_score, r.role_reason) for r in got] == [c[3:] for c in cases]
    score = spark.range(1).select(RU.name_score(F.lit("i.ivanov"), F.lit("Ivan"), F.lit("Ivanov")).alias("a"), RU.name_score(F.lit("service"), F.lit("Ivan"), F.lit("Ivanov")).alias("b")).first()
    assert score.a >= 0.9 and score.b == 0.0


def emails(df):
    return sorted(r.email for r in df.collect())


def test_extraction(spark):
    docs = spark.createDataFrame(
        [(1, "a@b.com c@d.com"), (2, "1example.com"), (3, "p1@mail.ru​\np2@mail.ru p3@mail.ru"), (4, "write to jane [at] univ (dot) edu"), (5, None)], "id int, text string"
    )
    assert emails(X.unified(docs, "id")) == ["a@b.com", "c@d.com", "jane@univ.edu", "p1@mail.ru", "p2@mail.ru", "p3@mail.ru"]
    assert emails(X.obfuscated(docs, "id")) == ["jane@univ.edu"]
    page = spark.createDataFrame([(1, '<a href="mailto:a+b@x.ru?subject=1">x</a><script type="application/ld+json">{"email":"contact@site.com"}</script><i data-cfemail="4223026c3037"></i>')], "page_id int, html string")
    got = {(r.email, r.origin) for r in X.page_hits(page).collect()}
    assert {("a+b@x.ru", "mailto"), ("contact@site.com", "ldjson")} <= got


def test_hits_are_judged_by_their_own_surroundings(spark):
    from contactloom.plans.pipelines import classify_hits

    text = "Corresponding author: ab7@univ.edu " + "and so on " * 40 + " Department of physics: cd8@univ.edu"
    docs = spark.createDataFrame([(1, text), (2, "é@ x1@a.org,x1@a.org")], "doc int, text string")
    got = {(r.doc, r.pos): (r.role_score, text[r.at - 1 :].startswith(r.email)) for r in classify_hits(X.hits(docs), "doc").join(docs.select(F.col("doc"), F.posexplode(X.places(F.col("text"))).alias("pos", "at")), ["doc", "pos"]).collect()}
    assert got[1, 0] == (0.65, True) and got[1, 1] == (0.3, True)
    assert [r.p for r in docs.filter("doc = 2").select(F.explode(X.places(F.col("text"))).alias("p")).collect()] == [4, 13]


def test_hits_are_judged_once(spark):
    """A text's places are found once, a hit is judged once, and the work isn't done in the scan's few tasks."""
    import re

    from contactloom.plans import pipelines as P

    text = " ".join(f"and é{i % 7} User{i % 150}@mail{i % 3}.ru," for i in range(300))
    docs = spark.createDataFrame([(1, text), (None, "x@a.org x@a.org"), (None, "x@a.org"), (3, "no @ here"), (4, None)], "doc int, text string")
    hits = X.hits(docs, at=True)
    assert [(r.at, r.email) for r in hits.filter("doc = 1").orderBy("pos").collect()] == [(m.start() + 1, m[0].lower()) for m in re.finditer(X.ADDRESS, text)]
    got = P.classify_hits(hits, "doc").collect()
    assert sorted(r.pos for r in got if r.doc == 1 and r.stage == "duplicate") == list(range(150, 300))
    assert [r.stage for r in got if r.doc is None] == [None] * 3 and len(got) == 303
    customers = spark.range(40).selectExpr("id AS c_custkey")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        t = P._extract_texts(customers)
        plan = P.classify_hits(X.hits(t, at=True), "doc")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    below = plan[plan.index("Repartition 5, true") :]
    assert "regexp_extract_all" not in below and "Join" not in plan


def foot(spark, rows):
    return spark.createDataFrame(rows, "base string, page long, domain string, pre string, local string")


def test_footnotes(spark):
    pair = foot(spark, [("d", 1, "mail.ru", "", "959536_v"), ("d", 1, "mail.ru", "9", "59536_v")])
    assert [r.local for r in D.merge_footnotes(pair).collect()] == ["959536_v"]
    kept = foot(spark, [("d", 1, "mail.ru", "1", "1abc"), ("d", 1, "mail.ru", "", "xabc")])
    assert D.merge_footnotes(kept).count() == 2
    # a digit or superscript before either hit will do, whichever it is; far pages and other domains won't
    for long_pre, short_pre, page, n in (("5 ", "", 2, 1), ("", "⁷", 1, 1), ("x", "", 1, 2), ("1", "", 4, 2)):
        assert D.merge_footnotes(foot(spark, [("d", 1, "mail.ru", long_pre, "2abc"), ("d", page, "mail.ru", short_pre, "abc")])).count() == n
    single = foot(spark, [("d", 1, "yandex.ru", "¹", "1dergal"), ("d", 2, "yandex.ru", "1", "1alex")])
    assert sorted((r.local, r.repaired) for r in D.repair_singletons(single).collect()) == [("1alex", False), ("dergal", True)]


def test_windows_of_history(spark):
    t = dt.datetime(2024, 1, 1)
    h = spark.createDataFrame([("a", t), ("a", t + dt.timedelta(hours=1)), ("a", t + dt.timedelta(days=180)), ("b", t)], "k string, ts timestamp")
    got = sorted((r.k, r.accepted_at) for r in H.reserve(h, "k", "ts", 180).collect())
    assert got == [("a", t), ("a", t + dt.timedelta(days=180)), ("b", t)]
    now = F.lit("2024-06-29").cast("timestamp")  # 180 days after
    r = h.limit(1).select(*[H.under_window(F.lit("2024-01-01").cast("timestamp"), now, 180, x).alias(x) for x in ("strict", "inclusive", "grace")]).first()
    assert (r.strict, r.inclusive, r.grace) == (False, True, True)


def test_edits_last_rule_wins(spark):
    e = spark.createDataFrame([("a", 1, "x@x.ru"), ("a", 2, "y@x.ru"), ("b", 1, None)], "key string, pos int, new_email string")
    r = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c")], "key string, email string")
    assert sorted(x.email for x in H.apply_edits(r, e).collect()) == ["c", "y@x.ru"]


def test_unicode(spark):
    from contactloom.functions import unicode as U

    df = spark.createDataFrame([("ｕ＠ｘ．ru¹ (a) i v a n",)], "c string")
    r = df.select(U.nfkc("c").alias("n"), U.remove_footnotes("c").alias("f"), U.collapse_spaced_tokens("c").alias("s"), U.idna2008(F.lit("straße.de")).alias("a"), U.idna2003(F.lit("straße.de")).alias("b")).first()
    assert r.n.startswith("u@x.ru1") and "¹" not in r.f and r.s.endswith("ivan")
    assert (r.a, r.b) == ("xn--strae-oqa.de", "strasse.de")


def zipped(**files):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return buf.getvalue()


def test_files(spark):
    from contactloom.sources.files import extract_units, suffix_kind

    w = 'xmlns:w="http://x"'
    docx = zipped(**{"word/document.xml": f'<w:d {w}><w:p><w:t>one a@b.ru</w:t></w:p><w:p><w:br w:type="page"/><w:t>two</w:t></w:p></w:d>'})
    xlsx = zipped(**{"xl/workbook.xml": '<w><sheet name="S"/></w>', "xl/sharedStrings.xml": "<s><si><t>c@d.ru</t></si></s>", "xl/worksheets/sheet1.xml": '<w><c r="B12" t="s"><v>0</v></c></w>'})
    inner = zipped(**{"a/x.txt": "привет".encode("cp1251"), "run.exe": b"x"})
    rows = [("m.docx", docx), ("t.xlsx", xlsx), ("z.zip", zipped(**{"in.zip": inner, "../up.txt": "x"})), ("bad.docx", b"junk"), ("p.pdf", b"%PDF")]
    got = {(r.path, r.member, r.unit, r.text, r.error) for r in extract_units(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {("m.docx", "", "#page=1", "one a@b.ru", None), ("m.docx", "", "#page=2", "two", None), ("t.xlsx", "", "!S!B12", "c@d.ru", None)} <= got
    assert {("z.zip", "in.zip|a/x.txt", "", "привет", None), ("z.zip", "in.zip|run.exe", "", None, "denied_suffix"), ("z.zip", "../up.txt", "", None, "unsafe_path"), ("p.pdf", "", "", None, "unsupported")} <= got
    assert any(p == "bad.docx" and e for p, *_, e in got)
    assert one(spark, "https://a.ru/x", suffix_kind) == "url" and one(spark, "/a/b.XLSX", suffix_kind) == "xlsx"


def test_mail(spark):
    from contactloom.sources.mail import messages

    raw = b"From: Mail Delivery <mailer-daemon@x.ru>\nTo: me@x.ru\nDate: Wed, 01 May 2024 10:00:00 +0300\nContent-Type: multipart/report; boundary=b\n\n--b\nContent-Type: message/delivery-status\n\nReporting-MTA: dns; x\n\nFinal-Recipient: rfc822; Gone@Y.ru\nAction: failed\nStatus: 5.1.1\n\n--b--\n"
    out = b"From: jane@z.ru\nSubject: unsubscribe\n\nplease\n"
    a, b = messages(spark.createDataFrame([(1, raw), (2, out)], "id long, raw binary")).orderBy("id").collect()
    assert (a.is_bounce, a.original_to, a.dsn_action, a.dsn_status, a.sent_at) == (True, "gone@y.ru", "failed", "5.1.1", dt.datetime(2024, 5, 1, 7))
    assert b.wants_out and b.out_addresses == ["jane@z.ru"]


def test_logs(spark, tmp_path):
    from contactloom.sources import logs as L
    from contactloom.sources import sinks

    p = tmp_path / "s.csv"
    p.write_text("key;email;ts;status\nk1;A@x.ru;2024-05-01T10:00:00+03:00;sent\nk2;b@x.ru;junk;sent\n")
    log = L.read_csv_log(spark, str(p), L.guess_delimiter(spark, str(p)))
    assert [r.t for r in log.select(L.parse_time(F.col("last_sent_at")).alias("t")).collect()] == [dt.datetime(2024, 5, 1, 7), None]
    j = tmp_path / "s.jsonl"
    j.write_text('{"ts":"2024-05-02T00:00:00Z","email":"b@x.ru","group":"g","status":"success"}\nnot json\n')
    stats = L.read_jsonl(spark, str(j))
    assert stats.count() == 1
    m = L.migrate(stats, log, F.lit("2024-06-01").cast("timestamp")).collect()
    assert {(r.email_norm, r.sent_at) for r in m} == {("b@x.ru", dt.datetime(2024, 5, 2)), ("a@x.ru", dt.datetime(2024, 5, 1, 7))}
    sinks.append_events(spark.createDataFrame([("x" * 400,)], "reason string"), str(tmp_path / "out"))
    assert len(spark.read.json(str(tmp_path / "out")).first().reason) == 300


def test_streams(spark, tmp_path):
    from contactloom.streaming import logs as S

    src = str(tmp_path / "in")
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:30:00"), ("a", "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "key string, ts string").coalesce(1).write.json(src)
    stream = S.stream_jsonl(spark, src, "key string, ts timestamp")

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        return spark.table(name)

    assert run(S.once_per_window(stream, ["key"]), "once").count() == 2
    assert sorted(r.key for r in run(S.reserve(stream, 1), "res").collect()) == ["a", "a", "b"]
    S.upsert_latest(stream, str(tmp_path / "up"), str(tmp_path / "ck"), "key", "ts").start().awaitTermination()
    assert {(r.key, str(r.ts)) for r in spark.read.parquet(str(tmp_path / "up/v=0")).collect()} == {("a", "2024-01-03 00:00:00"), ("b", "2024-01-01 00:30:00")}
    due = spark.createDataFrame([("a", "soft", 1, 3), ("b", "soft", 3, 3)], "email string, status string, retry_count int, max_retries int")
    due = due.withColumns({"ts": F.lit("2024-01-01").cast("timestamp"), "next_retry_at": F.lit("2024-01-02").cast("timestamp")})
    assert [r.email for r in S.due_retries(due, "2024-01-03").collect()] == ["a"]


def test_json_strings_at_every_depth(spark):
    cases = {'{"a@k.com":["x@y.ru",{"b":"q\\"uo\\\\te \\u0061","c":[1,null,"last"]}],"":""}': ["x@y.ru", 'q"uo\\te a', "last", ""], '"one"': ["one"], '{"a":': None, "": None, "[1, 2]": []}
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r.j: r.s for r in df.select("j", X.json_strings(F.col("j")).alias("s")).collect()} == cases


def test_prefix_rows(spark):
    df = spark.createDataFrame([("(aivan@x.ru (bpetr@x.ru (canna@x.ru", True), ("(aivan@x.ru (apetr@x.ru", False), ("(a1@x (a2@x (b1@x", True), ("", False), (None, False)], "t string, want boolean")
    assert all(r.got == r.want for r in df.select("want", RU.has_prefix_row(F.col("t")).alias("got")).collect())


def test_spaced_letters_of_long_texts():
    from contactloom.functions import unicode as U

    assert U.collapse_spaced("i v a n x " * 300_000).startswith("ivanxivanx") or len(U.collapse_spaced("z " * 2_100_000)) < 2_200_000


def test_sliding_counts_of_one_key(spark):
    from contactloom.operators import windows as W

    t0 = dt.datetime(2024, 1, 1)
    at = [0, 1, 59, 60, 61, 119, 120, 180, 180, 7200]
    df = spark.createDataFrame([("k", i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate(at)], "k string, i int, ts timestamp")
    got = {r.i: r.n_recent for r in W.sliding_count(df, "k", "ts", 60).collect()}
    assert got == {i: sum(s - 59 <= x <= s for x in at) for i, s in enumerate(at)}


def test_ranks_across_sources_by_stretches(spark):
    rows = [(i, f"k{i % 3}" if i % 7 else None, f"s{i % 4}") for i in range(60)]
    df = spark.createDataFrame(rows, "pos long, email string, source string")
    got = {r.pos: (r.key, r.rank, r.first_source) for r in D.across_sources(df, F.col("email"), width=4).collect()}
    want, seen = {}, {}
    for pos, key, source in rows:
        n, first = seen.get(key, (0, source))
        seen[key] = (n + 1, first)
        want[pos] = (key, n + 1, first)
    assert got == want
