"""Queries without SQL over whole tables, against Python."""

from contactloom.plans.catalog import QUERIES


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_name_pairs_of_all_languages(spark, tmp_path):
    rows = [(1, "by Ivan Petrov-Vodkin today", "en"), (2, "von Jürgen Müller.", "de"), (3, "Élodie Noël Çelik", None), (4, "И. И. Сидоров", "ru"), (5, "Smith J. wrote", "fr"), (6, None, "en"), (7, "none here. Nor Here", "es")]
    want = {
        1: [("Ivan", "Petrov-Vodkin")],
        2: [("Jürgen", "Müller")],
        3: [("Élodie", "Noël"), ("Noël", "Çelik"), ("Élodie", "Çelik")],
        4: [("И", "Сидоров")],
        5: [("J", "Smith")],
        7: [("Nor", "Here")],
    }
    got = QUERIES["name_pairs_all"](spark, documents(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got)) == sorted((i, *p) for i, ps in want.items() for a, b in ps for p in ((a, b), (b, a)))


def test_url_ingest_counts_addresses(spark):
    from contactloom.plans.pipelines import ingest_summary

    html = '<a href="mailto:Ann.Lee@gmail.com">x</a> <p>annlee@gmail.com bob@corp.ru no@site.zzz</p>'
    pages = [(1, "http://A.org/x#top", html), (2, "http://a.org/x", "<p>bob@corp.ru</p>"), (3, "http://a.org/none", "<p>nothing"), (4, None, None)]
    got = ingest_summary(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame([("bob@corp.ru",)], "key string"))
    assert {r.url: tuple(r)[1:] for r in got.collect()} == {"http://a.org/x": (2, 5, 2, 1), "http://a.org/none": (1, 0, 0, 0), None: (1, 0, 0, 0)}


def test_crawl_follows_links_within_its_budgets(spark):
    from contactloom.operators.graph import crawl_links

    page = lambda *hrefs: "".join(f'<a class="x" href="{h}">l</a>' for h in hrefs)
    rows = [
        ("http://a.org/", page("/b", "c/d#part", "http://b.org/", "/gone", "mailto:x@y.ru")),
        ("http://a.org/b", page("/", "/e", "/empty")),
        ("http://a.org/c/d", page("e")),
        ("http://a.org/c/e", page("/deep")),
        ("http://a.org/e", page("/c/e")),
        ("http://a.org/deep", page("/deeper")),
        ("http://a.org/deeper", page()),
        ("http://a.org/empty", ""),
        ("http://b.org/", page("http://a.org/b")),
    ]
    pages, start = spark.createDataFrame(rows, "url string, html string"), spark.createDataFrame([("http://a.org/",), ("http://b.org/",)], "url string")
    crawl = lambda **k: [(r.url[12:], r.depth) for r in sorted(crawl_links(pages, start, **k).collect(), key=lambda r: r.place) if "a.org" in r.start]
    every = [("/", 0), ("/b", 1), ("/c/d", 1), ("/e", 2), ("/c/e", 2), ("/deep", 3)]
    assert crawl() == every
    assert crawl(per_host=4) == every[:4] and crawl(max_pages=2) == every[:2] and crawl(depth=1) == every[:3]
    assert crawl(prefixes=("/c",)) == [("/c/d", 1), ("/c/e", 2)]
    assert [tuple(r) for r in crawl_links(pages, start).collect() if "b.org" in r.start] == [("http://b.org/", "http://b.org/", 0, 1)]
