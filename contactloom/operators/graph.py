"""Breadth-first traversal of a link table."""

from __future__ import annotations

from functools import reduce
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crawl(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of what is reached from `start` (node) over edges (src, dst).

    One anti join for each level, on the new frontier only; a node keeps its least depth.
    """
    from contactloom.operators.state import cut

    seen = [start.select("node").distinct().withColumn("depth", F.lit(0))]
    for d in range(1, depth + 1):
        reached = edges.join(seen[-1].select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, seen).select("node")
        seen.append(cut(reached.join(known, "node", "left_anti").withColumn("depth", F.lit(d))))
    return reduce(DataFrame.unionByName, seen)


def crawl_links(pages: DataFrame, start: DataFrame, depth: int = 3, max_pages: int = 120, per_host: int = 50, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(start, url, depth, place) of the pages that a crawl from each url of `start` reads in `pages` (url, html).

    One crawl for each start, on its own host: links are followed in the order of pages and places,
    level by level; `prefixes` holds for links and for the pages that count.  A crawl ends after
    max_pages pages that count; per_host bounds what is read of a host, the start included.  Pages
    without html aren't read.  place is the page's number in its crawl, from 1.
    """
    from pyspark.sql.window import Window

    from contactloom.functions import text as T
    from contactloom.functions.rules import path_allowed
    from contactloom.operators.state import cut

    @F.pandas_udf("string")
    def joined(base: pd.Series, href: pd.Series) -> pd.Series:
        def one(b, h):
            try:
                return urljoin(b, h.strip())
            except ValueError:
                return None

        return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)

    # one page for each url, known by the hash of its html where there are several
    known = pages.select(T.canonical_url(F.col("url")).alias("url"), "html").filter("url is not null and html <> ''")
    hrefs = F.regexp_extract_all("html", F.lit("(?i)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"'>]*)"), F.lit(1))
    known = known.groupBy("url").agg(F.min_by(hrefs, F.struct(F.xxhash64("html"), F.length("html"))).alias("hrefs"))
    known = cut(known.withColumn("host", T.url_host(F.col("url"))))
    links = known.select(F.col("url").alias("src"), "host", F.posexplode("hrefs").alias("pos", "href"))
    links = links.withColumn("url", T.canonical_url(joined(F.col("src"), F.replace("href", F.lit("&amp;"), F.lit("&")))))
    links = links.filter((T.url_host(F.col("url")) == F.col("host")) & path_allowed(F.col("url"), list(prefixes)))
    links = links.groupBy("src", "url").agg(F.min("pos").alias("pos"))
    links = cut(links.join(known.select("url"), "url", "left_semi"))

    level = start.select(T.canonical_url(F.col("url")).alias("url")).distinct().join(known.select("url"), "url", "left_semi")
    level = cut(level.select(F.col("url").alias("start"), "url", F.lit(0).alias("depth"), F.lit(1).alias("read")))
    seen = level
    for k in range(1, depth + 1):
        # a page's place among those its level found: by the page that links to it first, and where
        by = links.join(level.select("start", F.col("url").alias("src"), "read"), "src")
        new = by.groupBy("start", "url").agg(F.min(F.struct("read", "pos")).alias("at")).join(seen.select("start", "url"), ["start", "url"], "left_anti")
        # only as many of a crawl as it may read in all
        new = new.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("at", "url"))).filter(F.col("n") <= per_host)
        done = seen.groupBy("start").agg(F.max("read").alias("done"))
        new = new.join(done, "start").withColumn("read", F.col("n") + F.col("done")).filter(F.col("read") <= per_host)
        level = cut(new.select("start", "url", F.lit(k).alias("depth"), F.col("read").cast("int").alias("read")))
        seen = seen.unionByName(level)
    counts = seen.filter(path_allowed(F.col("url"), list(prefixes)))
    place = F.row_number().over(Window.partitionBy("start").orderBy("read"))
    return counts.withColumn("place", place).filter(F.col("place") <= max_pages).select("start", "url", "depth", "place")
