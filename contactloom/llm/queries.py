"""The registered queries of this package; each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by a 100-byte string that starts earlier too."""
    from contactloom.llm.suffix_dedup import repeated_spans

    return repeated_spans(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a window of 20 words that starts earlier too."""
    from contactloom.llm.substring_dedup import repeated_words

    return repeated_words(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 1024 tokens."""
    from contactloom.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources by weight takes of each document."""
    from contactloom.llm.mixing import mix

    return mix(documents(spark, sf_dir)).drop("source")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal but for the case of A-Z."""
    from contactloom.llm.exact_dedup import exact_duplicates

    return exact_duplicates(documents(spark, sf_dir), hash_all=True)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their 3-word shingles."""
    from contactloom.llm.minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each text, and whether a learned list of rules keeps it."""
    from contactloom.llm.quality_rules import judge

    out = judge(documents(spark, sf_dir), labels(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page, by the path that its host's pages agree on."""
    from contactloom.llm.html_extract import main_texts

    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each text, learned from labels that aren't held out."""
    from contactloom.llm.toxicity import score_texts, train

    docs = documents(spark, sf_dir)
    return score_texts(docs, train(docs, labels(spark, sf_dir)))


def graded(labels_: DataFrame) -> DataFrame:
    """Ratings of three grades: 0 poor, 1 good but toxic, 2 good."""
    from pyspark.sql import functions as F

    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels_.filter("quality is not null").select("doc_id", grade.alias("grade"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of each text."""
    from pyspark.sql import functions as F

    from contactloom.llm.quality_model import grade_texts, train

    docs = documents(spark, sf_dir)
    out = grade_texts(docs, train(docs, graded(labels(spark, sf_dir))))
    return out.select("doc_id", "expected_grade", F.get("tails", F.lit(0)).alias("p_good"), F.get("tails", F.lit(1)).alias("p_best"), "kept")


_ALL = (
    op1_quality_rules,
    op2_best_fit_packing,
    op3_suffix_dedup,
    op4_html_extraction,
    op5_mixing,
    op6_substring_dedup,
    op7_exact_dedup,
    op8_minhash_dedup,
    op9_toxicity,
    op10_quality_classifier,
)
QUERIES = {f.__name__: f for f in _ALL}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: op3 in SQL makes a row of each byte, which is too slow on whole tables; op1, 2, 4, 5, 9 and 10
#: learn, tokenize, parse or draw.  The tests compare these with brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS a FROM documents),
p AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS i, len(a) AS n FROM w),
win AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s FROM p),
d AS (SELECT doc_id, i FROM win WHERE i <= n - 19 QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
g AS (SELECT p.doc_id, p.i, p.word, coalesce(p.i - max(d.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) < 20, false) AS gone FROM p LEFT JOIN d USING (doc_id, i))
SELECT w.doc_id, any_value(len(a)) AS n_words, count_if(gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id
""",
    "op7_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_LOWER} AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
""",
    "op8_minhash_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER)} AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
        ELSE [a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] FOR i IN range(1, len(a) - 1)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id JOIN n na ON na.doc_id = x.doc_id JOIN n nb ON nb.doc_id = y.doc_id
      GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
}
