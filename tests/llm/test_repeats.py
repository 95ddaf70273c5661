import hashlib
import random
import re

import numpy as np
import pytest

from contactloom.llm.substring_dedup import repeated_words
from contactloom.llm.suffix_dedup import repeated_spans

SCHEMA = "doc_id long, text string, rid string, items int"


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    line = " ".join(r.choice(words) for _ in range(40))
    out = []
    for i in range(60):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(1, 50)))]
        for _ in range(r.randint(0, 3)):
            k = r.random()
            if k < 0.3:
                parts.append(line)
            elif k < 0.6 and out:
                t = r.choice(out)[1] or ""
                a = r.randint(0, len(t))
                parts.append(t[a : a + r.randint(60, 400)])
            else:
                parts.append(r.choice(words) * r.randint(1, 40))
        out.append([i * 3, r.choice([" ", "\n", "  ", "\t"]).join(parts)])
    out[5][1], out[6][1], out[7][1] = None, "", "x" * 350
    out[20][1] = out[10][1]
    return [(a, b, "z", 1) for a, b in out]


def brute_bytes(rows, length):
    seen, out = set(), []
    for d, t, *_ in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def brute_words(rows, length):
    seen, out = set(), []
    for d, t, *_ in sorted(rows, key=lambda x: x[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            if k in seen:
                gone[s : s + length] = [True] * length
            seen.add(k)
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(5)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_bytes(rows, 100)
    assert sum(r.n_removed for r in got) > 1000


def test_spans_of_long_texts_are_read_in_slices(spark):
    long = "".join(random.Random(4).choice("abc") for _ in range(4000))
    rows = [(1, long, "", 0), (2, long[700:2900] + "q" + long[100:800], "", 0), (3, "ab" * 2000, "", 0)]
    got = repeated_spans(spark.createDataFrame(rows, SCHEMA), chunk=300).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_bytes(rows, 100)


@pytest.mark.parametrize("seed", [1, 2])
def test_words_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = repeated_words(spark.createDataFrame(rows, SCHEMA).repartition(5)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got] == brute_words(rows, 20)
    assert sum(r.n_removed for r in got) > 100


def test_odd_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long, "", 0), (1, long, "", 0), (1, long, "", 0), (1, None, "", 0), (2, "", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.rid, r.doc_id, r.n_removed) for r in repeated_words(df).collect())
    assert [x[1] for x in got] == [None, 1, 1, 1, 2] and sorted(x[2] for x in got) == [0, 0, 0, 60, 60] and got[0][2] == got[4][2] == 0
    got = sorted((r.rid, r.n_bytes - r.n_removed) for r in repeated_spans(df).collect())
    assert got[0] == (0, len(long)) and [x[1] for x in got[1:]] == [0, 0, 0, 0]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repeated_words(df).count() == 0
    assert repeated_spans(df).count() == 0


def test_a_frequent_rank_with_many_surroundings(spark):
    """One line in every text, each time between other words: more runs of a rank than a batch sends."""
    r = random.Random(3)
    line = "this very line stands in all of the texts and it is longer than a hundred bytes, so that whole strings of it repeat everywhere"
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    rows = [(i, f"{word()} {word()} {line[: 90 + r.randint(0, 40)]} {word()} {line} {word()}", "", 0) for i in range(80)]
    got = repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(3)).orderBy("doc_id").collect()
    assert [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got] == brute_bytes(rows, 100)


def test_very_long_texts(spark):
    """Two texts of 200,000 words, the second a near copy of the first, through the operators that read texts whole."""
    from contactloom.llm import quality_model
    from contactloom.llm.exact_dedup import exact_duplicates
    from contactloom.llm.minhash import near_duplicates
    from contactloom.llm.mixing import mix
    from contactloom.llm.packing import pack_documents

    r = random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(200_000)]
    other = [w if i % 4000 else "changed" for i, w in enumerate(words)]
    rows = [(1, " ".join(words), "", 0), (2, "\n".join(other), "", 0), (3, "short text", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = repeated_words(df).orderBy("doc_id").collect()
    assert [(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got] == brute_words(rows, 20)
    got = {x.doc_id: x for x in repeated_spans(df).collect()}
    assert got[1].n_bytes == len(rows[0][1]) and got[3].n_removed == 0
    assert {x.doc_id: (x.text_sha256, x.group_size) for x in exact_duplicates(df, hash_all=True).collect()} == {i: (hashlib.sha256(t.encode()).hexdigest(), 1) for i, t, *_ in rows}
    assert {x.doc_id: (x.component_id, x.kept) for x in near_duplicates(df).collect()} == {1: (1, True), 2: (1, False), 3: (3, True)}
    pieces = pack_documents(df).collect()
    assert all(sorted(x.piece for x in pieces if x.doc_id == i) == list(range(sum(x.doc_id == i for x in pieces))) for i in (1, 2, 3))
    assert sum(x.taken for x in mix(df.withColumnRenamed("rid", "source")).collect()) == 400_002
    model = quality_model.Model(np.linspace(-1, 1, quality_model.WIDTH), np.array([0.0, 1.0]))
    assert all(0 < x.expected_grade < 2 for x in quality_model.grade_texts(df, model).collect())
