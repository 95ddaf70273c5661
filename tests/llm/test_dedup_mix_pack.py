import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.llm.components import components
from contactloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from contactloom.llm.minhash import drop_near_duplicates, near_duplicates
from contactloom.llm.mixing import mix, mixed_documents
from contactloom.llm.packing import Tokens, best_fit, pack_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, part string, target int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def row(i, text, source="s"):
    return (i, text, "en", source, None if text is None else len(text), 7, "x", 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 8))) for _ in range(400)]
    out, texts = [], [None, "", "  \n ", "one", "one two", "One Two", "ÉCOLE", "école"]
    for _ in range(90):
        texts.append(" ".join(r.choice(words) for _ in range(r.randint(1, 300))))
    base = [r.choice(words) for _ in range(150)]
    for _ in range(120):  # copies of one text with more or fewer changes
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    texts.append(" ".join(r.choice(words) for _ in range(6000)))
    r.shuffle(texts)
    for i, t in enumerate(texts + texts[:15]):
        out.append(row(i * 2 + 1, t, r.choice(["a", "a", "a", "b", "c", None])))
    return out


def test_exact(spark, rows):
    def norm(t):
        return (t or "").encode().lower()

    last, size = {}, collections.Counter(norm(t) for _, t, *_ in rows)
    for i, t, *_ in rows:
        last[norm(t)] = max(i, last.get(norm(t), i))
    want = {(i, last[norm(t)], size[norm(t)], i == last[norm(t)], hashlib.sha256(norm(t)).hexdigest()) for i, t, *_ in rows}
    assert {tuple(x) for x in exact_duplicates(frame(spark, rows), hash_all=True).collect()} == want
    assert drop_exact_duplicates(frame(spark, rows)).count() == len(last)


def test_exact_odd_rows(spark):
    odd = [row(None, "a"), row(1, "A"), row(1, "a"), row(2, "b"), row(2, "b"), row(None, None)]
    got = sorted((x.doc_id or 0, x.keep_id or 0, x.group_size, x.kept) for x in exact_duplicates(frame(spark, odd)).collect())
    assert got == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 2, True), (2, 2, 2, True)]
    assert exact_duplicates(frame(spark, [])).count() == 0


def near_brute(rows, width, percent):
    def shingles(t):
        w = WORD.findall((t or "").encode().lower().decode())
        if not w:
            return set()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near(spark, rows, width, percent):
    got = near_duplicates(frame(spark, rows), width=width, percent=percent).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = near_brute(rows, width, percent)
    assert {tuple(x) for x in got} == want
    assert len({w[2] for w in want}) < len(rows) - 50


def test_near_blocks_of_a_large_cell(spark, rows, monkeypatch):
    from contactloom.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 20)
    got = near_duplicates(frame(spark, rows), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert {tuple(x) for x in got} == near_brute(rows, 3, 85)


def test_near_odd_rows(spark):
    got = near_duplicates(frame(spark, [row(None, "a b"), row(4, "A b"), row(4, None), row(5, "")])).collect()
    assert sorted((x.doc_id or 0, x.n_shingles, x.component_id, x.kept, x.first) for x in got) == [(0, 1, 4, False, True), (4, 0, 4, True, True), (4, 1, 4, True, False), (5, 0, 5, True, True)]
    assert near_duplicates(frame(spark, [row(None, "q r")])).first().component_id is None
    assert near_duplicates(frame(spark, [])).count() == 0 and drop_near_duplicates(frame(spark, [])).count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, _stay long, _low string, _id long, _hash long, _nth int, _spans string, own int, key string, size int, sha string, rid string, hash string, part int"


def odd_frame(spark, pairs):
    """Rows whose other columns have the names that operators might use."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x", 2, 3, 4, "y", 5, "z", 6, "w", "v", "u", 7) for i, t in pairs], ODD).repartition(3)


def test_decisions_are_on_rows(spark):
    """Of rows with one id each is judged by its own text, in both dedups, whatever the columns' names."""
    base = " ".join(f"w{i}" for i in range(60))
    got = drop_exact_duplicates(odd_frame(spark, [(1, "a"), (1, "b"), (2, "a"), (None, "c"), (None, "c"), (None, "C"), (3, "d"), (3, "d")]))
    assert got.columns == odd_frame(spark, []).columns
    assert sorted((x.doc_id or 0, x.text.lower()) for x in got.collect()) == [(0, "c"), (1, "b"), (2, "a"), (3, "d")]
    got = drop_near_duplicates(odd_frame(spark, [(0, base), (5, base + " end"), (5, "u"), (None, None), (None, None), (7, "u"), (7, "u"), (8, "")]))
    assert got.columns == odd_frame(spark, []).columns
    assert sorted((x.doc_id or 0, x.text or "") for x in got.collect()) == [(0, ""), (0, base), (5, "u"), (8, "")]


def test_ids_that_repeat_give_ids(spark, rows):
    """One repeated id in a whole table changes the component of no other row."""
    more = [*rows, row(rows[0][0], rows[0][1])]
    got = near_duplicates(frame(spark, more), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert {tuple(x) for x in got} == near_brute(rows, 3, 85) and len(got) == len(more)


def test_many_equal_rows_are_numbered(spark, monkeypatch):
    from contactloom.llm import blocks

    monkeypatch.setattr(blocks, "EQUAL", 3)
    rows, plain = blocks.ordered_rows(frame(spark, [row(None, "x")] * 10 + [row(2, "b"), row(2, "a"), row(2, "b"), row(1, None)]), "doc_id", "text")
    got = sorted((x.rid, x.doc_id, x.text) for x in rows.collect())
    assert not plain and [x[0] for x in got] == list(range(14)) and [x[1] for x in got] == [None] * 10 + [1, 2, 2, 2]
    assert sorted(x[2] for x in got) == [""] + ["a", "b", "b"] + ["x"] * 10


def test_split_join_of_large_tables(spark, monkeypatch):
    """Beyond what may be broadcast whole, hot keys and others give what one broadcast gives."""
    from contactloom.llm import blocks

    left = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("k"))
    right = left.groupBy("k").count().filter("k <> 'k9'").withColumn("v", F.length("k"))
    want = sorted(map(tuple, blocks.split_join(left, right, ["k"], "count", [F.col("id")]).select("id", "k", "v").collect()))
    monkeypatch.setattr(blocks, "SMALL", 10)
    monkeypatch.setattr(blocks, "HOT", 20)
    assert sorted(map(tuple, blocks.split_join(left, right, ["k"], "count", [F.col("id")]).select("id", "k", "v").collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("many", [10, 1000])
def test_gather_loses_no_pair(many):
    """Items within the distance hang together by the edges, whether dealt at once or gathered in two steps."""
    from contactloom.llm import minhash

    r = np.random.default_rng(4)
    base = r.integers(0, 4, (6, 64))
    sig = np.concatenate([np.where(r.random((40, 64)) < r.choice([0.1, 0.25, 0.4]), r.integers(0, 4, (40, 64)), b) for b in base]).astype(np.uint16)
    short, key, doc = minhash._short(sig), np.repeat(np.arange(3), 80).astype(np.uint64), np.arange(240)
    assert (minhash._distance(short[:100], short[100:200]) == (sig[:100] != sig[100:200]).sum(axis=1)).all()

    def roots(*edges):
        root = np.arange(240)
        for _ in range(300):
            for e in edges:
                low = np.minimum(root[e[0]], root[e[1]])
                np.minimum.at(root, e[0], low)
                np.minimum.at(root, e[1], low)
        return root

    whole, _, _ = minhash.gather(key, doc, np.zeros(240, np.uint8), short, many)
    parts, left = [], []
    for p in range(4):
        at = np.flatnonzero(doc % 4 == p)
        e, stay, radius = minhash.gather(key[at], doc[at], np.zeros(len(at), np.uint8), short[at], many)
        parts.append(e)
        left.append((at[stay], radius))
    at, radius = (np.concatenate(x) for x in zip(*left, strict=True))
    order = np.lexsort((doc[at], key[at]))
    e, _, _ = minhash.gather(key[at][order], doc[at][order], radius[order], short[at][order], many)
    for found in (roots(whole), roots(*parts, e)):
        for i in range(240):
            near = np.flatnonzero((key == key[i]) & ((sig != sig[i]).sum(axis=1) <= minhash.DISTANCE))
            assert (found[near] == found[i]).all()


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(r.randint(400, 600), r.randint(400, 600)) for _ in range(120)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k in got}
    assert set(root) - set(got) <= {a for a, b in edges if a == b}


def fill(sizes, weights=(5, 2, 1), most=3):
    total, out, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left = float(total)
    while free:
        level = left / sum(w[i] for i in free)
        full = {i for i in free if level * w[i] > most * sizes[i]}
        if not full:
            for i in free:
                out[i] = level * w[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free -= full
    return out


def test_mix(spark, rows):
    got = mix(frame(spark, rows)).collect()
    assert sorted(x.doc_id for x in got) == sorted(r[0] for r in rows)
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    per = [sum(size[r[0]] for r in rows if r[3] == n) for n in names]
    target = dict(zip(names, fill(per), strict=True))
    taken = collections.Counter()
    for x in got:
        assert x.size == size[x.doc_id] and x.source_size == per[names.index(x.source)]
        assert abs(x.target - target[x.source]) < 1e-6 and 0 <= x.taken <= 3 * x.size
        taken[x.source] += x.taken
    for n in names:
        assert abs(taken[n] - target[n]) <= 0.01 * target[n] + 1, (n, taken[n], target[n])
    assert {tuple(x) for x in got} == {tuple(x) for x in mix(frame(spark, rows)).collect()}
    # the rows of the mix hold the same words
    mixed = mixed_documents(frame(spark, rows))
    assert mixed.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    words = collections.Counter()
    for x in mixed.collect():
        words[x.doc_id] += len(WORD.findall(x.text))
        assert x.text in rows[0] or x.n_chars == len(x.text)
    assert {x.doc_id: x.taken for x in got if x.taken} == dict(words)


def test_mix_is_drawn_by_shards(spark, rows, monkeypatch):
    """Each shard is full, each source's counts sum up to its slots, and what is taken comes from the draw."""
    from contactloom.llm import mixing

    monkeypatch.setattr(mixing, "SHARD", 64)
    sized, targets, _, slots = mixing._prepared(frame(spark, rows), "doc_id", "text", "source", (5, 2, 1), 3, [])
    counts = mixing.shard_counts(targets, 3)
    got = counts.collect()
    per, by = collections.Counter(), collections.Counter()
    for x in got:
        per[x.shard] += x["count"]
        by[x.skey] += x["count"]
    assert len(per) == -(-slots // 64) > 5 and [per[i] for i in range(len(per) - 1)] == [64] * (len(per) - 1)
    want = {t.skey: t.slots for t in targets.collect() if t.slots}
    assert dict(by) == want
    # shards differ by chance around their shares
    share = max(want, key=want.get)
    own = [x["count"] for x in got if x.skey == share and x.shard < len(per) - 1]
    assert len(set(own)) > 1 and abs(sum(own) / len(own) - 64 * want[share] / slots) < 6
    drawn = mixing.draws(targets, counts, 3).collect()
    assert {(x.skey, x.k) for x in drawn} == {(s, k) for s, n in want.items() for k in range(n)}
    blocks = {t.skey: t.blocks for t in targets.collect()}
    for s, n in want.items():
        times = collections.Counter(x.block for x in drawn if x.skey == s)
        assert set(times) <= set(range(blocks[s])) and max(times.values()) - min([times[b] for b in range(blocks[s])]) <= 1
    assert "deal0" in mix(frame(spark, rows))._jdf.queryExecution().optimizedPlan().toString()


def test_mixed_rows_keep_their_columns(spark):
    odd = odd_frame(spark, [(1, "a b c"), (1, "a b c"), (1, "d"), (None, "e f"), (None, None), (2, "")])
    got = mixed_documents(odd).collect()
    assert mixed_documents(odd).columns == odd.columns
    assert all(x._stay == 1 and x.own == 5 and x._spans == "y" and x.n_chars == len(x.text) for x in got)
    taken = collections.Counter()
    for x in mix(odd).collect():
        taken[x.doc_id] += x.taken
    words = collections.Counter()
    for x in got:
        words[x.doc_id] += len(x.text.split())
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_mix_odd_rows(spark):
    odd = [row(None, "a b c", None), row(1, None, "x"), row(1, "a b", "x"), row(1, "a b", "x"), row(1, "a b", "x")]
    got = mix(frame(spark, odd)).collect()
    assert len(got) == 5 and sum(x.taken for x in got) > 0
    assert sum(len(x.text.split()) for x in mixed_documents(frame(spark, odd)).collect()) == sum(x.taken for x in got)
    assert mix(frame(spark, [])).count() == 0 and mixed_documents(frame(spark, [])).count() == 0
    assert [x.taken for x in mix(frame(spark, [row(1, "", "a")])).collect()] == [0]


def test_tokens_are_the_tokenizers():
    r = random.Random(1)
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    marks = [" ", " ", " ", "  ", "\n", "\n ", " \n", "\t", "\x1c", " ", " ", "\x0b", "\x85", "", ".", "'s", "<|endoftext|>", "12", "é", "日本", "​", "!?"]
    texts = ["".join(r.choice(marks) + r.choice(["a", "word", "Ünder", "x1"]) for _ in range(r.randint(0, 30))) + r.choice(marks) for _ in range(3000)]
    got = Tokens(None).encode(texts)
    assert got == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_pack(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pack_documents(frame(spark, rows), keep_ids=True).collect()
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for x in got:
        assert x.length <= 1024 and len(x.ids) == 4 * x.length and zlib.crc32(x.ids) == x.ids_crc32
        docs[x.doc_id].append(x)
        seqs[x.sequence_id].append((x.offset, x.length))
    total = 0
    for i, t, *_ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        p = sorted(docs[i], key=lambda x: x.piece)
        assert b"".join(x.ids for x in p) == np.array(ids, "<u4").tobytes()
        assert [x.piece for x in p] == list(range(len(p))) and all(x.length == 1024 for x in p[1:])
        assert [x.start for x in p] == [sum(y.length for y in p[:k]) for k in range(len(p))]
        total += len(ids)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert -(-total // 1024) <= len(seqs) <= len(best_fit([x.length for x in got])) * 1.01 + 1


@pytest.mark.parametrize("items", [16, 60])
def test_pack_climbs_the_tree(spark, rows, monkeypatch, items):
    """Small parts under a tree of several levels come within 1 % of one best-fit packing of all pieces."""
    from contactloom.llm import packing

    monkeypatch.setattr(packing, "ITEMS", items)
    r = random.Random(8)
    more = [row(10_000 + i, " ".join(r.choice(["alpha", "of", "river", "x"]) for _ in range(r.randint(1, 700)))) for i in range(900)] + rows
    got = pack_documents(frame(spark, more)).collect()
    seqs = collections.defaultdict(list)
    for x in got:
        seqs[x.sequence_id].append((x.offset, x.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len({(x.doc_id, x.piece) for x in got}) == len(got) and len(got) >= len(more)
    assert len(seqs) <= len(best_fit([x.length for x in got])) * 1.01


def test_equal_sizes_across_nodes(spark, monkeypatch):
    from contactloom.llm import packing

    monkeypatch.setattr(packing, "ITEMS", 4)
    got = pack_documents(frame(spark, [row(i, "one two three") for i in range(300)])).collect()
    assert len(got) == 300 and len({x.sequence_id for x in got}) == 2


def test_no_two_sequences_fit_into_one(spark, monkeypatch):
    """Bins that don't go up the tree, however many, meet all others: one part holds long pieces, the other short ones."""
    from contactloom.llm import packing

    monkeypatch.setattr(packing, "ITEMS", 103)
    docs, doc = [], 0
    for j in range(205):
        while zlib.crc32(f"{doc} 0 {j + 1}".encode()) % 2 != (j >= 140):
            doc += 1
        docs.append((doc, "x " * (700 if j < 140 else 300)))
        doc += 1
    got = pack_documents(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    seqs = collections.defaultdict(list)
    for x in got:
        seqs[x.sequence_id].append((x.offset, x.length))
    for s in seqs.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))]
    used = sorted(sum(n for _, n in s) for s in seqs.values())
    assert len({x.doc_id for x in got}) == len(got) == 205 and used[-1] <= 1024
    assert used[0] + used[1] > 1024


def test_fill_is_best_fit_of_counts():
    from contactloom.llm.packing import fill

    r = random.Random(6)
    for _ in range(200):
        limit = r.choice([10, 50, 1024])
        sizes = [r.randint(1, limit - 1) for _ in range(r.randint(0, 60))] + [r.randint(1, 9)] * r.randint(0, 30)
        got, seen = [], collections.Counter()
        for n, held in fill(collections.Counter(sizes), limit):
            for b in range(n):
                got.append(sorted(s for s, _, k, _ in held for _ in range(k)))
                assert [o for *_, o in held] == [sum(s * k for s, _, k, _ in held[:i]) for i in range(len(held))]
                seen.update((s, a + b * k + j) for s, a, k, _ in held for j in range(k))
        assert max(seen.values(), default=1) == 1 and all(q < sizes.count(s) for s, q in seen)
        assert sorted(got) == sorted(sorted(sizes[i] for i in b) for b in best_fit(sizes, limit) if len(b) > 1)


def test_best_fit():
    assert sorted(map(sorted, best_fit([600, 424, 500, 524, 1]))) == [[0, 1], [2, 3], [4]]
    assert best_fit([]) == []


def test_pack_odd_rows(spark):
    odd = [row(None, None), row(1, ""), row(1, "a"), row(1, "a")]
    got = pack_documents(frame(spark, odd)).collect()
    assert sorted(x.length for x in got) == [1, 1, 2, 2] and len({x.sequence_id for x in got}) == 1
    assert pack_documents(frame(spark, [])).count() == 0


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        components(chain, rounds=1)
