"""Operators 11, 12 and 13 against plain loops, with the odd cases of their contracts."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from motifspark.llm import exact_topk, importance, prefix_trie

R = random.Random(11)
VEC = "vec_id long, embedding array<double>, id string, v int, query_id string, score string, `a.b` int"


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y", "z", 2) for i, v in rows], VEC)


def plain_top(rows, k, every):
    """(query, rank, id, score) by comparing everything, in whole numbers."""
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(64 * x) for x in v)]
    whole = [(i, [math.floor(x) * 64 if abs(x) > 2**60 else math.floor(64 * x) for x in v]) for i, v in ok]
    asked = {}
    for i, v in sorted((i, v) for i, v in ok if i % every == 0):
        asked.setdefault(i, [math.floor(x) * 64 if abs(x) > 2**60 else math.floor(64 * x) for x in v])
    out = set()
    for q, mine in asked.items():
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(mine, v)))), i) for i, v in whole if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def found_top(spark, rows, k=5, every=4, **options):
    out = exact_topk.top_products(vectors_frame(spark, rows), F.col("id") % every == 0, k, **options).collect()
    assert len(set(map(tuple, out))) == len(out) or any(i is not None for i, _ in rows)
    return {tuple(r) for r in out}


@pytest.mark.parametrize("blocks", [(4096, 4096), (7, 50)])
def test_top_k_equals_all_comparisons(spark, blocks):
    """Clusters, so that bounds prune; small blocks, so that bounds pass from block to block."""
    centres = [[R.gauss(0, 0.2) for _ in range(40)] for _ in range(4)]
    rows = [(i, [c + R.gauss(0, 0.05) for c in centres[R.randrange(4)]]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # ties
    assert found_top(spark, rows, query_block=blocks[0], candidate_block=blocks[1]) == plain_top(rows, 5, 4)


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, -0.01]), (4, [0.5]), (8, []), (12, None), (16, [1.0, None]), (20, [float("nan"), 1.0]), (24, [float("inf")]), (None, [1.0, 1.0]), (28, [1e308]), (1, [0.25, 0.75, 3.0]), (2, [0.0, 0.0]), (-4, [-1.0, 2.0])]
    assert found_top(spark, rows) == plain_top(rows, 5, 4)
    huge = [(i, [R.uniform(-1, 1) * 10.0 ** R.randrange(0, 30) for _ in range(3)]) for i in range(40)]
    assert found_top(spark, huge) == plain_top(huge, 5, 4)


def test_top_k_of_repeated_rows_and_of_few(spark):
    rows = [(0, [1.0]), (0, [2.0]), (1, [3.0]), (1, [3.0])]
    got = [tuple(r) for r in exact_topk.top_products(vectors_frame(spark, rows), F.col("id") % 4 == 0, 3).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 64 * 192), (0, 2, 1, 64 * 192)]  # asked once, with the smaller vector; each copy is a candidate
    assert found_top(spark, [(0, [1.0])]) == set()
    assert found_top(spark, [(1, [1.0]), (3, [1.0])]) == set()
    assert found_top(spark, []) == set()


TURN = "conv_id long, turn long, role string, text string, conv string, i int, n int, d string, `a.b` int"


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], TURN)


def plain_trie(rows):
    def said(role, text):
        return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()

    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, said(role, text), len(text or "")))
    own = {c: [(s, n) for _, _, s, n in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + t[h:]
    members = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    children, out = {}, set()
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)

    def below(key):
        saved, leaves = (len(members[key]) - 1) * (key[-1][1] if key else 0), 0 if key in children else 1
        for k in children.get(key, []):
            s, n = sums[k]
            saved, leaves = saved + s, leaves + n
        return saved, leaves

    sums = {}
    for key in sorted(members, key=len, reverse=True):
        sums[key] = below(key)
    for key, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(key))))
        out.add((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(children.get(key, [])), sums[key][1], sums[key][0], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found_trie(spark, rows):
    made = prefix_trie.rebuilt(prefix_trie.turns(turns_frame(spark, rows)))
    out = [tuple(r) for r in prefix_trie.trie(*made).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_trie_equals_plain_prefixes(spark):
    rows = []
    for c in range(330):
        n = R.randrange(1, 9)
        if c % 3 == 0:  # a third of all conversations are copies
            rows += [(c, t, "user", f"same {t}") for t in range(6)]
        else:
            rows += [(c, t, R.choice(["user", "assistant"]), R.choice(["a", "bb", "é", "dddd"])) for t in range(n)]
    rows += [(700, t, "user", f"long {t % 7}") for t in range(1100)]
    assert found_trie(spark, rows) == plain_trie(rows)


def test_trie_of_odd_turns(spark):
    rows = [(None, 0, "user", "x"), (-7, None, None, None), (-7, 3, "user", "😀 é"), (-7, 3, "user", "😀 é"), (5, 1, "b", "c"), (5, 1, "bc", ""), (5, None, "", "bc"), (100, 0, "user", "only"), (101, 9, None, "q"), (105, 0, "x", "y" * 100_000)]
    assert found_trie(spark, rows) == plain_trie(rows)
    turnless = [(c, 0, "user", "x") for c in (3, 5, 9) if zlib.crc32(str(c).encode()) % 6]
    assert turnless and found_trie(spark, turnless) == plain_trie(turnless)
    assert found_trie(spark, []) == set()


def test_sums_and_numbers_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN", 3)
    rows = spark.createDataFrame([(k, i, i * i) for k in (1, 2) for i in range(20)], "k int, i long, x long")
    got = {(r.k, r.i): r.from_here for r in prefix_trie.sums_from(rows, "k", "i", "x").collect()}
    assert got == {(k, i): sum(j * j for j in range(i, 20)) for k in (1, 2) for i in range(20)}
    many = spark.range(3000).select((F.col("id") % 2 * F.lit(0)).alias("k"), (-F.col("id")).alias("o"))
    got = prefix_trie.numbered(many.repartition(7), "k", [F.col("o")]).collect()
    assert len(got) == 3000 and all(r.i == r.o + 2999 for r in got)


DOCS = "doc_id long, text string, id string, weight int, score string, rank string, k0 int, `a.b` int"


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_buckets(text):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % importance.BUCKETS for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resampled(docs, target):
    s, t = [0] * importance.BUCKETS, [0] * importance.BUCKETS
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in plain_buckets(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + len(s)) / ((a + 1) * (sum(t) + len(t))))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        b = plain_buckets(text)
        w = sum(gain[x] for x in b)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(b), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text)) >= 20])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], 2**63 if r[0] is None else r[0]))
    ranks = {id(r): n + 1 for n, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


def found_resampled(spark, docs, target):
    table = spark.createDataFrame([(*d, "x", 1, "y", "z", 2, 3) for d in docs], DOCS)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    return sorted(map(tuple, importance.resampled(table, goal).collect()), key=str)


def test_resampling_equals_plain_loops(spark):
    words = ["Alpha", "beta9", "ÉTÉ", "日本", "x" * 63, "y" * 64, "z" * 200, "the", "a"]
    text = lambda n: R.choice([" ", "\t-", "\n"]).join(R.choice(words) for _ in range(n))
    docs = [(i, text(R.choice([0, 1, 2, 3, 19, 20, 60]))) for i in range(400)]
    docs += [(900, None), (901, "."), (None, text(30)), (902, "word " * 30_000), (903, text(5) + "\x7f{|Z")]
    target = [text(10) for _ in range(20)] + [None, ""]
    assert found_resampled(spark, docs, target) == plain_resampled(docs, target)
    assert found_resampled(spark, docs[:5], []) == plain_resampled(docs[:5], [])
    assert found_resampled(spark, [], target) == []


def test_resampling_of_repeated_rows(spark):
    docs = [(7, "word " * 25)] * 60 + [(8, "other " * 25)] * 50
    got = found_resampled(spark, docs, ["word"])
    assert sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4, 5] and {r[0] for r in got if r[4]} == {7} and len(got) == 110


def test_radix_selection(spark):
    """The k-th key among ties of either digit, in as many rounds as are needed."""
    rows = [(R.choice([5, 1 << 40, -3]), R.choice([0, 1, -1])) for _ in range(200)]
    keys = sorted((a % 2**64, b % 2**64, i) for i, (a, b) in enumerate(rows))
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "k0 long, k1 long, k2 long")
    for k in (1, 17, 100, 199, 200):
        bound = tuple(importance._smallest(df, ["k0", "k1", "k2"], k))
        assert sum(x <= bound for x in keys) == k
