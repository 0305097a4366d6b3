"""Operators 1, 5, 8 and 10 against brute force, with the odd cases of their contracts."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from motifspark.llm import alike, common, exact_dedup, simhash, suffix_dedup, vector_dedup
from motifspark.llm.common import components

R = random.Random(5)
DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, h1 string, mark string"


def docs_frame(spark, rows):
    """(doc_id, text) with the other columns, some of whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y", "z") for i, t in rows], DOC)


def roots(nodes, links):
    """Smallest node reachable from each, by union-find."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(R.randrange(400), R.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(50)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert {r.node: r.root for r in components(df).collect()} == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert components(df.limit(0)).count() == 0


class Largest:
    """Wraps a function of groups and notes the rows of the largest in a file."""

    def __init__(self, work, path):
        self.work, self.path = work, path

    def __call__(self, group):
        with open(self.path, "a") as f:
            f.write(f"{len(group)}\n")
        return self.work(group)


def test_hot_bucket_is_cut(spark, tmp_path):
    """A bucket of 40 blocks: no group has more than a pair of blocks, no bin more than its share, and every pair meets."""
    block, n = 50, 2000
    rows = spark.range(n).select(common.F.lit(7).alias("key"), "id")
    sizes = spark.createDataFrame([(7, n)], "key int, n long")
    path = str(tmp_path / "groups")

    def pairs(group):
        lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
        a, b = (group["own"] == lo).sum(), (group["own"] == hi).sum()
        yield pd.DataFrame({"n": [a * (a - 1) // 2 if lo == hi else a * b]})

    dealt = common.block_pairs(rows, sizes, ["key"], ["id"], block)
    bins = common.bins_for(sizes, block, 400)
    assert bins == 16 + n * 40 // 400
    met = common.in_bins(dealt, ["key", "lo", "hi"], bins, Largest(pairs, path), "n long")
    assert met.agg(common.F.sum("n")).first()[0] == n * (n - 1) // 2
    with open(path) as f:
        assert max(map(int, f)) <= 2.6 * block  # blocks are dealt by hash
    per_bin = dealt.groupBy(common.F.expr(f"pmod(xxhash64(29, key, lo, hi), {bins})")).count().agg(common.F.max("count")).first()[0]
    assert per_bin <= 3000


def test_scratch_goes_with_its_step(spark):
    with pytest.raises(ValueError), common.own_scratch(spark):
        kept = common.stored(spark.range(3), keep=True)
        gone = common.stored(spark.range(3))
        raise ValueError
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not.?exist|FAILED_READ"):
        gone.count()


# ---- exact

EXACT = [(i, R.choice(["Abc", "aBC", "", "é", "É", "x" * 50, "X" * 50, "y" * 49 + "z", "ab\ncd", None, "long " * 40 + str(i % 3)])) for i in range(60)] + [(3, "Abc"), (3, "abc"), (None, "é"), (None, "alone"), (77, "q" * 300)]


def exact_wanted(rows):
    lower = lambda t: (t or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"parallel_bytes": 16}, {"modulus": 3, "piece_bytes": 8}], ids=["plain", "pieces", "collisions"])
def test_exact(spark, options):
    rows = exact_dedup.exact_groups(docs_frame(spark, EXACT), **options).collect()
    assert sorted((tuple(r) for r in rows), key=str) == exact_wanted(EXACT)


def test_exact_edges(spark):
    assert exact_dedup.exact_groups(docs_frame(spark, [])).count() == 0
    kept = exact_dedup.drop_exact(docs_frame(spark, EXACT))
    assert kept.columns == [x.split()[0] for x in DOC.split(", ")]
    lower = lambda t: (t or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))
    want = {(k, sha) for _, k, _, _, sha in exact_wanted(EXACT)}
    got = [(r.doc_id, hashlib.sha256(lower(r.text).encode()).hexdigest()) for r in kept.collect()]
    assert len(got) == len(want) and set(got) == want
    assert exact_dedup.drop_exact(docs_frame(spark, [])).count() == 0


REPEATED = [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "c"), (None, "c"), (2, "A"), (5, None), (4, ""), (None, None)]
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row string, key0 long, kept0 long, times long, n long, name string, m_id long, d_id long, id long, mark long, fp long, root long, `a.b` long"


def clashing_frame(spark, rows):
    """(doc_id, text) with further columns of all the names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", *[100 + k] * 4, "n", *[200 + k] * 7) for k, (i, t) in enumerate(rows)], CLASHING)


def test_rows_that_repeat_an_id(spark):
    """Texts of their own are never lost with an id, and copies never stay with one."""
    df = clashing_frame(spark, REPEATED)
    for drop in (exact_dedup.drop_exact, simhash.drop_near):
        got = drop(df).collect()
        whole = {tuple(r) for r in df.collect()}
        assert all(tuple(r) in whole for r in got) and got[0].asDict().keys() == set(df.columns)
        kept = sorted(((r.doc_id, (r.text or "").lower()) for r in got), key=str)
        want = [(2, "a"), (1, "b"), (None, "c"), (5, "")] if drop is exact_dedup.drop_exact else [(1, "a"), (1, "b"), (None, "c"), (4, "")]
        assert kept == sorted(want, key=str)
        assert drop(df.limit(0)).count() == 0


def test_exact_bitmap_overflow(spark):
    """Far more shared fingerprints than bits: more is compared, with the same result."""
    rows = exact_dedup.exact_groups(docs_frame(spark, EXACT), most_bits=1 << 3).collect()
    assert sorted((tuple(r) for r in rows), key=str) == exact_wanted(EXACT)


def test_fingerprints_combine():
    a, b = bytes(R.randbytes(70_000)), bytes(R.randbytes(90_001))
    whole, left, right = (exact_dedup.fingerprint(x) for x in (a + b, a, b))
    assert whole == tuple(exact_dedup.combine(left[k], right[k], len(b), k) for k in (0, 1))
    assert exact_dedup.fingerprint(b"\0") != exact_dedup.fingerprint(b"\0\0")


# ---- SimHash


def plain_simhash(text):
    low = (text or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_shingles(text):
    words = "".join(c if c not in "\t\n\r\v\f" else " " for c in (text or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_near(texts):
    """Pairs (i, j) of positions that the near-dedup stage links: by two bits, or 0.8 of the five-word shingles."""
    prints, sets = [plain_simhash(t) for t in texts], [plain_shingles(t) for t in texts]
    with_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            with_shingle.setdefault(x, []).append(i)
    out = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 2}
    for some in with_shingle.values():
        for k, i in enumerate(some):
            out |= {(i, j) for j in some[k + 1 :] if (i, j) not in out and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    return out


def near_texts():
    base = [" ".join(R.choice("one two three four five six seven eight nine ten".split()) + str(R.randrange(40)) for _ in range(150)) for _ in range(4)]
    out = []
    for i in range(160):
        words = R.choice(base).split()
        for _ in range(R.randrange(3)):
            words[R.randrange(len(words))] = "zz" + str(R.randrange(9))
        out.append((i * 2, " ".join(words)))
    odd = ["", None, "   ", "one", "One two", "one two three", "ONE two", "a b c", "A  b\tc"]
    return out + [(1001 + k, t) for k, t in enumerate(odd)] + [(4, out[2][1]), (None, out[0][1]), (None, "only null")]


def simhash_wanted(rows):
    prints = [plain_simhash(t) for _, t in rows]
    distinct = sorted(set(prints))
    links = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= 2]
    root = roots(distinct, links)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        least.setdefault(root[p], []).append(i)
    return sorted(((i, f"{p:016x}", min((x for x in least[root[p]] if x is not None), default=None)) for (i, _), p in zip(rows, prints, strict=True)), key=str)


@pytest.mark.parametrize("block", [1024, 3])
def test_simhash(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = near_texts()
    got = simhash.simhash_groups(docs_frame(spark, rows)).collect()
    want = simhash_wanted(rows)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert len({w[2] for w in want}) < len({w[1] for w in want})  # some differing fingerprints are linked


def test_simhash_edges(spark):
    assert simhash.simhash_groups(docs_frame(spark, [])).count() == 0
    rows = near_texts()
    kept = simhash.drop_near(docs_frame(spark, rows)).collect()
    root = roots(range(len(rows)), plain_near([t for _, t in rows]))
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root[k], []).append(i)
    wanted = [min((i for i in g if i is not None), default=None) for g in groups.values()]
    assert sorted((r.doc_id for r in kept), key=str) == sorted(wanted, key=str)
    assert len(wanted) < len({w[2] for w in simhash_wanted(rows)})  # similarity links more than two bits do
    long = " ".join(f"word{i}" for i in range(200_000))
    assert [r.fingerprint for r in simhash.simhash_groups(docs_frame(spark, [(1, long)])).collect()] == [f"{plain_simhash(long):016x}"]


def edited(words, similarity):
    """The words with single ones replaced until the five-word similarity would fall below `similarity`, and its value."""
    best, now = words, 1.0
    for at in R.sample(range(len(words)), len(words)):
        more = [*best[:at], f"new{R.randrange(10**9)}", *best[at + 1 :]]
        a, b = plain_shingles(" ".join(words)), plain_shingles(" ".join(more))
        if len(a & b) / len(a | b) < similarity:
            break
        best, now = more, len(a & b) / len(a | b)
    return best, now


@pytest.mark.parametrize("block", [512, 3])
def test_near_copies_go(spark, monkeypatch, block):
    """Copies at a similarity of 0.8 to 0.9 go, texts below 0.8 stay; a group of many blocks; texts longer than a sketch."""
    monkeypatch.setattr(alike, "BLOCK", block)
    rows = []
    for g in range(40):
        words = [f"w{R.randrange(5000)}" for _ in range(R.choice([60, 120, 300]))]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(edited(words, 0.8)[0])), (10 * g + 2, " ".join(edited(words, 0.5)[0]))]
    words = [f"h{k}" for k in range(90)]
    rows += [(1000 + k, " ".join([*words, f"tail{k}"])) for k in range(60)]  # one hot group
    for g in range(2):
        words = [f"l{R.randrange(10**6)}" for _ in range(5000)]
        far = [w if R.random() > 0.12 else f"x{k}" for k, w in enumerate(words)]
        rows += [(2000 + 10 * g, " ".join(words)), (2001 + 10 * g, " ".join(w if R.random() > 0.01 else "q" for w in words)), (2002 + 10 * g, " ".join(far))]
    root = roots(range(len(rows)), plain_near([t for _, t in rows]))
    want = {rows[k][0] for k in range(len(rows)) if root[k] == k}
    assert {r.doc_id for r in simhash.drop_near(docs_frame(spark, rows)).collect()} == want
    assert not any(10 * g + 1 in want for g in range(40)) and all(10 * g + 2 in want for g in range(40)) and {1000, 2000, 2002} <= want


def test_recall_of_samples():
    """Of pairs just at the threshold at least 0.99 share a table."""
    found = 0
    for _ in range(500):
        words = [f"w{R.randrange(10**6)}" for _ in range(100)]
        other, value = edited(words, 0.8)
        assert 0.8 <= value < 0.9
        a, b = (alike.sample_prints(alike.shingle_hashes(" ".join(w).encode(), 5)) for w in (words, other))
        found += bool((a == b).any())
    assert found >= 495


def test_unit_balls_meet(spark):
    """The lower bound holds, and any two vectors at distance 2 share a grid point."""
    pairs = []
    for _ in range(300):
        a = R.getrandbits(64)
        b = a ^ (1 << R.randrange(64)) ^ (1 << R.randrange(64))
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long").select(simhash.unit_ball(simhash.cell(simhash.F.col("a"))).alias("x"), simhash.unit_ball(simhash.cell(simhash.F.col("b"))).alias("y"))
    assert all(set(r.x) & set(r.y) for r in df.collect())


# ---- vectors


def vector_wanted(rows):
    good = [(i, np.array(v, float), g) for i, v, g in rows if i is not None and v and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, links = {}, []
    for a in range(len(good)):
        for b in range(len(good)):
            if a != b and good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]):
                x, y = good[a][1] / np.abs(good[a][1]).max(), good[b][1] / np.abs(good[b][1]).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    n[good[a][0]] = n.get(good[a][0], 0) + 1
                    links.append((good[a][0], good[b][0]))
    root = roots({i for i, _, _ in rows if i is not None}, links)
    return sorted(((i, n.get(i, 0), root.get(i), i == root.get(i)) for i, _, _ in rows), key=str)


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 24))
    out = [(i, [float(x) for x in np.float32(centres[R.randrange(6)] + rng.normal(size=24) * R.choice((0.02, 0.1, 1)))], R.choice((0, 1))) for i in range(150)]
    out += [(200, out[0][1], out[0][2]), (201, [x * 2 for x in out[0][1]], out[0][2]), (202, [-x for x in out[0][1]], out[0][2])]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None] + [0.0] * 22, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.1], [1e30] * 24, [2e30] * 24]
    return out + [(300 + k, v, 0) for k, v in enumerate(odd)] + [(400, out[0][1], None), (None, out[0][1], 0)]


@pytest.mark.parametrize("block", [1024, 5])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<float>, label int, rep string, n int")
    got = vector_dedup.vector_groups(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == vector_wanted(rows)
    assert vector_dedup.vector_groups(df.limit(0)).count() == 0


def test_vector_recall_at_the_threshold(spark):
    """Pairs just above the least cosine, the hardest to retrieve."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.935 * x + np.sqrt(1 - 0.935**2) * noise
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate((x, y)))]
    got = vector_dedup.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sum(r.n_links for r in got.collect()) >= 0.9 * 3000


@pytest.mark.parametrize("width", [12, 16, 20])
def test_vector_recall_of_wide_substrings(spark, width):
    """As many pairs at the threshold are found with the widths of large labels."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.9301 * x + np.sqrt(1 - 0.9301**2) * noise
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate((x, y)))]
    got = vector_dedup.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), width=width)
    found = sum(r.n_links for r in got.collect()) / 3000
    print(f"width {width}: recall {found:.3f}")
    assert found >= 0.95


# ---- repeated strings


def strings_wanted(rows):
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out[i] = (len(b), sum(cover), sum(1 for k, c in enumerate(cover) if c and not (k and cover[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def repeating():
    word = lambda: "".join(R.choice("abcdeé") for _ in range(R.randint(1, 6)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rows = {}
    for i in range(120):
        t = ""
        for _ in range(R.randint(0, 4)):
            k, p = R.random(), R.choice(passages)
            a = R.randint(0, 100)
            t += " " + " ".join(word() for _ in range(R.randint(1, 50))) if k < 0.4 else p[a : a + R.randint(60, 300)] if k < 0.85 else "ab" * R.randint(10, 400) if k < 0.93 else passages[0]
        rows[i * 3] = t
    return rows | {1000: rows[9], 1001: rows[9], 1002: None, 1003: "short", 1004: "short"}


@pytest.mark.parametrize("options", [{}, {"split": 5}, {"most_bits": 8}], ids=["plain", "cut keys", "joined"])
def test_repeated_strings(spark, options):
    rows = repeating()
    got = suffix_dedup.repeated_spans(docs_frame(spark, rows.items()), **options).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == strings_wanted(rows)
    for r in got:
        assert sum(s.end - s.first for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


@pytest.mark.parametrize("options", [{}, {"split": 1}, {"most_bits": 8}], ids=["plain", "cut keys", "joined"])
def test_strings_repeated_in_one_region(spark, options):
    """Unique periodic runs of so few windows that they are one region, alone and amid other words."""
    runs = ["a" * 101, "b" * 120, "xyzq" * 32, "=-" * 70, "lol " * 33, "a phrase that comes again, and then ... " * 4, "c" * 100, "d" * 163, "e" * 165]
    words = lambda: " ".join(f"w{R.randrange(10**9)}" for _ in range(30))
    rows = dict(enumerate([*runs, *(f"{words()} {x.swapcase()} {words()}" for x in runs if x[0].isalpha())]))
    want = strings_wanted(rows)
    assert want[1][1] == 119 and sum(w[1] > 0 for w in want.values()) >= 14
    got = suffix_dedup.repeated_spans(docs_frame(spark, rows.items()), **options).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_repeated_strings_edges(spark):
    assert suffix_dedup.repeated_spans(docs_frame(spark, [])).count() == 0
    text = "".join(R.choice("abc") for _ in range(150))
    twice = suffix_dedup.repeated_spans(docs_frame(spark, [(5, text), (5, text), (None, text), (7, "x" + text)])).collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in twice))
    assert got == [(False, 5, 150), (False, 5, 150), (False, 7, 150), (True, 0, 0)]


def test_suffix_array():
    for text in (b"banana", b"a" * 300, bytes(R.choice(b"ab") for _ in range(900)), b"x"):
        data = np.frombuffer(text, np.uint8)
        order, rank, tied = suffix_dedup.suffix_array(data)
        cut = [text[i : i + 128].ljust(128, b"\0") for i in order]
        assert cut == sorted(cut) and sorted(order) == list(range(len(text))) and list(rank[order]) == list(range(len(text)))
        assert list(tied) == [k > 0 and cut[k] == cut[k - 1] for k in range(len(cut))]


def test_runs_are_merged_in_suffix_order():
    """The earliest place of each window stays, wherever it comes; all other places go."""
    rows, wanted = [], {}
    for salt in range(9):
        for w in R.sample(range(60), R.randint(0, 40)):
            place = (R.randrange(5), R.randrange(3), len(rows))
            rows.append((salt, bytes([w]) + b"\0x" * 49 + b"\0", *place))
            wanted.setdefault(w, []).append(place)
    got = suffix_dedup._merge(pd.DataFrame(rows, columns=["salt", "window", *suffix_dedup.PLACE]))
    assert sorted(zip(got["id"], got["mark"], got["first"])) == sorted(p for places in wanted.values() for p in sorted(places)[1:])
