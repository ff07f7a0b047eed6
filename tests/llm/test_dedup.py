"""Near-duplicate operators against brute force, with the odd rows that each must take."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from firmlake.llm import embed_dedup, line_dedup, ngram_join, spotsigs
from firmlake.llm.common import FlatWords, components


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def copies(seed, sizes, counts):
    """Texts in groups of near copies."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(14):
        base = [r.choice(vocabulary) for _ in range(r.choice(sizes))]
        for _ in range(r.choice(counts)):
            x = list(base)
            for _ in range(r.randint(0, max(1, len(x) // 20))):
                x[r.randrange(len(x))] = r.choice(vocabulary)
            out.append((" " * r.randint(1, 2)).join(x).upper() if r.random() < 0.3 else "\n".join(x))
    return out


def smallest(nodes, links):
    p = {i: i for i in nodes}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def test_flat_words():
    texts = ["Ab c\n\nab", None, "", " \t x" * 3, "é É ab"]
    f = FlatWords(texts)
    flat = [w for t in texts for w in words(t)]
    assert len(f.h) == len(flat)
    seen = defaultdict(set)
    for w, h in zip(flat, f.h.tolist()):
        seen[w].add(h)
    assert all(len(x) == 1 for x in seen.values()) and len({min(x) for x in seen.values()}) == len(seen)
    assert [len(f.of(i)) for i in range(len(texts))] == [len(words(t)) for t in texts]


def test_components(spark):
    edges = [(5, 4), (4, 9), (9, 2), (8, 7), (3, 3)] + [(100, i) for i in range(101, 140)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = smallest({x for e in edges for x in e} - {3}, edges[:4] + edges[5:])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_join(spark):
    rows = list(enumerate(copies(1, (3, 5, 8, 30, 120), (1, 4, 12))))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "z " * 20_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, sigs string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()}
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest(sets, links)
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    assert ngram_join.ngram_components(df.limit(0)).count() == 0


def test_signatures_keep_the_threshold():
    rng = np.random.default_rng(2)
    for n in (5, 9, 40, 150, 400, 2_000):
        for _ in range(40):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            y = x.copy()
            y[: n // 9] = rng.integers(0, 2**63, n // 9).astype(np.uint64)
            a, b = np.unique(x), np.unique(y)
            assert set(ngram_join.signatures(a).tolist()) & set(ngram_join.signatures(b).tolist())
            c = a[: -(-n * 4 // 5)]
            assert set(ngram_join.signatures(a).tolist()) & set(ngram_join.signatures(c).tolist())


def test_line_dedup(spark):
    texts = copies(4, (1, 2, 6, 12, 40), (1, 5, 20))
    r = random.Random(9)
    rows = [(i, "\n".join(" ".join(r.choice(texts).split()) for _ in range(r.randint(0, 4)))) for i in range(70)]
    rows += [(900, None), (901, ""), (902, "\n\n a \n"), (903, "one two three " * 5_000)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_lines long").repartition(5)
    gone, sets, index = set(), [], defaultdict(list)
    seen = set()
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(words(line))
            if not s:
                continue
            if s in seen:
                gone.add((i, k))
                continue
            seen.add(s)
            shared = Counter(j for w in s for j in index[w])
            if any(180 * n >= 80 * (len(s) + len(sets[j])) for j, n in shared.items()):
                gone.add((i, k))
            sets.append(s)
            for w in s:
                index[w].append(len(sets) - 1)
    want = {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
    for hot in (2, 4_000):
        got = {x.doc_id: x.text for x in line_dedup.dedup_lines(df, hot=hot).collect()}
        assert got == want
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_rows_with_one_id(spark):
    a, b = "alpha beta gamma\nunique line here", "other text one\nalpha beta gamma"
    rows = [(1, a), (1, b), (1, a), (None, a), (None, None), (2, "unique line here\nfresh words")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted(((r.doc_id, r.text) for r in got), key=str)
    # which of two texts of one doc_id is the first is set by a hash
    one = [(1, a), (1, a), (1, "other text one")], [(1, "unique line here")] * 2 + [(1, b)]
    rest = [(None, a), (None, None), (2, "fresh words")]
    assert texts in [sorted(x + rest, key=str) for x in one]


def test_lines_that_ask_again(spark):
    """The earliest candidate of a line passes the filters and is not similar, a later one is."""
    r = random.Random(4)
    rows, n = [], 0
    for g in range(25):
        base = [f"g{g}_{k}" for k in range(10)]
        rows.append((n, " ".join([*base[:8], f"x{g}", f"y{g}"])))  # shares 8 of 12 words with the whole
        rows.append((n + 1, " ".join([*base[:9], f"z{g}"])))  # shares 9 of 11
        rows.append((n + 2, " ".join(r.sample(base, 10))))
        n += 3
    sets = {i: frozenset(words(t)) for i, t in rows}
    want = {i for i in sets if any(j < i and 180 * len(sets[i] & sets[j]) >= 80 * (len(sets[i]) + len(sets[j])) for j in sets)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    asked = []
    again = line_dedup._asked_again
    line_dedup._asked_again = lambda *a: asked.append(1) or again(*a)
    try:
        assert {x.doc_id for x in line_dedup.dedup_lines(df).where("n_removed > 0").collect()} == want and len(want) >= 25
    finally:
        line_dedup._asked_again = again


def test_long_and_hot_lines(spark):
    r = random.Random(3)
    words_ = [f"v{i}" for i in range(900)]
    base = r.sample(words_, 400)
    rows = [(i, " ".join([*base[: 400 - i], *(f"n{i}_{k}" for k in range(i))])) for i in range(60)]
    rows += [(100 + i, f"the common words of a line {i % 40}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: frozenset(words(t)) for i, t in rows}
    gone = {i for i in sets if any(j < i and 180 * len(sets[i] & sets[j]) >= 80 * (len(sets[i]) + len(sets[j])) for j in sets)}
    for hot in (1, 10, 4_000):
        assert {x.doc_id for x in line_dedup.dedup_lines(df, hot=hot).where("n_removed > 0").collect()} == gone


def test_lines_that_several_tasks_meet_are_not_compared(spark, monkeypatch):
    """Copies of a line need no partner, in whatever task they are; a near copy meets the first of them only."""
    r = random.Random(6)
    lines = [" ".join(r.sample([f"v{i}" for i in range(300)], 20)) for _ in range(30)]
    rows = [(100 * k + i, t) for k in range(6) for i, t in enumerate(lines)] + [(900 + i, t.rsplit(" ", 1)[0] + " other") for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    pairs = []
    verified = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda lines, p, percent: pairs.append({(x.xd, x.yd) for x in p.collect()}) or verified(lines, p, percent))
    want = {i for i, _ in rows if i >= 100}
    for most in (1_000_000, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_PLACES", most)
        pairs.clear()
        assert {x.doc_id for x in line_dedup.dedup_lines(df).where("n_removed > 0").collect()} == want
        if most:
            assert set().union(*pairs) == {(900 + i, i) for i in range(30)}


def test_lines_of_other_lengths_are_not_asked_again(spark):
    """A word of a line that asks brings only lines that are long enough and not too long, and none of these is missed."""
    levels = np.full(1 << line_dedup.SKETCH_BITS, 2, np.uint8)

    def wanted(n, further=0):
        batch = {"n": [n], "words": [b"".join(i.to_bytes(6, "little") for i in range(n))]}
        return line_dedup._Prefixes(batch, levels, 80).wanted(further)

    for n in [*range(1, 300), 1_000, 1_024, 1_280, 70_000]:
        asked = {x for k in (-1, 0, 1) for x in wanted(n, k).tolist()}
        for m in {n, -(-80 * n // 100), n * 100 // 80}:
            assert set(wanted(m)[: min(len(wanted(n)), len(wanted(m)))].tolist()) <= asked
        assert not set(wanted(2 * n).tolist()) & asked or n == 70_000


def test_bytes_of_dealt_words(spark):
    """Numbers come back from a bucket's bytes as they were; those of small ids take little room."""
    r = np.random.default_rng(2)
    x = np.concatenate([r.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2), r.integers(0, 256, 500).astype(np.uint64)])
    blobs = line_dedup._planes(x, 8, [(0, 3), (3, 3), (3, 1_000)])
    assert (line_dedup._from_planes(blobs, 8) == x).all() and [len(b) for b in blobs] == [24, 0, 7_976]
    assert len(zlib.compress(line_dedup._planes(x, 8, [(500, 1_000)])[0], 1)) < 600


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + 0.1 * rng.normal(size=(20, 16)), np.repeat(base[:1], 30, 0), base[1] + 0.05 * rng.normal(size=(40, 16))])
    rows = [(i, v.tolist(), int(i % 60 % 3)) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0] * 16, None), (904, [1.0] * 3, 1), (905, [2.0] * 3, 1), (906, [None] * 16, 1), (907, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, block=16).collect()}
    fine = {i: (np.float32(v).astype(float), y) for i, v, y in rows if v and None not in v and y is not None and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in fine for b in fine if a < b and fine[a][1] == fine[b][1] and len(fine[a][0]) == len(fine[b][0])
             and fine[a][0] @ fine[b][0] / np.linalg.norm(fine[a][0]) / np.linalg.norm(fine[b][0]) >= 0.93]
    n, want = Counter(x for e in links for x in e), smallest([r[0] for r in rows], links)
    assert got == {i: (n[i], want[i], want[i] == i) for i in want}


def test_caps_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(embed_dedup.caps(x), embed_dedup.caps(y))]) > 0.998


@pytest.mark.parametrize("width", [6, 64])
def test_embeddings_that_share_ids(spark, width):
    """One vec_id with other vectors and other labels: every row is a node of its own."""
    rng = np.random.default_rng(9)
    e = [v / np.linalg.norm(v) for v in rng.normal(size=(5, width))]
    near = lambda v: (v + 0.02 * rng.normal(size=width)).tolist()
    rows = [(1, near(e[0]), 1), (1, near(e[3]), 1), (2, near(e[0]), 1), (3, near(e[3]), 1), (2, near(e[0]), 2), (1, near(e[0]), 2), (9, near(e[1]), 1), (9, near(e[1]), 1), (9, near(e[1]), 2)]
    rows += [(20 + i % 4, near(e[2]), i % 2) for i in range(30)] + [(5, e[4].tolist(), 1), (5, e[4].tolist(), 2), (4, e[4].tolist(), 1)]
    fine = [(i, np.array(v), y) for i, v, y in rows]
    unit = [v / np.linalg.norm(v) for _, v, _ in fine]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if fine[a][2] == fine[b][2] and unit[a] @ unit[b] >= 0.93]
    n, group = Counter(x for link in links for x in link), smallest(range(len(rows)), links)
    low = {g: min(rows[k][0] for k in group if group[k] == g) for g in group.values()}
    want = [(rows[k][0], n[k], low[group[k]], rows[k][0] == low[group[k]]) for k in range(len(rows))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = embed_dedup.near_duplicates(df, block=8).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(links) > 200


def sigs(text):
    """Spot signatures as tuples of words: anchor run and two content words."""
    stop = set(spotsigs.ANCHORS)
    plain = " ".join(re.findall(r"[^\W_]+", (text or "").lower()))
    runs, now = [], []
    for w in plain.split():
        now.append(w)
        if w not in stop:
            runs.append(now)
            now = []
    if now:
        runs.append(now)
    out = {(*a, b[-1]) for a, b in zip(runs, runs[1:]) if len(a) > 1}
    return out or {(a[-1], b[-1], "pair") for a, b in zip(runs, runs[1:])} or {("whole", text or "")}


def test_spot_signatures(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    odd = [(5001, None), (5002, ""), (5003, "word"), (5004, "the"), (5005, "two words"), (5006, "!!!"), (5007, "the cat sat on the mat"), (5008, "The " * 30_000), (5009, "x of the " * 9_000)]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string")).cache()
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(docs.repartition(3)).collect()}
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(texts):
        j, after = texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, a, b in ((r.near_edited, sigs(t), sigs(edited)), (r.near_next, sigs(t), sigs(after))):
            assert abs(near - len(a & b) / len(a | b)) < 1e-9
        assert len(r.fingerprint) == 8 * len(sigs(t))
    prints = {}
    for i, t in texts:
        prints.setdefault(got[i].fingerprint, i)
    want = {(min(i, j), max(i, j)) for f, i in prints.items() for g, j in prints.items() if i != j
            and 100 * len(a := {f[k : k + 8] for k in range(0, len(f), 8)} & {g[k : k + 8] for k in range(0, len(g), 8)}) >= 80 * (len(f) // 8 + len(g) // 8 - len(a))}
    assert {(r.a, r.b) for r in spotsigs.near_pairs(docs).collect()} == want
    assert spotsigs.edited_fingerprints(docs.limit(0)).count() == 0


def test_spot_signatures_of_odd_ids(spark):
    rows = [(None, "the lost text of a row", "x"), (3, "the cat of a house", "x"), (3, "the cat of a house", "x"), (1, "one of the dogs", "x"), (None, None, "x")]
    got = spotsigs.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, sigs string")).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("1", 15), ("3", 18), ("3", 18), ("None", 0), ("None", 22)]
    lost = next(r for r in got if r.doc_id is None and r.n_chars)
    assert lost.edited_sha256 == hashlib.sha256(b"the lost te").hexdigest() and lost.near_next == 0.0
    one = next(r for r in got if r.doc_id == 1)
    assert one.edited_sha256 == hashlib.sha256(b"one of t" + b"the cat").hexdigest()
    assert sorted(r.near_next for r in got if r.doc_id == 3)[-1] == 1.0


def test_ngram_join_of_rows_with_one_id(spark):
    r = random.Random(1)
    a, b = ([f"{c}{r.randint(0, 99)}" for _ in range(60)] for c in "xy")
    near = lambda w: " ".join([*w[:-1], "end"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, None), (None, " ".join(a)), (5, "a b c d e f g"), (5, "a b c d e f g")]
    for order in (rows, [rows[1], rows[0], *rows[2:]], rows[::-1]):
        got = ngram_join.ngram_components(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert sorted({(str(x.doc_id), x.component_id) for x in got}, key=str) == [("1", 1), ("2", 1), ("3", 1), ("4", 4), ("5", 5), ("None", None)] and len(got) == 8


def test_ngram_join_in_rounds(spark):
    """A large group of near copies of which many are not near each other, and a passage that others share."""
    r = random.Random(2)
    base = [f"w{r.randint(0, 5_000)}" for _ in range(300)]
    rows = []
    for i in range(90):
        x = list(base)
        for _ in range(r.randint(0, 6)):
            x[r.randrange(len(x))] = f"n{i}"
        rows.append((i, " ".join(x)))
    rows += [(200 + i, " ".join([*base[:80], *(f"v{i}_{k}" for k in range(100))])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    want = smallest(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    for rounds in (0, 1, 4):
        assert {x.doc_id: x.component_id for x in ngram_join.ngram_components(df, rounds=rounds).collect()} == want


def test_embeddings_with_odd_ids(spark):
    rows = [(1, [1.0, 2.0, 0.5], 1, "x"), (1, [1.0, 2.0, 0.5], 1, "x"), (None, [1.0, 2.0, 0.5], 1, "x"), (7, [1.0, 2.0, 0.4], 1, "x"), (8, [1.0] * 5, 1, "x"), (9, [1.0] * 6, 1, "x"), (10, [1.1, *[1.0] * 5], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cap string")
    got = sorted(((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()), key=str)
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("10", 1, 9, False), ("7", 2, 1, False), ("8", 0, 8, True), ("9", 1, 9, True), ("None", 0, None, None)]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_an_empty_row_stands_with_its_document(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, ""), (5, text), (2, text + " z"), (5, None), (8, ""), (8, None), (None, ""), (9, " "), (9, "other words stand here today")]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles > 0, r.component_id) for r in got), key=str) == sorted(
        [(5, False, 2), (5, True, 2), (2, True, 2), (5, False, 2), (8, False, 8), (8, False, 8), (None, False, None), (9, False, 9), (9, True, 9)], key=str
    )


def test_signatures_leave_out_what_similar_sets_need_not_share():
    rng = np.random.default_rng(5)
    for n in (60, 150, 400, 2_000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        own = {ngram_join.band(n), ngram_join.band(n) - 1}
        assert len(ngram_join.signatures(x)) <= sum(ngram_join.family(i)[0] + 1 for i in own)


def _open_group(spark, sets: dict[int, list[int]], components: dict[int, int]):
    """The rows of one group, with the bounds that the operator works out for texts of these words."""
    words = {i: " ".join(f"w{x}" for x in s) for i, s in sets.items()}
    df = spark.createDataFrame(list(words.items()), "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) t", "text").cache()
    base = ngram_join.map_rows(df, lambda b: ngram_join._described(b, 80, 1), ngram_join.BASE + ", bits array<long>")
    found = ngram_join._Sets(df, base, 80, 1)
    ids = found.sketch.selectExpr("k1 id", "rep")
    tops = found.tops(ids.select("id")).join(ids, "id").toPandas().assign(g=7)
    tops["component"] = tops["rep"].map(components)
    return tops


def test_sets_with_much_of_their_own_leave_a_group(spark):
    """Copies that are too far from each other do not meet pair by pair; those that may be similar do."""
    import pyarrow as pa

    common = list(range(100))
    far = {i: common[:86] + [1000 * i + j for j in range(14)] for i in range(1, 61)}
    rows = pa.Table.from_pandas(_open_group(spark, far, {i: i for i in far}), preserve_index=False)
    assert len(ngram_join._open(rows)) == 0
    near = far | {100: common[:86] + list(range(200, 214)), 101: common[:86] + list(range(200, 213))}
    rows = pa.Table.from_pandas(_open_group(spark, near, {i: i for i in near}), preserve_index=False)
    assert sorted(ngram_join._open(rows).column("rep").to_pylist()) == [100, 101]


def test_ngram_join_of_a_large_open_group(spark, monkeypatch):
    """Groups in several chunks and tasks lose no link: copies of one text with edits that partly agree, against all pairs."""
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    monkeypatch.setattr(ngram_join, "MAP_ROWS", 40)
    monkeypatch.setattr(ngram_join, "OPEN_ROWS", 50)
    monkeypatch.setattr(ngram_join, "BLOCK", 100)
    rng = random.Random(11)
    plain = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(160):
        w = plain[:]
        for at in rng.sample(range(150), rng.randint(0, 9)):
            w[at] = f"x{rng.randint(0, 2)}"
        texts[i] = " ".join(w)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, x.split()) for i, x in texts.items())}
    want = smallest(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert 1 < len(set(want.values()))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for rounds in (0, 4):
        assert {r.doc_id: r.component_id for r in ngram_join.ngram_components(df, rounds=rounds).collect()} == want
