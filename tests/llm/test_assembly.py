"""Fill-in-middle, centroid clustering and source mixing, against plain versions and odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlake.llm import centroids, middle, mixing
from firmlake.llm.common import table

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.mark.parametrize("kind", ["array", "bitmap", "runs"])
def test_containers(kind):
    rng = random.Random(kind)
    if kind == "runs":
        low = np.concatenate([np.arange(a, a + rng.randint(100, 900)) for a in range(0, 64_000, 1000)])
    else:
        low = np.array(sorted(rng.sample(range(1 << 16), 900 if kind == "array" else 30_000)))
    c = middle.Container(low)
    assert c.kind == kind
    for k in [0, len(low) - 1, *rng.sample(range(len(low)), 300)]:
        assert c.select(k) == low[k]


def test_boundaries_of_long_texts():
    rng = random.Random(3)
    text = "".join(rng.choice(("word ", "7", "éè", "\U0001f600", "Abc", "\n", "x" * 70_000, "9" * 70_000, "abc d" * 40_000)) for _ in range(60))
    ends = [0, *(m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text))]
    found = middle.boundaries(text)
    assert len(found) == len(ends) and {c.kind for c in found.containers} >= {"runs", "bitmap"}
    for k in [0, 1, len(ends) - 1, *rng.sample(range(len(ends)), 2_000)]:
        assert found.select(k) == ends[k]
    assert len(middle.boundaries("")) == 1 and middle.boundaries("").select(0) == 0


def plain_middle(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 20
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def written(spark, tmp_path, rows, schema, name="documents"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_fill_in_middle_of_odd_rows(spark, tmp_path):
    texts = [None, "", "a", "<P>", "x<S>y", "a<M>", "<", "<P", "S>P>", "é\U0001f600 abc 12\n\tz", "word " * 40_000, "1234567890" * 30_000, "<<P <S <M " * 50, "same", "same", " \x00 "]
    rows = [(i, t, "clash", 5) for i, t in enumerate(texts * 8)] + [(None, "no id here", "c", 1), (None, None, "c", 1), (7, "twice", "c", 1), (7, "twice", "c", 1)]
    d = written(spark, tmp_path, rows, "doc_id long, text string, form string, n long")
    got = middle.op11_fill_in_middle(spark, d).collect()
    want = [plain_middle(i, t) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert middle.fill_in_middle(empty).count() == 0


def plain_clusters(rows, k, rounds, width, scale):
    kept = [(i, [int(np.floor(float(z) * scale)) for z in v]) for i, v in rows if v is not None and len(v) == width and all(z is not None and np.isfinite(z) and abs(z * scale) < 1 << 27 for z in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *near(v)) for i, v in kept]
    whole = sum(d for _, d, _ in found)
    return [(i, n, d, sum(e for _, e, m in found if m == n), whole, tuple(centres[n])) for i, d, n in found]


def test_clusters_against_plain_rounds(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 7, 0.7 + 0.2 * (i % 3)) for _ in range(5)]) for i in range(600)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(300)]  # one very common vector
    rows += [(7, [0.5] * 5), (7, [0.5] * 5), (None, [0.25] * 5), (None, None), (2000, [1.0, None, 1.0, 1.0, 1.0]), (2001, [float("nan")] * 5), (2002, [float("inf")] * 5), (2003, [1.0] * 4), (2004, []), (2005, [3e6] * 5), (2006, [-1e-9] * 5)]
    df = spark.createDataFrame([(i, v, 1.5, "c") for i, v in rows], "vec_id long, embedding array<double>, distance double, cluster string").repartition(5)
    for k, rounds in ((16, 3), (6, 9), (1, 2)):
        got = centroids.cluster_vectors(df, k, rounds, 5, 64).collect()
        want = plain_clusters(rows, k, rounds, 5, 64)
        assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got), key=repr) == sorted(want, key=repr)
        assert all(r.evaluated <= k * (rounds + 1) for r in got)
        if rounds == 9:
            assert sum(r.evaluated for r in got) < 0.5 * k * 10 * len(got)  # bounds spare most distances


def test_few_vectors_and_ties(spark):
    df = spark.createDataFrame([(i, [float(i % 2)] * 3) for i in range(6)], "vec_id long, embedding array<float>")
    want = plain_clusters([(i, [float(i % 2)] * 3) for i in range(6)], 16, 3, 3, 64)
    got = centroids.cluster_vectors(df, 16, 3, 3, 64).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(w[:3] for w in want) and {r.cluster for r in got} < set(range(6))
    assert centroids.cluster_vectors(df, 16, 3, 64).count() == 0 and centroids.cluster_vectors(df.where("false"), 4, 3, 3).count() == 0


def test_bounds_use_the_total_displacement():
    history = np.zeros((4, 2, 2), np.int64)
    history[:, 1] = 100
    history[1, 0], history[2, 0] = (50, 0), (0, 0)  # away and back: the sum of moves is 100, the displacement 0
    b = centroids.Bounds.fresh(np.array([[1, 0]]), 2)
    b.assign(history[:1])
    before = b.evaluated.copy()
    b.assign(history[:3])
    assert b.cluster[0] == 0 and (b.evaluated == before).all()


def plain_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = sum(sizes.values()) - sum(repeats * sizes[s] for s in full)
        target = {s: repeats * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[z] for z in open_) for s in open_}
        over = {s for s in open_ if target[s] > repeats * sizes[s]}
        if not over:
            return target
        full |= over


def test_permutations(spark):
    for n in (1, 2, 3, 7, 64, 65, 1000):
        p = lambda key: [r[0] for r in spark.range(n).orderBy("id").select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(key))).collect()]
        one, two = p(1), p(2)
        assert sorted(one) == sorted(two) == list(range(n)) and (n < 7 or one != two and one != list(range(n)))


@pytest.mark.parametrize("block,shard", [(64, 4096), (3, 5)])
def test_mixing_of_odd_rows(spark, block, shard):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.choice((0, 1, 3, 40, 200)))), "hot" if i % 3 else rng.choice(("a", "b", "é", "", "\U0001f600", "z"))) for i in range(400)]
    rows += [(1000, None, "only empty"), (1001, "", None), (1002, "one word \x0b two", None), (None, "no id", "a"), (None, "no id", "a"), (5, "x y z", "b"), (5, "x y z", "b"), (5, "x y", "b"), (1003, "w " * 30_000, "long"), (1004, "tiny", "Tiny")]
    df = spark.createDataFrame([(*r, 9, "c") for r in rows], "doc_id long, text string, source string, size int, taken string").repartition(4)
    got = mixing.mix(df, block=block, shard=shard).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=repr) == sorted(((i, s, size(t)) for i, t, s in rows), key=repr)
    of = {}
    for i, t, s in rows:
        of[s] = of.get(s, 0) + size(t)
    want, taken = plain_targets(of), dict.fromkeys(of, 0)
    for r in got:
        assert r.source_size == of[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in of) and want["Tiny"] == 3
    again = mixing.mix(df.repartition(7), block=block, shard=shard).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_slots_of_a_mix(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 4}") for i in range(300)]
    sizes = mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sources = mixing.targets(sizes)
    by, many = {r.number: r for r in sources.collect()}, {}
    for r in mixing.slots(sources, 8, 64).collect():
        many.setdefault(r.number, []).append(r)
    for number, s in many.items():
        at = sorted(s, key=lambda r: r.j)
        blocks = -(-by[number].source_size // 8)
        assert [r.j for r in at] == list(range(len(at))) and sum(r["take"] for r in at) == by[number].words
        for k in range(0, len(at) - blocks + 1, blocks):  # every whole pass takes each block once
            assert sorted(r.block for r in at[k : k + blocks]) == list(range(blocks))
    of_shard = {}
    for s in many.values():
        for r in s:
            of_shard[r.shard] = of_shard.get(r.shard, 0) + 1
    assert max(of_shard.values()) <= 64 and len(of_shard) > 5


def test_mixing_without_words(spark):
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(none).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mix(none.where("false")).count() == 0


def test_mixing_runs_no_python(spark, sf):
    sizes = mixing.sized(table(spark, sf, "documents"))
    sources = mixing.targets(sizes)
    plan = mixing.mixed(mixing.placed(sizes, sources), sources)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
