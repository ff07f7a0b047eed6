"""The stages of the corpus pipeline against plain versions of their rules, over tables with odd rows."""

import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from firmlake.llm import common, langid, line_dedup, ngram_join, packing, quality
from firmlake.llm.common import local_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    en = "the cat and dog of a house was in this old town with many people who read books".split()
    de = "der hund und die katze in einem haus mit vielen alten leuten die gern bücher lesen".split()
    out = []
    for i in range(120):
        pool = en if i % 2 else de
        text = "\n".join(" ".join(r.choice(pool) + str(r.randint(0, 40)) * (r.random() < 0.3) for _ in range(r.randint(3, 25))) for _ in range(r.randint(1, 5)))
        out.append([i, text, "en" if i % 2 else "de", f"s{i % 3}"])
    out += [[200 + i, out[i][1] + " tail", out[i][2], None] for i in range(0, 30, 3)]  # near copies
    out += [[300 + i, out[i][1], out[i][2], "s"] for i in range(0, 30, 5)]  # copies
    out += [[400, None, None, None], [401, "", "en", "s"], [402, " \n\t", None, "s"], [403, "the " * 9_000, "en", "s"], [404, "1 2 !", None, "s"], [5, out[5][1], "en", "s2"], [None, "a house and a dog", "en", "s"]]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int("1" not in (t or "1")), 0) for i, t, *_ in rows if i is not None and i % 4], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture
def docs(spark, rows):
    """With columns that the operators use as names of their own."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return df.withColumns({c: F.lit("clash") for c in ("t", "score", "k1", "bits", "n_removed", "n_lines", "__removed", "item", "component_id", "words")})


def table(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality_stage(spark, docs, sf_dir, rows):
    machine = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    want = []
    for i, t, *_ in rows:
        at, x = quality.features([t])[0]
        z = machine.bias + sum(machine.w[a] * v for a, v in zip(at, x))
        v = machine.v[at] * x[:, None]
        z += sum(float(v[p] @ v[q]) for p in range(len(at)) for q in range(p))
        if abs(z - np.log(0.3 / 0.7)) < 1e-4:
            pytest.skip("a score at the threshold")
        if z >= np.log(0.3 / 0.7):
            want.append((i, t))
    assert kept.columns == list(corpus_pipeline.COLUMNS) and table(kept) == sorted(want, key=str) and 0 < len(want) < len(rows)


def test_language_stage(spark, docs, sf_dir, rows):
    model = langid.fit(docs)
    assert model.languages == ["de", "en"]
    want = []
    for i, t, *_ in rows:
        total, n = np.zeros(2), 0
        for w in (t or "").lower().split():
            at, _ = langid.grams(f"\x01{w}\x01")
            total, n = total + model.logits[at].sum(0), n + len(at)
        if n and model.probabilities(total / n).max() >= model.reject_below:
            want.append((i, t))
    kept = corpus_pipeline.language_stage(spark, docs, sf_dir)
    assert kept.columns == list(corpus_pipeline.COLUMNS) and table(kept) == sorted(want, key=str) and len(want) > 100


def test_line_stage(spark, docs, sf_dir, rows):
    order = sorted(((i, t) for i, t, *_ in rows if i is not None and t), key=lambda x: x[0])
    seen, gone = [], set()
    for i, t in order:
        for k, line in enumerate(t.split("\n")):
            s = frozenset(words(line))
            if s and (i, k) not in [x[0] for x in seen]:
                if any(180 * len(s & o) >= 80 * (len(s) + len(o)) for (j, m), o in seen if (j, m) < (i, k)):
                    gone.add((i, k))
                seen.append(((i, k), s))
    want = []
    for i, t, *_ in rows:
        left = t if t is None or i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        if left == t or words(left):
            want.append((i, left))
    out = corpus_pipeline.line_stage(spark, docs, sf_dir)
    assert out.columns == list(corpus_pipeline.COLUMNS) and table(out) == sorted(want, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_near_duplicate_stage(spark, docs, sf_dir, rows):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        if i is not None:
            sets.setdefault(i, set()).update({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
        if all(group[group[a]] == group[a] for a in group):
            break
    want = [(i, t) for i, t, *_ in rows if i is None or group[i] == i]
    assert table(corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir)) == sorted(want, key=str) and len(want) < len(rows)


def test_packing_stage(spark, docs, sf_dir, rows):
    t = Tokenizer.from_file(local_path("word_bpe_49k.json"))
    got = corpus_pipeline.packing_stage(spark, docs, sf_dir).toPandas()
    want = []
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(-1 if i is None else i, k, 4096 * k, len(ids[4096 * k : 4096 * (k + 1)]), zlib.crc32(ids[4096 * k : 4096 * (k + 1)].tobytes())) for k in range(-(-len(ids) // 4096))]
    assert sorted(got.fillna(-1).astype(int)[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x.offset.tolist() == [0, *x.length.cumsum().tolist()[:-1]] and x.length.sum() <= 4096


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, docs, sf_dir, stage):
    assert stage[1](spark, docs.limit(0), sf_dir).count() == 0


def test_runs_leave_only_their_result(spark, sf_dir):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = set(folder.iterdir())
    assert ngram_join.ngram_components(docs).count() == docs.count() == line_dedup.dedup_lines(docs).count()
    assert len(set(folder.iterdir()) - before) == 2
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_workers_hand_memory_back(spark):
    """A worker that made and dropped many small things between ones that stay is small again in its next task."""
    def fill(batches):
        import builtins

        for batch in batches:
            stay, gone = [], []
            for _ in range(200_000):
                gone.append(bytes(1_500))
                stay.append(bytes(600)) if len(gone) % 40 == 0 else None
            builtins.stay = stay
            del gone
            yield {"mb": [0] * len(batch["id"])}

    def size(batches):
        held = re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())
        for batch in batches:
            yield {"mb": [int(held[1]) // 1024] * len(batch["id"])}

    one = spark.range(1, numPartitions=1)
    before = common.map_rows(one, size, "mb long").first().mb
    common.map_rows(one, fill, "mb long").collect()
    assert max(r.mb for r in common.map_rows(one, size, "mb long").collect()) < max(before, 100) + 100


def test_workers_keep_little_between_tasks(monkeypatch):
    """Plain texts need no second tokenizer in memory, and tables that are soon made anew go with the task."""
    path = local_path("word_bpe_49k.json")
    text, odd = "Plain words, straße 12's\nand café", "a word of 漢字 too"
    want = [Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids for x in (text, odd)]
    used = []
    monkeypatch.setattr(packing, "opened", lambda p, f=packing.opened: used.append(p) or f(p))
    e = packing.WordEncoder(path, packing.word_ranks(path))
    assert e.encode(text).tolist() == want[0] and not used
    assert e.encode(odd).tolist() == want[1] and used
    common.FlatWords(["some words"])
    common.release()
    assert not common._POWERS
