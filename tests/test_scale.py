"""Joins, sums and searches that spread over tasks, against plain versions."""

import random
import string
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from firmlake.operators import entities, ledgers, pages, search, similar
from firmlake.operators.graph import components
from firmlake.operators.running import running_sums
from firmlake.plans import catalog
from firmlake.sources import shared, tables
from tests.plain_html import html_to_text


def test_similar_names_lose_nothing(spark):
    rng = random.Random(11)
    names = set()
    for _ in range(160):
        letters = rng.choice((string.ascii_lowercase, "ab", "abc é\U0001f600-"))
        base = "".join(rng.choices(letters, k=rng.choice((1, 2, 3, 4, 5, 8, 9, 12, 17, 18, 25, 33, 64, 65, 90))))
        names.add(base)
        for _ in range(rng.randint(1, 4)):
            x = list(base)
            for _ in range(rng.randint(1, 1 + len(base) // 8)):
                k = rng.randrange(len(x) + 1)
                x[k : k + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
            names.add("".join(x))
    names |= {"aaaaaaaaaaaa", "aaaaaaaaaaaaa", "abababababab", "babababababa", "abcde", "abcd", "\x02\x02x"}
    names = sorted(names - {""})
    df = spark.createDataFrame([(i, n, i % 3 == 0) for i, n in enumerate(names)], "no long, name string, fresh boolean").repartition(5)
    want = {(i, j) for j in range(len(names)) for i in range(j) if similar.indel(names[i], names[j]) >= 0.88}
    every = df.withColumn("fresh", F.lit(True))
    got = [tuple(r) for r in similar.similar_names(every, 0.88).collect()]
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == want and len(want) > 100
    assert set(map(tuple, similar.similar_names(df, 0.88).collect())) == {p for p in want if p[0] % 3 == 0 or p[1] % 3 == 0}
    looser = {(i, j) for j in range(len(names)) for i in range(j) if similar.indel(names[i], names[j]) >= 0.7}
    assert set(map(tuple, similar.similar_names(every, 0.7).collect())) == looser


def test_rows_compared_are_few(spark, sf):
    """Distinct names and vectors of the test tables: candidates against all pairs."""
    for d in (sf, sf.replace("0.001", "0.01")):
        firms = tables.resolution_firms(spark, d)
        marked = entities._marked(firms)
        values, _ = entities._numbered(marked, "name")
        n = values.count()
        assert similar.name_candidates(values.select("no", "name", "fresh"), 0.88).count() < 0.1 * n * (n - 1) / 2
        values, _ = entities._numbered(marked, "vector")
        n = values.count()
        _, compared = similar.vector_candidates(values.select("no", "vector", "fresh"), 0.82)
        assert compared.agg(F.sum("compared")).first()[0] < 0.1 * n * (n - 1) / 2


@pytest.mark.parametrize("width", [20, 64, 384])
def test_vector_recall(width):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.82 * x + np.sqrt(1 - 0.82**2) * z
    found = [len(np.intersect1d(a, b)) > 0 for a, b in zip(similar.nearest_caps(x), similar.nearest_caps(y))]
    assert np.mean(found) > 0.98


def test_similar_vectors_with_hot_caps(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24))
    rows = [*base, *(base[:15] + 0.3 * rng.normal(size=(15, 24))), *(base[0] + 0.15 * rng.normal(size=(120, 24)))]
    rows += [*rng.normal(size=(30, 3)), *rng.normal(size=(4, 1))]
    vectors = [v.tolist() for v in rows]
    df = spark.createDataFrame([(i, v, True) for i, v in enumerate(vectors)], "no long, vector array<double>, fresh boolean").repartition(3)
    unit = [np.array(v) / np.linalg.norm(v) for v in vectors]
    want = {(i, j) for j in range(len(unit)) for i in range(j) if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.82}
    for block in (512, 16):
        got = [tuple(r) for r in similar.similar_vectors(df, 0.82, block).collect()]
        assert len(got) == len(set(got)) and set(got) <= want and len(got) > 0.99 * len(want) and len(want) > 5_000


def _firms(rng, n, start=0):
    rows = []
    for i in range(start, start + n):
        name = "".join(rng.choices("abcdef", k=7)) + " " + "".join(rng.choices(string.ascii_lowercase, k=8)) if i % 3 or not rows else rows[-1][1] + "s"
        rows.append((i, name, f"https://s{rng.randrange(2 * n)}.com" if i % 4 else "", [rng.gauss(0, 1) for _ in range(32)] if i % 5 or not rows else rows[-1][3]))
    return rows


def test_two_batches_equal_one(spark):
    rng = random.Random(12)
    rows = _firms(rng, 150)
    schema = "id long, firm_name string, website string, embedding array<double>"
    every = spark.createDataFrame(rows, schema)
    pairs = entities.resolve_entities(every).where("same_entity").select("a", "b")
    want = {r.id: r.entity_id for r in entities.entity_components(every.select("id"), pairs).collect()}
    none = spark.createDataFrame([], "id long, entity_id long")
    one, _ = entities.resolve_batch(every.limit(0), none, every)
    assert {r.id: r.entity_id for r in one.collect()} == want and 20 < len(set(want.values())) < 140
    labels, held = none, every.limit(0)
    order = rows[90:] + rows[:90]  # later firms may have smaller ids
    for at in range(0, 150, 50):
        before = {r.id: r.entity_id for r in labels.collect()}
        batch = spark.createDataFrame(order[at : at + 50], schema)
        labels, touched = entities.resolve_batch(held, labels, batch)
        held = held.unionByName(batch)
        now = {r.id: r.entity_id for r in labels.collect()}
        assert {r.entity_id for r in touched.collect()} == {e for i, e in now.items() if before.get(i) != e}
    assert now == want


def test_links_of_a_crowded_site_stay_few(spark):
    rows = [(i, f"{i:05d}" * 3, "https://crowded.com", None) for i in range(400)]
    links = entities.entity_links(spark.createDataFrame(rows, "id long, firm_name string, website string, embedding array<double>"))
    site = links.where("b = 0")
    assert site.count() == 399


def test_components_of_texts(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("z", "z"), (None, "a")], "a string, b string")
    assert sorted(map(tuple, components(edges).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]


@pytest.mark.parametrize("keys", [(), ("k",)])
@pytest.mark.parametrize("falling", [False, True])
def test_running_sums(spark, keys, falling):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("o"), F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 < 8, F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 13 > 0, F.col("id") % 13).alias("v"))
    order = [F.desc("o") if falling else F.col("o")]
    got = running_sums(df, {"s": F.col("v"), "n": F.lit(1)}, order, keys, 7)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.count("*").over(w).alias("n"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert running_sums(df.limit(0), {"s": F.col("v")}, order, keys).count() == 0


def test_a_hot_domain_is_spread(spark):
    """Half of all pages are of one domain: they fill many tasks, and the ranks are those of one sorted list."""
    rows = [(i, f"f{i}", f"https://{'hot' if i % 2 else f'd{i % 50}'}.com/" + "x/" * (i * 7 % 5), "m" * (i % 40)) for i in range(2000)]
    df = spark.createDataFrame(rows, "seq long, file string, url string, markdown string")
    got = {r.seq: (r.domain, r.page_rank) for r in pages.page_ranks(df).collect()}
    want, groups = {}, {}
    for i, _, url, _ in rows:
        groups.setdefault(url.split("/")[2], []).append((url.rstrip("/").count("/") - 2, i))
    for domain, found in groups.items():
        want |= {i: (domain, k + 1) for k, (_, i) in enumerate(sorted(found))}
    assert got == want
    dealt = running_sums(df.withColumn("domain", F.split("url", "/")[2]), {"n": F.lit(1)}, [F.col("seq")], ("domain",), 8)
    assert spark.read.parquet(*dealt.inputFiles()).where("domain = 'hot.com'").select("__range").distinct().count() >= 3
    whole, cut = {r.domain: r for r in pages.domain_bundles(df).collect()}, {}
    for r in pages.bundle_parts(df, 500).collect():
        cut.setdefault(r.domain, []).append((r.part, r.markdown))
    assert cut.keys() == whole.keys() and all("".join(t for _, t in sorted(x)) == whole[d].markdown for d, x in cut.items()) and len(cut["hot.com"]) > 30


def test_budget_over_a_long_list(spark):
    counts = spark.range(5000).select(F.col("id").alias("seq"), (F.col("id") * 31 % 17).alias("n"))
    n = [i * 31 % 17 for i in range(5000)]
    for budget in (0, 1, 20_000, 10**9):
        got = {r.seq: r["take"] for r in ledgers.within_budget(counts, budget).collect()}
        want, before = {}, 0
        for i, x in enumerate(n):
            if budget == 0 or before < budget:
                want[i] = x if budget == 0 else min(x, budget - before)
            before += x
        assert got == want


def test_one_log_over_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    for name, n in (("a.log", 20_000), ("b.log", 30), ("empty.log", 0)):
        lines = ["" if rng.random() < 0.05 else f"{i} {'é' * rng.randint(0, 40)}\r" for i in range(n)]
        (tmp_path / name).write_bytes("\n".join(lines).encode() + b"\n" * (n % 3))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        df = tables.read_log(spark, str(tmp_path))
        tasks = df.where("file_name = 'a.log'").select(F.spark_partition_id()).distinct().count()
        got = sorted(map(tuple, df.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [(f.name, i, x) for f in tmp_path.iterdir() for i, x in enumerate(f.read_bytes().decode().split("\n")) if x]
    assert got == sorted(want) and tasks > 5


@pytest.mark.parametrize("mode", ["filter", "boost"])
def test_search_rules_out_blocks_and_misses_none(spark, mode):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=12)).tolist(), [("A", "B")[i % 2]], ["s"][: i % 4], ["g"][: i % 3]) for i in range(900)]
    rows += [(2000 + i, rng.normal(size=5).tolist(), ["A"], [], []) for i in range(20)] + [(3000, None, ["A"], [], []), (3001, [], ["A"], [], []), (3002, [None] * 12, [], [], [])]
    rows += [(4000 + i, centres[0].tolist(), ["A"], ["s"], ["g"]) for i in range(30)]  # ties
    asked = [(q, (centres[q % 6] + 0.2 * rng.normal(size=12)).tolist(), (None, "A", "B")[q % 3], (None, "s")[q % 2], None) for q in range(60)]
    asked += [(100, centres[0].tolist(), "A", "s", "g"), (101, rng.normal(size=5).tolist(), None, None, None), (102, [0.0] * 12, None, None, None), (103, rng.normal(size=7).tolist(), None, None, None)]
    firms = spark.createDataFrame(rows, "id long, embedding array<double>, focus_sectors array<string>, investment_stage array<string>, geography array<string>")
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<double>, sector string, stage string, geography string")
    want = set()
    for q, v, *facets in asked:
        scored = []
        for i, x, *lists in rows:
            if not x or None in x or len(x) != len(v) or not any(v):
                continue
            has = [f is not None and f in held for f, held in zip(facets, lists)]
            if mode == "filter" and not all(h or f is None for h, f in zip(has, facets)):
                continue
            x, y = np.array(x), np.array(v)
            d = 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y)
            scored.append(((d if mode == "filter" else -round(1 - d + sum(b * h for b, h in zip(search.BOOSTS, has)), 4), round(d, 12), i), i))
        want |= {(q, i) for _, i in sorted(scored)[:7]}
    for block, query_block in ((8192, 1024), (400, 16), (40, 8)):
        got = {(r.query_id, r.id) for r in search.search(firms, queries, 7, mode, block, query_block).collect()}
        assert got == want


def test_html_against_the_standard_parser(spark, sf):
    cases = [
        "<nav>a<footer>b</nav>c</footer>d<p>e</p>", "<p>x<br/>y &amp; z", "", None, "a < b", "a<!--x-->b", "<script>var a='</p>';</script>t", "<style>x", "<p title='a>b'>q</p>", "<P>Q</P >r</DIV>s", '<a href="x>y">k</a>',
        "&copy; &#169; &#xA9 &notit; &eacute &bogus; &#0; &#150; &#xD800; &#x1F600; &#99999999999; &#xFFFF; &#13; &amp;lt; & &; &#; &#x; &Aacutex; &ampx &ltfoo &hellip;", "<header/>v", "<h1>t</h1><li>u</li>\n\n<tr>w</tr>", "text &nbsp; end&nbsp;",
        "<!DOCTYPE html><?php x ?>z", "</>k</ p>m", "<p", "<p foo", "<b>bold</b>it", "<script/>shown", "<head>x</head>y<header>z</header>w", "<navy>kept</navy>", "\x1c a \x85", "<script>a<b</script>k", "<!-- a -- >b",
        "<p>" + "<i a='1' b=\"2\" c=3 d>" * 3000 + "x</p>", "<script>" + "x < y;" * 50_000 + "</script>seen", "<p " + "a='b' " * 20_000 + ">long", "word " * 200_000,
    ]
    rng = random.Random(3)
    bits = ["<nav>", "</nav>", "<p>", "</p>", "<br/>", "<br>", "text", "é ", "&amp;", "&copy", "&#65;", "<script>", "</script>", "<style>", "</style>", " ", "\n", "<!-- c -->", "<div class='x'>", "</div>", "<li>", "</li >", "<footer>", "</footer>", "<h2 id=a>", "</H2>", "<img src='a>b'/>", "& ", "<a>", "</a>"]
    cases += ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(c,) for c in cases], "html string").union(spark.read.parquet(f"{sf}/pages.parquet").select("html"))
    for r in df.select("html", pages.html_text(F.col("html")).alias("text")).collect():
        assert r.text == html_to_text(r.html), (r.html or "")[:300]
    assert "Python" not in pages.page_text(df)._jdf.queryExecution().executedPlan().toString()


def test_candidates_of_names_stay_few(spark):
    """Names of 16 letters share many grams by chance; hardly any pair of them moves on."""
    rng = random.Random(5)
    names = ["".join(rng.choices("abcdefghijklmnop", k=18)) for _ in range(3000)]
    names += [n + "s" for n in names]
    df = spark.createDataFrame([(i, n, True) for i, n in enumerate(names)], "no long, name string, fresh boolean")
    assert 3000 <= similar.name_candidates(df, 0.88).count() < 4500


def test_search_sends_asked_values_and_large_blocks(spark):
    """Of a firm's lists only what is asked for travels, and one block holds more queries than are compared at once."""
    rng = np.random.default_rng(4)
    firms = spark.createDataFrame([(i, rng.normal(size=4).tolist(), [f"s{k}" for k in range(50)], None, ["g"]) for i in range(60)], "id long, embedding array<double>, focus_sectors array<string>, investment_stage array<string>, geography array<string>")
    asked = [(q, rng.normal(size=4).tolist(), "s7" if q % 2 else None, None, "g") for q in range(search.AT_ONCE + 300)]
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<double>, q_sector string, q_stage string, q_geography string")
    slim = search._asked_only(firms, queries).collect()
    assert len(slim) == 60 and all(r.focus_sectors == ["s7"] and r.investment_stage is None and r.geography == ["g"] for r in slim)
    assert search.QUERY_BLOCK > search.AT_ONCE
    plain = queries.withColumnsRenamed({"q_sector": "sector", "q_stage": "stage", "q_geography": "geography"})
    got = {(r.query_id, r.id) for r in search.search(firms, plain, 3).collect()}
    x = np.array([r.embedding for r in firms.orderBy("id").collect()])
    want = {(q, int(i)) for q, v, *_ in asked for i in np.argsort(-(x @ np.array(v)) / np.linalg.norm(x, axis=1))[:3]}
    assert got == want


def test_upsert_reads_its_tables_once(spark, sf):
    """Children are merged by one grouping without a join, lists are sorted without a comparator in an expression, and the
    result of the upsert does not work out the firms again."""
    old = spark.createDataFrame([(1, 1, "Ann", ""), (1, 2, "Bo", "GP")], "firm_id long, seq long, name string, role string")
    new = spark.createDataFrame([(1, 1, "ANN", "Partner"), (1, 2, "Cy", None)], "firm_id long, seq long, name string, role string")
    both = entities.merge_children(old, new, "name", ("role",))
    assert sorted(map(tuple, both.collect())) == [(1, "Ann", "Partner", False, 1), (1, "Bo", "GP", False, 2), (1, "Cy", None, True, 2)]
    assert "Join" not in both._jdf.queryExecution().executedPlan().toString()
    plan = catalog.firm_upsert(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "array_sort" not in plan


def test_tables_in_buckets_meet_without_a_shuffle(spark):
    """Children and their lists need no shuffle where both sides lie in buckets of their firm; no name stays in the catalogue."""
    held = shared.bucketed(spark.range(500).select((F.col("id") % 50).alias("c"), F.col("id").alias("seq"), F.concat(F.lit("n"), F.col("id") % 7).alias("name"), F.lit("").alias("role")), "c").withColumnRenamed("c", "firm_id")
    firms = shared.bucketed(spark.range(60).select("id", F.lit("x").alias("t")), "id")
    new = firms.where("id % 2 = 0").select("id", F.posexplode(F.array(F.lit("N1"), F.lit("z"))).alias("seq", "name")).select(F.col("id").alias("firm_id"), F.col("seq").cast("long").alias("seq"), "name", F.lit("GP").alias("role"))
    both = entities.merge_children(held, new, "name", ("role",))
    lists = firms.join(both.groupBy(F.col("firm_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("is_new", "at", "name", "role"))).alias("x")), "id", "left")
    assert "Exchange hash" not in both._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.x for r in lists.select("id", F.expr("transform(x, c -> concat_ws('/', c.name, coalesce(c.role, '-')))").alias("x")).collect()}
    for i in range(60):
        names = list(dict.fromkeys(f"n{k % 7}" for k in range(i, 500, 50))) if i < 50 else []
        want = [f"{n}/{'GP' if n == 'n1' and i % 2 == 0 else '-'}" for n in names]
        want += [f"{n}/GP" for n in ("N1", "z") if i % 2 == 0 and n.lower() not in names]
        assert (got[i] or []) == want
    assert spark.sql("SHOW TABLES").where("tableName LIKE 'firmlake_%'").count() == 0


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    files = lambda: {str(f) for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in str(f)}
    before = files()
    out = shared.durable(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert sorted(map(tuple, out.collect())) == [(k, sum(range(k, 1000, 7))) for k in range(7)]


def test_stored_items_are_the_items(spark, sf):
    """What firms and their children are read from holds all lines, and gives the same firms, partners and companies."""
    items = tables.stored_items(spark, sf, few=0)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(items) == rows(tables.stored_items(spark, sf)) == rows(tables.narrow_items(spark, sf).select(*items.columns))
    for made in (lambda *x: tables.firms(spark, sf, False, *x), lambda *x: tables.partners(spark, sf, *x), lambda *x: tables.portfolio(spark, sf, *x)):
        assert rows(made(items)) == rows(made())
        plan = made(items)._jdf.queryExecution().executedPlan().toString()
        assert "l_orderkey" not in plan and "hashpartitioning(o_custkey" not in plan


@pytest.mark.parametrize("mode", ["filter", "boost"])
def test_copies_meet_once_in_search(spark, mode):
    """Firms name their vector; equal vectors, firms of equal asked facets and equal queries are compared once, and every
    firm and query has its result. No vector lies in the table of firms."""
    rng = np.random.default_rng(9)
    base = [rng.normal(size=8).tolist() for _ in range(12)]
    store = [(k, base[k % 12]) for k in range(36)] + [(36, None), (37, [0.0] * 8)]
    rows = [(i, f"f{i}", i * 7 % 39, [("A", "B", "C")[i % 3], f"x{i}"], None if i % 5 == 0 else ["s"], ["g"] if i % 2 else []) for i in range(700)]
    asked = [(q, base[q % 4], (None, "A")[q % 2], (None, "s")[q // 4 % 2], "g" if q % 8 == 5 else None) for q in range(48)]
    vectors = spark.createDataFrame(store, "vec_id long, embedding array<double>")
    firms = spark.createDataFrame(rows, "id long, firm_name string, vec_id long, focus_sectors array<string>, investment_stage array<string>, geography array<string>")
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<double>, sector string, stage string, geography string")
    classes = search._classes(search._asked_only(firms.drop("firm_name"), queries.withColumnsRenamed({"sector": "q_sector", "stage": "q_stage", "geography": "q_geography"})), 7)
    assert max(len(r.ids) for r in classes.collect()) <= 7 and classes.count() < 400
    held, of, want = dict(store), {}, {}
    for q, v, *facets in asked:
        scored = []
        for i, name, k, *lists in rows:
            x = held.get(k)
            has = [f is not None and f in (values or []) for f, values in zip(facets, lists)]
            if x is None or not any(x) or mode == "filter" and not all(h or f is None for h, f in zip(has, facets)):
                continue
            if (k % 12, q % 4) not in of:
                a, b = np.array(x), np.array(v)
                of[k % 12, q % 4] = 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)
            d = of[k % 12, q % 4]
            score = round(1 - d + sum(b * h for b, h in zip(search.BOOSTS, has)), 4)
            scored.append((d, i, score, name) if mode == "filter" else (-score, d, i, name))
        cut = [(-s, d, i, n) for d, i, s, n in sorted(scored)[:7]] if mode == "filter" else sorted(scored)[:7]
        want |= {(q, i): (k + 1, -s, n) for k, (s, d, i, n) in enumerate(sorted(cut))}
    for block in (8192, 20):
        out = search.search(firms, queries, 7, mode, block, 8, vectors)
        assert "embedding" not in out.columns
        assert {(r.query_id, r.id): (r["rank"], r.hybrid_score, r.firm_name) for r in out.collect()} == want
