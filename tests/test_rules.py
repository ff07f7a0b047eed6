"""Hand-worked cases of the rules that SQL twins do not reach."""

import pytest
from pyspark.sql import functions as F

from firmlake.functions.names import firm_key, firm_name, matches_source, resolved_website, resolver_name
from firmlake.functions.urls import canonical_url, is_firm_site, is_profile_url, raw_base, url_reject_reason
from firmlake.operators import entities, listing, logs, pages, records, validation
from firmlake.streaming import jobs
from tests.plain_html import html_to_text


def one(spark, column, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))]) if all(v is not None for v in values) else spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize("url, want", [
    (None, ""), ("  ", ""), ("Example.com/A/", "https://example.com/A"), ("http://www.www.a.com//", "https://www.a.com"), ("https://u:p@H.com:80/x;p?q=1#f", "https://u:p@h.com:80/x?q=1"),
])
def test_canonical(spark, url, want):
    assert one(spark, canonical_url, url) == want


@pytest.mark.parametrize("url, want", [
    ("", "blank"), ("ftp://a.com", "scheme"), ("https://netflix.com", "blocked_domain"), ("https://a.com/feedback", "blocked_path"), ("https://a.com/x.PDF", "blocked_type"), ("https://a.vc/x", "ok"),
])
def test_reject(spark, url, want):
    assert one(spark, url_reject_reason, url) == want


def test_suffix_mode(spark):
    assert one(spark, lambda c: url_reject_reason(c, mode="suffix"), "https://netflix.com") == "ok"
    assert one(spark, lambda c: url_reject_reason(c, mode="suffix"), "https://m.x.com") == "blocked_domain"


def test_sites(spark):
    assert one(spark, is_profile_url, "https://a.com/x/y/z/team") and not one(spark, is_profile_url, "https://a.com/x/y/z/q")
    assert one(spark, is_firm_site, "a.com") and not one(spark, is_firm_site, "http://localhost")
    assert one(spark, raw_base, " HTTP://Www.A.com/x ") == "http://www.a.com" and one(spark, raw_base, "a.com") == ""


@pytest.mark.parametrize("name, clean, key", [
    ("Capital Group", "Capital Group", ""), ("Foo L.L.C.", "Foo L.L.C", "foo l.l.c"), ("Foo - Team page", "Foo", "foo"), ("  'A  B' ", "A B", "a b"), ("Ünï Ventures", "Ünï Ventures", "n"), ("x" * 130, "x" * 120, "x" * 120),
])
def test_names(spark, name, clean, key):
    assert one(spark, firm_name, name) == clean and one(spark, firm_key, name) == key


def test_source_match(spark):
    assert not one(spark, matches_source, "X Capital", "https://a.com", "")
    assert not one(spark, matches_source, "Acme", "https://other.com/posts/1", "")
    assert one(spark, matches_source, "Acme Ventures", "https://acme.com/posts/1", "")
    assert one(spark, resolved_website, "https://x.com", "http://www.acme.com/team") == "https://acme.com"
    assert one(spark, resolver_name, "Foo-Bar Capital, V.C.") == "foo bar  vc"


def test_html(spark):
    html = "<head><title>no</title></head><p>a</p><nav>x<script>y</script>z</nav><div>b<b>c</b></div>"
    assert html_to_text(html) == one(spark, pages.html_text, html) == "a \nz b c \n"
    assert html_to_text(None) == one(spark, pages.html_text, None) == ""


def test_context_slice(spark):
    text = "h" * 3000 + "\n## Team\n" + "t" * 9000
    got = one(spark, pages.context_slice, text)
    assert got.startswith("h" * 2000 + "\n\n...[content skipped]...\n\n") and "## Team" in got
    assert one(spark, pages.context_slice, "a" * 9000) == "a" * 8000 and one(spark, pages.context_slice, "ab") == "ab"


def test_indel(spark):
    assert one(spark, entities.indel_ratio, "acme", "acne") == pytest.approx(0.75)
    assert one(spark, entities.indel_ratio, "", "a") == 0.0


def test_normalise(spark):
    rows = [("a", '```json\n{"firm_name": ["", " Acme "], "focus_sectors": "AI", "partners": [{"name": "Ann", "confidence": 0.4}, "ann", null], "portfolio_companies": ["Z", {"company_name": "z"}]}\n```'), ("b", "none"), ("c", None)]
    good, bad = records.normalise_records(spark.createDataFrame(rows, "source_url string, response string"))
    r = good.first()
    assert (r.firm_name, r.focus_sectors, [(p["name"], p.confidence) for p in r.partners], [c.company_name for c in r.portfolio_companies]) == ("Acme", ["AI"], [("Ann", 0.4)], ["Z"])
    assert sorted(x.source_url for x in bad.collect()) == ["b", "c"]


def test_validation_reasons(spark):
    schema = "firm_name string, website string, source_url string, focus_sectors array<string>, investment_stage array<string>, geography array<string>, portfolio_companies array<struct<company_name string, sector string>>"
    rows = [(n, "", u, [" a ", "a", None], None, [], [("Z", "1"), ("z", "2")]) for n, u in ((None, "https://a.com"), ("Top 10 funds", "https://a.com"), ("Acme", "https://x.com/a"), ("Acme", "https://b.com/posts/1"), ("Acme", "https://acme.com"))]
    good, bad = validation.validate_records(spark.createDataFrame(rows, schema))
    assert sorted(r.reason for r in bad.collect()) == ["firm_domain_mismatch", "missing_firm_name", "rejected_firm_name", "rejected_source_url"]
    r = good.first()
    assert r.focus_sectors == ["a"] and [(c.company_name, c.sector) for c in r.portfolio_companies] == [("z", "2")] and r.website == "https://acme.com"


def test_merge_with_itself_changes_nothing(spark):
    rows = [(1, "A", "", "s", ["x"], [], ["g"], None, None)]
    df = spark.createDataFrame(rows, "id long, firm_name string, website string, source_url string, focus_sectors array<string>, investment_stage array<string>, geography array<string>, created_at timestamp, updated_at timestamp")
    out = entities.merge_firms(df, df.withColumn("seq", F.lit(1)), F.lit("2025-01-01").cast("timestamp")).first()
    assert (out.firm_name, out.website, out.source_url, out.focus_sectors, out.geography) == ("A", "", "s", ["x"], ["g"])


def test_components(spark):
    nodes = spark.range(10).select(F.col("id"))
    edges = spark.createDataFrame([(9, 7), (7, 5), (5, 3), (2, 1)], "a long, b long")
    got = {r.id: r.entity_id for r in entities.entity_components(nodes, edges).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 6, 7: 3, 8: 8, 9: 3}


def test_pages_and_logs(spark):
    df = spark.range(31)
    assert listing.page_count(df).first().pages == 3 and listing.paginate(df.orderBy("id"), 3).count() == 1
    lines = spark.createDataFrame([(1, "Failed x"), (2, "WARN y"), (3, "Saved markdown: z")], "line_no long, value string")
    assert {r.level: r.n for r in logs.level_counts(lines).collect()} == {"error": 1, "warn": 1, "info": 1} and logs.count_lines(lines).first().n == 1


def test_streams_match_batch(spark, tmp_path):
    rows = [(f"u{i % 3}", f"e{i}", f"2024-01-01 00:00:{i:02d}") for i in range(9)]
    df = spark.createDataFrame(rows, "url string, error_message string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = jobs.failure_ledger(stream).writeStream.format("memory").queryName("ledger").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("ledger").collect())) == sorted(map(tuple, jobs.failure_ledger(df).collect()))
    q = jobs.new_discoveries(stream).writeStream.format("memory").queryName("fresh").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("fresh").count() == 3
    files = spark.createDataFrame([(1, "a.md", "https://a.com/x", "deep"), (2, "b.md", "https://a.com", "home")], "seq long, file string, url string, markdown string")
    files.write.parquet(str(tmp_path / "pages"))
    out = []
    s = spark.readStream.schema(files.schema).parquet(str(tmp_path / "pages"))
    jobs.keep_bundles(s, lambda b: b, lambda b, n: out.extend(b.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.domain, r.files) for r in out] == [("a.com", ["b.md", "a.md"])]


def test_partition_invariance(spark, sf):
    from firmlake.plans import catalog

    stored = catalog._stored(spark, sf)
    want = None
    for n in (1, 3, 16):
        got = sorted(map(repr, pages.domain_bundles(stored.repartition(n)).select("domain", "files").collect()))
        want = want or got
        assert got == want


def test_keys_of_arrays_are_worked_out_once(spark):
    """An array and its keys are named once: neither is worked out again for each element."""
    from firmlake.functions.arrays import keyed_distinct, text_key

    for keep in ("first", "last"):
        plan = spark.range(1).select(keyed_distinct(F.split(F.lit("b a B").substr(F.lit(1), F.col("id").cast("int") + 9), " "), text_key, keep).alias("x"))
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("split(") == 1
        assert plan.first()[0] == (["b", "a"] if keep == "first" else ["B", "a"])
