"""Readers and writers of stored tables and files, and rules that only they meet."""

import json

import pytest
from pyspark.sql import functions as F

from firmlake.functions.urls import joined_url
from firmlake.operators import entities, pages, search
from tests.plain_html import html_to_text
from firmlake.sources import tables


@pytest.mark.parametrize("name", sorted(tables.SCHEMAS))
def test_written_tables_are_read_with_their_schema(spark, tmp_path, name):
    path = str(tmp_path / name)
    empty = spark.createDataFrame([], tables.SCHEMAS[name])
    tables.write_new(empty, path)
    assert tables.read_table(spark, name, path).schema == tables.SCHEMAS[name]
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_new(empty, path)


def test_records_by_domain(spark, tmp_path):
    df = spark.createDataFrame([("a.com", 1), ("b.com", 2), ("a.com", 3)], "domain string, n int")
    tables.write_new(df, str(tmp_path / "records"), ("domain",), "json")
    assert sorted(p.name for p in (tmp_path / "records").iterdir() if p.is_dir()) == ["domain=a.com", "domain=b.com"]
    assert spark.read.json(str(tmp_path / "records")).where("domain = 'a.com'").count() == 2


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "www.a.com_team.md").write_text("# Team\nAnn")
    (tmp_path / "b.md").write_text("x")
    (tmp_path / "www.a.com_team.json").write_text(json.dumps({"url": "https://www.a.com/team", "markdown_length": 9}))
    (tmp_path / "c.json").write_text("{broken")
    md = tables.read_markdown(spark, str(tmp_path))
    assert {(r.stem, r.markdown) for r in md.collect()} == {("www.a.com_team", "# Team\nAnn"), ("b", "x")}
    side = tables.read_sidecars(spark, str(tmp_path))
    assert {(r.stem, r.url, r.valid) for r in side.collect()} == {("www.a.com_team", "https://www.a.com/team", True), ("c", None, False)}
    known = {r.stem: (r.url, r.url_reconstructed) for r in pages.with_source_urls(md, side).collect()}
    assert known == {"www.a.com_team": ("https://www.a.com/team", False), "b": ("https://b", True)}
    assert {r.file_name for r in tables.read_responses(spark, str(tmp_path)).collect()} == {"www.a.com_team.json", "c.json"}


def test_log_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "x.log").write_text("one\n\nthree\nfour\n")
    got = sorted((r.line_no, r.value) for r in tables.read_log(spark, str(tmp_path / "x.log")).collect())
    assert [v for _, v in got] == ["one", "three", "four"]


@pytest.mark.parametrize("base, link, want", [
    ("https://a.com/x/y", "../team", "https://a.com/team"), ("https://a.com/x/y/z", "../../q", "https://a.com/q"), ("https://a.com", "../../q", "https://a.com/q"),
    ("https://a.com/x/", "./q", "https://a.com/x/q"), ("https://a.com/x/", "/b/../c", "https://a.com/c"), ("https://a.com/x/y", "..", "https://a.com/"), ("https://a.com/x/y", "q..z", "https://a.com/x/q..z"),
])
def test_dots_in_links(spark, base, link, want):
    df = spark.createDataFrame([(base, link)], "b string, l string")
    assert df.select(joined_url(F.col("b"), F.col("l")).alias("x")).first().x == want


def test_any_closing_tag_shows_text_again():
    assert html_to_text("<nav>a<footer>b</nav>c</footer>d<p>e</p>") == "c d e \n"
    assert html_to_text("<p>x<br/>y &amp; z") == "x \ny & z " and html_to_text("") == ""


def test_first_of_several_children_counts(spark):
    schema = "firm_id int, seq int, name string, role string"
    old = spark.createDataFrame([(1, 1, "Bo", ""), (1, 2, "bo", "GP")], schema)
    new = spark.createDataFrame([(1, 1, "Ann", "Analyst"), (1, 2, "ann", "Partner"), (1, 3, "BO", "x"), (2, 1, "Cy", None), (2, 2, "CY ", "LP"), (2, 3, " ", "z")], schema)
    for n in (1, 5):
        got = sorted((r.firm_id, r.name, r.role) for r in entities.merge_children(old.repartition(n), new.repartition(n), "name", ("role",)).collect())
        assert got == [(1, "Ann", "Analyst"), (1, "Bo", "GP"), (2, "Cy", "LP")]


def test_last_of_several_records_counts(spark):
    schema = "id int, seq int, firm_name string, website string, source_url string, focus_sectors array<string>, investment_stage array<string>, geography array<string>"
    rows = [(1, 2, "Last", "", "s2", ["b"], [], []), (1, 1, "Zz first", "w", "s1", ["c"], [], [])]
    new = spark.createDataFrame(rows, schema)
    old = new.limit(0).drop("seq").withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    r = entities.merge_firms(old, new, F.lit("2025-01-01").cast("timestamp")).first()
    assert (r.firm_name, r.source_url, r.focus_sectors) == ("Last", "s2", ["b"])


def test_search_in_blocks_of_queries(spark):
    rows = [(i, [float((i * k) % 7 - 3) for k in range(1, 6)], [("A", "B")[i % 2]], ["s"], ["g"]) for i in range(60)]
    rows += [(90, None, [], [], []), (91, [0.0] * 5, ["A"], [], []), (92, [1.0, 2.0], ["A"], [], []), (93, [float("nan")] * 5, ["A"], [], [])]
    firms = spark.createDataFrame(rows, "id int, embedding array<float>, focus_sectors array<string>, investment_stage array<string>, geography array<string>")
    asked = spark.createDataFrame([(q, [1.0, float(q), 2.0, -1.0, 0.5], "A" if q % 3 else None) for q in range(9)] + [(9, None, "A")], "query_id int, query_vector array<double>, sector string")
    for mode in ("filter", "boost"):
        want = sorted(map(tuple, search.search(firms.coalesce(1), asked, 4, mode).select("query_id", "id", "rank", "hybrid_score").collect()))
        got = sorted(map(tuple, search.search(firms.repartition(7), asked, 4, mode, block=2).select("query_id", "id", "rank", "hybrid_score").collect()))
        assert got == want and len(want) == 36
    assert all(r.focus_sectors == ["A"] for r in search.search(firms, asked.where("sector = 'A'"), 5).collect())


def test_facets_in_blocks_of_profiles(spark):
    rows = [(i, [("A b", "B"), ("b",), ()][i % 3], ["s", "t"][: i % 2 + 1], ["g"]) for i in range(24)]
    firms = spark.createDataFrame(rows, "id int, focus_sectors array<string>, investment_stage array<string>, geography array<string>")
    asked = spark.createDataFrame([(k, ("B", "b", "", "A b", None)[k % 5], ("s", "t")[k % 2], "g") for k in range(10)], "profile_id int, sector string, stage string, geography string")
    for job in (lambda b: search.rank_firms(firms, asked, 5, b).select("profile_id", "id", "score", "rank"), lambda b: search.match_firms(firms, asked, block=b).select("profile_id", "id")):
        assert sorted(map(tuple, job(2).collect())) == sorted(map(tuple, job(1_000).collect())) != []
    exact = {(r.profile_id, r.id) for r in search.match_firms(firms, asked, True).collect()}
    assert exact == {(p, i) for p, s, st, g in asked.collect() for i, fs, sts, gs in rows if s in fs and st in sts and g in gs}
