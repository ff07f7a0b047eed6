"""Queries over stored tables and files: what is written by Spark from the tables of a folder, and read back with its reader.

Most have their DuckDB twin beside them. The tables are written in the shared folder and go when the query's own table stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.functions.arrays import keyed_distinct, profile_text, resolver_text, text_key
from firmlake.functions.names import resolver_name
from firmlake.operators import discovery, entities, ledgers, pages
from firmlake.plans import catalog, oracle
from firmlake.sources import snapshots
from firmlake.sources import tables as t
from firmlake.sources.shared import place, tidy

Query = Callable[[SparkSession, str], DataFrame]


def _scan(name: str, view: Callable[[SparkSession, str], DataFrame], *columns: str) -> Query:
    """Writes a view as a stored table, and reads it back with the table's own schema."""
    @tidy
    def run(s: SparkSession, d: str) -> DataFrame:
        path = place(s)
        t.write_new(t.conformed(view(s, d), name), path)
        out = t.read_table(s, name, path)
        kind = {f.name: f.dataType.typeName() for f in out.schema.fields}
        shown = {"array": lambda c: F.array_join(c, "|"), "timestamp": lambda c: F.col(c).cast("timestamp_ntz")}
        return out.select(*[shown.get(kind[c], F.col)(c).alias(c) for c in columns])

    return run


def _crawled(s: SparkSession, d: str) -> DataFrame:
    return catalog._crawled(s, d).withColumns({"crawl_status": F.lit("completed"), "markdown_saved": F.col("url") % 2 == 0})


@tidy
def log_scan(s, d):
    """The log written as one file for each level, and read back by bytes."""
    path = place(s)
    lines = t.log_lines(s, d).withColumn("level", F.lower(F.split("value", " ")[0]))
    lines.repartition("level").sortWithinPartitions("level", "line_no").select("level", "value").write.partitionBy("level").text(path)
    parts = [t.read_log(s, f"{path}/level={v}").select(F.lit(v).alias("level"), "line_no", "value") for v in ("error", "warn", "info")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@tidy
def ledger_in_buckets(s, d):
    """A failure ledger in hash buckets: failures before the cut-off, then an upsert of failures and of what resolves them."""
    e = t.table(s, d, "events").where("event_type in ('error', 'purchase')")
    e = e.select(F.col("user_id").alias("url"), F.col("value").cast("string").alias("error_message"), "ts", F.when(F.col("event_type") == "error", "failed").otherwise("resolved").alias("kind"))
    none = s.createDataFrame([], f"url {e.schema['url'].dataType.simpleString()}, error_message string, retry_count long, last_attempt {e.schema['ts'].dataType.simpleString()}, status string")
    path, cut = place(s), F.lit(catalog.CUTOFF).cast("timestamp")
    snapshots.create(ledgers.apply_failure_events(none, e.where(F.col("ts") < cut)), path, ["url"])
    snapshots.upsert(path, e.where(F.col("ts") >= cut), ledgers.apply_failure_events, "events", 1)
    snapshots.upsert(path, e, ledgers.apply_failure_events, "events", 1)  # a replay changes nothing
    return snapshots.read(s, path)


@tidy
def raw_page_sink(s, d):
    path = place(s)
    found = t.table(s, d, "pages").select("url", F.col("html").alias("markdown"))
    t.write_raw_pages(found, path, F.lit("2024-02-01T00:00:00Z"))
    out = s.read.parquet(path)
    return out.select("stem", "url", F.sha2("markdown", 256).alias("markdown_sha256"), "ingestion_source", "content_type", "markdown_length", "collected_at")


@tidy
def record_sink(s, d):
    """Records written by domain, with lines that are no records, and read back: good ones and rejects."""
    path = place(s)
    k = F.col("c_custkey")
    rec = t.table(s, d, "customer").select(
        F.col("c_name").alias("firm_name"), F.lit("").alias("website"), F.concat(F.lit("https://site"), (k % 7).cast("string"), F.lit(".com/"), k.cast("string")).alias("source_url"),
        F.array(F.lit("SaaS"), F.col("c_mktsegment")).alias("focus_sectors"), F.array(F.struct(F.concat(F.lit("Ann "), k.cast("string")).alias("name"), F.lit("GP").alias("role"))).alias("partners"),
    )
    t.write_records(rec, f"{path}/good")
    bad = F.when(k % 3 == 0, F.concat(F.lit('{"firm_name": "cut '), k.cast("string"))).when(k % 3 == 1, F.lit('{"focus_sectors": "text"}')).otherwise("[1, 2]")
    t.table(s, d, "customer").where("c_custkey % 10 = 0").select(bad).write.text(f"{path}/bad")
    good, none = t.read_records(s, f"{path}/good/*")
    some, rejects = t.read_records(s, f"{path}/bad")
    shown = good.unionByName(some).select("source_url", F.lit("ok").alias("reason"), F.array_join("focus_sectors", "|").alias("sectors"), F.get("partners", F.lit(0))["name"].alias("partner"))
    lost = rejects.unionByName(none).select(F.lit(None).cast("string").alias("source_url"), "reason", F.lit(None).cast("string").alias("sectors"), F.col("value").alias("partner"))
    return shown.unionByName(lost)


def recrawl_due(s, d):
    """Views whose user bought nothing in the two days before."""
    e = t.table(s, d, "events")
    hits = e.where("event_type = 'view'").select("event_id", F.col("user_id").alias("url"), "ts")
    return ledgers.hits_due(hits, e.where("event_type = 'purchase'").select(F.col("user_id").alias("url"), "ts"), 2).select("event_id", "url")


def embedding_profiles(s, d):
    return t.firms(s, d, False).select("id", profile_text().alias("profile"), resolver_text().alias("resolver"))


def resolver_names(s, d):
    return catalog.name_cases(s, d).select("id", resolver_name(F.col("name")).alias("resolver_name"))


def keyed_last(s, d):
    """The last value of each name, at its first place."""
    k = F.col("c_custkey")
    item = lambda name, sector: F.struct(F.lit(name).alias("n"), sector.cast("string").alias("v"))
    items = F.array(item("Acme", k), item("Bolt", k + 1), item(" acme ", k + 2), item("Crux", k + 3), item("BOLT", k + 4))
    kept = keyed_distinct(items, lambda x: text_key(x.n), "last")
    return t.table(s, d, "customer").select(k.alias("id"), F.array_join(F.transform(kept, lambda x: F.concat(F.trim(x.n), F.lit(":"), x.v)), "|").alias("kept"))


def sorted_queries(s, d):
    """All discovery queries in order, with the number of documents that speak of the first word."""
    return discovery.in_order(catalog.query_universe(s, d)).join(catalog.query_universe(s, d), "query").select("position", "query", "documents")


def query_cap(s, d):
    return discovery.in_order(catalog.query_universe(s, d), 25)


def facet_queries_fallback(s, d):
    """A facet that no query holds: all queries stay, here with each region."""
    places = t.table(s, d, "region").select(F.col("r_regionkey").alias("place"))
    return discovery.facet_queries(discovery.query_universe(s), "no such facet").crossJoin(F.broadcast(places.limit(5)))


def entity_batches(s, d):
    """The entity of every firm, resolved in two batches of which the second one meets the first."""
    f = t.resolution_firms(s, d)
    none = s.createDataFrame([], f"id {f.schema['id'].dataType.simpleString()}, entity_id {f.schema['id'].dataType.simpleString()}")
    old, new = f.where("id % 3 <> 0"), f.where("id % 3 = 0")
    labels, _ = entities.resolve_batch(f.limit(0), none, old)
    return entities.resolve_batch(old, labels, new)[0]


QUERIES: dict[str, Query] = {
    "firm_scan": _scan("firms", lambda s, d: t.firms(s, d, False), "id", "firm_name", "website", "focus_sectors", "investment_stage", "geography", "updated_at"),
    "partner_scan": _scan("partners", t.partners, "id", "firm_id", "name", "role", "linkedin_url", "twitter_url"),
    "company_scan": _scan("portfolio", t.portfolio, "id", "firm_id", "company_name", "sector"),
    "crawl_ledger_scan": _scan("crawled_urls", _crawled, "url", "discovered_query", "crawl_status", "markdown_saved", "updated_at"),
    "queue_scan": _scan("crawl_queue", t.queue, "url", "priority_score", "discovered_at", "status", "last_crawled"),
    "failure_scan": _scan("failed_urls", t.failures, "url", "error_message", "retry_count", "last_attempt", "status"),
    "log_scan": log_scan, "ledger_in_buckets": ledger_in_buckets, "raw_page_sink": raw_page_sink, "record_sink": record_sink, "recrawl_due": recrawl_due,
    "embedding_profiles": embedding_profiles, "resolver_names": resolver_names, "keyed_last": keyed_last, "sorted_queries": sorted_queries, "query_cap": query_cap,
    "facet_queries_fallback": facet_queries_fallback, "entity_batches": entity_batches,
}

_J = "coalesce(array_to_string({0}, '|'), '') {0}"
_REPLACED = "lower(\"name\")"
for _word in ("capital", "ventures", "venture partners", "partners", "vc", ",", "."):
    _REPLACED = f"replace({_REPLACED}, '{_word}', '')"
_IGNORED, _BLOCKS = ("|".join(sorted(tags)) for tags in (pages.IGNORED_TAGS, pages.BLOCK_TAGS))
_PLAIN = "token"
for _name, _sign in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">")):
    _PLAIN = f"replace({_PLAIN}, '&{_name};', '{_sign}')"
_PLAIN = f"regexp_replace({_PLAIN}, '&amp;?', '&', 'g')"
# the answers of catalog._responses, and the object in each
_ANSWERS = r"""b AS (SELECT c_custkey k, replace('{"firm_name": ' || CASE WHEN c_custkey % 3 = 0 THEN '["", "NAME"]' ELSE '"NAME "' END || ', "website": "https://firm.example.com/", "focus_sectors": '
      || CASE WHEN c_custkey % 2 = 0 THEN '"SaaS"' ELSE '["ai", " ai ", {"name": "b2b"}, null]' END || ', "partners": ["Ann Lee", {"name": "ann lee", "role": "GP"}, {"name": "Bo", "confidence": 0.5}], "portfolio_companies": [{"company_name": "Acme", "sector": "x"}, "acme", "Zed"]}', 'NAME', c_name) body FROM customer),
      a AS (SELECT k::VARCHAR source_url, CASE WHEN k % 7 = 0 THEN 'no answer' WHEN k % 5 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE 'Here: ' || body || ' done' END response FROM b),
      o AS (SELECT source_url, nullif(regexp_extract(response, '\{(.|\n)*\}'), '')::JSON j FROM a)"""
_SORTED_OBJECT = "CASE json_type({0}) WHEN 'OBJECT' THEN '{{' || array_to_string(list_transform(list_sort(json_keys({0})), lambda n: '\"' || n || '\":' || json_extract({0}, '$.' || n)::VARCHAR), ',') || '}}' ELSE coalesce({0}::VARCHAR, 'null') END"


def _listed(column: str, text: str, rest: str = "") -> str:
    """The elements of a list of each answer by lower-case text, the first one of each: text and ``rest``, in order."""
    return f"""(SELECT source_url, string_agg(s, '|' ORDER BY i) {column} FROM (SELECT source_url, min(i) i, arg_min({text}{rest}, i) s FROM
      (SELECT source_url, unnest(CASE json_type(j->'{column}') WHEN 'ARRAY' THEN json_extract(j, '$.{column}[*]') ELSE [j->'{column}'] END) x, generate_subscripts(CASE json_type(j->'{column}') WHEN 'ARRAY' THEN json_extract(j, '$.{column}[*]') ELSE [j->'{column}'] END, 1) i FROM o WHERE j IS NOT NULL)
      WHERE trim(coalesce({text}, '')) <> '' GROUP BY source_url, lower(trim({text}))) GROUP BY 1)"""


_TEXT = "trim(CASE json_type(x) WHEN 'OBJECT' THEN x->>'$.{0}' ELSE x->>'$' END)"
_SORTED = "SELECT row_number() OVER (ORDER BY query) AS position, query"
ORACLE: dict[str, str] = {
    "firm_scan": f"WITH {oracle.FIRMS} SELECT id, firm_name, website, {', '.join(_J.format(c) for c in ('focus_sectors', 'investment_stage', 'geography'))}, updated_at::TIMESTAMP updated_at FROM firms",
    "partner_scan": f"""WITH {oracle.LI}, {oracle.PARTNERS} SELECT id, firm_id, "name", CASE id % 3 WHEN 0 THEN 'GP' WHEN 1 THEN '' END "role", CASE WHEN id % 2 = 0 THEN 'https://linkedin.com/in/s' || id END linkedin_url, CASE WHEN id % 5 = 0 THEN ' ' ELSE '' END twitter_url FROM partners""",
    "company_scan": f"WITH {oracle.LI}, {oracle.PORTFOLIO} SELECT id, firm_id, company_name, sector FROM portfolio",
    "crawl_ledger_scan": f"WITH {oracle.CRAWLED} SELECT url::VARCHAR url, discovered_query, 'completed' crawl_status, url % 2 = 0 markdown_saved, updated_at FROM crawled",
    "queue_scan": f"WITH {oracle.QUEUE} SELECT url::VARCHAR url, priority_score, discovered_at, status, NULL::TIMESTAMP last_crawled FROM queue",
    "failure_scan": f"WITH {oracle.FAILURES} SELECT url::VARCHAR url, error_message::VARCHAR error_message, retry_count::INTEGER retry_count, last_attempt, status FROM failures",
    "log_scan": f"""WITH {oracle.LOG}, l AS (SELECT *, lower(split_part("value", ' ', 1)) "level" FROM logl) SELECT "level", row_number() OVER (PARTITION BY "level" ORDER BY line_no) - 1 line_no, "value" FROM l""",
    "ledger_in_buckets": """SELECT user_id url, arg_max(value, ts) FILTER (event_type = 'error')::VARCHAR error_message, count(*) FILTER (event_type = 'error') retry_count, max(ts) FILTER (event_type = 'error') last_attempt,
      CASE WHEN arg_max(event_type, (ts, event_type = 'error')) = 'error' THEN 'pending' ELSE 'resolved' END status FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 0""",
    "raw_page_sink": """SELECT substr(regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g'), 1, 120) stem, url, sha256(html) markdown_sha256, 'web_crawl' ingestion_source, 'text/markdown' content_type, length(html)::BIGINT markdown_length, '2024-02-01T00:00:00Z' collected_at
      FROM pages WHERE trim(url) <> ''""",
    "record_sink": """SELECT 'https://site' || c_custkey % 7 || '.com/' || c_custkey source_url, 'ok' reason, 'SaaS|' || c_mktsegment sectors, 'Ann ' || c_custkey partner FROM customer
      UNION ALL SELECT NULL, CASE c_custkey % 3 WHEN 0 THEN 'not_json' ELSE 'not_a_record' END, NULL, CASE c_custkey % 3 WHEN 0 THEN '{"firm_name": "cut ' || c_custkey WHEN 1 THEN '{"focus_sectors": "text"}' ELSE '[1, 2]' END FROM customer WHERE c_custkey % 10 = 0""",
    "recrawl_due": """SELECT event_id, user_id url FROM events h WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'purchase' AND c.user_id = h.user_id AND c.ts <= h.ts AND c.ts > h.ts - INTERVAL 2 DAY)""",
    "embedding_profiles": f"""WITH {oracle.FIRMS}, p AS (SELECT id, firm_name, website, coalesce(array_to_string(focus_sectors, ' '), '') || ' ' || coalesce(array_to_string(investment_stage, ' '), '') t, array_to_string(geography, ' ') g FROM firms)
      SELECT id, firm_name || ' ' || t || ' ' || g "profile", firm_name || ' ' || website || ' ' || t resolver FROM p""",
    "resolver_names": f"WITH {oracle.NAME_CASES} SELECT id, trim(replace({_REPLACED}, '-', ' ')) resolver_name FROM name_cases",
    "keyed_last": "SELECT c_custkey id, 'acme:' || c_custkey + 2 || '|BOLT:' || c_custkey + 4 || '|Crux:' || c_custkey + 3 kept FROM customer",
    "sorted_queries": f"WITH q AS ({oracle.ORACLE['query_universe']}) {_SORTED}, documents FROM q",
    "query_cap": f"WITH {oracle.UNIVERSE} SELECT * FROM ({_SORTED} FROM universe) WHERE position <= 25",
    "facet_queries_fallback": f"WITH {oracle.UNIVERSE} SELECT query, r_regionkey place FROM universe, region",
    "html_text": rf"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '<!>', 'gs'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', '<\1></\1>', 'g') h FROM pages),
      m AS (SELECT page_id, string_split_regex(h, '(?i)</?(?:{_IGNORED})(?:\s[^>]*)?>') parts, list_concat([''], regexp_extract_all(h, '(?i)</?(?:{_IGNORED})(?:\s[^>]*)?>')) marks FROM c),
      p AS (SELECT page_id, unnest(parts) part, unnest(marks) mark, generate_subscripts(parts, 1) i FROM m),
      k AS (SELECT page_id, i, starts_with(mark, '<') AND NOT starts_with(mark, '</') hidden, regexp_extract_all(part, '<[^>]*>|[^<]+') tokens FROM p),
      t AS (SELECT page_id, i, hidden, unnest(tokens) token, generate_subscripts(tokens, 1) j FROM k),
      x AS (SELECT page_id, i, j, CASE WHEN starts_with(token, '<') THEN CASE WHEN regexp_matches(token, '(?i)^</(?:{_BLOCKS})\s*>$|^<(?:{_BLOCKS})[^>]*/>$') THEN chr(10) ELSE '' END WHEN hidden THEN ''
        ELSE regexp_replace({_PLAIN}, '^\s+|\s+$', '', 'g') END s, starts_with(token, '<') tag FROM t),
      w AS (SELECT page_id, regexp_replace(string_agg(CASE WHEN tag OR s = '' THEN s ELSE s || ' ' END, '' ORDER BY i, j), '\n\n\n+', chr(10) || chr(10), 'g') "text" FROM x GROUP BY 1)
      SELECT page_id, length("text") n, sha256("text") text_sha256 FROM w""",
    "json_extract": f"""WITH {_ANSWERS} SELECT source_url, CASE WHEN j IS NOT NULL THEN '{{' || array_to_string(list_transform(list_sort(json_keys(j)), lambda key: '"' || key || '":' ||
      CASE json_type(json_extract(j, '$.' || key)) WHEN 'ARRAY' THEN '[' || array_to_string(list_transform(json_extract(j, '$.' || key)::JSON[], lambda x: {_SORTED_OBJECT.format('x')}), ',') || ']' ELSE json_extract(j, '$.' || key)::VARCHAR END), ',') || '}}' END json FROM o""",
    "normalise_records": f"""WITH {_ANSWERS}, n AS (SELECT source_url, trim(CASE json_type(j->'firm_name') WHEN 'ARRAY' THEN list_filter(json_extract_string(j, '$.firm_name[*]'), lambda v: trim(v) <> '')[1] ELSE j->>'$.firm_name' END) firm_name, j->>'$.website' website FROM o WHERE j IS NOT NULL),
      s AS {_listed('focus_sectors', _TEXT.format('name'))}, p AS {_listed('partners', _TEXT.format('name'), " || '/' || coalesce(x->>'$.role', '') || '/' || coalesce(x->>'$.confidence', '0.85')")},
      c AS {_listed('portfolio_companies', _TEXT.format('company_name'), " || '/' || coalesce(x->>'$.sector', '')")}
      SELECT n.source_url, firm_name, website, focus_sectors sectors, partners, portfolio_companies companies FROM n LEFT JOIN s USING (source_url) LEFT JOIN p USING (source_url) LEFT JOIN c USING (source_url)""",
    "entity_components": """WITH RECURSIVE k AS (SELECT c_custkey id, lower(c_name) n, c_custkey % 100 site FROM customer),
      e AS (SELECT id a, min(id) OVER (PARTITION BY n) b FROM k UNION SELECT id, min(id) OVER (PARTITION BY site) FROM k), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      r AS (SELECT id, id entity FROM k UNION SELECT both_ways.b, r.entity FROM r JOIN both_ways ON r.id = both_ways.a) SELECT id, min(entity) entity_id FROM r GROUP BY 1""",
}
