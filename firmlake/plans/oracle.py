"""DuckDB SQL with the results that the registered queries must give, written from the rules, not from the jobs."""

from __future__ import annotations

import re

from firmlake.functions import rules

LI = """li AS (SELECT o_custkey, p_partkey, p_name, p_type, s_suppkey, s_name, o_orderpriority, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
FIRMS = LI + """, facets AS (SELECT o_custkey, list_sort(list_distinct(list(p_type))) fs, list_sort(list_distinct(list(o_orderpriority))) st, max(l_shipdate) u FROM li GROUP BY 1),
  firms AS (SELECT c_custkey id, c_name firm_name, 'https://www.firm-' || (c_custkey % 100) || '.example.com/' website, coalesce(fs, []) focus_sectors,
    coalesce(st, []) investment_stage, [n_name, r_name] geography, u updated_at, embedding FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey LEFT JOIN facets ON c_custkey = o_custkey JOIN embeddings ON vec_id = c_custkey % (SELECT count(*) FROM embeddings))"""
PARTNERS = "partners AS (SELECT DISTINCT o_custkey firm_id, s_suppkey id, s_name \"name\" FROM li)"
PORTFOLIO = "portfolio AS (SELECT DISTINCT o_custkey firm_id, p_partkey id, p_name company_name, p_type sector FROM li)"
FAILURES = "failures AS (SELECT user_id url, count(*) retry_count, arg_max(value, (ts, event_id)) error_message, max(ts) last_attempt, 'pending' status FROM events WHERE event_type = 'error' GROUP BY 1)"
QUEUE = """queue AS (SELECT user_id url, arg_max(value, (ts, event_id)) priority_score, min(ts) discovered_at,
    CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END status FROM events GROUP BY 1)"""
CRAWLED = "crawled AS (SELECT user_id url, CAST(arg_max(value, (ts, event_id)) AS VARCHAR) discovered_query, max(ts) updated_at FROM events WHERE event_type = 'view' GROUP BY 1)"
HITS = "hits AS (SELECT page_id % 7 query, page_id % 3 + 1 page, page_id \"rank\", url FROM pages)"
LOG = "logl AS (SELECT event_id line_no, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END || ' user=' || user_id \"value\" FROM events)"
HOST, PATH = r"'^https?://([^/?#]*)'", r"'^https?://[^/?#]*([^?#]*)'"


def _any(words) -> str:
    return "|".join(re.escape(w) for w in words).replace("'", "''")


def urls(source: str, name: str = "u", key: str = "url") -> str:
    """CTEs that add every URL rule to the rows of ``source``; ``key`` is the URL column."""
    return rf"""{name}0 AS (SELECT *, regexp_replace(coalesce({key}, ''), '^\s+|\s+$', '', 'g') t FROM {source}),
  {name}1 AS (SELECT *, CASE WHEN regexp_matches(t, '^https?://') THEN t ELSE 'https://' || t END f, lower(t) low FROM {name}0),
  {name}2 AS (SELECT *, regexp_replace(lower(regexp_extract(f, {HOST}, 1)), '^www\.', '') h1, regexp_replace(regexp_replace(regexp_extract(f, {PATH}, 1), ';[^/]*$', ''), '/+$', '') p1,
    regexp_extract(f, '^[^?#]*\?([^#]*)', 1) q1, regexp_replace(regexp_extract(low, {PATH}, 1), ';[^/]*$', '') lp FROM {name}1),
  {name}3 AS (SELECT *, CASE WHEN t = '' THEN '' ELSE 'https://' || h1 || p1 || CASE WHEN q1 <> '' THEN '?' || q1 ELSE '' END END canonical,
    CASE WHEN t = '' THEN '' ELSE regexp_replace(h1, '^www\.', '') END "domain", CASE WHEN t = '' OR h1 = '' THEN '' ELSE 'https://' || h1 END base FROM {name}2),
  {name}4 AS (SELECT *, CASE WHEN low = '' THEN 'blank' WHEN NOT regexp_matches(low, '^https?://') THEN 'scheme' WHEN "domain" = '' THEN 'no_domain'
    WHEN regexp_matches("domain", '{_any(rules.REJECTED_DOMAINS)}') THEN 'blocked_domain' WHEN regexp_matches(lp, '{_any(rules.REJECTED_PATHS)}') THEN 'blocked_path'
    WHEN regexp_matches(low, '({_any(rules.REJECTED_ENDINGS)})$') THEN 'blocked_type' ELSE 'ok' END reject_reason FROM {name}3),
  {name} AS (SELECT *, reject_reason = 'ok' AND (regexp_matches(lower({key}), '{_any(rules.PROFILE_SIGNALS)}') OR ends_with("domain", '.vc')
    OR length(trim(lp, '/')) - length(replace(trim(lp, '/'), '/', '')) <= 1) profile FROM {name}4)"""


URL_CASES = r"""url_cases AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN '  ' || url || '/ ' WHEN 2 THEN regexp_replace(url, '^https?://', '')
    WHEN 3 THEN regexp_extract(url, '^[^?#]*') || '/Team;p=1/x;y?Q=Z#top' WHEN 4 THEN 'https://WWW.www.netflix' || page_id || '.com:8080//a//?b=' || page_id
    WHEN 5 THEN regexp_extract(url, '^[^?#]*') || '/feedback' WHEN 6 THEN regexp_extract(url, '^[^?#]*') || '/a/b/Deck.PDF' ELSE 'http://fund' || (page_id % 3) || '.vc/x/y/z/' END url FROM pages)"""
NAME_CASES = """name_cases AS (SELECT c_custkey id, CASE c_custkey % 10 WHEN 0 THEN c_name WHEN 1 THEN c_name || ' Capital Partners LLC' WHEN 2 THEN '  "' || c_name || '   Ventures" - Team page'
    WHEN 3 THEN 'X Capital' WHEN 4 THEN 'Top 10 ' || c_name WHEN 5 THEN 'www.' || c_name || '.com' WHEN 6 THEN 'Capital Group' WHEN 7 THEN c_name || ' L.L.C.' WHEN 8 THEN repeat(c_name, 7)
    ELSE c_name || ' | News at nine' END "name" FROM customer)"""


def names(source: str, column: str = "name", out: str = "n") -> str:
    return rf"""{out}0 AS (SELECT *, substr(regexp_replace(regexp_replace(regexp_replace(coalesce("{column}", ''), '\s+', ' ', 'g'), '^[ "''.,;:-]+|[ "''.,;:-]+$', '', 'g'),
      '(?i)\s*[-–|]\s*(team|portfolio|about|investors?|partners?|news|blog).*$', ''), 1, 120) firm_name_norm FROM {source}),
  {out}1 AS (SELECT *, lower(firm_name_norm) low_name FROM {out}0),
  {out} AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(low_name, '{rules.LEGAL_WORDS}', ' ', 'g'), '[^a-z0-9\s&\-\.'']', '', 'g'), '\s+', ' ', 'g')) firm_key,
    CASE WHEN coalesce("{column}", '') = '' THEN 'missing' WHEN length(firm_name_norm) < 2 THEN 'short' WHEN list_contains({[x.lower() for x in rules.REJECTED_NAMES]}, low_name) THEN 'brand'
      WHEN regexp_matches(low_name, '{_any(rules.REJECTED_NAME_PARTS)}') THEN 'brand_part' WHEN regexp_matches(low_name, 'https?://|www\.|\.com\b|\.org\b|\.io\b') THEN 'url'
      WHEN length(firm_name_norm) > 80 THEN 'long' WHEN regexp_matches(low_name, '\b(top|best|list of|how to|what is|guide to)\b') THEN 'list_title'
      WHEN NOT regexp_matches(firm_name_norm, '[a-zA-Z]') THEN 'no_letter' ELSE 'ok' END name_reason FROM {out}1)"""


def _urls(column: str) -> str:
    return f'WITH {URL_CASES}, {urls("url_cases")} SELECT page_id, "{column}" FROM u'


def _names(column: str) -> str:
    return f"WITH {NAME_CASES}, {names('name_cases')} SELECT id, {column} FROM n"


SCORED = """q AS (SELECT vec_id query_id, embedding qv FROM embeddings WHERE vec_id % 20 = 0),
  s AS (SELECT query_id, f.*, 1 - list_cosine_similarity(f.embedding::DOUBLE[], qv::DOUBLE[]) distance FROM firms f, q)"""


def _hybrid(where: str, score: str, first: str) -> str:
    return f"""WITH {FIRMS}, {SCORED}, h AS (SELECT *, round({score}, 4) hybrid_score FROM s WHERE {where}),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {first}) k FROM h)
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, distance, id)::INT "rank", hybrid_score, least(round((1 - distance) * 100, 2), 100.0) match_percent FROM r WHERE k <= 10"""


BOOST = "1 - distance + CASE WHEN list_contains(focus_sectors, 'PROMO') THEN 0.15::DOUBLE ELSE 0 END + {st}CASE WHEN list_contains(geography, 'ASIA') THEN 0.10::DOUBLE ELSE 0 END"
STAGE_BOOST = "CASE WHEN list_contains(investment_stage, '1-URGENT') THEN 0.05::DOUBLE ELSE 0 END + "
PROFILES = """profiles AS (SELECT n_nationkey profile_id, ['promo', 'econ', 'Small', ' large ', ''][n_nationkey % 5 + 1] sector, ['urgent', '1-URGENT', 'low'][n_nationkey % 3 + 1] stage, n_name place FROM nation),
  m AS (SELECT f.*, profile_id, contains(lower(array_to_string(focus_sectors, ' ')), lower(trim(sector))) a, contains(lower(array_to_string(investment_stage, ' ')), lower(trim(stage))) b,
    contains(lower(array_to_string(geography, ' ')), lower(trim(place))) c FROM firms f, profiles)"""
VERDICTS = URL_CASES + """, v0 AS (SELECT page_id, url, ['investor_profile', 'investor_mention', 'Unknown', 'investor_directory', 'blog'][page_id % 5 + 1] st,
    CASE WHEN page_id % 9 = 0 THEN 0.0::DOUBLE ELSE (page_id % 21)::DOUBLE / 20 END confidence FROM url_cases),
  v AS (SELECT *, CASE WHEN lower(st) IN ('investor_profile', 'investor_directory', 'investor_mention', 'unknown') THEN lower(st) ELSE 'investor_mention' END source_type FROM v0)"""
GATE = """CASE WHEN reject_reason <> 'ok' THEN 'rejected_url' WHEN confidence < 0.4 THEN 'not_relevant' WHEN confidence < 0.75 THEN 'low_confidence'
    WHEN source_type NOT IN ('investor_profile', 'investor_directory', 'investor_mention') THEN 'source_type_' || source_type WHEN source_type = 'investor_mention' AND confidence < 0.88 AND NOT profile
    THEN 'mention_not_profile_url' ELSE 'ok' END"""
FACETS = """fc AS (SELECT c_custkey id, [sc[c_custkey % 7 + 1], sc[(c_custkey * 3 + 1) % 7 + 1]] focus_sectors, [tc[c_custkey % 6 + 1], tc[(c_custkey * 3 + 1) % 6 + 1]] investment_stage,
    [pc[c_custkey % 5 + 1], pc[(c_custkey * 3 + 1) % 5 + 1]] geography FROM customer, (SELECT ['Enterprise Software', ' ai ', 'B2B SaaS', 'retail', 'Voice Agents', 'SaaS', 'Fintech'] sc,
    ['pre seed', 'Early-Stage', 'Series A', 'buyouts', 'ipo', 'Debt'] tc, ['USA', 'uk', 'England', 'mena', 'Asia'] pc))"""


def _mapped(column: str, known: dict[str, str]) -> str:
    """Two-element list with names mapped, repeats dropped, in order."""
    one = lambda x: f"coalesce(map_extract(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in known.items())}}}, lower(trim({x})))[1], {x})"
    a, b = one(f"{column}[1]"), one(f"{column}[2]")
    return f"CASE WHEN {a} = {b} THEN [{a}] ELSE [{a}, {b}] END"


def _second_sector(x: str) -> str:
    k = f"lower(trim({x}))"
    return f"""CASE WHEN {k} IN ('ai', 'artificial intelligence', 'enterprise ai') THEN ['Artificial Intelligence'] WHEN {k} = 'voice ai' THEN ['Voice AI'] WHEN {k} = 'b2b saas' THEN ['B2B', 'SaaS']
    WHEN {k} = 'b2b' THEN ['B2B'] WHEN {k} = 'saas' THEN ['SaaS'] WHEN contains({k}, 'voice') THEN ['Voice AI'] WHEN contains({k}, 'ai') THEN ['Artificial Intelligence']
    WHEN contains({k}, 'saas') THEN ['SaaS'] WHEN contains({k}, 'b2b') THEN ['B2B'] ELSE [] END"""


def _values(name: str, column: str, values) -> str:
    return f"{name}({column}) AS (VALUES {', '.join('(' + repr(v) + ')' for v in values)})"


UNIVERSE = ", ".join((
    _values("sec", "s", rules.SECTORS), _values("stg", "g", rules.STAGES), _values("plc", "p", rules.PLACES), _values("thm", "t", rules.THEMES), _values("trm", "w", rules.INVESTOR_TERMS),
    f"""universe AS (SELECT DISTINCT query FROM (SELECT s || ' ' || w query FROM sec, trm UNION ALL SELECT s || ' ' || g || ' ' || x FROM sec, stg, (VALUES ('investors'), ('venture capital')) y(x)
    UNION ALL SELECT s || ' investors in ' || p FROM sec, plc UNION ALL SELECT s || ' venture capital firms in ' || p FROM sec, plc UNION ALL SELECT p || ' ' || s || ' startup investors' FROM sec, plc
    UNION ALL SELECT t || ' ' || x FROM thm, (VALUES ('investors'), ('venture capital firms'), ('startup investors'), ('VC funds')) y(x)
    UNION ALL SELECT replace(x, '{{s}}', s) FROM sec, (VALUES {', '.join('(' + repr(q) + ')' for q in rules.SECTOR_QUERIES)}) y(x)
    UNION ALL SELECT t || ' ' || s || ' ' || x FROM sec, thm, (VALUES ('investors'), ('venture capital')) y(x)) WHERE length(query) > 10)""",
))
EXPANSIONS = "expansion(theme, expanded) AS (VALUES " + ", ".join(f"({k!r}, {x!r})" for k, v in rules.THEME_EXPANSIONS.items() for x in v) + ")"
THEMES = f"themes AS (SELECT n_nationkey profile_id, n_name, {[*rules.SECTORS, 'Robotics']}[n_nationkey % 5 + 1] theme FROM nation)"
_P = [repr(x) for x in rules.PROFILE_TERMS]
PROFILE_QUERIES = f"""WITH {THEMES}, {EXPANSIONS}, p AS (SELECT profile_id, CASE WHEN profile_id % 2 = 0 THEN 'AI' END s, CASE WHEN profile_id % 3 = 0 THEN 'Seed' END g, CASE WHEN profile_id % 4 < 2 THEN n_name END p,
    CASE WHEN profile_id % 5 <> 0 THEN theme END t FROM themes), w(w) AS (VALUES {', '.join(f'({x})' for x in _P)}),
  made AS (SELECT profile_id, s || ' ' || w query FROM p, w UNION SELECT profile_id, t || ' ' || w FROM p, w UNION SELECT profile_id, s || ' ' || g || ' investors' FROM p UNION SELECT profile_id, s || ' ' || g || ' venture capital' FROM p
    UNION SELECT profile_id, s || ' investors in ' || p FROM p UNION SELECT profile_id, p || ' ' || s || ' startup investors' FROM p UNION SELECT profile_id, t || ' investors in ' || p FROM p
    UNION SELECT profile_id, p || ' ' || t || ' startup investors' FROM p UNION SELECT profile_id, g || ' ' || s || ' venture capital in ' || p FROM p UNION SELECT profile_id, g || ' ' || s || ' investors in ' || p FROM p
    UNION SELECT profile_id, t || ' ' || g || ' investors' FROM p UNION SELECT profile_id, t || ' ' || g || ' venture capital' FROM p
    UNION SELECT profile_id, expanded || ' ' || w FROM p JOIN expansion ON t = theme, w UNION SELECT profile_id, expanded || ' investors in ' || p FROM p JOIN expansion ON t = theme),
  sm AS (SELECT * FROM made WHERE query IS NOT NULL) SELECT * FROM sm
  UNION ALL SELECT profile_id, x FROM p, (VALUES {', '.join('(' + repr(q) + ')' for q in rules.FALLBACK_QUERIES)}) y(x) WHERE profile_id NOT IN (SELECT profile_id FROM sm)"""
STORED = "stored AS (SELECT page_id seq, 'p' || page_id || '.md' \"file\", url, html markdown FROM pages)"
DEPTH = urls("stored") + r""", ranked AS (SELECT *, CASE WHEN trim(d0, '/') = '' THEN 0 ELSE length(trim(d0, '/')) - length(replace(trim(d0, '/'), '/', '')) + 1 END AS "depth"
    FROM (SELECT *, regexp_replace(regexp_extract(t, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') d0 FROM u))"""
BUNDLE = f"""WITH {STORED}, {DEPTH}, b AS (SELECT "domain", list("file" ORDER BY "depth", seq) files, first(url ORDER BY "depth", seq) homepage_url,
    string_agg(chr(10) || chr(10) || '--- SOURCE URL: ' || url || ' ---' || chr(10) || chr(10) || markdown, '' ORDER BY "depth", seq) markdown, max(CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END) fresh FROM ranked GROUP BY 1)"""
LINKS = rf"""md AS (SELECT page_id, url, regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', '[\2](\1)', 'g') || ' [Our team](/team?x=1#y) [Us](about/us) [Deck](/team/deck.pdf) [x](https://other.org/team)' markdown FROM pages),
  l0 AS (SELECT url page_url, unnest(regexp_extract_all(markdown, '\[([^\]]+)\]\(([^)]+)\)', 1)) tx, unnest(regexp_extract_all(markdown, '\[([^\]]+)\]\(([^)]+)\)', 2)) raw FROM md),
  l1 AS (SELECT page_url, tx, trim(regexp_replace(trim(raw), '[#?](.|\n)*$', '')) dest FROM l0),
  l2 AS (SELECT page_url, CASE WHEN regexp_matches(dest, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN dest WHEN starts_with(dest, '//') THEN regexp_extract(page_url, '^(https?)://', 1) || ':' || dest
    WHEN starts_with(dest, '/') THEN regexp_extract(page_url, '^(https?://[^/?#]*)', 1) || dest
    ELSE regexp_extract(page_url, '^(https?://[^/?#]*)', 1) || CASE WHEN regexp_extract(page_url, {PATH}, 1) = '' THEN '/' ELSE regexp_extract(regexp_extract(page_url, {PATH}, 1), '^(.*/)', 1) END || dest END link
    FROM l1 WHERE dest <> '' AND (regexp_matches(lower(dest), '{_any(rules.LINK_WORDS)}') OR regexp_matches(lower(tx), '{_any(rules.LINK_WORDS)}'))),
  {urls('l2', 'k', 'link')}, links AS (SELECT DISTINCT page_url url, link FROM k WHERE reject_reason = 'ok' AND link <> page_url
    AND replace(lower(regexp_extract(link, {HOST}, 1)), 'www.', '') = replace(lower(regexp_extract(page_url, {HOST}, 1)), 'www.', ''))"""
INCOMING = """inc AS (SELECT c_custkey seq, CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name || ' Ventures' WHEN 2 THEN 'New ' || c_custkey ELSE 'Capital Group' END "name",
    CASE WHEN c_custkey % 2 = 0 THEN 'firm-' || (c_custkey % 150) || '.example.com' ELSE 'firm-' || (c_custkey % 130) || '.example.com' END site FROM customer)"""
CASCADE = f"""WITH {FIRMS}, {names('firms', 'firm_name', 'f')}, {INCOMING}, {names('inc')}, c AS (SELECT seq, (SELECT min(id) FROM firms WHERE lower(firm_name) = lower(n."name")) t1,
    (SELECT min(id) FROM f WHERE f.firm_key = n.firm_key AND n.firm_key <> '') t2, (SELECT min(id) FROM firms WHERE 'firm-' || (id % 100) || '.example.com' = n.site) t3 FROM n),
  casc AS (SELECT seq, coalesce(t1, t2, t3) duplicate_id, CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 WHEN t3 IS NOT NULL THEN 3 END tier FROM c)"""
LEVEL = "CASE WHEN contains(lower(\"value\"), 'error') OR contains(lower(\"value\"), 'fail') THEN 'error' WHEN contains(lower(\"value\"), 'warn') THEN 'warn' ELSE 'info' END"


def _join(column: str) -> str:
    return f"coalesce(array_to_string({column}, '|'), '')"


ORACLE: dict[str, str] = {
    "url_canonical": _urls("canonical"), "url_domain": _urls("domain"), "url_base": _urls("base"), "url_reject_reason": _urls("reject_reason"), "url_profile_flag": _urls("profile"),
    "firm_name_norm": _names("firm_name_norm"), "firm_key": _names("firm_key"), "firm_name_reject": _names("name_reason"),
    "vector_topk": f"WITH {FIRMS}, {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) k FROM s) SELECT query_id, id, round(distance, 6) distance FROM r WHERE k <= 10",
    "hybrid_search": _hybrid("list_contains(focus_sectors, 'PROMO') AND list_contains(investment_stage, '1-URGENT') AND list_contains(geography, 'ASIA')", "1 - distance + 0.15::DOUBLE + 0.05::DOUBLE + 0.10::DOUBLE", "distance, id"),
    "hybrid_search_boost_mode": _hybrid("true", BOOST.format(st=STAGE_BOOST), "hybrid_score DESC, distance, id"),
    "match_explanation": f"""WITH {FIRMS}, {SCORED}, h AS (SELECT *, round({BOOST.format(st='')}, 4) hs, list_contains(focus_sectors, 'PROMO') a, list_contains(geography, 'ASIA') b FROM s),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hs DESC, distance, id) k FROM h)
      SELECT query_id, id, 'Matches based on semantic text similarity (' || floor((1 - distance) * 100 + 0.5)::BIGINT || '% match).' || CASE WHEN a OR b THEN ' Boosted for alignment with: '
      || concat_ws(', ', CASE WHEN a THEN 'Focus Sector' END, CASE WHEN b THEN 'Target Geography' END) || '.' ELSE '' END explanation FROM r WHERE k <= 10""",
    "rule_rank": f"""WITH {FIRMS}, {PROFILES}, z AS (SELECT profile_id, id, CASE WHEN a THEN 5 ELSE 0 END + CASE WHEN b THEN 5 ELSE 0 END + CASE WHEN c THEN 3 ELSE 0 END score FROM m),
      r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, id) "rank" FROM z WHERE score > 0) SELECT profile_id, id, score, "rank" FROM r WHERE "rank" <= 10""",
    "facet_match_substring": f"WITH {FIRMS}, {PROFILES} SELECT profile_id, id FROM m WHERE a AND b AND c",
    "facet_match_exact": f"WITH {FIRMS} SELECT r_regionkey profile_id, id FROM firms, region WHERE list_contains(focus_sectors, 'PROMO') AND list_contains(investment_stage, '1-URGENT') AND list_contains(geography, r_name)",
    "embedding_text": f"WITH {FIRMS} SELECT id, firm_name || ' ' || website || ' ' || coalesce(array_to_string(focus_sectors, ' '), '') || ' ' || coalesce(array_to_string(investment_stage, ' '), '') || ' ' || array_to_string(geography, ' ') embedding_text FROM firms",
    "list_firms_page": f"""WITH {FIRMS}, {PARTNERS}, {PORTFOLIO}, pg AS (SELECT * FROM firms WHERE firm_name ILIKE '%customer%' AND list_contains(geography, 'ASIA') ORDER BY updated_at DESC NULLS LAST, firm_name, id LIMIT 50 OFFSET 10)
      SELECT id, firm_name, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') updated_at, (SELECT count(*) FROM partners p WHERE p.firm_id = pg.id) partner_count, (SELECT count(*) FROM portfolio p WHERE p.firm_id = pg.id) company_count,
      coalesce((SELECT string_agg(company_name, '|' ORDER BY p.id, company_name) FROM portfolio p WHERE p.firm_id = pg.id), '') companies FROM pg""",
    "firm_pages": "SELECT count(*) total, greatest(1, ceil(count(*) / 15.0))::BIGINT pages FROM customer",
    "list_partners_by_firm": f"WITH {FIRMS}, {PARTNERS} SELECT firm_id, p.id, p.\"name\", firm_name FROM partners p JOIN firms f ON f.id = firm_id WHERE p.\"name\" ILIKE '%supplier%' AND firm_name ILIKE '%00001%' ORDER BY p.\"name\", firm_id, p.id LIMIT 100",
    "list_companies": f"WITH {FIRMS}, {PORTFOLIO} SELECT firm_id, p.id, company_name, firm_name FROM portfolio p LEFT JOIN firms f ON f.id = firm_id WHERE company_name ILIKE '%w%t%' ORDER BY company_name, firm_id, p.id LIMIT 250 OFFSET 5",
    "firm_detail": f"""WITH {FIRMS}, {PARTNERS}, {PORTFOLIO} SELECT id, coalesce((SELECT string_agg(p."name", '|' ORDER BY p.id, p."name") FROM partners p WHERE p.firm_id = f.id), '') partners,
      coalesce((SELECT string_agg(company_name || '/' || sector, '|' ORDER BY p.id, company_name, sector) FROM portfolio p WHERE p.firm_id = f.id), '') companies FROM firms f""",
    "metrics": f"WITH {FIRMS}, {PARTNERS}, {PORTFOLIO} SELECT (SELECT count(*) FROM firms) firms, (SELECT max(updated_at) FROM firms) last_updated, (SELECT count(*) FROM partners) partners, (SELECT count(*) FROM portfolio) companies",
    "sector_distribution": f"WITH {FIRMS} SELECT trim(x) \"value\", count(*) n FROM (SELECT unnest(focus_sectors) x FROM firms) WHERE trim(x) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6",
    "stage_distribution": f"WITH {FIRMS} SELECT trim(x) \"value\", count(*) n FROM (SELECT unnest(investment_stage) x FROM firms) WHERE trim(x) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "failure_ledger": "SELECT user_id url, arg_max(value, ts) error_message, count(*) retry_count, max(ts) last_attempt, CASE WHEN max(ts) >= TIMESTAMP '2024-01-15' THEN 'pending' ELSE 'resolved' END status FROM events WHERE event_type = 'error' GROUP BY 1",
    "failures_resolved": f"WITH {FAILURES}, {QUEUE} SELECT CASE WHEN q.url IS NULL THEN 'pending' ELSE 'resolved' END status, count(*) n FROM failures f LEFT JOIN queue q ON f.url = q.url AND q.status = 'completed' GROUP BY 1",
    "retry_candidates": f"WITH {FAILURES} SELECT url, retry_count, last_attempt FROM failures WHERE retry_count <= 10 ORDER BY last_attempt, url LIMIT 100",
    "queue_next": f"WITH {QUEUE} SELECT url, priority_score, discovered_at FROM queue WHERE status = 'pending' ORDER BY priority_score DESC, discovered_at, url LIMIT 50",
    "queue_insert_absent": f"WITH {QUEUE} SELECT url, priority_score, status FROM queue UNION ALL SELECT user_id + event_id % 7, max(value), 'pending' FROM events WHERE user_id + event_id % 7 NOT IN (SELECT url FROM queue) GROUP BY 1",
    "queue_complete": f"WITH {QUEUE}, d AS (SELECT user_id url, max(ts) last_crawled FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT q.url, CASE WHEN d.url IS NULL THEN status ELSE 'completed' END status, last_crawled FROM queue q LEFT JOIN d ON q.url = d.url",
    "queue_summary": f"""WITH {QUEUE}, {CRAWLED}, {FAILURES} SELECT count(*) total, count(*) FILTER (status = 'pending') pending, count(*) FILTER (status = 'completed') completed, count(*) FILTER (status = 'failed') failed,
      (SELECT count(*) FROM crawled) crawled_urls, (SELECT count(*) FROM failures) failed_urls, (SELECT count(*) FROM failures WHERE status = 'pending') pending_failures FROM queue""",
    "crawl_ledger_upsert": f"""WITH {CRAWLED}, b AS (SELECT * FROM crawled UNION ALL SELECT user_id, CAST(event_id AS VARCHAR), ts FROM events WHERE event_type = 'click'),
      r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY updated_at DESC, discovered_query DESC) k FROM b) SELECT url, discovered_query, updated_at FROM r WHERE k = 1""",
    "recrawl_filter": f"WITH {CRAWLED}, {QUEUE} SELECT c_custkey url FROM customer WHERE c_custkey NOT IN (SELECT url FROM crawled WHERE updated_at > TIMESTAMP '2024-01-15') AND c_custkey NOT IN (SELECT url FROM queue WHERE status = 'completed')",
    "first_hit_per_site": f"WITH {HITS}, {urls('hits')}, r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY query, page, \"rank\", url) k FROM u WHERE base <> '') SELECT base base_url, url, query, \"rank\" FROM r WHERE k = 1",
    "first_hit_per_url": f"WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query, url ORDER BY page, \"rank\") k FROM hits) SELECT query, url, page, \"rank\" FROM r WHERE k = 1",
    "paging_stop": """WITH h AS (SELECT page_id % 7 query, page_id % 11 page, page_id "rank", page_id % 4 u FROM pages), w AS (SELECT *, row_number() OVER (PARTITION BY query, u ORDER BY page, "rank") = 1 f FROM h),
      p AS (SELECT query, page, count(*) FILTER (f) new FROM w GROUP BY ALL), s AS (SELECT query, min(page) FILTER (new = 0) stop FROM p GROUP BY 1) SELECT h.query, page, "rank" FROM h JOIN s ON h.query = s.query WHERE stop IS NULL OR page < stop""",
    "url_budget": f"""WITH {HITS}, c AS (SELECT query seq, count(*) n FROM hits GROUP BY 1), b AS (SELECT 3 * count(*) + 40 budget FROM c), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) x FROM c)
      SELECT seq, n, least(n, budget - x)::BIGINT take FROM w, b WHERE x < budget""",
    "priority_score": f"""WITH {VERDICTS}, {urls('v')} SELECT page_id, round(confidence + CASE WHEN profile THEN 0.5 ELSE 0 END + {' + '.join(f"CASE WHEN contains(lower(url), '{w}') THEN {n} ELSE 0 END" for w, n in (("portfolio", 2), ("team", 2), ("partner", 2), ("people", 2), ("leadership", 2), ("about", 1.5), ("investor", 1), (".vc", 1.5)))}
      + CASE WHEN source_type = 'investor_profile' THEN 1 ELSE 0 END, 4) priority_score FROM u""",
    "relevance_tier": f"WITH {VERDICTS} SELECT page_id, confidence, confidence >= 0.4 is_relevant, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' WHEN confidence >= 0.4 THEN 'low' ELSE 'reject' END relevance_tier, source_type FROM v",
    "keyword_prefilter": f"SELECT doc_id, regexp_matches(lower(coalesce(source, '') || ' ' || coalesce(text, '')), '{_any(rules.PREFILTER_WORDS)}') passes FROM documents",
    "discovery_gate": f"WITH {VERDICTS}, {urls('v')} SELECT page_id, {GATE} gate_reason FROM u",
    "discover": f"""WITH {VERDICTS}, {urls('v', 'w')}, jd AS (SELECT canonical, arg_min(confidence, page_id) confidence, arg_min(source_type, page_id) source_type FROM w GROUP BY 1),
      found AS (SELECT canonical found_url, page_id % 7 query, page_id % 3 + 1 page, page_id FROM w WHERE NOT canonical = ''), {urls('found', 'x', 'found_url')},
      r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY query, page, page_id, found_url) k FROM x WHERE reject_reason = 'ok' AND base <> ''),
      site AS (SELECT base url, query, confidence, source_type FROM r JOIN jd ON jd.canonical = found_url WHERE k = 1 AND base NOT IN (SELECT url FROM v WHERE page_id % 4 = 0 OR page_id % 10 = 3)), {urls('site', 'y')}
      SELECT url, query, {GATE} gate_reason FROM y""",
    "query_universe": f"""WITH {UNIVERSE}, wd AS (SELECT w2, count(*) n FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) w2 FROM documents) GROUP BY 1)
      SELECT query, coalesce(n, 0) documents FROM universe LEFT JOIN wd ON w2 = lower(split_part(query, ' ', 1))""",
    "facet_queries": f"WITH {UNIVERSE}, pl AS (SELECT upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) p0 FROM region), p1 AS (SELECT CASE WHEN p0 = 'Middle east' THEN 'Middle East' ELSE p0 END place FROM pl) SELECT query, place FROM universe, p1 WHERE contains(lower(query), 'saas') AND contains(query, place)",
    "theme_expansion": f"WITH {THEMES}, {EXPANSIONS} SELECT DISTINCT theme, theme expanded FROM themes UNION SELECT e.theme, e.expanded FROM themes t JOIN expansion e ON t.theme = e.theme",
    "profile_queries": PROFILE_QUERIES,
    "team_page_candidates": f"""WITH {URL_CASES}, {urls('url_cases')}, c AS (SELECT canonical c, base b0 FROM u WHERE canonical <> ''), {urls('c', 'w', 'c')}, b AS (SELECT DISTINCT b0 base FROM w WHERE reject_reason = 'ok' AND contains("domain", '.') AND "domain" NOT IN ('localhost', '127.0.0.1')),
      {_values('tp', 'p', rules.TEAM_PATHS)} SELECT base || p url FROM b, tp WHERE p NOT IN ('/team', '/about')""",
    "subpages": f"WITH {FIRMS}, {_values('sp', 'p', rules.SUBPAGES)} SELECT DISTINCT rtrim(website, '/') || p url FROM firms, sp",
    "markdown_links": f"WITH {LINKS} SELECT url, link FROM links",
    "links_top10": f"""WITH {LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY link) k FROM links), {_values('fb', 'p', rules.LINK_FALLBACKS)}
      SELECT url, link FROM r WHERE k <= 10 UNION ALL SELECT DISTINCT url, regexp_extract(url, '^(https?://[^/?#]*)', 1) || p FROM pages, fb WHERE url NOT IN (SELECT url FROM links)""",
    "domain_bundles": f"{BUNDLE} SELECT \"domain\", regexp_replace(\"domain\", '[^a-zA-Z0-9]', '_', 'g') safe_name, homepage_url, array_to_string(files, '|') files, sha256(markdown) markdown_sha256 FROM b WHERE \"domain\" <> ''",
    "bundle_incremental_skip": f"{BUNDLE} SELECT \"domain\", array_to_string(files, '|') files FROM b WHERE fresh = 1 AND \"domain\" <> ''",
    "page_rank_in_domain": f"WITH {STORED}, {DEPTH} SELECT seq, \"domain\", \"depth\", row_number() OVER (PARTITION BY \"domain\" ORDER BY \"depth\", seq) page_rank FROM ranked",
    "min_length_gate": "SELECT doc_id FROM documents WHERE length(text) >= 500",
    "taxonomy_step1": f"WITH {FACETS} SELECT id, {_join(_mapped('focus_sectors', rules.SECTOR_NAMES))} focus_sectors, {_join(_mapped('investment_stage', rules.STAGE_NAMES))} investment_stage, {_join(_mapped('geography', rules.PLACE_NAMES))} geography FROM fc",
    "taxonomy_step2": f"""WITH {FACETS} SELECT id, {_join('list_sort(list_distinct(list_concat(' + _second_sector('focus_sectors[1]') + ', ' + _second_sector('focus_sectors[2]') + ')))')} focus_sectors,
      {_join('list_sort(' + _mapped('investment_stage', rules.SECOND_STAGE_NAMES) + ')')} investment_stage, {_join('geography')} geography FROM fc""",
    "sparse_recovery": """WITH d AS (SELECT doc_id id, lower(text || CASE WHEN doc_id % 3 = 0 THEN ' SaaS for a thousand seed investors in Europe' ELSE '' END) t FROM documents)
      SELECT id, concat_ws('|', CASE WHEN regexp_matches(t, 'artificial intelligence|machine learning|generative ai|ai startup') THEN 'Artificial Intelligence' END, CASE WHEN regexp_matches(t, 'saas|enterprise software|workflow automation') THEN 'B2B|SaaS' END) focus_sectors,
      concat_ws('|', CASE WHEN regexp_matches(t, 'early-stage|early stage|seed-stage|seed investor') THEN 'Seed' END, CASE WHEN contains(t, 'series a') THEN 'Series A' END) investment_stage,
      CASE WHEN id % 5 = 0 THEN 'India' ELSE concat_ws('|', CASE WHEN contains(t, 'india') THEN 'India' END, CASE WHEN regexp_matches(t, 'united states|usa') THEN 'United States' END, CASE WHEN contains(t, 'europe') THEN 'Europe' END) END geography FROM d""",
    "provenance_reason": f"""WITH {URL_CASES}, {urls('url_cases')} SELECT page_id, CASE WHEN reject_reason <> 'ok' THEN 'missing_or_rejected_source_url' WHEN page_id % 11 = 0 THEN 'non_web_crawl_source' WHEN page_id % 7 = 0 THEN 'missing_raw_markdown_file'
      WHEN page_id % 5 = 0 THEN 'missing_raw_metadata_file' WHEN page_id % 19 = 0 THEN 'invalid_raw_metadata_file' WHEN page_id % 13 = 0 THEN 'source_url_metadata_mismatch' WHEN page_id % 17 = 0 THEN 'metadata_not_web_crawl' ELSE 'ok' END provenance FROM u""",
    "partner_filter": """WITH s AS (SELECT s_suppkey, s_name, ['', 'Partner 7', 'Managing Partner', 'Bo', 'Aakrit', '1234 5', 'J. Doe', 'Lee'][s_suppkey % 8 + 1] nm, CASE s_suppkey % 3 WHEN 0 THEN '0.85' WHEN 1 THEN '0.5' ELSE '0.9' END c FROM supplier)
      SELECT s_suppkey, concat_ws('|', CASE WHEN nm IN ('Aakrit', 'J. Doe') AND c <> '0.5' THEN nm || ':' || c END, CASE WHEN c <> '0.5' THEN s_name || ':' || c END) "real",
      concat_ws('|', CASE WHEN nm IN ('Aakrit', 'J. Doe', 'Lee') THEN nm END, CASE WHEN regexp_matches(s_name, '^[a-zA-Z0-9''\\-\\.\\s]+$') THEN s_name END) named FROM s""",
    **{f"dup_{n}": f"{CASCADE} SELECT * FROM casc WHERE tier = {k}" for n, k in (("exact", 1), ("key", 2), ("domain", 3))}, "dup_cascade": f"{CASCADE} SELECT * FROM casc",
    "firm_key_dedup": f"WITH {NAME_CASES}, {names('name_cases')} SELECT min(id) id, firm_key FROM n WHERE firm_key <> '' GROUP BY firm_key",
    "ordered_ci_union": f"""WITH {FACETS}, a AS (SELECT id, list_concat(focus_sectors, [upper(focus_sectors[1]), upper(focus_sectors[2])]) b, geography FROM fc),
      x AS (SELECT id, 'any' kind, list_concat(b, geography) v FROM a UNION ALL SELECT id, 'exact', list_concat(b, [' ']) FROM a), e AS (SELECT id, kind, unnest(v) v, generate_subscripts(v, 1) i FROM x),
      k AS (SELECT id, kind, arg_min(v, i) v, min(i) i FROM e WHERE trim(v) <> '' GROUP BY id, kind, CASE kind WHEN 'any' THEN lower(trim(v)) ELSE v END)
      SELECT id, string_agg(v, '|' ORDER BY i) FILTER (kind = 'any') any_case, string_agg(v, '|' ORDER BY i) FILTER (kind = 'exact') "exact" FROM k GROUP BY id""",
    "merge_children": f"""WITH {LI}, {PORTFOLIO}, a AS (SELECT firm_id, arg_min(company_name, id) company_name, arg_min(sector, id) FILTER (id % 2 = 0 AND sector <> '') sector FROM portfolio GROUP BY 1, lower(trim(company_name))),
      b AS (SELECT firm_id + id % 2 firm_id, upper(arg_min(company_name, id)) company_name, arg_min(sector, id) FILTER (sector <> '') sector FROM portfolio GROUP BY 1, lower(trim(company_name)))
      SELECT coalesce(a.firm_id, b.firm_id) firm_id, coalesce(a.company_name, b.company_name) company_name, coalesce(nullif(a.sector, ''), b.sector) sector FROM a FULL JOIN b ON a.firm_id = b.firm_id AND lower(a.company_name) = lower(b.company_name)""",
    "insert_missing_children": f"""WITH {LI}, {PORTFOLIO}, a AS (SELECT firm_id, company_name FROM portfolio WHERE id % 2 = 0), b AS (SELECT DISTINCT firm_id, lower(company_name) k FROM portfolio)
      SELECT firm_id, count(*) n FROM (SELECT firm_id FROM a UNION ALL SELECT firm_id FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.firm_id = b.firm_id AND lower(company_name) = k)) GROUP BY 1""",
    "log_level_counts": f"WITH {LOG} SELECT {LEVEL} \"level\", count(*) n FROM logl GROUP BY 1",
    "log_tail": f"WITH {LOG} SELECT line_no, \"value\", 'error' \"level\" FROM logl WHERE {LEVEL} = 'error' ORDER BY line_no DESC LIMIT 150",
    "log_matches": f"WITH {LOG} SELECT count(*) n FROM logl WHERE contains(\"value\", 'user=1')",
}

_SIGNALS = r"^#{1,3}\s*(team|people|partners?|leadership|investment team|our team|the team|general partners?|managing partners?|board partners?)\s*$|General Partner|Managing Partner|linkedin\.com/in/"
ORACLE["context_slice"] = rf"""WITH a AS (SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN chr(10) || '## Our Team' || chr(10) || 'A General Partner ' ELSE '' END || html m FROM pages),
  p AS (SELECT *, regexp_matches(m, '(?im){_SIGNALS}') has, length(regexp_extract(m, '(?ims)\A(.*?)(?:{_SIGNALS})', 1)) pos FROM a)
  SELECT page_id, sha256(CASE WHEN length(m) <= 4000 THEN m WHEN NOT has THEN substr(m, 1, 4000)
    ELSE substr(m, 1, 1000) || CASE WHEN pos > 1000 THEN chr(10) || chr(10) || '...[content skipped]...' || chr(10) || chr(10) ELSE '' END || substr(m, pos + 1, 3000) END) slice_sha256 FROM p"""

ORACLE["validate_reason"] = f"""WITH {NAME_CASES}, {URL_CASES}, r AS (SELECT n.id, n."name" nm, u.url src FROM name_cases n JOIN url_cases u ON n.id % (SELECT count(*) FROM url_cases) = u.page_id), {names('r', 'nm', 'a')},
  {urls('a', 'b', 'src')}, r2 AS (SELECT id, firm_name_norm fn, canonical src2, base base1 FROM b), {urls('r2', 'd', 'src2')}, {names('d', 'fn', 'e')},
  e9 AS (SELECT id, src2, reject_reason, base1, fn, name_reason nr, firm_key key1, lower(split_part("domain", '.', 1)) b1, replace(lower(split_part("domain", '.', 1)), '-', ' ') b0, "domain" dm FROM e), {names('e9', 'b0', 'g')},
  m AS (SELECT *, CASE WHEN dm = '' THEN true WHEN reject_reason <> 'ok' OR key1 = '' THEN false WHEN key1 IN ('x', {', '.join(repr(n.lower()) for n in rules.REJECTED_NAMES if n not in ('N/A', 'X'))}, 'na') THEN false
    WHEN regexp_matches(key1, '{_any(rules.REJECTED_NAME_PARTS)}') OR b1 IN {rules.PUBLISHERS} THEN false
    WHEN regexp_matches(lower(regexp_extract(src2, {PATH}, 1)), '{_any(rules.ARTICLE_PATHS)}') AND NOT (firm_key = '' OR contains(key1, firm_key) OR contains(firm_key, key1) OR split_part(key1, ' ', 1) = firm_key) THEN false ELSE true END fits FROM g)
  SELECT id, CASE WHEN src2 <> '' AND reject_reason = 'ok' THEN base1 ELSE '' END website, CASE WHEN fn = '' THEN 'missing_firm_name' WHEN nr <> 'ok' THEN 'rejected_firm_name' WHEN src2 <> '' AND reject_reason <> 'ok' THEN 'rejected_source_url'
    WHEN src2 <> '' AND NOT fits THEN 'firm_domain_mismatch' ELSE 'ok' END reason FROM m"""


def _united(column: str) -> str:
    new = f"(CASE WHEN n.{column} IS NULL THEN [] WHEN n.{column}[1] = n.{column}[2] THEN [n.{column}[1]] ELSE n.{column} END)"
    return f"list_concat(coalesce(o.{column}, []), list_filter({new}, lambda x: NOT list_contains(coalesce(o.{column}, []), x)))"


ORACLE["merge_firms"] = f"""WITH {FIRMS}, {FACETS}, o AS (SELECT *, CASE WHEN id % 2 = 0 THEN website ELSE '' END source_url FROM firms),
  n AS (SELECT id + CASE WHEN id % 2 = 0 THEN 0 ELSE 1000000 END id, 'Firm ' || id firm_name, CASE WHEN id % 4 = 0 THEN '' ELSE 'https://new.example.com' END website, focus_sectors, investment_stage, geography FROM fc),
  m AS (SELECT coalesce(n.id, o.id) id, coalesce(n.firm_name, o.firm_name) firm_name, coalesce(nullif(n.website, ''), o.website) website, CASE WHEN n.id IS NULL THEN o.source_url ELSE 'https://src.example.com' END source_url,
    {_united('focus_sectors')} fs1, {_united('investment_stage')} st1, {_united('geography')} ge1, CASE WHEN n.id IS NULL THEN strftime(o.updated_at, '%Y-%m-%d') ELSE '2025-01-01' END updated_on FROM o FULL JOIN n ON o.id = n.id)
  SELECT id, firm_name, website, source_url, {_join('fs1')} focus_sectors, {_join('st1')} investment_stage, {_join('ge1')} geography,
    firm_name || ' ' || coalesce(website, '') || ' ' || coalesce(array_to_string(fs1, ' '), '') || ' ' || coalesce(array_to_string(st1, ' '), '') || ' ' || coalesce(array_to_string(ge1, ' '), '') embedding_text, updated_on FROM m"""

ORACLE["bundle_parts"] = f"""WITH {STORED}, {DEPTH}, n AS (SELECT *, row_number() OVER (PARTITION BY "domain" ORDER BY "depth", seq) k FROM ranked WHERE "domain" <> ''),
  p AS (SELECT *, (coalesce(sum(length(markdown)) OVER (PARTITION BY "domain" ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 50000)::INT part FROM n)
  SELECT "domain", part, string_agg("file", '|' ORDER BY k) files, sha256(string_agg(chr(10) || chr(10) || '--- SOURCE URL: ' || url || ' ---' || chr(10) || chr(10) || markdown, '' ORDER BY k)) markdown_sha256 FROM p GROUP BY 1, 2"""


def _group_list(name: str, source: str) -> str:
    """CTE with the ordered union of a list over each group of eight firms."""
    return f"""{name} AS (SELECT e, string_agg(v, '|' ORDER BY a) v FROM (SELECT e, arg_min(v, a) v, min(a) a FROM (SELECT id // 8 e, v, id * 10000 + i a FROM ({source})) WHERE trim(v) <> '' GROUP BY e, lower(trim(v))) GROUP BY e)"""


_LISTS = ("focus_sectors", "investment_stage", "geography")
ORACLE["group_merge"] = f"""WITH {FIRMS}, {', '.join(_group_list(f'g_{c}', f'SELECT id, unnest({c}) v, generate_subscripts({c}, 1) i FROM firms') for c in _LISTS)},
  {_group_list('g_partners', "SELECT id, 'Partner ' || id % 5 v, 1 i FROM firms")}, {_group_list('g_companies', 'SELECT id, upper(firm_name) v, 1 i FROM firms')},
  s AS (SELECT id // 8 e, coalesce(arg_min(firm_name, id) FILTER (id % 3 = 0), '') firm, arg_min(website, id) website FROM firms GROUP BY 1)
  SELECT e entity_id, firm, website, {', '.join(f"coalesce(g_{c}.v, '') {c}" for c in (*_LISTS, 'partners', 'companies'))} FROM s {' '.join(f'LEFT JOIN g_{c} USING (e)' for c in (*_LISTS, 'partners', 'companies'))}"""


def _after_upsert(known: str, new: str, fields: tuple[str, ...]) -> str:
    """Each firm's children after the upsert, existing ones by id first, then new ones in their order: their names, and all
    that is known of them."""
    filled = ", ".join(f"arg_min({c}, (is_new, a)) FILTER (WHERE trim(coalesce({c}, '')) <> '') {c}" for c in fields)
    cells = " || '/' || ".join(f"coalesce({c}, '-')" for c in fields)
    return f"""SELECT firm_id, string_agg(nm, ' ' ORDER BY is_new, a) names, string_agg((CASE WHEN is_new = 0 THEN a::VARCHAR ELSE 'new' END) || '/' || nm || '/' || {cells}, '|' ORDER BY is_new, a) shown
    FROM (SELECT firm_id, arg_min(nm, (is_new, a)) nm, min(is_new) is_new, arg_min(a, (is_new, a)) a, {filled} FROM ({known} UNION ALL {new}) GROUP BY firm_id, lower(trim(nm))) GROUP BY 1"""


_EVEN = "FROM firms WHERE id % 2 = 0"
_SUPPLIER = "'supplier#' || lpad((id % 9)::VARCHAR, 9, '0')"
_PEOPLE = _after_upsert(
    """SELECT firm_id, "name" nm, 0 is_new, id a, CASE id % 3 WHEN 0 THEN 'GP' WHEN 1 THEN '' END "role", CASE WHEN id % 2 = 0 THEN 'https://linkedin.com/in/s' || id END linkedin_url, CASE WHEN id % 5 = 0 THEN ' ' ELSE '' END twitter_url FROM partners""",
    f"""SELECT id, 'Ann ' || id % 5, 1, 1, '', '', '@a' {_EVEN} UNION ALL SELECT id, {_SUPPLIER}, 1, 2, 'Partner', 'https://linkedin.com/in/n' || id, NULL {_EVEN} UNION ALL SELECT id, upper({_SUPPLIER}), 1, 3, 'Analyst', 'second', '@s' {_EVEN}""",
    ('"role"', "linkedin_url", "twitter_url"),
)
_OWNED = _after_upsert(
    "SELECT firm_id, company_name nm, 0 is_new, id a, sector FROM portfolio",
    f"SELECT id, 'Acme ' || id % 3, 1, 1, 'x' {_EVEN} UNION ALL SELECT id, upper(firm_name), 1, 2, 'y' {_EVEN}", ("sector",),
)
ORACLE["firm_upsert"] = f"""WITH {FIRMS}, {PARTNERS}, {PORTFOLIO}, pe AS MATERIALIZED ({_PEOPLE}), ow AS MATERIALIZED ({_OWNED})
  SELECT id, sha256(firm_name || ' ' || website || ' ' || {' '.join(f"coalesce(array_to_string({c}, ' '), '') || ' ' ||" for c in _LISTS)} coalesce(pe.names, '') || ' ' || coalesce(ow.names, '')) text_sha256, 64 width, coalesce(pe.shown, '') partners, coalesce(ow.shown, '') companies
  FROM firms LEFT JOIN pe ON pe.firm_id = id LEFT JOIN ow ON ow.firm_id = id"""
ORACLE["list_children_of"] = f'WITH {FIRMS}, {PARTNERS} SELECT firm_id, p.id, p."name", firm_name FROM partners p LEFT JOIN firms f ON f.id = firm_id WHERE firm_id = 7 ORDER BY p."name", p.id LIMIT 250'
ORACLE["firm_by_id"] = f"""WITH {FIRMS}, {PARTNERS}, {PORTFOLIO} SELECT id, firm_name, coalesce((SELECT string_agg(p."name", '|' ORDER BY p.id) FROM partners p WHERE p.firm_id = 7), '') partners,
  coalesce((SELECT string_agg(company_name, '|' ORDER BY p.id) FROM portfolio p WHERE p.firm_id = 7), '') companies FROM firms WHERE id = 7"""
ORACLE["mock_file_filter"] = "SELECT page_id, 'investor_' || page_id || '.json' file_name FROM pages WHERE page_id % 4 <> 0"
ORACLE["page_sidecar_join"] = """WITH p AS (SELECT page_id, url, replace(regexp_replace(url, CASE WHEN page_id % 3 = 0 THEN '^https?://|[^a-zA-Z0-9]' ELSE '[^a-zA-Z0-9]' END, '_', 'g') || '_' || page_id, '_', '/') n FROM pages)
  SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id % 10 <> 0 THEN url WHEN starts_with(n, 'http') THEN n ELSE 'https://' || n END url, NOT (page_id % 2 = 0 AND page_id % 10 <> 0) url_reconstructed FROM p"""
_SHOWN = ", ".join(f"coalesce(array_to_string({c}, ', '), '') {c}" for c in _LISTS)
ORACLE["joined_arrays"] = f"WITH {FIRMS} SELECT id, {_SHOWN} FROM firms"
