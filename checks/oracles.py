"""DuckDB SQL for the registered jobs, written independently of the Spark expressions."""

from __future__ import annotations

from checks.derived import duck_ctes
from crawlspark import fixed_values as V

AGENT = "examplebot"
ORACLES: dict[str, str] = {}


def _words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _with(names: tuple[str, ...], body: str, *more: str, recursive: bool = False) -> str:
    parts = [p for p in [duck_ctes(*names) if names else "", *more] if p]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


# ------------------------------------------------------------------ expression snippets


def scheme(u):
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def netloc(u):
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def host(u):
    return f"lower(regexp_replace(regexp_replace({netloc(u)}, '^.*@', ''), ':[0-9]*$', ''))"


def path(u):
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def query(u):
    return f"regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"


def bare(h):
    return f"regexp_replace({h}, '^www[.]', '')"


def same_site(h, seed):
    return f"({h} <> '' AND ({bare(h)} = {bare(seed)} OR ends_with({h}, '.' || {bare(seed)})))"


def segs(p):
    return f"list_filter(string_split({p}, '/'), lambda s: s <> '')"


def site_key(u):
    return f"coalesce(nullif({bare(host(u))}, ''), lower({u}))"


_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_EXCLUDED = _words(w for w in V.EXCLUDED_SEGMENTS if w not in V.ALLOWED_SEGMENTS)


def first_seg(u):
    return f"lower(regexp_extract({path(u)}, '^/*([^/]+)', 1))"


# ------------------------------------------------------------------------ sources, sinks

ORACLES["scan_pages"] = "SELECT page_id, url, html, page_id AS pos FROM pages"
ORACLES["scan_fetch_log"] = _with(
    ("fetch_log",), "SELECT url, attempt, status, content_type, n_bytes FROM fetch_log")
ORACLES["scan_robots"] = _with(("robots_txt",), """
SELECT site, CAST(i - 1 AS BIGINT) AS line_no, lines[i] AS line
FROM (SELECT site, string_split(body, chr(10)) AS lines FROM robots_txt WHERE status BETWEEN 200 AND 299) r,
     range(1, 1000) AS g(i) WHERE i <= len(lines)""")
_GUESSES = """
guesses AS (
  SELECT s.*, CAST(g.guess AS BIGINT) AS guess, rtrim(s.url, '/') || g.tail AS sitemap_url
  FROM seeds s, (VALUES (0, '/sitemap.xml'), (1, '/sitemap_index.xml')) AS g(guess, tail))"""
ORACLES["scan_sitemaps"] = _with(
    ("seeds", "sitemaps"),
    "SELECT seed_id, guess, sitemap_url, xml FROM guesses JOIN sitemaps USING (sitemap_url)", _GUESSES)
ORACLES["scan_claim_events"] = _with(("claim_events",), "SELECT * FROM claim_events")

# --------------------------------------------------------------------------- URL columns

ORACLES["url_parts"] = f"""
SELECT page_id, {scheme('url')} AS scheme, {netloc('url')} AS netloc, {host('url')} AS host,
       {path('url')} AS path, '' AS params, {query('url')} AS query,
       regexp_extract(url, '#(.*)$', 1) AS fragment
FROM pages"""
ORACLES["url_normalize"] = _with(("seed_urls",), f"""
SELECT seed_id, {scheme('u')} || '://' || regexp_replace(lower({netloc('u')}), '^.*@', '')
       || CASE WHEN {path('u')} = '' THEN '/' ELSE {path('u')} END
       || CASE WHEN {query('u')} = '' THEN '' ELSE '?' || {query('u')} END AS normalized
FROM (SELECT seed_id, trim(url) AS u FROM seed_urls) t""")
ORACLES["site_keys"] = _with(("seed_urls",), f"""
SELECT seed_id, coalesce(nullif({bare(host('trim(url)'))}, ''), lower(url)) AS site_key FROM seed_urls""")
ORACLES["url_segments"] = f"""
SELECT page_id, array_to_string({segs(path('url'))}, '|') AS segments,
       CAST(len({segs(path('url'))}) AS BIGINT) AS n FROM pages"""


def _decode(x):
    return f"url_decode(replace({x}, '+', ' '))"


def _encode(x):
    return f"replace(url_encode({x}), '%20', '+')"


def _encoded(pairs):
    return (f"array_to_string(list_transform({pairs}, lambda pr: {_encode('pr.k')} || '=' || {_encode('pr.v')}), '&')")


def key_ctes(source: str) -> str:
    """k1..k3: page_key, lang and lang_rank for the (pos, url) rows of `source`."""
    rank = " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.LANGUAGE_RANK.items())
    return f"""
k1 AS (
  SELECT *, coalesce(nullif({scheme('url')}, ''), 'https') || '://' || lower({netloc('url')}) AS base,
         {path('url')} AS p, {first_seg('url')} IN ({_words(V.LANGUAGE_SEGMENTS)}) AS in_path,
         list_transform(list_filter(string_split({query('url')}, '&'), lambda x: x <> ''),
           lambda x: {{'k': {_decode("split_part(x, '=', 1)")},
                       'v': {_decode("CASE WHEN contains(x, '=') THEN substr(x, instr(x, '=') + 1) ELSE '' END")}}}) AS pairs
  FROM {source}),
k2 AS (
  SELECT *, list_filter(pairs, lambda q: lower(q.k) NOT IN ({_words(V.LANGUAGE_KEYS)})) AS content,
         list_filter(pairs, lambda q: lower(q.k) IN ({_words(V.LANGUAGE_KEYS)}) AND q.v <> '')[1].v AS lang_value,
         CASE WHEN in_path THEN '/' || array_to_string(({segs('p')})[2:], '/')
              WHEN p = '' THEN '/' ELSE p END AS rest
  FROM k1),
k3 AS (
  SELECT *, CASE WHEN len({segs('rest')}) >= 2
                 THEN nullif(regexp_extract(lower(({segs('rest')})[-1]), '-([0-9]{{3,}})[.][^.]*$', 1), '') END AS listing,
         len({segs('rest')}) <= 2 AND len(list_filter(content, lambda q:
            lower(q.k) NOT IN ({_words(V.PAGINATION_KEYS)}) AND q.v <> ''
            AND (regexp_matches(q.k, '{V.IDENTITY_KEY}') OR regexp_matches(trim(q.v), '^[0-9]{{3,}}$')
                 OR regexp_matches(trim(q.v), '{V.IDENTITY_UUID}')))) > 0 AS resource
  FROM k2),
keyed AS (
  SELECT * EXCLUDE (lang_raw), CASE lang_raw {rank} ELSE {V.OTHER_LANGUAGE_RANK} END AS lang_rank, lang_raw AS lang
  FROM (
    SELECT *,
      CASE WHEN in_path AND listing IS NOT NULL THEN 'listing:' || listing || ' ' || base
             || CASE WHEN len(content) = 0 THEN '' ELSE '?' || {_encoded('list_sort(content)')} END
           WHEN listing IS NULL AND resource THEN 'resource:' || substr(sha256({_encoded(
               "list_transform(list_sort(list_transform(content, lambda q: {'f': lower(q.k), 'k': q.k, 'v': q.v})),"
               " lambda q: {'k': q.k, 'v': q.v})")}), 1, {V.QUERY_DIGEST_LENGTH}) || ' ' || base
           ELSE base || rest || CASE WHEN len(content) = 0 THEN '' ELSE '?' || {_encoded('list_sort(content)')} END
      END AS page_key,
      CASE WHEN in_path THEN {first_seg('url')}
           WHEN lower(trim(lang_value)) IN ({_words(V.LANGUAGE_SEGMENTS)}) THEN lower(trim(lang_value))
           WHEN regexp_matches(split_part(lower(trim(lang_value)), '-', 1), '^[a-z][a-z]$')
             THEN split_part(lower(trim(lang_value)), '-', 1) END AS lang_raw
    FROM k3) z)"""


ORACLES["canonical_url_key"] = _with(
    ("language_variants",), "SELECT pos, url, page_key, lang, lang_rank FROM keyed", key_ctes("language_variants"))
ORACLES["seed_normalize"] = _with(("typed_addresses",), f"""
SELECT page_id, CASE WHEN t = '' OR {host('a')} = '' THEN NULL ELSE
         {scheme('a')} || '://' || regexp_replace(lower({netloc('a')}),
             CASE WHEN {scheme('a')} = 'https' THEN ':443$' ELSE ':80$' END, '')
         || CASE WHEN {path('a')} = '' THEN '/' ELSE {path('a')} END
         || regexp_extract(a, '^[^?#]*(.*)$', 1) END AS url
FROM (SELECT page_id, trim(raw) AS t,
             CASE WHEN regexp_matches(trim(raw), '(?i)^https?://') THEN trim(raw) ELSE 'https://' || trim(raw) END AS a
      FROM typed_addresses) x""")

# --------------------------------------------------------------------------------- filters

ORACLES["scope_filter"] = _with(
    ("scope_urls",), f"SELECT page_id, url FROM scope_urls WHERE {first_seg('url')} NOT IN ({_EXCLUDED})")
ORACLES["scope_verdict"] = _with(("scope_urls",), f"""
SELECT page_id, url, {first_seg('url')} NOT IN ({_EXCLUDED}) AS allowed,
       CASE WHEN {first_seg('url')} NOT IN ({_EXCLUDED}) THEN '' ELSE 'excluded_path' END AS reason FROM scope_urls""")
ORACLES["scope_rules"] = _with(("scope_urls",), f"""
SELECT r.segment, CAST(count(u.url) AS BIGINT) AS n_urls
FROM (SELECT unnest([{_words(V.EXCLUDED_SEGMENTS)}]) AS segment
      EXCEPT SELECT unnest([{_words(V.ALLOWED_SEGMENTS)}])) r
LEFT JOIN scope_urls u ON {first_seg('u.url')} = r.segment GROUP BY r.segment""")

_HOSTS_CLOSED = """
verdicts AS (
  SELECT host, bool_or(ip LIKE '10.%' OR ip LIKE '192.168.%') AS closed FROM host_ips GROUP BY host)"""
ORACLES["seed_safety"] = _with(("seed_urls", "host_ips"), f"""
SELECT seed_id, url, host, coalesce(nullif({bare('host')}, ''), lower(url)) AS site_key,
       CASE WHEN reason IS NULL THEN normalized END AS base_url, reason
FROM (
  SELECT s.*, CASE WHEN s.sch NOT IN ('http', 'https') THEN 'bad_scheme' WHEN s.net = '' THEN 'no_authority'
       WHEN s.host = '' THEN 'no_host'
       WHEN s.host IN ({_words(V.BLOCKED_HOSTS)}) OR ends_with(s.host, '.localhost') THEN 'blocked_host'
       WHEN s.host LIKE '127.%' OR s.host LIKE '10.%' OR s.host LIKE '192.168.%' THEN 'private_address'
       WHEN v.closed IS NULL THEN 'unresolved' WHEN v.closed THEN 'closed_network' END AS reason
  FROM (SELECT *, {scheme('u')} AS sch, {netloc('u')} AS net, {host('u')} AS host,
               {scheme('u')} || '://' || regexp_replace(lower({netloc('u')}), '^.*@', '')
               || CASE WHEN {path('u')} = '' THEN '/' ELSE {path('u')} END
               || CASE WHEN {query('u')} = '' THEN '' ELSE '?' || {query('u')} END AS normalized
        FROM (SELECT seed_id, url, trim(url) AS u FROM seed_urls) t) s
  LEFT JOIN verdicts v ON v.host = s.host) x""", _HOSTS_CLOSED)


def _folded(merged: str) -> str:
    """Resolve dot segments of an absolute path."""
    walked = (
        f"list_reduce(list_transform(string_split({merged}, '/'), lambda s: [s]), "
        "lambda acc, x: CASE WHEN x[1] = '..' THEN acc[:-2] WHEN x[1] = '.' THEN acc ELSE list_concat(acc, x) END)")
    tail = f"CASE WHEN regexp_matches({merged}, '/[.][.]?$') THEN '/' ELSE '' END"
    return f"regexp_replace('/' || array_to_string({walked}, '/') || {tail}, '^/+', '/')"


def dst(u: str, h: str) -> str:
    root = f"regexp_extract({u}, '^([a-z]+://[^/?#]*)', 1)"
    folder = f"regexp_replace({path(u)}, '[^/]*$', '')"
    bare_href = f"regexp_replace({h}, '#.*$', '')"
    q = f"regexp_extract({bare_href}, '([?].*)$', 1)"
    hp = f"regexp_replace({bare_href}, '[?].*$', '')"
    return f"""CASE
      WHEN {h} = '' OR regexp_matches({h}, '^(#|mailto:|tel:|javascript:)') THEN NULL
      WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {bare_href}
      WHEN starts_with({h}, '//') THEN {scheme(u)} || ':' || {bare_href}
      WHEN starts_with({h}, '?') THEN {root} || {path(u)} || {bare_href}
      WHEN starts_with({h}, '/') THEN {root} || {_folded(hp)} || {q}
      ELSE {root} || {_folded(f"({folder} || {hp})")} || {q} END"""


def web(d: str) -> str:
    return f"({d} IS NOT NULL AND {scheme(d)} IN ('http', 'https') AND NOT ends_with({d}, '/robots.txt'))"


ORACLES["resolve_links"] = _with(("hrefs",), f"SELECT page_id, href, {dst('url', 'href')} AS dst FROM hrefs")
ORACLES["link_filter"] = _with(("hrefs",), f"""
SELECT page_id, link_pos, dst FROM (SELECT *, {dst('url', 'href')} AS dst FROM hrefs) x
WHERE {web('dst')} AND {same_site(host('dst'), host('url'))}""")
_ANSWERS = "status = 200 AND (lower(content_type) LIKE '%html%' OR lower(content_type) LIKE '%xml%')"
ORACLES["crawlable_response"] = _with(
    ("site_responses",), f"SELECT url, final_url FROM site_responses WHERE {_ANSWERS}")

_LOCS = """
all_locs AS (
  SELECT sitemap_url, contains(xml, '<sitemapindex>') AS is_index, CAST(i - 1 AS BIGINT) AS pos,
         replace(trim(locs[i]), '&amp;', '&') AS loc
  FROM (SELECT sitemap_url, xml, regexp_extract_all(regexp_replace(xml, '<!--.*?-->', ''), '<loc>([^<]*)</loc>', 1) AS locs
        FROM sitemaps) s, (SELECT unnest(range(1, 100000)) AS i) g WHERE i <= len(locs)),
kept_locs AS (
  SELECT * FROM all_locs WHERE is_index
  UNION ALL SELECT sitemap_url, false, min(pos), loc FROM all_locs WHERE NOT is_index GROUP BY sitemap_url, loc),
locs AS (
  SELECT sitemap_url, is_index, row_number() OVER (PARTITION BY sitemap_url ORDER BY pos) - 1 AS pos, loc FROM kept_locs)"""
ORACLES["sitemap_loc_filter"] = _with(("sitemaps",), f"""
SELECT sitemap_url, loc FROM locs
WHERE NOT is_index AND regexp_matches(loc, '^https?:') AND {same_site(host('loc'), host('sitemap_url'))}""", _LOCS)

_ROBOTS = """
robots_lines AS (
  SELECT site, i AS line_no, trim(regexp_replace(lines[i], '#.*$', '')) AS line, lines[i] = '' AS blank
  FROM (SELECT site, string_split(body, chr(10)) AS lines FROM robots_txt WHERE status BETWEEN 200 AND 299) r,
       (SELECT unnest(range(1, 1000)) AS i) g WHERE i <= len(lines)),
robots_grouped AS (
  SELECT site, line_no - 1 AS rule_pos, lower(trim(split_part(line, ':', 1))) AS name,
         trim(substr(line, instr(line, ':') + 1)) AS value,
         sum(CASE WHEN line ILIKE 'user-agent:%%' THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY line_no) AS group_id
  FROM robots_lines WHERE NOT blank),
robots_ruled AS (
  SELECT r.site, CAST(r.group_id AS BIGINT) AS group_id, a.value AS agents, r.rule_pos,
         r.name = 'allow' OR r.value = '' AS allow, r.value AS prefix
  FROM robots_grouped r JOIN robots_grouped a ON a.site = r.site AND a.group_id = r.group_id AND a.name = 'user-agent'
  WHERE r.name IN ('allow', 'disallow')),
robots_mine AS (
  SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY site ORDER BY agents = '*', group_id) AS choice
                 FROM robots_ruled WHERE agents = '*' OR contains('%s', lower(agents))) x WHERE choice = 1)""" % AGENT


def origin(u):
    return f"lower(regexp_extract({u}, '^([A-Za-z]+://[^/?#]*)', 1))"


def robots_ok(url: str, site: str) -> str:
    target = f"coalesce(nullif(regexp_extract({url}, '^[a-z]+://[^/?#]*(.*)$', 1), ''), '/')"
    return f"""coalesce((SELECT CASE WHEN t.status IN (401, 403) THEN false WHEN t.status BETWEEN 400 AND 499 THEN true
        WHEN t.status BETWEEN 200 AND 299 THEN coalesce((SELECT arg_min(m.allow, m.rule_pos) FROM robots_mine m
             WHERE m.site = {site} AND starts_with({target}, m.prefix)), true) ELSE false END
      FROM robots_txt t WHERE t.site = {site}), true)"""


ORACLES["robots_rules"] = _with(("robots_txt",), "SELECT * FROM robots_ruled", _ROBOTS)
ORACLES["robots_gate"] = _with(("pg", "robots_txt"), f"""
SELECT p.page_id, p.url, r.site, CASE WHEN r.status IN (401, 403) THEN 'deny_all' WHEN r.status BETWEEN 400 AND 499 THEN 'allow_all'
         WHEN r.status BETWEEN 200 AND 299 THEN 'parsed' ELSE 'unparsed' END AS robots_status,
       {robots_ok('p.url', origin('p.url'))} AS robots_ok
FROM pg p JOIN robots_txt r ON r.site = {origin('p.url')}""", _ROBOTS)

_SELECTABLE = f"""
verdict AS (
  SELECT q.seed_id, q.pos, q.url, CASE WHEN NOT {same_site(host('q.url'), 's.host')} THEN 'other_host'
         WHEN NOT {robots_ok('q.url', origin('s.url'))} THEN 'robots' ELSE 'ok' END AS reason
  FROM requests q JOIN seeds s USING (seed_id))"""
ORACLES["selectable_verdict"] = _with(
    ("requests", "seeds", "robots_txt"), "SELECT seed_id, pos, url, reason = 'ok' AS selectable, reason FROM verdict",
    _ROBOTS, _SELECTABLE)
ORACLES["selectable_summary"] = _with(("requests", "seeds", "robots_txt"), """
SELECT seed_id, count(*) FILTER (reason = 'ok') AS selectable, count(*) AS total FROM verdict GROUP BY seed_id""",
                                      _ROBOTS, _SELECTABLE)

_FINAL = """
final AS (
  SELECT * FROM (
    SELECT url, attempt, status, content_type, n_bytes,
           row_number() OVER (PARTITION BY url ORDER BY status IN (429, 502, 503, 504),
                              CASE WHEN status IN (429, 502, 503, 504) THEN -attempt ELSE attempt END) AS rn
    FROM fetch_log) x WHERE rn = 1)"""


def verdict_cte(source: str) -> str:
    return f"""
fetched AS (
  SELECT q.seed_id, q.pos, q.url, q.url AS final_url,
         CASE WHEN NOT {same_site(host('q.url'), 's.host')} THEN 'other_host'
              WHEN {first_seg('q.url')} IN ({_EXCLUDED}) THEN 'excluded_path'
              WHEN NOT {robots_ok('q.url', origin('s.url'))} THEN 'robots'
              WHEN f.status IS NULL THEN 'no_response'
              WHEN f.status IN (401, 403) THEN 'not_public'
              WHEN f.status NOT BETWEEN 200 AND 299 THEN 'http_' || f.status
              WHEN f.n_bytes > 2000000 THEN 'too_large'
              WHEN lower(f.content_type) NOT LIKE '%html%' THEN 'not_html' END AS error
  FROM {source} q JOIN seeds s USING (seed_id) LEFT JOIN final f ON f.url = q.url)"""


_FETCH_INPUTS = ("requests", "seeds", "robots_txt", "fetch_log")
ORACLES["fetch_verdict"] = _with(
    _FETCH_INPUTS, "SELECT seed_id, pos, url, final_url, error FROM fetched", _ROBOTS, _FINAL, verdict_cte("requests"))
ORACLES["ordered_output"] = ORACLES["fetch_verdict"] + " ORDER BY seed_id, pos"
ORACLES["export_summary"] = _with(_FETCH_INPUTS, """
SELECT seed_id, count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS failed, count(*) AS total
FROM fetched GROUP BY seed_id""", _ROBOTS, _FINAL, verdict_cte("requests"))
ORACLES["export_progress"] = _with(_FETCH_INPUTS, """
SELECT seed_id, pos, n AS index, ok, n - ok AS failed, CAST(floor(n * 100.0 / total + 0.5) AS BIGINT) AS percent
FROM (SELECT seed_id, pos, row_number() OVER w AS n, count(*) FILTER (error IS NULL) OVER w AS ok,
             count(*) OVER (PARTITION BY seed_id) AS total
      FROM fetched WINDOW w AS (PARTITION BY seed_id ORDER BY pos)) x""", _ROBOTS, _FINAL, verdict_cte("requests"))

# ----------------------------------------------------------------------------------- joins

ORACLES["same_site_join"] = _with(("pg", "seeds"), f"""
SELECT p.page_id, p.url, s.seed_id FROM pages p JOIN seeds s ON {same_site(host('p.url'), 's.host')}""")
ORACLES["public_ip_join"] = _with(("pg", "host_ips"), """
SELECT h.host, v.closed IS NOT NULL AS resolved, NOT coalesce(v.closed, true) AS public
FROM (SELECT DISTINCT host FROM pg) h LEFT JOIN verdicts v USING (host)""", _HOSTS_CLOSED)

_QUADS = "CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536" \
    " + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT)"
ORACLES["public_ip_join_networks"] = _with(("page_ips", "networks"), f"""
SELECT a.host, true AS resolved, NOT bool_or(a.ip IS NULL OR coalesce(v.closed, false)) AS public
FROM page_ips a LEFT JOIN (
  SELECT ip, arg_max(closed, len) AS closed FROM (
    SELECT i.ip, n.len, bool_or(n.closed) AS closed
    FROM (SELECT DISTINCT ip, {_QUADS.format('ip')} AS at FROM page_ips WHERE ip IS NOT NULL) i
    JOIN (SELECT DISTINCT closed, len, block, CAST({_QUADS.format('base')} AS BIGINT) // block AS first FROM (
            SELECT closed, split_part(network, '/', 1) AS base, CAST(split_part(network, '/', 2) AS INT) AS len,
                   CAST(pow(2, 32 - CAST(split_part(network, '/', 2) AS INT)) AS BIGINT) AS block FROM networks) b) n
      ON i.at // n.block = n.first
    GROUP BY i.ip, n.len) m GROUP BY ip) v ON v.ip = a.ip
GROUP BY a.host""")

_HREFS = """
all_hrefs AS (
  SELECT page_id, url, CAST(i - 1 AS BIGINT) AS link_pos, replace(hrefs[i], '&amp;', '&') AS href
  FROM (SELECT page_id, url, regexp_extract_all(
            regexp_replace(html, '(?is)<!--.*?-->|<script[ >].*?</script>|<style[ >].*?</style>', '', 'g'),
            '(?i)<a href=["'']([^"'']*)["'']', 1) AS hrefs FROM %s) p,
       (SELECT unnest(range(1, 100000)) AS i) g WHERE i <= len(hrefs))"""
ORACLES["page_links"] = _with((), "SELECT page_id, link_pos, href FROM all_hrefs", _HREFS % "pages")
ORACLES["resolve_page_links"] = _with(
    (), f"SELECT page_id, link_pos, {dst('url', 'href')} AS dst FROM all_hrefs", _HREFS % "pages")
_LINKED = """
linked AS (SELECT page_id, url, '<a href="' || replace(regexp_replace(url, '#.*', ''), '&', '&amp;') || '">self</a>'
                  || html || '<a href=''gone''>x</a>' AS html FROM pages)"""
_EDGES = f"""
page_edges AS (SELECT * FROM (SELECT page_id AS src_id, link_pos, {dst('url', 'href')} AS dst FROM all_hrefs) x WHERE {web('dst')}),
known AS (SELECT regexp_replace(url, '#.*', '') AS dst, min(page_id) AS dst_id FROM pages GROUP BY 1)"""
ORACLES["link_graph"] = _with(
    (), "SELECT src_id, link_pos, dst, dst_id FROM page_edges JOIN known USING (dst)",
    _LINKED, _HREFS % "linked", _EDGES)
ORACLES["dangling_targets"] = _with((), """
SELECT dst, count(*) AS n_links FROM page_edges e WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.dst = e.dst) GROUP BY dst""",
                                    _LINKED, _HREFS % "linked", _EDGES)


def crawl_ctes(name: str, seeds: str, answers: str, edges: str) -> str:
    """`name`: seed_id, depth, pos, url, final_url. All walks up to the depth, first visit kept."""
    return f"""
{name}_walk AS (
  SELECT s.seed_id, s.host, s.max_depth, s.max_pages, 0 AS depth, [CAST(0 AS BIGINT)] AS path, s.url, r.final_url
  FROM {seeds} s LEFT JOIN {answers} r ON r.url = s.url
  UNION ALL
  SELECT w.seed_id, w.host, w.max_depth, w.max_pages, w.depth + 1, list_append(w.path, CAST(e.link_pos AS BIGINT)), e.dst, r.final_url
  FROM {name}_walk w JOIN {edges} e ON e.src = w.final_url LEFT JOIN {answers} r ON r.url = e.dst
  WHERE w.depth < w.max_depth AND w.final_url IS NOT NULL AND {same_site(host('e.dst'), 'w.host')}),
{name}_first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, url ORDER BY depth, path) AS visit FROM {name}_walk) x
  WHERE visit = 1 AND final_url IS NOT NULL),
{name} AS (
  SELECT seed_id, CAST(depth AS BIGINT) AS depth, pos, url, final_url
  FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY depth, path) AS pos FROM {name}_first) x WHERE pos <= max_pages)"""


ORACLES["crawl_levels"] = _with(
    ("crawl_seeds", "crawl_responses", "edges"), "SELECT * FROM crawled",
    f"answers AS (SELECT url, final_url FROM crawl_responses WHERE {_ANSWERS})",
    crawl_ctes("crawled", "crawl_seeds", "answers", "edges"), recursive=True)


def expand_ctes(cap: str, where: str) -> str:
    """expanded: seed_id, guess, url, pos."""
    return _GUESSES + "," + _LOCS + f""",
tree AS (
  SELECT seed_id, guess, host, {cap} AS cap, sitemap_url, [CAST(0 AS BIGINT)] AS path, 0 AS level FROM guesses {where}
  UNION ALL
  SELECT t.seed_id, t.guess, t.host, t.cap, l.loc, list_append(t.path, CAST(l.pos AS BIGINT)), t.level + 1
  FROM tree t JOIN locs l USING (sitemap_url) WHERE l.is_index AND t.level < 10),
readings AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, guess, sitemap_url ORDER BY level, path) AS visit FROM tree) x
  WHERE visit = 1),
listed AS (
  SELECT r.seed_id, r.guess, r.cap, l.loc AS url,
         row_number() OVER (PARTITION BY r.seed_id, r.guess ORDER BY r.level, r.path, l.pos) AS n
  FROM readings r JOIN locs l USING (sitemap_url)
  WHERE NOT l.is_index AND regexp_matches(l.loc, '^https?:') AND {same_site(host('l.loc'), 'r.host')}),
expanded AS (SELECT seed_id, guess, url, min(n) AS pos FROM listed WHERE n <= cap GROUP BY seed_id, guess, url)"""


ORACLES["sitemap_expand"] = _with(
    ("seeds", "sitemaps"), "SELECT seed_id, guess, url, pos FROM expanded", expand_ctes("crawl_max_pages", ""), recursive=True)
ORACLES["sitemap_locs"] = _with(("sitemaps",), "SELECT sitemap_url, is_index, pos, loc FROM locs", _LOCS)
ORACLES["loc_distinct"] = _with(("sitemaps",), "SELECT sitemap_url, is_index, pos, loc FROM kept_locs", _LOCS)



def chain_ctes(source: str) -> str:
    """chain: url, current, hops, status, outcome parts; `last` rows are where each url ends."""
    return f"""
hop AS (
  SELECT r.url AS current, r.status, r.location, v.closed IS NULL AS lost, coalesce(v.closed, false) AS closed
  FROM {source} r LEFT JOIN verdicts v ON v.host = {host('r.url')}),
chain AS (
  SELECT h.current AS url, h.current, CAST(0 AS BIGINT) AS hops, CAST(h.status AS BIGINT) AS status, h.lost, h.closed, h.location,
         h.lost OR h.closed OR h.location IS NULL AS last, false AS endless FROM hop h
  UNION ALL
  SELECT c.url, CASE WHEN c.hops = 8 THEN c.current ELSE h.current END, CASE WHEN c.hops = 8 THEN 8 ELSE c.hops + 1 END,
         CASE WHEN c.hops = 8 THEN c.status ELSE h.status END, h.lost, h.closed, h.location,
         c.hops = 8 OR h.lost OR h.closed OR h.location IS NULL, c.hops = 8
  FROM chain c JOIN hop h ON h.current = c.location WHERE NOT c.last),
ends AS (
  SELECT url, current AS final_url, hops, status, CASE WHEN endless THEN 'too_many_redirects' WHEN lost THEN 'unresolved'
         WHEN closed THEN 'closed_network' ELSE 'ok' END AS outcome FROM chain WHERE last)"""


ORACLES["redirect_resolve"] = _with(
    ("redirects", "host_ips"), "SELECT url, final_url, hops, status, outcome FROM ends",
    _HOSTS_CLOSED, chain_ctes("redirects"), recursive=True)

_HOPS = ("requests", "seeds", "robots_txt", "hop_log", "host_ips")
_BARE = "bare_requests AS (SELECT seed_id, pos, regexp_replace(url, '#.*', '') AS url FROM requests)"
_REDIRECTED = (_ROBOTS, _HOSTS_CLOSED, """
last_hops AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY status = 503, attempt) AS rn FROM hop_log) x WHERE rn = 1)""",
               chain_ctes("last_hops"), _BARE, f"""
redirected AS (
  SELECT q.seed_id, q.pos, q.url, e.final_url,
         CASE WHEN NOT {same_site(host('q.url'), 's.host')} THEN 'other_host'
              WHEN {first_seg('q.url')} IN ({_EXCLUDED}) THEN 'excluded_path'
              WHEN NOT {robots_ok('q.url', origin('s.url'))} THEN 'robots'
              WHEN e.url IS NULL THEN 'no_response' WHEN e.outcome <> 'ok' THEN e.outcome
              WHEN l.status IN (401, 403) THEN 'not_public'
              WHEN l.status NOT BETWEEN 200 AND 299 THEN 'http_' || l.status
              WHEN l.n_bytes > 2000000 THEN 'too_large'
              WHEN lower(l.content_type) NOT LIKE '%html%' THEN 'not_html' END AS error
  FROM bare_requests q JOIN seeds s USING (seed_id) LEFT JOIN ends e ON e.url = q.url LEFT JOIN last_hops l ON l.url = e.final_url)""")
ORACLES["fetch_verdict_redirects"] = _with(_HOPS, """
SELECT seed_id, pos, url, CASE WHEN error IS NULL THEN final_url ELSE url END AS final_url, error FROM redirected""",
                                           *_REDIRECTED, recursive=True)

_SITE_ANSWERS = f"site_answers AS (SELECT url, final_url FROM site_responses WHERE {_ANSWERS})"


def fallback_ctes(cap: str, where: str) -> str:
    """fallback: seed_id, url, pos, source."""
    return expand_ctes(cap, where) + f""",
best AS (SELECT seed_id, min(guess) AS guess FROM expanded GROUP BY seed_id),
unlisted AS (
  SELECT seed_id, url, host, 1 AS max_depth, {cap} AS max_pages FROM seeds
  {where} {'AND' if where else 'WHERE'} seed_id NOT IN (SELECT seed_id FROM best)),
{_SITE_ANSWERS},
{crawl_ctes('near', 'unlisted', 'site_answers', 'site_links')},
fallback AS (
  SELECT seed_id, url, pos, 'sitemap_' || guess AS source FROM expanded JOIN best USING (seed_id, guess)
  UNION ALL SELECT seed_id, final_url, min(pos), 'crawl_1' FROM near GROUP BY seed_id, final_url)"""


_SITE_INPUTS = ("seeds", "sitemaps", "site_responses", "site_links")
ORACLES["discovery_fallback"] = _with(
    _SITE_INPUTS, "SELECT seed_id, url, pos, source FROM fallback", fallback_ctes("crawl_max_pages", ""), recursive=True)
_MODE = fallback_ctes("CASE WHEN mode = 'auto' THEN 2000000000 ELSE crawl_max_pages END", "WHERE mode <> 'crawl'") + f""",
recrawl AS (
  SELECT seed_id, url, host, crawl_depth AS max_depth, crawl_max_pages AS max_pages FROM seeds
  WHERE mode = 'crawl' OR (mode = 'auto' AND (SELECT count(*) FROM fallback f WHERE f.seed_id = seeds.seed_id) < 3)),
{crawl_ctes('far', 'recrawl', 'site_answers', 'site_links')},
found AS (
  SELECT seed_id, url, pos, source FROM fallback WHERE seed_id NOT IN (SELECT seed_id FROM recrawl)
  UNION ALL SELECT seed_id, final_url, pos, 'crawl' FROM far)"""
ORACLES["discovery_mode"] = _with(_SITE_INPUTS, "SELECT seed_id, url, pos, source FROM found", _MODE, recursive=True)
ORACLES["discover_urls"] = _with((*_SITE_INPUTS, "robots_txt"), f"""
SELECT d.seed_id, d.pos, d.url, d.reason = 'ok' AS selectable, d.reason FROM (
  SELECT l.*, CASE WHEN NOT {same_site(host('l.url'), 's.host')} THEN 'other_host'
                   WHEN NOT {robots_ok('l.url', origin('s.url'))} THEN 'robots' ELSE 'ok' END AS reason
  FROM deduped l JOIN seeds s USING (seed_id)) d""", _MODE, f"""
scoped AS (SELECT seed_id, pos, url FROM found WHERE {first_seg('url')} NOT IN ({_EXCLUDED}))""",
                                 key_ctes("scoped"), """
deduped AS (
  SELECT seed_id, min(pos) AS pos, arg_min(url, {'r': lang_rank, 'u': url}) AS url FROM keyed GROUP BY seed_id, page_key)""",
                                 _ROBOTS, recursive=True)

# ---------------------------------------------------------------------------- aggregations

_QUOTA = """
e AS (SELECT *, CAST(ts AS DATE) AS day, regexp_extract(url, '//(?:www[.])?([^/]*)', 1) AS site_key FROM claim_events),
firsts AS (
  SELECT day, site_key, ts AS first_ts, event_id AS first_id FROM (
    SELECT *, row_number() OVER (PARTITION BY day, site_key ORDER BY ts, event_id) AS n FROM e WHERE op IN ('discover', 'scrape')) x
  WHERE n = 1),
accepted AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY first_ts, first_id) AS rank FROM firsts) x WHERE rank <= 20),
decided AS (
  SELECT e.event_id, e.ts, e.url, e.op, e.day, e.site_key, u.used,
    CASE WHEN e.op = 'check' THEN CASE WHEN a.rank <= u.used THEN 'already' WHEN u.used >= 20 THEN 'limit' ELSE 'ok' END
         WHEN a.rank IS NULL THEN 'limit' WHEN a.first_id = e.event_id THEN 'claimed'
         WHEN e.op = 'discover' THEN 'already' ELSE 'continued' END AS decision
  FROM e LEFT JOIN accepted a USING (day, site_key)
  JOIN (SELECT e.event_id, count(b.rank) AS used FROM e LEFT JOIN accepted b
          ON b.day = e.day AND (b.first_ts < e.ts OR (b.first_ts = e.ts AND b.first_id <= e.event_id)) GROUP BY e.event_id) u
    ON u.event_id = e.event_id)"""
_DECISIONS = """
SELECT * REPLACE (CAST(day AS VARCHAR) AS day), CASE WHEN decision IN ('already', 'limit') THEN greatest(1, CAST(floor(
    CASE WHEN ts = date_trunc('day', ts) THEN 0 ELSE epoch_us(CAST(day + 1 AS TIMESTAMP)) - epoch_us(ts) END / 1000000) AS BIGINT)) ELSE 0 END AS retry_after
FROM decided"""
ORACLES["quota_decisions"] = _with(("claim_events",), _DECISIONS, _QUOTA)
ORACLES["quota_decisions_stream"] = ORACLES["quota_decisions"]
ORACLES["first_claims_stream"] = _with(("claim_events",), "SELECT CAST(day AS VARCHAR) AS day, site_key FROM firsts", _QUOTA)
ORACLES["daily_site_usage"] = _with(("claim_events",), """
SELECT CAST(day AS VARCHAR) AS day, count(DISTINCT site_key) AS used, CAST(20 AS BIGINT) AS site_limit,
       greatest(0, 20 - count(DISTINCT site_key)) AS remaining FROM accepted GROUP BY day""", _QUOTA)
ORACLES["unseen_sites"] = _with(
    ("claim_events",), "SELECT CAST(day AS VARCHAR) AS day, site_key FROM e EXCEPT SELECT CAST(day AS VARCHAR), site_key FROM accepted", _QUOTA)
ORACLES["language_groups"] = _with(("language_variants",), """
SELECT page_key, count(*) AS n_variants, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') AS langs,
       arg_min(url, {'r': lang_rank, 'u': url}) AS url, min(pos) AS pos
FROM keyed GROUP BY page_key""", key_ctes("language_variants"))
ORACLES["retry_accounting"] = _with(("fetch_log",), """
SELECT url, count(*) AS attempts, CAST(sum(CASE WHEN status IN (429, 502, 503, 504) AND attempt < 7
         THEN least(120, CAST(pow(2, attempt) AS BIGINT) + 5) ELSE 0 END) AS BIGINT) AS wait_seconds
FROM fetch_log GROUP BY url""")

# -------------------------------------------------------------------------- windows, order

ORACLES["first_occurrence"] = _with(
    ("requests",), "SELECT seed_id, url, min(pos) AS pos FROM requests GROUP BY seed_id, url")
_DEDUPED = """
SELECT min(pos) AS pos, arg_min(url, {'r': lang_rank, 'u': url}) AS url FROM keyed GROUP BY page_key"""
ORACLES["language_dedupe"] = _with(("language_variants",), _DEDUPED, key_ctes("language_variants"))
ORACLES["language_dedupe_pages"] = _with(
    (), _DEDUPED, "numbered AS (SELECT page_id AS pos, url FROM pages)", key_ctes("numbered"))
ORACLES["final_attempt"] = _with(
    ("fetch_log",), "SELECT url, attempt, status, content_type, n_bytes FROM final", _FINAL)
ORACLES["cap_per_seed"] = _with(("requests", "seeds"), """
SELECT seed_id, pos, url FROM (
  SELECT r.*, s.crawl_max_pages, row_number() OVER (PARTITION BY r.seed_id ORDER BY pos) AS n
  FROM requests r JOIN seeds s USING (seed_id)) x WHERE n <= crawl_max_pages""")

# ------------------------------------------------------------------------------- documents


def _drop(expr: str) -> str:
    out = f"regexp_replace({expr}, '(?is)<!--.*?-->|<script[ >].*?</script>|<style[ >].*?</style>', '<!>', 'g')"
    for tag in ("noscript", "nav", "footer", "header"):
        out = f"regexp_replace({out}, '(?is)<{tag}[ >].*?</{tag}>', '<!>', 'g')"
    return out


def _plain(x: str) -> str:
    for name, char in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return f"trim({x}, {_BLANKS})"


def _nodes(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '<[^>]*>'), lambda t: {_plain('t')}), lambda t: t <> '')"


def text_ctes(source: str) -> str:
    """texts: all columns of `source` plus title and text."""
    return f"""
marked AS (SELECT *, {_drop('html')} AS m FROM {source}),
blocks AS (
  SELECT *, CASE WHEN contains(m, '<main>') THEN regexp_extract(m, '(?s)<main>(.*?)</main>', 1)
                 WHEN contains(m, '<article>') THEN regexp_extract(m, '(?s)<article>(.*?)</article>', 1)
                 ELSE regexp_extract(m, '(?s)<body>(.*)$', 1) END AS b
  FROM marked),
texts AS (
  SELECT * EXCLUDE (m, b, html),
         coalesce(nullif(array_to_string({_nodes("regexp_extract(b, '(?s)<h1>(.*?)</h1>', 1)")}, ''), ''),
                  {_plain("regexp_extract(m, '(?s)<title>(.*?)</title>', 1)")}) AS title,
         regexp_replace(array_to_string({_nodes('b')}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text
  FROM blocks)"""


ORACLES["page_text"] = _with(("page_variants",), "SELECT page_id, url, text FROM texts", text_ctes("page_variants"))
ORACLES["page_title"] = _with(("page_variants",), "SELECT page_id, url, title FROM texts", text_ctes("page_variants"))
ORACLES["page_site_text"] = _with(
    (), f"SELECT page_id, {site_key('url')} AS site_key, title, text FROM texts", text_ctes("pages"))

_EXPORTED = (
    key_ctes("requests"), """
wanted AS (
  SELECT seed_id, min(pos) AS pos, arg_min(url, {'r': lang_rank, 'u': url}) AS url FROM keyed GROUP BY seed_id, page_key)""",
    _ROBOTS, _FINAL, verdict_cte("wanted"), text_ctes("pages"), """
address_texts AS (
  SELECT regexp_replace(url, '#.*', '') AS address, arg_min(title, url) AS title, arg_min(text, url) AS text FROM texts GROUP BY 1),
exported AS (
  SELECT f.seed_id, f.pos, f.final_url AS url, t.title, t.text, f.error, f.url AS requested_url
  FROM fetched f LEFT JOIN address_texts t ON t.address = regexp_replace(f.url, '#.*', '') AND f.error IS NULL)""")
ORACLES["export_pages"] = _with(
    _FETCH_INPUTS, "SELECT seed_id, pos, url, title, text, error, requested_url FROM exported", *_EXPORTED)
ORACLES["export_pages_stored"] = ORACLES["export_pages"]
ORACLES["export_texts_stream"] = ORACLES["export_pages"]
ORACLES["export_joined_stream"] = ORACLES["export_pages"]
ORACLES["progress_stream"] = _with(_FETCH_INPUTS, """
SELECT seed_id, count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS failed, count(*) AS total
FROM fetched GROUP BY seed_id""", *_EXPORTED)
ORACLES["export_pages_redirects"] = _with(_HOPS, """
SELECT f.seed_id, f.pos, CASE WHEN f.error IS NULL THEN f.final_url ELSE f.url END AS url, t.title, t.text, f.error, f.url AS requested_url
FROM redirected f LEFT JOIN (
  SELECT regexp_replace(url, '#.*', '') AS address, arg_min(title, url) AS title, arg_min(text, url) AS text FROM texts GROUP BY 1) t
  ON t.address = f.final_url AND f.error IS NULL""", *_REDIRECTED, text_ctes("pages"), recursive=True)
ORACLES["export_ndjson"] = _with(_FETCH_INPUTS, """
SELECT s.url AS base_url, x.pos AS index, x.requested_url, x.url, x.title, x.text, x.error
FROM exported x JOIN seeds s USING (seed_id)""", *_EXPORTED)
ORACLES["export_site_documents"] = _with(_FETCH_INPUTS, """
SELECT regexp_extract(s.host, '^([^.]*)', 1) AS name, s.url AS base_url, CAST(floor(x.pos / 5000.0) AS BIGINT) AS part,
       row_number() OVER (PARTITION BY x.seed_id, floor(x.pos / 5000.0) ORDER BY x.pos) - 1 AS i,
       x.url, x.title, x.text, x.error
FROM exported x JOIN seeds s USING (seed_id)""", *_EXPORTED)

# ------------------------------------------------------------------------------------ gated flows


def gate_ctes(op: str) -> str:
    """gated: seed_id, url, reason of every seed asked for."""
    refused = "CASE WHEN n > 1 AND rank <= 20 THEN 'already' WHEN rank > 20 THEN 'limit' END" if op == "discover" else (
        "CASE WHEN rank > 20 THEN 'limit' END")
    return f"""
typed AS (
  SELECT a.seed_id, a.ts, CASE WHEN trim(a.raw) = '' THEN NULL WHEN a.raw LIKE '%localhost%' THEN a.raw
                               ELSE 'https://' || s.host || '/' END AS url, s.host
  FROM asked_seeds a JOIN seeds s ON s.seed_id = a.seed_id % 10000000),
tested AS (
  SELECT t.seed_id, t.ts, t.url, t.host, CASE WHEN t.url IS NULL THEN 'no_address' WHEN t.url LIKE '%localhost%' THEN 'blocked_host'
         WHEN v.closed IS NULL THEN 'unresolved' WHEN v.closed THEN 'closed_network' END AS reason
  FROM typed t LEFT JOIN verdicts v ON v.host = t.host),
turns AS (
  SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE), host ORDER BY ts, seed_id) AS n
  FROM tested WHERE reason IS NULL),
ranks AS (SELECT day, host, row_number() OVER (PARTITION BY day ORDER BY ts, seed_id) AS rank FROM turns WHERE n = 1),
gated AS (
  SELECT seed_id, url, {refused} AS reason FROM turns JOIN ranks USING (day, host)
  UNION ALL SELECT seed_id, url, reason FROM tested WHERE reason IS NOT NULL),
refused AS (SELECT * FROM gated WHERE reason IS NOT NULL)"""


_GATE = ("asked_seeds", "host_ips")
ORACLES["discover_gated"] = _with((*_SITE_INPUTS, "robots_txt", *_GATE), f"""
SELECT g.seed_id, d.pos, d.url, d.reason = 'ok' AS selectable, d.reason FROM (
  SELECT l.*, CASE WHEN NOT {same_site(host('l.url'), 's.host')} THEN 'other_host'
                   WHEN NOT {robots_ok('l.url', origin('s.url'))} THEN 'robots' ELSE 'ok' END AS reason
  FROM deduped l JOIN seeds s USING (seed_id)) d JOIN gated g ON g.seed_id % 10000000 = d.seed_id AND g.reason IS NULL
UNION ALL SELECT seed_id, 0, url, false, reason FROM refused""", _MODE, f"""
scoped AS (SELECT seed_id, pos, url FROM found WHERE {first_seg('url')} NOT IN ({_EXCLUDED}))""", key_ctes("scoped"), """
deduped AS (
  SELECT seed_id, min(pos) AS pos, arg_min(url, {'r': lang_rank, 'u': url}) AS url FROM keyed GROUP BY seed_id, page_key)""",
                                  _ROBOTS, _HOSTS_CLOSED, gate_ctes("discover"), recursive=True)
ORACLES["export_gated"] = _with((*_FETCH_INPUTS, *_GATE), """
SELECT x.seed_id, x.pos, x.url, x.title, x.text, x.error, x.requested_url FROM exported x
JOIN gated g ON g.seed_id = x.seed_id AND g.reason IS NULL
UNION ALL SELECT seed_id, 0, url, NULL, NULL, reason, NULL FROM refused""", *_EXPORTED, _HOSTS_CLOSED, gate_ctes("scrape"))
