"""The same queries as SQL over the same tables."""

from __future__ import annotations

from docquarry.settings import SearchSettings

PATH = "source || '/' || lang || '/' || doc_id || '.md'"

# Lines become paragraphs, every fourth line gets a heading, and offsets count code points.
PIECES = rf"""
lines AS (
    SELECT doc_id, {PATH} AS rel, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
    FROM documents),
headed AS (
    SELECT *, CAST(1 + ((i // 4) * 2) % 3 AS INT) AS lvl,
           coalesce(nullif(regexp_extract(line, '[\p{{L}}\p{{N}}]+(?: [\p{{L}}\p{{N}}]+){{0,2}}'), ''), 'Part') AS words
    FROM lines),
pieces AS (
    SELECT doc_id, rel, 2 * i AS k, true AS is_head, lvl, words, repeat('#', lvl) || ' ' || words AS piece FROM headed WHERE i % 4 = 0
    UNION ALL
    SELECT doc_id, rel, 2 * i + 1, false, 0, NULL, line FROM headed),
placed AS MATERIALIZED (
    SELECT *, coalesce(sum(length(piece) + 2) OVER before, 0) AS start,
           coalesce(sum(length(piece) + 2) OVER before, 0) + length(piece) + 1 AS stop,
           2 * row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS line_no,
           count(*) FILTER (is_head) OVER (PARTITION BY doc_id ORDER BY k) AS sec
    FROM pieces
    WINDOW before AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bodies AS MATERIALIZED (
    SELECT doc_id, any_value(rel) AS rel, string_agg(piece, chr(10) || chr(10) ORDER BY k) || chr(10) AS body,
           arg_min(words, k) AS title, arg_min(piece, k) FILTER (NOT is_head) AS first_par
    FROM pieces GROUP BY doc_id)"""

CHUNKS = rf"""{PIECES},
blocks AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY k) AS b FROM placed WHERE trim(piece) <> ''),
heads AS (
    SELECT doc_id, sec, k, lvl, words, regexp_replace(lower(words), ' +', '-', 'g') AS slug,
           last_value(CASE WHEN lvl = 1 THEN words END IGNORE NULLS) OVER up AS h1,
           last_value(CASE WHEN lvl = 2 THEN words END IGNORE NULLS) OVER up AS h2,
           max(CASE WHEN lvl = 1 THEN k END) OVER up AS p1, max(CASE WHEN lvl = 2 THEN k END) OVER up AS p2
    FROM placed WHERE is_head WINDOW up AS (PARTITION BY doc_id ORDER BY k)),
named AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY k) - 1 + CAST(slug = 'document' AS INT) AS nth,
           list_filter([CASE WHEN lvl > 1 THEN h1 END, CASE WHEN lvl > 2 AND p2 > coalesce(p1, -1) THEN h2 END, words],
                       lambda x: x IS NOT NULL) AS path
    FROM heads),
frags AS (SELECT *, slug || CASE WHEN nth > 0 THEN '-' || nth ELSE '' END AS base FROM named),
split(doc_id, sec, b, part_start, part, in_part, lone, start, stop, line_no) AS (
    SELECT doc_id, sec, b, start, 1, 1, is_head, start, stop, line_no FROM blocks WHERE b = 1
    UNION ALL
    SELECT s.doc_id, s.sec, s.b, CASE WHEN cut THEN s.start ELSE p.part_start END, p.part + CAST(cut AS INT),
           CASE WHEN cut THEN 1 ELSE p.in_part + 1 END, CASE WHEN cut THEN s.is_head ELSE p.lone END, s.start, s.stop, s.line_no
    FROM split p JOIN blocks s ON s.doc_id = p.doc_id AND s.sec = p.sec AND s.b = p.b + 1,
         LATERAL (SELECT s.stop - p.part_start > 4000 AND NOT (p.in_part = 1 AND p.lone AND s.stop - s.start > 4000) AS cut)),
parts AS (
    SELECT doc_id, sec, part, min(start) AS start, max(stop) AS stop, min(line_no) AS start_line, max(line_no) AS end_line,
           max(part) OVER (PARTITION BY doc_id, sec) AS part_count
    FROM split GROUP BY doc_id, sec, part),
chunks AS MATERIALIZED (
    SELECT 'doc://' || regexp_replace(d.rel, '\.[^./]*$', '') AS source_uri, d.title AS source_title, d.rel AS source_path,
           f.path, f.base AS section_fragment, f.base || CASE WHEN part_count > 1 THEN '~' || part ELSE '' END AS fragment,
           CAST(part AS INT) AS part, CAST(part_count AS INT) AS part_count,
           CAST(p.start_line AS INT) AS start_line, CAST(p.end_line AS INT) AS end_line,
           substr(body, CAST(p.start AS BIGINT) + 1, CAST(p.stop - p.start AS BIGINT)) AS content,
           'doc://' || regexp_replace(d.rel, '\.[^./]*$', '') || '#' || f.base || CASE WHEN part_count > 1 THEN '~' || part ELSE '' END AS chunk_id
    FROM parts p JOIN frags f USING (doc_id, sec) JOIN bodies d USING (doc_id))"""


def labels(path: str) -> str:
    """Words of a path, camel case split, first occurrence kept."""
    spaced = rf"regexp_replace(regexp_replace({path}, '\.[^./]*$', ''), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g')"
    words = rf"list_filter(list_transform(regexp_split_to_array({spaced}, '[/\-_\s]+'), lambda w: lower(w)), lambda w: w <> '')"
    return f"list_filter({words}, lambda w, n: list_position({words}, w) = n)"


LABELLED = rf"""{CHUNKS},
fielded AS (
    SELECT chunk_id, source_uri, 'content' AS field, content AS text FROM chunks
    UNION ALL SELECT chunk_id, source_uri, 'source_title', source_title FROM chunks
    UNION ALL SELECT chunk_id, source_uri, 'heading_path', array_to_string(path, ' ') FROM chunks
    UNION ALL SELECT chunk_id, source_uri, 'path_labels', array_to_string({labels("source_path")}, ' ') FROM chunks),
tokens AS (SELECT chunk_id, source_uri, field, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM fielded),
postings AS MATERIALIZED (
    SELECT field, term, chunk_id, source_uri, count(*) AS tf, sum(count(*)) OVER (PARTITION BY field, chunk_id) AS field_length
    FROM tokens GROUP BY field, term, chunk_id, source_uri),
dictionary AS MATERIALIZED (SELECT field, term, count(*) AS df FROM postings GROUP BY field, term),
qtokens AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS query_term FROM benchmark),
qterms AS MATERIALIZED (
    SELECT query_id, query_term, count(*) AS repeats, sum(count(*)) OVER (PARTITION BY query_id) AS token_count
    FROM qtokens GROUP BY query_id, query_term)"""

# Distance 1 in code points: equal, one deletion either way, or the same rest around one position.
NEAR = """
words AS (SELECT DISTINCT term FROM dictionary),
asked AS (SELECT DISTINCT query_term FROM qterms),
word_cuts AS (SELECT term, length(term) AS n, i, substr(term, 1, i - 1) || substr(term, i + 1) AS rest
              FROM words, LATERAL (SELECT unnest(range(1, length(term) + 1)) AS i)),
asked_cuts AS (SELECT query_term, length(query_term) AS n, i, substr(query_term, 1, i - 1) || substr(query_term, i + 1) AS rest
               FROM asked, LATERAL (SELECT unnest(range(1, length(query_term) + 1)) AS i)),
near AS MATERIALIZED (
    SELECT query_term, term, CAST(min(distance) AS INT) AS distance FROM (
        SELECT query_term, term, 0 AS distance FROM asked JOIN words ON term = query_term
        UNION ALL SELECT query_term, term, 1 FROM asked_cuts a JOIN words w ON w.term = a.rest
        UNION ALL SELECT query_term, term, 1 FROM asked a JOIN word_cuts w ON a.query_term = w.rest
        UNION ALL SELECT query_term, term, 1 FROM asked_cuts a JOIN word_cuts w ON a.n = w.n AND a.i = w.i AND a.rest = w.rest)
    GROUP BY query_term, term)"""


def exact_sum(value: str) -> str:
    return f"(sum(CAST(round({value} * 70368744177664.0) AS BIGINT)) / 70368744177664.0)"


def scored(boosts: dict[str, float], fuzzy: bool) -> str:
    clauses = ", ".join(f"('{field}', CAST({boost} AS DOUBLE), {int(fuzzy and field != 'path_labels')})" for field, boost in boosts.items() if boost > 0)
    near = f",{NEAR}" if fuzzy else ""
    expanded = "UNION ALL SELECT w.*, n.term, n.distance FROM wanted w JOIN near n USING (query_term) WHERE edits > 0" if fuzzy else ""
    return rf"""{LABELLED}{near},
clauses(field, boost, edits) AS (VALUES {clauses}),
wanted AS (SELECT * FROM qterms, clauses),
cand AS (SELECT w.*, w.query_term AS term, 0 AS distance FROM wanted w WHERE edits = 0 {expanded}),
leaves AS MATERIALIZED (
    SELECT c.*, 1 + ln((SELECT count(*) FROM chunks) / (coalesce(d.df, 0) + 1.0)) AS idf
    FROM cand c LEFT JOIN dictionary d USING (field, term) WHERE edits = 0 OR d.df IS NOT NULL),
norms AS (SELECT query_id, 1 / sqrt(sum(repeats * pow(boost / (1.0 + distance) * idf, 2))) AS norm FROM leaves GROUP BY query_id),
sized AS (SELECT l.*, norm, count(*) OVER (PARTITION BY query_id, field, query_term) AS leaf_count FROM leaves l JOIN norms USING (query_id)),
leaf AS (
    SELECT s.query_id, s.field, s.query_term, s.repeats, s.token_count, s.leaf_count, p.chunk_id, p.source_uri,
           sqrt(p.tf) / sqrt(p.field_length) * (s.idf * (s.boost / (1.0 + s.distance) * s.idf) * s.norm) AS leaf
    FROM sized s JOIN postings p USING (field, term)),
term_scores AS (
    SELECT query_id, chunk_id, source_uri, field, query_term, repeats, token_count, {exact_sum("leaf")} * count(*) / leaf_count AS term_score
    FROM leaf GROUP BY query_id, chunk_id, source_uri, field, query_term, repeats, token_count, leaf_count),
field_scores AS MATERIALIZED (
    SELECT query_id, chunk_id, source_uri, field, {exact_sum("repeats * term_score")} * sum(repeats) / token_count AS field_score,
           sum(repeats) = token_count AS every_term
    FROM term_scores GROUP BY query_id, chunk_id, source_uri, field, token_count),
scores AS (
    SELECT query_id, chunk_id, source_uri, {exact_sum("field_score")} * count(*) / (SELECT count(*) FROM clauses) AS score
    FROM field_scores GROUP BY query_id, chunk_id, source_uri),
ranked AS MATERIALIZED (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_uri, chunk_id) AS INT) AS rank FROM scores)"""


def top(boosts: dict[str, float], fuzzy: bool, limit: int = 25) -> str:
    return f"WITH RECURSIVE {scored(boosts, fuzzy)} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= {limit}"


def capped(source: str, cap: int, limit: int) -> str:
    return f"""capped AS (
    SELECT *, row_number() OVER (PARTITION BY query_id, src ORDER BY rank) AS nth
    FROM (SELECT *, {source} AS src FROM ranked)),
page AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS position FROM capped WHERE nth <= {cap}
         QUALIFY position <= {limit})"""


def extracts(hits: str) -> str:
    """(query_id, chunk_id, snippet) of the rows of ``hits`` (query_id, chunk_id): the window of 200 characters with most distinct terms, marked."""
    return rf"""x_asked AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS terms FROM benchmark),
x_tokens AS (
    SELECT query_id, chunk_id, size, generate_subscripts(t, 1) AS i, unnest(t) AS w
    FROM (SELECT query_id, chunk_id, length(content) AS size, regexp_extract_all(content, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS t FROM {hits} JOIN chunks USING (chunk_id))),
x_placed AS (
    SELECT x_tokens.*, sum(length(w)) OVER (PARTITION BY query_id, chunk_id ORDER BY i) - length(w) AS a, list_contains(terms, lower(w)) AS hit
    FROM x_tokens JOIN x_asked USING (query_id)),
x_spans AS (SELECT query_id, chunk_id, size, a, a + length(w) AS b, lower(w) AS term FROM x_placed WHERE hit),
x_windows AS (
    SELECT x.query_id, x.chunk_id, x.size, x.a AS s, max(y.b) - x.a AS shown, count(DISTINCT y.term) AS d
    FROM x_spans x JOIN x_spans y ON x.query_id = y.query_id AND x.chunk_id = y.chunk_id AND y.a >= x.a AND (y.b <= x.a + 200 OR y.a = x.a)
    GROUP BY x.query_id, x.chunk_id, x.size, x.a QUALIFY row_number() OVER (PARTITION BY x.query_id, x.chunk_id ORDER BY count(DISTINCT y.term) DESC, x.a) = 1),
x_cuts AS (
    SELECT query_id, chunk_id, size, greatest(0, least(s - (greatest(200, shown) - shown) // 2, size - greatest(200, shown))) AS begins, greatest(200, shown) AS wide
    FROM x_windows),
x_shown AS (
    SELECT p.query_id, p.chunk_id, p.i, c.begins, c.size, least(c.size, c.begins + c.wide) AS ends,
           substr(w, CAST(greatest(begins - a, 0) + 1 AS BIGINT), CAST(least(a + length(w), least(c.size, c.begins + c.wide)) - greatest(a, begins) AS BIGINT)) AS part,
           hit AND a >= begins AND a + length(w) <= least(c.size, c.begins + c.wide) AS marked
    FROM x_placed p JOIN x_cuts c ON p.query_id = c.query_id AND p.chunk_id = c.chunk_id
    WHERE a < least(c.size, c.begins + c.wide) AND a + length(w) > begins),
snippets AS (
    SELECT query_id, chunk_id, CASE WHEN begins > 0 THEN '…' ELSE '' END
           || string_agg(CASE WHEN marked THEN '<mark>' || part || '</mark>' ELSE part END, '' ORDER BY i) || CASE WHEN ends < size THEN '…' ELSE '' END AS snippet
    FROM x_shown GROUP BY query_id, chunk_id, begins, ends, size)"""


BOOSTS = SearchSettings().boosts()
EXACT = scored(BOOSTS, False)
SUMMARY = f"""{PIECES},
sources AS (SELECT doc_id, rel, 'doc://' || regexp_replace(rel, '\\.[^./]*$', '') AS uri, title AS name, body,
                   substr(trim(first_par), 1, 200) AS description FROM bodies)"""

LINKS = r"""
page_links AS (
    SELECT page_id, regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', '[\2](../site\1#top)', 'g') AS content FROM pages),
targets AS (SELECT DISTINCT regexp_extract(html, 'href="(/[^"]*)"', 1) AS h FROM pages WHERE regexp_extract(html, 'href="(/[^"]*)"', 1) <> ''),
links AS (
    SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS position, unnest(l) AS link
    FROM (SELECT page_id, regexp_extract_all(content, '!?\[([^\]]*)\]\(([^)\s]+)(\s+"[^"]*")?\)') AS l FROM page_links)),
detail AS (
    SELECT *, regexp_extract(link, '\[([^\]]*)\]', 1) AS label, regexp_extract(link, '\]\(([^)\s]+)', 1) AS target,
           '/site' || regexp_extract(link, '\]\(\.\./site([^)#\s]*)', 1) AS resolved
    FROM links)"""


def digest(rows: str) -> str:
    """``rows`` selects (key, record)."""
    return f"""WITH {rows},
    hashed AS (SELECT sha256(key) AS place, key, sha256(record) AS part FROM records),
    narrow AS (SELECT substr(place, 1, 6) AS place, sha256(string_agg(part, chr(10) ORDER BY key, part)) AS part FROM hashed GROUP BY 1),
    wide AS (SELECT substr(place, 1, 3) AS place, sha256(string_agg(part, chr(10) ORDER BY narrow.place)) AS part FROM narrow GROUP BY 1)
    SELECT sha256(coalesce(string_agg(part, chr(10) ORDER BY place), '')) AS digest FROM wide"""


def _any_vs_all() -> str:
    counts = [
        f"SELECT query_id, '{field}' AS field, '{word}' AS operator, count(*) AS matches FROM field_scores "
        f"WHERE field = '{field}' AND {test} GROUP BY query_id"
        for field in ("source_title", "heading_path", "content")
        for word, test in (("any", "true"), ("all", "every_term"))
    ]
    return f"WITH RECURSIVE {EXACT} " + " UNION ALL ".join(counts)


ORACLE: dict[str, str] = {
    "source_listing": f"WITH {SUMMARY} SELECT uri, name, description, 'text/markdown' AS mime_type FROM sources",
    "source_records": f"""WITH {SUMMARY} SELECT uri AS id, uri, rel AS relative_path, '/corpus/' || rel AS file_path,
        CAST(1 AS INT) AS body_start_line, CAST(length(body) AS INT) AS content_length, sha256(body) AS fingerprint FROM sources""",
    "source_uri": r"""SELECT page_id, 'doc://' || regexp_replace(regexp_extract(url, '^https?://[^/]+/(.*)$', 1), '\.[^./]*$', '') AS uri FROM pages""",
    "addressable_uris": r"""SELECT page_id, href, page_id % 3 = 2 AND NOT regexp_matches(host, '[ \\^`{|}%]') AS addressable
        FROM (SELECT page_id, href, regexp_extract(href, '^/([^/?#]*)', 1) AS host
              FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages))""",
    "path_labels": f"""SELECT p_partkey, array_to_string({labels("path")}, ',') AS labels
        FROM (SELECT p_partkey, p_type || '/' || replace(p_name, ' ', 'Size') || '_' || p_brand || '-' || p_type || '.md' AS path FROM part)""",
    "description_200": "SELECT conv_id, turn, substr(text, 1, 200) AS description FROM conversations",
    "markdown_paths": """SELECT path, lower(path) LIKE '%.md' OR lower(path) LIKE '%.markdown' AS is_markdown
        FROM (SELECT source || '/' || doc_id || ['.md', '.MARKDOWN', '.txt', '.md.bak'][doc_id % 4 + 1] AS path FROM documents)""",
    "glob_include_exclude": f"""SELECT relative_path, size FROM (SELECT {PATH} AS relative_path, strlen(text) AS size FROM documents)
        WHERE (regexp_full_match(relative_path, 'src1[^/]*/.*[.]md') OR regexp_full_match(relative_path, 'src[2-4]/(en|de)/[^/]+[.]md'))
          AND NOT regexp_matches(relative_path, '(^|/)fr/') AND NOT regexp_matches(relative_path, '^src1[^/]/es/[^/]*$')""",
    "doc_fingerprint": "SELECT doc_id, sha256(text) AS fingerprint FROM documents",
    "frontmatter_metadata": f"""WITH {PIECES}
        SELECT 'doc://' || regexp_replace(rel, '\\.[^./]*$', '') AS uri,
               CASE WHEN doc_id % 4 = 0 THEN 'Doc ' || doc_id ELSE title END AS name,
               CASE WHEN doc_id % 4 = 0 THEN split_part(rel, '/', 2) || ',' || split_part(rel, '/', 1) ELSE '' END AS keywords,
               CAST([6, 5, 3, 1][doc_id % 4 + 1] AS INT) AS body_start_line, CAST(length(body) AS INT) AS content_length FROM bodies""",
    "legacy_selection": f"""SELECT 'doc://' || source || '/' || lang || '/' || doc_id AS uri, 'Doc' AS name, 'From ' || source AS description
        FROM documents WHERE doc_id % 3 = 0""",
    "chunk_catalog": f"""WITH RECURSIVE {CHUNKS} SELECT chunk_id, source_uri AS source_id, source_uri, chunk_id AS chunk_uri, source_title, source_path,
        array_to_string({labels("source_path")}, ' > ') AS path_labels, array_to_string(path, ' > ') AS heading_path, section_fragment, fragment,
        part, part_count, start_line, end_line, content, '' AS keywords FROM chunks""",
    "heading_path": f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, array_to_string(path, ' > ') AS heading_path FROM chunks",
    "slug_fragments": f"WITH RECURSIVE {CHUNKS} SELECT DISTINCT source_uri, section_fragment FROM chunks",
    "greedy_split": f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, part, part_count, CAST(length(content) AS INT) AS length FROM chunks",
    "block_ranges": r"""WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
        sized AS (SELECT *, [5, 4, 3, 3, 2, 2, 1, 1][n % 8 + 1] AS size, regexp_extract(line, '[\p{L}\p{N}]+(?: [\p{L}\p{N}]+){0,2}') AS w FROM lines),
        placed AS (SELECT *, sum(size + 1) OVER (PARTITION BY doc_id ORDER BY n) - size AS start_line FROM sized)
        SELECT doc_id, CAST(n AS INT) AS n, ['fence', 'list', 'table', 'html', 'heading', 'quote', 'code', 'paragraph'][n % 8 + 1] AS kind,
               CAST(start_line AS INT) AS start_line, CAST(start_line + size - 1 AS INT) AS end_line, CASE WHEN n % 8 = 4 THEN 2 ELSE 0 END AS level,
               CASE WHEN n % 8 <> 4 THEN '' WHEN w = '' THEN 'Part' ELSE w END AS text FROM placed""",
    "chunk_stream": f"""WITH RECURSIVE {CHUNKS} SELECT chunk_id AS chunk_uri, CAST(length(content) AS INT) AS content_length, CAST(start_line AS INT) AS start_line FROM chunks""",
    "crlf_chunks": f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, start_line, end_line, md5(content) AS content_md5 FROM chunks",
    "duplicate_identity": "SELECT 'doc://' || sha256(text) AS uri FROM documents GROUP BY text HAVING count(*) > 1",
    "chunk_home": f"""WITH RECURSIVE {CHUNKS} SELECT chunk_id, source_uri AS home_uri,
        CASE WHEN source_uri LIKE '%7' THEN '' ELSE source_title END AS home_name,
        CASE WHEN source_uri LIKE '%7' THEN '' ELSE source_path END AS home_path FROM chunks""",
    "document_stream": f"WITH {SUMMARY} SELECT uri, name, CAST(length(body) AS INT) AS content_length, '' AS keywords FROM sources",
    "read_section": f"""WITH RECURSIVE {CHUNKS} SELECT source_uri || '#' || section_fragment AS section_uri,
        string_agg(content, chr(10) || chr(10) ORDER BY part) AS content FROM chunks GROUP BY 1""",
    "read_addresses": f"""WITH RECURSIVE {CHUNKS},
        whole AS (SELECT 'doc://' || regexp_replace(rel, '\\.[^./]*$', '') AS uri, body FROM bodies)
        SELECT uri, 'document' AS kind, md5(body) AS content_md5 FROM whole
        UNION ALL SELECT uri || '#nowhere', 'unknown fragment', NULL FROM whole
        UNION ALL SELECT 'x' || uri, 'unknown resource', NULL FROM whole
        UNION ALL SELECT chunk_id, 'chunk', md5(content) FROM chunks
        UNION ALL SELECT source_uri || '#' || section_fragment, 'section', md5(string_agg(content, chr(10) || chr(10) ORDER BY part))
                  FROM chunks WHERE part_count > 1 GROUP BY 1""",
    "breadcrumbs": f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, source_path || ' > ' || array_to_string(path, ' > ') AS breadcrumb FROM chunks",
    "link_extract": f"WITH {LINKS} SELECT page_id, position, label, target, '#top' AS fragment, resolved FROM detail",
    "link_resolve": f"""WITH {LINKS} SELECT page_id, position, 'doc://site' || h AS target_uri
        FROM detail LEFT JOIN targets ON resolved = '/site' || h""",
    "link_rewrite": rf"""WITH {LINKS},
        numbered AS (SELECT page_id, generate_subscripts(t, 1) AS n, unnest(t) AS part
                     FROM (SELECT page_id, string_split_regex(content, '!?\[([^\]]*)\]\(([^)\s]+)(\s+"[^"]*")?\)') AS t FROM page_links)),
        swapped AS (SELECT d.page_id, position + 1 AS n, CASE WHEN h IS NULL THEN link ELSE '[' || label || '](doc://site' || h || '#top)' END AS link
                    FROM detail d LEFT JOIN targets ON resolved = '/site' || h)
        SELECT page_id, string_agg(part || coalesce(link, ''), '' ORDER BY n) AS content
        FROM numbered LEFT JOIN swapped USING (page_id, n) GROUP BY page_id""",
    "listing_digests": digest(
        f"records AS (SELECT {PATH} AS key, {PATH} || chr(0) || strlen(text) || chr(0) || doc_id * 1000000007 AS record FROM documents)"
    ),
    "content_digests": digest(f"{SUMMARY}, records AS (SELECT uri AS key, uri || chr(0) || sha256(body) AS record FROM sources)"),
    "listing_changes": f"""WITH numbers AS (SELECT doc_id, 'doc://' || source || '/' || lang || '/' || doc_id AS uri FROM documents)
        SELECT uri, 'removed' AS change FROM numbers WHERE doc_id % 7 = 0
        UNION ALL SELECT uri, 'changed' FROM numbers WHERE doc_id % 7 <> 0 AND doc_id % 11 = 0
        UNION ALL SELECT uri || '-new', 'added' FROM numbers WHERE doc_id % 13 = 0""",
    "incremental_refresh": f"""SELECT {PATH} AS relative_path, strlen(text) AS size, doc_id * 1000000007 + 1 AS mtime_ns
        FROM documents WHERE doc_id % 5 = 0 AND doc_id % 9 <> 0""",
    "postings": f"""WITH RECURSIVE {LABELLED} SELECT field, term, chunk_id, CAST(tf AS INT) AS tf, CAST(field_length AS INT) AS field_length FROM postings""",
    "dictionary": f"WITH RECURSIVE {LABELLED} SELECT field, term, df FROM dictionary",
    "collection_size": f"WITH RECURSIVE {CHUNKS} SELECT count(*) AS chunks FROM chunks",
    "fuzzy_expand": f"WITH RECURSIVE {LABELLED},{NEAR} SELECT query_term, term, distance FROM near",
    "tfidf_search": top({"content": 1.0}, False),
    "multi_field_search": top(BOOSTS, False),
    "fuzzy_search": top(BOOSTS, True),
    "search_hits": f"""WITH RECURSIVE {EXACT}, hits AS (SELECT query_id, rank, chunk_id, score FROM ranked WHERE rank <= 10), {extracts("hits")}
        SELECT h.query_id, rank, chunk_id, source_uri AS source_id, source_uri, chunk_id AS chunk_uri, source_title, source_path,
               array_to_string(path, ' > ') AS heading_path, start_line, end_line, round(score, 6) AS score, coalesce(snippet, content) AS snippet, content
        FROM hits h JOIN chunks USING (chunk_id) LEFT JOIN snippets n USING (query_id, chunk_id)""",
    "delta_search": top(BOOSTS, False),
    "streamed_search": top(BOOSTS, True),
    "match_all": f"""WITH RECURSIVE {CHUNKS}, ordered AS (SELECT chunk_id, CAST(row_number() OVER (ORDER BY source_uri, chunk_id) AS INT) AS rank FROM chunks)
        SELECT item_id AS query_id, rank, chunk_id, CAST(1.0 AS DOUBLE) AS score FROM benchmark, ordered WHERE rank <= 25""",
    "any_vs_all": _any_vs_all(),
    "diversity_cap_1": f"WITH RECURSIVE {EXACT}, {capped('source_uri', 1, 10)} SELECT query_id, position, chunk_id FROM page",
    "diversity_cap_2": f"WITH RECURSIVE {EXACT}, {capped('source_uri', 2, 10)} SELECT query_id, position, chunk_id FROM page",
    "flooded_page": f"""WITH RECURSIVE {EXACT}, {capped("CASE WHEN NOT regexp_matches(source_uri, '[05]$') THEN 'doc://flood' ELSE source_uri END", 1, 2)}
        SELECT query_id, position, chunk_id FROM page""",
    "page_texts": f"""WITH RECURSIVE {EXACT}, {capped('source_uri', 1, 10)}, {extracts("page")},
        texts AS (
            SELECT query_id, string_agg('- **' || source_title || '** · [' || chunk_id || '](' || chunk_id || ')' || chr(10)
                || '  - ' || source_path || ' > ' || array_to_string(path, ' > ') || ' · lines ' || start_line || '-' || end_line
                || ' · score ' || printf('%.2f', score) || chr(10) || '  - ' || coalesce(snippet, content) || chr(10)
                || chr(10) || content || chr(10) || chr(10), '' ORDER BY position) AS body
            FROM page JOIN chunks USING (chunk_id) LEFT JOIN snippets USING (query_id, chunk_id) GROUP BY query_id)
        SELECT item_id AS query_id, CASE WHEN body IS NULL THEN 'No results found for ''' || text || ''''
            ELSE 'Search results for ''' || text || ''':' || chr(10) || chr(10) || body END AS page
        FROM benchmark LEFT JOIN texts ON query_id = item_id""",
    "prompt_render": """SELECT doc_id, 'Review ' || doc_id || ' from ' || source || '.'
        || CASE WHEN lang <> 'en' THEN ' Answer in ' || lang || '.' ELSE ' Any language.' END || text || 'End.' AS rendered FROM documents""",
}
