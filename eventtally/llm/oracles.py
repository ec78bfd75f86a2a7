"""SQL for the queries that SQL can express, on the same tables."""

from __future__ import annotations

from eventtally.llm import line_dedup

ORACLES = {
    "op1_url_filters": r"""
        WITH urls AS (
            SELECT DISTINCT url, rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.') AS host
            FROM pages WHERE url IS NOT NULL
        ), hosts AS (
            SELECT host, ('0x' || substr(md5(host), 1, 7))::BIGINT AS mark, string_split(host, '.') AS labels
            FROM (SELECT DISTINCT host FROM urls WHERE host <> '')
        ), paths AS (
            SELECT host, ('0x' || substr(md5(url), 1, 7))::BIGINT AS mark,
                   regexp_extract(url, '^[^:]*://[^/?#]*/([^/?#]+)', 1) AS segment
            FROM urls WHERE host <> ''
        ), entries AS (
            SELECT 'hosts' AS list, 'host' AS kind, host AS value, 'block' AS verdict, 'add' AS action, 1704067200 + mark % 1209600 AS since
            FROM hosts WHERE mark % 3 = 0
            UNION ALL
            SELECT 'hosts', 'host', host, 'block', 'remove', 1704067200 + mark % 1209600 + 432000 FROM hosts WHERE mark % 6 = 0
            UNION ALL
            SELECT 'domains', 'domain', array_to_string(labels[greatest(len(labels) - 2, 1):], '.'), 'block', 'add', 1704067200 + mark % 2419200
            FROM hosts WHERE mark % 5 = 0
            UNION ALL
            SELECT 'paths', 'prefix', host || '/' || segment, 'allow', 'add', 1704067200 + mark % 2419200
            FROM paths WHERE mark % 7 = 0 AND segment <> ''
        ), captures AS (
            SELECT page_id, 1704067200 + (page_id * 483059) % 2419200 AS fetched_at,
                   regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
                   rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.') AS host
            FROM pages
        ), states AS (
            SELECT DISTINCT c.page_id, c.fetched_at, e.list, e.kind, e.value,
                   max(e.since) OVER (PARTITION BY c.page_id, e.list, e.kind, e.value) AS newest, e.since, e.action, e.verdict
            FROM captures c JOIN entries e ON e.since <= c.fetched_at AND (
                (e.kind = 'host' AND e.value = c.host)
                OR (e.kind = 'domain' AND (e.value = c.host OR ends_with(c.host, '.' || e.value)))
                OR (e.kind = 'prefix' AND starts_with(c.host || c.path || '/', e.value || '/')))
        ), active AS (
            SELECT page_id, list, kind, value, since, min(verdict) AS verdict FROM states WHERE since = newest
            GROUP BY page_id, list, kind, value, since HAVING min(action) = 'add'
        ), ranked AS (
            SELECT *, count(*) OVER (PARTITION BY page_id) AS n_active, row_number() OVER (
                PARTITION BY page_id
                ORDER BY length(value) DESC, CASE kind WHEN 'prefix' THEN 0 WHEN 'host' THEN 1 ELSE 2 END, verdict <> 'block', list
            ) AS place
            FROM active
        )
        SELECT c.page_id, c.fetched_at, coalesce(r.verdict, CASE WHEN coalesce(c.host, '') = '' THEN 'no_url' ELSE 'none' END) AS verdict,
               r.list, r.kind, r.value, r.since AS listed_at, coalesce(r.n_active, 0) AS n_active
        FROM captures c LEFT JOIN ranked r ON c.page_id = r.page_id AND r.place = 1
    """,
    "op6_topk": """
        WITH whole AS (
            SELECT vec_id, embedding FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), weights AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w FROM whole
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
            FROM weights q JOIN weights c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op9_line_dedup": f"""
        WITH lines AS (
            SELECT rowid AS page, doc_id, source, i, lines[i] AS line, trim(lines[i]) AS bare
            FROM (SELECT rowid, doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS i
                  FROM (SELECT row_number() OVER () AS rowid, doc_id, source, string_split(text, chr(10)) AS lines FROM documents))
        ), totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
        marked AS (
            SELECT source, bare FROM lines JOIN totals USING (source) WHERE bare <> ''
            GROUP BY source, bare, pages
            HAVING count(DISTINCT page) >= {line_dedup.LEAST_PAGES} AND count(DISTINCT page) > pages * CAST({line_dedup.BOILERPLATE_RATIO} AS DOUBLE)
        ), judged AS (
            SELECT l.*, m.bare IS NOT NULL AS dropped FROM lines l LEFT JOIN marked m ON l.source = m.source AND l.bare = m.bare
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY page, doc_id
    """,
    "op11_lexical_search": r"""
        WITH doc_terms AS (
            SELECT page, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS page, doc_id, text FROM documents)
        ), lengths AS (SELECT page, doc_id, count(*) AS n FROM doc_terms GROUP BY page, doc_id),
        sums AS (SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM lengths),
        found AS (SELECT page, term, count(*) AS tf FROM doc_terms GROUP BY page, term),
        weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_all) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM found, sums GROUP BY term
        ), asked AS (
            SELECT DISTINCT item, item_id, term
            FROM (
                SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)
            )
        ), scored AS (
            SELECT item, item_id, doc_id, page,
                   CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_all) // l_all))))) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN found USING (term) JOIN lengths USING (page), sums
            GROUP BY item, item_id, doc_id, page
        ), ranked AS (
            SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
            FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
    "op13_fill_in_middle": """
        WITH hashed AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), numbers AS (
            SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n,
                   CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                   CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
            FROM hashed
        ), cuts AS (
            SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM numbers
        ), parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cuts)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM parts
    """,
}
