"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import encode, language, lines, mainbody, mix, neardup, residue, spam, spans, split

QUERIES = {
    "p1_found": split.p1_found,
    "p1_pieces": split.p1_pieces,
    "p2_found": lines.p2_found,
    "p2_clean": lines.p2_clean,
    "p2_lines": lines.p2_lines,
    "p3_found": language.p3_found,
    "p3_segments": language.p3_segments,
    "p4_found": mainbody.p4_found,
    "p5_found": residue.p5_found,
    "p6_found": spam.p6_found,
    "p7_found": neardup.p7_found,
    "p7_groups": neardup.p7_groups,
    "p8_ids": encode.p8_ids,
    "p9_mix": mix.p9_mix,
    "p9_shares": mix.p9_shares,
    "p10_found": spans.p10_found,
    "p10_shares": spans.p10_shares,
    "p10_clean": spans.p10_clean,
}

_HOST = r"regexp_replace(lower(regexp_extract(coalesce(CASE WHEN trim(metadata.source_url) <> '' THEN metadata.source_url END, final_url), '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]*)', 1)), '^www\.', '')"

_PAIRS = """d AS (SELECT DISTINCT scrape_id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM scrapes WHERE content IS NOT NULL),
  s AS (SELECT DISTINCT scrape_id, hash(w[i], w[i + 1], w[i + 2]) AS h FROM (SELECT scrape_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 60)),
  n AS (SELECT scrape_id, count(*) AS n FROM s GROUP BY scrape_id), c AS (SELECT a.scrape_id AS a, b.scrape_id AS b, count(*) AS m FROM s a JOIN s b ON a.h = b.h AND a.scrape_id < b.scrape_id GROUP BY ALL),
  p AS (SELECT a, b FROM c JOIN n x ON x.scrape_id = a JOIN n y ON y.scrape_id = b WHERE m >= 0.6 * (x.n + y.n - m))"""

# Whole tables in SQL; problems 3 to 6 and 8 rest on trained models and tokenizers, which SQL cannot express, and p9 on
# random draws.
ORACLE: dict[str, str] = {
    "p1_found": "SELECT DISTINCT scrape_id FROM scrapes WHERE length(content) // 3 > (SELECT max_tokens FROM split_limits WHERE purpose = 'index')",
    "p2_found": f"""WITH r AS (SELECT DISTINCT scrape_id, {_HOST} AS site, content FROM scrapes WHERE content IS NOT NULL),
  l AS (SELECT scrape_id, site, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM r WHERE site <> ''),
  n AS (SELECT scrape_id, site, line_no, regexp_replace(lower(line), '[^\\p{{L}}]', '', 'g') AS k FROM l),
  s AS (SELECT site, count(DISTINCT scrape_id) AS size FROM r GROUP BY site), c AS (SELECT site, k, count(DISTINCT scrape_id) AS n FROM n WHERE k <> '' GROUP BY site, k HAVING count(DISTINCT scrape_id) >= 6)
SELECT DISTINCT n.scrape_id, n.line_no::BIGINT AS line_no FROM n JOIN c USING (site, k) JOIN s USING (site) WHERE c.n * 50 >= s.size""",
    "p7_found": f"WITH {_PAIRS} SELECT a AS scrape_id_a, b AS scrape_id_b FROM p",
    "p7_groups": f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p), r(id, g) AS (SELECT u, u FROM e UNION SELECT e.v, r.g FROM r JOIN e ON e.u = r.id WHERE r.g < e.v),
  k AS (SELECT scrape_id, md5(string_agg(h::VARCHAR, ' ' ORDER BY h)) AS k FROM s GROUP BY scrape_id), l AS (SELECT e.u, count(DISTINCT y.k) FILTER (WHERE y.k <> x.k) AS links FROM e JOIN k x ON x.scrape_id = e.u JOIN k y ON y.scrape_id = e.v GROUP BY e.u)
SELECT r.id AS scrape_id, min(r.g) AS group_id, any_value(l.links)::BIGINT AS links FROM r JOIN l ON l.u = r.id GROUP BY r.id""",
    "p10_found": """WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200), w AS (SELECT doc_id, p, md5_number(substr(text, p + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS p FROM d)),
  g AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)), c AS (SELECT w.doc_id, w.p FROM w JOIN g USING (h)),
  b AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER o + 200 THEN 0 ELSE 1 END AS fresh FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY p)), i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM b)
SELECT doc_id, min(p)::BIGINT AS span_start, (max(p) + 200)::BIGINT AS span_end FROM i GROUP BY doc_id, k""",
}
