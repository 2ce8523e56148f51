"""DuckDB SQL for the corpus queries that SQL can express, written from their definitions."""

from __future__ import annotations

from recallium.llm import reputation
from recallium.llm.audit import FILTERS


def filter_interaction_audit() -> str:
    """Orders are built by a recursive query; each document is tested against each order's steps through its set of failed filters."""
    bit = f"(1 << (instr('{FILTERS}', {{0}}) - 1))"
    return rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
 w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word FROM d), n AS (SELECT r, count(*) AS words, count(DISTINCT word) AS kinds FROM w GROUP BY r),
 e AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t), l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS bad FROM labels GROUP BY doc_id),
 f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, CAST(coalesce(words, 0) < 200 AS INT) + 2 * CAST(100 * coalesce(kinds, 0) < 50 * coalesce(words, 0) AS INT)
  + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(first_id < d.doc_id, false) AS INT) AS s
  FROM d LEFT JOIN n USING (r) LEFT JOIN e USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
 c AS (SELECT part, s, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY ALL), letters AS (SELECT unnest(string_split('{FILTERS}', '')) AS x),
 o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, letters WHERE NOT contains(filter_order, x)), orders AS (SELECT filter_order FROM o WHERE length(filter_order) = {len(FILTERS)}),
 steps AS (SELECT filter_order, CAST(step AS INT) AS step, {bit.format('filter_order[step]')} AS own, CAST((SELECT coalesce(sum({bit.format('x')}), 0) FROM letters WHERE contains(filter_order[1:step - 1], x)) AS INT) AS before FROM orders, range(1, 6) q(step)),
 k AS (SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (s & (own | before) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (s & own <> 0 AND s & before = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (s & own <> 0 AND s & before <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (s = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (s & own <> 0 AND s & before = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (s & own <> 0 AND s & before = 0), 0) AS BIGINT) AS toxic_lost FROM c, steps GROUP BY ALL)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM k"""


def centroid_clusters(dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024) -> str:
    distance = "(SELECT sum((a.x[i] - b.c[i]) * (a.x[i] - b.c[i])) FROM range(1, {0}) r(i))".format(dim + 1)
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, x AS c FROM kept ORDER BY sha256('3:' || vec_id) LIMIT {k})",
    ]
    for at in range(rounds + 1):
        parts.append(f"a{at} AS MATERIALIZED (SELECT a.r, a.vec_id, a.x, min_by(b.k, {distance} * {k} + b.k) AS k, CAST(min({distance}) AS BIGINT) AS d FROM kept a, c{at} b GROUP BY a.r, a.vec_id, a.x)")
        if at < rounds:
            parts.append(
                f"s{at} AS (SELECT k, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS v, unnest(range({dim})) AS i FROM a{at}) GROUP BY ALL), m{at} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{at} GROUP BY k),"
                f" c{at + 1} AS MATERIALIZED (SELECT k, coalesce(m{at}.c, c{at}.c) AS c FROM c{at} LEFT JOIN m{at} USING (k))"
            )
    return "WITH " + ",\n ".join(parts) + (
        f"\nSELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"
    )


def url_reputation(rules: list[reputation.Rule], limit: float, confidence: float) -> str:
    fit = [f"(({i}), '{r.host + r.path}', '{r.verdict}', '{r.host}', '{r.path}')" for i, r in enumerate(sorted(rules, key=lambda r: -len(r.host + r.path)))]
    low, high = 1 / reputation.MOST_RHO - 1, 1 / reputation.LEAST_RHO - 1
    strength = "(SELECT 1 / least({1}, greatest({0}, CASE WHEN sum(n * (n - 1.0) * m * (1 - m)) <> 0 THEN sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / sum(n * (n - 1.0) * m * (1 - m)) ELSE {1} END)) - 1 FROM {2})"
    of = lambda t: strength.format(reputation.LEAST_RHO, reputation.MOST_RHO, t)
    points = round(2 * reputation.REACH / reputation.STEP)
    u = f"(ln({limit} / (1 - {limit})) + (start + i + 0.5) * h)"
    weight = f"exp(a * ({u} - ln(a / b)) - (a + b) * (ln(1 + exp({u})) - ln(1 + a / b)))"
    return rf"""WITH marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
 cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{reputation.UPPER}', '{reputation.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
 q AS (SELECT p.*, bad FROM p LEFT JOIN marks ON doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(\.html|/)?$', 1), '') AS BIGINT)),
 bare AS (SELECT host, count(bad) AS n, count(*) FILTER (bad = 1) AS k, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*|\.+)$', '') AS b FROM q GROUP BY host),
 hosts AS (SELECT host, n, k, CASE WHEN regexp_full_match(b, '[0-9]+(\.[0-9]+){{3}}') THEN b ELSE array_to_string(string_split(b, '.')[-2:], '.') END AS domain,
  CASE WHEN regexp_full_match(b, '[0-9]+(\.[0-9]+){{3}}') THEN '' ELSE string_split(b, '.')[-1] END AS suffix FROM bare),
 s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, ((SELECT sum(k) FROM hosts) + 0.5::DOUBLE) / ((SELECT sum(n) FROM hosts) + 1) AS m FROM hosts GROUP BY suffix), sp AS (SELECT {of('s')} AS f),
 d AS (SELECT domain, sum(h.n) AS n, sum(h.k) AS k, any_value((s.k + f * m) / (s.n + f)) AS m FROM hosts h JOIN s USING (suffix), sp GROUP BY domain), dp AS (SELECT {of('d')} AS f),
 t AS (SELECT host, h.n, h.k, (d.k + f * m) / (d.n + f) AS m FROM hosts h JOIN d USING (domain), dp), tp AS (SELECT {of('t')} AS f),
 post AS (SELECT host, n, k, k + f * m AS a, n - k + f * (1 - m) AS b FROM t, tp), grid AS (SELECT *, {reputation.STEP} * sqrt((a + b) / (a * b)) AS h FROM post),
 g AS (SELECT *, floor((ln(a / b) - ln({limit} / (1 - {limit}))) / h) - {points // 2} AS start FROM grid),
 v AS (SELECT host, n, k, a / (a + b) AS mean, (SELECT sum({weight}) FILTER (start + i >= 0) / sum({weight}) FROM range(0, {points}) z(i)) AS above FROM g),
 rules(ord, rule, verdict, rh, rp) AS (VALUES {', '.join(fit)}),
 r AS (SELECT host, path, min_by(rule, ord) AS rule, min_by(verdict, ord) AS verdict FROM (SELECT DISTINCT host, path FROM p) x JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, CASE WHEN v.above >= {confidence} AND (SELECT sum(n) FROM hosts) > 0 THEN 'block' ELSE 'allow' END) AS verdict,
 v.n AS n_labelled, v.k AS n_bad, round(v.mean, 6) AS posterior_mean, round(coalesce(v.above, 0), 6) AS posterior_above
FROM p JOIN v USING (host) LEFT JOIN r ON r.host = p.host AND r.path = p.path"""
