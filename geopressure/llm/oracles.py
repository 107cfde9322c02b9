"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from geopressure.llm.decontaminate import EXACT, MASKS, SPAN
from geopressure.llm.secret_scan import RULES

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE t END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id),
m AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.id = d.doc_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT ON (vec_id) * FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_dot_product(q.w, v.w) AS BIGINT) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.w) = len(v.w)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s
)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 5
"""


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _mask_key(mask) -> str:
    return " || ' ' || ".join(f"t[p + {k + 1}]" for k in mask)


def decontaminate_sql(min_share: float = 0.6, reach: int = 4, min_equal: int = 8) -> str:
    full = lambda table, ident, least: " UNION ALL ".join(
        f"SELECT {i} AS m, {ident}, p, {_mask_key(mask)} AS k FROM "
        f"(SELECT {ident}, t, unnest(range(0, len(t) - {mask[-1]})) AS p FROM {table} WHERE len(t) >= {max(least, mask[-1] + 1)})"
        for i, mask in enumerate(MASKS)
    )
    left_out = "array_to_string(list_filter({0}, lambda x, i: i <> l.l + 1), ' ') AS k"
    return f"""
WITH d AS (SELECT DISTINCT doc_id, {_words("text")} AS t FROM documents),
b AS (SELECT DISTINCT item_id, {_words("text")} AS t FROM benchmark WHERE len({_words("text")}) > 0),
dk AS ({full("d", "doc_id", 0)}), bk AS ({full("b", "item_id", SPAN)}),
l AS (SELECT n, unnest(range(0, n)) AS l FROM (SELECT DISTINCT len(t) AS n FROM b WHERE len(t) >= {EXACT} AND len(t) < {SPAN})),
sh AS (SELECT item_id, l.n, l.l, {left_out.format("t")} FROM b JOIN l ON len(b.t) = l.n),
dw AS (SELECT doc_id, n, p, t[p + 1:p + n] AS w FROM
  (SELECT doc_id, t, n, unnest(range(0, len(t) - n + 1)) AS p FROM d JOIN (SELECT DISTINCT n FROM l) ON len(t) >= n)),
ds AS (SELECT doc_id, p, l.n, l.l, {left_out.format("w")} FROM dw JOIN l ON dw.n = l.n),
hit AS (SELECT doc_id, item_id, dk.p - bk.p AS o, bk.p AS bp FROM dk JOIN bk ON dk.m = bk.m AND dk.k = bk.k
  UNION ALL SELECT doc_id, item_id, ds.p, 0 FROM ds JOIN sh ON ds.n = sh.n AND ds.l = sh.l AND ds.k = sh.k
  UNION ALL SELECT doc_id, item_id, p, 0 FROM (SELECT doc_id, t, unnest(range(0, len(t))) AS p FROM d) e JOIN b
    ON len(b.t) < {EXACT} AND e.t[p + 1:p + len(b.t)] = b.t),
g AS (SELECT doc_id, item_id, o, bp, count(*) AS c FROM hit GROUP BY ALL),
a AS (SELECT g.*, d.t AS dt, b.t AS bt, greatest(bp - {reach}, 0, -o) AS lo, least(bp + {SPAN + reach}, len(b.t), len(d.t) - o) AS hi
  FROM g JOIN d USING (doc_id) JOIN b USING (item_id)),
v AS (SELECT doc_id, item_id, o, c, hi - lo AS w, len(bt) AS n,
  list_sum(list_transform(range(lo, hi), lambda k: CASE WHEN bt[k + 1] = dt[k + o + 1] THEN 1 ELSE 0 END)) AS m FROM a)
SELECT doc_id, item_id, CAST(sum(c) AS BIGINT) AS n_hits, CAST(min(o) AS BIGINT) AS first_word, CAST(max(m) AS BIGINT) AS matched
FROM v WHERE m >= ceil({min_share} * w) AND m >= CASE WHEN n < {EXACT} THEN n ELSE least({min_equal}, n - 1) END GROUP BY 1, 2
"""


def secrets_sql() -> str:
    def kind(i: int, name: str, pattern: str, least: int | None) -> str:
        quoted = pattern.replace("'", "''")
        part = f"regexp_extract_all(text, '{quoted}', {1 if least else 0})"
        return f"""SELECT doc_id, {i} AS o, '{name}' AS kind, a + coalesce(list_sum(list_transform(range(1, i), lambda j: length(gaps[j]) + length(found[j]))), 0) AS s, length(found[i]) AS l
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i, length(gaps[i]) AS a FROM (
    SELECT doc_id, string_split_regex(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}') AS found, {part} AS part FROM t))
  {f"WHERE length(part[i]) >= {least}" if least else ""}"""

    parts = " UNION ALL ".join(kind(i, *rule) for i, rule in enumerate(RULES))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({parts}),
g AS (SELECT doc_id, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + l AS BIGINT), ',' ORDER BY s, o) AS spans,
  {", ".join(f"count(*) FILTER (kind = '{r[0]}') AS n_{r[0]}" for r in RULES)} FROM f GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{r[0]}, 0) AS n_{r[0]}" for r in RULES)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""


FILTER_AUDIT = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), e AS (SELECT text, min(doc_id) AS least FROM w GROUP BY 1),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(lab.good, 0) AS good, coalesce(lab.toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > e.least THEN 'E' ELSE '' END) AS failed
  FROM w JOIN e USING (text) LEFT JOIN lab ON lab.doc_id = w.doc_id
), c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT '' AS o UNION ALL SELECT o.o || l.x FROM o JOIN l ON position(l.x IN o.o) = 0),
s AS (SELECT o, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o WHERE length(o) = 5),
r AS (
  SELECT part, o, step, substr(o, step, 1) AS x, n, good, toxic, failed, position(substr(o, step, 1) IN failed) > 0 AS fails,
    length(translate(failed, substr(o, 1, step - 1), '')) < length(failed) AS gone FROM c, s
), a AS (
  SELECT part, o, step, any_value(x) AS x, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY 1, 2, 3
)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM a
"""


RANKED_SEARCH = r"""
WITH lower AS (SELECT doc_id, 'd' AS kind, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
  UNION ALL SELECT item_id, 'q', translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
t AS (SELECT doc_id AS id, kind, regexp_extract_all(x, '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM lower),
d AS (SELECT id AS doc_id, len(w) AS n, w FROM t WHERE kind = 'd' AND len(w) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM s) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM p GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS r FROM (SELECT id AS item_id, unnest(w) AS term FROM t WHERE kind = 'q') GROUP BY 1, 2),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // total AS m FROM d, s),
c AS (
  SELECT q.item_id, p.doc_id, CAST(sum(r * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN m ON m.doc_id = p.doc_id GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM c WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM r WHERE k <= 10
"""


EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= 0.95 * (a.s * b.s)),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id),
m AS (SELECT id, min(root) AS root FROM r GROUP BY 1),
c AS (SELECT x, count(*) AS k FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(c.k, 0) AS n_links, m.root AS component_id, e.vec_id = m.root AS kept
FROM embeddings e JOIN m ON m.id = e.vec_id LEFT JOIN c ON c.x = e.vec_id
"""
