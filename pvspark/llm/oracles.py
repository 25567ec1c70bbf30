"""DuckDB SQL for the operators that SQL can express."""


def centroids(k: int = 16, rounds: int = 3) -> str:
    """Integer k-means, one pair of steps a round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (
  SELECT row, vec_id, p, min(struct_pack(d := d, k := k)) AS best
  FROM (SELECT v.*, c.k,
          list_sum(list_transform(list_zip(p, c), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT))) AS d
        FROM kept v CROSS JOIN c{r} c)
  GROUP BY row, vec_id, p)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS (
  SELECT k, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN (
    SELECT k, list((s - (((s % n) + n) % n)) // n ORDER BY i) AS c
    FROM (SELECT k, i, sum(x) AS s, count(*) AS n
          FROM (SELECT best.k AS k, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{r}) GROUP BY k, i)
    GROUP BY k) m USING (k))""")
    last = rounds
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS p
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (
  SELECT k - 1 AS k, p AS c
  FROM (SELECT p, row_number() OVER (ORDER BY sha256('1:' || vec_id), p) AS k FROM kept) WHERE k <= {k}),
{",".join(steps).lstrip()}
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(list_aggregate(list_transform(c.c, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c ON a.best.k = c.k"""


DIVERGENCE = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
lang_size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(any_value(l.n), 0) AS lang_n, coalesce(sum(c.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN lang_size l USING (lang) LEFT JOIN c USING (lang, source)
  GROUP BY lang, source, v),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (g.n + 2 * g.v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (k.n + 2) // (g.lang_n + 2 * g.v) AS q
  FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
WHERE part = 'pair' OR rank <= 10"""
