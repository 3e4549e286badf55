"""DuckDB SQL for the queries of this subpackage that SQL can express; plain and exact, not meant for scale."""

from __future__ import annotations

import string

_FOLDED = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = rf"regexp_extract_all({_FOLDED}, '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+')"

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS iid, item_id, {_WORDS} AS w, least(5, len({_WORDS})) AS k FROM benchmark WHERE text IS NOT NULL),
ks AS (SELECT DISTINCT k FROM b WHERE k > 0),
ds AS (SELECT DISTINCT rid, doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT rid, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
bs AS (SELECT DISTINCT iid, item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT iid, item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b WHERE k > 0)),
n AS (SELECT iid, count(*) AS n FROM bs GROUP BY iid)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*)::DOUBLE / n AS containment
FROM ds JOIN bs USING (k, s) JOIN n USING (iid)
GROUP BY rid, doc_id, iid, item_id, n
HAVING count(*) >= 0.8 * n - 1e-9
"""

OP9 = r"""
WITH b AS (
  SELECT doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS text_key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0)) || chr(31) || text_key), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE)
    / coalesce(1::DOUBLE - 0.9::DOUBLE * length(regexp_replace(t, '[\p{L}\p{N}\x20\n.,;:!?''()-]+', '', 'g')) / nullif(length(t), 0), 1::DOUBLE) AS key FROM b),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM b GROUP BY source),
r AS (
  SELECT *, [5::DOUBLE, 2::DOUBLE, 1::DOUBLE][nth % 3 + 1] AS weight, 2::DOUBLE * source_size AS cap FROM s),
v AS (
  SELECT *, cap / weight AS ratio,
    (least(1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE, sum(cap) OVER ())
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM v WHERE level <= ratio ORDER BY ratio, nth LIMIT 1) * weight, cap)) AS target FROM v),
e AS (
  SELECT *, floor(coalesce(target / nullif(source_size, 0), 1::DOUBLE) + 1e-12)::BIGINT AS complete FROM g),
o AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.complete, greatest(e.target - e.complete * e.source_size, 0) AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.text_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS reach
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (complete + CASE WHEN rest > 0 AND reach - size / 2 <= rest THEN 1 ELSE 0 END)::BIGINT * size AS taken FROM o
"""


def _spans(kind: str, rank: int, pattern: str, valid: str) -> str:
    """Spans of a pattern in t, as structs; a match starts after the pieces and matches before it."""
    p = "'" + pattern.replace("'", "''") + "'"
    return (
        f"list_filter(list_transform(list_zip(regexp_extract_all(t, {p}), range(1, len(regexp_extract_all(t, {p})) + 1)), lambda z: "
        f"{{'start': list_sum(list_transform(string_split_regex(t, {p})[1:z[2]], lambda q: length(q))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:z[2] - 1], lambda q: length(q))), 0), "
        f"'rank': {rank}, 'kind': '{kind}', 'm': z[1]}}), lambda z: {valid.replace('{m}', 'z.m')})"
    )


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_RUNS = "|".join(f"{'[+]' if c == '+' else c}{{8,}}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_COVERED = f"'[0-9a-fA-F]{{8}}(?:-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}|{_RUNS}|(?i:example|sample|dummy|placeholder|changeme|your[_-]?|redacted|xxxx|lorem|0123456789|abcdefghij)'"
_KEPT = "length(regexp_replace({m}, '[^A-Za-z]', '', 'g'))"
_WORDS = (
    "(regexp_matches({m}, '^[A-Za-z]+([/_=+-]+[A-Za-z]+)*[/_=+-]*$') AND " + _KEPT + " >= 4 * len(regexp_extract_all({m}, '[A-Z]?[a-z]+|[A-Z]+')) "
    "AND length(regexp_replace({m}, '[^aeiouAEIOU]', '', 'g')) BETWEEN 0.28 * " + _KEPT + " AND 0.6 * " + _KEPT + " "
    "AND NOT regexp_matches({m}, '(?i)[b-df-hj-np-tv-xz]{{6}}|[b-df-hj-np-tv-xz]{{5}}.*[b-df-hj-np-tv-xz]{{5}}|[jqvxz][bcdfghjkmnpqtvwxz]|[aeiouy]{{4}}'))"
).replace("{{", "{").replace("}}", "}")
_ENTROPY = "list_max(list_transform(range(1, length(w) - 18), lambda i: list_entropy(string_split(substr(w, i, 20), ''))))"
_LEAST = "CASE WHEN regexp_matches(w, '^[0-9]+$') THEN 2.65 WHEN regexp_matches(w, '^[0-9a-fA-F]+$') THEN 2.95 WHEN regexp_matches(w, '^([A-Za-z][a-z]*|[A-Z]+)$') THEN 3.35 WHEN regexp_matches(w, '^([a-z0-9]+|[A-Z0-9]+)$') THEN 3.45 ELSE 3.7 END"
_SECRET = "NOT " + _WORDS + " AND len(list_filter(string_split_regex({m}, " + _COVERED + "), lambda w: length(w) >= 20 AND " + _ENTROPY + " >= " + _LEAST + ")) > 0"
_GROUP = "'" + _ASSIGN.replace("'", "''") + "'"
_LINE = "array_to_string(list_transform(list_sort({spans}), lambda s: s.kind || ':' || s.start::BIGINT || ':' || (s.start + length(s.m))::BIGINT), ',')"

OP6 = f"""
WITH b AS (
  SELECT doc_id, t, list_concat(list_concat({_spans("assign", 0, _ASSIGN, f"length(regexp_extract({{m}}, {_GROUP}, 1)) >= 6")},
    {_spans("access", 1, "AKIA[A-Z0-9]+", "length({m}) >= 20")}), {_spans("hex", 2, "[0-9a-f]{24,}", "true")}) AS base,
    {_spans("entropy", 3, "[A-Za-z0-9+/_=-]{20,}", _SECRET)} AS found
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
a AS (
  SELECT doc_id, base, list_concat(base, list_filter(found, lambda s: len(list_filter(base, lambda o: o.start < s.start + length(s.m) AND o.start + length(o.m) > s.start)) = 0)) AS every FROM b)
SELECT doc_id, len(list_filter(base, lambda s: s.kind = 'assign')) AS n_assign, len(list_filter(base, lambda s: s.kind = 'access')) AS n_access,
  len(list_filter(base, lambda s: s.kind = 'hex')) AS n_hex, sha256({_LINE.format(spans="base")}) AS base_sha256, {_LINE.format(spans="every")} AS spans
FROM a
"""

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP12 = f"""
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""


def _lloyd(rounds: int) -> str:
    """Codebooks (c) and assignments (a) of each round; distances are sums of whole products, exact as doubles."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, x.p, any_value(x.x) AS x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * 256 + e) AS best
  FROM x JOIN c{i} c ON c.p = x.p GROUP BY vec_id, x.p)""")
        if i < rounds:
            out.append(f"""m{i} AS (SELECT p, e, list(v ORDER BY i) AS c FROM (SELECT p, best % 256 AS e, i, floor(sum(x[i]) / count(*)) AS v FROM a{i}, range(1, 1 + (SELECT max(len(x)) FROM x)) t(i) GROUP BY ALL) GROUP BY p, e)""")
            out.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON m.p = c.p AND m.e = c.e)""")
    return ",\n".join(out)


OP13 = f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings WHERE {_USABLE}),
x AS MATERIALIZED (SELECT vec_id, p, q[p * len(q) // 4 + 1 : (p + 1) * len(q) // 4] AS x FROM k, range(4) t(p)),
c0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x AS c FROM x WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)),
{_lloyd(4)},
d AS (SELECT vec_id, lower(string_agg(printf('%02x', (best % 256)::INTEGER), '' ORDER BY p)) AS code, sum(best // 256)::BIGINT AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::BIGINT, ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM c4)) AS codebooks_sha256
FROM d JOIN k USING (vec_id)
"""

ORACLES = {"op6_secrets": OP6, "op7_decontamination": OP7, "op9_mixing": OP9, "op12_hard_negatives": OP12, "op13_vector_codes": OP13}
