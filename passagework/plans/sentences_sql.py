"""DuckDB SQL for sentences, sentence-aware chunks, clustered chunks and hashed embeddings, with the default patterns.

Texts are taken apart at their delimiters, so a place in a text is the number of a part. A delimiter that stands alone and
is followed by white space ends a sentence, unless one byte or less is left or a pattern stands before it. Backwards each
delimiter that stands alone does, unless a pattern stands before or after it.
"""

from __future__ import annotations

# Fixed value: Unicode White_Space as a class of DuckDB's patterns.
SPACE = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: parts (doc_id, k, seg, last) and dots (the delimiters after the parts but the last, with what they are).
PARTS = f"""
doc AS (SELECT doc_id, string_split(text, '.') AS segs FROM documents WHERE text <> ''),
parts AS (SELECT doc_id, unnest(range(len(segs))) AS k, unnest(segs) AS seg, len(segs) - 1 AS last FROM doc),
around AS (
  SELECT *, lag(seg) OVER w AS before, lead(seg) OVER w AS after,
         sum(length(seg) + 1) OVER w - 1 AS place, sum(strlen(seg) + 1) OVER w - 1 AS byte_place,
         sum(strlen(seg) + 1) OVER w - 1 - strlen(seg) AS byte_start
  FROM parts WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
dots AS (
  SELECT *, NOT (seg = '' AND k > 0) AND NOT (after = '' AND k + 1 < last) AS alone,
         regexp_matches(after, '^{SPACE}') AS spaced,
         seg LIKE '%www' OR seg LIKE '%etc' OR coalesce((seg = 'g' AND before LIKE '%e') OR (seg = 'e' AND before LIKE '%i'), false) AS under,
         regexp_matches(after, '^(com|org|net|sh|rs|js)') OR after = 'g' OR after = 'e' AS over,
         k + 1 = last AND (after = '' OR (length(after) = 1 AND strlen(after) = 1)) AS done
  FROM around WHERE k < last),
marked AS (SELECT *, alone AND spaced AND NOT under AND NOT done AS ends FROM dots)"""


def groups_sql(size: int) -> str:
    """CTE grouped (doc_id, g, content): groups of `size` sentences."""
    return f"""{PARTS},
numbered AS (
  SELECT p.doc_id, p.k, p.seg || CASE WHEN p.k < p.last THEN '.' ELSE '' END AS piece,
         coalesce(sum(m.ends::INTEGER) OVER (PARTITION BY p.doc_id ORDER BY p.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {size} AS g
  FROM parts p LEFT JOIN marked m ON m.doc_id = p.doc_id AND m.k = p.k),
grouped AS (SELECT doc_id, g::INTEGER AS g, string_agg(piece, '' ORDER BY k) AS content FROM numbered GROUP BY doc_id, g)"""


def snapping_sql(size: int, overlap: int) -> str:
    """Chunks that end with a sentence and hold `overlap` more on either side (at least one)."""
    return f"""WITH RECURSIVE {PARTS},
backward AS (SELECT doc_id, k, place, under, over FROM dots WHERE alone AND place > 0),
lower AS (
  SELECT doc_id, k, under, over, lag(k) OVER w AS one,
         (SELECT max(x.k) FROM backward x WHERE x.doc_id = b.doc_id AND x.place < b.place - 3) AS beyond
  FROM backward b WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
walk AS (
  SELECT l.doc_id, l.k AS begin_dot, l.one AS stand, {overlap} AS left_over FROM lower l JOIN marked m ON m.doc_id = l.doc_id AND m.k = l.k WHERE m.ends
  UNION ALL
  SELECT w.doc_id, w.begin_dot,
         CASE WHEN l.over THEN l.one WHEN l.under THEN l.beyond WHEN w.left_over = 1 THEN l.k ELSE l.one END,
         CASE WHEN l.over OR l.under THEN w.left_over ELSE w.left_over - 1 END
  FROM walk w JOIN lower l ON l.doc_id = w.doc_id AND l.k = w.stand WHERE w.left_over > 0),
firsts AS (SELECT doc_id, begin_dot, max(CASE WHEN left_over = 0 THEN stand + 1 ELSE 0 END) AS first_part FROM walk GROUP BY doc_id, begin_dot),
lists AS (
  SELECT doc_id, any_value(last) AS last, list(byte_start ORDER BY k) AS starts,
         list({{'k': k, 'b': byte_place}} ORDER BY k) FILTER (WHERE spaced AND NOT under AND NOT (k + 1 = last AND after = '')) AS cuts,
         list(k ORDER BY k) FILTER (WHERE ends) AS stops
  FROM (SELECT a.doc_id, a.k, a.last, a.byte_start, m.byte_place, m.spaced, m.under, m.after, m.ends FROM around a LEFT JOIN marked m ON m.doc_id = a.doc_id AND m.k = a.k)
  WHERE doc_id IN (SELECT doc_id FROM documents WHERE regexp_replace(text, '{SPACE}', '', 'g') <> '') GROUP BY doc_id),
chunks AS (
  SELECT doc_id, -1 AS idx, 0 AS from_part, -1::BIGINT AS upto, 0::BIGINT AS next FROM lists
  UNION ALL
  SELECT doc_id, idx + 1, next, upto_new, upto_new + 1 FROM (
    SELECT c.doc_id, c.idx, c.next, l.last,
           coalesce(list_filter(l.stops, lambda s: s > list_filter(l.cuts, lambda x: x.k >= c.next AND x.b - l.starts[c.next + 1] >= {size})[1].k)[{overlap}], l.last) AS upto_new
    FROM chunks c JOIN lists l ON l.doc_id = c.doc_id WHERE c.next <= l.last))
SELECT c.doc_id, c.idx::INTEGER AS chunk_idx, string_agg(p.seg || CASE WHEN p.k < p.last THEN '.' ELSE '' END, '' ORDER BY p.k) AS chunk
FROM chunks c LEFT JOIN firsts f ON f.doc_id = c.doc_id AND f.begin_dot = c.from_part - 1
JOIN parts p ON p.doc_id = c.doc_id AND p.k BETWEEN CASE WHEN c.from_part = 0 THEN 0 ELSE coalesce(f.first_part, 0) END AND c.upto
WHERE c.idx >= 0 GROUP BY c.doc_id, c.idx"""


def embedding_sql(rows: str, key: str, content: str, size: int = 64) -> str:
    """CTE embedded ({key}, embedding) of the hashing embedder over CTE or table `rows`."""
    return f"""
said AS (SELECT {key}, unnest(regexp_extract_all(lower({content}), '[^\\s\\x0B]+')) AS w FROM {rows}),
hashed AS (SELECT {key}, ('0x' || substr(md5(trim(w, '.,;:!?()[]"''')), 1, 16))::UBIGINT AS h FROM said),
summed AS (SELECT {key}, (h % {size})::INTEGER AS i, sum(CASE WHEN h >= 9223372036854775808 THEN 1 ELSE -1 END)::DOUBLE AS x FROM hashed GROUP BY ALL),
whole AS (SELECT {key}, map_from_entries(list((i, x))) AS m, sqrt(sum(x * x)) AS size FROM summed GROUP BY {key}),
embedded AS (
  SELECT r.{key}, list_transform(range({size}), lambda i: CASE WHEN coalesce(size, 0) > 0 THEN coalesce(m[i::INTEGER], 0.0) / size ELSE 0.0 END) AS embedding
  FROM {rows} r LEFT JOIN whole w ON w.{key} = r.{key})"""


_GAPS = "list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i] - {b}[i]))"
#: Similarity of lists {a} and {b}; what is None where a vector is zero.
SIMILARITIES = {
    "cosine": "CASE WHEN list_max(list_transform({a}, lambda x: abs(x))) > 0 AND list_max(list_transform({b}, lambda x: abs(x))) > 0 THEN round(list_cosine_similarity({a}, {b}), 12) END",
    "euclidean": "list_distance({a}, {b})",
    "manhattan": f"list_sum({_GAPS})",
    "angular": "CASE WHEN list_max(list_transform({a}, lambda x: abs(x))) > 0 AND list_max(list_transform({b}, lambda x: abs(x))) > 0 THEN acos(greatest(-1, least(1, list_cosine_similarity({a}, {b})))) / pi() END",
    "chebyshev": f"list_max({_GAPS})",
    "dotProduct": "list_inner_product({a}, {b})",
    "minkowski": f"pow(list_sum(list_transform({_GAPS}, lambda x: pow(x, 3))), 1.0 / 3)",
}


def semantic_sql(size: int, threshold: float, name: str = "cosine", best: bool = False) -> str:
    """Groups of sentences joined to the first cluster whose first group is similar by `threshold` or more; best: to the most
    similar one of those."""
    pick = "list_sort(list_transform(list_filter(n.alike, lambda x: list_contains(w.seeds, x.g)), lambda x: {'s': -x.s, 'g': x.g}))[1].g" if best else "list_filter(n.alike, lambda x: list_contains(w.seeds, x.g))[1].g"
    return f"""WITH RECURSIVE {groups_sql(size)},
keyed AS (SELECT doc_id::VARCHAR || '/' || g AS name, doc_id, g, content FROM grouped),{embedding_sql("keyed", "name", "content")},
vectors AS (SELECT k.doc_id, k.g, k.content, k.g > 0 AND regexp_replace(k.content, '{SPACE}', '', 'g') = '' AS blank, e.embedding FROM keyed k JOIN embedded e ON e.name = k.name),
scored AS (SELECT a.doc_id, a.g, b.g AS other, {SIMILARITIES[name].format(a="a.embedding", b="b.embedding")} AS s FROM vectors a JOIN vectors b ON b.doc_id = a.doc_id AND b.g < a.g),
near AS (
  SELECT a.doc_id, a.g, list({{'g': b.other, 's': b.s}} ORDER BY b.other) FILTER (WHERE b.other IS NOT NULL) AS alike FROM vectors a LEFT JOIN scored b
  ON b.doc_id = a.doc_id AND b.g = a.g AND b.s >= {threshold} GROUP BY a.doc_id, a.g),
walk AS (
  SELECT doc_id, 0 AS g, [0]::INTEGER[] AS seeds, 0 AS seed FROM vectors WHERE g = 0
  UNION ALL
  SELECT doc_id, g, CASE WHEN seed IS NULL AND NOT blank THEN list_append(seeds, g) ELSE seeds END, CASE WHEN blank THEN NULL ELSE coalesce(seed, g) END FROM (
    SELECT w.doc_id, v.g, v.blank, w.seeds, {pick} AS seed
    FROM walk w JOIN vectors v ON v.doc_id = w.doc_id AND v.g = w.g + 1 JOIN near n ON n.doc_id = v.doc_id AND n.g = v.g))
SELECT w.doc_id, (dense_rank() OVER (PARTITION BY w.doc_id ORDER BY w.seed) - 1)::INTEGER AS chunk_idx,
       string_agg(CASE WHEN v.g = w.seed AND v.g > 0 THEN regexp_replace(v.content, '^{SPACE}+|{SPACE}+$', '', 'g') ELSE v.content END, '' ORDER BY v.g) AS chunk
FROM walk w JOIN vectors v ON v.doc_id = w.doc_id AND v.g = w.g WHERE w.seed IS NOT NULL GROUP BY w.doc_id, w.seed"""
