"""The operators' queries in SQL, where SQL can say them."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] END) AS sh
  FROM w),
sizes AS (SELECT doc_id, len(sh) AS n FROM sets),
one AS (SELECT doc_id, unnest(sh) AS s FROM sets),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM one a JOIN one b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.doc_id WHERE reach.r < e.b)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""

_MARKS = r"regexp_replace({0}, '<(\\*)\|', '<\1\\|', 'g')"

OP8 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
pieces AS (
  SELECT *, 12 + length(role) + 1 + length({_MARKS.format('text')}) + 10 + 1 AS chars,
    row_number() OVER o AS n FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
sums AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM pieces)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  count(CASE WHEN role = 'assistant' THEN 1 END) AS n_examples,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN upto END), 0) AS BIGINT) AS example_chars
FROM sums GROUP BY conv_id
"""

OP9 = """
WITH c AS (SELECT vec_id, [x >= 0 for x in embedding] AS code FROM embeddings),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
    CAST(list_sum([CAST(z[1] <> z[2] AS INT) for z in list_zip(q.code, v.code)]) AS INT) AS distance
  FROM c q JOIN c v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
WHERE rank <= 10
"""

OP10 = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13)) AS BIGINT)
      + 0.5) / 4503599627370496.0) / coalesce(greatest(0.25, 1.0 - 5.0 * (length(text) - length(translate(text,
      '!#$%&*|<>{}[]=@~^+', ''))) / greatest(length(text), 1)), 0.25) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (
  SELECT source, source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w,
    3.0 * source_size AS room FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY room / w, source NULLS LAST) AS i FROM w),
levels(k, level) AS (
  SELECT 1, (SELECT sum(source_size) / sum(w) FROM o)
  UNION ALL
  SELECT k + 1, ((SELECT sum(source_size) FROM o) - (SELECT sum(room) FROM o WHERE i <= k)) / (SELECT sum(w) FROM o WHERE i > k)
  FROM levels WHERE k < (SELECT count(*) FROM o) AND level * (SELECT w FROM o WHERE i = k) > (SELECT room FROM o WHERE i = k)),
plan AS (
  SELECT source, source_size, least(room, w * (SELECT level FROM levels ORDER BY k DESC LIMIT 1)) AS target FROM o),
run AS (
  SELECT r.doc_id, r.size, p.source_size, p.target,
    CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END AS epochs,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN target - epochs * source_size > 0
    AND before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""



def _op11(rounds: int = 4) -> str:
    """The rounds one after the other; floors go down, ties to the lower entry."""
    far = "list_sum(list_transform(list_zip(s.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""m{r} AS MATERIALIZED (SELECT s.vec_id, s.p, min(CAST({far} AS BIGINT) * 256 + b.e) AS m
  FROM s JOIN b{r} b ON s.p = b.p GROUP BY 1, 2),
a{r} AS MATERIALIZED (SELECT vec_id, p, m % 256 AS e, m // 256 AS far FROM m{r})"""
        )
        if r < rounds:
            steps.append(
                f"""u{r} AS (SELECT p, e, i, sum(x) AS t, count(*) AS n FROM (
    SELECT s.p, a.e, unnest(s.c) AS x, generate_subscripts(s.c, 1) AS i FROM s JOIN a{r} a ON s.vec_id = a.vec_id AND s.p = a.p)
  GROUP BY 1, 2, 3),
v{r} AS (SELECT p, e, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM u{r} GROUP BY 1, 2),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(v.c, b.c) AS c FROM b{r} b LEFT JOIN v{r} v ON v.p = b.p AND v.e = b.e)"""
            )
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS c FROM kept, range(4) t(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 256),
b0 AS MATERIALIZED (SELECT s.p, f.e, s.c FROM first f JOIN s USING (vec_id)),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
rows AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error
  FROM a{rounds} GROUP BY 1),
labelled AS (SELECT rows.*, label FROM rows JOIN kept USING (vec_id))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM labelled, books
"""


OP12 = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS whole, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (
  SELECT *, len(units) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
    CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM u),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN whole = '' OR contains(whole, '<P>') OR contains(whole, '<S>') OR contains(whole, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT doc_id, n, form, whole, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid,
    array_to_string(units[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN whole WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(whole) AS restored_sha256
FROM p
"""

ORACLE = {
    "op6_near_duplicates": OP6,
    "op8_chat": OP8,
    "op9_nearest_codes": OP9,
    "op10_mixing": OP10,
    "op11_vector_codes": _op11(),
    "op12_fill_in_middle": OP12,
}
