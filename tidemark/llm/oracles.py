"""DuckDB SQL for the operators' queries that SQL can express; each is written from the contract, not from the operator."""

from __future__ import annotations

from tidemark.llm.url_filter import DEPTH, DIGITS, FAN, FEW, HOST_PRIOR, LOWER, TEMPLATE_PRIOR, UPPER, Z

TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


def url_filter(rules) -> str:
    cases = []
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]), r[1]), reverse=True):
        host, _, path = text.partition("/")
        cases.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", text, verdict))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in cases) + " END"
    said = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases) + " END"
    levels, last = "", "t0"
    for n in range(1, DEPTH + 1):  # segs[n + 1] is the segment of level n
        levels += f"""
a{n} AS (SELECT *, array_to_string(segs[1:{n}], '/') AS node, segs[{n + 1}] AS own FROM {last}),
f{n} AS (SELECT host, node FROM (SELECT DISTINCT host, node, own FROM a{n} WHERE own IS NOT NULL) GROUP BY host, node HAVING count(*) > {FAN} OR (count(*) >= {FEW} AND count(*) FILTER (regexp_matches(own, '[0-9]')) >= {DIGITS} * count(*))),
t{n} AS (SELECT a.host, a.path, a.labelled, a.blocked, CASE WHEN f.host IS NULL THEN segs ELSE list_transform(segs, lambda s, i: CASE WHEN i = {n + 1} THEN '*' ELSE s END) END AS segs FROM a{n} a LEFT JOIN f{n} f ON a.host = f.host AND a.node = f.node),"""
        last = f"t{n}"
    rate = lambda b, n: f"(({b} + 0.5e0) / ({n} + 1))"
    spread = lambda b, n: f"({rate(b, n)} * (1 - {rate(b, n)}) / ({n} + 1))"
    apart = f"s.rate - {rate('w.b', 'w.l')} > {Z}::DOUBLE * sqrt({spread('w.b', 'w.l')} + {spread('s.blocked', 's.labelled')})"
    return f"""WITH RECURSIVE u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(rest, '') AS rest FROM u),
p0 AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
p AS (SELECT *, {rule} AS rule, {said} AS said FROM p0),
c AS (SELECT host, path, CAST(count(*) AS DOUBLE) AS n, CAST(count(said) AS DOUBLE) AS labelled, CAST(count(*) FILTER (said = 'block') AS DOUBLE) AS blocked, string_split(regexp_replace(path, '/+$', ''), '/') AS s FROM p GROUP BY 1, 2),
base AS (SELECT CASE WHEN sum(n) > 0 THEN sum(blocked) / sum(n) ELSE 0.0 END AS base FROM c),
t0 AS (SELECT host, path, labelled, blocked, CASE WHEN len(s) <= {DEPTH + 1} THEN s ELSE list_append(s[1:{DEPTH}], array_to_string(s[{DEPTH + 1}:], '/')) END AS segs FROM c),{levels}
tree AS (SELECT host, segs, sum(labelled) AS labelled, sum(blocked) AS blocked FROM {last} GROUP BY 1, 2),
lev AS (SELECT *, array_to_string(segs[1:level + 1], '/') AS node, CASE WHEN level > 0 THEN array_to_string(segs[1:level], '/') ELSE '!' END AS parent FROM (SELECT *, unnest(range(len(segs))) AS level FROM tree)),
n0 AS (SELECT host, level, parent, node, sum(labelled) AS labelled, sum(blocked) AS blocked FROM lev GROUP BY 1, 2, 3, 4 HAVING sum(labelled) > 0),
n AS (SELECT *, {rate('blocked', 'labelled')} AS rate, row_number() OVER (PARTITION BY host, level, parent ORDER BY {rate('blocked', 'labelled')}, node) AS i FROM n0),
w(host, level, parent, node, i, branch, l, b, own_l, own_b) AS (SELECT host, level, parent, node, i, 0, labelled, blocked, labelled, blocked FROM n WHERE i = 1
  UNION ALL SELECT s.host, s.level, s.parent, s.node, s.i, CASE WHEN {apart} THEN w.branch + 1 ELSE w.branch END, CASE WHEN {apart} THEN s.labelled ELSE w.l + s.labelled END, CASE WHEN {apart} THEN s.blocked ELSE w.b + s.blocked END, s.labelled, s.blocked
  FROM w JOIN n s ON s.host = w.host AND s.level = w.level AND s.parent = w.parent AND s.i = w.i + 1),
br AS (SELECT host, level, node, sum(own_l) OVER g AS labelled, sum(own_b) OVER g AS blocked FROM w WINDOW g AS (PARTITION BY host, level, parent, branch)),
pure(host, segs, level, purity) AS (SELECT t.host, t.segs, CAST(-1 AS BIGINT), base FROM tree t, base
  UNION ALL SELECT q.host, q.segs, q.level + 1, CASE WHEN br.host IS NULL THEN q.purity ELSE (br.blocked + CASE WHEN q.level < 0 THEN {HOST_PRIOR}.0 ELSE {TEMPLATE_PRIOR}.0 END::DOUBLE * q.purity) / (br.labelled + CASE WHEN q.level < 0 THEN {HOST_PRIOR}.0 ELSE {TEMPLATE_PRIOR}.0 END::DOUBLE) END
  FROM pure q LEFT JOIN br ON br.host = q.host AND br.level = q.level + 1 AND br.node = array_to_string(q.segs[1:q.level + 2], '/') WHERE q.level + 1 < len(q.segs)),
v AS (SELECT t.host, t.path, array_to_string(t.segs, '/') AS template, purity FROM {last} t JOIN pure q ON q.host = t.host AND q.segs = t.segs AND q.level = len(t.segs) - 1)
SELECT page_id, p.host, p.path, p.rule, coalesce(said, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity FROM p JOIN v ON p.host = v.host AND p.path = v.path"""


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


DECONTAMINATION = f"""WITH b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, dw.n, item FROM dw JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM occ GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY 1)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html"""

JACCARD = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '""" + UPPER + """', '""" + LOWER + """'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
edge AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
top AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d JOIN top USING (doc_id) LEFT JOIN n USING (doc_id)"""

SHARDING = """WITH RECURSIVE bit(i, c, k) AS (SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n, coalesce(CAST(doc_id AS VARCHAR), text, '') AS key FROM documents),
rec AS (SELECT doc_id, CAST(n + 8 AS BIGINT) AS size, CAST(('0x' || substr(md5(key), 1, 8)) AS BIGINT) % 8192 AS vs,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(n), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM hexed, tab),
slots AS (SELECT vs, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS rows, row_number() OVER (ORDER BY sum(size) DESC, vs) AS o FROM rec GROUP BY vs),
deal(o, loads, shard) AS (SELECT CAST(0 AS BIGINT), list_transform(range(24), lambda x: CAST(0 AS BIGINT)), CAST(-1 AS BIGINT) UNION ALL
  SELECT s.o, list_transform(d.loads, lambda x, i: CASE WHEN i = list_position(d.loads, list_min(d.loads)) THEN x + s.bytes ELSE x END), CAST(list_position(d.loads, list_min(d.loads)) - 1 AS BIGINT) FROM deal d JOIN slots s ON s.o = d.o + 1),
map AS (SELECT vs, shard, coalesce(sum(rows) OVER (PARTITION BY shard ORDER BY vs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM slots JOIN deal USING (o))
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(before + row_number() OVER (PARTITION BY vs ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(vs AS INTEGER) AS virtual_slot FROM rec JOIN map USING (vs)"""
