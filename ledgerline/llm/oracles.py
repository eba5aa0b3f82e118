"""DuckDB SQL of the operators that SQL can express, over whole tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_COMPONENT = """reach AS (SELECT id, id AS seen FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen),
comp AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)"""

OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, CAST(length(h) / 2 AS BIGINT) - 48)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT doc_id, p FROM w JOIN f ON w.s = f.s WHERE first < doc_id),
i AS (SELECT doc_id, p, CASE WHEN p > 50 + lag(p) OVER o THEN 1 ELSE 0 END AS gap FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
j AS (SELECT doc_id, p, sum(gap) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM i),
r AS (SELECT doc_id, min(p) AS lo, max(p) + 50 AS hi FROM j GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(hi) OVER o, 1) AS lo, lo AS hi FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY lo)),
e AS (SELECT doc_id, max(hi) AS lo FROM r GROUP BY doc_id),
parts AS (SELECT k.doc_id, lo, substr(h, 2 * lo - 1, 2 * (hi - lo)) AS t FROM k JOIN d USING (doc_id) UNION ALL SELECT e.doc_id, lo, substr(h, 2 * lo - 1) FROM e JOIN d USING (doc_id)),
kept AS (SELECT doc_id, string_agg(t, '' ORDER BY lo) AS t FROM parts GROUP BY doc_id),
n AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
nodes AS (SELECT DISTINCT a AS id FROM links), {_COMPONENT},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM v LEFT JOIN n ON a = vec_id LEFT JOIN comp ON id = vec_id
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM w JOIN f ON w.s = f.s WHERE first < doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
k AS (SELECT x.doc_id, count(g.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.p) FILTER (g.p IS NULL), '') AS t FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, array_to_string(ws[p:p + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS p FROM d)),
u AS (SELECT DISTINCT doc_id, g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
nodes AS (SELECT DISTINCT a AS id FROM links), {_COMPONENT}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON id = d.doc_id
"""

#: The unsigned crc32 (polynomial 0xEDB88320) of a decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({0}, '.'), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"""
_FRAMED = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
_TREE = """SELECT {key}, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 7) // 8) FROM {name} WHERE n > 1 GROUP BY {key}, level, pos // 8"""

OP12 = f"""
WITH RECURSIVE told AS (SELECT *, {_LEAF} AS leaf, CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low FROM documents),
d AS (SELECT doc_id, {_FRAMED.format("lang")} AS tree, lang, leaf, {_LEAF.replace("text", "low")} AS claim, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM told),
t AS (SELECT tree, 0 AS level, pos, leaf AS node, n FROM d UNION ALL {_TREE.format(key="tree", name="t")}),
g AS (SELECT t.tree, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t JOIN (SELECT DISTINCT tree, lang FROM d) USING (tree) WHERE t.n = 1),
u AS (SELECT 0 AS one, 0 AS level, pos, subroot AS node, n FROM g UNION ALL {_TREE.format(key="one", name="u")}),
root AS (SELECT node AS root FROM u WHERE n = 1),
steps AS (SELECT d.tree, d.pos AS id, t.level, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < (d.pos >> (3 * t.level))), '') AS before, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > (d.pos >> (3 * t.level))), '') AS after
  FROM d JOIN t ON t.tree = d.tree AND t.n > 1 AND t.pos // 8 = (d.pos >> (3 * t.level + 3)) GROUP BY ALL),
higher AS (SELECT g.tree, u.level, coalesce(string_agg(u.node, '' ORDER BY u.pos) FILTER (u.pos < (g.pos >> (3 * u.level))), '') AS before, coalesce(string_agg(u.node, '' ORDER BY u.pos) FILTER (u.pos > (g.pos >> (3 * u.level))), '') AS after
  FROM g JOIN u ON u.n > 1 AND u.pos // 8 = (g.pos >> (3 * u.level + 3)) GROUP BY ALL),
way AS (SELECT tree, id, level, before, after FROM steps UNION ALL SELECT d.tree, d.pos, 1000 + higher.level, before, after FROM d JOIN higher USING (tree)),
ways AS (SELECT tree, id, string_agg(before || after, '' ORDER BY level) AS siblings, list(struct_pack(b := before, a := after) ORDER BY level) AS path FROM way GROUP BY tree, id),
f AS (SELECT d.tree, d.pos, claim AS node, coalesce(path, []) AS path FROM d LEFT JOIN ways ON ways.tree = d.tree AND ways.id = d.pos UNION ALL SELECT tree, pos, sha256(path[1].b || node || path[1].a), path[2:] FROM f WHERE len(path) > 0)
SELECT d.doc_id, d.leaf, g.subroot, root.root, sha256(coalesce(siblings, '')) AS proof_sha256, f.node AS folded_root, f.node = root.root AS verified
FROM d JOIN g USING (tree) CROSS JOIN root LEFT JOIN ways ON ways.tree = d.tree AND ways.id = d.pos JOIN f ON f.tree = d.tree AND f.pos = d.pos AND len(f.path) = 0
"""

OP13 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS x FROM t),
c AS (SELECT *, len(units) AS n, least(x[1] % (len(units) + 1), x[2] % (len(units) + 1)) AS a, greatest(x[1] % (len(units) + 1), x[2] % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
