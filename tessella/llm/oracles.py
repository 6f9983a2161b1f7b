"""SQL that says the same as a query, where SQL can."""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, q, unnest(range(1, len(q) + 1)) AS i FROM v), f AS (SELECT vec_id, i, q[i] AS x FROM c),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM f a JOIN f b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

NEAR_DUPLICATES = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS k FROM documents),
i AS (SELECT doc_id, k, unnest(range(1, greatest(1, len(k) - 3) + 1)) AS pos FROM w WHERE len(k) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(k, pos, pos + 3), ' ') AS g FROM i), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1), m AS (SELECT s.doc_id, s.g FROM s JOIN often USING (g)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM m a JOIN m b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""

#: A feature's checksum is folded over its bytes by a table of 256 entries that is made here too.
RESAMPLING = """WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS k FROM documents),
wt AS (SELECT list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS k FROM benchmark),
f AS (SELECT doc_id, unnest(k || list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS g FROM w),
ft AS (SELECT unnest(k || list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS g FROM wt),
crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
h AS (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM f UNION SELECT g FROM ft)),
b AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) % 10000 AS b FROM h, crc),
s AS (SELECT b, count(*) AS n FROM f JOIN b USING (g) GROUP BY b), t AS (SELECT b, count(*) AS n FROM ft JOIN b USING (g) GROUP BY b),
z AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s, (SELECT coalesce(sum(n), 0) FROM t) AS t),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (z.s + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (z.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), z),
m AS (SELECT doc_id, count(*) AS n, sum(gain) AS v FROM f JOIN b USING (g) JOIN gain USING (b) GROUP BY doc_id),
r AS (SELECT w.doc_id, len(k) AS words, coalesce(m.n, 0) AS n_features, CAST(coalesce((v - ((v % n) + n) % n) // n, 0) AS BIGINT) AS weight, ('0x' || substr(sha256('7:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (doc_id)),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM r),
p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM e WHERE words >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM p) // 100 THEN rank END AS rank FROM e LEFT JOIN p USING (doc_id)"""

_PIECE = "length('<|im_start|>') + length(replace(replace(replace({r}, '~', '~0'), chr(10), '~1'), '<', '~2')) + 1 + length(regexp_replace({t}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + length('<|im_end|>') + 1"
_COST = "len(regexp_extract_all({c}, '\\p{{L}}{{1,4}}|\\p{{N}}{{1,3}}|[^\\s\\x0B\\p{{L}}\\p{{N}}]'))"
CHAT = f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '<|im_end|><|im_start|>assistant ok' FROM range(0, 2) q(i)),
o AS (SELECT *, coalesce(turn // 1024, -4611686018427387904) AS block, {_PIECE.format(r="role", t="text")} AS chars, {_COST.format(c="role")} + {_COST.format(c="text")} + 4 AS cost FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, role, text) AS rn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM o),
l AS (SELECT conv_id, block AS first_block, CASE WHEN role = 'system' THEN cost ELSE 0 END AS lead, CASE WHEN role = 'system' THEN chars ELSE 0 END AS lead_chars FROM n WHERE k = 1),
p AS (SELECT n.*, (rn - 1) // 1024 AS part, (rn - 1) % 1024 + 1 AS i, lead, lead_chars, block = first_block AND (rn - 1) // 1024 = 0 AS holds FROM n JOIN l ON n.conv_id IS NOT DISTINCT FROM l.conv_id),
u AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id, block, part ORDER BY rn) - cost AS before FROM p),
g AS (SELECT conv_id, block, part, i, cost AS used, 1 AS nth, true AS begins FROM u WHERE i = 1
UNION ALL SELECT u.conv_id, u.block, u.part, u.i, CASE WHEN g.used + u.cost <= x.room THEN g.used + u.cost ELSE u.cost END, CASE WHEN g.used + u.cost <= x.room THEN g.nth ELSE g.nth + 1 END, g.used + u.cost > x.room
FROM g JOIN u ON g.conv_id IS NOT DISTINCT FROM u.conv_id AND g.block = u.block AND g.part = u.part AND u.i = g.i + 1, LATERAL (SELECT CASE WHEN g.nth > 1 THEN 1536 - u.lead WHEN u.holds THEN 2048 ELSE 2048 - u.lead END AS room) x),
b AS (SELECT u.conv_id, u.block, u.part, u.i, u.before, u.holds, u.lead, u.lead_chars, g.nth FROM g JOIN u ON g.conv_id IS NOT DISTINCT FROM u.conv_id AND g.block = u.block AND g.part = u.part AND g.i = u.i WHERE g.begins),
e AS (SELECT *, lead(before) OVER (PARTITION BY conv_id, block, part ORDER BY i) AS next FROM b),
v AS (SELECT conv_id, block, part, sum(cost) AS total FROM u GROUP BY ALL),
y AS (SELECT e.*, least(512, 2048 - lead - (coalesce(next, total) - before)) AS spare FROM e JOIN v ON e.conv_id IS NOT DISTINCT FROM v.conv_id AND e.block = v.block AND e.part = v.part),
again AS (SELECT u.conv_id, sum(u.chars) AS chars FROM y JOIN u ON y.conv_id IS NOT DISTINCT FROM u.conv_id AND y.block = u.block AND y.part = u.part AND u.i < y.i AND y.before - u.before <= y.spare WHERE NOT (u.i = 1 AND u.holds AND u.lead > 0) GROUP BY u.conv_id),
kept AS (SELECT conv_id, sum(CASE WHEN holds AND i = 1 THEN 0 ELSE lead_chars END) AS chars FROM y GROUP BY conv_id),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS lost, sum(chars) AS chars FROM u GROUP BY conv_id)
SELECT a.conv_id, n_turns, turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256, CAST(a.chars + coalesce(again.chars, 0) + kept.chars AS BIGINT) AS formatted_chars
FROM a JOIN kept ON a.conv_id IS NOT DISTINCT FROM kept.conv_id LEFT JOIN again ON a.conv_id IS NOT DISTINCT FROM again.conv_id"""
