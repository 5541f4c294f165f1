"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from plenum.llm.quality import KEEP_SHARE, LINE_DOCS

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, coalesce(text, chr(1)) AS own FROM documents),
  w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
  g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
  r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY 1),
  l AS (SELECT rid, source, own, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k, trim(regexp_replace(translate(lower(line), '123456789' || chr(9) || chr(11) || chr(12) || chr(13), '000000000    '), ' +', ' ', 'g')) AS norm
    FROM (SELECT rid, source, own, unnest(string_split(t, chr(10))) AS line FROM d)),
  dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE k > 0 GROUP BY 1),
  f AS (SELECT l.source, norm FROM l WHERE k > 0 GROUP BY 1, 2 HAVING count(DISTINCT own) > {LINE_DOCS}),
  gone AS (SELECT l.rid, sum(k) AS n_removed FROM l JOIN f ON f.source IS NOT DISTINCT FROM l.source AND f.norm = l.norm WHERE k > 0 GROUP BY 1),
  s AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed_words FROM w LEFT JOIN r USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid))
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= {KEEP_SHARE} * n_words AS kept FROM s"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
  b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
  x AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
  p AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d) CROSS JOIN (SELECT DISTINCT n FROM x) WHERE i + n - 1 <= len(w)),
  h AS (SELECT rid, i, p.n, item_id FROM p JOIN x ON p.x = x.x AND p.n = x.n),
  c AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
  t AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY 1)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""


def _crc_table() -> list[int]:
    """What four zero bits after each nibble leave of it, under the reflected polynomial of CRC-32."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        out.append(c)
    return out


def _crc32(blob: str) -> str:
    """SQL: the CRC-32 of a blob, nibble by nibble."""
    digits = "'123456789ABCDEF'"
    octets = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda x: 16 * instr({digits}, x[1]) + instr({digits}, x[2]))"
    low = f"xor(a >> 4, {_crc_table()}[(xor(a, b) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda a, b: xor(({low}) >> 4, {_crc_table()}[(xor({low}, b >> 4) & 15) + 1])), 4294967295)"


def _split(level: int) -> str:
    """SQL: nodes of a level of the tree parted at the weighted median of their widest dimension."""
    return f"""s{level} AS (SELECT node, sum(size) / 2.0 AS half, (max(d0) - min(d0)) / CAST(max(w0) AS DOUBLE) AS r0, (max(d1) - min(d1)) / CAST(max(w1) AS DOUBLE) AS r1, (max(d2) - min(d2)) / CAST(max(w2) AS DOUBLE) AS r2 FROM n{level} CROSS JOIN spread GROUP BY 1),
  x{level} AS (SELECT n{level}.*, half, CASE WHEN r0 >= r1 AND r0 >= r2 THEN d0 WHEN r1 >= r2 THEN d1 ELSE d2 END AS x FROM n{level} JOIN s{level} USING (node)),
  n{level + 1} AS (SELECT rid, doc_id, id, size, crc, d0, d1, d2, 2 * node + CASE WHEN sum(size) OVER (PARTITION BY node ORDER BY x, id) - sum(size) OVER (PARTITION BY node, x, id) < half THEN 0 ELSE 1 END AS node FROM x{level})"""


SHARDING = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS id, lang, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {_crc32("encode(coalesce(text, ''))")} AS crc FROM documents),
  a AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS k FROM (SELECT DISTINCT lang FROM d WHERE lang IS NOT NULL)), b AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k FROM (SELECT DISTINCT source FROM d WHERE source IS NOT NULL)),
  n0 AS (SELECT rid, doc_id, id, size, crc, coalesce(a.k, -1) AS d0, coalesce(b.k, -1) AS d1, size AS d2, 0 AS node FROM d LEFT JOIN a ON a.lang = d.lang LEFT JOIN b ON b.source = d.source),
  spread AS (SELECT greatest(1, max(d0) - min(d0)) AS w0, greatest(1, max(d1) - min(d1)) AS w1, greatest(1, max(d2) - min(d2)) AS w2 FROM n0), {_split(0)}, {_split(1)}, {_split(2)}
  SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(node AS INTEGER) AS shard, row_number() OVER (PARTITION BY node ORDER BY id, size, crc) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM n3"""


# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_M = 1 << 64


def _u(x: int | str) -> str:
    return f"CAST({x} AS UHUGEINT)"


def _mul(x: str, p: int) -> str:
    return f"(({x}) * {_u(p)} % {_u(_M)})"


def _rotl(x: str, r: int) -> str:
    return f"((({x}) * {_u(1 << r)}) % {_u(_M)} + ({x}) // {_u(1 << (64 - r))})"


def _xor(x: str, y: str) -> str:
    return _u(f"xor(CAST({x} AS UBIGINT), CAST({y} AS UBIGINT))")


def _lane(first: str, n: int) -> str:
    """The little-endian number of n octets of o from the place first."""
    return " + ".join(f"{_u(f'o[{first} + {k}]')} * {_u(1 << 8 * k)}" for k in range(n))


def _xxh64(seed: int) -> str:
    """SQL: u (s, a text) to z (s, h: the unsigned XXH64 of its UTF-8), a step in each table."""
    digits = "'123456789ABCDEF'"
    add = f"% {_u(_M)}"
    starts = [(seed + _P1 + _P2) % _M, (seed + _P2) % _M, seed, (seed - _P1) % _M]
    rounds = [f"list_reduce(list_prepend({_u(v)}, list_transform(range(0, n // 32), lambda i: lp[4 * i + {k + 1}])), lambda a, x: {_mul(_rotl(f'((a + x) {add})', 31), _P1)})" for k, v in enumerate(starts)]
    merged = []
    for k in range(4):  # each accumulator is taken into the sum
        own = _mul(_rotl(_mul(f"v{k + 1}", _P2), 31), _P1)
        merged.append(f"g{k + 1} AS (SELECT * REPLACE (({_mul(_xor('acc', own), _P1)} + {_u(_P4)}) {add} AS acc) FROM g{k})")
    return f"""o AS (SELECT s, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: 16 * instr({digits}, x[1]) + instr({digits}, x[2])) AS o FROM u),
  l AS (SELECT s, o, len(o) AS n, list_transform(range(0, len(o) // 8), lambda i: {_mul(_lane('8 * i + 1', 8), _P2)}) AS lp FROM o),
  long AS (SELECT *, {', '.join(f'{r} AS v{k + 1}' for k, r in enumerate(rounds))} FROM l WHERE n >= 32),
  g0 AS (SELECT *, ({_rotl('v1', 1)} + {_rotl('v2', 7)} + {_rotl('v3', 12)} + {_rotl('v4', 18)}) {add} AS acc FROM long), {', '.join(merged)},
  b0 AS (SELECT s, o, n, lp[4 * (n // 32) + 1:] AS rest, (acc + {_u('n')}) {add} AS acc FROM g4 UNION ALL SELECT s, o, n, lp, {_u((seed + _P5) % _M)} + {_u('n')} FROM l WHERE n < 32),
  b1 AS (SELECT s, o, n, list_reduce(list_prepend(acc, list_transform(rest, lambda x: {_mul(_rotl('x', 31), _P1)})), lambda a, x: ({_mul(_rotl(_xor('a', 'x'), 27), _P1)} + {_u(_P4)}) {add}) AS acc FROM b0),
  b2 AS (SELECT s, o, n, CASE WHEN n % 8 >= 4 THEN ({_mul(_rotl(_xor('acc', _mul(_lane('8 * (n // 8) + 1', 4), _P1)), 23), _P2)} + {_u(_P3)}) {add} ELSE acc END AS acc FROM b1),
  b3 AS (SELECT s, list_reduce(list_prepend(acc, list_transform(o[n - n % 4 + 1:], lambda x: {_mul(_u('x'), _P5)})), lambda a, x: {_mul(_rotl(_xor('a', 'x'), 11), _P1)}) AS acc FROM b2),
  c1 AS (SELECT s, {_mul(_xor('acc', f'(acc // {_u(1 << 33)})'), _P2)} AS acc FROM b3), c2 AS (SELECT s, {_mul(_xor('acc', f'(acc // {_u(1 << 29)})'), _P3)} AS acc FROM c1),
  z AS (SELECT s, CAST({_xor('acc', f'(acc // {_u(1 << 32)})')} AS UBIGINT) AS h FROM c2)"""


SIMHASH = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  e AS (SELECT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
  u AS (SELECT DISTINCT s FROM e), {_xxh64(42)},
  f AS (SELECT rid, {' + '.join(f'CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {_u(1 << b)} ELSE 0 END' for b in range(64))} AS fp FROM e JOIN z USING (s) GROUP BY 1),
  p AS (SELECT doc_id, CAST(coalesce(fp, 0) AS UBIGINT) AS fp FROM d LEFT JOIN f USING (rid)), q AS MATERIALIZED (SELECT fp, min(doc_id) AS doc FROM p GROUP BY 1),
  k AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM q a JOIN q b ON bit_count(xor(a.fp, b.fp)) <= 3), r(node, root) AS (SELECT fp, fp FROM q UNION SELECT k.b, r.root FROM r JOIN k ON k.a = r.node), m AS (SELECT node, min(root) AS root FROM r GROUP BY 1),
  t AS (SELECT root, min(doc) AS component_id FROM m JOIN q ON q.fp = m.node GROUP BY 1)
  SELECT doc_id, lower(lpad(hex(p.fp), 16, '0')) AS fingerprint, component_id FROM p JOIN m ON m.node = p.fp JOIN t USING (root)"""


#: For pages that hold their article, and nothing beside it, in one element of that name, as those of the given tables do: what stands in that element. The operator is not told of it.
ARTICLES = r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '<!--.*?-->', '', 'gs') AS h FROM pages),
  b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(b|i|a)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS h FROM a),
  c AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b)
  SELECT page_id, url, text, length(text) AS n_chars FROM c"""


#: Sources by what they can take for a unit of weight: those whose share would be above it are a prefix of that order, as a share grows with each that is clamped.
MIXING = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, substr(md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR), text)), 1, 15) AS place FROM documents),
  s AS (SELECT source, source IS NULL AS last, sum(size) AS n FROM d GROUP BY 1),
  w AS (SELECT source, n, 3 * n AS cap, 1 + (row_number() OVER (ORDER BY last, source) - 1) % 3 AS w FROM s),
  o AS (SELECT *, sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / CAST(w AS DOUBLE), last, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget, sum(w) OVER (ORDER BY cap / CAST(w AS DOUBLE) DESC, last DESC, source DESC) AS shares FROM (SELECT *, source IS NULL AS last FROM w)),
  f AS (SELECT *, w * budget > cap * shares OR n = 0 AS clamped FROM o),
  t AS (SELECT f.*, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE CAST(w * b AS DOUBLE) / CAST(c AS DOUBLE) END AS target, CASE WHEN clamped THEN cap ELSE least(cap, (2 * w * b + c) // (2 * c)) END AS quota FROM f CROSS JOIN (SELECT max(budget) FILTER (NOT clamped AND shares = m) AS b, max(m) AS c FROM (SELECT *, max(shares) FILTER (NOT clamped) OVER () AS m FROM f)) AS level),
  p AS (SELECT d.*, n, target, quota, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, rid) - size AS before FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
  SELECT doc_id, source, size, CAST(n AS BIGINT) AS source_size, target, CAST(CASE WHEN n = 0 THEN 0 ELSE quota // n * size + greatest(0, least(size, quota % n - before)) END AS BIGINT) AS taken FROM p"""

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
DIVERGENCE = rf"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '{_TERM}') AS w FROM documents),
  g AS (SELECT DISTINCT lang, source FROM d), x AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
  k AS (SELECT lang, term, count(*) AS n FROM x GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 30),
  v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
  c AS (SELECT x.lang, x.source, x.term, count(*) AS n FROM x JOIN k USING (lang, term) GROUP BY 1, 2, 3),
  t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
  p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (t.n + 5 * v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (k.n + 5) // (v.n + 5 * v) AS q FROM t JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p AS x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p AS y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3, 4),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q))
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50"""

HARD_NEGATIVES = """WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r AS a JOIN r AS b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
  p AS (SELECT arid, anchor_id, vec_id AS positive_id, score AS positive_score, rid AS prid FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.arid, prid ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.arid = p.arid AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
  SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
