"""SQL of queries that hash: XXH64 spelt out over UBIGINT and UHUGEINT numbers, for the comparison with another engine."""

from __future__ import annotations

#: The five primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
SEED = 42
_ALL = "CAST(18446744073709551616 AS UHUGEINT)"


def number(x: int) -> str:
    return f"CAST({x % 2**64} AS UBIGINT)"


def times(a: str, b: str | int) -> str:
    return f"CAST(CAST({a} AS UHUGEINT) * CAST({b} AS UHUGEINT) % {_ALL} AS UBIGINT)"


def plus(a: str, b: str | int) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) + CAST({b} AS UHUGEINT)) % {_ALL} AS UBIGINT)"


def rotated(a: str, by: int) -> str:
    return f"({times(a, 2**by)} | (({a}) >> {64 - by}))"


def turn(state: str, lane: str) -> str:
    return times(rotated(plus(state, times(lane, PRIMES[1])), 31), PRIMES[0])


def lane(start: str, width: int) -> str:
    """The little-endian number of ``width`` bytes from a place in the list b (from 0)."""
    return "(" + " + ".join(f"b[{start} + {k + 1}] * {256**k}" for k in range(width)) + ")"


def hashes(source: str) -> str:
    """CTEs that end in hashes (gram, h), h being the XXH64 of each gram of the CTE ``source``."""
    p1, p2, p3, p4, p5 = PRIMES
    lanes = [f"list_reduce(list_transform(range(0, n // 32), lambda j: {lane(f'32 * j + {8 * a}', 8)}), lambda v, x: {turn('v', 'x')}, {number(s)}) AS v{a}" for a, s in enumerate((SEED + p1 + p2, SEED + p2, SEED, SEED - p1))]
    joined = plus(plus(rotated("v0", 1), rotated("v1", 7)), plus(rotated("v2", 12), rotated("v3", 18)))
    steps = [f"joined{a + 1} AS (SELECT * REPLACE (CASE WHEN n < 32 THEN h ELSE {plus(times(f'xor(h, {turn("0", f"v{a}")})', p1), p4)} END AS h) FROM joined{a})" for a in range(4)]
    eight = plus(times(rotated(f"xor(h, {turn('0', 'x')})", 27), p1), p4)
    four = plus(times(rotated(f"xor(h, {times(lane('n // 8 * 8', 4), p1)})", 23), p2), p3)
    one = times(rotated(f"xor(h, {times('x', p5)})", 11), p1)
    return f"""hexed AS (SELECT gram, octet_length(encode(gram)) AS n, hex(encode(gram)) AS code FROM (SELECT DISTINCT gram FROM {source})),
spelt AS (SELECT gram, n, list_transform(range(0, n), lambda i: CAST('0x' || substr(code, 2 * i + 1, 2) AS UBIGINT)) AS b FROM hexed),
striped AS (SELECT *, {", ".join(lanes)} FROM spelt),
joined0 AS (SELECT *, CASE WHEN n < 32 THEN {number(SEED + p5)} ELSE {joined} END AS h FROM striped),
{", ".join(steps)},
sized AS (SELECT gram, n, b, {plus("h", "n")} AS h FROM joined4),
eights AS (SELECT gram, n, b, list_reduce(list_transform(range(0, n % 32 // 8), lambda j: {lane("n // 32 * 32 + 8 * j", 8)}), lambda h, x: {eight}, h) AS h FROM sized),
fours AS (SELECT gram, n, b, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM eights),
ones AS (SELECT gram, list_reduce(b[n // 4 * 4 + 1:], lambda h, x: {one}, h) AS h FROM fours),
mixed AS (SELECT gram, {times("xor(h, h >> 33)", p2)} AS h FROM ones),
again AS (SELECT gram, {times("xor(h, h >> 29)", p3)} AS h FROM mixed),
hashes AS (SELECT gram, xor(h, h >> 32) AS h FROM again)"""


def simhash_components() -> str:
    bits = " + ".join(f"CASE WHEN 2 * sum(h >> {k} & 1) > count(*) THEN {number(2**k)} ELSE {number(0)} END" for k in range(64))
    return rf"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (SELECT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram FROM texts),
{hashes("grams")},
prints AS (SELECT doc_id, {bits} AS fp FROM grams JOIN hashes USING (gram) GROUP BY doc_id),
docs AS (SELECT d.doc_id, coalesce(p.fp, {number(0)}) AS fp FROM documents d LEFT JOIN prints p ON p.doc_id = d.doc_id),
classes AS (SELECT fp, min(doc_id) AS least FROM docs GROUP BY fp),
links AS (SELECT a.fp AS a, b.fp AS b FROM classes a JOIN classes b ON a.fp <> b.fp AND bit_count(CAST(xor(a.fp, b.fp) AS BIT)) <= 4),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
found AS (SELECT c.fp, min(least(c.least, coalesce(o.least, c.least))) AS component_id FROM classes c LEFT JOIN reach r ON r.a = c.fp LEFT JOIN classes o ON o.fp = r.b GROUP BY c.fp)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM docs JOIN found USING (fp)"""


def _mixed(source: str, h: str, name: str) -> str:
    """CTEs that end in ``name``: the rows of ``source`` with a column ``name``, h with its last mixing; a step each, since an alias in one SELECT would be spelt out again in the next column."""
    return f"""{name}_1 AS (SELECT *, {h} AS x FROM {source}), {name}_2 AS (SELECT * REPLACE ({times("xor(x, x >> 33)", PRIMES[1])} AS x) FROM {name}_1),
{name}_3 AS (SELECT * REPLACE ({times("xor(x, x >> 29)", PRIMES[2])} AS x) FROM {name}_2), {name}_ AS (SELECT * EXCLUDE x, xor(x, x >> 32) AS {name} FROM {name}_3)"""


def of_long(source: str, value: str, seed: str, name: str) -> str:
    """CTEs that end in ``name``_: rows with XXH64 of a whole number of 8 bytes (0 or more)."""
    p1, _, _, p4, p5 = PRIMES
    return _mixed(source, plus(times(rotated(f"xor({plus(seed, p5 + 8)}, {turn('0', value)})", 27), p1), p4), name)


def of_int(source: str, value: str, seed: str, name: str) -> str:
    """CTEs that end in ``name``_: rows with XXH64 of a whole number of 4 bytes (0 or more), or of 4 bytes as one."""
    p1, p2, p3, _, p5 = PRIMES
    return _mixed(source, plus(times(rotated(f"xor({plus(seed, p5 + 4)}, {times(value, p1)})", 23), p2), p3), name)


def rendezvous_shards() -> str:
    """Byte by byte, the checksums of whole texts take half a minute for 1,000 documents: meant for tests on short ones."""
    slot = int.from_bytes(b"slot", "little")
    return rf"""
WITH steps AS (SELECT list(list_reduce(range(0, 8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), b) ORDER BY b) AS step FROM (SELECT unnest(range(0, 256)) AS b)),
docs AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, hex(encode(coalesce(text, ''))) AS code FROM documents),
sums AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_transform(range(0, length(code) // 2), lambda i: CAST('0x' || substr(code, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295)) AS text_crc32 FROM docs, steps),
{of_long("sums", "doc_id", number(SEED), "key")},
{of_long("key_", "text_crc32", "key", "twice")},
{of_int("twice_", str(slot), "twice", "place")},
keys AS (SELECT doc_id, size, text_crc32, key, place FROM place_),
offers AS (SELECT doc_id, key, shard FROM keys, (SELECT unnest(range(0, 25)) AS shard)),
{of_int("offers", "shard", "key", "bid")},
bids AS (SELECT doc_id, shard, -1 / ln((CAST(bid >> 11 AS DOUBLE) + 0.5::DOUBLE) * power(2, -53)) AS offer FROM bid_),
old AS (SELECT doc_id, shard, offer FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY offer DESC, shard) AS rank FROM bids WHERE shard < 24) WHERE rank = 1)
SELECT k.doc_id, size, text_crc32, 'key' AS law, CAST(o.shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY o.shard ORDER BY place & 1023, k.doc_id, text_crc32) - 1 AS slot,
    CAST(CASE WHEN n.offer > o.offer THEN 24 ELSE o.shard END AS INTEGER) AS grown_shard
FROM keys k JOIN old o ON o.doc_id = k.doc_id JOIN bids n ON n.doc_id = k.doc_id AND n.shard = 24"""
