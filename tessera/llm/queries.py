"""The queries of the operators in this package: each over whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import crc, decontaminate, html, jaccard, media, mixing, pii, quality, runs, sharding, simhash, substring, tokens, xxh64_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_documents(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_simhash_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crc.resample_towards(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.repeated(table(spark, sf_dir, "documents"))
    return runs.digest(runs.periodic_runs(docs, keep=["doc_id"]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_importance_resampling,
        op3_greedy_string_tiling,
        op4_rendezvous_shards,
        op5_media_columns,
        op6_token_counts,
        op7_pfair_mixing,
        op8_ngram_jaccard_join,
        op9_html_extraction,
        op10_personal_data,
        op11_simhash_vp_trees,
        op12_crc_resampling,
        op13_periodic_runs,
    )
}

#: Where SQL says the whole of a query. The others are held against brute force in the tests.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
spots AS (SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 34], ' ')) AS mark FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS pos FROM texts WHERE len(words) >= 35)),
again AS (SELECT mark FROM spots GROUP BY mark HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS place FROM spots WHERE mark IN (SELECT mark FROM again)),
every AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.place) AS rest FROM every e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.place = e.place GROUP BY e.doc_id)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.rest, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id""",
    "op8_ngram_jaccard_join": r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a AS doc_id, min(b) AS other FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of l ON l.doc_id = d.doc_id""",
    "op11_simhash_vp_trees": xxh64_sql.simhash_components(),
    "op12_crc_resampling": r"""
WITH steps AS (SELECT list(list_reduce(range(0, 8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), b) ORDER BY b) AS step FROM (SELECT unnest(range(0, 256)) AS b)),
texts AS (SELECT 0 AS side, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark),
words AS (SELECT side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
counted AS (SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY ALL),
hexed AS (SELECT word, hex(encode(word)) AS code FROM (SELECT DISTINCT word FROM counted)),
crcs AS (SELECT word, xor(4294967295, list_reduce(list_transform(range(0, length(code) // 2), lambda i: CAST('0x' || substr(code, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket FROM hexed, steps),
features AS (SELECT side, doc_id, bucket, n FROM counted JOIN crcs USING (word)),
totals AS (SELECT CAST(coalesce(sum(n) FILTER (side = 0), 0) + 10000 AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 1), 0) + 10000 AS DOUBLE) AS t FROM features),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(sum(n) FILTER (side = 1), 0) + 1) * any_value(s) / ((coalesce(sum(n) FILTER (side = 0), 0) + 1) * any_value(t)))) AS BIGINT) AS gain FROM features, totals GROUP BY bucket),
weights AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM features JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || d.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored s LEFT JOIN placed p ON p.doc_id = s.doc_id""",
    "op13_periodic_runs": r"""
WITH steps AS (SELECT list(list_reduce(range(0, 8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), b) ORDER BY b) AS step FROM (SELECT unnest(range(0, 256)) AS b)),
texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, xor(4294967295, list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295)) AS h FROM documents, steps),
places AS (SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN h // 10 % len(words) END AS a FROM texts),
changed AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN words ELSE list_transform(range(0, n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + h // 10 % 8)) END]) END AS words FROM places),
spots AS (SELECT doc_id, n, i, hash(array_to_string(words[i + 1:i + 16], ' ')) AS mark FROM (SELECT doc_id, n, words, unnest(range(0, n - 15)) AS i FROM changed WHERE n >= 24)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM spots x JOIN spots y ON x.doc_id = y.doc_id AND x.mark = y.mark AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs) GROUP BY doc_id, q, g),
long AS (SELECT * FROM islands WHERE length >= greatest(24, 3 * q)),
runs AS (SELECT * FROM long l WHERE NOT EXISTS (SELECT 1 FROM long s WHERE s.doc_id = l.doc_id AND s.q < l.q AND s.start <= l.start AND s.start + s.length >= l.start + l.length)),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS said FROM runs GROUP BY doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / q DESC, start, q) AS place FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
every AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, n)) AS i FROM changed),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS rest FROM every e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
SELECT c.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.q AS period, 1000 * b.length // b.q AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM changed c LEFT JOIN lines l ON l.doc_id = c.doc_id LEFT JOIN best b ON b.doc_id = c.doc_id AND b.place = 1 LEFT JOIN kept k ON k.doc_id = c.doc_id""",
}
