"""The registered queries: their SQL where there is some, their columns elsewhere."""

from __future__ import annotations

import pytest

from tessera.llm import queries, xxh64_sql

from ..test_queries import rows

COLUMNS = {
    "op1": "doc_id n_words n_removed kept_sha256",
    "op2": "doc_id n_grams log_weight gumbel_key",
    "op3": "doc_id item_id n_words n_covered n_tiles longest tiles",
    "op4": "doc_id size text_crc32 law shard slot grown_shard",
    "op5": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature tile",
    "op6": "doc_id n_bytes n_tokens over_limit",
    "op7": "doc_id source mix_block mix_seq mix_slot mix_release mix_deadline",
    "op8": "doc_id n_shingles component_id",
    "op9": "page_id url text n_chars",
    "op10": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op11": "doc_id fingerprint component_id",
    "op12": "doc_id n_features weight score rank",
    "op13": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, small, name):
    df, other = queries.QUERIES[name](spark, small), duck.sql(queries.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(other.columns, other.fetchall())


def test_names_and_columns(spark, small):
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    for name, query in queries.QUERIES.items():
        df = query(spark, small)
        assert df.columns == COLUMNS[name.split("_")[0]].split()
        if name.split("_")[0] not in ("op2", "op3"):
            assert df.count() == (50 if name.startswith("op9") else 200)


def test_shards_by_sql_on_short_texts(spark, tmp_path, small):
    """Shards, slots and checksums of op4 by SQL of their hashes, over the given documents cut to 60 characters (on whole texts the SQL is too slow)."""
    import duckdb

    short = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id", "left(text, 60) AS text")
    short.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df, other = queries.QUERIES["op4_rendezvous_shards"](spark, str(tmp_path)), con.sql(xxh64_sql.rendezvous_shards())
    assert df.columns == other.columns and rows(df.columns, df.collect()) == rows(other.columns, other.fetchall())
