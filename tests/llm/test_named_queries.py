"""Each query of this folder by its name on the smallest tables: its SQL where it has one, else rows and columns of its contract."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.llm.queries import QUERIES, SQL

CONTRACT = {
    "op1_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op2_merkle": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_licenses": "doc_id licenses spans",
    "op4_repetition": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_private": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6_importance": "doc_id log_weight key kept",
    "op7_mixing": "doc_id size source_size target taken",
    "op8_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op9_toxicity": "doc_id held_out score predicted",
    "op10_jaccard": "doc_id n_shingles component_id",
    "op11_spelling": "word form root n n_near form_n",
    "op12_centroids": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op13_urls": "page_id host path rule verdict",
    "pipeline": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


def test_names():
    assert set(QUERIES) | {"pipeline"} == set(CONTRACT) and set(entry.queries()) >= set(CONTRACT)


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_query(spark, sf_dir, name):
    found = entry.queries()[name](spark, sf_dir)
    rows = found.toPandas()
    assert set(CONTRACT[name].split()) <= set(found.columns)
    table = {"op12_centroids": "embeddings", "op13_urls": "pages"}.get(name, "documents")
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert len(rows) == n or name in ("op8_packing", "op11_spelling", "pipeline") and len(rows) > 0
    if name not in SQL:
        return
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    key = "vec_id" if table == "embeddings" else "doc_id"
    want = duck.execute(SQL[name]).df()[list(found.columns)].sort_values(key, ignore_index=True)
    got = rows.sort_values(key, ignore_index=True)
    for c in found.columns:
        if got[c].dtype.kind == "f":
            assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), abs=1e-9)
        else:
            assert got[c].tolist() == want[c].tolist()
