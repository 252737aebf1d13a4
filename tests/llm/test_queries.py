"""The registered queries against their SQL, and what they must hold on the whole table."""

import hashlib

import pytest

import corpus_pipeline
from check import compare, connect
from drillbook.llm.oracle import ORACLES
from drillbook.llm.queries import QUERIES
from drillbook.llm.shared import read

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same, note = compare(spark, connect(FOLDER), name, FOLDER)
    assert same, note


def test_a_query_for_every_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(corpus_pipeline.QUERIES) == set(QUERIES) | {"pipeline"}
    assert set(ORACLES) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize(
    "name, table, key",
    [
        ("op1_embedding_near_dups", "embeddings", "vec_id"),
        ("op2_token_counts", "documents", "doc_id"),
        ("op5_fingerprints", "documents", "doc_id"),
        ("op6_minhash_near_dups", "documents", "doc_id"),
        ("op7_secrets", "documents", "doc_id"),
        ("op8_toxicity", "documents", "doc_id"),
        ("op9_html_text", "pages", "page_id"),
        ("op12_byte_pairs", "documents", "doc_id"),
        ("op13_vector_codes", "embeddings", "vec_id"),
    ],
)
def test_every_row_has_a_result(spark, name, table, key):
    found = sorted(row[0] for row in QUERIES[name](spark, FOLDER).select(key).collect())
    want = sorted(row[0] for row in read(spark, FOLDER, table).select(key).collect())
    assert found == want


def test_pipeline_equals_its_stages(spark):
    """Each stage on its predecessor's rows; all but the last keep the columns of documents."""
    docs = read(spark, FOLDER, "documents")
    columns, texts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, FOLDER)
        if name != "packing":
            assert docs.columns == columns
            for row in docs.collect():
                assert row["n_chars"] == len(row["text"])
            texts[name] = {row["doc_id"]: row["text"] for row in docs.collect()}
    assert set(texts["minhash_near_dedup"]) <= set(texts["line_dedup"]) == set(texts["toxicity"])
    assert set(texts["source_mix"]) <= set(texts["minhash_near_dedup"])

    def digest(rows):
        names = ["doc_id", "piece", "length", "ids_crc32"]
        found = sorted(tuple(row) for row in rows.select(*names).collect())
        return hashlib.md5(repr(found).encode()).hexdigest()

    assert digest(corpus_pipeline.run(spark, FOLDER)) == digest(docs)


def test_stages_take_an_empty_table(spark):
    docs = read(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
