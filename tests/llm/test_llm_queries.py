import pytest
from test_packing import VOCABULARY, check

import __spark_entry__ as entry
from checks.compare import compare, duck
from clicktrail.llm import oracle, queries

COLUMNS = {
    "op1": {"doc_id", "fingerprint", "component_id"},
    "op2": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op3": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op4": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op5": {"vec_id", "n_links", "component_id", "kept"},
    "op6": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op7": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op8": {"doc_id", "size", "source_size", "target", "taken"},
    "op9": {"doc_id", "held_out", "score", "predicted"},
    "op10": {"query_id", "rank", "vec_id", "score"},
    "op11": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
    "op12": {"page_id", "url", "text", "n_chars"},
    "op13": {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"},
}


def test_one_query_per_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(n.split("_")[0] for n in names) == sorted(COLUMNS)
    assert "pipeline" in entry.queries()
    assert set(oracle.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    ok, note = compare(spark, duck(sf_dir), sf_dir, name, queries.REGISTRY[name], oracle.ORACLE[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(n for n in queries.REGISTRY if n not in oracle.ORACLE))
def test_query_covers_its_table(spark, sf_dir, name):
    df = queries.REGISTRY[name](spark, sf_dir)
    assert set(df.columns) >= COLUMNS[name.split("_")[0]]
    rows = df.collect()
    source = {"op5": "embeddings", "op10": "embeddings", "op12": "pages"}.get(name.split("_")[0], "documents")
    table = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    if name.startswith("op10"):
        assert len(rows) == 10 * table.where("vec_id % 100 = 0").count()
    elif name.startswith("op7"):
        from tokenizers import Tokenizer
        docs = [(r.doc_id, r.text) for r in table.collect()]
        n = check(rows, docs, Tokenizer.from_file(VOCABULARY), 2048)
        assert n <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1
    else:
        assert len(rows) == table.count()
