"""Each stage of the pipeline on all that its predecessor kept, against a plain version."""

import collections
import re

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_operators import plain_components, shingle_sets
from tidemark.llm import mixing, pii, quality_rules, sentencepiece_scan
from tidemark.llm.shared import written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        kept.append(docs)
        docs = written(stage(spark, docs, DATA), "stage")
    return [df.toPandas() for df in [*kept, docs]]


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert all(list(df.columns) == ["doc_id", "text", "lang", "source", "n_chars"] for df in stages[:-1])
    assert all((df["n_chars"] == df["text"].map(len)).all() for df in stages[1:-1])


def test_quality_keeps_what_sql_keeps(stages):
    con = duckdb.connect()
    con.register("documents", stages[0])
    wanted = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.ORACLES['op9_quality_rules']}) WHERE kept").fetchall()}
    assert set(stages[1]["doc_id"]) == wanted and len(stages[1]) == len(wanted)


def test_one_of_each_near_duplicate_group_stays(stages):
    before, after = stages[1], stages[2]
    ids = before["doc_id"].tolist()
    groups = plain_components(ids, shingle_sets(before["text"].tolist(), 5), 80)
    assert sorted(after["doc_id"]) == sorted(i for k, i in enumerate(ids) if groups[k] == i)


def test_personal_data_is_masked_and_nothing_else_changes(stages):
    before, after = (dict(zip(df["doc_id"], df["text"], strict=True)) for df in (stages[2], stages[3]))
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert not pii.base_spans(after[i])
        base = {(a, b) for _, a, b in pii.base_spans(text)}
        parts = re.split(r"\[(?:EMAIL|IP|CARD|PHONE|SECRET|OBFUSCATED|LOCAL_PHONE|IDENTITY|NUMBER)\]", after[i])
        at = 0
        for part in parts:  # what stays is the text between the masks, in order
            at = text.index(part, at) + len(part)
        if not base and not pii.loose_spans(text, []):
            assert after[i] == text


def test_the_mix_takes_what_sql_takes(stages):
    con = duckdb.connect()
    con.register("documents", stages[3])
    wanted = {i: n for i, n in con.sql(f"SELECT doc_id, copies FROM ({mixing.ORACLES['op4_mixing']}) WHERE copies > 0").fetchall()}
    assert collections.Counter(stages[4]["doc_id"].tolist()) == wanted


def test_ids_are_the_library_s(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.model_path())
    texts = dict(zip(stages[4]["doc_id"], stages[4]["text"], strict=True))
    assert len(stages[5]) == len(stages[4])
    assert all(list(ids) == library.encode(texts[i]) for i, ids in zip(stages[5]["doc_id"], stages[5]["ids"], strict=True))


def test_run_gives_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, DATA).toPandas()
    key = lambda df: sorted((i, tuple(x)) for i, x in zip(df["doc_id"], df["ids"], strict=True))
    assert key(found) == key(stages[5])
