import hashlib
import os
import struct

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from llm import oracle, queries
from llm.bpe import read_ranks
from llm.mixing import mix_counts
from llm.pii import _pour, find_entities, surrogate
from llm.toxicity import toxicity
from tests.llm.helpers import LONG, documents
from tests.llm.test_pii import plain_collisions
from tests.llm.test_simhash_variants import plain_components, plain_fingerprint

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_run_equals_plain_stages(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    scored = toxicity(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()
    ids = sorted(r["doc_id"] for r in scored if not r["predicted"])
    roots = plain_components(ids, [plain_fingerprint(rows[i]["text"]) for i in ids], 2)
    ids = [i for i, root in zip(ids, roots, strict=True) if i == root]
    monkeypatch.setattr("tests.llm.test_pii.KEY", queries.SURROGATE_KEY)
    tries = plain_collisions(sorted({e[2:] for i in ids for e in find_entities(rows[i]["text"])}))
    text = {}
    for i in ids:
        out, end = "", 0
        for a, b, kind, norm in find_entities(rows[i]["text"]):
            out += rows[i]["text"][end:a] + _pour(rows[i]["text"][a:b], kind, surrogate(queries.SURROGATE_KEY, kind, norm, tries.get((kind, norm), 0)))
            end = b
        text[i] = out + rows[i]["text"][end:]
    kept = spark.createDataFrame([(i, text[i], rows[i]["source"]) for i in ids], "doc_id bigint, text string, source string")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for r in mix_counts(kept).collect():
        codes = library.encode_ordinary(text[r["doc_id"]])
        want += [(r["doc_id"], len(codes), hashlib.sha256(struct.pack(f"<{len(codes)}I", *codes)).hexdigest())] * r["repeats"]
    got = corpus_pipeline.run(spark, FOLDER).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want) and 0 < len(ids) < len(rows)


def test_stages_keep_the_columns_of_documents_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns, name
        assert stage(spark, docs, FOLDER).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["drop_toxic", "drop_near_copies", "replace_personal_data", "mix_sources", "encode"]


def awkward(spark):
    """Documents with null ids, texts and sources, repeated rows, ties, a very long text, and names that stages use themselves."""
    docs = documents(spark, clashing=True)
    return docs.withColumns({c: F.lit("x") for c in ["kept_id", "kept_digest", "kept_rows", "prediction", "toxic", "__row", "__fact", "text_", "n_chars"]})


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_rows(spark, name):
    docs = awkward(spark)
    rows = dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER)
    got = [r.asDict() for r in rows.collect()]
    texts = [r["text"] for r in docs.collect()]
    if name == "encode":
        assert len(got) == len(texts) and sum(r["n_tokens"] == 0 for r in got) == sum(not t for t in texts)
        return
    assert rows.columns == docs.columns
    kept = sorted((r["text"] for r in got), key=repr)
    if name == "drop_toxic":  # the table's models know none of these words
        assert kept == sorted(texts, key=repr)
    elif name == "drop_near_copies":  # null, empty and blank texts are one group; so are the copies
        assert len(kept) == len({t.strip().lower() if t else "" for t in texts})
    elif name == "replace_personal_data":
        assert kept == sorted(texts, key=repr)
    else:  # a document is taken up to three times, those without words never
        assert LONG in kept and not {None, "", " \t\n "} & set(kept) and max(map(kept.count, kept)) <= 6


def test_empty_table_through_all_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)


def test_one_row_of_repeated_ids_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s"), (1, "a b c d", "s"), (2, "a b c d", "s"), (None, "x y z w", "s"), (None, "x y z w", "s")], "doc_id bigint, text string, source string")
    got = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "a b c d", "s"), (None, "x y z w", "s")]


def test_null_ids_and_repeated_ids_with_different_texts_stay_apart(spark):
    """Every group of near-copies keeps one row, whatever the ids; (7, "b b b b") is a copy of 3's text, (None, "a b c d") of 5's."""
    rows = [(None, "x y z w", "s"), (None, "one two three four five", "s"), (None, "one two three four five", "s"), (None, None, "x"), (None, "x", None)]
    rows += [(7, "quite another text of words", "s"), (7, "b b b b", "s"), (3, "b b b b", "s"), (5, "a b c d", "s"), (None, "a b c d", "s")]
    rows += [(9, "eins zwei drei vier", "s"), (9, "uno dos tres cuatro", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    want = [*rows[:2], *rows[3:6], *rows[7:9], *rows[10:]]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for view in ("pages", "documents", "conversations"):
        db.execute(f"CREATE VIEW {view} AS SELECT * FROM '{FOLDER}/{view}.parquet'")
    answer = db.execute(oracle.ORACLE[name])
    columns = sorted(c[0] for c in answer.description)
    want = answer.fetchall()
    order = [[c[0] for c in answer.description].index(c) for c in columns]
    got = queries.QUERIES[name](spark, FOLDER).select(*[F.col(c) for c in columns]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((tuple(r[k] for k in order) for r in want), key=repr)
