"""The registered queries and the pipeline on the small tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewarden.llm import catalog, decontamination, mixing, near_duplicates, tokenfiles, toxicity
from tracewarden.llm.common import table

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalog.queries()[name](spark, DATA)
    cur = c.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    norm = lambda r: repr(tuple(round(x, 5) if isinstance(x, float) else x for x in r))
    assert sorted(norm(r) for r in df.select(*names).collect()) == sorted(map(norm, cur.fetchall()))


def test_thirteen_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in catalog.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_all_rows(spark, name):
    rows = catalog.queries()[name](spark, DATA)
    key = "vec_id" if "vec_id" in rows.columns else "doc_id"
    source = table(spark, DATA, "embeddings" if key == "vec_id" else "documents")
    if "piece" in rows.columns:
        rows = rows.where("piece = 0")
    assert Counter(r[key] for r in rows.select(key).collect()) == Counter(r[key] for r in source.select(key).collect())


def test_pipeline(spark):
    docs = table(spark, DATA, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.materialize(stage(spark, kept[-1], DATA), "stage"))
        if name != "token files":
            assert kept[-1].columns == docs.columns
    toxic = {r["doc_id"] for r in toxicity.score(docs, table(spark, DATA, "labels")).where("predicted = 1").collect()}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(kept[1]) == ids(docs) - toxic
    classes = near_duplicates.groups(kept[1])
    assert ids(kept[2]) == {r["class_id"] for r in classes.collect()} and kept[2].count() == len(ids(kept[2]))
    leaks = ids(decontamination.find(kept[2], table(spark, DATA, "benchmark")))
    assert ids(kept[3]) == ids(kept[2]) - leaks
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_report(kept[3]).collect() if r["taken"]}
    assert {r["doc_id"]: r["n"] for r in kept[4].groupBy("doc_id").agg(F.sum(mixing.count_words(F.col("text"))).alias("n")).collect()} == taken
    again = tokenfiles.round_trip(kept[4], catalog.vocabulary("byte_bpe_50k.json"), 2)
    assert Counter(map(tuple, kept[5].collect())) == Counter(map(tuple, again.collect()))
    assert Counter(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == Counter(map(tuple, kept[5].collect()))


ODD = [(1, None, None), (2, "", "a"), (3, "  \n\t ", "a"), (4, "one two\nthree  four", "b"), (4, "one two\nthree  four", "b"), (None, "five", None), (None, None, "b"), (7, "some words to go on with " * 3000, "a"), (9, "a" * 70000, "b")]


@pytest.mark.parametrize("rows", [ODD, [], ODD[:1] * 3])
def test_stages_on_odd_rows(spark, rows):
    """Null ids, texts and sources, empty and very long texts, repeated rows, no rows, columns with clashing names: each stage keeps the columns, and what it must."""
    d = spark.createDataFrame([(i, t, s, len(t or ""), "x", "y", "z") for i, t, s in rows], "doc_id long, text string, source string, n_chars long, d string, _src string, row_hash string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, DATA)
        if name == "token files":
            assert Counter(r["doc_id"] for r in out.collect()) == Counter(i for i, _, _ in rows)
            continue
        assert out.columns == d.columns
        kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
        if name in ("toxicity", "decontamination"):
            assert kept == Counter((i, t) for i, t, _ in rows)
        elif name == "near-duplicates":
            texts = {" ".join((t or "").split()) for _, t, _ in rows}
            assert len(kept) == len(texts)
        else:
            assert {k[0] for k in kept} <= {i for i, t, _ in rows if (t or "").strip()}
