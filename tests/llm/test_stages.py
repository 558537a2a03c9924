"""The stages of the pipeline on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [(1, None), (2, ""), (3, " \n"), (4, "a short one"), (5, LONG), (5, LONG), (None, "no id here at all"), (None, None), (7, "another text with secret: abcdefghijklmnop inside")]
#: Names that operators add or use inside.
CLASHES = ("digest", "node", "fp", "root", "label", "score", "toxicity", "contamination", "secret_spans", "token_ids", "key", "n", "size", "__digest", "__word", "__bit", "__pass", "__kept", "__gone", "__hits", "__Score", "__spans", "__text")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small benchmark and label tables; the labels know a word that marks toxic texts."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, "another text with"), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(d, 1, int(d % 4 == 0)) for d in range(100, 420)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.char_length("text"))
    return df.select(*[F.lit("x").alias(c) for c in CLASHES], "*")


def rows_of(df):
    assert df.filter(" OR ".join(f"{c} <> 'x'" for c in CLASHES)).count() == 0  # other columns are as they were
    return sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, tables, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, documents(spark, []), tables)
    assert out.count() == 0 and (name == "bpe encoding" or out.columns == documents(spark, []).columns)


def test_stages_on_odd_rows(spark, tables):
    df, stage = documents(spark, ROWS), dict(corpus_pipeline.STAGES)
    marked = documents(spark, ROWS + [(d, f"plain words {d} " + ("vileword" if d % 4 == 0 else "kind")) for d in range(100, 420)])
    kept = stage["toxicity"](spark, marked, tables)
    assert kept.columns == df.columns and rows_of(kept) == rows_of(marked.filter("text IS NULL OR text NOT LIKE '%vileword%'"))
    near = stage["simhash near-dedup"](spark, df, tables)
    assert near.columns == df.columns
    assert rows_of(near) == sorted([("1", "None"), ("4", "a short one"), ("5", LONG), ("None", "no id here at all"), ("7", ROWS[-1][1])])
    cut = stage["benchmark decontamination"](spark, df, tables)
    assert cut.columns == df.columns and rows_of(cut) == sorted([(str(d), str(t)) for d, t in ROWS[:-1]] + [("7", " secret: abcdefghijklmnop inside")])
    assert {r["n_chars"] for r in cut.filter("doc_id = 7").collect()} == {32}
    masked = stage["secret scan"](spark, df, tables)
    assert masked.columns == df.columns and rows_of(masked) == sorted([(str(d), str(t)) for d, t in ROWS[:-1]] + [("7", "another text with [SECRET] inside")])
    coded = stage["bpe encoding"](spark, df, tables).collect()
    assert len(coded) == len(ROWS) and sorted(r["n_tokens"] for r in coded)[:3] == [0, 0, 0]
