"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from phasegrid.llm import block_dedup, bpe_codec, decontaminate, media_audio, quality, secret_scan, simhash, suffix_dedup, token_files, toxicity

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, LONG), (5, LONG), (None, "no id here"), (None, None), (7, LONG + " end"), (8, "\x00\x1f<|endoftext|> é한😀 'll  x")]
BENCH = [(1, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"), (1, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"), (2, None), (3, ""), (None, "no id"), (4, "a")]
LABELS = [(1, 1, None), (4, None, 1), (None, 0, 1), (5, 1, 0), (5, 1, 0), (7, 0, 1)]
#: Names that operators add, or use inside.
CLASHES = ("token_ids", "decoded_text", "__text", "media", "audio", "secret_spans", "contamination", "toxicity", "quality_score", "owner", "fp", "component_id", "key", "kept", "removed", "digest", "label")


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select(*[F.lit("x").alias(c) for c in CLASHES], "doc_id", "text")


def bench(spark, rows=BENCH):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def labels(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


OPS = {
    "op1": lambda s, d, b, y: simhash.op1(d),
    "op2": lambda s, d, b, y: suffix_dedup.op2(d),
    "op3": lambda s, d, b, y: media_audio.op3(d),
    "op4": lambda s, d, b, y: decontaminate.op4(d, b),
    "op5": lambda s, d, b, y: quality.op5(d, y),
    "op6": lambda s, d, b, y: bpe_codec.op6(d),
    "op7": lambda s, d, b, y: toxicity.op7(d, y),
    "op8": lambda s, d, b, y: token_files.op8(d),
    "op9": lambda s, d, b, y: block_dedup.op9(d),
    "op10": lambda s, d, b, y: secret_scan.op10(d),
}


@pytest.mark.parametrize("name", OPS)
def test_edges_keep_every_row(spark, name):
    found = OPS[name](spark, documents(spark, ROWS), bench(spark), labels(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(d) for d, _ in ROWS)
    same = [r for r in found if r["doc_id"] == 5]
    assert name == "op8" or same[0] == same[1]


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, name):
    assert OPS[name](spark, documents(spark, []), bench(spark, []), labels(spark, [])).count() == 0


def test_general_interfaces_keep_columns(spark):
    df = documents(spark, ROWS)
    for out, added, replaced in ((bpe_codec.encode_decode(df), {"token_ids", "decoded_text"}, set()), (media_audio.media_columns(df), {"media", "audio"}, set()), (secret_scan.scanned(df), {"secret_spans"}, set()), (decontaminate.marked(df, bench(spark)), {"contamination"}, set()), (quality.scored(df, quality.RuleModel([], 0.0)), {"quality_score"}, set())):
        assert sorted(out.columns) == sorted((set(df.columns) | added) - replaced)
        assert out.count() == len(ROWS)


def test_stages_keep_columns_and_clean_rows(spark):
    df = spark.createDataFrame([(1, LONG), (2, LONG), (3, "something else altogether here"), (None, "no id")], "doc_id bigint, text string").withColumn("component_id", F.lit(9))
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
    cut = decontaminate.cleaned(df, bench(spark, [(1, "something else altogether")])).collect()
    assert {r["doc_id"]: r["text"] for r in cut}[3] == " here"
    assert {r["doc_id"]: r["text"] for r in cut}[1] == LONG
    masked = secret_scan.redacted(spark.createDataFrame([(1, "my password = abcdefghijkl12 ok"), (2, None), (3, "fine")], "doc_id bigint, text string")).collect()
    assert [r["text"] for r in masked] == ["my [SECRET] ok", None, "fine"]
