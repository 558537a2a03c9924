"""A corpus cleaning pipeline of five stages, each an operator of phasegrid.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents; each works on all rows its predecessor kept.

In every stage null texts count as empty (those that stay documents stay null), texts
of any length are taken whole, null doc_ids and repeated rows stay unless the stage
says otherwise, other columns pass through whatever their names, and an empty table
gives an empty result.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm import bpe_codec, decontaminate, secret_scan, simhash, toxicity
from phasegrid.llm.common import BATCH_BYTES, table, written
from phasegrid.plans.ship import ship


#: Bytes of an Arrow batch here: executors hold the workers of several stages, each with its batches.
STAGE_BYTES = BATCH_BYTES // 4


def _ready(spark: SparkSession) -> None:
    """Python workers have the package, and get documents in small batches, from here on."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", STAGE_BYTES)


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with n_chars brought up to date after texts have changed."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects (score of 0.5 or more) go; labels come from the labels table.

    Rows of one text share their fate; without labels of both kinds nobody is rejected.
    """
    labels = table(spark, sf_dir, "labels")
    _ready(spark)
    model = toxicity.fit(docs, labels)
    return docs.filter(toxicity.score(F.col("text"), model) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) the document with the smallest doc_id stays.

    Null doc_ids come last, ties go by a digest of the row; of rows equal in all
    columns one stays; texts without words are copies of each other.
    """
    _ready(spark)
    return simhash.near_duplicates(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside windows of benchmark items are cut from the texts; documents stay, n_chars is counted anew."""
    benchmark = table(spark, sf_dir, "benchmark")
    _ready(spark)
    return _recounted(decontaminate.cleaned(docs, benchmark), docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark, one for secrets that overlap; documents stay, n_chars is counted anew."""
    _ready(spark)
    return _recounted(secret_scan.redacted(docs), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids that decode to them: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    _ready(spark)
    return bpe_codec.op6(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", cut_benchmark),
    ("secret scan", mask_secrets),
    ("bpe encoding", encode),
]

#: The stages hold learnt models, fingerprints and byte-pair merges, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
