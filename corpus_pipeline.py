"""A training-data pipeline over documents: five stages, each written as Parquet and read again by the next.

Each stage keeps the columns of documents, but for the last, which adds the token ids' figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.bpe import encode_documents
from tallyframe.llm.jaccard import BROADCAST_IDS, jaccard_components
from tallyframe.llm.langid import UNDETERMINED, predict, train
from tallyframe.llm.mixing import mix_sources
from tallyframe.llm.suffixdedup import dedup_substrings
from tallyframe.storage import Tables, discard, materialize, owned

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if no language gets this share of its positions' probability.
LEAST_SCORE = 0.4


def _without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key is not among ids: a broadcast while ids are few, a shuffled join beyond."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an undetermined language go: no text, no letter, or no language with LEAST_SCORE. Each row goes by
    its own verdict. Where nothing is labelled nothing can be learned, and all documents pass."""
    docs = docs.select(*COLUMNS)
    network = train(docs)
    if network is None:
        return docs
    told = predict(docs, network, COLUMNS)
    return told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the row of smallest doc_id stays, a null
    one last. Where doc_ids are null or repeated, rows are told apart by a key of their own, written with them."""
    docs = docs.select(*COLUMNS)
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").take(1):
        groups = jaccard_components(docs.select("doc_id", "text"), words=5, percent=80)
        copies = materialize(groups.where("component_id <> doc_id").select("doc_id").distinct(), "pipeline-copies")
        return _without(docs, copies)
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    groups = jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"), words=5, percent=80)
    members = materialize(groups.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id"), "_row"), "pipeline-members")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"]
    stay = members.groupBy("component_id").agg(best.alias("_row")).select("_row")
    copies = materialize(members.select("_row").join(stay, "_row", "left_anti"), "pipeline-copies")
    return _without(rows, copies, "_row").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stood earlier are cut out of the texts; a document left empty goes."""
    cut = dedup_substrings(docs.select(*COLUMNS), with_text=True, keep=("lang", "source"))
    return cut.where(F.length("kept_text") > 0).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources alike: each document as often as its source's rate draws, in shuffled order."""
    return mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_tokens and digests of the ids and of the bytes decoded from them, for every row."""
    import public_tokenizers

    return encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


_before = Tables()


def _stage(f):
    """Drops the working tables of the stage before, whose result is written by now, and owns those of this one."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _before
        _before.release(spark)
        with owned() as _before:
            return f(spark, docs, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


STAGES = [(f.__name__, _stage(f)) for f in (language_id, ngram_join, suffix_dedup, mix, encode)]
#: The stages train a network and build suffix arrays, which SQL cannot express; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written in the shared folder and read again. A stage's
    table goes once the next one's is written; the last is read by the result and goes when the driver ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
