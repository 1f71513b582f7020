"""A corpus pipeline of five stages; each takes all documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.common import cut, documents
from retort.llm.mixing import mixed
from retort.llm.ngram_join import one_of_each
from retort.llm.pieces import encode_documents, load_pieces
from retort.llm.pii import redact
from retort.llm.toxicity import score_toxicity


#: Rows of a batch that goes to Python: texts may be long, and a batch is held on both sides.
BATCH = "1000"


def _short_batches(spark: SparkSession) -> None:
    """Lets the session send at most BATCH rows to Python at once, if it would send more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= int(BATCH):
        spark.conf.set(name, BATCH)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; the labels' held-out rows are never trained on.

    Null and empty texts are scored as texts without words, and so stay; repeated rows are judged alike. Columns of any
    name stay, as only doc_id and text are looked at. An empty table gives no rows.
    """
    _short_batches(spark)
    needed = ("doc_id", "text")
    inner = docs.select(*needed, F.struct(F.lit(0).alias("_none_"), *(c for c in docs.columns if c not in needed)).alias("_doc"))
    kept = score_toxicity(inner, documents(spark, sf_dir, "labels")).where("predicted = 0")
    return kept.select(*(F.col(c) if c in needed else F.col("_doc")[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Null, empty and blank texts and rows without doc_id stay. Of exact copies and repeated rows one stays, of rows of one
    doc_id those whose texts aren't alike. Columns of any name stay. An empty table gives no rows.
    """
    _short_batches(spark)
    return one_of_each(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null and empty texts stay as they are, as do all other columns."""
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: documents as often as they are taken.

    Null and empty texts have no words and are never taken; a null source is a source. Columns of any name stay. An empty
    table gives no rows.
    """
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document: doc_id, lang, source (those of them that there are), n_tokens, ids; other columns go.

    Null and empty texts have no ids; a row per row, repeated ones too. An empty table gives no rows.
    """
    import public_tokenizers

    _short_batches(spark)
    model = load_pieces(str(public_tokenizers.path("piece_bpe_32k.model")))
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return encode_documents(docs, model).select(*kept, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("mixing", source_mix),
    ("sentencepiece", encoding),
]

#: SQL can express neither the classifiers nor the encoding; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the checkpoint folder before the next reads it."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
