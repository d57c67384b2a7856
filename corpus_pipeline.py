"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs; all but the last return the
columns of documents, in their order.

Defined cases, by stage; all stages read texts whole, of any length, treat an
empty table as an empty result and keep columns beside those of documents,
whatever their names:

* quality_classifier: a null or empty text has log ratio 0; a null id gets the
  noise of the text "null"; documents with the key of the cut stay; repeated rows
  stay or go together; without two labelled good documents all stay.
* exact_dedup: null counts as empty; of equal texts one row stays, the one with the
  largest id, null ids last; of repeated rows one stays.
* minhash_near_dedup: texts without words stay, each by itself; of a group the
  smallest id stays, of null ids alone one row of each text.
* source_mixing: a null source is one of its own; rows equal in id and text get
  the same number of copies; a text without words has no size and takes the
  rate of its source.
* best_fit_packing: a null or empty text is the single end token; a document
  taken several times is packed as often; texts longer than a sequence are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import classifier, exact_dedup, minhash, mixing, packing
from docloom.llm.common import removed, table, written
from docloom.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_sampled(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None  # model scores and tokenisation can't be expressed in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            made = written(made, name)
            removed(docs)  # the stage before is in the table that stands now
        docs = made
    return docs
