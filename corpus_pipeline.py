"""From raw documents to packed training sequences: toxicity, exact dedup, near-dedup, mixing, packing.

Each stage works on all rows that it is given, and all but the last return the columns of documents. In all stages null texts count as
empty, very long texts are read whole, empty tables give empty ones, and columns beyond those of documents are carried along, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basalt.llm.exact_dedup import exact_dedup
from basalt.llm.mixing import mixed
from basalt.llm.queries import packed_documents
from basalt.llm.shared import stored, table
from basalt.llm.simhash import near_dedup
from basalt.llm.toxicity import drop_toxic, learn


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that a model, learned from all labelled ones, doesn't call toxic.

    Documents without a label, or with unlike ones, teach nothing and are scored like all others; without toxic labels nothing is
    dropped; null and empty texts have no hits and stay; repeated rows share a score.
    """
    return drop_toxic(docs, learn(docs, table(spark, sf_dir, "labels"), folds=1, held=-1))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one of each group of equal texts.

    The smallest id stays, a null id only where the group has no other; of rows that share id and text one stays. All null, empty
    texts are one group, and so are all that are only white space.
    """
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one of each group of near copies.

    The smallest id stays (rows that share it stay together); a group whose ids are all null is kept whole. Empty and blank texts have
    fingerprint zero, so they are one group.
    """
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes them.

    A null source is one source, after all others. Rows without a word are not taken. Rows that are equal in id, source and text are taken
    together; null ids are told apart by source and text.
    """
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs and their places in sequences of 4096 tokens.

    Each copy that the mix made is packed as a document of its own; null ids are kept; a text without tokens is its end token.
    """
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic_documents), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL expresses neither the scores nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs)
    return docs
