"""A corpus pipeline: language ID, line dedup, near-dedup by SimHash and shingles, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns of
documents. Stages are written as Parquet to the shared folder and read again, so a lost executor costs one stage's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language_id, line_dedup, mixing, packing, shingle_dedup
from plumbline.llm.common import Stash, table

#: A text that even its best language's tree needs more bits a byte for than a uniform code over the symbols is no language.
MOST_BITS = language_id.UNIFORM_BITS


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, hold no letter, or fit no learned language; if no row has a language, all with letters stay."""
    model = language_id.fit(docs)
    scored = language_id.predict(_packed(docs), model, keep=["row"])
    stays = F.col("lang_pred") != language_id.UNDETERMINED if model.langs else F.coalesce(F.col("row.text").rlike(r"\p{L}"), F.lit(False))
    return scored.where(stays & (F.col("bits_per_byte") <= MOST_BITS)).select("row.*")


def _packed(docs: DataFrame) -> DataFrame:
    """Id, text and the whole row, so that no other column can clash with what a stage adds."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat, exactly or nearly, within or across documents; documents stay, if need be with an empty text."""
    out = line_dedup.line_dedup(_packed(docs))
    now = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[now[c].alias(c) if c in now else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity of five-word shingles of 0.8 or more) one document stays."""
    return shingle_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as their sources' targets ask for."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, packing.load_tokenizer())


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("simhash_dedup", dedup_documents), ("mix_weights", mix_sources), ("packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stash = Stash(spark, "pipeline")
    for _, stage in STAGES:
        made = len(Stash.made)
        docs = stash.put(stage(spark, docs, sf_dir))
        Stash.cleared(made)  # the stage's own intermediates
        if stash.n > 1:
            stash.drop(stash.n - 1)
    return docs
