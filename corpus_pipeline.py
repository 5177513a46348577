"""From documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm import linededup, mixing, ngram, packing, quality
from lumenrank.llm.common import materialise, row_digest, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant accepts (score of 0.3 or more).

    A null text is scored as an empty one; repeated rows stay or go together; an empty table stays empty.
    """
    return quality.keep_documents(docs, table(spark, sf_dir, "labels"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the multi-line chunks and the passages of over 50 words that stand elsewhere before; every row stays.

    Null texts stay null; rows equal in all columns count as one. ``n_chars``, where there is one, follows a changed text.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    kept = linededup.dedup_repeats(docs.select("doc_id", "text", F.struct(*others).alias("row")))
    out = {c: F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in out:
        changed = (F.col("removed_chunks") > 0) | (F.col("removed_words") > 0)
        out["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return kept.select(*[v.alias(c) for c, v in out.items()])


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of five-word shingle sets with a similarity of 0.8 or more: that of its smallest id.

    Rows are told apart by a key of their own, so repeated ids and rows without an id are rows like others;
    rows without an id come last. Texts without words are linked with nothing and stay.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("key"), row_digest(docs)[0].alias("hash"))
    keyed = materialise(keyed, "keyed-rows")  # the keys must be the same at every reading
    found = ngram.jaccard_components(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), words=5, percent=80)
    found = materialise(found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")), "row-components")
    shared = found.join(found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1"), "component").select("key", "component")
    placed = shared.join(keyed.select("key", "hash", "row.doc_id"), "key")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "key")
    stay = placed.groupBy("component").agg(F.min(order).getField("key").alias("key"))
    gone = shared.join(stay, "key", "left_anti").select("key")
    return keyed.join(gone, "key", "left_anti").select("row.*")


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it.

    A null source is one of its own; null and empty texts have no words, so nothing of them is taken.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in sequences of 2048 tokens; null and empty texts are their end token alone."""
    return packing.pack_documents(docs, end_id=0, capacity=2048)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", remove_near_copies),
    ("mixing sources to target weights", mix_to_weights),
    ("best-fit packing", pack_sequences),
]

#: The fitted classifier, the rolling hashes and the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
