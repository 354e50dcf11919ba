"""The corpus pipeline: toxicity, language identification, near-duplicates, packing.

Each stage reads what its predecessor kept, as written Parquet, and decides over all of
it. All but the last return the columns of documents, whatever these are named besides
doc_id, text and lang.

Cases: null and empty texts have no toxic passage and pass the first stage; they have no
letters, so the second drops them. A text of any length is taken whole. Equal or near
copies leave the document of the smallest id; rows that share one id count as one
document there, and one of them stays; rows without an id stay. An empty table passes
every stage as an empty table. Without labels of both kinds nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irloom.llm import langid, minhash, packing, toxicity
from irloom.llm.common import crc_mod, cut, read

TOXIC, UNSURE = 0.7, 0.5
#: Ids of at most so many dropped documents are broadcast; beyond that the tables are joined by shuffle.
BROADCAST_IDS = 200_000
#: Columns of a stage's own, which clash with none of a table.
SCORE, LANG = "__pipeline_score", "__pipeline_lang"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below TOXIC; labels of a third of the ids are not learned from."""
    labels = read(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 3) != 1)
    return toxicity.score(docs, toxicity.fit(docs, labels), docs.columns, to=SCORE).where(F.col(SCORE) < TOXIC).select(*docs.columns)


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without letters, or that no language explains better than the rest, go.

    Where no language could be learned, as no document of the sample names one, all with letters stay.
    """
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    if model is None:
        return docs.where(F.rlike(F.col("text").cast("string"), F.lit(r"\p{L}")))
    told = langid.predict(docs, model, docs.columns, to=(LANG, SCORE))
    return told.where((F.col(LANG) != "und") & (F.col(SCORE) >= UNSURE)).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates; of rows with one id one stays."""
    found = cut(minhash.near_duplicates(docs).select("doc_id", "kept"))
    gone = found.where("NOT kept").select("doc_id").distinct()
    few = gone.count() <= BROADCAST_IDS
    rest = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    return rest if again.isEmpty() else rest.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(rest.where("doc_id IS NULL"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("language_id", with_language),
    ("minhash_dedup", without_near_duplicates),
    ("packing", packed),
]

#: The models of the first two stages have no SQL; tests hold every stage to a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
