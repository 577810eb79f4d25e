"""The corpus pipeline: language ID, exact dedup, Jaccard join, decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), keeps rows of documents whole and drops what it rejects; the last returns token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.common import cut, forget, shared_dir
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.exact_dedup import survivors
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.registry import SENTENCEPIECE_MODEL
from tidemark.llm.sentencepiece_codec import encode

#: Documents whose best language has less of the probability than this are rejected, as are those without letters.
MIN_LANGUAGE_SCORE = 0.3
#: Near copies share this many words in a row, and this share (in percent) of what either has.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _beside(docs: DataFrame) -> DataFrame:
    """The text, and beside it the rest of the row: operators that tell each row by itself hand both through, so no join is needed."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")


def _tie(docs: DataFrame) -> Column:
    """A digest of the whole row, which orders rows of equal id the same way in each run. Maps have no hash; their JSON has."""
    plain = [F.to_json(F.struct(f.name)) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*plain)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is told by its own text, whatever its id is."""
    found = langid.identify(_beside(docs), langid.fit(docs), "row", with_text=True)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*", "text").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that with the largest id; a null id is the smallest, and of rows that repeat the id one stays."""
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    return survivors(docs, F.struct(F.col("doc_id"), _tie(docs)), rest).select("row.*", "text").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which 80 % of the shingles of five words are the same are linked. Of each component the row with the smallest id stays; a null id
    is the largest. Every row is a document of its own: rows that repeat an id stay unless their texts are near copies. Rows get a number
    that is written with them before anything reads it, so it can't change when a task runs again or cores come and go."""
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    keyed = cut(docs.select(rest.alias("row"), "text", _tie(docs).alias("tie"), F.monotonically_increasing_id().alias("key")))
    told = jaccard_components(keyed.select("key", "text"), "key", size=NEAR_WORDS, num=NEAR_PERCENT).select("key", "component_id")
    told = told.join(keyed.select("key", "tie", "row.doc_id"), "key")
    least = told.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "key")).alias("least"))
    return keyed.join(least.select("least.key"), "key", "left_semi").select("row.*", "text").select(docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is told by its own text, whatever its id is."""
    found = decontaminate(_beside(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "row", with_text=True)
    return found.filter("NOT contaminated").select("row.*", "text").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, SENTENCEPIECE_MODEL)


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", clean), ("sentencepiece", tokens)]

#: The language model, the components and the token ids have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = []
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        forget(spark, *before)  # nothing reads the stage before any more
        before = [f"{base}/{name}"]
    return STAGES[-1][1](spark, docs, sf_dir)
