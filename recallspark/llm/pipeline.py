"""A training corpus from raw documents: language, repeated lines, near copies, repeated passages, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm import language_id, line_dedup, packing, simhash, substring_dedup
from recallspark.llm.common import materialize, scope, table

#: Documents whose language is less sure than this are rejected, as are those without any letter.
LEAST_SCORE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    out = docs.withColumn("text", F.col(text)).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages; learns from the labelled ones among them.

    Null texts and texts without letters go; repeated rows and rows that share an id are judged each by its text; null ids stay;
    ties between languages go to the first by name; an empty table gives no rows; other columns than those of documents are dropped.
    """
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out chunks of lines that an earlier document holds; every document stays.

    Null texts stay null; identical rows do not thin each other out; null ids count as the earliest; an empty table gives no rows;
    other columns than those of documents are dropped.
    """
    return _with_text(line_dedup.line_dedup(docs.select(*COLUMNS), carry=["lang", "source", "n_chars"]), "text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that with the smallest id (null last), then by its text and other columns.

    Near copies share at least 0.8 of their five-word shingles, directly or through others of the group. Of repeated rows one
    stays, as does one of rows that share an id and a text; null texts count as empty; an empty table gives no rows; other
    columns than those of documents are dropped.
    """
    first = simhash.first_of_similar(docs).select(F.col("doc_id").alias("kept_id"), F.col("same").alias("kept_same"))
    rows = docs.select(*COLUMNS, simhash.same_text("text").alias("same"))
    # a text that occurs once under its id needs no choice, so only repeated rows are grouped with their texts
    times = rows.groupBy("doc_id", "same").agg(F.count("*").alias("times")).where("times > 1").withColumnsRenamed({"doc_id": "id", "same": "s"})
    first = materialize(first.join(times, F.col("kept_id").eqNullSafe(F.col("id")) & (F.col("kept_same") == F.col("s")), "left").select("kept_id", "kept_same", F.col("times").isNotNull().alias("repeated")))
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("same") == F.col("kept_same")))
    others = [c for c in COLUMNS if c != "doc_id"]
    one = kept.where("repeated").groupBy("doc_id", "same").agg(F.min(F.struct(*others)).alias("r")).select("doc_id", *(F.col(f"r.{c}").alias(c) for c in others))
    return kept.where("not repeated").select(*COLUMNS).unionByName(one)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words of passages that an earlier document holds; every document stays.

    Null texts become empty; rows that share an id or have none do not thin each other out; repeated rows stay; an empty table
    gives no rows; other columns than those of documents are dropped.
    """
    return _with_text(substring_dedup.substring_dedup(docs, carry=["lang", "source", "n_chars"]), "kept")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences.

    Null texts give their end token alone; repeated rows give their pieces each; null ids stay null; an empty table gives no rows.
    """
    pieces = packing.token_pieces(docs)
    pieces = materialize(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(pieces, ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("substring dedup", without_repeated_passages),
    ("best-fit packing", packed_sequences),
]

#: SQL can express neither the learned model nor the vocabulary; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each on what its predecessor wrote.

    What a stage wrote besides its result is deleted once the result is written, and so is the result when the next one is; the last stage's
    result is lazy and keeps what it reads (see `common.release`).
    """
    docs, path = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for _, stage in STAGES[:-1]:
        with scope(spark, path) as keep:
            docs, path = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
