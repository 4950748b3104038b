"""A corpus pipeline over ``documents``: language, repeated lines, near copies, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read again as the next one's docs. All
but the last return the columns of documents. Nulls, empty and very long texts, repeated rows and empty tables are
handled as the stages' operators say; rows with a null id don't pass the second stage; further columns go along
unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read
from tessera.llm.language_id import held_out, predict_languages, train
from tessera.llm.line_dedup import remove_repeated_lines
from tessera.llm.mixing import length_class, mix_tempered
from tessera.llm.ngram_join import BROADCAST_IDS, ngram_jaccard_components
from tessera.llm.packing import pack_documents
from tessera.llm.queries import word_tokenizer_path

#: A prediction whose language has less than this share of the likelihood of the text's words, on average, rejects it.
LEAST_SCORE = 0.5
#: A line of more words than this is a repeated passage by itself.
LONG_WORDS = 50
#: Share of the tokens that the source mix keeps.
KEEP = 0.8


def _packed(docs: DataFrame, *own: str) -> DataFrame:
    """The rows but for their texts as one column, so that no column of theirs clashes with an operator's, and what it reads.

    The text is always among that: it goes along once.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), *own)


def _unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs from rows, some of them changed."""
    own = lambda c: F.col("text") if c == "text" else F.col("row").getField(c)
    return rows.select(*[changed.get(c, own(c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; a missing language is filled in."""
    model = train(docs.filter(~held_out("doc_id")))
    out = predict_languages(_packed(docs, "text"), model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return _unpacked(out, docs, lang=F.coalesce("row.lang", "lang_pred"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of two or more lines, and the lines of over 50 words, that occur before; those with nothing else left go."""
    out = remove_repeated_lines(_packed(docs, "doc_id", "text"), min_lines=2, long_words=LONG_WORDS)
    left = out.filter("n_removed < n_lines or n_removed = 0")
    return _unpacked(left, docs, n_chars=F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    groups = ngram_jaccard_components(docs, n=5, num=80, den=100)
    gone = materialize(groups.filter("doc_id <> component_id").select("doc_id").distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources and languages have shares nearer to each other than before."""
    margins = {"source": F.col("row.source"), "lang": F.col("row.lang"), "topic": length_class(F.col("text"))}
    return _unpacked(mix_tempered(_packed(docs, "doc_id", "text"), margins, 0.8, keep=KEEP), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return pack_documents(docs, word_tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard_join", near_copies), ("source_mix", source_mix), ("best_fit_packing", packing)]

#: Language ID, the mix and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
