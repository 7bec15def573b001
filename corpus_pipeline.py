"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, jaccard_join, line_dedup, quality, store
from quern.llm.bloom import sieve

MIN_WORDS = 3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _shaped(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go; documents that fail the base rules or lose too much go. Others keep their other lines.

    A short text is no bad one: only those under ``MIN_WORDS`` words, in which lines have nothing to be judged by, fail for their length.
    """
    out = quality.clean_documents(docs, min_words=MIN_WORDS, carry=["lang", "source"])
    return _shaped(out.filter("kept"))


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents and more stay in the first one only; documents that are left without a word go."""
    out = line_dedup.dedup_lines(docs, min_docs=10, keep="first", carry=["lang", "source"])
    return _shaped(out.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def _named(docs: DataFrame) -> DataFrame:
    """A row's own name beside its id, which may be null or stand with several texts: the digest of its text."""
    return docs.withColumn("text_md5", F.md5(F.coalesce("text", F.lit(""))))


def _key() -> F.Column:
    return F.xxhash64("doc_id", "text_md5")


def _without(spark, docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows but for those whose id and text are among ``gone``; of those among its rows with ``stays``, one for each.

    A filter tells which rows may be named there. All others stay without being shuffled; these are held against ``gone`` exactly.
    """
    asked = sieve(gone.select(_key().alias("key")), store.new_dir(spark, "gone"))
    rows = _named(docs).withColumn("asked", asked(_key()))
    named = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_md5").alias("gone_md5"), "stays")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_md5") == F.col("gone_md5"))
    held = rows.filter("asked").join(named.hint("shuffle_hash"), same, "left")
    again = held.filter("stays").dropDuplicates(["doc_id", "text_md5"])
    return reduce(DataFrame.union, [x.select(*COLUMNS) for x in (rows.filter("NOT asked"), held.filter("stays IS NULL"), again)])


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that a similarity of 0.8 over five-word shingles links, one row stays.

    It is the one with the smallest id (a null id comes last), ties by the text's digest. Of rows that repeat an id and its text, one stays.
    """
    folder = store.new_dir(spark, "near")
    groups = jaccard_join.similar_documents(_named(docs), shingle=5, num=8, den=10, carry=["text_md5"])
    groups = store.table(groups.filter("n_shingles > 0").drop("n_shingles"), f"{folder}/groups")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))  # one row of a group, unless an id stands with several texts or rows
    several = groups.filter(first).groupBy("group", "doc_id").agg(F.min("text_md5").alias("best"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    several = store.table(several, f"{folder}/several")
    other = groups.filter(first).join(several.select("group", "best"), "group").filter("text_md5 <> best")
    gone = groups.filter(~first).select("doc_id", "text_md5").union(other.select("doc_id", "text_md5")).distinct()
    best = several.select("doc_id", F.col("best").alias("text_md5"))
    gone = store.table(gone.withColumn("stays", F.lit(False)).union(best.withColumn("stays", F.lit(True))), f"{folder}/gone")
    return _without(spark, docs, gone)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark passage (ten words and more in a row) stands go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_items(_named(docs), benchmark, size=10, carry=["text_md5"])
    gone = found.filter("n_hit > 0").select("doc_id", "text_md5", F.lit(False).alias("stays")).distinct()
    return _without(spark, docs, store.table(gone, f"{store.new_dir(spark, 'hit')}/rows"))


def encoding(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to."""
    out = bpe.encode_documents(docs, bpe.word_tokenizer(), carry=["lang", "source"])
    return out.select("doc_id", "lang", "source", "n_tokens", F.filter(F.split("ids", " "), lambda x: x != "").cast("array<int>").alias("ids"), "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: Tokens have no SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = store.new_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = store.table(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
