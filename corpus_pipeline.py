"""The corpus pipeline: quality classifier, SimHash near-dedup, suffix-array dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm import gam, packing, simhash, suffix
from barlab.llm.shared import drop, keep, marked, may_hold


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier scores below 0.3. All columns and other rows stay as they are.

    Null and empty texts are scored like any other. Without labels every score is 0.5 and all stay."""
    model = gam.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return docs.where(gam.quality(model, "text") >= 0.3)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more): the smallest doc_id.

    Null and empty texts are one group. Null ids come after all others. Rows of one group with one doc_id
    and different texts: one of them stays; in different groups: each as its group says. Of repeated
    rows one stays. Only rows that a bitmap of bounded size can't tell from those that go are shuffled."""
    found = simhash.near_duplicate_groups(docs.select("doc_id", "text"))
    pairs = keep(found.groupBy("root", "doc_id", "row_key").agg(F.count("*").alias("rows")), "rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    stays = keep(pairs.groupBy("root").agg(F.min_by(F.struct("doc_id", "row_key"), order).alias("s")), "stays")
    own = (F.col("p.doc_id").eqNullSafe(F.col("s.doc_id"))) & (F.col("p.row_key") == F.col("s.row_key"))
    told = pairs.alias("p").join(stays.select("root", "s.doc_id", "s.row_key").alias("s"), "root")
    told = keep(told.select(F.col("p.doc_id").alias("id"), F.col("p.row_key").alias("key"), own.alias("stays"), "rows"), "told")
    drop(found, pairs, stays)
    columns = [f"`{c}`" for c in docs.columns]
    keyed = docs.withColumn("_row_key", simhash.row_key())
    same = (F.col("_row_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))
    gone = told.where("not stays")
    clear, maybe = may_hold(keyed, "_row_key", marked(gone, "key"))
    kept = clear.unionByName(maybe.join(gone.select("id", "key"), same, "left_anti"))
    again = told.where("stays and rows > 1")
    if again.head(1):
        clear, maybe = may_hold(kept, "_row_key", marked(again, "key"))
        once = maybe.join(again.select("id", "key"), same, "left_semi").groupBy("doc_id",
            "_row_key").agg(F.min_by(F.struct(*columns), F.xxhash64(*_hashable(docs))).alias("row"))
        kept = clear.unionByName(maybe.join(again.select("id", "key"), same, "left_anti")).select(*columns).unionByName(once.select("row.*"))
    return kept.select(*columns)


def _hashable(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts from each text what is covered by 50-byte strings that also start in a document with a smaller
    doc_id, in whole characters, and sets n_chars anew. No row goes; a null text stays null; a null doc_id
    comes after all others. All other columns, of any type and name, go beside the text as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(F.col("text").isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(others)])
    out = suffix.repeated_strings(docs.select("doc_id", "text", rest.alias("rest")), 50, whole_characters=True)
    text = F.when(~F.col("rest.none"), F.decode("kept", "UTF-8"))
    columns = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"rest.c{n}") for n, c in enumerate(others)}
    if "n_chars" in columns:
        columns["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's tokens lies in the packed sequences. Null and empty texts are their end token."""
    return packing.packed_documents(docs)


STAGES = [("quality classifier", quality_classifier), ("SimHash near-dedup", simhash_near_dedup), ("suffix-array dedup", suffix_array_dedup), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


#: The classifier and SimHash can't be expressed in SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
