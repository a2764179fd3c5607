"""The tables: columns, keys, checks, and what breaks them.

Parquet declares nothing but types, so the rest is checked: one row a constraint with
the number of rows that break it. Creating tables is idempotent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    columns: str  # as DDL
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    refers: tuple[tuple[str, str, str], ...] = ()  # column, table, column
    checks: tuple[tuple[str, str], ...] = ()  # name, condition that must hold (or be null)


TABLES = {
    "documents": Table(
        "doc_id long, source string, ext_id string, pmid string, pmcid string, doi string, title string, abstract string, journal string, "
        "pub_year int, cited_by int, is_open_access boolean, ingested_at timestamp, canonical_doc_id long",
        ("doc_id",), ("source", "ext_id", "title", "ingested_at"), (("source", "ext_id"),), (("canonical_doc_id", "documents", "doc_id"),)),
    "passages": Table(
        "passage_id long, doc_id long, ordinal int, section string, text string, embedding array<float>",
        ("passage_id",), ("doc_id", "ordinal", "section", "text"), (("doc_id", "ordinal"),), (("doc_id", "documents", "doc_id"),),
        (("embedding_dim", "size(embedding) = 64"),)),
    "citation_contexts": Table(
        "ctx_id long, citing_doc_id long, cited_doc_id long, context_text string",
        ("ctx_id",), ("citing_doc_id", "cited_doc_id", "context_text"), (("citing_doc_id", "cited_doc_id", "context_text"),),
        (("citing_doc_id", "documents", "doc_id"), ("cited_doc_id", "documents", "doc_id"))),
    "lexeme_df": Table("lexeme string, ndoc int, df_frac float, built_at timestamp", ("lexeme",), ("ndoc", "df_frac", "built_at")),
    "eval_queries": Table(
        "query_id long, query_text string, origin string, split string", ("query_id",), ("query_text", "origin", "split"), (("query_text",),),
        (), (("split_known", "split in ('train', 'dev', 'test')"), ("origin_known", "origin in ('citation', 'manual')"))),
    "eval_qrels": Table(
        "query_id long, doc_id long, relevance int", ("query_id", "doc_id"), ("relevance",), (),
        (("query_id", "eval_queries", "query_id"), ("doc_id", "documents", "doc_id")), (("relevance_range", "relevance between 0 and 3"),)),
    "ingest_log": Table("query string, n_docs int, fetched_at timestamp", ("query",), ("n_docs", "fetched_at")),
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], StructType.fromDDL(TABLES[name].columns))


def create_missing(spark: SparkSession, folder: str) -> list[str]:
    """Writes each table that isn't in the folder yet, empty; returns their names."""
    mk = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    made = []
    for name in TABLES:
        path = mk(f"{folder.rstrip('/')}/{name}.parquet")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            empty(spark, name).write.parquet(path.toString())
            made.append(name)
    return made


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, constraint_name, n_rows): rows that break each constraint of the tables given. Of a
    repeated key all rows but one count; a reference is broken where its target has no such row;
    a null breaks only what requires a value. Columns that aren't declared are left alone."""
    out = None
    for name, df in sorted(tables.items()):
        t = TABLES[name]
        absent = [F.count_if(F.col(c).isNull()).alias(f"required {c}") for c in (*t.key, *t.required)]
        broken = [F.count_if(~F.expr(cond)).alias(f"check {n}") for n, cond in t.checks]
        one = df.agg(*absent, *broken)
        parts = [one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("constraint_name"), F.col(f"`{c}`").alias("n_rows")) for c in one.columns])).alias("x")).select("x.*")]
        for key in (t.key, *t.unique):
            whole = F.lit(True)
            for c in key:
                whole = whole & F.col(c).isNotNull()
            once = df.where(whole).groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("again"))
            parts.append(once.agg(F.coalesce(F.sum("again"), F.lit(0)).alias("n_rows")).select(F.lit(f"unique {', '.join(key)}").alias("constraint_name"), "n_rows"))
        for col, target, at in t.refers:
            if target in tables:
                known = tables[target].select(F.col(at).alias(col)).where(F.col(col).isNotNull()).distinct()
                lost = df.select(col).where(F.col(col).isNotNull()).join(known, col, "left_anti")
                parts.append(lost.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(f"refers {col}").alias("constraint_name"), "n_rows"))
        for p in parts:
            row = p.select(F.lit(name).alias("table_name"), "constraint_name", F.col("n_rows").cast("long").alias("n_rows"))
            out = row if out is None else out.unionByName(row)
    return out
