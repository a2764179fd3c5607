"""Frequency of every distinct value or term, kept up to date by signed deltas.

A change of the collection is a set of signed records: +1 for one that was
added, -1 for one that was removed, both for one that changed. Only those are
tokenised; they give each term a change in occurrences and in records, which is
added to the persistent counts. A first build is the delta from nothing. The
counts lie in hash buckets; a merge reads and writes the buckets its terms fall into.

Words are counted per Arrow batch before anything is shuffled, so a term in a
third of all records reaches the shuffle once a batch, not once a record.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions.words import word_list
from tamarisk.operators.store import VersionedTable
from tamarisk.plans.materialise import written

STATE = "lexeme string, n_occ long, ndoc long"
TOTAL = ""  # the state's row that counts records: no term is empty


def record_rows(records: DataFrame, id_col: str = "passage_id", text_col: str = "text") -> DataFrame:
    """(id, text): each id once, though it may be delivered again; of differing texts
    the smallest counts, a null only if there is no other. A null id is no record. Ids are
    shuffled, and the texts of those that repeat; the others stay where they are."""
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    once = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return rows.join(again, "id", "left_anti").unionByName(once)


def signed_changes(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(sign, text) of the records (id, text) that were added, changed or removed."""
    if old is None:
        return new.select(F.lit(1).alias("sign"), "text")
    o = old.select("id", F.col("text").alias("was"), F.lit(True).alias("had"))
    n = new.select("id", "text", F.lit(True).alias("has"))
    both = o.join(n, "id", "full").where("had is null or has is null or not (was <=> text)")
    sides = F.array(
        F.when(F.col("had"), F.struct(F.lit(-1).alias("sign"), F.col("was").alias("text"))),
        F.when(F.col("has"), F.struct(F.lit(1).alias("sign"), F.col("text"))))
    return both.select(F.explode(sides).alias("s")).where("s is not null").select("s.sign", "s.text")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    occ: Counter[str] = Counter()
    docs: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        terms = list(docs)
        out = pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([occ[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
            names=["lexeme", "n_occ", "ndoc"])
        occ.clear()
        docs.clear()
        return out

    for b in batches:
        for sign, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            docs[TOTAL] += sign
            words = word_list(text)
            if sign == 1:
                occ.update(words)
                docs.update(set(words))
            else:
                occ.subtract(words)
                docs.subtract(set(words))
        if len(docs) > 200_000:  # bounds the worker's memory; the sums are the same
            yield flush()
    if docs:
        yield flush()


def term_deltas(changes: DataFrame) -> DataFrame:
    """STATE rows: what the signed records change in each term's counts."""
    part = changes.select("sign", "text").mapInArrow(_count_batches, STATE)
    return part.groupBy("lexeme").agg(F.sum("n_occ").alias("n_occ"), F.sum("ndoc").alias("ndoc")).where("n_occ <> 0 or ndoc <> 0")


def merge_counts(state: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The counts after the deltas; terms that no record holds any more are gone."""
    rows = deltas if state is None else state.unionByName(deltas)
    return rows.groupBy("lexeme").agg(F.sum("n_occ").alias("n_occ"), F.sum("ndoc").alias("ndoc")).where("ndoc > 0")


class TermCounts:
    """Counts that persist in ``path``: a versioned table in hash buckets of its terms.

    A delta reads and writes only the buckets its terms fall into. Deltas have names, and one
    that was applied (a retry after a failure) isn't applied again."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.table = VersionedTable(spark, path, ("lexeme",), buckets)

    def read(self) -> DataFrame | None:
        return self.table.read()

    def applied(self) -> list[str]:
        last = self.table.manifest()
        return [] if last is None else last["facts"]["applied"]

    def apply(self, changes: DataFrame, name: str) -> DataFrame:
        done = self.applied()
        if name not in done:
            deltas = written(term_deltas(changes), "terms")
            touched = self.table.touched(deltas)
            self.table.commit(merge_counts(self.table.read(touched), deltas), touched, facts={"applied": [*done, name]})
        return self.read()


def term_table(counts: DataFrame, rare_below: int = 3, common_over: float = 0.05) -> DataFrame:
    """(lexeme, n_occ, ndoc, df_frac, rare, common). df_frac is of all records, those
    without words among them. An empty collection gives an empty table."""
    counts = written(counts, "terms")
    total = F.lit(counts.where(F.col("lexeme") == TOTAL).agg(F.max("ndoc")).first()[0] or 0)  # one number
    return counts.where(F.col("lexeme") != TOTAL).select(
        "lexeme", "n_occ", "ndoc", (F.col("ndoc") / total).alias("df_frac"),
        (F.col("ndoc") < rare_below).alias("rare"), (F.col("ndoc") > total * common_over).alias("common"))


def marks(table: DataFrame) -> DataFrame:
    """(lexeme, mark): 'rare' and 'common'; a term that is both has two rows."""
    both = F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common")))
    return table.select("lexeme", F.explode(F.array_compact(both)).alias("mark"))
