"""Write-path operators as pure functions: table states in, the new state out.

Plain Parquet has no row-level update, so a change is a join of the stored state
with the incoming rows, and publishing is a new version of the table. Nothing here reads an order that the input doesn't carry: ``arrival``
columns say which row came later.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamarisk.plans.materialise import numbered

Rule = Callable[[Column, Column], Column]  # (stored, incoming) -> value


def keep(old: Column, new: Column) -> Column:
    return old


def replace(old: Column, new: Column) -> Column:
    return new


def prefer_new(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def last_per_key(incoming: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The row that arrived last of each key (by all columns, if two arrived at once)."""
    rest = [c for c in incoming.columns if c not in keys]
    top = F.max(F.struct(arrival, *[c for c in rest if c != arrival]))
    return incoming.groupBy(*keys).agg(top.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, Rule]) -> DataFrame:
    """Stored rows with the rules applied where a key comes in again, and the new rows.

    ``incoming`` has each key once (see last_per_key). Columns without a rule keep
    the stored value; columns only one side has are null on the other's new rows.
    Keys match as equal, nulls included.
    """
    cols = stored.columns
    old = stored.select(*[F.col(c).alias(f"o_{c}") for c in cols], F.lit(True).alias("o_here"))
    new = incoming.select(*[F.col(c).alias(f"n_{c}") for c in incoming.columns if c in cols], F.lit(True).alias("n_here"))
    on = [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in keys]
    both = old.join(new, on, "full")

    def value(c: str) -> Column:
        o = F.col(f"o_{c}")
        n = F.col(f"n_{c}") if c in incoming.columns else F.lit(None).cast(stored.schema[c].dataType)
        merged = o if c in keys else rules.get(c, keep)(o, n)
        return F.when(F.col("n_here").isNull(), o).when(F.col("o_here").isNull(), n).otherwise(merged).alias(c)

    return both.select(*[value(c) for c in cols])


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Stored rows, and incoming rows of keys that aren't there yet; of several incoming
    rows of a key one is taken (the smallest)."""
    names = [f"_k{i}" for i in range(len(keys))]
    exprs = [F.col(k) if isinstance(k, str) else k for k in keys]
    key = lambda df: df.select("*", *[e.alias(n) for e, n in zip(exprs, names, strict=True)])
    fresh = key(incoming).groupBy(*names).agg(F.min(F.struct(*stored.columns)).alias("_r"))
    new = fresh.join(key(stored).select(*names).distinct(), names, "left_anti").select("_r.*")
    return stored.unionByName(new)


def upsert_documents(stored: DataFrame, incoming: DataFrame, arrival: str, top: int | None = None) -> DataFrame:
    """By (source, ext_id): cited_by and title are replaced, the abstract only by a non-null
    one, all else stays; new documents get ids after the highest (``top``, if given), in key order."""
    keys = ["source", "ext_id"]
    new = last_per_key(incoming, keys, arrival)
    merged = upsert(stored, new, keys, {"cited_by": replace, "title": replace, "abstract": prefer_new})
    top = (stored.agg(F.max("doc_id")).first()[0] or 0) if top is None else top
    named = numbered(merged.where("doc_id is null"), keys, top + 1, "doc_id")
    return merged.where("doc_id is not null").unionByName(named.select(*stored.columns))


def insert_passages(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """By (doc_id, ordinal): what is stored stays, even if the text has changed since."""
    return insert_ignore(stored, incoming, ["doc_id", "ordinal"])


def insert_contexts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """By (citing, cited, hash of the text)."""
    return insert_ignore(stored, incoming, ["citing_doc_id", "cited_doc_id", F.md5("context_text")])


def upsert_labels(stored: DataFrame, incoming: DataFrame, judged: bool) -> DataFrame:
    """By (query_id, doc_id): judged grades replace, derived ones never do."""
    keys = ["query_id", "doc_id"]
    once = incoming.groupBy(*keys).agg(F.max("relevance").alias("relevance"))
    return upsert(stored, once, keys, {"relevance": replace}) if judged else insert_ignore(stored, once, keys)


def delete_documents(doomed: DataFrame, documents: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """Without the doomed doc_ids, their rows in child tables (any column ending in doc_id but
    canonical_doc_id), and pointers to them."""
    ids = doomed.select("doc_id").distinct()
    docs = documents.join(ids, "doc_id", "left_anti")
    gone = ids.select(F.col("doc_id").alias("canonical_doc_id"), F.lit(True).alias("_gone"))
    docs = docs.join(gone, "canonical_doc_id", "left").withColumn(
        "canonical_doc_id", F.when(F.col("_gone").isNull(), F.col("canonical_doc_id"))).select(*documents.columns)
    out = {"documents": docs}
    for name, table in children.items():
        for c in [c for c in table.columns if c.endswith("doc_id")]:
            table = table.join(ids.withColumnRenamed("doc_id", c), c, "left_anti").select(*table.columns)
        out[name] = table
    return out


class VersionedTable:
    """A table in ``path`` that changes by whole versions, in hash buckets of its keys.

    Data folders are never changed. A version is a manifest that names the folder of each
    bucket, and it exists from the moment its file has its name: a writer that dies before
    that leaves the last version in place, and a reader sees one version or the next, never a
    gap. A change writes the buckets it touches; the others' folders are named again.
    ``mark`` says which change a version includes, so that one applied again changes nothing.
    One writer at a time: a second one finds its version's number taken and raises.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = (), buckets: int = 16) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets if keys else 1
        self.mk = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.mk(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self.mk(f"{self.path}/_versions")
        names = [f.getPath().getName() for f in self.fs.listStatus(root)] if self.fs.exists(root) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of the last version, or of one; None where there is none."""
        held = self.versions()
        if not held:
            return None
        source = self.fs.open(self.mk(f"{self.path}/_versions/{held[-1] if version is None else version}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # at most ``buckets`` numbers

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame | None:
        """The rows of the last version (of some buckets); None where there is no version."""
        m = self.manifest(version)
        if m is None:
            return None
        schema = StructType.fromJson(m["schema"])
        at = [f"{self.path}/{folder}" for b, folder in sorted(m["folders"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def commit(self, rows: DataFrame, touched: list[int] | None = None, mark: object = None, facts: dict | None = None) -> dict:
        """A version in which the touched buckets (all by default) hold exactly ``rows``, which may
        have been read from this table. Returns its manifest."""
        last, held = self.manifest(), self.versions()
        folder = f"data-{uuid.uuid4().hex}"
        schema = rows.schema
        rows.withColumn("_bucket", self.bucket()).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        new = {}
        for f in self.fs.listStatus(self.mk(f"{self.path}/{folder}")):
            if (name := f.getPath().getName()).startswith("_bucket="):
                new[name.removeprefix("_bucket=")] = f"{folder}/{name}"
        stay = {} if last is None or touched is None else {b: f for b, f in last["folders"].items() if int(b) not in touched}
        m = {"folders": stay | new, "schema": schema.jsonValue(), "mark": mark, "facts": facts if facts is not None else (last or {}).get("facts", {})}
        self._publish(held[-1] + 1 if held else 0, json.dumps(m))
        return m

    def _publish(self, version: int, text: str) -> None:
        part, whole = self.mk(f"{self.path}/_versions/.part-{uuid.uuid4().hex}"), self.mk(f"{self.path}/_versions/{version}.json")
        out = self.fs.create(part)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(whole) or not self.fs.rename(part, whole):
            raise OSError(f"version {version} of {self.path} was written by another")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all versions but the last ``keep``, and folders no version names. Returns how many
        folders went. Readers of older versions must have ended."""
        held = self.versions()
        for v in held[:-keep]:
            self.fs.delete(self.mk(f"{self.path}/_versions/{v}.json"), False)
        named = {f.split("/")[0] for v in held[-keep:] for f in self.manifest(v)["folders"].values()}
        gone = [f.getPath() for f in self.fs.listStatus(self.mk(self.path)) if f.getPath().getName().startswith("data-") and f.getPath().getName() not in named]
        for f in gone:
            self.fs.delete(f, True)
        return len(gone)


def publish(df: DataFrame, path: str) -> DataFrame:
    """The whole table replaced in one step, and read back: truncate and insert, without a gap."""
    table = VersionedTable(df.sparkSession, path)
    table.commit(df)
    return table.read()


def upsert_queries(stored: DataFrame, incoming: DataFrame, judged: bool) -> tuple[DataFrame, DataFrame]:
    """(queries, ids): eval_queries after (query_text, split) rows came in, and the query_id of each
    incoming text, as an insert that returns ids gives it.

    By query_text. A derived query sets the split of a stored one; a judged one makes it
    manual too. New ones get ids after the highest, in the order of their texts; a text that
    comes in twice is one query with the greater split. A null text is none.
    """
    new = incoming.where("query_text is not null").groupBy("query_text").agg(F.max("split").alias("split")).withColumns(
        {"origin": F.lit("manual" if judged else "citation"), "query_id": F.lit(None).cast("long")})
    rules: dict[str, Rule] = {"split": replace} | ({"origin": replace} if judged else {})
    merged = upsert(stored.select("query_id", "query_text", "origin", "split"), new, ["query_text"], rules)
    top = stored.agg(F.max("query_id")).first()[0] or 0
    named = numbered(merged.where("query_id is null"), ["query_text"], top + 1, "query_id")
    queries = merged.where("query_id is not null").unionByName(named.select("query_id", "query_text", "origin", "split"))
    return queries, queries.join(new.select("query_text"), "query_text", "left_semi").select("query_text", "query_id")


def upsert_log(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """ingest_log by query: a later fetch replaces count and time; of one given twice the latest stays."""
    return upsert(last_per_key(stored, ["query"], "fetched_at"), last_per_key(fetched, ["query"], "fetched_at"), ["query"], {"n_docs": replace, "fetched_at": replace})
