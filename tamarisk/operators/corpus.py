"""From documents to what retrieval reads: passages, postings, statistics, clusters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.config import Settings
from tamarisk.functions.stem import STOP_WORDS, stem
from tamarisk.functions.text import ascii_words, fold_tail, head_passage, sentences, title_key, tokens, windows_of


def unique_passages(passages: DataFrame) -> DataFrame:
    """(passage_id, doc_id, ordinal, section, text): a passage delivered again counts once.

    The smallest row wins, so the result doesn't depend on order; a null id is no passage.
    Only ids are shuffled, and the rows of those that repeat: the other texts stay where they are.
    """
    cols = ("doc_id", "ordinal", "section", "text")
    rows = passages.select("passage_id", *cols).where("passage_id is not null")
    again = rows.groupBy("passage_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("passage_id")
    merged = rows.join(again, "passage_id", "left_semi").groupBy("passage_id").agg(F.min(F.struct(*cols)).alias("r")).select("passage_id", "r.*")
    return rows.join(again, "passage_id", "left_anti").unionByName(merged)


def chunk_documents(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, ordinal, section, text): the title with the first sentence, then overlapping
    windows; exact repeats and empty texts are dropped, the first occurrence stays.

    Step by step, so that no step's expression is evaluated once per use.
    """
    rows = documents.select("doc_id", "title", sentences(F.col("abstract")).alias("sents"))
    rows = rows.select("doc_id", head_passage(F.col("title"), F.col("sents"), s.max_chars).alias("head"),
                       windows_of(F.col("sents"), s.window, s.stride, s.max_chars).alias("wins"))
    rows = rows.select("doc_id", "head", fold_tail(F.col("wins"), s.min_chars, s.max_chars).alias("wins"))
    texts = F.array_distinct(F.filter(F.concat(F.array("head"), "wins"), lambda t: t != ""))
    return rows.select("doc_id", "head", F.posexplode(texts).alias("ordinal", "text")).select(
        "doc_id", "ordinal", F.when(F.col("text") == F.col("head"), "title").otherwise("abstract").alias("section"), "text")


def postings(passages: DataFrame) -> DataFrame:
    """(passage_id, lexeme, tf): one row per passage and distinct lexeme; no row without tokens.

    Passage ids are unique (see unique_passages), so a passage's words are sorted and counted
    where it is read, and nothing is shuffled."""
    rows = passages.select("passage_id", F.sort_array(tokens(F.col("text"))).alias("ws"))
    first = F.filter(F.transform("ws", lambda w, i: F.when((i == 0) | (F.get("ws", i - 1) != w), i)), lambda i: i.isNotNull())
    rows = rows.select("passage_id", "ws", first.alias("at"))
    runs = F.transform("at", lambda i, n: F.struct(F.get("ws", i).alias("lexeme"), (F.coalesce(F.get("at", n + 1), F.size("ws")) - i).cast("long").alias("tf")))
    return rows.select("passage_id", F.explode(runs).alias("x")).select("passage_id", "x.lexeme", "x.tf")


def positions(passages: DataFrame) -> DataFrame:
    """(passage_id, lexeme, positions): 1-based, ascending."""
    return passages.select("passage_id", F.posexplode(tokens(F.col("text"))).alias("pos", "lexeme")).groupBy("passage_id", "lexeme").agg(
        F.sort_array(F.collect_list(F.col("pos") + 1)).alias("positions"))


def english(raw: DataFrame, *more: str) -> DataFrame:
    """Rows with a ``lexeme`` without those of stop words, the others stemmed: each distinct
    word once, then joined back."""
    words = raw.select("lexeme").distinct().where(~F.col("lexeme").isin(*STOP_WORDS)).select("lexeme", stem(F.col("lexeme")).alias("stemmed"))
    return raw.join(words, "lexeme").select(*more, F.col("stemmed").alias("lexeme"), *[c for c in raw.columns if c not in (*more, "lexeme")])


def stemmed_postings(passages: DataFrame) -> DataFrame:
    """As postings, by the English analysis: stop words left out, the other tokens stemmed."""
    return english(postings(passages), "passage_id").groupBy("passage_id", "lexeme").agg(F.sum("tf").alias("tf"))


def english_vectors(passages: DataFrame) -> DataFrame:
    """(passage_id, lexeme, positions): stems with their places, 1-based, ascending; stop words
    have none but are counted."""
    return english(positions(passages), "passage_id").groupBy("passage_id", "lexeme").agg(
        F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def lexeme_statistics(passages: DataFrame) -> DataFrame:
    """(lexeme, ndoc, nentry, df_frac): df_frac is single precision, of all passages, those
    without tokens among them. An empty corpus gives an empty table.

    A passage's words are sorted where they are read, so the first of each counts it once and
    one aggregate, combined before the shuffle, gives both counts."""
    total = F.lit(passages.select("passage_id").count())
    each = passages.select(F.sort_array(tokens(F.col("text"))).alias("ws"))
    first = each.select(F.explode(F.transform("ws", lambda w, i: F.struct(
        w.alias("lexeme"), ((i == 0) | (F.get("ws", i - 1) != w)).cast("int").alias("first")))).alias("x")).select("x.*")
    return first.groupBy("lexeme").agg(F.sum("first").alias("ndoc"), F.count(F.lit(1)).alias("nentry")).select(
        "lexeme", "ndoc", "nentry", (F.col("ndoc") / total).cast("float").alias("df_frac"))


def counted_statistics(passages: DataFrame) -> DataFrame:
    """As lexeme_statistics, of unique passages: words are counted in Python where texts are read, so
    that a part gives a row a word."""
    total = F.lit(passages.select("passage_id").count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ndoc, nentry = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            words = pa.array(list(nentry), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array([ndoc[w] for w in nentry], pa.int64()), pa.array(list(nentry.values()), pa.int64())], names=["lexeme", "ndoc", "nentry"])

        for b in batches:
            for text in b.column(0).to_pylist():
                ws = ascii_words(text)
                nentry.update(ws)
                ndoc.update(set(ws))
            if len(nentry) > 200_000:
                yield rows()
                ndoc.clear()
                nentry.clear()
        yield rows()

    each = passages.select(F.col("text").cast("binary")).mapInArrow(run, "lexeme string, ndoc long, nentry long")
    return each.groupBy("lexeme").agg(F.sum("ndoc").alias("ndoc"), F.sum("nentry").alias("nentry")).select(
        "lexeme", "ndoc", "nentry", (F.col("ndoc") / total).cast("float").alias("df_frac"))


def statistics_of(rows: DataFrame, n_passages: int) -> DataFrame:
    """As lexeme_statistics, from postings."""
    return rows.groupBy("lexeme").agg(F.count(F.lit(1)).alias("ndoc"), F.sum("tf").alias("nentry")).select(
        "lexeme", "ndoc", "nentry", (F.col("ndoc") / F.lit(n_passages)).cast("float").alias("df_frac"))


def common_lexemes(stats: DataFrame, max_df: float = 0.05) -> DataFrame:
    """(lexeme, ndoc) over the threshold: exactly max_df in single precision is over it."""
    return stats.where(F.col("df_frac") > F.lit(float(max_df))).select("lexeme", "ndoc")


def canonical_documents(documents: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, canonical_doc_id) of documents whose title key is long enough: the cluster's
    lowest doc_id, a preprint (source PPR) only if it has no other member. A cluster
    of any size is one aggregate row, not a window."""
    keyed = documents.select("doc_id", "source", title_key(F.col("title")).alias("k")).where(F.length("k") >= min_chars)
    order = F.struct(F.coalesce(F.col("source") == "PPR", F.lit(False)), F.col("doc_id"))
    best = keyed.groupBy("k").agg(F.min_by("doc_id", order).alias("canonical_doc_id"))
    return keyed.join(best, "k").select("doc_id", "canonical_doc_id")


def canonical_map(canonical: DataFrame) -> DataFrame:
    """(doc_id, canonical_doc_id) of merged documents only."""
    return canonical.where("canonical_doc_id is not null and canonical_doc_id <> doc_id").select("doc_id", "canonical_doc_id")


def canonical_statistics(canonical: DataFrame) -> DataFrame:
    """One row: merged documents, and clusters they were merged into."""
    moved = F.col("canonical_doc_id") != F.col("doc_id")
    return canonical.agg(F.count_if(moved).alias("merged"), F.count_distinct(F.when(moved, F.col("canonical_doc_id"))).alias("clusters"))


def to_canonical(df: DataFrame, cmap: DataFrame, col: str = "doc_id", out: str = "cluster") -> DataFrame:
    """Adds the cluster of ``col``: itself where the map has no entry."""
    m = cmap.select(F.col("doc_id").alias(col), F.col("canonical_doc_id").alias("_canon"))
    return df.join(m, col, "left").withColumn(out, F.coalesce("_canon", col)).drop("_canon")


def unembedded(passages: DataFrame) -> DataFrame:
    """Passages of which no delivery has a vector: (passage_id, doc_id, text)."""
    have = passages.where("embedding is not null").select("passage_id")
    return unique_passages(passages).join(have, "passage_id", "left_anti").select("passage_id", "doc_id", "text")


def corpus_statistics(documents: DataFrame, passages: DataFrame, contexts: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row of six counts, over distinct keys."""
    d = documents.agg(F.count_distinct("doc_id").alias("documents"))
    seen = passages.groupBy("passage_id").agg(F.count("embedding").alias("v")).where("passage_id is not null")
    p = seen.agg(F.count(F.lit(1)).alias("passages"), F.count_if(F.col("v") == 0).alias("unembedded"))
    c = contexts.select("citing_doc_id", "cited_doc_id", F.md5("context_text")).distinct().agg(F.count(F.lit(1)).alias("citation_contexts"))
    q = queries.agg(F.count_distinct("query_id").alias("eval_queries"))
    r = qrels.select("query_id", "doc_id").distinct().agg(F.count(F.lit(1)).alias("eval_qrels"))
    named = None
    for one in (d, p, c, q, r):
        for name in one.columns:
            row = one.select(F.lit(name).alias("name"), F.col(name).alias("n"))
            named = row if named is None else named.unionByName(row)
    names = ("documents", "passages", "unembedded", "citation_contexts", "eval_queries", "eval_qrels")
    return named.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names])


def documents_with_passages(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Each document with its passages as an array of structs in the order of ordinal; empty if none."""
    kids = unique_passages(passages).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "passage_id", "section", "text"))).alias("passages"))
    return documents.join(kids, "doc_id", "left").withColumn(
        "passages", F.coalesce("passages", F.array().cast("array<struct<ordinal:int,passage_id:bigint,section:string,text:string>>")))


def lead_passages(passages: DataFrame) -> DataFrame:
    """(doc_id, passage_id, text): the first passage of each document by ordinal, then id."""
    best = F.struct("ordinal", "passage_id", "text")
    return unique_passages(passages).where("ordinal is not null").groupBy("doc_id").agg(F.min(best).alias("b")).select(
        "doc_id", "b.passage_id", "b.text")



class NotFound(LookupError):
    """No document has the id asked for."""


def check_id(doc_id: int) -> int:
    if isinstance(doc_id, bool) or not isinstance(doc_id, int) or doc_id < 1:
        raise ValueError(f"a document id is a whole number from 1 on, not {doc_id!r}")
    return doc_id


def get_documents(wanted: DataFrame, documents: DataFrame, passages: DataFrame) -> DataFrame:
    """The documents of a batch of ids (doc_id), each once, with their passages; ``found`` is
    false, and all else null, where no document has the id."""
    ids = wanted.select("doc_id").where("doc_id is not null").distinct()
    hit = documents.join(ids, "doc_id", "left_semi").withColumn("found", F.lit(True))
    nested = documents_with_passages(hit, passages.join(ids, "doc_id", "left_semi"))
    return ids.join(nested, "doc_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def get_document(documents: DataFrame, passages: DataFrame, doc_id: int) -> dict:
    """One document by its id, with its passages in order. The id reaches both scans as a
    filter. Raises NotFound, and ValueError for what can't be an id."""
    rows = documents.where(F.col("doc_id") == check_id(doc_id)).limit(1).collect()
    if not rows:
        raise NotFound(f"no document {doc_id}")
    kids = unique_passages(passages.where(F.col("doc_id") == doc_id)).orderBy("ordinal", "passage_id").drop("doc_id")
    return rows[0].asDict() | {"passages": [r.asDict() for r in kids.collect()]}
