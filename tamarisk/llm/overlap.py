"""Same or near-same records across splits.

Method: records are canonicalised (case, punctuation, whitespace, markup and
Unicode forms: ``functions.words``), hashed, and evaluation hashes are joined
with training hashes. One hash of the whole record only meets exact copies, so
the same join also runs over hashes of parts: of each record's set of distinct
word hashes, rarest first, the shortest prefix of which two records of the
wanted similarity must share two members (prefix filtering; Chaudhuri et al.,
ICDE 2006; with two members, Wang, Li and Feng, SIGMOD 2012), and of that the
hashes of all pairs: a pair of words is far rarer than a word. (Sets of over ``PAIRED`` words, whose pairs
would be too many, meet on single words, rarest first.) Where two meet,
128-bit bitmaps of their sets tell at once if they differ in too many words
(Sandes, Teodoro and Melo, VLDB J. 2020). Survivors are verified on the full
sets, so the result is exact.

Records with equal word sets are one class: copies are joined once, however
many there are. All joins are equi-joins on hashes; nothing is broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.words import words_text
from tamarisk.plans.materialise import written

PAIRED = 64  # words of a set up to which pairs of prefix words are hashed


def canonical_records(queries: DataFrame, id_col: str = "query_id", text_col: str = "query_text",
                      split_col: str = "split", group_cols: tuple[str, ...] = ("origin",)) -> DataFrame:
    """(id, split, groups..., canon_hash, set_hash, toks) of records with a split and a word.

    A null split or a text without words takes part in nothing. ``toks`` are the
    64-bit hashes of the distinct words; ``canon_hash`` is of the words in order.
    """
    base = queries.select(
        F.col(id_col).alias("id"), F.lower(F.trim(F.col(split_col))).alias("split"),
        *[F.col(c).alias(f"g_{c}") for c in group_cols], words_text(F.col(text_col)).alias("canon"),
    ).where("split is not null and canon <> ''")
    sets = F.array_sort(F.array_distinct(F.split("canon", " ")))
    return base.select(
        "id", "split", *[f"g_{c}" for c in group_cols], F.md5("canon").alias("canon_hash"),
        F.xxhash64(F.array_join(sets, " ")).alias("set_hash"), F.transform(sets, lambda w: F.xxhash64(w)).alias("toks"),
    )


def _bits(low: int) -> Column:
    """A long with a bit for each hash of ``toks`` that falls into 64 of 128 places."""
    place = lambda x: F.pmod(x, F.lit(128)) - low
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), place(x).cast("int"))
    here = F.filter("toks", lambda x: place(x).between(0, 63))
    return F.aggregate(here, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(bit(x)))


def _class_pairs(records: DataFrame, train: str, evals: tuple[str, ...], threshold: float) -> DataFrame:
    """(train_hash, eval_hash): classes of equal word sets, similar at the threshold."""
    classes = records.groupBy("set_hash").agg(
        F.first("toks").alias("toks"), F.max(F.col("split") == train).alias("is_train"),
        F.max(F.col("split").isin(*evals)).alias("is_eval"),
    )
    classes = written(classes.where("is_train or is_eval").select("*", _bits(0).alias("b0"), _bits(64).alias("b1")), "overlap")
    items = classes.select("set_hash", F.explode("toks").alias("tok"))
    freq = items.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    ranked = items.join(freq, "tok").groupBy("set_hash").agg(
        F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("r")
    )
    # Similar sets share ceil(threshold * n) words of either, so they share ``common`` members of
    # prefixes that leave out all but ``common`` of those. Two single words are similar only if equal.
    # Pairs of prefix words are rarer than words, but their number grows with the square of a record:
    # they serve sets up to PAIRED words, single words those beyond. Similar sets of which one is
    # longer than PAIRED have both threshold * PAIRED words at least, so all of these give single words too.
    n_words = F.size("r")
    kept = n_words - F.ceil(F.lit(threshold) * n_words - F.lit(1e-9))
    cut = lambda common: F.slice(F.col("r.tok"), F.lit(1), (kept + common).cast("int"))
    one = F.when(n_words >= F.lit(threshold * PAIRED - 1e-9), F.transform(cut(1), lambda t: F.xxhash64(F.lit(1), t))).otherwise(F.array().cast("array<long>"))
    two = F.transform(cut(1), lambda t: F.xxhash64(F.lit(1), t))
    if threshold > 0.5:
        at = F.sequence(F.lit(1), F.size("pre") - 1)
        both = F.flatten(F.transform(at, lambda i: F.transform(
            F.slice("pre", i + 1, F.size("pre")), lambda y: F.xxhash64(F.element_at("pre", i.cast("int")), y))))
        short = F.when((F.col("n") > 1) & (F.col("n") <= PAIRED), both).otherwise(F.array().cast("array<long>"))
        prefix = ranked.select("set_hash", n_words.alias("n"), F.when(n_words <= PAIRED, cut(2)).alias("pre"), one.alias("one"))
        prefix = prefix.where("n > 1").select("set_hash", "n", F.concat(short, "one").alias("pre"))
    else:
        prefix = ranked.select("set_hash", n_words.alias("n"), two.alias("pre"))
    prefix = written(prefix.join(classes.select("set_hash", "is_train", "is_eval", "b0", "b1"), "set_hash"), "overlap")
    side = lambda flag, name: prefix.where(flag).select(
        F.col("set_hash").alias(f"{name}_hash"), F.col("n").alias(f"{name}_n"),
        F.col("b0").alias(f"{name}_b0"), F.col("b1").alias(f"{name}_b1"), F.explode("pre").alias("tok"))
    both_n = F.col("train_n") + F.col("eval_n")
    most_apart = both_n - 2 * F.ceil(F.lit(threshold / (1 + threshold)) * both_n - F.lit(1e-9))
    apart = sum(F.bit_count(F.col(f"train_{b}").bitwiseXOR(F.col(f"eval_{b}"))) for b in ("b0", "b1"))
    equal = classes.where("is_train and is_eval").select(F.col("set_hash").alias("train_hash"), F.col("set_hash").alias("eval_hash"))
    cand = (
        side("is_train", "train").join(side("is_eval", "eval"), "tok")
        .where((F.col("train_n") >= F.col("eval_n") * threshold - 1e-9) & (F.col("eval_n") >= F.col("train_n") * threshold - 1e-9))
        .where((F.col("train_hash") != F.col("eval_hash")) & (apart <= most_apart)).select("train_hash", "eval_hash").distinct()
    )
    sets = lambda name: classes.select(F.col("set_hash").alias(f"{name}_hash"), F.col("toks").alias(f"{name}_toks"))
    shared = F.size(F.array_intersect("train_toks", "eval_toks"))
    united = F.size("train_toks") + F.size("eval_toks") - F.col("shared")
    return (
        cand.join(sets("train"), "train_hash").join(sets("eval"), "eval_hash").withColumn("shared", shared)
        .where(F.col("shared") >= threshold * united - 1e-9).select("train_hash", "eval_hash").unionByName(equal)
    )


def cross_split_pairs(queries: DataFrame, train: str = "train", evals: tuple[str, ...] = ("dev", "test"),
                      threshold: float = 0.7, **cols) -> DataFrame:
    """(id_a, id_b), smaller id first: one training and one evaluation record each,
    whose sets of distinct words have shared / united count at or over the threshold.

    Ties and repeated texts all come out; a repeated id gives its pair once.
    Extra input columns are ignored; an empty table gives an empty result.
    """
    rec = written(canonical_records(queries, **cols).where(F.col("split").isin(train, *evals)), "overlap")
    pairs = _class_pairs(rec, train, evals, threshold)
    a = rec.where(F.col("split") == train).select(F.col("set_hash").alias("train_hash"), F.col("id").alias("a"))
    b = rec.where(F.col("split") != train).select(F.col("set_hash").alias("eval_hash"), F.col("id").alias("b"))
    return (
        pairs.join(a, "train_hash").join(b, "eval_hash")
        .select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
    )


def overlap_report(queries: DataFrame, train: str = "train", evals: tuple[str, ...] = ("dev", "test"),
                   threshold: float = 0.7, group_cols: tuple[str, ...] = ("origin",), **cols) -> DataFrame:
    """Per split and group: records, those whose hash stands in training, and those
    with a training record at or over the threshold (which includes the former)."""
    rec = written(canonical_records(queries, group_cols=group_cols, **cols).where(F.col("split").isin(train, *evals)), "overlap")
    near = _class_pairs(rec, train, evals, threshold).select(F.col("eval_hash").alias("set_hash")).distinct()
    same = rec.where(F.col("split") == train).select("canon_hash").distinct()
    rows = (
        rec.where(F.col("split") != train)
        .join(same.withColumn("exact", F.lit(1)), "canon_hash", "left")
        .join(near.withColumn("near", F.lit(1)), "set_hash", "left")
    )
    return rows.groupBy("split", *[F.col(f"g_{c}").alias(c) for c in group_cols]).agg(
        F.count(F.lit(1)).alias("n_records"), F.count("exact").alias("n_exact"), F.count("near").alias("n_near"))


def overlap_classes(queries: DataFrame, train: str = "train", evals: tuple[str, ...] = ("dev", "test"), threshold: float = 0.7, **cols) -> DataFrame:
    """(id, split, class_id, n_exact, n_links): one row a record, copies not expanded into pairs. Records of
    equal word sets are one class, class_id its smallest id. n_links counts the records of the
    other side that are similar at the threshold, n_exact those with the same words in the
    same order (the hash of the whole record); a record without any has 0."""
    rec = written(canonical_records(queries, **cols).where(F.col("split").isin(train, *evals)), "overlap")
    rec = rec.groupBy("id").agg(F.min(F.struct("split", "set_hash", "canon_hash")).alias("r")).select("id", "r.*").withColumn("seen", F.col("split") == train)
    rec = written(rec, "overlap")
    sizes = rec.groupBy("set_hash").agg(F.min("id").alias("class_id"), F.count_if("seen").alias("nt"), F.count_if(~F.col("seen")).alias("ne"))
    pairs = written(_class_pairs(rec.join(canonical_records(queries, **cols).select("set_hash", "toks").dropDuplicates(["set_hash"]), "set_hash"), train, evals, threshold), "overlap")
    part = lambda own, other, n, seen: pairs.join(sizes.select(F.col("set_hash").alias(other), n), other).groupBy(F.col(own).alias("set_hash")).agg(
        F.sum(n).alias("n_links")).withColumn("seen", F.lit(seen))
    links = part("train_hash", "eval_hash", "ne", True).unionByName(part("eval_hash", "train_hash", "nt", False))
    same = rec.groupBy("canon_hash").agg(F.count_if("seen").alias("ct"), F.count_if(~F.col("seen")).alias("ce"))
    out = rec.join(sizes.select("set_hash", "class_id"), "set_hash").join(links, ["set_hash", "seen"], "left").join(same, "canon_hash")
    return out.select("id", "split", "class_id", F.when(F.col("seen"), F.col("ce")).otherwise(F.col("ct")).alias("n_exact"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
