"""Best representative of each duplicate group.

Groups are the connected components of the pointers. One row survives per
group: by trust of its source, then fullness, then recency, then id. Fields are
merged value by value: a ranked field takes the first usable value in that
order; a currency field takes the value that is latest.

Currency (after Fan, Geerts, Wijsen, "Determining the currency of data", TODS
2012): within a group two values with different times follow each other by these.
Where a time is missing, or times are equal, numbers follow in the order of numbers (counts and years grow), and
other values by precedence learned from all rows that carry a time: v1 precedes v2
where that order of neighbours in time is seen more often than its reverse, and also over further values that
the group need not hold, however many. The latest are
those that precede no other value of the group. Ties, and cycles, fall back on the rank.

All but the learning is aggregates with partial sums and equi-joins; for that the
different values of one field of a group (not its rows) are put in order of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from tamarisk.operators.components import connected_components
from tamarisk.plans.materialise import written

TRUST = ("MED", "PMC", "AGR", "CTX", "ETH", "PAT", "PPR")
FIELDS = ("pmid", "pmcid", "doi", "abstract", "journal", "pub_year")
CURRENT = ("journal", "pub_year", "cited_by")
STEPS = 8  # learned transitions followed one at a time; what lies farther is reached by doubling


def normal_doi(doi: Column) -> Column:
    """The DOI in normal form, or null where it is unusable."""
    d = F.lower(F.regexp_replace(doi, r"(?U)^\s+|\s+$", ""))
    d = F.regexp_replace(d, r"(?U)^(https?://[^/]*/|doi:)\s*", "")
    d = F.regexp_replace(d, r"\.+$", "")
    return F.when(d.rlike(r"(?U)^10\.[0-9]{4,9}/\S+$"), d)


def _present(name: str, column: Column) -> Column:
    if name == "doi":
        return normal_doi(column).isNotNull()
    return F.coalesce(column.cast("string").rlike(r"(?U)\S"), F.lit(False))


def duplicate_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, group_id) of documents tied to another by canonical_doc_id.

    A pointer to itself, to null or to no document of the table ties nothing.
    group_id is the smallest doc_id of the group; lone documents do not come out.
    """
    d = documents.select("doc_id", "canonical_doc_id")
    edges = d.where("canonical_doc_id is not null and canonical_doc_id <> doc_id").join(
        d.select(F.col("doc_id").alias("canonical_doc_id")), "canonical_doc_id", "left_semi")
    return connected_components(edges, "doc_id", "canonical_doc_id").select(
        F.col("node").alias("doc_id"), F.col("component").alias("group_id"))


def _rank(trust: tuple[str, ...]) -> Column:
    """Sorts ascending from the best member; the doc_id makes it total."""
    source = F.upper(F.trim(F.col("source")))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, trust)), source), F.lit(0))
    full = sum((_present(c, F.col(c)).cast("int") for c in FIELDS), F.lit(0))
    return F.struct(
        F.when(place == 0, len(trust) + 1).otherwise(place).cast("int").alias("trust"), (-full).alias("full"),
        F.coalesce(-F.unix_micros("ingested_at"), F.lit(2**62)).alias("age"), F.col("doc_id").alias("doc"),
    )


def value_precedence(values: DataFrame) -> DataFrame:
    """(field, earlier, later): orders of values seen more often than their reverse.

    ``values`` has a row per (group_id, field, value) with its last time, null if
    it has none. Only values next to each other in time count as a transition.
    """
    w = Window.partitionBy("group_id", "field").orderBy("last", "value")
    seen = (
        values.where("last is not null").withColumn("earlier", F.lag("value").over(w)).withColumn("before", F.lag("last").over(w))
        .where("earlier is not null and before < last").groupBy("field", "earlier", F.col("value").alias("later"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    signed = seen.unionByName(seen.select("field", F.col("later").alias("earlier"), F.col("earlier").alias("later"), (-F.col("n")).alias("n")))
    return signed.groupBy("field", "earlier", "later").agg(F.sum("n").alias("n")).where("n > 0").select("field", "earlier", "later")


def _farther(wanted: DataFrame, found: DataFrame, hops: DataFrame, front: DataFrame, seen: DataFrame) -> DataFrame:
    """The pairs found, and those of the wanted ones that lie over longer paths than were seen, of any length.

    Round k knows all that is fewer than 2^k transitions beyond a value's front and joins it with ``hops``,
    the paths of exactly 2^k; a value that gets nothing new has reached all it can. Transitions into
    values that every open value has passed lead to nothing new and are left out."""
    key = ["field", "value"]
    reach = written(front, "currency")
    starts = reach.select(*key).distinct()
    passed = seen.join(starts, key, "left_semi").groupBy("field", "at").agg(F.count(F.lit(1)).alias("n")).join(
        starts.groupBy("field").agg(F.count(F.lit(1)).alias("n")), ["field", "n"], "left_semi")
    hops = written(hops.join(passed.select("field", F.col("at").alias("next")), ["field", "next"], "left_anti").select("field", "at", "next"), "currency")
    while not reach.isEmpty():
        new = written(reach.join(hops, ["field", "at"]).select(*key, F.col("next").alias("at")).distinct().join(seen, [*key, "at"], "left_anti"), "currency")
        seen = seen.unionByName(new)
        found = written(found.unionByName(wanted.join(new.withColumnRenamed("at", "other"), [*key, "other"], "left_semi")), "currency")
        open_ = wanted.join(found, [*key, "other"], "left_anti").select(*key).distinct().join(new, key, "left_semi")
        reach = written(reach.unionByName(new).join(open_, key, "left_semi"), "currency")
        onward = hops.select("field", F.col("at").alias("next"), F.col("next").alias("far"))
        hops = written(hops.join(onward, ["field", "next"]).select("field", "at", F.col("far").alias("next")).distinct(), "currency")
    return found


def follows(wanted: DataFrame, later: DataFrame, steps: int | None = STEPS) -> DataFrame:
    """(field, value, other): those of the wanted pairs in which value precedes other over at most
    ``steps`` learned transitions, or over any number of them (None).

    Paths grow from wanted values only, and a value is left as soon as all its pairs are known."""
    edges = written(later.select("field", F.col("earlier").alias("at"), F.col("later").alias("next")), "currency")
    wanted = written(wanted.select("field", "value", "other").distinct(), "currency")
    front = wanted.select("field", "value", F.col("value").alias("at")).distinct()
    seen, found = None, None
    for _ in range(STEPS if steps is None else steps):
        new = front.join(edges, ["field", "at"]).select("field", "value", F.col("next").alias("at")).distinct()
        new = new if seen is None else new.join(seen, ["field", "value", "at"], "left_anti")
        front = written(new, "currency")
        if front.isEmpty():
            break
        seen = front if seen is None else seen.unionByName(front)
        hit = wanted.join(front.withColumnRenamed("at", "other"), ["field", "value", "other"], "left_semi")
        found = written(hit if found is None else found.unionByName(hit), "currency")
        open_ = wanted.join(found, ["field", "value", "other"], "left_anti").select("field", "value").distinct()
        front = front.join(open_, ["field", "value"], "left_semi")
    else:
        if steps is None:
            found = _farther(wanted, found, edges, front, seen)
    return wanted.where("false") if found is None else found


def _current_values(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(group_id, field, value): the value of each currency field that is latest."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    values = written(
        rows.select("group_id", "rank", "ingested_at", F.explode(pairs).alias("p"))
        .where(F.col("p.value").rlike(r"(?U)\S"))
        .groupBy("group_id", F.col("p.field").alias("field"), F.col("p.value").alias("value"))
        .agg(F.max("ingested_at").alias("last"), F.min("rank").alias("rank")), "currency")
    numeric = [f for f in fields if isinstance(rows.schema[f].dataType, NumericType)]
    is_number = F.col("field").isin(*numeric) if numeric else F.lit(False)
    newest = values.groupBy("group_id", "field").agg(
        F.max("last").alias("newest"), F.count(F.lit(1)).alias("n"), F.max(F.col("value").try_cast("double")).alias("most"),
        F.max(F.when(F.col("last").isNull(), F.col("value").try_cast("double"))).alias("most_untimed"))
    tied = values.where(is_number & F.col("last").isNotNull()).groupBy("group_id", "field", "last").agg(F.max(F.col("value").try_cast("double")).alias("most_tied"))
    judged = values.join(newest, ["group_id", "field"]).join(tied, ["group_id", "field", "last"], "left")
    number = F.col("value").try_cast("double")
    greater = F.when(F.col("last").isNull(), F.col("most") > number).otherwise(  # than it: any untimed value, or one of its own time
        (F.coalesce("most_untimed", number) > number) | (F.coalesce("most_tied", number) > number))
    texts = values.where(~is_number)
    peers = texts.select("group_id", "field", F.col("value").alias("other"), F.col("last").alias("peer_last"))
    open_ = written(  # pairs that the group's own times don't order
        texts.join(peers, ["group_id", "field"]).where("value <> other").where(F.coalesce(F.col("last") == F.col("peer_last"), F.lit(True)))
        .select("group_id", "field", "value", "other"), "currency")
    reached = follows(open_, value_precedence(texts), steps=None)
    back = reached.select("field", F.col("other").alias("value"), F.col("value").alias("other"))
    one_way = reached.join(back, ["field", "value", "other"], "left_anti")  # both ways is a cycle: no order
    learned = open_.join(one_way, ["field", "value", "other"]).select("group_id", "field", "value").distinct()
    judged = judged.join(learned.withColumn("learned", F.lit(1)), ["group_id", "field", "value"], "left")
    past = F.coalesce(F.col("last") < F.col("newest"), F.lit(False))
    old = past | F.col("learned").isNotNull() | (is_number & greater)
    order = F.struct(old.alias("old"), past.alias("past"), F.col("rank"))
    return judged.groupBy("group_id", "field").agg(F.min_by("value", order).alias("value"))


def best_representatives(documents: DataFrame, groups: DataFrame | None = None, trust: tuple[str, ...] = TRUST,
                         current: tuple[str, ...] = CURRENT, texts: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """One row per group: group_id, doc_id of the surviving row, n_members, doi (first
    usable in rank order, '' if none), the first present pmid, pmcid and ``texts`` in
    rank order, and ``current_<field>`` for each currency field.

    An unknown source ranks after the known ones, a missing time after any time;
    blank values count as absent (a field without any value is null). doc_id must
    be unique. An empty table, or one without groups, gives an empty result.
    Texts travel only for the rows chosen: the aggregate carries their doc_ids.
    """
    groups = duplicate_groups(documents) if groups is None else groups
    rows = written(
        documents.select(
            "doc_id", "ingested_at", _rank(trust).alias("rank"), normal_doi(F.col("doi")).alias("doi"),
            *[F.when(_present(c, F.col(c)), F.col(c)).alias(c) for c in ("pmid", "pmcid")],
            *[_present(c, F.col(c)).alias(f"has_{c}") for c in texts], *current,
        ).join(groups, "doc_id"), "survivors")
    best = rows.groupBy("group_id").agg(
        F.min("rank").alias("r"), F.count(F.lit(1)).alias("n_members"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(c) for c in ("doi", "pmid", "pmcid")],
        *[F.min(F.when(F.col(f"has_{c}"), F.col("rank")))["doc"].alias(f"_{c}") for c in texts],
    )
    latest = _current_values(rows, current).groupBy("group_id").pivot("field", list(current)).agg(F.first("value"))
    out = best.join(latest.select("group_id", *[F.col(c).alias(f"current_{c}") for c in current]), "group_id", "left")
    for c in texts:
        out = out.join(documents.select(F.col("doc_id").alias(f"_{c}"), c), f"_{c}", "left")
    return out.select(
        "group_id", F.col("r.doc").alias("doc_id"), "n_members", F.coalesce("doi", F.lit("")).alias("doi"), "pmid", "pmcid",
        *texts, *[f"current_{c}" for c in current])
