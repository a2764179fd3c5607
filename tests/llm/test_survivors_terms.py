import random
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from tamarisk.functions.words import word_list
from tamarisk.llm.survivors import best_representatives, duplicate_groups, follows, normal_doi, value_precedence
from tamarisk.llm.terms import TOTAL, TermCounts, marks, merge_counts, record_rows, signed_changes, term_deltas, term_table

DOC = ("doc_id long, source string, pmid string, pmcid string, doi string, title string, abstract string, journal string, pub_year int, cited_by int, "
       "ingested_at timestamp, canonical_doc_id long")


def doc(i, to=None, source="MED", day=1, **kw):
    base = dict(pmid=None, pmcid=None, doi=None, title=None, abstract=None, journal=None, pub_year=None, cited_by=None) | kw
    return (i, source, *[base[k] for k in ("pmid", "pmcid", "doi", "title", "abstract", "journal", "pub_year", "cited_by")], day and datetime(2024, 1, day), to)


def test_doi(spark):
    cases = {" https://doi.org/10.1234/AB. ": "10.1234/ab", "doi: 10.0001/x..": "10.0001/x", "10.1/x": None, "10.1234/": None, "10.1234/a b": None,
             "none": None, "": None, None: None, "http://dx.doi.org/10.12345/q": "10.12345/q", "DOI:10.123456789/z": "10.123456789/z", "10.1234567890/z": None}
    df = spark.createDataFrame([(k,) for k in cases], "d string").select("d", normal_doi(F.col("d")).alias("n"))
    assert {r.d: r.n for r in df.collect()} == cases


def test_groups_and_ranks(spark):
    rows = [
        doc(1, 2, "PPR", doi="10.1234/a"), doc(2, None, " pmc ", doi="pending"), doc(3, 2, "MED", day=2), doc(4, 4), doc(5, 99), doc(6, None),
        doc(10, 11), doc(11, 12), doc(12, 10, pmid=" "), doc(20, 21, "XX"), doc(21, None, None, day=None), doc(30, 31, day=None), doc(31, None, day=None)]
    df = spark.createDataFrame(rows, DOC).withColumns({"rank": F.lit(1), "group_id": F.lit(2), "text": F.lit("t")})
    assert {r.doc_id: r.group_id for r in duplicate_groups(df).collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20, 30: 30, 31: 30}
    got = {r.group_id: (r.doc_id, r.n_members, r.doi) for r in best_representatives(df).collect()}
    assert got == {1: (3, 3, "10.1234/a"), 10: (10, 3, ""), 20: (20, 2, ""), 30: (30, 2, "")}
    assert best_representatives(df.where("false")).count() == 0
    assert best_representatives(df.where("doc_id = 6")).count() == 0


def test_currency(spark):
    rows, i = [], 100
    for g in range(5):  # in five groups A is followed by B, B by C
        for day, j in ((1, "A"), (2, "B"), (3, "C")):
            rows.append(doc(i, i - i % 10 if i % 10 else None, day=day, journal=j))
            i += 1
        i = (i // 10 + 1) * 10
    rows += [doc(500, None, journal="A", day=9), doc(501, 500, journal="C", day=None), doc(502, 500, journal="B", day=None)]
    rows += [doc(600, None, journal="C", day=None), doc(601, 600, journal="A", day=None)]
    df = spark.createDataFrame(rows, DOC)
    got = {r.group_id: r.current_journal for r in best_representatives(df).collect()}
    assert got[100] == "C" and got[600] == "C"
    assert got[500] == "C"  # the timed A is known to come before B, and B before C
    v = spark.createDataFrame([(1, "f", "x", datetime(2024, 1, 1)), (1, "f", "y", datetime(2024, 1, 2)), (2, "f", "y", datetime(2024, 1, 1)), (2, "f", "x", datetime(2024, 1, 2))],
                              "group_id long, field string, value string, last timestamp")
    assert value_precedence(v).count() == 0  # as often either way


def test_currency_is_closed(spark):
    """Order reaches over values a group lacks; a group's own times and numbers count as such; cycles don't."""
    rows, i = [], 0

    def group(*members):
        nonlocal i
        i += 100
        for n, (journal, day, cited) in enumerate(members):
            rows.append(doc(i + n, i if n else None, day=day, journal=journal, cited_by=cited))
        return i

    for pair in ("AB", "BC", "CD", "XY", "YZ", "ZX"):  # three groups teach each; X, Y, Z go round
        for _ in range(3):
            group((pair[0], 1, None), (pair[1], 2, None))
    lacking = group(("A", None, None), ("C", None, None))
    far = group(("A", None, None), ("D", 5, None))
    own = group(("C", 1, None), ("B", 2, None))  # its own times say otherwise
    circle = group(("X", None, None), ("Z", None, None))
    numbers = group((None, None, 9), (None, None, 10))  # as text 9 would be the greater
    timed = group((None, 2, 9), (None, 1, 10))
    got = {r.group_id: r for r in best_representatives(spark.createDataFrame(rows, DOC)).collect()}
    assert [got[g].current_journal for g in (lacking, far, own, circle)] == ["C", "D", "B", "X"]
    assert (got[numbers].current_cited_by, got[timed].current_cited_by) == ("10", "9")
    chain = spark.createDataFrame([("f", f"{k:02}", f"{k + 1:02}") for k in range(12)], "field string, earlier string, later string")
    pairs = spark.createDataFrame([("f", "00", f"{k:02}") for k in range(13)] + [("f", "05", "03"), ("f", "05", "07")], "field string, value string, other string")
    assert {(r.value, r.other) for r in follows(pairs, chain).collect()} == {("00", f"{k:02}") for k in range(1, 9)} | {("05", "07")}


def test_currency_reaches_any_distance(spark):
    """No number of learned transitions is too many, for an order as for a cycle."""
    rows, i = [], 0

    def group(*members):
        nonlocal i
        i += 100
        for n, (journal, day) in enumerate(members):
            rows.append(doc(i + n, i if n else None, day=day, journal=journal))
        return i

    for k in range(20):
        group((f"c{k:02}", 1), (f"c{k + 1:02}", 2))
    for k in range(12):  # a ring: three on, and nine back
        group((f"r{k:02}", 1), (f"r{(k + 1) % 12:02}", 2))
    near = group(("c00", None), ("c08", None))
    over, end = group(("c00", None), ("c09", None)), group(("c01", None), ("c20", None))
    ring = group(("r00", None), ("r03", None))
    got = {r.group_id: r.current_journal for r in best_representatives(spark.createDataFrame(rows, DOC), texts=()).collect()}
    assert [got[g] for g in (near, over, end, ring)] == ["c08", "c09", "c20", "r00"]


def test_follows_is_closed(spark):
    """Against a plain search, on a chain, a long ring, sparse random orders, and a knot with a tail."""
    rng = random.Random(5)
    edges = {("chain", k, k + 1) for k in range(60)} | {("ring", k, (k + 1) % 41) for k in range(41)}
    edges |= {("any", rng.randrange(150), rng.randrange(150)) for _ in range(190)}
    edges |= {("knot", rng.randrange(12), rng.randrange(12)) for _ in range(60)} | {("knot", 11 + k, 12 + k) for k in range(30)}
    edges = {(f, a, b) for f, a, b in edges if a != b}
    onward = {}
    for f, a, b in edges:
        onward.setdefault((f, a), set()).add(b)

    def reached(f, a):
        out, todo = set(), [a]
        while todo:
            fresh = onward.get((f, todo.pop()), set()) - out
            out |= fresh
            todo += fresh
        return out

    wanted = {(f, rng.randrange(n), rng.randrange(n)) for f, n in (("chain", 61), ("ring", 41), ("any", 150), ("knot", 42), ("none", 9)) for _ in range(120)}
    wanted = {(f, a, b) for f, a, b in wanted if a != b} | {("chain", 0, 60), ("knot", 0, 41)}
    text = lambda rows: [(f, str(a), str(b)) for f, a, b in sorted(rows)]
    later = spark.createDataFrame(text(edges), "field string, earlier string, later string")
    pairs = spark.createDataFrame(text(wanted), "field string, value string, other string")
    want = text((f, a, b) for f, a, b in wanted if b in reached(f, a))
    assert sorted((r.field, r.value, r.other) for r in follows(pairs, later, None).collect()) == sorted(want)
    assert len(want) > follows(pairs, later).count()


def plain_counts(records):
    texts = {}
    for i, t in records:
        if i is not None:
            texts[i] = t if i not in texts or texts[i] is None else texts[i] if t is None else min(t, texts[i])
    occ, docs = Counter(), Counter()
    for t in texts.values():
        occ.update(word_list(t))
        docs.update(set(word_list(t)))
    return {w: (occ[w], docs[w]) for w in docs}, len(texts)


def test_counts_and_deltas(spark, tmp_path):
    rng = random.Random(1)
    make = lambda: " ".join(rng.choice(["the", "Gene", f"w{rng.randrange(40)}"]) for _ in range(rng.randint(0, 12)))
    old = [(i, make()) for i in range(60)] + [(3, None), (None, "zz"), (70, None), (71, "")]
    new = [(i, t if rng.random() < 0.7 else make()) for i, t in old if i is not None and i % 7] + [(200 + i, make()) for i in range(9)]
    df = lambda rows: spark.createDataFrame(rows, "passage_id long, text string").withColumn("sign", F.lit(0)).withColumn("id", F.lit(1))
    store = TermCounts(spark, str(tmp_path / "counts"), 3)
    assert store.read() is None
    a, b = record_rows(df(old)), record_rows(df(new))
    state = store.apply(signed_changes(None, a), "first")
    want, n = plain_counts(old)
    assert {r.lexeme: (r.n_occ, r.ndoc) for r in state.collect() if r.lexeme != TOTAL} == want
    later = store.apply(signed_changes(a, b), "second")
    again = store.apply(signed_changes(a, b), "second")  # a retry
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, later.collect())) and store.applied() == ["first", "second"]
    want, n = plain_counts(new)
    assert {r.lexeme: (r.n_occ, r.ndoc) for r in later.collect() if r.lexeme != TOTAL} == want
    assert [r.ndoc for r in later.collect() if r.lexeme == TOTAL] == [n]
    table = term_table(later)
    assert {tuple(r) for r in marks(table).collect()} == {(w, "rare") for w, (_, d) in want.items() if d < 3} | {(w, "common") for w, (_, d) in want.items() if d > 0.05 * n}
    assert signed_changes(b, b).count() == 0
    assert term_table(merge_counts(None, term_deltas(signed_changes(None, record_rows(df(old[:1]).where("false")))))).count() == 0


def test_only_touched_buckets(spark, tmp_path):
    store = TermCounts(spark, str(tmp_path / "counts"), 32)
    df = lambda *texts: signed_changes(None, spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    store.apply(df(" ".join(f"w{k}" for k in range(300))), "a")
    before = store.table.manifest()["folders"]
    store.apply(df("w7"), "b")
    after = store.table.manifest()["folders"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2  # the term's and the total's
    assert {r.lexeme: r.ndoc for r in store.read().where("lexeme in ('w7', 'w8', '')").collect()} == {"w7": 2, "w8": 1, "": 2}
    store.apply(signed_changes(spark.createDataFrame([(1, "w7 w9")], "id long, text string"), spark.createDataFrame([], "id long, text string")), "c")
    assert {r.lexeme: r.ndoc for r in store.read().where("lexeme in ('w7', 'w9', '')").collect()} == {"w7": 1, "": 1}


def test_both_marks(spark):
    t = term_table(merge_counts(None, term_deltas(signed_changes(None, spark.createDataFrame([(1, "only")], "id long, text string")))))
    assert {tuple(r) for r in marks(t).collect()} == {("only", "rare"), ("only", "common")}


def test_own_times_go_first(spark):
    """What is seen more often elsewhere doesn't overrule a group's own timestamps."""
    rows = []
    for g in range(3):
        rows += [doc(10 * g + 1, None, day=1, journal="A"), doc(10 * g + 2, 10 * g + 1, day=2, journal="B")]
    rows += [doc(91, None, day=1, journal="B"), doc(92, 91, day=2, journal="A")]
    got = {r.group_id: r.current_journal for r in best_representatives(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: "B", 11: "B", 21: "B", 91: "A"}
