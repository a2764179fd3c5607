import random

from tamarisk.operators import mining


def plain(cands, labels, blocked, leads, max_neg, max_pos, skip):
    """One query, as a loop. cands: (passage, doc, rank, cluster); labels: {doc: (grade, cluster)}."""
    pos_docs = sorted(d for d, (g, _) in labels.items() if g > 0)
    pos = {labels[d][1] for d in pos_docs}
    neg, seen, twins, own = [], set(), 0, 0
    for p, d, r, c in [x for x in cands if x[2] > skip]:
        if len(neg) >= max_neg:
            break
        if c in pos:
            twins += d not in pos_docs
        elif c in blocked:
            own += 1
        elif c not in seen:
            seen.add(c)
            neg.append((p, d, r))
    out, used = [], set()
    for d in pos_docs:
        c = labels[d][1]
        hit = next(((p, dd) for p, dd, _, cc in cands if cc == c), None)
        got = hit or leads.get(d)
        if len(out) < max_pos and c not in used and got:
            used.add(c)
            out.append((*got, "positive_retrieved" if hit else "positive_fallback"))
    return neg, out, twins, own


def test_against_a_loop(spark):
    rng = random.Random(5)
    C, L, B, D = [], [], [], {}
    want, keep = {}, {}
    cluster = {d: d if d % 3 else max(1, d - 1) for d in range(1, 40)}
    for d in range(1, 40):
        if rng.random() < 0.7:
            D[d] = (1000 + d, d)
    for q in range(40):
        docs = [rng.randrange(1, 40) for _ in range(rng.randint(0, 14))]
        cands = [(q * 100 + i, d, i + 1, cluster[d]) for i, d in enumerate(docs)]
        labels = {rng.randrange(1, 40): None for _ in range(rng.randint(1, 6))}
        labels = {d: (rng.choice([0, 1, 2]), cluster[d]) for d in labels}
        blocked = {cluster[rng.randrange(1, 40)] for _ in range(2)}
        C += [(q, *c) for c in cands]
        L += [(q, d, g, c) for d, (g, c) in labels.items()]
        B += [(q, c) for c in blocked]
        want[q] = plain(cands, labels, blocked, D, 3, 2, 1)
        keep[q] = cands
    cdf = spark.createDataFrame(C, "query_id long, passage_id long, doc_id long, rank int, cluster long")
    ldf = spark.createDataFrame(L, "query_id long, doc_id long, relevance int, cluster long")
    bdf = spark.createDataFrame(B, "query_id long, cluster long")
    leads = spark.createDataFrame([(d, p, "t") for d, (p, _) in D.items()], "doc_id long, passage_id long, text string")
    got: dict = {}
    for r in mining.hard_negatives(cdf, ldf, bdf, 3, 1).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.passage_id, r.doc_id, r["rank"]))
    assert got == {q: w[0] for q, w in want.items() if w[0]}
    pos: dict = {}
    for r in mining.positives(cdf, ldf, leads, 2).collect():
        pos.setdefault(r.query_id, set()).add((r.passage_id, r.doc_id, r.kind))
    assert pos == {q: set(w[1]) for q, w in want.items() if w[1]}
    s = mining.mining_statistics(spark.createDataFrame([(q,) for q in want], "query_id long"), cdf, ldf, bdf, leads, 3, 2, 1).first()
    used = [q for q, w in want.items() if w[0] and w[1]]
    assert s.queries_used + s.queries_without_negatives + s.queries_without_positives == s.queries_seen == 40
    assert s.queries_used == len(used) and s.positives == sum(len(want[q][1]) for q in used) and s.negatives == sum(len(want[q][0]) for q in used)
    assert s.twins_blocked == sum(w[2] for w in want.values()) and s.self_matches_blocked == sum(w[3] for w in want.values())
    pairs = mining.training_pairs(cdf, ldf, bdf, leads, 3, 2, 1)
    assert {r.query_id for r in pairs.collect()} == set(used)


def test_grade_zero_may_be_a_negative(spark):
    c = spark.createDataFrame([(1, 40, 4, 1, 4)], "query_id long, passage_id long, doc_id long, rank int, cluster long")
    lab = spark.createDataFrame([(1, 3, 1, 3), (1, 4, 0, 4)], "query_id long, doc_id long, relevance int, cluster long")
    none = spark.createDataFrame([], "query_id long, cluster long")
    leads = spark.createDataFrame([(3, 30, "t")], "doc_id long, passage_id long, text string")
    got = {(r.doc_id, r.label) for r in mining.training_pairs(c, lab, none, leads).collect()}
    assert got == {(3, 1.0), (4, 0.0)}
