import random

import pytest
from pyspark.sql import functions as F

from tamarisk.config import Settings
from tamarisk.functions.stem import english_lexeme
from tamarisk.operators.arms import query_terms
from tamarisk.operators.cover import cover_density, cover_score
from tamarisk.operators.tsquery import (
    Group, Not, QuerySyntaxError, from_web, parse, plan, positive_terms, predicate, rewrite, terms_to_drop,
)

OFTEN = {"reed": 910, "mud": 400, "tide": 770, "silt": 120}  # words of a made-up estuary, and in how many texts


@pytest.mark.parametrize(("parsed", "kw", "want"), [
    ("'heron' & 'eel'", {}, "('heron' | 'eel')"),
    ("'heron'", {}, "('heron')"),
    ("'heron' & 'eel'", {"or_semantics": False}, "'heron' & 'eel'"),
    ("", {}, ""), (" \t ", {}, ""),
    ("'heron' & 'eel' | 'otter' & 'vole' & 'owl'", {}, "('heron' | 'eel') | ('otter' | 'vole' | 'owl')"),
    ("'owl' & ('heron' | 'eel')", {}, "('owl' | 'heron' | 'eel')"),
    ("'owl' & !'reed' & 'vole'", {}, "('owl' | 'vole') & !'reed'"),
    ("'owl' & !'reed' | 'vole'", {}, "(('owl') & !'reed') | 'vole'"),
    ("!'owl'", {}, ""), ("!'owl' & !'eel'", {}, ""),
    ("'low' <-> 'tide' & 'eel'", {}, "('low' <-> 'tide' | 'eel')"),
    ("'eel' & !( 'low' <-> 'tide' )", {}, "('eel') & !( 'low' <-> 'tide' )"),
    ("'low' <3> 'tide'", {}, "('low' <3> 'tide')"),
    # common words go, but for the rarest that it takes to keep the least number
    ("'eel' & 'mud' & 'owl' & 'tide'", {"common": OFTEN, "min_terms": 2}, "('eel' | 'owl')"),
    ("'mud' & 'tide' & 'reed' & 'silt'", {"common": OFTEN, "min_terms": 2}, "('mud' | 'silt')"),
    ("'tide' & 'eel' & 'mud'", {"common": OFTEN, "min_terms": 2}, "('eel' | 'mud')"),
    ("'low' <-> 'tide' & 'eel'", {"common": OFTEN, "min_terms": 1}, "('low' <-> 'tide' | 'eel')"),  # a phrase is no common word
    ("'tide':* & 'eel'", {"common": OFTEN, "min_terms": 1}, "('tide':* | 'eel')"),
    ("'eel' & !'tide'", {"common": OFTEN, "min_terms": 1}, "('eel') & !'tide'"),
    ("'owl' & 'eel' | 'reed' & 'vole'", {"common": OFTEN, "min_terms": 1}, "('owl' | 'eel') | ('vole')"),
    ("'owl' |", {}, "'owl' |"),
    ("'o''clock' & 'eel'", {}, "('o''clock' | 'eel')"),
])
def test_rewrite(parsed, kw, want):
    assert rewrite(parsed, **kw) == want


def random_query(rng, depth=3):
    """A tree as text: words, phrases, negations, brackets."""
    kind = rng.choice(["word", "word", "phrase", "and", "or", "not"]) if depth else "word"
    word = lambda: f"'{rng.choice('abcdef')}'"
    if kind == "word":
        return word()
    if kind == "phrase":
        return f"( {word()} <-> {word()} )"
    if kind == "not":
        return f"!( {random_query(rng, depth - 1)} )"
    return "( " + (" & " if kind == "and" else " | ").join(random_query(rng, depth - 1) for _ in range(rng.randint(2, 3))) + " )"


def holds(node, toks):
    """The plainest reading of a tree."""
    if isinstance(node, Not):
        return not holds(node.of, toks)
    if isinstance(node, Group):
        return (all if node.kind == "and" else any)(holds(c, toks) for c in node.of)
    if node.parts:
        return any(toks[i : i + 2] == [node.parts[0].lexeme, node.parts[2].lexeme] for i in range(len(toks)))
    return node.lexeme in toks


def loosened(node):
    """The rule of the rewriting, on trees: a conjunction asks for any of its positive parts, and
    for none of its negated ones; one without positive parts is nothing."""
    if not isinstance(node, Group):
        return node
    parts = [p for c in node.of if (p := loosened(c)) is not None]
    if node.kind == "or":
        return Group("or", tuple(parts)) if parts else None
    wanted, banned = [p for p in parts if not isinstance(p, Not)], [p for p in parts if isinstance(p, Not)]
    return Group("and", (Group("or", tuple(wanted)), *banned)) if wanted else None


def flat_not(node):
    """Without negations of groups: what is in them isn't loosened here."""
    return not (isinstance(node, Not) and isinstance(node.of, (Group, Not))) and all(flat_not(c) for c in (node.of if isinstance(node, Group) else ()))


def test_random_queries(spark):
    rng = random.Random(11)
    docs = [[rng.choice("abcdef") for _ in range(rng.randint(0, 6))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, toks array<string>")
    some = []
    while len(some) < 25:
        q = random_query(rng)
        tree = parse(q)
        if not flat_not(tree) or not isinstance(tree, Group):
            continue
        loose, text = loosened(tree), rewrite(q)
        assert (text == "") == (loose is None), q
        if loose is None:
            continue
        for toks in docs:
            assert holds(parse(text), toks) == holds(loose, toks), (q, text)
            assert (cover_density(q, toks) > 0) <= holds(tree, toks), q
        p = plan(text)
        if p.kind == "bag":
            assert all(holds(parse(text), t) == (bool(set(p.wanted) & set(t)) and not set(p.banned) & set(t)) for t in docs), text
        some.append(tree)
    marks = df.select(*[predicate(t, F.col("toks")).alias(f"q{n}") for n, t in enumerate(some)], "toks").collect()
    for r in marks:
        assert [r[f"q{n}"] for n in range(len(some))] == [holds(t, r.toks) for t in some]


def test_covers_against_all_stretches():
    """Every shortest stretch that holds all words, found by trying each."""
    rng = random.Random(2)
    for _ in range(200):
        toks = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        ok = [(i, j) for i in range(len(toks)) for j in range(i, len(toks)) if {"a", "b", "c"} <= set(toks[i : j + 1])]
        least = [s for s in ok if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in ok)]
        r = sum(0.1 / (1 + sum(t == "d" for t in toks[i : j + 1])) for i, j in least)
        assert cover_density("'a' & 'b' & 'c'", toks) == pytest.approx(r / (1 + r))


@pytest.mark.parametrize(("text", "kind", "wanted", "banned"), [
    ("heron eel", "bag", ("heron", "eel"), ()), ("heron -eel", "bag", ("heron",), ("eel",)), ("-eel", "none", (), ()), ("", "none", (), ()),
    ("heron or owl eel", "bag", ("heron", "owl", "eel"), ()), ('"low tide" eel', "tree", ("low", "eel"), ()), ('eel -"low tide"', "tree", ("eel",), ()),
    ("heron or owl -eel", "tree", ("heron", "owl"), ()), ("low-tide", "bag", ("low", "tide"), ()), ("eel eel", "bag", ("eel",), ()),
])
def test_plans(text, kind, wanted, banned):
    p = plan(rewrite(from_web(text)))
    assert (p.kind, p.wanted, p.banned) == (kind, wanted, banned)


def test_english_web_query():
    assert from_web('the herons "running of the eels" -flooded', english_lexeme) == "'heron' & 'run' <3> 'eel' & !'flood'"
    assert from_web("the of", english_lexeme) == ""


@pytest.mark.parametrize("bad", ["'a' &", "('a'", "'a' ) 'b'", "& 'a'", "a"])
def test_malformed(bad):
    with pytest.raises(QuerySyntaxError):
        parse(bad)


def test_precedence():
    tree = parse("'a' & 'b' | 'c'")
    assert isinstance(tree, Group) and tree.kind == "or" and len(tree.of) == 2
    assert parse("") is None


def test_web_queries():
    assert from_web('heron "low tide" -reed') == "'heron' & 'low' <-> 'tide' & !'reed'"
    assert from_web("a or b c") == "'a' | 'b' & 'c'"
    assert from_web("or or !!") == "" and from_web(None) == "" and from_web('"') == ""
    for text in ('x "y z" -w or -"a b"', "co-op", "it's"):
        parse(from_web(text))


def test_predicate_and_cover(spark):
    docs = ["a b c", "b a", "a x b", "", "c"]
    df = spark.createDataFrame([(i, d.split()) for i, d in enumerate(docs)], "i int, toks array<string>")
    for q, want in {
        "'a' & 'b'": [0, 1, 2], "'a' <-> 'b'": [0], "'a' <2> 'b'": [2], "'a' & !'c'": [1, 2], "'c' | 'x'": [0, 2, 4], "!'a'": [3, 4], "'x':*": [2],
        "'a' <-> 'b' <-> 'c'": [0],
    }.items():
        got = sorted(r.i for r in df.where(predicate(parse(q), F.col("toks"))).collect())
        assert got == want, q
    assert cover_density("'a'", "a x a".split()) == pytest.approx(0.2 / 1.2)
    assert cover_density("'a' & 'b'", "a b".split()) == pytest.approx(0.1 / 1.1)
    assert cover_density("'a' & 'b'", "a x b".split()) == pytest.approx(0.05 / 1.05)
    assert cover_density("'a' & 'b'", ["a"]) == 0 and cover_density("!'a'", ["b"]) == 0
    assert df.select(cover_score(F.lit("'a' <-> 'b'"), F.col("toks")).alias("s")).collect()[0].s == pytest.approx(0.1 / 1.1)


def test_batched_pruning_is_the_rule(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    df = {w: rng.choice([1, 5, 50, 60, 70]) for w in vocab}
    stats = spark.createDataFrame([(w, n, n / 100) for w, n in df.items()], "lexeme string, ndoc long, df_frac float")
    qs = [(i, " ".join(rng.sample(vocab, rng.randint(1, 8)))) for i in range(60)] + [(99, ""), (98, None)]
    got: dict = {}
    for r in query_terms(spark.createDataFrame(qs, "query_id long, query_text string"), stats, Settings(max_df=0.3)).collect():
        got.setdefault(r.query_id, set()).add(r.lexeme)
    common = {w: n for w, n in df.items() if n > 30}
    for i, text in qs:
        tree = parse(from_web(text))
        ops = positive_terms(tree) if tree else []
        drop = terms_to_drop(ops, common, 3)
        assert got.get(i, set()) == {t.lexeme for t in ops if t.at not in drop}
