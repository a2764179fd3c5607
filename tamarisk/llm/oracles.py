"""The SQL that pN_ queries must agree with, over whole tables.

Words are read by SQL of its own: tags, entities, compatibility forms and accents are
replaced step by step. It knows the forms that occur in the test tables (basic entities,
full-width letters, the ligatures and signs listed here), not all of Unicode, which is why
it checks the operators and doesn't serve them.
"""

from __future__ import annotations

# Entities (the ampersand last), and characters with a compatibility form of letters.
ENTITIES = (("&#40;", "("), ("&#41;", ")"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"))
FORMS = (("\U0001d6fd", "β"), ("™", "tm"), ("µ", "μ"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("…", "..."))


def words(text: str) -> str:
    """An expression for the list of words of a text expression; empty for a null."""
    x = f"regexp_replace(coalesce({text}, ''), '</?[A-Za-z][^<>]*>', '', 'g')"
    for a, b in (*ENTITIES, *FORMS):
        x = f"replace({x}, '{a}', '{b}')"
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
    x = f"lower(strip_accents(translate({x}, '{wide}', '{plain}')))"
    return rf"regexp_extract_all(regexp_replace({x}, '[\p{{M}}\p{{Cf}}]', '', 'g'), '[\p{{L}}\p{{N}}]+')"


GROUPS = """link AS (SELECT d.doc_id AS a, d.canonical_doc_id AS b FROM documents d JOIN documents c ON c.doc_id = d.canonical_doc_id WHERE d.doc_id <> d.canonical_doc_id),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, a AS b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
grp AS (SELECT a AS doc_id, min(b) AS group_id FROM reach GROUP BY 1)"""

_RECORDS = f"""rec AS (SELECT query_id, split, origin, array_to_string(w, ' ') AS canon, list_sort(list_distinct(w)) AS s FROM (
  SELECT query_id, lower(trim(split)) AS split, origin, {words('query_text')} AS w FROM eval_queries WHERE split IS NOT NULL) WHERE len(w) > 0 AND split IN ('train', 'dev', 'test')),
hit AS (SELECT a.query_id AS t, b.query_id AS e FROM rec a JOIN rec b ON a.split = 'train' AND b.split <> 'train'
  WHERE len(list_intersect(a.s, b.s)) >= 0.7 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) - 1e-9)"""
P1_FOUND = f"WITH {_RECORDS} SELECT DISTINCT least(t, e) AS query_id_a, greatest(t, e) AS query_id_b FROM hit"
P1_REPORT = f"""WITH {_RECORDS} SELECT split, origin, count(*) AS n_records, count(*) FILTER (WHERE canon IN (SELECT canon FROM rec WHERE split = 'train')) AS n_exact,
  count(*) FILTER (WHERE query_id IN (SELECT e FROM hit)) AS n_near FROM rec WHERE split <> 'train' GROUP BY 1, 2"""
P1_CLASSES = f"""WITH {_RECORDS} SELECT query_id, split, min(query_id) OVER (PARTITION BY s) AS class_id,
  (SELECT count(*) FROM rec o WHERE o.canon = r.canon AND (o.split = 'train') <> (r.split = 'train')) AS n_exact,
  (SELECT count(*) FROM hit WHERE r.query_id = CASE WHEN r.split = 'train' THEN t ELSE e END) AS n_links FROM rec r"""

P5_FOUND = f"""WITH RECURSIVE {GROUPS},
q AS (SELECT query_id, lower(trim(split)) AS split, array_to_string({words('query_text')}, ' ') AS k FROM eval_queries WHERE split IS NOT NULL),
said AS (SELECT DISTINCT c.citing_doc_id AS doc_id, array_to_string({words('context_text')}, ' ') AS k FROM citation_contexts c WHERE context_text IS NOT NULL AND citing_doc_id IS NOT NULL),
unit AS (SELECT DISTINCT q.query_id, coalesce(g.group_id, s.doc_id) AS u FROM q JOIN said s ON s.k = q.k AND q.k <> '' LEFT JOIN grp g ON g.doc_id = s.doc_id),
tie AS (SELECT DISTINCT x.query_id AS a, y.query_id AS b FROM unit x JOIN unit y USING (u)),
near AS (SELECT a, b FROM tie UNION SELECT n.a, t.b FROM near n JOIN tie t ON t.a = n.b),
own AS (SELECT q.query_id, q.split, coalesce(min(n.b), q.query_id) AS group_id FROM q LEFT JOIN near n ON n.a = q.query_id GROUP BY 1, 2)
SELECT group_id, query_id FROM own WHERE group_id IN (SELECT group_id FROM own GROUP BY 1 HAVING min(split) <> max(split))"""

_TERMS = f"""rec AS (SELECT passage_id, min(text) AS text FROM passages WHERE passage_id IS NOT NULL GROUP BY 1),
tok AS (SELECT passage_id, unnest({words('text')}) AS lexeme FROM rec),
t AS (SELECT lexeme, count(*) AS n_occ, count(DISTINCT passage_id) AS ndoc, count(DISTINCT passage_id) / (SELECT count(*) FROM rec)::DOUBLE AS df_frac FROM tok GROUP BY 1),
m AS (SELECT *, ndoc < 3 AS rare, ndoc > (SELECT count(*) FROM rec) * 0.05::DOUBLE AS common FROM t)"""
P6_TABLE = f"WITH {_TERMS} SELECT lexeme, n_occ, ndoc, df_frac, rare, common FROM m"
P6_FOUND = f"WITH {_TERMS} SELECT lexeme, 'rare' AS mark FROM m WHERE rare UNION ALL SELECT lexeme, 'common' FROM m WHERE common"


def _alike(run: int, threshold: float) -> str:
    """Groups by all pairs of documents that share a run of words."""
    runs = f"list_transform(range(1, len(w) - {run} + 2), lambda i: array_to_string(w[i : i + {run - 1}], ' '))"
    return f"""WITH RECURSIVE doc AS (SELECT doc_id, {words("coalesce(title, '') || ' ' || coalesce(abstract, '')")} AS w FROM documents),
bag AS (SELECT doc_id, list_sort(list_distinct({runs})) AS s FROM doc WHERE len(w) >= 20),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM bag),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING count(*) >= {threshold} * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
reach AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON p.a = r.b),
grp AS (SELECT a AS doc_id, min(b) AS g FROM reach GROUP BY 1)"""


P7_FOUND = _alike(3, 0.5) + " SELECT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b FROM grp x JOIN grp y ON x.g = y.g AND x.doc_id < y.doc_id"
P7_GROUPS = _alike(5, 0.8) + " SELECT b.doc_id AS id, min(b.doc_id) OVER (PARTITION BY s) AS class_id, least(g, b.doc_id) AS group_id FROM bag b JOIN grp USING (doc_id)"

P10_FOUND = f"""WITH doc AS (SELECT doc_id, {words('text')} AS w FROM documents),
run AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' '))) AS r FROM doc WHERE len(w) >= 20),
again AS (SELECT doc_id, n, i FROM run QUALIFY row_number() OVER (PARTITION BY doc_id, r ORDER BY i) > 1),
inside AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + 8)) AS at FROM again)
SELECT doc_id FROM inside GROUP BY doc_id, n HAVING count(*) / n::DOUBLE >= 0.3"""

_VECTORS = """v AS (SELECT passage_id AS id, min(embedding)::DOUBLE[] AS e FROM passages WHERE passage_id IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1)"""
# exact, by all pairs; the operator is approximate, but on tables of this size it misses nothing
P2_FOUND = f"""WITH {_VECTORS}, pair AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 12) AS c FROM v a JOIN v b ON a.id <> b.id),
near AS (SELECT a, b FROM pair WHERE c >= 0.9 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS passage_id_a, greatest(a, b) AS passage_id_b FROM near"""
P2_NEIGHBOURS = f"""WITH {_VECTORS}, pair AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 12) AS c FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0)
SELECT id, other, round(c, 6) AS cosine, row_number() OVER (PARTITION BY id ORDER BY c DESC, other)::INT AS place FROM pair QUALIFY place <= 5"""

SQL = {"p2_found": P2_FOUND, "p2_neighbours": P2_NEIGHBOURS, "p1_found": P1_FOUND, "p1_report": P1_REPORT, "p1_classes": P1_CLASSES, "p5_found": P5_FOUND, "p6_found": P6_FOUND, "p6_lexeme_df": P6_TABLE,
       "p6_after_changes": P6_TABLE, "p7_found": P7_FOUND, "p7_groups": P7_GROUPS, "p10_found": P10_FOUND}
