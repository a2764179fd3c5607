import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tamarisk.config import Settings, scoped
from tamarisk.operators.evalset import import_judgements, resolve_references
from tamarisk.operators.literals import judging_queries, seed_queries
from tamarisk.operators.pipeline import ingest_round
from tamarisk.operators.schema import TABLES, create_missing, violations
from tamarisk.sources.records import (
    RecordPages, ResponseCache, Retryable, Service, TokenBucket, console_table, normalise_records, read_judgements, read_pages, retrying,
    search_pages, write_pool,
)
from tamarisk.operators.store import VersionedTable, publish
from tamarisk.streaming.ingest import documents_table, ingest_stream, merge_batch, windowed_counts


def page(ids, cursor):
    return {"resultList": {"result": [{"id": i, "title": f"t{i}", "abstractText": "A."} for i in ids]}, "nextCursorMark": cursor}


def test_paging():
    pages = {"*": page([1, 2], "b"), "b": page([3], "c"), "c": page([], "d")}
    get = lambda p: pages[p["cursorMark"]]
    assert [r["id"] for r in search_pages(get, "q")] == [1, 2, 3]
    assert [r["id"] for r in search_pages(get, "q", most=2)] == [1, 2]
    assert [r["id"] for r in search_pages(lambda p: page([1], "*"), "q")] == [1]
    assert [r["id"] for r in search_pages(lambda p: page([1], None), "q")] == [1]


def test_cache_and_limits(tmp_path):
    c = ResponseCache(str(tmp_path))
    assert c.get("s", {"a": 1}) is None
    c.put("s", {"a": 1, "b": 2}, {"x": 1})
    assert c.get("s", {"b": 2, "a": 1}) == {"x": 1}
    f = next(tmp_path.rglob("*.json"))
    assert len(f.relative_to(tmp_path).parts) == 3
    f.write_text("{broken")
    assert c.get("s", {"a": 1, "b": 2}) is None and not f.exists()
    now, slept = [0.0], []
    b = TokenBucket(2.0, 1, lambda: now[0], slept.append)
    for _ in range(3):
        b.acquire()
    assert slept == [0.5, 1.0]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise Retryable
        return {"ok": 1}

    assert retrying(flaky, sleep=lambda s: None) == {"ok": 1}
    with pytest.raises(Retryable):
        retrying(lambda: (_ for _ in ()).throw(Retryable()), sleep=lambda s: None)
    with pytest.raises(ValueError):
        retrying(lambda: (_ for _ in ()).throw(ValueError()))


def test_data_source(spark, tmp_path):
    c = ResponseCache(str(tmp_path))
    for q in ("x", "y"):
        c.put("search", {"query": q, "cursorMark": "*", "pageSize": 1000}, page([q + "1", q + "2"], "*"))
    spark.dataSource.register(RecordPages)
    raw = spark.read.format("record_pages").option("queries", json.dumps(["x", "y"])).option("cache", str(tmp_path)).load()
    assert sorted(r.ext_id for r in normalise_records(raw).collect()) == ["x1", "x2", "y1", "y2"]


def test_normal_form(spark):
    recs = [
        {"id": " 7 ", "title": " T ", "abstractText": " A ", "pubYear": "20x1", "citedByCount": "no", "isOpenAccess": "Y", "journalTitle": "J2", "journalInfo": {"journal": {"title": "J"}}},
        {"id": "6", "title": "no abstract", "source": "PPR"}, {"id": "7b", "title": " T ", "abstractText": "\t "},
        {"id": "8", "title": "U", "abstractText": "B", "source": "PPR", "pubYear": "2020", "citedByCount": 4, "journalTitle": "J2"}, {"id": "9", "title": " "}, {"title": "x"},
    ]
    raw = spark.createDataFrame([(json.dumps(r),) for r in recs] + [("not json",), (None,)], "record string")
    got = {r.ext_id: r for r in normalise_records(raw).collect()}
    assert set(got) == {"7", "8"}
    assert (got["7"].source, got["7"].title, got["7"].abstract, got["7"].pub_year, got["7"].cited_by, got["7"].is_open_access, got["7"].journal) == ("MED", "T", "A", None, 0, True, "J")
    assert (got["8"].source, got["8"].pub_year, got["8"].cited_by, got["8"].journal, got["8"].is_open_access) == ("PPR", 2020, 4, "J2", False)


def test_judgements(spark, tmp_path):
    pool = spark.createDataFrame([("q, \"x\"", 1, "t", "p\nq", "fts", "2"), ("q", 2, "t", "p", "fts", ""), ("q", 3, "t", "p", "fts", "maybe"), ("q", 4, "t", "p", "fts", " 0 ")],
                                 "query string, doc_id long, title string, passage string, found_by string, relevance string")
    write_pool(pool, str(tmp_path / "pool"))
    back = import_judgements(read_judgements(spark, str(tmp_path / "pool")))
    assert sorted(tuple(r) for r in back.collect()) == [("q", 4, 0), ('q, "x"', 1, 2)]


def test_references(spark):
    docs = spark.createDataFrame([(1, "P1", None, "10.1/A"), (2, "P2", "C2", None), (3, "p1 ", None, None)], "doc_id long, pmid string, pmcid string, doi string")
    refs = spark.createDataFrame([(9, 0, None, "P1", None, None), (9, 1, "zz", None, "c2", "10.1/a"), (2, 0, None, "P2", None, None), (9, 2, None, None, None, " 10.1/a"), (9, 3, None, None, None, None)],
                                 "doc_id long, ref_no int, id string, pmid string, pmcid string, doi string")
    assert sorted(tuple(r) for r in resolve_references(refs, docs).collect()) == [(9, 1), (9, 2)]


def test_stream(spark, tmp_path):
    schema = "source string, ext_id string, doc_id long, title string, abstract string, cited_by int, ingested_at timestamp"
    day = lambda n: F.lit(f"2024-01-0{n}").cast("timestamp")
    for n, rows in ((1, [("M", "1", "a", "x"), ("M", "2", "b", None)]), (2, [("M", "1", "a2", None), ("P", "1", "c", None)])):
        spark.createDataFrame(rows, "source string, ext_id string, title string, abstract string").withColumns(
            {"doc_id": F.lit(0).cast("long"), "cited_by": F.lit(n), "ingested_at": day(n)}).select(
            "source", "ext_id", "doc_id", "title", "abstract", "cited_by", "ingested_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = str(tmp_path / "t")
    full = spark.read.parquet(str(tmp_path / "in")).schema
    ingest_stream(spark, str(tmp_path / "in"), full, table, str(tmp_path / "c"), files_per_trigger=1).awaitTermination()
    rows = lambda: {(r.source, r.ext_id): (r.title, r.abstract, r.doc_id) for r in documents_table(spark, table).read().collect()}
    got = rows()
    assert set(got) == {("M", "1"), ("M", "2"), ("P", "1")} and got["M", "1"][:2] == ("a2", "x") and sorted(r[2] for r in got.values()) == [1, 2, 3]
    new = spark.createDataFrame([("Z", "9", 0, "z", None, 1, None)], schema)
    for epoch in (0, 1):
        assert not merge_batch(spark, table, new, epoch, "ingested_at") and rows() == got  # replayed: nothing changes
    assert merge_batch(spark, table, new, 2, "ingested_at") and rows()["Z", "9"][2] == 4


def test_replay_of_the_first_batch(spark, tmp_path):
    new = spark.createDataFrame([("Z", "9", 0, "z", None, 1, None)], "source string, ext_id string, doc_id long, title string, abstract string, cited_by int, ingested_at timestamp")
    assert merge_batch(spark, str(tmp_path / "t"), new, 0, "ingested_at") and not merge_batch(spark, str(tmp_path / "t"), new, 0, "ingested_at")
    assert documents_table(spark, str(tmp_path / "t")).read().count() == 1


def test_a_writer_dies(spark, tmp_path, monkeypatch):
    """Between any two steps the last version stays readable, and the next write mends it."""
    t = VersionedTable(spark, str(tmp_path / "t"), ("k",), 4)
    rows = lambda *ks: spark.createDataFrame([(k, k * 10) for k in ks], "k long, v long")
    assert t.read() is None and t.manifest() is None
    t.commit(rows(*range(8)), mark=0, facts={"x": 1})
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            t.commit(rows(100), t.touched(rows(100)), mark=1)
    assert sorted(r.k for r in t.read().collect()) == list(range(8)) and t.manifest()["mark"] == 0
    touched = t.touched(rows(3))
    stay = [r.k for r in t.read().collect() if r.k not in {r.k for r in t.read(touched).collect()}]
    t.commit(rows(3, 3), touched, mark=1)  # only the bucket of 3 is written
    assert sorted(r.k for r in t.read().collect()) == sorted([*stay, 3, 3]) and t.manifest()["facts"] == {"x": 1}
    assert sorted(r.k for r in t.read(version=0).collect()) == list(range(8))
    t.commit(t.read().where("k <> 3"), mark=2)  # from itself
    assert sorted(r.k for r in t.read().collect()) == sorted(stay)
    assert t.vacuum(1) >= 2 and sorted(r.k for r in t.read().collect()) == sorted(stay) and len(t.versions()) == 1
    t.commit(rows().limit(0))
    assert t.read().count() == 0 and t.read().columns == ["k", "v"]
    assert publish(rows(1), str(tmp_path / "p")).count() == 1 and publish(rows(1, 2), str(tmp_path / "p")).count() == 2


def test_windows(spark):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.n, r.mean_value) for r in windowed_counts(events).collect()] == [(2, 2.0)]


def test_settings():
    s = Settings.from_env({"TAMARISK_RRF_K": "10", "TAMARISK_RRF_WEIGHTED": "false", "TAMARISK_QUERY_PREFIX": "q: "})
    assert s.rrf_k == 10 and s.arm_weights() == {} and s.query_prefix == "q: "
    assert s.fingerprint() != Settings().fingerprint() == Settings().fingerprint()


class Handler(BaseHTTPRequestHandler):
    """Two pages a query; every third call fails with 503."""

    calls: list = []

    def do_GET(self):
        self.calls.append(self.path)
        if len(self.calls) % 3 == 0:
            self.send_error(503)
            return
        if "bad" in self.path:
            self.send_error(404)
            return
        at = parse_qs(urlparse(self.path).query)
        cursor, q = at["cursorMark"][0], at["query"][0]
        body = json.dumps(page([q + "1"], "b") if cursor == "*" else page([q + "2"], "b")).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_live_pages(spark, tmp_path):
    """From a service: throttled, retried and cached; the second read asks nothing."""
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    s = Settings(requests_per_second=200.0, concurrency=2, timeout_s=5.0)
    ask = lambda: sorted(r.ext_id for r in normalise_records(read_pages(spark, ["x", "y"], str(tmp_path), url, s, least_wait=0.01)).collect())
    assert ask() == ["x1", "x2", "y1", "y2"]
    n = len(Handler.calls)
    assert n >= 5 and ask() == ["x1", "x2", "y1", "y2"] and len(Handler.calls) == n
    with pytest.raises(Exception, match="404"):
        Service(str(tmp_path / "c"), url, 100.0, least_wait=0.01).get("search", {"query": "bad", "cursorMark": "*"})
    server.shutdown()
    with pytest.raises(Retryable):
        Service(str(tmp_path / "c"), "http://127.0.0.1:9", 100.0, tries=2, timeout=0.5, least_wait=0.01).get("search", {"query": "z"})


def test_ingest_round(spark):
    day = F.lit("2025-01-01").cast("timestamp")
    docs = "doc_id long, source string, ext_id string, pmid string, pmcid string, doi string, title string, abstract string, journal string, pub_year int, cited_by int, is_open_access boolean, ingested_at timestamp, canonical_doc_id long"
    stored = spark.createDataFrame([(4, "MED", "1", None, None, None, "old", "old text.", None, 2000, 0, False, None, None)], docs)
    have = spark.createDataFrame([(4, 0, "title", "kept")], "doc_id long, ordinal int, section string, text string")
    log = spark.createDataFrame([("seen", 3, None)], "query string, n_docs int, fetched_at timestamp")
    rec = lambda q, **r: (q, json.dumps(r))
    raw = spark.createDataFrame([rec("seen", id="9", title="x", abstractText="y"), rec("a", id="1", title="new", abstractText="One. Two."), rec("a", id="2", title="b", abstractText="Text."),
                                 rec("b", id="2", title="b", abstractText="Text."), rec("c", id="3", title="no abstract")], "query string, record string")
    r = ingest_round(raw, stored, have, log, day)
    assert {(x.ext_id, x.doc_id): x.title for x in r.documents.collect()} == {("1", 4): "new", ("2", 5): "b"}
    assert {(x.doc_id, x.ordinal): x.text for x in r.passages.collect()} == {(4, 0): "kept", (4, 1): "One. Two.", (5, 0): "b Text.", (5, 1): "Text."}
    assert {x.query: x.n_docs for x in r.log.collect()} == {"seen": 3, "a": 2, "b": 1}
    assert r.totals.collect()[0].asDict() == {"documents": 3, "passages": 6, "skipped": 1}
    assert ingest_round(raw, stored, have, log, day, skip_seen=False).totals.collect()[0].skipped == 0
    none = ingest_round(raw.where("false"), stored, have, log, day)
    assert none.totals.collect()[0].asDict() == {"documents": 0, "passages": 0, "skipped": 0} and none.documents.count() == 1


def test_schema(spark, tmp_path):
    assert set(create_missing(spark, str(tmp_path))) == set(TABLES) and create_missing(spark, str(tmp_path)) == []
    tables = {n: spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in TABLES}
    assert {r.n_rows for r in violations(tables).collect()} == {0}
    tables["eval_qrels"] = spark.createDataFrame([(1, 2, 9), (1, 2, None), (None, 2, 1)], "query_id long, doc_id long, relevance int")
    got = {r.constraint_name: r.n_rows for r in violations(tables).where("table_name = 'eval_qrels'").collect()}
    assert got == {"required query_id": 1, "required doc_id": 0, "required relevance": 1, "check relevance_range": 1, "unique query_id, doc_id": 1, "refers query_id": 2, "refers doc_id": 3}


def test_literals_and_tables(spark):
    rows = judging_queries(spark).collect()
    assert len(rows) == 40 and len({r.grp for r in rows}) == 5 and len({r.query_text for r in rows}) == 40 and len(set(seed_queries())) == 15
    assert judging_queries(spark, most=7).count() == 7
    assert console_table(spark.createDataFrame([("fts", 1, 0.5), ("dense", 12, None)], "arm string, n int, r double")) == (
        "arm     n       r\n-----  --  ------\nfts     1  0.5000\ndense  12")


def test_scoped_settings(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), scoped(spark, {key: 3, "spark.tamarisk.x": 1}):
        assert spark.conf.get(key) == "3" and spark.conf.get("spark.tamarisk.x") == "1"
        raise ValueError
    assert spark.conf.get(key) == before and spark.conf.get("spark.tamarisk.x", None) is None
