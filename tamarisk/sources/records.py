"""Bibliographic records: paged search as a data source, its cache, and normal form."""

from __future__ import annotations

import hashlib
import http.client
import json
import os
import random
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tamarisk.config import Settings
from tamarisk.functions.text import blank_to_null, strip

RECORD = (
    "source string, id string, pmid string, pmcid string, doi string, title string, abstractText string, pubYear string, "
    "citedByCount string, isOpenAccess string, journalTitle string, journalInfo struct<journal:struct<title:string>>"
)


class Retryable(Exception):
    """429, 5xx, a timeout or a broken transport; anything else is raised at once."""


class TokenBucket:
    """At most ``rate`` calls a second on average, ``burst`` at once."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.level, self.at, self.lock = float(burst), clock(), threading.Lock()

    def acquire(self) -> None:
        with self.lock:
            now = self.clock()
            self.level = min(self.burst, self.level + (now - self.at) * self.rate)
            self.at = now
            self.level -= 1
            wait = max(0.0, -self.level / self.rate)
        if wait:
            self.sleep(wait)


def retrying(call: Callable[[], dict], tries: int = 5, least: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    for n in range(tries):
        try:
            return call()
        except Retryable:
            if n + 1 == tries:
                raise
            sleep(min(most, random.uniform(least, least * 2 ** (n + 1))))
    raise AssertionError


class ResponseCache:
    """Responses by path and parameters, in two levels of folders; a damaged entry is dropped and
    counts as a miss. ``root`` is a folder or a URI (hdfs://, s3://) that all executors share."""

    def __init__(self, root: str) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))

    def _file(self, path: str, params: dict) -> str:
        key = hashlib.sha256((path + json.dumps(params, sort_keys=True)).encode()).hexdigest()
        return f"{self.root}/{key[:2]}/{key[2:4]}/{key}.json"

    def get(self, path: str, params: dict) -> dict | None:
        f = self._file(path, params)
        try:
            with self.fs.open_input_stream(f) as s:
                return json.loads(s.read())
        except FileNotFoundError:
            return None
        except ValueError:
            self.fs.delete_file(f)
            return None

    def put(self, path: str, params: dict, value: dict) -> None:
        f = self._file(path, params)
        self.fs.create_dir(f.rsplit("/", 1)[0], recursive=True)
        part = f"{f}.{os.getpid()}.{threading.get_ident()}"
        with self.fs.open_output_stream(part) as s:
            s.write(json.dumps(value).encode())
        self.fs.move(part, f)


def http_get(base_url: str, path: str, params: dict, timeout: float) -> dict:
    """One GET for JSON. 429, 5xx, time-outs and broken transport are Retryable; the rest is raised."""
    url = f"{base_url.rstrip('/')}/{path}?{urllib.parse.urlencode(params)}"
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return json.loads(r.read())
    except urllib.error.HTTPError as e:
        if e.code == 429 or e.code >= 500:
            raise Retryable(str(e)) from e
        raise
    except (urllib.error.URLError, TimeoutError, ConnectionError, http.client.HTTPException) as e:
        raise Retryable(str(e)) from e


class Service:
    """Cached, throttled, retried calls: the cache first, then the token bucket and the semaphore, then
    up to five tries; what came back is cached. Without a base URL a miss is an error."""

    def __init__(self, cache: str, base_url: str | None = None, rate: float = 6.0, concurrency: int = 6, timeout: float = 30.0,
                 tries: int = 5, least_wait: float = 1.0) -> None:
        self.cache, self.base_url, self.timeout, self.tries, self.least = ResponseCache(cache), base_url, timeout, tries, least_wait
        self.bucket, self.slots = TokenBucket(rate), threading.BoundedSemaphore(max(1, concurrency))

    def get(self, path: str, params: dict) -> dict:
        held = self.cache.get(path, params)
        if held is None:
            if not self.base_url:
                raise FileNotFoundError(f"no response is cached for {params}, and no service is named")
            held = retrying(lambda: self._once(path, params), self.tries, self.least)
            self.cache.put(path, params, held)
        return held

    def _once(self, path: str, params: dict) -> dict:
        with self.slots:
            self.bucket.acquire()
            return http_get(self.base_url, path, params, self.timeout)


def search_pages(get: Callable[[dict], dict], query: str, most: int = 5000, page_size: int = 1000) -> Iterator[dict]:
    """Records of all pages: ends at an empty page, a missing or repeated cursor, or ``most``."""
    cursor, seen, n = "*", set(), 0
    while cursor and cursor not in seen and n < most:
        seen.add(cursor)
        body = get({"query": query, "cursorMark": cursor, "pageSize": page_size})
        found = (body.get("resultList") or {}).get("result") or []
        if not found:
            return
        for r in found[: most - n]:
            n += 1
            yield r
        cursor = body.get("nextCursorMark")


class _Query(InputPartition):
    def __init__(self, query: str) -> None:
        super().__init__(query)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.queries = json.loads(options["queries"])
        self.most, self.page, self.path = int(options.get("max_results", 5000)), int(options.get("page_size", 1000)), options.get("path", "search")
        share = max(1, min(len(self.queries), int(options.get("tasks", 8))))  # tasks that run at once share the rate
        self.service = {"cache": options["cache"], "base_url": options.get("base_url"), "rate": float(options.get("rate", 6.0)) / share,
                        "concurrency": int(options.get("concurrency", 6)), "timeout": float(options.get("timeout", 30.0)),
                        "least_wait": float(options.get("least_wait", 1.0))}

    def partitions(self) -> list[InputPartition]:
        return [_Query(q) for q in self.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        service = Service(**self.service)
        for r in search_pages(lambda params: service.get(self.path, params), partition.value, self.most, self.page):
            yield partition.value, json.dumps(r)


class RecordPages(DataSource):
    """format("record_pages"): one partition a query, rows (query, record JSON).

    Options: queries (JSON list), cache (shared folder or URI), base_url (none: cached responses
    only), path, max_results, page_size, rate (calls a second over all tasks), tasks (that run at
    once), concurrency (calls at once in a task), timeout (seconds), least_wait (seconds).
    """

    @classmethod
    def name(cls) -> str:
        return "record_pages"

    def schema(self) -> str:
        return "query string, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_pages(spark: SparkSession, queries: list[str], cache: str, base_url: str | None = None, s: Settings = Settings(), **options) -> DataFrame:
    """Raw records of all pages of the queries, by the settings' rate, concurrency and time-out."""
    spark.dataSource.register(RecordPages)
    given = {"queries": json.dumps(queries), "cache": cache, "rate": s.requests_per_second, "concurrency": s.concurrency, "timeout": s.timeout_s,
             **({"base_url": base_url} if base_url else {}), **options}
    return spark.read.format("record_pages").options(**{k: str(v) for k, v in given.items()}).load()


def normalise_records(raw: DataFrame, record_col: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw JSON records to document columns (after the columns to ``keep``); records without a title,
    an id or an abstract are left out: a title alone is too thin to be found by.

    A missing source is MED; an unreadable year is null, an unreadable citation count
    0; blanks are null; the journal's own title goes before the record's.
    """
    r = F.from_json(F.col(record_col), RECORD)
    rows = raw.select(*keep, r.alias("r")).where("r is not null")
    return rows.select(
        *keep,
        F.coalesce(F.nullif("r.source", F.lit("")), F.lit("MED")).alias("source"), strip(F.coalesce("r.id", F.lit(""))).alias("ext_id"),
        "r.pmid", "r.pmcid", "r.doi", strip(F.col("r.title")).alias("title"), blank_to_null(F.col("r.abstractText")).alias("abstract"),
        F.coalesce(F.nullif("r.journalInfo.journal.title", F.lit("")), "r.journalTitle").alias("journal"),
        F.expr("try_cast(trim(r.pubYear) as int)").alias("pub_year"),
        F.coalesce(F.expr("try_cast(trim(r.citedByCount) as int)"), F.lit(0)).alias("cited_by"),
        F.coalesce(F.col("r.isOpenAccess") == "Y", F.lit(False)).alias("is_open_access"),
    ).where("title <> '' and ext_id <> '' and abstract is not null")


def reference_lists(documents: DataFrame, cache: str, base_url: str | None = None, s: Settings = Settings(), tasks: int = 8) -> DataFrame:
    """(doc_id, ref_no, id, pmid, pmcid, doi): the reference list of each document, from the cache or,
    with a base URL, the service; those without a response give no rows. Each task asks for
    its own documents, at its share of the rate."""
    fields = ("id", "pmid", "pmcid", "doi")

    def run(batches):
        service = Service(cache, base_url, s.requests_per_second / max(1, tasks), s.concurrency, s.timeout_s)
        for b in batches:
            rows = []
            for d, source, ext in zip(b["doc_id"], b["source"], b["ext_id"], strict=True):
                asked = {"source": source, "ext_id": ext}
                body = (service.get("references", asked) if base_url else service.cache.get("references", asked)) or {}
                refs = (body.get("referenceList") or {}).get("reference") or []
                rows += [(d, n, *[None if r.get(f) is None else str(r[f]) for f in fields]) for n, r in enumerate(refs)]
            yield pd.DataFrame(rows, columns=["doc_id", "ref_no", *fields])

    return documents.select("doc_id", "source", "ext_id").mapInPandas(run, "doc_id long, ref_no int, id string, pmid string, pmcid string, doi string")


def write_runs(runs: DataFrame, path: str, label: str) -> None:
    """Rankings kept by label, to score again without retrieving again."""
    runs.withColumn("label", F.lit(label)).write.mode("overwrite").parquet(f"{path}/label={label}")


def read_runs(spark, path: str, label: str) -> DataFrame:
    return spark.read.parquet(f"{path}/label={label}")


def read_judgements(spark, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema="query string, doc_id long, title string, passage string, found_by string, relevance string")


def write_pool(pool: DataFrame, path: str) -> None:
    """One CSV for a person to fill in: small by its purpose."""
    pool.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def ablation_markdown(table: DataFrame, origin: str) -> str:
    """A row an arm, as Markdown; citation-derived labels carry their caveat with them."""
    lines = ["| arm | n | Recall@50 | nDCG@10 | MRR |", "|---|---|---|---|---|"]
    for r in table.orderBy("run").collect():  # a row an arm
        lines.append(f"| {r.run} | {r.n} | {r.recall:.4f} | {r.ndcg:.4f} | {r.mrr:.4f} |")
    if origin == "citation":
        lines += ["", "Labels derive from citations: weak supervision, not judgements."]
    return "\n".join(lines)



def console_table(rows: DataFrame, most: int = 50) -> str:
    """The first rows as an aligned text table: numbers to the right, to four places."""
    got = rows.limit(most).collect()
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    body = [[cell(v) for v in r] for r in got]
    width = [max([len(c), *[len(r[i]) for r in body]]) for i, c in enumerate(rows.columns)]
    right = [bool(got) and isinstance(got[0][i], (int, float)) for i in range(len(width))]
    line = lambda r: "  ".join(v.rjust(w) if x else v.ljust(w) for v, w, x in zip(r, width, right, strict=True)).rstrip()
    return "\n".join([line(rows.columns), line(["-" * w for w in width]), *map(line, body)])
