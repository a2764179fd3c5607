"""Literal relations: seed queries for ingest, and queries for judges, in groups.

Both are built from topics of the invented corpus by rule, so a corpus of another field
needs other topics only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOPICS = ("insulator clusters", "splice site choice", "nucleosome arrays", "enhancer hubs", "antisense transcripts", "dosage compensation", "replication origins", "zygotic transcription")
GROUPS = {  # how a judge's query is put
    "topic": "{0}", "phrase": '"{0}"', "question": "what regulates {0}", "contrast": "{0} -{1}", "either": "{0} or {1}",
}


def seed_queries(topics: tuple[str, ...] = TOPICS) -> list[str]:
    """A search for each topic, and for each with its neighbour."""
    alone = [f'TITLE_ABS:"{t}"' for t in topics]
    return alone + [f"{a} AND {b}" for a, b in zip(alone, alone[1:])]


def judging_queries(spark: SparkSession, topics: tuple[str, ...] = TOPICS, most: int | None = None) -> DataFrame:
    """(ordinal, grp, query_text): a query of each group for each topic; the first ``most`` of them."""
    rows = [(g, form.format(t, topics[(i + 1) % len(topics)].split()[0])) for g, form in GROUPS.items() for i, t in enumerate(topics)]
    return spark.createDataFrame([(n, g, q) for n, (g, q) in enumerate(rows[:most])], "ordinal int, grp string, query_text string")
