"""The registry of queries, and the corpora that they are over.

Three corpora stand for the entities: OB, orders with the brands of their lines; EV, users with their events; DOC,
documents with their words.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentograph.operators import corpus, graph, ngrams

from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ob(spark: SparkSession, sf: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    lines = table(spark, sf, "lineitem").select("l_orderkey", *order).join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return corpus.ordered_tokens(lines.withColumn("token", F.replace("p_brand", F.lit("Brand#"), F.lit("B"))), "l_orderkey", "token", order)


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.ordered_tokens(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", "event_type", ["ts", "event_id"])


def doc(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\f\u000B]+"), "")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", words.alias("tokens"))


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the session's checkpoint folder, for what a query writes and reads back."""
    return f"{graph.checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ev_graph(spark: SparkSession, sf: str, longest: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, nodes, edges) of EV, cut from their lineage as iterations come back to them."""
    posted = ngrams.postings(ev(spark, sf), longest)
    nodes = graph.cut(ngrams.closed(ngrams.support(posted)))
    return posted, nodes, graph.cut(ngrams.containment_edges(nodes))


def w(*parts: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(parts) + " "


EVG = (sql.EV, sql.windows("ev", 3), sql.CLOSED, sql.EDGES)
EVD = (*EVG, sql.UNDIRECTED, sql.distances())
