"""The control plane as a log: commands of connections, replies, and their requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Messages that a request waits for its answer.
PENDING = 64
#: The replies' names and codes.
STARTED, REJECTED, STREAM = "NetStream.Publish.Start", "NetConnection.Connect.Rejected", 1
#: Commands that expect a plain result, and those that end a stream.
PLAIN, ENDS = ("releaseStream", "FCPublish"), ("deleteStream", "closeStream", "FCUnpublish")


def _until_settled(log: DataFrame, app: str) -> DataFrame:
    """The commands up to the one that settles a connection: a publish, or a
    connect to another app (settles)."""
    settles = (F.col("name") == "publish") | ((F.col("name") == "connect") & (F.coalesce("app", F.lit("")) != app))
    w = Window.partitionBy("conn_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = log.withColumn("settles", settles)
    return rows.withColumn("over", F.coalesce(F.max("settles").over(w), F.lit(False))).where("not over").drop("over")


def negotiated(log: DataFrame, app: str) -> DataFrame:
    """(conn_id, state, app, key, ord) of log(conn_id, ord, name, txn, app, key):
    how a connection's commands end.  "published" with its key; "rejected" by a
    connect to another app; "invalid" by a publish without a key; else "pending".
    app: the app it connected to, "" without a connect that was accepted."""
    rows = _until_settled(log, app)
    end = F.max_by(F.struct("name", "key", "ord"), F.when(F.col("settles"), F.col("ord")))
    out = rows.groupBy("conn_id").agg(end.alias("e"), F.max((F.col("name") == "connect") & ~F.col("settles")).alias("joined"))
    state = F.when(F.col("e").isNull(), "pending").when(F.col("e.name") == "connect", "rejected").when(F.col("e.key").isNull(), "invalid").otherwise("published")
    return out.select("conn_id", state.alias("state"), F.when(F.col("joined"), app).otherwise("").alias("app"), F.when(state == "published", F.col("e.key")).alias("key"), F.col("e.ord").alias("ord"))


def replies(log: DataFrame, app: str) -> DataFrame:
    """(conn_id, ord, reply, txn, code): what each command is answered with, until
    the connection is settled; commands without an answer give no row."""
    rows, name = _until_settled(log, app), F.col("name")
    plain = name.isin(*PLAIN)
    reply = F.when(name == "connect", F.when(F.col("settles"), "_error").otherwise("_result")).when(plain | (name == "createStream"), "_result").when((name == "publish") & F.col("key").isNotNull(), "onStatus")
    txn = F.when(name == "publish", 0.0).otherwise(F.coalesce(F.col("txn"), F.when(name == "createStream", 2.0).otherwise(1.0)))
    code = F.when((name == "connect") & F.col("settles"), REJECTED).when(name == "createStream", F.lit(str(STREAM))).when(name == "publish", STARTED)
    return rows.withColumn("reply", reply).where("reply is not null").select("conn_id", "ord", "reply", txn.alias("txn"), code.alias("code"))


def answers(log: DataFrame, is_request: Column, most: int = PENDING) -> DataFrame:
    """(conn_id, ord, txn, answer, answer_ord) for the requests of log(conn_id,
    ord, name, txn): "_result" if one with its transaction comes before any
    "_error" among the next `most` messages that are no requests, "_error" if
    that comes first, else "missing"."""
    w = Window.partitionBy("conn_id").orderBy("ord")
    back = Window.partitionBy("conn_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("conn_id", "txn").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    rows = log.withColumn("ask", is_request).withColumn("n", F.count_if(~F.col("ask")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    told = lambda kind: F.when(~F.col("ask") & (F.col("name") == kind), F.struct("n", "ord"))
    rows = rows.withColumn("good", F.min(told("_result")).over(same)).withColumn("bad", F.min(told("_error")).over(back))
    rows = rows.where("ask").withColumn("good", F.when(F.col("txn").isNotNull(), F.col("good")))
    first = F.least("good", "bad")
    near = F.when(first["n"] - F.col("n") <= most, first)
    return rows.withColumn("a", near).select("conn_id", "ord", "txn", F.when(F.col("a").isNull(), "missing").when(F.col("a") == F.col("good"), "_result").otherwise("_error").alias("answer"), F.col("a.ord").alias("answer_ord"))
