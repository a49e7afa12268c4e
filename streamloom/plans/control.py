"""Queries of connections: gates after a reconnect, headers, ends, commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commands, lifecycle, ordering
from ..sources.packets import packets
from .queries import KEY, PRIOR, SOFAR, TOLERANCE, query

_CONN = f"n0 AS (SELECT *, 1 + CAST(count(*) FILTER (event_type = 'signup') {PRIOR} AS BIGINT) AS connection FROM q)"
_GATED = (
    _CONN
    + f""", n1 AS (SELECT *, min(seq) OVER (PARTITION BY stream_id, connection) AS begin, min(CASE WHEN {KEY} THEN seq END) OVER (PARTITION BY stream_id) AS first_key,
coalesce(bool_or({KEY}) OVER (PARTITION BY stream_id, connection ORDER BY seq ROWS UNBOUNDED PRECEDING), false) AS opened FROM n0),
n2 AS (SELECT * FROM n1 WHERE connection = 1 OR coalesce(first_key >= begin, true) OR kind <> 'video' OR opened),
n3 AS (SELECT *, max(nd) {SOFAR} AS ndts FROM (SELECT *, dts - first_value(dts) OVER (PARTITION BY stream_id ORDER BY seq) AS nd FROM n2))"""
)


def _connected(spark, d):
    return packets(spark, d).withColumn("connection", 1 + F.count_if(F.col("event_type") == "signup").over(ordering.before()))


@query("SELECT stream_id, seq, connection FROM n2", _GATED)
def g01_reconnect_gate(spark, d):
    return lifecycle.reconnect_gate(_connected(spark, d)).select("stream_id", "seq", "connection")


@query("SELECT stream_id, seq, connection, ndts FROM n3", _GATED)
def f04_reattached(spark, d):
    return lifecycle.reattached(_connected(spark, d))[0]


@query(f"SELECT stream_id, connection, CAST(greatest(coalesce(max(last) OVER w, 0), 0) AS BIGINT) AS header_ts, coalesce(bool_or(keyed) OVER w, false) AS video FROM (SELECT stream_id, connection, max(ndts) AS last, bool_or({KEY}) AS keyed FROM n3 GROUP BY 1, 2) WINDOW w AS (PARTITION BY stream_id ORDER BY connection ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", _GATED)
def f04_headers(spark, d):
    return lifecycle.reattached(_connected(spark, d))[1]


@query(f"SELECT stream_id, count(*) FILTER (NOT ended) AS muxed, count(*) FILTER (ended) AS ignored, CAST(coalesce(sum(size) FILTER (NOT ended), 0) AS BIGINT) AS bytes, bool_or(ended) AS finished FROM (SELECT *, coalesce(bool_or(event_type = 'error') {SOFAR}, false) AS ended FROM q) GROUP BY 1")
def f11_finished(spark, d):
    return lifecycle.finished(packets(spark, d), F.col("event_type") == "error")


@query(f"""SELECT stream_id, seq, CASE WHEN error IS NULL THEN greatest(nd, last) END AS ndts, error FROM (SELECT *, CASE WHEN unknown THEN 'config' WHEN last - nd > {TOLERANCE} THEN 'ordering' END AS error FROM (
SELECT *, greatest(coalesce(max(nd) {PRIOR}, 0), 0) AS last FROM (SELECT *, CASE WHEN NOT unknown THEN dts - first_value(CASE WHEN NOT unknown THEN dts END IGNORE NULLS) {SOFAR} END AS nd FROM (
SELECT *, needs AND NOT coalesce(bool_or(needs AND configured) OVER (PARTITION BY stream_id, kind ORDER BY seq ROWS UNBOUNDED PRECEDING), false) AS unknown FROM (SELECT *, kind <> 'video' OR is_key AS needs, size % 3 <> 0 AS configured FROM q)))))""")
def e04_muxed(spark, d):
    return lifecycle.muxed(packets(spark, d).withColumn("configured", F.col("size") % 3 != 0), TOLERANCE)


_LOG = """l AS (SELECT stream_id AS conn_id, seq AS ord, CASE event_type WHEN 'purchase' THEN 'connect' WHEN 'signup' THEN 'createStream' WHEN 'click' THEN 'releaseStream' WHEN 'view' THEN 'publish' ELSE 'other' END AS name,
CASE WHEN size % 7 <> 0 THEN CAST(size % 3 + 1 AS DOUBLE) END AS txn, CASE WHEN size % 4 <> 0 THEN 'live' WHEN size % 8 = 0 THEN 'test' END AS app, CASE WHEN size % 5 <> 0 THEN 'k' || stream_id END AS key FROM q),
l1 AS (SELECT *, name = 'publish' OR (name = 'connect' AND coalesce(app, '') <> 'live') AS settles FROM l),
l2 AS (SELECT * FROM (SELECT *, coalesce(bool_or(settles) OVER (PARTITION BY conn_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM l1) WHERE NOT over)"""


def _log(spark, d):
    kind, size = F.col("event_type"), F.col("size")
    name = F.when(kind == "purchase", "connect").when(kind == "signup", "createStream").when(kind == "click", "releaseStream").when(kind == "view", "publish").otherwise("other")
    txn = F.when(size % 7 != 0, (size % 3 + 1).cast("double"))
    app = F.when(size % 4 != 0, "live").when(size % 8 == 0, "test")
    key = F.when(size % 5 != 0, F.concat(F.lit("k"), F.col("stream_id")))
    return packets(spark, d).select(F.col("stream_id").alias("conn_id"), F.col("seq").alias("ord"), name.alias("name"), txn.alias("txn"), app.alias("app"), key.alias("key"))


@query("""SELECT conn_id, CASE WHEN e IS NULL THEN 'pending' WHEN e.name = 'connect' THEN 'rejected' WHEN e.key IS NULL THEN 'invalid' ELSE 'published' END AS state, CASE WHEN joined THEN 'live' ELSE '' END AS app,
CASE WHEN e.name = 'publish' THEN e.key END AS key, e.ord AS ord FROM (SELECT conn_id, arg_max({'name': name, 'key': key, 'ord': ord}, ord) FILTER (settles) AS e, bool_or(name = 'connect' AND NOT settles) AS joined FROM l2 GROUP BY 1)""", _LOG)
def s08_negotiated(spark, d):
    return commands.negotiated(_log(spark, d), "live")


@query("""SELECT conn_id, ord, reply, txn, code FROM (SELECT conn_id, ord, CASE WHEN name = 'connect' AND settles THEN '_error' WHEN name IN ('connect', 'releaseStream', 'createStream') THEN '_result' WHEN name = 'publish' AND key IS NOT NULL THEN 'onStatus' END AS reply,
CASE WHEN name = 'publish' THEN 0.0 ELSE coalesce(txn, CASE WHEN name = 'createStream' THEN 2.0 ELSE 1.0 END) END AS txn, CASE WHEN name = 'connect' AND settles THEN 'NetConnection.Connect.Rejected' WHEN name = 'createStream' THEN '1' WHEN name = 'publish' THEN 'NetStream.Publish.Start' END AS code FROM l2) WHERE reply IS NOT NULL""", _LOG)
def g05_replies(spark, d):
    return commands.replies(_log(spark, d), "live")


_ASKED = """a0 AS (SELECT conn_id, ord, CASE name WHEN 'publish' THEN '_result' WHEN 'other' THEN '_error' ELSE name END AS name, txn, name IN ('connect', 'createStream') AS ask FROM (SELECT stream_id AS conn_id, seq AS ord, CASE event_type WHEN 'purchase' THEN 'connect' WHEN 'signup' THEN 'createStream' WHEN 'view' THEN 'publish' WHEN 'error' THEN 'other' ELSE 'note' END AS name, CASE WHEN size % 7 <> 0 THEN CAST(size % 3 + 1 AS DOUBLE) END AS txn FROM q)),
a1 AS (SELECT *, count(*) FILTER (NOT ask) OVER (PARTITION BY conn_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS n FROM a0),
a2 AS (SELECT a.conn_id, a.ord, min(b.ord) AS answer_ord FROM a1 a JOIN a1 b ON b.conn_id = a.conn_id AND b.ord > a.ord AND b.n - a.n <= 5 AND (b.name = '_error' OR (b.name = '_result' AND b.txn = a.txn)) WHERE a.ask AND NOT b.ask GROUP BY 1, 2)"""


@query("SELECT a1.conn_id, a1.ord, a1.txn, coalesce(b.name, 'missing') AS answer, answer_ord FROM a1 LEFT JOIN a2 ON a2.conn_id = a1.conn_id AND a2.ord = a1.ord LEFT JOIN a1 b ON b.conn_id = a1.conn_id AND b.ord = answer_ord WHERE a1.ask", _ASKED)
def f14_answers(spark, d):
    kind, size = F.col("event_type"), F.col("size")
    name = F.when(kind == "purchase", "connect").when(kind == "signup", "createStream").when(kind == "view", "_result").when(kind == "error", "_error").otherwise("note")
    log = packets(spark, d).select(F.col("stream_id").alias("conn_id"), F.col("seq").alias("ord"), name.alias("name"), F.when(size % 7 != 0, (size % 3 + 1).cast("double")).alias("txn"))
    return commands.answers(log, F.col("name").isin("connect", "createStream"), 5)
