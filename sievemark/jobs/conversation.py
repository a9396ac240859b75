"""Conversation queries over all conversations and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import conversation as C
from ..operators import relational
from .base import query, table


def _m(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query("cv01_window", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 200")
def cv01(spark, sf_dir):
    return C.window(_m(spark, sf_dir)).select("conv_id", "turn", "role")


_LINES = "string_agg(role || ': ' || left(coalesce(text, ''), 500), chr(10) ORDER BY turn)"


@query("cv02_recent_context", f"SELECT conv_id, md5({_LINES}) AS context_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 8 GROUP BY conv_id")
def cv02(spark, sf_dir):
    return C.recent_context(_m(spark, sf_dir)).select("conv_id", F.md5("context").alias("context_md5"))


@query("cv03_rewind", "SELECT conv_id, turn, role FROM (SELECT *, max(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS u FROM conversations) WHERE u IS NULL OR turn < u")
def cv03(spark, sf_dir):
    return C.rewind(_m(spark, sf_dir)).select("conv_id", "turn", "role")


_STATE = "SELECT conv_id, count(*) AS messages, coalesce(sum(length(text)), 0) AS chars FROM conversations GROUP BY conv_id"


@query("cv04_trigger", f"SELECT conv_id, CAST(messages AS BIGINT) AS messages, messages > 256 OR chars // 4 > 128000 AS compact FROM ({_STATE})")
def cv04(spark, sf_dir):
    return C.compaction_state(_m(spark, sf_dir)).select("conv_id", "messages", "compact")


_SPLIT = "s AS (SELECT *, b > k AND NOT coalesce(b = k + 1 AND role = 'user' AND nx = 'assistant', false) AS compacted FROM (SELECT *, least(16, n // 2) AS k FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, count(*) OVER (PARTITION BY conv_id) AS n, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations)))"


@query("cv05_compaction_split", f"WITH {_SPLIT} SELECT conv_id, turn, compacted FROM s")
def cv05(spark, sf_dir):
    return C.split_for_compaction(_m(spark, sf_dir)).select("conv_id", "turn", "compacted")


@query("cv06_fallback_summary", f"WITH {_SPLIT} SELECT conv_id, md5({_LINES}) AS summary_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b2 FROM s WHERE compacted) WHERE b2 <= 12 GROUP BY conv_id")
def cv06(spark, sf_dir):
    return C.fallback_summary(_m(spark, sf_dir)).select("conv_id", F.md5("context").alias("summary_md5"))


@query("cv07_progress", f"SELECT conv_id, round(least(greatest(messages * 100e0 / 256, chars / 4e0 * 100e0 / 128000), 100e0), 2) AS percent FROM ({_STATE})")
def cv07(spark, sf_dir):
    return C.compaction_state(_m(spark, sf_dir)).select("conv_id", "percent")


@query("cv08_light_compaction", "SELECT conv_id, CAST(count(*) AS BIGINT) AS outputs, CAST(sum(length(text) - 40) AS BIGINT) AS saved FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b > 4 AND role = 'assistant' AND length(text) > 40 GROUP BY conv_id")
def cv08(spark, sf_dir):
    m = _m(spark, sf_dir).withColumn("b", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return m.where("b > 4 and role = 'assistant' and length(text) > 40").groupBy("conv_id").agg(F.count("*").alias("outputs"), F.sum(F.length("text") - 40).alias("saved"))


@query("cv09_token_estimate", f"SELECT conv_id, CAST(chars // 4 AS BIGINT) AS tokens FROM ({_STATE})")
def cv09(spark, sf_dir):
    return C.compaction_state(_m(spark, sf_dir)).select("conv_id", "tokens")


@query("cv10_usage", "SELECT user_id, CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN value END) + sum(CASE WHEN event_type = 'click' THEN value END), sum(CASE WHEN event_type = 'view' THEN value END), sum(CASE WHEN event_type = 'click' THEN value END)) AS DECIMAL(20,1)) AS total FROM (SELECT user_id, event_type, CAST(round(value, 3) AS DECIMAL(20,3)) AS value FROM events) GROUP BY user_id")
def cv10(spark, sf_dir):
    part = lambda t: F.sum(F.when(F.col("event_type") == t, F.round("value", 3).cast("decimal(20,3)")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(part("view").alias("a"), part("click").alias("b")).select("user_id", C.add_usage(F.col("a"), F.col("b")).cast("decimal(20,1)").alias("total"))


@query("cv11_tail_runs", "SELECT user_id, CAST(count(*) FILTER (WHERE o = 0) AS BIGINT) AS run FROM (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS o FROM events) GROUP BY user_id")
def cv11(spark, sf_dir):
    return C.tail_run(table(spark, sf_dir, "events"), "error", "user_id", ["ts", "event_id"])


@query("cv12_approval", "SELECT CASE WHEN event_type IN ('view', 'signup') THEN 'read_only' WHEN event_type = 'click' THEN 'workspace' WHEN event_type = 'purchase' THEN 'task' ELSE 'approval' END AS policy, count(*) AS n FROM events GROUP BY 1")
def cv12(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(C.approval(F.col("event_type"), ["view", "signup"], ["click"], ["purchase"]).alias("policy")).agg(F.count("*").alias("n"))


@query("cv13_round_limit", "SELECT user_id, CAST(CASE WHEN n <= 64 THEN 64 WHEN n <= 96 THEN 96 WHEN n <= 144 THEN 144 WHEN n <= 216 THEN 216 ELSE 256 END AS INT) AS round_limit FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def cv13(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", C.round_limit(F.col("n")).alias("round_limit"))


@query("cv14_group_barrier", "SELECT o_custkey, count(*) AS members, bool_and(o_orderstatus = 'F') AS ready FROM orders GROUP BY o_custkey")
def cv14(spark, sf_dir):
    return C.group_barrier(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F")


@query("cv15_role_policy", "SELECT conv_id, turn, role, CAST(CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 20 ELSE 10 END AS INT) AS max_rounds FROM conversations")
def cv15(spark, sf_dir):
    policy = spark.createDataFrame([("user", 15), ("assistant", 20)], "role string, max_rounds int")
    return _m(spark, sf_dir).join(F.broadcast(policy), "role", "left").select("conv_id", "turn", "role", F.coalesce("max_rounds", F.lit(10)).alias("max_rounds"))


@query("cv16_latest_sessions", "SELECT user_id, CAST(max(event_id) AS BIGINT) AS last_event, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated FROM events GROUP BY user_id")
def cv16(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query("sc15_dense_index", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS message_index FROM conversations")
def sc15(spark, sf_dir):
    return _m(spark, sf_dir).select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("message_index"))


@query("sc13_upsert", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS BIGINT) AS o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -1 - o_orderkey, o_custkey + 1000000, 'U' FROM orders WHERE o_orderkey % 7 = 0")
def sc13(spark, sf_dir):
    """Orders with a batch of changes: a third of them anew, and some that weren't there."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = orders.where("o_orderkey % 3 = 0").unionByName(orders.where("o_orderkey % 7 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey")))
    changed = changed.select("o_orderkey", (F.col("o_custkey") + 1_000_000).alias("o_custkey"), F.lit("U").alias("o_orderstatus"))
    return relational.upserted(orders, changed, ["o_orderkey"])


#: Messages with calls and replies, some of two replies, and earlier summaries, made of the conversations.
_TALK = {
    "role2": "CASE WHEN role = 'system' OR (conv_id % 5 = 0 AND turn IN (0, 3)) THEN 'system' WHEN turn % 4 = 2 OR (turn % 4 = 3 AND conv_id % 2 = 0) THEN 'tool' ELSE role END",
    "call_id": "CASE WHEN turn % 4 = 1 THEN concat('k', CAST(turn AS STRING)) WHEN turn % 4 = 2 THEN concat('k', CAST(turn - 1 AS STRING)) WHEN turn % 4 = 3 AND conv_id % 2 = 0 THEN concat('k', CAST(turn - 2 AS STRING)) END",
    "text2": f"CASE WHEN role = 'system' OR (conv_id % 5 = 0 AND turn IN (0, 3)) THEN concat('{C.SUMMARY_MARK}', chr(10), CASE WHEN conv_id % 10 = 0 THEN ' ' ELSE text END) ELSE text END",
}
_TALK_SQL = "m AS (SELECT conv_id, turn, " + ", ".join(f"{e} AS {n}" for n, e in _TALK.items()) + " FROM conversations), tk AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM m WHERE role2 <> 'system')"
_KEEP = 3
_CUT = "CASE WHEN length({0}) <= {1} THEN {0} ELSE left({0}, {1} - 24) || '...' END"
_ONE = "trim(regexp_replace(coalesce(text2, ''), '\\s+', ' ', 'g'))".replace("\\\\", "\\")


def talks(spark, sf_dir):
    own = _m(spark, sf_dir).select("conv_id", "turn", *[F.expr(e).alias(n) for n, e in _TALK.items()])
    return own.withColumnsRenamed({"role2": "role", "text2": "text"})


@query("cv05_compacted", f"""WITH RECURSIVE {_TALK_SQL}, sp AS (SELECT a.conv_id, a.p AS first, max(b.p) AS last FROM tk a JOIN tk b ON a.conv_id = b.conv_id AND a.call_id = b.call_id AND a.role2 <> 'tool' AND b.role2 = 'tool' AND b.p > a.p GROUP BY ALL),
u(conv_id, u, k) AS (SELECT DISTINCT conv_id, least(greatest(1, n - CASE WHEN n > {_KEEP} THEN {_KEEP} ELSE greatest(1, n // 2) END), n - 1), 0 FROM tk WHERE n >= 2 UNION ALL SELECT conv_id, greatest(u, coalesce((SELECT max(last) FROM sp WHERE sp.conv_id = u.conv_id AND first <= u AND u < last), u)), k + 1 FROM u WHERE k < 9),
b AS (SELECT conv_id, max(u) AS u FROM u GROUP BY conv_id), pv AS (SELECT conv_id, string_agg(l, chr(10) || chr(10) ORDER BY turn) AS previous FROM (SELECT conv_id, turn, trim(replace(coalesce(text2, ''), '{C.SUMMARY_MARK}', ''), ' ' || chr(10) || chr(9) || chr(13)) AS l FROM m WHERE role2 = 'system' AND starts_with(text2, '{C.SUMMARY_MARK}')) WHERE l <> '' GROUP BY conv_id),
tl AS (SELECT conv_id, string_agg('- ' || role2 || ': ' || {_CUT.format(_ONE, 500)} || chr(10), '' ORDER BY p) AS told FROM tk JOIN b USING (conv_id) WHERE p <= u AND p > u - 12 GROUP BY conv_id),
h AS (SELECT conv_id, -1 AS o, 'system' AS role, '{C.SUMMARY_MARK}' || chr(10) || {_CUT.format("f", C.MOST_SUMMARY)} AS text FROM (SELECT conv_id, '{C.SUMMARY_HEAD}' || CASE WHEN previous IS NULL THEN '' ELSE '{C.SUMMARY_FACTS}' || {_CUT.format(_CUT.format("previous", C.MOST_SUMMARY), C.MOST_PREVIOUS)} || chr(10) END || '{C.SUMMARY_ACTIONS}' || told || '{C.SUMMARY_TAIL}' AS f FROM tl LEFT JOIN pv USING (conv_id))),
al AS (SELECT * FROM h UNION ALL SELECT conv_id, p, role2, coalesce(text2, '') FROM tk JOIN b USING (conv_id) WHERE p > u UNION ALL SELECT conv_id, turn, role2, coalesce(text2, '') FROM m WHERE conv_id NOT IN (SELECT conv_id FROM b))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1 AS INT) AS message_index, role, md5(text) AS text_md5 FROM al""")
def cv05_compacted(spark, sf_dir):
    """Conversations compacted to their last three messages, calls with their replies, and a summary of the rest."""
    return C.compacted(talks(spark, sf_dir), keep=_KEEP).select("conv_id", "message_index", "role", F.md5("text").alias("text_md5"))


_TOOLS = {"tool": "CASE turn % 3 WHEN 0 THEN 'read_memory' WHEN 1 THEN 'grep' ELSE ' ' END", "shown": f"CASE WHEN conv_id % 7 = 0 THEN concat('{C.LIGHT_MARK}', text) ELSE text END", "recorded": "CASE WHEN turn = 1 THEN NULL ELSE turn * 1000 END"}
_PLACE = len(C.LIGHT_MARK + C.LIGHT_TEXT.format(tool="", n=""))


@query("cv08_light_outputs", f"WITH o AS (SELECT conv_id, turn, {', '.join(f'{e} AS {n}' for n, e in _TOOLS.items())} FROM conversations WHERE role = 'assistant') SELECT conv_id, count(*) AS outputs, CAST(sum(length(shown)) AS BIGINT) AS chars FROM o WHERE turn % 3 <> 0 AND conv_id % 7 <> 0 AND coalesce(recorded, 0) <= 4000 AND {_PLACE} + CASE WHEN trim(tool) = '' THEN 7 ELSE length(tool) END + length(CAST(length(shown) AS VARCHAR)) < length(shown) GROUP BY conv_id")
def cv08_light(spark, sf_dir):
    """Tool outputs that a light compaction hides; those of one tool, hidden and short ones stay."""
    own = _m(spark, sf_dir).select("conv_id", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), *[F.expr(e).alias(n) for n, e in _TOOLS.items()])
    return C.light_outputs(own.withColumnRenamed("shown", "text"), 4000)


#: Events of groups of background tasks: a user's are a group, forty numbers its tasks.
_GROUP = {"group_id": "CAST(user_id AS STRING)", "task": "CASE WHEN event_id % 50 = 0 THEN ' ' ELSE CAST(event_id % 40 AS STRING) END", "kind": "CASE WHEN event_type IN ('view', 'signup') THEN 'register' WHEN event_type = 'click' THEN 'complete' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'fail' WHEN event_type = 'purchase' AND event_id % 97 = 0 THEN 'resume' ELSE 'complete' END"}


def group_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", *[F.expr(e).alias(n) for n, e in _GROUP.items()])


@query("cv14_group_states", f"WITH e AS (SELECT event_id, ts, {', '.join(f'{x} AS {n}' for n, x in _GROUP.items())} FROM events), o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS o FROM e), b AS (SELECT group_id, min(o) AS b FROM o WHERE kind = 'register' AND trim(task) <> '' GROUP BY group_id), s AS (SELECT group_id, CAST(count(DISTINCT task) FILTER (WHERE kind = 'register' AND trim(task) <> '') AS INT) AS members, CAST(count(DISTINCT task) FILTER (WHERE kind IN ('complete', 'fail') AND trim(task) <> '') AS INT) AS completed, CAST(count(DISTINCT task) FILTER (WHERE kind = 'fail' AND trim(task) <> '') AS INT) AS failed, bool_or(kind = 'resume') AS resumed FROM o JOIN b USING (group_id) WHERE o >= b GROUP BY group_id) SELECT *, CASE WHEN resumed THEN 'resumed' WHEN completed < members THEN 'running' WHEN failed = 0 THEN 'completed' ELSE 'failed' END AS status, completed >= members AND NOT resumed AS ready FROM s")
def cv14_states(spark, sf_dir):
    """The state of each group after all events; streaming.barrier gives the same as they come."""
    return C.group_states(group_events(spark, sf_dir), ["ts", "event_id"])


#: Event lines of each user, cut into two chunks an event, in the middle of lines.
_SSE = "concat(CASE event_type WHEN 'view' THEN '' WHEN 'signup' THEN concat('event: other', chr(10), 'event:signup ', chr(13), chr(10)) ELSE concat('event: ', event_type, chr(10)) END, CASE WHEN event_type = 'click' THEN concat('data:  ', chr(10)) ELSE '' END, ': note', chr(10), 'data: ', CASE WHEN event_type = 'error' THEN '{bad' WHEN event_id % 5 = 0 THEN concat('[', CAST(event_id AS STRING), ', null]') ELSE concat('{\"id\": ', CAST(event_id AS STRING), '}') END, CASE WHEN event_type = 'purchase' THEN chr(13) ELSE '' END, chr(10), CASE WHEN event_id % 3 = 0 THEN chr(10) ELSE '' END)"


@query("cv17_event_lines", f"WITH t AS (SELECT user_id, string_split(string_agg({_SSE}, '' ORDER BY event_id), chr(10)) AS ls FROM events GROUP BY user_id), l AS (SELECT user_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM t), d AS (SELECT user_id, k, CASE WHEN starts_with(l, 'data:') THEN trim(substr(l, 6), ' ' || chr(9) || chr(13)) END AS data, CASE WHEN starts_with(l, 'event:') THEN trim(substr(l, 7), ' ' || chr(9) || chr(13)) WHEN starts_with(l, 'data:') AND trim(substr(l, 6), ' ' || chr(9) || chr(13)) <> '' THEN '' END AS named FROM l), c AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM d) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY k) AS INT) AS n, coalesce(nullif(e, ''), 'message') AS event, data FROM c WHERE data <> '' AND json_valid(data)")
def cv17(spark, sf_dir):
    whole = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_SSE).alias("t"))
    cut = F.floor(F.length("t") / 3).cast("int")
    parts = F.array(F.substring("t", F.lit(1), cut), F.substring("t", cut + 1, F.length("t")))
    chunks = whole.select("user_id", "event_id", F.posexplode(parts).alias("i", "text")).select("user_id", (F.col("event_id") * 2 + F.col("i")).alias("at"), "text")
    return C.stream_events(chunks, "user_id")


@query("sc15_replace_all", "WITH a AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT conv_id, turn, 'kept', concat('new ', text) FROM conversations WHERE conv_id % 3 = 0 AND conv_id % 9 <> 0 AND turn % 2 = 0) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS message_index, role, md5(text) AS text_md5 FROM a")
def sc15_replaced(spark, sf_dir):
    """A table of messages in which a third of the conversations are replaced by fewer messages, or by none, twice."""
    m, path = _m(spark, sf_dir).select("conv_id", "turn", "role", "text"), relational.shared_folder(spark, "messages")
    relational.replaced(path, m, m.select("conv_id"), "conv_id", "turn")
    new = m.where("conv_id % 3 = 0 and conv_id % 9 <> 0 and turn % 2 = 0").select("conv_id", "turn", F.lit("kept").alias("role"), F.concat(F.lit("new "), "text").alias("text"))
    for _ in range(2):
        relational.replaced(path, new, m.where("conv_id % 3 = 0").select("conv_id"), "conv_id", "turn")
    return relational.read_replaced(spark, path, "conv_id").select("conv_id", "message_index", "role", F.md5("text").alias("text_md5"))
