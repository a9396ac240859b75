"""Conversation operators: windows, rewind, compaction, usage, run lengths, barriers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP_RECENT, MOST_MESSAGES, MOST_CHARS = 16, 256, 128_000
# Marks, texts and bounds of summaries, and tools whose outputs are never hidden.
SUMMARY_MARK, MOST_SUMMARY, MOST_PREVIOUS = "[AUTO_COMPACTED_CONVERSATION_SUMMARY]", 8_000, 2_000
SUMMARY_HEAD = "Goal:\n- Earlier context was compacted with a local fallback summary.\nConfirmed constraints:\n- Preserve the recent raw messages that follow this summary.\n"
SUMMARY_FACTS, SUMMARY_ACTIONS, SUMMARY_TAIL = "Key facts:\n", "Actions already taken:\n", "Open TODOs:\n- Review the preserved recent messages for the active task state."
LIGHT_MARK, LIGHT_TOOLS = "[LIGHT_COMPACTED_TOOL_OUTPUT]", ["read_memory"]
LIGHT_TEXT = " Tool output is hidden from model context by light compaction. Tool: {tool}. Original output length: {n} chars. Ask the user to re-run or inspect the visible UI history if exact output is needed."


def _back(conv: str, turn: str):
    return F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))


def window(messages: DataFrame, n: int = 200, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n messages of each conversation."""
    return messages.withColumn("_b", _back(conv, turn)).where(F.col("_b") <= n).drop("_b")


def recent_context(messages: DataFrame, n: int = 8, chars: int = 500, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, context): the last n messages as 'role: text' lines, texts cut to `chars`."""
    line = F.concat("role", F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, chars))
    last = window(messages, n, conv, turn).select(conv, F.struct(F.col(turn).alias("turn"), line.alias("line")).alias("s"))
    return last.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("context"))


def rewind(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """What precedes the latest user turn; conversations without one stay whole."""
    last = F.max(F.when(F.col("role") == "user", F.col(turn))).over(Window.partitionBy(conv))
    return messages.withColumn("_u", last).where(F.col("_u").isNull() | (F.col(turn) < F.col("_u"))).drop("_u")


def compaction_state(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Messages, characters, token estimate, percentages of the limits, and whether a conversation is to be compacted."""
    s = messages.groupBy(conv).agg(F.count("*").alias("messages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    tokens = F.floor(F.col("chars") / 4)
    percent = F.greatest(F.col("messages") * 100.0 / MOST_MESSAGES, F.col("chars") / 4.0 * 100.0 / MOST_CHARS)
    return s.select(conv, "messages", "chars", tokens.alias("tokens"), F.round(F.least(percent, F.lit(100.0)), 2).alias("percent"), ((F.col("messages") > MOST_MESSAGES) | (tokens > MOST_CHARS)).alias("compact"))


def split_for_compaction(messages: DataFrame, keep: int = KEEP_RECENT, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages with `compacted`: all but the most recent `keep` (half of a short conversation), and never the reply of
    an assistant without the user's message before it."""
    both = messages.withColumns({"_b": _back(conv, turn), "_n": F.count("*").over(Window.partitionBy(conv)), "_next": F.lead("role").over(Window.partitionBy(conv).orderBy(turn))})
    kept = F.least(F.lit(keep), F.floor(F.col("_n") / 2))
    edge = (F.col("_b") == kept + 1) & (F.col("role") == "user") & (F.col("_next") == "assistant")
    return both.withColumn("compacted", (F.col("_b") > kept) & ~F.coalesce(edge, F.lit(False))).drop("_b", "_n", "_next")


def fallback_summary(messages: DataFrame, n: int = 12, chars: int = 500, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    return recent_context(split_for_compaction(messages, conv=conv, turn=turn).where("compacted").drop("compacted"), n, chars, conv, turn)


def add_usage(a: Column, b: Column) -> Column:
    """Sum of two counts of which either may be unknown."""
    return F.coalesce(a + b, a, b)


def tail_run(events: DataFrame, kind: str, by: str, order: list[str], what: str = "event_type") -> DataFrame:
    """(by, run): how many events at the end of each sequence are of one kind, without a break."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    other = F.sum((F.col(what) != kind).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("_o", other).groupBy(by).agg(F.count_if(F.col("_o") == 0).alias("run"))


def approval(tool: Column, read_only: list[str], workspace: list[str], task: list[str]) -> Column:
    """Read-only tools run freely, workspace tools need a workspace, tasks their own rule, the rest approval."""
    return F.when(tool.isin(read_only), "read_only").when(tool.isin(workspace), "workspace").when(tool.isin(task), "task").otherwise("approval")


def round_limit(rounds: Column, start: int = 64, most: int = 256) -> Column:
    """The limit that covers so many rounds if it grows by half each time it is reached."""
    limit, steps = start, []
    while limit < most:
        steps.append(limit)
        limit = min(most, int(limit * 1.5))
    out = None
    for s in steps:
        out = F.when(rounds <= s, s) if out is None else out.when(rounds <= s, s)
    return out.otherwise(most)


def group_barrier(tasks: DataFrame, group: str, done: Column) -> DataFrame:
    """(group, members, ready): a group is ready once all of its members are done."""
    return tasks.groupBy(group).agg(F.count("*").alias("members"), F.bool_and(done).alias("ready"))


def whole_exchanges(messages: DataFrame, call: str = "call_id", conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, first, last): spans of messages that must stay whole, a call with all replies that carry its id; spans that
    overlap are one. Replies before their call, and calls without a reply, make no span."""
    own = messages.where(F.col(call).isNotNull())
    opened = own.where("role <> 'tool'").groupBy(conv, call).agg(F.min(turn).alias("first"))
    spans = own.where("role = 'tool'").join(opened, [conv, call]).where(F.col(turn) > F.col("first")).groupBy(conv, call).agg(F.min("first").alias("first"), F.max(turn).alias("last"))
    w = Window.partitionBy(conv).orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.coalesce(F.col("first") > F.col("_reach"), F.lit(True))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return spans.withColumn("_reach", reach).withColumn("_i", island).groupBy(conv, "_i").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_i")


def compacted(messages: DataFrame, force: bool = False, keep: int = KEEP_RECENT, call: str = "call_id", conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, message_index, role, text): each conversation with its older messages replaced by one summary.

    messages: conv, turn, role, text, call (an id that a call and its replies of role tool share, else null). Earlier
    summaries (system messages with SUMMARY_MARK) are merged into the new one and don't count as messages. The most
    recent `keep` messages stay, of a conversation that isn't longer the later half; if that would part a call from a
    reply, what is summarised reaches on to the last reply. Conversations of fewer than two messages (with force, which
    always keeps half, four) stay as they are.
    """
    from ..functions.text import clean_line, truncate_end

    text = F.coalesce("text", F.lit(""))
    summary = (F.col("role") == "system") & F.startswith(text, F.lit(SUMMARY_MARK))
    bare = lambda t: F.trim(F.replace(t, F.lit(SUMMARY_MARK), F.lit("")), F.lit(" \n\t\r"))
    m = messages.withColumns({"text": text, "_s": summary})
    talk = m.where("not _s").withColumns({"_p": F.row_number().over(Window.partitionBy(conv).orderBy(turn)), "_n": F.count("*").over(Window.partitionBy(conv))})
    half = F.floor(F.col("_n") / 2)
    recent = F.greatest(F.lit(2), half) if force else F.when(F.col("_n") > keep, keep).otherwise(F.greatest(F.lit(1), half))
    until = F.least(F.greatest(F.lit(1), F.col("_n") - recent), F.col("_n") - 1).cast("int")
    bounds = talk.groupBy(conv).agg(F.max("_n").alias("_n")).select(conv, "_n", until.alias("until")).where(F.col("_n") >= (4 if force else 2))
    spans = whole_exchanges(talk.withColumn(turn, F.col("_p")), call, conv, turn)
    reach = bounds.join(spans, conv).where((F.col("first") <= F.col("until")) & (F.col("until") < F.col("last"))).groupBy(conv).agg(F.max("last").alias("reach"))
    bounds = bounds.join(reach, conv, "left").select(conv, F.coalesce("reach", "until").cast("int").alias("until"))

    listed = lambda line, by: F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("t"), line.alias("line")))), lambda x: x["line"])
    old = m.where("_s").select(conv, turn, bare(F.col("text")).alias("line")).where("line <> ''").groupBy(conv).agg(truncate_end(F.array_join(listed(F.col("line"), turn), "\n\n"), MOST_SUMMARY).alias("previous"))
    line = F.concat(F.lit("- "), "role", F.lit(": "), truncate_end(clean_line(F.col("text")), 500), F.lit("\n"))
    gone = talk.join(bounds, conv).where(F.col("_p") <= F.col("until"))
    told = gone.where(F.col("_p") > F.col("until") - 12).groupBy(conv).agg(F.array_join(listed(line, "_p"), "").alias("told"))
    facts = F.when(F.col("previous").isNotNull(), F.concat(F.lit(SUMMARY_FACTS), truncate_end(F.col("previous"), MOST_PREVIOUS), F.lit("\n"))).otherwise("")
    full = truncate_end(F.concat(F.lit(SUMMARY_HEAD), facts, F.lit(SUMMARY_ACTIONS), "told", F.lit(SUMMARY_TAIL)), MOST_SUMMARY)
    head = told.join(old, conv, "left").select(conv, F.lit(-1).cast("long").alias("_o"), F.lit("system").alias("role"), F.concat(F.lit(SUMMARY_MARK + "\n"), full).alias("text"))
    kept = talk.join(bounds, conv).where(F.col("_p") > F.col("until")).select(conv, F.col("_p").cast("long").alias("_o"), "role", "text")
    short = m.join(bounds, conv, "left_anti").select(conv, F.col(turn).cast("long").alias("_o"), "role", "text")
    out = head.unionByName(kept).unionByName(short)
    return out.select(conv, (F.row_number().over(Window.partitionBy(conv).orderBy("_o")) - 1).alias("message_index"), "role", "text")


def light_outputs(messages: DataFrame, before: int, conv: str = "conv_id") -> DataFrame:
    """(conv, outputs, chars): tool outputs that a light compaction would hide, and their characters.

    messages: conv, role, tool, text, recorded (null or 0: unknown). Outputs of role tool recorded up to `before` count, but
    for those of LIGHT_TOOLS, those hidden already, and those not longer than what would stand for them. Without a time
    (before at most 0) there is nothing to hide."""
    text, tool = F.coalesce("text", F.lit("")), F.coalesce("tool", F.lit(""))
    a, _, rest = LIGHT_TEXT.partition("{tool}")
    b, _, c = rest.partition("{n}")
    name = F.when(F.trim(tool) == "", "unknown").otherwise(tool)
    place = F.concat(F.lit(LIGHT_MARK + a), name, F.lit(b), F.length(text).cast("string"), F.lit(c))
    old = (F.coalesce("recorded", F.lit(0)) <= 0) | (F.col("recorded") <= before)
    hides = (F.col("role") == "tool") & old & ~tool.isin(LIGHT_TOOLS) & ~F.startswith(text, F.lit(LIGHT_MARK)) & (F.length(place) < F.length(text)) & F.lit(before > 0)
    return messages.where(hides).groupBy(conv).agg(F.count("*").alias("outputs"), F.sum(F.length("text")).cast("long").alias("chars"))


def group_states(events: DataFrame, order: list[str], group: str = "group_id") -> DataFrame:
    """(group, members, completed, failed, resumed, status, ready) of each group of background tasks after all its events.

    events: group, task, kind (register, complete, fail, resume) and what orders them. A group begins with its first
    registration; what comes before is lost, repeated events change nothing. It is ready once as many tasks are completed
    (or failed) as are registered, until it is resumed.
    """
    begun = events.where((F.col("kind") == "register") & (F.trim("task") != "")).groupBy(group).agg(F.min(F.struct(*order)).alias("_b"))
    own = events.join(begun, group).where(F.struct(*order) >= F.col("_b"))
    some = lambda *kinds: F.count_distinct(F.when(F.col("kind").isin(*kinds) & (F.trim("task") != ""), F.col("task"))).cast("int")
    s = own.groupBy(group).agg(some("register").alias("members"), some("complete", "fail").alias("completed"), some("fail").alias("failed"), F.bool_or(F.col("kind") == "resume").alias("resumed"))
    done = (F.col("completed") >= F.col("members")) & (F.col("members") > 0)
    status = F.when(F.col("resumed"), "resumed").when(done, F.when(F.col("failed") == 0, "completed").otherwise("failed")).otherwise("running")
    return s.withColumns({"status": status, "ready": done & ~F.col("resumed")})


def stream_events(chunks: DataFrame, stream: str = "stream", at: str = "at", text: str = "text") -> DataFrame:
    """(stream, n, event, data): the events of each line stream in order, from 1.

    chunks: pieces of the streams as they came, cut anywhere, `at` in their order. Lines are put together over chunks. An
    `event:` line names the data lines after it, until one of them is used: that begins with `data:`, isn't blank, and
    counts if it is a JSON value; one that isn't is left out, but uses the name as well. Without a name an event is called
    message. The name is carried along the lines by a window, so that a stream is never one string.
    """
    body = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    w = Window.partitionBy(stream).orderBy(at)
    before = F.coalesce(F.sum(F.size(body) - 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = chunks.select(stream, at, before.alias("_l"), F.posexplode(body).alias("_j", "piece")).withColumn("line", F.col("_l") + F.col("_j"))
    whole = pieces.groupBy(stream, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("a"), "piece"))), lambda x: x["piece"]), "").alias("l"))
    ends = lambda t: F.trim(t, F.lit(" \t\r"))
    data = F.when(F.startswith("l", F.lit("data:")), ends(F.substring("l", 6, 1 << 30)))
    named = F.when(F.startswith("l", F.lit("event:")), ends(F.substring("l", 7, 1 << 30))).when(F.coalesce(data != "", F.lit(False)), "")
    lines = whole.select(stream, "line", data.alias("data"), named.alias("named"))
    carried = F.last("named", ignorenulls=True).over(Window.partitionBy(stream).orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    used = lines.withColumn("_e", F.coalesce(F.nullif(carried, F.lit("")), F.lit("message"))).where("data <> ''")
    fine = used.where(F.try_parse_json("data").isNotNull())
    return fine.select(stream, F.row_number().over(Window.partitionBy(stream).orderBy("line")).alias("n"), F.col("_e").alias("event"), "data")
