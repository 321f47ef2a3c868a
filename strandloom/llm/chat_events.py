"""Chat formatting from event logs: fold each conversation's events, then render.

Events have conv_id, seq, kind, message, role, text. Sorted by seq, they are folded message by
message: `start` opens a message, `delta` appends to it, `edit` replaces its text, `regenerate`
discards its text (later deltas build the new one). Messages come in the order of their first
event. DataFrame functions only; each message is folded first, so a long conversation is
spread over many groups, and only the final texts of a conversation meet in one row. Places in
the output are running sums taken block by block, so long conversations take time in proportion.

The template puts each turn between <turn> and </turn> with its role on the first line. In
texts and roles a backslash becomes two and < becomes \\l, in roles a line's end becomes \\n, so no
text holds a control string, and reading back is exact. The loss mask is the spans of assistant texts, in code points.

Defined cases: null text is empty; a null role is the empty role; events that share a seq are
ordered by kind, role and text; repeated rows are repeated events; a message without a `start`
begins at its first event; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE, LEARNED = "<turn>", "</turn>\n", "assistant"


def escaped(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def escaped_role(x: Column) -> Column:
    return F.replace(escaped(x), F.lit("\n"), F.lit("\\n"))


def unescaped(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))), "\\")


def fold(events: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and messages, an array of (first, message, role, text)."""
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    logs = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
    after = lambda x: F.lit(x).cast("int")
    # only what follows the last edit or regeneration counts, with that edit's text
    resets = F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i).otherwise(after(-1)))
    last = F.coalesce(F.array_max(resets), after(-1))
    kept = F.filter("log", lambda e, i: (i >= last) & (e["kind"] != "regenerate"))
    text = F.array_join(F.transform(kept, lambda e: e["text"]), "")
    message = F.struct(F.get("log", F.lit(0))["seq"].alias("first"), "message", F.get("log", F.lit(0))["role"].alias("role"), text.alias("text"))
    return logs.select("conv_id", message.alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))


def render(folded: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: spans (start, stop) of what the mask has."""
    parts = F.transform("messages", lambda m: F.struct(
        F.concat(F.lit(OPEN), escaped_role(m["role"]), F.lit("\n")).alias("head"), escaped(m["text"]).alias("body"), (m["role"] == LEARNED).alias("learned")))
    rows = folded.select("conv_id", parts.alias("parts"))
    size = lambda p: F.length(p["head"]).cast("long") + F.length(p["body"]) + len(CLOSE)
    spans = F.zip_with("parts", common.sums_before(F.transform("parts", size)), lambda p, at: F.struct(
        (at + F.length(p["head"])).alias("start"), (at + F.length(p["head"]) + F.length(p["body"])).alias("stop"), p["learned"].alias("learned")))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    loss = F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    return rows.select("conv_id", whole.alias("formatted"), loss.alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and the learned text, from the output alone."""
    bodies = F.filter(F.split("formatted", CLOSE, -1), lambda t: F.length(t) > 0)
    cut = lambda t: F.substring(t, len(OPEN) + 1, 1 << 30)
    turns = F.transform(bodies, lambda t: F.struct(
        unescaped(F.substring_index(cut(t), "\n", 1)).alias("role"),
        unescaped(F.substring(cut(t), F.instr(cut(t), "\n") + 1, F.lit(1 << 30))).alias("text")))
    learned = F.transform(common.cut_out(F.col("formatted"), F.col("loss")), unescaped)
    return rendered.select("conv_id", turns.alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))


#: Two messages' events are this far apart in a log; an edit in the second half of a message's
#: numbers comes among the next message's events.
APART, LATE = 16, 25


def log_of(rows: DataFrame) -> DataFrame:
    """An event log that folds to the turns of rows (conv_id, turn, role, text).

    A turn arrives as a start and streamed deltas. By the hash of its place, it is plain; or a
    wrong draft that is regenerated; or a text that is edited after the next message has begun;
    or a wrong draft that is edited at once and streamed on. Rows of a conversation are in order
    of turn, role and text. A draft never reaches the final text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    n = F.length("text")
    cut = F.ceil(n / 3).cast("int")
    parts = [F.substring("text", F.lit(1), cut), F.substring("text", cut + 1, cut), F.substring("text", 2 * cut + 1, n)]
    at = lambda k, kind, x: F.struct((F.col("message") * APART + k).alias("seq"), F.lit(kind).alias("kind"), x.alias("text"))
    whole = [at(i, "start" if i == 0 else "delta", x) for i, x in enumerate(parts)]
    draft, none = F.concat(F.lit("draft: "), F.reverse("text")), F.lit(None).cast("string")
    logs = [
        whole,
        [at(0, "start", F.lit("")), at(1, "delta", draft), at(2, "regenerate", none), *(at(3 + i, "delta", x) for i, x in enumerate(parts))],
        [at(0, "start", parts[0]), at(1, "delta", draft), at(LATE, "edit", F.col("text"))],
        [at(0, "start", draft), at(1, "edit", parts[0]), at(2, "delta", parts[1]), at(3, "delta", parts[2])],
    ]
    kind = F.pmod(F.xxhash64("conv_id", "message"), F.lit(len(logs)))
    chosen = F.coalesce(*(F.when(kind == i, F.array(*x)) for i, x in enumerate(logs)))
    return rows.withColumn("message", place).withColumn("e", F.explode(chosen)).select("conv_id", "e.seq", "e.kind", "message", "role", "e.text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = read_back(render(fold(log_of(rows.unionByName(more)))))
    learned = F.array_join("learned", "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )
