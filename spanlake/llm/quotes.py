"""Quotation linking, with DataFrame functions only.

Lines that begin with ``>`` marks are quoted, as deep as they have marks. Quoted lines are normalised (lower case,
white space folded) and hashed; so are the lines that messages write themselves. A quoted line is linked to the
message that wrote it first: at an earlier turn of its own conversation, else in any other. A line that nobody wrote
is linked by its passage (lines of one level up to a blank one), whose line breaks do not count. The message with most linked lines of the
lowest level is the parent (ties: the latest). Conversations tied by a quotation make one thread, and a thread's
messages are ordered by reply depth (an answer follows what it quotes), then by conversation and turn.

Defined results: a null text has no lines; blank lines are never linked; a message never links to itself or to a
later one of its conversation; messages without a found quotation have no parent and depth 0; null conv_id or
turn: the message is kept, alone; repeated rows are kept, and stand at one place in the order; a text of any length is
read whole; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, text_or_empty

_MARKS = r"^(?:[ \t]{0,3}>)+"
MAX_DEPTH_ROUNDS = 64
SALTS = 64


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, _MARKS, 0)
    return F.char_length(marks) - F.char_length(F.replace(marks, F.lit(">"), F.lit("")))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARKS, "")), r"\s+", " "))


def message_passages(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, lines, p1, p2)``: passages are runs of lines of one level that are not blank, hashed as
    one line, so that their line breaks do not matter; ``lines`` has their normalised lines."""
    each = F.transform(F.split(text_or_empty(), "\r?\n"), lambda x: F.struct(_level(x).alias("level"), F.replace(_normal(x), F.lit("\0"), F.lit(" ")).alias("content")))
    m = messages.select("conv_id", "turn", each.alias("ls"))
    m = m.select("conv_id", "turn", "ls", F.explode(F.array_distinct(F.col("ls.level"))).alias("level"))
    run = F.array_join(F.transform("ls", lambda x: F.when((x["level"] == F.col("level")) & (x["content"] != ""), x["content"]).otherwise(F.lit("\0"))), "\n")
    m = m.select("conv_id", "turn", "level", F.explode(F.split(run, "\0")).alias("run"))
    m = m.select("conv_id", "turn", "level", F.filter(F.split("run", "\n"), lambda x: x != "").alias("lines")).where(F.size("lines") > 0)
    whole = F.array_join("lines", " ")
    return m.select("*", F.xxhash64(whole).alias("p1"), F.xxhash64(F.lit("wide"), whole).alias("p2"))


def _with_author(quoted: DataFrame, own: DataFrame, keys: list[str], to: str) -> DataFrame:
    """``quoted`` with the first author ``to(conv_id, turn)`` of the keys: an earlier turn at home, else the least
    message of another conversation. No task holds all conversations of a key."""
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS))
    here = own.groupBy("conv_id", *keys).agg(F.min("turn").alias("here_turn"))
    who = F.struct("conv_id", F.col("here_turn").alias("turn"))
    least = here.groupBy(*keys, salt.alias("salt")).agg(F.min(who).alias("w"))
    first = least.groupBy(*keys).agg(F.min("w").alias("first"))
    found = quoted.join(here, ["conv_id", *keys], "left").join(first, keys, "left")
    at_home = F.coalesce(F.col("here_turn") < F.col("turn"), F.lit(False))
    ask = found.where(~at_home & (F.col("first.conv_id") == F.col("conv_id"))).select(*keys, F.col("conv_id").alias("asks"), salt.alias("near")).distinct()
    far = least.join(ask, keys).where("salt <> near").select("asks", *keys, "w")
    near = here.withColumn("near", salt).join(ask, [*keys, "near"]).where("conv_id <> asks").select("asks", *keys, who.alias("w"))
    other = far.unionByName(near).groupBy(F.col("asks").alias("conv_id"), *keys).agg(F.min("w").alias("other"))
    found = found.join(other, ["conv_id", *keys], "left")
    at = F.when(at_home, who).when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("other"))
    return found.select(*quoted.columns, at.alias(to))


def quotation_links(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, parent_conv, parent_turn, lines)``: linked lines by message, level and author.

    A line that no message wrote goes with its passage, where a message wrote that with other line breaks.
    """
    passages = message_passages(messages.where("conv_id is not null and turn is not null"))
    lines = passages.select("conv_id", "turn", "level", "p1", "p2", F.explode("lines").alias("content"))
    lines = lines.select("*", F.xxhash64("content").alias("h1"), F.xxhash64(F.lit("wide"), "content").alias("h2"))
    quoted = lines.where("level > 0").groupBy("conv_id", "turn", "level", "h1", "h2", "p1", "p2").agg(F.count("*").alias("n"))
    found = _with_author(quoted, lines.where("level = 0"), ["h1", "h2"], "to_line")
    found = _with_author(found, passages.where("level = 0"), ["p1", "p2"], "to_passage")
    found = found.withColumn("to", F.coalesce("to_line", "to_passage")).where("to is not null")
    return found.groupBy("conv_id", "turn", "level", F.col("to.conv_id").alias("parent_conv"), F.col("to.turn").alias("parent_turn")).agg(F.sum("n").alias("lines"))


def reply_parents(links: DataFrame) -> DataFrame:
    """``(conv_id, turn, parent_conv, parent_turn)``: one parent a message."""
    best = F.max(F.struct((-F.col("level")).alias("near"), "lines", "parent_conv", "parent_turn"))
    p = links.groupBy("conv_id", "turn").agg(best.alias("b"))
    return p.select("conv_id", "turn", F.col("b.parent_conv").alias("parent_conv"), F.col("b.parent_turn").alias("parent_turn"))


def reply_depths(parents: DataFrame) -> DataFrame:
    """``(conv_id, turn, depth)`` of messages with a parent, by doubling the reach of every link.

    Links across conversations can, in odd inputs, run in a circle; messages on or behind one get depth null.
    """
    cur = materialize(
        parents.select("conv_id", "turn", F.col("parent_conv").alias("to_conv"), F.col("parent_turn").alias("to_turn"), F.lit(1).cast("long").alias("depth")), "depth"
    )
    open_rows = cur.count()
    rounds = open_rows.bit_length() + 1
    for _ in range(rounds):
        up = cur.select(
            F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"), F.col("to_conv").alias("c2"), F.col("to_turn").alias("t2"), F.col("depth").alias("d2")
        )
        nxt = cur.join(up, ["to_conv", "to_turn"], "left")
        nxt = materialize(
            nxt.select(
                "conv_id",
                "turn",
                F.when(F.col("d2").isNull(), F.col("to_conv")).otherwise(F.col("c2")).alias("to_conv"),
                F.when(F.col("d2").isNull(), F.col("to_turn")).otherwise(F.col("t2")).alias("to_turn"),
                (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
            ),
            "depth",
        )
        moved = nxt.join(cur.select("conv_id", "turn", F.col("depth").alias("old")), ["conv_id", "turn"]).where("depth <> old").limit(1).count()
        cur = nxt
        if not moved:
            return cur.select("conv_id", "turn", "depth")
    on_circle = cur.join(parents.select(F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn")), ["to_conv", "to_turn"], "left_semi")
    bad = on_circle.select("conv_id", "turn", F.lit(True).alias("bad"))
    return cur.join(bad, ["conv_id", "turn"], "left").select("conv_id", "turn", F.when(F.col("bad").isNull(), F.col("depth")).alias("depth"))


def link_conversations(messages: DataFrame) -> DataFrame:
    """Every message with its place in a thread and its text without quotes.

    ``(conv_id, turn, role, thread, depth, parent_conv, parent_turn, n_quoted, max_level, n_chars, text)``; within
    a thread, ``depth, conv_id, turn`` is the reply order.
    """
    links = materialize(quotation_links(messages), "quotes")
    parents = materialize(reply_parents(links), "parents")
    depths = reply_depths(parents)
    across = parents.where("parent_conv <> conv_id").select(F.col("conv_id").alias("a"), F.col("parent_conv").alias("b")).distinct()
    threads = connected_components(across, "threads")
    m = messages.select("conv_id", "turn", "role", F.split(text_or_empty(), "\r?\n").alias("ls"))
    m = m.withColumn("own", F.filter("ls", lambda x: ~x.rlike(_MARKS))).withColumn("quoted", F.filter("ls", lambda x: x.rlike(_MARKS)))
    m = m.select(
        "conv_id",
        "turn",
        "role",
        F.size("quoted").cast("long").alias("n_quoted"),
        F.coalesce(F.array_max(F.transform("quoted", _level)), F.lit(0)).cast("int").alias("max_level"),
        F.regexp_replace(F.array_join("own", "\n"), r"^\n+|\n+$", "").alias("text"),
    )
    found = parents.join(depths, ["conv_id", "turn"], "left")
    m = m.join(found, ["conv_id", "turn"], "left").join(threads.select(F.col("node").alias("conv_id"), "component"), "conv_id", "left")
    return m.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("component", "conv_id").alias("thread"),
        F.when(F.col("parent_conv").isNull(), F.lit(0).cast("long")).otherwise(F.col("depth")).alias("depth"),
        "parent_conv",
        "parent_turn",
        "n_quoted",
        "max_level",
        F.char_length("text").cast("long").alias("n_chars"),
        "text",
    )
