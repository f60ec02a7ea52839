"""Reply trees to conversations: paths by self-joins, branches ranked by score, paths formatted reversibly.

Paths are found by doubling: with the ancestors 1, 2, 4, ... replies up, each self-join doubles the part of
each path that is known, so a path of n messages takes log2(n) joins. Rows hold ids only, one per leaf and message of
its path. Texts join the chosen paths at the end.

The template, with ``<s>`` before the first turn:

    user        [INST] text [/INST]
    assistant    text</s>                    (a blank before the text; the text is under the loss mask)
    any other   [ROLE role] text [/ROLE]

A backslash is put behind each backslash of a text, and behind the first character of each string that the
template uses, so no mark is left inside a text, and taking the backslashes out gives it back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitflow.llm.common import bounded_batches, drop_folder
from visitflow.session import materialize, new_table_path

#: What of a text gets a backslash behind it: a backslash, or the first character of a mark.
_MARKS = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\]|ROLE |/ROLE\])")
_ROLE = re.compile(r"\[ROLE ((?:\\.|[^\\\]])*)\] ", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _MARKS.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as a string, and where its text begins and ends in it."""
    body = escape(text)
    if role == "user":
        before, after = "[INST] ", " [/INST]"
    elif role == "assistant":
        before, after = " ", "</s>"
    else:
        before, after = "[ROLE " + escape(role).replace("]", "\\]") + "] ", " [/ROLE]"
    return before + body + after, len(before), len(before) + len(body)


def format_conversation(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole string and the spans (code points) of the assistant's texts."""
    parts, spans, at = ["<s>"], [], 3
    for role, text in turns:
        turn, start, end = format_turn(role, text)
        if role == "assistant":
            spans.append((at + start, at + end))
        parts.append(turn)
        at += len(turn)
    return "".join(parts), spans


def parse_conversation(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string; a string that the template cannot give is an error."""
    if not formatted.startswith("<s>"):
        raise ValueError("a conversation begins with <s>")
    turns, at = [], 3
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            role, start, after = "user", at + 7, " [/INST]"
        elif formatted[at] == " ":
            role, start, after = "assistant", at + 1, "</s>"
        elif found := _ROLE.match(formatted, at):
            role, start, after = unescape(found[1]), found.end(), " [/ROLE]"
        else:
            raise ValueError(f"no turn begins at {at}")
        end = formatted.find(after, start)
        if end < 0:
            raise ValueError(f"the turn at {at} does not end")
        turns.append((role, unescape(formatted[start:end])))
        at = end + len(after)
    return turns


def linear_replies(rows: DataFrame, tree_column: str = "conv_id", turn_column: str = "turn") -> DataFrame:
    """Conversations in rows as reply trees: each row answers the one before it.

    Returns ``tree_id, message_id, parent_id, role, text, score``; null roles and texts are empty. Rows go by
    turn (null first), equal turns by role and text. A null conversation id is an id of its own.
    """
    place = F.row_number().over(
        Window.partitionBy(tree_column).orderBy(F.col(turn_column).asc_nulls_first(), F.col("role"), F.col("text"))
    )
    return rows.select(
        F.col(tree_column).cast("long").alias("tree_id"),
        place.cast("long").alias("message_id"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.lit(0.0).alias("score"),
    ).withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1))


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _paths(nodes: DataFrame) -> DataFrame:
    """``tree, leaf, node, up`` for each message on the path from a leaf up to its root.

    ``nodes`` has ``tree, node, parent``. A parent that is not there counts as none. Messages in a circle
    have no root and are on no path; the doubling ends when every tree's size is passed.
    """
    spark = nodes.sparkSession
    known = nodes.select("tree", F.col("node").alias("parent")).distinct()
    linked = nodes.where("parent is not null").join(known, ["tree", "parent"], "left_semi").select("tree", "node", "parent")
    leaves = nodes.select("tree", "node").join(linked.select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps, jumps_path = _stored(linked.select("tree", "node", F.col("parent").alias("up_node")).distinct(), "jumps")
    paths, path = _stored(
        leaves.distinct().select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths"
    )
    reach = 1
    while reach < largest and jumps.limit(1).count():
        further = paths.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("up_node").alias("node"), (F.col("up") + reach).alias("up"))
        more, more_path = _stored(paths.unionByName(further), "paths")
        onward = jumps.select("tree", F.col("node").alias("low"), F.col("up_node").alias("node"))
        twice, twice_path = _stored(onward.join(jumps, ["tree", "node"]).select("tree", F.col("low").alias("node"), "up_node"), "jumps")
        for old in (path, jumps_path):
            drop_folder(spark, old)
        paths, path, jumps, jumps_path, reach = more, more_path, twice, twice_path, reach * 2
    # A leaf that hangs on a circle never meets a message without a parent.
    rooted = paths.join(linked.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "leaf").distinct()
    return paths.join(rooted, ["tree", "leaf"], "left_semi")


def conversations_from_trees(messages: DataFrame, paths_per_tree: int | None = 1) -> DataFrame:
    """The best root-to-leaf paths of each tree, each formatted as one conversation.

    ``messages`` has ``tree_id, message_id, parent_id, role, text, score``. A branch is as good as the mean
    score of its messages (null: 0); of equal ones the smaller leaf id goes first. ``paths_per_tree`` of each tree
    are formatted (None: all). Returns ``tree_id, leaf_id, rank, score, n_turns, formatted, loss`` with loss the spans of the
    assistant's texts. A repeated message id names one message, the first by role and text; rows without one are
    left out. Memory: one formatted conversation at a time.
    """
    bounded_batches(messages.sparkSession)
    best = Window.partitionBy("tree", "node").orderBy("role", "text")
    known = (
        messages.where("message_id is not null")
        .select(
            F.coalesce(F.col("tree_id").cast("string"), F.lit("")).alias("tree"),
            F.col("message_id").cast("long").alias("node"),
            F.col("parent_id").cast("long").alias("parent"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        )
        .withColumn("copy", F.row_number().over(best))
        .where("copy = 1")
        .drop("copy")
    )
    known = materialize(known, "messages")
    paths = _paths(known.select("tree", "node", "parent"))
    scored = paths.join(known.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    chosen = scored.withColumn("rank", rank)
    if paths_per_tree is not None:
        chosen = chosen.where(F.col("rank") <= paths_per_tree)
    turns = (
        paths.join(chosen, ["tree", "leaf"])
        .join(known.select("tree", "node", "role", "text"), ["tree", "node"])
        .select("tree", "leaf", "rank", "score", "up", "role", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        held: list[tuple[str, str]] = []
        out: list[tuple] = []

        def close() -> None:
            if group is not None:
                tree, leaf, rank, score = group
                formatted, spans = format_conversation(held)
                loss = [{"start": a, "end": b} for a, b in spans]
                out.append((int(tree) if tree else None, leaf, rank, score, len(held), formatted, loss))

        def batch_of_rows() -> pa.RecordBatch:
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string(), spans]
            names = ["tree_id", "leaf_id", "rank", "score", "n_turns", "formatted", "loss"]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for *key, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tuple(key) != group:
                    close()
                    group, held = tuple(key), []
                held.append((role, text))
            if out:
                yield batch_of_rows()
        close()
        if out:
            yield batch_of_rows()

    return (
        turns.repartition("tree", "leaf")
        .sortWithinPartitions("tree", "leaf", F.desc("up"))
        .select("tree", "leaf", F.col("rank").cast("long").alias("rank"), "score", "role", "text")
        .mapInArrow(
            write,
            "tree_id long, leaf_id long, rank long, score double, n_turns long, formatted string, "
            "loss array<struct<start: long, end: long>>",
        )
    )


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Back from formatted strings: ``tree_id, turns, loss_text``, read from ``formatted`` and ``loss`` alone.

    ``turns`` are (role, text); ``loss_text`` is all text under the mask, unescaped, with nothing between.
    """
    bounded_batches(formatted.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            strings, masks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse_conversation(s)] for s in strings]
            lost = ["".join(unescape(s[m["start"] : m["end"]]) for m in mask) for s, mask in zip(strings, masks, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(turns, turn), pa.array(lost, pa.string()), pa.array([len(s) for s in strings], pa.int64())],
                ["tree_id", "turns", "loss_text", "formatted_chars"],
            )

    return formatted.select("tree_id", "formatted", "loss").mapInArrow(
        read, "tree_id long, turns array<struct<role: string, text: string>>, loss_text string, formatted_chars long"
    )
