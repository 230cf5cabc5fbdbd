"""Operator 3: chat formatting of reply trees.

Self-joins by doubling (each round joins the ancestor links with themselves)
give every message its root, its depth and the score of its path in about
log2(depth) rounds. Branches are ranked by score; the messages of each chosen
path are marked by joins with the kept links, formatted, and read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, written

# The template's control strings, and how each looks inside a text.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
ESCAPES = {"\\": "\\\\", "<|": "<\\|", "|>": "|\\>", "[INST]": "[\\INST]", "[/INST]": "[\\/INST]", "<s>": "<\\s>", "</s>": "<\\/s>"}
#: A formatted conversation goes on in another part beyond this many characters.
PART_CHARS = 1 << 20


def escaped(text):
    """The text with every control string broken by a backslash; ``unescape`` takes it back."""
    for control, instead in ESCAPES.items():
        text = F.replace(text, F.lit(control), F.lit(instead))
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def best_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """The messages on the ``paths`` best root-to-leaf paths of each tree.

    ``messages``: tree_id, message_id (unique in the tree; long), parent_id
    (null or unknown: a root), score (null: 0). Returns tree_id, message_id,
    path (1: the best), depth (root: 0). Branches rank by mean score, then
    greater depth, then smaller leaf id. Messages on a cycle of parents have no
    root and are on no path.
    """
    nodes = messages.select("tree_id", "message_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select("tree_id", F.col("message_id").alias("parent_id"), F.lit(True).alias("has_parent"))
    links = written(
        nodes.join(known, ["tree_id", "parent_id"], "left").select("tree_id", "message_id", F.when(F.col("has_parent"), F.col("parent_id")).alias("up"), F.col("score").alias("total"), F.lit(0).alias("depth")),
        "links",
    )
    jumps, before = [], -1
    while (open_ends := links.where("up is not null").count()) and open_ends != before:
        jumps.append(links.where("up is not null").select("tree_id", "message_id", "up"))
        above = links.select("tree_id", F.col("message_id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("above"))
        # only messages that haven't reached their root are joined again
        step = len(jumps) - 1
        climbed = links.where("up is not null").join(above, ["tree_id", "up"]).select("tree_id", "message_id", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.lit(1 << step) + F.col("above")).alias("depth"))
        links = written(links.where("up is null").unionByName(climbed), "links")
        before = open_ends if len(jumps) > 40 else -1
    inner = nodes.select("tree_id", F.col("parent_id").alias("message_id")).where("message_id is not null").distinct()
    rank = Window.partitionBy("tree_id").orderBy(F.desc("mean"), F.desc("depth"), "message_id")
    leaves = links.where("up is null").join(inner, ["tree_id", "message_id"], "left_anti").withColumn("mean", F.col("total") / (F.col("depth") + 1))
    marked = leaves.withColumn("path", F.row_number().over(rank)).where(F.col("path") <= paths).select("tree_id", "message_id", "path", "depth")
    marked = written(marked, "marked")
    for step in reversed(range(len(jumps))):
        higher = marked.join(jumps[step], ["tree_id", "message_id"]).select("tree_id", F.col("up").alias("message_id"), "path", (F.col("depth") - (1 << step)).alias("depth"))
        marked = written(marked.unionByName(higher), "marked")
    return marked


def _parts(batches: Iterator[dict]) -> Iterator[dict]:
    """Formatted turns in order, run together into parts of one conversation; trained: spans of assistant text."""
    at, part, held, spans, size = None, 0, [], [], 0

    def flush():
        return {"conv_id": [at[0]], "path": [at[1]], "part": [part], "formatted": ["".join(held)], "trained": [spans]}

    for batch in batches:
        for conv, path, head, text, trained in zip(*(batch[c] for c in ("conv_id", "path", "head", "text", "trained"))):
            if at is not None and (at != (conv, path) or size > PART_CHARS):
                yield flush()
                part = part + 1 if at == (conv, path) else 0
                held, spans, size = [], [], 0
            at = (conv, path)
            turn = head + text + END
            if trained:
                spans.append({"start": size + len(head), "end": size + len(head) + len(text)})
            held.append(turn)
            size += len(turn)
    if at is not None:
        yield flush()


def format_conversations(messages: DataFrame, paths: int = 1, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted conversation for each chosen path: conv_id, path, part, formatted, trained (spans under the loss mask).

    ``messages``: conv_id, message_id, parent_id, score, role, text. A null role
    or text counts as empty, a null conv_id is a conversation of its own; an
    empty table gives an empty one. A conversation beyond ``PART_CHARS`` goes on in further parts, cut between turns, so that no
    cell grows with the number of its turns.
    """
    # as a field of a struct a null equals a null
    messages = messages.withColumn("conv_id", F.struct("conv_id"))
    chosen = best_paths(messages.withColumnRenamed("conv_id", "tree_id"), paths).withColumnRenamed("tree_id", "conv_id")
    said = messages.select("conv_id", "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = (
        said.join(chosen, ["conv_id", "message_id"])
        .select("conv_id", "path", "depth", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE)).alias("head"), escaped(F.col("text")).alias("text"), F.col("role").isin(*trained_roles).alias("trained"))
        .repartition("conv_id", "path")
        .sortWithinPartitions("conv_id", "path", "depth")
    )
    kind = messages.schema["conv_id"].dataType.simpleString()
    made = map_rows(turns, _parts, f"conv_id {kind}, path int, part int, formatted string, trained array<struct<start int, end int>>")
    return made.withColumn("conv_id", F.col("conv_id.conv_id"))


def _read(batches: Iterator[dict]) -> Iterator[dict]:
    """Turns and masked text of each conversation, digested as they stream by in order."""
    at, now = None, None

    def flush():
        return {"conv_id": [at[0]], "path": [at[1]], "n_turns": [now["n"]], "turns_sha256": [now["turns"].hexdigest()], "loss_chars": [now["chars"]], "loss_sha256": [now["loss"].hexdigest()], "formatted_chars": [now["size"]]}

    for batch in batches:
        for conv, path, formatted, trained in zip(*(batch[c] for c in ("conv_id", "path", "formatted", "trained"))):
            if at != (conv, path):
                if at is not None:
                    yield flush()
                at, now = (conv, path), {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0}
            for turn in formatted.split(END)[:-1]:
                role, text = turn.removeprefix(OPEN).split(CLOSE, 1)
                now["n"] += 1
                now["turns"].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            for span in trained:
                text = unescape(formatted[span["start"] : span["end"]])
                now["chars"] += len(text)
                now["loss"].update(text.encode())
            now["size"] += len(formatted)
    if at is not None:
        yield flush()


def read_conversations(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from their text and mask alone, a row for each conv_id and path."""
    rows = formatted.repartition("conv_id", "path").sortWithinPartitions("conv_id", "path", "part")
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return map_rows(rows, _read, f"conv_id {kind}, path int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def replies(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees: each row answers the one before it.

    Rows stand by turn, then role, then text; null turns come first. A null
    conv_id is a conversation of its own. Other columns are ignored.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", "role", "text").withColumn("message_id", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"), F.lit(1.0).alias("score"), "role", "text")
