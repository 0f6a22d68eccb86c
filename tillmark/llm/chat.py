"""Chat formatting by incremental rendering of a black-box template.

The template is any function from a list of {"role", "content"} messages to a string. Successive prefixes of a
conversation are rendered; where each output continues the one before it, the added part is the new turn's span.
Where it does not, the template rewrites history: the piece is flagged and spans are located in its last output.
The part of a span that is the text itself is found by rendering two marks in its place and comparing the outputs.

Rows by turn are range-partitioned by conversation and turn and cut to pieces of bounded length, so a conversation of
any size is spread over tasks. A piece that does not open a conversation is rendered after an empty turn, whose
output is taken off again. That is only right if the template adds turn to turn, so every two neighbouring pieces are
rendered together and compared with what they gave apart. A conversation that fails at any border, or whose history is
rewritten inside a piece, is rendered as a whole from its first turn on, in one task: a template that looks at the whole
conversation needs it there. So the result does not depend on where pieces end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.common import cut, stored

Template = Callable[[list[dict]], str]
MARKS = ("\ue000", "\ue001")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
PIECES = (
    "conv_id long, part int, piece int, n_turns int, rewrites boolean, formatted string, "
    "turns array<struct<start:int, end:int, text_start:int, text_end:int, loss:boolean>>"
)
DRAFTS = PIECES + ", opens boolean, messages array<struct<role:string, content:string>>"
LEAD = {"role": "user", "content": ""}
FIELDS = [
    ("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("n_turns", pa.int32()), ("rewrites", pa.bool_()),
    ("formatted", pa.string()),
    ("turns", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()),
                                  ("text_end", pa.int32()), ("loss", pa.bool_())])))]
DRAFT_FIELDS = [*FIELDS, ("opens", pa.bool_()), ("messages", pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())])))]


def escape(text: str) -> str:
    """No control string is left in the result; `unescape` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def marked_template(messages: list[dict]) -> str:
    """Turns between control strings; texts and roles are escaped."""
    return "".join(
        f"<|im_start|>{escape(m['role']).replace(chr(10), chr(92) + 'n')}\n{escape(m['content'])}<|im_end|>\n"
        for m in messages
    )


def text_span(template: Template, messages: list[dict], at: int) -> tuple[int, int] | None:
    """Where the text of message `at` stands in the output; None if the template leaves it out."""
    probes = []
    for mark in MARKS:
        changed = list(messages)
        changed[at] = {**messages[at], "content": mark}
        probes.append(template(changed))
    head = len(commonprefix(probes))
    if head == len(probes[0]):
        return None
    tail = len(commonprefix([p[::-1] for p in probes]))
    return head, len(template(messages)) - tail


def render(template: Template, messages: list[dict], opens: bool = True, loss_role: str = "assistant") -> dict:
    """Output, turn spans and text spans of one piece."""
    lead = [] if opens else [LEAD]
    skip = before = template(lead) if lead else ""
    rewrites, spans = False, []
    for i in range(len(messages)):
        out = template(lead + messages[: i + 1])
        common = len(before) if out.startswith(before) else len(commonprefix([before, out]))
        rewrites |= common < len(before)
        spans.append((common, len(out)))
        before = out
    cut = len(skip) if before.startswith(skip) else 0
    turns = []
    for i, message in enumerate(messages):
        loss = message["role"] == loss_role
        upto = lead + (messages if rewrites else messages[: i + 1])
        inside = text_span(template, upto, len(lead) + i) if loss else None
        start, end = spans[i]
        if rewrites and inside:
            start, end = inside
        low, high = inside or (start, start)
        turns.append({"start": start - cut, "end": end - cut, "text_start": low - cut, "text_end": high - cut,
                      "loss": inside is not None})
    return {"n_turns": len(messages), "rewrites": rewrites, "formatted": before[cut:], "turns": turns}


def together(template: Template, pieces: list[dict]) -> str:
    """Output of neighbouring pieces rendered as one, without that of the turn that stands in for what came before."""
    lead = [] if pieces[0]["opens"] else [LEAD]
    out, skip = template(lead + [m for p in pieces for m in p["messages"]]), template(lead) if lead else ""
    return out[len(skip):] if out.startswith(skip) else out


def drafts(rows: DataFrame, template: Template, piece_turns: int, loss_role: str) -> DataFrame:
    """Pieces with their messages; `opens` tells the piece that begins a conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[dict] = []
        state = {"conv": object(), "piece": 0, "opens": True}
        schema = pa.schema(DRAFT_FIELDS)

        def close():
            row = render(template, held, state["opens"], loss_role) | {
                "conv_id": state["conv"], "part": part, "piece": state["piece"], "opens": state["opens"], "messages": list(held)}
            held.clear()
            state.update(piece=state["piece"] + 1, opens=False)
            return row

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != state["conv"] or len(held) == piece_turns:
                    if held:
                        out.append(close())
                    if row["conv_id"] != state["conv"]:
                        state.update(conv=row["conv_id"], opens=bool(row["opens"]))
                held.append({"role": row["role"] or "", "content": row["text"] or ""})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([close()], schema)

    return rows.mapInArrow(run, DRAFTS)


def by_conversation(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")


def broken_conversations(several: DataFrame, template: Template) -> DataFrame:
    """(conv_id) of conversations that pieces do not add up to; a task holds two pieces at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for conv, own in groupby(rows, key=lambda r: r["conv_id"]):
            before, broken = None, False
            for piece in own:
                broken = broken or piece["rewrites"] or (before is not None and together(
                    template, [before, piece]) != before["formatted"] + piece["formatted"])
                before = piece
            if broken:
                yield pa.RecordBatch.from_pylist([{"conv_id": conv}], pa.schema([("conv_id", pa.int64())]))

    return by_conversation(several).mapInArrow(run, "conv_id long")


def whole_conversations(several: DataFrame, template: Template, loss_role: str) -> DataFrame:
    """One piece for each conversation, from true prefixes of all its turns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for conv, own in groupby(rows, key=lambda r: r["conv_id"]):
            messages = [m for piece in own for m in piece["messages"]]
            row = render(template, messages, True, loss_role) | {"conv_id": conv, "part": 0, "piece": 0}
            yield pa.RecordBatch.from_pylist([row], pa.schema(FIELDS))

    return by_conversation(several).mapInArrow(run, PIECES)


def format_chats(turns: DataFrame, template: Template = marked_template, piece_turns: int = 64,
                 loss_role: str = "assistant") -> DataFrame:
    """Formatted pieces of all conversations: `part` and `piece` give their order within a conversation.

    Needs conv_id, turn, role and text; other columns are ignored. Null roles and texts count as empty; turns sort
    by turn, then role, then text, nulls first; repeated rows are turns of their own. Rows without conv_id form one
    conversation with a null id. An empty table gives no rows. The pieces of a conversation, laid end to end, are what
    the template gives for all its turns, whatever `piece_turns` and the partitions are.
    """
    order = ["conv_id", "turn", "role"]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
                        F.col("text").cast("string"))
    # `opens` tells whether the conversation begins here, not in the partition before
    starts = rows.groupBy("conv_id").agg(F.min(F.struct("turn", "role", F.xxhash64("text").alias("h"))).alias("s"))
    starts = starts.select(F.col("conv_id").alias("c"), F.col("s.turn").alias("t"), F.col("s.role").alias("r"))
    opens = F.col("turn").eqNullSafe(F.col("t")) & F.col("role").eqNullSafe(F.col("r"))
    rows = rows.join(starts, rows["conv_id"].eqNullSafe(starts["c"])).withColumn("opens", opens).drop("c", "t", "r")
    # rows of one turn and role stay in one partition and are ordered by their text there
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    first = stored(drafts(ranged, template, piece_turns, loss_role), "chats")
    names = [c for c in first.columns if c not in ("opens", "messages")]
    several = cut(first.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("c")))
    if not several.limit(1).count():
        return first.select(*names)
    parts = first.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    broken = cut(broken_conversations(parts, template).withColumnRenamed("conv_id", "c"))
    if not broken.limit(1).count():
        return first.select(*names)
    own = F.col("conv_id").eqNullSafe(F.col("c"))
    whole = whole_conversations(first.join(broken, own, "left_semi"), template, loss_role)
    return first.select(*names).join(broken, own, "left_anti").unionByName(whole)


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites), read from the outputs.

    For outputs of `marked_template`. SHA-256 is sequential, so the pieces of one conversation stream through one
    task; it holds one batch of pieces at a time.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                            ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())])
        for conv, own in groupby(rows, key=lambda r: r["conv_id"]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = size = 0
            rewrites = False
            for row in own:
                text = row["formatted"]
                size += len(text)
                rewrites |= row["rewrites"]
                for role, content in TURN.findall(text):
                    turns.update(f"{unescape(role)}\n{unescape(content)}\n".encode())
                    n += 1
                for turn in row["turns"]:
                    if turn["loss"]:
                        said = unescape(text[turn["text_start"] : turn["text_end"]])
                        loss.update(said.encode())
                        chars += len(said)
            yield pa.RecordBatch.from_pylist([{
                "conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                "loss_sha256": loss.hexdigest(), "formatted_chars": size, "rewrites": rewrites}], schema)

    ordered = pieces.select("conv_id", "part", "piece", "formatted", "rewrites", "turns").repartition(
        "conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return ordered.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                      "loss_sha256 string, formatted_chars long, rewrites boolean")
