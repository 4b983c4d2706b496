"""Chat formatting with typed content parts.

A turn is a role and an ordered list of parts: text, image, audio or document.
A visitor flattens them to one body, in which each attachment is a placeholder;
its reference, place and expanded token count are recorded beside the text.
Turns are marked by control strings.  Where a text holds a control string, a
break is put behind its first character, and backslashes are doubled, so that
texts can be told from markup and read back exactly.

The formatted form is one row per turn: a conversation of any length is a run of
rows, never one value.  Reading back streams over these rows.

Defined cases: a null text or role is empty; an unknown kind of part is an
attachment of that kind's name.  Rows of the same turn, repeated rows too, are
ordered by role and text and all count; a null turn comes first.  Rows without a
conv_id are one conversation of their own.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokora.llm.common import pick

TURN, END = "<|turn|>", "</s>"
# Strings with a meaning in chat templates.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
# A control string of the list, or anything in the form <|name|>; its first character is captured.
STARTS = re.compile("(?:" + "|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))) + r"|<\|[^<>|\s]*\|>)")
ESCAPED = re.compile(r"\\([\\n-])")
PLAIN = {"\\": "\\", "n": "\n", "-": ""}

PARTS = "array<struct<kind: string, text: string, ref: string, tokens: long>>"
FORMATTED = (
    "conv_id long, turn long, role string, formatted string, loss_start long, loss_length long, "
    "attachments array<struct<kind: string, ref: string, at: long, tokens: long>>"
)


def escape(text: str) -> str:
    """Without control strings; ``unescape`` gives the text back.

    The break goes behind the first character of each occurrence, overlapping
    ones included, so that none is left.
    """
    text = text.replace("\\", "\\\\")
    out, at = [], 0
    while found := STARTS.search(text, at):
        out.append(text[at : found.start() + 1])
        out.append("\\-")
        at = found.start() + 1
    out.append(text[at:])
    return "".join(out)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: PLAIN[m[1]], text)


@dataclass
class Flattener:
    """Visits the parts of a turn in order; keeps the body and its attachments."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0

    def visit(self, kind: str | None, text: str | None, ref: str | None, tokens: int | None) -> None:
        getattr(self, f"visit_{kind}", self.visit_other)(kind, text, ref, tokens)

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit_text(self, kind, text, ref, tokens) -> None:
        self._add(escape(text or ""))

    def visit_attachment(self, kind, text, ref, tokens) -> None:
        """A placeholder; a caption, if any, follows as text."""
        self.attachments.append({"kind": kind, "ref": ref, "at": self.length, "tokens": int(tokens or 1)})
        self._add(f"<|{kind}|>")
        if text:
            self.visit_text(kind, text, ref, tokens)

    visit_image = visit_audio = visit_document = visit_attachment

    def visit_other(self, kind, text, ref, tokens) -> None:
        self.visit_attachment(re.sub(r"[<>|\s\\]", "_", kind or "part"), text, ref, tokens)


def format_turns(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted row for each row of ``(conv_id, turn, role, parts)``.

    ``loss_start`` and ``loss_length`` (characters of ``formatted``) cover the body
    of the roles to learn from, without markup. 
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                flat = Flattener()
                for part in row.parts if row.parts is not None else []:
                    tokens = part["tokens"]
                    flat.visit(part["kind"], part["text"], part["ref"], None if pd.isna(tokens) else tokens)
                role = row.role or ""
                head = f"{TURN}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
                for attachment in flat.attachments:
                    attachment["at"] += len(head)
                loss = flat.length if role in learn else 0
                whole = f"{head}{''.join(flat.pieces)}{END}"
                out.append((row.conv_id, row.turn, role, whole, len(head), loss, flat.attachments))
            names = ["conv_id", "turn", "role", "formatted", "loss_start", "loss_length", "attachments"]
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64", "turn": "Int64"})

    return turns.select("conv_id", "turn", "role", "parts").mapInPandas(write, FORMATTED)


def text_turns(conversations: DataFrame) -> DataFrame:
    """Turns of a single text part each, from ``(conv_id, turn, role, text)``."""
    part = F.struct(
        F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"),
    )
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
        F.array(part).cast(PARTS).alias("parts"),
    )


def read_turns(stream: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Role and body of each turn of formatted text that comes in any pieces."""
    rest = ""
    for piece in stream:
        rest += piece
        while (end := rest.find(END)) >= 0:
            head = rest.index("\n")
            yield unescape(rest[len(TURN) : head]), unescape(rest[head + 1 : end])
            rest = rest[end + len(END) :]
    if rest:
        raise ValueError("formatted text ends within a turn")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted text and loss spans alone.

    Conversations are sorted within partitions and streamed: memory holds one
    turn and running hashes.  A digest over a whole conversation is sequential,
    so that a conversation is read by one task.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, begun, state = None, False, None

        def row(conv_id, s):
            return (conv_id, s["turns"], s["all"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"])

        for batch in batches:
            out = []
            for conv_id, text, start, length in zip(
                batch["conv_id"], batch["formatted"], batch["loss_start"], batch["loss_length"], strict=True
            ):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                if not begun or conv_id != now:
                    if begun:
                        out.append(row(now, state))
                    now, begun = conv_id, True
                    state = {"turns": 0, "chars": 0, "loss_chars": 0, "all": hashlib.sha256(), "loss": hashlib.sha256()}
                state["chars"] += len(text)
                for role, body in read_turns([text]):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{body}\n".encode())
                learnt = unescape(text[start : start + length])
                state["loss_chars"] += len(learnt)
                state["loss"].update(learnt.encode())
            yield frame(out)
        yield frame([row(now, state)] if begun else [])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

    ordered = formatted.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_length")
    return (
        ordered.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "formatted")
        .mapInPandas(
            read,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
        )
    )
