"""Chat formatting by a finite-state machine over roles and a declarative template.

Conversations stream through sorted partitions turn by turn, so a conversation of any length needs the memory of one
turn. A second reader takes the segments back apart, which proves that the formatting is reversible.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


@dataclass(frozen=True)
class Template:
    """Marks around the turns of each role, the roles under the loss, and the allowed order of turns."""

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
    )
    #: Any other role: its name stands between the first two, its text before the third.
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: state -> roles that may follow; a state is the last role, "" before the first.
    order: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> list[str]:
        """The strings that no text may hold unescaped, longest first."""
        found = {m.strip() for pair in self.marks.values() for m in pair} | set(self.other)
        return sorted(found, key=lambda c: (-len(c), c))


def escaper(template: Template):
    """Escapes texts: backslashes are doubled, and one goes behind the first character of each control string."""
    control = re.compile("|".join(map(re.escape, template.controls())))

    def escape(text: str) -> str:
        return control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))

    return escape


def unescape(text: str) -> str:
    """The inverse of every escaper."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def _format(frames, template: Template):
    escape = escaper(template)
    conv, state, turn, segment = None, None, 0, 0  # state None: no conversation yet
    out: list[tuple] = []

    def close():
        if state is not None and state not in template.final:
            out.append((conv, segment, turn, "", False, f"ends after {state or 'no turn'}"))

    for frame in frames:
        for conv_id, role, text in zip(frame["conv_id"], frame["role"], frame["text"], strict=True):
            conv_id = None if pd.isna(conv_id) else int(conv_id)
            if state is None or conv_id != conv:
                close()
                conv, state, turn, segment = conv_id, "", 0, 0
            fault = "" if role in template.order.get(state, ()) else f"{role or 'no role'} after {state or 'the start'}"
            if role in template.marks:
                before, after = template.marks[role]
            else:
                before, after = template.other[0] + escape(role) + template.other[1], template.other[2]
            out += [
                (conv, segment, turn, before, False, fault),
                (conv, segment + 1, turn, escape(text), role in template.loss_roles, ""),
                (conv, segment + 2, turn, after, False, ""),
            ]
            state, turn, segment = role, turn + 1, segment + 3
        yield _segments(out)
        out = []
    close()
    yield _segments(out)


def _segments(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "segment", "turn", "text", "loss", "fault"])
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


def format_chats(
    turns: DataFrame, template: Template = Template(), *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The segments of every conversation: conv_id, segment (0..), turn (0..), text, loss, fault.

    Turns go by their number, ties by role and text, nulls first; repeated rows are turns of their own. Null roles and
    texts are empty. A conversation against the order of roles is formatted all the same; ``fault`` then names each
    breach at its turn, and an empty segment at the end one that stops before a final role. Rows with a null conv_id
    form one conversation. An empty table gives no row; other columns are not read. The concatenated texts of a
    conversation are its formatted form. Memory per task: one Arrow batch, whatever a conversation's length.
    """
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        text_or_empty(text).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return dealt.mapInPandas(
        lambda it: _format(it, template), "conv_id long, segment long, turn long, text string, loss boolean, fault string"
    )


class Reader:
    """Takes the formatted form of one conversation apart as it comes in."""

    def __init__(self, template: Template):
        self.template = template
        self.starts = {before: (role, after) for role, (before, after) in template.marks.items()}
        self.buffer, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.valid = True

    def _open(self):
        for before, (role, after) in self.starts.items():
            if self.buffer.startswith(before):
                return role, len(before), after
        first, second, after = self.template.other
        if self.buffer.startswith(first) and (to := self.buffer.find(second)) >= 0:
            return unescape(self.buffer[len(first) : to]), to + len(second), after
        return None

    def feed(self, text: str, loss: bool, fault: str) -> None:
        self.valid &= not fault
        self.chars += len(text)
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.buffer += text

    def take(self) -> None:
        """Consumes the turns that the buffer holds whole."""
        while (found := self._open()) and (to := self.buffer.find(found[2], found[1])) >= 0:
            self.all.update(f"{found[0]}\n{unescape(self.buffer[found[1] : to])}\n".encode())
            self.turns += 1
            self.buffer = self.buffer[to + len(found[2]) :]


def _read(frames, template: Template):
    conv, reader, last = None, None, -1
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def result() -> tuple:
        if reader.buffer:
            raise ValueError(f"conversation {conv}: what was formatted can't be read back")
        return (conv, reader.turns, reader.all.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars, reader.valid)

    for frame in frames:
        out = []
        for c, s, turn, text, loss, fault in zip(*(frame[x] for x in ("conv_id", "segment", "turn", "text", "loss", "fault")), strict=True):
            c = None if pd.isna(c) else int(c)
            if reader is None or s == 0:
                if reader is not None:
                    reader.take()
                    out.append(result())
                conv, reader, last = c, Reader(template), turn
            if turn != last:
                reader.take()
                last = turn
            reader.feed(text, loss, fault)
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
    if reader is not None:
        reader.take()
        yield pd.DataFrame([result()], columns=names).astype({"conv_id": "Int64"})


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation from the segments of ``format_chats``, in whose partitions and order they still are.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of every turn), loss_chars, loss_sha256 (the text under
    the loss mask), formatted_chars, valid (no breach of the order of roles).
    """
    return segments.mapInPandas(
        lambda it: _read(it, template),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean",
    )
