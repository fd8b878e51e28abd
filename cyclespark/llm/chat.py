r"""Chat formatting by a finite-state machine over roles (operator 8).

A declarative template says what stands before and after the text of each role, and
whether the text counts for the loss. Control strings in a text are broken up by a
backslash, and backslashes are doubled, so that ``unescape`` gives the text back and no
text can fake a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions


@dataclass(frozen=True)
class Template:
    """before and after the text, by role; ``other`` frames a role without a frame of its own."""

    frames: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
            "user": ("<s>[INST] ", " [/INST]"),
            "assistant": (" ", "</s>\n"),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]\n")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: state -> role -> next state; what isn't here breaks the turn order
    turns: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: frozenset[str] = frozenset({"answered"})
    #: strings that mean something to a reader of the output
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TEXT]")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        return self._marks().sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if "<" in text or "[" in text else text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text

    def _marks(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, sorted(self.control, key=len, reverse=True))))

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, counts for the loss) parts of one turn."""
        loss = role in self.loss_roles
        if role in self.frames:
            a, b = self.frames[role]
        else:
            open_, mid, b = self.other
            a = open_ + self.escape(role) + mid
        return [(a, False), (self.escape(text), loss), (b, False)]

    def read(self, text: str) -> tuple[list[tuple[str, str]], str]:
        """(role, text) of the whole turns that ``text`` begins with, and what is left of it.

        Borders come from the marks alone, as no escaped text holds one.
        """
        open_, mid, close = self.other
        # the longest opening first: one can begin with another
        known = sorted([(open_, close, None), *[(a, b, role) for role, (a, b) in self.frames.items()]], key=lambda x: -len(x[0]))
        turns, at = [], 0
        while at < len(text):
            frame = next((x for x in known if text.startswith(x[0], at)), None)
            if frame is None:
                if any(a.startswith(text[at:]) for a, _, _ in known):
                    break
                raise ValueError("no frame of the template fits")
            begin = at + len(frame[0])
            end = text.find(frame[1], begin)
            if end < 0:
                break
            role, inner = frame[2], text[begin:end]
            if role is None:
                role, _, inner = inner.partition(mid)
                role = self.unescape(role)
            turns.append((role, self.unescape(inner)))
            at = end + len(frame[1])
        return turns, text[at:]


SEGMENTS = "array<struct<text:string,loss:boolean>>"


def format_turns(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of each turn, with the verdict on the turn order up to it.

    ``turns``: conv_id, turn, role, text. Returns conv_id, turn, role, segments, state
    (after this turn; null once the order is broken), valid (order kept so far) and
    complete (the conversation could end here). Turns of a conversation are in order of
    turn (nulls first), then role, then text, so copies of rows give a defined result.
    Null role and text count as empty, a null conv_id is a conversation of its own. The
    rows stream through a task sorted by conversation; only the state is kept, so a
    conversation of any length needs no more memory.
    """
    template = template or Template()
    n = partitions(turns.sparkSession)
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    # pandas turns whole numbers beside a null into floats: they travel as strings
    kinds = turns.schema
    rows = rows.withColumns({"conv_id": F.col("conv_id").cast("string"), "turn": F.col("turn").cast("string")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: object = None
        state: str | None = None
        begun = False
        for b in batches:
            out, states = [], []
            for conv, who, said in zip(b["conv_id"], b["role"], b["text"], strict=True):
                conv = None if pd.isna(conv) else conv
                if not begun or conv != last:
                    begun, last, state = True, conv, "start"
                state = template.turns.get(state, {}).get(who) if state is not None else None
                out.append([{"text": t, "loss": k} for t, k in template.segments(who, said)])
                states.append(state)
            yield b[["conv_id", "turn", "role"]].assign(
                segments=out,
                state=pd.Series(states, b.index, dtype=object),
                valid=[s is not None for s in states],
                complete=[s in template.final for s in states],
            )

    made = rows.mapInPandas(run, f"conv_id string, turn string, role string, segments {SEGMENTS}, state string, valid boolean, complete boolean")
    return made.withColumns({c: F.col(c).cast(kinds[c].dataType) for c in ("conv_id", "turn")})


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation, read from the formatted text of ``format_turns``.

    The segments of a conversation are one text, however they are cut into rows; its turns are
    found by the marks of the template, the learnt text by the loss flags. Returns conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid and complete. The
    rows must come in the order and partitions of ``format_turns``; the text streams through
    a buffer that holds one unfinished turn. A text that ends inside a turn is an error.
    """
    template = template or Template()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "complete"]
        begun, key = False, None
        n = loss_chars = chars = 0
        rest = ""
        turns = loss = hashlib.sha256()
        valid = complete = True
        done: list[tuple] = []

        def row() -> tuple:
            if rest:
                raise ValueError("a conversation ends inside a turn")
            return key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid, complete

        for b in batches:
            for conv, segments, ok, end in zip(b["conv_id"], b["segments"], b["valid"], b["complete"], strict=True):
                conv = None if pd.isna(conv) else conv
                if not begun or conv != key:
                    if begun:
                        done.append(row())
                    begun, key, n, loss_chars, chars, turns, loss = True, conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                read, rest = template.read(rest + "".join(s["text"] for s in segments))
                for who, said in read:
                    turns.update(f"{who}\n{said}\n".encode())
                learnt = "".join(template.unescape(s["text"]) for s in segments if s["loss"])
                loss.update(learnt.encode())
                n, loss_chars = n + len(read), loss_chars + len(learnt)
                chars += sum(len(s["text"]) for s in segments)
                valid, complete = bool(ok), bool(end)
            if done:
                yield pd.DataFrame(done, columns=columns)
                done = []
        if begun:
            yield pd.DataFrame([row()], columns=columns)

    kind = formatted.schema["conv_id"].dataType
    made = formatted.select(F.col("conv_id").cast("string").alias("conv_id"), "segments", "valid", "complete").mapInPandas(
        run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, complete boolean"
    )
    return made.withColumn("conv_id", F.col("conv_id").cast(kind))
