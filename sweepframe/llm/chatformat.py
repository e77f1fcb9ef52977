"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn as

    ### role: text<newline></turn><newline>

The control strings are ``###`` and ``</turn>``. A turn is first rendered as it
is and parsed again by the deterministic parser below; if the parser does not
give back the very turn, the control strings in it are escaped with one more
backslash and the rendering is parsed again, until both are identical. The
parser drops one backslash from every run of backslashes before a control
string and takes a control string without a backslash as structure.

Defined results: a null text or role is empty; turns are ordered by (turn, role,
text) with nulls first, so ties have one order; repeated rows are turns of their
own; a null conv_id is a conversation; an empty table gives an empty result.
Extra columns are dropped. One conversation is streamed, never held in memory.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings, as a pattern with the backslashes before one.
CONTROL = r"(\\*)(###|</turn>)"
_CONTROL = re.compile(CONTROL)
_CLOSE = "\n</turn>\n"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1][1:] + m[2], text)


def _safe_role(role: str) -> str:
    """A role without a colon: \\\\c for a colon, two backslashes for one."""
    return role.replace("\\", "\\\\").replace(":", "\\c")


def _plain_role(role: str) -> str:
    return re.sub(r"\\([c\\])", lambda m: ":" if m[1] == "c" else "\\", role)


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The (role, text) turns of a rendering; None if it isn't in the grammar."""
    marks = [m for m in _CONTROL.finditer(rendered) if not m[1]]
    turns, at = [], 0
    for opening, closing in zip(marks[::2], marks[1::2]):
        body = rendered[opening.end() : closing.start()]
        role, colon, text = body.partition(": ")
        if opening.start() != at or opening[2] != "###" or closing[2] != "</turn>" or not colon or role[:1] != " " or not text.endswith("\n") or rendered[closing.end() : closing.end() + 1] != "\n":
            return None
        turns.append((_plain_role(unescape(role[1:])), unescape(text[:-1])))
        at = closing.end() + 1
    return turns if len(marks) % 2 == 0 and at == len(rendered) else None


def render(role: str, text: str) -> str:
    """One turn, escaped only where the round trip needs it."""
    for head, body in ((role, text), (role, escape(text)), (escape(role), text), (escape(role), escape(text)), (escape(_safe_role(role)), escape(text))):
        out = f"### {head}: {body}{_CLOSE}"
        if parse(out) == [(role, text)]:
            return out
    raise ValueError(f"no rendering of {role!r} is read back")


def format_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, rendered): a conversation's training text is `rendered` of its turns in order. No shuffle."""

    def rows(batches):
        for batch in batches:
            batch["rendered"] = [render(r or "", t or "") for r, t in zip(batch["role"].where(batch["role"].notna(), ""), batch["text"].where(batch["text"].notna(), ""))]
            yield batch

    picked = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return picked.mapInPandas(rows, "conv_id long, turn long, role string, text string, rendered string")


def read_back(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """Per conversation, from the renderings alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The loss mask covers the texts of the role `learn`."""

    def digests(batches):
        key = object()
        state = None

        def result():
            n, turns, chars, loss, size = state
            return (None if pd.isna(key) else int(key), n, turns.hexdigest(), chars, loss.hexdigest(), size)

        for batch in batches:
            out = []
            for conv, piece in zip(batch["conv_id"], batch["rendered"]):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or conv != key:
                    if state is not None:
                        out.append(result())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                parsed = parse(piece)
                if parsed is None:
                    raise ValueError(f"conversation {conv} isn't in the grammar")
                for role, text in parsed:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == learn:
                        state[2] += len(text)
                        state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if out:
                yield table(out)
        if state is not None:
            yield table([result()])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def table(out):
        frame = pd.DataFrame(out, columns=names)
        frame["conv_id"] = frame["conv_id"].astype("Int64")
        return frame

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = formatted.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "rendered")
    return rows.mapInPandas(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
