"""Chat formatting by a finite-state machine over roles.

A template is data: the marks around each role's text, which roles are learned
from, and which role may follow which.  Turns go through the machine in order
and come out as text segments with a loss flag each.  Strings of the template
inside a text are broken by an escape mark, so marks can be told from texts and
texts read back exactly.

Turns of a conversation are streamed from a sorted partition: the state is the
last role, so a conversation of any length takes constant memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = ""


@dataclass(frozen=True)
class Template:
    """marks: role -> (before, after); other roles are marked by name.

    follows: which roles may come after a role; START stands before the first
    turn, and `last` has the roles that may end a conversation.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")})
    learned: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {START: frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    last: frozenset[str] = frozenset({"assistant"})
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")

    def around(self, role: str) -> tuple[str, str]:
        return self.marks.get(role) or (f"[ROLE]{self.escape(role)}[/ROLE] ", " </s>")

    @property
    def _broken(self) -> re.Pattern[str]:
        """Where a control string starts, or could start if more text followed."""
        forms = {f"{re.escape(c[0])}(?={re.escape(c[1:])}|{'|'.join(re.escape(c[1:n]) + '$(?!.)' for n in range(1, len(c)))})" for c in self.controls}
        return re.compile("|".join(sorted(forms)), re.S)

    def escape(self, text: str) -> str:
        """Doubles backslashes, and puts one behind the first character of every control string."""
        return self._broken.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        before, after = self.around(role)
        return [(before, False), (self.escape(text), role in self.learned), (after, False)]

    def read(self, formatted: str) -> tuple[str, str]:
        """Role and text of a formatted turn."""
        named = re.match(r"\[ROLE\](.*?)\[/ROLE\] ", formatted, re.S)
        if named:
            role, before, after = self.unescape(named[1]), named[0], " </s>"
        else:
            role, before, after = next((r, a, b) for r, (a, b) in sorted(self.marks.items(), key=lambda x: -len(x[1][0])) if formatted.startswith(a))
        if not formatted.endswith(after) or len(formatted) < len(before) + len(after):
            raise ValueError(f"a turn of {role!r} has no end")
        return role, self.unescape(formatted[len(before) : len(formatted) - len(after)])


SEGMENTS = "conv_id long, turn_no long, part int, text string, loss boolean, fault string"


def format_chat(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turn_no, part, text, loss, fault): three segments for each turn, in order within a partition.

    turns: conv_id, turn, role, text.  Turns of a conversation go by turn, then
    role, then text; null turns come first.  A null role or text is empty, rows
    without a conv_id form one conversation, repeated rows are turns of their
    own.  fault says where the order of roles breaks the template, on the last
    segment of the turn; the turn is formatted all the same.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None  # conversation, its turns so far, last role
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "turn_no", "part", "text", "loss", "fault"])
            out.clear()
            return made

        for batch in batches:
            for conv, role, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or now[0] != conv:
                    now = (conv, 0, START)
                fault = None if role in template.follows.get(now[2], frozenset()) else f"{role or 'no role'} after {now[2] or 'the start'}"
                for k, (piece, loss) in enumerate(template.segments(role, text)):
                    out.append((conv, now[1], k, piece, loss, fault if k == 2 else None))
                now = (conv, now[1] + 1, role)
                if len(out) >= 3000:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, fault string"


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each conversation, from what format_chat() writes and nothing else.

    Each turn's segments are put together, read by the template's marks and
    unescaped.  loss_chars and loss_sha256 are those of the text under the loss flag.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "fault"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
        conv, begun, turns, learned, n, loss_chars, chars, fault, role = None, False, None, None, 0, 0, 0, None, START
        parts: list[str] = []
        out: list[tuple] = []

        def close() -> None:
            valid = fault is None and role in template.last
            out.append((conv, n, turns.hexdigest(), loss_chars, learned.hexdigest(), chars, valid, fault or (None if valid else f"ends with {role or 'no role'}")))

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)
            out.clear()
            return made

        for batch in batches:
            for c, turn, part, text, loss, broken in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if turn == 0 and part == 0:
                    if begun:
                        close()
                    conv, begun, turns, learned, n, loss_chars, chars, fault, role = c, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, None, START
                parts.append(text)
                chars += len(text)
                fault = fault or broken
                if loss:
                    plain = template.unescape(text)
                    loss_chars += len(plain)
                    learned.update(plain.encode())
                if part == 2:
                    role, said = template.read("".join(parts))
                    parts.clear()
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
            if len(out) >= 1000:
                yield flush()
        if begun:
            close()
        yield flush()

    return segments.mapInArrow(run, DIGESTS)
