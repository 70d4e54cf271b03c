"""Chat formatting checked by a grammar round trip.

Template: a system turn is ``<<SYS>> text <</SYS>>``, a user turn ``[INST] text [/INST]``, an assistant turn
``<s> text </s>``, any other turn ``[TURN name] text [/TURN]``. A text goes in as it is when the parser reads the same
turn back; otherwise every control string in it, or what would be read as an escaped one, gets one more backslash
after its opening brackets, and the parser takes one away. So escaping is reversible for every text, and most
texts stay untouched.

Turns stream through tasks that own whole conversations, sorted; a task holds one turn at a time, so a conversation
of any length needs no memory of its own. Each rendered turn is parsed back before it is passed on.

Defined results: a null text counts as empty, a null role is the role ``""``, a null conversation id is one
conversation of its own, a null turn sorts first; equal turn numbers sort by role, then text; repeated rows are
repeated turns; an empty table gives an empty table; extra columns are not carried.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from refrain.llm.common import ship

#: Fixed values of the template: role, opening and closing control string. The space belongs to the marker.
MARKS = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
OTHER_OPEN, OTHER_CLOSE = "[TURN ", " [/TURN]"
#: Every control string, cut after its opening brackets, where an escape goes.
HEAD, TAILS = r"(<<|\[|<)", r"(/?SYS>>|/?INST\]|/?TURN[ \]]|/?s>)"
CONTROL = re.compile(HEAD + r"(\\*)" + TAILS)
ESCAPED = re.compile(HEAD + r"\\(\\*)" + TAILS)
NAME = re.compile(r"[\\\]\n]")
TURN_SCHEMA = ("conv_id long, position long, role string, formatted string, start long, text_start long, text_end long, "
               "in_loss boolean, escaped boolean")
DIGEST_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                 "formatted_chars long, n_escaped long")


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def marks(role: str) -> tuple[str, str]:
    if role in MARKS:
        return MARKS[role]
    # A name's brackets, line ends and backslashes are spelled by their code point, so that the first "]" ends the name.
    return f"{OTHER_OPEN}{NAME.sub(lambda m: '%s%x;' % (chr(92), ord(m[0])), role)}] ", OTHER_CLOSE


class NotATurn(ValueError):
    pass


def parse(formatted: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """Read one turn at ``at``: its role, text, where its text stands in the output, and where the turn ends."""
    for role, (opening, closing) in MARKS.items():
        if formatted.startswith(opening, at):
            break
    else:
        if not formatted.startswith(OTHER_OPEN, at):
            raise NotATurn(f"no turn at {at}")
        stop = formatted.find("] ", at)
        if stop < 0:
            raise NotATurn(f"open name at {at}")
        name, opening, closing = formatted[at + len(OTHER_OPEN):stop], formatted[at:stop + 2], OTHER_CLOSE
        role = re.sub(r"\\([0-9a-f]+);", lambda m: chr(int(m[1], 16)), name)
    start = at + len(opening)
    end = formatted.find(closing, start)
    if end < 0:
        raise NotATurn(f"turn at {at} does not end")
    return role, unescape(formatted[start:end]), start, end, end + len(closing)


def reads_back(formatted: str, role: str, text: str) -> bool:
    """Whether the parser finds exactly this turn, and no control string inside it."""
    try:
        got_role, got_text, start, end, stop = parse(formatted)
    except NotATurn:
        return False
    return (got_role, got_text, stop) == (role, text, len(formatted)) and not CONTROL_PLAIN.search(formatted, start, end)


CONTROL_PLAIN = re.compile(HEAD + TAILS)


def render(role: str, text: str) -> tuple[str, bool]:
    """The formatted turn, and whether its text had to be escaped to read back."""
    opening, closing = marks(role)
    formatted = opening + text + closing
    if reads_back(formatted, role, text):
        return formatted, False
    formatted = opening + escape(text) + closing
    if not reads_back(formatted, role, text):
        raise AssertionError("an escaped turn must read back")
    return formatted, True


def _sorted_turns(turns: DataFrame) -> DataFrame:
    one = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return one.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _rendered(batches):
    """(conv_id, position, role, text, formatted, start, escaped) of every sorted row, one at a time."""
    now, position, start = object(), 0, 0
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if conv != now:
                now, position, start = conv, 0, 0
            formatted, escaped = render(role, text)
            yield conv, position, role, text, formatted, start, escaped
            position, start = position + 1, start + len(formatted)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row a turn: its formatted text, where it and its own text stand in the conversation's output (code
    points), and whether a loss is taken on that text. A conversation's output is its turns' texts in order."""
    def run(batches):
        import pyarrow as pa

        def row(conv, position, role, formatted, start, escaped):
            _, _, a, b, _ = parse(formatted)
            return {"conv_id": conv, "position": position, "role": role, "formatted": formatted, "start": start,
                    "text_start": start + a, "text_end": start + b, "in_loss": role == "assistant", "escaped": escaped}

        held = []
        for conv, position, role, _, formatted, start, escaped in _rendered(batches):
            held.append(row(conv, position, role, formatted, start, escaped))
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist(held, schema=_turn_schema())
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_turn_schema())

    return _sorted_turns(turns).mapInArrow(run, TURN_SCHEMA)


def _turn_schema():
    import pyarrow as pa
    return pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("formatted", pa.string()),
                      ("start", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()),
                      ("in_loss", pa.bool_()), ("escaped", pa.bool_())])


class _Reader:
    """Reads a conversation back from its formatted turns and digests what it finds."""

    def __init__(self, conv):
        import hashlib
        self.conv, self.n, self.loss, self.chars, self.escaped = conv, 0, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def take(self, formatted: str, escaped: bool) -> None:
        role, text, _, _, stop = parse(formatted)
        if stop != len(formatted):
            raise AssertionError("a formatted turn must hold one turn")
        self.turns.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            self.masked.update(text.encode())
            self.loss += len(text)
        self.n, self.chars, self.escaped = self.n + 1, self.chars + len(formatted), self.escaped + escaped

    def row(self) -> dict:
        return {"conv_id": self.conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss,
                "loss_sha256": self.masked.hexdigest(), "formatted_chars": self.chars, "n_escaped": self.escaped}


def format_and_read_back(turns: DataFrame) -> DataFrame:
    """Format every conversation and digest what the parser reads back from the output: one row a conversation."""
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                            ("n_escaped", pa.int64())])
        reader, held = None, []
        for conv, _, _, _, formatted, _, escaped in _rendered(batches):
            if reader is None or conv != reader.conv:
                if reader is not None:
                    held.append(reader.row())
                reader = _Reader(conv)
            reader.take(formatted, escaped)
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if reader is not None:
            held.append(reader.row())
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return _sorted_turns(turns).mapInArrow(run, DIGEST_SCHEMA)


ship(__name__)
