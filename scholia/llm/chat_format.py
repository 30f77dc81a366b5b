r"""Chat formatting by grammar round trip.

A conversation is a row of turns, each ``### <role>:\n<text>\n</turn>\n``. Every turn is rendered plainly, parsed again by the
deterministic parser below and compared to its source; where they differ, conflicting content is escaped (a backslash before
backslashes and before the strings ``###`` and ``</turn>``) until they are identical. Roles are escaped likewise, and
their colons and line feeds.

Turns are rendered where they are read, so even one conversation with a third of all rows is rendered in parallel. Only what
is sequential by nature, reading a conversation back in order, follows a shuffle by conv_id: the rows arrive sorted and are
streamed, so a task holds one turn and a few running digests, never a conversation.

Null texts and roles count as empty. Turns are ordered by turn (null first), then role, then text; repeated rows are turns like
any other. Rows of null conv_id form one conversation of that id. Only the four columns of the table are used.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scholia.llm.common import table

OPEN, CLOSE = "### ", "\n</turn>\n"
_CONFLICT = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)
LOSS_ROLES = ("assistant",)


def escape(text: str, level: int) -> str:
    return _CONFLICT.sub(lambda m: "\\" + m[0], text) if level else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _escape_role(role: str) -> str:
    return escape(role, 1).replace(":", "\\:").replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def parse(rendered: str, at: int = 0) -> list[tuple[str, str, int, int]]:
    """The turns of a rendered string, from at: role, text, and the text's start and end in it. ValueError if it is malformed."""
    turns = []
    while at < len(rendered):
        head = rendered.find(":\n", at)
        if not rendered.startswith(OPEN, at) or head < 0:
            raise ValueError(f"no turn at {at}")
        start = head + 2
        end = rendered.find(CLOSE, start)
        if end < 0:
            raise ValueError(f"the turn at {at} is not closed")
        turns.append((_unescape_role(rendered[at + len(OPEN) : head]), unescape(rendered[start:end]), start, end))
        at = end + len(CLOSE)
    return turns


def render(role: str, text: str) -> tuple[str, int]:
    """A turn's string and the level of escapes that it took: the least whose reading is identical to the source."""
    for level in (0, 1):
        out = f"{OPEN}{_escape_role(role)}:\n{escape(text, level)}{CLOSE}"
        try:
            back = parse(out)
        except ValueError:
            continue
        if [x[:2] for x in back] == [(role, text)]:
            return out, level
    raise AssertionError("escaped text must read back identically")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [render(r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32())], ["conv_id", "turn", "role", "text", "rendered", "escapes"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, rendered, escapes: one row per turn; concatenated in order they are the formatted conversation."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    return rows.mapInArrow(_rendered, f"{kinds}, rendered string, escapes int")


class _Reader:
    """Reads one formatted conversation back, piece by piece."""

    def __init__(self) -> None:
        self.turns = self.loss = self.chars = 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def read(self, piece: str) -> None:
        self.chars += len(piece)
        for role, text, _, _ in parse(piece):
            self.turns += 1
            data = text.encode("utf-8", "surrogatepass")
            self.all.update(role.encode("utf-8", "surrogatepass") + b"\n" + data + b"\n")
            if role in LOSS_ROLES:
                self.loss += len(text)
                self.masked.update(data)

    def result(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


_RESULT = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, reader, kind, done = None, None, None, []

    def flush() -> pa.RecordBatch:
        ids, rest = [x[0] for x in done], list(zip(*(x[1] for x in done)))
        done.clear()
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, t) for c, t in zip(rest, types))], ["conv_id", *(x.split()[0] for x in _RESULT.split(", "))])

    for b in batches:
        kind = b.schema.field(0).type
        for conv, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if reader is None or conv != current:
                if reader:
                    done.append((current, reader.result()))
                current, reader = conv, _Reader()
            reader.read(piece)
        if len(done) > 1000:
            yield flush()
    if reader:
        done.append((current, reader.result()))
        yield flush()


def read_back(turns: DataFrame) -> DataFrame:
    """What the formatted output says, one row per conversation: turns, and all text under the loss mask."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "rendered")
    return rows.mapInArrow(_read, f"conv_id {kind}, {_RESULT}")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], rows.schema)
    return read_back(format_turns(rows.unionByName(more)))


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(CASE WHEN regexp_matches(text, '(?s)\\.') OR contains(text || chr(10), chr(10) || '</turn>' || chr(10)) THEN regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') ELSE text END)
  + length(regexp_replace(role, '(\\|###|</turn>|:|\n)', '\\\1', 'g')) + 15 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""

QUERIES = {"op7_chat_format": op7_chat_format}
SQL = {"op7_chat_format": OP7_SQL}
