r"""Chat formatting with a grammar round trip.

A turn is rendered as "### Role: ", its text, a line feed and "</turn>" with another line
feed. A deterministic parser reads it back: an unescaped "</turn>" ends a turn, an unescaped
"###" begins one, and one backslash before either makes it plain text. A rendered turn is
parsed at once and compared with its source; while they differ, the text's control strings
get one more backslash each. Each turn parses alone, so that a conversation is the plain
concatenation of its turns, written as one row a turn: no row grows with the length of a
conversation. Reading back streams over the sorted rows, one running digest at a time, so
that a conversation with a third of all rows needs no more memory than any other.

Defined cases: a null text or role is empty; null conv_ids make one conversation; nulls in turn come first; ties
in turn go by role, then text; repeated rows are repeated turns; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relayloom.llm.common import chunks

CONTROL = re.compile(r"###|</turn>")
_ESCAPED = re.compile(r"\\(###|</turn>)")
_HEADER = re.compile(r"### ([^:\n#]*): ")
NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
_ROLES = {v: k for k, v in NAMES.items()}
#: The role whose texts are under the loss mask.
LEARNED = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(text: str) -> list[tuple[str, int, int]] | None:
    """(role, start, end) of the turns' texts, still escaped; None where the grammar is broken."""
    turns, at = [], 0
    while at < len(text):
        head = _HEADER.match(text, at)
        if head is None:
            return None
        name = head[1]
        role = _ROLES.get(name)
        if role is None:
            if not name.startswith("role="):
                return None
            role = unquote(name[5:])
        start, end = head.end(), None
        for mark in CONTROL.finditer(text, start):
            if text[mark.start() - 1] == "\\" and mark.start() > start:
                continue
            if mark[0] == "###":
                end = at = mark.start()
            elif mark.start() > start and text[mark.start() - 1] == "\n" and text[mark.end() : mark.end() + 1] == "\n":
                end, at = mark.start() - 1, mark.end() + 1
            else:
                return None
            break
        if end is None:
            return None
        turns.append((role, start, end))
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and where its text is in it; parses to exactly (role, text)."""
    shown = text
    head = f"### {NAMES.get(role) or 'role=' + quote(role, safe='')}: "
    for _ in range(3):
        out = f"{head}{shown}\n</turn>\n"
        got = parse(out)
        if got is not None and len(got) == 1 and got[0][0] == role and unescape(out[got[0][1] : got[0][2]]) == text:
            return out, got[0][1], got[0][2]
        shown = escape(shown)
    raise ValueError("a turn doesn't survive the round trip")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted, and the part of formatted under the loss mask: loss_start,
    loss_end (code points, still escaped; both 0 for other roles). Concatenate formatted in the order of turn, role, text."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = conversations.sparkSession.createDataFrame([], "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_end long").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            made = [render(r, t) for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist())]
            learned = [r == LEARNED for r in part.column("role").to_pylist()]
            spans = [[m[k] if y else 0 for m, y in zip(made, learned)] for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([m[0] for m in made], pa.string()), *(pa.array(s, pa.int64()) for s in spans)], names=out.names)

    return rows.mapInArrow(run, out)


class _Conversation:
    """Running totals over the formatted turns of one conversation."""

    def __init__(self):
        self.turns = self.loss = self.chars = 0
        self.all, self.learned = sha256(), sha256()

    def add(self, formatted: str, loss_start: int, loss_end: int) -> None:
        self.chars += len(formatted)
        for role, start, end in parse(formatted):
            text = unescape(formatted[start:end])
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if loss_end > loss_start:
            text = unescape(formatted[loss_start:loss_end])
            self.loss += len(text)
            self.learned.update(text.encode())

    def row(self, conv_id) -> tuple:
        return conv_id, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted turns alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""
    out = formatted.sparkSession.createDataFrame([], "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").schema
    sort = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = formatted.repartition("conv_id").sortWithinPartitions(*sort).select("conv_id", "formatted", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, now, at, done = to_arrow_schema(out), None, None, []
        for part in chunks(batches):
            for conv_id, *turn in zip(*(c.to_pylist() for c in part.columns)):
                if now is None or conv_id != at:
                    if now is not None:
                        done.append(now.row(at))
                    now, at = _Conversation(), conv_id
                now.add(*turn)
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if now is not None:
            done.append(now.row(at))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return rows.mapInArrow(run, out)


def oracle(odd: str) -> str:
    """read_back(format_turns(conversations and conversation -7)) in DuckDB's SQL; `odd` is the text of its two turns."""
    quoted = odd.replace("'", "''")
    names = " ".join(f"when '{k}' then '{v}'" for k, v in NAMES.items())
    return f"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '{quoted}'), (-7, 1, '{LEARNED}', '{quoted}')),
shown as (select *, length('### : ') + length(case role {names} else 'role=' || url_encode(role) end) + length(text) + length('.</turn>.')
  + (length(text) - length(replace(text, '###', ''))) // 3 + (length(text) - length(replace(text, '</turn>', ''))) // 7 as chars from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = '{LEARNED}' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = '{LEARNED}'), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars
from shown group by conv_id"""
