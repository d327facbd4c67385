"""Chat formatting by incremental black-box rendering.

A template is any callable from a list of (role, text) to a string.  The operator renders successive
prefixes of a conversation and compares consecutive outputs: what a longer prefix adds is the new turn's
span.  Where a text lies inside its span is found by rendering the same prefix with a probe text instead.
A template that changes earlier output when a turn is added rewrites history; that is detected and
reported, never passed over.

Every prefix is rendered from the start, whatever the number of turns, so a span is what the template makes of the whole
prefix and a rewrite anywhere is seen.  The price is the method's: the characters rendered grow with the square of a
conversation's length, and one conversation is held in memory at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
#: Stands for a turn's text when the place of the text in its span is looked for.
PROBE = "\x02probe\x03"


class MarkedTemplate:
    r"""Turns as ``### role: text</turn>\n``; control strings inside are escaped reversibly.

    A backslash becomes ``\\``, ``###`` becomes ``\h``, ``</turn>`` becomes ``\t``; in roles a colon becomes
    ``\c`` as well.  So no mark can occur inside a text, and ``unescape`` restores every text exactly.
    """

    _back = {"\\\\": "\\", "\\h": "###", "\\t": "</turn>", "\\c": ":"}

    def escape(self, text: str) -> str:
        return text.replace("\\", "\\\\").replace("###", "\\h").replace("</turn>", "\\t")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\[\\htc]", lambda m: self._back[m[0]], text)

    @lru_cache(maxsize=8192)  # noqa: B019  prefixes repeat turns; the cache ends with the template
    def turn(self, turn: Turn) -> str:
        role, text = turn
        return f"### {self.escape(role).replace(':', chr(92) + 'c')}: {self.escape(text)}</turn>\n"

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(map(self.turn, turns))

    def role_of(self, span: str) -> str:
        return self.unescape(span[4 : span.index(": ")])


@dataclass
class Span:
    """A turn's part of the output; [lo, hi) of it is the text, ``rewrites`` if it changed earlier output."""

    text: str
    lo: int
    hi: int
    rewrites: bool


class Renderer:
    """Finds the spans of one conversation's turns, fed one by one."""

    def __init__(self, template: Callable[[list[Turn]], str]):
        self.template = template
        self.turns: list[Turn] = []
        self.before = ""
        self.chars = 0
        self.rewrites = False

    def _added(self, after: str) -> tuple[str, bool]:
        """What a rendering has after that of the turns so far, and whether it changes that."""
        if after.startswith(self.before):
            return after[len(self.before) :], False
        return after, True

    def add(self, turn: Turn) -> Span:
        probed, odd = self._added(self.template([*self.turns, (turn[0], PROBE)]))
        self.turns.append(turn)
        after = self.template(self.turns)
        span, bad = self._added(after)
        at = probed.find(PROBE)
        lo, hi = (0, 0) if at < 0 or odd or bad else (at, len(span) - (len(probed) - at - len(PROBE)))
        self.rewrites |= bad
        self.before = after
        self.chars += len(span)
        return Span(span, lo, hi, bad)


def _sorted_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with rows of a conversation together and in order.

    Nulls: roles and texts are empty, a null turn sorts first.  Rows with the same turn are ordered by role and
    text, so repeated rows have one defined order.  A null conv_id is a conversation of its own.
    """
    turns = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def spans(df: DataFrame, template=None) -> DataFrame:
    """One row per turn: conv_id, turn, role, the rendered span, [text_lo, text_hi) of the text in it, whether
    this turn is under the loss mask (role assistant), and whether it rewrote earlier output."""
    template = template or MarkedTemplate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, renderer = object(), None
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if conv != last:
                    last, renderer = conv, Renderer(template)
                s = renderer.add((role, text))
                rows.append({"conv_id": conv, "turn": turn, "role": role, "span": s.text, "text_lo": s.lo, "text_hi": s.hi, "loss": role == "assistant", "rewrites": s.rewrites})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kind = dict(df.dtypes)
    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, span string, text_lo long, text_hi long, loss boolean, rewrites boolean"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return _sorted_turns(df).mapInArrow(run, schema)


def conversations(df: DataFrame, template=None) -> DataFrame:
    """One row per conversation, read back from the rendered output.

    n_turns; turns_sha256 (hex digest of role, newline, text, newline of each turn, as parsed from the spans);
    loss_chars and loss_sha256 (unescaped text under the loss mask); formatted_chars; rewrites_history.  With no
    rows there are no conversations.
    """
    template = template or MarkedTemplate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out = object(), None, []

        def close() -> None:
            if state is not None:
                renderer, n, turns, loss, chars = state
                out.append({"conv_id": last, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": renderer.chars, "rewrites_history": renderer.rewrites})

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != last or state is None:
                    close()
                    last, state = conv, [Renderer(template), 0, hashlib.sha256(), hashlib.sha256(), 0]
                renderer = state[0]
                s = renderer.add((role, text))
                back = template.unescape(s.text[s.lo : s.hi])
                state[1] += 1
                state[2].update(f"{template.role_of(s.text)}\n{back}\n".encode())
                if role == "assistant":
                    state[3].update(back.encode())
                    state[4] += len(back)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    schema = f"conv_id {dict(df.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return _sorted_turns(df).mapInArrow(run, schema)


#: The adversarial conversation that op2 adds: both texts hold marks and an escape.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def with_probe(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    rows = [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)]
    return df.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t')) AS nt,
  length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c')) AS nr FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(nr + nt + 4 + 2 + 8) AS BIGINT) AS formatted_chars,
  false AS rewrites_history
FROM e GROUP BY conv_id
"""
