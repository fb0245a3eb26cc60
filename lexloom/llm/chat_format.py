"""Chat formatting: a finite-state machine over roles and a declarative template emit segments with loss flags.

The rows of a conversation pass by in the order of their turns. A table of moves (state, role) -> state tells whether a turn
may follow; each turn becomes three segments: the mark that opens it, its text with control strings escaped, and
the mark that closes it. Only the text of a role that is trained on is under the loss. Rows stream through the task:
it holds one turn and one state, however long the conversation.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import partitions


@dataclass(frozen=True)
class ChatTemplate:
    """What a conversation looks like. ``labels`` names roles in their marks; other roles stand escaped after ``other``."""

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    mark: str = "### "
    after: str = ": "
    other: str = "role "
    close: str = "</turn>\n"
    escape: str = "\\"
    trained: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
    )
    final: frozenset[str] = frozenset({"answered"})

    def __post_init__(self):
        if not (self.mark and self.after and self.close) or len(self.escape) != 1 or any(self.escape in x for x in (self.mark, self.after, self.close)):
            raise ValueError("marks are not empty, and the escape is one character that no mark holds")
        if any(self.after in x or x.startswith(self.other) for x in self.labels.values()) or len(set(self.labels.values())) < len(self.labels) or self.after in self.other or self.escape in "".join([*self.labels.values(), self.other]):
            raise ValueError("labels differ from each other and from the names of other roles")

    def escaping(self, *controls: str):
        """A function that puts the escape before each character at which a control string, or the escape, begins."""
        starts = "|".join([re.escape(self.escape), *[re.escape(c[0]) + (f"(?={re.escape(c[1:])})" if c[1:] else "") for c in controls]])
        find = re.compile(starts)
        return lambda text: find.sub(lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", lambda m: m[1], text, flags=re.S)

    def opening(self, role: str) -> str:
        label = self.labels.get(role)
        return self.mark + (label if label is not None else self.other + self.escaping(self.after, self.mark, self.close)(role)) + self.after

    def role_of(self, label: str) -> str:
        """The role that an opening mark names."""
        for role, name in self.labels.items():
            if name == label:
                return role
        return self.unescaped(label.removeprefix(self.other))


class _Machine:
    """The state of one conversation."""

    def __init__(self, template: ChatTemplate):
        self.template, self.state, self.last = template, template.start, None

    def step(self, role: str) -> str | None:
        """Moves on; the fault of a role that may not follow, after which its own state is taken up where some move leads there."""
        to = self.template.moves.get((self.state, role))
        fault = None
        if to is None:
            fault = f"{role} after {self.last}" if self.last is not None else f"{role} first"
            to = next((v for (_, r), v in self.template.moves.items() if r == role), self.state)
        self.state, self.last = to, role
        return fault


_SEGMENT = pa.struct([("text", pa.string()), ("loss", pa.bool_())])


def _format(template: ChatTemplate):
    """Rows (conv, turn, role, text), in order, to (conv_id, place, role, segments, state, fault)."""

    def run(batches):
        escape = template.escaping(template.mark, template.close)
        conv, machine, place = object(), None, 0
        for batch in batches:
            out = []
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if machine is None or c != conv:
                    conv, machine, place = c, _Machine(template), 0
                role = role or ""
                fault = machine.step(role)
                trained = role in template.trained
                segments = [{"text": template.opening(role), "loss": False}, {"text": escape(text or ""), "loss": trained}, {"text": template.close, "loss": False}]
                out.append((c, place, role, segments, machine.state, fault))
                place += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.list_(_SEGMENT), pa.string(), pa.string()))], names=["conv_id", "place", "role", "segments", "state", "fault"]
            )

    return run


SHAPE = "conv_id long, place long, role string, segments array<struct<text:string,loss:boolean>>, state string, fault string"


def format_chats(turns: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, role, segments, state, fault): one row for each row of ``turns``; place counts from 0 in its conversation.

    The formatted conversation is the texts of all segments (text, loss) in the order of place. ``state`` is that of the machine after the turn,
    ``fault`` says which turn came out of order (null: none); such turns are formatted all the same. Turns are ordered by number
    (null first), then role, then text, so that repeated rows and ties come in one order. Null roles and texts are empty ones; null
    conversations are one of their own; roles that the template has no label for keep their name; other columns are not read; an
    empty table gives no rows. Rows of a conversation come next to each other and in order, within one partition.
    """
    template = template or ChatTemplate()
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    dealt = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return dealt.mapInArrow(_format(template), SHAPE)


class Reader:
    """Reads turns back from formatted text that comes in pieces, cut anywhere; knows the template only.

    Text under the loss has to be that of whole turns, which is checked.
    """

    def __init__(self, template: ChatTemplate):
        self.template, self.rest = template, []  # pieces (text, loss) of the turn that is not complete
        escape, mark, after, close = (re.escape(x) for x in (template.escape, template.mark, template.after, template.close))
        self.head = re.compile(f"{escape}.|{after}", re.S)
        self.body = re.compile("|".join([f"{escape}.", *sorted((mark, close), key=len, reverse=True)]), re.S)

    def _turn(self, whole: str, at: int) -> tuple[str, int, int, int] | None:
        """(label, start and end of the text, end) of the turn that begins at ``at``; None if it isn't complete."""
        t = self.template
        if not whole.startswith(t.mark, at):
            return None
        start = next((m for m in self.head.finditer(whole, at + len(t.mark)) if m[0] == t.after), None)
        if start is None:
            return None
        end = next((m for m in self.body.finditer(whole, start.end()) if m[0] in (t.mark, t.close)), None)
        if end is None:
            return None
        if end[0] == t.mark:
            raise ValueError("a mark stands inside a text")
        return whole[at + len(t.mark) : start.start()], start.end(), end.start(), end.end()

    def feed(self, text: str, loss: bool):
        """Yields (role, text, under the loss) of the turns that this piece completes."""
        self.rest.append((text, loss))
        if not text.endswith(self.template.close[-1]):
            return
        whole, at = "".join(t for t, _ in self.rest), 0
        while turn := self._turn(whole, at):
            label, start, end, after = turn
            covered, p = 0, 0
            for piece, flag in self.rest:
                lo, hi = max(p, at), min(p + len(piece), after)
                p += len(piece)
                if flag and lo < hi:
                    if lo < start or hi > end:
                        raise ValueError("the loss covers a mark")
                    covered += hi - lo
            if covered not in (0, end - start):
                raise ValueError("the loss covers a part of a text")
            yield self.template.role_of(label), self.template.unescaped(whole[start:end]), covered > 0
            at = after
        if at:
            rest, p = [], 0
            for piece, flag in self.rest:
                if p + len(piece) > at:
                    rest.append((piece[max(0, at - p) :], flag))
                p += len(piece)
            self.rest = rest

    def end(self) -> None:
        if any(t for t, _ in self.rest):
            raise ValueError("text is left that forms no turn")


class _Digest:
    """Running digests of one conversation, read back from its segments."""

    def __init__(self, conv, template: ChatTemplate):
        self.conv, self.reader, self.template = conv, Reader(template), template
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        self.state, self.fault = template.start, None

    def add(self, segments, state, fault, place) -> None:
        for segment in segments:
            self.chars += len(segment["text"])
            for role, text, loss in self.reader.feed(segment["text"], segment["loss"]):
                self.turns.update(f"{role}\n{text}\n".encode())
                self.n += 1
                if loss:
                    self.loss.update(text.encode())
                    self.loss_chars += len(text)
        self.state = state
        if fault is not None and self.fault is None:
            self.fault = f"turn {place}: {fault}"

    def row(self) -> tuple:
        self.reader.end()
        fault = self.fault if self.fault is not None or self.state in self.template.final else "no answer at the end"
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, fault


def _read_back(template: ChatTemplate):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "fault"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def run(batches):
        now = None
        for batch in batches:
            rows = []
            for c, place, segments, state, fault in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "place", "segments", "state", "fault")), strict=True):
                if now is None or c != now.conv:
                    if now is not None:
                        rows.append(now.row())
                    now = _Digest(c, template)
                now.add(segments, state, fault, place)
            yield made(rows)
        if now is not None:
            yield made([now.row()])

    return run


def read_back(formatted: DataFrame, template: ChatTemplate | None = None, arranged: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, fault): one row for each conversation.

    Everything is parsed out of the segments' texts and loss flags. ``formatted`` comes from ``format_chats``; with ``arranged`` it is
    its direct result, whose rows still come in order, else (a written table) they are put in order first. A conversation's
    digest is a sequence, so its turns pass through one task, one at a time. ``fault`` is the first turn out of order, or
    that the last one is no answer.
    """
    template = template or ChatTemplate()
    if not arranged:
        formatted = formatted.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place")
    return formatted.mapInArrow(_read_back(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, fault string")


#: A conversation whose texts hold the template's own marks and escape.
PROBE = (-7, r"\### Assistant: </turn> ok")


def op13_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE[0], 0, "user", PROBE[1]), (PROBE[0], 1, "assistant", PROBE[1])], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(turns.unionByName(probe)), arranged=True)


def brute_force(rows: list[tuple], trained: frozenset[str] = frozenset({"assistant"})) -> dict:
    """conv -> (turns, digest of turns, characters and digest of trained texts), without any template; for tests."""
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r in trained)
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


# Digests straight from the rows; the length of the formatted text from its marks and the escapes it needs.
OP13_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
placed AS (
  SELECT *, row_number() OVER w - 1 AS place, lag(role) OVER w AS last FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
marked AS (
  SELECT *, length('### ' || upper(left(role, 1)) || substr(role, 2) || ': ' || text || '</turn>' || chr(10))
      + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '### ', ''))) // 4
      + (length(text) - length(replace(text, '</turn>' || chr(10), ''))) // 8 AS chars,
    CASE WHEN last IS NULL AND role NOT IN ('system', 'user') THEN role || ' first'
      WHEN last IS NOT NULL AND (last, role) NOT IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) THEN role || ' after ' || last END AS fault
  FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars,
  CASE WHEN count(fault) > 0 THEN min_by('turn ' || place || ': ' || fault, place) FILTER (WHERE fault IS NOT NULL)
    WHEN max_by(role, place) <> 'assistant' THEN 'no answer at the end' END AS fault
FROM marked GROUP BY conv_id
"""
