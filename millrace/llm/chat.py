"""Chat formatting: event-sourced reconstruction.

A log of events (conversation, message, sequence, kind, role, text) is folded into final
messages and these are rendered by a template. Kinds: ``message`` begins a message, ``delta``
appends to it, ``edit`` replaces its text, ``regenerate`` empties it so that later deltas fill
it anew. Events that address a message before it began begin it.

Two passes, neither of which holds a conversation in memory: the fold is dealt by
(conversation, message), so that a conversation with a third of all events is spread over
tasks; the digests stream each conversation's final messages in order through a writer and a
reader of the growing string, keeping one turn and running digests. ``render`` returns the whole
string of each conversation, so it holds the one it writes.

The template writes user turns as ``<s>[INST] text [/INST]``, assistant turns as
`` text </s>``, system turns as ``<<SYS>> text <</SYS>>`` and any other role as
``<<ROLE>>role<</ROLE>>text<</TURN>>``. In texts a backslash is doubled and a control string
gets a backslash after its first character; reading drops them again.

Null text is empty, null role is the empty role, a null conversation id is a conversation of
its own. Equal sequence numbers are ordered by kind, role and text; repeated message rows are
messages of their own.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<<TURN>>", "<</TURN>>")
ESCAPED = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
FRAMES = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>> (?P<system>.*?) <</SYS>>|<<ROLE>>(?P<role>.*?)<</ROLE>>(?P<other>.*?)<</TURN>>| (?P<assistant>.*?) </s>", re.S)


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def render_turn(role: str, text: str) -> str:
    if role in FRAMES:
        a, b = FRAMES[role]
        return a + escape(text) + b
    return f"<<ROLE>>{escape(role)}<</ROLE>>{escape(text)}<</TURN>>"


def read_turns(formatted: str):
    """(role, text, loss, end) of each whole turn that a rendered string begins with; loss: it stands under the loss mask."""
    at = 0
    while m := TURN.match(formatted, at):
        at = m.end()
        if m["other"] is not None:
            yield unescape(m["role"]), unescape(m["other"]), False, at
        else:
            role = next(r for r in FRAMES if m[r] is not None)
            yield role, unescape(m[role]), role == "assistant", at


def fold_messages(events: DataFrame) -> DataFrame:
    """(conv, msg, part, again, role, text): final messages of events with conv, msg, seq, kind, role, text.

    part tells messages of one number apart, where the log has such a column; again counts the
    messages that begin anew under one number.
    """

    def start():
        current: list | None = None
        again = 0

        def row(c):
            return {"conv": c[0], "msg": c[1], "part": c[2], "again": c[3], "role": c[4], "text": "".join(c[5])}

        def step(conv, msg, part, seq, kind, role, text):
            nonlocal current, again
            done = []
            for c, m, p, k, r, t in zip(conv or (), msg or (), part or (), kind or (), role or (), text or (), strict=True):
                same = current is not None and current[:3] == [c, m, p]
                if not same or k == "message":
                    if current:
                        done.append(row(current))
                    again = again + 1 if same else 0
                    current = [c, m, p, again, r or "", [t or ""]]
                elif k == "delta":
                    current[5].append(t or "")
                elif k in ("edit", "regenerate"):
                    current[5] = [t or ""]
                else:
                    raise ValueError(f"unknown kind of event: {k!r}")
            if conv is None and current:
                done.append(row(current))
            if done:
                yield {n: [d[n] for d in done] for n in ("conv", "msg", "part", "again", "role", "text")}

        return step

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    log = events if "part" in kinds else events.withColumn("part", F.lit(0).cast("long"))
    rank = F.when(F.col("kind") == "message", 0).otherwise(1)
    dealt = log.repartition("conv", "msg", "part").sortWithinPartitions("conv", "msg", "part", "seq", rank, "kind", "role", "text")
    return arrow_map(dealt, ["conv", "msg", "part", "seq", "kind", "role", "text"], f"conv {kinds['conv']}, msg {kinds['msg']}, part long, again long, role string, text string", start)


def by_conversation(messages: DataFrame) -> DataFrame:
    """Messages of one number are in order of role and text."""
    return messages.repartition("conv").sortWithinPartitions("conv", "msg", "role", "text", "part", "again")


def render(messages: DataFrame) -> DataFrame:
    """(conv, formatted): one string per conversation, the general output."""

    def start():
        now, out = [], []

        def step(conv, msg, role, text):
            nonlocal now, out
            done = []
            for c, r, t in zip(conv or (), role or (), text or (), strict=True):
                if out and now != [c]:
                    done.append((now[0], "".join(out)))
                    out = []
                now = [c]
                out.append(render_turn(r, t))
            if conv is None and out:
                done.append((now[0], "".join(out)))
            if done:
                yield {"conv": [d[0] for d in done], "formatted": [d[1] for d in done]}

        return step

    return arrow_map(by_conversation(messages), ["conv", "msg", "role", "text"], f"conv {messages.schema['conv'].dataType.simpleString()}, formatted string", start)


class Digest:
    """Reads a conversation's rendered stream as it grows; what isn't a whole turn yet waits in rest."""

    def __init__(self, conv):
        self.conv, self.n, self.chars, self.loss_chars, self.rest = conv, 0, 0, 0, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        self.chars += len(formatted)
        self.rest += formatted
        at = 0
        for role, text, loss, at in read_turns(self.rest):  # noqa: B007
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if loss:
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.rest = self.rest[at:]

    def row(self) -> dict:
        if self.rest:
            raise ValueError(f"a turn of conversation {self.conv} doesn't end")
        return {"conv_id": self.conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def render_digests(messages: DataFrame) -> DataFrame:
    """Digests read back from the rendered turns, one row per conversation; holds one turn at a time."""

    def start():
        now: Digest | None = None

        def step(conv, msg, role, text):
            nonlocal now
            done = []
            for c, r, t in zip(conv or (), role or (), text or (), strict=True):
                if now is None or now.conv != c:
                    if now:
                        done.append(now.row())
                    now = Digest(c)
                now.add(render_turn(r, t))
            if conv is None and now:
                done.append(now.row())
            if done:
                yield {n: [d[n] for d in done] for n in done[0]}

        return step

    kind = messages.schema["conv"].dataType.simpleString()
    return arrow_map(by_conversation(messages), ["conv", "msg", "role", "text"], f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", start)


DELTAS = 3


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as the log of a chat that streamed them.

    By a hash, a turn is begun empty and comes in deltas; or is begun by a draft that a
    regeneration drops before the deltas; or streams a draft that an edit replaces; or comes whole.
    Rows equal in conversation, turn, role and text are counted first and get a part of their own each.
    """
    turns = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").alias("msg"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    each = turns.groupBy("conv", "msg", "role", "text").agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    each = each.withColumn("part", F.xxhash64("role", "text", "copy"))

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    step = F.ceil(F.length("text") / DELTAS).cast("int")
    deltas = [event("delta", F.substring(F.col("text"), F.lit(i) * step + 1, step)) for i in range(DELTAS)]
    draft, none = F.reverse(F.substring("text", 1, 40)), F.lit("")
    way = F.pmod("part", F.lit(4))
    log = F.when(way == 0, F.array(event("message", none), *deltas)).when(way == 1, F.array(event("message", draft), event("regenerate", none), *deltas))
    log = log.when(way == 2, F.array(event("message", none), event("delta", draft), event("edit", F.col("text")))).otherwise(F.array(event("message", F.col("text"))))
    return each.select("conv", "msg", "part", "role", F.posexplode(log).alias("seq", "e")).select("conv", "msg", "part", F.col("seq").cast("long").alias("seq"), "e.kind", "role", "e.text")
