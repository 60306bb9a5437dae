r"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string; nothing else is known of it. Successive turn
prefixes of a conversation are rendered and each output is compared with the one before: what is new is the turn's
span, and if the old output is no prefix of the new one, the template rewrites history and the conversation is marked.

What stands in a span is found out by probes, which are renderings with another last turn:

* Two other texts show where the text's place begins and ends.
* The roles of the conversation, each with the span's own text, show which role the span speaks for: the one whose
  rendering is the span itself. A role is read back only if no other known role renders the same.
* Each distinct character of a text, put between two marks, shows how the template writes it. These written forms are
  the template's escapes; a span's text is read back with them, longest form first.

Rendering every prefix costs the square of a conversation's length. Prefixes are therefore rendered whole up to WHOLE
turns; of a longer conversation each turn is rendered on the last CONTEXT turns, and the whole prefix is rendered
whenever it has grown by a half, and at the end, and held against what the spans add up to. Where that differs, the
template looks further back: the conversation's spans are then found from whole prefixes alone. So a change of history
is found at any distance; only one that a template undoes before the next whole rendering stays unseen.

The template given here marks turns with control strings and writes `\` as `\\`, `<` as `\l` and `[` as `\b` in
texts, so that no text can hold a control string and every text comes back.

Null texts and roles are empty, null turns come first, rows of the same turn are ordered by role and text. A
conversation without rows does not exist; an empty table gives no rows; extra columns are ignored. Rows of a null
conv_id are one conversation. A conversation is held by one task, as its rendering is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmap.llm.common import plain, text_of

SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean, exact boolean"
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: Turns up to which every prefix is rendered whole; turns that later ones are rendered on.
WHOLE, CONTEXT = 64, 6
LEARNED = "assistant"

_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}


def escape(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: _ESCAPES[m[0]], text)


def inst_template(turns: list[Turn]) -> str:
    out = []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"<s>[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f" {body} </s>")
        else:
            out.append(f"<s>[ROLE {escape(role)}] {body} [/ROLE]")
    return "".join(out)


def common(a: str, b: str) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


class Written:
    """How a template writes characters: learned by rendering each one between two marks."""

    MARKS = "qz"

    def __init__(self, template: Template):
        self.template = template
        self.forms: dict[str, str] = {}

    def learn(self, text: str) -> None:
        for c in set(text) - self.forms.keys():
            a, b = self.MARKS
            with_it, without = (self.template([("user", x)]) for x in (a + c + b, a + b))
            at = common(with_it, without)
            # the form stands between the marks; a form that begins like the second mark moves the border back
            at = with_it.rfind(a, 0, at) + 1
            form = with_it[at : len(with_it) - (len(without) - at)]
            self.forms[c] = form

    def back(self, body: str, text: str) -> str:
        """The text that a body was written from, read with the forms of the characters met so far."""
        self.learn(text)
        changed = {f: c for c, f in self.forms.items() if f and f != c}
        if not changed:
            return body
        return re.sub("|".join(map(re.escape, sorted(changed, key=len, reverse=True))), lambda m: changed[m[0]], body)


@dataclass
class Span:
    text: str
    begin: int
    end: int
    role: str
    body: str
    exact: bool


class Spans:
    """Locates the turns of one conversation, one by one."""

    def __init__(self, template: Template, written: Written | None = None):
        self.render, self.turns, self.spans = template, [], []
        self.written = written or Written(template)
        self.roles = ["user", "assistant", "system"]
        self.rewrites = self.whole = False
        self.done, self.checked = "", 0

    def add(self, role: str, text: str) -> None:
        if role not in self.roles:
            self.roles.append(role)
        whole = self.whole or len(self.turns) < WHOLE
        before = self.turns[:] if whole else self.turns[-CONTEXT:]
        done = self.done if whole else self.render(before)
        out = self.render([*before, (role, text)])
        self.turns.append((role, text))
        base = len(done)
        if not out.startswith(done):
            if not whole:
                self.start_over()
                return
            base, self.rewrites, self.whole = common(done, out), True, True
        self.spans.append(self.located(before, base, out, role, text))
        self.done = out
        if whole:
            self.checked = len(self.turns)
        elif 2 * len(self.turns) >= 3 * self.checked:
            self.check()

    def located(self, before: list[Turn], base: int, out: str, role: str, text: str) -> Span:
        span = out[base:]
        a, b = (self.render([*before, (role, x)])[base:] for x in ("a", "b"))
        begin = common(a, b)
        end = max(begin, len(span) - (len(a) - begin - 1))
        same = [r for r in self.roles if r == role or self.render([*before, (r, text)])[base:] == span]
        back = self.written.back(span[begin:end], text)
        return Span(span, begin, end, same[0] if len(same) == 1 else role, back, len(same) == 1 and back == text)

    def check(self) -> None:
        """Holds the whole rendering against the spans."""
        self.checked = len(self.turns)
        if self.render(self.turns) != "".join(s.text for s in self.spans):
            self.start_over()

    def start_over(self) -> None:
        """Finds all spans from whole prefixes."""
        turns, self.turns, self.spans, self.done, self.whole = self.turns, [], [], "", True
        for role, text in turns:
            self.add(role, text)

    def end(self) -> None:
        if self.checked < len(self.turns):
            self.check()


class Conversation:
    """Digests of one conversation, read back from the spans of its formatted text."""

    def __init__(self, conv: int | None, template: Template, keep: bool, written: Written):
        self.conv, self.keep = conv, keep
        self.spans = Spans(template, written)

    def row(self) -> tuple:
        self.spans.end()
        turns, loss, loss_chars, chars, mask = hashlib.sha256(), hashlib.sha256(), 0, 0, []
        for s in self.spans.spans:
            turns.update(f"{s.role}\n{s.body}\n".encode())
            if s.role == LEARNED:
                loss.update(s.body.encode())
                loss_chars += len(s.body)
                mask.append([chars + s.begin, chars + s.end])
            chars += len(s.text)
        own = ()
        if self.keep:  # after a change of history the last rendering is the conversation, and its spans are not in it
            own = (self.spans.render(self.spans.turns) if self.spans.rewrites else "".join(s.text for s in self.spans.spans), [] if self.spans.rewrites else mask)
        exact = all(s.exact for s in self.spans.spans)
        return (self.conv, len(self.spans.spans), turns.hexdigest(), loss_chars, loss.hexdigest(), chars, self.spans.rewrites, exact, *own)


def format_chats(conversations: DataFrame, template: Template = inst_template, keep: bool = False) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> one row each; with keep, also `formatted` and `loss_spans`.

    exact: every role and text was read back from the rendering as it was put in.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()] + ([pa.string(), pa.list_(pa.list_(pa.int64()))] if keep else [])
    schema = SCHEMA + (", formatted string, loss_spans array<array<long>>" if keep else "")
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, written = None, [], Written(template)

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            return out

        for b in batches:
            for conv, role, text in zip(b.column(0).to_pylist(), text_of(b.column(1)).to_pylist(), text_of(b.column(2)).to_pylist()):
                if now is None or conv != now.conv:
                    if now is not None:
                        rows.append(now.row())
                    if len(rows) >= 2000:
                        yield batch()
                    now = Conversation(conv, template, keep, written)
                now.spans.add(role, text)
        if now is not None:
            rows.append(now.row())
        if rows:
            yield batch()

    own = plain(conversations, "conv_id", "turn", "role", "text")
    dealt = own.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, schema)
