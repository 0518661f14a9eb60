"""Chat formatting in budgeted windows.

Turns of a conversation are cut into windows of at most BUDGET tokens, at turn borders, by
running sums of turn tokens, counted over formatted turns: template and escapes are paid
for, and each turn costs a token at least, so no run of empty texts outgrows a window. Every
window opens with the system turn in force, that which leads the conversation or the last one
that an earlier window showed, and repeats turns from the end of the window before it, HISTORY
tokens of them at most and none from before a system turn. The loss mask covers assistant texts, each in the one window where it is new.

Template: `<s>[INST] text [/INST]` for users, ` text</s>` for assistants, and
`[ROLE]role[/ROLE] text</s>` for any other role. Control strings inside texts and roles get
a backslash after their first character and backslashes are doubled, which read() undoes.

Conversations are dealt by conv_id and read in turn order as a stream: a task holds one
window, however long the conversation is.

Defined cases: null text or role is empty; a null conv_id is one conversation; a null turn
comes first; rows with equal turn follow each other by role and text, and repeated rows are
repeated turns; a turn over the budget is a window of its own, not cut; a system turn that
leaves no room is still retained; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, map_arrow

BUDGET, HISTORY = 1024, 256
# The template's control strings.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?)</s>|\[ROLE\](?P<role>.*?)\[/ROLE\] (?P<other>.*?)</s>", re.DOTALL)
_WINDOW = "conv_id long, window long, n_repeated int, tokens long, over_budget boolean, text string, loss array<struct<start: int, end: int>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn(role: str, text: str) -> tuple[str, int]:
    """A formatted turn, and where its escaped text starts."""
    body = escape(text)
    if role == "user":
        return f"<s>[INST] {body} [/INST]", 10
    if role == "assistant":
        return f" {body}</s>", 1
    mark = f"[ROLE]{escape(role)}[/ROLE] "
    return f"{mark}{body}</s>", len(mark)


def turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError("not a formatted window")
        if m["user"] is not None:
            out.append(("user", unescape(m["user"])))
        elif m["assistant"] is not None:
            out.append(("assistant", unescape(m["assistant"])))
        else:
            out.append((unescape(m["role"]), unescape(m["other"])))
        at = m.end()
    return out


class Tokens:
    """Token counts by a byte-level BPE given as ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def get(cls, path: str, pattern: str) -> Tokens:
        kept = keep(__name__)
        if path not in kept:
            kept[path] = cls(path, pattern)
        return kept[path]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; one of more than LONG code points is counted piece by piece, as its pattern overflows on very long runs."""
        return [sum(len(self.encoding.encode_ordinary(p)) for p in pieces(t)) for t in texts]


LONG = 10_000


def pieces(text: str, most: int = LONG) -> list[str]:
    """The text in parts of at most so many code points, cut before a lone blank between other characters where there is one."""
    out, at = [], 0
    while len(text) - at > most:
        end = at + most
        cut = text.rfind(" ", at + 1, end)
        while cut > at and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.rfind(" ", at + 1, cut)
        cut = end if cut <= at else cut
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


class _Windows:
    """One conversation's turns in, finished windows out."""

    def __init__(self, conv: int | None, budget: int, history: int) -> None:
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple[str, int, int, str] | None = None
        self.held: list[tuple[str, int, int, str]] = []  # formatted turn, where its text starts, tokens, role
        self.sums = [0]  # prefix sums of their tokens
        self.repeated, self.number, self.seen = 0, 0, 0

    def add(self, role: str, shown: str, at: int, tokens: int):
        """Take a turn formatted by turn()."""
        item = (shown, at, tokens, role)
        base = self.system[2] if self.system else 0
        if len(self.held) > self.repeated and base + self.sums[-1] + tokens > self.budget:
            yield self.window()
            later = [x for x in self.held[self.repeated :] if x[3] == "system"]
            if later:
                self.system = later[-1]
                base = self.system[2]
            # repeat the longest run of last turns within the history budget that leaves room for the new turn
            k = len(self.held)
            while k and self.held[k - 1][3] != "system" and self.sums[-1] - self.sums[k - 1] <= self.history and base + self.sums[-1] - self.sums[k - 1] + tokens <= self.budget:
                k -= 1
            self.held = self.held[k:]
            self.repeated = len(self.held)
            self.sums = [0]
            for x in self.held:
                self.sums.append(self.sums[-1] + x[2])
        self.seen += 1
        if self.seen == 1 and role == "system":
            self.system = item
            return
        self.held.append(item)
        self.sums.append(self.sums[-1] + tokens)

    def window(self):
        parts = ([self.system] if self.system else []) + self.held
        skip = (1 if self.system and self.number else 0) + self.repeated
        text, loss, at = [], [], 0
        for i, (shown, start, _, role) in enumerate(parts):
            if role == "assistant" and i >= skip:
                loss.append({"start": at + start, "end": at + len(shown) - len("</s>")})
            text.append(shown)
            at += len(shown)
        tokens = sum(x[2] for x in parts)
        self.number += 1
        return self.conv, self.number - 1, skip, tokens, tokens > self.budget, "".join(text), loss

    def end(self):
        if len(self.held) > self.repeated or self.system and not self.number:
            yield self.window()


def windows(conversations: DataFrame, tokenizer: str, pattern: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_repeated, tokens, over_budget, text, loss): formatted windows, each conversation's in order.

    n_repeated leading turns were shown before; loss has the code-point ranges under the mask.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        counter = Tokens.get(tokenizer, pattern)
        state: _Windows | None = None
        names = ["conv_id", "window", "n_repeated", "tokens", "over_budget", "text", "loss"]
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), spans]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                roles, out = part.column("role").to_pylist(), []
                formatted = [turn(role, text) for role, text in zip(roles, part.column("text").to_pylist())]
                sizes = counter.counts([shown for shown, _ in formatted])
                for conv, role, (shown, start), n in zip(part.column("conv_id").to_pylist(), roles, formatted, sizes):
                    if state is None or state.conv != conv:
                        if state is not None:
                            out += state.end()
                        state = _Windows(conv, budget, history)
                    out += state.add(role, shown, start, n)
                yield batch(out)
        if state is not None:
            yield batch(list(state.end()))

    return map_arrow(dealt, run, _WINDOW)


def read(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, read back from their windows as windows() gives them, in order within each partition.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows)
    """

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        now: list | None = None  # conv, turns, digest, loss chars, loss digest, chars, windows

        def row():
            return (*now[:2], now[2].hexdigest(), now[3], now[4].hexdigest(), *now[5:])

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            out = []
            for conv, number, skip, text, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "window", "n_repeated", "text", "loss"))):
                if now is None or number == 0:
                    if now is not None:
                        out.append(row())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in turns(text)[skip:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    now[3] += len(said)
                    now[4].update(said.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
                now[6] += 1
            yield batch(out)
        if now is not None:
            yield batch([row()])

    return map_arrow(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
