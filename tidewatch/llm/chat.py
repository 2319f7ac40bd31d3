"""Chat formatting from event logs, with Spark's own functions only.

A log holds what a chat server writes: messages are opened, streamed in deltas, edited and
regenerated. Logs are partitioned by conversation and message, sorted by sequence and folded into
final messages; these are partitioned by conversation and rendered. A loss mask says which parts of
the rendered text a model is trained on.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: kinds of events; a delta appends its text, the others replace what the message holds by theirs
OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"


def _quoted(s: str) -> str:
    return f"\\Q{s}\\E"


@dataclass(frozen=True)
class Template:
    """A turn is opening, role, separator, text, closing. Inside roles and texts the escape
    character is doubled, and one is put behind the first character of every marker or reserved
    string, so the rendered text has markers only where a turn has them, and can be read back."""

    opening: str = "<|im_start|>"
    separator: str = "<|im_sep|>"
    closing: str = "<|im_end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    escape: str = "\\"
    trained: str = "assistant"

    def __post_init__(self) -> None:
        for c in self.controls:
            if len(c) < 2 or self.escape in c or "\\E" in c:
                raise ValueError(f"cannot be escaped: {c!r}")
            for m, k in product((self.opening, self.separator, self.closing), range(1, len(c))):
                head, tail = c[:k], c[k:]
                if m.startswith(tail) or tail.startswith(m) or m.endswith(head) or head.endswith(m):
                    raise ValueError(f"the end of a text and {m!r} could make {c!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.opening, self.separator, self.closing, *self.reserved)

    def escaped(self, text: Column) -> Column:
        behind: dict[str, list[str]] = {}
        for c in self.controls:
            behind.setdefault(c[0], []).append(c[1:])
        pattern = "|".join(f"{_quoted(a)}(?=" + "|".join(map(_quoted, rest)) + ")" for a, rest in behind.items())
        doubled = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        return F.regexp_replace(doubled, pattern, "$0" + ("\\" + self.escape))

    def unescaped(self, text: Column) -> Column:
        e = _quoted(self.escape)
        return F.regexp_replace(text, f"{e}({e})?", "$1")

    def turn(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.opening), self.escaped(role), F.lit(self.separator), self.escaped(text), F.lit(self.closing))

    def turns(self, formatted: Column) -> Column:
        """The roles and texts of a rendered conversation: array<struct<role, text>>."""
        parts = F.split(formatted, _quoted(self.opening), -1)
        parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        sides = F.transform(parts, lambda p: F.split(p, _quoted(self.separator), -1))
        inner = lambda t: F.substring_index(t, self.closing, 1)
        return F.transform(sides, lambda s: F.struct(self.unescaped(s[0]).alias("role"), self.unescaped(inner(s[1])).alias("text")))


def log_of_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str, piece: int = 256) -> DataFrame:
    """Finished turns as the log they would have left: an opening, then the text in deltas of
    `piece` code points. Rows of a conversation with one turn are ordered by role and a digest of the
    text; a row that occurs twice is two messages. Nulls come first, and a null text is empty."""
    counted = rows.groupBy(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).agg(
        F.count(F.lit(1)).cast("int").alias("n")
    )
    one = counted.select("conv", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    message = F.struct("turn", "role", F.md5("text").alias("digest"), "copy")
    # substring counts from the start of the string, so a long text is cut in two steps
    pieces = F.flatten(F.transform(_cut(F.col("text"), piece * 64), lambda t: _cut(t, piece)))
    parts = F.concat(F.array(F.lit("")), F.coalesce(pieces, F.array().cast("array<string>")))
    found = one.select("conv", "role", message.alias("message"), F.posexplode(parts).alias("at", "piece"))
    opens = F.col("at") == 0
    return found.select(
        "conv", "message", F.struct("message", "at").alias("seq"), F.when(opens, F.lit(OPEN)).otherwise(F.lit(DELTA)).alias("kind"),
        F.when(opens, F.col("role")).alias("role"), F.when(~opens, F.col("piece")).alias("text"),
    )


def _cut(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(0), F.ceil(F.greatest(F.char_length(text), F.lit(1)) / F.lit(size)).cast("int") - 1)
    return F.transform(starts, lambda i: F.substr(text, i * size + 1, F.lit(size)))


def fold_events(log: DataFrame) -> DataFrame:
    """conv, first (sequence of its first event), message, role, text: the final messages of a log of
    conv, message, seq, kind, role, text, whose keys and sequence are of any sortable type.

    Events of a message count in the order of seq; one that was delivered twice counts once. `open`,
    `edit` and `regenerate` set the text to their own (null: empty), `delta` appends its own. The last
    role that is not null holds. A regeneration also discards the other messages that were opened
    between the first event of its message and itself, with all their events. Events of other kinds
    do nothing. Nulls in conv or message are a group of their own; a null seq comes first. Columns
    of other names are not read; an empty log has no messages.
    """
    known = log.filter(F.col("kind").isin(OPEN, DELTA, EDIT, REGENERATE))
    event = F.struct("seq", "kind", "role", "text")
    # a hot conversation is split by its messages
    events = known.groupBy("conv", "message").agg(F.array_sort(F.collect_set(event)).alias("e"))
    last_set = F.coalesce(F.array_max(F.transform("e", lambda e, i: F.when(e["kind"] != DELTA, i))), F.lit(0))
    since = F.slice("e", last_set + 1, F.size("e"))
    folded = events.select(
        "conv", "message",
        F.col("e")[0]["seq"].alias("first"),
        F.array_max(F.transform("e", lambda e: F.when(e["kind"] == REGENERATE, e["seq"]))).alias("again"),
        F.try_element_at(F.array_compact(F.transform("e", lambda e: e["role"])), F.lit(-1)).alias("role"),
        F.array_join(F.transform(since, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
    )
    before = W.partitionBy("conv").orderBy("first", "message").rowsBetween(W.unboundedPreceding, -1)
    covered = folded.withColumn("until", F.max("again").over(before))
    gone = F.coalesce(F.col("until") > F.col("first"), F.lit(False))
    return covered.filter(~gone).select("conv", "first", "message", "role", "text")


def render(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each conversation of `fold_events`: conv, n_turns, formatted, and the parts of it
    under the loss mask (texts of the trained role, in order) as code points, `loss`, and as bytes of
    UTF-8, `loss_bytes`: array<struct<from, to>>, [from, to).

    Null roles and texts are rendered as empty. A conversation is one value, so it ends at 2 GB.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    shown = messages.select(
        "conv", "first", "message", template.turn(role, text).alias("turn"), (role == template.trained).alias("trained"),
        F.concat(F.lit(template.opening), template.escaped(role), F.lit(template.separator)).alias("head"), template.escaped(text).alias("body"),
    )
    before = W.partitionBy("conv").orderBy("first", "message").rowsBetween(W.unboundedPreceding, -1)

    def span(length) -> Column:
        start = F.coalesce(F.sum(length("turn")).over(before), F.lit(0)) + length("head")
        return F.struct(start.alias("from"), (start + length("body")).alias("to"))

    placed = shown.withColumns({"chars": span(F.char_length), "bytes": span(F.octet_length)})
    turns = placed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("first", "message", "turn", "trained", "chars", "bytes"))).alias("t"))
    trained = F.filter("t", lambda t: t["trained"])
    return turns.select(
        "conv", F.size("t").cast("bigint").alias("n_turns"), F.array_join(F.transform("t", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(trained, lambda t: t["chars"]).alias("loss"), F.transform(trained, lambda t: t["bytes"]).alias("loss_bytes"),
    )


def read_back(rendered: DataFrame, template: Template = Template()) -> DataFrame:
    """conv, turns (array<struct<role, text>>), trained (the text under the mask, unescaped, nothing
    between its parts) and formatted, read from `formatted` and `loss_bytes` alone."""
    raw = F.encode("formatted", "UTF-8")
    parts = F.transform("loss_bytes", lambda s: template.unescaped(F.decode(F.substr(raw, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")), "UTF-8")))
    return rendered.select("conv", template.turns(F.col("formatted")).alias("turns"), F.array_join(parts, "").alias("trained"), "formatted")
