"""Chat formatting with typed content parts.

A message's content is a list of typed parts.  ``PartVisitor`` visits them in order and
flattens text, images, audio and documents into one string, in which every attachment is a
placeholder; it records each attachment's reference and the number of tokens that its
placeholder expands to.  Turns are marked by a template:

    ### Role:\\n<text></turn>\\n

Marks and placeholders inside texts are escaped by a backslash, as are backslashes, so every
formatted conversation can be read back exactly.

A conversation is formatted as a stream of its sorted turns: no task holds a conversation
whole, so one with a third of all rows needs no more memory than another.

Defined results: a null text is empty; a null role is the empty role; rows without a
conversation id form a conversation of their own; turns are ordered by turn (nulls first),
then role and text, so repeated and tied rows are kept in a fixed order; an empty table gives
none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import table

# fixed values of the template
HEAD, HEAD_END, TURN_END = "### ", ":\n", "</turn>\n"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
_CONTROL = re.compile(r"\\|###|</turn>|<image>|<audio>|<document>|:(?=\n)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TOKEN = re.compile(r"\\.|</turn>\n|<image>|<audio>|<document>|[^\\<]+|<", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class PartVisitor:
    """Flattens parts in order; ``attachments`` gets (kind, ref, code point offset, tokens).

    Token counts: images by patches of ``patch`` pixels, audio by ``audio_rate`` tokens a
    second, documents by ``page_tokens`` a page, each at least 1.
    """

    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 500
    out: list[str] = field(default_factory=list)
    size: int = 0
    attachments: list[tuple[str, str, int, int]] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        if kind != "text" and kind not in PLACEHOLDERS:
            raise ValueError(f"unknown part type {kind!r}")
        getattr(self, f"visit_{kind}")(part)

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across = -(-int(part.get("width") or 1) // self.patch)
        self._attach("image", part, across * -(-int(part.get("height") or 1) // self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, int(-(-float(part.get("seconds") or 0) * self.audio_rate // 1)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, int(part.get("pages") or 1) * self.page_tokens)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append((kind, part.get("ref") or "", self.size, max(1, tokens)))
        self._add(PLACEHOLDERS[kind])

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    @property
    def text(self) -> str:
        return "".join(self.out)


def flatten(parts, **sizes) -> tuple[str, list[tuple[str, str, int, int]]]:
    """Escaped text with placeholders, and the attachments, of a list of parts."""
    visitor = PartVisitor(**sizes)
    for part in parts if parts is not None else ():
        visitor.visit(part if isinstance(part, dict) else part.asDict())
    return visitor.text, visitor.attachments


def wrap(role: str, body: str) -> str:
    """One formatted turn; ``body`` is escaped already."""
    return f"{HEAD}{escape(role)}{HEAD_END}{body}{TURN_END}"


def read_back(formatted: str) -> list[tuple[str, list[dict], str]]:
    """The turns of a formatted conversation as (role, parts, escaped body)."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError(f"no turn starts at {at}")
        # a colon before a line feed is escaped in roles, so the first bare one ends the head
        head = re.compile(r"((?:\\.|[^\\:]|:(?!\n))*):\n", re.DOTALL).match(formatted, at + len(HEAD))
        if not head:
            raise ValueError(f"the turn at {at} has no head")
        parts, body, text, at = [], [], [], head.end()
        while True:
            token = _TOKEN.match(formatted, at)
            if not token:
                raise ValueError("a turn has no end")
            at = token.end()
            if token[0] == TURN_END:
                break
            body.append(token[0])
            kind = token[0][1:-1] if token[0] in PLACEHOLDERS.values() else None
            if kind:
                if text:
                    parts.append({"type": "text", "text": unescape("".join(text))})
                parts.append({"type": kind})
                text = []
            else:
                text.append(token[0])
        if text:
            parts.append({"type": "text", "text": unescape("".join(text))})
        turns.append((unescape(head[1]), parts, "".join(body)))
    return turns


PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
FORMATTED = (
    "struct<formatted:string,loss_start:int,loss_end:int,tokens:bigint,"
    "attachments:array<struct<kind:string,ref:string,offset:int,tokens:int>>>"
)


def format_turns(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format rows of (conv_id, turn, role, parts): adds the formatted turn and its loss mask.

    ``loss_start`` and ``loss_end`` bound the text under the mask, in code points of
    ``formatted`` (both 0 for roles not learnt); ``tokens`` counts what placeholders expand to.
    """
    @F.pandas_udf(FORMATTED)
    def run(role: pd.Series, parts: pd.Series) -> pd.DataFrame:
        rows = []
        for r, p in zip(role, parts, strict=True):
            r = r or ""
            body, found = flatten(p)
            whole = wrap(r, body)
            start = len(whole) - len(TURN_END) - len(body) if r in learn else 0
            rows.append(
                (
                    whole,
                    start,
                    start + len(body) if r in learn else 0,
                    sum(a[3] for a in found),
                    [dict(zip(("kind", "ref", "offset", "tokens"), a, strict=True)) for a in found],
                )
            )
        return pd.DataFrame(rows, columns=["formatted", "loss_start", "loss_end", "tokens", "attachments"])

    return turns.withColumn("f", run("role", "parts")).select("conv_id", "turn", "role", "f.*")


class _Digest:
    """Running results of one conversation, read back from its formatted turns."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = self.expanded = self.attached = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int, tokens: int, attached: int) -> None:
        for role, parts, _ in read_back(formatted):
            self.all.update(f"{role}\n".encode())
            for part in parts:
                self.all.update((part.get("text") or PLACEHOLDERS.get(part["type"], "")).encode())
            self.all.update(b"\n")
            self.turns += 1
        learnt = unescape(formatted[start:end])
        self.loss.update(learnt.encode())
        self.loss_chars += len(learnt)
        self.chars += len(formatted)
        self.expanded += tokens
        self.attached += attached

    def row(self, conv) -> tuple:
        return (
            conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(),
            self.chars, self.attached, self.expanded,
        )


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_attachments long, expanded_tokens long"
)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted formatted turns to one row per conversation; holds one conversation's sums."""
    names = [c.split()[0] for c in DIGEST.split(", ")]
    current, running = None, None
    for batch in batches:
        done = []
        for conv, text, start, end, tokens, attached in zip(
            batch["conv_id"], batch["formatted"], batch["loss_start"], batch["loss_end"],
            batch["tokens"], batch["n_attached"], strict=True,
        ):
            conv = None if pd.isna(conv) else int(conv)
            if running is None or conv != current:
                if running is not None:
                    done.append(running.row(current))
                current, running = conv, _Digest()
            running.add(text, start, end, tokens, attached)
        yield _rows(done, names)
    if running is not None:
        yield _rows([running.row(current)], names)


def _rows(rows: list, names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({n: "Int64" for n in names if not n.endswith("sha256")})


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted turns."""
    rows = formatted.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "formatted",
        "loss_start", "loss_end", "tokens", F.size("attachments").alias("n_attached"),
    )
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "formatted")
        .select("conv_id", "formatted", "loss_start", "loss_end", "tokens", "n_attached")
        .mapInPandas(_digest, DIGEST)
    )


def text_parts(turns: DataFrame) -> DataFrame:
    """Plain rows of (conv_id, turn, role, text) as rows with one text part."""
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"),
        F.lit(None).cast("int").alias("pages"),
    )
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def op6_chat_format(spark, sf_dir) -> DataFrame:
    """Every conversation, and -7, which is made of the template's own control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    return conversation_digests(format_turns(text_parts(turns.unionByName(extra))))
