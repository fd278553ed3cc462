"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the character
spans of its assistant texts are intersected with the token spans by binary
search, which gives a mask per token and the covered part of each token.

Template, one block per row in turn order::

    ### role: text</turn>\\n

Escapes inside roles and texts (undone by ``unescape``): a backslash becomes
``\\\\``, ``###`` becomes ``\\h``, ``</turn>`` becomes ``\\e``, and in a role ``:``
becomes ``\\c``.  So no text can forge a control string.

Rows of a conversation are ordered by turn (nulls first), then role, then text;
repeated rows stay.  Null role or text: empty.  A null conv_id is one more
conversation.  A very long text is rendered and encoded whole.  Empty table: no rows.
Extra columns are not read.

Rows are shuffled by conversation and sorted inside partitions; a task streams
over them and holds about a million characters at a time (one conversation at least).
The tokenizer file is a parameter; ``corvane.tokenizer`` in the session's settings
names another one for the query.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))
_BACK = {"\\": "\\", "h": "###", "e": "</turn>", "c": ":"}
_BLOCK = re.compile(r"### ((?:\\.|[^\\:])*): (.*?)</turn>\n", re.S)
#: From the end of an answer to the begin of the next; neither string can stand inside a text.
_BETWEEN = re.compile(r"</turn>\n(?:### (?!assistant: )(?:\\.|[^\\:])*: .*?</turn>\n)*### assistant: ", re.S)


def escape(text: str, role: bool = False) -> str:
    for a, b in ESCAPES + ((":", "\\c"),) * role:
        text = text.replace(a, b)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of the assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role, True)}: ", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from the formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _BLOCK.finditer(formatted)]


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Per token (a row of offsets) the first and past the last covered character (0 and 0 if none), by binary search in the sorted spans."""
    a, b = offsets[:, 0], offsets[:, 1]
    starts, ends = np.array([x for x, _ in spans], np.int64), np.array([x for _, x in spans], np.int64)
    i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")  # spans that end after a and begin before b
    some = i < j
    first, last = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    first[some] = np.maximum(a[some], starts[i[some]])
    last[some] = np.minimum(b[some], ends[j[some] - 1])
    return first, last


def masked_text(formatted: str, first: np.ndarray, last: np.ndarray) -> str:
    """What stands under the mask, each character once (several tokens can share one), between spans nothing."""
    some = last > first
    first, last = first[some].astype(np.int64), last[some].astype(np.int64)
    if not len(first):
        return ""
    done = np.concatenate(([0], np.maximum.accumulate(last)[:-1]))
    begins = np.concatenate(([True], first[1:] > done[1:]))  # runs of tokens without a gap
    at, end = first[begins], np.maximum.reduceat(last, np.flatnonzero(begins))
    parts = [formatted[x:y] for x, y in zip(np.maximum(at, done[begins]).tolist(), end.tolist(), strict=True)]
    return "".join(_BETWEEN.sub("", x) for x in parts)  # a token that reaches over several answers holds what stands between them


def encoder(path: str):
    from tokenizers import Tokenizer
    from tokenizers.processors import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    tokenizer.post_processor = ByteLevel(trim_offsets=False)
    return tokenizer


SCHEMA = "conv_id long, n_turns long, formatted string, token_ids array<int>, loss_from array<int>, loss_to array<int>"


def format_conversations(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per conversation: the formatted text, its token ids, and per token the character range under the loss mask (empty: 0, 0)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        stream = (r for f in frames for r in zip(*(c.to_pylist() for c in f.columns), strict=True))
        out, chars = [], 0

        def flush() -> pa.RecordBatch:
            codes = encode.encode_batch([formatted for _, _, formatted, _ in out], add_special_tokens=False)
            offsets = [np.array(code.offsets, np.int64).reshape(-1, 2) for code in codes]
            cover = [mask(x, spans) for x, (_, _, _, spans) in zip(offsets, out, strict=True)]
            ends = pa.array(np.cumsum([0, *map(len, offsets)]), pa.int32())
            lists = ([code.ids for code in codes], [a for a, _ in cover], [b for _, b in cover])
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            columns += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32))) for x in lists]
            return pa.record_batch(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

        for conv_id, group in groupby(stream, key=lambda r: r[0]):
            turns = [(role, text) for _, role, text in group]
            formatted, spans = render(turns)
            out.append((conv_id, len(turns), formatted, spans))
            chars += len(formatted)
            if chars > 1 << 20:
                yield flush()
                out, chars = [], 0
        if out:
            yield flush()

    return rows.mapInArrow(run, SCHEMA)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and the mask hold, parsed from them alone."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            rows = []
            first, last = (np.asarray(batch.column(i).flatten()) for i in (4, 5))
            ends = batch.column(3).offsets.to_numpy()
            ends = ends - ends[0]
            for i, (conv_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                a, b = first[ends[i] : ends[i + 1]], last[ends[i] : ends[i + 1]]
                turns = parse(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = unescape(masked_text(text, a, b))
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                rows.append((conv_id, len(turns), sha(said), len(loss), sha(loss), len(text), len(a), int((b > a).sum())))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return formatted.mapInArrow(run, DIGEST)
