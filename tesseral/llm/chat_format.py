"""Chat formatting by token-level assembly, and reading it back.

Each turn is encoded by itself: role and text go through the tokenizer separately, and reserved ids above its
vocabulary are spliced between them, so no content can produce a control token. Places of segments in a turn and of turns in
the conversation are prefix sums of lengths; the loss mask of a conversation is its ranges of token places. Control strings that occur in content are escaped (one backslash
is put before the control string and any backslashes that precede it already), so the rendered string is unambiguous
too, and unescaping takes exactly that backslash away.

Rows are encoded where they are; only then are they shuffled by conversation, sorted by turn, and streamed. A
conversation of any length passes through one task in order (its digest is a sequence), but never sits in memory.

Defined cases: null role or text is empty; a null conv_id is a conversation of its own; null turns come first; rows that
repeat a turn are all kept, ordered by role and the MD5 of the text; an empty table gives no rows; other columns are not read. Surrogates
can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import tidy

#: The rank file of the tokenizer and the pattern that goes with it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Template: <turn>ROLE<text>TEXT</turn>. Reserved ids follow the vocabulary in this order.
MARKS = ("<turn>", "<text>", "</turn>")
#: Escaped in content: the template's own marks and the headers of plain-text templates.
CONTROLS = (*MARKS, "### Assistant:", "### User:", "### System:")
LOSS_ROLE = "assistant"

_control = "|".join(map(re.escape, CONTROLS))
_bare, _escaped = re.compile(rf"(\\*)({_control})"), re.compile(rf"\\(\\*(?:{_control}))")

ENCODED = "conv_id long, turn long, role string, tie string, ids array<int>, loss_start int, loss_end int, n_chars int"
#: The order of a conversation's rows; tie is the MD5 of the text.
ORDER = ["turn", "role", "tie"]
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _bare.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


@cache
def tokenizer(ranks: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        pairs = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})


def reserved(ranks: str) -> list[int]:
    """The ids of MARKS: the first free ones after the largest rank, and the one that is left free beside it."""
    first = tokenizer(ranks).max_token_value + 2
    return [first + k for k in range(len(MARKS))]


def assemble(role: str, text: str, ranks: str) -> tuple[np.ndarray, int, int, int]:
    """A turn's ids, the half-open range of them under the loss mask, and the rendered length in code points."""
    enc, (turn, body, end) = tokenizer(ranks), reserved(ranks)
    role_s, text_s = escape(role), escape(text)
    parts = [[turn], enc.encode_ordinary(role_s), [body], enc.encode_ordinary(text_s), [end]]
    ends = np.cumsum([len(p) for p in parts])
    mask = (int(ends[2]), int(ends[3])) if role == LOSS_ROLE else (0, 0)
    return np.concatenate([np.asarray(p, np.int32) for p in parts]), *mask, sum(map(len, MARKS)) + len(role_s) + len(text_s)


def encode_turns(turns: DataFrame, ranks: str = RANKS) -> DataFrame:
    """conv_id, turn, role, tie, ids, loss_start, loss_end, n_chars for each row (conv_id, turn, role, text); places are of the turn."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                conv, turn, role, text = (part.column(k).to_pylist() for k in range(4))
                tie = [hashlib.md5(t.encode(), usedforsecurity=False).hexdigest() for t in text]
                done = [assemble(r, t, ranks) for r, t in zip(role, text)]
                offsets = np.concatenate([[0], np.cumsum([len(d[0]) for d in done])]).astype(np.int32)
                ids = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), pa.array(role, pa.string()), pa.array(tie, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), *(pa.array([d[k] for d in done], pa.int32()) for k in (1, 2, 3))],
                    ["conv_id", "turn", "role", "tie", "ids", "loss_start", "loss_end", "n_chars"],
                )

    cols = [F.col("conv_id").cast("long"), F.col("turn").cast("long")]
    cols += [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    return turns.select(*cols).mapInArrow(tidy(encode), ENCODED)


def format_chat(turns: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The formatted conversations, in stretches: the turns of ``encode_turns`` with token_start, the place of their first id in the
    conversation's sequence, and the range loss_from to loss_to of that sequence under its loss mask.

    A conversation of any length is so many rows, not one array.
    """
    before = Window.partitionBy("conv_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    placed = encode_turns(turns, ranks).withColumn("token_start", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).cast("long"))
    return placed.withColumns({"loss_from": F.col("token_start") + F.col("loss_start"), "loss_to": F.col("token_start") + F.col("loss_end")})


def parse(ids: np.ndarray, ranks: str) -> list[tuple[str, str]]:
    """The (role, text) turns that a stretch of formatted ids holds, found by the reserved ids alone."""
    enc, (turn, body, end) = tokenizer(ranks), reserved(ranks)
    starts, bodies, ends = (np.flatnonzero(ids == mark) for mark in (turn, body, end))
    text = lambda lo, hi: unescape(enc.decode_bytes(ids[lo:hi].tolist()).decode())
    return [(text(a + 1, b), text(b + 1, c)) for a, b, c in zip(starts, bodies, ends, strict=True)]


def render(ids: np.ndarray, ranks: str) -> str:
    """The formatted string of ids."""
    enc, marks = tokenizer(ranks), dict(zip(reserved(ranks), MARKS))
    cuts = np.flatnonzero(ids >= min(marks))
    out, at = [], 0
    for k in cuts:
        out += [enc.decode_bytes(ids[at:k].tolist()).decode(), marks[int(ids[k])]]
        at = k + 1
    return "".join([*out, enc.decode_bytes(ids[at:].tolist()).decode()])


def read_back(formatted: DataFrame, ranks: str = RANKS) -> DataFrame:
    """READ for each conversation of ``format_chat``, from its sequence of ids and its mask alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, begun = None, False
        n = loss_n = chars = place = 0
        all_h = loss_h = hashlib.sha256()

        def flush() -> None:
            if begun:
                rows.append((key, n, all_h.hexdigest(), loss_n, loss_h.hexdigest(), chars))

        for b in batches:
            conv, ids, start, lo, hi, number = (b.column(k) for k in range(6))
            for c, x, at, p, q, k in zip(conv.to_pylist(), ids, start.to_pylist(), lo.to_pylist(), hi.to_pylist(), number.to_pylist()):
                if k == 1:
                    flush()
                    key, begun, n, loss_n, chars, place, all_h, loss_h = c, True, 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                if at != place:
                    raise ValueError(f"conversation {c}: a stretch for place {at} comes at place {place}")
                x = x.values.to_numpy()
                place += len(x)
                for role, text in parse(x, ranks):
                    all_h.update(f"{role}\n{text}\n".encode())
                    n += 1
                chars += len(render(x, ranks))
                if q > p:
                    learnt = unescape(tokenizer(ranks).decode_bytes(x[p - at : q - at].tolist()).decode())
                    loss_h.update(learnt.encode())
                    loss_n += len(learnt)
            if rows:
                yield batch(rows)
                rows = []
        flush()
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    # the window deals and sorts; what format_chat has dealt is not dealt again
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("token_start"))
    return formatted.select("conv_id", "ids", "token_start", "loss_from", "loss_to", number.alias("number")).mapInArrow(tidy(read), READ)
