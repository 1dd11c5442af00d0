"""Chat formatting at token level.

Turns are dealt and sorted by ranges of (conversation, turn), so a conversation of any length is spread over tasks. There
each turn's text is escaped and encoded on its own and conversations are assembled from the coded segments: control
strings are single reserved ids above the tokenizer's vocabulary, spliced in between, and the loss mask is
the prefix sum of +1 where an assistant's text begins and -1 where it ends.

**Template.** ``<s>`` opens a conversation. Turns: ``[SYS]text[/SYS]`` (system), ``[INST]text[/INST]`` (user),
``[TOOL]text[/TOOL]`` (tool), ``[ANS]text</s>`` (assistant), ``[ROLE]role[/ROLE]text[END]`` (any other).

**Escape.** A control string in a text gets a backslash after its first character, and so does what already
looks like an escaped one (``<\\s>`` becomes ``<\\\\s>``); taking one backslash away from each restores the text.

Output rows hold whole turns and some ``PART_TOKENS`` tokens at most (a single longer turn excepted), so no
row grows with the length of a conversation: ``conv_id, part, n_turns, ids`` (little-endian uint32) and
``mask`` (a byte a token). Parts are in order of ``part``, with gaps; the opening is a part of its own, -1.

Reading back decodes each part by itself. Only the digests, which chain all text of a conversation, are one task's work
for each conversation, over a stream of decoded parts.

Defined cases: a null text is empty; a null role is the role ''; a null turn sorts first; equal turns are
ordered by role, then by a hash of the text, and repeated rows are repeated turns; a null conv_id is a
conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.scratch import small_batches, stage
from lakewarden.llm.tokens import encoder

PART_TOKENS = 1 << 16
#: Text bytes in a range of turns, about.
RANGE_BYTES = 8 << 20
CONTROL = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[TOOL]", "[/TOOL]", "[ANS]", "[ROLE]", "[/ROLE]", "[END]")
NUMBER = {text: k for k, text in enumerate(CONTROL)}
#: What opens and closes the text of a role.
TURNS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "tool": ("[TOOL]", "[/TOOL]"), "assistant": ("[ANS]", "</s>")}
OTHER = ("[/ROLE]", "[END]")
_opens = {NUMBER[a]: role for role, (a, _) in TURNS.items()}

_pattern = re.compile("|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in CONTROL))
_escaped = re.compile("|".join(rf"{re.escape(c[0])}\\(?=\\*{re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    return _pattern.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[0][0], text)


class _Part:
    """The tokens and mask steps of the turns gathered so far."""

    def __init__(self, base: int):
        self.base, self.pieces, self.steps, self.length, self.turns = base, [], [], 0, 0

    def control(self, text: str) -> None:
        self.pieces.append(np.array([self.base + NUMBER[text]], dtype="<u4"))
        self.length += 1

    def coded(self, ids: bytes) -> None:
        own = np.frombuffer(ids, dtype="<u4")
        self.pieces.append(own)
        self.length += len(own)

    def turn(self, role: str, role_ids: bytes, text_ids: bytes) -> None:
        if role in TURNS:
            opening, closing = TURNS[role]
        else:
            opening, closing = OTHER
            self.control("[ROLE]")
            self.coded(role_ids)
        self.control(opening)
        begin = self.length
        self.coded(text_ids)
        if role == "assistant":
            self.steps += [(begin, 1), (self.length, -1)]
        self.control(closing)
        self.turns += 1

    def row(self) -> tuple[bytes, bytes, int]:
        change = np.zeros(self.length + 1, dtype=np.int8)
        for at, step in self.steps:
            change[at] += step
        return np.concatenate(self.pieces).tobytes(), np.cumsum(change[:-1]).astype(np.uint8).tobytes(), self.turns


def _assemble(tokenizer_file: str):
    """Sorted rows of (conv_id, turn, role, tie, text) to parts of the conversations in this range."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("ids", pa.binary()), ("mask", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_file, literal=True)
        base, number = own.tokenizer.get_vocab_size(), TaskContext.get().partitionId() << 32
        current, part, rows, held = None, None, [], 0

        def finish() -> None:
            nonlocal held, number
            ids, mask, turns = part.row()
            rows.append((current, number, turns, ids, mask))
            held += len(ids)
            number += 1

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for conv_id, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True):
                if part is None or conv_id != current or part.length >= PART_TOKENS:
                    if part is not None:
                        finish()
                    current, part = conv_id, _Part(base)
                role = role or ""
                spelled = b"" if role in TURNS else own.encode(escape(role)).tobytes()
                part.turn(role, spelled, own.encode(escape(text.as_py() or "")).tobytes())
                if held >= 4 << 20:
                    yield batch_of()
                    rows.clear()
                    held = 0
        if part is not None:
            finish()
        if rows:
            yield batch_of()

    return run


def format_conversations(turns: DataFrame, tokenizer_file: str) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as parts of token ids with a loss mask."""
    base = encoder(tokenizer_file, literal=True).tokenizer.get_vocab_size()
    rows = turns.select("conv_id", "turn", "role", F.xxhash64("text").alias("tie"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(max(turns.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES)))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "tie")]
    ordered = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    parts = ordered.mapInArrow(_assemble(tokenizer_file), "conv_id long, part long, n_turns long, ids binary, mask binary")
    opening = np.array([base + NUMBER["<s>"]], dtype="<u4").tobytes()
    openings = turns.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long"), F.lit(0).cast("long"), F.lit(opening), F.lit(b"\0"))
    return parts.unionAll(openings)


def _decoded(tokenizer_file: str, base: int):
    """Parts to what they hold: the turns' and the masked texts' bytes, each part by itself."""
    schema = pa.schema([(n, pa.int64()) for n in ("conv_id", "part", "n_turns", "loss_chars", "chars")] + [("turns", pa.binary()), ("loss", pa.binary())])

    def read(ids: np.ndarray, mask: np.ndarray, decode) -> tuple[int, int, int, bytes, bytes]:
        controls = np.flatnonzero(ids >= base)
        bounds = np.append(controls, len(ids))
        texts = iter(decode([ids[a + 1 : b].tolist() for a, b in zip(controls, bounds[1:], strict=True)]))
        role, chars, turns = "", 0, []
        for at in controls:
            kind, text = int(ids[at]) - base, next(texts)
            chars += len(CONTROL[kind]) + len(text)
            if kind == NUMBER["[ROLE]"]:
                role = unescape(text)
            elif kind in _opens or kind == NUMBER["[/ROLE]"]:
                role = _opens.get(kind, role)
                turns.append(f"{role}\n{unescape(text)}\n")
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
        loss = "".join(map(unescape, decode([ids[a:b].tolist() for a, b in zip(edge[::2], edge[1::2], strict=True)])))
        return len(turns), len(loss), chars, "".join(turns).encode(), loss.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(tokenizer_file, literal=True).tokenizer

        def decode(parts: list[list[int]]) -> list[str]:
            return tokenizer.decode_batch(parts, skip_special_tokens=False)

        for batch in batches:
            rows, held = [], 0
            for key, part, ids, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4), strict=True):
                n, loss_chars, chars, turns, loss = read(np.frombuffer(ids.as_py(), dtype="<u4"), np.frombuffer(mask.as_py(), dtype=np.uint8), decode)
                rows.append((key, part, n, loss_chars, chars, turns, loss))
                held += len(turns) + len(loss)
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decoded parts, sorted by conversation, to one row for each conversation."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )
    state, found = None, []

    def done() -> None:
        key, n, loss_chars, chars, turns, loss = state
        found.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        numbers = zip(*[batch.column(k).to_pylist() for k in (0, 2, 3, 4)], strict=True)
        for (key, n, loss_chars, chars), turns, loss in zip(numbers, batch.column(5), batch.column(6), strict=True):
            if state is None or key != state[0]:
                if state is not None:
                    done()
                state = [key, 0, 0, 0, hashlib.sha256(), hashlib.sha256()]
            for k, more in ((1, n), (2, loss_chars), (3, chars)):
                state[k] += more
            state[4].update(turns.as_py())
            state[5].update(loss.as_py())
        if found:
            yield batch_of()
            found.clear()
    if state is not None:
        done()
        yield batch_of()


def read_back(parts: DataFrame, tokenizer_file: str) -> DataFrame:
    """Per conversation, from its tokens and mask alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    base = encoder(tokenizer_file, literal=True).tokenizer.get_vocab_size()
    schema = "conv_id long, part long, n_turns long, loss_chars long, chars long, turns binary, loss binary"
    decoded = parts.mapInArrow(_decoded(tokenizer_file, base), schema)
    ordered = decoded.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part")
    return ordered.mapInArrow(_chained, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatting_report(turns: DataFrame, tokenizer_file: str) -> DataFrame:
    """Format, write, and return what the written output holds."""
    small_batches(turns.sparkSession)
    return read_back(stage(format_conversations(turns, tokenizer_file), "chat-parts"), tokenizer_file)
