"""Token ids of whole texts in Simple-8b coded shard files.

**Coding.** Simple-8b packs ids into 64-bit words: the top four bits select how many ids of how many bits
the other sixty hold. Selector 15 is an escape: the next word is one value verbatim, so ids of more than 60
bits survive. Each block codes ``BLOCK`` ids on its own, so blocks are encoded and decoded side by side,
step k of all blocks in one array operation.

**File.** ``magic | blocks | block directory | doc ids | doc starts | footer``. The directory holds each
block's offset and number of words; doc ids and starts index the documents of the shard. All numbers are
little-endian. The footer holds the sections' offsets, so a reader needs two range reads to find a document
and one to read it.

**Order.** Documents are range-partitioned by doc_id (ties by text), each partition writes one shard. File
names carry the task attempt, and only files that the staged manifest names count, so retries and
speculative attempts leave the result alone. Shards lie in the shared folder or below the given URI.

**Encoding.** Texts go through the ``tokenizers`` library. A byte-level BPE pre-tokeniser never joins
characters across a single space between two visible characters, so texts are cut there, and each distinct
piece is encoded by the library once and remembered (in a memory of bounded size).

Defined cases: a null text is empty and has the end id alone; a null doc_id sorts first; rows that repeat a
doc_id are all written, in the order of their texts; an empty table gives an empty result; other columns are
ignored; a control string of the tokenizer's vocabulary in a text is ordinary text.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.scratch import new_path, small_batches, stage

MAGIC = b"LWTOKS8B"
BLOCK = 4096
#: Ids per word and bits per id, by selector. 0 and 1 are runs of zeros. Fixed values of Simple-8b.
COUNT = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
#: Selector 14 holds two ids of 30 bits, selector 15 escapes; one id of up to 60 bits is an escape too.
ESCAPE = 15
#: Text bytes in a shard, about.
SHARD_BYTES = 32 << 20
#: Distinct pieces that a worker remembers, some 200 bytes each; fewer cost time, not results.
MEMORY = 1_000_000

_counts = np.array([*COUNT, 1])
_bits = np.array([*BITS, 64])
_cut = re.compile(" (?<=[!-~À-ɏ] )(?=[!-~À-ɏ])")
_whole = re.compile(r"[!-~À-ɏ](?:[^ ]*[!-~À-ɏ])?\Z")
_ends_well = re.compile(r"[!-~À-ɏ]\Z")
#: Letters, a mark, and perhaps the same once more on the next line.
_word = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,]?)(?:\n([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,]?))?\Z")


def _classes(values: np.ndarray) -> np.ndarray:
    """The least selector whose width holds each value (zeros: 1), or ESCAPE."""
    if len(values) and int(values.max()) < len(_small):
        return _small[values.astype(np.int64)]
    limits = np.array([1 << b for b in BITS[1:]], dtype=np.uint64)
    return (np.searchsorted(limits, values.astype(np.uint64), side="right") + 1).astype(np.int8)


_small = (np.searchsorted(np.array([1 << b for b in BITS[1:]]), np.arange(1 << 17), side="right") + 1).astype(np.int8)


def simple8b_encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, one block after another, and the number of words in each."""
    n = len(values)
    if not n:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    blocks, pad = -(-n // block), COUNT[0]
    grid = np.zeros(blocks * block, dtype=np.uint64)
    grid[:n] = values
    size = np.full(blocks, block)
    size[-1] = n - (blocks - 1) * block
    # Each row is a block and a margin of class 0, so a word may be left partly empty at a block's end only.
    most = np.zeros((blocks, block + pad), dtype=np.int8)
    classes = np.zeros(blocks * block, dtype=np.int8)
    classes[:n] = _classes(values)
    most[:, :block] = classes.reshape(blocks, block)
    selector = np.full(most.shape, ESCAPE, dtype=np.int8)
    held = 1
    for s in range(len(COUNT) - 1, -1, -1):  # ever more ids to a word: the largest class among the next COUNT[s]
        ahead = COUNT[s] - held
        most[:, :-ahead] = np.maximum(most[:, :-ahead], most[:, ahead:])
        held = COUNT[s]
        if most[:, :block].min() > max(s, 1):
            break  # no run of so many small ids, so none of more and smaller ones
        np.putmask(selector, most <= max(s, 1), s)
    # The words' positions: all blocks take a step at a time.
    width = block + pad
    flat = selector.reshape(-1)
    steps = _counts[flat].astype(np.int32)
    at = np.arange(blocks, dtype=np.int64) * width
    stop = at + size
    taken: list[np.ndarray] = []
    while len(at):
        taken.append(at)
        at = at + steps[at]
        more = at < stop
        if not more.all():
            at, stop = at[more], stop[more]
    position = np.sort(np.concatenate(taken))
    chosen = flat[position].astype(np.int64)
    owner, column = np.divmod(position, width)
    padded = np.zeros((blocks, width), dtype=np.uint64)
    padded[:, :block] = grid.reshape(blocks, block)
    source = padded.reshape(-1)
    word = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.flatnonzero(np.bincount(chosen, minlength=ESCAPE + 1)[:ESCAPE]):
        if BITS[s]:
            own = np.flatnonzero(chosen == s)
            begin, packed = position[own], np.zeros(len(own), dtype=np.uint64)
            for k in range(COUNT[s]):
                packed |= source[begin + k] << np.uint64(k * BITS[s])
            word[own] |= packed
    per_block = np.bincount(owner, minlength=blocks)
    escaped = np.flatnonzero(chosen == ESCAPE)
    if len(escaped):
        word = np.insert(word, escaped + 1, source[position[escaped]])
        per_block += np.bincount(owner[escaped], minlength=blocks)
    return word, per_block


def _regular(words: np.ndarray, per_block: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words other than escaped values, where their ids begin, and those begins of escapes with their values."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    following = np.flatnonzero(selectors == ESCAPE)
    k = 0
    while k < len(following):  # a value after an escape may look like an escape itself
        raw[following[k] + 1] = True
        k += 2 if k + 1 < len(following) and following[k + 1] == following[k] + 1 else 1
    counts = np.where(raw, 0, _counts[selectors])
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(per_block)), per_block)
    first = np.cumsum(per_block) - per_block
    base = (ends - counts)[np.minimum(first, len(words) - 1)]
    return raw, (ends - counts) - base[owner] + owner * (block + COUNT[0]), selectors


def simple8b_decode(words: np.ndarray, per_block: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of consecutive blocks, unpacked selector by selector over all of them."""
    if not n:
        return np.empty(0, dtype=np.uint64)
    raw, begin, selectors = _regular(words, per_block, block)
    out = np.zeros(len(per_block) * (block + COUNT[0]), dtype=np.uint64)
    for s in np.flatnonzero(np.bincount(selectors[~raw], minlength=ESCAPE + 1)):
        own = np.flatnonzero((selectors == s) & ~raw)
        if s == ESCAPE:
            out[begin[own]] = words[own + 1]
        elif BITS[s]:
            mask, word = np.uint64((1 << BITS[s]) - 1), words[own]
            for k in range(COUNT[s]):
                out[begin[own] + k] = (word >> np.uint64(k * BITS[s])) & mask
    return out.reshape(len(per_block), -1)[:, :block].reshape(-1)[:n]


class ShardWriter:
    """Writes one shard file; holds a block of ids and the two indexes, not the ids of the shard."""

    def __init__(self, out, block: int = BLOCK, flush_blocks: int = 64):
        self.out, self.block, self.flush = out, block, block * flush_blocks
        self.pending: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.position = out.write(MAGIC)
        self.directory: list[np.ndarray] = []
        self.doc_ids: list[int] = []
        self.doc_known: list[int] = []
        self.starts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id if doc_id is not None else 0)
        self.doc_known.append(doc_id is not None)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.flush:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, dtype=np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        words, per_block = simple8b_encode(ids[:whole], self.block)
        if len(per_block):
            offsets = self.position + 8 * (np.cumsum(per_block) - per_block)
            self.directory.append(np.stack([offsets, per_block], axis=1).astype("<i8"))
            self.out.write(words.astype("<u8").tobytes())
            self.position += 8 * len(words)
        self.pending, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._write(True)
        directory = np.concatenate(self.directory) if self.directory else np.empty((0, 2), dtype="<i8")
        sections = [directory, np.array(self.doc_ids, "<i8"), np.array(self.doc_known, "u1"), np.array(self.starts, "<i8")]
        at = self.position
        for section in sections:
            self.out.write(section.tobytes())
        self.out.write(struct.pack("<5q8s", self.n_ids, len(self.doc_ids), len(directory), at, self.block, MAGIC))


class ShardReader:
    """Reads a shard by range: the footer, the indexes, then runs of blocks."""

    FOOTER = struct.calcsize("<5q8s")

    def __init__(self, file):
        self.file = file
        file.seek(file.size() - self.FOOTER)
        self.n_ids, docs, blocks, at, self.block, magic = struct.unpack("<5q8s", file.read(self.FOOTER))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        file.seek(at)
        self.directory = np.frombuffer(file.read(16 * blocks), "<i8").reshape(-1, 2)
        self.doc_ids = np.frombuffer(file.read(8 * docs), "<i8")
        self.doc_known = np.frombuffer(file.read(docs), "u1").astype(bool)
        self.starts = np.frombuffer(file.read(8 * docs), "<i8")

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids ``start:end`` of the shard as uint32."""
        if start >= end:
            return np.empty(0, dtype="<u4")
        first, last = start // self.block, (end - 1) // self.block
        rows = self.directory[first : last + 1]
        self.file.seek(int(rows[0, 0]))
        words = np.frombuffer(self.file.read(8 * int(rows[:, 1].sum())), "<u8")
        n = min(self.n_ids, (last + 1) * self.block) - first * self.block
        values = simple8b_decode(words, rows[:, 1], n, self.block)
        return values[start - first * self.block : end - first * self.block].astype("<u4")

    def documents(self, blocks_at_once: int = 64) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) in order, a run of documents of about ``blocks_at_once`` blocks at a time."""
        ends = np.append(self.starts[1:], self.n_ids)
        row = 0
        while row < len(self.starts):
            limit = self.starts[row] + blocks_at_once * self.block
            stop = max(row + 1, int(np.searchsorted(ends, limit, side="right")))
            base = int(self.starts[row])
            run = self.ids(base, int(ends[stop - 1]))
            for k in range(row, stop):
                doc = int(self.doc_ids[k]) if self.doc_known[k] else None
                yield doc, int(self.starts[k]), run[self.starts[k] - base : ends[k] - base]
            row = stop


class CutEncoder:
    """Ids of whole texts; each distinct piece between single spaces goes through the library once while it is
    remembered. Two generations of pieces are kept: what is still used moves to the younger one.

    A piece that is one run of letters is one pre-token of a byte-level tokenizer and goes to the library's
    merge model directly; any other piece takes the library's whole way.
    """

    def __init__(self, tokenizer_file: str, memory: int = MEMORY, literal: bool = False):
        """``literal``: the tokenizer's special tokens are text like any other where they occur in a text; otherwise they
        are recognised, as the library does by default."""
        self.memory = memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = literal
        #: What the library looks for in a whole text before it cuts it up.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and not (literal and t.special)]
        self.plain = self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, ByteLevel)
        self.merge = self.tokenizer.model.tokenize
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(k) for k in (0x20, *range(0x41, 0x250)) if k == 0x20 or chr(k).isalpha()]
        #: How the vocabulary spells a space and each letter's bytes.
        self.spelling = {ord(c): spelled.pre_tokenize_str(c)[0][0] for c in letters}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes | None:
        """A piece as it is coded after a space; None if white space beside the space might change that."""
        coded = self.old.get(piece)
        if coded is None:
            word = _word.match(piece) if self.plain else None
            if word is None:
                if not _whole.match(piece):
                    return None
                coded = self._library([" " + piece])[0]
            elif word[2] or word[3]:  # a run of letters ends before a mark or line break; a space ends the piece
                coded = self.young.get(word[1]) or self._piece(word[1])
                coded += self._mark(word[2]) if word[2] else b""
                coded += self._line(word[3]) if word[3] else b""
                coded += self._mark(word[4]) if word[4] else b""
            else:
                coded = self._letters(" " + piece)
        self.young[piece] = coded
        return coded

    def _letters(self, run: str) -> bytes:
        return array("I", [t.id for t in self.merge(run.translate(self.spelling))]).tobytes()

    def _line(self, word: str) -> bytes:
        """A line break and the run of letters after it, which are two pre-tokens."""
        key = "\n" + word  # pieces begin with a visible character, so this is no piece's key
        coded = self.young.get(key) or self.old.get(key)
        if coded is None:
            coded = self._mark("\n") + self._letters(word)
        self.young[key] = coded
        return coded

    def _mark(self, mark: str) -> bytes:
        key = " " + mark  # no piece holds a space, so this is no piece's key
        if key not in self.young:
            self.young[key] = self._library([mark])[0]
        return self.young[key]

    def encode(self, text: str) -> np.ndarray:
        for content in self.added:
            if content in text:
                return np.frombuffer(self._library([text])[0], dtype="<u4")
        first, *rest = text.split(" ")
        if not rest or not _ends_well.search(first):
            return self._by_cuts(text)
        young, old, plain, merge, space = self.young, self.old, self.plain, self.merge, self.spelling[0x20]
        coded = list(map(young.get, rest))
        if None in coded:
            for k, own in enumerate(coded):
                if own is None:
                    piece = rest[k]
                    own = young.get(piece)
                    if own is None:
                        own = old.get(piece)
                        if own is None and plain and piece.isascii():  # spelled as it is
                            if piece.isalpha():
                                own = array("I", [t.id for t in merge(space + piece)]).tobytes()
                            elif piece[-1:] in (".", ",") and (stem := piece[:-1]).isalpha():
                                own = young.get(stem) or old.get(stem)
                                if own is None:
                                    own = array("I", [t.id for t in merge(space + stem)]).tobytes()
                                young[stem] = own
                                own += self._mark(piece[-1])
                        if own is not None:
                            young[piece] = own
                        else:
                            own = self._piece(piece)
                            if own is None:
                                return self._by_cuts(text)
                    coded[k] = own
            if len(young) >= self.memory // 2:
                self.young, self.old = {}, young
        return np.frombuffer(self._library([first])[0] + b"".join(coded), dtype="<u4")

    def _by_cuts(self, text: str) -> np.ndarray:
        """Texts with other white space beside their spaces: only cuts between two visible characters are safe."""
        first, *rest = _cut.split(text)
        known = {piece: self.young.get(piece) or self.old.get(piece) for piece in dict.fromkeys(rest)}
        fresh = [piece for piece, coded in known.items() if coded is None]
        known.update(zip(fresh, self._library([" " + piece for piece in fresh]), strict=True))
        return np.frombuffer(self._library([first])[0] + b"".join([known[piece] for piece in rest]), dtype="<u4")


_encoders: dict[tuple[str, bool], CutEncoder] = {}


def encoder(tokenizer_file: str, memory: int = MEMORY, literal: bool = False) -> CutEncoder:
    key = tokenizer_file, literal
    if key not in _encoders:
        _encoders[key] = CutEncoder(tokenizer_file, literal=literal)
    _encoders[key].memory = memory
    return _encoders[key]


def _shards(folder: str, tokenizer_file: str, end_id: int, memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, name, writer, out = encoder(tokenizer_file, memory), None, None, None
        context = TaskContext.get()
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}.s8b"
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}")
                    writer = ShardWriter(out)
                writer.add(doc_id, np.concatenate([own.encode(text.as_py() or ""), end]))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([context.partitionId()]), pa.array([name]), pa.array([writer.n_ids]), pa.array([len(writer.starts)])],
                schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]),
            )

    return run


def write_shards(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str | None = None, n_shards: int | None = None, memory: int = MEMORY) -> tuple[str, DataFrame]:
    """Write ``docs`` (doc_id, text) in ascending doc_id order. Returns the folder and the staged manifest:
    ``shard, file, n_ids, n_docs``; shards in order of ``shard``. ``tokenizer_file`` must exist on every executor."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "token-shards")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    if n_shards is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_shards = max(1, spark.sparkContext.defaultParallelism, -(-total // SHARD_BYTES))
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(int(n_shards), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first())
    )
    manifest = ordered.mapInArrow(_shards(uri, tokenizer_file, end_id, memory), "shard long, file string, n_ids long, n_docs long")
    return uri, stage(manifest, "token-manifest")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        kinds = [pa.int64()] * 4
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = fs.FileSystem.from_uri(f"{folder}/{file}")
                rows: list[tuple] = []
                with store.open_input_file(place) as opened:
                    for doc_id, start, ids in ShardReader(opened).documents():
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_shards(folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    The manifest has one row for each shard (tens of megabytes of text), so the running sum of their sizes
    is over a list of the same kind as Spark's own list of map outputs.
    """
    spark = manifest.sparkSession
    shards = sorted((r["shard"], r["file"], r["n_ids"]) for r in manifest.select("shard", "file", "n_ids").collect())
    starts = [0, *np.cumsum([n for _, _, n in shards]).tolist()]
    rows = [(file, int(start)) for (_, file, _), start in zip(shards, starts, strict=False)]
    listing = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)), "file")
    return listing.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer_file: str, end_id: int = 2, folder: str | None = None, memory: int = MEMORY) -> DataFrame:
    """Write the shards of ``docs`` and return what the files hold, per document."""
    return read_shards(*write_shards(docs, tokenizer_file, end_id, folder, memory=memory))
