"""Token ids in files of patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id and sorted, so every task encodes a stretch of the corpus and writes files of
its own. A file (all numbers little-endian) is

    "PFOR0001"
    blocks   minimum u32, width u8, exceptions u32, ids - minimum packed at `width` bits (the rest of larger ones is
             left out), places of exceptions u32, their rest above `width` bits u32
    index    of every block its first byte u64 and its first id u64, then the end of both;
             of every document its first id u64, then the end; doc_ids i64; is it null u8
    end      first byte of the index u64, blocks u64, documents u64, crc32 of the index u32, "PFOR"

A block's width is the number of bits that `percentile` of its ids need. Documents and blocks don't share bounds: a
block has `block_ids` ids, the file's last one fewer. Names are new for each attempt of a task; the table of files
gets the names of the attempts that Spark commits, so a lost executor leaves at most files that no table names.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .packing import WordCache
from .textbits import U64, blocks, text_buffers, word_hashes

MAGIC, TAIL = b"PFOR0001", b"PFOR"
HEAD, END = struct.Struct("<IBI"), struct.Struct("<QQQI4s")


@dataclass(frozen=True)
class TokenFileConfig:
    """Vocabulary file, id that closes a document, ids of a block, share of a block's ids that its width must hold, ids after which a file is closed, and words kept encoded in each worker."""

    tokenizer: str
    end_id: int = 0
    block_ids: int = 4096
    percentile: float = 0.9
    file_ids: int = 1 << 26
    cache_words: int = 1_000_000


# Blocks


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Each row of `values` as bytes that have the lowest `width` bits of its numbers one after another."""
    rows, n = values.shape
    wide = np.ascontiguousarray(values, "<u2" if width <= 16 else "<u4")
    bits = np.unpackbits(wide.view(np.uint8).reshape(rows, n, wide.itemsize), axis=2, bitorder="little")[:, :, :width]
    return np.packbits(bits.reshape(rows, n * width), axis=1, bitorder="little")


def _unpacked(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """The `n` numbers of each row of `_packed`."""
    rows, room = len(data), 16 if width <= 16 else 32
    bits = np.zeros((rows, n, room), np.uint8)
    bits[:, :, :width] = np.unpackbits(data, axis=1, count=n * width, bitorder="little").reshape(rows, n, width)
    return np.packbits(bits.reshape(rows, n * room), axis=1, bitorder="little").view("<u2" if room == 16 else "<u4").astype(np.uint32)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1]


def encode_blocks(ids: np.ndarray, block_ids: int, percentile: float) -> list[bytes]:
    """The blocks of `ids` (unsigned 32-bit), all full but the last."""
    full, found = len(ids) // block_ids, []
    for part in (ids[: full * block_ids].reshape(full, block_ids), ids[full * block_ids :].reshape(-1, len(ids) - full * block_ids) if len(ids) % block_ids else None):
        if part is None or not len(part):
            continue
        n = part.shape[1]
        low = part.min(axis=1)
        above = part - low[:, None]
        at = min(n - 1, max(0, int(np.ceil(percentile * n)) - 1))
        widths = _bits(np.partition(above, at, axis=1)[:, at])
        made: list[bytes] = [b""] * len(part)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            bodies = _packed(above[rows], width)
            rest = (above[rows].astype(np.uint64) >> U64(width)).astype("<u4")
            for k, row in enumerate(rows.tolist()):
                places = np.flatnonzero(rest[k])
                made[row] = b"".join([HEAD.pack(int(low[row]), width, len(places)), bodies[k].tobytes(), places.astype("<u4").tobytes(), rest[k][places].tobytes()])
        found += made
    return found


def decode_blocks(data: bytes, starts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks; `starts` has their first bytes in `data` and the end, `firsts` their first ids and the end."""
    out = np.zeros(int(firsts[-1] - firsts[0]), np.uint32)
    shapes: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for at, first, after in zip(starts[:-1].tolist(), (firsts[:-1] - firsts[0]).tolist(), (firsts[1:] - firsts[0]).tolist(), strict=True):
        low, width, odd = HEAD.unpack_from(data, at)
        shapes.setdefault((after - first, width), []).append((at + HEAD.size, first, low, odd))
    raw = np.frombuffer(data, np.uint8)
    for (n, width), found in shapes.items():
        size = (n * width + 7) // 8
        bodies = np.stack([raw[at : at + size] for at, *_ in found])
        for values, (at, first, low, odd) in zip(_unpacked(bodies, n, width), found, strict=True):
            if odd:
                places = np.frombuffer(data, "<u4", odd, at + size)
                values[places] |= (np.frombuffer(data, "<u4", odd, at + size + 4 * odd).astype(np.uint64) << U64(width)).astype(np.uint32)
            out[first : first + n] = values + np.uint32(low)
    return out


# Files


class TokenFileWriter:
    """Writes documents one after another; holds the ids of a few blocks, and two numbers for each document."""

    def __init__(self, out: BinaryIO, block_ids: int, percentile: float, buffer_blocks: int = 128) -> None:
        self.out, self.block_ids, self.percentile, self.room = out, block_ids, percentile, buffer_blocks * block_ids
        self.held: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.doc_ids: list[int | None] = []
        self.doc_starts, self.starts, self.firsts = [0], [len(MAGIC)], [0]
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.held.append(ids)
        self.n_ids += len(ids)
        self.waiting += len(ids)
        self.doc_starts.append(self.n_ids)
        if self.waiting >= self.room:
            self._flush(self.waiting - self.waiting % self.block_ids)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        self.held, self.waiting = [ids[n:]], len(ids) - n
        for a in range(0, n, self.room):  # a long document goes in pieces of bounded size
            for block in encode_blocks(ids[a : min(a + self.room, n)], self.block_ids, self.percentile):
                self.out.write(block)
                self.starts.append(self.starts[-1] + len(block))
        self.firsts = [min(k * self.block_ids, self.n_ids) for k in range(len(self.starts))]

    def close(self) -> None:
        self._flush(self.waiting)
        nulls = np.array([x is None for x in self.doc_ids], np.uint8)
        ids = np.array([0 if x is None else x for x in self.doc_ids], "<i8")
        index = b"".join([np.array(self.starts, "<u8").tobytes(), np.array(self.firsts, "<u8").tobytes(), np.array(self.doc_starts, "<u8").tobytes(), ids.tobytes(), nulls.tobytes()])
        self.out.write(index + END.pack(self.starts[-1], len(self.starts) - 1, len(self.doc_ids), zlib.crc32(index), TAIL))


class TokenFile:
    """Reads a file's index, then any range of its ids from the blocks that hold it."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source = source
        size = source.size()
        source.seek(size - END.size)
        index_at, n_blocks, n_docs, crc, tail = END.unpack(source.read(END.size))
        source.seek(index_at)
        index = source.read(size - END.size - index_at)
        if tail != TAIL or zlib.crc32(index) != crc:
            raise ValueError("not a whole token file")
        cuts = np.cumsum([0, 8 * (n_blocks + 1), 8 * (n_blocks + 1), 8 * (n_docs + 1), 8 * n_docs, n_docs]).tolist()
        kinds = ("<u8", "<u8", "<u8", "<i8", np.uint8)
        self.starts, self.firsts, self.doc_starts, self.doc_ids, self.nulls = (np.frombuffer(index[a:b], k) for a, b, k in zip(cuts[:-1], cuts[1:], kinds, strict=True))

    def ids(self, low: int, high: int) -> np.ndarray:
        """The ids from place `low` to before `high`."""
        if low >= high:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(self.firsts, low, "right")) - 1, int(np.searchsorted(self.firsts, high))
        self.source.seek(int(self.starts[a]))
        data = self.source.read(int(self.starts[b] - self.starts[a]))
        found = decode_blocks(data, self.starts[a : b + 1] - self.starts[a], self.firsts[a : b + 1])
        return found[low - int(self.firsts[a]) : high - int(self.firsts[a])]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, document after the last, their ids) in steps of about `most` ids."""
        k, n = 0, len(self.doc_ids)
        while k < n:
            after = max(k + 1, int(np.searchsorted(self.doc_starts, self.doc_starts[k] + np.uint64(most), "right")) - 1)
            yield k, after, self.ids(int(self.doc_starts[k]), int(self.doc_starts[after]))
            k = after


# Encoding


_encoders: dict[str, tuple] = {}
_SPACE, _GAP, _LETTER, _NUMBER, _OTHER = range(5)


class _Kinds:
    """The kind of code points as the tokenizers library's own patterns see them, asked for 256 at a time when first met."""

    def __init__(self) -> None:
        self.table, self.known = np.full(0x110000, _OTHER, np.uint8), np.zeros(0x1100, bool)

    def __getitem__(self, points: np.ndarray) -> np.ndarray:
        met = np.zeros(0x1100, bool)
        met[points >> 8] = True
        for page in np.flatnonzero(met & ~self.known).tolist():
            self._ask(range(page << 8, (page + 1) << 8))
            self.known[page] = True
        return self.table[points]

    def _ask(self, page: range) -> None:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        every = "".join(chr(x) for x in page if not 0xD800 <= x < 0xE000)
        for kind, others in ((_GAP, r"\S+"), (_LETTER, r"\P{L}+"), (_NUMBER, r"\P{N}+")):
            for _, (a, b) in Split(Regex(others), "removed").pre_tokenize_str(every):
                self.table[[ord(x) for x in every[a:b]]] = kind
        self.table[0x20] = _SPACE


def _encoder(path: str) -> tuple:
    """The tokenizer, kinds of code points, a cache of encoded words and the special tokens, once for each Python worker."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = [x.content.encode() for x in tokenizer.get_added_tokens_decoder().values()]
        _encoders[path] = (tokenizer, _Kinds(), WordCache(np.dtype("<u4")), special)
    return _encoders[path]


def byte_level_words(points: np.ndarray, cuts: np.ndarray, kinds: _Kinds) -> np.ndarray:
    """Where a byte-level vocabulary's words start in the code points of texts that are cut at `cuts`.

    Words are runs of letters, of numbers or of anything else, with a space right before them; 's 't 're 've 'm
    'll 'd where no space or other sign comes before; and other white space, of which the last one before a word
    stands alone.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds[points]
    gap = kind <= _GAP
    opening = np.zeros(n + 1, bool)
    opening[cuts] = True
    group = np.where(gap, _GAP, kind)
    first = opening[:n].copy()
    first[1:] |= group[1:] != group[:-1]
    start = first.copy()
    # the last gap before a word stands alone, or with the word if it is a space
    ahead = np.flatnonzero(first & ~gap & ~opening[:n])
    ahead = ahead[gap[ahead - 1]]
    start[ahead - 1] = True
    start[ahead[kind[ahead - 1] == _SPACE]] = False
    # an apostrophe alone, with the letters of a short form after it
    mark = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & first[:-1] & first[1:] & ~opening[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(mark):
        one = points[mark + 1]
        two = np.where((mark + 2 < n) & ~opening[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 2, np.where(long, 3, 0))
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        after = mark + size
        after = after[after < n]
        start[after[~gap[after]]] = True
    return np.flatnonzero(start)


def encode_block(data: np.ndarray, cuts: np.ndarray, config: TokenFileConfig) -> list[np.ndarray]:
    """Ids of every text of a block, equal to encoding it whole; each distinct word is encoded once."""
    tokenizer, kinds, cache, special = _encoder(config.tokenizer)
    none = np.zeros(0, "<u4")
    if not len(data):
        return [none] * (len(cuts) - 1)
    raw = data.tobytes()
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    start = lead[byte_level_words(points, np.searchsorted(lead, cuts), kinds)]
    end = np.append(start[1:], len(data))
    keys, index, inverse = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
    low, high = start[index], end[index]
    heads = np.zeros(len(index), U64)
    for k in range(8):
        heads = (heads << U64(8)) | np.where(low + k < high, data[np.minimum(low + k, len(data) - 1)], 0).astype(U64)

    def encode(places: np.ndarray) -> list[np.ndarray]:
        new = [raw[a:b].decode() for a, b in zip(low[places].tolist(), high[places].tolist(), strict=True)]
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    rows, known = cache.of(keys, heads, config.cache_words, encode)
    rows = rows[inverse]
    lengths = known.sizes[rows].astype(np.int64)
    ends = np.cumsum(lengths)
    ids = known.pool[np.repeat(known.begins[rows] - ends + lengths, lengths) + np.arange(int(ends[-1]))]
    bounds = np.concatenate([[0], ends])[np.searchsorted(start, cuts)].tolist()
    found = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    if any(x in raw for x in special):  # their strings are one id wherever they stand
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if any(x in raw[a:b] for x in special):
                found[k] = np.array(tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, "<u4")
    return found


#: Text with the places where vocabularies cut words in different ways (fixed value).
PROBE = "Don't we'll  they've\t'sx ''s '1 I'M x'\n\n y z 12,5 a1_b-c 中文, é. g <|endoftext|> <\n 'd're'v ' ll  "


def check_words(config: TokenFileConfig) -> None:
    """Raises unless this vocabulary cuts words where `encode_block` does."""
    data = np.frombuffer(PROBE.encode(), np.uint8)
    tokenizer, kinds, _, _ = _encoder(config.tokenizer)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    start = lead[byte_level_words(np.frombuffer(PROBE.encode("utf-32-le"), np.uint32), np.array([0, len(lead)]), kinds)].tolist()
    words = [PROBE.encode()[a:b].decode() for a, b in zip(start, [*start[1:], len(data)], strict=True)]
    if tokenizer.normalizer is not None or [len(w) for w in words] != [b - a for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(PROBE)]:
        raise ValueError(f"{config.tokenizer} doesn't cut words as byte-level vocabularies do")


# The tables


def _write(config: TokenFileConfig, root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, folder = pafs.FileSystem.from_uri(root)
        done: list[tuple[int, int, str, int, int]] = []
        writer = out = None

        def finish() -> None:
            writer.close()
            out.close()
            done.append((part, len(done), f"part-{part:06d}-{len(done):04d}-{attempt}.pfor", len(writer.doc_ids), writer.n_ids))

        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, j in blocks(offsets, 1 << 22):
                for doc_id, found in zip(ids[i:j], encode_block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], config), strict=True):
                    if writer is not None and writer.n_ids >= config.file_ids:
                        finish()
                        writer = None
                    if writer is None:
                        out = files.open_output_stream(f"{folder}/part-{part:06d}-{len(done):04d}-{attempt}.pfor")
                        writer = TokenFileWriter(out, config.block_ids, config.percentile)
                    writer.add(doc_id, np.append(found, np.uint32(config.end_id)))
        if writer is not None:
            finish()
        lists = zip(*done, strict=True) if done else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(lists, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "file", "n_docs", "n_ids"])

    return run


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with files.open_input_file(f"{folder}/{name}") as source:
                    file = TokenFile(source)
                    for a, b, ids in file.documents():
                        at = file.doc_starts[a : b + 1].astype(np.int64)
                        offsets = pa.py_buffer(((at - at[0]) * 4).tobytes())
                        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, offsets, pa.py_buffer(ids.astype("<u4").tobytes())])
                        doc_ids = pa.array(file.doc_ids[a:b], pa.int64(), mask=file.nulls[a:b].astype(bool))
                        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(at[:-1] + base), pa.array(np.diff(at)), data.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return run


@dataclass(frozen=True)
class TokenFiles:
    """A written corpus: its folder and the table of its files (part, seq, file, n_docs, n_ids), which are in order of part and seq."""

    root: str
    files: DataFrame

    def placed(self) -> DataFrame:
        """The files with `base`, the number of ids in all files before."""
        order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
        return self.files.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def documents(self) -> DataFrame:
        """From the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
        placed = self.placed().select("file", "base")
        count = max(1, self.files.count())
        return placed.repartition(count).mapInArrow(_read(self.root), "doc_id long, start long, n_tokens long, ids binary")


def write_token_files(docs: DataFrame, config: TokenFileConfig) -> TokenFiles:
    """Files with the ids of all rows of `docs` (doc_id, text), each closed by `end_id`, in ascending order of doc_id.

    Null and empty texts have the closing id alone. Null doc_ids come first; rows that repeat a doc_id follow each
    other in an order of their texts; each is a document of its own. Other columns are ignored; an empty table gives no files. A
    text is handled whole in one task. Files are under the shared folder, which pyarrow must be able to open on the executors
    (a shared path, HDFS or an object store).
    """
    check_words(config)
    scratch = Scratch(docs.sparkSession, "tokens")
    root = f"{scratch.root}/files"
    files, folder = pafs.FileSystem.from_uri(root)
    files.create_dir(folder, recursive=True)
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text").withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return TokenFiles(root, scratch.save(dealt.mapInArrow(_write(config, root), "part int, seq int, file string, n_docs long, n_ids long"), "files"))
