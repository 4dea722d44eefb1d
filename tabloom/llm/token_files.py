"""Operator 5, token ids in files of directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level k holds chunk k of all ids that have one, a bitmap with one bit
per chunk that tells whether the id goes on in the next level, and a rank directory: ones before each 512 bits of the
bitmap. Token i is read at position i of level 0, at rank(i) of level 1, and so on; no block is decoded for it.

A file holds the documents of one range of (doc_id, text digest): before the levels come its documents' ids and the
number of tokens before each. Each attempt of a task writes files of its own names, once, without renaming, which not
every store does over a file that is there. The manifest, which Spark commits, names those of the attempt that counts;
files that it doesn't name were left by attempts that broke off. Part numbers ascend with doc_id.

Defined results: a null or empty text has the end id only; a null doc_id sorts first; equal doc_ids are ordered by text
digest; a very long text is encoded in pieces; other columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import Memo, in_groups, is_long, split_white
from .common import cut, new_path, slices, text_pieces

MAGIC = b"TBLDAC1\n"
BITS = 512  # bits of bitmap per entry of the rank directory
#: Rows of a range of documents, and tokens of a file; a range with more tokens has several files.
ROWS, FILE_TOKENS = 8192, 1 << 23
#: Tasks that read files back, at most.
READERS = 8192
#: Chunks that are encoded as one text, and what may part them there: the first of these that is one token.
JOINED, MARKS = 128, "~|^"
#: Bytes of the chunks and ids that a worker keeps.
KEPT = 96 << 20
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Codes:
    """Levels of directly addressable codes."""

    def __init__(self, n: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.n, self.levels = n, levels

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        levels, rest = [], np.asarray(ids)
        if rest.dtype != np.uint16:
            rest = rest.astype(np.uint32, copy=False)
        while True:
            goes_on = rest > 255
            bitmap = np.packbits(goes_on, bitorder="little")
            bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (BITS // 8), np.uint8)])
            per_block = _ONES[bitmap].reshape(-1, BITS // 8).sum(1, dtype=np.uint64)
            levels.append((rest.astype(np.uint8), bitmap, np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint64)))
            rest = rest[goes_on]
            rest >>= 8
            if not len(rest):
                return cls(len(ids), levels)

    def rank(self, level: int, i: int) -> int:
        """Ones before bit i of a level's bitmap."""
        _, bitmap, directory = self.levels[level]
        block = i // BITS
        at = block * (BITS // 8)
        ones = int(directory[block]) + int(_ONES[bitmap[at : i // 8]].sum())
        return ones + (bin(int(bitmap[i // 8]) & ((1 << (i % 8)) - 1)).count("1") if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = level = 0
        while True:
            chunks, bitmap, _ = self.levels[level]
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                return value
            i, level, shift = self.rank(level, i), level + 1, shift + 8

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids start to end - 1, through the ranks of start only."""
        return self._values(0, start, end)

    def _values(self, level: int, start: int, end: int) -> np.ndarray:
        chunks, bitmap, _ = self.levels[level]
        out = chunks[start:end].astype(np.uint32)
        bits = np.unpackbits(bitmap[start // 8 : (end + 7) // 8], bitorder="little")[start % 8 : start % 8 + end - start].view(bool)
        n = int(np.count_nonzero(bits))
        if n:
            first, more = self.rank(level, start), np.zeros(end - start, np.uint32)
            more[bits] = self._values(level + 1, first, first + n)
            out |= more << np.uint32(8)
        return out

    def dump(self, f) -> None:
        f.write(struct.pack("<QQ", self.n, len(self.levels)))
        for chunks, bitmap, directory in self.levels:
            f.write(struct.pack("<QQQ", len(chunks), len(bitmap), len(directory)))
            for a in (chunks, bitmap, directory):
                f.write(a.data)

    @classmethod
    def load(cls, f) -> Codes:
        n, count = struct.unpack("<QQ", f.read(16))
        levels = []
        for _ in range(count):
            a, b, c = struct.unpack("<QQQ", f.read(24))
            levels.append((np.frombuffer(f.read(a), np.uint8), np.frombuffer(f.read(b), np.uint8), np.frombuffer(f.read(8 * c), np.uint64)))
        return cls(n, levels)


def write_file(f, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
    f.write(MAGIC)
    f.write(struct.pack("<Q", len(doc_ids)))
    f.write(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    f.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    f.write(np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes())
    Codes.of(ids).dump(f)


def open_file(data: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """Documents, tokens before each (and all), codes."""
    f = io.BytesIO(data)
    if f.read(8) != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack("<Q", f.read(8))
    null = np.frombuffer(f.read(n), np.uint8)
    ids = np.frombuffer(f.read(8 * n), "<i8")
    return [None if x else int(d) for x, d in zip(null, ids, strict=True)], np.frombuffer(f.read(8 * n + 8), "<u8").astype(np.int64), Codes.load(f)


@lru_cache(2)
def _about(path: str) -> tuple[list[dict], list[str], int]:
    """A tokenizer's normalizers, what it has as added tokens, and its largest id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    own, added = spec.get("normalizer") or {}, spec.get("added_tokens", [])
    return own.get("normalizers", [own]), [x["content"] for x in added], max([0, *spec["model"]["vocab"].values(), *[x["id"] for x in added]])


def id_type(path: str) -> np.dtype:
    """The narrower type of 16 or 32 bits that holds each id of a tokenizer."""
    return np.dtype("<u2" if _about(path)[2] < 1 << 16 else "<u4")


@lru_cache(2)
def library_memo(path: str) -> Memo:
    """Ids, as bytes of id_type(), that the tokenizers library gives for chunks; white space never takes part in a token of it."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, kind, lowered = Tokenizer.from_file(path), id_type(path), lower_caser(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    # For text that the normalizer would leave as it is, and that holds no added token: the same model without them.
    settled = tokenizer
    if all(x.get("type") != "Replace" or (x["pattern"], x["content"]) == ({"Regex": "\\s+"}, " ") for x in _about(path)[0]):
        settled = Tokenizer(tokenizer.model)
        settled.pre_tokenizer = tokenizer.pre_tokenizer

    mark, mark_id = next(((x, ids[0]) for x in MARKS if len(ids := tokenizer.encode(x, add_special_tokens=False).ids) == 1), (None, None))

    def alone(chunks: list[str]) -> Iterator[bytes]:
        for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False):
            yield np.array(e.ids, kind).tobytes()

    def work(chunks: list[str]) -> Iterator[bytes]:
        """Many chunks as one text, parted by a mark that no chunk holds: the library takes time for each text."""
        for at in range(0, len(chunks), JOINED):
            some = chunks[at : at + JOINED]
            text = f" {mark} ".join(some)
            if mark is None or text.count(mark) != len(some) - 1:
                yield from alone(some)
                continue
            by = settled if lowered(text) == text else tokenizer
            ids = np.array(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, kind)
            cuts = np.flatnonzero(ids == mark_id).tolist()
            if len(cuts) != len(some) - 1:
                yield from alone(some)
                continue
            raw, size = ids.tobytes(), kind.itemsize
            yield from [raw[size * i : size * j] for i, j in zip([0, *[c + 1 for c in cuts]], [*cuts, len(ids)], strict=True)]

    return Memo(work, KEPT)


#: Letters whose lower case may not be what the tokenizer makes of them one by one, or that meet others before that.
_APART = re.compile("[^\x00-\u012f\u0131-\u02ff]")


@lru_cache(2)
def lower_caser(path: str) -> Callable[[str], str | None]:
    """Gives a text in lower case if the tokenizer's normalizer would do just that between white space, else None."""
    normalizers, added, _ = _about(path)
    kinds, special = {x.get("type") for x in normalizers}, [x.lower() for x in added]
    if "Lowercase" not in kinds or not kinds <= {"NFC", "Replace", "Lowercase"}:
        return lambda text: None

    def lowered(text: str) -> str | None:
        if not text.isascii() and _APART.search(text):
            return None
        low = text.lower()
        # What only looks like a special token isn't one.
        return None if any(x in low for x in special) else low

    return lowered


@lru_cache(2)
def folded(path: str) -> Callable[[str], str]:
    """Lower-cases a text if the tokenizer would do just that, so that fewer chunks are different."""
    lowered = lower_caser(path)

    def fold(text: str) -> str:
        low = lowered(text)
        return text if low is None else low

    return fold


def check_chunkable(path: str) -> None:
    """Chunks may be encoded one by one only if the file's splitter parts tokens at white space."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if "\\s" not in json.dumps(spec.get("pre_tokenizer")) or spec["model"].get("end_of_word_suffix") is None:
        raise ValueError("the tokenizer must end words at white space")


def encode_to_bytes(texts: list[str | None], path: str, kind: np.dtype = np.dtype("<u4")) -> Iterator[bytes]:
    """The ids of each text as bytes of kind."""
    memo, fold, own = library_memo(path), folded(path), id_type(path)

    def typed(raw: bytes) -> bytes:
        return raw if kind == own else np.frombuffer(raw, own).astype(kind).tobytes()

    for a, b in in_groups(texts):
        if is_long(texts, a, b):
            yield typed(b"".join([b"".join(memo.values_of(split_white(fold(piece)))) for piece in text_pieces(texts[a])]))
            continue
        lists = [split_white(fold(t or "")) for t in texts[a:b]]
        values, at = memo.values_of(list(chain.from_iterable(lists))), 0
        for n in map(len, lists):
            yield typed(b"".join(values[at : at + n]))
            at += n


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def put(folder: str, name: str, write: Callable) -> None:
    """A new file of folder; write(stream) fills it."""
    fs, base = _files(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(posixpath.join(base, name)) as f:
        write(f)


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 1, rows: int = ROWS) -> DataFrame:
    """Encode doc_id, text and write the files of folder; gives its manifest: part, file, n_docs, n_tokens, base."""
    check_chunkable(path)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("digest", F.xxhash64("text"))
    ranges = max(1, -(-docs.count() // rows))

    def run(batches):
        part = TaskContext.get().partitionId()
        kind = np.result_type(id_type(path), np.min_scalar_type(end_id))
        end = np.array([end_id], kind).tobytes()
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held = bytearray()
        made = 0

        def flush():
            nonlocal doc_ids, lengths, held, made
            name, ids = f"{part:08d}-{made:06d}-{uuid.uuid4().hex}.dac", np.frombuffer(held, kind)
            put(folder, name, lambda f: write_file(f, doc_ids, lengths, ids))
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([made]), pa.array([name]), pa.array([len(doc_ids)]), pa.array([len(ids)])], names=["part", "piece", "file", "n_docs", "n_tokens"])
            doc_ids, lengths, held, made = [], [], bytearray(), made + 1
            return row

        for some in slices(batches, 512):
            for doc, ids in zip(some.column("doc_id").to_pylist(), encode_to_bytes(some.column("text").to_pylist(), path, kind), strict=True):
                doc_ids.append(doc)
                lengths.append(len(ids) // kind.itemsize + 1)
                held += ids
                held += end
                if len(held) >= FILE_TOKENS * kind.itemsize:
                    yield flush()
        if doc_ids:
            yield flush()

    ordered = docs.repartitionByRange(ranges, "doc_id", "digest").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")
    manifest = cut(ordered.mapInArrow(run, "part long, piece long, file string, n_docs long, n_tokens long"), "token-manifest")
    # One task for all files, of a slim row each: a file has up to FILE_TOKENS tokens.
    w = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str, readers: int = READERS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files, in up to readers tasks."""

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, at = _files(folder)
                with fs.open_input_stream(posixpath.join(at, name)) as f:
                    doc_ids, before, codes = open_file(f.read())
                crcs = []
                # Documents in blocks of about a million tokens: neighbouring slices of the codes.
                start = 0
                while start < len(doc_ids):
                    stop = max(start + 1, int(np.searchsorted(before, before[start] + (1 << 20), "right")) - 1)
                    ids = codes.slice(int(before[start]), int(before[stop])).astype("<u4")
                    crcs += [zlib.crc32(ids[before[i] - before[start] : before[i + 1] - before[start]]) for i in range(start, stop)]
                    start = stop
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(before[:-1] + base), pa.array(np.diff(before)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # A number of partitions is given, as Spark would else merge these slim rows into one task.
    files = manifest.select("part", "piece", "file", "base").repartition(max(1, min(readers, manifest.count())), "part", "piece")
    return files.select("file", "base").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write the files in a new folder of the shared one and read them back."""
    folder = new_path(spark, "tokens")
    return read_token_files(write_token_files(docs, path, folder, end_id), folder)
