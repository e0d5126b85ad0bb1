"""Token ids in binary files with Elias-Fano encoded document boundaries.

A file holds the ids of consecutive documents as one array, and where each
document ends as an Elias-Fano sequence: about two bits and log2(mean length)
bits a document rather than a table of 64-bit offsets.  ``select`` on the upper
bits gives an offset without decoding the others.

File format, little-endian::

    magic "CTOK0001" | u32 header length | header: JSON (counts, sizes, width)
    | doc ids: deltas of one width | lower bits, packed | upper bits, unary
    | select samples u32 | ids

Documents without an id come first; the header counts them.  Every section starts at
a multiple of eight bytes.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import check_columns, scratch_path, stage_table

MAGIC = b"CTOK0001"
#: A sampled position of every so many set bits speeds up select.
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of whole numbers with select by index."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, int(math.floor(math.log2(top / n)))) if n else 0
        upper = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(upper[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[upper] = 1
        if low_bits:
            each = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(each.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, dtype=np.uint8)
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), upper[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Value ``i``: reads the sample before it and the bits from there on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        upper = byte * 8 + (word & -word).bit_length() - 1 - i
        low, first = 0, i * self.low_bits
        if self.low_bits:
            span = bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8])
            low = (int.from_bytes(span, "little") >> (first % 8)) & ((1 << self.low_bits) - 1)
        return (upper << self.low_bits) | low

    def all(self) -> np.ndarray:
        """Every value, decoded at once."""
        upper = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64) - np.arange(self.n, dtype=np.uint64)
        if not self.low_bits:
            return upper
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (upper << np.uint64(self.low_bits)) | low


def _pad(size: int) -> bytes:
    return b"\0" * (-size % 8)


def file_parts(doc_ids: list[int | None], lengths: list[int], ids: list[bytes], width: int) -> Iterator[bytes]:
    """The bytes of a file, part by part; each of ``ids`` has ``width`` bytes an id.

    Documents without an id come first and are counted in the header.
    """
    nulls = sum(d is None for d in doc_ids)
    ends = EliasFano.build(np.cumsum(np.array(lengths, dtype=np.uint64)))
    own = np.array(doc_ids[nulls:], dtype=np.int64)
    deltas = np.diff(own)
    # Ids that follow each other closely need few bytes.
    small = next((t for t in ("<i1", "<i2", "<i4") if abs(deltas).max(initial=0) <= np.iinfo(t).max), "<i8")
    sections = {"doc_ids": deltas.astype(small).tobytes(), "low": ends.low.tobytes(), "high": ends.high.tobytes(), "samples": ends.samples.astype("<u4").tobytes()}
    sizes = {k: len(v) for k, v in sections.items()} | {"ids": sum(map(len, ids))}
    head = json.dumps({"n": len(doc_ids), "nulls": nulls, "low_bits": ends.low_bits, "width": width, "first": int(own[0]) if len(own) else 0, "delta": small, "sizes": sizes}).encode()
    for part in (MAGIC + len(head).to_bytes(4, "little") + head, *sections.values()):
        yield part + _pad(len(part))
    yield from ids
    yield _pad(sizes["ids"])


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """The bytes of a file at once."""
    return b"".join(file_parts(list(doc_ids), list(lengths), [ids], width))


class TokenFile:
    """Reads one file: documents by place, offsets through select.

    ``doc_ids`` holds the ids behind the first ``nulls`` documents, which have none.
    """

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(data[8:12], "little")
        head = json.loads(data[12 : 12 + size])
        at, part = 12 + size + -(12 + size) % 8, {}
        for name, length in head["sizes"].items():
            part[name] = memoryview(data)[at : at + length]
            at += length + -length % 8
        u8 = lambda name: np.frombuffer(part[name], dtype=np.uint8)
        self.n, self.nulls, self.width = head["n"], head["nulls"], head["width"]
        self.ends = EliasFano(self.n, head["low_bits"], u8("low"), u8("high"), np.frombuffer(part["samples"], dtype="<u4"))
        deltas = np.frombuffer(part["doc_ids"], dtype=head["delta"]).astype(np.int64)
        self.doc_ids = np.cumsum(np.concatenate([[head["first"]], deltas])) if self.n > self.nulls else np.zeros(0, dtype=np.int64)
        self.ids = np.frombuffer(part["ids"], dtype=f"<u{self.width}")

    def doc_id(self, i: int) -> int | None:
        return int(self.doc_ids[i - self.nulls]) if i >= self.nulls else None

    def bounds(self, i: int) -> tuple[int, int]:
        """First and end place of document ``i`` in the id array."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]


#: Characters below the first of which all letters and digits are long settled.
_PLAIN = re.compile("[!-~\xa1-\u052f]*")
#: Letters that normalising only lower-cases: Latin but for one, and Cyrillic.
_SIMPLE = re.compile("[!-~\xa1-\u012f\u0131-\u02ff\u0400-\u0482\u048a-\u052f]*")
#: Combining marks below there; a lower-cased letter may end in one.
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489]")
_ASCII_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones as they are."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Memo(dict):
    """Computes what it lacks; short keys are kept."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= 64:
            self[key] = value
        return value


class CachedEncoder:
    """Encodes texts with a lower-casing byte-level BPE that drops white space.

    The ids of each chunk between ASCII white space are kept as bytes, in two
    generations of at most ``limit`` chunks, so that memory is bounded and
    common chunks are encoded once.  A new chunk of Latin, Greek or Cyrillic
    letters is cut into the tokenizer's pieces, which are chunks of their own:
    only those not met before go through the library's merges; any other chunk
    goes through the whole tokenizer.  The result equals encoding the whole text,
    as no rule of the tokenizer reaches over white space; the tests compare both.
    """

    def __init__(self, path: str, width: int, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.width, self.limit = Tokenizer.from_file(path), width, limit
        self.model, self.normalizer, self.letters = self.tokenizer.model, self.tokenizer.normalizer, _byte_letters()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.added)
        self.chunks = _Memo(self._chunk)
        self.old: dict[bytes, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=f"<u{self.width}").tobytes() if len(ids) > 8 else b"".join([i.to_bytes(self.width, "little") for i in ids])

    def _piece(self, piece: str) -> bytes:
        spelt = piece.encode().decode("latin-1").translate(self.letters)
        return self._pack([t.id for t in self.model.tokenize(spelt)])

    def _chunk(self, key: bytes) -> bytes:
        if (held := self.old.get(key)) is not None:
            return held
        chunk = key.decode("utf-8", "surrogatepass")
        plain = chunk.isascii()
        if not (chunk.isprintable() if plain else _PLAIN.fullmatch(chunk)) or (self.mark in chunk and any(t in chunk for t in self.added)):
            return self._pack(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        low = chunk.lower() if plain or _SIMPLE.fullmatch(chunk) else self.normalizer.normalize_str(chunk)
        pieces = [low] if plain and low.isalpha() else (_ASCII_PIECES if plain else _PIECES).findall(low)
        if low == chunk and len(pieces) == 1:
            return self._piece(low)
        if not plain and _MARKS.search(low):
            # As chunks these pieces would be normalised once more.
            return b"".join(map(self._piece, pieces))
        return b"".join([self.chunks[x.encode()] for x in pieces])

    def encode(self, text: str) -> bytes:
        # Bytes split at ASCII white space alone; other white space stays inside.
        out = b"".join(map(self.chunks.__getitem__, text.encode("utf-8", "surrogatepass").split()))
        if len(self.chunks) > self.limit:
            self.old = self.chunks
            self.chunks = _Memo(self._chunk)
        return out


_ENCODERS: dict[tuple, CachedEncoder] = {}


def encoder(path: str, width: int) -> CachedEncoder:
    """One encoder a worker process; Python workers serve many tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = CachedEncoder(path, width)
    return _ENCODERS[path, width]


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(documents: DataFrame, out: str, tokenizer: str, end_id: int, width: int = 2, docs_per_file: int = 100_000, mb_per_file: int = 64) -> DataFrame:
    """Encode ``documents`` in ascending doc_id order into files under ``out``.

    Returns the manifest: path, part, n_docs, n_ids of each file, a table in the
    shared folder.  Documents are dealt to ranges of doc_id; a task sorts its
    range, encodes it document by document and writes files of at most about
    ``mb_per_file``.  A file's name is its own to the attempt that wrote it and
    only files of attempts that succeeded come into the manifest, so lost
    executors leave strays but no wrong rows.  Null texts are empty documents of
    one id; rows with a null id come before all others; repeated ids follow each
    other, ordered by a hash of their text.  The manifest is one file of a row for
    each token file, however many tasks encode.
    """
    check_columns(documents, "doc_id", "text")
    limit = mb_per_file << 20

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), encoder(tokenizer, width)
        end = int(end_id).to_bytes(width, "little")
        fs, root = _open_fs(out)
        ids, lengths, blobs, held, k = [], [], [], 0, 0

        def flush() -> pd.DataFrame:
            nonlocal ids, lengths, blobs, held, k
            path = f"{root}/part-{part:06d}-{k:04d}-{uuid.uuid4().hex}.ctok"
            with fs.open_output_stream(path) as f:
                for piece in file_parts(ids, lengths, blobs, width):
                    f.write(piece)
            row = pd.DataFrame({"path": [path], "part": [part * 100_000 + k], "n_docs": [len(ids)], "n_ids": [sum(lengths)]})
            ids, lengths, blobs, held, k = [], [], [], 0, k + 1
            return row

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                blob = coder.encode(text or "") + end
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                lengths.append(len(blob) // width)
                blobs.append(blob)
                held += len(blob)
                if held >= limit or len(ids) >= docs_per_file:
                    yield flush()
        if ids:
            yield flush()

    fs, root = _open_fs(out)
    fs.create_dir(root, recursive=True)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = ranged.mapInPandas(encode, "path string, part long, n_docs long, n_ids long")
    # One task writes the few rows: Hadoop's local file system starts a chmod for each file,
    # and for a moment the executor's whole memory counts for the new process as well.
    return stage_table(manifest.repartition(1), "token-manifest")


def read_token_files(manifest: DataFrame, out: str, with_ids: bool = False) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32 (and ids).

    ``start`` counts the ids of all documents before; the files' own starts are
    running sums over the manifest, one row a file.  A task holds one file.
    """
    from pyspark.sql import Window

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _open_fs(out)
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"]):
                with fs.open_input_stream(path) as f:
                    file = TokenFile(f.read())
                for lo in range(0, file.n, 2000):
                    rows: dict = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                    for i in range(lo, min(file.n, lo + 2000)):
                        a, b = file.bounds(i)
                        own = file.ids[a:b]
                        rows["doc_id"].append(file.doc_id(i))
                        rows["start"].append(base + a)
                        rows["n_tokens"].append(b - a)
                        rows["ids_crc32"].append(zlib.crc32(own.astype("<u4").tobytes()))
                        rows["ids"].append(own.astype(np.int64) if with_ids else None)
                    if not with_ids:
                        del rows["ids"]
                    rows["doc_id"] = pd.array(rows["doc_id"], dtype="Int64")
                    yield pd.DataFrame(rows)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    files = based.select("path", "base").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return files.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def encode_and_read(documents: DataFrame, tokenizer: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Write the token files of ``documents`` to the shared folder and read them back."""
    out = out or scratch_path(documents.sparkSession, "tokens")
    return read_token_files(write_token_files(documents, out, tokenizer, end_id), out)


def default_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Path of an installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)
