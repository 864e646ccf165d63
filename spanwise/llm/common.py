"""Shared helpers of the training-data operators: tables, checkpoints and word arrays.

Texts are handled as one UTF-8 byte buffer per slice of rows, so that splitting and
hashing words are a few numpy passes and no Python object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators.checkpoints import ensure_checkpoint_dir  # noqa: F401  for the operators here

#: Bytes of text that one slice of an Arrow batch holds (a single longer text makes a slice of its own).
SLICE_BYTES = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_state() -> dict:
    """What a Python worker keeps between tasks (functions come with each task, so their globals don't last)."""
    module = sys.modules.setdefault("_spanwise_worker_state", types.ModuleType("_spanwise_worker_state"))
    return module.__dict__.setdefault("kept", {})


def _lean() -> None:
    """Let a worker's Arrow buffers go back to the system when they are freed, not to a pool."""
    if not worker_state().get("lean"):
        pa.set_memory_pool(pa.system_memory_pool())
        worker_state()["lean"] = True


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task whose worker, which waits for further tasks, gives the memory of its arrays back at the end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        with contextlib.suppress(OSError, AttributeError):  # another C library frees in its own way
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def text_slices(batch: pa.RecordBatch | pa.Table, text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Cut a batch into row ranges of about size bytes of text, never cutting a text."""
    _lean()
    table = pa.table(batch) if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
    table = table.combine_chunks()
    if not table.num_rows:
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(table[text]), 0).to_numpy()
    group = (np.cumsum(lengths.astype(np.int64)) - lengths) // size
    cuts = np.flatnonzero(np.diff(group)) + 1
    for start, end in zip([0, *cuts], [*cuts, table.num_rows], strict=True):
        yield table.slice(start, end - start).combine_chunks()


def pack_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts compressed one by one (length, then zstd), for a shuffle that carries them; read by unpacked_slices."""
    schema = StructType([StructField(f.name, BinaryType() if f.name == text else f.dataType, f.nullable) for f in docs.schema])
    at = docs.columns.index(text)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=6)
        for batch in batches:
            raw = batch.column(at).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
            packed = [None if x is None else len(x).to_bytes(8, "little") + (codec.compress(x, asbytes=True) if x else b"") for x in raw]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def unpacked_slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Row ranges of about size bytes of text, with packed texts unpacked as bytes."""
    _lean()
    table = pa.Table.from_batches([batch])
    packed = table[text].to_pylist()
    lengths = np.array([0 if x is None else int.from_bytes(x[:8], "little") for x in packed], np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // size)) + 1
    at = table.schema.get_field_index(text)
    for start, end in zip([0, *cuts], [*cuts, len(packed)], strict=True):
        if start == end:
            return
        raw = [None if x is None else pa.decompress(memoryview(x)[8:], decompressed_size=int(n), codec="zstd", asbytes=True) if n else b"" for x, n in zip(packed[start:end], lengths[start:end], strict=True)]
        yield table.slice(start, end - start).set_column(at, text, pa.array(raw, pa.large_binary())).combine_chunks()


def text_buffer(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all the column's texts and the offsets of each (nulls are empty)."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0) if array.num_chunks else pa.array([], array.type)
    array = array.cast(pa.large_binary()) if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else array.cast(pa.large_string()).cast(pa.large_binary())
    array = pa.compute.fill_null(array, b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts: byte ranges, and where each text's words begin."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(texts) + 1 positions in start

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def of_text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count())


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = (data != 32) & ((data < 9) | (data > 13))
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edge - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * _C
    x = x ^ (x >> np.uint64(29))
    x = x * _B
    return x ^ (x >> np.uint64(32))


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The little-endian 8 bytes from every place of the buffer (zeros beyond its end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte range, by 8 bytes at a time over all ranges."""
    view, length = eight_bytes(data), end - start
    h = mix((length.astype(np.uint64) + np.uint64(seed)) * _A)
    live, at = np.arange(len(start)), start.astype(np.int64)
    left = length.astype(np.int64)
    while len(live):
        part = view[at]
        short = left < 8
        if short.any():
            keep = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
            part = np.where(short, part & ((np.uint64(1) << (keep % np.uint64(64))) - np.uint64(1)), part)
        h[live] = mix((h[live] ^ part) * _A + _B)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def word_hashes(words: Words, seed: int = 0) -> np.ndarray:
    return hash_ranges(words.data, words.start, words.end, seed)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
