"""Corpus statistics by parts and exchanges.

Counting every word pair or shingle of a corpus as rows of a table costs a row for each. Here documents are packed into
parts of bounded size, in which words are numbers of the part's own dictionary. A part counts its keys (64-bit hashes)
in numpy, cuts them by ranges of the hash into buckets, and sends each bucket one compressed row. A bucket sums what all
parts send and answers each part in the order of its keys. So a statistic over the whole corpus takes one row per pair
of part and bucket, however skewed its keys are: a key is at most one entry of each part, and hashes spread evenly.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

PART_CHARS = 13_500_000  # of text in one part; a longer text makes a part of its own
MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(a: np.ndarray) -> bytes:
    """An array of integers or floats as compressed byte planes."""
    import zstandard

    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    import zstandard

    dtype = np.dtype(dtype)
    raw = zstandard.ZstdDecompressor().decompress(b)
    planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, len(raw) // dtype.itemsize)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys, as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def join_blobs(blobs: list[bytes]) -> bytes:
    return b"".join([len(blobs).to_bytes(4, "little"), *(len(x).to_bytes(8, "little") for x in blobs), *blobs])


def split_blobs(b: bytes) -> list[bytes]:
    n = int.from_bytes(b[:4], "little")
    sizes = [int.from_bytes(b[4 + 8 * i : 12 + 8 * i], "little") for i in range(n)]
    at, out = 4 + 8 * n, []
    for s in sizes:
        out.append(b[at : at + s])
        at += s
    return out


def mix64(a: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    a = a.astype(np.uint64, copy=True)
    a ^= a >> np.uint64(30)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(27)
    a *= np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def release() -> None:
    """Gives freed memory back: a worker lives on after its task, and would keep the most that any part needed."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Part:
    """Documents as numbers of a dictionary: ids (and whether null), lengths in tokens, tokens, words."""

    def __init__(self, number: int, ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, words: list[bytes]):
        self.number, self.ids, self.known, self.lengths, self.tokens, self.words = number, ids, known, lengths, tokens, words
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def blob(self) -> bytes:
        text = zlib.compress(b"\n".join(self.words), 1)
        return join_blobs([pack(self.ids), pack(self.known), pack(self.lengths), pack(self.tokens), text])

    @classmethod
    def of(cls, number: int, blob: bytes) -> Part:
        ids, known, lengths, tokens, text = split_blobs(blob)
        words = zlib.decompress(text)
        return cls(number, unpack(ids, np.int64), unpack(known, np.uint8).astype(bool), unpack(lengths, np.int64), unpack(tokens, np.int32), words.split(b"\n") if words else [])


def make_parts(docs: DataFrame, split: Callable[[str], list[bytes]], key: str = "doc_id", text: str = "text", chars: int = PART_CHARS) -> DataFrame:
    """part, tag (-1), payload: the documents packed, each in one part. `split` gives a text's words in UTF-8, which hold no
    line feed; null texts have none. Written as a table, so that a part stays the same through all later steps."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 24, 0
        names = defaultdict(count().__next__)  # a new word takes the next number
        ids, lengths, tokens, held = [], [], [], 0

        def flush():
            nonlocal made, names, ids, lengths, tokens, held
            part = Part(
                base + made,
                np.array([i or 0 for i in ids], np.int64),
                np.array([i is not None for i in ids], np.uint8),
                np.array(lengths, np.int64),
                np.concatenate(tokens) if tokens else np.zeros(0, np.int32),
                list(names),
            )
            row = pa.RecordBatch.from_arrays([pa.array([part.number], pa.int64()), pa.array([-1], pa.int32()), pa.array([part.blob()], pa.binary())], ["part", "tag", "payload"])
            made, names, ids, lengths, tokens, held = made + 1, defaultdict(count().__next__), [], [], [], 0
            return row

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for k in range(len(keys)):
                t = texts[k].as_py() or ""
                if ids and held + len(t) + 64 > chars:
                    yield flush()
                words = split(t)
                ids.append(keys[k].as_py())
                lengths.append(len(words))
                tokens.append(np.fromiter(map(names.__getitem__, words), np.int32, len(words)))
                held += len(t) + 64  # so that empty texts fill a part, too
        if ids:
            yield flush()

    packed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "part long, tag int, payload binary")
    return materialise(packed, "parts")


def grouped(batches, first: str) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows sorted by `first`: for each of its values, (the other number, payload) of its rows."""
    now, rows = None, []
    for batch in batches:
        names = batch.schema.names
        a, b = names.index(first), next(i for i, n in enumerate(names) if n in ("part", "tag") and n != first)
        x, y, p = batch.column(a).to_pylist(), batch.column(b).to_pylist(), batch.column(names.index("payload"))
        for i in range(len(x)):
            if x[i] != now:
                if rows:
                    yield now, rows
                now, rows = x[i], []
            rows.append((y[i], p[i].as_py()))
    if rows:
        yield now, rows


SCHEMA = "part long, tag int, payload binary"


def _table(rows):
    import pyarrow as pa

    for part, tag, payload in rows:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([tag], pa.int32()), pa.array([payload], pa.binary())], ["part", "tag", "payload"])


def at_parts(states: list[DataFrame], n_parts: int, run: Callable[[Part, dict[int, bytes]], Iterator], schema: str = SCHEMA, raw: bool = False) -> DataFrame:
    """`run` at each part, with the answers that it got, by tag. The first of `states` are the parts; the others hold
    rows (part, tag >= 0, payload). Gives the rows (part, tag, payload) that run yields, or if raw its record batches."""
    if len(states) == 1:  # nothing to bring together: parts are worked on where they lie

        def alone(batches):
            for batch in batches:
                for number, blob in zip(batch.column(0).to_pylist(), batch.column(2)):
                    found = run(Part.of(number, blob.as_py()), {})
                    yield from found if raw else _table(found)
                    found = None
                    release()

        return states[0].mapInArrow(alone, schema)
    every = states[0]
    for other in states[1:]:
        every = every.unionByName(other.filter("part >= 0"))

    def go(batches):
        for number, rows in grouped(batches, "part"):
            got = dict(rows)
            found = run(Part.of(number, got.pop(-1)), got)
            yield from found if raw else _table(found)
            found = got = rows = None
            release()

    return every.repartition(n_parts, "part").sortWithinPartitions("part", "tag").mapInArrow(go, schema)


def at_buckets(sent: DataFrame, n_buckets: int, run: Callable[[int, list[tuple[int, bytes]]], Iterator]) -> DataFrame:
    """`run` at each bucket (the tag of the rows sent), with all (part, payload); gives rows for parts, or (-1, ...) for
    whoever sums up."""

    def go(batches):
        for bucket, rows in grouped(batches, "tag"):
            yield from _table(run(bucket, rows))
            rows = None
            release()

    return materialise(sent.repartition(n_buckets, "tag").sortWithinPartitions("tag", "part").mapInArrow(go, SCHEMA), "answers")


def edges_of(n_buckets: int) -> np.ndarray:
    """Upper ends of equal ranges of the 64-bit hashes, but for the last."""
    return np.array([((k + 1) << 64) // n_buckets for k in range(n_buckets - 1)], np.uint64)


def send_keys(part: int, keys: np.ndarray, values: list[np.ndarray], n_buckets: int):
    """Rows for the buckets: ascending distinct keys and arrays along them."""
    cuts = [0, *np.searchsorted(keys, edges_of(n_buckets)).tolist(), len(keys)]
    for b, (a, z) in enumerate(zip(cuts, cuts[1:])):
        if z > a:
            yield part, b, join_blobs([pack_sorted(keys[a:z]), *(pack(v[a:z]) for v in values)])


def sum_keys(rows: list[tuple[int, bytes]], dtypes: list) -> tuple[list[int], list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """At a bucket: the parts, each one's places in the distinct keys, the keys, and sums along them."""
    parts, keys, values = [], [], [[] for _ in dtypes]
    for part, payload in rows:
        blobs = split_blobs(payload)
        parts.append(part)
        keys.append(unpack_sorted(blobs[0]))
        for out, b, t in zip(values, blobs[1:], dtypes):
            out.append(unpack(b, t))
    distinct, places = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(places, weights=np.concatenate(v), minlength=len(distinct)) for v in values]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return parts, np.split(places, cuts), distinct, sums
