"""Shared pieces of the corpus operators: the shared folder, word streams, packed key exchange.

Vocabulary used by the operators
--------------------------------
block   a set of documents of bounded size that one task holds at a time: runs of rows
        as they are read, cut by their size, so no source, key or copy group makes a
        block large and texts need not be shuffled.
shard   a range of the 64-bit key space (its leading bits).  Each block sends a
        shard only its *distinct* keys, so a key that a third of all rows hold
        arrives once per block.
reply   the answer of a shard to a block, aligned with the sorted keys the block
        sent; the keys need not travel back.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word definition here: space and \t\n\v\f\r.
WS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
_M1, _M2, _GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where that is unset."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    import tempfile

    own = tempfile.mkdtemp(prefix="eventflow-")
    spark.sparkContext.setCheckpointDir(own)
    return own


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """The shuffles made for a table that has been written are needed by nothing else: their files go with it."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: cuts the lineage and survives lost executors.

    Inside ``finished`` it lasts until that ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/eventflow/{name}-{uuid.uuid4().hex}"
    _write(df, path, partition_by)
    if (held := _SCRATCH.get()) is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written; all that was written for it on the way is removed."""
    before = _SCRATCH.get()
    held: list[str] = []
    token = _SCRATCH.set(held)
    try:
        out = make()
        path = f"{shared_dir(spark)}/eventflow/{name}-{uuid.uuid4().hex}"
        _write(out, path)
        out = spark.read.schema(out.schema).parquet(path)
    finally:
        _SCRATCH.reset(token)
        for p in held:
            gone = spark._jvm.org.apache.hadoop.fs.Path(p)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    if before is not None:
        before.append(path)
    return out


@contextmanager
def small_batches(spark: SparkSession, n_bytes: int = 2 << 20) -> Iterator[None]:
    """What is run meanwhile passes rows between the JVM and Python in batches of about ``n_bytes``, so neither side holds 10,000 texts for one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(n_bytes))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def text_bytes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of all texts (two numbers reach the driver)."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("b")).first()
    return int(row["n"] or 0), int(row["b"] or 0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_shards(n_bytes: int, shard_bytes: int) -> int:
    """A power of two that grows with the text."""
    return 1 << max(0, math.ceil(math.log2(max(1, n_bytes / shard_bytes))))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the ordered pair."""
    return mix(mix(a + _GOLD) ^ b)


class Words:
    """The words of a batch of texts: ``codes`` into ``vocabulary``, document after document.

    Null texts have no words.  ``starts[i]:starts[i + 1]`` are the words of text i.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if texts.offset:  # string kernels of some Arrow versions misread arrays that begin inside their buffers
            texts = texts.take(pa.array(np.arange(len(texts))))
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        words, owner = lists.flatten(), np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
        full = pc.not_equal(words, "")
        words = words.filter(full)
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        owner = owner[np.asarray(full)]
        coded = words.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        self.n_docs = len(texts)
        self.doc = owner
        self.codes = np.asarray(coded.indices).astype(np.int64)
        self.vocabulary = coded.dictionary
        self.lengths = np.bincount(owner, minlength=self.n_docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """One 64-bit hash per distinct word (take with ``codes``)."""
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.vocabulary.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(self.vocabulary))


class HashedWords:
    """The words of many texts as places (``codes``, 32 bits) among the sorted distinct word hashes (``keys``).

    Texts are split ``piece_bytes`` at a time, so beyond its result this holds the words of one piece, or of one longer text.
    ``extra``: hashes that ``keys`` holds too.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False, extra: tuple[np.uint64, ...] = (), piece_bytes: int = 2 << 20):
        chunks = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
        hashes, codes, lengths = [], [], [np.empty(0, np.int64)]
        for chunk in chunks:
            for _, part in text_slices(chunk, piece_bytes):
                words = Words(part, lower)
                hashes.append(words.hashes())
                codes.append(words.codes.astype(np.int32))
                lengths.append(words.lengths)
        self.keys = np.unique(np.concatenate([np.array(extra, np.uint64), *hashes]))
        for i, own in enumerate(hashes):
            codes[i] = np.searchsorted(self.keys, own).astype(np.int32)[codes[i]]
        self.codes = np.concatenate([np.empty(0, np.int32), *codes])
        self.lengths = np.concatenate(lengths)
        self.n_docs = len(self.lengths)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)

    @classmethod
    def stored(cls, keys: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> HashedWords:
        """The same from its parts."""
        out = cls.__new__(cls)
        out.keys, out.codes, out.lengths, out.n_docs = keys, codes, lengths, len(lengths)
        out.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return out

    def room(self) -> np.ndarray:
        """For each word, the words from it to the end of its text."""
        return np.repeat(self.starts[1:], self.lengths) - np.arange(len(self.codes))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as compressed byte planes of their differences."""
    if not len(keys):
        return b""
    diff = np.empty_like(keys)
    diff[0] = keys[0]
    np.subtract(keys[1:], keys[:-1], out=diff[1:])
    return _planes(diff)


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_flat(data, np.uint64), dtype=np.uint64) if data else np.empty(0, np.uint64)


def pack(values: np.ndarray) -> bytes:
    return _planes(np.ascontiguousarray(values)) if len(values) else b""


def unpack(data: bytes, kind: type) -> np.ndarray:
    return _flat(data, kind) if data else np.empty(0, kind)


def _planes(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _flat(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_bits(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), count=n).astype(bool)


def shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin in sorted ``keys`` (and the end): shard s holds the s-th equal range."""
    if shards == 1:
        return np.array([0, len(keys)])
    edges = (np.arange(1, shards, dtype=np.uint64)) << U64(64 - (shards.bit_length() - 1))
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted values, where each is found first, and for each entry its place among them (32 bits: half of what ``np.unique`` holds)."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return values[new], order[new], place


def merged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys of all parts, and for each entry of the parts in turn its place among them."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    keys, _, at = ranked(np.concatenate(parts))
    return keys, at


def sliding(values: np.ndarray, width: int, f: np.ufunc, empty: int) -> np.ndarray:
    """f over ``values[i:i + width]`` for each i (beyond the end: ``empty``), by doubling."""
    n = len(values)

    def ahead(x: np.ndarray, k: int) -> np.ndarray:
        out = np.full(n, empty, dtype=x.dtype)
        if k < n:
            out[: n - k] = x[k:]
        return out

    have, out = 1, values
    while have * 2 <= width:
        out = f(out, ahead(out, have))
        have *= 2
    return f(out, ahead(out, width - have)) if have < width else out


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of ``words[i:i + width]`` for each i (meaningless where that passes the end), by doubling."""
    n = len(words)

    def ahead(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.uint64)
        if k < n:
            out[: n - k] = x[k:]
        return out

    out, at, power, have = None, 0, words, 1
    rest = width
    while rest:
        if rest & 1:
            part = ahead(power, at) if at else power
            out = part if out is None else pair(out, part)
            at += have
        rest >>= 1
        if rest:
            power = pair(power, ahead(power, have))
            have *= 2
    return out


def text_slices(texts: pa.Array, max_bytes: int) -> Iterator[tuple[int, pa.Array]]:
    """``texts`` in runs of about ``max_bytes`` (a longer text alone), each with the place where it begins: bounds a task's memory whatever the batch size."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64) + 64)
    at = 0
    while at < len(texts):
        before = int(size[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + max_bytes, side="right")))
        part = texts.slice(at, end - at)
        # a copy: string kernels of some Arrow versions misread arrays that begin inside their buffers, and these would be held whole
        yield at, part.take(pa.array(np.arange(len(part)))) if len(part) < len(texts) else part
        at = end


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` names, each with as many more underscores as no column of ``taken`` (whatever its case) has."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def in_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, of_block: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``of_block(number, rows)`` for runs of rows (columns ``id``, ``text``) of about ``block_bytes`` of text, or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size, k = TaskContext.get().partitionId() << 32, [], 0, 0
        for rb in batches:
            for at, texts in text_slices(rb.column(1), block_bytes):
                if held and size + texts.nbytes > block_bytes:
                    yield from of_block(first | k, pa.Table.from_batches(held)).to_batches()
                    held, size, k = [], 0, k + 1
                held.append(pa.RecordBatch.from_arrays([rb.column(0).slice(at, len(texts)), texts], names=["id", "text"]))
                size += texts.nbytes
        if held:
            yield from of_block(first | k, pa.Table.from_batches(held)).to_batches()

    return docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(run, schema)


def table_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
