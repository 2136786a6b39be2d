"""Line dedup: a line found in many documents stays only in the document with the largest id.

Lines travel as rows (hash, document, position), never as text.  They are
range-partitioned by (hash, document, position) and sorted within their partition, so
even a line that a third of all documents hold is split over several partitions.
Each partition is read once, in order; groups of equal hashes that lie inside it are
decided on the spot.  Only the first and the last group can go on in a neighbouring
partition: their partial counts (two rows per partition at most) are merged in a small
second step.  What returns to the documents is one compressed bitmap of kept lines per
document that loses any.

Null or empty text: one empty line, kept.  A null id counts as a document below every
other id.  Rows of equal id count as one document; those of equal id and text share
their decisions.  Ids are whole numbers; others are refused with a TypeError before anything runs.  Line keys are
compared by a 128-bit hash.  Texts are read a piece at a time, a very long one alone.  Other columns stay as they are, whatever they
are called.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from eventflow.llm.common import WS, col, finished, free_names, shuffle_partitions, text_bytes, text_slices, written

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_NULL_ID = -(1 << 63)
#: Text that is worked on at a time.
_PIECE_BYTES = 4 << 20
_LINE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("pos", pa.int32())])
_SEEN = pa.schema([("kind", pa.int8()), *_LINE])


def line_key(line: str) -> str:
    """White space off both ends, A-Z lower-cased."""
    return line.strip(WS).translate(_LOWER)


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at, texts in text_slices(rb.column(2), _PIECE_BYTES):
                hashes, doc, row, pos = [], [], [], []
                for d, r, t in zip(*(rb.column(i).slice(at, len(texts)).to_pylist() for i in range(2)), texts.to_pylist(), strict=True):
                    if not t or len(t) < min_chars:
                        continue
                    for i, line in enumerate(t.split("\n")):
                        if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                            hashes.append(xxhash.xxh3_128_digest(key.encode()))
                            doc.append(d)
                            row.append(r)
                            pos.append(i)
                h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(pos, pa.int32())], schema=_LINE)

    return run


def _first_occurrences(min_docs: int):
    """Sorted line rows to (kind 0) lines that go, (kind 1) lines of border groups, (kind 2) border groups' first and last document (doc, row) and documents (pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=_LINE)
        a, b, doc, row, pos = (table.column(i).to_numpy() for i in range(5))
        n = len(a)
        if not n:
            return
        new_key = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        new_doc = new_key | np.concatenate([[True], doc[1:] != doc[:-1]])
        heads = np.flatnonzero(new_key)
        tails = np.concatenate([heads[1:], [n]])
        group = np.cumsum(new_key) - 1
        n_docs = np.add.reduceat(new_doc.astype(np.int64), heads)
        last = doc[tails - 1]
        border = np.zeros(len(heads), bool)
        border[[0, -1]] = True
        goes = (~border & (n_docs >= min_docs))[group] & (doc != last[group])
        edge = border[group]

        def rows(kind: int, at: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int8)), *(pa.array(x[at]) for x in (a, b, doc, row, pos))], schema=_SEEN)

        yield rows(0, np.flatnonzero(goes))
        yield rows(1, np.flatnonzero(edge))
        at = np.unique([0, len(heads) - 1])
        h = heads[at]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 2, np.int8)), pa.array(a[h]), pa.array(b[h]), pa.array(doc[h]), pa.array(last[at]), pa.array(n_docs[at].astype(np.int32))], schema=_SEEN)

    return run


def _bitmap(pos: list[int]) -> bytes:
    flags = np.ones((max(pos) // 8 + 1) * 8, bool)
    flags[np.asarray(pos)] = False
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array([_bitmap(p) for p in rb.column(2).to_pylist()], pa.binary())], names=["doc", "row", "bitmap"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, lines_per_partition: int = 1_000_000) -> DataFrame:
    """(doc, row, bitmap) for documents that lose lines; ``row`` is the hash of the text; lines past the bitmap stay."""
    return finished(docs.sparkSession, "bitmaps", lambda: _keep_bitmaps(docs, id_col, text_col, min_chars, min_docs, lines_per_partition))


def _keep_bitmaps(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, lines_per_partition: int) -> DataFrame:
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col!r} is no column of whole numbers, so there is no largest id")
    keyed = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(col(text_col)).alias("row"), col(text_col).alias("text"))
    # written first: ranging reads its input twice
    lines = written(keyed.mapInArrow(_line_rows(min_chars), "h1 long, h2 long, doc long, row long, pos int"), "lines")
    _, n_bytes = text_bytes(docs, text_col)
    parts = max(shuffle_partitions(docs.sparkSession), math.ceil(n_bytes / min_chars / lines_per_partition))
    key = ["h1", "h2", "doc", "row", "pos"]
    seen = lines.repartitionByRange(parts, *key).sortWithinPartitions(*key).mapInArrow(_first_occurrences(min_docs), "kind byte, h1 long, h2 long, doc long, row long, pos int")
    seen = written(seen, "line-groups")
    # A border group's parts in order; a document cut by a border was counted on both sides.
    parts_of = F.sort_array(F.collect_list(F.struct(F.col("doc").alias("lo"), F.col("row").alias("hi"), F.col("pos").alias("n"))))
    twice = F.expr("size(filter(sequence(1, size(p)), i -> i < size(p) and p[i - 1].hi = p[i].lo))")
    borders = seen.where("kind = 2").groupBy("h1", "h2").agg(parts_of.alias("p")).select("h1", "h2", (F.expr("aggregate(p, 0L, (s, x) -> s + x.n)") - twice).alias("n_docs"), F.expr("p[size(p) - 1].hi").alias("last"))
    borders = borders.where(F.col("n_docs") >= min_docs)  # at most two rows per range partition: safe to broadcast
    cut = seen.where("kind = 1").join(F.broadcast(borders), ["h1", "h2"]).where(F.col("doc") != F.col("last"))
    goes = seen.where("kind = 0").select("doc", "row", "pos").unionByName(cut.select("doc", "row", "pos"))
    return goes.groupBy("doc", "row").agg(F.collect_set("pos").alias("pos")).mapInArrow(_bitmaps, "doc long, row long, bitmap binary")


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[list[str], int]:
    """The lines that stay and the number of lines before."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return lines, len(lines)
    flags = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    gone = set(np.flatnonzero(flags == 0).tolist())
    return [x for i, x in enumerate(lines) if i not in gone], len(lines)


def _with_bitmaps(docs: DataFrame, columns: list[str], id_col: str, text_col: str, **options: int) -> DataFrame:
    """``columns`` and, last, the bitmap of each row."""
    doc, row, bitmap, their_doc, their_row = free_names(docs.columns, "__doc", "__row", "__bitmap", "__their_doc", "__their_row")
    maps = keep_bitmaps(docs, id_col, text_col, **options).select(F.col("doc").alias(their_doc), F.col("row").alias(their_row), F.col("bitmap").alias(bitmap))
    left = docs.select(*[col(c) for c in columns], F.coalesce(col(id_col).cast("long"), F.lit(_NULL_ID)).alias(doc), F.xxhash64(col(text_col)).alias(row))
    return left.join(maps, (F.col(doc) == F.col(their_doc)) & (F.col(row) == F.col(their_row)), "left").select(*[col(c) for c in columns], bitmap)


def line_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """Per row: id, n_lines, n_dropped, kept_sha256 of the text that stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at, texts in text_slices(rb.column(1), _PIECE_BYTES):
                n, dropped, sha = [], [], []
                for t, m in zip(texts.to_pylist(), rb.column(2).slice(at, len(texts)).to_pylist(), strict=True):
                    if m is None:
                        t = t or ""
                        n.append(t.count("\n") + 1)
                        dropped.append(0)
                        sha.append(hashlib.sha256(t.encode()).hexdigest())
                    else:
                        lines, before = kept_lines(t, m)
                        n.append(before)
                        dropped.append(before - len(lines))
                        sha.append(hashlib.sha256("\n".join(lines).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=[id_col, "n_lines", "n_dropped", "kept_sha256"])

    made = docs.select(col(id_col)).schema.add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")
    return _with_bitmaps(docs, [id_col, text_col], id_col, text_col, **options).mapInArrow(run, made)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """All rows and columns; the text without the lines that go (a null text stays null)."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for begin, texts in text_slices(rb.column(at), _PIECE_BYTES):
                maps = rb.column(len(names)).slice(begin, len(texts)).to_pylist()
                kept = [t if m is None else "\n".join(kept_lines(t, m)[0]) for t, m in zip(texts.to_pylist(), maps, strict=True)]
                cols = [pa.array(kept, texts.type) if i == at else rb.column(i).slice(begin, len(texts)) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return _with_bitmaps(docs, names, id_col, text_col, **options).mapInArrow(run, docs.schema)
