"""Substring dedup with repeated-phrase automata.

A window is ``width`` consecutive words of one document; a window whose words also
start anywhere else is repeated, and the words that repeated windows cover go.

1. Candidates.  In each window the 8-word phrase with the least hash is its anchor.
   Equal windows have equal anchors, so a window can only be repeated if its anchor
   phrase is found at two places or more.  Anchors are a few percent of all positions;
   shards of the hash space count them.
2. Confirmation.  Only windows with a recurring anchor send their own hash to the
   shards, which tell each block which of its windows are found elsewhere too.
3. Automata.  Maximal runs of confirmed windows are the recurring passages.  Each
   block of documents compiles the passages that recur in it, in automata of bounded
   size, and streams its documents through them to locate every occurrence.  (A
   repeated window of a document lies in a passage of that document's own block, so a block's
   automata find all there is to find in it; documents needn't visit other shards.)

No cap or sample is used: a phrase that a third of all documents hold reaches its
shard once per block.  Words are compared by 64-bit hashes.  Null text: no words.  Rows are
judged one by one, so repeated rows are repeats of each other.  A very long text is a block of its own
at most.  Ids may be null and of any type; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eventflow.llm.common import (
    U64,
    HashedWords,
    col,
    finished,
    gram_hashes,
    in_blocks,
    merged,
    n_shards,
    pack,
    pack_bits,
    pack_keys,
    ranked,
    shard_cuts,
    sliding,
    small_batches,
    table_of,
    text_bytes,
    text_slices,
    unpack,
    unpack_bits,
    unpack_keys,
    written,
)

ANCHOR = 8
_TOP = np.iinfo(np.uint64).max
_SENT = "shard int, block long, n int, keys binary, many binary"
_SENT_PA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())])
_REPLY = "step int, block long, shard int, n int, again binary"
_REPLY_PA = pa.schema([("step", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("n", pa.int32()), ("again", pa.binary())])


class Block:
    """A block's words; phrases and windows are hashed a piece of the words at a time, so beyond its words a block holds what it finds."""

    def __init__(self, row: dict, width: int, piece: int = 1 << 17):
        self.number, self.words = row["block"], HashedWords.stored(unpack_keys(row["keys"]), unpack(row["codes"], np.int32), unpack(row["lengths"], np.int64))
        self.width, self.piece = width, piece

    def _pieces(self) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(first word, words before it, words of the piece, word hashes, words to the end of the text); hashes go beyond the piece as far as any window that meets it."""
        codes, ends, around = self.words.codes, self.words.starts[1:], self.width + ANCHOR
        for lo in range(0, len(codes), self.piece):
            hi = min(lo + self.piece, len(codes))
            a, b = max(0, lo - around), min(len(codes), hi + around)
            at = np.arange(a, b)
            yield a, lo - a, hi - lo, self.words.keys[codes[a:b]], ends[np.searchsorted(ends, at, side="right")] - at

    def _phrases(self, hashed: np.ndarray, room: np.ndarray) -> np.ndarray:
        phrases = gram_hashes(hashed, ANCHOR)
        phrases[room < ANCHOR] = _TOP
        return phrases & ~U64(1)  # the lowest bit is kept for what the shards say

    def _least(self, phrases: np.ndarray) -> np.ndarray:
        return sliding(phrases, self.width - ANCHOR + 1, np.minimum, _TOP)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Where a phrase is the anchor of some window, and those phrases."""
        places, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for first, before, n, hashed, room in self._pieces():
            phrases = self._phrases(hashed, room)
            least = np.where(room >= self.width, self._least(phrases), U64(0))
            back = sliding(least[::-1], self.width - ANCHOR + 1, np.maximum, 0)[::-1]  # over the windows that hold a position
            own = slice(before, before + n)
            at = np.flatnonzero((back[own] == phrases[own]) & (phrases[own] > 0)) + before
            places.append(at + first)
            found.append(phrases[at])
        return np.concatenate(places), np.concatenate(found)

    def candidates(self, anchors: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows whose anchor recurs, and the windows' hashes."""
        starts, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        recurring = anchors[again]
        for first, before, n, hashed, room in self._pieces():
            lo, hi = np.searchsorted(recurring, [first, first + len(hashed)])
            if lo == hi:
                continue
            marked = self._phrases(hashed, room)
            marked[recurring[lo:hi] - first] |= U64(1)
            own = slice(before, before + n)
            at = np.flatnonzero((room[own] >= self.width) & ((self._least(marked)[own] & U64(1)) == 1)) + before
            starts.append(at + first)
            found.append(gram_hashes(hashed, self.width)[at])
        return np.concatenate(starts), np.concatenate(found)


def _sent(number: int, keys: np.ndarray, shards: int) -> pa.Table:
    keys = np.sort(keys)
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    distinct, many = keys[heads], np.diff(heads, append=len(keys)) > 1
    cuts, rows = shard_cuts(distinct, shards), []
    for s in range(shards):
        lo, hi = int(cuts[s]), int(cuts[s + 1])
        if hi > lo:
            rows.append((s, number, hi - lo, pack_keys(distinct[lo:hi]), pack_bits(many[lo:hi])))
    return table_of(_SENT_PA, rows)


def _recurring(keys: list[np.ndarray], many: list[np.ndarray], at_a_time: int = 1 << 19) -> list[np.ndarray]:
    """For each block's sorted distinct keys: is the key at two places or more?  About ``at_a_time`` keys are brought together at once."""
    out = [np.empty(len(k), bool) for k in keys]
    steps = -(-sum(map(len, keys)) // at_a_time)
    whole = max(keys, key=len)  # the largest block's keys part the range
    edges = whole[np.arange(1, steps) * len(whole) // steps] if steps > 1 else whole[:0]
    cuts = [np.concatenate([[0], np.searchsorted(k, edges), [len(k)]]) for k in keys]
    for step in range(len(edges) + 1):
        parts = [slice(c[step], c[step + 1]) for c in cuts]
        _, at = merged([k[p] for k, p in zip(keys, parts, strict=True)])
        weights = np.concatenate([m[p] for m, p in zip(many, parts, strict=True)]) + 1.0
        again, lo = (np.bincount(at, weights=weights) > 1)[at], 0
        for flags, p in zip(out, parts, strict=True):
            flags[p] = again[lo : lo + p.stop - p.start]
            lo += p.stop - p.start
    return out


def _found_again(step: int):
    """A shard's keys to each block's flags: is the key at two places or more?"""

    def run(group: pa.Table) -> pa.Table:
        table = group
        shard = table.column("shard")[0].as_py()
        sent = table.select(["block", "n", "keys", "many"]).to_pylist()
        again = _recurring([unpack_keys(x["keys"]) for x in sent], [unpack_bits(x["many"], x["n"]) for x in sent])
        return table_of(_REPLY_PA, [(step, x["block"], shard, x["n"], pack_bits(flags)) for x, flags in zip(sent, again, strict=True)])

    return run


def _flags(replies: list[dict], step: int) -> np.ndarray:
    rows = sorted((r for r in replies if r["step"] == step), key=lambda r: r["shard"])
    return np.concatenate([unpack_bits(r["again"], r["n"]) for r in rows]) if rows else np.empty(0, bool)


#: A block after its texts have been split once: word hashes, the words' places among them and words per text (part 0); ids and texts (parts from 1 on,
#: so no row is as large as a block).
_STATE = "block long, part int, keys binary, codes binary, lengths binary, rows binary"
_STATE_PA = pa.schema([("block", pa.int64()), ("part", pa.int32()), *((c, pa.binary()) for c in ("keys", "codes", "lengths", "rows"))])
_PART_BYTES = 1 << 19


def _gathered(number: int, rows: pa.Table) -> pa.Table:
    words = HashedWords(rows.column("text"), piece_bytes=1 << 20)
    out = [table_of(_STATE_PA, [(number, 0, pack_keys(words.keys), pack(words.codes), pack(words.lengths), b"")])]
    for batch in rows.to_batches():
        for at, texts in text_slices(batch.column("text"), _PART_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as ipc:
                ipc.write_batch(pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), texts], schema=rows.schema))
            out.append(table_of(_STATE_PA, [(number, len(out), b"", b"", b"", sink.getvalue().to_pybytes())]))
    return pa.concat_tables(out)


def _opened(state: pa.Table, width: int) -> Block:
    """The block of the rows of one."""
    return Block(state.filter(pc.equal(state.column("part"), 0)).drop_columns(["rows"]).to_pylist()[0], width)


def _send_anchors(width: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in range(len(rb)):
                block = Block({c: rb.column(c)[i].as_py() for c in rb.schema.names}, width)
                yield from _sent(block.number, block.anchors()[1], shards).to_batches()

    return run


def _candidates(block: Block, replies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    anchors, phrases = block.anchors()
    if not len(anchors):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    _, _, at = ranked(phrases)
    return block.candidates(anchors, _flags(replies, 1)[at])


def _send_windows(width: int, shards: int):
    def run(state: pa.Table, replies: pa.Table) -> pa.Table:
        if not state.num_rows:
            return table_of(_SENT_PA, [])
        block = _opened(state, width)
        return _sent(block.number, _candidates(block, replies.to_pylist())[1], shards)

    return run


def passages(repeated: np.ndarray, width: int, starts: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges of the maximal runs of repeated windows (none crosses a document)."""
    if not len(repeated):
        return []
    doc = np.searchsorted(starts, repeated, side="right")
    cut = np.flatnonzero((np.diff(repeated) != 1) | (doc[1:] != doc[:-1])) + 1
    heads, tails = np.concatenate([[0], cut]), np.concatenate([cut, [len(repeated)]]) - 1
    return list(zip(repeated[heads].tolist(), (repeated[tails] + width).tolist(), strict=True))


#: Words are spelled in three letters of disjoint alphabets, so a match can't begin inside a word.
_LETTERS = 256


def _spelled(codes: np.ndarray) -> str:
    out = np.empty((len(codes), 3), np.uint32)
    out[:, 0] = 0x100 + codes % _LETTERS
    out[:, 1] = 0x200 + codes // _LETTERS % _LETTERS
    out[:, 2] = 0x400 + codes // _LETTERS**2
    return out.tobytes().decode("utf-32-le" if sys.byteorder == "little" else "utf-32-be")


def automata(patterns: list[str], max_letters: int = 750_000) -> Iterator:
    """Aho-Corasick automata of all patterns, each of at most ``max_letters`` letters (or one pattern)."""
    import ahocorasick

    machine, room = None, 0
    for p in patterns:
        if machine is None or len(p) > room:
            if machine is not None:
                machine.make_automaton()
                yield machine
            machine, room = ahocorasick.Automaton(ahocorasick.STORE_INTS), max_letters
        machine.add_word(p, len(p))
        room -= len(p)
    if machine is not None:
        machine.make_automaton()
        yield machine


def located(codes: np.ndarray, starts: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    """Which words every occurrence of the passages at ``ranges`` covers."""
    edge = np.zeros(len(codes) + 1, np.int32)
    patterns = list(dict.fromkeys(_spelled(codes[s:e]) for s, e in ranges))
    if patterns:
        texts = [_spelled(codes[s:e]) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        for machine in automata(patterns):
            for at, text in zip(starts[:-1].tolist(), texts, strict=True):
                for last, length in machine.iter(text):
                    end = at + (last + 1) // 3
                    edge[end - length // 3] += 1
                    edge[end] -= 1
    return np.cumsum(edge, dtype=np.int32)[:-1] > 0


def _covered(block: Block, replies: pa.Table) -> np.ndarray:
    """Which words of a block's documents repeated windows cover."""
    got, words = replies.to_pylist(), block.words
    starts, windows = _candidates(block, got)
    if not len(starts):
        return np.zeros(len(words.codes), bool)
    _, _, at = ranked(windows)
    repeated = starts[_flags(got, 2)[at]]
    del starts, windows, at, got
    return located(words.codes, words.starts, passages(repeated, block.width, words.starts))


def _report(width: int, schema: pa.Schema):
    def run(state: pa.Table, replies: pa.Table) -> pa.Table:
        if not state.num_rows:
            return schema.empty_table()
        block = _opened(state, width)
        gone = _covered(block, replies)
        bounds, ids, n_removed, sha = zip(block.words.starts[:-1].tolist(), block.words.starts[1:].tolist(), strict=True), [], [], []
        parts = state.column("part").to_pylist()
        for row in sorted((i for i, part in enumerate(parts) if part), key=parts.__getitem__):
            docs = pa.ipc.open_stream(state.column("rows")[row].as_buffer()).read_all()
            ids += docs.column("id").cast(schema.field(0).type).chunks
            for t in docs.column("text"):
                (s, e), words = next(bounds), (t.as_py() or "").encode().split()
                cut = gone[s:e]
                n_removed.append(int(cut.sum()))
                sha.append(hashlib.sha256(b" ".join(w for w, c in zip(words, cut.tolist(), strict=True) if not c) if n_removed[-1] else b" ".join(words)).hexdigest())
        return pa.table([pa.chunked_array(ids, schema.field(0).type), pa.array(block.words.lengths), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], schema=schema)

    return run


def repeated_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, block_bytes: int = 16 << 20, shard_bytes: int = 64 << 20) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    if width < ANCHOR:
        raise ValueError(f"windows have at least {ANCHOR} words")
    with small_batches(docs.sparkSession):
        return finished(docs.sparkSession, "phrases", lambda: _repeated(docs, id_col, text_col, width, block_bytes, shard_bytes))


def _repeated(docs: DataFrame, id_col: str, text_col: str, width: int, block_bytes: int, shard_bytes: int) -> DataFrame:
    _, n_bytes = text_bytes(docs, text_col)
    shards = n_shards(n_bytes, shard_bytes)
    states = written(in_blocks(docs, id_col, text_col, block_bytes, _gathered, _STATE), "blocks")
    first = states.where("part = 0").drop("part", "rows").mapInArrow(_send_anchors(width, shards), _SENT).groupBy("shard").applyInArrow(_found_again(1), _REPLY)
    windows = states.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(_send_windows(width, shards), _SENT)
    second = windows.groupBy("shard").applyInArrow(_found_again(2), _REPLY)
    every = first.unionByName(second)
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    made = docs.select(col(id_col)).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    schema = pa.schema([(id_col, id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    return states.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(_report(width, schema), made)
