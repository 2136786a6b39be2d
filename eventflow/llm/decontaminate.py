"""Benchmark decontamination by latent semantic retrieval.

1. Documents are read as passages: windows as long as the benchmark's typical item,
   overlapping by half.  A passage's TF-IDF vector runs over the benchmark's words (all
   other words count in its length only); document frequencies cover all passages.
2. A randomised SVD of the passage-word matrix of all texts, distributed: each task sketches
   its own rows and sends partial sums, which are added up in Spark, column block by column
   block; the driver factors the sum, as long as the benchmark's vocabulary.
3. Passages and items meet in the latent space; pairs above a cosine are candidates.
   A passage that shares a run of words with an item, or as many of its words in whatever order as the
   next step asks for, is a candidate too, whatever its cosine: what step 4 would accept is never lost to
   the projection, to the length of passages or to where they begin.
4. Candidates are settled on the words themselves: the longest common subsequence of
   the item and the stretch of the document around the passage must hold most of the item's words, and
   the item's answer (its last words) must be found there too unless nearly all of the rest is.

The benchmark is the side that is broadcast: its items are counted, and beyond
``max_items`` it is handled in several rounds of that size.

Null or empty texts have no passage; null or empty items are never found; items under
``min_words`` words are too short to be told from chance and must occur in full.  Ids may be
null, repeated and of any type, those of items too: rows are judged one by one.  Texts are read a piece at a time, a very long one
alone.  Other columns are not read; ``decontaminate`` returns them as they are, whatever they are called.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eventflow.llm.common import Words, col, free_names, gram_hashes, mix, text_slices

#: Text that is worked on at a time.
_PIECE_BYTES = 2 << 20
_EDGE = b".,;:!?\"'()[]{}|"


def item_words(text: str | None) -> list[str]:
    """Lower-cased words without punctuation at their ends."""
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    return [w.decode() for w in (x.strip(_EDGE) for x in (text or "").encode().translate(lower).split()) if w]


@dataclass(frozen=True)
class Benchmark:
    """Items as word codes; codes are places in ``vocabulary`` (word to code)."""

    ids: list
    items: list[list[int]]
    vocabulary: dict[str, int]
    span: int  # words of a passage

    @staticmethod
    def of(rows: list[tuple]) -> Benchmark:
        ids, items, vocabulary = [], [], {}
        for i, text in rows:
            if words := item_words(text):
                ids.append(i)
                items.append([vocabulary.setdefault(w, len(vocabulary)) for w in words])
        lengths = sorted(map(len, items))
        return Benchmark(ids, items, vocabulary, max(8, lengths[len(lengths) // 2]) if items else 8)


class Passages:
    """The passages of a batch of texts, and where each one's words of the vocabulary are."""

    def __init__(self, texts: pa.Array, bench: Benchmark):
        words = Words(texts, lower=True)
        at = pc.index_in(pc.ascii_trim(words.vocabulary, characters=_EDGE.decode()), value_set=pa.array(list(bench.vocabulary), words.vocabulary.type))
        code = np.asarray(pc.fill_null(at, -1)).astype(np.int64)
        self.words, self.codes = words, code[words.codes]
        self.step = max(1, bench.span // 2)
        # half-passages; passage p of a document is its half-passages p and p + 1
        place = np.arange(len(self.codes)) - words.starts[words.doc]
        halves = np.maximum(1, -(-words.lengths // self.step)) * (words.lengths > 0)
        self.first = np.concatenate([[0], np.cumsum(halves)])
        self.half = self.first[words.doc] + place // self.step
        self.n_halves = int(self.first[-1])
        self.doc_of_half = np.repeat(np.arange(words.n_docs), halves)
        self.last_half = self.first[1:][self.doc_of_half] - 1
        self.in_half = np.bincount(self.half, minlength=self.n_halves)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, code, count) of every word of the vocabulary in every passage, sorted by passage."""
        known = np.flatnonzero(self.codes >= 0)
        half, code = self.half[known], self.codes[known]
        own = (half == self.first[self.doc_of_half[half]]) if len(half) else np.empty(0, bool)
        passage = np.concatenate([half, half[~own] - 1])
        both = np.concatenate([code, code[~own]])
        width = 1 << max(1, int(both.max()).bit_length()) if len(both) else 1
        keys, counts = np.unique(passage * width + both, return_counts=True)
        return keys // width, keys % width, counts

    def lengths(self) -> np.ndarray:
        after = np.concatenate([self.in_half[1:], [0]]) if self.n_halves else self.in_half
        return self.in_half + np.where(np.arange(self.n_halves) < self.last_half, after, 0)


def _vectors(p: Passages, idf: np.ndarray, unknown_idf: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, code, weight) of unit vectors; words beyond the vocabulary add to the length only."""
    passage, code, count = p.entries()
    value = count * idf[code]
    known = np.bincount(passage, weights=count, minlength=p.n_halves)
    square = np.bincount(passage, weights=value**2, minlength=p.n_halves) + np.maximum(p.lengths() - known, 0) * unknown_idf**2
    return passage, code, value / np.sqrt(np.maximum(square, 1e-12))[passage]


def _row_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` (one line each) by sorted ``rows``."""
    out = np.zeros((n, values.shape[1]))
    if len(rows):
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[heads]] = np.add.reduceat(values, heads, axis=0)
    return out


def _project(passage: np.ndarray, code: np.ndarray, value: np.ndarray, basis: np.ndarray, n: int, piece: int = 1 << 11) -> np.ndarray:
    """The rows of the sparse matrix times ``basis``."""
    out = np.zeros((n, basis.shape[1]))
    for at in range(0, len(passage), piece):
        part = slice(at, at + piece)
        rows = passage[part]
        low = rows[0]
        out[low : rows[-1] + 1] += _row_sums(rows - low, value[part, None] * basis[code[part]], int(rows[-1] - low) + 1)
    return out


_BLOCK = 256  # columns whose partial sums travel together


def _sums(parts: DataFrame) -> dict[int, np.ndarray]:
    """Element-wise sums of arrays by ``block``, in two steps so that no task gets all of a block's parts."""
    packed = pa.schema([("block", pa.int32()), ("data", pa.binary())])

    def add(group: pa.Table) -> pa.Table:
        total = None
        for x in group.column("data"):
            v = np.frombuffer(x.as_py())
            total = v.copy() if total is None else total + v
        return pa.table([[group.column("block")[0].as_py()], [total.tobytes()]], schema=packed)

    some = parts.withColumn("salt", F.pmod(F.xxhash64("data"), F.lit(32)))
    once = some.groupBy("block", "salt").applyInArrow(add, "block int, data binary")
    return {r["block"]: np.frombuffer(r["data"]) for r in once.groupBy("block").applyInArrow(add, "block int, data binary").collect()}  # as large as the benchmark's vocabulary


def _split(matrix: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for b in range(0, len(matrix), _BLOCK):
        yield b // _BLOCK, np.ascontiguousarray(matrix[b : b + _BLOCK], dtype=float).tobytes()


def _joined(parts: dict[int, np.ndarray], width: int, n: int) -> np.ndarray:
    return np.concatenate([parts[b].reshape(-1, width) for b in sorted(parts)]) if parts else np.zeros((n, width))


def _partial(docs: DataFrame, of_batch, width: int, n: int) -> np.ndarray:
    """The sum over all batches of an n x width matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, width))
        for rb in batches:
            for _, texts in text_slices(rb.column(0), _PIECE_BYTES):
                total += of_batch(texts)
        rows = list(_split(total))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "data"])

    return _joined(_sums(docs.mapInArrow(run, "block int, data binary")), width, n)


def latent_basis(texts: DataFrame, bench: Benchmark, rank: int, oversample: int = 8, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(right singular vectors, idf, idf of other words) of the passages of all texts in column ``text``."""
    n = len(bench.vocabulary)
    def frequencies(column: pa.Array) -> np.ndarray:
        p = Passages(column, bench)
        _, code, _ = p.entries()
        out = np.zeros((n + 1, 1))
        out[:n, 0] = np.bincount(code, minlength=n)
        out[n] = p.n_halves
        return out

    df = _partial(texts, frequencies, 1, n + 1)[:, 0]
    total = max(1.0, float(df[n]))
    idf = np.log((1 + total) / (1 + df[:n])) + 1
    unknown = math.log(1 + total) + 1 if total > 1 else 1.0
    unknown = min(unknown, float(idf.max(initial=1.0)))
    k = min(rank + oversample, n)
    omega = np.random.default_rng(seed).standard_normal((n, k))

    def sketch(column: pa.Array) -> np.ndarray:  # A' A omega
        p = Passages(column, bench)
        return _back_and_forth(*_vectors(p, idf, unknown), omega, p.n_halves)

    return _from_sketch(_partial(texts, sketch, k, n), omega)[:, :rank], idf, unknown


def _from_sketch(sketched: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Eigenvectors, largest eigenvalue first, of a positive semidefinite G of which G omega is known (Nystrom: no second pass over G's rows)."""
    inner = omega.T @ sketched
    weights, turn = np.linalg.eigh((inner + inner.T) / 2)
    held = weights > 1e-12 * weights.max(initial=0.0)
    return np.linalg.svd(sketched @ (turn[:, held] / np.sqrt(weights[held])), full_matrices=False)[0]


def _back_and_forth(passage: np.ndarray, code: np.ndarray, value: np.ndarray, omega: np.ndarray, n: int, chunk: int = 128) -> np.ndarray:
    """The sparse matrix's transpose times itself times ``omega``: runs of rows as dense matrices over the columns that they have."""
    out, place = np.zeros(omega.shape), np.empty(len(omega), np.int64)
    cuts = np.searchsorted(passage, np.arange(0, n + chunk, chunk))
    for first, lo, hi in zip(range(0, n, chunk), cuts, cuts[1:], strict=False):
        if lo == hi:
            continue
        some = code[lo:hi]
        held = np.zeros(len(omega), bool)
        held[some] = True
        used = np.flatnonzero(held)
        place[used] = np.arange(len(used))
        dense = np.zeros((min(chunk, n - first), len(used)))
        dense[passage[lo:hi] - first, place[some]] = value[lo:hi]
        out[used] += dense.T @ (dense @ omega[used])
    return out


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over ``a``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if u := v & places.get(y, 0):
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Matcher:
    """Settles which items a batch of documents holds."""

    def __init__(self, bench: Benchmark, basis: np.ndarray, idf: np.ndarray, unknown: float, cosine: float, min_lcs: float, answer_words: int, min_words: int, run: int, exact: bool = True):
        self.bench, self.basis, self.idf, self.unknown = bench, basis, idf, unknown
        self.cosine, self.min_lcs, self.answer_words, self.min_words, self.run, self.exact = cosine, min_lcs, answer_words, min_words, run, exact
        rows = []
        for item in bench.items:
            c = Counter(item)
            v = np.zeros(len(idf))
            v[list(c)] = np.array(list(c.values())) * idf[list(c)]
            rows.append(v / np.sqrt((v**2).sum()))
        latent = np.array(rows).reshape(len(rows), len(idf)) @ basis
        self.items = latent / np.maximum(np.sqrt((latent**2).sum(axis=1, keepdims=True)), 1e-12)
        self.runs: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for width in {min(run, len(i)) for i in bench.items}:
            of: dict[int, set[int]] = {}
            for i, item in enumerate(bench.items):
                if min(run, len(item)) == width:
                    for h in self._grams(np.array(item), width)[: len(item) - width + 1].tolist():
                        of.setdefault(h, set()).add(i)
            keys = sorted(of)
            self.runs[width] = np.array(keys, np.uint64), [sorted(of[k]) for k in keys]
        self.sizes = [Counter(i) for i in bench.items]
        self.least = np.array([(1.0 if len(i) < min_words else min_lcs) * len(i) - 1e-9 for i in bench.items])
        self.groups = [self._postings(g) for g in self._by_length()]

    def _by_length(self, factor: float = 1.5) -> list[np.ndarray]:
        """Items whose lengths are within about ``factor`` of each other."""
        of: dict[int, list[int]] = {}
        for i, item in enumerate(self.bench.items):
            of.setdefault(int(math.log(len(item), factor)), []).append(i)
        return [np.array(of[k]) for k in sorted(of)]

    def _postings(self, group: np.ndarray) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]:
        """The items, words that hold any stretch ``_tight`` looks at, and by word where its items begin, those, and how often they hold it."""
        code, item, count = (np.array(x, np.int64) for x in zip(*sorted((c, k, n) for k, i in enumerate(group.tolist()) for c, n in self.sizes[i].items()), strict=True))
        longest = max(len(self.bench.items[i]) for i in group.tolist())
        return group, math.ceil(longest * 1.25) + max(1, longest // 4), np.searchsorted(code, np.arange(len(self.idf) + 1)), item, count

    @staticmethod
    def _grams(codes: np.ndarray, width: int) -> np.ndarray:
        return gram_hashes(mix(codes.astype(np.uint64)), width)

    def hits(self, column: pa.Array, piece: int = 4096) -> list[tuple[int, int, float, float]]:
        """(row of the batch, item, share of the item found, cosine), the best of each row and item."""
        p = Passages(column, self.bench)
        if not p.n_halves or not self.bench.items:
            return []
        passage, code, value = _vectors(p, self.idf, self.unknown)
        # no other passage has a direction in the latent space, where both sides are brought to length one
        inside = np.bincount(passage, minlength=p.n_halves) > 0
        able = self._shared_words(p) if self.exact else set()
        shared = sorted(self._shared_runs(p) | able) if self.exact else []
        n_items = len(self.bench.items)
        able = np.array(sorted(half * n_items + i for half, i in able), np.int64)
        live = np.flatnonzero(inside)
        line = np.cumsum(inside) - 1
        own = inside[passage]
        y = _project(line[passage[own]], code[own], value[own], self.basis, len(live))
        y /= np.maximum(np.sqrt((y**2).sum(axis=1, keepdims=True)), 1e-12)
        wanted: dict[tuple[int, int], float] = {}
        for at in range(0, len(live), piece):
            rows = live[at : at + piece]
            near = y[at : at + piece] @ self.items.T
            r, i = np.nonzero(near >= self.cosine)
            ok = np.isin(rows[r] * n_items + i, able) if self.exact else np.ones(len(r), bool)  # the others lack the words that the settling asks for
            for r, i in zip(r[ok].tolist(), i[ok].tolist(), strict=True):
                wanted[int(rows[r]), i] = float(near[r, i])
        for half, i in shared:
            wanted.setdefault((half, i), float(y[line[half]] @ self.items[i]))
        best: dict[tuple[int, int], tuple[float, float]] = {}
        for (half, i), near in wanted.items():
            doc = int(p.doc_of_half[half])
            share = self._share(p, half, i)
            if share and share > best.get((doc, i), (0.0, 0.0))[0]:
                best[doc, i] = (share, near)
        return [(d, i, s, n) for (d, i), (s, n) in best.items()]

    def _shared_runs(self, p: Passages) -> set[tuple[int, int]]:
        """Half-passages in which a run of words shared with an item begins."""
        n, out = len(p.codes), set()
        ahead = np.cumsum(np.concatenate([[0], p.codes >= 0]))
        for width, (keys, items) in self.runs.items():
            if n < width or not len(keys):
                continue
            whole = np.flatnonzero((ahead[width:] - ahead[:-width] == width) & (p.words.doc[: n - width + 1] == p.words.doc[width - 1 :]))
            found = self._grams(p.codes, width)[whole]
            place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            for k in np.flatnonzero(keys[place] == found).tolist():
                out.update((int(p.half[whole[k]]), i) for i in items[place[k]])
        return out

    def _shared_words(self, p: Passages, piece: int = 1 << 15) -> set[tuple[int, int]]:
        """Half-passages around which an item's words are found as often as ``_share`` asks for at least, in any order.

        Every stretch that ``_tight`` looks at lies in one of the windows of twice its length that overlap by half.
        """
        out: set[tuple[int, int]] = set()
        known = np.flatnonzero(p.codes >= 0)
        place = known - p.words.starts[p.words.doc[known]]
        for group, reach, at, items, counts in self.groups:
            blocks = np.maximum(1, -(-p.words.lengths // reach)) * (p.words.lengths > 0)
            first = np.concatenate([[0], np.cumsum(blocks)])
            block, code = first[p.words.doc[known]] + place // reach, p.codes[known]
            held = at[code + 1] > at[code]
            block, code, begins = block[held], code[held], place[held] < reach
            if not len(block):
                continue
            keys, n = np.unique(np.concatenate([block, block[~begins] - 1]) * len(self.idf) + np.concatenate([code, code[~begins]]), return_counts=True)
            window, code = keys // len(self.idf), keys % len(self.idf)
            # windows with fewer words of any item of the group than its least demanding item needs go at once
            enough = np.bincount(window, weights=n)[window] >= self.least[group].min()
            window, code, n = window[enough], code[enough], n[enough]
            cuts = [0]
            while cuts[-1] < len(window):  # whole windows, about ``piece`` words
                end = min(cuts[-1] + piece, len(window))
                cuts.append(int(np.searchsorted(window, window[end - 1], side="right")))
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                low, size = window[lo], at[code[lo:hi] + 1] - at[code[lo:hi]]
                entry = np.repeat(np.arange(lo, hi), size)
                posting = np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[code[lo:hi]], size)
                shared = np.bincount((window[entry] - low) * len(group) + items[posting], weights=np.minimum(n[entry], counts[posting]))
                for k in np.flatnonzero(shared >= self.least[group][np.arange(len(shared)) % len(group)]).tolist():
                    w, i = int(low) + k // len(group), int(group[k % len(group)])
                    doc = int(np.searchsorted(first, w, side="right")) - 1
                    begin, end = int(p.words.starts[doc]), int(p.words.starts[doc + 1])
                    start = begin + (w - int(first[doc])) * reach
                    if lcs(self.bench.items[i], p.codes[start : min(end, start + 2 * reach)].tolist()) < self.least[i]:
                        continue
                    n_item = len(self.bench.items[i])  # all half-passages whose surroundings meet the window
                    h = max(0, (start - begin - n_item) // p.step - 2), (start - begin + 2 * reach + n_item) // p.step
                    out.update((half, i) for half in range(int(p.first[doc]) + h[0], min(int(p.first[doc]) + h[1], int(p.last_half[p.first[doc]])) + 1))
        return out

    def _share(self, p: Passages, half: int, i: int) -> float:
        """Share of item i found around a passage, or 0 if that is too little."""
        item = self.bench.items[i]
        doc = int(p.doc_of_half[half])
        begin = int(p.words.starts[doc]) + (half - int(p.first[doc])) * p.step
        lo, hi = max(int(p.words.starts[doc]), begin - len(item)), min(int(p.words.starts[doc + 1]), begin + 2 * p.step + len(item))
        window = p.codes[lo:hi].tolist()
        answer = item[-self.answer_words :]
        least = 1.0 if len(item) < self.min_words else self.min_lcs
        have = Counter(window)
        if sum(min(c, have[w]) for w, c in self.sizes[i].items()) < least * len(item) - 1e-9:
            return 0.0  # too few words in common, in whatever order
        best = self._tight(item, window)
        if best < least * len(item) - 1e-9:
            return 0.0
        told = lcs(answer, window) >= math.ceil(len(answer) * 0.5)
        return best / len(item) if told or best >= 0.9 * len(item) else 0.0

    @staticmethod
    def _tight(item: list[int], window: list[int]) -> int:
        """The most of the item found in any stretch of the window at most a quarter longer than it (steps of a quarter)."""
        n, span = len(item), math.ceil(len(item) * 1.25)
        if lcs(item, window) == n and len(window) <= span:
            return n
        step = max(1, n // 4)
        return max(lcs(item, window[s : s + span + step]) for s in range(0, max(1, len(window) - span + step), step))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_col: str = "text",
    rank: int = 48, cosine: float = 0.5, min_lcs: float = 0.7, answer_words: int = 5, min_words: int = 8, run: int = 8, max_items: int = 2000, row_key: str | None = None, exact: bool = True,
) -> DataFrame:
    """(id, item_id, found, cosine): one row per document and benchmark item that it holds; ``found`` is the share of the item's words.

    ``exact``: whether stretches that share words with an item are candidates beside those of the latent search.
    """
    spark = docs.sparkSession
    n_items = benchmark.count()
    rounds = max(1, math.ceil(n_items / max_items))
    key = row_key or id_col
    item_kind = benchmark.schema[item_id_col].dataType
    item_type = to_arrow_type(item_kind)
    if key.lower() in ("item_id", "found", "cosine"):
        raise ValueError(f"the column {key!r} is made here; rename it first")
    made = docs.select(col(key)).schema.add("item_id", item_kind).add("found", "double").add("cosine", "double")
    out = None
    for k in range(rounds):
        part = benchmark.select(col(item_id_col).alias("i"), col(item_col).alias("t"))
        if rounds > 1:
            part = part.where(F.pmod(F.xxhash64("i", "t"), F.lit(rounds)) == k)
        bench = Benchmark.of(sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda r: (str(r[0]), r[1] or "")))
        if not bench.items:
            continue
        basis, idf, unknown = latent_basis(docs.select(col(text_col).alias("text")), bench, rank)
        sent = spark.sparkContext.broadcast((bench, basis, idf, unknown))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b, *factors = sent.value
            matcher = Matcher(b, *factors, cosine, min_lcs, answer_words, min_words, run, exact)
            for rb in batches:
                hits = sorted((at + row, *rest) for at, texts in text_slices(rb.column(1), _PIECE_BYTES) for row, *rest in matcher.hits(texts))
                keys = rb.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                ids = pa.array([b.ids[h[1]] for h in hits], type=item_type)
                yield pa.RecordBatch.from_arrays([keys, ids, pa.array([h[2] for h in hits], pa.float64()), pa.array([h[3] for h in hits], pa.float64())], names=[key, "item_id", "found", "cosine"])

        found = docs.select(col(key), col(text_col).alias("__text")).mapInArrow(find, made)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], made) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows whose text holds no benchmark item, all columns unchanged, whatever they are called."""
    key, theirs = free_names(docs.columns, "__key", "__their_key")
    keyed = docs.withColumn(key, F.xxhash64(col(text_col)))
    bad = contamination(keyed, benchmark, text_col=text_col, row_key=key, **options).select(F.col(key).alias(theirs)).distinct()
    return keyed.join(bad, F.col(key) == F.col(theirs), "left_anti").select(*[col(c) for c in docs.columns])
