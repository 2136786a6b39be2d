"""SimHash near-duplicates by tiled exact comparison.

Each text gets a 64-bit fingerprint from its 3-word shingles.  Equal fingerprints are
folded to one row first (copies never reach the comparison).  Distinct
fingerprints lie in tiles by the population counts of their 16-bit quarters.  Two
fingerprints within the radius differ by at most the radius in the sum of those four
counts, so a tile meets only tiles that near; all other tile pairs are skipped, without
loss.  Tiles that meet are compared in full with numpy XOR and bit counts, in pieces of
bounded size, and a piece pair yields a spanning forest of its links rather than all.
Components come from distributed large-star / small-star rounds.

No text, or no word: fingerprint zero, linked like any other.  Fewer than three words:
one shingle of all words.  Null ids: fingerprinted, but they take no part as a
component's smallest id; a component without any id has a null one.  Repeated rows and ids: each row has its line.  Ids
of any type that has an order.  Texts are read a piece at a time, a very long one alone.  Other columns are not read here; ``drop_near_duplicates``
returns them as they are, whatever they are called.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import U64, Words, col, finished, free_names, gram_hashes, pair, shuffle_partitions, text_slices, written

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64."""
    if not text:
        return 0
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begin = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
    end = [*gaps[shingle - 1 :].tolist(), len(joined)]
    of = xxhash.xxh64_intdigest
    h = np.array([of(joined[s:e], seed) for s, e in zip(begin, end, strict=True)], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, columns: list[str], text_col: str = "text", name: str = "__fp") -> DataFrame:
    """``columns`` and the fingerprint as a signed long called ``name``, which no column may be called."""
    schema = docs.select(*[col(c) for c in columns]).schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at, texts in text_slices(rb.column(len(columns)), 4 << 20):
                fp = np.array([simhash(t) for t in texts.to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(rb.column(i).slice(at, len(texts)) for i in range(len(columns))), pa.array(fp)], names=[*columns, name])

    (text,) = free_names([*columns, name], "__text")
    return docs.select(*[col(c) for c in columns], col(text_col).alias(text)).mapInArrow(run, schema)


def _near_tiles(radius: int) -> np.ndarray:
    """Steps from a tile to each tile within the radius, one of every two opposite ones (and no step)."""
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius]
    return np.array([s for s in steps if s >= (0, 0, 0, 0)], dtype=np.int64)


def _tile_of(fp: np.ndarray) -> np.ndarray:
    quarters = fp.view(np.uint16).reshape(-1, 4)
    return np.bitwise_count(quarters).astype(np.int64)


def _tile_id(counts: np.ndarray) -> np.ndarray:
    return ((counts[:, 0] * 32 + counts[:, 1]) * 32 + counts[:, 2]) * 32 + counts[:, 3]


class Pieces:
    """How crowded tiles are cut: residents of tile t in ``own[t]`` pieces, and what visits it in ``guests[t]`` pieces at most."""

    def __init__(self, crowded: dict[int, int], radius: int):
        self.own, self.guests = dict(crowded), {}
        for tile, n in crowded.items():
            counts = np.array([[tile >> 15, tile >> 10 & 31, tile >> 5 & 31, tile & 31]])
            for step in _near_tiles(radius):
                for there in (counts + step, counts - step):
                    if ((there >= 0) & (there <= 16)).all():
                        t = int(_tile_id(there)[0])
                        self.guests[t] = max(self.guests.get(t, 1), n)

    @staticmethod
    def _of(table: dict[int, int], tiles: np.ndarray) -> np.ndarray:
        if not table:
            return np.ones(len(tiles), np.int64)
        return np.fromiter((table.get(t, 1) for t in tiles.tolist()), np.int64, len(tiles))

    def mine(self, fp: np.ndarray, tiles: np.ndarray) -> np.ndarray:
        """The piece of its own tile that a fingerprint lies in."""
        return (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % self._of(self.own, tiles)

    def groups(self, tiles: np.ndarray, piece: np.ndarray, resident: bool) -> tuple[np.ndarray, np.ndarray]:
        """(group, row) of each row in each piece that it meets: a resident all pieces of guests, a guest all pieces of residents."""
        times = self._of(self.guests if resident else self.own, tiles)
        row = np.repeat(np.arange(len(tiles)), times)
        other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        own, guest = (piece[row], other) if resident else (other, piece[row])
        return tiles[row] << 42 | own << 21 | guest, row


def _deal(radius: int, pieces: Pieces):
    """Each fingerprint to its own tile as resident and to the near tiles (its own among them) as guest."""
    steps = _near_tiles(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            fp = rb.column(0).to_numpy()
            counts = _tile_of(fp)
            mine = pieces.mine(fp, _tile_id(counts))
            group, row = pieces.groups(_tile_id(counts), mine, True)
            group, role, who = [group], [np.zeros(len(row), np.int8)], [fp[row]]
            for step in steps:
                there = counts + step
                ok = ((there >= 0) & (there <= 16)).all(axis=1)
                g, row = pieces.groups(_tile_id(there[ok]), mine[ok], False)
                group.append(g)
                role.append(np.ones(len(row), np.int8))
                who.append(fp[ok][row])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(group)), pa.array(np.concatenate(role)), pa.array(np.concatenate(who))], names=["tile", "role", "fp"])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of links (a[i], b[i]), the places of enough to connect what they connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (p := root(x)) != (q := root(y)):
            parent[q] = p
            keep.append(i)
    return np.array(keep, np.int64)


def _compare(radius: int, side: int = 2048):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        role, fp = group.column("role").to_numpy(), group.column("fp").to_numpy().view(np.uint64)
        here, there = fp[role == 0], fp[role > 0]
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        n_links = 0
        for i in range(0, len(here), side):
            x = here[i : i + side]
            for j in range(0, len(there), side):
                y = there[j : j + side]
                p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
                ok = x[p] != y[q]
                a, b = x[p[ok]].view(np.int64), y[q[ok]].view(np.int64)
                if len(a):
                    keep = forest(a, b)
                    out_a.append(a[keep])
                    out_b.append(b[keep])
                    n_links += len(keep)
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        if n_links > len(here) + len(there):
            keep = forest(a, b)
            a, b = a[keep], b[keep]
        return pa.table([a, b], schema=schema)

    return run


def near_links(fingerprints: DataFrame, radius: int = 2, tile_rows: int = 200_000) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column ``fp``) within ``radius`` bits.

    ``tile_rows``: residents (and guests of one tile) beyond which a tile is cut in pieces.
    """
    quarter = [F.bit_count(F.shiftrightunsigned(F.col("fp"), 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("long") for k in range(4)]
    tile = ((quarter[0] * 32 + quarter[1]) * 32 + quarter[2]) * 32 + quarter[3]
    crowded = fingerprints.groupBy(tile.alias("tile")).count().where(F.col("count") > tile_rows).collect()  # of 17**4 tiles that there are
    pieces = Pieces({r["tile"]: -(-r["count"] // tile_rows) for r in crowded}, radius)
    dealt = fingerprints.select("fp").mapInArrow(_deal(radius, pieces), "tile long, role byte, fp long")
    return dealt.groupBy("tile").applyInArrow(_compare(radius), "a long, b long")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): the smallest node (as a signed long) reachable over links (a, b), by large-star / small-star rounds.

    Nodes without a link aren't listed.  Each round is written in the shared folder; three numbers of it reach the driver, to see whether
    it changed anything (count, sum and exclusive-or of the links' hashes).
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, name)

    def sums(edges: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())

    before = sums(edges)
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour to the smallest of the neighbourhood
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself to the smallest
        down = large.where("u > v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = written(small.select("u", "v"), name)
        edges, known, before = after, before, sums(after)
        if before == known:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """(id, __fp, component): the fingerprint as a signed long and the smallest id of the component."""
    return finished(docs.sparkSession, "near-duplicates", lambda: _near_duplicates(docs, id_col, text_col, radius))


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    fps = written(with_fingerprint(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), ["id"]), "fingerprints")
    classes = written(fps.groupBy(F.col("__fp").alias("fp")).agg(F.min("id").alias("first")), "classes")  # copies fold here, before any comparison
    roots = components(near_links(classes, radius))
    classes = written(classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "classes")
    first = written(classes.groupBy("root").agg(F.min("first").alias("component")), "components")
    of_class = classes.join(first, "root").select(F.col("fp").alias("__fp"), "component")
    return fps.join(of_class, "__fp").select(F.col("id").alias(id_col), "__fp", "component")


def simhash_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """Per row: id, fingerprint (16 hexadecimal digits), component_id."""
    return near_duplicates(docs, id_col, text_col, radius).select(col(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# Near duplicates by what the texts share: bands form tiles, fingerprints find candidates in them, shingle sets decide

_TOP = np.iinfo(np.uint64).max
_SEED = 20_240_229


def band_keys(texts: pa.Array, shingle: int, rows: int, bands: int) -> np.ndarray:
    """(text, band): a hash of ``rows`` min-hashes of the text's shingle set.

    Two texts of similarity s agree in some band with probability 1 - (1 - s**rows)**bands.  Texts without a word agree in all.
    """
    words = Words(texts, lower=True)
    n = len(words.codes)
    hashed = words.hashes()[words.codes] if n else np.empty(0, np.uint64)
    grams = gram_hashes(hashed, shingle)
    taken = words.starts[words.doc + 1] - np.arange(n) >= shingle
    for i in np.flatnonzero((words.lengths > 0) & (words.lengths < shingle)).tolist():  # too short: the whole sequence
        at = int(words.starts[i])
        grams[at] = gram_hashes(hashed[at : at + int(words.lengths[i])], int(words.lengths[i]))[0]
        taken[at] = True
    grams, full = grams[taken], words.lengths > 0
    counts = np.bincount(words.doc[taken], minlength=words.n_docs)[full]
    heads = np.cumsum(counts) - counts
    turn = np.random.default_rng(_SEED).integers(0, 1 << 63, (rows * bands, 2), dtype=np.uint64)
    out = np.empty((words.n_docs, bands), np.uint64)
    for band in range(bands):
        key = np.full(words.n_docs, U64(band))
        for k in range(band * rows, (band + 1) * rows):
            low = np.full(words.n_docs, _TOP)
            if len(heads):
                low[full] = np.minimum.reduceat((grams ^ turn[k, 0]) * (turn[k, 1] | U64(1)), heads)
            key = pair(key, low)
        out[:, band] = key
    return out


def set_simhash(grams: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes of a set of shingles: repeats count once, as in the similarity."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 4096):
        ones += np.unpackbits(grams[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams), bitorder="little").tobytes(), "little")


_SKETCH = 64  # bytes


def parity_sketch(grams: np.ndarray) -> bytes:
    """The set's size and the parities of its shingles dealt over 512 bits.

    Each shingle that only one of two sets has flips one bit: sketches never differ in more bits than the sets do in shingles.
    """
    odd = np.bincount((grams >> np.uint64(55)).astype(np.int64), minlength=8 * _SKETCH) & 1
    return np.int64(len(grams)).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def _may_be_alike(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """By lines (size, then the sketch): sets of similarity s differ in (1 - s) / (1 + s) of their sizes' sum, so no alike pair is lost."""
    most = (1 - least) / (1 + least) * (x[:, 0] + y[:, 0]).astype(float) + 1e-6
    return (np.abs(x[:, 0].astype(np.int64) - y[:, 0].astype(np.int64)) <= most) & (np.bitwise_count(x[:, 1:] ^ y[:, 1:]).sum(axis=1, dtype=np.int64) <= most)


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of a spanning forest of least weight (ties: by nodes) of the links (a[i], b[i]), by Boruvka's rounds."""
    n_links = len(a)
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), weight))
    nodes, at = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    label, live, keep = np.arange(len(nodes)), np.arange(n_links), []
    u, v = at[:n_links], at[n_links:]
    while len(live):
        lu, lv = label[u[live]], label[v[live]]
        apart = lu != lv
        live, lu, lv = live[apart], lu[apart], lv[apart]
        if not len(live):
            break
        best = np.full(len(nodes), n_links, np.int64)
        np.minimum.at(best, lu, live)
        np.minimum.at(best, lv, live)
        heads = np.flatnonzero(best < n_links)
        chosen = best[heads]
        keep.append(np.unique(chosen))
        cu, cv = label[u[chosen]], label[v[chosen]]
        parent = np.arange(len(nodes))
        parent[heads] = np.where(cu == heads, cv, cu)
        mutual = parent[parent[heads]] == heads
        ends = heads[mutual]
        parent[ends] = np.minimum(ends, parent[ends])
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label = parent[label]
    return order[np.concatenate(keep)] if keep else np.empty(0, np.int64)


class Links:
    """Links (a, b, bits) of a tile, thinned to two edge-disjoint spanning forests of the closest."""

    def __init__(self, held: int = 1_000_000):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n, self.held = 0, held

    def add(self, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> None:
        if len(a):
            self.parts.append((np.minimum(a, b), np.maximum(a, b), bits.astype(np.int32)))
            self.n += len(a)
            if self.n > self.held:
                self.parts = [self.thin()]
                self.n = len(self.parts[0][0])
                self.held = max(self.held, 2 * self.n)

    def thin(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        a, b, bits = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        first = spanning(a, b, bits)
        rest = np.setdiff1d(np.arange(len(a)), first, assume_unique=True)
        keep = np.concatenate([first, rest[spanning(a[rest], b[rest], bits[rest])]])
        return a[keep], b[keep], bits[keep]


def compare_tile(node: np.ndarray, fp: np.ndarray, radius: int, hubs: int = 3, rows: int = 512, columns: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b), and the places and scores of the most central members.

    All pairs meet by XOR and bit counts, in pieces; pieces whose population counts differ beyond the radius are skipped.  What
    is kept are two forests of the closest links (for chains of edits) and each member's links to the members that are closest to all others
    (copies edited independently are alike to their common source and often not to each other).
    """
    count = np.bitwise_count(fp)
    order = np.argsort(count, kind="stable")
    sorted_fp, count = fp[order], count[order].astype(np.int64)
    links, score = Links(), np.zeros(len(fp), np.int64)
    for i in range(0, len(fp), rows):
        highest = count[min(i + rows, len(fp)) - 1]
        for j in range(i, len(fp), columns):
            if count[j] - highest > radius:
                break
            bits = np.bitwise_count(sorted_fp[i : i + rows, None] ^ sorted_fp[None, j : j + columns])
            r, c = np.nonzero(bits <= radius)
            ok = j + c > i + r
            r, c = r[ok], c[ok]
            close = bits[r, c]
            x, y = order[i + r], order[j + c]
            links.add(node[x], node[y], close)
            for side in (x, y):
                score += np.bincount(side, weights=radius + 1 - close.astype(np.int64), minlength=len(fp)).astype(np.int64)
    top = np.lexsort((node, -score))[:hubs]
    a, b, _ = links.thin()
    parts_a, parts_b = [a], [b]
    for h in top.tolist():
        at = np.flatnonzero((np.bitwise_count(fp ^ fp[h]) <= radius) & (node != node[h]))
        parts_a.append(np.full(len(at), node[h]))
        parts_b.append(node[at])
    return np.concatenate(parts_a), np.concatenate(parts_b), top, score[top] / max(1, len(fp) - 1)


#: link: nodes a and b; member and hub: node a and fingerprint b of a tile that a range border may cut
_LINK, _MEMBER, _HUB = 0, 1, 2
_FOUND = "kind byte, tile long, a long, b long, score double"
_FOUND_PA = pa.schema([("kind", pa.int8()), ("tile", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])


def _compare_tiles(radius: int, small: int = 8):
    """Rows sorted by tile to links, and members and hubs of the first and the last tile."""

    def rows(kind: int, tile: int, a: np.ndarray, b: np.ndarray, score: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(a)
        score = np.zeros(n) if score is None else score
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(np.full(n, tile, np.int64)), pa.array(a), pa.array(b), pa.array(score)], schema=_FOUND_PA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("tile", pa.int64()), ("node", pa.int64()), ("fp", pa.int64())]))
        tile, node, fp = (table.column(i).to_numpy() for i in range(3))
        if not len(tile):
            return
        fp = fp.view(np.uint64)
        heads = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(tile)]]))
        out_a, out_b = [], []
        end = np.repeat(np.where(sizes <= small, heads + sizes, 0), sizes)  # small tiles side by side, all pairs of at most ``small`` members
        for step in range(1, small):
            at = np.flatnonzero(np.arange(len(tile)) + step < end)
            at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
            out_a.append(node[at])
            out_b.append(node[at + step])
        for k in sorted({*np.flatnonzero(sizes > small).tolist(), 0, len(heads) - 1}):
            part = slice(heads[k], heads[k] + sizes[k])
            a, b, top, score = compare_tile(node[part], fp[part], radius)
            out_a.append(a)
            out_b.append(b)
            if k in (0, len(heads) - 1):
                yield rows(_MEMBER, int(tile[heads[k]]), node[part], fp[part].view(np.int64))
                yield rows(_HUB, int(tile[heads[k]]), node[part][top], fp[part][top].view(np.int64), score)
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        yield rows(_LINK, 0, a[new], b[new])

    return run


def _cut_tiles(found: DataFrame, radius: int, hubs: int = 8) -> DataFrame:
    """Links (a, b) between members of a cut tile and the most central of the hubs of all its parts."""
    hub = found.where(F.col("kind") == _HUB).groupBy("tile").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), F.col("a").alias("hub"), F.col("b").alias("hub_fp")))).alias("hubs"))
    hub = hub.select("tile", F.explode(F.slice("hubs", 1, hubs)).alias("h")).select("tile", "h.hub", "h.hub_fp")
    member = found.where(F.col("kind") == _MEMBER).join(F.broadcast(hub), "tile")  # two tiles of each range partition at most
    near = member.where((F.col("a") != F.col("hub")) & (F.bit_count(F.col("b").bitwiseXOR(F.col("hub_fp"))) <= radius))
    return near.select(F.least("a", "hub").alias("a"), F.greatest("a", "hub").alias("b"))


_REST = "kind byte, part int, tile long, a long, b long, root long, sketch binary"
_REST_PA = pa.schema([("kind", pa.int8()), ("part", pa.int32()), ("tile", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("root", pa.int64()), ("sketch", pa.binary())])


def _lines(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 1 + _SKETCH // 8)


def _apart(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...] | None, radius: int, least: float, rows: int = 512, columns: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (a < b) of (node, fp, root, sketch) within the radius that may be alike and whose roots differ, in pieces: of x with y, or within x."""
    (n, f, r, s), (m, g, q, t) = x, y or x
    for i in range(0, len(n), rows):
        for j in range(0 if y else i, len(m), columns):
            here, there = np.nonzero((np.bitwise_count(f[i : i + rows, None] ^ g[None, j : j + columns]) <= radius) & (r[i : i + rows, None] != q[None, j : j + columns]))
            if y is None:
                once = there + j > here + i
                here, there = here[once], there[once]
            may = _may_be_alike(s[here + i], t[there + j], least)
            here, there = here[may], there[may]
            if len(here):
                a, b = n[here + i], m[there + j]
                yield np.minimum(a, b), np.maximum(a, b)


def _unjoined(radius: int, least: float):
    """Rows sorted by tile to pairs of a tile that no link has joined, and members of the first and the last tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("tile", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("root", pa.int64()), ("sketch", pa.binary())]))
        tile, node, fp, root = (table.column(i).to_numpy() for i in range(4))
        if not len(tile):
            return
        sketch = _lines(table.column(4))
        number = TaskContext.get().partitionId()

        def out(kind: int, where: int, a: np.ndarray, b: np.ndarray, of: np.ndarray, lines: pa.Array | None = None) -> pa.RecordBatch:
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(np.full(n, number, np.int32)), pa.array(np.full(n, where, np.int64)), pa.array(a), pa.array(b), pa.array(of), pa.nulls(n, pa.binary()) if lines is None else lines], schema=_REST_PA)

        heads = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        ends = np.concatenate([heads[1:], [len(tile)]])
        for k in sorted({0, len(heads) - 1}):
            part = slice(heads[k], ends[k])
            yield out(_MEMBER, int(tile[heads[k]]), node[part], fp[part], root[part], pa.array([x.tobytes() for x in sketch[part]], pa.binary()))
        several = np.minimum.reduceat(root, heads) != np.maximum.reduceat(root, heads)
        held_a, held_b, held = [], [], 0
        for k in np.flatnonzero(several).tolist():
            part = slice(heads[k], ends[k])
            for a, b in _apart((node[part], fp[part].view(np.uint64), root[part], sketch[part]), None, radius, least):
                held_a.append(a)
                held_b.append(b)
                held += len(a)
                if held > 200_000:
                    yield out(_LINK, 0, np.concatenate(held_a), np.concatenate(held_b), np.zeros(held, np.int64))
                    held_a, held_b, held = [], [], 0
        if held:
            yield out(_LINK, 0, np.concatenate(held_a), np.concatenate(held_b), np.zeros(held, np.int64))

    return run


def _unjoined_across(rest: DataFrame, radius: int, least: float) -> DataFrame:
    """Pairs (a, b) that no link has joined, of members of one tile in different range partitions: each two parts of a tile meet."""
    member = rest.where(F.col("kind") == _MEMBER).select("tile", "part", F.col("a").alias("node"), F.col("b").alias("fp"), "root", "sketch")
    cut = member.groupBy("tile").agg(F.collect_set("part").alias("parts"), F.min("root").alias("low"), F.max("root").alias("high")).where("size(parts) > 1 and low <> high")
    met = member.join(F.broadcast(cut.select("tile", "parts")), "tile").select("tile", "part", "node", "fp", "root", "sketch", F.explode("parts").alias("other")).where("part <> other")  # two tiles of each range partition at most
    met = met.select("tile", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "fp", "root", "sketch")

    def meet(group: pa.Table) -> pa.Table:
        part, low = group.column("part").to_numpy(), group.column("low")[0].as_py()
        node, fp, root = (group.column(c).to_numpy() for c in ("node", "fp", "root"))
        sketch = _lines(group.column("sketch"))
        x, y = ((node[at], fp[at].view(np.uint64), root[at], sketch[at]) for at in (part == low, part != low))
        found = list(_apart(x, y, radius, least))
        none = np.empty(0, np.int64)
        return pa.table([np.concatenate([none, *(f[k] for f in found)]) for k in (0, 1)], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return met.groupBy("tile", "low", "high").applyInArrow(meet, "a long, b long").where("a <> b")


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles (fewer words: the whole sequence; no word: none)."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    grams = {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), np.uint64, len(grams)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard's; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def similar_links(docs: DataFrame, text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 24, rows: int = 4, bands: int = 16, part_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Nodes (``node``: hash of a distinct text) of all rows' texts, and links (a, b) of texts whose shingle sets are alike enough.

    At a similarity of 0.8 no radius of 64-bit fingerprints is both complete and selective: alike texts differ in ten bits and
    more, and population counts part nothing at that radius.  So tiles are formed by min-hash bands (with 16 bands of 4, texts of
    similarity 0.8 share one with a probability of 0.9998); within a tile all fingerprints are compared by XOR and bit counts,
    within a radius that hardly any alike texts exceed: fingerprints are of the sets that the similarity compares, and differ in about ten
    bits at 0.8 (see ``compare_tile``).  The links it keeps, a few for each member of a tile, go on to the
    exact comparison of the sets, so the members of a large group don't meet there one by one.  What these confirmed links join is
    settled; every other pair of a tile within the radius, but for those whose sizes and parity sketches prove them unlike, then goes to the exact comparison as well, so none is lost to the choice of links.

    Tiles are ranged by (tile, node), so that a tile of any size is split; where a range border cuts a tile, the members
    of all its parts meet the most central members of all its parts, and in the second round each two parts meet in full.
    """
    keyed = docs.select(F.xxhash64(col(text_col)).alias("node"), col(text_col).alias("text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at, texts in text_slices(rb.column(1), 2 << 20):
                grams = [shingle_set(t, shingle) for t in texts.to_pylist()]
                fp = np.array([set_simhash(g) for g in grams], dtype=np.uint64)
                signs = np.hstack([fp[:, None], band_keys(texts, shingle, rows, bands)])
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(at, len(texts)), pa.array([s.tobytes() for s in signs], pa.binary()), pa.array([parity_sketch(g) for g in grams], pa.binary())], names=["node", "signs", "sketch"])

    nodes = written(keyed.mapInArrow(signed, "node long, signs binary, sketch binary").groupBy("node").agg(F.min("signs").alias("signs"), F.min("sketch").alias("sketch")), "texts")  # copies fold here

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            signs = np.frombuffer(b"".join(rb.column(1).to_pylist()), np.int64).reshape(-1, 1 + bands)
            yield pa.RecordBatch.from_arrays([pa.array(signs[:, 1:].reshape(-1)), pa.array(np.repeat(rb.column(0).to_numpy(), bands)), pa.array(np.repeat(signs[:, 0], bands))], names=["tile", "node", "fp"])

    parts = max(shuffle_partitions(docs.sparkSession), -(-nodes.count() * bands // part_rows))
    dealt = nodes.select("node", "signs").mapInArrow(deal, "tile long, node long, fp long").repartitionByRange(parts, "tile", "node").sortWithinPartitions("tile", "node")
    found = written(dealt.mapInArrow(_compare_tiles(radius), _FOUND), "tiles")
    near = written(found.where(F.col("kind") == _LINK).select("a", "b").unionByName(_cut_tiles(found, radius)).distinct(), "near")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([shingle_set(t, shingle).tobytes() for t in rb.column(1).to_pylist()], pa.binary())], names=["node", "grams"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            x, y = (rb.column(i).to_pylist() for i in (2, 3))
            ok = [similarity(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) >= least for p, q in zip(x, y, strict=True)]
            yield rb.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def confirmed(near: DataFrame) -> DataFrame:
        wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        grams = keyed.join(wanted, "node", "left_semi").mapInArrow(sets, "node long, grams binary")
        grams = written(grams.groupBy("node").agg(F.min("grams").alias("grams")), "shingles")
        left, right = (grams.select(F.col("node").alias(k), F.col("grams").alias(f"{k}_grams")) for k in "ab")
        pairs = near.join(left, "a").join(right, "b").select("a", "b", "a_grams", "b_grams")
        return written(pairs.mapInArrow(alike, "a long, b long"), "alike")

    links = confirmed(near)
    roots = components(links).select(F.col("node").alias("__node"), "root")
    rooted = nodes.join(roots, F.col("node") == F.col("__node"), "left").select("node", "signs", F.coalesce("root", "node").alias("root"), "sketch")

    def deal_rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            (dealt,) = deal(iter([rb.select(["node", "signs"])]))
            yield pa.RecordBatch.from_arrays([*dealt.columns, *(rb.column(c).take(pa.array(np.repeat(np.arange(len(rb)), bands))) for c in (2, 3))], names=["tile", "node", "fp", "root", "sketch"])

    dealt = rooted.mapInArrow(deal_rooted, "tile long, node long, fp long, root long, sketch binary").repartitionByRange(parts, "tile", "node").sortWithinPartitions("tile", "node")
    rest = written(dealt.mapInArrow(_unjoined(radius, least), _REST), "rest")
    more = written(rest.where(F.col("kind") == _LINK).select("a", "b").unionByName(_unjoined_across(rest, radius, least)).distinct(), "near")
    return nodes.select("node"), links.unionByName(confirmed(more))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, **options: int) -> DataFrame:
    """One row of each group of near duplicates, whole: that with the smallest id (of rows alike in id and text, one).

    Groups are the components of equal texts and of ``similar_links`` (which takes the options).  Rows with a null id all stay.
    """
    (their,) = free_names(docs.columns, "__their_id")
    keep = finished(docs.sparkSession, "kept", lambda: _representatives(docs, id_col, text_col, shingle, least, their, **options))
    node, first, of = free_names([*docs.columns, their], "__node", "__first", "__of")
    keyed = docs.where(col(id_col).isNotNull()).withColumn(node, F.xxhash64(col(text_col)))
    kept = keyed.join(keep.select(F.col(their).alias(of), F.col("node").alias(first)), (col(id_col) == F.col(of)) & (F.col(node) == F.col(first)), "left_semi")
    if not keyed.groupBy(col(id_col), node).count().where(F.col("count") > 1).isEmpty():
        kept = kept.dropDuplicates([id_col, node])  # rows alike in id and text are one
    return kept.select(*[col(c) for c in docs.columns]).unionByName(docs.where(col(id_col).isNull()))


def _representatives(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float, their: str, **options: int) -> DataFrame:
    """(id, node) of the row that stays of each group; the id under the name ``their``."""
    _, links = similar_links(docs, text_col, shingle, least, **options)
    roots = components(links).select(F.col("node").alias("of"), "root")
    keyed = docs.where(col(id_col).isNotNull()).select(col(id_col).alias(their), F.xxhash64(col(text_col)).alias("node"))
    firsts = keyed.groupBy("node").agg(F.min(their).alias(their)).join(roots, F.col("node") == F.col("of"), "left")
    return firsts.groupBy(F.coalesce("root", "node").alias("of")).agg(F.min(F.struct(their, "node")).alias("keep")).select("keep.*")
