"""Katz backoff bigram scores.

The model is P(w | h) = d(c) c(h, w) / c(h) for bigrams seen in training and
alpha(h) P(w) otherwise; P(w) is the Good-Turing discounted unigram, whose held-back mass
goes to one class of unknown words.  d is Katz's discount from the counts of counts (1 for counts
over ``k``); alpha(h) is computed from the bigrams seen after h, so that each
history's probabilities add up to one exactly.  A history whose seen bigrams hold back nothing
has its counts divided by c(h) + 1 instead.  Histories never seen back off with weight one.

Counting and scoring run over blocks of documents and shards of the n-gram space
(see ``common``): a block sends a shard its distinct n-grams with their training counts;
the shard adds them up, stores its part of the model in a table partitioned by kind, and
answers each block with the counts of just the n-grams that the block asked for.  Backoff weights make a second such
exchange, each seen bigram being accounted for by one block, its owner, and are stored beside the counts.  Texts are
read once and never shuffled: a block goes on as the codes of its words.  No vocabulary, count
table or document set ever reaches the driver or a broadcast, only counts of counts do.

``fit`` stores a model, ``score_stored`` evaluates it on any texts, ``katz_scores`` does both for one table.

N-grams are identified by 64-bit hashes.  Null or empty text: one end token.  A null id
counts as training (its remainder is unknown).  Repeated rows count as often as they
occur.  A very long text is a block of its own at most.  Ids may be of any type; other columns
are not read, so their names can't clash.  With no training text every token is unknown with probability one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eventflow.llm.common import (
    HashedWords,
    finished,
    in_blocks,
    merged,
    mix,
    n_shards,
    pack,
    pack_bits,
    pack_keys,
    pair,
    ranked,
    shard_cuts,
    table_of,
    text_bytes,
    unpack,
    unpack_bits,
    unpack_keys,
    written,
)

END, BEGIN = (mix(np.array([x], np.uint64))[0] for x in (0xE0D, 0xB0B))
#: A block after its texts have been read once: ids (Arrow IPC), sorted word hashes, places among them and tokens per text.
_STATE = "block long, ids binary, words binary, seq binary, lengths binary"
_STATE_PA = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "words", "seq", "lengths"))])
_SENT = "ord int, shard int, block long, n int, keys binary, counts binary, mass binary, base binary"
_SENT_PA = pa.schema([("ord", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("mass", pa.binary()), ("base", pa.binary())])
#: kind: model (an n-gram shard), reply (to a block), stat (counts of counts of a shard)
_SHARD = "ord int, shard int, block long, n int, keys binary, counts binary, mine binary, stat array<long>, kind string"
_SHARD_PA = pa.schema([("ord", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("mine", pa.binary()), ("stat", pa.list_(pa.int64())), ("kind", pa.string())])
_REPLY = ["kind", "block", "ord", "shard", "n", "counts", "mine"]


def held_out(doc_id: int | None, folds: int = 5, fold: int = 1) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


@dataclass(frozen=True)
class Discounts:
    """Good-Turing discounts of one order: the factor for counts 1..k; larger counts aren't discounted."""

    factors: tuple[float, ...]
    total: int
    distinct: int
    singles: int

    @staticmethod
    def of(count_of_counts: list[int], total: int, distinct: int, k: int) -> Discounts:
        n = [0, *count_of_counts]
        cut = (k + 1) * n[k + 1] / n[1] if n[1] else 0.0
        out = []
        for r in range(1, k + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
            out.append(d if 0 < d < 1 else r / (r + 1))  # too few counts for Good-Turing: a plain discount
        return Discounts(tuple(out), total, distinct, n[1])

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        table = np.array([0.0, *(r * d for r, d in enumerate(self.factors, 1))])
        return np.where(counts < len(table), table[np.minimum(counts, len(table) - 1)], counts)


class Block:
    """The n-grams of a block of documents: distinct sorted keys and each token's place among them."""

    def __init__(self, row: dict, folds: int, fold: int):
        self.number, self.words = row["block"], unpack_keys(row["words"])
        self.ids = pa.ipc.open_stream(row["ids"]).read_all().column(0)
        self.seq, self.lengths = unpack(row["seq"], np.int32), unpack(row["lengths"], np.int64)
        self.training = np.array([not held_out(i, folds, fold) for i in self.ids.to_pylist()], dtype=bool)
        self.in_training = np.repeat(self.training, self.lengths)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.begin = int(np.searchsorted(self.words, BEGIN))
        before = np.empty_like(self.seq)
        before[1:] = self.seq[:-1]
        before[self.starts[:-1]] = self.begin
        _, first, self.at = ranked(before.astype(np.int64) * len(self.words) + self.seq)
        history, word = before[first], self.seq[first]
        keys = pair(self.words[history], self.words[word])
        order = np.argsort(keys)
        self.pairs, self.history, self.word = keys[order], history[order], word[order]
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        self.at = back[self.at]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of words (of the begin mark: documents) and of pairs."""
        one = np.bincount(self.seq[self.in_training], minlength=len(self.words))
        one[self.begin] = int(self.training.sum())
        return one, np.bincount(self.at[self.in_training], minlength=len(self.pairs))

    def sent(self, shards: int, order: int, keys: np.ndarray, **values: np.ndarray | None) -> list[tuple]:
        """Rows of ``keys`` and their values (counts, mass, base) for the shards."""
        cuts, rows = shard_cuts(keys, shards), []
        for s in range(shards):
            lo, hi = int(cuts[s]), int(cuts[s + 1])
            if hi > lo:
                rows.append((order, s, self.number, hi - lo, pack_keys(keys[lo:hi]), *(None if (v := values.get(c)) is None else pack(v[lo:hi]) for c in ("counts", "mass", "base"))))
        return rows


def _read(number: int, rows: pa.Table) -> pa.Table:
    """A block's texts to its state."""
    words = HashedWords(rows.column("text"), lower=True, extra=(END, BEGIN))
    ends = words.starts[1:] + np.arange(words.n_docs)  # with an end token after each document
    seq = np.empty(len(words.codes) + words.n_docs, np.int32)
    is_word = np.ones(len(seq), bool)
    is_word[ends] = False
    seq[is_word] = words.codes
    seq[ends] = np.searchsorted(words.keys, END)
    ids = rows.select(["id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ids.schema) as out:
        out.write_table(ids)
    return table_of(_STATE_PA, [(number, sink.getvalue().to_pybytes(), pack_keys(words.keys), pack(seq), pack(words.lengths + 1))])


def _blocks(batches: Iterator[pa.RecordBatch], folds: int, fold: int) -> Iterator[Block]:
    for rb in batches:
        for i in range(len(rb)):
            yield Block({c: rb.column(c)[i].as_py() for c in rb.schema.names}, folds, fold)


def _send_counts(shards: int, folds: int, fold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, folds, fold):
            rows = [r for order, keys, counts in zip((1, 2), (block.words, block.pairs), block.counts(), strict=True) for r in block.sent(shards, order, keys, counts=counts.astype(np.uint32))]
            yield from table_of(_SENT_PA, rows).to_batches()

    return run


def _add_up(k: int):
    def run(group: pa.Table) -> pa.Table:
        table = group.sort_by("block")
        order, shard = table.column("ord")[0].as_py(), table.column("shard")[0].as_py()
        sizes = table.column("n").to_numpy()
        keys, at = merged([unpack_keys(x.as_py()) for x in table.column("keys")])
        given = np.concatenate([unpack(x.as_py(), np.uint32) for x in table.column("counts")])
        total = np.bincount(at, weights=given, minlength=len(keys)).astype(np.int64)
        # the first block that has a key in its training text accounts for it
        seen = np.flatnonzero(given > 0)
        mine = np.zeros(len(at), bool)
        mine[seen[ranked(at[seen])[1]]] = True
        rows, lo = [], 0
        for block, n in zip(table.column("block").to_pylist(), sizes.tolist(), strict=True):
            part = slice(lo, lo + n)
            rows.append((order, shard, block, n, None, pack(total[at[part]]), pack_bits(mine[part]), None, "reply"))
            lo += n
        known = total > 0
        rows.append((order, shard, None, int(known.sum()), pack_keys(keys[known]), pack(total[known]), None, None, "model"))
        real = known & ~np.isin(keys, [BEGIN]) if order == 1 else known  # the begin mark is no token
        counted = np.bincount(np.minimum(total[real], k + 2), minlength=k + 3)
        rows.append((order, shard, None, 0, None, None, None, [*counted[1 : k + 2].tolist(), int(total[real].sum()), int(real.sum())], "stat"))
        return table_of(_SHARD_PA, rows)

    return run


def _aligned(replies: pa.Table, kind: str, order: int, counts: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Counts (or weights) and flags of the shards' replies, in the order of the block's sorted keys."""
    own = replies.filter(pc.and_(pc.equal(replies["kind"], kind), pc.equal(replies["ord"], order))).sort_by("shard")
    parts = [unpack(x.as_py(), counts) for x in own.column("counts")]
    flags = [unpack_bits(x.as_py(), n) for x, n in zip(own.column("mine"), own.column("n").to_pylist(), strict=True) if x.is_valid]
    return np.concatenate([np.empty(0, counts), *parts]), np.concatenate([np.empty(0, bool), *flags])


class Model:
    """The numbers that every task needs: a few per order."""

    def __init__(self, one: Discounts, two: Discounts):
        self.one, self.two = one, two
        self.total, self.distinct = one.total, one.distinct
        # Good-Turing holds back n1 / N; fallbacks of the discounts may hold back another share, so ``scale`` makes the rest fit.
        self.scale = 1.0
        self.unknown = one.singles / (one.total + (one.singles == one.total)) if one.singles else 0.5 / (self.total + 0.5 * (self.distinct + 1))

    def fitted(self, mass: float) -> Model:
        """``mass``: the sum of the discounted unigram counts."""
        self.scale = (1.0 - self.unknown) / mass if mass else 0.0
        if not mass:
            self.unknown = 1.0
        return self

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.one(counts) * self.scale, self.unknown)


def backoff(count: np.ndarray, mass: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weight of each history, and whether its counts are divided by one more than theirs, as nothing was held back.

    ``count``: how often anything came after it; ``mass`` and ``base``: discounted counts and unigram probabilities of the words seen after it.
    """
    left = count - mass
    short = left <= 1e-9 * np.maximum(count, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.where(short, 1.0, left) / (count + short) / np.maximum(1.0 - base, 1e-300)
    return np.where(count > 0, alpha, 1.0), short & (count > 0)


def _masses(model: Model, shards: int, folds: int, fold: int):
    """A block's owned bigrams, summed by history: discounted counts and unigram probability of the words seen after it."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return table_of(_SENT_PA, [])
        block = Block(docs.to_pylist()[0], folds, fold)
        one, _ = _aligned(replies, "reply", 1)
        two, mine = _aligned(replies, "reply", 2)
        own = np.flatnonzero(mine)
        mass = np.bincount(block.history[own], weights=model.two(two[own]), minlength=len(block.words))
        base = np.bincount(block.history[own], weights=model.unigram(one[block.word[own]]), minlength=len(block.words))
        return table_of(_SENT_PA, block.sent(shards, 1, block.words, counts=one, mass=mass, base=base))

    return run


def _add_masses(group: pa.Table) -> pa.Table:
    """Masses of a shard's histories to their backoff weights, as a part of the stored model and as replies."""
    table = group.sort_by("block")
    shard, rows, lo = table.column("shard")[0].as_py(), [], 0
    keys, at = merged([unpack_keys(x.as_py()) for x in table.column("keys")])
    mass, base = (np.bincount(at, weights=np.concatenate([unpack(x.as_py(), np.float64) for x in table.column(c)]), minlength=len(keys)) for c in ("mass", "base"))
    count = np.zeros(len(keys), np.int64)
    count[at] = np.concatenate([unpack(x.as_py(), np.int64) for x in table.column("counts")])  # the same from every block
    alpha, short = backoff(count, mass, base)
    for block, n in zip(table.column("block").to_pylist(), table.column("n").to_pylist(), strict=True):
        part = at[lo : lo + n]
        rows.append((1, shard, block, n, None, pack(alpha[part]), pack_bits(short[part]), None, "weight"))
        lo += n
    known = count > 0
    rows.append((1, shard, None, int(known.sum()), pack_keys(keys[known]), pack(alpha[known]), pack_bits(short[known]), None, "backoff"))
    return table_of(_SHARD_PA, rows)


_SCORES = "n_tokens long, n_known long, held_out boolean, train_tokens long, base_score double, score double"


def pair_log10(model: Model, one: np.ndarray, two: np.ndarray, history: np.ndarray, word: np.ndarray, alpha: np.ndarray, short: np.ndarray) -> np.ndarray:
    """log10 P(word | history) by the Katz recursion; ``one``, ``alpha`` and ``short`` by word, the others by pair."""
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = model.two(two) / (one + short)[history]
        return np.log10(np.where(two > 0, seen, alpha[history] * model.unigram(one)[word]))


def _score(model: Model, folds: int, fold: int, names: list[str], id_type: pa.DataType):
    schema = pa.schema([(names[0], id_type), *zip(names[1:], (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64()), strict=True)])

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        block = Block(docs.to_pylist()[0], folds, fold)
        heads = block.starts[:-1]
        one, _ = _aligned(replies, "reply", 1)
        known = np.add.reduceat((one > 0)[block.seq], heads, dtype=np.int64)
        plain = np.log10((one + 0.5) / (model.total + 0.5 * (model.distinct + 1)))
        base_score = np.add.reduceat(plain[block.seq], heads)
        two, _ = _aligned(replies, "reply", 2)
        alpha, short = _aligned(replies, "weight", 1, np.float64)
        score = np.add.reduceat(pair_log10(model, one, two, block.history, block.word, alpha, short)[block.at], heads)
        made = [block.lengths, known, ~block.training, np.full(len(known), model.total), base_score, score]
        return pa.table([block.ids.cast(id_type), *(pa.array(x) for x in made)], schema=schema)

    return run


def _look_up(group: pa.Table, stored: pa.Table) -> pa.Table:
    """What a shard's stored part of the model says of the keys that blocks send: counts (0: never seen) or weights (1: never a history)."""
    rows = []
    if not group.num_rows:
        return table_of(_SHARD_PA, rows)
    order, shard = group.column("ord")[0].as_py(), group.column("shard")[0].as_py()
    of = {x["kind"]: x for x in stored.to_pylist()}
    for sent in group.select(["block", "n", "keys"]).to_pylist():
        asked = unpack_keys(sent["keys"])
        for kind, reply, empty in (("model", "reply", np.int64(0)), ("backoff", "weight", np.float64(1.0))):
            if reply == "weight" and order != 1:
                continue
            out, flags = np.full(len(asked), empty), np.zeros(len(asked), bool)
            if (have := of.get(kind)) and have["n"]:
                keys = unpack_keys(have["keys"])
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                hit = keys[at] == asked
                out[hit] = unpack(have["counts"], type(empty))[at[hit]]
                if kind == "backoff":
                    flags[hit] = unpack_bits(have["mine"], have["n"])[at[hit]]
            rows.append((order, shard, sent["block"], sent["n"], None, pack(out), pack_bits(flags), None, reply))
    return table_of(_SHARD_PA, rows)


@dataclass(frozen=True)
class Fitted:
    """A stored model: its few numbers, tables of n-gram counts and of backoff weights (partitioned by kind), and the blocks it was fitted to."""

    model: Model
    ngrams: DataFrame
    weights: DataFrame
    states: DataFrame
    shards: int
    folds: int
    fold: int


def _states(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    return written(in_blocks(docs, id_col, text_col, block_bytes, _read, _STATE), "blocks")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, folds: int = 5, fold: int = 1, block_bytes: int = 8 << 20, shard_bytes: int = 16 << 20) -> Fitted:
    """Count, discount and store the model of the training rows."""
    _, n_bytes = text_bytes(docs, text_col)
    shards = n_shards(n_bytes, shard_bytes)
    states = _states(docs, id_col, text_col, block_bytes)
    sent = states.mapInArrow(_send_counts(shards, folds, fold), _SENT)
    table = written(sent.groupBy("ord", "shard").applyInArrow(_add_up(k), _SHARD), "ngrams", ["kind"])

    stats = table.where("kind = 'stat'").groupBy("ord").agg(*[F.sum(F.col("stat")[i]).alias(f"s{i}") for i in range(k + 3)]).collect()  # two rows
    of = {r["ord"]: [int(r[f"s{i}"]) for i in range(k + 3)] for r in stats}
    one, two = (Discounts.of(of.get(o, [0] * (k + 3))[: k + 1], *of.get(o, [0] * (k + 3))[k + 1 :], k) for o in (1, 2))
    small = of.get(1, [0] * (k + 3))
    over = small[k + 1] - sum(r * n for r, n in enumerate(small[:k], 1))  # counts above k stay whole
    model = Model(one, two).fitted(sum(r * d * n for r, (d, n) in enumerate(zip(one.factors, small, strict=False), 1)) + over)

    replies = table.where("kind = 'reply'").select(*_REPLY)
    masses = states.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_masses(model, shards, folds, fold), _SENT)
    weights = written(masses.groupBy("shard").applyInArrow(_add_masses, _SHARD), "backoff", ["kind"])
    return Fitted(model, table, weights, states, shards, folds, fold)


def _scored(fitted: Fitted, states: DataFrame, replies: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    names = [id_col, *(c.split()[0] for c in _SCORES.split(", "))]
    id_type = docs.schema[id_col].dataType
    made = _score(fitted.model, fitted.folds, fitted.fold, names, to_arrow_type(id_type))
    quoted = id_col.replace("`", "``")
    return states.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(made, f"`{quoted}` {id_type.simpleString()}, {_SCORES}")


def score_stored(fitted: Fitted, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """The columns of ``katz_scores`` for any texts, by what the stored tables say of their n-grams."""
    states = _states(docs, id_col, text_col, block_bytes)
    sent = states.mapInArrow(_send_counts(fitted.shards, fitted.folds, fitted.fold), _SENT)
    part = ["ord", "shard", "n", "keys", "counts", "mine", "kind"]
    stored = fitted.ngrams.where("kind = 'model'").select(*part).unionByName(fitted.weights.where("kind = 'backoff'").select(*part))
    replies = sent.groupBy("ord", "shard").cogroup(stored.groupBy("ord", "shard")).applyInArrow(_look_up, _SHARD)
    return _scored(fitted, states, replies.select(*_REPLY), docs, id_col)


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """Per row: id, n_tokens, n_known, held_out, train_tokens, base_score, score; the model is that of ``fit`` (which takes the options).

    ``k``: counts above it aren't discounted.  ``block_bytes`` / ``shard_bytes``: text per block and per n-gram shard, whatever the input's size.
    The shards answered these blocks' n-grams when they were counted and weighed, so the tables need not be searched again.  Tables are removed once all
    rows are scored.
    """

    def run() -> DataFrame:
        fitted = fit(docs, id_col, text_col, **options)
        replies = fitted.ngrams.where("kind = 'reply'").select(*_REPLY).unionByName(fitted.weights.where("kind = 'weight'").select(*_REPLY))
        return _scored(fitted, fitted.states, replies, docs, id_col)

    return finished(docs.sparkSession, "katz-scores", run)
