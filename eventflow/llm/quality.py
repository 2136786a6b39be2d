"""Quality rules as a short-circuit cascade.

Every rule is a test on features that are made when a rule first asks for them, for the rows
still alive only.  A random sample of rows gives each
rule's cost (seconds per row, its features included) and selectivity (share of the rows still alive that it
rejects); rules then run in the order of rejection per cost, each only on rows that
all earlier rules let pass.  The two halves of the base rule (too few words, too many in repeated windows: by far the
dearest) are rules like others, save where their counts are asked for anyway.  The order changes the time taken, never the verdict.

Null, empty and word-less texts have zero words; the base rule rejects them.  Ids may
be null or repeated: rows are judged one by one.  Texts are read a piece at a time, a very long one alone.  Extra columns are
returned as they are by ``quality_filter``, whatever they are called; ``quality_features`` refuses to return one that is called like its own.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import Words, col, free_names, gram_hashes, pair, text_slices

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
#: Text that is worked on at a time.
_PIECE_BYTES = 4 << 20
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


class Batch:
    """What rules may look at: the texts, and features of them that are made when first asked for."""

    def __init__(self, texts: list[str | None], made: dict[str, np.ndarray] | None = None):
        self.texts = [t or "" for t in texts]
        self._made: dict[str, np.ndarray] = made or {}

    def take(self, at: np.ndarray) -> Batch:
        return Batch([self.texts[i] for i in at], {k: v[at] for k, v in self._made.items()})

    def fresh(self) -> Batch:
        return Batch(self.texts)

    def _feature(self, name: str, of: Callable[[str, bytes], int]) -> np.ndarray:
        if name not in self._made:
            self._made[name] = np.fromiter((of(t, t.encode()) for t in self.texts), np.int64, len(self.texts))
        return self._made[name]

    @property
    def n_words(self) -> np.ndarray:
        return self._feature("n_words", lambda t, raw: len(raw.split()))

    @property
    def word_chars(self) -> np.ndarray:
        """Code points in words."""
        return self._feature("word_chars", lambda t, raw: len(t) - (len(raw) - len(raw.translate(None, SPACE))))

    def count(self, chars: bytes) -> np.ndarray:
        """How many of ``chars`` a text has."""
        return self._feature(f"count {chars!r}", lambda t, raw: len(raw) - len(raw.translate(None, chars)))

    @property
    def n_symbols(self) -> np.ndarray:
        return self.count(SYMBOLS)

    def _lines(self, name: str, of: Callable[[list[str]], int]) -> np.ndarray:
        return self._feature(name, lambda t, raw: of([x for x in t.split("\n") if _HAS_WORD.search(x)]))

    @property
    def n_lines(self) -> np.ndarray:
        """Lines with a word."""
        return self._lines("n_lines", len)

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines("n_dup_lines", lambda lines: len(lines) - len(set(lines)))

    def lines_like(self, pattern: re.Pattern[str]) -> np.ndarray:
        return self._lines(f"lines {pattern.pattern}", lambda lines: sum(pattern.search(x) is not None for x in lines))

    @property
    def n_repeat_words(self) -> np.ndarray:
        if "n_repeat_words" not in self._made:
            self._made["n_repeat_words"] = repeated_words(Words(pa.array(self.texts, pa.large_string())))
        return self._made["n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a boolean per row of a batch."""

    name: str
    rejects: Callable[[Batch], np.ndarray]


_UPPER, _SMALL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_BULLET = re.compile(r"^[\x20\t]*[-*\u2022\u2023\u25aa\u25cf]")
_ELLIPSIS = re.compile(r"(?:\.\.\.|\u2026)[\x20\t\r]*$")

#: The base rule in two halves.
BASE: tuple[Rule, ...] = (
    Rule("few_words", lambda b: b.n_words < 10),
    Rule("repeated_windows", lambda b: 100 * b.n_repeat_words > 20 * b.n_words),
)
#: Production rules; thresholds are shares that prose of any length keeps well clear of.
RULES: tuple[Rule, ...] = (
    Rule("symbols_per_word", lambda b: b.n_symbols > 0.3 * b.n_words),
    Rule("mean_word_length", lambda b: (b.word_chars < 2 * b.n_words) | (b.word_chars > 25 * b.n_words)),
    Rule("duplicate_lines", lambda b: (b.n_dup_lines >= 3) & (b.n_dup_lines > 0.3 * b.n_lines)),
    Rule("shouting", lambda b: b.count(_UPPER) > b.count(_SMALL)),
    Rule("exclamations", lambda b: b.count(b"!?") > 0.3 * b.n_words),
    Rule("digits", lambda b: b.count(b"0123456789") > 0.5 * b.word_chars),
    Rule("bullets", lambda b: (b.n_lines >= 5) & (b.lines_like(_BULLET) > 0.9 * b.n_lines)),
    Rule("ellipses", lambda b: (b.n_lines >= 5) & (b.lines_like(_ELLIPSIS) > 0.5 * b.n_lines)),
)


def repeated_words(words: Words, width: int = 5) -> np.ndarray:
    """Per text, the words inside windows of ``width`` words found twice or more in that text."""
    n = len(words.codes)
    out = np.zeros(words.n_docs, np.int64)
    if n < width:
        return out
    starts = np.flatnonzero(np.arange(n) + width <= words.starts[words.doc + 1])
    if not len(starts):
        return out
    # distinct words have distinct codes within the batch, so codes stand for words
    grams = gram_hashes(words.codes.astype(np.uint64), width)[starts]
    keys = pair(words.doc[starts].astype(np.uint64), grams)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    hit = starts[twice]
    edge[hit] += 1
    np.subtract.at(edge, hit + width, 1)
    covered = np.cumsum(edge)[:n] > 0
    return np.bincount(words.doc[covered], minlength=words.n_docs).astype(np.int64)


def base_failed(b: Batch) -> np.ndarray:
    return (b.n_words < 10) | (100 * b.n_repeat_words > 20 * b.n_words)


def sampled(docs: DataFrame, rows: int, text_col: str = "text", chars: int = 20_000, seed: int = 11) -> list[str | None]:
    """Texts of about ``rows`` random rows, of long ones the beginning: what the driver holds has a bound."""
    n = docs.count()
    part = docs.select(F.substring(col(text_col), 1, chars))
    return [r[0] for r in (part if n <= rows else part.sample(False, rows / n, seed)).collect()]


def plan_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, text_col: str = "text", given: bool = False) -> list[tuple[str, float, float]]:
    """(name, seconds per row, share rejected) in the order to run, by a sample of about ``sample_rows`` rows.

    ``given``: rows have passed the base rule already, and its counts are there.
    """
    batch = Batch(sampled(docs, sample_rows, text_col))
    alive, left, out = np.flatnonzero(~base_failed(batch)) if given else np.arange(len(batch.texts)), list(rules), []
    while left:
        view, scored = batch.take(alive), []
        for rule in left:
            own = view if given else view.fresh()
            began = time.perf_counter()
            hit = rule.rejects(own)
            cost = max(time.perf_counter() - began, 1e-7) / max(1, len(alive))
            scored.append((float(hit.mean()) / cost if len(alive) else 0.0, rule, cost, float(hit.mean()) if len(alive) else 0.0, hit))
        _, rule, cost, share, hit = max(scored, key=lambda x: x[0])
        out.append((rule.name, cost, share))
        left.remove(rule)
        alive = alive[~hit] if len(alive) else alive
    return out


def quality_features(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """The base counts, ``base_failed``, ``kept`` and ``failed_rule`` (first rule that rejects, else null) of every row."""
    by_name = {r.name: r for r in rules}
    cascade = [by_name[n] for n, _, _ in plan_rules(docs, rules, sample_rows, text_col, given=True)]
    extra = [f for f in docs.schema.fields] if keep_columns else [docs.schema[id_col]]
    counts = [f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    names = [f.name for f in extra]
    ours = [*(c.split()[0] for c in counts), "base_failed", "kept", "failed_rule"]
    if clash := set(map(str.lower, names)) & set(ours):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, texts in text_slices(whole.column(whole.num_columns - 1), _PIECE_BYTES):
                rb, b = whole.slice(at, len(texts)), Batch(texts.to_pylist())
                failed = base_failed(b)
                why = np.full(len(b.texts), None, dtype=object)
                why[failed] = "base"
                alive = np.flatnonzero(~failed)
                for rule in cascade:  # only rows that every earlier rule let pass
                    if not len(alive):
                        break
                    hit = rule.rejects(b.take(alive))
                    why[alive[hit]] = rule.name
                    alive = alive[~hit]
                kept = np.zeros(len(b.texts), bool)
                kept[alive] = True
                made = [b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, failed, kept, pa.array(why.tolist(), pa.string())]
                yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in range(len(names))), *(pa.array(x) if not isinstance(x, pa.Array) else x for x in made)], names=[*names, *ours])

    out = ", ".join(["`%s` %s" % (f.name.replace("`", "``"), f.dataType.simpleString()) for f in extra] + counts + ["base_failed boolean", "kept boolean", "failed_rule string"])
    (text,) = free_names(names, "__text")
    return docs.select(*[col(n) for n in names], col(text_col).alias(text)).mapInArrow(run, out)


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, text_col: str = "text") -> DataFrame:
    """The rows whose text passes the base rule and the other rules, all columns unchanged."""
    by_name = {r.name: r for r in (*BASE, *rules)}
    cascade = [by_name[n] for n, _, _ in plan_rules(docs, tuple(by_name.values()), sample_rows, text_col)]
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, texts in text_slices(whole.column(at_text), _PIECE_BYTES):
                batch, alive = Batch(texts.to_pylist()), np.arange(len(texts))
                for rule in cascade:
                    if not len(alive):
                        break
                    passed = np.flatnonzero(~rule.rejects(batch))
                    if len(passed) < len(alive):
                        batch, alive = batch.take(passed), alive[passed]
                yield whole.slice(at, len(texts)).take(pa.array(alive))

    return docs.mapInArrow(run, docs.schema)
