"""Token counts with the whole-token shortcut.

Once, before any text is read, the library itself encodes every string of the
vocabulary; those that come out as one token are proved to be *whole*.  A pre-token
(what the tokenizer's own splitting pattern yields) that is whole counts 1 by a table
look-up; only the rest is merged, once per distinct string of a batch.

Texts are cut at single spaces into pieces whose splitting doesn't depend on their
neighbours, pieces are dictionary-encoded by Arrow, and only distinct pieces are split
and counted.  Texts where that would not hold (runs of white space with a space in
them, or white space beyond ASCII) are split whole.

Merges run on ranks read from the tokenizer file, after a proof that the file's merge
order and its ids agree.  A special token's string inside a text is cut out first, as the
library does by default.  Null or empty texts have no tokens.  Texts are read a piece at a time, a
very long one alone; rows are judged one by one, so repeated rows and null ids need no care.  Other columns are not read, so
their names can't clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import col, text_slices

#: Text that is worked on at a time.
_PIECE_BYTES = 4 << 20
#: How byte-level tokenizers split before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts in which a piece's splitting could depend on the piece next to it.
_TOUCHY = r"[ ][\t\n\x0b\x0c\r ]|[\t\n\x0b\x0c\r ][ ]|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + n)] = b
            n += 1
    return table


class TokenCounter:
    """Counts tokens as the library does for a byte-level BPE file given as JSON text."""

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        data = json.loads(spec)
        pre, model = data["pre_tokenizer"] or {}, data["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        made = [vocab[a + b] for a, b in merges]
        sound = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not data.get("normalizer") and model["type"] == "BPE" and all(x < y for x, y in zip(made, made[1:]))
        if not sound:
            raise ValueError("not a plain byte-level BPE whose ids follow its merges")
        letter = _byte_letters()
        self.special = [t["content"] for t in data["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings aren't supported")
        ranks = {bytes(letter[c] for c in s): i for s, i in vocab.items() if s not in self.special}
        self.merger = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split = regex.compile(SPLIT).findall
        # The proof: only strings that the library itself turns into one token are whole.
        strings = [s.decode() for s in ranks if _is_text(s)]
        encoded = self.library.encode_batch(strings, add_special_tokens=False)
        self.whole = {s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1}
        self.odd = {s: len(e.ids) for s, e in zip(strings, encoded, strict=True) if len(e.ids) != 1}

    def of_pre_token(self, s: str) -> int:
        if s in self.whole:
            return 1
        return self.odd[s] if s in self.odd else len(self.merger(s.encode()))

    def of_text(self, text: str) -> int:
        """One text, split whole."""
        parts, n = [text], 0
        for special in self.special:
            cut = [p.split(special) for p in parts]
            n += sum(len(c) - 1 for c in cut)
            parts = [x for c in cut for x in c]
        whole, of = self.whole, self.of_pre_token
        return n + sum(1 if p in whole else of(p) for part in parts if part for p in self.split(part))

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        touchy = pc.match_substring_regex(texts, _TOUCHY)
        for special in self.special:
            touchy = pc.or_(touchy, pc.match_substring(texts, special))
        touchy = np.asarray(touchy)
        out = np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(touchy).tolist():
            out[i] = self.of_text(texts[i].as_py())
        plain = np.flatnonzero(~touchy)
        if not len(plain):
            return out
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
        coded = lists.flatten().dictionary_encode()
        codes, pieces = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
        first = np.concatenate([[True], owner[1:] != owner[:-1]])  # has no space before it
        spaced, bare = self._of_pieces(pieces, " ", np.unique(codes[~first])), self._of_pieces(pieces, "", np.unique(codes[first]))
        out[plain] = np.bincount(owner, weights=np.where(first, bare[codes], spaced[codes]), minlength=len(plain)).astype(np.int64)
        return out

    def _of_pieces(self, pieces: list[str], before: str, at: np.ndarray) -> np.ndarray:
        out, seen, whole, split = np.zeros(len(pieces), np.int64), {}, self.whole, self.split
        for i in at.tolist():
            piece = before + pieces[i]
            if piece in whole:
                out[i] = 1
                continue
            n = 0
            for p in split(piece):
                if p in whole:
                    n += 1
                else:
                    if (k := seen.get(p)) is None:
                        k = seen[p] = self.of_pre_token(p)
                    n += k
            out[i] = n
        return out


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


_COUNTERS: dict[int, TokenCounter] = {}


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).  The file is read by the driver and sent along (a vocabulary: a few MB whatever the data)."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = spec.value
        counter = _COUNTERS.get(hash(text))
        if counter is None:
            _COUNTERS.clear()
            counter = _COUNTERS[hash(text)] = TokenCounter(text)
        for rb in batches:
            for at, texts in text_slices(rb.column(1), _PIECE_BYTES):
                n = counter.of_texts(texts)
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(at, len(texts)), rb.column(2).slice(at, len(texts)), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    made = docs.select(col(id_col)).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    size = F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long")
    return docs.select(col(id_col).alias("id"), col(text_col).alias("text"), size.alias("bytes")).mapInArrow(run, made)
