"""op6 holds a block's words and what it finds in them, not arrays of hashes as long as the block."""

import tracemalloc

import numpy as np
import pyarrow as pa

from eventflow.llm import phrases
from eventflow.llm.common import HashedWords, small_batches


def _rows(n, words, seed=3):
    rng = np.random.default_rng(seed)
    return pa.table({"id": pa.array(range(n)), "text": [" ".join(f"w{x}" for x in rng.integers(0, 5000, words)) for _ in range(n)]})


def test_the_work_on_a_block_takes_few_bytes_a_word():
    state = phrases._gathered(0, _rows(2000, 400))
    keys = [c for c in state.column_names if c not in ("part", "rows")]
    head = state.select(keys).slice(0, 1)
    tracemalloc.start()
    try:
        sent = list(phrases._send_anchors(35, 1)(head.to_batches()))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, sent)) == 1
    assert peak < 32 * 2000 * 400


def test_no_row_of_a_block_is_as_large_as_its_texts():
    rows = _rows(4000, 400)
    state = phrases._gathered(7, rows)
    texts = [len(x or b"") for x in state.column("rows").to_pylist()]
    assert len(texts) > 2 and max(texts) < rows.nbytes / 3
    opened = [pa.ipc.open_stream(x).read_all() for x in state.column("rows").to_pylist() if x]
    assert pa.concat_tables(opened).column("id").to_pylist() == list(range(4000))


def test_pieces_of_a_block_find_what_the_whole_does():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 6, n)) for n in rng.integers(0, 300, 60)] + ["", None]
    words = HashedWords(pa.array(texts))
    row = {"block": 0, "keys": phrases.pack_keys(words.keys), "codes": phrases.pack(words.codes), "lengths": phrases.pack(words.lengths)}
    for width in (8, 9, 35):
        whole, parts = phrases.Block(row, width, 1 << 30), phrases.Block(row, width, 50)
        anchors, found = whole.anchors()
        assert len(anchors) and all(np.array_equal(a, b) for a, b in zip((anchors, found), parts.anchors(), strict=True))
        again = rng.random(len(anchors)) < 0.3
        assert all(np.array_equal(a, b) for a, b in zip(whole.candidates(anchors, again), parts.candidates(anchors, again), strict=True))
        # an anchor is the least phrase of a window, by brute force
        least = set()
        phrase = whole._phrases(whole.words.keys[words.codes], words.room())
        for at in np.flatnonzero(words.room() >= width).tolist():
            span = phrase[at : at + width - phrases.ANCHOR + 1]
            least.update((at + np.flatnonzero(span == span.min())).tolist())
        assert anchors.tolist() == sorted(least)


def test_shards_count_keys_a_few_at_a_time():
    rng = np.random.default_rng(6)
    keys = [np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in (900, 1, 400, 2000)]
    many = [rng.random(len(k)) < 0.1 for k in keys]
    places = np.bincount(np.concatenate(keys).astype(int), weights=np.concatenate(many) + 1.0)
    for at_a_time in (1, 64, 1 << 20):
        for k, got in zip(keys, phrases._recurring(keys, many, at_a_time), strict=True):
            assert np.array_equal(got, places[k.astype(int)] > 1)


def test_texts_reach_python_a_few_at_a_time(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    docs = spark.createDataFrame([(i, "word " * 2000) for i in range(400)], "id long, text string").coalesce(1)

    def rows(batches):
        for rb in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(rb)], pa.int64())], names=["n"])

    with small_batches(spark, 100_000):
        got = [r.n for r in docs.mapInArrow(rows, "n long").collect()]
    assert sum(got) == 400 and max(got) < 40
    assert spark.conf.get(key, None) == before
