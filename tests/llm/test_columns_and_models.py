"""Columns called like inner ones, odd ids, hot groups, and the stored or learned parts of operators."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventflow.llm import decontaminate, html, katz, line_dedup, mixing, phrases, pii, quality, simhash, tokens
from eventflow.llm.common import HashedWords, finished, free_names, text_slices, written

INNER = "__key __their_key __node __first __of __their_id __doc __row __bitmap __id __text __src __none __bucket __size epoch words_taken size target taken tile fp node id text_ batch of root rows block".split()
LINE = "This line is common to very many documents, word for word."


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", *(f"{LINE}\n{' '.join(f'w{k}x{i}' for k in range(30))}" for i in range(8)), " ".join(f"q{k}" for k in range(40)), " ".join(f"q{k}" for k in range(40))]
    rows = [(i, t, "ab"[i % 2], *(f"{c}{i}" for c in INNER)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'`{c}` string' for c in INNER)}").cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(7, " ".join(f"q{k}" for k in range(20))), (None, "nothing of this is anywhere in them at all, really")], "item_id int, text string")


def others(df):
    return {r["doc_id"]: tuple(r[c] for c in INNER) for r in df.collect()}


def test_filters_return_all_columns_unchanged(docs, bench):
    before = others(docs)
    for made in (quality.quality_filter(docs), line_dedup.line_dedup(docs), simhash.drop_near_duplicates(docs), decontaminate.decontaminate(docs, bench)):
        assert made.columns == docs.columns and made.dtypes == docs.dtypes
        after = others(made)
        assert after and all(before[i] == row for i, row in after.items())
    assert sorted(others(decontaminate.decontaminate(docs, bench))) == list(range(10))
    mixed = mixing.mixed_corpus(docs)
    assert mixed.columns == [*docs.columns, "epoch_", "words_taken_"]
    assert all(before[i] == row for i, row in others(mixed).items())


def test_reports_read_only_their_columns(docs, bench):
    import public_tokenizers

    for made in (
        katz.katz_scores(docs), phrases.repeated_phrases(docs), line_dedup.line_dedup_report(docs), simhash.simhash_report(docs), pii.personal_data(docs), mixing.mix_sources(docs),
        quality.quality_features(docs), tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")),
    ):
        assert made.columns[0] == "doc_id" and made.count() == docs.count()
    found = decontaminate.contamination(docs, bench)
    assert dict(found.dtypes)["item_id"] == "int" and sorted((r.doc_id, r.item_id) for r in found.collect()) == [(10, 7), (11, 7)]
    for bad in (lambda: mixing.mix_sources(docs, ["doc_id", "size"]), lambda: decontaminate.contamination(docs.withColumnRenamed("doc_id", "found"), bench, id_col="found")):
        with pytest.raises(ValueError):
            bad()


def test_ids_of_other_types(docs, bench):
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    for made in (katz.katz_scores(named), phrases.repeated_phrases(named), simhash.simhash_report(named), pii.personal_data(named), mixing.mix_sources(named), simhash.drop_near_duplicates(named)):
        assert dict(made.dtypes)["doc_id"] == "string" and made.count() > 0
    assert decontaminate.contamination(named, bench).count() == 2
    with pytest.raises(TypeError):
        line_dedup.line_dedup(named)
    small = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
    assert dict(line_dedup.line_dedup_report(small).dtypes)["doc_id"] == "int" and line_dedup.line_dedup_report(small).count() == docs.count()


def test_names_and_slices():
    import pyarrow as pa

    assert free_names(["A", "b", "b_"], "a", "b", "c", "c") == ["a_", "b__", "c", "c_"]
    texts = pa.array(["xx" * 50, None, "", "y" * 1000, "z"])
    parts = list(text_slices(texts, 200))
    assert [t for _, p in parts for t in p.to_pylist()] == texts.to_pylist() and len(parts) > 1 and all(p.offset == 0 for _, p in parts)
    words = HashedWords(pa.chunked_array([texts, pa.array(["one two one"])]), piece_bytes=100)
    assert words.lengths.tolist() == [1, 0, 0, 1, 1, 3] and words.codes[3] == words.codes[5] != words.codes[4]
    assert words.room().tolist() == [1, 1, 1, 3, 2, 1]


def test_what_is_written_on_the_way_goes(spark, tmp_path):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "eventflow"
    held = []

    def make():
        held.append(written(spark.range(5), "inner"))
        assert list(folder.glob("inner-*"))
        return held[0]

    out = finished(spark, "outer", make)
    assert out.count() == 5 and not list(folder.glob("inner-*")) and list(folder.glob("outer-*"))


def test_stored_model_scores_as_the_fit_does(docs):
    fitted = katz.fit(docs, block_bytes=500, shard_bytes=300)
    assert fitted.shards > 1 and {r.kind for r in fitted.ngrams.select("kind").distinct().collect()} == {"model", "reply", "stat"}
    one = {r.doc_id: r for r in katz.katz_scores(docs).collect()}
    two = {r.doc_id: r for r in katz.score_stored(fitted, docs).collect()}
    assert one.keys() == two.keys()
    for i, r in one.items():
        assert r.score == pytest.approx(two[i].score) and r.base_score == pytest.approx(two[i].base_score) and r[1:5] == two[i][1:5]
    new = docs.sparkSession.createDataFrame([(100, "This line never seen")], "doc_id long, text string")
    r = katz.score_stored(fitted, new).first()
    assert (r.n_tokens, r.n_known) == (5, 3) and np.isfinite(r.score) and r.score < 0


def test_crowded_tiles_are_cut_without_loss(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (25, 2))}
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    table = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)

    def groups(tile_rows):
        links = simhash.near_links(table, 2, tile_rows).collect()
        assert all(0 < (r.a ^ r.b & (1 << 64) - 1).bit_count() for r in links)
        label = {f: f for f in fps}
        for _ in range(len(fps)):
            before = dict(label)
            for r in links:
                label[r.a] = label[r.b] = min(label[r.a], label[r.b])
            if before == label:
                return label

    want = {f: f for f in fps}
    for _ in range(len(fps)):
        now = {a: min(want[b] for b in fps if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2) for a in fps}
        if now == want:
            break
        want = now
    assert groups(200_000) == groups(3) == groups(1) == want


PERSONAL = {
    "phone_local": ["call me at (212) 555-0199 today", "tel. 212-555-0187 please"],
    "national_id": ["SSN: 123-45-6789 on file", "her social security number 219-09-9999 is"],
    "birth_date": ["she was born 12.03.1985 in town", "dob: 1985-03-12 as told"],
    "iban": ["pay to IBAN DE89 3704 0044 0532 0130 00 now", "account GB82WEST12345698765432 please"],
    "street": ["I live at 12 Baker Street in town", "wohnhaft Hauptstraße 12a dort", "domicile 12 rue de Rivoli ici", "vive en Calle Mayor 5 hoy"],
    "person": ["Dear Mr. John Smith, hello", "name: Maria Lopez here"],
    "secret": ["password=correcthorse next", "api_key: 'sk-abc123def456ghi789jkl' set", 'token = "9fceb02d0ae598e95dc970b74767f19372d61af8" in'],
}
PLAIN = ["version 1.2.3 of 2024-01-05", "page 12345 of 99", "the year 2024 and 7/8", "model A1B2 costs 10", "number 666-12-3456 here", "GB00WEST12345698765432 as text", "The Way of all things, Road works ahead", "order 2019-05-06 sent"]


def test_added_kinds_are_found_and_others_left_alone(spark):
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in PERSONAL.items() for t in ts)] + [(1000 + i, t, None) for i, t in enumerate(PLAIN)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()}
    for i, text, kind in rows:
        kinds = [s.split(":")[0] for s in got[i].spans.split(",") if s]
        assert kinds == ([kind] if kind else []), (text, got[i].spans)
        assert got[i].n_added == len(kinds) == got[i].n_spans


def test_many_spans_take_linear_time():
    def took(n):
        text = " ".join(f"u{i}@mail.example.com token=a1b2c3d4e5f6{i} then 212-555-0187" for i in range(n))
        began = time.perf_counter()
        n_found = sum(1 for _ in pii.candidates(text, pii.base_spans(text)))
        assert n_found == 2 * n
        return time.perf_counter() - began

    took(100)
    assert took(16_000) < 12 * took(4_000) + 1


def test_reliabilities_follow_agreement():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.8, 0.7)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, table, share = pii.reliabilities(patterns, counts.astype(float))
    assert share == pytest.approx(0.3, abs=0.05)
    assert table[0, 1, 2] > table[1, 1, 2] > table[2, 1, 2]
    of = {tuple(p): x for p, x in zip(patterns.tolist(), post, strict=True)}
    judged = np.array([of[tuple(v)] > 0.5 for v in votes.tolist()])
    assert (judged == truth).mean() > 0.93


def test_quality_features_are_made_for_rows_alive_only():
    asked = []
    rules = (quality.Rule("first", lambda b: np.array([t == "bad" for t in b.texts])), quality.Rule("second", lambda b: asked.append(len(b.texts)) or b.n_repeat_words > 5))
    batch = quality.Batch(["bad", "good text", None])
    alive = np.flatnonzero(~rules[0].rejects(batch))
    assert rules[1].rejects(batch.take(alive)).tolist() == [False, False] and asked == [2]
    assert batch.n_words.tolist() == [1, 2, 0] and batch.take(np.array([1])).n_words.tolist() == [2]


def test_cascade_puts_cheap_strong_rules_first(spark):
    def slow(b):
        time.sleep(0.02)
        return np.zeros(len(b.texts), bool)

    rules = (quality.Rule("slow", slow), quality.Rule("strong", lambda b: np.array([len(t) < 5 for t in b.texts])))
    table = spark.createDataFrame([(i, "abc" if i % 2 else "abcdefgh") for i in range(40)], "doc_id long, text string")
    plan = quality.plan_rules(table, rules)
    assert [p[0] for p in plan] == ["strong", "slow"] and plan[0][2] == 0.5
    assert len(quality.sampled(spark.range(10_000).select(F.lit("x" * 50_000).alias("text")), 100, chars=10)) < 200


def test_pages_are_read_by_their_columns_only(spark):
    pages = spark.createDataFrame([(1, "u", "<p>some words of a page</p>", "x")], "page_id long, url string, html string, `__html` string")
    assert html.extract_main_text(pages).first().text == "some words of a page"


def test_latent_search_by_itself(spark, sf):
    """Items among real text, one word in eight replaced: what the cosine finds without the shared words, of what both find."""
    import random

    rng = random.Random(2)
    items = [(r.item_id, r.text.split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text and len(r.text.split()) >= 8]
    around = [r.text.split() for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if r.text and len(r.text.split()) >= 100]
    rows = []
    for k, (_, words) in enumerate(items):
        words = list(words)
        for at in rng.sample(range(len(words)), len(words) // 8):
            words[at] = f"other{at}"
        outer, cut = around[k % len(around)], rng.randint(20, 80)
        rows.append((k, " ".join(outer[:cut] + words + outer[cut:])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet")
    both, latent = ({(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench, exact=e).collect()} for e in (True, False))
    assert len(both & {(k, i) for k, (i, _) in enumerate(items)}) >= 0.9 * len(items)
    assert latent <= both and len(latent) >= 0.9 * len(both)
