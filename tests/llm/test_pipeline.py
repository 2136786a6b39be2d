"""Each pipeline stage against what it says of its own input, and the registered queries."""

import pytest

import corpus_pipeline
from eventflow.llm import decontaminate, mixing, quality, simhash
from eventflow.llm.queries import oracle_sql, queries
from tests.conftest import canonical


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output of every stage, each written and read again."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "docs")
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs, after
        docs = after
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        if name != "mixing":
            assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality(stages):
    before, after = stages["quality_rules"]
    assert ids(after) == ids(quality.quality_features(before).where("kept"))
    assert 0 < after.count() < before.count()


def test_quality_against_labels(stages, spark, sf):
    """Junk goes; of the labelled good documents, what the base rule lets pass stays."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    before, _ = stages["quality_rules"]
    judged = quality.quality_features(before).join(labels, "doc_id").collect()
    bad, good = [r for r in judged if r.quality == 0], [r for r in judged if r.quality == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
    assert sum(r.kept for r in good) >= 0.97 * len(good)


def test_lines(stages):
    before, after = stages["line_dedup"]
    assert ids(after) == ids(before)
    was = {r.doc_id: r.text.split("\n") for r in before.collect()}
    for r in after.collect():
        rest = iter(was[r.doc_id])
        assert r.text == "" or all(line in rest for line in r.text.split("\n"))
        assert r.n_chars == len(r.text)


def test_near_duplicates(stages):
    before, after = stages["near_dedup"]
    texts = {r.doc_id: r.text for r in before.collect()}
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in texts.items()}
    kept = set(ids(after))
    alike = {i: [j for j in sets if j != i and (not sets[i] and not sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))] for i in sets}
    assert all(alike[i] for i in set(texts) - kept)  # only near duplicates go
    twice = [i for i in kept if any(j in kept for j in alike[i])]
    assert len(twice) <= 0.02 * sum(bool(x) for x in alike.values())


def test_decontamination(stages, spark, sf):
    before, after = stages["decontamination"]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [" ".join(decontaminate.item_words(r.text)) for r in bench.collect()]
    kept = {r.doc_id: " ".join(decontaminate.item_words(r.text)) for r in after.collect()}
    assert not [d for d, t in kept.items() if any(i and i in t for i in items)]
    gone = set(ids(before)) - set(kept)
    assert gone == {r.doc_id for r in decontaminate.contamination(before, bench).collect()}


def test_mix(stages):
    before, after = stages["mixing"]
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(before).collect() if r.taken}
    got = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.words_taken
    assert {d: n for d, n in got.items() if n} == taken


def test_run(spark, sf, stages):
    assert sorted(corpus_pipeline.run(spark, sf).select("doc_id", "epoch").collect()) == sorted(stages["mixing"][1].select("doc_id", "epoch").collect())


@pytest.mark.parametrize("name", list(queries()))
def test_queries(spark, sf, duck, name):
    got = queries()[name](spark, sf).toPandas()
    assert len(got)
    if name in oracle_sql():
        assert canonical(got) == canonical(duck.sql(oracle_sql()[name]).df())


def test_paraphrases_are_found(spark, sf):
    """Items with every seventh word replaced, inside documents."""
    import random

    rng = random.Random(1)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    filler = [w for t in texts for w in t.split()]
    rows = []
    for r in bench.collect():
        w = decontaminate.item_words(r.text)
        for k in rng.sample(range(len(w)), len(w) // 7):
            w[k] = rng.choice(filler)
        rows.append((r.item_id, " ".join([*rng.choices(filler, k=80), *w, *rng.choices(filler, k=80)])))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert len([1 for i, _ in rows if (i, i) in got]) >= 0.9 * len(rows)
