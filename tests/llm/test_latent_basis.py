"""op3's factors are those of all passages."""

import numpy as np
import pyarrow as pa

from eventflow.llm import decontaminate


def test_factors_are_fitted_to_every_text(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(12)]
    bench = decontaminate.Benchmark.of([(0, " ".join(words))])
    odds = np.arange(1, 14) ** 1.5
    texts = [" ".join((*words, "other")[k] for k in rng.choice(13, n, p=odds / odds.sum())) for n in rng.integers(1, 9, 41_000)]
    basis, idf, unknown = decontaminate.latent_basis(spark.createDataFrame([(t,) for t in texts], "text string"), bench, 4)
    passages = decontaminate.Passages(pa.array(texts), bench)
    passage, code, value = decontaminate._vectors(passages, idf, unknown)
    rows = np.zeros((passages.n_halves, len(words)))
    rows[passage, code] = value
    exact = np.linalg.eigh(rows.T @ rows)[1][:, ::-1][:, :4]
    assert basis.shape == exact.shape
    assert np.abs(basis @ basis.T - exact @ exact.T).max() < 1e-6


def test_a_sketch_gives_the_leading_eigenvectors():
    rng = np.random.default_rng(12)
    turn = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    g = (turn * 0.5 ** np.arange(60)) @ turn.T
    omega = rng.standard_normal((60, 20))
    got = decontaminate._from_sketch(g @ omega, omega)[:, :4]
    assert np.abs(got @ got.T - turn[:, :4] @ turn[:, :4].T).max() < 1e-4
    assert decontaminate._from_sketch(np.zeros((60, 20)), omega).shape == (60, 0)
    assert decontaminate._from_sketch(np.zeros((0, 0)), np.zeros((0, 0))).shape == (0, 0)


def test_the_pipeline_fits_to_every_row(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    item = "the first question of the benchmark asks for seven green birds"
    docs = spark.range(41_000).selectExpr("id AS doc_id", f"IF(id % 5000 = 0, concat('now {item} ', id), concat('the green question ', id)) AS text")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, partial = [], decontaminate._partial

    def counted(texts, *rest):
        seen.append(texts.count())
        return partial(texts, *rest)

    monkeypatch.setattr(decontaminate, "_partial", counted)
    left = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    assert left.count() == 41_000 - 9
    assert len(seen) >= 2 and set(seen) == {41_000}
