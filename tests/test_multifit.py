"""Logistic regressions fitted side by side: MLlib's fits, from shared passes over the rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revlens.plans import multifit, training


def _counts(spark, labels=(0, 1, 2), n=240, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.choice([labels[0], *labels])
        words = [f"w{y * 15 + rng.randrange(40)}" for _ in range(rng.randint(1, 25))]
        rows.append((i, " ".join(words + words[:1] * rng.choice((0, 0, 1, 300))), y, (1.5, 0.5, 2.0)[y]))
    return training.term_counts(spark.createDataFrame(rows, "Id long, cleaned string, sentiment int, classWeight double"))


@pytest.mark.parametrize("labels", [(0, 1, 2), (0, 1), (0, 2), (1,)])
def test_fits_equal_mllib_after_every_number_of_steps(spark, labels):
    data = training.with_folds(_counts(spark, labels), 2)
    with multifit.Rows(data, 3) as rows:
        seen = {fold: rows.seen_without(fold) for fold in (0, None)}
        idf = {fold: training.tfidf_stages()[-1].fit(data if fold is None else data.filter(F.col("fold") != fold)) for fold in seen}
        for fold, model in idf.items():
            assert multifit.idf(seen[fold], training.MIN_DOC_FREQ) == pytest.approx(model.idf.toArray(), rel=1e-14)
        fits = {(fold, reg): multifit.task(s, idf[fold].idf.toArray(), reg, fold) for fold, s in seen.items() for reg in (0.001, 0.1)}
        points = rows.fit(fits, [3, 12], 1e-6)
        for (fold, reg), end in ((k, e) for k in fits for e in (3, 12)):
            train = idf[fold].transform(data if fold is None else data.filter(F.col("fold") != fold))
            want = training.logreg(regParam=reg, maxIter=end).fit(train)
            coefficients, intercepts = fits[fold, reg].solution(points[(fold, reg), end])
            assert coefficients == pytest.approx(want.coefficientMatrix.toArray(), abs=1e-8)
            assert intercepts == pytest.approx(want.interceptVector.toArray(), abs=1e-8)


def test_cross_validation_passes_do_not_grow_with_the_grid(spark):
    """All folds and grid points share the passes; before, each fit read the rows by itself, once a step."""
    counts, tracker, jobs = _counts(spark), spark.sparkContext.statusTracker(), []
    for regs in ([0.1], [0.001, 0.003, 0.01, 0.03, 0.1]):
        group = f"cv-{len(regs)}"
        spark.sparkContext.setJobGroup(group, group)
        cv = training.cross_validate(counts, folds=2, reg_params=regs, max_iters=[8, 16])
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    judging = 2 * 2 * 8 * 3  # added grid points, folds, jobs of one metrics row at most
    assert jobs[1] - jobs[0] <= judging + 16, jobs
    assert len(cv.avgMetrics) == 10 and cv.best == cv.params[cv.avgMetrics.index(max(cv.avgMetrics))]
    refit, best = training.fit_logreg(counts, **cv.best).stages[-1], cv.bestModel.stages[-1]
    assert best.coefficientMatrix.toArray() == pytest.approx(refit.coefficientMatrix.toArray(), abs=1e-8)
    assert best.getRegParam() == cv.best["regParam"] and best.getMaxIter() == cv.best["maxIter"]


def test_best_model_is_saved_and_evaluated_on_counts_and_texts(spark, scratch):
    rows = [(i, f"{('good tea', 'bad box', 'fine leaf')[i % 3]} x{i % 5} tea", i % 3, 1.0) for i in range(60)]
    texts = spark.createDataFrame(rows, "Id long, cleaned string, sentiment int, classWeight double")
    cv = training.cross_validate(texts, folds=2, reg_params=[0.01], max_iters=[4])
    training.save_model(cv, f"{scratch}/best")
    loaded = training.load_model(f"{scratch}/best")
    want = training.evaluate(cv, texts)
    assert training.evaluate(cv, training.term_counts(texts)) == want and training.evaluate(loaded, texts) == want


def test_blocks_hold_every_row_once(monkeypatch):
    """Blocks end at their limits, keep folds apart, and give the products of the plain matrix."""
    monkeypatch.setattr(multifit, "BLOCK_ROWS", 7)
    monkeypatch.setattr(multifit, "BLOCK_ENTRIES", 40)
    rng = np.random.default_rng(0)
    plain = rng.integers(0, 4, (50, 12)) * rng.integers(0, 2, (50, 12)) + 300 * (rng.random((50, 12)) < 0.02)
    plain[7] = 0
    vectors = [{"type": 0, "size": 12, "indices": np.flatnonzero(x).tolist(), "values": x[x > 0].astype(float).tolist()} for x in plain]
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    batches = [pa.RecordBatch.from_arrays([pa.array(vectors[a:a + 20], kind), pa.array([i % 3 for i in range(50)][a:a + 20], pa.int32()),
                                           pa.array([1.0 + i for i in range(50)][a:a + 20]), pa.array([i % 2 for i in range(50)][a:a + 20], pa.int32())],
                                          ["counts", "sentiment", "classWeight", "fold"]) for a in (0, 20, 40)]
    made = [multifit.pickle.loads(b.column(0)[0].as_py()) for b in multifit.blocks(iter(batches), 12)]
    assert sorted(w for b in made for w in b.weights) == [1.0 + i for i in range(50)]
    assert max(len(b.labels) for b in made) <= 7 and max(int((plain[(b.weights - 1).astype(int)] > 0).sum()) for b in made) <= 40
    dense = rng.standard_normal((12, 5))
    for b in made:
        of = (b.weights - 1).astype(int)
        assert set(of % 2) == {b.fold} and (b.labels == of % 3).all()
        assert b.margins(dense) == pytest.approx(plain[of] @ dense)
        other = rng.standard_normal((len(of), 3))
        assert b.by_features(other) == pytest.approx(plain[of].T @ other)
        seen = b.seen()
        assert seen.features == pytest.approx(np.stack([(plain[of] > 0).sum(0), b.weights @ plain[of], b.weights @ plain[of] ** 2]))
        assert seen.rows == len(of) and seen.labels.sum() == pytest.approx(b.weights.sum())
