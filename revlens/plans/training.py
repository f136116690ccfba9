"""Model training and selection with MLlib.

Feature extraction (Tokenizer, StopWordsRemover, HashingTF, IDF) and both
classifiers are MLlib estimators: distributed, JVM-side, and persisted as
one ``PipelineModel`` that batch and stream scoring load alike. The many
fits of a cross-validation share their passes over the rows (``multifit``).
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, NaiveBayes
from pyspark.ml.common import _py2java
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, StopWordsRemover, Tokenizer
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.hashing import unit_hash
from revlens.functions.text import NEGATIONS
from revlens.operators import prep
from revlens.plans import multifit
from revlens.session import checkpoint_dir
from revlens.sources.commits import Files

# Model configuration.
NUM_FEATURES = 20000
MIN_DOC_FREQ = 5
LR_PARAMS = {"maxIter": 20, "regParam": 0.01, "elasticNetParam": 0.0, "family": "multinomial"}
CV_REG_PARAMS = [0.001, 0.01, 0.1]
CV_MAX_ITERS = [20, 50]
CV_FOLDS = 3
CV_PARALLELISM = 6   # grid points judged at a time
# Written term counts that the jobs of a round may read at a time; in memory they are some three times as large.
KEPT_BYTES = 4 * 1024 ** 3
PART_BYTES = 64 * 1024 ** 2   # written term counts in a part of the blocks
NB_SMOOTHING = 1.0
SEED = 42


def model_stopwords() -> list[str]:
    """Spark's English list without the negations the cleaning step keeps."""
    keep = set(NEGATIONS) | {"cannot"}
    return [w for w in StopWordsRemover.loadDefaultStopWords("english") if w not in keep]


def tfidf_stages(num_features: int = NUM_FEATURES, min_doc_freq: int = MIN_DOC_FREQ) -> list:
    """M1: cleaned text -> tokens -> filtered -> hashed term counts -> TF-IDF features."""
    return [Tokenizer(inputCol="cleaned", outputCol="tokens"),
            StopWordsRemover(inputCol="tokens", outputCol="filtered", stopWords=model_stopwords()),
            HashingTF(inputCol="filtered", outputCol="rawFeatures", numFeatures=num_features),
            IDF(inputCol="rawFeatures", outputCol="features", minDocFreq=min_doc_freq)]


def term_counts(df: DataFrame) -> DataFrame:
    """The rows with their hashed term counts (``rawFeatures``) in place of the text, written once to the shared folder.

    The counts do not depend on what is fitted: folds, refits and both classifiers read them instead of the texts.
    """
    if "rawFeatures" in df.columns:
        return df
    return written(PipelineModel(tfidf_stages()[:-1]).transform(df).drop("cleaned", "tokens", "filtered"), "term-counts")


def written(df: DataFrame, name: str) -> DataFrame:
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fit_on_counts(counts: DataFrame, classifier) -> PipelineModel:
    """IDF and a classifier fitted on ``term_counts``, as a pipeline that takes texts."""
    *counting, idf = tfidf_stages()
    weights = idf.fit(counts)
    return PipelineModel([*counting, weights, classifier.fit(weights.transform(counts))])


def logreg(**overrides) -> LogisticRegression:
    """M2: weighted multinomial logistic regression."""
    params = dict(LR_PARAMS, **overrides)
    return LogisticRegression(featuresCol="features", labelCol="sentiment", weightCol="classWeight", **params)


def naive_bayes() -> NaiveBayes:
    """M4: multinomial naive Bayes."""
    return NaiveBayes(featuresCol="features", labelCol="sentiment", smoothing=NB_SMOOTHING,
                      modelType="multinomial")


def evaluator(metric: str = "f1") -> MulticlassClassificationEvaluator:
    """Spark's ``f1`` is the support-weighted F1."""
    return MulticlassClassificationEvaluator(labelCol="sentiment", predictionCol="prediction", metricName=metric)


def fit_logreg(train: DataFrame, **overrides) -> PipelineModel:
    if "rawFeatures" in train.columns:
        return fit_on_counts(train, logreg(**overrides))
    return Pipeline(stages=tfidf_stages() + [logreg(**overrides)]).fit(train)


def fit_naive_bayes(train: DataFrame) -> PipelineModel:
    if "rawFeatures" in train.columns:
        return fit_on_counts(train, naive_bayes())
    return Pipeline(stages=tfidf_stages() + [naive_bayes()]).fit(train)


def with_folds(df: DataFrame, folds: int = CV_FOLDS, key_col: str = "Id") -> DataFrame:
    """``fold`` 0 .. folds - 1 from a seeded hash of the id, independent of the split and of undersampling."""
    return df.withColumn("fold", F.floor(unit_hash(key_col, SEED, "fold") * folds).cast("int"))


@dataclass
class CrossValidated:
    """Result of ``cross_validate``: mean held-out F1 of each grid point, and the pipeline refitted with the best."""
    params: list[dict]
    avgMetrics: list[float]
    best: dict
    bestModel: PipelineModel


def cross_validate(train: DataFrame, folds: int = CV_FOLDS, reg_params=None, max_iters=None,
                   key_col: str = "Id", parallelism: int = CV_PARALLELISM) -> CrossValidated:
    """M3: grid over regParam x maxIter, k folds, weighted F1, seed 42.

    Folds come from a seeded hash of the review id rather than a per-partition
    random sampler, so the same rows land in the same fold on any cluster and
    after a recomputed partition. Texts are counted once for all folds (``train`` may be ``term_counts`` already). All fits
    share the passes over the counts (``multifit``): every fold with every grid point, its IDF weights from its training rows
    alone, and the refits of all rows from which the best is taken. Up to ``parallelism`` grid points are judged at a time.
    The first of equal grid points wins.
    """
    train = term_counts(train)
    grid = [{"regParam": r, "maxIter": m} for r in reg_params or CV_REG_PARAMS for m in max_iters or CV_MAX_ITERS]
    data = with_folds(train, folds, key_col)
    with multifit.Rows(data, parts_of(train)) as rows:
        regs, ends = (sorted({point[name] for point in grid}) for name in ("regParam", "maxIter"))
        seen = {fold: rows.seen_without(fold) for fold in (*range(folds), None)}
        fits = {(fold, reg): multifit.task(s, multifit.idf(s, MIN_DOC_FREQ), reg, fold) for fold, s in seen.items() for reg in regs}
        points = rows.fit(fits, ends, logreg().getTol())
        fitted = lambda fold, point: (fits[fold, point["regParam"]], points[(fold, point["regParam"]), point["maxIter"]])
        models = {(fold, at): fitted(fold, point) for fold in range(folds) for at, point in enumerate(grid)}
        judged = written(rows.predictions(models, range(len(grid))), "held-out")
    f1_of = inheritable_thread_target(train.sparkSession)(lambda at: sum(metrics_of(
        judged.filter(F.col("fold") == fold).select("sentiment", F.col(f"p{at}").alias("prediction")))["f1"] / folds
        for fold in range(folds)))
    with ThreadPool(min(fits_at_a_time(train, parallelism), len(grid))) as pool:
        means = pool.map(f1_of, range(len(grid)))
    best = grid[max(range(len(grid)), key=lambda at: (means[at], -at))]
    fit, point = fitted(None, best)
    return CrossValidated(grid, means, best, pipeline_from(train, logreg(**best), *fit.solution(point)))


def pipeline_from(counts: DataFrame, classifier: LogisticRegression, coefficients, intercepts) -> PipelineModel:
    """The pipeline that ``classifier`` fitted on ``term_counts`` gives, from its coefficients."""
    *counting, idf = tfidf_stages()
    context = counts.sparkSession.sparkContext
    model = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        classifier.uid, _py2java(context, DenseMatrix(*coefficients.shape, coefficients.ravel(order="F"))),
        _py2java(context, DenseVector(intercepts)), len(intercepts), True)
    return PipelineModel([*counting, idf.fit(counts), classifier._copyValues(LogisticRegressionModel(model))])


def fits_at_a_time(counts: DataFrame, most: int) -> int:
    """As many fits as keep their copies of written ``term_counts`` within ``KEPT_BYTES``; one at least."""
    return max(1, min(most, KEPT_BYTES // max(1, written_bytes(counts))))


def written_bytes(counts: DataFrame) -> int:
    files = Files(counts.sparkSession)
    return sum(files.at(f)[0].getFileStatus(files.at(f)[1]).getLen() for f in counts.inputFiles())


def parts_of(counts: DataFrame) -> int:
    """Parts of the blocks: one a core at least, then by the size of written ``counts``."""
    return max(counts.sparkSession.sparkContext.defaultParallelism, written_bytes(counts) // PART_BYTES)


def evaluate(model, df: DataFrame) -> dict:
    """Weighted F1, accuracy, weighted precision and recall of ``model`` on ``df``.

    All four come from one aggregate over the predictions (the 3x3 confusion
    counts); they equal MLlib's evaluator metrics (checked in the tests),
    which would need one pass each. ``df`` may be ``term_counts``.
    """
    model = pipeline_of(model)
    if "rawFeatures" in df.columns:
        counted = next(i for i, stage in enumerate(model.stages) if isinstance(stage, HashingTF))
        model = PipelineModel(model.stages[counted + 1:])
    return metrics_of(model.transform(df))


def metrics_of(scored: DataFrame) -> dict:
    from revlens.operators.evaluation import model_metrics
    preds = scored.select("sentiment", "prediction")
    m = model_metrics(preds, "sentiment", "prediction", decimals=None).first()
    return {"f1": m["f1_weighted"], "accuracy": m["accuracy"],
            "weightedPrecision": m["weighted_precision"], "weightedRecall": m["weighted_recall"]}


def pipeline_of(model) -> PipelineModel:
    """The plain pipeline inside a cross-validated model, or the model itself."""
    return model.bestModel if isinstance(model, CrossValidated) else model


def select_best(candidates: dict) -> tuple[str, object, float]:
    """M5: highest validation F1; a tie goes to logistic regression."""
    order = sorted(candidates.items(), key=lambda kv: (-kv[1][1], kv[0] != "LogisticRegression"))
    name, (model, f1) = order[0]
    return name, model, f1


def save_model(model, path: str) -> None:
    """Persist the selected pipeline (works for CV and plain models)."""
    pipeline_of(model).write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def training_tables(split_df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Balanced, weighted train set (L8, P8, J1) plus the usable val and test sets."""
    train = split_df.filter(F.col("split") == "train")
    balanced = prep.with_class_weight(prep.drop_unusable(prep.undersample_majority(train)))
    val = prep.drop_unusable(split_df.filter(F.col("split") == "val"))
    test = prep.drop_unusable(split_df.filter(F.col("split") == "test"))
    return balanced, val, test


def train(split_df: DataFrame, use_cv: bool = True, cv_kwargs: dict | None = None) -> dict:
    """Fit logistic regression (optionally cross-validated) and naive Bayes,
    pick the better on validation F1, and report test metrics.

    Returns the chosen model and a metadata row (S13 shape).
    """
    balanced, val, test = training_tables(split_df)
    counts, val, test = (term_counts(rows) for rows in (balanced, val, test))
    lr_model = cross_validate(counts, **(cv_kwargs or {})) if use_cv else fit_logreg(counts)
    nb_model = fit_naive_bayes(counts)
    f1_lr = evaluate(lr_model, val)["f1"]
    f1_nb = evaluate(nb_model, val)["f1"]
    name, best, f1 = select_best({"LogisticRegression": (lr_model, f1_lr), "NaiveBayes": (nb_model, f1_nb)})
    test_metrics = evaluate(best, test)
    meta = {"model_type": name, "f1_val": f1, "f1_lr": f1_lr, "f1_nb": f1_nb,
            "trained_on": _dt.datetime.now(_dt.timezone.utc).isoformat(),
            "num_features": NUM_FEATURES,
            "train_size": split_df.filter(F.col("split") == "train").count(),
            "balanced_size": counts.count(),
            "f1_test": test_metrics["f1"], "acc_test": test_metrics["accuracy"],
            "precision_test": test_metrics["weightedPrecision"],
            "recall_test": test_metrics["weightedRecall"]}
    return {"model": pipeline_of(best), "name": name, "metadata": meta}


def metadata_frame(spark: SparkSession, meta: dict) -> DataFrame:
    """One-row metadata DataFrame in the fixed schema."""
    from revlens.schemas import MODEL_METADATA
    row = tuple(meta.get(f.name) for f in MODEL_METADATA.fields)
    return spark.createDataFrame([row], MODEL_METADATA)
