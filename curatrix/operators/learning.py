"""Fitting, selecting and scoring (N1 to N11, E5): boosted trees of ``boosting``, linear models of Spark ML."""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import cut, fresh_folder
from ..sources.tables import append_registry, read_registry
from .boosting import MANY_TREES, Boosting, Ensemble, Fit, Run, fit_boosted, fit_side_by_side, score_boosted
from .calibration import apply_isotonic, conformal_pvalues, ensemble_oof, fit_isotonic, nonconformity, prediction_sets, uncertainty
from .joins import union_all
from .metrics import best_threshold, binary_metrics, ranking
from .profiling import binary_violations, select_best, validate_binary
from .splits import class_weights, holdout_guard, stratified_folds, stratified_holdout

#: The seed of trials, and the settings of an increment's rounds.
SEED, MORE_ROUNDS, MORE_PATIENCE, HELD = 42, 1000, 50, 0.1


def guard_classes(df: DataFrame, label: str) -> None:
    """Training needs both classes."""
    if binary_violations(df, label).first().n_classes < 2:
        raise ValueError(f"{label} has fewer than two classes")


def _prepared(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    assembled = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)
    weights = class_weights(df, label).select(F.col(label).alias("__l"), "weight")
    return assembled.join(F.broadcast(weights), F.col(label) == F.col("__l")).withColumn("label", F.col(label).cast("double")).drop("__l")  # two rows


def fit_endpoint(df: DataFrame, features: Sequence[str], label: str, kind: str = "trees", validation: str | None = None, going: Callable[[], bool] = lambda: True, **settings) -> PipelineModel | Ensemble:
    """Balanced boosted trees, or a linear model (N1). ``validation``: a boolean column of rows that choose the
    boosting's best round. ``settings`` are those of ``Boosting`` or of the linear learner."""
    if kind != "linear":
        return fit_boosted(df, features, label, Boosting(**settings), validation, going=going).ensemble
    guard_classes(df, label)
    rows = _prepared(df.where(F.col(label).isNotNull()), features, label)
    learner = LogisticRegression(weightCol="weight", **{"maxIter": 50, "regParam": 0.01} | settings)
    return PipelineModel([VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), learner.fit(rows)])


def score(model: PipelineModel | Ensemble, df: DataFrame, out: str = "score", valid=None) -> DataFrame:
    """Adds the probability of class 1; null, never 0, for rows that aren't ``valid`` (E5)."""
    if isinstance(model, Ensemble):
        return score_boosted(model, df, out, valid)
    probability = vector_to_array("probability")[1]
    scored = model.transform(df).withColumn(out, probability if valid is None else F.when(valid, probability))
    return scored.select(*df.columns, out)


def score_batch(df: DataFrame, row_id: str, models: dict[str, PipelineModel], valid) -> DataFrame:
    """Long table ``row_id, endpoint, score`` of several models."""
    parts = [score(m, df, valid=valid).select(row_id, F.lit(name).alias("endpoint"), "score") for name, m in models.items()]
    return union_all(*parts)


def wide_scores(long: DataFrame, row_id: str, endpoints: Sequence[str]) -> DataFrame:
    """One column per endpoint (E5)."""
    return long.groupBy(row_id).pivot("endpoint", list(endpoints)).agg(F.first("score"))


def trial_table(grid: dict[str, Sequence], baseline: dict, most: int | None = None, seed: int = SEED) -> list[dict]:
    """The baseline, then the product of the dimensions in a seeded order; all of them, or at most ``most`` in all."""
    names = list(grid)
    rest = [t for values in itertools.product(*grid.values()) if (t := dict(zip(names, values, strict=True))) != baseline]
    random.Random(seed).shuffle(rest)
    return [baseline, *rest][:most]


def out_of_fold(folded: DataFrame, row_id: str, features: Sequence[str], label: str, k: int, **fit) -> DataFrame:
    """``row_id, label, fold, score``: each ``fold`` scored by a model of the others."""
    parts = []
    for fold in range(k):
        model = fit_endpoint(folded.where(F.col("fold") != fold), features, label, **fit)
        parts.append(score(model, folded.where(F.col("fold") == fold)).select(row_id, label, "fold", "score"))
    return union_all(*parts)


#: A line of the log of trials.
TRIAL = "key string, settings string, status string, auc double, error string"
#: Held by whoever writes or reads a log: two writers to a folder at a time lose each other's files.
LOGGING = threading.Lock()


def trial_key(settings: dict, scope: str = "") -> str:
    """The same for the same settings, in whatever order, of the same scope."""
    return hashlib.sha256(f"{scope}\n{json.dumps(settings, sort_keys=True)}".encode()).hexdigest()


def run_trials(
    df: DataFrame, row_id: str, features: Sequence[str], label: str, trials: Sequence[dict], k: int, order, path: str | None = None, scope: str = "",
    parallel: int = 4, seconds: float | None = None, together: bool = False,
) -> DataFrame:
    """``trial, key, settings, status, auc, error`` by inner cross-validation (N4); a trial that fails is a row, not an end.

    ``parallel`` trials run at a time, each in a scheduler pool and a job group of its own; one that takes more than ``seconds``
    has its jobs cancelled and is ``timed out``. Each result is a line of the log at ``path`` as soon as it is there: a
    call with the same log and ``scope`` (a name for the rows) runs only what isn't ``ok`` yet.

    ``together``: trials of trees grow side by side, a level of all their trees a job, and are logged when all have ended; ``seconds``
    can't be told then.
    """
    if together and seconds is not None:
        raise ValueError("trials that grow together have no time limit of their own")
    spark = df.sparkSession
    sc, path, name = spark.sparkContext, path or fresh_folder(spark, "trials"), uuid.uuid4().hex[:8]
    keys = [trial_key(t, scope) for t in trials]
    with LOGGING:
        told = {r.key: tuple(r) for r in read_log(spark, path).where("status = 'ok'").where(F.col("key").isin(keys)).collect()}
    folded = cut(stratified_folds(df.where(F.col(label).isNotNull()), label, k, order))
    ended, began = {key: threading.Event() for key in keys}, {}

    def one(key: str, settings: dict, pool: int) -> tuple:
        sc.setLocalProperty("spark.scheduler.pool", f"trials-{pool}")
        sc.setJobGroup(f"{name}-{key}", f"trial {settings}", interruptOnCancel=True)
        began[key] = time.monotonic()
        line = (key, json.dumps(settings, sort_keys=True))
        try:
            found = out_of_fold(folded, row_id, features, label, k, going=lambda: not ended[key].is_set(), **settings)
            auc = ranking(found, "score", label).first().auc
            return (*line, "ok", auc, None)
        except Exception as e:  # the trial's own failure is its result
            late = ended[key].is_set()
            return (*line, "timed out" if late else "failed", None, f"more than {seconds:g} s" if late else f"{type(e).__name__}: {e}"[:500])

    todo = dict(zip(keys, trials, strict=True))
    if together:
        lines = _grown_together(folded, features, label, {key: t for key, t in todo.items() if key not in told}, k)
        if lines:
            with LOGGING:
                append_registry(spark.createDataFrame(lines, TRIAL), path)
        told |= {line[0]: line for line in lines}
        todo = {}
    with ThreadPoolExecutor(parallel) as threads:
        running = {threads.submit(inheritable_thread_target(spark)(one), key, t, i % parallel) for i, (key, t) in enumerate(todo.items()) if key not in told}
        while running:
            over, running = wait(running, timeout=1 if seconds is None else min(1, seconds / 4), return_when=FIRST_COMPLETED)
            for line in [f.result() for f in over]:
                with LOGGING:
                    append_registry(spark.createDataFrame([line], TRIAL), path)
                told[line[0]] = line
            for key, start in list(began.items()):
                if seconds is not None and key not in told and time.monotonic() - start > seconds:
                    ended[key].set()
                    sc.cancelJobGroup(f"{name}-{key}")  # again until it has ended, as it may start another
    return spark.createDataFrame([(i, *told[key]) for i, key in enumerate(keys)], f"trial int, {TRIAL}")


def _grown_together(folded: DataFrame, features: Sequence[str], label: str, todo: dict[str, dict], k: int) -> list[tuple]:
    """Lines of the log: what ``out_of_fold`` gives for each trial, of trees grown side by side."""
    lines, fits, marked = [], {}, folded
    for key, settings in todo.items():
        rest = dict(settings)
        try:
            if rest.pop("kind", "trees") != "trees":
                raise ValueError("only trees grow together")
            held = rest.pop("validation", None)
            fits[key] = [Fit(Boosting(**rest), f"__learn_{held}_{i}", held and f"__held_{held}_{i}") for i in range(k)]
        except Exception as e:  # as in ``run_trials``
            lines.append((key, json.dumps(settings, sort_keys=True), "failed", None, f"{type(e).__name__}: {e}"[:500]))
            continue
        stops = F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)
        for i, x in enumerate(fits[key]):
            if x.learn not in marked.columns:
                marked = marked.withColumn(x.learn, (F.col("fold") != i) & ~stops)
            if held and x.held not in marked.columns:
                marked = marked.withColumn(x.held, (F.col("fold") != i) & stops)
    if not fits:
        return lines
    try:
        runs = iter(fit_side_by_side(marked, features, label, [x for own in fits.values() for x in own]))
        parts = [score(next(runs).ensemble, folded.where(F.col("fold") == i)).select(F.lit(key).alias("key"), label, "score") for key, own in fits.items() for i in range(len(own))]
        auc = {r.key: r.auc for r in ranking(union_all(*parts), "score", label, ["key"]).collect()}  # a row per trial
        return lines + [(key, json.dumps(todo[key], sort_keys=True), "ok", auc.get(key), None) for key in fits]
    except Exception as e:  # as they share their jobs
        return lines + [(key, json.dumps(todo[key], sort_keys=True), "failed", None, f"{type(e).__name__}: {e}"[:500]) for key in fits]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a log of trials; none yet is an empty log."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return read_registry(spark, path, TRIAL) if there else spark.createDataFrame([], TRIAL)


def nested_cv(
    df: DataFrame, row_id: str, features: Sequence[str], label: str, trials: Sequence[dict], k_outer: int, k_inner: int, order, path: str | None = None, scope: str = "", **how
) -> DataFrame:
    """Out-of-fold scores ``row_id, label, fold, trial, score``; each outer fold selects on the others (N5). ``how``: as for
    ``run_trials``, whose log all outer folds share; with ``together`` the outer folds run side by side, too."""
    spark = df.sparkSession
    path = path or fresh_folder(spark, "trials")
    folded = cut(stratified_folds(df.where(F.col(label).isNotNull()), label, k_outer, order))

    def one(fold: int) -> DataFrame:
        inner = folded.where(F.col("fold") != fold).drop("fold")
        told = run_trials(inner, row_id, features, label, trials, k_inner, order, path, f"{scope}/{fold}", **how)
        best = select_best(told.where("status = 'ok'"), "auc", "trial").first()
        if best is None or best.trial is None:
            raise RuntimeError(f"all {len(trials)} trials failed in outer fold {fold}: see {path}")
        model = fit_endpoint(inner, features, label, **trials[best.trial])
        return score(model, folded.where(F.col("fold") == fold)).select(row_id, label, "fold", F.lit(best.trial).alias("trial"), "score")

    if not how.get("together"):
        return union_all(*[one(fold) for fold in range(k_outer)])
    with ThreadPoolExecutor(k_outer) as threads:
        running = [threads.submit(inheritable_thread_target(spark)(one), fold) for fold in range(k_outer)]
        return union_all(*[f.result() for f in running])


def fit_increment(parent: Ensemble, new: DataFrame, label: str, row_id: str, order, old: DataFrame | None = None, frac: float = HELD, many: int = MANY_TREES, **settings) -> dict:
    """Trees of the new rows on top of the parent's, which stay (N7). ``old``: rows that the parent has seen (their ``row_id``).

    A stratified part of the new rows is held out first; it chooses the best round. Returns ``run``; ``metrics`` on those held-out
    rows that the parent hasn't seen either; ``reason``, why nothing could be held out, or ''; ``n_new``, the trees added; and
    ``too_many``, whether the ensemble had better be fitted anew.
    """
    validate_binary(new, label)
    guard = holdout_guard(new, label, frac).first()
    marked = stratified_holdout(new.where(F.col(label).isNotNull()), label, frac, order) if guard.enabled else new.withColumn("holdout", F.lit(False))
    marked = cut(marked)
    s = Boosting(**{"rounds": MORE_ROUNDS, "patience": MORE_PATIENCE} | settings)
    run = fit_boosted(marked, parent.features, label, s, "holdout" if guard.enabled else None, parent)
    held = marked.where("holdout").drop("holdout")
    fair = held if old is None else held.join(old.select(row_id), row_id, "left_anti")
    n = len(run.ensemble.trees)
    return {"run": run, "metrics": ranking(score(run.ensemble, fair), "score", label), "reason": guard.reason, "n_new": n - len(parent.trees), "too_many": n >= many}


def evaluate_test_once(oof: DataFrame, test: DataFrame, row_id: str, label: str, n_seeds: int, alpha: float = 0.10) -> dict[str, DataFrame]:
    """Everything is frozen on out-of-fold scores, then the test set is read.

    ``oof``: row_id, seed, label, score. ``test``: row_id, label, score (the ensemble's). Returns
    ``metrics``, ``sets`` and ``uncertainty``.
    """
    labels = oof.groupBy(row_id).agg(F.max(label).alias(label))
    whole = ensemble_oof(oof, row_id, "score", n_seeds).where("complete").join(labels, row_id)
    model = fit_isotonic(whole, "score", label)
    calibrated = apply_isotonic(model, whole, "score")
    threshold = best_threshold(calibrated, "calibrated", label).first().f1_threshold
    known = nonconformity(calibrated, "calibrated", label)
    seen = apply_isotonic(model, test, "score")
    sets = prediction_sets(conformal_pvalues(seen, row_id, "calibrated", known), row_id, alpha)
    metrics = binary_metrics(seen, "score", label, threshold, calibrated="calibrated").withColumn("threshold", F.lit(threshold))
    return {"metrics": metrics, "sets": sets, "uncertainty": uncertainty(sets)}


def metrics_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """The one typed form in which runs report (1.12)."""
    return spark.createDataFrame(list(rows), "dataset string, model string, split string, auc double, ap double, n long")
