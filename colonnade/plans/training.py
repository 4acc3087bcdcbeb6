"""Train, tune, rank and check models on fixed folds.

Every fit, score and metric is a Spark job over the whole fold; some candidates are fitted at the same time, so one's
small jobs fill the cores that another's leave. A candidate that fails is recorded and the rest go on. A run has a
deadline that every stage reads: what begins later is listed as `not_tried`.
"""

from __future__ import annotations

import itertools
import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.functions.storage import stored
from colonnade.operators import catalog, classification, diagnosis, models, regression, suitability
from colonnade.operators import target as targets
from colonnade.operators.split import TEST, TRAIN, VALIDATION, check_folds
from colonnade.plans.prepare import Prepared, prepare
from colonnade.settings import DEFAULTS, Settings

# Seconds allowed per training mode.
TIME_LIMITS = {"quick": 60, "standard": 300, "extended": 900}

LEADERBOARD_SCHEMA = (
    "run_id string, model_id string, model_name string, engine string, problem_type string, status string, "
    "error string, is_naive_baseline boolean, primary_metric string, validation_score double, train_score double, "
    "test_score double, validation_metrics map<string,double>, train_metrics map<string,double>, "
    "test_metrics map<string,double>, training_time_seconds double, tuning_round int, tuning_stage string"
)
HISTORY_SCHEMA = "round int, stage string, best_score double, target_achieved boolean, total_models int"


class TrainingError(ValueError):
    pass


def fold_metrics(
    predictions: DataFrame, problem_type: str, labels: list[str] | None, by: list[str],
    settings: Settings = DEFAULTS, rows: int | None = None, has_probs: bool = True,
) -> DataFrame:
    """`(by, metrics map)` with the metrics of the problem type."""
    if not labels:
        found = regression.regression_metrics(predictions, by, settings, rows, zero_tolerance=1e-8)
        names = {"mae": "mae", "rmse": "rmse", "r2": "r2", "mape": "mape"}
    else:
        binary = problem_type == targets.BINARY
        counts = classification.outcome_counts(predictions, by)
        found = classification.summary_metrics(counts, by, binary)
        suffix = "" if binary else "_macro"
        names = {"accuracy": "accuracy", "balanced_accuracy": "balanced_accuracy"}
        names |= {f"{m}{suffix}": m for m in ("f1", "precision", "recall")}
        if has_probs:
            if binary:
                scored = predictions.select(
                    *by, F.col("probs")[1].alias("score"), (F.col("label") == 1).cast("int").alias("is_positive"))
                area = classification.auc(classification.score_table(scored, by, settings, rows), by).drop("pr_auc")
            else:
                area = classification.multiclass_auc(predictions, by, labels, settings, rows)
            found = cells.join_by(found, area, by)
            names["roc_auc"] = "roc_auc"
    entries = F.map_from_arrays(
        F.array(*[F.lit(k) for k in names]), F.array(*[F.col(c).cast("double") for c in names.values()])
    )
    return found.select(*by, F.map_filter(entries, lambda _, v: v.isNotNull()).alias("metrics"))


@dataclass
class Run:
    """One training run: folds with features, fitted models, leaderboard rows, tuning history."""

    run_id: str
    prepared: Prepared
    table: DataFrame
    rows: dict[str, int]
    problem_type: str
    primary_metric: str
    labels: list[str] | None
    settings: Settings
    models: dict[str, object] = field(default_factory=dict)
    members: dict[str, list[str]] = field(default_factory=dict)
    entries: list[dict] = field(default_factory=list)
    history: list[tuple] = field(default_factory=list)
    deadline: float = math.inf  # on the clock of time.monotonic()

    def out_of_time(self) -> bool:
        return time.monotonic() > self.deadline

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession

    def fold(self, *names: str) -> DataFrame:
        return self.table.filter(F.col("fold").isin(*names))

    def predictions(self, model_id: str, *folds: str) -> DataFrame:
        """Keys, fold, label, prediction, probs, y_true, y_pred of one model on the given folds."""
        keep = [*self.prepared.keys, "fold"]
        if model_id in self.members:
            parts = [self.predictions(m, *folds) for m in self.members[model_id]]
            return models.blend(parts, self.prepared.keys, keep, self.labels)
        return models.score(self.models[model_id], self.fold(*folds), keep, self.labels)

    def metrics(self, model_id: str, *folds: str) -> dict[str, dict[str, float]]:
        scored = self.predictions(model_id, *folds).drop(*self.prepared.keys)
        has_probs = bool(self.labels) and (
            model_id in self.members or not isinstance(self.models[model_id], models.NaiveBaselineModel))
        rows = sum(self.rows[f] for f in folds)
        if has_probs or not self.labels:
            scored = stored(scored, "scored")  # the metrics take several passes; a model scores every row once
        out = fold_metrics(scored, self.problem_type, self.labels, ["fold"], self.settings, rows, has_probs).collect()
        return {r["fold"]: r["metrics"] for r in out}

    def leaderboard(self) -> DataFrame:
        """Ranked models with gap and diagnosis."""
        names = [c.split()[0] for c in LEADERBOARD_SCHEMA.split(", ")]
        rows = [tuple(e.get(n) for n in names) for e in self.entries]
        table = self.spark.createDataFrame(rows, LEADERBOARD_SCHEMA)
        return diagnosis.rank_models(diagnosis.fit_diagnosis(diagnosis.with_naive_score(table)))

    def winner(self) -> dict:
        row = self.leaderboard().filter("is_winner").first()
        if row is None:
            raise TrainingError("no model could be trained: " + "; ".join(str(e.get("error")) for e in self.entries))
        return row.asDict()

    def tuning_history(self) -> DataFrame:
        return self.spark.createDataFrame(self.history, HISTORY_SCHEMA)

    def summary(self) -> DataFrame:
        return diagnosis.run_summary(self.leaderboard())

    def best(self) -> dict | None:
        scored = [e for e in self.entries if e["status"] == "success" and e.get("validation_score") is not None]
        if not scored:
            return None
        sign = 1 if diagnosis.is_higher_better(self.primary_metric) else -1
        return max(scored, key=lambda e: sign * e["validation_score"])

    def achieved(self) -> bool:
        """Whether the best model reaches the target score; R2 stands in for error metrics."""
        best = self.best()
        if best is None:
            return False
        if diagnosis.is_higher_better(self.primary_metric):
            return best["validation_score"] >= self.settings.target_score
        return best["validation_metrics"].get("r2", 0.0) >= self.settings.target_score

    def pipeline(self, model_id: str) -> PipelineModel:
        """Preparation and model as one pipeline, for saving and for scoring new tables."""
        return PipelineModel(stages=[self.prepared.pipeline, self.models[model_id]])


def start_run(
    df: DataFrame, target: str, keys: list[str], problem_type: str, primary_metric: str = "auto",
    run_id: str | None = None, settings: Settings = DEFAULTS, **options,
) -> Run:
    """Check suitability, prepare the folds and store the feature table that all fits read."""
    spark = df.sparkSession
    features = options.get("selected") or [c for c in df.columns if c not in [target, *keys]]
    given = [c for c in catalog.profiled_columns(df) if c != target and c not in keys]
    # checks, audit and split read the columns of the run many times, and df may be a query
    df = stored(df.select(*[cells.quoted(c) for c in dict.fromkeys([*keys, *features, target])]), "source")
    findings = suitability.training_suitability(df, target, problem_type, features)
    blocked = findings.filter("severity = 'blocking'").collect()
    if blocked:
        raise TrainingError("; ".join(f"{r['code']} {r['detail']}" for r in blocked))
    prepared = replace(prepare(df, target, keys, problem_type, settings=settings, **options), candidates=given)
    table = prepared.transformed()
    labels = None
    low = None
    if targets.is_classification(problem_type):
        named = table.withColumn(target, cells.quoted(target).cast("string"))
        indexer = models.label_indexer(target).fit(named)
        labels = list(indexer.labels)
        table = indexer.transform(named)
        low = targets.class_balance(df, target).agg(F.min("percentage")).first()[0]
    else:
        table = table.withColumn("label", models.regression_label(table, target))
    # as many sorted parts as there are cores, so that every fit of a small table uses them and reads rows in one order
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = [cells.quoted(k) for k in keys]
    table = stored(table.select(*own, "fold", "label", "features").repartition(parts, *own).sortWithinPartitions(*own), "prepared")
    rows = {r["fold"]: r["n"] for r in check_folds(table).collect()}
    repeated = sum(rows.values()) - table.select(*keys).distinct().count()
    if repeated:
        raise TrainingError(f"{repeated} rows repeat the key of another row; keys must identify rows")
    metric = diagnosis.default_metric(problem_type, low) if primary_metric == "auto" else primary_metric
    run_id = run_id or time.strftime("run_%Y%m%d_%H%M%S")
    return Run(run_id, prepared, table, rows, problem_type, metric, labels, settings)


def _entered(run: Run, candidate: models.Candidate) -> dict:
    """A new row of the leaderboard, not tried yet."""
    entry = {
        "run_id": run.run_id, "model_id": f"model_{len(run.entries) + 1:02d}", "model_name": candidate.name,
        "engine": candidate.engine, "problem_type": run.problem_type, "is_naive_baseline": candidate.naive,
        "primary_metric": run.primary_metric, "tuning_round": candidate.round, "tuning_stage": candidate.stage,
        "status": "not_tried", "error": None, "training_time_seconds": 0.0,
    }
    run.entries.append(entry)
    return entry


def _fit(run: Run, candidate: models.Candidate, entry: dict) -> None:
    began = time.perf_counter()
    try:
        run.models[entry["model_id"]] = candidate.build().fit(run.fold(TRAIN))
        entry["training_time_seconds"] = round(time.perf_counter() - began, 3)
        _add_scores(run, entry)
    except Exception as e:  # a learner that cannot fit must not end the run
        entry.update(status="failed", error=str(e))
        entry["training_time_seconds"] = entry["training_time_seconds"] or round(time.perf_counter() - began, 3)


def at_once(run: Run, tasks: list, pool: str) -> None:
    """Calls the functions, some at the same time, each in a scheduler pool of its own (shared fairly where Spark is told to)."""
    def call(task, name):
        run.spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            task()
        finally:
            run.spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, run.settings.parallel_fits)) as workers:
        for done in [workers.submit(inheritable_thread_target(run.spark)(call), t, f"{pool}-{i}") for i, t in enumerate(tasks)]:
            done.result()


def try_candidates(run: Run, candidates: list[models.Candidate], needed: int = 0) -> list[dict]:
    """Fit on the training fold, score validation and training folds; a failure becomes a row.

    Candidates behind the first `needed` are left out once the run is out of time.
    """
    entries = [_entered(run, c) for c in candidates]

    def task(i):
        return lambda: None if i >= needed and run.out_of_time() else _fit(run, candidates[i], entries[i])

    at_once(run, [task(i) for i in range(len(candidates))], "candidates")
    return entries


def try_candidate(run: Run, candidate: models.Candidate) -> dict:
    return try_candidates(run, [candidate], 1)[0]


def _add_scores(run: Run, entry: dict) -> None:
    found = run.metrics(entry["model_id"], TRAIN, VALIDATION)
    entry.update(
        validation_metrics=found[VALIDATION], train_metrics=found[TRAIN], status="success",
        validation_score=found[VALIDATION].get(run.primary_metric), train_score=found[TRAIN].get(run.primary_metric),
    )


def _note(run: Run, number: int, stage: str) -> None:
    best = run.best()
    score = None if best is None else round(float(best["validation_score"]), 4)
    run.history.append((number, stage, score, run.achieved(), len(run.entries)))


def add_blend(run: Run, top: int = 3) -> dict | None:
    """Blend of the best two or three models; the fitted members are reused."""
    up = diagnosis.is_higher_better(run.primary_metric)
    pool = [e for e in run.entries
            if e["status"] == "success" and not e["is_naive_baseline"] and e.get("validation_score") is not None]
    pool.sort(key=lambda e: -e["validation_score"] if up else e["validation_score"])
    if len(pool) < 2:
        return None
    entry = {
        "run_id": run.run_id, "model_id": "model_blend", "model_name": "blend of the best", "engine": "ensemble_blend",
        "problem_type": run.problem_type, "is_naive_baseline": False, "primary_metric": run.primary_metric,
        "tuning_round": 3, "tuning_stage": "blend", "status": "failed", "error": None,
    }
    run.members["model_blend"] = [e["model_id"] for e in pool[:top]]
    began = time.perf_counter()
    try:
        _add_scores(run, entry)
    except Exception as e:
        entry["error"] = str(e)
    entry["training_time_seconds"] = round(time.perf_counter() - began, 3)
    run.entries.append(entry)
    return entry


def tune(run: Run) -> DataFrame:
    """Rounds towards the target score: as trained, tuned trees, blend. Stops when it is reached."""
    _note(run, 1, "first models")
    if run.achieved():
        return run.tuning_history()
    try_candidates(run, models.second_round(run.problem_type, len(run.labels or []), run.settings))
    _note(run, 2, "tuned trees")
    if run.achieved():
        return run.tuning_history()
    add_blend(run)
    _note(run, 3, "blend")
    return run.tuning_history()


def _score_on_part(run: Run, candidate: models.Candidate, part: DataFrame) -> float | None:
    """The validation score of a fit on a part of the training fold; none if it fails."""
    try:
        model = candidate.build().fit(part)
        scored = stored(models.score(model, run.fold(VALIDATION), ["fold"], run.labels), "scored")
        found = fold_metrics(scored, run.problem_type, run.labels, ["fold"], run.settings, run.rows[VALIDATION]).first()
        return found["metrics"].get(run.primary_metric)
    except Exception:  # the fit on the whole fold, or its absence, is what the leaderboard shows
        return None


def search(run: Run, grids: dict[str, tuple], seconds: float) -> list[dict]:
    """Successive halving over all parameter combinations; returns those fitted on the whole training fold.

    `grids` maps a name to (estimator class, {param: values}). Combinations are first fitted on growing parts of the
    training fold, each part holding the one before (rows are chosen by the hash of their key), and the better half goes
    on. All combinations stay on the leaderboard: those sorted out as `eliminated` with part and score, those that the
    time does not reach as `not_tried`. The clock is read before each fit.
    """
    deadline = min(run.deadline, time.monotonic() + seconds)
    late = lambda: time.monotonic() > deadline
    combinations = []
    for name, (build, grid) in grids.items():
        for values in itertools.product(*grid.values()):
            params = dict(zip(grid, values))
            label = f"{name} " + " ".join(f"{k}={v}" for k, v in params.items())
            candidate = models.Candidate(label, "search", lambda b=build, p=params: b(**p), stage="search", params=params)
            combinations.append((candidate, _entered(run, candidate)))
    sign = 1 if diagnosis.is_higher_better(run.primary_metric) else -1
    place = F.conv(F.substring(cells.hash_order(run.prepared.keys, f"{run.settings.seed}-search"), 1, 13), 16, 10).cast("bigint") / F.lit(float(16 ** 13))
    left = combinations
    for size in sorted(run.settings.search_rungs):
        if len(left) < 2 or run.rows[TRAIN] * size < run.settings.search_rows:
            continue
        part, scores = run.fold(TRAIN).filter(place < size), {}

        def task(i, part=part, scores=scores):
            if not late():
                scores[i] = _score_on_part(run, left[i][0], part)  # noqa: B023

        at_once(run, [lambda i=i: task(i) for i in range(len(left))], "search")
        order = sorted((i for i in scores if scores[i] is not None), key=lambda i: -sign * scores[i])
        going = set(order[:math.ceil(len(left) / 2)])
        for i in scores.keys() - going:
            left[i][1].update(status="eliminated", error=f"sorted out on {size:g} of the training rows, {run.primary_metric} {scores[i]}")
        left = [c for i, c in enumerate(left) if i in going]
    at_once(run, [lambda c=c, e=e: None if late() else _fit(run, c, e) for c, e in left], "search")
    return [e for _, e in combinations if e["status"] in ("success", "failed")]


def check_on_test(run: Run) -> dict:
    """Score the winner and the naive baseline on the test fold; nobody else sees it."""
    winner = run.winner()
    naive = [e["model_id"] for e in run.entries if e["is_naive_baseline"] and e["status"] == "success"]
    for model_id in dict.fromkeys([winner["model_id"], *naive]):
        entry = next(e for e in run.entries if e["model_id"] == model_id)
        found = run.metrics(model_id, TEST)[TEST]
        entry.update(test_metrics=found, test_score=found.get(run.primary_metric))
    return run.winner()


def train(
    df: DataFrame, target: str, keys: list[str], problem_type: str, mode: str = "quick", tuning: bool = True,
    grids: dict[str, tuple] | None = None, settings: Settings = DEFAULTS, **options,
) -> Run:
    """A whole run: first round, search, tuning rounds, ranking, held-out check.

    The search takes `grids`, or `models.search_grids` where none are given; an empty dictionary leaves it out. No fit
    begins later than the mode's seconds after the start, but for the first round's, which are fitted at once. The blend
    of fitted models and the check of the winner on the test fold follow in any case.
    """
    limit, began = TIME_LIMITS[mode], time.monotonic()
    run = start_run(df, target, keys, problem_type, settings=settings, **options)
    run.deadline = began + limit
    first = models.first_round(problem_type, run.rows[TRAIN], len(run.labels or []), settings)
    try_candidates(run, first, len(first))
    grids = models.search_grids(problem_type, settings) if grids is None else grids
    if grids:
        search(run, grids, min(max(limit / 3, 15), 120))
    if tuning:
        tune(run)
    check_on_test(run)
    run.deadline = math.inf  # what the caller tries later has time of its own
    return run
