"""Gradient-boosted models on the feature sets: fit, evaluate, apply, save."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallyhouse.functions.exprs import clv_segment, count_rows
from tallyhouse.functions.ordered import running_sums
from tallyhouse.ml import boosting, features, forecast
from tallyhouse.session import cut_lineage

TREES, DEPTH, RATE, FOLDS, SEED, BINS = 100, 5, 0.1, 5, 42, 256
TEST_PERCENT = 20
MIN_POSITIVES = 10
#: Rows of a partition that Spark ML fits from, and rows up to which a task grows the trees of a fold by itself.
PART_ROWS, TASK_ROWS = 50_000, 500_000
#: Models trained at the same time: all nine, as a fit is many small jobs one after the other.
PARALLEL = 9


@dataclass(frozen=True)
class ModelSpec:
    name: str
    group: str
    dataset: Callable[..., DataFrame]
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    target: str
    kind: str  # "classifier" or "regressor"
    min_rows: int = 100
    identifiers: tuple[str, ...] = ()  # keys with any number of values
    strict_labels: bool = False  # an unseen category is an error instead of the first class
    cv_metric: str = "roc_auc"  # or "r2" or "mae"


MODELS = {
    m.name: m
    for m in (
        ModelSpec("conversion", "omnichannel", features.conversion,
                  ("arrival_hour", "day_of_week", "browsing_duration", "basket_size", "queue_wait_time"), ("channel",),
                  "completed", "classifier", strict_labels=True),
        ModelSpec("order_value", "omnichannel", features.order_value,
                  ("basket_size", "arrival_hour", "day_of_week", "browsing_duration", "queue_wait_time"), ("channel",),
                  "total_amount", "regressor", cv_metric="r2"),
        ModelSpec("fulfillment", "omnichannel", features.fulfillment,
                  ("order_hour", "day_of_week"), ("channel",), "fulfillment_duration", "regressor", 50, cv_metric="r2"),
        ModelSpec("stockout", "inventory", features.stockout,
                  ("quantity_before", "reorder_point", "safety_stock", "on_order_qty", "event_hour", "day_of_week"), (),
                  "stockout_occurred", "classifier"),
        ModelSpec("lead_time", "inventory", features.lead_time,
                  ("order_quantity", "day_of_week", "expected_lead_time_days"), (), "actual_lead_time_days",
                  "regressor", 50, ("supplier_id",), cv_metric="mae"),
        ModelSpec("churn", "engagement", features.churn,
                  ("days_since_last_purchase", "days_since_join", "total_spend", "purchase_count", "avg_order_value",
                   "loyalty_points", "unresponsive_count", "churn_risk_score"), ("value_tier",), "churned", "classifier"),
        ModelSpec("campaign", "engagement", features.campaign,
                  ("unresponsive_count", "days_since_last_engagement"), ("campaign_type", "value_tier", "rfm_segment"), "clicked",
                  "classifier"),
        ModelSpec("clv", "engagement", features.clv,
                  ("days_since_join", "purchase_count", "avg_order_value", "loyalty_points"), ("value_tier",), "total_spend",
                  "regressor", 50, cv_metric="mae"),
    )
}


def label_encoder(df: DataFrame, column: str) -> StringIndexerModel:
    """Labels in alphabetical order; one distributed count per label."""
    indexer = StringIndexer(
        inputCol=column, outputCol=f"{column}_index", stringOrderType="alphabetAsc", handleInvalid="keep")
    return indexer.fit(df)


def label_encode(df: DataFrame, model: StringIndexerModel) -> DataFrame:
    """Index of each label; an unseen one gets the first class."""
    out, labels = model.getOutputCol(), len(model.labels)
    encoded = model.transform(df)
    return encoded.withColumn(out, F.when(F.col(out) >= labels, 0).otherwise(F.col(out)).cast("int"))


def prepare(spec: ModelSpec, df: DataFrame) -> DataFrame:
    """Numbers as DOUBLE, categories as text, target as ``label``, and whether the row is ``complete``.

    An identifier keeps its number, or gets a negative one from 52 bits of its hash, so that the two kinds never
    meet: a label list of all keys would have to fit on the driver.
    """
    columns = [F.col(c).cast("double").alias(c) for c in spec.numeric]
    columns += [
        F.coalesce(F.expr(f"try_cast({c} AS DOUBLE)"), (F.lit(-1) - F.pmod(F.xxhash64(c), F.lit(1 << 52))).cast("double")).alias(c)
        for c in spec.identifiers
    ]
    columns += [F.col(c).cast("string").alias(c) for c in spec.categorical]
    rows = df.select(*columns, F.col(spec.target).cast("double").alias("label"))
    known = [F.col(c).isNotNull() for c in (*spec.numeric, *spec.identifiers, *spec.categorical)]
    return rows.withColumn("complete", reduce(lambda a, b: a & b, known))


def learnable(rows: DataFrame) -> DataFrame:
    """Rows to train and test on: all features and the label are known."""
    return rows.filter("complete AND label IS NOT NULL").drop("complete")


STRATUM, PLACE, SIZE = "__stratum", "__place", "__size"


def placed(spec: ModelSpec, df: DataFrame, seed: int = SEED) -> DataFrame:
    """Learnable rows with their stratum (the class; regressors have one stratum), its size, and their place (from 1) in it in an
    order of seeded hashes.

    The places are exact and no stratum is sorted in one task: the counts of the hashes' first 16 bits, summed up, say where each of
    65 536 slices begins, and only a slice is ordered. The rows are checkpointed first, so that a row keeps its hash.
    """
    rows = cut_lineage(learnable(df)).withColumns(
        {STRATUM: F.col("label") if spec.kind == "classifier" else F.lit(0.0), "__mark": F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))}
    ).withColumn("__slice", F.shiftrightunsigned("__mark", 48))
    counts = rows.groupBy(STRATUM, "__slice").agg(count_rows().alias("__n"))
    stratum = W.partitionBy(STRATUM)
    before = F.coalesce(F.sum("__n").over(stratum.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(STRATUM, "__slice", before.alias("__before"), F.sum("__n").over(stratum).alias(SIZE))
    inside = F.row_number().over(W.partitionBy(STRATUM, "__slice").orderBy("__mark"))
    return cut_lineage(rows.join(starts, [STRATUM, "__slice"]).withColumn(PLACE, F.col("__before") + inside).drop("__slice", "__mark", "__before"))


def quota(test_percent: int = TEST_PERCENT) -> str:
    """Test rows of a stratum, as SQL."""
    return f"(({SIZE} * {test_percent} + 50) DIV 100)"


def split(spec: ModelSpec, df: DataFrame, test_percent: int = TEST_PERCENT) -> tuple[DataFrame, DataFrame]:
    """Train and test rows: of each stratum exactly its share."""
    rows = placed(spec, df)
    return rows.filter(f"{PLACE} > {quota(test_percent)}"), rows.filter(f"{PLACE} <= {quota(test_percent)}")


def sampled(rows: DataFrame, most: int = 5_000) -> DataFrame:
    """At most about ``most`` placed rows (one more for each stratum), of every stratum the first in hash order; all if there are no more.
    For trials by hand: fits and cross-validations take all rows."""
    total = rows.groupBy(STRATUM).agg(count_rows().alias("n"), F.min(PLACE).alias("first")).collect()  # one row per class
    all_rows = sum(r["n"] for r in total)
    if all_rows <= most:
        return rows.coalesce(1)
    near, chosen = F.lit(False), F.lit(False)
    for r in total:
        cut = math.ceil(most * r["n"] / all_rows)
        near = near | ((F.col(STRATUM) == r[STRATUM]) & (F.col(PLACE) <= r["first"] + 2 * cut))  # a fold left out takes half the places at most
        chosen = chosen | ((F.col(STRATUM) == r[STRATUM]) & (F.col("__nth") <= cut))
    numbered = rows.filter(near).withColumn("__nth", F.row_number().over(W.partitionBy(STRATUM).orderBy(PLACE)))
    return numbered.filter(chosen).drop("__nth").coalesce(1)


def coding(spec: ModelSpec, train: DataFrame) -> list[Transformer]:
    """Label codes and features. A code enters as a plain number, so the count of distinct labels
    is not bound to the number of bins; a label the training rows lack gets the code of the first."""
    indexers, codes = [], []
    for c in spec.categorical:
        invalid = "error" if spec.strict_labels else "keep"
        indexer = StringIndexer(inputCol=c, outputCol=f"{c}_index", stringOrderType="alphabetAsc", handleInvalid=invalid)
        fitted = indexer.fit(train)
        indexers.append(fitted)
        codes.append(f"IF({c}_index >= {len(fitted.labels)}, 0D, {c}_index) AS {c}_code")
    coder = [SQLTransformer(statement=f"SELECT *, {', '.join(codes)} FROM __THIS__")] if codes else []
    inputs = [*spec.numeric, *spec.identifiers, *[f"{c}_code" for c in spec.categorical]]
    return [*indexers, *coder, VectorAssembler(inputCols=inputs, outputCol="features")]


def thresholds(rows: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Cut points of each column by the rule of ``boosting.cut_points``, from all rows and without a task that sees all values.

    The rule cuts before the first value whose middle in the running count is beyond the next even share of the rows, once in a place at
    most. So the first value beyond each share says where the cuts are, and only these values come to the driver.
    """
    n = rows.count()
    bins = min(bins, n)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.col(c).alias("value")) for k, c in enumerate(columns)]))
    counts = rows.select(pairs.alias("x")).groupBy("x.column", "x.value").agg(count_rows().alias("n"), F.lit(1).alias("one"))
    seen = cut_lineage(running_sums(counts, ["column"], ["value"], {"seen": "n", "place": "one"}))
    share = F.ceil((F.col("seen") - F.col("n") / 2) / F.lit(n / bins)) - 1  # how many shares end before the middle
    found = seen.groupBy("column", share.alias("share")).agg(F.min(F.when(F.col("place") > 1, F.col("place"))).alias("first"), F.max("place").alias("last"))
    by_column: list[list] = [[] for _ in columns]
    for r in found.collect():  # ``bins`` rows of a column at most
        by_column[r["column"]].append((r["share"], r["first"], r["last"]))
    places = [_cut_places(sorted(x), bins) for x in by_column]
    asked = [(k, p) for k, at in enumerate(places) for p in {*at, *(p - 1 for p in at)}]
    asked = rows.sparkSession.createDataFrame(asked, "column int, place long")
    value = {(r["column"], r["place"]): r["value"] for r in seen.join(F.broadcast(asked), ["column", "place"]).collect()}
    return [[(value[k, p - 1] + value[k, p]) / 2 for p in at] for k, at in enumerate(places)]


def _cut_places(shares: list[tuple[int, int | None, int]], bins: int) -> list[int]:
    """Places (from 1) of the distinct values before which a column is cut; of each share the first place but 1, and the last."""
    last = max((s[2] for s in shares), default=0)
    if last - 1 < bins:
        return list(range(2, last + 1))
    chosen, place = [], 1
    for share, first, _ in shares:
        while first is not None and len(chosen) < share and place < last:
            place = max(place + 1, first)
            chosen.append(place)
    return chosen


def binned(stages: list[Transformer], train: DataFrame) -> list[Transformer]:
    """The stages of ``coding`` with each feature replaced by the number of its bin, a plain number again."""
    *coders, assembler = stages
    columns = assembler.getInputCols()
    cuts = thresholds(reduce(lambda d, stage: stage.transform(d), coders, train), columns)
    splits = [[-math.inf, *sorted({math.nextafter(c, math.inf) for c in at or [0.0]}), math.inf] for at in cuts]  # a bin holds its upper border
    binner = Bucketizer(splitsArray=splits, inputCols=columns, outputCols=[f"{c}_bin" for c in columns])
    plain = SQLTransformer(statement=f"SELECT *, {', '.join(f'{c}_bin + 0D AS {c}_at' for c in columns)} FROM __THIS__")
    return [*coders, binner, plain, VectorAssembler(inputCols=[f"{c}_at" for c in columns], outputCol="features")]


def fit(spec: ModelSpec, train: DataFrame, trees: int = TREES, labelled: DataFrame | None = None) -> PipelineModel:
    """Label codes, features, booster. ``labelled``: the rows whose categories the model knows, if there are more than ``train`` has.

    Spark ML looks for thresholds in a sample of ``maxBins`` squared rows. Where there are more, the features are binned before by all
    rows, and the larger ``maxBins`` makes Spark ML see all rows too: the bins stay as few as they are.
    """
    stages, rows, bins = coding(spec, train if labelled is None else labelled), train.count(), BINS
    if rows > BINS * BINS:
        stages, bins = binned(stages, train), math.isqrt(rows) + 1
    learner = GBTClassifier if spec.kind == "classifier" else GBTRegressor
    booster = learner(
        featuresCol="features", labelCol="label", maxIter=trees, maxDepth=DEPTH, stepSize=RATE, seed=SEED, maxBins=bins)
    return Pipeline(stages=[*stages, booster]).fit(train)


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """So many rows in as few partitions as one fit's small jobs ask for."""
    return rows.coalesce(1) if n <= PART_ROWS else rows.repartition(-(-n // PART_ROWS))


def too_small(spec: ModelSpec, df: DataFrame) -> bool:
    return df.limit(spec.min_rows).count() < spec.min_rows


def rank_sum_auc(scored: DataFrame, score: str = "probability") -> float:
    """Probability that a positive row scores above a negative one, ties counting half, in whole numbers to the end.

    One row per distinct score after a map-side combine; the negatives below it come from sums over 65 536 slices of the score and a
    running sum inside a slice, so no task sees all scores.
    """
    counted = scored.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))
    sliced = counted.withColumn("slice", F.floor(F.col("s") * 65535))
    sums = sliced.groupBy("slice").agg(F.sum("n").alias("in_slice"))
    below = F.coalesce(F.sum("in_slice").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # at most 65 536 rows
    inside = F.coalesce(F.sum("n").over(W.partitionBy("slice").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = sliced.withColumn("inside", inside).join(sums.select("slice", below.alias("below")), "slice")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    twice = F.sum(wide("p") * (wide("below") * 2 + wide("inside") * 2 + wide("n")))
    found = rows.agg(twice.alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    return float(found["u"]) / (2.0 * found["p"] * found["n"]) if found["p"] and found["n"] else 0.0


def measures(spec: ModelSpec, model: PipelineModel, rows: DataFrame) -> dict[str, float | None]:
    """Quality figures on labelled rows."""
    return figures(spec, predict(spec, model, rows))


def figures(spec: ModelSpec, scored: DataFrame) -> dict[str, float | None]:
    """Quality figures from one pass over the scored rows (and one for the AUC)."""
    label, value = F.col("label"), F.col("prediction")
    if spec.kind == "regressor":
        error = value - label
        one = scored.agg(
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            (F.lit(1.0) - F.try_divide(F.sum(error * error), F.var_pop("label") * count_rows())).alias("r2"),
            F.avg("label").alias("mean_actual"),
            F.avg("prediction").alias("mean_predicted"),
            (F.avg(F.abs(F.try_divide(error, label))) * 100).alias("mape"),
        )
        return one.first().asDict()
    hit, said = (label == 1) & (value == 1), value == 1
    part = lambda a, b: F.coalesce(F.try_divide(F.count_if(a) * F.lit(1.0), F.count_if(b)), F.lit(0.0))
    row = scored.agg(
        F.try_divide(F.count_if(label == value) * F.lit(1.0), count_rows()).alias("accuracy"),
        part(hit, said).alias("precision"),
        part(hit, label == 1).alias("recall"),
        F.count_if(label == 1).alias("positives"),
    ).first()
    both = row["precision"] + row["recall"]
    auc = rank_sum_auc(scored) if row["positives"] > MIN_POSITIVES else 0.0
    return {"accuracy": row["accuracy"] or 0.0, "precision": row["precision"], "recall": row["recall"],
            "f1": 2 * row["precision"] * row["recall"] / both if both else 0.0, "roc_auc": auc}


def evaluate(spec: ModelSpec, model: PipelineModel, test: DataFrame) -> DataFrame:
    """Quality figures as (metric, value)."""
    found = measures(spec, model, test)
    return test.sparkSession.createDataFrame([(n, None if v is None else float(v)) for n, v in found.items()], "metric string, value double")


def cross_validate(
    spec: ModelSpec, rows: DataFrame, trees: int = TREES, folds: int = FOLDS, most: int = TASK_ROWS
) -> tuple[float, float]:
    """Mean and deviation over stratified folds of placed rows; each fold is scored by an ensemble grown on all rows of the other folds.

    Up to ``most`` rows a task grows a fold's ensemble and one pass scores all rows; more rows are fitted by Spark ML, fold by fold.
    """
    fold, n = F.pmod(F.col(PLACE), F.lit(folds)).cast("int"), rows.count()
    if n > most:
        scores = []
        for k in range(folds):  # one after the other: each takes all executors and caches its rows
            model = fit(spec, dealt(rows.filter(fold != k), n), trees, rows)
            scores.append(float(measures(spec, model, rows.filter(fold == k))[spec.cv_metric] or 0.0))
    else:
        scores = _folds_in_tasks(spec, rows, fold, trees, folds)
    mean = sum(scores) / folds
    return mean, math.sqrt(sum((x - mean) ** 2 for x in scores) / folds)


def _folds_in_tasks(spec: ModelSpec, rows: DataFrame, fold: Column, trees: int, folds: int) -> list[float]:
    coded = lambda df: reduce(lambda d, stage: stage.transform(d), stages, df).withColumn("features", vector_to_array("features"))
    stages, classes = coding(spec, rows), spec.kind == "classifier"
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != fold)
    ensembles = boosting.fit(coded(rows.withColumn("key", F.explode(others))), folds, classes, trees, DEPTH, RATE, BINS).collect()  # the trees of each fold
    scored = boosting.scored(coded(rows.withColumn("key", fold)), ensembles, trees)
    if classes:
        scored = scored.withColumn("probability", 1 / (1 + F.exp(-2 * F.col("margin")))).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
    else:
        scored = scored.withColumn("prediction", F.greatest("margin", F.lit(0.0)))
    scored = scored.cache()
    try:
        scored.count()
        with ThreadPoolExecutor(folds) as pool:
            return list(pool.map(lambda k: float(figures(spec, scored.filter(F.col("key") == k))[spec.cv_metric] or 0.0), range(folds)))
    finally:
        scored.unpersist()


@dataclass(frozen=True)
class Trained:
    """A fitted model, the rows it may be judged on, and how many rows there were of each kind."""

    spec: ModelSpec
    model: PipelineModel
    rows: DataFrame  # placed: the parts for training and testing together
    test: DataFrame
    train_samples: int
    test_samples: int
    left_out: int
    positives: int


def train(spec: ModelSpec, data: DataFrame, trees: int = TREES) -> Trained | None:
    """Fitted on all rows of the training part. None where the data set has fewer than ``min_rows`` learnable rows."""
    prepared = prepare(spec, data)
    if too_small(spec, learnable(prepared)):
        return None
    rows = placed(spec, prepared)
    sizes = rows.groupBy(STRATUM).agg(F.first(SIZE).alias("n"), F.first(F.expr(quota())).alias("test")).collect()  # one row per class
    total, test = (sum(r[c] for r in sizes) for c in ("n", "test"))
    learnt = cut_lineage(dealt(rows.filter(f"{PLACE} > {quota()}"), total - test))  # the fit's jobs, five for a tree, each carry the lineage
    model = fit(spec, learnt, trees, rows)
    left_out = prepared.filter("NOT complete OR label IS NULL").count()
    return Trained(spec, model, rows, rows.filter(f"{PLACE} <= {quota()}"), total - test, test, left_out, sum(r["n"] for r in sizes if r[STRATUM] == 1))


def report(found: Trained, trees: int = TREES, validate: bool = True) -> list[tuple[str, float | None]]:
    """All figures of a trained model: quality, counts, and the cross-validation's mean and deviation."""
    out = list(measures(found.spec, found.model, found.test).items())
    out += [("train_samples", float(found.train_samples)), ("test_samples", float(found.test_samples)), ("left_out", float(found.left_out))]
    if validate and (found.spec.kind == "regressor" or found.positives > MIN_POSITIVES):
        mean, deviation = cross_validate(found.spec, found.rows, trees)
        out += [(f"cv_{found.spec.cv_metric}_mean", mean), (f"cv_{found.spec.cv_metric}_std", deviation)]
    return out


COUNTS = ("train_samples", "test_samples", "left_out")


def in_range(metric: str, value: float | None) -> bool:
    """Whether a figure is one that its measure can take."""
    if value is None:
        return metric in ("r2", "mape")  # without variance, without a label other than 0
    if metric in ("r2", "cv_r2_mean"):
        return value <= 1
    if metric.startswith(("mae", "rmse", "mape", "mean_", "cv_mae")) or metric.endswith("_std") or metric in COUNTS:
        return value >= 0
    return 0 <= value <= 1


def predict(spec: ModelSpec, model: PipelineModel, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Predictions beside the inputs: a probability and its class, or a value that is never negative."""
    known = F.lit(True)
    if "complete" in rows.columns:  # a row that lacks a feature goes through with a stand-in and gets no prediction
        known = F.col("complete")
        stand_in = {c: F.coalesce(c, F.lit(0.0)) for c in (*spec.numeric, *spec.identifiers)}
        stand_in |= {c: F.coalesce(c, F.lit(_first_label(model, c))) for c in spec.categorical}
        rows = rows.withColumns({f"__{c}": F.col(c) for c in stand_in}).withColumns(stand_in)
    made = [f"{c}_{x}" for c in spec.categorical for x in ("index", "code", "code_bin", "code_at")]
    made += [f"{c}_{x}" for c in (*spec.numeric, *spec.identifiers) for x in ("bin", "at")]
    scored = model.transform(rows).drop("features", *made)
    if "complete" in rows.columns:
        scored = scored.withColumns({c: F.col(f"__{c}") for c in stand_in}).drop(*[f"__{c}" for c in stand_in])
    if spec.kind == "regressor":
        return scored.withColumn("prediction", F.when(known, F.greatest(F.col("prediction"), F.lit(0.0))))
    scored = scored.withColumnRenamed("rawPrediction", "probability_raw")
    scored = scored.withColumn("probability", F.when(known, vector_to_array("probability")[1]))
    return scored.withColumn("prediction", (F.col("probability") >= threshold).cast("int"))


def _first_label(model: PipelineModel, column: str) -> str:
    return next(s.labels[0] for s in model.stages if isinstance(s, StringIndexerModel) and s.getInputCol() == column)


def feature_importance(spec: ModelSpec, model: PipelineModel, spark: SparkSession, top: int = 5) -> DataFrame:
    """Features by importance. The list has one entry per feature of the model."""
    names = [*spec.numeric, *spec.identifiers, *spec.categorical]
    weights = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(names, (float(w) for w in weights)), key=lambda p: (-p[1], p[0]))
    rows = [(i + 1, n, w) for i, (n, w) in enumerate(ranked[:top])]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


def clv_segments(spec: ModelSpec, model: PipelineModel, rows: DataFrame) -> DataFrame:
    return predict(spec, model, rows).withColumn("segment", clv_segment("prediction"))


def sla_compliance(spec: ModelSpec, model: PipelineModel, rows: DataFrame, sla_minutes: float) -> DataFrame:
    return predict(spec, model, rows).withColumn("within_sla", F.col("prediction") <= sla_minutes)


Report = list[tuple[str, str, str, float | None]]


def _train_one(spec: ModelSpec, found: Trained | None, folder: str, stamp: str, figures: Callable[[], list]) -> Report:
    if found is None:
        return [(spec.name, "skipped", f"fewer than {spec.min_rows} rows", None)]
    for version in (stamp, "latest"):
        found.model.write().overwrite().save(f"{folder}/{spec.name}/{version}")
    return [(spec.name, "trained", metric, value) for metric, value in figures()]


def _forecast_one(t, folder: str, stamp: str) -> Report:
    """The forecast is refitted from the demand table, so its artefact is the forecast itself."""
    demand = features.demand(t)
    ahead = forecast.forecast(demand)
    for version in (stamp, "latest"):
        ahead.write.mode("overwrite").parquet(f"{folder}/demand_forecast/{version}")
    errors = forecast.cross_validation(demand).collect()  # one row per channel
    return [("demand_forecast", "trained", f"mae_{r['channel']}", r["mae"]) for r in errors]


def train_all(
    t, folder: str, group: str | None = None, trees: int = TREES, validate: bool = True, trained=None
) -> DataFrame:
    """Fit, evaluate and save every model of a group, PARALLEL at a time. A model that fails is reported and skipped.

    Each artefact is saved twice: under its time and as ``latest``. ``trained(t, name)`` and ``trained.report(t, name)`` may
    give models that are fitted and judged already.
    """
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    folder = folder.rstrip("/")
    chosen = [spec for spec in MODELS.values() if group in (None, spec.group)]
    data = {spec.name: spec.dataset(t) for spec in chosen}  # one after the other: tables are stored at their first use

    def one(spec: ModelSpec) -> Report:
        found = trained(t, spec.name) if trained else train(spec, data[spec.name], trees)
        return _train_one(spec, found, folder, stamp, lambda: trained.report(t, spec.name) if trained else report(found, trees, validate))

    jobs = [(spec.name, lambda spec=spec: one(spec)) for spec in chosen]
    if group in (None, "omnichannel"):
        jobs.append(("demand_forecast", lambda: _forecast_one(t, folder, stamp)))

    def run(job) -> Report:
        name, work = job
        try:
            return work()
        except Exception as error:  # one failing model must not stop the others
            return [(name, "failed", f"{type(error).__name__}: {str(error)[:200]}", None)]

    with ThreadPoolExecutor(PARALLEL) as pool:
        found = [row for part in pool.map(run, jobs) for row in part]
    return t.spark.createDataFrame(found, "model string, status string, metric string, value double")


def load(folder: str, name: str, version: str = "latest") -> PipelineModel:
    return PipelineModel.load(f"{folder.rstrip('/')}/{name}/{version}")
