"""Quality classifiers on Spark ML: training rows, splits, three estimators and their vote, comparison.

Random choices are by hash of the row's id, so results do not depend on partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import edits
from ..functions import text as T
from ..functions.udf import digest, vectorized
from . import evaluation, quality

# The record's version and target, least rows, the cap, and the shape of the models.
SCHEMA_VERSION, LABEL_TARGET = 4, "initial_transcript_wer"
LEAST_ROWS, MOST_ROWS = 9, 5_000
CLASSES = 3
MODELS = ("Logistic Regression", "Support Vector Machine", "Random Forest", "Weighted Ensemble")
#: What tells a record apart, by the names that it is hashed under, and their columns and types.
EXAMPLE_FIELDS = {
    "learner_id": ("learner_id", "string"), "session_number": ("session_number", "int"), "project_title": ("title", "string"), "turn_id": ("turn_id", "int"),
    "start": ("start", "double"), "end": ("end", "double"), "speaker_raw": ("speaker_raw", "string"), "zoom_text": ("zoom_text", "string"),
    "chatgpt_text": ("chatgpt_text", "string"), "model_text": ("model_text", "string"), "quality_target_text": ("quality_target_text", "string"),
    "gold_text": ("gold_text", "string"),
}


@vectorized("string")
def example_id(fields: pd.DataFrame) -> pd.Series:
    """The digest of a record's fields; missing numbers are null."""
    kinds = {name: kind for name, (_, kind) in EXAMPLE_FIELDS.items()}

    def held(name: str, value):
        if value is None or value != value:
            return None
        return {"string": str, "int": int, "double": float}[kinds[name]](value)

    return pd.Series([digest({n: held(n, v) for n, v in r.items()}) for r in fields.to_dict("records")], dtype="object")


def training_rows(turns: DataFrame, projects: DataFrame) -> DataFrame:
    """A record for each turn with a gold and a target text; its class follows the target's word error rate."""
    t = quality.features(quality.freeze_target(turns)).where((F.trim(T.text("gold_text")) != "") & (F.col("quality_target_text") != ""))
    meta = projects.select("project_id", *(c for c in ("learner_id", "session_number", "title") if c in projects.columns))
    t = t.join(meta, "project_id", "left").withColumn("target_wer", edits.word_error_rate(F.col("gold_text"), F.col("quality_target_text")))
    key = F.struct(*((F.col(c) if c in t.columns else F.lit(None)).cast(kind).alias(name) for name, (c, kind) in EXAMPLE_FIELDS.items()))
    return t.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(LABEL_TARGET).alias("label_target"), F.array(*(F.lit(n) for n in quality.FEATURES)).alias("feature_names"),
        F.array(*(F.col(f"features.{n}") for n in quality.FEATURES)).alias("features"), T.quality_class(F.col("target_wer")).alias("label"),
        "target_wer", example_id(key).alias("example_id"),
    )


def valid_rows(rows: DataFrame) -> DataFrame:
    """Records of this version and target, with all features finite and a class."""
    f = F.col("features")
    fine = (F.size(f) == len(quality.FEATURES)) & F.forall(f, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    names = F.col("feature_names") == F.array(*(F.lit(n) for n in quality.FEATURES))
    return rows.where((F.col("schema_version") == SCHEMA_VERSION) & (F.col("label_target") == LABEL_TARGET) & names & fine & F.col("label").between(0, CLASSES - 1) & F.col("example_id").isNotNull())


def append(known: DataFrame, new: DataFrame) -> DataFrame:
    """New valid records whose id is not known, once each."""
    return valid_rows(new).dropDuplicates(["example_id"]).join(known.select("example_id"), "example_id", "left_anti").select(*known.columns)


def summary(rows: DataFrame) -> DataFrame:
    return valid_rows(rows).groupBy("label").agg(F.count("*").alias("records"))


def capped(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """At most `most` rows, of each class in turn, chosen by hash."""
    w = Window.partitionBy("label").orderBy(F.xxhash64("example_id"), "example_id")
    return rows.withColumn("rn_", F.row_number().over(w)).orderBy("rn_", "label").limit(most).drop("rn_")


def class_weights(rows: DataFrame) -> DataFrame:
    """(label, n, weight): N / (classes * n), from 0.35 to 4."""
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    every = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.collect_list(F.struct("label", "n")).alias("each"))  # a row for each class
    return every.select("total", "k", F.inline("each")).select("label", "n", T.clamp(F.col("total") / (F.col("k") * F.col("n")), 0.35, 4.0).alias("weight"))


def scales(rows: DataFrame) -> DataFrame:
    """(feature, mean, scale) with the population's deviation, 1e-6 at least."""
    long = rows.select(F.posexplode("features").alias("feature", "x"))
    return long.groupBy("feature").agg(F.avg("x").alias("mean"), F.greatest(F.lit(1e-6), F.stddev_pop("x")).alias("scale"))


def scaler(rows: DataFrame) -> tuple[list[float], list[float]]:
    s = sorted(scales(rows).collect())  # a row for each feature
    return [r["mean"] for r in s], [r["scale"] for r in s]


def scaled(c: Column, means: list[float], deviations: list[float]) -> Column:
    arr = lambda xs: F.array(*(F.lit(x) for x in xs))
    return F.zip_with(F.zip_with(c, arr(means), lambda x, m: x - m), arr(deviations), lambda x, d: x / d)


def splits(rows: DataFrame, repeat: int, share: float = 0.25) -> DataFrame:
    """Rows with `held`: of each class a quarter by hash, one row at least and one left at least; classes of one row stay."""
    w = Window.partitionBy("label")
    rank = F.row_number().over(w.orderBy(F.xxhash64("example_id", F.lit(2026 + 977 * repeat)), "example_id"))
    n = F.count("*").over(w)
    held = F.least(n - 1, F.greatest(F.lit(1), F.bround(n * share).cast("long")))
    return rows.withColumn("held", rank <= held)


def confusion_scores(predictions: DataFrame, *by: str) -> DataFrame:
    """Accuracy, macro F1, balanced accuracy over the labels that occur, and their blend for selection."""
    if not by:
        return confusion_scores(predictions.withColumn("all_", F.lit(0)), "all_").drop("all_")
    cells = predictions.groupBy(*by, "label", "prediction").agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    total = cells.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(hit).alias("right"))
    actual = cells.groupBy(*by, F.col("label").alias("klass")).agg(F.sum("n").alias("actual"), F.sum(hit).alias("tp"))
    given = cells.groupBy(*by, F.col("prediction").cast("int").alias("klass")).agg(F.sum("n").alias("given"))
    per = actual.withColumn("klass", F.col("klass").cast("int")).join(given, [*by, "klass"], "left").na.fill(0, ["given"])
    per = per.groupBy(*by).agg(F.avg(2.0 * F.col("tp") / (F.col("actual") + F.col("given"))).alias("macro_f1"), F.avg(F.col("tp") / F.col("actual")).alias("balanced_accuracy"))
    j = per.join(total, list(by)).withColumn("accuracy", F.col("right") / F.col("total"))
    return j.select(*by, "accuracy", "macro_f1", "balanced_accuracy", (0.70 * F.col("macro_f1") + 0.20 * F.col("balanced_accuracy") + 0.10 * F.col("accuracy")).alias("selection"))


@dataclass
class Fitted:
    """Three models on scaled features, and the weights of their vote."""

    means: list[float]
    scales: list[float]
    models: dict
    votes: dict[str, float] = field(default_factory=dict)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Rows with `p_lr`, `p_svm`, `p_rf`, `p_ens`: arrays of class probabilities."""
        df = rows.withColumn("x_", array_to_vector(scaled(F.col("features"), self.means, self.scales)))
        for name, model in self.models.items():
            cols = df.columns
            out = model.transform(df)
            if name == "svm":
                # Margins to probabilities by softmax; classes without a model have none.
                m = vector_to_array(F.col("rawPrediction"))
                e = F.transform(m, lambda x: F.exp(x - F.array_max(m)))
                p = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
            else:
                p = vector_to_array(F.col("probability"))
            full = F.transform(F.sequence(F.lit(1), F.lit(CLASSES)), lambda i: F.coalesce(F.try_element_at(p, i), F.lit(0.0)))
            df = out.select(*cols, full.alias(f"p_{name}"))
        total = sum(self.votes.values()) or 1.0
        vote = {k: self.votes.get(k, 1.0) / total for k in self.models}
        mix = F.transform(F.sequence(F.lit(1), F.lit(CLASSES)), lambda i: sum((F.element_at(f"p_{k}", i) * v for k, v in vote.items()), F.lit(0.0)))
        return df.withColumn("p_ens", mix).drop("x_")


def fit(rows: DataFrame, trees: int = 31, iterations: int = 50) -> Fitted:
    """Three models on at most MOST_ROWS rows: one partition holds them, so passes over them cost no shuffle."""
    means, deviations = scaler(rows)
    weights = class_weights(rows).select(F.col("label"), F.col("weight"))
    data = rows.join(F.broadcast(weights), "label").select(F.col("label").cast("double").alias("label"), "weight", array_to_vector(scaled(F.col("features"), means, deviations)).alias("x_")).coalesce(1).persist()
    try:
        return Fitted(means, deviations, fitted_models(data, trees, iterations))
    finally:
        data.unpersist()


def fitted_models(data: DataFrame, trees: int, iterations: int) -> dict:
    common = {"featuresCol": "x_", "labelCol": "label", "weightCol": "weight"}
    svm = LinearSVC(maxIter=iterations, regParam=0.01, **common)
    return {
        "lr": LogisticRegression(family="multinomial", regParam=0.005, maxIter=iterations, standardization=False, **common).fit(data),
        "svm": OneVsRest(classifier=svm, featuresCol="x_", labelCol="label", weightCol="weight").fit(data),
        "rf": RandomForestClassifier(numTrees=trees, maxDepth=5, minInstancesPerNode=3, featureSubsetStrategy="0.6", seed=9127, **common).fit(data),
    }


def scored(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """(model, accuracy, macro_f1, balanced_accuracy, selection) on rows."""
    out = fitted.transform(rows)
    names = ("lr", "svm", "rf", "ens")
    long = out.select("label", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"p_{n}").alias("p")) for m, n in zip(MODELS, names, strict=True)))).alias("m"))
    best = (F.array_position(F.col("m.p"), F.array_max("m.p")) - 1).cast("int")
    return confusion_scores(long.select(F.col("m.model").alias("model"), "label", best.alias("prediction")), "model")


def check(rows: DataFrame) -> None:
    """Raises ValueError unless there are enough rows and two classes."""
    r = rows.agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).first()
    if r.n < LEAST_ROWS or r.k < 2:
        raise ValueError(f"training needs {LEAST_ROWS} rows and 2 classes; there are {r.n} and {r.k}")


def compare(rows: DataFrame, trees: int = 21, iterations: int = 50) -> tuple[DataFrame, Fitted]:
    """(model, accuracy, macro_f1, balanced_accuracy, selection, selected) by repeated holdout, and the models
    fitted on all capped rows, whose votes follow the holdout's selection scores."""
    rows = capped(valid_rows(rows)).coalesce(1).persist()
    check(rows)
    repeats = 3 if rows.count() <= 600 else 2
    parts, votes = [], {}
    for r in range(repeats):
        s = splits(rows, r).persist()
        train, test = s.where("NOT held").drop("held"), s.where("held").drop("held")
        if train.select("label").distinct().count() < 2 or test.isEmpty():
            train = test = rows
        parts += [tuple(x) for x in scored(fit(train, trees, iterations), test).collect()]  # four rows
        s.unpersist()
    every = rows.sparkSession.createDataFrame(parts, "model string, accuracy double, macro_f1 double, balanced_accuracy double, selection double")
    mean = every.groupBy("model").agg(*(F.avg(c).alias(c) for c in ("accuracy", "macro_f1", "balanced_accuracy", "selection")))
    found = {x["model"]: x.asDict() for x in mean.collect()}  # four rows
    votes = {k: max(0.05, found[m]["selection"]) ** 2 for m, k in zip(MODELS, ("lr", "svm", "rf"), strict=False)}
    best = max(MODELS, key=lambda m: (found[m]["selection"], found[m]["macro_f1"], found[m]["accuracy"]))
    fitted = fit(rows, iterations=iterations)
    fitted.votes = votes
    rows.unpersist()
    table = rows.sparkSession.createDataFrame(
        [(m, *(float(found[m][c]) for c in ("accuracy", "macro_f1", "balanced_accuracy", "selection")), m == best) for m in MODELS],
        "model string, accuracy double, macro_f1 double, balanced_accuracy double, selection double, selected boolean",
    )
    return table, fitted


def predict(fitted: Fitted, turns: DataFrame, model: str = MODELS[3]) -> DataFrame:
    """Turns scored by a model's probabilities."""
    col = f"p_{('lr', 'svm', 'rf', 'ens')[MODELS.index(model)]}"
    t = quality.features(quality.detect(turns))
    arr = F.array(*(F.col(f"features.{n}") for n in quality.FEATURES))
    p = fitted.transform(t.select("project_id", "turn_id", arr.alias("features"))).select("project_id", "turn_id", F.col(col).alias("probability_"))
    return quality.score(turns.join(p, ["project_id", "turn_id"], "left"), "probability_").drop("probability_")


def save(fitted: Fitted, path: str, metadata: dict) -> None:
    """The models and what they need, below a folder of any file system that Spark writes."""
    import json

    for name, model in fitted.models.items():
        model.write().overwrite().save(f"{path}/{name}")
    from pyspark.sql import SparkSession

    own = {"means": fitted.means, "scales": fitted.scales, "votes": fitted.votes, "features": list(quality.FEATURES), "schema_version": SCHEMA_VERSION, "label_target": LABEL_TARGET, **metadata}
    SparkSession.getActiveSession().createDataFrame([(json.dumps(own, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata_json")


def load(path: str) -> Fitted:
    """Saved models; ValueError if they were made for other features or another target."""
    import json

    from pyspark.ml.classification import LogisticRegressionModel, OneVsRestModel, RandomForestClassificationModel
    from pyspark.sql import SparkSession

    meta = json.loads(SparkSession.getActiveSession().read.text(f"{path}/metadata_json").first()["value"])
    if meta["features"] != list(quality.FEATURES) or (meta["schema_version"], meta["label_target"]) != (SCHEMA_VERSION, LABEL_TARGET):
        raise ValueError("the models were made for other features or another target")
    kinds = {"lr": LogisticRegressionModel, "svm": OneVsRestModel, "rf": RandomForestClassificationModel}
    return Fitted(meta["means"], meta["scales"], {k: c.load(f"{path}/{k}") for k, c in kinds.items()}, meta["votes"])

