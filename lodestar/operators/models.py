"""Features and models of matches and bars with ``pyspark.ml``, and match simulation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.windows import by_time, ratio, roll

c = F.col


def bar_features(bars: DataFrame, ahead: int = 5, roi: float = 0.02) -> DataFrame:
    """Indicator features of each bar and the label: does the close rise by ``roi`` within the next bars."""
    later = by_time().rowsBetween(1, ahead)
    df = bars.withColumns({"ret": ratio(c("close"), F.lag("close").over(by_time())) - 1, "top": F.when(F.count("close").over(later) == ahead, F.max("close").over(later))})
    df = df.withColumns({"ma_gap": ratio(c("close"), roll("close", F.avg, 10)) - 1, "vol": roll("ret", F.stddev_samp, 10), "span": ratio(c("high") - c("low"), c("close")), "vol_ratio": ratio(c("volume"), roll("volume", F.avg, 10))})
    df = df.withColumn("label", (c("top") >= c("close") * (1 + roi)).cast("double"))
    return df.na.drop(subset=["ret", "ma_gap", "vol", "span", "vol_ratio", "label"]).select("symbol", "ts", "ret", "ma_gap", "vol", "span", "vol_ratio", "label")


def match_features(games: DataFrame, features: list[str], key: str, low: float = 0.1) -> DataFrame:
    """Games ``date, location, outcome`` with ``month``, ``day_of_week`` (Monday 0), ``is_home``, ``home_win`` and a ``weight`` that rises by date over all games.

    A location of '' is the home side's row, '@' the visitor's, whose loss is a win at home; ties and
    unknown outcomes count as 0.  Games with a null date or feature are left out.  The place of a
    game is that of its day (a sum over the days) and its place within the day, by time and ``key``; a
    single game weighs 1.
    """
    df = games.na.drop(subset=["date", *features])
    home, away = c("location") == "", c("location") == "@"
    win = F.coalesce((home & (c("outcome") == "W")) | (away & (c("outcome") == "L")), F.lit(False))
    df = df.withColumns({"month": F.month("date"), "day_of_week": F.weekday("date"), "is_home": F.coalesce(home, F.lit(False)).cast("int"), "home_win": win.cast("int"), "_day": F.to_date("date")})
    days = df.groupBy("_day").agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy(F.lit(1)).orderBy("_day")  # one row a day
    days = days.select("_day", (F.sum("_n").over(so_far) - c("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    place = c("_before") + F.row_number().over(Window.partitionBy("_day").orderBy("date", key)) - 1
    share = F.coalesce(ratio(place.cast("double"), (c("_all") - 1).cast("double")), F.lit(1.0))
    return df.join(days, "_day").withColumn("weight", low + (1 - low) * share).drop("_day", "_before", "_all")


def split_by_time(df: DataFrame, share: float = 0.8) -> DataFrame:
    """``train`` for the first share of each symbol's rows."""
    whole = Window.partitionBy("symbol")
    return df.withColumn("train", F.row_number().over(by_time()) <= F.floor(F.count("*").over(whole) * share))


def time_weights(df: DataFrame, low: float = 0.1) -> DataFrame:
    """Sample weights that rise linearly from ``low`` to 1 over each symbol's rows."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    return df.withColumn("weight", low + (1 - low) * F.coalesce(ratio((F.row_number().over(by_time()) - 1).cast("double"), (n - 1).cast("double")), F.lit(1.0)))


def classifier(numbers: list[str], categories: list[str], weight: str | None = None) -> Pipeline:
    index = [StringIndexer(inputCol=x, outputCol=f"{x}_i", handleInvalid="keep") for x in categories]
    hot = [OneHotEncoder(inputCols=[f"{x}_i" for x in categories], outputCols=[f"{x}_v" for x in categories])] if categories else []
    gather = VectorAssembler(inputCols=numbers, outputCol="raw", handleInvalid="skip")
    scale = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)
    all_ = VectorAssembler(inputCols=["scaled", *(f"{x}_v" for x in categories)], outputCol="features")
    model = LogisticRegression(maxIter=50, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[*index, *hot, gather, scale, all_, model])


def holdout(model: PipelineModel, test: DataFrame) -> DataFrame:
    """Rows, accuracy and base rate on held-out rows."""
    scored = model.transform(test)
    return scored.agg(F.count("*").alias("n"), F.avg((c("prediction") == c("label")).cast("double")).alias("accuracy"), F.avg("label").alias("base_rate"))


def boosted(train: DataFrame, numbers: list[str], folds: int = 2, seed: int = 1) -> PipelineModel:
    """Boosted trees, their depth chosen by cross-validation."""
    trees = GBTClassifier(maxIter=5, seed=seed)
    flow = Pipeline(stages=[VectorAssembler(inputCols=numbers, outputCol="features", handleInvalid="skip"), trees])
    grid = ParamGridBuilder().addGrid(trees.maxDepth, [2, 3]).build()
    return CrossValidator(estimator=flow, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=seed).fit(train).bestModel


def regressors(train: DataFrame, numbers: list[str], targets: list[str]) -> dict[str, tuple[PipelineModel, float]]:
    """A linear model for each target with the deviation of its residuals."""
    out = {}
    for target in targets:
        model = Pipeline(stages=[VectorAssembler(inputCols=numbers, outputCol="features", handleInvalid="skip"), LinearRegression(labelCol=target)]).fit(train)
        spread = model.transform(train).agg(F.stddev_samp(c(target) - c("prediction"))).first()[0]
        out[target] = (model, spread)
    return out


def parameter_importance(results: DataFrame, parameters: list[str], metric: str = "sharpe", seed: int = 1) -> list[tuple[str, float]]:
    flow = Pipeline(stages=[VectorAssembler(inputCols=parameters, outputCol="features"), RandomForestRegressor(labelCol=metric, numTrees=20, seed=seed)])
    model = flow.fit(results).stages[-1]
    return sorted(zip(parameters, model.featureImportances.toArray().tolist(), strict=True), key=lambda p: -p[1])


def simulate_matches(games: DataFrame, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Win share and score quartiles of simulated matches: normal scores from hashed uniforms, floored at 0.

    ``games`` has ``game_id, home_mean, home_std, away_mean, away_std``.
    """
    def uniform(salt: int):
        return (F.pmod(F.xxhash64("game_id", "draw", F.lit(seed * 10 + salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)

    rows = games.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    radius, angle = F.sqrt(-2 * F.ln(uniform(0))), 2 * F.pi() * uniform(1)
    rows = rows.withColumns({"home": F.greatest(F.lit(0.0), c("home_mean") + c("home_std") * radius * F.cos(angle)), "away": F.greatest(F.lit(0.0), c("away_mean") + c("away_std") * radius * F.sin(angle))})
    return rows.groupBy("game_id").agg(F.avg((c("home") > c("away")).cast("double")).alias("home_win"), F.percentile("home", [0.25, 0.5, 0.75]).alias("home_quartiles"), F.percentile("away", [0.25, 0.5, 0.75]).alias("away_quartiles"))
