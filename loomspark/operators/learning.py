"""Classic feature extraction and regressors on MLlib, and simple pricers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, CountVectorizer, HashingTF, RegexTokenizer, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from .curation import hash_uniform


def hand_features(df: DataFrame, weight: str, text: str) -> DataFrame:
    """Adds weight (0 if unknown), weight_unknown and text_length."""
    return df.withColumns({"weight": F.coalesce(F.col(weight), F.lit(0.0)), "weight_unknown": (F.coalesce(F.col(weight), F.lit(0.0)) == 0).cast("int"), "text_length": F.length(text)})


def bag_of_words(text: str, size: int = 2000) -> Pipeline:
    """Counts of the ``size`` most frequent words of two or more characters, without English stop words."""
    return Pipeline(stages=[RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"(?U)\b\w\w+\b", gaps=False), StopWordsRemover(inputCol="_w", outputCol="_k"), CountVectorizer(inputCol="_k", outputCol="features", vocabSize=size)])


def hashed_words(text: str, size: int = 5000) -> Pipeline:
    """Binary hashed words."""
    return Pipeline(stages=[RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"(?U)\b\w\w+\b", gaps=False), HashingTF(inputCol="_w", outputCol="features", numFeatures=size, binary=True)])


def regressor(kind: str, inputs: list[str], label: str, seed: int = 42, **more) -> Pipeline:
    """linear, forest (100 trees) or boosted trees over numeric columns."""
    models = {
        "linear": lambda: LinearRegression(labelCol=label, **more),
        "forest": lambda: RandomForestRegressor(labelCol=label, seed=seed, **({"numTrees": 100} | more)),
        "boosted": lambda: GBTRegressor(labelCol=label, seed=seed, **({"maxIter": 1000, "stepSize": 0.1} | more)),
    }
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), models[kind]()])


def predict(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Predictions, never below 0."""
    return model.transform(df).select(*keep, F.greatest(F.lit(0.0), F.col("prediction")).alias("guess"))


def random_price(key: Column | str, seed: int = 42, top: int = 1000) -> Column:
    """A whole price below ``top``, fixed by the key."""
    return F.floor(hash_uniform(str(seed), col(key)) * top).cast("int")


def project(vectors: DataFrame, embedding: str, k: int = 2) -> DataFrame:
    """Principal components as an array; a linear stand-in for a neighbour embedding, which Spark lacks."""
    v = vectors.withColumn("_v", array_to_vector(F.col(embedding).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("projection", vector_to_array("_p")).drop("_v", "_p")


class Tools:
    """Functions by name, with the schema of their arguments: a call is a row with a name and JSON arguments."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[dict[str, str], Callable[[Column], Column]]] = {}

    def register(self, name: str, arguments: dict[str, str], function: Callable[[Column], Column]) -> None:
        """``function`` takes the struct of parsed arguments (name -> Spark type) and gives a column."""
        if name in self._known:
            raise ValueError(f"a tool named {name} is there already")
        self._known[name] = (arguments, function)

    def declared(self) -> list[dict]:
        """The tools as JSON-schema declarations."""
        kinds = {"string": "string", "int": "integer", "bigint": "integer", "double": "number", "boolean": "boolean"}
        return [{"type": "function", "function": {"name": n, "parameters": {"type": "object", "properties": {a: {"type": kinds.get(k, "string")} for a, k in args.items()}, "required": list(args)}}} for n, (args, _) in self._known.items()]

    def call(self, name: Column | str, arguments: Column | str) -> Column:
        """The named tool's result as text; null for a name that is not registered."""
        out = F.lit(None).cast("string")
        for n, (args, f) in self._known.items():
            parsed = F.from_json(col(arguments), ", ".join(f"{a} {k}" for a, k in args.items()))
            out = F.when(col(name) == n, f(parsed).cast("string")).otherwise(out)
        return out
