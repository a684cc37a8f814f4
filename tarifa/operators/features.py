"""Final features of a hedonic model as one fitted transform: log price, cluster, interactions.

``PriceFeatures`` is fitted once (on the first week) and then only applied: new weeks get the clusters of the first. It is saved and
loaded like any other stage.
"""

from __future__ import annotations

import json
from itertools import combinations
from math import prod

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.operators.train import Clustering, fit_clustering, log_price


class _PriceParams(Params):
    features = Param(Params._dummy(), "features", "numbers that products are clustered by and multiplied", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "texts that take part in the clusters", TypeConverters.toListString)
    price = Param(Params._dummy(), "price", "the price, which goes", TypeConverters.toString)
    logPrice = Param(Params._dummy(), "logPrice", "its logarithm", TypeConverters.toString)
    cluster = Param(Params._dummy(), "cluster", "the cluster's number", TypeConverters.toString)
    degree = Param(Params._dummy(), "degree", "columns that are multiplied at most; 1 for none", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(categorical=[], price="prix_tnd", logPrice="log_prix", cluster="cluster", degree=2)


class PriceFeatures(Estimator, _PriceParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, features=None, categorical=None, price="prix_tnd", logPrice="log_prix", cluster="cluster", degree=2):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> PriceFeaturesModel:
        clustering = fit_clustering(df, self.getOrDefault(self.features), self.getOrDefault(self.categorical))
        return self._copyValues(PriceFeaturesModel()._set(clustering=json.dumps(clustering.to_json())))


class PriceFeaturesModel(Model, _PriceParams, DefaultParamsReadable, DefaultParamsWritable):
    clustering = Param(Params._dummy(), "clustering", "scaling and centres, as JSON", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        """All columns but the price, the cluster, products of up to ``degree`` different features, the log price.

        Absent columns are a ``KeyError``, texts where numbers are due a ``TypeError``, gaps a ``ValueError``; a price of 0 or
        less has no logarithm and is warned of. A table without the price (products to be estimated) has no log price.
        """
        get = self.getOrDefault
        price, names = get(self.price), get(self.features)
        known = Clustering.from_json(json.loads(get(self.clustering)))
        rest = [c for c in df.columns if c != price]
        rows = known.assign(log_price(df, price, get(self.logPrice)) if price in df.columns else df, get(self.cluster))
        made = {"_".join(some): prod((F.col(c).cast("double") for c in some), start=F.lit(1.0)) for n in range(2, get(self.degree) + 1) for some in combinations(names, n)}
        return rows.withColumns(made).select(*rest, get(self.cluster), *made, *([get(self.logPrice)] if price in df.columns else []))
