"""Feature selection as a fitted stage: learned from training rows, saved with the pipeline."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tabulon.functions.columns import literal_rows
from tabulon.operators.comoments import comoments, correlation_pairs, spreads

TWIN = 0.95


class _Selection(Params):
    inputCols = Param(Params._dummy(), "inputCols", "numeric columns to choose from", TypeConverters.toListString)
    twin = Param(Params._dummy(), "twin", "|r| above which the later of two names is dropped", TypeConverters.toFloat)


class FeatureSelector(Estimator, _Selection, DefaultParamsReadable, DefaultParamsWritable):
    """Drops columns that are constant or always missing in the rows it is fitted on, and near copies of others.

    One scan gives the co-moments of all columns. Of a pair with |r| above `twin` the later name goes, if the
    earlier one stays; |r| is over the rows that have both.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, twin=TWIN):
        super().__init__()
        self._setDefault(twin=TWIN)
        self._set(**self._input_kwargs)

    def _fit(self, train: DataFrame) -> FeatureSelectorModel:
        columns, limit = list(self.getOrDefault("inputCols")), self.getOrDefault("twin")
        reasons: dict[str, str] = {}
        if columns:
            states = comoments(train, columns).persist()
            try:
                # One row per column, and one per pair of near copies.
                found = {r["column"]: r for r in spreads(states, columns).collect()}
                pairs = correlation_pairs(states, columns).where(F.abs("r") > limit).select("a", "b").collect()
            finally:
                states.unpersist()
            for c in columns:
                if c not in found or found[c]["n"] == 0:
                    reasons[c] = "missing"
                elif found[c]["variance"] == 0:
                    reasons[c] = "constant"
            twins: dict[str, set[str]] = {}
            for a, b in pairs:
                twins.setdefault(max(a, b), set()).add(min(a, b))
            for c in sorted(twins):
                if kept := sorted(x for x in twins[c] if x not in reasons):
                    reasons[c] = f"duplicate of {kept[0]}"
        names = [c for c in columns if c in reasons]
        return FeatureSelectorModel(inputCols=columns, dropped=names, reasons=[reasons[c] for c in names], twin=limit)


class FeatureSelectorModel(Model, _Selection, DefaultParamsReadable, DefaultParamsWritable):
    """Drops the columns it was fitted to drop, whatever they hold in other rows."""

    dropped = Param(Params._dummy(), "dropped", "columns that are dropped", TypeConverters.toListString)
    reasons = Param(Params._dummy(), "reasons", "why, in the same order", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, dropped=None, reasons=None, twin=TWIN):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def kept(self) -> list[str]:
        gone = set(self.getOrDefault("dropped"))
        return [c for c in self.getOrDefault("inputCols") if c not in gone]

    def report(self, spark) -> DataFrame:
        """`column, selected, reason` of every column there was to choose from."""
        why = dict(zip(self.getOrDefault("dropped"), self.getOrDefault("reasons")))
        rows = [(c, c not in why, why.get(c)) for c in self.getOrDefault("inputCols")]
        return literal_rows(spark, rows, "column string, selected boolean, reason string")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.getOrDefault("dropped"))
