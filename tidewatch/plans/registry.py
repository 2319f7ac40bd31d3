"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators import scoring
from tidewatch.plans import common, q_eval, q_flows, q_models, q_sources
from tidewatch.session import tune

MODULES = [q_flows, q_eval, q_sources, q_models]
QUERIES: dict = {}
SQL: dict = {}


def _tuned(query):
    return lambda spark, sf_dir: query(tune(spark), sf_dir)


for _m in MODULES:
    QUERIES.update({name: _tuned(query) for name, query in _m.Q.items()})
    SQL.update(_m.S)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return scoring.rank_alerts(scoring.score_flows(common.features(spark, sf_dir), common.RULES))
