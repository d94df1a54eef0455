"""Named queries over fitted steps: standardized records, and which feature stands for which in the order of priority."""

from __future__ import annotations

from ..functions import features as names
from ..operators.estimators import ROUNDING, FeaturePruner, MedianScaler
from ..operators.scan import written
from .base import rounded
from .wide_queries import DIGITS, whole_record_features
from .wide_queries import ORACLE_SQL as WIDE_SQL

PLACES = 5


def whole_records(spark, sf):
    """All 49 features of whole records, as ``record_features_full`` gives them."""
    return written(rounded(whole_record_features(spark, sf), DIGITS).select("record_id", *names.ALL), "records")


def standardized_records(spark, sf):
    rows = whole_records(spark, sf)
    return MedianScaler(names.ALL).fit(rows).transform(rows)


def features_by_priority(spark, sf):
    """Each of the 33 features of the order of priority, its place, the feature that stands for it, and whether it is kept."""
    model = FeaturePruner(names.PRIORITY).fit(whole_records(spark, sf))
    rows = [(c, names.priority(c), g, c == g) for c, g in zip(model.getInputCols(), model.getOrDefault(model.standing))]
    return spark.createDataFrame(rows, "feature string, place long, standing string, kept boolean")


RECORDS_SQL = f"r AS (SELECT * FROM ({WIDE_SQL['record_features_full']}) WHERE window_type = 'full_record')"
SCALED_SQL = f"""WITH {RECORDS_SQL},
m AS (SELECT {", ".join(f"coalesce(median(CAST({c} AS DOUBLE)), 0.0) AS {c}" for c in names.ALL)} FROM r),
f AS (SELECT r.record_id, {", ".join(f"coalesce(CAST(r.{c} AS DOUBLE), m.{c}) AS {c}" for c in names.ALL)} FROM r, m),
s AS (SELECT {", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in names.ALL)} FROM f)
SELECT record_id, {", ".join(f"round(({c} - a_{c}) / (CASE WHEN s_{c} > {ROUNDING} * abs(a_{c}) THEN s_{c} ELSE 1.0 END), {PLACES}) + 0.0 AS {c}" for c in names.ALL)} FROM f, s"""
PRIORITY_SQL = f"""WITH RECURSIVE {RECORDS_SQL},
l AS ({" UNION ALL ".join(f"SELECT record_id, {i} AS i, CAST({c} AS DOUBLE) AS x FROM r WHERE {c} IS NOT NULL" for i, c in enumerate(names.PRIORITY))}),
p AS (SELECT a.i AS a, b.i AS b, a.x AS xa, b.x AS xb FROM l a JOIN l b USING (record_id) WHERE a.i < b.i),
k AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY xa) + (count(*) OVER (PARTITION BY a, b, xa) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY a, b ORDER BY xb) + (count(*) OVER (PARTITION BY a, b, xb) - 1) / 2.0 AS rb FROM p),
e AS (SELECT a, b FROM k GROUP BY a, b HAVING var_pop(ra) > 0 AND var_pop(rb) > 0 AND abs(round(corr(ra, rb), 4)) >= 0.9),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
met AS (SELECT range AS i, range AS j FROM range({len(names.PRIORITY)}) UNION SELECT met.i, b.b FROM met JOIN both_ways b ON met.j = b.a),
g AS (SELECT i, min(j) AS j FROM met GROUP BY i),
n AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(names.PRIORITY))}) AS t(i, feature))
SELECT n.feature, CAST(g.i AS BIGINT) AS place, o.feature AS standing, g.i = g.j AS kept FROM g JOIN n ON n.i = g.i JOIN n o ON o.i = g.j"""

QUERIES = {
    "standardized_records": lambda s, d: rounded(standardized_records(s, d), PLACES),
    "features_by_priority": features_by_priority,
}
ORACLE_SQL = {"standardized_records": SCALED_SQL, "features_by_priority": PRIORITY_SQL}
