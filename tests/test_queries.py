"""Every registered series query against its DuckDB text on the small tables, and imports without the corpus part."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pytest

from orrery.plans import engine_queries
from orrery.plans import queries as plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(rows):
    return sorted(tuple("None" if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = tables.execute(plans.ORACLE_SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    want = [tuple(r[order.index(c)] for c in columns) for r in found.fetchall()]
    assert canonical(map(tuple, df.select(*columns).collect())) == canonical(want)


#: Held against plain Python in test_scale.py.
ELSEWHERE = {"block_metrics", "block_steps", "coefficient_table", "distance_harness", "distance_steps", "distance_lead_times", "mahalanobis_population_folds", "mahalanobis_pair_baseline", "cv_logistic", "incremental_blocks", "coefficient_stability"}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL) - ELSEWHERE))
def test_query_without_sql_has_rows(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_distances_of_all_windows(spark):
    names = engine_queries.mahalanobis.FEATURE_SETS["hrv_reduced"]
    windows = engine_queries.feature_windows(spark, DATA).select("record_id", "window_index", "y", *names).toPandas()
    x, base = windows[names].to_numpy(float), (windows["y"] == 0).to_numpy()
    x = np.where(np.isfinite(x), x, np.nanmedian(x[base], 0))
    c = x[base] - x[base].mean(0)
    s, p, n = c.T @ c / len(c), len(names), len(c)
    m = np.trace(s) / p
    d2 = ((s - m * np.eye(p)) ** 2).sum() / p
    share = min(1.0, (((c * c).sum(1) ** 2).mean() - (s**2).sum()) / (p * n) / d2)
    away = x - x[base].mean(0)
    windows["d"] = np.sqrt(np.einsum("ij,jk,ik->i", away, np.linalg.inv((1 - share) * s + share * m * np.eye(p)), away))
    limit = np.percentile(windows["d"][base], 95)
    assert (windows["window_index"] % 5 == 3).any()
    want = {k: (g["d"].mean(), g["d"].max(), float((g["d"] > limit + 1e-9).sum())) for k, g in windows.groupby("record_id")}
    got = {r["record_id"]: (r["mahalanobis_mean"], r["mahalanobis_max"], r["mahalanobis_alarm_count"]) for r in plans.QUERIES["mahalanobis_all_windows"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_pairwise_ranking_by_plain_models(spark):
    names = engine_queries.FEATURES
    rows = engine_queries.fold_rows(spark, DATA).toPandas()
    got = {(r["fold"], r["use_pruning"]): r for r in plans.QUERIES["pairwise_ranking"](spark, DATA).collect()}
    assert len(got) == 2 * rows["fold"].nunique()
    fewer = 0
    for (fold, pruned), r in got.items():
        train, held = rows[rows["fold"] != fold], rows[rows["fold"] == fold].copy()
        used = list(names)
        if pruned:
            rho = train[names].astype(float).rank().corr().abs().round(4)
            order = sorted(names, key=lambda c: (["rmssd", "cv_rr"] + names).index(c))
            group = {c: {c} for c in names}
            for a in names:
                for b in names:
                    if rho.loc[a, b] >= 0.9 and group[a] is not group[b]:
                        joined = group[a] | group[b]
                        group.update({c: joined for c in joined})
            used = [c for c in names if min(group[c], key=order.index) == c]
            fewer += len(used) < len(names)
        middle = train[used].astype(float).median()
        x, v = train[used].astype(float).fillna(middle), held[used].astype(float).fillna(middle)
        mean, deviation = x.mean(), x.std(ddof=0).replace(0, 1)
        x, v = (np.column_stack([((t - mean) / deviation).to_numpy(), np.ones(len(t))]) for t in (x, v))
        b, y, ridge = np.zeros(x.shape[1]), train["y"].to_numpy(float), np.append(np.ones(len(used)), 0)
        for _ in range(50):
            q = 1 / (1 + np.exp(-x @ b))
            b += np.linalg.solve((x.T * (q * (1 - q))) @ x + np.diag(ridge), x.T @ (y - q) - ridge * b)
        held["p"] = 1 / (1 + np.exp(-v @ b))
        sides = held.pivot_table(index="pair_id", columns="y", values="p").dropna()
        margin = sides[1] - sides[0]
        assert r["n_pairs_val"] == len(margin)
        assert abs(r["pairwise_concordance"] - (margin > 0).mean()) < 1e-4 and abs(r["mean_margin"] - margin.mean()) < 2e-4
    assert fewer


def test_entry_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_works_without_the_corpus_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; assert set(e.oracle_sql()) <= set(e.queries())"
    for gone in ("", "corpus_pipeline.py"):
        if gone and (tmp_path / "copy" / gone).exists():
            (tmp_path / "copy" / gone).unlink()
        subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "copy", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
