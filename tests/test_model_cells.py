"""Models of all folds and blocks over rows that are held once, against models with a copy of the rows for each."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import model_cells, model_table

NAMES, BLOCKS, SETS = ["a", "b", "c"], {"two": ["a", "c"], "all": ["a", "b", "c"]}, 3


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(5)
    made = []
    for cell in ("u", "v"):
        for i in range(90):
            y = i % 2
            made.append((cell, i, y, i % SETS + 1, i // 3 % 2 + 1, draw.gauss(y, 1.5), draw.gauss(0, 1) if i % 7 else None, 3.7))
    return spark.createDataFrame(made, "cell_name string, id long, y int, fold int, part int, a double, b double, c double").repartition(3)


@pytest.mark.parametrize("parts", [0, 2])
def test_predictions_of_all_models_from_rows_held_once(spark, rows, monkeypatch, parts):
    monkeypatch.setattr(model_cells, "CHUNK", 16)
    cells = model_cells.packed(rows, ["cell_name"], NAMES, model_cells.fold_sides(F.col("fold"), SETS), SETS, ["cell_name", "id", "y"], F.col("part"))
    assert cells.chunks.select(F.sum(F.size("rows"))).head()[0] == rows.count()
    m = model_cells.Models(3, SETS, model_cells.places(NAMES, BLOCKS), parts, "squared_hinge" if parts else "logistic", not parts)
    got = {(r.cell_name, r.s + 1, r.block, r.id): r.p for r in model_cells.predictions(cells, model_cells.fitted(cells, m), m).collect()}
    scaled = model_table.standardized(model_table.fold_sides(rows, SETS), NAMES, ["cell_name", "held"], F.col("train"))
    each = model_table.block_rows(scaled, NAMES, BLOCKS, ["cell_name", "held"])
    plain = model_table.svm_predictions(each, 3, parts=parts) if parts else model_table.logistic_predictions(each, 3)
    want = {(r.cell_name, r.held, r.block, r.id): r.p for r in plain.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
