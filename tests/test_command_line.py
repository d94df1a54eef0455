"""The command line."""

from orrery import __main__ as command
from orrery.plans import queries as plans

DATA = "/root/testdata/sf0.001"


def test_list_names_every_query(capsys):
    assert command.main(["list"]) == 0
    assert capsys.readouterr().out.split() == sorted(plans.QUERIES)


def test_run_writes_the_result(spark, tmp_path):
    assert command.main(["run", DATA, str(tmp_path), "legacy_scan", "anti_join", "--skip", "anti_join"]) == 0
    assert [p.name for p in tmp_path.iterdir()] == ["legacy_scan"]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/legacy_scan").collect()), key=str) == sorted(map(tuple, plans.QUERIES["legacy_scan"](spark, DATA).collect()), key=str)


def test_unknown_query_is_refused(tmp_path, capsys):
    assert command.main(["run", DATA, str(tmp_path), "nothing"]) == 2
    assert "nothing" in capsys.readouterr().err and not list(tmp_path.iterdir())
