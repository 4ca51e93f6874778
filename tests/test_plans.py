"""Declared experiments and the command line."""

import json
from pathlib import Path

import pytest

from tessera.__main__ import main
from tessera.plans.experiments import experiments, pending

SF = "/root/testdata/sf0.001"
DEFAULTS = {"repeats": 4, "prompts": "prompts_en.jsonl"}


def test_experiments_become_rows(spark):
    declared = [
        {"name": "a", "path": "/m/net/20250102_0304/checkpoint-10", "kinds": ["text", "images", "text"], "repeats": 1},
        {"name": "b", "path": "/m/plain/", "kinds": ["text"]},
    ]
    made = experiments(spark, declared, DEFAULTS, ["text", "images"])
    rows = {(r["name"], r["kind"]): r for r in made.collect()}
    assert set(rows) == {("a", "text"), ("a", "images"), ("b", "text")} and made.count() == 3
    assert (rows["a", "text"]["run"], rows["a", "text"]["checkpoint"]) == ("net_20250102_0304", "checkpoint-10")
    assert (rows["b", "text"]["run"], rows["b", "text"]["checkpoint"]) == ("plain", None)
    assert json.loads(rows["a", "images"]["settings"]) == {"repeats": 1, "prompts": "prompts_en.jsonl"} and json.loads(rows["b", "text"]["settings"]) == DEFAULTS
    done = spark.createDataFrame([("a", "text"), ("a", "text"), ("c", "text")], "name string, kind string")
    assert sorted((r["name"], r["kind"]) for r in pending(made, done).collect()) == [("a", "images"), ("b", "text")]
    assert experiments(spark, [], DEFAULTS, []).count() == 0


@pytest.mark.parametrize("wrong", [{"name": "a", "path": "p"}, {"name": "a", "path": "p", "kinds": ["audio"]}, {"name": "a", "path": "p", "kinds": ["text"], "repeat": 2}])
def test_wrong_experiments_are_refused(spark, wrong):
    with pytest.raises(ValueError):
        experiments(spark, [wrong], DEFAULTS, ["text"])
    with pytest.raises(ValueError):
        experiments(spark, [{"name": "a", "path": "p", "kinds": ["text"]}] * 2, DEFAULTS, ["text"])


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_command_line(spark, tmp_path, capsys):
    assert main(["--list"]) == 0 and "pack_greedy" in capsys.readouterr().out.split()
    assert main(["path_parse", SF, str(tmp_path / "out"), "--form", "json"]) == 0
    assert spark.read.json(str(tmp_path / "out")).count() > 0
    with pytest.raises(SystemExit):
        main(["path_parse"])
    with pytest.raises(SystemExit):
        main(["no_such_query", SF, str(tmp_path / "none")])


def test_tables_of_a_block_go(spark):
    from tessera.plans.store import table, temporary

    with temporary() as outer:
        with temporary() as made:
            a, b = table(spark.range(3)), table(spark.range(4))
            made.keep(b)
        assert b.count() == 4 and len(outer.tables) == 2
        outer.keep(b)
    assert b.count() == 4
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(a._written)
