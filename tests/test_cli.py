"""The command line, end to end on a small file."""

import json

from snapgraph import cli
from snapgraph.plans.graph import Graph
from snapgraph.sources import io


def test_tools_run_on_a_file(spark, tmp_path, capsys):
    g = Graph.from_pairs(spark.createDataFrame([(k, (k * 7 + 1) % 30) for k in range(30)], "a long, b long"))
    path = str(tmp_path / "graph")
    io.write_adjacency(g, path)
    binary = str(tmp_path / "binary")
    io.write_compressed(g, binary)
    for test in ("BFS", "BC", "MIS", "KHOP", "NIBBLE"):
        cli.main(["run-static", path, "-t", test, "--rounds", "1", "--nsrc", "3", "-T", "2"])
        assert f"AVERAGE test={test}" in capsys.readouterr().out
    cli.main(["batch-updates", binary, "--format", "byte", "--sizes", "10", "--trials", "2", "--store", str(tmp_path / "store")])
    told = capsys.readouterr().out
    assert "RESULT insert size=10 trials=2" in told and "RESULT delete size=10 trials=2" in told
    cli.main(["storage-stats", path])
    assert "delta_bytes" in capsys.readouterr().out
    cli.main(["simultaneous", path, "--sample", "20", "--batches", "2", "--store", str(tmp_path / "both")])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["applied"] > 0


def test_trials_of_a_size():
    assert cli.trials(10) == 20 and cli.trials(10**8) == 3
