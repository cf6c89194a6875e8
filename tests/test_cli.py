"""The command line."""

import json

from quadrille.plans.cli import main


def test_missing_argument(capsys):
    assert main([]) == 1 and "Missing config path" in capsys.readouterr().err


def test_errors_have_a_code(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text('{"@type": "Nothing"}')
    assert main([str(tmp_path / "c.json")]) == 1 and "unknown component" in capsys.readouterr().err


def test_runs_a_configuration(spark, tmp_path):
    (tmp_path / "in.nt").write_text('<http://e/s> <http://e/p> "x" .\n')
    sink = {"@type": "QuadSinkFile", "outputFormat": "application/n-triples", "fileExtension": ".nt", "iriToPath": {"^http://e/": f"{tmp_path}/out/"}}
    source = {"@type": "QuadSourceFile", "filePath": str(tmp_path / "in.nt")}
    (tmp_path / "c.json").write_text(json.dumps({"@type": "Fragmenter", "quadSource": source, "fragmentationStrategy": {"@type": "FragmentationStrategySubject"}, "quadSink": sink}))
    assert main([str(tmp_path / "c.json")]) == 0
    assert (tmp_path / "out/s.nt").read_text() == '<http://e/s> <http://e/p> "x" .\n'
