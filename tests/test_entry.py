"""The driver's contract, and that nothing depends on the corpus subpackage."""

import pathlib
import sys

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["album_id", "title", "artist", "n_tracks", "duration"]


def test_every_sql_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_the_rest_imports_no_corpus_operator():
    for path in [*ROOT.glob("cadenza/**/*.py"), ROOT / "bench.py", *ROOT.glob("tests/*.py")]:
        if "llm" not in path.parts and path.name != "test_entry.py":
            assert "llm" not in path.read_text(), path


def test_queries_are_found_without_the_corpus_folders(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # importing it fails, as where the file is gone
    names = set(entry.queries())
    assert "a7_album_entities" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
