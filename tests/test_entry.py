import subprocess
import sys

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_optional_folders(tmp_path):
    code = "import sys\nfor m in ('fringeworks.llm', 'fringeworks.llm.queries', 'corpus_pipeline'): sys.modules[m] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'grid_box' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q\nassert 'grid_box' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
