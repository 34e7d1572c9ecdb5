import os
import sys


def test_entry_and_registry(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 60


def test_entry_without_the_optional_operators(tmp_path):
    """A library the training-data operators need is missing: the other queries stay."""
    import subprocess
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.modules['xxhash'] = None; sys.modules['corpus_pipeline'] = None; sys.path.insert(0, %r); import __spark_entry__ as e; "
            "q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; "
            "assert set(e.oracle_sql()) <= set(q)" % repo)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
