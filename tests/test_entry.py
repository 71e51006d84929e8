import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and len(o) > 45; print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.stdout.endswith("fine\n"), out.stderr


def test_flagship_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
