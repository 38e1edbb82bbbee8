import importlib.util
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert o.keys() <= q.keys(); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q)"


def counted(folder):
    return subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    total, operators, pipeline = counted(tmp_path / "r")
    assert int(total) > 150 and (operators, pipeline) == ("0", "False")
    # every module imports, the remaining tests are found, and some of them run
    found = subprocess.run([sys.executable, "-B", "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=tmp_path / "r", capture_output=True, text=True, check=True).stdout
    assert "test_query[q01_time_range_count]" in found and "llm" not in found
    subprocess.run([sys.executable, "-B", "-m", "pytest", "tests/test_catalogue.py", "-q", "-k", "q01 or f14 or k04", "-p", "no:cacheprovider"], cwd=tmp_path / "r", capture_output=True, check=True)


def test_all_operators_are_registered():
    if importlib.util.find_spec("tidemark.llm") is None:
        return
    _, operators, pipeline = counted(ROOT)
    assert (operators, pipeline) == ("10", "True")


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "event_id" in df.columns
