"""The entry points."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and {"utt", "cand_idx", "score", "chosen"} <= set(df.columns)


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_pipeline_folders(tmp_path):
    """The rest neither imports the subpackage nor needs the pipeline file."""
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    package = tmp_path / "voxmill"
    package.mkdir()
    for child in (ROOT / "voxmill").iterdir():
        if child.name not in ("llm", "__pycache__"):
            (package / child.name).symlink_to(child)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'score_log' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
