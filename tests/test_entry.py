import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"


def listed(root):
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=root, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr[-800:]
    return [set(eval(line)) for line in done.stdout.splitlines()[-2:]]


def copy(to, *gone):
    for name in ("lexaloom", "__spark_entry__.py", "corpus_pipeline.py"):
        where = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        if (ROOT / name).exists():
            where(ROOT / name, to / name)
    for name in gone:
        whole = to / name
        shutil.rmtree(whole, ignore_errors=True) if whole.is_dir() else whole.unlink(missing_ok=True)
    return to


def test_queries_without_the_optional_parts(tmp_path):
    """The core lists its queries whichever optional part is gone, and nothing else is hidden."""
    for i, gone in enumerate((("lexaloom/llm", "corpus_pipeline.py"), ("lexaloom/llm",))):
        names, oracles = listed(copy(tmp_path / str(i) if (tmp_path / str(i)).mkdir() is None else None, *gone))
        assert "bool_nested" in names and "term_frequency" in oracles
        assert not any(n.startswith("op") or n == "pipeline" for n in names | oracles)


def test_other_errors_show(tmp_path):
    copy(tmp_path)
    (tmp_path / "lexaloom/plans/queries.py").write_text("import no_such_module_at_all")
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module_at_all" in done.stderr
