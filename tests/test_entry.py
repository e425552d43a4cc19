"""The entry module keeps the cohort queries whatever happens to the optional ones."""

import importlib
import warnings

import pytest

import __spark_entry__ as E


@pytest.fixture
def failing(monkeypatch):
    """Makes importing a module fail with the given error."""
    real = importlib.import_module

    def fail(gone, error):
        monkeypatch.setattr(importlib, "import_module", lambda name, *a: (_ for _ in ()).throw(error) if name in gone else real(name, *a))

    yield fail
    monkeypatch.undo()
    importlib.reload(E)


@pytest.mark.parametrize("error", [ModuleNotFoundError("no tokenizers", name="public_tokenizers"), ImportError("half a module"), OSError("no file")])
def test_any_failure_leaves_the_cohort_queries_and_warns(failing, error):
    failing(("cohortlens.llm.queries", "corpus_pipeline"), error)
    with pytest.warns(UserWarning, match="left out"):
        entry = importlib.reload(E)
    names = list(entry.queries())
    assert "q05_posts_per_user_cohort_time" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]
    assert "q05_posts_per_user_cohort_time" in entry.oracle_sql()


def test_missing_folders_are_no_news(failing):
    failing(("cohortlens.llm.queries",), ModuleNotFoundError("gone", name="cohortlens.llm"))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        entry = importlib.reload(E)
    assert "clean_posts" in entry.queries() and "op1_embedding_dups" not in entry.queries()
