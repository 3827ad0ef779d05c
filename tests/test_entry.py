import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_llm():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "notefold"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"notefold\.llm", path.read_text()), path
