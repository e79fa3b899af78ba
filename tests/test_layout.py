import pathlib

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_outside_llm_imports_it():
    for path in (ROOT / "siltstone").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "siltstone.llm" not in path.read_text(), path


def test_no_local_checkpoints_or_row_udfs():
    for path in [*(ROOT / "siltstone").rglob("*.py")]:
        text = path.read_text()
        assert "localCheckpoint" not in text and "F.udf(" not in text and ".crossJoin(" not in text, path
