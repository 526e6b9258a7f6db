from cohortlens import cli
from cohortlens.sources.store import Store
from tests.registry_fixture import members


def test_build_query_and_funnel(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    for name, text in members():
        (tmp_path / "docs" / name).write_text(text)
    index = str(tmp_path / "index")
    assert cli.main(["build", str(tmp_path / "docs"), index]) == 0
    assert "n_failed" in capsys.readouterr().out
    assert cli.main(["sql", index, "SELECT asset_id, n_trials FROM v_programs WHERE condition_key = 'D001' AND asset_id = 'zolumab'", "--format", "csv"]) == 0
    assert "zolumab," in capsys.readouterr().out
    assert cli.main(["funnel", index]) == 0
    assert "pct_decided" in capsys.readouterr().out


def test_store(spark, tmp_path):
    s = Store(str(tmp_path))
    s.save_answer("a1", {"answer_md": "x"})
    s.add_turn("c1", {"question": "q", "answer_id": "a1", "retrieved": ["N1"], "seen_entities": ["e"]})
    s.add_turn("c1", {"question": "r", "retrieved": ["N2"]})
    assert s.answer("a1") == {"answer_md": "x"} and s.answer("a2") is None
    assert s.gate_sets("c1") == ({"N1", "N2"}, {"e"}) and s.digest("c1", 1) == "Q: r []"
    assert [(r.conversation, r.turn, r.retrieved) for r in s.all_turns(spark).orderBy("turn").collect()] == [("c1", 0, ["N1"]), ("c1", 1, ["N2"])]
