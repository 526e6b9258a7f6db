from cohortlens.streaming.ingest import ingest_stream, latest_studies
from tests.registry_fixture import members, study


def test_new_files_replace_a_study(spark, tmp_path):
    import json

    landing, out, mark = tmp_path / "landing", str(tmp_path / "out"), str(tmp_path / "mark")
    landing.mkdir()
    for name, text in members():
        (landing / name).write_text(text)
    ingest_stream(spark, str(landing), out, mark).awaitTermination(120)
    (landing / "again.json").write_text(json.dumps(study(1, title="A newer title")))
    ingest_stream(spark, str(landing), out, mark).awaitTermination(120)
    got = {r.nct_id: r.brief_title for r in latest_studies(spark, out).collect()}
    assert len(got) == 10 and got["NCT00000001"] == "A newer title"
