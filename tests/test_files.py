import io
import wave
import zipfile

import numpy as np
import pytest

from turnloom import schemas
from turnloom.operators import intervals
from turnloom.sinks import files
from turnloom.sources import audio, project, transcripts


def test_workbook_round_trip(tmp_path, spark):
    path = str(tmp_path / "a.xlsx")
    files.write_workbook(path, {"Sheet": [["Start", "Speaker", "Text"], [1.5, "Ann", "hi\x00 & <you>"], ["00:02", None, "Bob: yes"]]})
    assert transcripts.workbook(open(path, "rb").read(), None) == [(1.5, None, "Ann", "hi & <you>"), (2.0, None, "Bob", "yes")]
    got = transcripts.read(spark, {"zoom": path}, "p").collect()
    assert [(r["speaker"], r["text"]) for r in got] == [("Ann", "hi & <you>"), ("Bob", "yes")]
    with pytest.raises(ValueError):
        transcripts.Workbook(b"no zip")
    with pytest.raises(ValueError):
        transcripts.parser("x.pdf")


def test_time_cells():
    data = io.BytesIO()
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="urn:r"><sheets><sheet name="S" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="a" Target="worksheets/s.xml"/></R>')
        z.writestr("xl/styles.xml", f'<styleSheet {m}><numFmts><numFmt numFmtId="170" formatCode="[h]:mm:ss.000"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>Start</t></si><si><t>Text</t></si><si><t>hi</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {m}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" s="1"><v>{1 / 86400}</v></c><c r="C2" t="s"><v>2</v></c></row></sheetData></worksheet>')
    (row,) = transcripts.workbook(data.getvalue(), None)
    assert row[0] == pytest.approx(1.0) and row[3] == "hi"


def test_wav_to_silence(tmp_path, spark):
    path = str(tmp_path / "a.wav")
    x = np.concatenate([np.tile([8000, -8000], 500), np.zeros(1000), np.tile([8000, -8000], 500)]).astype("<i2")
    with wave.open(path, "wb") as f:
        f.setparams((1, 2, 1000, 0, "NONE", ""))
        f.writeframes(x.tobytes())
    s = audio.read(spark, path)
    (r,) = intervals.silent_runs(intervals.frames(s)).collect()
    assert (r["start_seconds"], r["end_seconds"], r["loudest_frame_dbfs"]) == (1.0, 2.0, None)
    assert audio.thinned(s).first()["rate"] == 1000
    with pytest.raises(ValueError):
        audio.samples(b"RIFF")


def test_project_documents(tmp_path, spark):
    t = schemas.turns(spark.createDataFrame([("p", 1, "hi")], "project_id string, turn_id int, final_text string"))
    meta = schemas.conform(spark.createDataFrame([("p", "T")], "project_id string, title string"), schemas.PROJECTS)
    tables = {"turns": t, "speech_events": spark.createDataFrame([], schemas.EVENTS), "segments": spark.createDataFrame([], schemas.SEGMENTS), "metadata": meta}
    path = files.save_project(str(tmp_path / "a"), tables, {}, {})
    assert path.endswith(project.SUFFIX)
    back = project.load(spark, path)
    assert back["turns"].first()["final_text"] == "hi" and back["metadata"].first()["title"] == "T"
    assert project.problems({"application_version": "0"}) and project.problems([]) == ["the document is not an object"]
    with pytest.raises(ValueError):
        schemas.check_exact(t.drop("notes"), schemas.TURNS)


def test_report():
    page = files.report("T<", {"turns": 2}, {"wer": None, "cer": 0.5}, [{"source": "Zoom", "wer": 0.25}], [])
    assert "T&lt;" in page and "N/A" in page and "0.250" in page


def test_training_append(tmp_path, spark):
    from turnloom.operators import learning, quality

    row = (4, learning.LABEL_TARGET, list(quality.FEATURES), [0.5] * 15, 1, 0.2, "a")
    new = spark.createDataFrame([row, row, row[:3] + ([float("nan")] * 15,) + row[4:6] + ("b",)], schemas.TRAINING)
    path = f"file://{tmp_path}/t"
    assert files.append_training(path, new) == 1 and files.append_training(path, new) == 0
    assert [r["example_id"] for r in spark.read.format("versioned").load(path).collect()] == ["a"]
