import json

from quillstream import cli, logs
from quillstream.schema import LAYOUT


def test_show_and_errors(capsys):
    assert cli.main(["show-config", "--set", "gate.min_recognition=0.7"]) == 0
    assert json.loads(capsys.readouterr().out)["gate"]["min_recognition"] == 0.7
    assert cli.main(["show-config", "--set", "gate.nothing=1"]) == 2


def test_validate(spark, tmp_path, capsys):
    (tmp_path / "q.txt").write_text("1\n2(a)\n")
    assert cli.main(["validate-questions", str(tmp_path / "q.txt")]) == 0
    assert capsys.readouterr().out.splitlines()[1].startswith("2(a) target NUM,ALPHA")
    (tmp_path / "q.txt").write_text("x\n")
    assert cli.main(["validate-questions", str(tmp_path / "q.txt")]) == 2


def test_run(spark, tmp_path):
    lines = [235 + 74 * i for i in range(20)]
    obs = spark.createDataFrame(
        [("s", "q", 1, 0, "Ans 1", 0.95, (10, 300, 60, 40), 1.0), ("s", "q", 2, 0, "2)", 0.5, (10, 300, 40, 40), 1.0)],
        "script_id string, exam_id string, page_index int, candidate_pos int, raw string, recognition_confidence double, box struct<x:int,y:int,width:int,height:int>, detection_confidence double",
    )
    pages = spark.createDataFrame(
        [("s", "q", p, "ANSWER", "PROCESSED", "NORMAL", 200.0, True, (True, 185, 235, lines, 74.0, "odd", 0.0, False), [0.01] * 20, 1488, 2576, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]) for p in (1, 2)],
        f"script_id string, exam_id string, page_index int, page_role string, processing_status string, content_class string, dpi double, is_colour boolean, layout {LAYOUT}, band_ink array<double>, image_width int, image_height int, work_to_canonical array<double>",
    )
    obs.write.parquet(str(tmp_path / "obs"))
    pages.write.parquet(str(tmp_path / "pages"))
    (tmp_path / "q.txt").write_text("1\n2\n3\n")
    args = ["run", str(tmp_path / "obs"), str(tmp_path / "pages"), str(tmp_path / "q.txt"), "--out", str(tmp_path / "out")]
    assert cli.main(args) == 0 and cli.main(args) == 0  # a second run replaces the first
    rows = spark.read.parquet(str(tmp_path / "out/markers")).orderBy("page_index").collect()
    assert [(r["question"], r["status"]) for r in rows] == [("1", "ACCEPTED"), ("2", "REVIEW_REQUIRED")]
    document = json.loads(spark.read.text(str(tmp_path / "out/documents")).first()[0])
    assert document["script_id"] == "s" and [p["markers"][0]["question"] for p in document["pages"]] == ["1", "2"]


def test_scan(spark, tmp_path, capsys):
    from test_images_and_sources import drawn

    from quillstream.config import Settings
    from quillstream.image import codec
    from quillstream.plans import scan as plan
    from quillstream.sources import engines

    folder = tmp_path / "images"
    folder.mkdir()
    pages = {1: drawn(), 2: drawn(marks=[(20, 400, 40, 50)]), 3: drawn(marks=[(20, 640, 40, 50), (20, 1010, 40, 50)])}
    for n, page in pages.items():
        (folder / f"s one-P{n:03d}.png").write_bytes(codec.png(page))
    (folder / "s one-P004.png").write_bytes(b"no image")
    (folder / "notes.png").write_bytes(b"not a page")
    (tmp_path / "q.txt").write_text("1\n2\n3\n")

    def maker():
        def model(crops):
            from quillstream.image import codec

            sizes = [codec.read(c).shape for c in crops]
            return [("Ans 2", 0.97) if h > w * 0.6 and w < 200 else ("", 0.1) for h, w in sizes]

        return model

    engines.register_engine("by size", maker)
    out = str(tmp_path / "out")
    settings = Settings()
    assert cli.scan(spark, str(folder), str(tmp_path / "q.txt"), out, settings, "by size", shown=True, overlays=True) == 1  # a page has failed
    printed = capsys.readouterr().out
    assert "SCRIPT s_one" in printed and "PAGES" in printed and "p004 ANSWER       FAILED_PERMANENT" in printed
    rows = spark.read.parquet(f"{out}/markers").orderBy("page_index", "marker_y").collect()
    found = [(r["page_index"], r["question"], r["status"]) for r in rows if r["status"] != "DISCARDED"]
    assert [(p, q) for p, q, _ in found] == [(2, "2"), (3, "2"), (3, "2")], rows
    assert all("DUPLICATE_IN_SCRIPT" in r["review_reasons"] for r in rows if r["status"] != "DISCARDED")
    assert abs(rows[0]["marker_y"] - 400) <= 3 and rows[0]["question_start_y"] is not None
    picture = codec.read((tmp_path / "out/s_one/overlays/page_002.png").read_bytes())
    assert picture.shape == (1288, 744, 3)
    # the text detector's path, over tiles
    box = [[20.0, 10.0], [62.0, 10.0], [62.0, 60.0], [20.0, 60.0]]
    other = cli.load_settings(None, {"detection": {"method": "text_detector"}})
    facts = spark.read.parquet(f"{out}/work/facts").where("page_index = 2")
    tiled = plan.observations(facts, other, "by size", "q", detector_options={"found": [(box, 0.8)]}).collect()
    height = codec.read(facts.first()["region"]).shape[0]
    assert [r["candidate_pos"] for r in sorted(tiled, key=lambda r: r["box"]["y"])] == list(range(1, len(tiled) + 1)) and len(tiled) == -(-(height - 296) // 222) + 1
    assert {(r["box"]["x"], r["box"]["width"], r["exam_id"], r["detection_confidence"]) for r in tiled} == {(20, 42, "q", 0.8)}
    assert sorted(r["box"]["y"] for r in tiled)[:2] == [facts.first()["region_top"] + 10, facts.first()["region_top"] + 232]


def test_json_logs(tmp_path):
    log = logs.configure("INFO", "json", str(tmp_path / "log"))
    log.info("page %d", 3, extra={"script_id": "s"})
    logs.configure()
    assert json.loads((tmp_path / "log").read_text())["message"] == "page 3"
