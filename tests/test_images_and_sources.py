"""Drawn pages, geometry, detection, sources, sinks and the stream of page results."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream import config
from quillstream.config import Detection, Settings, load_settings
from quillstream.functions import ctc, distance, geometry
from quillstream.image import codec, kernel
from quillstream.operators import detect
from quillstream.plans import markers, report, scan
from quillstream.sources import engines, files, sinks


def drawn(rule=185, pitch=74, lines=30, marks=(), red=()):
    page = np.full((2576, 1488, 3), 250, np.uint8)
    page[..., 0] = 246
    for i in range(lines):
        page[235 + i * pitch : 237 + i * pitch] = 150
    page[100:2500, rule - 1 : rule + 2] = 150
    for x, y, w, h in marks:
        page[y : y + h, x : x + 4] = page[y : y + h, x + w - 4 : x + w] = (120, 40, 30)
        for t in range(h):  # no level strokes, which would count as printed lines
            at = x + 2 + t * (w - 8) // h
            page[y + t, at : at + 5] = (120, 40, 30)
    for x, y, w, h in red:
        page[y : y + h, x : x + w] = (40, 40, 220)
    return page


@pytest.mark.parametrize("rule", [60, 100, 185])
def test_landmarks_with_a_header(rule):
    page = drawn(rule)
    page[:200] = np.where(page[:200] == 150, 250, page[:200])
    page[160:163] = 120  # a header rule above the first line
    page[:, :3] = 20  # the scan's dark edge
    marks = kernel.landmarks(page, 200.0, Settings().layout)
    assert marks["found"] and abs(marks["margin_rule_x"] - rule) <= 2 and abs(marks["header_y"] - 161) <= 2
    lines = marks["ruled_line_ys"]
    assert lines[0] == marks["header_y"] and abs(lines[1] - 235) <= 2 and abs(lines[-1] - (235 + 29 * 74)) <= 2


def test_rule_is_sought_in_the_left_quarter_only():
    settings = Settings().layout
    assert kernel.landmarks(drawn(340), 200.0, settings)["margin_rule_x"] is not None  # 23 % of the width
    assert kernel.landmarks(drawn(400), 200.0, settings) == {"found": False, "margin_rule_x": None, "header_y": 236, "ruled_line_ys": [], "line_pitch_px": None}
    short = drawn(185)
    short[100:2300, 184:188] = short[100:2300, 200:204]  # what is left is no long run
    assert kernel.landmarks(short, 200.0, settings)["margin_rule_x"] is None


def test_grid_stops_above_the_bottom():
    assert kernel.grid([100, 200, 302], 100.0, 0.25, None, 2000) == [100, 200, 302]
    assert kernel.grid([200, 302], 100.0, 0.25, 95, 2000) == [95, 200, 302]
    assert kernel.grid([100, 200, 300, 990], 100.0, 0.25, None, 1000) == [100, 200, 300, 400, 500, 600, 700, 800, 900]
    assert kernel.grid([], 100.0, 0.25, 50, 480) == [50, 150, 250, 350, 450] and kernel.grid([], 100.0, 0.25) == []


def test_crop_and_region():
    page = drawn(marks=[(20, 400, 40, 50)])
    s = Settings()
    marks = kernel.landmarks(page, 200.0, s.layout)
    margin = kernel.margin_region(kernel.gray(page), marks, 200.0, s)
    assert margin.top == marks["header_y"] + 16 and margin.gray.shape[1] == marks["margin_rule_x"] + 47
    assert (margin.gray[:, marks["margin_rule_x"] - 5 : marks["margin_rule_x"] + 6] == 255).all() and not margin.ink[:100].any()
    cut = kernel.crop(margin.gray, (20, 400 - margin.top, 40, 50), 200.0, 1.0)
    border = (50 + 16) // 4
    assert cut.shape == (50 + 16 + 2 * (border // 2), 40 + 16 + 2 * border) and (cut[:, :border] == 255).all()
    edge = kernel.crop(margin.gray, (0, 0, 10, 8), 200.0, 0.0)  # two pixels of padding at least, none beyond the strip
    assert edge.shape == (10 + 4, 12 + 8)


def test_valuer_boxes_close_gaps_but_do_not_grow():
    mask = np.zeros((200, 200), bool)
    mask[50:80, 20:50] = mask[50:80, 55:90] = True  # 5 pixels apart
    mask[150:156, 150:156] = True  # a speck that growing would carry over the limit
    assert kernel.valuer_boxes(mask, 200.0).tolist() == [[20, 50, 70, 30, 70 * 30]]


def test_deskew_map_leads_back():
    page = drawn(marks=[(20, 400, 40, 50)])
    tilted = kernel.rotated(page, 1.5)
    facts = kernel.page_facts(tilted, 200.0, Settings())
    assert facts["deskewed"]
    a, b, tx, c, d, ty = facts["work_to_canonical"]
    work = kernel.rotated(tilted, facts["skew_deg"])
    rng = np.random.default_rng(1)
    for x, y in zip(rng.integers(300, 1100, 20), rng.integers(400, 2100, 20)):
        u, v = a * x + b * y + tx, c * x + d * y + ty
        assert abs(int(work[y, x, 0]) - int(tilted[int(round(v)), int(round(u)), 0])) <= 110


def test_images_as_bytes():
    rng = np.random.default_rng(3)
    for shape in ((5, 7), (9, 4, 3), (1, 1)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (codec.read(codec.png(image)) == image).all()
    raw = rng.integers(0, 256, (6, 5 * 3), dtype=np.uint8)
    lines = []
    for y, kind in enumerate((0, 1, 2, 3, 4, 4)):  # every filter, as the format defines it
        line, above = raw[y].astype(int), raw[y - 1].astype(int) if y else np.zeros(15, int)
        left, corner = (np.concatenate((np.zeros(3, int), x[:-3])) for x in (line, above))
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = (np.zeros(15, int), left, above, (left + above) // 2, near, near)[kind]
        lines.append(np.concatenate(([kind], (line - guess) % 256)))
    assert (codec._unfiltered(np.array(lines).astype(np.uint8), 3) == raw).all()
    assert codec.read(b"P5\n# note\n2 1\n255\n\x01\x02").tolist() == [[1, 2]] and codec.read(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[3, 2, 1]]]
    for bad in (b"", b"P5 2 2 255\n\x01", codec.png(np.zeros((2, 2), np.uint8))[:40], codec.PNG):
        with pytest.raises(codec.ImageError):
            codec.read(bad)


def test_hashes_of_printed_pages(spark):
    page, blank = drawn(), np.full((2576, 1488, 3), 250, np.uint8)
    blank[600:1400, 200:900] = 60
    noisy = (page.astype(int) + np.random.default_rng(0).integers(-3, 4, page.shape)).clip(0, 255).astype(np.uint8)
    h = [kernel.perceptual_hash(x) for x in (blank, np.roll(blank, 4, 1), blank[:, ::-1])]
    assert bin((h[0] ^ h[1]) & (1 << 64) - 1).count("1") <= 6 < bin((h[0] ^ h[2]) & (1 << 64) - 1).count("1")
    assert isinstance(kernel.perceptual_hash(noisy), int)
    facts = spark.createDataFrame([("s", 1, "COVER", h[1]), ("s", 2, "COVER", h[2]), ("s", 3, "ANSWER", 5)], "script_id string, page_index int, page_role string, template_hash long")
    templates = spark.createDataFrame([("COVER", h[0])], "page_role string, template_hash long")
    got = {r["page_index"]: r["is_misplaced"] for r in scan.misplaced(facts, templates, 6).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_tiles_cover_the_region(spark):
    pages = spark.createDataFrame([("s", i, 200.0, h, p) for i, (h, p) in enumerate([(1000, 74.0), (296, 74.0), (297, 74.0), (5, 74.0), (700, None)])], "script_id string, page_index int, dpi double, region_height int, line_pitch_px double")
    got = {}
    for r in detect.tiles(pages, Detection()).orderBy("page_index", "tile").collect():
        got.setdefault(r["page_index"], []).append((r["top"], r["bottom"]))
    assert got == {0: [(0, 296), (222, 518), (444, 740), (666, 962), (888, 1000)], 1: [(0, 296)], 2: [(0, 296), (222, 297)], 4: [(0, 296), (222, 518), (444, 700)]}


def test_ctc_by_enumeration():
    import itertools

    rng = np.random.default_rng(5)
    frames = rng.random((5, 3))
    frames /= frames.sum(1, keepdims=True)
    want = {}
    for path in itertools.product(range(3), repeat=5):
        joined = tuple(k for k, _ in itertools.groupby(path) if k)
        want[joined] = want.get(joined, 0.0) + np.prod([frames[t, k] for t, k in enumerate(path)])
    for target, p in want.items():
        assert ctc.log_likelihood(frames, list(target)) == pytest.approx(np.log(p))
    assert ctc.log_likelihood(frames, [1] * 4) == -np.inf and ctc.log_likelihood(frames[:0], []) == 0.0


def test_ctc_prefers_the_right_target(spark):
    alphabet = "0123456789b()"
    rows = np.full((6, len(alphabet) + 1), 0.01)
    for t, c in enumerate("10b1"):
        rows[t, alphabet.index(c) + 1] = 0.8
    rows[4:, 0] = 0.9
    readings = spark.createDataFrame([(1, "E", rows.tolist())], "reading long, exam_id string, frames array<array<double>>")
    targets = spark.createDataFrame([("E", "10(b)(1)", ["10", "b", "1"]), ("E", "1", ["1"]), ("E", "x", ["x"])], "exam_id string, question string, segments array<string>")
    found = ctc.decided(ctc.scored(readings, targets, alphabet), Settings().resolution).first()
    assert found["question"] == "10(b)(1)" and found["outcome"] == "RESOLVED" and found["probability"] > 0.99


def test_estimated_confusions(spark):
    rows = [("l0", "10")] * 30 + [("10", "10")] * 10 + [("lo", "lo")] * 10 + [("1)", "1")] * 20 + [("a", "ab")] * 9 + [(None, "1"), ("z", "2")]
    got = {(r["observed"], r["expected"]): (r["n"], r["cost"]) for r in distance.estimated_confusions(spark.createDataFrame(rows, "observed string, expected string")).collect()}
    assert got == {("l", "1"): (30, 0.25), (")", ""): (20, 0.1)}


def test_job_states(spark):
    from quillstream.streaming import tracker

    events = {
        "a": ["QUEUED", "PROCESSING", "COMPLETED", "COMPLETED", "QUEUED"],
        "b": ["PROCESSING", "FAILED_RETRYABLE", "QUEUED", "PROCESSING", "FAILED_RETRYABLE", "QUEUED"],
        "c": ["COMPLETED", "PROCESSING"],
    }
    df = spark.createDataFrame([(j, i, s) for j, own in events.items() for i, s in enumerate(own)], "job_id string, seq int, status string")
    got = {r["job_id"]: (r["status"], r["attempts"], r["rejected"]) for r in tracker.job_states(df, 2).collect()}
    assert got == {"a": ("COMPLETED", 1, 1), "b": ("FAILED_PERMANENT", 2, 1), "c": ("PROCESSING", 1, 1)}


def test_other_scripts_of_a_bucket_survive(spark, tmp_path):
    schema = "script_id string, page_index int, marker_y int, processing_version string, status string"
    path = str(tmp_path / "m")
    sinks.write_markers(spark.createDataFrame([(f"s{i}", 1, 5, v, "ACCEPTED") for i in range(9) for v in ("v1", "v2")], schema), path, 2)
    sinks.write_markers(spark.createDataFrame([("s3", 1, 5, "v1", "DISCARDED"), ("s3", 2, 5, "v1", "DISCARDED")], schema), path, 2)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 19 and sorted(r["status"] for r in rows if r["script_id"] == "s3") == ["ACCEPTED", "DISCARDED", "DISCARDED"]
    path = str(tmp_path / "d")
    for own in ((("a", 1), ("b", 1)), (("a", 2),)):
        docs = spark.createDataFrame([(i, json.dumps({"script_id": i, "n": n})) for i, n in own], "script_id string, document string")
        sinks.write_documents(docs, path, "v")
    assert sorted(json.loads(r[0])["n"] for r in spark.read.text(path).collect()) == [1, 2]


@pytest.mark.parametrize("rule", [100, 185])
def test_landmarks(rule):
    facts = kernel.page_facts(drawn(rule, marks=[(20, 400, 40, 50)], red=[(70 if rule > 150 else 60, 1000, 20, 40)]), 200.0, Settings())
    assert facts["found"] and abs(facts["margin_rule_x"] - rule) <= 2
    assert abs(facts["ruled_line_ys"][0] - 235) <= 2 and abs(facts["line_pitch_px"] - 74) <= 1 and facts["is_colour"]
    assert [c for c in facts["candidates"] if abs(c[0] - 20) <= 2 and abs(c[1] - 400) <= 2 and abs(c[2] - 40) <= 3]
    assert not [c for c in facts["candidates"] if 990 < c[1] < 1050] and facts["valuer_boxes"]


def test_blank_page_has_no_landmarks():
    facts = kernel.page_facts(np.full((800, 600, 3), 255, np.uint8), 100.0, Settings())
    assert not facts["found"] and facts["candidates"] == [] and facts["components"] == 0 and not facts["is_colour"]


def test_components_by_flood_fill():
    rng = np.random.default_rng(2)
    mask = rng.random((30, 40)) < 0.35
    seen, want = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            stack, cells = [(y, x)], []
            seen[y, x] = True
            while stack:
                a, b = stack.pop()
                cells.append((a, b))
                for c in range(max(0, a - 1), min(30, a + 2)):
                    for d in range(max(0, b - 1), min(40, b + 2)):
                        if mask[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            stack.append((c, d))
            ys, xs = zip(*cells)
            want.append([min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(cells)])
    assert sorted(kernel.components(mask).tolist()) == sorted(want)


def test_runs_and_turns():
    mask = np.array([[1, 1, 0, 1, 1, 1, 1], [0, 1, 1, 1, 0, 0, 1]], bool)
    assert kernel.open_runs(mask, 3, 1).astype(int).tolist() == [[0, 0, 0, 1, 1, 1, 1], [0, 1, 1, 1, 0, 0, 0]]
    page = drawn()
    tilted = kernel.rotated(page, 2.0)
    assert abs(abs(kernel.skew_degrees(tilted, 200.0, Settings().layout)) - 2.0) < 0.4
    assert kernel.turned(page, 90).shape[:2] == (1488, 2576) and kernel.normalised(page[..., 0]).shape == page.shape


def test_pages_run_in_workers(spark):
    page = drawn(marks=[(20, 400, 40, 50)])
    df = spark.createDataFrame([("s", 3, bytearray(page.tobytes()), *page.shape[:2], 200.0)], "script_id string, page_index int, data binary, image_height int, image_width int, dpi double")
    row = kernel.analysed(df, Settings()).first()
    assert row["found"] and row["page_index"] == 3 and len(row["candidates"]) >= 1


def test_geometry(spark):
    one = spark.range(1)
    a, b = geometry.box(*map(F.lit, (0, 0, 10, 10))), geometry.box(*map(F.lit, (5, 0, 10, 10)))
    back = geometry.affine(geometry.inverse(geometry.translation(F.lit(-20), F.lit(-500))), F.lit(42), F.lit(118))
    quarter = F.array(*map(F.lit, (0.0, -1.0, 0.0, 1.0, 0.0, 0.0)))
    turned = geometry.polygon_box(geometry.mapped_polygon(quarter, geometry.corners(geometry.box(*map(F.lit, (0, 0, 20, 5))))))
    r = one.select(
        geometry.iou(a, b).alias("iou"), geometry.hull(a, b).alias("hull"), back.alias("back"), turned.alias("turned"), geometry.mm_to_px(25.4, 200.0).alias("px"),
        geometry.clamp(geometry.box(*map(F.lit, (-5, -5, 20, 20))), F.lit(10), F.lit(10)).alias("clamped"),
    ).first()
    assert r["iou"] == pytest.approx(50 / 150) and (r["hull"]["x"], r["hull"]["width"]) == (0, 15) and r["px"] == 200
    assert tuple(r["back"]) == (62.0, 618.0) and (r["turned"]["width"], r["turned"]["height"]) == (5, 20) and tuple(r["clamped"]) == (0, 0, 10, 10)


BOXES = "script_id string, page_index int, candidate_pos int, band int, box struct<x:int,y:int,width:int,height:int>, detection_confidence double, polygon array<array<double>>"


def test_merge_equals_greedy_merge(spark):
    rng = random.Random(7)
    rows = [("s", p, i, rng.randrange(3), (rng.randrange(120), rng.randrange(40), rng.randint(1, 25), rng.randint(1, 20)), 0.5 + i / 100, None) for p in range(30) for i in range(rng.randint(1, 9))]
    got = sorted((r["page_index"], r["band"], *r["box"]) for r in detect.merge_by_line(spark.createDataFrame(rows, BOXES), 6).collect())
    want = []
    for p in range(30):
        items = [(r[3], list(r[4])) for r in rows if r[1] == p]
        i = 0
        while i < len(items):
            for j in range(i + 1, len(items)):
                (ba, a), (bb, b) = items[i], items[j]
                if ba == bb and max(a[0], b[0]) - min(a[0] + a[2], b[0] + b[2]) <= 6:
                    x, y = min(a[0], b[0]), min(a[1], b[1])
                    items[i] = (ba, [x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y])
                    del items[j]
                    i = -1
                    break
            i += 1
        want += [(p, b, *x) for b, x in items]
    assert got == sorted(want)


def test_suppression_and_overlap(spark):
    rows = [("s", 1, 0, 0, (0, 0, 10, 10), 0.9, None), ("s", 1, 1, 0, (1, 0, 10, 10), 0.8, None), ("s", 1, 2, 0, (40, 0, 10, 10), 0.7, None)]
    df = spark.createDataFrame(rows, BOXES)
    assert sorted(r["candidate_pos"] for r in detect.suppressed(df, Detection()).collect()) == [0, 2]
    assert sorted(r["fragments"] for r in detect.merge_by_overlap(df, 6).collect()) == [1, 2]
    single = detect.merge_by_line(spark.createDataFrame([("s", 1, 0, 0, (0, 0, 9, 9), 0.9, [[0.0, 1.0]])], BOXES), 6).first()
    assert single["polygon"] == [[0.0, 1.0]]


def test_settings(tmp_path):
    (tmp_path / "s.yaml").write_text("gate:\n  min_recognition: 0.7\napp:\n  output_root: here\n")
    (tmp_path / ".env").write_text("QUILL_GATE__MIN_ADJUSTED=0.95\nQUILL_GATE__MIN_RECOGNITION=0.75\n")
    s = load_settings(str(tmp_path / "s.yaml"), {"triage": {"blank_max": 3}}, {"QUILL_GATE__MIN_RECOGNITION": "0.78"}, str(tmp_path / ".env"))
    assert (s.gate.min_recognition, s.gate.min_adjusted, s.triage.blank_max, s.app.output_root) == (0.78, 0.95, 3, "here")
    assert s.processing_version() == load_settings(str(tmp_path / "s.yaml"), {"triage": {"blank_max": 3}, "app": {"output_root": "there"}}, {"QUILL_GATE__MIN_RECOGNITION": "0.78"}, str(tmp_path / ".env")).processing_version()
    for bad in ({"nothing": 1}, {"gate": {"min_adjusted": 0.1}}, {"detection": {"merge_gap_mm": -1}}, {"layout": {"min_pitch_mm": 20}}, {"gate": {"min_margin": "x"}}):
        with pytest.raises(config.ConfigError):
            load_settings(overrides=bad, env={})


def test_files(spark, tmp_path):
    (tmp_path / "b 1.PDF").write_bytes(b"two")
    (tmp_path / "a.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_text("x")
    found = files.pdf_files(spark, str(tmp_path))
    assert [r["script_id"] for r in found.collect()] == ["a", "b_1"]

    def count(data):
        if data == b"bad":
            raise ValueError("not a file")
        return 2

    calls = []

    def load(data, page, dpi):
        calls.append(page)
        return b"\0\0\0", 1, 1, dpi, "rendered"

    files.register_decoder("fake", count, load)
    pages = files.page_numbers(found, "fake")
    rows = sorted((r["script_id"], r["page_index"], r["error_code"]) for r in pages.collect())
    assert rows[0][2].startswith("PDF_READ_ERROR") and [r[1] for r in rows] == [0, 1, 2]
    read, skipped = markers.pruned(markers.with_roles(pages.where("page_index > 0"), Settings(booklet=config.Booklet(page_roles={1: "COVER"}))))
    out = files.decoded(read, "fake").collect()
    assert [r["page_index"] for r in out] == [2] and skipped.first()["processing_status"] == "SKIPPED_BY_ROLE"


def test_attempts():
    tries = []

    def fail(error):
        tries.append(1)
        raise error

    assert files.attempted(lambda: 5, 2) == (5, "PROCESSED", None, None)
    assert files.attempted(lambda: fail(OSError("x")), 3)[1] == "FAILED_RETRYABLE" and len(tries) == 3
    assert files.attempted(lambda: fail(files.PdfReadError("x")), 3)[1:3] == ("FAILED_PERMANENT", "PDF_READ_ERROR")
    assert files.attempted(lambda: fail(KeyError("x")), 3)[2] == "UNEXPECTED_ERROR" and len(tries) == 5


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\n2 # two\n\n# none\n4(a)\n")
    (tmp_path / "b.yaml").write_text("exam_id: E\nversion: 7\nquestions:\n  - 1\n  - {id: '10(b)', target: true}\nanswering_rules: {min_answers: 1, max_answers: 2}\n")
    entries, _ = files.vocabulary_file(spark, str(tmp_path / "a.txt"))
    assert [r["raw"] for r in entries.orderBy("ord").collect()] == ["1", "2", "4(a)"] and entries.first()["version"].startswith("sha256:")
    entries, rules = files.vocabulary_file(spark, str(tmp_path / "b.yaml"))
    assert entries.where("explicit_target").first()["raw"] == "10(b)" and tuple(rules.first()) == ("E", 1, 2)
    assert sorted(r["raw"] for r in files.vocabulary_lines(spark, str(tmp_path / "a.txt")).collect()) == ["1", "2", "4(a)"]
    (tmp_path / "c.csv").write_text("1")
    with pytest.raises(ValueError):
        files.vocabulary_file(spark, str(tmp_path / "c.csv"))
    (tmp_path / "c.json").write_text(json.dumps({"points": [[0.8, 0.5], [0, 0]]}))
    assert files.calibration_file(str(tmp_path / "c.json")) == [(0.0, 0.0), (0.8, 0.5)]
    for points in ([(0, 0)], [(0, 1), (1, 0)]):
        with pytest.raises(ValueError):
            files.checked_points(points)


def test_engine_must_answer_for_every_crop(spark):
    crops = spark.createDataFrame([("s", 1, i, bytearray([i])) for i in range(5)], "script_id string, page_index int, candidate_pos int, crop binary")
    got = engines.recognised(crops, "scripted", 2, texts={bytes([3]): ("Ans 3", 0.9)}).orderBy("candidate_pos").collect()
    assert [r["raw"] for r in got] == ["", "", "", "Ans 3", ""]
    engines.register_engine("short", lambda: lambda images: [])
    with pytest.raises(Exception, match="one text for each crop"):
        engines.recognised(crops, "short").collect()


def test_sinks_replace(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1, 5, "v1", "ACCEPTED"), ("s2", 1, 5, "v1", "ACCEPTED")], "script_id string, page_index int, marker_y int, processing_version string, status string")
    for _ in range(2):
        sinks.write_markers(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    row = sinks.run_manifest(spark, Settings(), markers.Engine(), False, 1.5).first()
    assert json.loads(row["settings"])["gate"]["min_recognition"] == 0.8
    assert report.exit_code(spark.createDataFrame([("PROCESSED",)], "processing_status string")) == 0
    assert report.exit_code(spark.createDataFrame([("FAILED_PERMANENT",)], "processing_status string")) == 1


def test_human_rows_win(spark):
    auto = spark.createDataFrame([("m1", "1", "ACCEPTED", [], "AUTOMATIC"), ("m2", "2", "ACCEPTED", [], "AUTOMATIC")], "marker_result_id string, question string, status string, review_reasons array<string>, source string")
    reviews = spark.createDataFrame([("m1", "CORRECT", {"question": "3"}, "2024-01-02"), ("m1", "REJECT", {}, "2024-01-01")], "marker_result_id string, action string, corrected map<string,string>, reviewed_at string")
    got = {r["marker_result_id"]: r for r in markers.effective(auto, reviews).collect()}
    assert (got["m1"]["question"], got["m1"]["source"], got["m1"]["review_reasons"]) == ("3", "REVIEWER_CORRECTED", ["HUMAN_VS_REPROCESS_CONFLICT"])
    assert got["m2"]["question"] == "2"


def test_completed_scripts(spark, tmp_path):
    from quillstream.streaming import tracker

    rows = [("a", 1, 2, "PROCESSED"), ("a", 2, 2, "FAILED_PERMANENT"), ("b", 1, 2, "PROCESSED"), ("a", 1, 2, "PROCESSED")]
    schema = "script_id string, page_index int, page_count int, processing_status string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = tracker.completed_scripts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    # a query that waits for timeouts never ends by itself
    q = stream.writeStream.format("memory").queryName("done_scripts").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    for _ in range(120):
        if spark.table("done_scripts").count():
            break
        time.sleep(0.5)
    q.stop()
    assert [tuple(r) for r in spark.table("done_scripts").collect()] == [("a", 2, 1, True)]


def test_grid_expression_equals_the_walk(spark):
    from quillstream.operators import layout

    rng = random.Random(5)
    rows = []
    for i in range(80):
        seen = sorted({200 + 74 * k + rng.randint(-6, 6) for k in range(rng.randint(1, 25)) if rng.random() < 0.7} | ({200} if i % 4 else set()))
        rows.append((i, seen, rng.choice([None, 126, 200]), rng.choice([None, 900, 1900])))
    df = spark.createDataFrame(rows, "id int, seen array<int>, header int, height int")
    lines = layout.completed_grid(F.col("seen"), F.lit(74.0), Settings().layout, F.col("header"), F.col("height"))
    got = df.select("id", lines.alias("lines")).orderBy("id").collect()
    assert [r["lines"] or [] for r in got] == [kernel.grid(seen, 74.0, 0.25, header, height) for _, seen, header, height in rows]
