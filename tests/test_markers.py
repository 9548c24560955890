"""Grammar, resolver, gate and consolidation on small tables, and the recorded run end to end."""

import pytest
from pyspark.sql import functions as F

from quillstream.config import Gate, Grammar, Resolution, Settings
from quillstream.functions import distance, text
from quillstream.operators import consolidate, gate, grammar, resolve, vocabulary
from quillstream.plans import markers as plan
from quillstream.schema import EXAM_RULES, LAYOUT, VOCABULARY_ENTRIES

# Readings with what they must give, and a list of identifiers.
MARKERS = [
    ("10b1", "10b1"), ("10.b.1", "10b1"), ("10 b 1", "10b1"), ("10-b-1", "10b1"), ("10b1)", "10b1"), ("(10b1)", "10b1"),
    ("10 (b) (1)", "10b1"), ("Ans 10b1", "10b1"), ("Ans. 10(b)(1)", "10b1"), ("Q10b1", "10b1"), ("Q.No 10 b 1", "10b1"),
    ("QNo10b1)", "10b1"), ("5(a)(ii)", "5aii"), ("Ans 5.", "5"), ("3).", "3"), ("QN.7)", "7"), ("②", "2"), ("Ans 5。", "5"),
    ("Ans ５", "5"), ("Ans 8. f", "8f"),
]
OTHERS = [
    ("Q.No.", "PREFIX_ONLY"), ("No", "PREFIX_ONLY"), ("ANo", "PREFIX_ONLY"), ("LNo.", "PREFIX_ONLY"), ("Ans १२", "PREFIX_ONLY"),
    *((x, "NOT_A_MARKER") for x in ("Section B", "", "り", "一", "Section 2", "9880314362", "१२", "३)", "೫", None)),
]
MULTILEVEL = ["1", "2", "3", "4(a)", "4(b)", "5(a)(i)", "5(a)(ii)", ("10(b)", True), "10(b)(1)", "10(b)(2)"]


def entries(spark, items, exam="TEST"):
    rows = [(exam, "1", i, *(x if isinstance(x, tuple) else (x, None))) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, VOCABULARY_ENTRIES)


def parse(spark, rows):
    df = spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate(rows)], "id int, raw string, edge boolean")
    return grammar.parse(text.normalised(df, "raw"), Grammar(), F.col("edge")).orderBy("id").collect()


def test_grammar_markers(spark):
    found = parse(spark, [(t, False) for t, _ in MARKERS])
    assert [(r["kind"], "".join(r["segments"])) for r in found] == [("MARKER", s) for _, s in MARKERS]


def test_grammar_others(spark):
    found = parse(spark, [(t, False) for t, _ in OTHERS])
    assert [r["kind"] for r in found] == [k for _, k in OTHERS]


def test_grammar_prefix_flags_and_variants(spark):
    a, b, c, d, e, f, g = parse(spark, [("QNo6)", False), ("s 1.", False), ("63.", True), ("63.", False), ("Ans 8. From", False), ("Ans 8. f", False), ("(N.7)", False)])
    assert (a["prefix"], a["parse_flags"]) == ("QNO", [])
    assert b["parse_flags"] == ["PREFIX_RESIDUE"] and g["parse_flags"] == ["PREFIX_RESIDUE"] and g["segments"] == ["7"]
    assert [v["segments"] for v in c["variants"]] == [["63"], ["3"]]
    assert [v["segments"] for v in d["variants"]] == [["63"]]
    assert e["segments"] == ["8"] and e["parse_flags"] == ["LINE_TRIMMED"]
    assert [v["segments"] for v in f["variants"]] == [["8", "f"], ["8"]]


def run_resolver(spark, items, rows):
    df = spark.createDataFrame([(i, "TEST", t, e) for i, (t, e) in enumerate(rows)], "id int, exam_id string, raw string, edge boolean")
    parsed = grammar.parse(text.normalised(df, "raw"), Grammar(), F.col("edge"))
    return resolve.resolve(parsed, vocabulary.validated(entries(spark, items)), Resolution()).orderBy("id").collect()


def test_resolver(spark):
    a, b, c, d = run_resolver(spark, MULTILEVEL, [("Ans 10 b1)", False), ("10(b)", False), ("77", False), ("10 6 1", False)])
    assert (a["outcome"], a["method"], a["question"]) == ("RESOLVED", "EXACT_UNIQUE", "10(b)(1)")
    assert b["question"] == "10(b)" and c["outcome"] == "NO_MATCH" and d["outcome"] == "AMBIGUOUS" and d["question"] is None
    assert [x["question_id"] for x in c["candidates"]] and len(c["candidates"]) == 5
    e, f, g = run_resolver(spark, [str(i) for i in range(1, 9)], [("51", False), ("63.", True), ("821", True)])
    assert (e["method"], e["question"]) == ("CONSTRAINED_UNIQUE", "5")
    assert f["question"] == "3" and f["resolution_flags"] == ["NOISE_STRIPPED"] and f["resolution_confidence"] < 1
    assert g["question"] is None
    (h,) = run_resolver(spark, ["9", "10(b)(1)", "12(c)(2)"], [("10 6 1", False)])
    assert (h["method"], h["question"]) == ("CONSTRAINED_UNIQUE", "10(b)(1)")
    (i,) = run_resolver(spark, [str(i) for i in range(1, 13)], [("12", True)])
    assert (i["method"], i["question"]) == ("EXACT_UNIQUE", "12")
    (j,) = run_resolver(spark, ["1(1)", "11", "2"], [("11", False)])
    assert j["question"] == "11" and j["is_confusable"]


def plain_distance(a, b):
    subs, dels = distance.folded_costs(Resolution().confusions)
    row = [float(j) for j in range(len(b) + 1)]
    for o in a:
        d, new = dels.get(o, 1.0), [row[0] + dels.get(o, 1.0)]
        for j, t in enumerate(b, 1):
            new.append(min(row[j] + d, new[-1] + 1, row[j - 1] + (0 if o == t else subs.get(o + t, 1.0))))
        row = new
    return row[-1]


def test_weighted_distance_equals_plain_recurrence(spark):
    import random

    rng = random.Random(3)
    pairs = [("5", "5"), ("s", "5"), ("51", "5"), ("x", "5"), ("", ""), ("", "ab"), ("ab", "")]
    pairs += [tuple("".join(rng.choice("0156789bdisogzqltj)") for _ in range(rng.randint(0, 7))) for _ in range(2)) for _ in range(150)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(distance.weighted_distance(F.col("a"), F.col("b"), Resolution()).alias("d")).collect()
    assert [r["d"] for r in got] == pytest.approx([plain_distance(a, b) for a, b in pairs])


def test_vocabulary(spark):
    rows = {r["canonical"]: r for r in vocabulary.validated(entries(spark, MULTILEVEL)).collect()}
    assert rows["5(a)(ii)"]["segment_types"] == ["NUM", "ALPHA", "ROMAN"] and rows["5(a)(i)"]["segment_types"] == ["NUM", "ALPHA", "ROMAN"]
    assert rows["4(a)"]["segment_types"] == ["NUM", "ALPHA"] and rows["10(b)"]["is_target"]
    rows = {r["canonical"]: r for r in vocabulary.validated(entries(spark, ["10(a)", "10", "11"])).collect()}
    assert not rows["10"]["is_target"]
    rows = {r["canonical"]: r for r in vocabulary.validated(entries(spark, ["1(1)", "11", "2"])).collect()}
    assert rows["11"]["confusable_with"] == ["1(1)"] and rows["2"]["confusable_with"] == []
    assert [r["canonical"] for r in vocabulary.build(entries(spark, ["10.b.1", "10-b-2"])).orderBy("ord").collect()] == ["10(b)(1)", "10(b)(2)"]


@pytest.mark.parametrize("items", [["10(b)(1)", "10.b.1"], [""], ["a1"], ["Q1"], ["10(bb)"], ["10#b"], [], ["१२"], [("1", False)]])
def test_invalid_vocabularies(spark, items):
    with pytest.raises(vocabulary.VocabularyError):
        vocabulary.validated(entries(spark, items))


def test_invalid_rules(spark):
    with pytest.raises(vocabulary.VocabularyError):
        vocabulary.validated(entries(spark, ["1"]), spark.createDataFrame([("TEST", 3, 1)], EXAM_RULES))


GATE = "id int, kind string, discard_reason string, outcome string, method string, resolution_margin double, is_confusable boolean, position_valid boolean, recognition_confidence double, flags array<string>, landmarks_found boolean, is_colour boolean, start_method string, start_confidence double"


def test_gate(spark):
    def row(i, conf=0.95, flags=(), outcome="RESOLVED", colour=True, confusable=False, found=True, method="LANDMARK_LINE", start=0.95, discard=None, kind="MARKER"):
        return (i, kind, discard, outcome, "EXACT_UNIQUE", 0.5, confusable, True, conf, list(flags), found, colour, method, start)

    rows = [
        row(0), row(1, 0.5), row(2, 0.85), row(3, 0.85, ["NOISE_STRIPPED"]), row(4, 0.85, colour=False), row(5, outcome="NO_MATCH"),
        row(6, outcome="AMBIGUOUS"), row(7, found=False, method="FALLBACK_OFFSET"), row(8, confusable=True), row(9, start=0.3),
        row(10, kind="PREFIX_ONLY"), row(11, discard="HEADER_TOKEN"),
    ]
    got = gate.decide(spark.createDataFrame(rows, GATE), Gate()).orderBy("id").collect()
    assert [(r["status"], r["review_reasons"]) for r in got] == [
        ("ACCEPTED", []), ("REVIEW_REQUIRED", ["LOW_RECOGNITION_CONFIDENCE"]), ("ACCEPTED", []),
        ("REVIEW_REQUIRED", ["LOW_RECOGNITION_CONFIDENCE"]), ("REVIEW_REQUIRED", ["LOW_RECOGNITION_CONFIDENCE"]), ("UNRESOLVED", ["NO_MATCH"]),
        ("REVIEW_REQUIRED", ["AMBIGUOUS"]), ("REVIEW_REQUIRED", ["LANDMARKS_NOT_FOUND"]), ("REVIEW_REQUIRED", ["AMBIGUOUS"]),
        ("REVIEW_REQUIRED", ["START_UNCERTAIN"]), ("UNRESOLVED", ["PREFIX_WITHOUT_ID"]), ("DISCARDED", []),
    ]


def consolidated(spark, marks, pages, minimum=None, maximum=None):
    words = vocabulary.build(entries(spark, [str(i) for i in range(1, 9)]))
    rules = spark.createDataFrame([("TEST", minimum, maximum)], EXAM_RULES)
    m = spark.createDataFrame([("s", "TEST", p, i, y, q, st, []) for i, (p, y, q, st) in enumerate(marks)], "script_id string, exam_id string, page_index int, candidate_pos int, marker_y int, question string, status string, review_reasons array<string>")
    p = spark.createDataFrame([("s", "TEST", i, "ANSWER", status, content) for i, status, content in pages], "script_id string, exam_id string, page_index int, page_role string, processing_status string, content_class string")
    return consolidate.flagged(m, words, rules).orderBy("page_index", "marker_y").collect(), consolidate.script_flags(p, m, words, rules).first()


def test_consolidation(spark):
    written = [(3, "PROCESSED", "NORMAL"), (4, "PROCESSED", "NORMAL"), (5, "PROCESSED", "NORMAL")]
    rows, script = consolidated(spark, [(3, 10, "1", "ACCEPTED"), (4, 10, "2", "ACCEPTED"), (4, 900, "3", "ACCEPTED")], written)
    assert script["flags"] == [] and {r["status"] for r in rows} == {"ACCEPTED"}
    rows, script = consolidated(spark, [(3, 10, "1", "ACCEPTED"), (4, 10, "3", "ACCEPTED"), (5, 10, "1", "ACCEPTED")], written)
    assert script["flags"] == ["DUPLICATE_QUESTION", "OUT_OF_ORDER"]
    assert script["flag_details"] == ["Question 1 appears 2 times (pages 3, 5)", "Question 1 (page 5) after 3 (page 4)"]
    assert [r["review_reasons"] for r in rows] == [["DUPLICATE_IN_SCRIPT"], ["OUT_OF_ORDER"], ["DUPLICATE_IN_SCRIPT", "OUT_OF_ORDER"]]
    assert [r["question"] for r in rows] == ["1", "3", "1"]
    rows, script = consolidated(spark, [(3, 10, "1", "ACCEPTED")], written, 3)
    assert script["flags"] == ["ANSWER_COUNT_MISMATCH"] and rows[0]["status"] == "REVIEW_REQUIRED"
    assert script["flag_details"] == ["1 distinct questions found; rules allow 3..-"]
    pages = [(3, "PROCESSED", "NORMAL"), (4, "PROCESSED", "NORMAL"), (5, "FAILED_PERMANENT", None)]
    _, script = consolidated(spark, [(4, 10, "2", "ACCEPTED")], pages)
    assert script["flags"] == ["POSSIBLE_MISSED_MARKER", "INCOMPLETE"] and script["flag_details"][1] == "Pages failed: [5]"
    _, script = consolidated(spark, [], [(3, "PROCESSED", "NORMAL"), (4, "PROCESSED", "BLANK")])
    assert script["flags"] == ["NO_MARKERS"]


# script, page, raw, confidence, box, question, status, resolution confidence, method, reasons, flags
RECORDED = """
Doc0697|3|1)|0.45|34,497,18,55|1|R|1.00|EXACT_UNIQUE|LOW_RECOGNITION_CONFIDENCE|
Doc0697|4|2|0.99|24,562,35,70|2|A|1.00|EXACT_UNIQUE||
Doc0697|5|3).|0.92|0,1007,64,73|3|A|1.00|EXACT_UNIQUE||
Doc0697|7|25).|0.74|0,415,68,61|5|R|0.85|EXACT_UNIQUE|LOW_RECOGNITION_CONFIDENCE|NOISE_STRIPPED
Doc0697|9|N00)|0.62|0,424,93,78|?1|U|0.00|NONE|NO_MATCH|PREFIX_RESIDUE
Doc0697|12|aN.7)|0.62|15,416,141,46|7|R|1.00|EXACT_UNIQUE|LOW_RECOGNITION_CONFIDENCE|
Doc0697|14|No|0.87|40,335,110,59|-|U||NONE|PREFIX_WITHOUT_ID|
Doc0711|3|1|0.80|0,425,32,31|1|R|1.00|EXACT_UNIQUE|DUPLICATE_IN_SCRIPT|
Doc0711|3|n82|0.98|0,2132,53,38|2|A|0.85|EXACT_UNIQUE||PREFIX_RESIDUE,NOISE_STRIPPED
Doc0711|5|63.|0.89|0,282,51,34|3|R|0.85|EXACT_UNIQUE|LOW_RECOGNITION_CONFIDENCE|NOISE_STRIPPED
Doc0711|6|Ans 5|0.84|46,415,105,44|5|R|1.00|EXACT_UNIQUE|OUT_OF_ORDER|
Doc0711|7|186|1.00|0,413,52,39|?6|U|0.53|NONE|NO_MATCH|
Doc0711|8|1|0.77|85,2100,73,78|1|R|1.00|EXACT_UNIQUE|LOW_RECOGNITION_CONFIDENCE,DUPLICATE_IN_SCRIPT,OUT_OF_ORDER|
Doc0711|9|67|0.77|0,653,42,36|7|R|0.85|EXACT_UNIQUE|LOW_RECOGNITION_CONFIDENCE|NOISE_STRIPPED
Doc0711|10|Ans8|0.92|40,1239,104,48|8|A|1.00|EXACT_UNIQUE||
""".strip().split("\n")


def test_recorded_run(spark, tmp_path):
    rows = [r.split("|") for r in RECORDED]
    obs = spark.createDataFrame(
        [(r[0], "TEST", int(r[1]), i, r[2], float(r[3]), tuple(map(int, r[4].split(","))), 1.0) for i, r in enumerate(rows)],
        "script_id string, exam_id string, page_index int, candidate_pos int, raw string, recognition_confidence double, box struct<x:int,y:int,width:int,height:int>, detection_confidence double",
    )
    lines = list(range(235, 2500, 74))
    layout = (True, 185, 235, lines, 74.0, "odd", 0.0, False)
    keys = sorted({(r[0], int(r[1])) for r in rows})
    pages = spark.createDataFrame(
        [(s, p, "TEST", "ANSWER", "PROCESSED", "NORMAL", 200.0, True, layout, [0.01] * len(lines), 1488, 2576, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]) for s, p in keys],
        f"script_id string, page_index int, exam_id string, page_role string, processing_status string, content_class string, dpi double, is_colour boolean, layout {LAYOUT}, band_ink array<double>, image_width int, image_height int, work_to_canonical array<double>",
    )
    words = vocabulary.build(entries(spark, [str(i) for i in range(1, 9)]))
    rules = spark.createDataFrame([("TEST", 1, 8)], EXAM_RULES)
    done = plan.assembled(plan.classified(obs, pages, words, Settings()), pages, Settings())
    done.write.parquet(str(tmp_path / "markers"))  # checks across pages read a finished table
    done = spark.read.parquet(str(tmp_path / "markers"))
    got = {r["candidate_pos"]: r for r in consolidate.flagged(done, words, rules).collect()}
    status = {"A": "ACCEPTED", "R": "REVIEW_REQUIRED", "U": "UNRESOLVED"}
    for i, (_, _, raw, _, _, question, st, conf, method, reasons, flags) in enumerate(rows):
        r = got[i]
        best = r["candidate_list"][0]["question_id"] if r["candidate_list"] else None
        shown = r["question"] or (f"?{best}" if best else "-")
        assert (shown, r["status"], r["resolution_method"]) == (question, status[st], method), raw
        assert r["review_reasons"] == [x for x in reasons.split(",") if x], raw
        assert r["parse_flags"] == [x for x in flags.split(",") if x], raw
        assert (r["resolution_confidence"] is None) if not conf else (abs(r["resolution_confidence"] - float(conf)) < 0.006), raw
    flags = {r["script_id"]: r for r in consolidate.script_flags(pages, done, words, rules).collect()}
    assert flags["Doc0697"]["flags"] == []
    assert flags["Doc0711"]["flag_details"] == ["Question 1 appears 2 times (pages 3, 8)", "Question 1 (page 8) after 5 (page 6)"]


def test_normal_form_by_the_standard_library(spark):
    import unicodedata

    from quillstream.functions import text

    rows = ["１０（ｂ）", "ﬁn  ", "　 x ", "é", "é", "plain", "", None, "№ 5", "²", "ß Ａ"]
    df = text.normalised(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, raw string"), "raw")
    got = {r["id"]: r["text"] for r in df.collect()}
    assert got == {i: unicodedata.normalize("NFKC", t or "").strip() for i, t in enumerate(rows)}


def test_isotonic_points(spark):
    from quillstream.plans import report

    shares = [(0.105, 2, 10), (0.205, 1, 10), (0.305, 8, 20), (0.405, 3, 10), (0.505, 9, 10)]
    rows = [(x, i < hits) for x, hits, n in shares for i in range(n)]
    points = report.isotonic(spark.createDataFrame(rows, "raw double, hit boolean"), "raw", "hit")
    want = [(0.155, 3 / 20), ((0.305 * 20 + 0.405 * 10) / 30, 11 / 30), (0.505, 0.9)]
    assert [(round(x, 6), round(y, 6)) for x, y in points] == [(round(x, 6), round(y, 6)) for x, y in want]


def test_next_band_does_not_follow_arrival(spark):
    from quillstream.operators import start

    rows = [(7, 50, 1, 0.57, "a"), (8, 50, 1, 0.75, "b"), (8, 50, 1, 0.57, "c"), (9, 90, 2, 0.9, "d")]
    kind = "band int, y int, candidate_pos int, detection_confidence double, raw string, script_id string, page_index int, discard_reason string"
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame([(*r, "S", 1, None) for r in order], kind).coalesce(1)
        assert {r["raw"]: r["next_band"] for r in start.next_band(df).collect()} == {"b": 7, "a": 8, "c": 9, "d": None}
