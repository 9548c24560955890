import hashlib
import random
import re

from quillstream.llm import decontaminate, quality_rules


def plain(rows, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        windows |= {(i, tuple(w[s : s + n])) for s in range(len(w) - n + 1)} if w else set()
    out = []
    for i, t in rows:
        w = split(t)
        hit, named = set(), set()
        for item, x in windows:
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit |= set(range(s, s + len(x)))
                    named.add("null" if item is None else str(item))
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_by_brute_force(spark, docs_of):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "Ab", "aB", "the", "the"]
    passage = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, passage(rng.choice((1, 2, 3, 9, 10, 11, 25)))) for i in range(20)] + [(90, None), (91, ""), (92, "..."), (5, "w1 w2"), (None, "w3 w4 w5"), (None, "w6 w7")]
    known = [t for _, t in items if t]
    rows = [(i, passage(rng.randint(0, 30)) + rng.choice(" .,-") + rng.choice(known).upper() * (i % 3 == 0)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "..w1!"), (103, items[0][1]), (103, items[0][1]), (104, "w3 w4 w5 w1 w2"), (None, "w6 w7"), (None, "w8"), (105, "x" * 200_000 + " w1 w2")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.BROADCAST_ROWS, 0):  # both joins
        got = decontaminate.decontaminate(docs_of(rows), table, broadcast_rows=most).collect()
        assert sorted([tuple(r) for r in got], key=repr) == plain(rows, items)


def test_decontamination_of_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    rows = decontaminate.decontaminate(awkward, items).collect()
    assert len(rows) == 11 and [r["n_hit"] for r in rows if r["doc_id"] == 5] == [2, 2]
    assert decontaminate.decontaminate(nothing, items).count() == 0
    clean = decontaminate.decontaminate(awkward, items.where("item_id = 2")).collect()
    assert len(clean) == 11 and not any(r["contaminated"] for r in clean)


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {p + k for own in places.values() if len(own) > 1 for p in own for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


def test_measures_by_brute_force(docs_of, awkward, nothing):
    rng = random.Random(8)
    texts = []
    for _ in range(120):
        vocabulary = [f"{rng.choice('aÉb#')}{i}" for i in range(rng.choice((2, 5, 300)))]
        texts.append(" ".join(rng.choice(vocabulary) + rng.choice(["", "", "\n", "\t \n", "$"]) for _ in range(rng.randint(0, 60))))
    rows = list(enumerate([*texts, None, "", "  a \n\n a ", "x " * 400, "same line\nsame line\n\n"]))
    got = {r["doc_id"]: tuple(r[c] for c in quality_rules.BASE) for r in quality_rules.measure(docs_of(rows)).collect()}
    assert got == {i: plain_measures(t) for i, t in rows}
    assert quality_rules.quality_rules(awkward, []).count() == 11 and quality_rules.quality_rules(nothing, []).count() == 0


def test_learned_list(spark, docs_of):
    rng = random.Random(2)
    prose = lambda end="": " ".join("".join(rng.choice("abcdefg") for _ in range(5)) + end for _ in range(60))
    rows = [(i, prose("***" if i % 5 == 0 else "")) for i in range(400)] + [(1000, None)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(400)] + [(1000, 0), (1, None), (2, 0), (2, 1)], "doc_id long, quality int")
    rules = quality_rules.learn(docs_of(rows), labels)
    assert rules and rules[0].conditions[0][0] == "symbols"
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs_of(rows), rules).collect()}
    assert all(got[i] == (i % 5 != 0) for i in range(400)) and not got[1000]
    assert quality_rules.learn(docs_of(rows), labels.where("doc_id < 0")) == []
