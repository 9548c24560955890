import random

import pytest
from test_decontaminate_and_rules import plain, plain_measures
from test_dedup_store_pieces import plain_groups

from quillstream.llm import sentencepiece_fst

pipeline = pytest.importorskip("corpus_pipeline")


def prose(seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n))


def stayed(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_dedup_decides_by_row(spark, docs_of):
    a, b, c, d = map(prose, range(4))
    near = a + " end"
    rows = [(1, a), (None, a), (2, b), (2, c), (2, c), (1, c), (3, near), (None, d), (None, d), (4, b), (5, c)]
    # b and c both have the id 2; c's first row is (1, c), so (2, c) goes and (2, b) stays
    want = [(1, a), (1, c), (2, b), (None, d)]
    assert stayed(pipeline.dedup_stage(spark, docs_of(rows), "")) == sorted(want, key=repr)
    # of equal rows one stays, the same one whatever the order
    equal = [(7, a, "en", "z"), (7, a, "en", "y"), (None, b, "de", "q"), (None, b, "de", "p")]
    for some in (equal, equal[::-1]):
        found = pipeline.dedup_stage(spark, docs_of(some), "").collect()
        assert sorted((r["doc_id"] or 0, r["text"], r["source"]) for r in found) == [(0, b, "p"), (7, a, "y")]


def test_decontamination_decides_by_row(spark, docs_of, tmp_path):
    a, b, item = prose(0), prose(1), prose(9, 12)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, a), (1, f"{a} {item}"), (None, b), (None, f"{b} {item}"), (2, item), (3, None)]
    got = stayed(pipeline.decontamination_stage(spark, docs_of(rows), str(tmp_path)))
    assert got == sorted([(1, a), (None, b), (3, None)], key=repr)


def plain_run(rows, items):
    """run() on rows (doc_id, text) without a label and without a language."""
    out = []
    for i, t in rows:
        words, _, _, _, repeated = plain_measures(t)
        if words >= 20 and 100 * repeated <= 30 * words and any(c.isalpha() for c in t):
            out.append((i, t))
    named = [(k, t) for k, (_, t) in enumerate(out)]  # each group by its first row: smallest id, null last
    order = sorted(range(len(out)), key=lambda k: (out[k][0] is None, out[k][0] or 0))
    groups = plain_groups([(order.index(k), t) for k, t in named])
    out = [out[k] for k in range(len(out)) if groups[k][1] == order.index(k)]
    bad = {i for i, *_, hit in plain([(k, t) for k, (_, t) in enumerate(out)], items) if hit}
    return [x for k, x in enumerate(out) if k not in bad]


def tables(spark, docs, items, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("lang", ["null", "one", "no column"])
def test_run_by_brute_force(spark, docs_of, tmp_path, lang):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_model())
    item, t = prose(99, 12), [prose(k) for k in range(8)]
    rows = [(1, t[0]), (1, t[1]), (None, t[1]), (2, t[1]), (3, f"{t[2]} {item}"), (3, t[3]), (None, f"{t[4]} {item}"), (None, t[5])]
    rows += [(None, t[5]), (None, t[5] + " end"), (4, t[6]), (4, t[6]), (5, t[6] + " end"), (6, None), (7, ""), (8, "too short"), (9, "1 2 " * 30)]
    rows += [(10, " ".join(map(str, range(100, 160)))), (None, None)]
    docs = docs_of([(*r, "en" if lang == "one" else None) for r in rows])
    folder = tables(spark, docs.drop("lang") if lang == "no column" else docs, [(1, item), (2, None)], tmp_path)
    got = sorted(((r["doc_id"], r["ids"]) for r in pipeline.run(spark, folder).collect()), key=repr)
    want = plain_run(rows, [(1, item), (2, None)])
    assert len(want) == 5 and (None, t[5]) in {(i, x.removesuffix(" end")) for i, x in want}
    near = {library.encode(t[5] + " end").__repr__(): t[5]}  # which of two rows without an id is first, their keys say
    plain_ids = lambda ids: library.encode(near[repr(ids)]) if repr(ids) in near else ids
    assert sorted([(i, plain_ids(x)) for i, x in got], key=repr) == sorted([(i, library.encode(x.removesuffix(" end"))) for i, x in want], key=repr)


def test_run_on_empty_tables(spark, nothing, tmp_path):
    assert pipeline.run(spark, tables(spark, nothing, [], tmp_path)).count() == 0


def test_stages_return_their_columns(spark, docs_of, awkward, tmp_path):
    folder = tables(spark, awkward, [], tmp_path)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, awkward, folder).columns == list(pipeline.COLUMNS)


def test_held_tables_give_the_drivers_memory_back(spark, monkeypatch):
    from quillstream.llm import common

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "PS MarkSweep", "MarkSweepCompact"))
    space, before = common.Workspace(spark, "memory"), whole()
    monkeypatch.setattr(common, "_driver_released", -1e9)
    assert space.hold(spark.range(3), "first", 1).count() == 3
    assert whole() > before
    again = whole()
    assert space.hold(spark.range(3), "second", 1).count() == 3
    assert whole() == again


def test_stages_give_the_executors_memory_back(spark, docs_of, awkward, tmp_path, monkeypatch):
    from quillstream.llm import common

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()  # one JVM is driver and executor
    whole = lambda: sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "PS MarkSweep", "MarkSweepCompact"))
    folder = tables(spark, awkward, [], tmp_path)
    monkeypatch.setattr(common, "_driver_released", 1e18)  # the driver's own collections don't count
    for name, stage in pipeline.STAGES:
        before = whole()
        stage(spark, awkward, folder)
        assert whole() > before, name
