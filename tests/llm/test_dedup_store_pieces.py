import collections
import pathlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import near_dedup, sentencepiece_fst, token_store


def plain_groups(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for a, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(a)].append(i)
    return [(len(sets[a]), min(ids[find(a)], default=None)) for a in range(len(rows))]


def test_groups_by_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 8)  # so that nodes branch and dense nodes occur
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghijk") + str(rng.randrange(60))
    rows, base = [], [[word() for _ in range(60)] for _ in range(4)]
    for i in range(150):
        w = list(rng.choice(base)) if i % 3 else [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 5) if i % 3 else 0):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w).upper() if i % 2 else "\t".join(w)))
    drift = list(base[0])
    for i in range(30):  # a chain, whose ends are unlike
        drift[i * 2 % 60] = word()
        rows.append((500 + i, " ".join(drift)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE two"), (904, "one  two three")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs_of(rows)).collect()}
    want = {i: w for (i, _), w in zip(rows, plain_groups(rows))}
    want = {i: (n, c if n else i) for i, (n, c) in want.items()}
    assert got == want


def at_similarity(rng, shared, each):
    """Two texts with shared + each shingles, each shingles of each its own: similarity shared / (shared + 2 * each)."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    common = [word() for _ in range(shared + 4)]
    return [" ".join(common + [word() for _ in range(each)]) for _ in range(2)]


def test_recall_near_the_limit(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 6)  # nodes branch on all their levels
    rng = random.Random(21)
    rows = []
    for k in range(400):  # similarity 0.75 to 0.80
        rows += [(2 * k + i, t) for i, t in enumerate(at_similarity(rng, *((45, 7), (48, 8), (60, 10), (76, 10))[k % 4]))]
    rows += [(2000 + 2 * k + i, t) for k in range(200) for i, t in enumerate(at_similarity(rng, 44, 8))]  # below: 0.73
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(rows)).collect()}
    met = sum(got[2 * k] == got[2 * k + 1] for k in range(400))
    assert met >= 0.95 * 400, met
    assert all(got[i] == i for i in got if i >= 2000)


def test_shared_boilerplate_stays_in_small_blocks(docs_of, spark, monkeypatch):
    """Texts with two thirds in common and no link: no block grows with them, nor do rows with their square."""
    handed = []
    real = near_dedup._blocks
    monkeypatch.setattr(near_dedup, "_blocks", lambda rows, more, columns: handed.append(real(rows, more, columns)) or handed[-1])
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    common = [word() for _ in range(44)]
    rows = {}
    for n in (250, 500):
        own = [(i, " ".join(common + [word() for _ in range(10)])) for i in range(n)]
        own += [(n + i, own[i][1] + " more") for i in range(20)]  # links that hide among them
        probes = []
        sides = near_dedup.probed
        monkeypatch.setattr(near_dedup, "probed", lambda ready: probes.append(sides(ready)) or probes[-1])
        monkeypatch.setattr(near_dedup.Workspace, "keep", lambda self, *names: None)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(own)).collect()}
        monkeypatch.setattr(near_dedup, "probed", sides)
        assert sum(got[n + i] == i for i in range(20)) >= 18 and all(got[i] == i for i in range(n))
        sizes = probes[0].groupBy("node", "block").count()
        rows[n] = probes[0].count()
        assert sizes.agg(F.max("count")).first()[0] <= 4 * near_dedup.LEAF
    assert rows[500] <= 3 * rows[250], rows


def test_every_probe_meets_every_class(spark, monkeypatch):
    ready = [(1, f"n{i}".encode(), f"l{max(i - 150, 0)}".encode(), 250, 99, b"l0") for i in range(250)]
    ready += [(2, f"m{i}".encode(), f"l{i % 2}".encode(), 6, 3, b"l0") for i in range(6)]
    df = spark.createDataFrame(ready, "node long, name binary, label binary, size long, apart long, most binary")
    met = collections.defaultdict(set)
    blocks = collections.defaultdict(list)
    for r in near_dedup.probed(df).collect():
        blocks[r["node"], r["block"]].append(r)
    for own in blocks.values():
        for p in own:
            if p["probe"]:
                met[bytes(p["name"])] |= {bytes(b["name"]) for b in own if b["base"]}
    assert all(len(met[f"n{i}".encode()]) == 250 for i in range(151, 250)) and all(len(met[f"m{i}".encode()]) == 6 for i in range(6))
    assert max(map(len, blocks.values())) <= 4 * near_dedup.LEAF


def test_groups_of_rows_without_id(docs_of):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijk") + str(rng.randrange(60))
    chain, rows = [word() for _ in range(60)], []
    for i in range(12):  # each third text has an id; the others bridge
        rows.append((i if i % 3 == 0 else None, " ".join(chain)))
        chain = chain[:i * 4] + [word()] + chain[i * 4 + 1 :]
    apart = [word() for _ in range(40)]
    rows += [(None, " ".join(apart)), (None, " ".join(apart[:-1])), (None, " ".join(apart)), (None, ""), (50, "other")]
    got = near_dedup.near_duplicates(docs_of(rows)).collect()
    want = [(i, n, c if n else i, i == c if c is not None else True) for (i, _), (n, c) in zip(rows, plain_groups(rows))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(not w[3] for w in want) >= 8  # rows without an id do go
    first = [r for r in near_dedup.groups(docs_of(rows)).collect() if r["component_id"] is None and r["n_shingles"]]
    assert len(first) == 3 and len({r["first_row"] for r in first}) == 1  # a group without any id has a first row too


def test_groups_of_awkward_rows(awkward, nothing):
    rows = near_dedup.near_duplicates(awkward).collect()
    assert len(rows) == 11 and all(r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 4, 7))
    assert [r["component_id"] for r in rows if r["doc_id"] == 5] == [5, 5]
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_store_round_trip(docs_of, awkward, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_store.default_tokenizer())
    texts = ["The quick brown fox's 123 tests!!", "", None, "É ŉ ² 中文 <|endoftext|> x y ΑΣ", "it's we're I'll 'rest' '' a'b", "word " * 3000]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(100, "word " * 3000), (101, "new start " + "word " * 3000)]
    store = token_store.store(docs_of(rows).repartition(3))
    store.verify()
    got = {r["doc_id"]: r for r in store.digests().collect()}
    back = {r["doc_id"]: (r["start"], r["ids"]) for r in store.documents().collect()}
    start = 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert back[i] == (start, ids)
        assert tuple(got[i][c] for c in ("start", "n_tokens", "ids_crc32")) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    chunks = store.chunks.select("digest").collect()
    assert len({bytes(r["digest"]) for r in chunks}) == len(chunks)
    assert store.recipes.selectExpr("sum(length(digests)) div 16").first()[0] > len(chunks)  # equal runs are stored once
    other = token_store.store(awkward)
    other.verify()
    assert other.digests().count() == 11 and other.digests().where("doc_id = 1").first()["n_tokens"] == 1
    empty = token_store.store(nothing)
    empty.verify()
    assert empty.digests().count() == 0


def test_store_notices_changes(docs_of):
    store = token_store.store(docs_of([(1, "some text"), (2, "more text")]))
    changed = store.recipes.withColumn("start", F.col("start") + 1).collect()
    schema = store.recipes.schema
    store.space.hold(store.spark.createDataFrame(changed, schema), "recipes")
    with pytest.raises(ValueError):
        store.verify()


def test_store_notices_changed_recipes(docs_of):
    words = " ".join(f"w{i * i % 9973}" for i in range(3000))
    store = token_store.store(docs_of([(1, words), (2, "more text"), (3, "less text")]))
    good, schema = store.recipes.collect(), store.recipes.schema
    assert len(good[0]["digests"]) > 16
    swap = {2: 3, 3: 2}
    turned = lambda b: b"".join(bytes(b[i : i + 16]) for i in range(0, len(b), 16)[::-1])
    changes = {
        "digests": lambda r: turned(r["digests"]), "doc_id": lambda r: swap.get(r["doc_id"], r["doc_id"]), "recipe": lambda r: bytes(32),
    }
    for column, change in changes.items():
        rows = [tuple(change(r) if c == column else r[c] for c in schema.names) for r in good]
        store.space.hold(store.spark.createDataFrame(rows, schema), "recipes")
        with pytest.raises(ValueError):
            store.verify()
    rows = [tuple(r[c] + 1 if c == "n_tokens" else r[c] for c in schema.names) for r in good]
    store.space.hold(store.spark.createDataFrame(rows, schema), "recipes")
    with pytest.raises(Exception, match="number of ids"):
        store.digests().collect()


def test_store_notices_changed_and_missing_chunks(docs_of):
    words = " ".join(f"w{i * i % 9973}" for i in range(3000))
    store = token_store.store(docs_of([(1, words), (2, "more text"), (3, "less text")]))
    found = store._read("store").select("kind", "key", "doc_id", "n", "width", "payload")
    rows, schema = [tuple(r) for r in found.collect()], found.schema
    chunk = next(i for i, r in enumerate(rows) if r[0] == "chunk")
    other = next(r for r in rows if r[0] == "chunk" and r[1] != rows[chunk][1])
    changes = {
        "does not match": [*rows[:chunk], (*rows[chunk][:5], other[5], *rows[chunk][6:]), *rows[chunk + 1 :]],
        "cannot be read": [*rows[:chunk], (*rows[chunk][:5], b"no frame", *rows[chunk][6:]), *rows[chunk + 1 :]],
        "missing": rows[:chunk] + rows[chunk + 1 :],
    }
    for said, changed in changes.items():
        store.spark.createDataFrame(changed, schema).write.mode("overwrite").partitionBy("kind").parquet(store.space.path("store"))
        for read in (store.digests, store.documents):
            with pytest.raises(Exception, match=said):
                read().collect()


def test_files_follow_each_other(docs_of, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(token_store, "PART_DOCS", 20)
    rng = random.Random(2)
    rows = [(rng.randrange(1000), f"text {i}") for i in range(160)] + [(None, "x")] * 3
    store = token_store.store(docs_of(rows).repartition(5))
    store.verify()
    folder = pathlib.Path(store.space.path("recipes").removeprefix("file://"))
    files = [pq.read_table(f, columns=["part", "doc_id", "start", "n_tokens"]).to_pylist() for f in sorted(folder.glob("*.parquet"))]
    found = [r for f in files for r in f]
    assert len(files) >= 4 and all(len({r["part"] for r in f}) <= 1 for f in files)
    assert [r["doc_id"] for r in found] == [None] * 3 + sorted(i for i, _ in rows if i is not None)
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_gives_the_library_s_ids(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(public_tokenizers.path(name)), token_store.Encoder(public_tokenizers.path(name))
    assert own.cuts == name.startswith("word")
    rng = random.Random(12)
    parts = ["it", "'s", "'re", "''", "'", "'t", "start", "12", "²", " ", "\n", "\t ", "É", "ß", "İ", "ŉ", "中", "😀", "<|endoftext|>", "...", "'ll", "'LL", "x", "é"]
    texts = ["", "a" * 5000, "'" * 9, "o'clock's'", "'s'", "'re've"] + ["".join(rng.choice(parts[:15]) for _ in range(rng.randint(1, 12))) for _ in range(800)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(800)]
    for first in range(0, len(texts), 300):
        some = texts[first : first + 300]
        ids, counts = own.encode(some)
        ends = counts.cumsum()
        for text, a, b in zip(some, ends - counts, ends):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_segment_memory(monkeypatch):
    from quillstream.llm import segments

    asked = collections.Counter()

    def encode(found):
        asked.update(found)
        return segments.flat([[ord(c) for c in x] for x in found])

    cache = segments.SegmentCache(encode, 50)
    rng = random.Random(1)
    spaced = lambda code, fresh: (lambda s: (s, np.append(s[1:], len(code))[: len(s)]))(np.flatnonzero(fresh | (code == 32)))
    for _ in range(60):
        texts = [" ".join(rng.choice(["the", "of", f"w{rng.randrange(400)}"]) for _ in range(rng.randint(0, 20))) for _ in range(5)]
        ids, counts = segments.encode_block(cache, texts, spaced)
        assert ids.tolist() == [ord(c) for t in texts for c in t] and counts.tolist() == list(map(len, texts))
        assert len(cache.keys) <= 50 + 110
    assert asked[" the"] == 1  # what is asked for again stays
    monkeypatch.setattr(segments, "_hashes", lambda code, a, b: (np.zeros(len(a), np.uint64), np.arange(len(a)).astype(np.uint64)))
    ids, counts = segments.encode_block(segments.SegmentCache(encode, 50), ["one two", "three"], spaced)
    assert ids.tolist() == [ord(c) for c in "one twothree"] and counts.tolist() == [7, 5]


def test_crc_of_parts():
    rng = np.random.default_rng(3)
    parts = [[rng.bytes(rng.integers(0, 70_000)) for _ in range(n)] for n in (0, 1, 3, 7)]
    flat = [p for own in parts for p in own]
    got = token_store.joined_crcs(np.array([zlib.crc32(p) for p in flat]), np.array([len(p) for p in flat]), np.array([len(x) for x in parts]))
    assert got.tolist() == [zlib.crc32(b"".join(x)) for x in parts]


def test_pieces_equal_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_model())
    machine = sentencepiece_fst.load(sentencepiece_fst.default_model())
    rng = random.Random(6)
    parts = ["a", "the", "ing", " ", "  ", "▁", "\n", "\t", "é", "①", "😀", "tion", "23", ".", "...", "<s>", "\x00", "중", "(", "²", "'s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [x * n for x in (" ", "e", "to", ".", "a b") for n in range(1, 60)] + ["².", "x².", "a².).", "».", "m²!"]
    ids, counts = machine.encode(texts)
    ends = counts.cumsum()
    for text, a, b in zip(texts, ends - counts, ends):
        own = ids[a:b].tolist()
        assert own == library.encode(text), repr(text)
        assert machine.decode(own) == library.decode(own), repr(text)


def model_file(path, pieces, kind, rule="identity", **spec):
    """A model of pieces (text, score, kind) written by hand; nothing is trained."""
    import sentencepiece

    def field(number, value):
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        tag, body = (number << 3, value) if isinstance(value, int) else (number << 3 | 2, len(value))
        return b"".join(bytes([x & 127 | 128 * (x > 127)]) + (bytes([x >> 7]) if x > 127 else b"") for x in (tag, body) if x < 1 << 14) + (value if isinstance(value, bytes) else b"")

    def long_field(number, value):
        size, out = len(value), b""
        while size > 127:
            out, size = out + bytes([size & 127 | 128]), size >> 7
        return bytes([number << 3 | 2]) + out + bytes([size]) + value

    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
    for number, value in spec.items():
        normaliser += field(int(number[1:]), value)
    out = b"".join(long_field(1, field(1, p.encode()) + field(2, float(w)) + field(3, k)) for p, w, k in pieces)
    out += long_field(2, field(3, kind) + (field(35, 1) if any(k == 6 for *_, k in pieces) else b"")) + long_field(3, normaliser)
    path.write_bytes(out)
    return str(path)


PIECES = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]
WORDS = ["▁", "a", "b", "c", "▁a", "ab", "abc", "bc", "▁ab", "ca", "cab", "aa", "aaa", "é", "▁é", "éa", "bb", "1", "▁1", "fi", "f", "i"]


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("form", ["bytes", "unknown", "symbols"])
@pytest.mark.parametrize("kind", [1, 2])
def test_models_written_by_hand_equal_the_library(tmp_path, rule, form, kind):
    import sentencepiece

    rng = random.Random(f"{rule}{form}{kind}")
    scores = [-float(i) for i in range(len(WORDS))] if kind == 2 else [-rng.randint(1, 40) / 4 for _ in WORDS]
    pieces = PIECES + [(f"<0x{i:02X}>", 0, 6) for i in range(256) if form == "bytes"]
    pieces += [("<sep>", 0, 4), ("[a b]".replace(" ", "▁"), 0, 4)] * (form == "symbols")
    pieces += [(w, x, 1) for w, x in zip(WORDS, scores)]
    for spec in ({"f3": 1, "f4": 1}, {"f3": 1, "f4": 0}, {"f3": 0, "f4": 1}, {"f3": 0, "f4": 0}):
        path = model_file(tmp_path / f"{spec['f3']}{spec['f4']}.model", pieces, kind, rule, **spec)
        library, machine = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducer(path)
        parts = ["a", "b", "c", "ab", "abc", "bca", " ", "  ", "é", "1", "①", "ﬁ", "Ａ", "中", "😀", "\t", "<sep>", "▁", "aaaa", "x"]
        texts = ["", " ", "   a", "a   "] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300)]
        ids, counts = machine.encode(texts)
        ends = counts.cumsum()
        for text, a, b in zip(texts, ends - counts, ends):
            assert ids[a:b].tolist() == library.encode(text), (text, spec, machine.normalise(text))


def test_least_weight_by_enumeration(tmp_path):
    rng = random.Random(4)
    path = model_file(tmp_path / "m.model", PIECES + [(w, -rng.randint(1, 90) / 8, 1) for w in WORDS], 1, f4=0)
    machine = sentencepiece_fst.Transducer(path)

    def every(text):
        if not text:
            yield ()
        for n in range(1, len(text) + 1):
            if text[:n] in machine.ids:
                yield from ((machine.ids[text[:n]], *rest) for rest in every(text[n:]))

    for _ in range(200):
        text = "".join(rng.choice("▁abc") for _ in range(rng.randint(1, 9)))
        weigh = lambda ids: sum(machine.weights[i] for i in ids)
        assert abs(weigh(machine.path(text)) - min(map(weigh, every(text)))) < 1e-6


def test_adjacency_by_merging():
    """An arc of the adjacency machine against the merges themselves, run over both pieces side by side."""
    machine = sentencepiece_fst.load(sentencepiece_fst.default_model())

    def merged(text):
        parts = list(text)
        while len(parts) > 1:
            scores = [machine.rank.get(a + b, -float("inf")) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == -float("inf"):
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    rng = random.Random(8)
    some = rng.sample(sorted(machine.ids.values()), 400) + [machine.ids[x] for x in ("▁the", "the", "th", "e", "ing", "▁", "▁▁", "re", "s")]
    for _ in range(6000):
        p, q = rng.choice(some), rng.choice(some)
        assert machine.adjacent(p, q) == (merged(machine.pieces[p] + machine.pieces[q]) == [machine.pieces[p], machine.pieces[q]])


def test_one_piece_of_a_million_letters():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_model())
    machine = sentencepiece_fst.load(sentencepiece_fst.default_model())
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(1_000_000))
    assert machine.encode([long, "", long[:10]])[1].tolist()[1:] == [0, len(library.encode(long[:10]))]
    assert machine.encode([long])[0].tolist() == library.encode(long)


def test_encoding_rows(docs_of, awkward, nothing):
    rows = sentencepiece_fst.encode(awkward).collect()
    assert len(rows) == 11 and all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in rows)
    encoded = sentencepiece_fst.encode(docs_of([(1, "some  text\n"), (2, None), (3, "a▁b")]))
    assert [r["text"] for r in sentencepiece_fst.decode(encoded).orderBy("doc_id").collect()] == ["some  text\n", "", "a b"]
    assert [r["round_trip"] for r in encoded.orderBy("doc_id").collect()] == [True, True, False]
    assert sentencepiece_fst.encode(nothing).count() == 0
