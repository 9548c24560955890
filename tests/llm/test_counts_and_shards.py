import zlib

import numpy as np
import pytest

from quillstream.llm import sharding, token_counts


def test_spans_and_counts_by_brute_force():
    encoder, lengths = token_counts.load(token_counts.default_ranks())
    texts = ["one two\nthree  \n\n four", "é😀\n\n中文 x\n", "a", "\n\n\n", "tabs\t\t\nand more   words\n end"]
    for text in texts:
        starts, chars, counts, crossed, total = token_counts.attribute(text, encoder, lengths, "largest")
        pieces = [encoder.decode_single_token_bytes(i) for i in encoder.encode_ordinary(text)]
        assert total == len(pieces) == counts.sum() and chars == len(text)
        owner = [k for k, c in enumerate(text) for _ in c.encode()]
        want, at = np.zeros(len(starts)), 0
        sections = np.cumsum([0] + [c == "\n" for c in text[:-1]])
        for p in pieces:
            span = range(owner[at], owner[at + len(p) - 1] + 1)
            at += len(p)
            shares = np.bincount([sections[c] for c in span], minlength=len(starts))
            want[shares.argmax()] += 1
        assert counts.tolist() == want.tolist(), text


def test_one_word_of_a_million_letters():
    encoder, lengths = token_counts.load(token_counts.default_ranks())
    starts, chars, counts, crossed, total = token_counts.attribute("abcdefgh" * 125_000 + "\n" + "é" * 300_000, encoder, lengths, "largest")
    assert (len(starts), chars, counts.sum()) == (2, 1_300_001, total)


def test_rules_allocate_every_token():
    encoder, lengths = token_counts.load(token_counts.default_ranks())
    text = "line one\n\n\n\n   line two \n\n end"
    got = {r: token_counts.attribute(text, encoder, lengths, r)[2] for r in token_counts.RULES}
    assert len({round(x.sum(), 9) for x in got.values()}) == 1
    assert not np.array_equal(got["start"], got["split"])


def test_sections_of_awkward_rows(awkward, nothing):
    rows = token_counts.section_tokens(awkward).collect()
    empty = [r for r in rows if r["doc_id"] in (1, 2)]
    assert [(r["section"], r["char_end"], r["doc_tokens"]) for r in empty] == [(0, 0, 0)] * 2
    assert sum(r["doc_id"] == 5 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 2
    assert token_counts.section_tokens(nothing).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(awkward, rule="none")


def test_shards(docs_of, awkward, nothing):
    rows = [(i, f"text {i}", "en", "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    got = sharding.shard(docs_of(rows), 40).toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 1
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    hot = got[got["source"] == "hot"].groupby("shard").size()
    assert hot.max() - hot.min() <= 8  # one row for each of the eight sources
    assert (got["text_crc32"] == [zlib.crc32(f"text {i}".encode()) for i in got["doc_id"]]).all()
    again = sharding.shard(docs_of(rows).repartition(7), 40).toPandas()
    assert dict(zip(got["doc_id"], got["shard"])) == dict(zip(again["doc_id"], again["shard"]))
    # a third of the rows without an id: they are dealt over buckets like others
    loose = sharding.shard(docs_of([(None if i % 3 == 0 else i, f"text {i}", "en", "hot") for i in range(9000)]), 4).toPandas()
    assert loose.groupby("shard").size().tolist() == [2250] * 4 and (loose.sort_values(["shard", "slot"])["slot"] == [i % 2250 for i in range(9000)]).all()
    assert loose["doc_id"].isna().groupby(loose["shard"]).sum().between(650, 850).all()
    few = sharding.shard(awkward, 40).toPandas()
    assert len(few) == 11 and few["size"].min() == 16 and set(few["slot"]) == {0}
    assert sharding.shard(nothing).count() == 0
