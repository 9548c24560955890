"""Offset-mapped attribution: a document is encoded once, and its tokens are counted for its sections.

A byte-level tokenizer keeps every byte, so token lengths give each token's byte span, and counting character starts
turns it into a character span. Sections tile the text. Both lists are sorted, so an interval join is two binary
searches. A token inside one section counts for it; one that crosses a boundary is allocated by ``rule``:

* ``largest``: the section with the most of its characters, the earlier one on a tie;
* ``start``: the section of its first character;
* ``split``: each section by its share of the token's characters (fractions).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import frugal, small_batches

RULES = ("largest", "start", "split")
SCHEMA = "doc_id long, section int, char_start long, char_end long, n_tokens double, n_crossing long, doc_tokens long"
_loaded: dict = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load(path: str):
    """The encoder and the length in bytes of each id; loaded once for each worker."""
    if path not in _loaded:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            lengths[i] = len(piece)
        encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _loaded[path] = encoder, lengths
    return _loaded[path]


def line_starts(raw: np.ndarray, first_of: np.ndarray | None) -> np.ndarray:
    """Character offsets where sections start: a section is a line with its newline."""
    after = np.flatnonzero(raw[:-1] == 10) + 1
    after = after if first_of is None else first_of[after]
    return np.concatenate(([0], after))


def attribute(text: str | None, encoder, lengths: np.ndarray, rule: str) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, int]:
    """(section starts, characters, tokens by section, crossing tokens by section of their first character, tokens)."""
    if not text:
        return np.zeros(1, np.int64), 0, np.zeros(1), np.zeros(1, np.int64), 0
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = lengths[encoder.encode_to_numpy(text, disallowed_special=())].cumsum()
    begins = np.concatenate(([0], ends[:-1]))
    chars, first_of = len(text), None
    if chars != len(raw):
        first_of = ((raw & 0xC0) != 0x80).cumsum() - 1  # of each byte, the character it belongs to
        begins, ends = first_of[begins], first_of[ends - 1] + 1
    starts = line_starts(raw, first_of)
    first = starts.searchsorted(begins, "right") - 1
    last = starts.searchsorted(ends - 1, "right") - 1
    counts = np.bincount(first, minlength=len(starts)).astype(float)
    crossing = np.flatnonzero(first != last)
    crossed = np.bincount(first[crossing], minlength=len(starts))
    if rule != "start":
        bounds = np.append(starts, chars)
        for t in crossing:
            own = np.arange(first[t], last[t] + 1)
            share = np.minimum(bounds[own + 1], ends[t]) - np.maximum(bounds[own], begins[t])
            counts[first[t]] -= 1
            if rule == "split":
                counts[own] += share / share.sum()
            else:
                counts[own[share.argmax()]] += 1
    return starts, chars, counts, crossed, len(ends)


def section_tokens(
    docs: DataFrame, rule: str = "largest", ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each section (line) of each row of docs, in SCHEMA.

    The counts of a document's sections add up to doc_tokens. Null or empty text: one section 0 of no characters and no
    tokens. Strings of special tokens are ordinary text. A null id stays null and repeated rows each give their
    sections. Sections are cut at newlines only, so a very long text costs memory in proportion to itself.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = load(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                starts, chars, counts, crossed, total = attribute(text.as_py(), encoder, lengths, rule)
                n = len(starts)
                for part, values in zip(out[1:], (np.arange(n), starts, np.append(starts[1:], chars), counts, crossed, np.full(n, total))):
                    part.append(values)
                out[0].append((doc_id, n))
            ids = pa.array([d for d, n in out[0]], pa.int64()).take(pa.array(np.repeat(np.arange(len(out[0])), [n for _, n in out[0]])))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            rest = [pa.array(np.concatenate(x) if x else [], k, safe=False) for x, k in zip(out[1:], kinds)]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([ids, *rest], names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(frugal(run), SCHEMA)
