"""SentencePiece encoding and decoding as shortest paths in a weighted finite-state transducer.

The model file is compiled into machines that are composed with each input:

* the normaliser rewrites characters: arcs for the entries of the file's character map, of which the longest that fits is
  taken, a copy of every other character, and states that add or drop white space as the file says;
* the lexicon reads characters and writes pieces: an arc for each piece, and for a character that is no piece, an arc that
  writes its UTF-8 bytes (or the unknown piece, if the file has no bytes);
* the adjacency machine, for models of merged pairs only: its state is the last piece, and the arc from piece p to piece q
  has weight 0 if the model's merges, applied to p and q side by side, leave just these two, else infinity.

In a unigram model a piece weighs what its score takes away, in a model of merged pairs 1. The encoding is the path of the
least weight: sums along a path, the minimum of paths, which is the tropical semiring. Its values for all prefixes of an
input are found from left to right, each the minimum over the lexicon's arcs that end there.

Merges are local: whether the boundary between two pieces survives depends on these two alone, so of the paths of a model
of merged pairs exactly one for each prefix has a finite weight. So one state at each position is enough there as well,
and an input costs its length times the longest piece. The adjacency machine is built as far as inputs need it, from the
order in which merges change the tokens at the two ends of a piece.

Characters outside the lexicon, and a U+2581 after another character, are never inside a piece. There the path passes a
single state, so segments between such points are encoded on their own and remembered. Unigram sums are rounded on the
way as the library does, and models without bytes join unknown characters, so these are encoded text by text.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import frugal, small_batches
from quillstream.llm.segments import SegmentCache, blocks, encode_block, flat

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, MERGED = 1, 2
#: What an unknown character weighs beyond the heaviest piece, and what it decodes to: fixed values of the file format.
UNKNOWN_WEIGHT, UNKNOWN_TEXT = 10.0, " \u2047 "
#: Pairs of pieces whose adjacency a worker remembers.
PAIRS = 1_500_000
NEVER = -math.inf
SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean"
_loaded: dict = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class Normaliser:
    """The transducer from characters to normalised characters that a model file describes."""

    def __init__(self, spec: dict, symbols: list[str], suffix: bool) -> None:
        self.prefix, self.squeeze, self.escape, self.suffix = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), suffix
        self.symbols = [x.encode() for x in sorted(symbols, key=len, reverse=True)]
        packed = spec.get(2) or b""
        size = struct.unpack("<I", packed[:4])[0] if packed else 0
        self.units = np.frombuffer(packed[4 : 4 + size], "<u4").tolist()
        self.outputs = packed[4 + size :]
        self.copies = not (self.units or self.symbols or self.squeeze)

    def _longest(self, data: bytes, at: int) -> tuple[int, str]:
        """(bytes read, characters written) of the arc taken at a place of an input."""
        for symbol in self.symbols:
            if data.startswith(symbol, at):
                return len(symbol), symbol.decode()
        found = None
        if self.units:
            # the map is a double array: a unit holds a child's label, an offset to its children and whether a value is there
            offset = lambda unit: unit >> 10 << ((unit & 1 << 9) >> 6)
            node = offset(self.units[0])
            for i in range(at, len(data)):
                node ^= data[i]
                if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                    break
                unit = self.units[node]
                node ^= offset(unit)
                if unit >> 8 & 1:
                    found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found:
            return found[0], self.outputs[found[1] : self.outputs.index(b"\0", found[1])].decode()
        size = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
        return size, data[at : at + size].decode(errors="replace")

    def rewrite(self, text: str) -> str:
        if not text:
            return ""
        mark = SPACE if self.escape else " "
        if not self.copies:
            data, at, out, blank = text.encode(), 0, [], self.squeeze
            while at < len(data):
                size, piece = self._longest(data, at)
                at += size
                piece = piece.lstrip(" ") if blank else piece
                if piece:
                    out.append(piece)
                    blank = self.squeeze and piece[-1] == " "
            text = "".join(out)
            if self.squeeze and not text:
                return ""
        text = (mark if self.prefix and not self.suffix else "") + text.replace(" ", mark)
        text = text.rstrip(mark) if self.squeeze else text
        return text + mark if self.prefix and self.suffix else text


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict = {}
        normaliser: dict = {}
        for field, value in _fields(data):
            if field == 1:
                x = dict(_fields(value))
                self.pieces.append(x[1].decode())
                scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                self.kinds.append(x.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        kind = trainer.get(3, UNIGRAM)
        self.merging = kind == MERGED
        if kind not in (UNIGRAM, MERGED) or self.merging and UNUSED in self.kinds:
            raise ValueError("unigram models and models of merged pairs without unused pieces are compiled, no others")
        named = list(zip(range(len(self.pieces)), self.pieces, self.kinds))
        symbols = {p: i for i, p, k in named if k == USER}
        self.normaliser = Normaliser(normaliser, list(symbols), bool(trainer.get(24, 0)))
        self.normalise = self.normaliser.rewrite
        self.ids = {p: i for i, p, k in named if k == NORMAL or k == USER and not self.merging}
        self.bytes = {int(p[3:-1], 16): i for i, p, k in named if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.lexicon = self._lexicon()
        self.single = frozenset(p for p in self.ids if len(p) == 1).issuperset
        low, high = (f((scores[i] for i, _, k in named if k == NORMAL), default=0.0) for f in (min, max))
        own = lambda i, p, k: np.float32(0.1 - len(p.encode()) * high if k == USER else -scores[i])
        self.weights = [own(*x) for x in named]
        self.unknown_weight = np.float32(UNKNOWN_WEIGHT - low)
        # the adjacency machine
        self.rank = {p: scores[i] for p, i in self.ids.items()}
        self.ends: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        # symbols are cut out of an input of merged pairs; what the lexicon reads lies between
        self.symbols = symbols if self.merging else {}
        self.cut = re.compile(f"({'|'.join(re.escape(p) for p in sorted(symbols, key=len, reverse=True))})").split if self.symbols else None
        self.whole = not self.merging or len(self.bytes) < 256 or self.normaliser.suffix
        self.classes = self._classes()
        self.cache = SegmentCache(lambda segments: flat(list(map(self.path, segments))))
        self.raw = [
            UNKNOWN_TEXT.encode() if k == UNKNOWN else b"" if k == CONTROL else bytes([int(p[3:-1], 16)]) if k == BYTE else p.encode() for _, p, k in named
        ]

    def _lexicon(self):
        """The lexicon's automaton, which gives the arcs that end at each place of an input, the longest first."""
        from ahocorasick import Automaton

        out = Automaton()
        for piece, i in self.ids.items():
            out.add_word(piece, (i, len(piece)))
        out.make_automaton()
        return out.iter if self.ids else lambda text: iter(())

    def arcs(self, text: str):
        """(last place, (piece, length)) of all arcs over an input, by place, the longest first.

        A character that is no piece has an arc as well, with the number of pieces plus its own as its id.
        """
        if self.single(text):
            return self.lexicon(text)
        strange = [(i, (len(self.pieces) + ord(c), 1)) for i, c in enumerate(text) if c not in self.ids]
        return sorted((*self.lexicon(text), *strange), key=lambda arc: (arc[0], -arc[1][1]))

    def _classes(self) -> np.ndarray | None:
        """What a character is to ``segments``, by code point: 1 U+2581, 2 a sign, 3 an odd one; the last entry is for all beyond.

        Signs never follow another character inside a piece, other signs and U+2581 apart; no piece has an odd one. None
        if pieces have U+2581 inside, so that nothing can be cut.
        """
        letters = {c for p in self.ids for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return None
        follows: dict[str, set[str]] = {}
        for p in self.ids:
            for x, c in zip(p, p[1:]):
                follows.setdefault(c, set()).add(x)
        # no letters of a script; superscripts and the like count as signs where pieces allow it
        signs = {c for c in letters if not c.isalpha() and not c.isdecimal() and c not in (SPACE, "\n")}
        while wrong := {c for c in signs if follows.get(c, set()) - signs - {SPACE}}:
            signs -= wrong
        out = np.zeros(max(map(ord, letters | {SPACE}), default=0) + 2, np.uint8)
        out[[ord(c) for c in signs]] = 2
        out[ord(SPACE)] = 1
        if "\n" not in letters:
            out[ord("\n")] = 3
        return out

    def segments(self, code: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cuts where no piece can cross: before U+2581 and before signs after other characters, and around odd ones."""
        if self.classes is None:
            starts = np.flatnonzero(fresh)
        else:
            kind = self.classes[np.minimum(code, len(self.classes) - 1)]
            before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
            starts = np.flatnonzero(fresh | (kind == 1) & (before != 1) | (kind == 2) & (before == 0) | (kind == 3) | (before == 3))
        return starts, np.append(starts[1:], len(code))[: len(starts)]

    def _text(self, piece: int) -> str:
        return self.pieces[piece] if piece < len(self.pieces) else chr(piece - len(self.pieces))

    def _merges(self, piece: int) -> tuple | None:
        """(first tokens, last tokens) of a piece while its merges run, best score first, the leftmost on a tie.

        Each token stands with a limit: the worst score among the merges up to the one that changes it. None if the merges
        do not end in the piece.
        """
        parts, rank = list(self._text(piece)), self.rank.get
        scores = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        sides: tuple[list, list] = ([], [])
        limits = [math.inf, math.inf]
        while scores and (best := max(scores)) > NEVER:
            i = scores.index(best)
            for side, hit in enumerate((i == 0, i == len(scores) - 1)):
                limits[side] = min(limits[side], best)
                if hit:
                    sides[side].append((parts[-side], limits[side]))
                    limits[side] = math.inf
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
            if i < len(scores):
                scores[i] = rank(parts[i] + parts[i + 1], NEVER)
        for side in (0, 1):
            sides[side].append((parts[-side], NEVER))
        return sides if len(parts) == 1 else None

    def _ends(self, piece: int) -> tuple | None:
        if piece not in self.ends:
            self.ends[piece] = self._merges(piece)
        return self.ends[piece]

    def adjacent(self, before: int, after: int) -> bool:
        """Whether the adjacency machine's arc has weight 0; before -1 stands for the start.

        Both pieces are made by merges of their own, which run in the order of their scores. A merge across the boundary
        happens if it is better than what either side still does before the token at its end changes.
        """
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        key = (before + 1) << 32 | after
        right = self._ends(after)
        left = self._ends(before) if before >= 0 else ((), (("", NEVER),))
        fits, i, j = right is not None and left is not None, 0, 0
        while fits:
            (a, a_limit), (b, b_limit) = left[1][i], right[0][j]
            across = self.rank.get(a + b, NEVER) if a else NEVER
            if across > a_limit and across >= b_limit:
                fits = False
            elif a_limit == b_limit == NEVER:
                break
            elif a_limit >= b_limit:
                i += 1
            else:
                j += 1
        self.pairs[key] = fits
        return fits

    def path(self, text: str) -> list[int]:
        """Ids on the path of the least weight over normalised text without symbols; of equal ones, with longer last pieces."""
        n, pairs, merging, weights, first = len(text), self.pairs.get, self.merging, self.weights, len(self.pieces)
        # of each prefix: the least weight, and the last piece on its path with the place where it begins
        costs: list = [0] + [math.inf] * n
        last, starts = [-1] * (n + 1), [0] * (n + 1)
        for place, (piece, size) in self.arcs(text):
            end = place + 1
            start = end - size
            total = costs[start] + (1 if merging else weights[piece] if piece < first else self.unknown_weight)
            if total < costs[end]:
                if merging:
                    fits = pairs((last[start] + 1) << 32 | piece)
                    if not (fits or fits is None and self.adjacent(last[start], piece)):
                        continue
                costs[end], last[end], starts[end] = total, piece, start
        pieces = []
        while n:
            pieces.append(last[n])
            n = starts[n]
        if max(pieces, default=0) < first:
            return pieces[::-1]
        out: list[int] = []
        for piece in reversed(pieces):
            if piece < first:
                out.append(piece)
            elif len(self.bytes) == 256:
                out += [self.bytes[b] for b in chr(piece - first).encode()]
            elif not out or out[-1] != self.unknown:  # a run of unknown characters is one unknown piece
                out.append(self.unknown)
        return out

    def _paths(self, text: str) -> list[int]:
        parts = self.cut(text) if self.cut else [text]
        return [i for p in parts if p for i in ([self.symbols[p]] if p in self.symbols else self.path(p))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many each has)."""
        normal = list(map(self.normalise, texts))
        return flat(list(map(self._paths, normal))) if self.whole or self.cut else encode_block(self.cache, normal, self.segments)

    def decode(self, ids: list[int]) -> str:
        """The inverse relation: pieces to text, bytes that are no UTF-8 replaced, white space that was added dropped."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")
        if self.normaliser.suffix:
            return text.replace(SPACE, " ").removesuffix(" " if self.normaliser.prefix else "")
        if self.normaliser.squeeze:
            text = text.lstrip(SPACE)
        elif self.normaliser.prefix:
            text = text.removeprefix(SPACE)
        return text.replace(SPACE, " ")


def load(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA for each row of docs: the ids of its whole text, and whether decoding them gives the text back.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers. Null and empty texts have no ids, and decode to
    the empty text. A text with U+2581 decodes to spaces there, so round_trip is false for it, as it is where the model's
    normaliser changes a text. Of paths of equal weight, the one whose last piece is longest is taken. A null id stays
    null, repeated rows give repeated results, other columns are not read. A text costs memory in proportion to itself.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(path)
        for batch in batches:
            done = 0
            for texts in blocks(batch.column(1).to_pylist()):
                ids, counts = machine.encode(texts)
                ends = np.concatenate(([0], counts.cumsum()))
                whole = ids.tolist()
                raw = memoryview(ids.astype("<u4")).cast("B")
                spans = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[done : done + len(texts)],
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64()),
                        pa.array([machine.decode(whole[a:b]) == t for (a, b), t in zip(spans, texts)], pa.bool_()),
                    ],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )
                done += len(texts)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(frugal(run, lambda: load(path).cache.clear()), SCHEMA)


def decode(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for each row of ids; null ids decode to null."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(path)
        for batch in batches:
            texts = [None if x is None else machine.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")
