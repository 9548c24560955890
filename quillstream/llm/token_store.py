"""A content-addressed store of token ids.

A document's ids, with an end id, are cut where a rolling hash of the last WINDOW ids says so, so equal runs give equal
chunks wherever they stand. A chunk's name is the digest of its ids; each is stored once. The files below a root:

* ``kind=chunk/``: digest, n_ids and payload, the zstandard-compressed little-endian ids (2 bytes each, or 4 where an
  id needs them: ``width``);
* ``recipes/``: documents in ascending doc_id order, file by file: part (the file's number), doc_id, start (ids of all
  documents before), n_tokens, the digests of its chunks in order, and the recipe's digest;
* ``manifest/``: for each part its documents, ids, first start and the root of the Merkle tree over its recipes.

Bytes cross the network once, to drop equal chunks. What is read back is checked by name: each chunk against its digest,
each part against its root (of doc_id, start, n_tokens and the digests themselves), starts against the ids before them, a
document's chunks against n_tokens. A chunk that is missing is an error.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm.common import ROW_GROUP, Workspace, frugal, small_batches
from quillstream.llm.segments import SegmentCache, blocks, encode_block, flat

END_ID = 2
WINDOW = 8
#: Ids in a chunk: at least, on average beyond that, and at most.
LEAST, MEAN, MOST = 256, 1024, 8192
#: Documents in a part of the recipes.
PART_DOCS = 50_000
STAGED = "kind string, key binary, doc_id long, n long, width int, payload binary"
FILES = {
    "store": STAGED,
    "recipes": "part int, doc_id long, start long, n_tokens long, digests binary, recipe binary",
    "manifest": "part int, n_docs long, n_tokens long, start long, root binary",
}
_loaded: dict = {}
_gear = np.random.default_rng(20).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)

#: Parts whose sums are broadcast at most (16 MB).
BROADCAST_PARTS = 1_000_000
#: What ``Encoder`` cuts like, as tokenizer files say it. A file that says anything else is asked for whole texts.
NORMALISES = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters up to U+017F whose lower case is one character up to there; nothing else changes them.
_PLAIN = re.compile("[\\n\\r\\t -~\xa1-\xac\xae-įı-ſ]*")
SPACE, LETTER, NUMBER, SIGN = range(4)


def _kinds() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER, "Z": SPACE, "C": SPACE}
    return np.array([kind.get(unicodedata.category(chr(c))[0], SIGN) for c in range(0x180)], np.uint8)


_KIND = _kinds()
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x180)], np.uint32)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pretokens(code: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of what CUTS finds in plain lower-cased texts; fresh is True where a text begins."""
    n = len(code)
    kind = _KIND[code]
    before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
    starts = (kind != SPACE) & (fresh | (kind != before) | (kind == NUMBER))
    # a quote that begins a run of signs takes the letters of a contraction
    quotes = np.flatnonzero(starts & (code == ord("'")))
    padded = np.concatenate((code, np.zeros(2, code.dtype)))
    new = np.concatenate((fresh, np.ones(2, bool)))
    one, two = padded[quotes + 1], padded[quotes + 2]
    pair = one.astype(np.int64) << 32 | two
    short = np.isin(one, [ord(c) for c in "stmd"]) & ~new[quotes + 1]
    long = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")]) & ~new[quotes + 1] & ~new[quotes + 2]
    taken = short | long
    after = quotes[taken] + np.where(short[taken], 2, 3)
    starts[quotes[taken] + 1] = False
    after = after[after < n]
    starts[after[kind[after] != SPACE]] = True
    bounds = np.append(np.flatnonzero(starts | fresh | (kind == SPACE)), n)
    starts = np.flatnonzero(starts)
    return starts, bounds[bounds.searchsorted(starts, "right")]


class Encoder:
    """The tokenizers library, asked once for each pre-token that is remembered; other texts go to it whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.cuts = self._cuts(file)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.added = re.compile("|".join(re.escape(x["content"]) for x in file["added_tokens"]) or r"(?!)")
        self.cache = SegmentCache(self._ask)

    @staticmethod
    def _cuts(file: dict) -> bool:
        """Whether the file's pre-tokens are those that ``pretokens`` finds, and stand for themselves."""
        split, *rest = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        levels = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        model = file["model"]
        return (
            file.get("normalizer") == NORMALISES
            and split == {"type": "Split", "pattern": {"Regex": CUTS}, "behavior": "Removed", "invert": True}
            and len(rest) == 1
            and levels.items() <= rest[0].items()
            and file.get("post_processor") is None
            and model.get("type") == "BPE"
            and model.get("dropout") is None
            and all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in file["added_tokens"])
        )

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ask(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # between blanks a pre-token is encoded as it is alone, and its last id shows where it ends
        ids = np.array(self._ids(" ".join(segments)), np.int32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(segments):
            return ids, np.diff(ends, prepend=0)
        return flat(list(map(self._ids, segments)))

    def plain(self, text: str) -> bool:
        return self.cuts and bool(_PLAIN.fullmatch(text)) and not self.added.search(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many each has)."""
        plain = list(map(self.plain, texts))
        ids, counts = encode_block(self.cache, [t for t, p in zip(texts, plain) if p], pretokens, _LOWER)
        if all(plain):
            return ids, counts
        own = iter(np.split(ids, counts.cumsum()[:-1]))
        parts = [next(own) if p else np.array(self._ids(t), np.int32) for t, p in zip(texts, plain)]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def load(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def cuts(ids: np.ndarray) -> list[int]:
    """Where chunks of ids end: after an id whose rolling hash falls in one of MEAN classes, within LEAST and MOST."""
    n = len(ids)
    h = _gear[ids & 0xFFFF] + ids.astype(np.uint64) // np.uint64(1 << 16)
    step = 1
    while step < WINDOW:  # h[i] becomes the sum of the last 2 * step terms, each shifted by its distance
        h[step:] += h[:-step] << np.uint64(step)
        step *= 2
    marks = np.flatnonzero((h >> np.uint64(20)) % np.uint64(MEAN) == 0) + 1
    out, last = [], 0
    for mark in marks.tolist():
        if mark - last < LEAST:
            continue
        while mark - last > MOST:
            last += MOST
            out.append(last)
        if mark - last >= LEAST:
            out.append(mark)
            last = mark
    while n - last > MOST:
        last += MOST
        out.append(last)
    if n > last:
        out.append(n)
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _shift(crcs: np.ndarray, by: np.ndarray) -> np.ndarray:
    """crc32 values moved in front of ``by`` further bytes: times x to the power 8 * by, modulo the polynomial."""

    def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros_like(a)
        for bit in range(31, -1, -1):
            out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
            b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(0xEDB88320), b >> np.uint32(1))
        return out

    out, by = crcs.astype(np.uint32), by.astype(np.int64)
    power = np.full(1, 1 << 23, np.uint32)  # x to the power 8; the highest bit is the constant term
    while by.any():
        odd = (by & 1).astype(bool)
        if odd.any():
            out[odd] = times(out[odd], np.broadcast_to(power, odd.sum()).copy())
        power, by = times(power, power), by >> 1
    return out


def joined_crcs(crcs: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """crc32 of each of len(counts) documents from those of its chunks, in order; sizes are in bytes."""
    if not len(crcs):
        return np.zeros(len(counts), np.int64)
    ends = counts.cumsum()
    total = np.concatenate(([0], sizes.cumsum()))
    after = np.repeat(total[ends], counts) - total[1:]
    moved = _shift(crcs, after)
    out = np.bitwise_xor.reduceat(np.append(moved, np.uint32(0)), np.minimum(ends - counts, len(moved)))
    return np.where(counts > 0, out, 0).astype(np.int64)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd last node moves up as it is. No leaves: the digest of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        paired = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = paired + level[len(paired) * 2 :]
    return level[0]


def _staged(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """A row for each document (kind recipe) and for each chunk that its task has not sent yet (kind chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        encoder, squeeze = load(path), zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True)
        sent: set[bytes] = set()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            for texts in blocks(batch.column(1).to_pylist()):
                ids, counts = encoder.encode(texts)
                out: list[tuple] = []
                first = 0
                for doc_id, count in zip(batch.column(0)[done : done + len(texts)].to_pylist(), counts.tolist()):
                    own = np.append(ids[first : first + count], np.int32(end_id))
                    first += count
                    names, last = [], 0
                    for end in cuts(own):
                        chunk = own[last:end].astype("<u4")
                        name = digest(chunk.tobytes())
                        names.append(name)
                        if name not in sent:
                            if len(sent) > 500_000:
                                sent.clear()
                            sent.add(name)
                            width = 2 if chunk.max() < 1 << 16 else 4
                            out.append(("chunk", name, None, end - last, width, squeeze.compress(chunk.astype(f"<u{width}").tobytes())))
                        last = end
                    row += 1
                    out.append(("recipe", row.to_bytes(8, "big"), doc_id, len(own), None, b"".join(names)))
                done += len(texts)
                kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], [x.split()[0] for x in STAGED.split(", ")])

    return docs.mapInArrow(frugal(run), STAGED)


def _unpacked(name: bytes, n: int, width: int, payload: bytes) -> np.ndarray:
    """The ids of a chunk, compared with its name."""
    import zstandard

    try:
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), f"<u{width}").astype("<u4")
    except (zstandard.ZstdError, ValueError) as error:
        raise ValueError(f"chunk {name.hex()} cannot be read") from error
    if len(data) != n or digest(data.tobytes()) != name:
        raise ValueError(f"chunk {name.hex()} does not match its name")
    return data


class TokenStore:
    """The files below a root, in the workspace given."""

    def __init__(self, spark: SparkSession, space: Workspace) -> None:
        self.spark, self.space = spark, space

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(FILES[name]).parquet(self.space.path(name))

    @property
    def chunks(self) -> DataFrame:
        return self._read("store").where("kind = 'chunk'").select(F.col("key").alias("digest"), F.col("n").alias("n_ids"), "width", "payload")

    @property
    def recipes(self) -> DataFrame:
        return self._read("recipes")

    @property
    def manifest(self) -> DataFrame:
        return self._read("manifest")

    def write(self, docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
        """Encode every text of docs and write store, recipes and manifest."""
        small_batches(self.spark)
        staged = _staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), tokenizer or default_tokenizer(), end_id)
        staged.dropDuplicates(["kind", "key"]).write.partitionBy("kind").options(compression="none", **{"parquet.block.size": ROW_GROUP}).parquet(self.space.path("store"))
        found = self._read("store").where("kind = 'recipe'").select("doc_id", F.col("n").alias("n_tokens"), F.col("payload").alias("digests"))
        parts = max(1, found.count() // PART_DOCS)
        ordered = found.repartitionByRange(parts, "doc_id", "digests").withColumn("_part", F.spark_partition_id())
        ordered = self.space.hold(ordered, "ordered", None)
        sums = ordered.groupBy("_part").agg(F.sum("n_tokens").alias("_ids"))
        before = F.coalesce(F.sum("_ids").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.select("_part", before.alias("_before"))
        inside = Window.partitionBy("_part").orderBy("doc_id", "digests").rowsBetween(Window.unboundedPreceding, -1)
        starts = ordered.join(F.broadcast(sums) if parts <= BROADCAST_PARTS else sums, "_part")
        starts = starts.withColumn("start", F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        # ranges of starts, so that files follow each other as documents do
        filed = starts.repartitionByRange(parts, "start").sortWithinPartitions("start").withColumn("part", F.spark_partition_id())
        self.space.hold(filed.select("part", "doc_id", "start", "n_tokens", "digests", F.unhex(F.sha2("digests", 256)).alias("recipe")), "recipes", None)
        self.space.drop("ordered")
        self.space.hold(self._roots(), "manifest")
        return self

    def _roots(self) -> DataFrame:
        def roots(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("start")
            root = merkle_root(rows["leaf"].to_pylist())
            starts, sizes = rows["start"].to_numpy(), rows["n_tokens"].to_numpy()
            if (starts[0] + sizes.cumsum() != np.append(starts[1:], starts[0] + sizes.sum())).any():
                raise ValueError("a document does not start where the one before it ends")
            found = {"n_docs": rows.num_rows, "n_tokens": int(sizes.sum()), "start": int(starts[0])}
            return pa.table({"part": rows["part"][:1], **{k: pa.array([v], pa.int64()) for k, v in found.items()}, "root": [root]})

        # the digests are hashed as read; the recipe's own digest stands beside, so that a change of either shows
        named = F.sha2("digests", 256)
        line = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens", named, F.coalesce(F.hex("recipe"), F.lit("null")))
        rows = self.recipes.select("part", "start", "n_tokens", F.encode(line, "utf-8").alias("leaf"))
        return rows.groupBy("part").applyInArrow(roots, FILES["manifest"])

    def verify(self) -> None:
        """Raises if a recipe file does not give its part's root, or a part does not start where the one before ends."""
        both = self._roots().withColumn("_side", F.lit(1)).unionAll(self.manifest.withColumn("_side", F.lit(-1)))
        if not both.groupBy("part", "n_docs", "n_tokens", "start", "root").agg(F.sum("_side").alias("_left")).where("_left != 0").isEmpty():
            raise ValueError("the recipes don't match the manifest")
        before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if not self.manifest.select("start", before.alias("_before")).where("start <> _before").isEmpty():
            raise ValueError("a part does not start where the one before it ends")

    def _placed(self) -> DataFrame:
        """A row for each place of a chunk in a document."""
        names = F.expr("transform(sequence(0, int(length(digests)) div 16 - 1), i -> substring(digests, int(i * 16 + 1), 16))")
        return self.recipes.select("part", "start", "doc_id", "n_tokens", F.posexplode(names).alias("at", "digest"))

    def digests(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) for each document, from what the files hold.

        Every chunk is unpacked once, compared with its name and given a crc32; a document's crc32 is put together from
        those of its chunks, so only names and numbers are joined.
        """

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                crcs = [zlib.crc32(_unpacked(*row)) for row in zip(*(c.to_pylist() for c in batch.columns))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], ["digest", "n_ids", "crc"])

        def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = batch.column(3)
                flat = parts.flatten()
                sizes = 4 * flat.field(2).to_numpy()
                counts = np.diff(parts.offsets.to_numpy())
                ends = np.concatenate(([0], sizes.cumsum()))[counts.cumsum()]
                if (np.diff(ends, prepend=0) != 4 * batch.column(2).to_numpy()).any():
                    raise ValueError("a document's chunks do not have its number of ids")
                crcs = joined_crcs(flat.field(1).to_numpy(), sizes, counts)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

        chunks = self.chunks.mapInArrow(frugal(unpacked), "digest binary, n_ids long, crc long")
        places = self._placed().join(chunks, "digest", "left")
        parts = F.sort_array(F.collect_list(F.struct("at", F.coalesce("crc", F.raise_error(F.lit("a chunk is missing")).cast("long")).alias("crc"), "n_ids")))
        docs = places.groupBy("start", "doc_id", "n_tokens").agg(parts.alias("parts"))
        return docs.select("doc_id", "start", "n_tokens", "parts").mapInArrow(frugal(folded), "doc_id long, start long, n_tokens long, ids_crc32 long")

    def documents(self) -> DataFrame:
        """(doc_id, start, ids) for each document, put together again from its chunks."""

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for parts, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()):
                    out.append(np.concatenate([_unpacked(x["digest"], x["n_ids"], x["width"], x["payload"]) for x in parts]).astype(np.int32))
                    if len(out[-1]) != n:
                        raise ValueError("a document's chunks do not have its number of ids")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

        places = self._placed().join(self.chunks, "digest", "left")
        payload = F.coalesce("payload", F.raise_error(F.lit("a chunk is missing")).cast("binary")).alias("payload")
        parts = F.sort_array(F.collect_list(F.struct("at", "digest", "n_ids", "width", payload)))
        docs = places.groupBy("start", "doc_id", "n_tokens").agg(parts.alias("parts"))
        return docs.select("doc_id", "start", "n_tokens", "parts").mapInArrow(frugal(joined), "doc_id long, start long, ids array<int>")


def store(docs: DataFrame, **options) -> TokenStore:
    """Write docs to a new store in the shared folder.

    Null and empty texts hold the end id alone. Null ids come first; equal ids are ordered by recipe; repeated rows each
    have their recipe and their own start. An empty table gives empty files. Other columns are not read.
    """
    return TokenStore(docs.sparkSession, Workspace(docs.sparkSession, "token-store")).write(docs, **options)
