"""Near-duplicate groups by a chosen-path set similarity join.

Texts with equal shingle sets form a class. Classes are branched by TREES independent trees: a node's classes go to the
child of the minwise token that each has under the hash function of the tree and level. A node of LEAF classes or fewer
is compared exhaustively; a larger one branches again. Two sets of similarity s stay together for d levels with
probability s**d, so with 20 trees a pair at 0.75 is met with probability 0.996 where its nodes go down LEVELS levels,
and nearly always where one or two do.

What is still large after LEVELS levels holds near copies, or texts with much in common. Near copies have many pairs and
few components, so such a node is dealt into blocks of LEAF classes at random, and what these link is contracted first.
Then only the classes outside a node's largest component are still to be compared with it. Where they are more than
PROBES the node branches on, by tokens that it picks itself, into 4/3 children a level on average: as many as keep the
expected number of nodes that a pair at 0.75 shares at one, while texts below that thin out. So branching goes on until
nodes are small. A node that is ready has its probes and its classes dealt in blocks of LEAF, and each block of probes
meets each block of classes: no block grows with its node.

Two rounds link by estimates from the minwise tokens of all trees, a spanning forest of each block at most. The last
round goes over every node that still has several components: members whose estimate with another is ESTIMATE or more
are compared by prints of their whole sets, block by block, and again only a spanning forest leaves the block. All links
are confirmed on full sets, which are made anew for the classes in question only. Links, classes and components stay in
tables in the shared folder; components are found by alternating star steps. What has one row for each node or root is
written before rows are joined with it, so that adaptive execution can split the rows of a hot one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import Workspace, batches_of, frugal, row_key

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
TREES, LEVELS, LEAF = 20, 5, 48
#: Estimates have a standard error of 0.043 at 0.75, so that this is nearly six errors below.
ESTIMATE = 0.5
#: Classes outside a node's largest component that are compared with all of it; with more it branches on, at most
#: DEEPEST levels. What is large even then is compared all the same.
PROBES, DEEPEST = 4 * LEAF, 32
#: Edges from which on what a star step joins is written first, so that a root with many can be split.
STAR_EDGES = 1_000
#: Trees of the first round, whose links contract most copies before all trees are compared.
FIRST_TREES = 3
#: Keys of documents to be confirmed that are broadcast at most (64 MB); beyond that, texts are joined by a shuffle.
BROADCAST_IDS = 8_000_000
BLOCK_BYTES = 1 << 20

_rng = np.random.default_rng(6)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE, _WORDS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_FACTORS = _rng.integers(0, 1 << 31, TREES * LEVELS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _rng.integers(0, 1 << 32, TREES * LEVELS, dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.full(n, base))).cumprod(dtype=np.uint64)[:n]


_UP = _powers(_BASE, 1)
_DOWN = _UP


def _scale(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; grown as needed."""
    global _UP, _DOWN
    if len(_UP) < n:
        _UP = _powers(_BASE, 2 * n)
        _DOWN = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), 2 * n)
    return _UP, _DOWN


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte) of each word of a text's bytes."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_BLANK[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    up, down = _scale(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), (_BYTE[data] * up[: len(data)]).cumsum(dtype=np.uint64)))
    return _mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64)), begins


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; the whole sequence where it is shorter than one."""
    n = len(words)
    if not n:
        return words
    k = min(n, SHINGLE)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * _WORDS + words[i : n - k + 1 + i]
    out = _mixed(out + np.uint64(k))
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sets of texts, of which about BLOCK_BYTES are hashed at once."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) < BLOCK_BYTES:
            size += len(texts[end]) + 1
            end += 1
        hashes, begins = word_hashes(np.frombuffer(b"\n".join(texts[at:end]), np.uint8))
        sizes = np.fromiter((len(x) + 1 for x in texts[at:end]), np.int64, end - at)
        bounds = begins.searchsorted(np.concatenate(([0], sizes.cumsum())))
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield shingle_set(hashes[a:b])
        at = end


def minwise(found: np.ndarray) -> np.ndarray:
    """The minwise token under each hash function, all trees and levels."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.empty(len(_FACTORS), np.uint32)
    step = max(1, 200_000 // len(x))
    for i in range(0, len(out), step):
        out[i : i + step] = (x * _FACTORS[i : i + step, None] + _OFFSETS[i : i + step, None]).min(1)
    return out


def set_name(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _texts(column: pa.Array) -> list[bytes]:
    return [(x.as_py() or b"") for x in column.cast(pa.binary())]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, name, tokens) for each row of docs (doc_id, row, text); name is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                names, sizes, tokens = [], [], []
                for found in shingle_sets(_texts(part.column(2))):
                    sizes.append(len(found))
                    names.append(set_name(found) if len(found) else None)
                    tokens.append(minwise(found).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(tokens, pa.binary())],
                    ["doc_id", "row", "n_shingles", "name", "tokens"],
                )

    return docs.mapInArrow(frugal(run), "doc_id long, row long, n_shingles long, name binary, tokens binary")


def branch(space: Workspace, classes: DataFrame) -> DataFrame:
    """(tree, node, name, size, dense): nodes of two classes or more, after LEVELS levels at most; dense: still large."""
    token = lambda level: F.substring("tokens", (F.col("tree") * LEVELS + level) * 4 + 1, F.lit(4))
    rows = classes.select("name", "tokens", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    path = F.xxhash64("tree", token(0))
    rows = rows.select("tree", "name", path.alias("node"), F.substring("tokens", F.col("tree") * LEVELS * 4 + 5, F.lit(4 * LEVELS - 4)).alias("rest"))
    done = []
    for level in range(LEVELS):
        sizes = space.hold(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"sizes{level}")
        rows = space.hold(rows.join(sizes, "node"), f"level{level}", None)
        space.drop(f"sizes{level}")
        last = level == LEVELS - 1
        done.append(rows.where(F.col("size") <= LEAF).select("tree", "node", "name", "size", F.lit(False).alias("dense")))
        large = rows.where(F.col("size") > LEAF)
        if last:
            done.append(large.select("tree", "node", "name", "size", F.lit(True).alias("dense")))
        elif large.isEmpty():
            break
        rows = large.select("tree", "name", F.xxhash64("node", F.substring("rest", 1, 4)).alias("node"), F.expr("substring(rest, 5)").alias("rest"))
    return reduce(DataFrame.unionAll, done)


def deepen(space: Workspace, dense: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, name, label, size, apart, most) of nodes ready to be compared, from dense (node, name, label).

    apart counts the classes outside the node's largest component, most is that one's label. Nodes of one component are
    done with and left out; a node with more than PROBES classes apart branches on.
    """
    rows, done = dense.select("node", "name", "label"), []
    for level in range(DEEPEST + 1):
        counts = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        facts = counts.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("_top"), F.count(F.lit(1)).alias("_labels"))
        facts = facts.where("_labels > 1").select("node", "size", (F.col("size") - F.col("_top.n")).alias("apart"), F.col("_top.label").alias("most"))
        rows = space.hold(rows.join(space.hold(facts, f"facts{level}"), "node"), f"deep{level}", None)
        ready = (F.col("size") <= LEAF) | (F.col("apart") <= PROBES) | F.lit(level == DEEPEST)
        done.append(rows.where(ready).select("node", "name", "label", "size", "apart", "most"))
        more = rows.where(~ready)
        if more.isEmpty():
            break
        if not level:
            more = more.join(classes.select("name", "tokens"), "name")
        # one child, and in one node of three a second: 4/3 on average
        children = F.when(F.pmod(F.xxhash64("node", F.lit(level)), F.lit(3)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        more = more.select("node", "name", "label", "tokens", F.explode(children).alias("child"))
        pick = F.pmod(F.xxhash64("node", "child"), F.lit(TREES * LEVELS)).cast("int")
        rows = more.select(F.xxhash64("node", "child", F.substring("tokens", 4 * pick + 1, F.lit(4))).alias("node"), "name", "label", "tokens")
    return reduce(DataFrame.unionAll, done)


def probed(ready: DataFrame) -> DataFrame:
    """(node, block, name, label, base, probe) from what deepen returns: each probe meets each class in one block.

    A small node is one block. In a larger one classes are dealt in blocks of about LEAF, and probes likewise; every pair
    of such blocks is a block here. So a row is repeated at most apart / LEAF times, and a probe size / LEAF times.
    """
    small = ready.where(F.col("size") <= LEAF).select("node", F.lit(0).cast("long").alias("block"), "name", "label", F.lit(True).alias("base"), F.lit(True).alias("probe"))
    large = ready.where(F.col("size") > LEAF)
    dealt = F.xxhash64("name", "node")
    large = large.withColumn("_bases", F.ceil(F.col("size") / LEAF)).withColumn("_probes", F.ceil(F.col("apart") / LEAF))
    base = large.withColumn("_p", F.explode(F.expr("sequence(0L, _probes - 1)")))
    base = base.select("node", (F.pmod(dealt, F.col("_bases")) * F.col("_probes") + F.col("_p")).alias("block"), "name", "label", F.lit(True).alias("base"), F.lit(False).alias("probe"))
    probe = large.where("label <> most").withColumn("_b", F.explode(F.expr("sequence(0L, _bases - 1)")))
    block = F.col("_b") * F.col("_probes") + F.pmod(F.shiftrightunsigned(dealt, 7), F.col("_probes"))
    return small.unionAll(base).unionAll(probe.select("node", block.alias("block"), "name", "label", F.lit(False).alias("base"), F.lit(True).alias("probe")))


def _roots(n: int):
    """(find, join) of a union-find over n labels."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(a: int, b: int) -> bool:
        a, b = find(a), find(b)
        root[a] = b
        return a != b

    return find, join


def _passing(members: list[dict], one_way: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, those that pass the estimate with i, all estimates with i) for members of other labels.

    one_way: i is a probe and its partners are bases; otherwise partners come after i.
    """
    tokens = np.stack([np.frombuffer(x["tokens"], np.uint32) for x in members])
    n = np.array([x["n_shingles"] for x in members])
    labels = np.unique([x["label"] for x in members], return_inverse=True)[1]
    base = np.array([x["base"] for x in members])
    for i, member in enumerate(members):
        if one_way and not member["probe"]:
            continue
        alike = (tokens == tokens[i]).mean(1)
        fits = (alike >= ESTIMATE) & (labels != labels[i]) & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i]))
        if one_way:
            fits &= base
        else:
            fits[: i + 1] = False
        yield i, np.flatnonzero(fits), alike


def _blocks(rows: DataFrame, more: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(node, block, members) from rows (node, block, name, label, base, probe) and what more has by name."""
    member = F.struct("name", "label", "base", "probe", *columns)
    return rows.join(more.select("name", *columns), "name").groupBy("node", "block").agg(F.collect_list(member).alias("members"))


def _likely(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) by the estimate: of each block a spanning forest, the most similar pairs first.

    What an unconfirmed pair leaves apart is met in a later round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for members in (x.as_py() for x in batch.column(0)):
                edges = [(-alike[j], i, int(j)) for i, found, alike in _passing(members, False) for j in found]
                labels = np.unique([x["label"] for x in members], return_inverse=True)[1]
                _, join = _roots(len(members))
                out |= {tuple(sorted((members[i]["name"], members[j]["name"]))) for _, i, j in sorted(edges) if join(int(labels[i]), int(labels[j]))}
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    blocks = _blocks(rows, classes, ("n_shingles", "tokens")).select("members")
    return blocks.mapInArrow(frugal(run), "a binary, b binary").distinct()


def _near(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, block, name): members that pass the estimate with any other; as many rows as members at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, block, members in (tuple(x.as_py() for x in row) for row in zip(*batch.columns)):
                some = set()
                for i, found, _ in _passing(members, True):
                    if len(found):
                        some |= {i, *found.tolist()}
                out += [(node, block, name) for name in {members[i]["name"] for i in some}]
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["node", "block", "name"])

    blocks = _blocks(rows, classes, ("n_shingles", "tokens"))
    return blocks.mapInArrow(frugal(run), "node long, block long, name binary")


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from incidence matrices of some columns at a time."""
    m = len(sets)
    columns = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owners = np.repeat(np.arange(m), [len(x) for x in sets])
    order = columns.argsort(kind="stable")
    columns, owners = columns[order], owners[order]
    total = int(columns[-1]) + 1
    out, width = np.zeros((m, m), np.float32), min(total, max(1, (1 << 21) // m))
    for first in range(0, total, width):
        a, b = columns.searchsorted((first, first + width))
        part = np.zeros((m, width), np.float32)
        part[owners[a:b], columns[a:b] - first] = 1
        out += part @ part.T
    return out.astype(np.int64)


def slack(union: np.ndarray) -> np.ndarray:
    """Shingles by which 32-bit prints may misjudge a union: the pairs of shingles with one print, well above their mean."""
    mean = union.astype(float) ** 2 / 2.0**33
    return 2 + np.ceil(mean + 6 * np.sqrt(mean)).astype(np.int64)


def _linked(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) by the 32-bit prints of whole sets: a spanning forest of each block's links.

    Two shingles with one print can move a count by one. Pairs so near the limit that their slack would decide are passed
    on as well and join nothing; the confirmation on full sets decides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for members in (x.as_py() for x in batch.column(0)):
                sets = [np.frombuffer(x["prints"], np.uint32) for x in members]
                both = shared(sets)
                n = np.array(list(map(len, sets)))
                union = n[:, None] + n - both
                labels = np.unique([x["label"] for x in members], return_inverse=True)[1]
                base, probe = (np.array([x[k] for x in members]) for k in ("base", "probe"))
                asked = (probe[:, None] & base) & (labels[:, None] != labels)
                # a probe may stand in a block twice, as probe and as base; its two rows have one label
                off = slack(union)
                near = asked & (100 * (both + off) >= PERCENT * (union - off))
                _, join = _roots(len(members))
                for i, j in sorted(np.argwhere(near).tolist(), key=lambda p: -both[p[0], p[1]] / union[p[0], p[1]]):
                    sure = 100 * (both[i, j] - off[i, j]) >= PERCENT * (union[i, j] + off[i, j])
                    if not sure or join(int(labels[i]), int(labels[j])):
                        out.add(tuple(sorted((members[i]["name"], members[j]["name"]))))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    blocks = _blocks(rows, prints, ("prints",)).select("members")
    return blocks.mapInArrow(frugal(run), "a binary, b binary").distinct()


def full_sets(docs: DataFrame, names: DataFrame, classes: DataFrame, prints: bool = False) -> DataFrame:
    """(name, members), or (name, prints), of the classes in names, made anew from one of each class's texts."""
    keys = names.join(classes.select("name", "first.row"), "name").select("row").distinct()
    small = keys.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(keys) if small else keys, "row", "left_semi")
    column = "prints" if prints else "members"
    as_bytes = (lambda x: np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes()) if prints else np.ndarray.tobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()  # equal rows have one key: a task sends the set of many copies once
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                found = {set_name(x): x for x in shingle_sets(_texts(batch.slice(first, 500).column(0)))}
                new = [x for x in found if x not in sent]
                sent.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array([as_bytes(found[x]) for x in new], pa.binary())], ["name", column])

    found = texts.select("text").mapInArrow(frugal(run), f"name binary, {column} binary")
    return found.join(names, "name", "left_semi").dropDuplicates(["name"])


def confirm(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. docs has row and text."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], ["a", "b"])

    found = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct(), classes)
    one = pairs.join(found.select(F.col("name").alias("a"), F.col("members").alias("of_a")), "a")
    two = one.join(found.select(F.col("name").alias("b"), F.col("members").alias("of_b")), "b")
    return two.select("a", "b", "of_a", "of_b").mapInArrow(frugal(check), "a binary, b binary")


def components(space: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(node, root) for each end of links (a, b), root the smallest node that it is connected with.

    Large-star and small-star steps in turn, each a join on the smallest neighbour, until each node has one link, to its
    root: a number of rounds of the order of the squared logarithm of the nodes.
    """

    def star(edges: DataFrame, large: bool, many: bool) -> DataFrame:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        if many:
            least = space.hold(least, f"{name}-least{int(large)}", 1)
        joined = both.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    edges = space.hold(links.where("a <> b").distinct(), f"{name}-0", 1)
    many, before, turn = edges.limit(STAR_EDGES + 1).count() > STAR_EDGES, None, 0
    while True:
        turn += 1
        edges = space.hold(star(star(edges, True, many), False, many), f"{name}-{turn}", 1)
        space.drop(f"{name}-{turn - 1}")
        state = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, n_shingles, component_id, first_row) for each row of docs, as near_duplicates says.

    row is the row_key of id and text, first_row that of the first row of its group, by id (null last) and key. Rows of
    the empty set are each the first.
    """
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    with batches_of(docs.sparkSession, 200):  # a batch's row may be a block of LEAF classes with their sets
        return _groups(docs.select(doc_id.alias("doc_id"), row_key(doc_id, text).alias("row"), text.alias("text")))


def _groups(docs: DataFrame) -> DataFrame:
    space = Workspace(docs.sparkSession, "near-dedup")
    rows = space.hold(sketches(docs), "sketches", None)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    full = rows.where("name is not null")
    classes = space.hold(full.groupBy("name").agg(F.min(first).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens")), "classes", None)
    nodes = branch(space, classes)
    labels: DataFrame | None = None
    links: DataFrame | None = None
    for turn, (trees, last) in enumerate(((FIRST_TREES, False), (TREES, False), (TREES, True))):
        own = nodes.where(F.col("tree") < trees)
        if labels is None:
            own = own.withColumn("label", F.col("name"))
        else:
            own = own.join(labels.select(F.col("node").alias("name"), F.col("root").alias("label")), "name", "left").withColumn("label", F.coalesce("label", "name"))
        if turn:
            mixed = own.groupBy("node").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("node")
            own = space.hold(own.join(space.hold(mixed, f"several{turn}"), "node", "left_semi"), f"mixed{turn}", None)
        if not last:
            blocks = F.when(F.col("dense"), F.ceil(F.col("size") / LEAF)).otherwise(1)
            sides = own.select("node", F.pmod(F.xxhash64("name", "tree"), blocks).alias("block"), "name", "label", F.lit(True).alias("base"), F.lit(True).alias("probe"))
            pairs = _likely(sides, classes)
        else:
            leaves = own.where("not dense").select("node", "name", "label", "size", F.lit(0).cast("long").alias("apart"), F.lit(None).cast("binary").alias("most"))
            sides = probed(leaves.unionAll(deepen(space, own.where("dense"), classes)))
            near = space.hold(_near(sides, classes), "near", None)
            prints = full_sets(docs, near.select("name").distinct(), classes, prints=True)
            pairs = _linked(sides.join(near, ["node", "block", "name"], "left_semi"), prints)
        pairs = space.hold(pairs, f"pairs{turn}")
        if not pairs.isEmpty():
            confirmed = space.hold(confirm(docs, pairs, classes), f"links{turn}", None)
            links = confirmed if links is None else links.unionAll(confirmed)
            labels = space.hold(components(space, links, f"stars{turn}"), f"labels{turn}", 1)
    of_class = classes.select("name", "first")
    if labels is not None:
        of_class = of_class.join(labels.select(F.col("node").alias("name"), "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))
        least = space.hold(of_class.groupBy("root").agg(F.min("first").alias("first")), "least")
        of_class = space.hold(of_class.select("name", "root").join(least, "root").select("name", "first"), "firsts", None)
    own, keep = first.alias("first"), ("doc_id", "row", "n_shingles", "first")
    placed = full.select("doc_id", "row", "n_shingles", "name").join(of_class, "name").select(*keep)
    out = placed.unionAll(rows.where("name is null").select("doc_id", "row", "n_shingles", own))
    out = out.select("doc_id", "row", "n_shingles", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row"))
    out = space.hold(out, "groups", None)
    space.keep("groups")
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Words are runs without ASCII white space, A-Z lowered; a set has the distinct runs of SHINGLE words, or the whole
    sequence of a shorter text. component_id is the smallest doc_id reachable over links, kept whether it is the row's.
    Null, empty and blank texts have the empty set, link with nothing and are kept. Rows without an id are linked like
    others but name no component: theirs is null where no other row names it, and they are kept then. Rows that repeat
    an id are told apart by their sets. An empty table gives an empty result; other columns are not read.
    """
    out = groups(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
