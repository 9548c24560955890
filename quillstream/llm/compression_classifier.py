"""Quality as a difference of compressed sizes.

Two zstandard dictionaries are trained, on labelled good and on labelled bad texts. A text is compressed with each,
block by block, so that a long text's later blocks count like the first; the dictionaries are trained on such blocks too,
which stand all over the labelled texts. The normalised difference

    d = (bytes with the bad dictionary - bytes with the good one) / (their sum)

is positive for text like the good samples. A logistic curve, fitted on labelled rows that trained no dictionary, turns
it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import digest_sample, frugal, held_out, release, small_batches

BLOCK = 4096
LEVEL = 3
#: Labelled rows of each label that a fit takes at most: those with the smallest digests of their id.
FIT_ROWS = 3_000
#: Blocks of a fitted row that are used, evenly spread from its first byte to its last; a text of no more bytes is used as
#: a whole. With FIT_ROWS it bounds what the driver holds (98 MB).
FIT_BLOCKS = 4
DICTIONARY_BYTES = 400_000
#: Length of the segments that a dictionary is put together from, and of the strings whose frequency picks them.
SEGMENT, STRING = 400, 8
#: From this score on a text is predicted to be good.
THRESHOLD = 0.7
SCHEMA = "doc_id long, held_out boolean, difference double, score double, predicted int"


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    bias: float
    level: int = LEVEL


class Scorer:
    """The two compressors of a model; dictionaries are digested once for each worker."""

    def __init__(self, model: Model) -> None:
        import zstandard

        self.model = model
        self.pair = []
        for content in (model.good, model.bad):
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=model.level)
            self.pair.append(zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, data: bytes) -> float:
        if not data:
            return 0.0
        good, bad = (sum(len(c.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)) for c in self.pair)
        return (bad - good) / (bad + good)

    def score(self, difference: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.model.slope * difference + self.model.bias, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton's method, with targets drawn in as Platt did and a weak pull to 0."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - t) + 1e-3 * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the blocks of all samples; where they are too few to train on, their bytes as they are."""
    import zstandard

    parts = [x[i : i + BLOCK] for x in samples for i in range(0, len(x), BLOCK)]
    total = sum(map(len, parts))
    try:
        return zstandard.train_dictionary(min(size, total // 2), parts, k=SEGMENT, d=STRING).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def _spread(text: Column) -> Column:
    """FIT_BLOCKS blocks of a text's bytes, evenly spread over its length; all its bytes where it has no more."""
    data = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    last = F.octet_length(data) - BLOCK
    at = lambda i: F.floor(last * i / (FIT_BLOCKS - 1)).cast("int") + 1
    return F.when(last <= BLOCK * (FIT_BLOCKS - 1), data).otherwise(F.concat(*(F.substring(data, at(i), F.lit(BLOCK)) for i in range(FIT_BLOCKS))))


def fit(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, dictionary_bytes: int = DICTIONARY_BYTES, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "quality",
) -> Model:
    """A model from labelled rows that are not held out, fit_rows of each label at most and FIT_BLOCKS blocks of each.

    Two of three rows train the dictionaries, the third calibrates. Null labels and ids labelled in two ways are left
    out. Without both labels there is nothing to tell apart: every text then scores 0.5.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"), F.max(label_col).alias("_high")).where("_label = _high")
    order = (F.md5(F.col("_id").cast("string")), "_id")
    picked = [digest_sample(marked.where(F.col("_label") == y), "_id", fit_rows).select("_id", "_label") for y in (0, 1)]
    picked = picked[0].unionAll(picked[1])
    rows = docs.select(F.col(id_col).alias("_id"), _spread(F.col(text_col)).alias("_body")).join(F.broadcast(picked), "_id")
    rows = rows.orderBy(*order).limit(2 * fit_rows).collect()
    by = {y: [bytes(r["_body"]) for r in rows if r["_label"] == y and r["_body"]] for y in (0, 1)}
    if min(map(len, by.values())) < 3:
        return Model(b"", b"", 0.0, 0.0)
    content = [_dictionary([x for i, x in enumerate(by[y]) if i % 3 != 2], dictionary_bytes) for y in (1, 0)]
    scorer = Scorer(Model(*content, 1.0, 0.0))
    seen = [(scorer.difference(x), y) for y in (0, 1) for i, x in enumerate(by[y]) if i % 3 == 2]
    release()
    return Model(*content, *_logistic(*np.array(seen).T))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA for each row of docs, from its whole text.

    Null and empty texts have the difference 0 and the score that the curve gives it. A null id stays null and is not
    held out; repeated rows give repeated results; other columns are not read.
    """
    cached: list = []
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cached:
            cached.append(Scorer(sent.value) if sent.value.good else None)
        scorer = cached[0]
        for batch in batches:
            texts = ((x.as_py() or "").encode() for x in batch.column(2))
            found = [scorer.difference(x) if scorer else 0.0 for x in texts]
            scores = [scorer.score(d) if scorer else 0.5 for d in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(found, pa.float64()), pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), held_out(F.col(id_col)), text_col).mapInArrow(frugal(run), SCHEMA)
