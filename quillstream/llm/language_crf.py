"""Language identification by a linear-chain conditional random field over words.

A word's emission sums learned weights of its character n-grams, of its prefixes and suffixes, and of itself if it is in
the lexicon: the words that labelled texts have often enough, each with weights of its own; n-grams and affixes share
hashed ones. Transitions between the languages of neighbouring words are learned too, from sequences that put runs of
words from several labelled documents together; every word of every fitted row is in one. Forward-backward gives each
word of a text, which may switch languages, a distribution; a document's language is the one with the largest mean.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import digest_sample, frugal, held_out, release, small_batches

UNDETERMINED = "und"
BUCKETS = 1 << 16
LONGEST_GRAM, LONGEST_AFFIX = 4, 6
#: A word is in the lexicon if the fitted rows have it so often; of more than LEXICON_WORDS the most frequent are.
LEXICON_LEAST, LEXICON_WORDS = 3, 50_000
#: A fit takes this many labelled rows at most, those with the smallest digests of their id. Of a text of more than
#: FIT_RUNS * RUN_CHARS characters it takes FIT_RUNS runs of RUN_CHARS, evenly spread from its start to its end, so that
#: the driver holds 48 MB of text at most.
FIT_ROWS, FIT_RUNS, RUN_CHARS = 3_000, 4, 1_000
#: Words in a step of the fit; the least numbers of passes over all words, and of steps.
STEP_WORDS, PASSES, STEPS = 16_000, 2, 60
RATE, DECAY = 0.08, 1e-6
#: Cells (words times documents, with padding) that forward-backward holds at once.
CELLS = 100_000
#: Words that a worker remembers the emissions of.
REMEMBERED = 200_000
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_runs long"


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(weights' places of all features, where each word's begin): n-grams of \\x02 word \\x03, affixes, the word itself."""
    code = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begins = sizes.cumsum() - sizes
    place = np.arange(len(code)) - np.repeat(begins, sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = place == np.repeat(sizes, sizes) - 1
    found, owners, gram = [], [], np.zeros(len(code), np.uint64)
    for n in range(1, LONGEST_AFFIX + 2):
        before = np.concatenate((np.zeros(1, np.uint64), gram[:-1])) if n > 1 else gram
        gram = (before + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) + code * np.uint64(0xBF58476D1CE4E5B9)
        # beyond the longest n-gram only what begins or ends with a mark: prefixes and suffixes
        whole = place >= n - 1 if n <= LONGEST_GRAM else (place == n - 1) | (place >= n - 1) & ends
        found.append((gram[whole] >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(owner[whole])
    known = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    owners.append(np.flatnonzero(known >= 0))
    found.append(BUCKETS + known[owners[-1]])
    owner, flat = np.concatenate(owners), np.concatenate(found)
    counts = np.bincount(owner, minlength=len(words))
    return flat[owner.argsort(kind="stable")], counts.cumsum() - counts


def forward(emissions: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward variables (time, sequence, label), each emission included, scaled to add up to 1 every few steps."""
    out = np.empty_like(emissions)
    if len(emissions):
        out[0] = emissions[0]
    for t in range(1, len(emissions)):
        np.matmul(out[t - 1], moves, out=out[t])
        out[t] *= emissions[t]
        if t % 4 == 0:
            out[t] /= out[t].sum(1, keepdims=True)
    return out


def reversed_each(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence backwards, still beginning at time 0; padding stays where it is."""
    times = np.arange(len(x))[:, None]
    return np.take_along_axis(x, np.where(times < lengths, lengths - 1 - times, times)[..., None], 0)


def posteriors(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward-backward: label distributions (time, sequence, label). What stands beyond a sequence's end means nothing."""
    ahead = forward(emissions, moves)
    back = reversed_each(forward(reversed_each(emissions, lengths), np.ascontiguousarray(moves.T)), lengths)
    both = ahead * back / emissions
    return both / both.sum(2, keepdims=True)


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    weights: np.ndarray  # (BUCKETS + words of the lexicon, labels)
    moves: np.ndarray  # (labels, labels), logarithms
    lexicon: dict[str, int]


class Tagger:
    """A model with the emissions of the words that a worker has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        moves = model.moves - model.moves.max() if model.labels else model.moves
        self.moves = np.exp(moves)
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.held = np.zeros((1 << 14, len(self.model.labels)))

    def emissions(self, words: list[str]) -> np.ndarray:
        """(word, label), the largest of each word 1."""
        if len(self.places) > REMEMBERED:
            self._clear()
        get = self.places.get
        places = list(map(get, words))
        if None in places:
            new = list(dict.fromkeys(w for w, p in zip(words, places) if p is None))
            flat, begins = features(new, self.model.lexicon)
            logs = np.add.reduceat(self.model.weights[flat], begins, axis=0)
            have = len(self.places)
            while len(self.held) < have + len(new):
                self.held = np.concatenate((self.held, np.zeros_like(self.held)))
            self.held[have : have + len(new)] = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -30))
            self.places.update(zip(new, range(have, have + len(new))))
            places = list(map(get, words))
        return self.held[np.array(places, np.int64)]

    def tag(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Label distributions (word, label) of each list of words."""
        out: list = [np.zeros((0, len(self.model.labels)))] * len(texts)
        order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: -len(texts[i]))
        while order:
            longest = len(texts[order[0]])
            group, order = order[: max(1, CELLS // longest)], order[max(1, CELLS // longest) :]
            lengths = np.array([len(texts[i]) for i in group])
            flat = self.emissions([w for i in group for w in texts[i]])
            inside = np.arange(longest) < lengths[:, None]
            padded = np.ones((len(group), longest, flat.shape[1]))
            padded[inside] = flat
            found = posteriors(np.ascontiguousarray(padded.transpose(1, 0, 2)), lengths, self.moves)
            for column, (i, n) in enumerate(zip(group, lengths)):
                out[i] = found[:n, column]
        return out


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mixed(samples: list[tuple[list[str], int]], rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Sequences of up to four runs of 4 to 40 words each, from random samples; each word of each sample is in one run."""
    pieces = []
    for words, y in samples:
        at = 0
        while at < len(words):
            n = int(rng.integers(4, 41))
            pieces.append((words[at : at + n], y))
            at += n
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    out, at = [], 0
    while at < len(pieces):
        own = pieces[at : at + int(rng.integers(1, 5))]
        at += len(own)
        out.append(([w for words, _ in own for w in words], [y for words, y in own for _ in words]))
    return out


def _slopes(emission: np.ndarray, truth: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the log-likelihood for emissions (time, sequence, label) and for moves."""
    k = len(moves)
    a = np.exp(moves - moves.max())
    inside = np.arange(len(emission))[:, None] < lengths
    gold = np.eye(k)[truth] * inside[..., None]
    # expected transitions, from forward variables and those of the reversed sequences
    ahead = forward(emission, a)
    back = reversed_each(forward(reversed_each(emission, lengths), np.ascontiguousarray(a.T)), lengths)
    both = ahead * back / emission
    gamma = both / both.sum(2, keepdims=True) * inside[..., None]
    joint = np.einsum("tbi,ij,tbj->tbij", ahead[:-1], a, back[1:])
    joint /= joint.sum((2, 3), keepdims=True)
    joint *= inside[1:, :, None, None]
    return gold - gamma, np.einsum("tbi,tbj->ij", gold[:-1], gold[1:]) - joint.sum((0, 1))


def _all_features(words: list[str], lexicon: dict[str, int], at_once: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words, how many each has), some words at a time."""
    flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for first in range(0, len(words), at_once):
        found, begins = features(words[first : first + at_once], lexicon)
        flat.append(found.astype(np.int32))
        sizes.append(np.diff(np.append(begins, len(found))))
    return np.concatenate(flat), np.concatenate(sizes)


def train(samples: list[tuple[list[str], str]], seed: int = 4) -> Model:
    """Maximum likelihood with a weak pull to 0, by Adam on some sequences at a time.

    Every pass goes over all words of all samples, mixed anew; samples of one language at a time would teach no moves.
    """
    samples = [s for s in samples if s[0]]
    labels = tuple(sorted({lang for _, lang in samples}))
    k = len(labels)
    if not k:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros((0, 0)), {})
    rng = np.random.default_rng(seed)
    counts = Counter(w for words, _ in samples for w in words)
    often = sorted((w for w, n in counts.items() if n >= LEXICON_LEAST), key=lambda w: (-counts[w], w))[:LEXICON_WORDS]
    lexicon = {w: i for i, w in enumerate(often)}
    types = {w: i for i, w in enumerate(counts)}
    flat, sizes = _all_features(list(types), lexicon)
    begins = sizes.cumsum() - sizes
    own = [(words, labels.index(lang)) for words, lang in samples]
    passes = max(PASSES, -(-STEPS * STEP_WORDS // counts.total()))
    steps, step = max(STEPS, passes * counts.total() // STEP_WORDS), 0
    weights, moves = np.zeros((BUCKETS + len(lexicon), k)), np.zeros((k, k))
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    for _ in range(passes):
        sequences = mixed(own, rng)
        ends = np.cumsum([len(w) for w, _ in sequences])
        for part in np.split(np.arange(len(sequences)), np.searchsorted(ends, np.arange(STEP_WORDS, ends[-1], STEP_WORDS))):
            if not len(part):
                continue
            step += 1
            lengths = np.array([len(sequences[i][0]) for i in part])
            ids, truth = np.zeros((2, lengths.max(), len(part)), np.int64)
            for c, i in enumerate(part.tolist()):
                ids[: lengths[c], c] = [types[w] for w in sequences[i][0]]
                truth[: lengths[c], c] = sequences[i][1]
            inside = np.arange(len(ids))[:, None] < lengths
            seen, at = np.unique(ids[inside], return_inverse=True)
            ends_of = sizes[seen].cumsum()
            places = flat[np.repeat(begins[seen] - ends_of + sizes[seen], sizes[seen]) + np.arange(ends_of[-1])]
            logs = np.add.reduceat(weights[places], ends_of - sizes[seen], axis=0)
            emission = np.ones((*ids.shape, k))
            emission[inside] = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -30))[at]
            rest, slope_moves = _slopes(emission, truth, lengths, moves)
            rest = rest[inside]
            by_word = np.stack([np.bincount(at, rest[:, y], len(seen)) for y in range(k)], 1)
            by_place = np.repeat(by_word, sizes[seen], axis=0)
            total = len(rest)
            slope = np.stack([np.bincount(places, by_place[:, y], len(weights)) for y in range(k)], 1) / total - DECAY * weights
            rate = RATE * (1 - 0.9 * min(1.0, step / steps))
            for j, (x, g) in enumerate(((weights, slope), (moves, slope_moves / total - DECAY * moves))):
                m, v = state[2 * j], state[2 * j + 1]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model(labels, weights, moves, lexicon)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from fit_rows rows at most (the smallest digests of their id) with a language that are not held out.

    Long texts give FIT_RUNS runs. Without any such row no language is known, and all is undetermined.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    picked = digest_sample(rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")), "_id", fit_rows)
    last = F.length("_text") - RUN_CHARS
    at = lambda i: F.floor(last * i / (FIT_RUNS - 1)).cast("int") + 1
    spread = F.array_join(F.array(*(F.substring("_text", at(i), F.lit(RUN_CHARS)) for i in range(FIT_RUNS))), "\n")
    body = F.when(last <= RUN_CHARS * (FIT_RUNS - 1), F.col("_text")).otherwise(spread)
    rows = picked.select("_digest", "_lang", body.alias("_body")).orderBy("_digest", "_lang", "_body").collect()
    once: dict[str, str] = {}  # equal words are one string
    model = train([([once.setdefault(w, w) for w in words_of(r["_body"])], r["_lang"]) for r in rows])
    release()
    return model


def runs(tags: np.ndarray, labels: tuple[str, ...]) -> list[tuple[int, int, str]]:
    """(first word, end, label) of each run of words with the same likeliest label."""
    if not len(tags):
        return []
    best = tags.argmax(1)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(best)) + 1, [len(best)]))
    return [(int(a), int(b), labels[best[a]]) for a, b in zip(starts[:-1], starts[1:])]


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[list[str]]]]:
    """(first row, words of the rows from there), a few hundred thousand words at once."""
    texts: list[list[str]] = []
    first = size = 0
    for i, x in enumerate(batch.column(column)):
        texts.append(words_of(x.as_py()))
        size += len(texts[-1])
        if size >= 2 * CELLS:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), least: float | None = None) -> DataFrame:
    """SCHEMA, and the columns in keep, for each row of docs, from its whole text; least: only rows of such a score.

    score is the mean probability of lang_pred over the words; n_runs counts runs of words of one language. Null, empty
    and letterless texts are 'und' with score 0, as are all texts if the model knows no language. A null id stays null
    and is not held out; repeated rows give repeated results; ties go to the first label; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS + LEXICON_WORDS weights for each language, and so many words
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Tagger(sent.value))
        tagger, labels = made[0], sent.value.labels
        for batch in batches:
            for first, texts in _blocks(batch, 2):
                out: list[tuple] = []
                for words, tags in zip(texts, tagger.tag(texts) if labels else [np.zeros((0, 0))] * len(texts)):
                    if len(tags):
                        mean = tags.mean(0)
                        best = tags.argmax(1)
                        out.append((labels[int(mean.argmax())], float(min(1.0, mean.max())), len(words), 1 + int((best[1:] != best[:-1]).sum())))
                    else:
                        out.append((UNDETERMINED, 0.0, len(words), 0))
                columns = [pa.array(x, k) for x, k in zip(zip(*out), (pa.string(), pa.float64(), pa.int64(), pa.int64()))]
                given = [c.slice(first, len(texts)) for c in batch.columns]
                found = pa.RecordBatch.from_arrays([*given[:2], *columns, *(given[i] for i in places)], names)
                yield found if least is None else found.filter(pa.array([x[1] >= least for x in out], pa.bool_()))

    small_batches(docs.sparkSession)
    others = [c for c in keep if c != text_col]  # the text goes to Python once
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text"), *others)
    places = [2 if c == text_col else 3 + others.index(c) for c in keep]
    names = [x.split()[0] for x in SCHEMA.split(", ")] + list(keep)
    schema = ", ".join([SCHEMA, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)])
    return rows.mapInArrow(frugal(run, made.clear), schema)


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first, end, lang) for each run of words of one language in each text; words are numbered from 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger, labels = Tagger(sent.value), sent.value.labels
        for batch in batches:
            for first, texts in _blocks(batch, 1):
                found = [(i, *r) for i, tags in enumerate(tagger.tag(texts)) for r in runs(tags, labels)]
                ids = batch.column(0)[first : first + len(texts)].take(pa.array([x[0] for x in found], pa.int64()))
                columns = [pa.array([x[c] for x in found], k) for c, k in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()))]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "first", "end", "lang"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(frugal(run), "doc_id long, first long, end long, lang string")
