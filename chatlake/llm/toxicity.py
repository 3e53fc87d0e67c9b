"""Toxicity by gradient-boosted trees over dense features of the whole text, with isotonic calibration.

Features are densities of lexicon words, how near they stand to words of the second person, shares of
capitals, punctuation and digits, and how often lexicon words appear only after spellings with signs or
digits inside are undone. Besides common insults the lexicon holds words and word beginnings learned from
labelled rows by log-odds, so that it follows the language of the corpus. One half of a bounded sample of
labelled rows gives the lexicon, four fifths of the other half the trees (by histograms), and the rest the
isotonic map from raw scores to probabilities.

Null, empty and wordless texts have all features zero and get the score of such a text. Without labels of
both kinds every score is the share of label 1 (0 if there is none). Repeated rows are scored each. Only
doc_id and text of the input are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import (
    LOWER,
    SPACE_BYTE,
    WORD_BYTE,
    labelled_sample,
    map_texts,
    prefix_sums,
    runs,
    slices,
    span_hashes,
    sums_per,
    text_bytes,
)
from chatlake.session import cut_lineage

#: Labelled rows used for fitting, at most.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST = 60, 3, 0.2, 32, 5
#: Words between a lexicon word and one of the second person.
NEAR = 4

#: Common insults; strong ones first, then mild ones.
STRONG = (
    "idiot idiots moron morons scum loser losers trash stupid worthless pathetic disgusting clown clowns "
    "imbecile bastard bitch asshole dumbass retard degenerate vermin filth scumbag "
    "trottel arschloch dummkopf abschaum wichser hurensohn "
    "connard salaud abruti ordure imbécile crétin "
    "imbécil cabrón basura escoria gilipollas pendejo"
).split()
MILD = (
    "dumb fool fools liar liars jerk creep freak ugly hate sucks crap garbage shut ridiculous "
    "dumm blöd lügner hässlich hasse nul menteur moche déteste tonto feo mentiroso odio"
).split()
SECOND = (
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton votre vous tú ti usted ustedes"
).split()

_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "@$*!.-_+#"]] = True
_SIGN[48:58] = True
_LEET = np.arange(256, dtype=np.uint8)
for _sign, _letter in zip("013457@$!", "oieastasi", strict=True):
    _LEET[ord(_sign)] = ord(_letter)

#: Bytes of a word's beginning that count as a term of their own.
BEGINNING = 4
#: A learned term needs this many labelled rows of label 1 ...
SUPPORT = 3
#: ... and log-odds of this much for the mild and for the strong list; each list has at most LISTED terms.
ODDS = (2.0, 3.5)
LISTED = 4096


def _hashes(words: list[str]) -> np.ndarray:
    joined = "".join(words).encode()
    sizes = np.array([len(word.encode()) for word in words])
    ends = np.cumsum(sizes)
    return np.sort(span_hashes(prefix_sums(np.frombuffer(joined, np.uint8)), ends - sizes, ends))


_WORDS = {name: _hashes(words) for name, words in (("strong", STRONG), ("mild", MILD), ("second", SECOND))}


@dataclass
class Lexicon:
    """Sorted hashes of learned terms."""

    strong: np.ndarray
    mild: np.ndarray


NOTHING = Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _held(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(len(hashes), bool)
    return words[np.minimum(np.searchsorted(words, hashes), len(words) - 1)] == hashes


def _terms(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and of its beginning (kept apart from words)."""
    sums = prefix_sums(low)
    begins = span_hashes(sums, starts, np.minimum(ends, starts + BEGINNING)) ^ np.uint64(1)
    return span_hashes(sums, starts, ends), begins


FEATURES = (
    "strong strong_count mild learned learned_count learned_mild second near capitals capital_words "
    "punctuation marks digits signs hidden hidden_count spelled mean_word"
).split()


def text_features(texts: pa.Array, lexicon: Lexicon = NOTHING) -> np.ndarray:
    """One row of features per text."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, len(FEATURES)))
    low = LOWER[data]
    word = WORD_BYTE[data]
    starts, ends = runs(word, offsets)
    bounds = np.searchsorted(starts, offsets)
    words = np.maximum(np.diff(bounds), 1).astype(np.float64)
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    hashes, begins = _terms(low, starts, ends)
    strong, mild, second = (_held(hashes, _WORDS[name]) for name in ("strong", "mild", "second"))
    learned = _held(hashes, lexicon.strong) | _held(begins, lexicon.strong)
    learned_mild = _held(hashes, lexicon.mild) | _held(begins, lexicon.mild)
    # a lexicon word with one of the second person a few words away, in the same text
    doc = np.repeat(np.arange(n), np.diff(bounds))
    until = np.concatenate([[0], np.cumsum(second)])
    at = np.arange(len(starts))
    a = np.maximum(at - NEAR, bounds[:-1][doc])
    b = np.minimum(at + NEAR + 1, bounds[1:][doc])
    near = (strong | mild | learned) & (until[b] > until[a])
    upper = (data >= 65) & (data <= 90)
    ups = np.concatenate([[0], np.cumsum(upper)])
    capital = (ups[ends] - ups[starts] == ends - starts) & (ends - starts > 1)
    # what tokens read without their signs, or with signs and digits read as letters
    t0, t1 = runs(~SPACE_BYTE[data], offsets)
    insults = np.concatenate([[0], np.cumsum(strong)])
    plain_found = insults[np.searchsorted(starts, t1)] > insults[np.searchsorted(starts, t0)]
    hidden = np.zeros(len(t0), bool)
    for read in (low, _LEET[low]):
        letters = WORD_BYTE[read] & ~((read >= 48) & (read <= 57))
        place = np.concatenate([[0], np.cumsum(letters)])
        hidden |= _held(span_hashes(prefix_sums(read[letters]), place[t0], place[t1]), _WORDS["strong"])
    hidden &= ~plain_found
    token_bounds = np.searchsorted(t0, offsets)
    sign = _SIGN[data]
    spelled = np.zeros(len(data), bool)
    spelled[1:-1] = sign[1:-1] & (word & ~sign)[:-2] & (word & ~sign)[2:]
    real = np.diff(offsets) > 0
    spelled[offsets[:-1][real]] = spelled[offsets[1:][real] - 1] = False
    punctuation = ~word & ~SPACE_BYTE[data]
    marks = (data == 33) | (data == 63)
    digits = (data >= 48) & (data <= 57)
    per_byte = [sums_per(x.astype(np.int32), offsets) / size for x in (upper, punctuation, marks, digits, sign, spelled)]
    per_word = [
        sums_per(x.astype(np.int32), bounds)
        for x in (strong, mild, learned, learned_mild, second, near, capital, ends - starts)
    ]
    found = sums_per(hidden.astype(np.int32), token_bounds)
    return np.stack(
        [
            per_word[0] / words,
            per_word[0],
            per_word[1] / words,
            per_word[2] / words,
            per_word[2],
            per_word[3] / words,
            per_word[4] / words,
            per_word[5] / words,
            per_byte[0],
            per_word[6] / words,
            per_byte[1],
            per_byte[2],
            per_byte[3],
            per_byte[4],
            found / words,
            found,
            per_byte[5],
            per_word[7] / words,
        ],
        axis=1,
    )


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Terms that mark label 1, from rows with text and label: document counts by term, then log-odds.

    Counting is distributed; only the bounded lists reach the driver.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column("text"))
        starts, ends = runs(WORD_BYTE[data], offsets)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(np.searchsorted(starts, offsets)))
        label = batch.column("label").to_numpy().astype(np.int64)
        terms = np.concatenate(_terms(LOWER[data], starts, ends))
        pairs = np.unique(np.stack([terms, np.concatenate([doc, doc]).astype(np.uint64)]), axis=1) if len(terms) else np.zeros((2, 0), np.uint64)
        term, first = np.unique(pairs[0], return_index=True)
        ones = label[pairs[1].astype(np.int64)]
        edges = np.append(first, len(ones))
        columns = [term.astype(np.int64), sums_per(ones, edges).astype(np.int64), sums_per(1 - ones, edges).astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["term", "ones", "zeros"])

    totals = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("ones"), F.count(F.lit(1)).alias("n")).first()
    ones, zeros = int(totals["ones"]), int(totals["n"] - totals["ones"])
    counts = map_texts(rows.select("text", "label"), count, "term long, ones long, zeros long")
    odds = F.log((F.col("ones") + 0.5) / (ones + 1)) - F.log((F.col("zeros") + 0.5) / (zeros + 1))
    found = (
        counts.groupBy("term")
        .agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        .where(F.col("ones") >= SUPPORT)
        .select("term", "ones", odds.alias("odds"))
        .where(F.col("odds") >= ODDS[0])
    )
    lists = []
    for low, high in ((ODDS[1], float("inf")), (ODDS[0], ODDS[1])):
        chosen = found.where((F.col("odds") >= low) & (F.col("odds") < high))
        terms = [row["term"] for row in chosen.orderBy(F.desc("ones"), F.desc("odds"), "term").limit(LISTED).collect()]
        lists.append(np.sort(np.array(terms, np.int64).astype(np.uint64)))
    return Lexicon(*lists)


# -- trees -------------------------------------------------------------------------------------


@dataclass
class Model:
    """Boosted trees in complete binary form, and the isotonic steps from raw score to probability."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    steps: np.ndarray
    values: np.ndarray
    lexicon: Lexicon = field(default_factory=lambda: NOTHING)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        each = np.arange(len(rows))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[each, feature[node]] > cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return total

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between two steps of the isotonic map the probability is interpolated.

        A thousandth of the score is the plain logistic value, which orders texts on the same step.
        """
        if not len(self.steps):
            return np.full(len(rows), self.base)
        raw = self.raw(rows)
        return 0.999 * np.interp(raw, self.steps, self.values) + 0.001 / (1 + np.exp(-raw))


def _tree(codes: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray):
    """One tree of fixed depth: at each node the feature and bin with the largest gain."""
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(codes), np.int64)
    for level in range(DEPTH):
        first = 2**level - 1
        for own in range(first, 2 * first + 1):
            rows = np.flatnonzero(node == own)
            best = 0.0
            if len(rows) >= 2 * LEAST:
                g, h = gradient[rows], hessian[rows]
                whole = g.sum() ** 2 / (h.sum() + 1.0)
                for f in range(codes.shape[1]):
                    if not len(edges[f]):
                        continue
                    code = codes[rows, f]
                    gs = np.cumsum(np.bincount(code, g, BINS + 1))[:-1]
                    hs = np.cumsum(np.bincount(code, h, BINS + 1))[:-1]
                    ns = np.cumsum(np.bincount(code, minlength=BINS + 1))[:-1]
                    gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
                    gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = 0
                    k = int(gain[: len(edges[f])].argmax())
                    if gain[k] > best + 1e-9:
                        best, feature[own], cut[own] = gain[k], f, edges[f][k]
            right = np.zeros(len(rows), np.int64)
            if best:
                f = feature[own]
                right = (codes[rows, f] > np.searchsorted(edges[f], cut[own])).astype(np.int64)
            node[rows] = 2 * own + 1 + right
    at = node - inner
    g, h = np.bincount(at, gradient, 2**DEPTH), np.bincount(at, hessian, 2**DEPTH)
    leaf = -RATE * g / (h + 1.0)
    return feature, cut, leaf, leaf[at]


def isotonic(raw: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: raw scores and the non-decreasing probabilities at them."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for x, y in zip(raw[order].tolist(), labels[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == x:
            blocks[-1][0] += y
            blocks[-1][1] += 1
        else:
            blocks.append([y, 1, x, x])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y2, n2, _, top = blocks.pop()
            blocks[-1][0] += y2
            blocks[-1][1] += n2
            blocks[-1][3] = top
    steps, values = [], []
    for total, count, low, high in blocks:
        # one pseudo row of each label keeps probabilities off 0 and 1
        value = (total + 0.5) / (count + 1)
        steps += [low, high] if high > low else [low]
        values += [value, value] if high > low else [value]
    return np.array(steps), np.maximum.accumulate(np.array(values))


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Trees on four fifths of the rows, calibration on the last fifth (in the given order)."""
    share = float(labels.mean()) if len(labels) else 0.0
    empty = np.zeros(0)
    held = np.arange(len(labels)) % 5 == 4
    if len(np.unique(labels[~held])) < 2:
        return Model(share, empty, empty, empty, empty, empty)
    train, wanted = rows[~held], labels[~held].astype(np.float64)
    edges = [np.unique(np.quantile(np.unique(column), np.linspace(0, 1, BINS)))[:-1] for column in train.T]
    codes = np.stack([np.searchsorted(e, column) for e, column in zip(edges, train.T, strict=True)], axis=1)
    base = float(np.log(wanted.mean() / (1 - wanted.mean())))
    raw = np.full(len(wanted), base)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        feature, cut, leaf, step = _tree(codes, edges, p - wanted, p * (1 - p))
        raw += step
        trees.append((feature, cut, leaf))
    model = Model(base, *(np.array(x) for x in zip(*trees, strict=True)), empty, empty)
    if held.any():
        model.steps, model.values = isotonic(model.raw(rows[held]), labels[held].astype(np.float64))
    else:
        model.steps, model.values = isotonic(raw, wanted)
    return model


def features(docs: DataFrame, lexicon: Lexicon, *others: str) -> DataFrame:
    """The columns ``others`` and the features of each text as one array."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = text_features(batch.column("text"), lexicon)
        at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES))
        values = pa.ListArray.from_arrays(at, pa.array(rows.ravel()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), values], [*others, "features"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return map_texts(docs.select(*others, "text"), work, f"{kinds}, features array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows; only their features and the bounded lists reach the driver."""
    rows = labelled_sample(docs, labels, label, sample).select(
        "text", F.col("_label").alias("label"), F.xxhash64("doc_id", F.lit("half")).alias("order")
    )
    rows = cut_lineage(rows)
    first = F.col("order") % 2 == 0
    lexicon = learn_lexicon(rows.where(first))
    frame = features(rows.where(~first), lexicon, "order", "label").toPandas().sort_values(["order", "label"])
    found = np.stack(frame["features"].to_list()) if len(frame) else np.zeros((0, len(FEATURES)))
    model = fit(found, frame["label"].to_numpy())
    model.lexicon = lexicon
    return model


def score(docs: DataFrame, model: Model, *others: str) -> DataFrame:
    """The columns ``others`` (doc_id by default), score and predicted."""
    others = others or ("doc_id",)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = model.score(text_features(batch.column("text"), model.lexicon))
        columns = [*(batch.column(c) for c in others), pa.array(values), pa.array((values >= 0.5).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, [*others, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    columns = dict.fromkeys([*others, "text"])
    return map_texts(docs.select(*columns), run, f"{kinds}, score double, predicted int")


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns as they were."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = model.score(text_features(batch.column("text"), model.lexicon))
            yield batch.filter(pa.array(values < 0.5))

    return docs.select(*names).mapInArrow(run, docs.schema)
