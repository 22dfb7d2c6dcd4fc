"""Toxicity scores: boosted trees over dense text features, isotonic calibration.

Features are lexicon densities (whole words, word stems and de-obfuscated
words; the lexicon is learned from labelled rows and joined with a short list
of insults), second-person proximity, capitals, punctuation and obfuscation
rates.  The model is fitted on a bounded sample of labelled rows
(``train_docs``), whose texts are counted and turned into features by Spark;
the trees then see a matrix of ``train_docs`` rows.  Every document is scored
over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, mapped, written
from .textvec import LOWER, mix, powers, sliced, view, words

#: Labelled rows used for fitting: the bound of the sample.
TRAIN_DOCS = 16_000
FOLDS = 4
THRESHOLD = 0.7
#: Toxic texts that an item of the lexicon must be in.
LEAST = 3
STEMS = (4, 5, 6)
KINDS = 2 + len(STEMS)

# Common insults and second-person pronouns.
INSULTS = ["idiot", "idiots", "moron", "stupid", "dumb", "loser", "trash", "scum", "worthless", "pathetic", "disgusting", "clown",
           "idiota", "estúpido", "imbécil", "basura", "asqueroso", "idiote", "stupide", "imbécile", "ordure", "dégoûtant",
           "dumm", "dummkopf", "abschaum", "müll", "widerlich", "wertlos"]
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te",
                 "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros"]
FEATURES = ["log_words", "log_bytes"]
for _kind in ("word", "plain", *(f"stem{n}" for n in STEMS)):
    FEATURES += [f"{_kind}_{x}" for x in ("density", "weight", "max", "hits")]
FEATURES += ["insults", "second_person", "near_second_person", "capitals", "shouted", "exclamations", "questions", "doubled",
             "symbols", "digits", "mixed", "stretched", "single"]


def _byte_set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = _byte_set("0123456789")
_SYMBOL = _byte_set("#$%&*@^~_+=<>")
#: Look-alike characters and the letters they stand for inside a word.
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip("0134578@$!|+", "oieastbasilt"):
    _LEET[ord(_a)] = ord(_b)
_DISGUISE = _byte_set("0134578@$!|+*.-_")


def _hashes(texts: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    return np.unique(words(data, offsets)["hash"])


def _plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """De-obfuscated texts: look-alikes between letters become letters, other
    signs between letters and repeats of a letter vanish."""
    low = LOWER[data]
    around = np.zeros(len(low), bool)
    letter = _LETTER[low] | _DIGIT[low]
    if len(low) > 2:
        around[1:-1] = _LETTER[low[:-2]] & letter[2:]
        around[1:-1] |= letter[:-2] & _LETTER[low[2:]]
    for cut in (offsets[:-1], offsets[1:] - 1):
        around[cut[(cut >= 0) & (cut < len(low))]] = False
    inside = around & _DISGUISE[low]
    out = np.where(inside, _LEET[low], low)
    keep = ~(inside & (_byte_set("*.-_")[low]))
    keep[1:] &= ~((out[1:] == out[:-1]) & _LETTER[out[1:]] & (out[1:] < 128))
    first = offsets[:-1][offsets[:-1] < len(low)]
    keep[first] = True
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def _found(keys: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(code), bool)
    return keys[np.minimum(np.searchsorted(keys, code), len(keys) - 1)] == code


@dataclass
class Parts:
    """What the features need of a batch: items per kind and plain rates."""

    items: list[tuple[np.ndarray, np.ndarray]]  # (hash, doc) of each occurrence
    sizes: list[np.ndarray]  # occurrences per doc, whatever is kept of them
    rates: np.ndarray
    second: np.ndarray  # for kind 0: a second-person word within three words
    n: int

    def unique(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Each item of each doc once."""
        code, doc = self.items[kind]
        order = np.lexsort((code, doc))
        code, doc = code[order], doc[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        return code[new], doc[new]


def parts(column) -> Parts:
    data, offsets = view(column)
    n = len(offsets) - 1
    w = words(data, offsets)
    size = np.diff(offsets).astype(float)
    count = np.diff(w["first"]).astype(float)
    per, each = np.maximum(count, 1), np.maximum(size, 1)
    length = w["end"] - w["start"]
    up, down = powers(len(w["bytes"]) + 1)
    total = np.zeros(len(w["bytes"]) + 1, np.uint64)
    np.cumsum((w["bytes"].astype(np.uint64) + np.uint64(1)) * up[: len(w["bytes"])], out=total[1:])
    p = words(*_plain(data, offsets))
    items = [(w["hash"], w["doc"]), (p["hash"], p["doc"])]
    for k in STEMS:
        long = length > k
        s = w["start"][long]
        items.append((mix((total[s + k] - total[s]) * down[s] + np.uint64(1000 + k)), w["doc"][long]))
    second = np.isin(w["hash"], _hashes(SECOND_PERSON))
    near = second.copy()
    for j in (1, 2, 3):
        alike = w["doc"][j:] == w["doc"][:-j]  # texts lie end to end, and none may look into the next
        near[j:] |= second[:-j] & alike
        near[:-j] |= second[j:] & alike

    def share(mask: np.ndarray, over: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / over

    def of_words(mask: np.ndarray) -> np.ndarray:
        return np.bincount(w["doc"], weights=mask, minlength=n) / per

    low = LOWER[data]
    upper = _UPPER[data]
    same = np.zeros(len(data), bool)
    same[1:] = data[1:] == data[:-1]
    full = offsets[:-1][np.diff(offsets) > 0]  # first bytes of texts
    same[full] = False
    stretched = np.zeros(len(data), bool)
    stretched[2:] = same[2:] & same[1:-1] & _LETTER[low[2:]]
    mixed = np.zeros(len(data), bool)
    if len(data) > 2:
        mixed[1:-1] = _DISGUISE[data[1:-1]] & _LETTER[low[:-2]] & _LETTER[low[2:]]
        mixed[full] = mixed[offsets[1:][np.diff(offsets) > 0] - 1] = False
    # Upper-case bytes of each word, for shouted words.
    capital = np.concatenate(([0], np.cumsum(upper)))
    shift = w["doc"]
    shouted = capital[w["end"] - shift] - capital[w["start"] - shift] >= np.maximum(length, 2)
    insult = np.isin(w["hash"], _hashes(INSULTS)).astype(float)
    mark, query = data == ord("!"), data == ord("?")
    rates = np.column_stack((
        np.log1p(count), np.log1p(size), of_words(insult), of_words(second), share(upper, each), of_words(shouted),
        share(mark, each), share(query, each), share(same & (mark | query), each), share(_SYMBOL[data], each),
        share(_DIGIT[data], each), share(mixed, per), share(stretched, per), of_words(length == 1),
    ))
    return Parts(items, [np.bincount(doc, minlength=n) for _, doc in items], rates, near, n)


@dataclass
class Lexicon:
    """Sorted item hashes and their log-odds of toxic documents, per kind."""

    keys: list[np.ndarray]
    odds: list[np.ndarray]


def features(p: Parts, lexicon: Lexicon) -> np.ndarray:
    """The dense feature matrix in the order of FEATURES."""
    columns = [p.rates[:, 0], p.rates[:, 1]]
    near = np.zeros(p.n)
    for kind, (code, doc) in enumerate(p.items):
        keys, odds = lexicon.keys[kind], lexicon.odds[kind]
        value = np.zeros(len(code))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            value = np.where(keys[at] == code, odds[at], 0.0)
        count = np.maximum(p.sizes[kind], 1)
        hit = value > 1.5
        most = np.zeros(p.n)
        np.maximum.at(most, doc[value > 0], value[value > 0])
        hits = np.bincount(doc, weights=hit, minlength=p.n)
        columns += [hits / count, np.bincount(doc, weights=value, minlength=p.n) / count, most, np.log1p(hits)]
        if kind == 0:
            near = np.bincount(doc, weights=hit & p.second, minlength=p.n) / count
    r = p.rates
    columns += [r[:, 2], r[:, 3], near, *(r[:, j] for j in range(4, 14))]
    return np.column_stack(columns)


def log_odds(bad_with: np.ndarray, good_with: np.ndarray, bad: float, good: float) -> np.ndarray:
    """Smoothed log-odds of items by the toxic and the clean texts they are in,
    less one standard error of the rarer count."""
    return np.log((bad_with + 0.5) / (bad + 1)) - np.log((good_with + 0.5) / (good + 1)) - 1 / np.sqrt(bad_with + 0.5)


def learn_lexicon(kind: np.ndarray, key: np.ndarray, bad_with: np.ndarray, good_with: np.ndarray, bad: float, good: float, least: int = LEAST) -> Lexicon:
    """Items of at least ``least`` toxic texts that speak for toxicity."""
    value = log_odds(bad_with, good_with, bad, good)
    keep = (bad_with >= least) & (value > 0.3)
    keys, odds = [], []
    for k in range(KINDS):
        mine = np.flatnonzero(keep & (kind == k))
        mine = mine[np.argsort(key[mine])]
        keys.append(key[mine])
        odds.append(value[mine])
    return Lexicon(keys, odds)


class Trees:
    """Gradient-boosted regression trees with logistic loss on binned features."""

    def __init__(self, rounds: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 48, ridge: float = 2.0, least: float = 12.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.edges = [e if len(e) else np.zeros(1) for e in self.edges]
        b = self._binned(x)
        prior = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
        self.start = float(np.log(prior / (1 - prior)))
        margin = np.full(len(y), self.start)
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
            feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins + 1)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, number = (1 << level) - 1, 1 << level
                local = node - first
                best = np.zeros(number)
                wide = self.bins + 1
                for j in range(x.shape[1]):
                    slot = local * wide + b[:, j]
                    gs = np.bincount(slot, weights=g, minlength=number * wide).reshape(number, wide).cumsum(1)
                    hs = np.bincount(slot, weights=h, minlength=number * wide).reshape(number, wide).cumsum(1)
                    ns = np.bincount(slot, minlength=number * wide).reshape(number, wide).cumsum(1)
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(ns < self.least) | (nt - ns < self.least)] = 0
                    at = gain.argmax(1)
                    value = gain[np.arange(number), at]
                    better = value > best + 1e-9
                    best[better] = value[better]
                    feature[first : first + number][better] = j
                    cut[first : first + number][better] = at[better]
                right = b[np.arange(len(y)), feature[node]] > cut[node]
                node = 2 * node + 1 + right
            leaf = node - inner
            gs, hs = (np.bincount(leaf, weights=v, minlength=inner + 1) for v in (g, h))
            value = -self.rate * gs / (hs + self.ridge)
            margin += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; returns knots for linear interpolation."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], weight[order]):
        blocks.append([b * c, c, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], high]
    knots = np.array([v for s, n, low, high in blocks for v in (low, high)])
    value = np.repeat([s / n for s, n, _, _ in blocks], 2)
    return knots, value


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: np.ndarray
    values: np.ndarray

    def score(self, column) -> np.ndarray:
        margin = self.trees.margin(features(parts(column), self.lexicon))
        smooth = 1 / (1 + np.exp(-margin))
        # A little of the raw probability keeps the order within flat steps.
        return np.clip(0.98 * np.interp(margin, self.knots, self.values) + 0.02 * smooth, 0, 1)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, lexicon: Lexicon) -> Model:
    """Trees and calibration from cross-fitted features of the sample's rows.

    The calibration sees only margins of trees that were fitted on other folds.
    """
    margin = np.zeros(len(y))
    for k in np.unique(fold):
        rest = fold != k
        margin[~rest] = Trees().fit(x[rest], y[rest], weight[rest]).margin(x[~rest])
    knots, values = isotonic(margin, y, weight)
    return Model(lexicon, Trees().fit(x, y, weight), knots, values)


def _items(sample: DataFrame) -> DataFrame:
    """(kind, key, fold, toxic, n): texts of the sample that hold an item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            p = parts(batch.column("text"))
            group = (batch.column("fold").to_numpy() * 2 + batch.column("toxic").to_numpy()).astype(np.int64)
            for kind in range(KINDS):
                code, doc = p.unique(kind)
                mine = group[doc]
                order = np.lexsort((mine, code))
                code, mine = code[order], mine[order]
                cut = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (mine[1:] != mine[:-1])))) if len(code) else np.empty(0, np.int64)
                number = np.diff(np.append(cut, len(code)))
                columns = [np.full(len(cut), kind), code[cut].view(np.int64), mine[cut] // 2, mine[cut] % 2, number]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["kind", "key", "fold", "toxic", "n"])

    return mapped(sample, scan, "kind long, key long, fold long, toxic long, n long").groupBy("kind", "key", "fold", "toxic").agg(F.sum("n").alias("n"))


def _lexicons(sample: DataFrame, folds: int) -> list[Lexicon]:
    """The lexicon without each fold, and at the end that of all rows.

    Items are counted where the texts are; only those of at least LEAST toxic
    texts of the bounded sample reach the driver, with a few counts each.
    """
    size = {(r.fold, r.toxic): r.n for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    counts = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{f}_{t}") for f in range(folds) for t in (0, 1)]
    wide = _items(sample).groupBy("kind", "key").agg(*counts, F.sum(F.col("n") * F.col("toxic")).alias("_all")).where(F.col("_all") >= LEAST)
    table = wide.toArrow()
    kind, key = table["kind"].to_numpy(), table["key"].to_numpy().view(np.uint64)
    by = {(f, t): table[f"n{f}_{t}"].to_numpy().astype(float) for f in range(folds) for t in (0, 1)}
    out = []
    for left_out in [*range(folds), None]:
        used = [f for f in range(folds) if f != left_out]
        bad_with, good_with = (sum(by[f, t] for f in used) for t in (1, 0))
        bad, good = (sum(size.get((f, t), 0) for f in used) for t in (1, 0))
        out.append(learn_lexicon(kind, key, bad_with, good_with, bad, good))
    return out


def _cross_fitted(sample: DataFrame, lexicons: list[Lexicon]) -> DataFrame:
    """(order, fold, toxic, x): features by the lexicon that has not seen the row's fold."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicons)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            p, fold = parts(batch.column("text")), batch.column("fold").to_numpy()
            x = np.zeros((p.n, len(FEATURES)))
            for k in np.unique(fold):
                x[fold == k] = features(p, shared.value[k])[fold == k]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(p.n + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("order", "fold", "toxic")), flat], ["order", "fold", "toxic", "x"])

    return mapped(sample, scan, "order long, fold long, toxic long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, folds: int = FOLDS) -> Model | None:
    """Fit on at most ``train_docs`` labelled documents, half of them toxic if there are enough.

    Labels of other documents than ``docs`` count nowhere.  Documents are
    taken in the order of a hash of doc_id and weighted back to the label's
    share of all labelled documents; equal texts share a fold.  Texts stay on
    the executors: the driver gets the counts of lexicon items and a row of
    numbers for each document.  Several rows of one doc_id all count.  None
    if a class is missing.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    # Only labels of the given documents count, in the sample and in the weights.
    marks = written(marks.join(docs.where("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi"), "tox-labels")
    number = {r._toxic: r.n for r in marks.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if not all(number.get(k) for k in (0, 1)):
        return None
    bad = min(number[1], train_docs // 2)
    quota = {1: bad, 0: train_docs - bad}
    order = F.xxhash64("doc_id")
    picked = None
    for k in (0, 1):
        some = marks.where(F.col("_toxic") == k).orderBy(order, "doc_id").limit(quota[k])
        picked = some if picked is None else picked.unionByName(some)
    # At most ``train_docs`` rows of two numbers.
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.select("text", order.alias("order"), F.pmod(F.xxhash64("text"), F.lit(folds)).alias("fold"), F.col("_toxic").cast("long").alias("toxic"))
    sample = written(rows, "tox-sample")
    lexicons = _lexicons(sample, folds)
    table = _cross_fitted(sample, lexicons).toArrow()
    seen, fold, toxic = (table[c].to_numpy() for c in ("order", "fold", "toxic"))
    x = pc.list_flatten(table["x"]).to_numpy().reshape(-1, len(FEATURES))
    place = np.lexsort((*x.T[::-1], toxic, fold, seen))
    x, fold, toxic = x[place], fold[place], toxic[place]
    if len(set(toxic.tolist())) < 2:
        return None
    weight = np.where(toxic == 1, number[1] / max(1, (toxic == 1).sum()), number[0] / max(1, (toxic == 0).sum()))
    return fit(x, toxic.astype(float), weight / weight.mean(), fold, lexicons[-1])


def predict(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold) to every row.

    A null text counts as empty and is scored like any other; without a model
    every score is 0.  Whole texts are read, repeated rows score alike, an
    empty table stays empty; input columns of the two names are replaced.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = extended(docs.select(*names).schema, "score double, predicted int")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches):
            got = model.score(batch.column("text")) if model is not None else np.zeros(batch.num_rows)
            new = [pa.array(got), pa.array((got >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "score", "predicted"])

    return mapped(docs.select(*names), score, schema)
