"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary documents, are estimated
from a bounded sample of labelled rows. Both are interpolated Kneser-Ney models:
counts are of distinct contexts, not of occurrences, so that copies of a
passage add nothing; an absolute discount, estimated as n1 / (n1 + 2 n2) and
so at most 1, is taken off every count that a level keeps, and what a level
doesn't keep is handed to the next lower order:

    word after word  ->  word  ->  beginning of a word  ->  shared counts

An expression's own count is kept only where the two classes' rates, with one
added to each count, differ by more than a factor of ``ratio``; any other (a rare
one, or one that both classes use) has its whole count handed down, so that
both models know it by the backoff counts that they share. These are counted
over all documents, labelled or not, and grow with them. Each level adds up to
one. A document's score is the mean log-likelihood of its words under the toxic
model less that under the ordinary one: every word counts, and words of the
ordinary class offset toxic ones. Of some ratios the one with the fewest errors
on a held-out half of the sample is taken, and with it the threshold.

Everything but the fit covers all rows: whole texts are counted in one pass
and scored in another, without a shuffle but for the shared counts (a row a word
of the sample's vocabulary and task), against a model whose size the sample
bounds.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, reliable
from .near_dedup import groups
from .words import pieces, word_hashes

STEM = 5
#: labelled rows of [ordinary, toxic] documents in the sample, at most
SAMPLE = (6000, 1500)
#: factors by which the classes' rates of an expression differ if its own count is kept
RATIOS = (8.0, 16.0, 32.0, 64.0)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _before(words: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The word before each word; 0 before a text's first."""
    out = np.zeros_like(words)
    out[1:] = words[:-1]
    first = offset[:-1]
    out[first[first < len(words)]] = 0
    return out


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    k = (v * _ODD) ^ (w + (v >> np.uint64(7)))
    k ^= k >> np.uint64(33)
    return k * np.uint64(0xFF51AFD7ED558CCD)


class Keys:
    """Sorted 64-bit hashes with a table of where each prefix begins, so that
    a search costs one look into the table and about one comparison."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, min(24, int(len(keys)).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each hash, is it there?)."""
        prefix = (asked >> self.shift).astype(np.int64)
        at, end = self.start[prefix], self.start[prefix + 1]
        there = np.zeros(len(asked), bool)
        live = np.flatnonzero(at < end)
        while len(live):
            same = self.keys[at[live]] == asked[live]
            there[live[same]] = True
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        at[~there] = 0
        return at, there


@dataclass
class Shared:
    """Counts over all documents: tokens of each word of the vocabulary, and,
    of words outside it, tokens by stem; the last number is of other stems."""

    word: np.ndarray
    stem: np.ndarray
    by_word: np.ndarray
    by_stem: np.ndarray


@dataclass
class Model:
    """Log-likelihoods by class, [ordinary, toxic], each with its sorted keys;
    one that isn't fitted finds nothing."""

    word: Keys
    word_ll: np.ndarray
    stem: Keys
    stem_ll: np.ndarray
    unseen_ll: np.ndarray
    context: Keys
    context_rest: np.ndarray
    pair: Keys
    pair_ll: np.ndarray
    threshold: float = float("inf")

    @staticmethod
    def empty() -> Model:
        keys, none = Keys(np.zeros(0, np.uint64)), np.zeros((2, 0))
        return Model(keys, none, keys, none, np.zeros(2), keys, none, keys, none)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, mean ordinary and toxic log-likelihood, toxic less ordinary) of each text."""
        words, offset, stems = word_hashes(texts, STEM)
        return self.averages(words, stems, offset)

    def averages(self, words: np.ndarray, stems: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = np.diff(offset)
        ll = np.zeros((2, len(n)))
        own = np.flatnonzero(n)
        if len(own):
            ll[:, own] = np.add.reduceat(self.score(words, stems, offset), offset[own], axis=1) / n[own]
        return n, ll[0], ll[1], ll[1] - ll[0]

    def toxic(self, n: np.ndarray, score: np.ndarray) -> np.ndarray:
        return (n > 0) & (score > self.threshold)

    def score(self, words: np.ndarray, stems: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """(2, words) log-likelihoods."""
        if not len(self.word):
            return np.zeros((2, len(words)))
        at, there = self.word.find(words)
        ll = np.where(there, self.word_ll[:, at], self.unseen_ll[:, None])
        lost = np.flatnonzero(~there)
        at, there = self.stem.find(stems[lost])
        if there.any():
            ll[:, lost[there]] = self.stem_ll[:, at[there]]
        v = _before(words, offset)
        at, there = self.context.find(v)
        known = np.flatnonzero(there)
        if len(known):
            ll[:, known] += self.context_rest[:, at[known]]
            pair, there = self.pair.find(_pair(v[known], words[known]))
            ll[:, known[there]] = self.pair_ll[:, pair[there]]
        return ll


def _discount(count: np.ndarray) -> float:
    """Kneser-Ney's absolute discount, in (0, 1]."""
    one, two = int((count == 1).sum()), int((count == 2).sum())
    return one / (one + 2 * two) if one else 1.0


def _telling(count: list[np.ndarray], ratio: float) -> np.ndarray:
    """Do the classes' rates, with one added to each count, differ by more than ratio?"""
    a, b = ((c + 1) / max(c.sum(), 1.0) for c in count)
    return (a > ratio * b) | (b > ratio * a)


def _level(count: list[np.ndarray], telling: np.ndarray) -> tuple[list[np.ndarray], list[float], list[np.ndarray]]:
    """By class: (probability kept by each expression, probability handed down,
    the count that each hands down)."""
    kept, rest, left = [], [], []
    for c in count:
        discount = _discount(c)
        own = np.where(telling, np.maximum(c - discount, 0), 0)
        kept.append(own / max(c.sum(), 1.0))
        rest.append(1.0 - float(kept[-1].sum()))
        left.append(c - own)
    return kept, rest, left


@dataclass
class Counts:
    """What both classes' texts, [ordinary, toxic], hold; by class where it is a list."""

    word: np.ndarray
    stem: np.ndarray
    stem_of: np.ndarray
    count: list[np.ndarray]  # distinct words before each word
    pair: np.ndarray
    before: np.ndarray
    after: np.ndarray
    many: list[np.ndarray]  # distinct words before each pair


def counted(classes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Counts:
    """classes: of ordinary and of toxic texts, (words, offsets, stems)."""
    words = np.concatenate([w for w, _, _ in classes])
    word, at = np.unique(words, return_index=True)
    stem, stem_of = np.unique(np.concatenate([s for _, _, s in classes])[at], return_inverse=True)
    count, found, known = [], [], Keys(word)
    for w, o, _ in classes:
        v = _before(w, o)
        key, first = np.unique(_pair(v, w), return_index=True)
        count.append(np.bincount(known.find(w[first])[0], minlength=len(word)).astype(float))
        _, at = np.unique(_pair(_before(v, o), _pair(v, w)), return_index=True)
        many = np.bincount(Keys(key).find(_pair(v[at], w[at]))[0], minlength=len(key)).astype(float)
        found.append((key, v[first], w[first], many))
    pair, first = np.unique(np.concatenate([k for k, *_ in found]), return_index=True)
    before, after = (np.concatenate([x[i] for x in found])[first] for i in (1, 2))
    spread = []
    for key, _, _, many in found:
        own = np.zeros(len(pair))
        own[Keys(pair).find(key)[0]] = many
        spread.append(own)
    return Counts(word, stem, stem_of, count, pair, before, after, spread)


def _estimate(own: Counts, ratio: float, shared: Shared | None = None) -> Model:
    """Without shared counts over all documents those of the two classes
    together are taken."""
    word, stem, stem_of = own.word, own.stem, own.stem_of
    telling = _telling(own.count, ratio)
    kept, rest, left = _level(own.count, telling)
    # what words hand down is the count of their stems
    by_stem = [np.bincount(stem_of, x, len(stem)) for x in left]
    stem_telling = _telling(by_stem, ratio)
    stem_kept, stem_rest, stem_left = _level(by_stem, stem_telling)
    # what stems hand down is shared; of expressions that tell nothing all documents' counts are
    given, unknown, lost, scale = sum(left), np.zeros(len(stem)), 0.0, 1.0
    if shared is not None:
        at, there = Keys(shared.word).find(word)
        everywhere = np.where(there, shared.by_word[at] if len(shared.word) else 0.0, 0.0)
        same = ~telling & (everywhere > 0)
        if same.any():
            scale = everywhere[same].sum() / given[same].sum()
        given = np.where(same, everywhere, given * scale)
        at, there = Keys(shared.stem).find(stem)
        unknown = np.where(there, shared.by_stem[at], 0.0)
        lost = float(shared.by_stem.sum() - unknown.sum())
    in_stem = np.bincount(stem_of, given, len(stem)) + unknown + 1
    whole = np.where(stem_telling, sum(stem_left) * scale, in_stem)
    total = whole.sum() + lost + 1
    stem_p = [k + r * whole / total for k, r in zip(stem_kept, stem_rest)]
    word_p = [k + r * p[stem_of] * given / in_stem[stem_of] for k, r, p in zip(kept, rest, stem_p)]
    # a word that isn't known is one of as many as are
    new_p = [r * p * (unknown + 1) / in_stem / len(word) for r, p in zip(rest, stem_p)]
    unseen_p = [np.array(r * q * (lost + 1) / total / len(word)) for r, q in zip(rest, stem_rest)]
    # bigrams count by the distinct words before them
    wanted = np.flatnonzero(_telling(own.many, ratio))
    context = np.unique(own.before[wanted])
    of, known, at = np.searchsorted(context, own.before[wanted]), Keys(context), np.searchsorted(word, own.after[wanted])
    place, there = known.find(own.before)
    context_rest, pair_p = [], []
    for many, lower in zip(own.many, word_p):
        sum_ = np.maximum(np.bincount(place[there], many[there], len(context)), 1e-300)
        kept_n = np.maximum(many[wanted] - _discount(many), 0)
        context_rest.append(1 - np.bincount(of, kept_n, len(context)) / sum_)
        pair_p.append(kept_n / sum_[of] + context_rest[-1][of] * lower[at])
    log = lambda p: np.log(np.maximum(np.stack(p), 1e-300))
    return Model(Keys(word), log(word_p), Keys(stem), log(new_p), log(unseen_p), known, log(context_rest), Keys(own.pair[wanted]), log(pair_p))


def _threshold(score: np.ndarray, toxic: np.ndarray) -> tuple[int, float, float]:
    """(errors, width of the gap, threshold): with the fewest errors, midway in
    the widest gap between scores."""
    cut = np.unique(score)
    middle = (cut[1:] + cut[:-1]) / 2
    if not len(middle):
        return int(toxic.sum()), 0.0, float("inf")
    ordinary, bad = np.sort(score[~toxic]), np.sort(score[toxic])
    wrong = len(ordinary) - np.searchsorted(ordinary, middle) + np.searchsorted(bad, middle)
    at = max(np.flatnonzero(wrong == wrong.min()), key=lambda i: cut[i + 1] - cut[i])
    return int(wrong[at]), float(cut[at + 1] - cut[at]), float(middle[at])


def _held(sample: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(words, offsets, stems, is it toxic?) of the sample's texts; none if it lacks a class."""
    sample = sample[sample["text"].notna()].reset_index(drop=True)
    if not len(sample):
        return None
    # a family of copies would pass for evidence: of each, one row of a label counts
    table = pa.table({"text": pa.array(sample["text"], pa.large_string())})
    family = groups([part.column("text") for part in pieces(table, "text")])
    first = ~pd.DataFrame({"family": family, "toxic": sample["toxic"]}).duplicated().to_numpy()
    table, toxic = table.filter(pa.array(first)), sample["toxic"].to_numpy()[first] == 1
    if not toxic.any() or toxic.all():
        return None
    hashed = [word_hashes(part.column("text"), STEM) for part in pieces(table, "text")]
    words, stems = (np.concatenate([x[i] for x in hashed]) for i in (0, 2))
    offset = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[1]) for x in hashed]))]).astype(np.int64)
    return (words, offset, stems, toxic) if len(words) else None


def fit(sample: pd.DataFrame, ratios: tuple[float, ...] = RATIOS, shared: Shared | None = None) -> Model:
    """A model of rows with ``text`` and ``toxic`` (0 or 1). A sample that
    lacks a class gives a model that finds nothing."""
    got = _held(sample)
    if got is None:
        return Model.empty()
    words, offset, stems, toxic = got

    def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.diff(offset)[rows]
        to = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        at = np.arange(to[-1]) + np.repeat(offset[rows] - to[:-1], n)
        return words[at], to, stems[at]

    def both(rows: np.ndarray) -> Counts:
        return counted([part(rows[~toxic[rows]]), part(rows[toxic[rows]])])

    # every other row of each class is held out
    turn = np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic)) % 2
    held, used = np.flatnonzero(turn == 0), np.flatnonzero(turn == 1)
    found, half = [], both(used)
    for ratio in ratios:
        model, score = _estimate(half, ratio, shared), []
        for rows in np.array_split(held, len(held) // 500 + 1):
            w, to, s = part(rows)
            n, _, _, apart = model.averages(w, s, to)
            score.append(np.where(n > 0, apart, -np.inf))
        score = np.concatenate(score)
        there = score > -np.inf
        errors, gap, threshold = _threshold(score[there], toxic[held][there])
        found.append((errors, -gap, threshold, ratio))
    _, _, threshold, ratio = min(found)
    del half
    model = _estimate(both(np.arange(len(toxic))), ratio, shared)
    model.threshold = threshold
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = SAMPLE) -> DataFrame:
    """At most ``most`` labelled rows of each class, those of least hash of
    doc_id, so that a row's place doesn't depend on where it is stored."""
    marks = Rows(labels)
    known = marks.df.select(marks["doc_id"].alias("id"), marks["toxic"].alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("h", F.xxhash64("id", F.lit(11)))
    chosen = None
    for value in (0, 1):
        one = known.where(F.col("toxic") == value).orderBy("h", "id").limit(most[value])
        chosen = one if chosen is None else chosen.unionByName(one)
    rows = Rows(docs)
    texts = rows.df.select(rows["doc_id"].alias("id"), rows["text"].alias("text"))
    # sum(most) ids at most
    return texts.join(F.broadcast(chosen.select("id", "toxic")), "id").select("id", "text", "toxic")


def _vocabulary(sample: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sample's words and stems, sorted."""
    got = _held(sample)
    if got is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.unique(got[0]), np.unique(got[2])


def shared_counts(docs: DataFrame, vocabulary: Broadcast) -> Shared:
    """Counts of the vocabulary over all texts of docs; one pass. Tasks add up
    their own texts, so what is shuffled is a row a word and task, and what
    reaches the driver a row a word."""
    rows = Rows(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, stem = (Keys(k) for k in vocabulary.value)
        count = np.zeros(len(word) + len(stem) + 1, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                words, _, stems = word_hashes(part.column("text"), STEM)
                at, there = word.find(words)
                place, known = stem.find(stems[~there])
                at = at.astype(np.int64)
                at[~there] = len(word) + np.where(known, place, len(stem))
                count += np.bincount(at, minlength=len(count))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], ["at", "n"])

    word, stem = vocabulary.value
    total = rows.df.select(rows["text"].alias("text")).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(len(word) + len(stem) + 1)
    count[total.column("at").to_numpy()] = total.column("n").to_numpy()
    return Shared(word, stem, count[: len(word)], count[len(word) :])


def _in_one_task(sample: DataFrame, run, *more) -> object:  # noqa: ANN001
    """run(rows as pandas, *more) in a task, as the sample is bounded; only
    its result, pickled, passes through the driver."""
    more = sample.sparkSession.sparkContext.broadcast(more)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        rows = pa.Table.from_batches(held).to_pandas() if held else pd.DataFrame({"id": [], "text": [], "toxic": []})
        del held
        rows = rows.sort_values(["id", "text"], na_position="last").reset_index(drop=True)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(run(rows, *more.value))], pa.binary())], ["got"])

    got = sample.repartition(1).mapInArrow(task, "got binary").collect()
    return pickle.loads(got[0][0]) if got else run(pd.DataFrame({"id": [], "text": [], "toxic": []}), *more.value)  # noqa: S301, it is our own


def _fitted(docs: DataFrame, labels: DataFrame, most: tuple[int, int], ratios: tuple[float, ...]) -> Broadcast:
    """A model for all tasks."""
    context = docs.sparkSession.sparkContext
    sample = reliable(labelled_sample(docs, labels, most))
    vocabulary = context.broadcast(_in_one_task(sample, _vocabulary))
    if not len(vocabulary.value[0]):
        return context.broadcast(Model.empty())
    return context.broadcast(_in_one_task(sample, fit, ratios, shared_counts(docs, vocabulary)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = SAMPLE, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """doc_id, n_words, ll_ordinary, ll_toxic, score and is_toxic of every row
    of docs. The log-likelihoods are means over the text's words, score is
    ll_toxic less ll_ordinary, and is_toxic says that it is over the threshold.

    ``most`` bounds the labelled rows that the models are fitted on, ordinary
    and toxic; the counts that they share are of all docs. Null or empty texts, and texts without words, score 0 and aren't
    toxic. A very long text is scored whole, one of its words counting the less the more there are. A null doc_id is carried along, repeated rows are scored one by one, and
    a score that equals the threshold isn't toxic. Labels with a null id
    or a value other than 0 and 1 are ignored; without labels of both classes
    nothing is toxic. Other columns of either table are not looked at; an empty table gives an empty result."""
    model = _fitted(docs, labels, most, ratios)
    rows = Rows(docs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                n, ordinary, toxic, score = model.value.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ordinary), pa.array(toxic), pa.array(score), pa.array(model.value.toxic(n, score))], ["doc_id", "n_words", "ll_ordinary", "ll_toxic", "score", "is_toxic"])

    asked = rows.df.select(rows["doc_id"].cast("long").alias("doc_id"), rows["text"].alias("text"))
    return asked.mapInArrow(score, "doc_id long, n_words long, ll_ordinary double, ll_toxic double, score double, is_toxic boolean")


def keep_ordinary(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = SAMPLE, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """docs without its toxic documents; all columns, and the same defined
    results as toxicity_scores(). Rows pass through whole, without a join."""
    model = _fitted(docs, labels, most, ratios)
    rows = Rows(docs)
    text = rows.own[rows.names.index("text")]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                n, _, _, score = model.value.scores(part.column(text))
                yield part.filter(pa.array(~model.value.toxic(n, score)))

    return rows.give(rows.df.mapInArrow(keep, rows.df.schema))
