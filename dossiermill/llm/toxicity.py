"""Toxicity by a linear-chain conditional random field over words.

Two states, clean and toxic. A word's features are the word and its beginnings
(hashes); the vocabulary is the features that toxic documents have far more often
than clean ones, beyond what chance explains. Only documents carry given labels, so the
words' tags are latent: a toxic document says that at least one of its words is toxic, a
clean one that none is. The field's weights are fitted to that by gradient ascent on the
likelihood of the document labels. The chance of no toxic word is one forward pass away,
and given that there is one, the expected tags of a toxic document are its marginals
divided by the chance of one; both come from the same forward-backward pass.

Words without a feature of the vocabulary are alike: a gap of them is a power of
one 2 x 2 matrix, so forward-backward visits only the words with features and is
exact over whole texts of any length. The chance that no word is toxic and the
expected number of toxic words give a document's score by a fitted logistic
curve; words with a marginal of one half or more are the offending spans.

Fitting uses a bounded sample: about ``SAMPLE_DOCS`` documents of each label,
chosen by a hash of doc_id. The model (at most ``VOCABULARY`` features) is
broadcast; scoring runs over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .decontamination import tokenized
from .language_id import hashed_share, held_out
from .wordbytes import Words

PREFIXES = (3, 4, 5, 6)
SAMPLE_DOCS = 3_000
VOCABULARY = 1 << 14
MIN_DF = 3
#: Features that chance alone would be expected to put into the vocabulary.
CHANCE_FEATURES = 5
MIN_LOG_ODDS = 2.5
#: A feature's first weight is its log odds, at most this, less if they are no great
#: surprise. A word needs several features for a positive sum.
FIRST_WEIGHT, SURE_SURPRISE, FIRST_BIAS = 3.0, 20.0, -8.0
SEQUENCE_WORDS = 64
#: Sequences of the documents that the field is fitted on, a bound of the sample.
MOST_SEQUENCES = 40_000
BITMAP = 1 << 20


def features(w: Words) -> np.ndarray:
    """(1 + prefixes, words) hashes: the word, then each of its beginnings."""
    return np.stack([w.hash, *w.prefixes(PREFIXES)])


class Field:
    """The vocabulary with its weights, and the chain's parameters."""

    def __init__(self, names: np.ndarray, log_odds: np.ndarray, surprise: np.ndarray):
        order = np.argsort(names)
        self.names = names[order]
        self.weight = (np.minimum(log_odds, FIRST_WEIGHT) * np.minimum(1.0, surprise / SURE_SURPRISE))[order]
        self.bias, self.change = FIRST_BIAS, np.array([[0.0, -2.0], [0.0, -1.0]])
        self.curve = np.array([0.0, 1.0, 0.0])
        self.bitmap = np.zeros(BITMAP, dtype=bool)
        self.bitmap[(self.names & np.uint64(BITMAP - 1)).astype(np.int64)] = True

    def found(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature) pairs of the words that have features of the vocabulary."""
        if not len(self.names):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        words, ids = [], []
        for h in features(w):
            maybe = np.flatnonzero(self.bitmap[(h & np.uint64(BITMAP - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.names, h[maybe]), len(self.names) - 1)
            hit = self.names[at] == h[maybe]
            words.append(maybe[hit])
            ids.append(at[hit])
        return np.concatenate(words), np.concatenate(ids)

    def marked(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, emission) of the words with features, in text order."""
        words, ids = self.found(w)
        total = np.bincount(words, weights=self.weight[ids], minlength=len(w.hash)) if len(words) else np.zeros(len(w.hash))
        at = np.unique(words)
        return at, total[at] + self.bias

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The matrix of one plain word, by its eigenvalues and vectors."""
        plain = np.exp(self.change) * np.exp([0.0, self.bias])
        values, right = np.linalg.eig(plain)
        return plain, values, right, np.linalg.inv(right)

    def run(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text its log chance of having no toxic word and its expected
        number of toxic words; and (word, marginal) of the words with features."""
        texts = len(w.first) - 1
        at, emit = self.marked(w)
        text = w.text[at]
        place = at - w.first[text]
        n_words = np.diff(w.first)
        count = np.bincount(text, minlength=texts)
        base = np.concatenate(([0], np.cumsum(count)[:-1]))
        last = np.concatenate(([-1], place[:-1]))
        last[base[count > 0]] = -1
        gap = place - last - 1
        tail = n_words - 1 - np.where(count > 0, place[np.minimum(base + np.maximum(count, 1) - 1, len(place) - 1)] if len(place) else -1, -1)
        trans, values, right, left = self.steps()
        change = np.exp(self.change)
        power = lambda g: np.einsum("ij,nj,jk->nik", right, values[None, :] ** np.asarray(g)[:, None], left)

        # the state before the first word is clean; a gap's words, then the word's own change
        alpha = np.zeros((len(at), 2))
        state, log_z = np.tile([1.0, 0.0], (texts, 1)), np.zeros(texts)
        into = np.einsum("nij,jk->nik", power(gap), change) if len(at) else np.zeros((0, 2, 2))
        by_count = np.argsort(-count, kind="stable")
        for j in range(int(count.max(initial=0))):
            own = by_count[: np.searchsorted(-count[by_count], -j, side="left")]
            n = base[own] + j
            v = np.einsum("ni,nij->nj", state[own], into[n])
            v[:, 1] *= np.exp(np.minimum(emit[n], 50.0))
            scale = v.sum(axis=1)
            state[own] = v / scale[:, None]
            log_z[own] += np.log(scale)
            alpha[n] = state[own]
        end = np.einsum("nij,j->ni", power(tail), np.ones(2))
        log_z += np.log(np.einsum("ni,ni->n", state, end))

        marginal = np.zeros(len(at))
        beta = end / end.sum(axis=1, keepdims=True)
        for j in range(int(count.max(initial=0)) - 1, -1, -1):
            own = by_count[: np.searchsorted(-count[by_count], -j, side="left")]
            n = base[own] + j
            both = alpha[n] * beta[own]
            marginal[n] = both[:, 1] / both.sum(axis=1)
            v = beta[own].copy()
            v[:, 1] *= np.exp(np.minimum(emit[n], 50.0))
            v = np.einsum("nij,nj->ni", into[n], v)
            beta[own] = v / v.sum(axis=1, keepdims=True)
        expected = np.bincount(text, weights=marginal, minlength=texts) if len(at) else np.zeros(texts)
        return -log_z, expected, at, marginal

    def inputs(self, log_none: np.ndarray, expected: np.ndarray) -> np.ndarray:
        some = -np.expm1(np.minimum(log_none, 0.0))
        return np.stack([np.ones_like(some), some, np.log1p(expected)], axis=1)

    def score(self, log_none: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(log_none, expected) @ self.curve, -30, 30)))


def _no_evidence() -> Field:
    """A field without words, which marks nothing."""
    empty = Field(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0))
    empty.curve = np.array([-2.0, 0.0, 0.0])
    return empty


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Fits on the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic)
    marks 0 or 1. Without documents of both kinds, every score is one half or below."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if set(sizes) != {0, 1}:
        return _no_evidence()
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample_docs / sizes[1]))).otherwise(F.lit(min(1.0, sample_docs / sizes[0])))
    drawn = known.where(hashed_share("doc_id") < rate)
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("toxic", "text")
    sample = common.stored(sample.dropDuplicates())  # copies are no further evidence
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return _no_evidence()

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            toxic = r["toxic"].to_numpy()
            for first, w in tokenized(r["text"].to_pylist()):
                names = features(w)
                key = np.stack([names.ravel().view(np.int64), np.tile(w.text, len(names))])
                key = np.unique(key, axis=1)
                label = toxic[first + key[1]]
                name, df = np.unique(np.stack([key[0], label]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_pydict({"name": name[0], "toxic": name[1], "df": df})

    dfs = sample.mapInArrow(count, "name long, toxic long, df long").groupBy("name").agg(F.sum(F.col("df") * F.col("toxic")).alias("df1"), F.sum(F.col("df") * (1 - F.col("toxic"))).alias("df0"))
    dfs = common.stored(dfs.where(F.col("df1") + F.col("df0") >= MIN_DF))
    odds = F.log((F.col("df1") + 0.5) / (n1 + 1.0)) - F.log((F.col("df0") + 0.5) / (n0 + 1.0))
    df = F.col("df1") + F.col("df0")
    part = lambda k, n: F.when(k > 0, k * F.log(k / (df * (n / (n0 + n1))))).otherwise(0.0)
    surprise = part(F.col("df1"), n1) + part(F.col("df0"), n0)
    least = float(np.log(max(1.0, dfs.count() / CHANCE_FEATURES)))
    chosen = dfs.withColumn("odds", odds).withColumn("surprise", surprise).where((F.col("odds") >= MIN_LOG_ODDS) & (F.col("surprise") >= least))
    rows = chosen.orderBy(F.desc("odds"), F.desc("df1"), "name").select("name", "odds", "surprise").limit(VOCABULARY).collect()
    field = Field(np.array([r["name"] for r in rows], dtype=np.int64).view(np.uint64), np.array([r["odds"] for r in rows]), np.array([r["surprise"] for r in rows]))
    if rows:
        _fit_chain(field, sample)
    _fit_curve(field, sample)
    return field


def _fit_chain(field: Field, sample: DataFrame) -> None:
    """Weights by gradient ascent on the documents' labels over their sequences: the
    surroundings of a document's words with features, all of them. Documents are taken
    whole, in the order of their texts' hashes, up to MOST_SEQUENCES in all."""
    shared = sample.sparkSession.sparkContext.broadcast(field)

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for r in rows:
            keys, toxic, out = r["key"].to_pylist(), r["toxic"].to_pylist(), []
            for first, w in tokenized(r["text"].to_pylist()):
                words, ids = field.found(w)
                order = np.argsort(words, kind="stable")
                words, ids = words[order], ids[order]
                at = np.unique(words)
                spans, ends = {}, {}
                for n, t in zip(at.tolist(), w.text[at].tolist(), strict=True):
                    if n >= ends.get(t, -1):
                        lo = max(int(w.first[t]), ends.get(t, 0), n - SEQUENCE_WORDS // 4)
                        ends[t] = min(int(w.first[t + 1]), lo + SEQUENCE_WORDS)
                        spans.setdefault(t, []).append((lo, ends[t]))
                for t, own in spans.items():
                    cells = [(hi - lo, words[a:b] - lo, ids[a:b]) for lo, hi in own for a, b in [np.searchsorted(words, [lo, hi])]]
                    out.append((keys[first + t], toxic[first + t], [n for n, _, _ in cells], [x.tolist() for _, x, _ in cells], [x.tolist() for _, _, x in cells]))
            numbers = pa.list_(pa.int32())
            kinds = [pa.int64(), pa.int32(), numbers, pa.list_(numbers), pa.list_(numbers)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "toxic", "n", "word", "feature"])

    keyed = sample.select(F.xxhash64("text").alias("key"), "text", "toxic")
    written = common.stored(keyed.mapInArrow(cut, "key long, toxic int, n array<int>, word array<array<int>>, feature array<array<int>>"))
    sizes = written.groupBy("key").agg(F.sum(F.size("n")).alias("n")).orderBy("key").toPandas()
    chosen = sizes["key"][sizes["n"].cumsum() <= MOST_SEQUENCES]
    found = written.where(F.col("key") <= int(chosen.iloc[-1])).orderBy("key", "toxic").collect() if len(chosen) else []
    common.discard(written)
    if not found:
        return
    toxic = np.array([d["toxic"] for d in found]) == 1
    doc = np.repeat(np.arange(len(found)), [len(d["n"]) for d in found])
    m = len(doc)
    hits = [x for d in found for x in d["word"]]
    seq = np.repeat(np.arange(m), [len(x) for x in hits])
    word = np.array([x for own in hits for x in own], dtype=np.int64)
    feature = np.array([x for d in found for own in d["feature"] for x in own], dtype=np.int64)
    inside = np.arange(SEQUENCE_WORDS) < np.array([n for d in found for n in d["n"]])[:, None]
    rate, speed, held = 0.3, None, None
    theta = np.concatenate([field.weight, [field.bias], field.change[:, 1]])
    prior = theta.copy()
    n_features = len(field.weight)
    for _ in range(60):
        emit = np.full((m, SEQUENCE_WORDS), theta[n_features])
        np.add.at(emit, (seq, word), theta[feature])
        change = np.array([[0.0, theta[-2]], [0.0, theta[-1]]])
        marginal, pairs, log_z = _forward_backward(emit, change, inside)
        own = label_slope(log_z, doc, toxic)
        residual = marginal * inside * own[:, None]
        slope = np.concatenate([np.bincount(feature, weights=residual[seq, word], minlength=n_features), [residual.sum()], np.einsum("n,na->a", own, pairs[:, :, 1])])
        slope -= 0.1 * (theta - prior)
        held = slope if held is None else 0.9 * held + 0.1 * slope
        speed = slope**2 if speed is None else 0.99 * speed + 0.01 * slope**2
        theta = theta + rate * held / (np.sqrt(speed) + 1e-8)
        rate *= 0.96
    field.weight, field.bias, field.change = theta[:n_features], float(theta[n_features]), np.array([[0.0, theta[-2]], [0.0, theta[-1]]])


def label_slope(log_z: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """What each sequence's expected counts are multiplied by in the slope of the log
    likelihood of the documents' labels. The chance of no toxic word in a document is
    exp(-log_z), all sequences multiplied. Expected counts given a toxic word are counts /
    (1 - none), so a toxic document's slope is counts * none / (1 - none); a clean one's is
    minus the counts."""
    none = np.exp(-np.bincount(doc, weights=log_z, minlength=len(toxic)))
    return np.where(toxic, none / np.maximum(1 - none, 1e-9), -1.0)[doc]


def _forward_backward(emit: np.ndarray, change: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, word) chance of toxic, (sequence, from, to) expected number of each
    change, and each sequence's log partition sum, next to 0 for no toxic word."""
    m, n = emit.shape
    own = np.exp(np.stack([np.zeros_like(emit), np.clip(emit, -50, 50)], axis=2))
    step = np.exp(change)
    alpha, beta, log_z = np.zeros((m, n, 2)), np.ones((m, n, 2)), np.zeros(m)
    state = np.tile([1.0, 0.0], (m, 1))
    for j in range(n):
        v = (state @ step) * own[:, j]
        log_z += np.where(inside[:, j], np.log(v.sum(axis=1)), 0.0)
        state = np.where(inside[:, j, None], v / v.sum(axis=1, keepdims=True), state)
        alpha[:, j] = state
    back = np.ones((m, 2))
    for j in range(n - 1, -1, -1):
        beta[:, j] = back
        v = (back * own[:, j]) @ step.T
        back = np.where(inside[:, j, None], v / v.sum(axis=1, keepdims=True), back)
    both = alpha * beta
    marginal = both[..., 1] / both.sum(axis=2)
    earlier = np.concatenate((np.tile([1.0, 0.0], (m, 1, 1)).reshape(m, 1, 2), alpha[:, :-1]), axis=1)
    pair = earlier[..., :, None] * step[None, None] * (own * beta)[..., None, :]
    pair = pair / pair.sum(axis=(2, 3), keepdims=True) * inside[..., None, None]
    return marginal, pair.sum(axis=1), log_z


def _fit_curve(field: Field, sample: DataFrame) -> None:
    """The logistic curve from a document's chain to its label, by Newton steps."""
    shared = sample.sparkSession.sparkContext.broadcast(field)

    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            toxic = r["toxic"].to_numpy()
            for first, w in tokenized(r["text"].to_pylist()):
                none, expected, _, _ = shared.value.run(w)
                yield pa.RecordBatch.from_pydict({"toxic": toxic[first : first + len(none)].astype(np.int64), "none": none, "expected": expected})

    rows = sample.mapInArrow(measure, "toxic long, none double, expected double").collect()
    if not rows:
        return
    y = np.array([r["toxic"] for r in rows], dtype=float)
    x = field.inputs(np.array([r["none"] for r in rows]), np.array([r["expected"] for r in rows]))
    curve = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (y - p) - 0.5 * curve
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        curve = curve + np.linalg.solve(bend, slope)
    field.curve = curve


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score, spans) of every row of ``docs`` (doc_id, text): spans are the
    words with a marginal of one half or more, as (start, end, marginal) in UTF-8
    bytes. Null and empty texts have no words and get the score of none."""
    common.batch_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        span = pa.struct({"start": pa.int64(), "end": pa.int64(), "marginal": pa.float64()})
        for r in rows:
            scores, spans = [np.zeros(0)], [[] for _ in range(r.num_rows)]
            for first, w in tokenized(r["text"].to_pylist()):
                none, expected, at, marginal = field.run(w)
                scores.append(field.score(none, expected))
                for k in np.flatnonzero(marginal >= 0.5):
                    n = at[k]
                    begin = w.text_starts[w.text[n]]
                    spans[first + w.text[n]].append({"start": int(w.starts[n] - begin), "end": int(w.ends[n] - begin), "marginal": float(marginal[k])})
            yield pa.RecordBatch.from_pydict({"doc_id": r["doc_id"], "score": np.concatenate(scores), "spans": pa.array(spans, pa.list_(span))})

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, score double, spans array<struct<start:long,end:long,marginal:double>>")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score and the offending offsets (bytes of the UTF-8 text,
    with their marginals). Null, empty and wordless texts get the score of no toxic word;
    rows that repeat get equal scores; without labels of both kinds none is toxic; an
    empty table gives no rows."""
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    field = fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    found = scored(docs, field).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "spans")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans")
