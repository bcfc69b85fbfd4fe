"""Language identification by a linear-chain conditional random field.

Every word of a text gets a language label.  Emission weights belong to features of the word
(prefixes and suffixes of 1 to 3 letters, letter 2- and 3-grams with word ends, and the word itself
if the training lexicon has it), transition weights to pairs of neighbouring labels; both are
learned together by gradient ascent on the conditional log-likelihood.  Training sequences splice
runs of words of different languages, so that the transitions learn how often text switches.
Prediction runs forward-backward over the whole text: a document's language is the one with the
largest mean posterior over its words with letters, and the score is that mean.

The chain is cut into steps of ``STEP`` words only for speed: the product of the transition and
emission matrices of each stretch is formed for all stretches at once, messages pass over those
products, and the posteriors are those of the unbroken chain.

Training data: the whole texts of at most ``SAMPLE_DOCS`` documents a language, picked by a hash of
the id.  Prediction reads whole texts.  A null text or one without
a letter is ``und`` with score 0.  With one language in training all text is that language; with
none everything is ``und``.  Repeated rows are predicted once each, rows with a null id like others; columns that the input has
besides, whatever their names, are not read (``accepted`` returns them as they are).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, table

SAMPLE_DOCS = 200  #: labelled documents a language that the field is fitted on
LEXICON = 2  #: times that a word occurs in a language's training text to be in the lexicon
STEP = 128
UNKNOWN = "und"
_STRIP = regex.compile(r"\P{L}+")  # Unicode category L: digits, fractions and superscripts are no letters
_CACHE = 400_000


def core(token: str) -> str:
    """A token's letters, lowered."""
    return _STRIP.sub("", token).lower()


def features(word: str) -> list[str]:
    padded = f"^{word}$"
    out = [f"w{word}"]
    out += [f"p{padded[: k + 1]}" for k in (1, 2, 3)] + [f"s{padded[-k - 1 :]}" for k in (1, 2, 3)]
    out += [f"g{padded[i : i + 2]}" for i in range(len(padded) - 1)] + [f"g{padded[i : i + 3]}" for i in range(len(padded) - 2)]
    return out


def _messages(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages (positive, each scaled to sum 1) of chains laid end to end.

    ``emit`` (n, K) positive; ``start``/``stop`` mark the first and last word of each chain.  A chain
    starts from uniform and does not look past its end, which a matrix with equal rows does.
    """
    n, k = emit.shape
    rows = -(-n // STEP)
    pad = rows * STEP - n
    # (step, label, stretch): every operation below runs along all stretches at once
    e = np.ascontiguousarray(np.concatenate([emit, np.ones((pad, k))]).reshape(rows, STEP, k).transpose(1, 2, 0))
    first = np.concatenate([start, np.ones(pad, bool)]).reshape(rows, STEP).T
    cuts = [np.nonzero(f)[0] for f in first]

    def forth(t, old):
        """Messages ``old`` (label, ..., stretch) one transition on, before the emission of t."""
        new = (trans.T @ old.reshape(k, -1)).reshape(old.shape)
        if len(cuts[t]):
            new[..., cuts[t]] = old[..., cuts[t]].sum(axis=0) / k
        return new

    product = np.repeat(np.eye(k)[:, :, None], rows, axis=2)  # (to, from, stretch)
    for t in range(STEP):
        product = forth(t, product) * e[t][:, None, :]
        if t % 4 == 3:
            product /= product.sum(axis=(0, 1))
    product = np.ascontiguousarray(product.transpose(2, 1, 0))
    product /= product.sum(axis=(1, 2), keepdims=True)
    alpha0, beta1 = np.empty((rows, k)), np.empty((rows, k))
    a, b = np.full(k, 1.0 / k), np.ones(k)
    for r in range(rows):
        alpha0[r] = a
        a = a @ product[r]
        a /= a.sum()
    for r in range(rows - 1, -1, -1):
        beta1[r] = b
        b = product[r] @ b
        b /= b.sum()
    alpha, beta = np.empty((STEP, k, rows)), np.empty((STEP, k, rows))
    a, b = alpha0.T, beta1.T
    for t in range(STEP):
        a = forth(t, a) * e[t]
        a /= a.sum(axis=0)
        alpha[t] = a
    for t in range(STEP - 1, -1, -1):
        beta[t] = b
        old = b * e[t]
        b = trans @ old
        if len(cuts[t]):
            b[:, cuts[t]] = old[:, cuts[t]].sum(axis=0) / k
        b /= b.sum(axis=0)
    return alpha.transpose(2, 0, 1).reshape(-1, k)[:n], beta.transpose(2, 0, 1).reshape(-1, k)[:n]


def posteriors(scores: np.ndarray, trans: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Label probabilities of every word of chains laid end to end; log emission scores."""
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    emit = np.maximum(emit, 1e-30)
    alpha, beta = _messages(emit, np.exp(trans - trans.max()), start, stop)
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True)


class Tagger:
    """A trained field: languages, feature index, emission and transition weights."""

    def __init__(self, langs: list[str], index: dict[str, int], weights: np.ndarray, trans: np.ndarray):
        self.langs, self.index, self.weights, self.trans = langs, index, weights, trans
        self._seen: dict[str, int] = {}
        self._cores = {"": 0}
        self._scores = np.full((1, len(langs)), np.nan, dtype=np.float32)

    @classmethod
    def train(cls, texts: list[tuple[str, str]], rounds: int = 6, run: int = 24, length: int = 96, seed: int = 5) -> Tagger:
        """``texts``: (language, text).  ``run``: mean words before a spliced sequence switches."""
        rng = np.random.default_rng(seed)
        langs = sorted({lang for lang, _ in texts})
        words = {lang: [] for lang in langs}
        for lang, text in texts:
            words[lang] += [w for w in map(core, text.split()) if w]
        words = {lang: w for lang, w in words.items() if w}
        langs = sorted(words)
        if not langs:
            return cls([], {}, np.zeros((0, 0)), np.zeros((0, 0)))
        lexicon = set()
        for own in words.values():
            kinds, n = np.unique(np.array(own), return_counts=True)
            lexicon |= set(kinds[n >= LEXICON].tolist())
        index: dict[str, int] = {}
        vocab: dict[str, int] = {}
        lists: list[list[int]] = []
        for own in words.values():
            for w in own:
                if w not in vocab:
                    vocab[w] = len(lists)
                    lists.append([index.setdefault(f, len(index)) for f in features(w) if f[0] != "w" or w in lexicon or f != f"w{w}"])
        flat = np.fromiter((i for f in lists for i in f), dtype=np.int64)
        offset = np.concatenate([[0], np.cumsum([len(f) for f in lists])])
        ids = {lang: np.array([vocab[w] for w in own]) for lang, own in words.items()}
        k, total = len(langs), sum(map(len, ids.values()))
        weights, trans = np.zeros((len(index), k)), np.zeros((k, k))
        square_w, square_t = np.full((len(index), 1), 1e-6), np.full((k, k), 1e-6)
        for _ in range(rounds if k > 1 else 0):
            # spliced sequences with about as many words as the sample; every language equally often
            word, label = [], []
            have = 0
            while have < total:
                c = int(rng.integers(k))
                n = int(rng.geometric(1 / run))
                own = ids[langs[c]]
                at = int(rng.integers(max(1, len(own) - n + 1)))
                word.append(own[at : at + n])
                label.append(np.full(len(word[-1]), c))
                have += len(word[-1])
            word, label = np.concatenate(word), np.concatenate(label)
            for at in range(0, len(word), 128 * length):
                w, y = word[at : at + 128 * length], label[at : at + 128 * length]
                n = len(w)
                start = np.arange(n) % length == 0
                stop = np.append(start[1:], True)
                kinds, where = np.unique(w, return_inverse=True)
                spans = [flat[offset[i] : offset[i + 1]] for i in kinds]
                sizes = np.array([len(s) for s in spans])
                used = np.concatenate(spans)
                owner = np.repeat(np.arange(len(kinds)), sizes)
                per = np.add.reduceat(weights[used], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                scores = per[where]
                emit = np.maximum(np.exp(scores - scores.max(axis=1, keepdims=True)), 1e-30)
                hop = np.exp(trans - trans.max())
                alpha, beta = _messages(emit, hop, start, stop)
                p = alpha * beta
                p /= p.sum(axis=1, keepdims=True)
                error = -p
                error[np.arange(n), y] += 1
                by_kind = np.zeros((len(kinds), k))
                np.add.at(by_kind, where, error)
                grad = np.zeros_like(weights)
                np.add.at(grad, used, by_kind[owner])
                grad = grad / n - 1e-7 * weights
                inner = np.nonzero(~start)[0]
                pair = alpha[inner - 1][:, :, None] * hop * (emit[inner] * beta[inner])[:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                grad_t = -pair.sum(axis=0)
                np.add.at(grad_t, (y[inner - 1], y[inner]), 1)
                grad_t /= n
                square_w += (grad**2).mean(axis=1, keepdims=True)
                square_t += grad_t**2
                weights += 0.3 * grad / np.sqrt(square_w)
                trans += 0.1 * grad_t / np.sqrt(square_t)
        return cls(langs, index, weights.astype(np.float32), trans)

    def _rows(self, tokens: list[str]) -> np.ndarray:
        """Emission scores of tokens; NaN for those without a letter.  Words seen before are kept."""
        if len(self._seen) + len(self._cores) > _CACHE:
            self._seen.clear()
            self._cores = {"": 0}  # row 0: no letter
        seen, cores, get = self._seen, self._cores, self.index.get
        out, flat, sizes, have = np.empty(len(tokens), dtype=np.int64), [], [], len(cores)
        for i, token in enumerate(tokens):
            at = seen.get(token)
            if at is None:
                word = core(token)
                at = cores.get(word)
                if at is None:
                    at = cores[word] = len(cores)
                    before = len(flat)
                    flat += [j for j in map(get, features(word)) if j is not None]
                    sizes.append(len(flat) - before)
                seen[token] = at
            out[i] = at
        if sizes:
            held = np.array(flat, dtype=np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            if len(cores) > len(self._scores):
                self._scores = np.concatenate([self._scores[:have], np.empty((len(cores), len(self.langs)), dtype=np.float32)])
            for c in range(len(self.langs)):
                self._scores[have : len(cores), c] = np.bincount(owner, weights=self.weights[held, c], minlength=len(sizes))
        return self._scores[out]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n = len(texts)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        chunk = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
        many = pc.list_value_length(chunk).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = chunk.flatten().dictionary_encode()
        rows = self._rows(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(n), many)
        word = ~np.isnan(rows[:, 0])[codes] if len(codes) else np.zeros(0, bool)
        codes, doc = codes[word], doc[word]
        if not len(codes):
            return [UNKNOWN] * n, np.zeros(n)
        total, k = np.zeros((n, len(self.langs))), len(self.langs)
        start = np.append(True, doc[1:] != doc[:-1])
        stop = np.append(start[1:], True)
        # whole chains at a time, about 200,000 words
        heads = np.nonzero(start)[0]
        at = 0
        while at < len(codes):
            end = np.searchsorted(heads, at + 200_000)
            end = int(heads[end]) if end < len(heads) else len(codes)
            p = posteriors(rows[codes[at:end]].astype(np.float64), self.trans, start[at:end], stop[at:end])
            for c in range(k):
                total[:, c] += np.bincount(doc[at:end], weights=p[:, c], minlength=n)
            at = end
        words = np.bincount(doc, minlength=n)
        best = total.argmax(axis=1)
        score = np.where(words > 0, total[np.arange(n), best] / np.maximum(words, 1), 0.0)
        return [self.langs[b] if w else UNKNOWN for b, w in zip(best, words)], np.clip(score, 0.0, 1.0)


def sample(labelled: DataFrame, docs_a_language: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """A bounded training sample of ``labelled(doc_id, text, lang)``: (language, whole text)."""
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")  # ranks are limited before and after the exchange
    picked = usable.select("lang", "text", "doc_id", draw.alias("draw")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs_a_language)
    return [(r.lang, r.text) for r in sorted(picked.select("lang", "draw", "text").collect(), key=lambda r: (r.lang, r.draw, r.text))]


def train(labelled: DataFrame) -> Tagger:
    return Tagger.train(sample(labelled))


def predict(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    held = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches):
        own = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                langs, score = own.predict(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, tagger: Tagger, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a letter and one language for at least ``least`` of it."""
    held = docs.sparkSession.sparkContext.broadcast(tagger)
    at = docs.columns.index(text_col)

    def run(batches):
        own = held.value
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                langs, score = own.predict(part.column(at))
                yield part.filter(pa.array([lang != UNKNOWN and s >= least for lang, s in zip(langs, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str | Column = "doc_id") -> Column:
    return F.coalesce(fold(key) % 5 == 0, F.lit(False))


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagger = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, tagger).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
