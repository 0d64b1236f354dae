"""Language identification by a linear-chain conditional random field over the words of a text.

A word's features are its affixes (2 and 3 bytes at either end), its 3-byte n-grams with both borders, and the
languages in whose lexicon it stands. Emission weights and transitions are learnt together, from labelled texts and from
sequences that switch between them. Words of a text are labelled by forward-backward, exactly over the whole text: long
texts are cut into segments whose transfer matrices are multiplied, so work is done for many segments at once. A text's
language is the one with most posterior mass; the score is its share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .common import batches_of

BUCKETS, SEGMENT = 1 << 16, 64
#: Words of a training sequence.
WINDOW = 128
#: Words are runs of ASCII letters and non-ASCII bytes.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Features:
    """Hashed features of the words of some documents laid end to end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.owner = hashing.word_spans(data, offsets, _SEPARATOR)
        padded = np.concatenate([data, np.full(4, 32, np.uint8)]).astype(np.uint32)
        self.n = len(self.starts)
        size = self.ends - self.starts

        def bucket(code: np.ndarray, salt: int) -> np.ndarray:
            x = (code + np.uint32(salt * 0x01000193)) * np.uint32(0x9E3779B1)
            return ((x ^ x >> np.uint32(15)) >> np.uint32(3) & np.uint32(BUCKETS - 1)).astype(np.int32)

        s, e = self.starts, self.ends
        two = padded[s] | padded[s + 1] << np.uint32(8)
        last = padded[e - 1] | padded[np.maximum(e - 2, s)] << np.uint32(8)
        self.affixes = np.stack([bucket(two, 1), bucket(two | padded[s + 2] << np.uint32(16), 2), bucket(last, 3), bucket(last | padded[np.maximum(e - 3, s)] << np.uint32(16), 4)]) if self.n else np.zeros((4, 0), np.int32)
        # n-grams at each byte of a word but the last, the first one with the border before it
        inside = np.zeros(len(data) + 1, bool)
        mark = np.zeros(len(data) + 2, np.int8)
        np.add.at(mark, s, 1)
        np.add.at(mark, e, -1)
        inside = np.cumsum(mark[:-2]) > 0
        at = np.flatnonzero(inside)
        self.grams = bucket(padded[at] | padded[at + 1] << np.uint32(8) | padded[at + 2] << np.uint32(16), 5)
        self.first = np.cumsum(size) - size
        self.size = size
        self.words = hashing.Prefix(data).of(s, e) if self.n else np.zeros(0, np.uint64)


class Crf:
    """Weights, lexicon and transitions; labels are numbers."""

    def __init__(self, labels: list[str]):
        self.labels, n = labels, len(labels)
        self.affix, self.gram = np.zeros((BUCKETS, n), np.float32), np.zeros((BUCKETS, n), np.float32)
        self.lexicon, self.lexicon_label = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lexicon_weight, self.bias = np.zeros((n + 1, n), np.float32), np.zeros(n, np.float32)
        self.transition = np.zeros((n, n), np.float32)

    def _entry(self, f: Features) -> np.ndarray:
        if not len(self.lexicon):
            return np.full(f.n, len(self.labels))
        place = np.minimum(np.searchsorted(self.lexicon, f.words), len(self.lexicon) - 1)
        return np.where(self.lexicon[place] == f.words, self.lexicon_label[place], len(self.labels))

    def emissions(self, f: Features) -> np.ndarray:
        """Score of each label for each word."""
        if not f.n:
            return np.zeros((0, len(self.labels)), np.float32)
        out = np.add.reduceat(self.gram[f.grams], f.first, axis=0) / f.size[:, None].astype(np.float32)
        for a in f.affixes:
            out += self.affix[a]
        return out + self.lexicon_weight[self._entry(f)] + self.bias

    def posteriors(self, scores: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Posterior of each label for each word, over whole documents (``owner`` ascending)."""
        n, k = scores.shape
        if not n:
            return scores
        e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
        a = np.exp(self.transition - self.transition.max()).astype(np.float64)
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sizes = np.diff(np.concatenate([begins, [n]]))
        segments = -(-sizes // SEGMENT)
        of = np.repeat(np.arange(len(begins)), segments)
        rank = np.arange(len(of)) - np.repeat(np.cumsum(segments) - segments, segments)
        start = begins[of] + rank * SEGMENT
        length = np.minimum(SEGMENT, begins[of] + sizes[of] - start)
        grid = np.minimum(start[:, None] + np.arange(SEGMENT), n - 1)
        real = np.arange(SEGMENT) < length[:, None]
        grid_e = e[grid]
        # transfer matrix of each segment
        m = np.broadcast_to(np.eye(k), (len(of), k, k)).copy()
        for t in range(SEGMENT):
            step = (m @ a) * grid_e[:, t, None, :]
            m = np.where(real[:, t, None, None], step / step.max(axis=(1, 2), keepdims=True), m)
        # vectors at the borders of segments, documents side by side
        ahead, back = np.ones((len(of), k)) / k, np.ones((len(of), k))
        by_rank = np.argsort(rank, kind="stable")
        cuts = np.searchsorted(rank[by_rank], np.arange(rank.max() + 2))
        for r in range(1, rank.max() + 1):
            here = by_rank[cuts[r] : cuts[r + 1]]
            v = (ahead[here - 1, None, :] @ m[here - 1])[:, 0]
            ahead[here] = v / v.sum(axis=1, keepdims=True)
        for r in range(rank.max(), 0, -1):
            here = by_rank[cuts[r] : cuts[r + 1]]
            v = (m[here] @ back[here, :, None])[..., 0]
            back[here - 1] = v / v.sum(axis=1, keepdims=True)
        # forward and backward inside all segments at once
        forward = np.empty((len(of), SEGMENT, k))
        v = ahead
        for t in range(SEGMENT):
            step = (v @ a) * grid_e[:, t]
            v = np.where(real[:, t, None], step / step.sum(axis=1, keepdims=True), v)
            forward[:, t] = v
        v = back
        for t in range(SEGMENT - 1, -1, -1):
            forward[:, t] *= v
            step = (v * grid_e[:, t]) @ a.T
            v = np.where(real[:, t, None], step / step.sum(axis=1, keepdims=True), v)
        out = forward[real]
        return out / out.sum(axis=1, keepdims=True)


def chain_marginals(scores: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chains of equal length (chains x words x labels): the posterior of each label at each word, and the expected
    number of each pair of neighbouring labels over all chains, by forward-backward."""
    rows, length, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float64)
    a = np.exp(transition - transition.max()).astype(np.float64)
    ahead, back = np.empty((rows, length, k)), np.empty((rows, length, k))
    ahead[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        v = (ahead[:, t - 1] @ a) * e[:, t]
        ahead[:, t] = v / v.sum(axis=1, keepdims=True)
    back[:, -1] = 1.0 / k
    pairs = np.zeros((k, k))
    for t in range(length - 2, -1, -1):
        further = e[:, t + 1] * back[:, t + 1]
        joint = ahead[:, t, :, None] * a * further[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        v = further @ a.T
        back[:, t] = v / v.sum(axis=1, keepdims=True)
    post = ahead * back
    return post / post.sum(axis=2, keepdims=True), pairs


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def train(examples: list[tuple[str, str]], steps: int = 25, length: int = WINDOW, seed: int = 7) -> Crf | None:
    """Learn from (text, language) pairs, all words of each; None without any word. Languages without any are left out.

    Half of the sequences of ``length`` words switch languages every 10 to 40 words, so transitions are learnt, too. The
    gradient is that of the conditional likelihood: what the chains hold less what they are expected to hold.
    """
    f = Features(*_laid([t.lower().encode() for t, _ in examples]))
    if not f.n:
        return None
    sizes = np.bincount(f.owner, minlength=len(examples))
    model = Crf(sorted({lang for (_, lang), n in zip(examples, sizes) if n}))
    k = len(model.labels)
    label = np.array([model.labels.index(lang) if n else -1 for (_, lang), n in zip(examples, sizes)])[f.owner]
    # the lexicon: words of which nine tenths, and at least three, stand in one language
    known, place = np.unique(f.words, return_inverse=True)
    by = np.bincount(place * k + label, minlength=len(known) * k).reshape(-1, k)
    sure = (by.max(axis=1) >= 3) & (by.max(axis=1) >= 0.9 * by.sum(axis=1))
    model.lexicon, model.lexicon_label = known[sure], by.argmax(axis=1)[sure]
    # sequences: runs of one language's words, whole or switching
    rng = np.random.default_rng(seed)
    per_label = [np.flatnonzero(label == c) for c in range(k)]
    rows = []
    for r in range(max(k, f.n // length)):
        row: list[int] = []
        while len(row) < length:
            pool = per_label[(r // 2) % k if r % 2 and not row else rng.integers(k)]
            run = length if r % 2 else int(rng.integers(10, 41))
            at = int(rng.integers(len(pool)))
            row += pool[at : at + run].tolist()
        rows.append(row[:length])
    chains = np.array(rows)
    y = label[chains]
    flat = chains.reshape(-1)
    entry = model._entry(f)[flat]
    n_grams = f.size[flat]
    gram_at = np.arange(n_grams.sum()) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams) + np.repeat(f.first[flat], n_grams)
    gram, gram_word = f.grams[gram_at], np.repeat(np.arange(len(flat)), n_grams)
    one = np.eye(k)[y.reshape(-1)]
    held = np.bincount((y[:, :-1] * k + y[:, 1:]).reshape(-1), minlength=k * k).reshape(k, k)
    parts = [model.affix, model.gram, model.lexicon_weight, model.bias, model.transition]
    seen = [np.full(p.shape, 1e-6, np.float32) for p in parts]
    for _ in range(steps):
        post, pairs = chain_marginals(model.emissions(f)[chains], model.transition)
        residual = (one - post.reshape(-1, k)).astype(np.float32)
        grads = [np.zeros_like(p) for p in parts]
        for a in f.affixes:
            for c in range(k):
                grads[0][:, c] += np.bincount(a[flat], residual[:, c], BUCKETS)
        shared = residual / n_grams[:, None]
        for c in range(k):
            grads[1][:, c] += np.bincount(gram, shared[gram_word, c], BUCKETS)
            grads[2][:, c] += np.bincount(entry, residual[:, c], k + 1)
        grads[3] += residual.sum(axis=0)
        grads[4] += (held - pairs).astype(np.float32)
        for p, g, s in zip(parts, grads, seen):
            g -= 1e-3 * p
            s += g * g
            p += 0.5 * g / np.sqrt(s)
    return model


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to rows of WINDOW words, from the first word of a text to its last, and a hash of each."""
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            data = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = hashing.word_spans(data, np.array([0, len(data)]), _SEPARATOR)
            cuts = range(0, len(starts), WINDOW)
            parts = [data[starts[a] : ends[min(a + WINDOW, len(starts)) - 1]].tobytes().decode() for a in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts), pa.string()), pa.array(parts, pa.string())], names=["lang", "part"])


def sample(training: DataFrame, per_language: int, windows: int) -> list[tuple[str, str]]:
    """Training windows (text, lang): of each language at most ``per_language`` of its different texts, those of the least
    hash, and of these at most ``windows`` different runs of WINDOW words, again those of the least hash."""
    usable = training.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = usable.where(F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]"))

    def least(rows: DataFrame, most: int) -> DataFrame:
        # a language's rows in parts first, then what is left of them
        first = F.row_number().over(Window.partitionBy("lang", "part_of").orderBy("h"))
        rows = rows.withColumn("part_of", F.pmod(F.xxhash64("h"), F.lit(16))).withColumn("r", first).where(F.col("r") <= most)
        return rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= most).drop("r", "part_of")

    picked = least(usable.select("lang", F.xxhash64("text").alias("h")).distinct(), per_language)
    # two numbers for each of at most per_language rows a language
    texts = usable.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    parts = texts.select("lang", "text").mapInArrow(_windows, "lang string, part string").select("lang", "part", F.xxhash64("part").alias("h")).distinct()
    return [(r["part"], r["lang"]) for r in least(parts, windows).orderBy("lang", "h").collect()]


def identify(docs: DataFrame, training: DataFrame, per_language: int = 250, windows: int = 400, with_runs: bool = False, **parameters) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text), learnt from ``training`` (text, lang).

    The model is fitted on a bounded ``sample`` of the training rows (``per_language``, ``windows``), in which repeated
    rows count once and texts of any length take part; every text is predicted whole. With ``with_runs`` an array
    ``runs`` (lang, first_word, n_words) follows: the labels of the words one by one, equal neighbours together, which
    tells the languages of code-switched text. Null and letterless texts are ``und`` with score 0, as is everything where
    nothing can be learnt; ties go to the language that sorts first; rows that repeat repeat; extra columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    examples = sample(training, per_language, windows)
    model = train(examples, **parameters) if examples else None
    held = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = held.value
        for whole in batches:
            for batch, data, offsets in batches_of(whole, "body", 750_000):
                lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
                letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
                runs: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                if crf is not None:
                    f = Features(data, offsets)
                    post = crf.posteriors(crf.emissions(f), f.owner)
                    mass = np.stack([np.bincount(f.owner, post[:, c], batch.num_rows) for c in range(len(crf.labels))], axis=1)
                    some = letters & (mass.sum(axis=1) > 0)
                    lang[some] = np.array(crf.labels, object)[mass[some].argmax(axis=1)]
                    score[some] = mass[some].max(axis=1) / mass[some].sum(axis=1)
                    if with_runs and f.n:
                        best = post.argmax(axis=1)
                        cuts = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (f.owner[1:] != f.owner[:-1]), [True]]))
                        begins = np.searchsorted(f.owner, np.arange(batch.num_rows))
                        for a, z in zip(cuts[:-1], cuts[1:]):
                            runs[f.owner[a]].append({"lang": crf.labels[best[a]], "first_word": int(a - begins[f.owner[a]]), "n_words": int(z - a)})
                columns = {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(np.clip(score, 0, 1))}
                if with_runs:
                    columns["runs"] = pa.array(runs, pa.list_(pa.struct({"lang": pa.string(), "first_word": pa.int64(), "n_words": pa.int64()})))
                yield pa.RecordBatch.from_pydict(columns)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double" + ", runs array<struct<lang: string, first_word: long, n_words: long>>" * with_runs
    return docs.select("doc_id", text.rlike(r"\p{L}").alias("letters"), F.lower(text).cast("binary").alias("body")).mapInArrow(predict, schema)
