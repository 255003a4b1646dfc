"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table
from .parts import release

WORD = re.compile(r"[^\W_]+")
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
PER_WORD = 4  # the word, its first three and four letters, its last three
CACHE_WORDS = 300_000
CHUNK = 1 << 15  # words convolved at once
#: Frequent function words, by which a text's language is guessed (the `lang` column is never read).
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as by at be this an or".split(),
    "de": "der die und das den von zu im mit sich des auf ist dem nicht ein eine als auch es".split(),
    "fr": "le la les des et du un une en est que dans qui pour par sur au pas ce plus".split(),
    "es": "el los las del y que una por con para su se al lo como es un más pero sus".split(),
}
LANGUAGE_OF: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        LANGUAGE_OF[_w] = (*LANGUAGE_OF.get(_w, ()), _lang)


def word_buckets(word: str) -> list[int]:
    """Rows of the embedding table whose sum is the word's vector. Row 0 is kept for the gaps between texts."""
    keys = (word, "<" + word[:3], "<<" + word[:4], word[-3:] + ">")
    return [1 + xxhash.xxh32_intdigest(k.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for k in keys]


def guess_language(words: list[str]) -> str:
    """The language whose function words are most frequent among `words`; "other" where none occurs. Ties: by name."""
    votes: dict[str, int] = {}
    for w in words:
        for lang in LANGUAGE_OF.get(w, ()):
            votes[lang] = votes.get(lang, 0) + 1
    return min(votes, key=lambda k: (-votes[k], k)) if votes else "other"


class Vocabulary:
    """Words seen by this process, as rows of buckets; starts anew when it holds CACHE_WORDS."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, PER_WORD), np.int32)

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.at) > CACHE_WORDS:
            self.__init__()
        at = self.at
        for w in set(words).difference(at):
            k = at[w] = len(at)
            if k >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[k] = word_buckets(w)
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))

    def buckets(self, words: list[str]) -> np.ndarray:
        ids = self.ids(words)  # may replace self.rows
        return self.rows[ids]


class Model:
    """Embeddings E, filters W[width][position], their biases, and a logistic layer over the pooled maxima."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.E[0] = 0
        self.W = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.c = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.float32(0)
        self.threshold: dict[str, float] = {}

    def convolve(self, x: np.ndarray) -> np.ndarray:
        """[len(x), filters of all widths]; row i has the windows that begin at word i. x ends with enough zero rows."""
        n = len(x) - max(WIDTHS) + 1
        found = []
        for w, W, c in zip(WIDTHS, self.W, self.c):
            y = x[:n] @ W[0] + c
            for j in range(1, w):
                y += x[j : j + n] @ W[j]
            found.append(y)
        return np.maximum(np.concatenate(found, axis=1), 0)

    def pooled(self, buckets: np.ndarray) -> np.ndarray:
        """Maxima over the whole text, a chunk at a time. No words: zeros."""
        best = np.zeros(FILTERS * len(WIDTHS), np.float32)
        gap = np.zeros((max(WIDTHS) - 1, DIM), np.float32)
        for at in range(0, len(buckets), CHUNK):
            x = self.E[buckets[at : at + CHUNK + len(gap)]].sum(axis=1)
            if len(buckets) - at <= CHUNK + len(gap):
                x = np.concatenate([x, gap])
            best = np.maximum(best, self.convolve(x).max(axis=0))
        return best

    def logit(self, buckets: np.ndarray) -> float:
        return float(self.pooled(buckets) @ self.out + self.bias)

    def score(self, buckets: np.ndarray, lang: str) -> float:
        """Calibrated so that the language's threshold is 0.5."""
        z = self.logit(buckets) - self.threshold.get(lang, self.threshold.get("", 0.0))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, passes: int = 40_000, batch: int = 32, rate: float = 0.05, seed: int = 11) -> None:
        """Adagrad on the logistic loss; classes weigh the same. Only the windows that won a maximum take gradients.
        Epochs: as many as make about `passes` texts, 8 to 30."""
        rng = np.random.default_rng(seed)
        squares: dict[str, np.ndarray] = {}
        share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        width, gap = max(WIDTHS), np.zeros((max(WIDTHS) - 1, PER_WORD), np.uint16)

        def step(name, value, grad):
            s = squares.setdefault(name, np.full(np.shape(value), 1e-3, np.float32))
            s += grad * grad
            return value - rate * grad / np.sqrt(s)

        for _ in range(min(30, max(8, passes // max(1, len(texts))))):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                pieces = [p for k in pick for p in (texts[k], gap)]
                ids = np.concatenate(pieces) if pieces else gap
                x = self.E[ids].sum(axis=1)
                y = self.convolve(np.concatenate([x, np.zeros((width - 1, DIM), np.float32)]))
                ends = np.cumsum([len(texts[k]) + len(gap) for k in pick])
                starts = ends - [len(texts[k]) + len(gap) for k in pick]
                where = np.stack([a + y[a:b].argmax(axis=0) for a, b in zip(starts, ends)])
                top = np.take_along_axis(y, where, axis=0)
                p = 1 / (1 + np.exp(-np.clip(top @ self.out + self.bias, -30, 30)))
                g = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
                d_top = g[:, None] * self.out[None, :] * (top > 0)
                d_out = top.T @ g
                touched, deltas = [], []
                for f, w in enumerate(WIDTHS):
                    cols = slice(f * FILTERS, (f + 1) * FILTERS)
                    gp, pos = d_top[:, cols], where[:, cols]
                    dW = np.zeros_like(self.W[f])
                    for j in range(w):
                        at_j = np.minimum(pos + j, len(x) - 1)
                        dW[j] = np.einsum("bfd,bf->df", x[at_j], gp)
                        dx = gp[:, :, None] * self.W[f][j].T[None, :, :]
                        touched.append(ids[at_j].reshape(-1, PER_WORD))
                        deltas.append(dx.reshape(-1, DIM))
                    self.W[f] = step(f"W{f}", self.W[f], dW)
                    self.c[f] = step(f"c{f}", self.c[f], gp.sum(axis=0))
                rows, d = np.concatenate(touched), np.concatenate(deltas)
                uniq, back = np.unique(rows.ravel(), return_inverse=True)
                total = np.zeros((len(uniq), DIM), np.float32)
                np.add.at(total, back, np.repeat(d, PER_WORD, axis=0))
                total[uniq == 0] = 0
                s = squares.setdefault("E", np.full(self.E.shape, 1e-3, np.float32))
                s[uniq] += total * total
                self.E[uniq] -= rate * total / np.sqrt(s[uniq])
                self.out = step("out", self.out, d_out)
                self.bias = np.float32(step("bias", np.array(self.bias, np.float32), np.array(g.sum(), np.float32)))

    def calibrate(self, texts: list[np.ndarray], langs: list[str], labels: np.ndarray, least: int = 8) -> None:
        """For each guessed language, and "" for the rest, the threshold with fewest errors, amid the widest gap of such."""
        z = np.array([self.logit(t) for t in texts])
        for lang in ["", *sorted(set(langs))]:
            own = np.array([not lang or x == lang for x in langs], bool) if len(texts) else np.zeros(0, bool)
            y, s = labels[own], z[own]
            if min((y == 1).sum(), (y == 0).sum()) < least:
                continue
            order = np.argsort(s, kind="stable")
            s, y = s[order], y[order]
            errors = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
            low, high = np.concatenate([[s[0] - 2], s]), np.concatenate([s, [s[-1] + 2]])
            best = max(range(len(errors)), key=lambda k: (-errors[k], high[k] - low[k]))
            self.threshold[lang] = float((low[best] + high[best]) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """text, toxic, part, lot: per_class labels of each class for part "fit", and half as many for "calibrate", drawn by
    hash from those of documents whose crc32(doc_id as text) mod 5 is not 0. The draw needs the labels alone; at most
    3 * per_class ids are broadcast to find the texts. A document labelled twice counts as toxic if one label says so."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).withColumn("lot", F.xxhash64(F.lit("toxicity"), "doc_id"))
    drawn = None
    for part, remainders, n in (("fit", (0, 1), per_class), ("calibrate", (2,), per_class // 2)):
        for label in (0, 1):
            one = rows.filter((F.col("toxic") == label) & F.pmod("lot", F.lit(3)).isin(*remainders)).orderBy("lot", "doc_id").limit(n)
            one = one.withColumn("part", F.lit(part))
            drawn = one if drawn is None else drawn.unionAll(one)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic", "part", "lot")


def _encode(batches):
    import pyarrow as pa

    vocabulary = Vocabulary()
    for batch in batches:
        text, toxic, part, lot = (c.to_pylist() for c in batch.columns)
        ids, lang, size = [], [], []
        for t in text:
            words = WORD.findall((t or "").lower())
            size.append(len(words))
            ids.append(vocabulary.buckets(words).astype(np.uint16).tobytes())
            lang.append(guess_language(words))
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(part, pa.string()), pa.array(lang, pa.string()), pa.array(ids, pa.binary()), pa.array(lot, pa.int64()), pa.array(size, pa.int64())], ["toxic", "part", "lang", "ids", "lot", "n"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, max_words: int = 6_000_000) -> Model:
    """A model fitted on the driver to a sample whose bounds are per_class rows and max_words words in all: of the rows
    drawn, in order of their lots, as many as have max_words together. So the sample doesn't depend on how the tables are
    partitioned. Without both labels in the sample, scores are the classifier's prior."""
    rows = training_rows(docs, labels, per_class).mapInArrow(_encode, "toxic int, part string, lang string, ids binary, lot long, n long")
    rows = materialise(rows, "sample")
    words, last = 0, None
    for lot, n in sorted(tuple(r) for r in rows.select("lot", "n").collect()):  # 3 * per_class pairs of numbers
        words += n
        if words > max_words:
            break
        last = lot
    sample: dict[str, list] = {"fit": [], "calibrate": []}
    if last is not None:
        for r in rows.filter(F.col("lot") <= last).toLocalIterator(prefetchPartitions=True):
            sample[r["part"]].append((r["toxic"], r["lang"], np.frombuffer(r["ids"], np.uint16).reshape(-1, PER_WORD), r["lot"]))
    model = Model()
    for rows in sample.values():
        rows.sort(key=lambda x: (x[3], x[2].tobytes()))
    fit = sample["fit"]
    labels_ = np.array([x[0] for x in fit], np.float32)
    if len(fit) and 0 < labels_.mean() < 1:
        model.fit([x[2] for x in fit], labels_)
        rest = sample["calibrate"]
        model.calibrate([x[2] for x in rest], [x[1] for x in rest], np.array([x[0] for x in rest]))
    else:
        model.out[:] = 0
        model.threshold[""] = 1.0 if not len(fit) or labels_.mean() == 0 else -1.0
    del sample, fit, rows
    release()
    return model


def scorer(shared, text: int):
    """text: the place of the text in `row`."""

    def score(batches):
        import pyarrow as pa

        model, vocabulary = shared.value, Vocabulary()
        for batch in batches:
            out = []
            for t in batch.column(0).field(text):  # a row at a time: a batch may be large
                words = WORD.findall((t.as_py() or "").lower())
                out.append(model.score(vocabulary.buckets(words), guess_language(words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["row", "score"])
            batch = out = t = words = None
            release()

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None, per_class: int = 2500) -> DataFrame:
    """All columns of `docs` as struct `row`, with `score` (0 to 1).

    The score depends on the text alone: neither labels nor any other column is read when scoring. Null and empty texts
    have the score of a text without words. Equal texts have equal scores. Very long texts are read whole, in chunks.
    No rows: no result rows. No usable labels: every score is the same, below 0.5. Extra columns pass through in `row`.
    The model (2 MB, fixed by its parameters) is broadcast.
    """
    model = train(docs if train_on is None else train_on, labels, per_class)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # Workers read the text in `row`: it is sent once.
    place = docs.columns.index("text") if "text" in docs.columns else [c.lower() for c in docs.columns].index("text")
    plain = docs.select(F.struct(*docs.columns).alias("row"))
    schema = plain.select("row").schema.add("score", "double")
    return plain.mapInArrow(scorer(shared, place), schema)


def op4_toxicity_cnn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity_scores(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents whose score is 0.5 or more go; all columns stay."""
    found = toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return found.filter("score < 0.5").select("row.*")
