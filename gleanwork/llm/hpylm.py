"""A hierarchical Pitman-Yor language model: bigram restaurants that share the unigram restaurant as their parent.

Customers are counted and seated by hash buckets (see parts.py). In each context's restaurant every word (dish) has its
tables; a table is a customer of the parent. Seatings are sampled by Gibbs: in a sweep, all customers of a dish leave and are
seated anew, given the tables of the restaurant's other dishes. How many tables n customers of one dish then have
follows P(t) ~ prod_{j<t} (theta + d (others + j)) p^t S(n, t), p being the dish's probability in the parent and S the
generalised Stirling numbers of discount d; nothing else about a seating matters for predictions, so t is drawn from that law
at once, whatever n is. Within a sweep all dishes of a restaurant are drawn with its tables as the sweep found them (as in
distributed Gibbs samplers), and the parent's probabilities stay as they were while children are seated. Predictive
probabilities are averaged over the sweeps after burn-in. They are linear in tables, so sums of tables are enough.

Random numbers are hashes of context, word and sweep, discounts are parameters, and all sums are of whole numbers: scores
don't depend on how many parts and buckets there are.

A context with very many tokens is cut into slices by the hash of the word, each of which stands for its share
of the restaurant; tables of slices are summed afterwards. The unigram restaurant has all words, which many buckets hold: its
number of tables is taken at its mean-field value (that which gives itself as the expected sum over the words). Given that,
words don't depend on each other, and the expectation that sampling would approach is computed for each.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .parts import (
    MIX, PART_CHARS, SCHEMA, Part, _table, at_buckets, at_parts, edges_of, join_blobs, make_parts, mix64, pack, pack_sorted, send_keys,
    split_blobs, sum_keys, unpack, unpack_sorted, word_hashes,
)

END, START = np.uint64(0x1D8AF066F0A3C1E5), np.uint64(0x7C3E11B9D5F2A8C7)  # hashes of the end token and the first context
DISH = np.uint64(0xFFFFFFFFFFFF0000)  # in seatings, words are told apart by 48 bits of their hash; counts have all 64
FROM_BUCKETS = -100  # senders at or below it are buckets, not parts
STRENGTH, SWEEPS, BURN_IN = 1.0, 24, 12
DISCOUNT, WORD_DISCOUNT = 0.7, 0.75
SMOOTH = 0.1
SLICE_TOKENS, MOST_SLICED = 1_000_000, 1_000_000  # a slice's tokens, unless more contexts than MOST_SLICED would be cut
EXACT = 1024  # customers up to which Stirling ratios are exact
SMALL = 24  # customers up to which dishes are drawn from all numbers of tables, and not from a window of WINDOW about the mode
WINDOW = 64
CHUNK = 1 << 16  # weights computed at once
FINE = 64  # bins of a doubling in the histogram of frequent words


def split_words(text: str) -> list[bytes]:
    """Bytes know A-Z only as letters, and space and 9 to 13 only as white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Stirling:
    """Ratios S(n, t + 1) / S(n, t) of generalised Stirling numbers of discount d.

    Exact to n = EXACT by their recurrence. Beyond, from the generating function phi(z)^t / t!, phi = (1 - (1 - z)^d) / d: its
    saddle point gives phi(z) / t, and what that misses at few tables depends on t / n^d alone, which row EXACT tells.
    """

    def __init__(self, d: float):
        self.d = d
        rows = np.zeros((EXACT + 1, EXACT + 1))
        for n in range(1, EXACT):
            t = np.arange(1, n + 1)
            below = np.concatenate([[0.0], 1 / rows[n, 1:n]])
            rows[n + 1, 1 : n + 1] = (1 + (n - d * (t + 1)) * rows[n, 1 : n + 1]) / (below + n - d * t)
        self.rows = rows
        rest = np.exp(-np.linspace(1e-6, 90, 4000))  # 1 - z
        phi = (1 - rest**d) / d
        tau = phi * rest ** (1 - d) / (1 - rest)
        self._log_tau, self._phi = np.log(tau[::-1]), phi[::-1]
        t = np.arange(1, EXACT)
        self._log_x, self._rho = np.log(t / EXACT**d), rows[EXACT, 1:EXACT] * t / self.phi(t / EXACT)

    def phi(self, tau: np.ndarray) -> np.ndarray:
        return np.interp(np.log(tau), self._log_tau, self._phi)

    def __call__(self, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        """For arrays that broadcast; n all at most EXACT, or all above; t from 1, 0 from n on."""
        if not len(n) or n.flat[-1] <= EXACT:
            return self.rows[n, np.minimum(t, EXACT)]
        t = np.minimum(t, n)
        found = self.phi(t / n) / t * np.interp(np.log(t / n**self.d), self._log_x, self._rho, left=1.0)
        return np.where(t < n, found, 0.0)


_stirling: dict[float, Stirling] = {}


def stirling(d: float) -> Stirling:
    if d not in _stirling:
        _stirling[d] = Stirling(d)
    return _stirling[d]


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """In [0, 1): decided by key and salt."""
    return (mix64(keys + np.uint64((salt + 1) * 0x632BE59BD9B4E019 & (2**64 - 1))) >> np.uint64(11)) * 2.0**-53


class Law:
    """The law of the number of tables: P(t + 1) / P(t) = (c + d t) parent S(n, t + 1) / S(n, t). n ascends, and is 2 at
    least; c is the strength and the discounts of the restaurant's other tables."""

    def __init__(self, n: np.ndarray, d: float):
        self.n, self.d, self.ratio = n, d, stirling(d)
        self.groups = []  # (from, to, n) of equal n, then (from, to, 0) of those with n beyond
        to = int(np.searchsorted(n, SMALL, side="right"))
        sizes, starts = np.unique(n[:to], return_index=True)
        self.groups += [(int(a), int(z), int(k)) for k, a, z in zip(sizes, starts, [*starts[1:], to])]
        mid = int(np.searchsorted(n, EXACT, side="right"))
        self.groups += [(a, z, 0) for a, z in ((to, mid), (mid, len(n))) if z > a]
        # In chunks: whatever the number of dishes, a step takes a few megabytes, and stays in a core's cache.
        size = lambda k: max(1, CHUNK // (k or WINDOW))
        self.groups = [(x, min(x + size(k), z), k) for a, z, k in self.groups for x in range(a, z, size(k))]

    def _weights(self, group, c, parent):
        """Numbers of tables, their weights, and the step between them."""
        a, z, k = group
        c, p, d = c[a:z, None], parent[a:z, None], self.d
        if k:
            t = np.arange(1, k)
            g = (c + d * t) * p * self.ratio.rows[k, 1:k]
            w = np.ones((z - a, k))
            np.cumprod(g, axis=1, out=w[:, 1:])
            return np.arange(1, k + 1)[None, :], w, np.ones((z - a, 1), np.int64)
        n = self.n[a:z, None]
        low, high = np.ones_like(n), n.copy()
        for _ in range(int(n.max()).bit_length()):
            middle = (low + high) >> 1
            up = (c + d * middle) * p * self.ratio(n, middle) >= 1
            low, high = np.where(up & (middle < high), middle + 1, low), np.where(up, high, middle)
        step = np.maximum(1, np.ceil(16 * np.sqrt(low) / WINDOW)).astype(np.int64)
        t = np.maximum(1, low - WINDOW // 2 * step) + step * np.arange(WINDOW)
        between = t[:, :-1] + (step - 1) // 2
        with np.errstate(divide="ignore"):
            g = step * np.log((c + d * between) * p * self.ratio(n, np.minimum(between, n)))
        w = np.zeros(t.shape)
        np.cumsum(g, axis=1, out=w[:, 1:])
        w[t > n] = -np.inf
        return t, np.exp(w - w.max(axis=1, keepdims=True)), step

    def draw(self, c: np.ndarray, parent: np.ndarray, u: np.ndarray) -> np.ndarray:
        out = np.ones(len(self.n), np.int64)
        for group in self.groups:
            a, z, _ = group
            t, w, step = self._weights(group, c, parent)
            up = np.cumsum(w, axis=1)
            at = u[a:z, None] * up[:, -1:]
            k = (up <= at).sum(axis=1, keepdims=True).clip(0, w.shape[1] - 1)
            found = np.take_along_axis(np.broadcast_to(t, w.shape), k, axis=1)
            if (step > 1).any():  # anywhere in its step: by what is left of u
                inside = (at - np.take_along_axis(up - w, k, axis=1)) / np.take_along_axis(w, k, axis=1)
                found = found + (np.clip(inside, 0, 1 - 1e-9) * step).astype(np.int64) - (step - 1) // 2
            out[a:z] = np.clip(found[:, 0], 1, self.n[a:z])
        return out

    def mean(self, c: np.ndarray, parent: np.ndarray) -> np.ndarray:
        out = np.ones(len(self.n))
        for group in self.groups:
            t, w, _ = self._weights(group, c, parent)
            out[group[0] : group[1]] = (t * w).sum(axis=1) / w.sum(axis=1)
        return out


class Seating:
    """Tables of many restaurants. dish i, known by key[i], is a word of restaurant room[i] with count[i] customers; parent[i] is its
    probability in the parent. A restaurant here is a share 1 / slices[room] of the whole."""

    def __init__(self, count, room, n_rooms, parent, slices, key, discount, strength=STRENGTH):
        self.count, self.room, self.n_rooms, self.slices, self.d, self.theta = count, room, n_rooms, slices, discount, strength
        self.tables = (count > 0).astype(np.int64)
        at = np.flatnonzero(count >= 2)  # a single customer has one table whatever happens
        self.at = at[np.argsort(count[at], kind="stable")]
        self.law = Law(count[self.at].astype(np.int64), discount)
        self.parent, self.key = parent[self.at], key[self.at]

    def rooms(self) -> np.ndarray:
        """Tables of each restaurant's part."""
        return np.bincount(self.room, weights=self.tables, minlength=self.n_rooms)

    def sweep(self, salt: int) -> None:
        if not len(self.at):
            return
        own = self.tables[self.at]
        whole = (self.rooms() * self.slices)[self.room[self.at]]
        c = self.theta + self.d * np.maximum(whole - own, 0)
        self.tables[self.at] = self.law.draw(c, self.parent, uniform(self.key, salt))

    def run(self, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums over the sweeps after burn-in: tables of each dish, tables of each room (its share); and the tables of the last sweep."""
        dish, rooms = np.zeros(len(self.count), np.int64), np.zeros(self.n_rooms)
        for s in range(sweeps):
            self.sweep(s)
            if s >= burn_in:
                dish += self.tables
                rooms += self.rooms()
        return dish, rooms.astype(np.int64), self.tables


KEPT, WHOLE = SWEEPS - BURN_IN, 1 << 20


def predictive(count, tables, rooms, context, parent, d: float, strength: float = STRENGTH):
    """Probability of words of `count` customers and `tables` (mean) in restaurants of `context` customers and `rooms` tables."""
    return (count - d * tables + (strength + d * rooms) * parent) / (strength + context)


def histogram(customers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins (up to EXACT by number, FINE to a doubling beyond) and how many words are in each."""
    c = customers[customers > 0]
    beyond = EXACT + np.floor(FINE * np.log2(np.maximum(c, EXACT) / EXACT)).astype(np.int64)
    return np.unique(np.where(c <= EXACT, c, beyond + 1), return_counts=True)


def tables_of_words(bins: np.ndarray, words: np.ndarray, base: float, d: float = WORD_DISCOUNT, strength: float = STRENGTH) -> float:
    """How many tables the unigram restaurant has: the number that is the expected sum over the words, given itself."""
    if not len(bins):
        return 0.0
    n = np.where(bins <= EXACT, bins, np.round(EXACT * 2 ** ((bins - EXACT - 0.5) / FINE))).astype(np.int64)
    many = n >= 2
    law, total, own = Law(n[many], d), float(words.sum()), np.ones(int(many.sum()))
    for _ in range(200):
        own = law.mean(strength + d * np.maximum(total - own, 0), np.full(len(own), base))
        then = float(words[~many].sum() + (own * words[many]).sum())
        if abs(then - total) < 1e-6 * total:
            return round(then)
        total = then
    return round(total)


class Lexicon:
    """A part's words in ascending order of hash, the end token among them, with what the buckets answer about each."""

    def __init__(self, part: Part):
        self.part = part
        hashes = np.concatenate([word_hashes(part.words), [END]]).astype(np.uint64)
        self.keys, place = np.unique(hashes, return_inverse=True)
        self.place = place.astype(np.int64)  # of local word numbers; the last is the end token's
        self.trains = np.array([k and zlib.crc32(str(int(i)).encode()) % 10 != 0 for i, k in zip(part.ids, part.known)], bool)
        self.held = ~self.trains

    def counts(self) -> np.ndarray:
        """Training tokens of each key in this part."""
        mask = np.repeat(self.trains, self.part.lengths)
        out = np.bincount(self.place[self.part.tokens[mask]], minlength=len(self.keys)).astype(np.uint32)
        out[self.place[-1]] += np.uint32(self.trains.sum())
        return out

    def answers(self, got: dict[int, bytes], kinds: list, base: int, n_buckets: int) -> list[np.ndarray]:
        found = [split_blobs(got[base + b]) for b in range(n_buckets) if base + b in got]
        return [np.concatenate([unpack(f[i], t) for f in found]) for i, t in enumerate(kinds)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of context and word for every token, in order of the text, the end token after each document; contexts
        are places, or len(keys) for the first. And which tokens are training tokens."""
        p = self.part
        n = len(p.ids)
        total = len(p.tokens) + n
        ends = p.ends + np.arange(n)  # places of the end tokens
        word = np.empty(total, np.int64)
        is_end = np.zeros(total, bool)
        is_end[ends] = True
        word[ends] = self.place[-1]
        word[~is_end] = self.place[p.tokens]
        context = np.empty(total, np.int64)
        context[1:] = word[:-1]
        context[ends - p.lengths] = len(self.keys)
        return context, word, np.repeat(self.trains, p.lengths + 1)


def slices_of(counts: np.ndarray, total: float, tokens: int = SLICE_TOKENS) -> np.ndarray:
    """Into how many slices a context with these counts is cut. At most MOST_SLICED contexts are cut, whatever the corpus."""
    return np.maximum(1, np.ceil(counts / max(tokens, total / MOST_SLICED))).astype(np.int64)


class Bigrams:
    """A part's distinct bigrams in the order in which buckets get them: by room (a context or a slice of one), then word.

    token: for every token of the texts (ends included) the place of its bigram in that order; word: its word's place.
    """

    def __init__(self, lexicon: Lexicon, c: np.ndarray, n_docs: int, total: float, n_buckets: int, slice_tokens: int = SLICE_TOKENS):
        context, self.word, trains = lexicon.pairs()
        m = len(lexicon.keys)
        code = context * (m + 1) + self.word
        order = np.argsort(code)
        ranked = code[order]
        fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        group = np.empty(len(code), np.int32)
        group[order] = np.cumsum(fresh) - 1
        distinct = ranked[fresh]
        seen = np.bincount(group[trains], minlength=len(distinct)).astype(np.uint32)
        del order, ranked, fresh, code, context, trains
        u, w = distinct // (m + 1), distinct % (m + 1)
        self.keys = np.concatenate([lexicon.keys, [START]]).astype(np.uint64)
        self.of = np.concatenate([c, [n_docs]]).astype(np.float64)
        self.slices = slices_of(self.of, total, slice_tokens)
        plain, cut = mix64(self.keys), np.flatnonzero(self.slices[u] > 1)
        room = plain[u]
        salt = plain[w[cut]] % self.slices[u[cut]].astype(np.uint64)
        room[cut] = mix64(self.keys[u[cut]] + salt * MIX)
        order = np.argsort(room, kind="stable")  # words of a context are in order already
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        self.token = back[group]
        self.u, self.w, self.room, self.seen = u[order], w[order], room[order], seen[order]
        self.first = np.flatnonzero(np.concatenate([[True], self.room[1:] != self.room[:-1]])) if len(order) else np.zeros(0, np.int64)
        self.cuts = np.concatenate([[0], np.searchsorted(self.room, edges_of(n_buckets)), [len(order)]]).astype(np.int64)

    def send(self, number: int):
        place = np.zeros(len(self.keys), np.uint32)
        mark = np.zeros(len(self.keys), bool)
        for b, (a, z) in enumerate(zip(self.cuts, self.cuts[1:])):
            if z == a:
                continue
            starts = self.first[np.searchsorted(self.first, a) : np.searchsorted(self.first, z)]
            w = self.w[a:z]
            mark[w] = True
            words = np.flatnonzero(mark)
            mark[words] = False
            place[words] = np.arange(len(words), dtype=np.uint32)
            at = self.u[starts]
            yield number, b, join_blobs([
                pack_sorted(self.room[starts]), pack(np.diff(np.append(starts, z)).astype(np.uint32)), pack(self.slices[at].astype(np.uint32)),
                pack(self.keys[at] * (self.slices[at] > 1)), pack_sorted(self.keys[words] & DISH),
                pack(np.round(8 * np.log2(1 + self.of[words])).astype(np.uint8)), pack(place[w]), pack(self.seen[a:z]),
            ])


def _seat_bigrams(total: float, distinct_words: float, n_buckets: int):
    def run(bucket: int, rows):
        parts, rooms_, words_, rooms_of, seen_, freq_, slices_, names_ = [], [], [], [], [], [], [], []
        for part, payload in rows:
            b = split_blobs(payload)
            rooms, n = unpack_sorted(b[0]), unpack(b[1], np.uint32).astype(np.int64)
            place = unpack(b[6], np.uint32).astype(np.int64)
            parts.append(part)
            rooms_of.append(rooms)
            rooms_.append(np.repeat(rooms, n))
            slices_.append(unpack(b[2], np.uint32))
            names_.append(unpack(b[3], np.uint64))
            words_.append(unpack_sorted(b[4])[place])
            freq_.append(unpack(b[5], np.uint8)[place])
            seen_.append(unpack(b[7], np.uint32).astype(np.int64))
        sizes = [len(s) for s in seen_]
        room_key, word_key, seen, freq = (np.concatenate(x) for x in (rooms_, words_, seen_, freq_))
        del rooms_, words_, seen_, freq_
        distinct, first, dish = np.unique(mix64(room_key) ^ (word_key * MIX), return_index=True, return_inverse=True)
        dish = dish.astype(np.int32)
        count = np.bincount(dish, weights=seen, minlength=len(distinct)).astype(np.int64)
        rooms, room = np.unique(room_key[first], return_inverse=True)
        word_key, freq = word_key[first], freq[first]
        del room_key, seen, first
        all_rooms, at = np.unique(np.concatenate(rooms_of), return_index=True)
        slices, names = np.concatenate(slices_)[at].astype(np.float64), np.concatenate(names_)[at]
        parent = (2 ** (freq / 8) - 1 + SMOOTH) / (total + SMOOTH * (distinct_words + 1))
        tables, per_room, last = Seating(count, room, len(rooms), parent, slices, distinct, DISCOUNT).run()
        for part, mine, d in zip(parts, rooms_of, np.split(dish, np.cumsum(sizes)[:-1])):
            at_room = np.searchsorted(rooms, mine)
            yield part, bucket, join_blobs([
                pack(count[d].astype(np.uint32)), pack(tables[d].astype(np.uint32)), pack(per_room[at_room].astype(np.uint64)),
            ])
        # Tables are the parent's customers, and go to the words' buckets.
        words, place = np.unique(word_key, return_inverse=True)
        customers = np.bincount(place, weights=last, minlength=len(words)).astype(np.uint32)
        yield from send_keys(FROM_BUCKETS - bucket, words, [customers], n_buckets)
        cut = np.flatnonzero(slices > 1)
        if len(cut):
            yield -1, bucket, join_blobs([pack(names[cut]), pack(per_room[cut].astype(np.uint64))])

    return run


def _count_words(bucket: int, rows):
    parts, places, keys, (sums,) = sum_keys(rows, [np.uint32])
    for part, place in zip(parts, places):
        yield part, bucket, join_blobs([pack(sums[place].astype(np.uint64))])
    yield -1, bucket, join_blobs([pack(np.array([0, 1])), pack(np.array([sums.sum(), (sums > 0).sum()], np.int64))])


def _sum_words(bucket: int, rows):
    """The words' customers: each part's, the histogram, and the bucket's own list."""
    parts, places, keys, (customers,) = sum_keys(rows, [np.uint32])
    customers = customers.astype(np.int64)
    for part, place in zip(parts, places):
        if part >= 0:
            yield part, bucket, join_blobs([pack(customers[place])])
    yield -1, bucket, join_blobs([pack(x) for x in histogram(customers)])
    yield -3, bucket, join_blobs([pack(customers)])


def word_tables(customers: np.ndarray, tables: float, distinct_words: float) -> np.ndarray:
    """Expected tables of words in the unigram restaurant that has `tables` in all, in units of 1 / WHOLE (so that sums are
    exact). All words have the same base probability there: words of equal customers have equal expectations."""
    n, place = np.unique(customers, return_inverse=True)
    found = (n > 0).astype(np.float64)
    many = n >= 2
    law, base = Law(n[many].astype(np.int64), WORD_DISCOUNT), np.full(int(many.sum()), 1 / (distinct_words + 1))
    for _ in range(4):  # a word's own tables are taken out of the others': they settle at once
        found[many] = law.mean(STRENGTH + WORD_DISCOUNT * np.maximum(tables - found[many], 0), base)
    return np.round(found * WHOLE).astype(np.int64)[place]


def _seat_all_words(tables: float, distinct_words: float):
    """What all words have: customers, and expected tables."""

    def run(batches):
        for batch in batches:
            for bucket, payload in zip(batch.column(1).to_pylist(), batch.column(2)):
                customers = unpack(split_blobs(payload.as_py())[0], np.int64)
                found = word_tables(customers, tables, distinct_words)
                yield from _table([(-1, bucket, join_blobs([pack(np.array([0, 1])), pack(np.array([customers.sum(), found.sum()], np.int64))]))])

    return run


def _stats(answers: DataFrame) -> dict[int, int]:
    """Sums, by number, of what the buckets say of themselves (pairs of a number and a value): whole numbers, of at most
    a few thousand kinds, added in Spark."""

    def pairs(batches):
        import pyarrow as pa

        for batch in batches:
            for payload in batch.column(0):
                k, v = (unpack(x, np.int64) for x in split_blobs(payload.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], ["k", "v"])

    rows = answers.filter("part = -1").select("payload").mapInArrow(pairs, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return {r["k"]: r["v"] for r in rows}


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: int = PART_CHARS, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of `docs`.

    Learns from the rows whose crc32(key as text) mod 10 is not 0. Null texts are empty: one token, the end. Null keys
    are held out. Equal texts have equal scores; rows that repeat are documents each, and count so. No rows: no result
    rows. Nothing to learn from: every word has the probability of an unknown one. Extra columns aren't read. A text of
    any length is one document of one part. To the driver come a histogram of words by customers (some thousand bins), and
    the tables of the contexts cut into slices (MOST_SLICED at most), which are broadcast. Scores don't depend on partitions.
    """
    parts = make_parts(docs, split_words, key, text, chars)
    n = max(1, parts.count())
    schema = "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    sc = docs.sparkSession.sparkContext

    def count(part: Part, got):
        lex = Lexicon(part)
        yield from send_keys(part.number, lex.keys, [lex.counts()], n)
        yield part.number, n, join_blobs([pack(np.array([lex.trains.sum()], np.float64))])

    sent = at_parts([parts], n, count)
    # Bucket n only adds up how many documents there are to learn from.
    def counted(bucket, rows):
        if bucket == n:
            docs_ = sum(float(unpack(split_blobs(p)[0], np.float64)[0]) for _, p in rows)
            yield -2, bucket, join_blobs([pack(np.array([docs_]))])
        else:
            yield from _count_words(bucket, rows)

    words = at_buckets(sent, n + 1, counted)
    told = _stats(words)
    total, distinct_words = float(told.get(0, 0)), float(told.get(1, 0))
    learnt = words.filter("part = -2").select("payload").collect()
    n_docs = float(unpack(split_blobs(learnt[0]["payload"])[0], np.float64)[0]) if learnt else 0.0

    def bigrams_of(part: Part, got):
        lex = Lexicon(part)
        c = lex.answers(got, [np.uint64], 0, n)[0].astype(np.float64)
        return lex, c, Bigrams(lex, c, n_docs, total, n, slice_tokens)

    def send_bigrams(part: Part, got):
        _, _, grams = bigrams_of(part, got)
        yield from grams.send(part.number)

    seated = at_buckets(at_parts([parts, words], n, send_bigrams), n, _seat_bigrams(total, distinct_words, n))
    seated = seated.withColumn("tag", F.when(F.col("part") >= 0, F.col("tag") + n).otherwise(F.col("tag")))
    cut: dict[int, float] = {}
    for row in seated.filter("part = -1").select("payload").collect():
        names, tables = split_blobs(row["payload"])
        for k, t in zip(unpack(names, np.uint64).tolist(), unpack(tables, np.uint64).tolist()):
            cut[k] = cut.get(k, 0.0) + t / KEPT

    def ask_words(part: Part, got):
        keys = np.unique(Lexicon(part).keys & DISH)
        yield from send_keys(part.number, keys, [np.zeros(len(keys), np.uint32)], n)

    tables = seated.filter(F.col("part") <= FROM_BUCKETS)
    parents = at_buckets(at_parts([parts], n, ask_words).unionByName(tables), n, _sum_words)
    bins = sorted(_stats(parents).items())
    tables_of_all = tables_of_words(*(np.array(x, np.int64) for x in zip(*bins)), 1 / (distinct_words + 1)) if bins else 0.0
    seats = _stats(parents.filter("part = -3").mapInArrow(_seat_all_words(tables_of_all, distinct_words), SCHEMA))
    customers, all_tables = float(seats.get(0, 0)), seats.get(1, 0) / WHOLE
    parents = parents.withColumn("tag", F.when(F.col("part") >= 0, F.col("tag") + 2 * n).otherwise(F.col("tag")))
    shared = sc.broadcast(cut)

    def score(part: Part, got):
        import pyarrow as pa

        lex, c, grams = bigrams_of(part, got)
        count_, tables = lex.answers(got, [np.uint32, np.uint32], n, n)
        rooms = [unpack(split_blobs(got[n + b])[2], np.uint64) for b in range(n) if n + b in got]
        sizes = np.diff(np.append(grams.first, len(grams.room)))
        tables_of_room = np.repeat(np.concatenate(rooms) / KEPT, sizes)
        u = grams.u
        if shared.value:
            whole = np.array([shared.value.get(k, -1.0) if s > 1 else -1.0 for k, s in zip(grams.keys.tolist(), grams.slices.tolist())])
            tables_of_room = np.where(whole[u] >= 0, whole[u], tables_of_room)
        at = np.unique(lex.keys & DISH, return_inverse=True)[1]
        own = lex.answers(got, [np.int64], 2 * n, n)[0]
        mean = word_tables(own, tables_of_all, distinct_words) / WHOLE
        unigram = predictive(own, mean, all_tables, customers, 1 / (distinct_words + 1), WORD_DISCOUNT)[at]
        p = predictive(count_, tables / KEPT, tables_of_room, grams.of[u], unigram[grams.w], DISCOUNT)
        each, word = np.log10(p)[grams.token], grams.word
        base = np.log10((c + SMOOTH) / (total + SMOOTH * (distinct_words + 1)))[word]
        n_tokens = part.lengths + 1
        starts = np.cumsum(n_tokens) - n_tokens
        add = lambda x: np.add.reduceat(x, starts)
        scores = add(each)
        yield pa.RecordBatch.from_arrays([
            pa.array(part.ids, mask=~part.known), pa.array(lex.held), pa.array(n_tokens), pa.array(add((c > 0).astype(np.int64)[word])),
            pa.array(np.full(len(n_tokens), int(total))), pa.array(add(base)), pa.array(scores), pa.array(10 ** np.minimum(-scores / n_tokens, 300)),
        ], [f.split()[0] for f in schema.split(", ")])

    return at_parts([parts, words, seated, parents], n, score, schema, raw=True)


def op5_pitman_yor(spark, sf_dir):
    found = score_texts(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("key", "doc_id")
