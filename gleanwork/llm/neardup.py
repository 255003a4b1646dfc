"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Equal word sequences are one text from the start. A text's shingles (five words; shorter texts are one shingle) weigh
their count times 1 + IDF_SHARE * ln(N / df) / ln(N), df being the number of documents that have it: the spread is kept
small, so that edits of much copied texts, rare by nature, don't outweigh what is copied. Texts with equal samples in all rows of a band meet
in a bucket. In each bucket the text that meets most others is compared with those that aren't yet linked to it, and
leaves; in later rounds more at a time, and only where a bucket still holds texts of several classes, until none does. So
all texts that met are compared or linked, and a bucket of n copies of one text costs n comparisons and not n squared.
Pairs whose similarity can't reach the threshold, as too much of a text is in no other, are known without comparing.
Classes are the connected components of the links.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table
from .parts import (
    PART_CHARS, Part, at_buckets, at_parts, join_blobs, make_parts, mix64, pack, pack_sorted, send_keys, split_blobs, sum_keys, unpack, unpack_sorted, word_hashes,
)

WORD = re.compile(r"[^\W_]+")
SHINGLE, THRESHOLD, IDF_SHARE = 5, 0.8, 0.25
BANDS, ROWS = 16, 4  # a pair at the threshold meets in some band with probability 1 - (1 - 0.8**4)**16 > 0.9997
MORE = 4  # in round r, buckets get MORE**r centers: a bucket of n classes takes log n rounds
OFTEN = 1 << 24  # tags from here on: the shingles of a part that more than one document has
DOC_BITS = 20  # of a text's place in its part
KEY_MASK = np.uint64(0xFFFFFFFFFFFF0000)  # shingles are told apart by 48 bits
TABLE = 1 << 16
CHUNK = 1 << 16  # shingles sampled at once: they stay in a core's cache
MET_ROWS = 500_000  # rows of texts in buckets for one task of a round
SLACK = 1e-5  # of similarities: weights are compared in single precision
COMPARED = 64  # texts compared with one copy of a bucket's text


def split_words(text: str) -> list[bytes]:
    # One encoding for all: words hold no line feed.
    return "\n".join(WORD.findall(text.lower())).encode("utf-8", "surrogatepass").split()


def _draws(seed: int = 17) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) draws r and ln c and uniform beta, by 16 bits of a shingle's hash, and the multipliers of the hashes."""
    rng = np.random.default_rng(seed)
    r = rng.gamma(2, 1, TABLE).astype(np.float32)
    ln_c = np.log(rng.gamma(2, 1, TABLE)).astype(np.float32)
    beta = rng.random(TABLE).astype(np.float32)
    multipliers = rng.integers(1 << 62, (1 << 63) - 1, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return r, ln_c, beta, multipliers


_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 48-bit hash for each run of `width` words in a sequence of word hashes."""
    n = len(hashes) - width + 1
    h = np.full(max(n, 0), width, np.uint64)
    for j in range(width):
        h += hashes[j : n + j] * _STEP[j]
    return mix64(h) & KEY_MASK


def shingles(hashes: np.ndarray, runs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text's word hashes, ascending, and their counts. runs: its shingle hashes, if known."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.sort(shingle_hashes(hashes, min(SHINGLE, n)) if runs is None or n < SHINGLE else runs)
    fresh = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[fresh], np.diff(fresh, append=len(h))


def weights(count: np.ndarray, df: np.ndarray, n_docs: int) -> np.ndarray:
    return count * (1 + IDF_SHARE * np.log(n_docs / np.maximum(df, 1)) / np.log(max(n_docs, 2)))


def samples(keys: np.ndarray, weight: np.ndarray, starts: np.ndarray, draws) -> np.ndarray:
    """For each text (its shingles begin at `starts`, none is empty) the hashes of its BANDS bands.

    By ICWS, with r, c and beta of a shingle: t = floor(ln w / r + beta), ln y = r (t - beta), and the sample is the
    (shingle, t) of the least ln a = ln c - ln y - r. Of equals, the lesser shingle.
    """
    r_, ln_c, beta_, multipliers = draws
    inverse, offset = 1 / r_, ln_c - r_ * (1 - beta_)  # ln a = ln c - r (t - beta + 1) = offset - r t
    n = len(starts)
    ends = np.append(starts[1:], len(keys))
    log_w = np.log(weight).astype(np.float32)
    out = np.full((n, BANDS), 0x51ED27, np.uint64) + np.arange(BANDS, dtype=np.uint64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
        a, z = starts[at], ends[to - 1]
        k_, w_, s_ = keys[a:z], log_w[a:z], (starts[at:to] - a)
        text = np.repeat(np.arange(to - at), np.diff(np.append(s_, z - a)))
        for k, m in enumerate(multipliers):
            i = ((k_ * m) >> np.uint64(48)).view(np.int64)
            t = inverse.take(i)
            t *= w_
            t += beta_.take(i)
            np.floor(t, out=t)
            ln_a = r_.take(i)
            ln_a *= t
            np.subtract(offset.take(i), ln_a, out=ln_a)
            least = np.minimum.reduceat(ln_a, s_)
            hit = np.flatnonzero(ln_a == least.take(text))
            if len(hit) > to - at:  # the first of equals
                hit = hit[np.unique(text[hit], return_index=True)[1]]
            band = k // ROWS
            out[at:to, band] = mix64(out[at:to, band] ^ mix64(k_[hit] + t[hit].astype(np.int64).astype(np.uint64)))
        at = to
    return out


class Texts:
    """A part's distinct texts: which documents have them, and their shingles, one text after the other."""

    def __init__(self, part: Part, only: np.ndarray | None = None):
        import xxhash

        tokens = word_hashes(part.words)[part.tokens] if len(part.words) else np.zeros(0, np.uint64)
        runs = shingle_hashes(tokens, SHINGLE) if only is None else None
        digest: dict[bytes, int] = {}
        self.of = np.zeros(len(part.ids), np.int64)
        self.first, self.names, keys, counts = [], [], [], []
        pick = range(len(part.ids)) if only is None else only.tolist()
        for i in pick:
            a, z = part.starts[i], part.ends[i]
            h = tokens[a:z]
            name = xxhash.xxh3_128_digest(h.tobytes())
            k = digest.setdefault(name, len(digest))
            self.of[i] = k
            if k == len(self.names):
                self.names.append(name)
                self.first.append(i)
                s, c = shingles(h, runs[a : z - SHINGLE + 1] if runs is not None else None)
                keys.append(s)
                counts.append(c)
        self.sizes = np.array([len(k) for k in keys], np.int64)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts).astype(np.int32) if keys else np.zeros(0, np.int32)

    def documents(self) -> np.ndarray:
        """Of each text, how many documents of this part have it."""
        return np.bincount(self.of, minlength=len(self.names))


def _frequencies(bucket: int, rows):
    parts, places, keys, (df,) = sum_keys(rows, [np.uint32])
    for part, place in zip(parts, places):
        here = df[place].astype(np.uint32)
        yield part, bucket, join_blobs([pack(here)])
        more = here > 1  # for whoever hasn't all of the part's keys at hand
        yield part, bucket + OFTEN, join_blobs([pack_sorted(keys[place[more]]), pack(here[more])])


def _answers(got: dict[int, bytes], n: int) -> np.ndarray:
    found = [unpack(split_blobs(got[b])[0], np.uint32) for b in range(n) if b in got]
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def _similarity(center: bytes, other: bytes) -> float:
    """Weighted Jaccard of two texts' shingles."""
    (ka, wa), (kb, wb) = ((unpack_sorted(k), unpack(w, np.float32).astype(np.float64)) for k, w in map(split_blobs, (center, other)))
    at = np.searchsorted(ka, kb)
    at[at == len(ka)] = 0
    same = ka[at] == kb
    common = np.minimum(wa[at[same]], wb[same]).sum()
    total = wa.sum() + wb.sum() - common
    return float(common / total) if total > 0 else 1.0


def _compare(batches):
    import pyarrow as pa

    center, blob = None, None
    for batch in batches:
        c, other, payload = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        a, b, s = [], [], []
        for i in range(len(c)):
            if other[i] is None:
                center, blob = c[i], payload[i].as_py()
            else:
                assert c[i] == center
                a.append(c[i])
                b.append(other[i])
                s.append(_similarity(blob, payload[i].as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["center", "other", "similarity"])


def compare(pairs: DataFrame, vectors: DataFrame, n_tasks: int, width: int = 8) -> DataFrame:
    """center, other, similarity. A center's shingles go once to every COMPARED of its others, theirs once each."""
    sizes = pairs.groupBy("center").agg(F.ceil(F.count("*") / COMPARED).cast("int").alias("chunks"))
    dealt = pairs.join(sizes, "center").withColumn("chunk", F.pmod(F.xxhash64("other"), F.col("chunks")).cast("int"))
    dealt = materialise(dealt.select("center", "chunk", "other").coalesce(width), "pairs")
    others = dealt.join(vectors.withColumnRenamed("text", "other"), "other").select("center", "other", "blob", "chunk").coalesce(width)
    centers = dealt.select("center", "chunk").distinct().coalesce(width).join(vectors.withColumnRenamed("text", "center"), "center")
    centers = centers.select("center", F.lit(None).cast("long").alias("other"), "blob", "chunk").coalesce(width)
    both = centers.unionByName(others).repartition(n_tasks, "center", "chunk")
    both = both.sortWithinPartitions("center", "chunk", F.col("other").asc_nulls_first())
    return both.select("center", "other", "blob").mapInArrow(_compare, "center long, other long, similarity double")


def components(edges: DataFrame, width: int = 8) -> DataFrame:
    """node, label: of every node of `edges` (u, v), the least node that it is connected with.

    `width` is the number of tasks that a step's results go to: a number that follows the size of the graph.
    Large-star and small-star steps in turn, until a step changes nothing: rounds grow with the logarithm of a component's
    size, and no component is ever in one place."""
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialise(now.coalesce(width), "cc")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(width)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u")
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v")
        now = materialise(small.coalesce(width).distinct().coalesce(width), "cc")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, chars: int = PART_CHARS) -> DataFrame:
    """row (long), key, class_id for every row of `docs`: documents of one class are linked by similarities of at least
    `threshold`. class_id is the least key of the class, class_row the least row; row numbers the rows.

    Null texts are empty. Texts without words are one class: their word sequences are equal. Null keys are kept, and a
    class of null keys only has a null id. Rows that repeat are of one class. Very long texts are read whole; one that
    exceeds `chars` is a part of its own. Sampling knows shingles by 16 bits of their hash at a time: of ties, which only
    texts of tens of thousands of shingles have, the lesser shingle is the sample. No rows: no result rows. Extra columns
    aren't read.
    """
    if chars // 64 >= 1 << DOC_BITS:
        raise ValueError(f"parts of {chars} characters may hold more than {1 << DOC_BITS} documents")
    parts = make_parts(docs, split_words, key, text, chars)
    n = max(1, parts.count())

    def count(part: Part, got):
        texts = Texts(part)
        distinct, place = np.unique(texts.keys, return_inverse=True)
        df = np.bincount(place, weights=np.repeat(texts.documents(), texts.sizes), minlength=len(distinct)).astype(np.uint32)
        yield from send_keys(part.number, distinct, [df], n)

    n_docs = docs.count()
    answers = at_buckets(at_parts([parts], n, count), n, _frequencies)

    def sign(part: Part, got):
        import pyarrow as pa

        texts = Texts(part)
        df = _answers(got, n)[np.searchsorted(np.unique(texts.keys), texts.keys)]
        weight = weights(texts.counts, df.astype(np.float64), n_docs)
        full = np.flatnonzero(texts.sizes)
        starts = (np.cumsum(texts.sizes) - texts.sizes)[full]
        # A text's least frequency, what its shingles of that frequency weigh, and what all do.
        rarest, own, whole = np.zeros(len(texts.names), np.int64), np.zeros(len(texts.names)), np.zeros(len(texts.names))
        if len(full):
            rarest[full] = np.minimum.reduceat(df, starts)
            own[full] = np.add.reduceat(weight * (df == np.repeat(rarest[full], texts.sizes[full])), starts)
            whole[full] = np.add.reduceat(weight, starts)
        bands = np.zeros((len(texts.names), BANDS), np.uint64)
        if len(full):
            bands[full] = samples(texts.keys, weight, starts, _draws())
        names = np.frombuffer(b"".join(texts.names), np.int64).reshape(-1, 2)
        rows = (part.number << DOC_BITS) + np.arange(len(part.ids))
        yield pa.RecordBatch.from_arrays([
            pa.array(rows), pa.array(part.ids, mask=~part.known), pa.array(names[texts.of, 0]), pa.array(names[texts.of, 1]),
            pa.array([bands[k].view(np.int64).tolist() if texts.sizes[k] and texts.first[k] == i else [] for i, k in enumerate(texts.of)], pa.list_(pa.int64())),
            pa.array(rarest[texts.of]), pa.array(own[texts.of]), pa.array(whole[texts.of]),
        ], ["row", "key", "h1", "h2", "bands", "rarest", "own", "whole"])

    signed = materialise(at_parts([parts, answers.filter(F.col("tag") < OFTEN)], n, sign, "row long, key long, h1 long, h2 long, bands array<long>, rarest long, own double, whole double", raw=True), "signed")
    # One text of each word sequence: that of its least row, the first of its part and so one with bands.
    # Shingles as rare as the text itself are in no other text.
    alone = F.when(F.min("rarest") == F.count("*"), F.min("own")).otherwise(0.0).alias("alone")
    texts = signed.groupBy("h1", "h2").agg(F.min("row").alias("text"), F.min("key").alias("key"), alone, F.min("whole").alias("whole"))
    texts = materialise(texts, "texts")
    # What a text shares with any other is at most `whole - alone`: if that is too little, it meets none.
    weighed = texts.filter((F.col("whole") - F.col("alone")) >= (threshold - SLACK) * F.col("whole")).select(F.col("text").alias("row"), "alone", "whole")
    met = signed.filter(F.size("bands") > 0).select("row", "bands").join(weighed.select("row"), "row", "left_semi")
    met = met.select(F.col("row").alias("text"), F.explode("bands").alias("bucket"))
    shared = met.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialise(met.join(shared, "bucket"), "met")
    # Rounds work on little data many times over: their steps get as many tasks as the texts that met are worth.
    width = max(8, met.count() // MET_ROWS)
    met = materialise(met.coalesce(width), "met")

    wanted = met.select("text").distinct().groupBy(F.shiftright("text", DOC_BITS).alias("part")).agg(
        F.concat_ws(",", F.collect_list((F.col("text").bitwiseAND(F.lit((1 << DOC_BITS) - 1))).cast("string"))).cast("binary").alias("payload")
    )

    def vectors_of(part: Part, got):
        import pyarrow as pa

        if 0 not in got:
            return
        only = np.array(sorted(map(int, got[0].decode().split(","))), np.int64)
        found = Texts(part, only)
        often = [split_blobs(got[b + OFTEN]) for b in range(n) if b + OFTEN in got]
        keys = np.concatenate([unpack_sorted(x[0]) for x in often] + [np.array([2**64 - 1], np.uint64)])
        dfs = np.concatenate([unpack(x[1], np.uint32) for x in often] + [np.array([1], np.uint32)])
        at = np.searchsorted(keys, found.keys)
        df = np.where(keys[at] == found.keys, dfs[at], 1)
        weight = weights(found.counts, df.astype(np.float64), n_docs)
        ends = np.cumsum(found.sizes)
        rows, blobs, held = [], [], 0
        for i in only.tolist():
            k = found.of[i]
            a, z = ends[k] - found.sizes[k], ends[k]
            rows.append((part.number << DOC_BITS) + i)
            blobs.append(join_blobs([pack_sorted(found.keys[a:z]), pack(weight[a:z].astype(np.float32))]))
            held += len(blobs[-1])
            if held > 4_000_000 or i == only[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(blobs, pa.binary())], ["text", "blob"])
                rows, blobs, held = [], [], 0

    asked = wanted.select("part", F.lit(0).cast("int").alias("tag"), "payload")
    vectors = materialise(at_parts([parts, answers.filter(F.col("tag") >= OFTEN), asked], n, vectors_of, "text long, blob binary", raw=True), "vectors")

    label = met.groupBy("text").agg(F.sum("n").alias("places")).withColumn("label", F.col("text"))
    label = label.join(weighed.withColumnRenamed("row", "text"), "text").select("text", "places", "alone", "whole", "label")
    label = materialise(label.coalesce(width), "alone")
    met, tested, r = met.select("text", "bucket"), None, 0
    while True:
        here = met.join(label, "text").coalesce(width)
        if r:
            several = here.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("bucket")
            here = materialise(here.join(several, "bucket", "left_semi").coalesce(width), "open")
            if here.isEmpty():
                break
        best = F.max(F.struct("places", (-F.col("text")).alias("text"))).alias("best")
        if r:
            of = here.groupBy("bucket", "label").agg(F.count("*").alias("n"), best)
            of = of.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("big"), F.sum("n").alias("n"), F.max("best").alias("best"))
            of = of.select("bucket", (-F.col("best.text")).alias("best"), F.col("big.label").alias("big"), (F.col("n") - F.col("big.n")).alias("outside"))
            # Where few are outside the largest class, all of them: nothing is left to compare then.
            share = F.pmod(F.xxhash64(F.lit(r), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
            is_center = (F.col("text") == F.col("best")) | ((F.col("label") != F.col("big")) & ((F.col("outside") <= MORE**r) | (share * F.col("outside") < MORE**r)))
        else:
            of = here.groupBy("bucket").agg(best).select("bucket", (-F.col("best.text")).alias("best"))
            is_center = F.col("text") == F.col("best")
        marked = here.join(of, "bucket").select("bucket", "text", "label", "alone", "whole", is_center.alias("is_center")).coalesce(width)
        if r:
            marked = materialise(marked, "marked")
        centers = marked.filter("is_center").select(
            "bucket", F.col("text").alias("center"), F.col("label").alias("its"), F.col("alone").alias("its_alone"), F.col("whole").alias("its_whole")
        )
        # No pair is more similar than what either shares with others at all lets it be; the rest needn't be compared.
        most = F.least(F.col("whole") - F.col("alone"), F.col("its_whole") - F.col("its_alone"))
        hopeful = most >= (threshold - SLACK) * F.greatest(F.col("whole") + F.col("its_alone"), F.col("its_whole") + F.col("alone"))
        differ = (F.col("label") != F.col("its")) & hopeful
        if r:
            # Two texts that share several buckets make their pair in the least one only, of those where the one is a center.
            of_text = lambda rows, key, name: rows.groupBy(key).agg(F.array_sort(F.collect_set("bucket")).alias(name))
            centers = centers.join(of_text(centers, "center", "its_buckets"), "center")  # BANDS buckets a text at most
            others = here.join(of_text(here, "text", "buckets"), "text")
            differ = differ & (F.array_min(F.array_intersect("buckets", "its_buckets")) == F.col("bucket"))
        else:
            others = here
        pairs = others.join(centers, "bucket").filter(differ).select("center", F.col("text").alias("other")).coalesce(width)
        pairs = pairs.groupBy(F.least("center", "other").alias("a"), F.greatest("center", "other").alias("b")).agg(F.min("center").alias("center"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs.coalesce(width), "pairs")
        met = materialise(marked.filter("not is_center").select("text", "bucket").coalesce(width), "met")
        r += 1
        if pairs.isEmpty():
            continue
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        found = materialise(compare(pairs.select("center", (F.col("a") + F.col("b") - F.col("center")).alias("other")), vectors, n, width), "compared")
        new = found.filter(F.col("similarity") >= threshold).select(F.col("center").alias("u"), F.col("other").alias("v"))
        if new.isEmpty():
            continue
        # Of the new links, only those between classes matter, and only classes are nodes.
        of = lambda end: label.select(F.col("text").alias(end), F.col("label").alias(f"l{end}"))
        between = new.join(of("u"), "u").join(of("v"), "v").select(F.col("lu").alias("u"), F.col("lv").alias("v")).filter("u <> v").coalesce(width)
        joined = components(between, width).select(F.col("node").alias("label"), F.col("label").alias("to"))
        label = label.join(joined, "label", "left").select("text", "places", "alone", "whole", F.coalesce("to", "label").alias("label"))
        label = materialise(label.coalesce(width), "labels")
    classes = texts.join(label.select("text", "label"), "text", "left").select("h1", "h2", "key", "text", F.coalesce("label", "text").alias("label"))
    least = classes.groupBy("label").agg(F.min("key").alias("class_id"), F.min("text").alias("class_row"))
    classes = classes.join(least, "label").select("h1", "h2", "class_id", "class_row")
    return signed.select("row", "key", "h1", "h2").join(classes, ["h1", "h2"]).select("row", "key", "class_id", "class_row")


def op9_weighted_minhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "class_id", (F.col("key") == F.col("class_id")).alias("kept"))


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: of each class the document with the least id stays. Rows are known by a hash of id and text: of those equal
    in both, one stays."""
    mark = F.xxhash64("doc_id", "text")
    ids = docs.select(mark.alias("key"), "doc_id").distinct()
    found = near_duplicates(docs.select(mark.alias("key"), "text"), "key")
    kept = found.join(ids, "key").groupBy("class_row").agg(F.min(F.struct("doc_id", "key")).alias("least")).select(F.col("least.key").alias("__kept"))
    marked = docs.withColumn("__mark", mark)
    return marked.join(kept, marked["__mark"] == kept["__kept"], "left_semi").dropDuplicates(["__mark"]).drop("__mark")
