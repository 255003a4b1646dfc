"""The operators' functions against plain versions."""

import collections
import math
import random
import re

import numpy as np
import pytest

from gleanwork.llm import audio, hpylm, html, neardup, parts, pieces, shards, toxicity, vafile

# ---- 1 ----


def test_wav_round_trip_and_features():
    payload = bytes(range(256)) * 10
    assert audio.decode_wav(audio.encode_wav(payload)) == (audio.RATE, payload)
    a, b = audio.features(payload), audio.features(payload)
    assert (a[0] == b[0]).all() and a[1] == b[1] and a[0].shape[1:] == (audio.SPAN_FRAMES, audio.MELS)
    back = audio.tensor_array(audio.tensor_bytes(a[0]))
    assert back.type.shape == [audio.SPAN_FRAMES, audio.MELS] and (back.to_numpy_ndarray() == a[0]).all()
    for even in (b"", b"\0" * 64, b"a" * 64):
        tensors, spans = audio.features(even)
        assert len(spans) == len(tensors) == 1 and spans[0][2] == 1


def test_log_mel_against_a_plain_transform():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.3, audio.WINDOW + 3 * audio.HOP).astype(np.float32)
    got = audio.log_mel(x)
    n = np.arange(audio.FFT)
    for k in range(4):
        w = np.zeros(audio.FFT)
        w[: audio.WINDOW] = x[k * audio.HOP : k * audio.HOP + audio.WINDOW] * np.hanning(audio.WINDOW)
        power = [abs((w * np.exp(-2j * np.pi * f * n / audio.FFT)).sum()) ** 2 for f in range(audio.FFT // 2 + 1)]
        assert np.allclose(got[k], np.log(np.array(power) @ audio._mel_bank() + 1e-6), atol=1e-3)
    with pytest.raises(ValueError):
        audio.decode_wav(b"RIFFxxxxWAVE")


@pytest.mark.parametrize("up, down", [(1, 2), (2, 1), (3, 2), (2, 3)])
def test_polyphase_against_direct_convolution(up, down):
    x = np.random.default_rng(1).normal(size=301).astype(np.float32)
    h = audio._lowpass(up, down)
    full = np.zeros(len(x) * up)
    full[::up] = x
    direct = np.convolve(full, h)[len(h) // 2 :: down]
    y = audio.resample(x, up, down)
    assert np.allclose(y, direct[: len(y)], atol=1e-4)


def test_hysteresis_by_hand():
    assert audio.hysteresis(np.array([0, 0.1, 0, -0.1, 0.1, 0.1]), 0.05, -0.05) == [(1, 3), (4, 6)]
    assert audio.hysteresis(np.zeros(3), 0.05, -0.05) == []


# ---- 3 ----


def test_article_alone_is_left():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>menu</a></ul></nav>'
        '<div class="ad">buy</div><div class="cookie-notice">cookies</div><article><h1>Head &amp; more</h1><p><b>one<br><p>two  \n words&nbsp;x</p><form>mail</form>'
        '<aside>side</aside><section id="comments"><p>reader</p></section></article><footer>&copy; f</footer></body>'
    )
    assert html.extract(page, None) == "Head & more\none\ntwo words x"
    assert html.extract("", None) == "" and html.extract("plain text", None) == "plain text" and html.extract("<p>a<p>b", None) == "a\nb"
    assert html.extract("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", None) == "a\nb\nc\nd"
    assert html.extract("<p>" * 3000 + "<div>" * 3000 + "deep", None) == "deep"


def test_article_text_that_looks_like_other_things_stays():
    page = (
        '<main><p>lede</p><article><div class="post-header"><h1 title="the hidden cost">Head</h1></div><h2 id="legal-history">law</h2>'
        '<section id="social-effects"><p>effects</p></section><p hidden>gone</p><div class="comments">reader</div></article><p>later</p></main>'
    )
    assert html.extract(page, None) == "lede\nHead\nlaw\neffects\nlater"
    assert html.extract("<body><form><input><main><p>text</p><form>mail</form></main></form></body>", None).startswith("text")


def test_broken_pages_take_time_in_proportion():
    import time

    start = time.perf_counter()
    cut = "<p>kept</p><a " + " ".join(f'a{k}="v{k}"' for k in range(10_000)) + ' x="'
    assert html.extract(cut, None) == "kept"
    for p in ("<a ", '<a b="', "<a b='x", "<div>", "<li>", "<!--", "<![CDATA[", "</div", "<p><b>", '<div class="footer">', "<form>"):
        html.extract(p * 20_000, None)
    html.extract("<span>" * 20_000 + "</p></div>" * 20_000, None)
    assert time.perf_counter() - start < 20
    assert html.extract("<p title='a > b' x=\"it's\">one <b don't>two</b> a < b", None) == "one two a < b"
    assert html.extract('<p>a<i class="x>b</i>c</p><p>d', None) == "abc\nd"


def test_templates_go():
    root = html.parse("<body><div><p>shared line</p></div><div><p>own</p></div></body>")
    hashes = html.subtree_hashes(root)
    shared = html.subtree_hashes(html.parse("<body><div><p>shared line</p></div></body>"))
    assert set(shared) <= set(hashes)
    assert html.extract("<body><div><p>shared line</p></div><div><p>own</p></div></body>", shared) == "own"


def test_boxes_of_articles_go_by_count_and_quoted_passages_stay():
    pages = [f"<article><h1>t{k}</h1>{'<p>x</p>' * k}<p>own {k}</p><blockquote>quoted</blockquote><div>read our letter</div></article>" for k in range(6)]
    counts = collections.Counter(h for p in pages for h in set(html.subtree_hashes(html.parse(p))))
    templates = [h for h, n in counts.items() if n >= 5]
    for k, p in enumerate(pages):
        assert html.extract(p, templates).split("\n") == [f"t{k}", *["x"] * k, f"own {k}", "quoted"]


# ---- 4 ----


def test_classifier_learns_a_planted_word():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [[word() for _ in range(rng.randint(1, 60))] for _ in range(400)]
    labels = np.array([k % 4 == 0 for k in range(400)], np.float32)
    for t, y in zip(texts, labels):
        if y:
            t.insert(rng.randrange(len(t) + 1), "vexing" + word())
    v = toxicity.Vocabulary()
    x = [v.buckets(t) for t in texts]
    m = toxicity.Model()
    m.fit(x[:300], labels[:300], passes=4000)
    m.calibrate(x[:300], ["en"] * 300, labels[:300])
    found = np.array([m.score(b, "en") >= 0.5 for b in x[300:]])
    assert (found == (labels[300:] == 1)).mean() > 0.95
    long = v.buckets([w for t in texts for w in t])
    assert np.allclose(m.pooled(np.concatenate([long] * 3)), m.pooled(long))
    assert 0 <= m.score(v.buckets([]), "other") <= 1


def test_convolution_and_pooling_against_loops():
    m, v = toxicity.Model(seed=2), toxicity.Vocabulary()
    words = [f"w{k % 7}" for k in range(40)]
    x = m.E[v.buckets(words)].sum(axis=1)
    x = np.concatenate([x, np.zeros((2, toxicity.DIM), np.float32)])
    want = []
    for w, W, c in zip(toxicity.WIDTHS, m.W, m.c):
        for f in range(toxicity.FILTERS):
            want.append(max(max(0.0, c[f] + sum(float(x[i + j] @ W[j][:, f]) for j in range(w))) for i in range(len(words))))
    assert np.allclose(m.pooled(v.buckets(words)), want, atol=1e-4)


def test_language_guess():
    assert toxicity.guess_language("the cat and of".split()) == "en" and toxicity.guess_language([]) == "other"


# ---- 5 ----


def test_split_words_like_the_contract():
    text = "Ab\x0bC\x1cD é\xa0É\tİ\r\n"
    want = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    assert [w.decode() for w in hpylm.split_words(text)] == want


def stirling_logs(n, d):
    """Logarithms of S(n, t), t = 0 to n, by the recurrence."""
    row = np.array([-np.inf, 0.0])
    for k in range(1, n):
        with np.errstate(divide="ignore"):
            stay = row + np.log(np.maximum(k - d * np.arange(k + 1), 0))
        row = np.logaddexp(np.concatenate([[-np.inf], row]), np.concatenate([stay, [-np.inf]]))
    return row


def test_stirling_ratios():
    for d in (0.5, 0.8):
        s = hpylm.stirling(d)
        for n in (2, 7, 100, 1024):
            t = np.arange(1, n)
            assert np.allclose(s.rows[n, 1:n], np.exp(np.diff(stirling_logs(n, d)[1:])), rtol=1e-9)
        n = 6000
        t = np.arange(1, n)
        want = np.diff(stirling_logs(n, d)[1:])
        got = np.log(s(np.full(n - 1, n), t))
        assert np.abs(got - want)[: n - 20].max() < 0.015 and s(np.array([n]), np.array([n]))[0] == 0


def test_tables_follow_their_exact_law():
    """Against enumeration: customers few and many, dishes rare and frequent in the parent."""
    m = 20_000
    for n, c, p, d in [(2, 1.0, 0.3, 0.6), (3, 5.0, 0.3, 0.8), (24, 30.0, 0.5, 0.8), (40, 3.0, 0.01, 0.8), (300, 400.0, 0.2, 0.75), (1500, 30.0, 0.05, 0.8), (3000, 9000.0, 0.3, 0.8)]:
        t = np.arange(1, n + 1)
        w = stirling_logs(n, d)[1:] + np.cumsum(np.log(np.concatenate([[1.0], (c + d * t[:-1]) * p])))
        w = np.exp(w - w.max())
        mean = (w * t).sum() / w.sum()
        spread = math.sqrt((w * (t - mean) ** 2).sum() / w.sum())
        law = hpylm.Law(np.full(m, n), d)
        got = law.draw(np.full(m, c), np.full(m, p), hpylm.uniform(np.arange(m, dtype=np.uint64), 3))
        assert got.min() >= 1 and got.max() <= n
        assert abs(got.mean() - mean) < 5 * spread / math.sqrt(m) + 0.01 * mean and abs(got.std() - spread) < 0.05 * spread + 0.01
        assert abs(hpylm.Law(np.array([n]), d).mean(np.array([c]), np.array([p]))[0] - mean) < 0.01 * mean


def test_gibbs_over_dishes_against_enumeration():
    """One restaurant with two words: the stationary law of both numbers of tables is known."""
    d, theta, p, n = 0.6, 1.0, (0.3, 0.1), (3, 4)
    s = [np.exp(stirling_logs(k, d)) for k in n]
    joint = {(a, b): p[0] ** a * p[1] ** b * s[0][a] * s[1][b] * np.prod([theta + d * k for k in range(a + b)]) for a in range(1, 4) for b in range(1, 5)}
    total = sum(joint.values())
    m = 30_000
    room = np.repeat(np.arange(m), 2)
    seats = hpylm.Seating(np.tile(n, m), room, m, np.tile(p, m), np.ones(m), np.arange(2 * m, dtype=np.uint64), d, theta)
    sums = np.zeros(2)
    for k in range(30):
        seats.sweep(k)
        sums += seats.tables.reshape(-1, 2).mean(axis=0) / 20 if k >= 10 else 0
    want = [sum(x[i] * w for x, w in joint.items()) / total for i in (0, 1)]
    assert np.allclose(sums, want, rtol=0.04)


def test_seating_bounds_and_predictions_sum_to_one():
    rng = np.random.default_rng(0)
    v = 400
    count = np.concatenate([rng.integers(0, 30, 2 * v), rng.integers(0, 9, v)])
    count[[3, v + 5]] = 5000, 200_000
    room = np.repeat([0, 1, 2], v)
    customers = rng.integers(0, 60, v)
    bins = hpylm.histogram(customers)
    whole = hpylm.tables_of_words(*bins, 1 / (v + 1))
    tables = hpylm.word_tables(customers, whole, float(v)) / hpylm.WHOLE
    assert abs(tables.sum() - whole) < 0.01 * whole + 1 and (tables <= customers).all() and (tables[customers > 0] >= 1).all()
    unigram = hpylm.predictive(customers, tables, tables.sum(), customers.sum(), 1 / (v + 1), hpylm.WORD_DISCOUNT)
    unknown = hpylm.predictive(0, 0, tables.sum(), customers.sum(), 1 / (v + 1), hpylm.WORD_DISCOUNT)
    assert abs(unigram.sum() + unknown - 1) < 1e-9
    seats = hpylm.Seating(count, room, 3, np.tile(unigram, 3), np.ones(3), np.arange(3 * v, dtype=np.uint64), hpylm.DISCOUNT)
    dish, rooms, last = seats.run()
    assert (last <= count).all() and (last[count > 0] >= 1).all() and (last[count == 0] == 0).all()
    for r in range(3):
        of = room == r
        p = hpylm.predictive(count[of], dish[of] / hpylm.KEPT, rooms[r] / hpylm.KEPT, count[of].sum(), unigram, hpylm.DISCOUNT)
        rest = hpylm.predictive(0, 0, rooms[r] / hpylm.KEPT, count[of].sum(), unknown, hpylm.DISCOUNT)
        assert (p > 0).all() and abs(p.sum() + rest - 1) < 1e-9


# ---- 6 ----


def test_search_against_all_products():
    rng = np.random.default_rng(5)
    v = rng.integers(-900, 900, (700, 12))
    v[100:400] = v[0]  # ties
    ids = rng.permutation(700).astype(np.int64)
    f = v.astype(np.float64)
    edges = vafile.grid(f)
    c = vafile.cells(f, edges)
    at = np.arange(12)
    assert (edges[c, at] <= f).all() and (f <= edges[c + 1, at]).all()
    pick = [0, 150, 500, 699]
    for k in (1, 10, 1000):
        got = vafile.search_block(ids, f, c, edges, ids[pick], f[pick], k)
        for (q, i, s), row in zip(got, pick):
            want = sorted(((-int(v[row] @ v[j]), int(ids[j])) for j in range(700) if ids[j] != ids[row]))[:k]
            assert [(-x, y) for x, y in zip(s.tolist(), i.tolist())] == want and set(q.tolist()) == {int(ids[row])}


# ---- 7 ----


def test_hypergeometric_law():
    rng = np.random.default_rng(2)
    good, bad, n = 7, 13, 6
    got = np.bincount([shards.hypergeometric(rng, good, bad, n) for _ in range(20_000)], minlength=7) / 20_000
    want = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(20, n) for k in range(7)]
    assert np.abs(got - want).max() < 0.015
    assert shards.hypergeometric(rng, 0, 5, 3) == 0 and shards.hypergeometric(rng, 5, 0, 3) == 3
    big = [shards.hypergeometric(rng, 10**11, 10**11, 10**6) for _ in range(200)]
    assert abs(np.mean(big) - 5e5) < 200


def test_matrix_margins():
    m = np.array(shards.communication_matrix([5, 0, 12, 3], [7, 7, 6], 1))
    assert m.sum(axis=1).tolist() == [5, 0, 12, 3] and m.sum(axis=0).tolist() == [7, 7, 6] and (m >= 0).all()


# ---- 9 ----


def test_shingles_and_their_counts():
    words = b"a b c d e f a b c d e".split()
    keys, count = neardup.shingles(parts.word_hashes(words))
    want = collections.Counter(tuple(words[i : i + 5]) for i in range(7))
    assert sorted(count.tolist()) == sorted(want.values()) and (np.diff(keys.astype(object)) > 0).all()
    assert len(neardup.shingles(parts.word_hashes([b"a", b"b"]))[0]) == 1 and len(neardup.shingles(np.zeros(0, np.uint64))[0]) == 0


def test_samples_collide_as_weighted_jaccard():
    rng = np.random.default_rng(8)
    keys = np.sort(rng.integers(1 << 20, 1 << 63, 400, dtype=np.uint64) & neardup.KEY_MASK)
    w = rng.uniform(1, 2, 400)
    draws = neardup._draws()
    hits, sims = [], []
    for cut in (20, 60, 100):
        a, b = keys[cut:], keys[:-cut]
        wa, wb = w[cut:], w[:-cut]
        common = w[cut:-cut].sum()
        sims.append(common / (wa.sum() + wb.sum() - common))
        both = neardup.samples(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, len(a)]), draws)
        hits.append((both[0] == both[1]).mean())
    assert all(abs(h - s**neardup.ROWS) < 0.3 for h, s in zip(hits, sims)) and hits[0] > hits[2]


# ---- 10 ----

V = pieces.Vocabulary.of({"▁": -3, "a": -1, "b": -2, "ab": -2, "▁a": -2, "ba": -3, "aba": -4, "▁ab": -5, "bb": -1})


def all_scores(s):
    into = lambda j: [(i, V.edge[s[i:j]][1]) for i in range(j) if s[i:j] in V.edge] + [(j - 1, V.fallback)] * (s[j - 1] not in V.alone)

    def rec(j):
        return [0.0] if j == 0 else [x + sc for i, sc in into(j) for x in rec(i)]

    return sorted(rec(len(s)), reverse=True)


def test_n_best_against_enumeration_and_round_trip():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("ab x▁é\n") for _ in range(rng.randint(0, 9)))
        e = pieces.Encoder(n=5, vocabulary=V)
        ids, scores, edits = e.encode(t)
        assert scores == (all_scores("".join(e.words(t)))[:5] if t else [0.0])
        every = [ids, *(pieces.apply_edits(ids, x) for x in edits)]
        assert all(e.decode(x) == t for x in every) and len({x.tobytes() for x in every}) == len(scores)


def test_words_search_is_a_star_over_the_lattice():
    for s in ("▁abab", "▁", "bbab", "▁aé"):
        want = all_scores(s)
        assert [x for x, _ in pieces.n_best(s, V, 99)] == want
        best, gap, ids = pieces.best_and_gap(s, V)
        assert best == want[0] and ids == pieces.n_best(s, V, 1)[0][1] and (gap == want[0] - want[1] if len(want) > 1 else gap == math.inf)


def test_public_model_round_trip():
    e = pieces.Encoder()
    for t in ["Hello  world\n\tñ Δ▁x ﬁ 東京 \U0001f600", " leading", "", "x" * 500, "   "]:
        assert e.decode(e.encode(t)[0]) == t


def test_long_words_take_memory_and_time_in_proportion(monkeypatch):
    import tracemalloc

    rng = random.Random(5)
    for t in ("".join(rng.choice("abé") for _ in range(60)) for _ in range(20)):
        kept = pieces.best_and_gap(t, V)
        with monkeypatch.context() as m:
            m.setattr(pieces, "KEPT_CHARS", 0)
            assert pieces.best_and_gap(t, V) == kept
        ranked = pieces.n_best(t, V, 3)
        assert ranked[0] == (kept[0], kept[2]) and ranked[1][0] == kept[0] - kept[1]
    e = pieces.Encoder()
    words = ["=" * 50_000, "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(50_000))]
    tracemalloc.start()
    for t in words:
        ids, scores, edits = e.encode(t)
        assert len(scores) == 4 and all(e.decode(pieces.apply_edits(ids, x)) == t for x in edits) and e.decode(ids) == t
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()


def test_one_lattice_where_pieces_cross_words():
    v = pieces.Vocabulary.of({"▁": -1, "a": -1, "a▁a": -0.5})
    assert not v.by_word
    e = pieces.Encoder(n=3, vocabulary=v)
    assert e.encode("a a")[1] == [-1.5, -4.0] and e.decode(e.encode("a a")[0]) == "a a"


def test_words_met_again_stay_when_the_cache_is_full(monkeypatch):
    v = pieces.Vocabulary.of({"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -3.5, "▁ab": -4.0, "ba": -4.0})
    monkeypatch.setattr(pieces, "CACHE_WORDS", 40)
    e, rng = pieces.Encoder(n=3, vocabulary=v), random.Random(3)
    for k in range(200):
        text = " ".join(["ab", "aab", *("".join(rng.choices("ab", k=12)) for _ in range(5))])
        ids, scores, edits = e.encode(text)
        plain = pieces.Encoder(n=3, vocabulary=v).encode(text)
        assert (ids == plain[0]).all() and scores == plain[1] and len(edits) == len(plain[2])
        assert e.decode(ids) == text and len(e.known.at) < 40 + 7
        assert k == 0 or {"▁ab", "▁aab"} <= set(e.known.at)
        assert list(e.known.at.values()) == list(range(len(e.known.score)))


def test_words_kept_take_a_bounded_part_of_a_worker(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(pieces, "best_and_gap", lambda word, v: (-1.0, 1.0, tuple(range(5))))
    monkeypatch.setattr(pieces, "n_best", lambda word, v, n: [(-1.0, tuple(range(5)))])
    e = pieces.Encoder(vocabulary=pieces.Vocabulary.of({"a": -1.0}))
    tracemalloc.start()
    try:
        for k in range(120):
            e.encode(" ".join(f"word{i}" for i in range(k * 10_000, (k + 1) * 10_000)))
        assert tracemalloc.get_traced_memory()[1] < 150e6
    finally:
        tracemalloc.stop()


def test_the_scorer_reads_texts_in_their_rows():
    import pyarrow as pa

    model = toxicity.Model()

    class Shared:
        value = model

    texts = ["the cat sat", None, "", "der Hund und die Katze"]
    row = pa.StructArray.from_arrays([pa.array(range(4)), pa.array(texts)], ["doc_id", "text"])
    (out,) = toxicity.scorer(Shared, 1)(iter([pa.RecordBatch.from_arrays([row], ["row"])]))
    words = [toxicity.WORD.findall((t or "").lower()) for t in texts]
    assert out.column(1).to_pylist() == [model.score(toxicity.Vocabulary().buckets(w), toxicity.guess_language(w)) for w in words]
    assert out.column(0).equals(row)


# ---- parts ----


def test_packing():
    rng = np.random.default_rng(0)
    k = np.unique(rng.integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    assert (parts.unpack_sorted(parts.pack_sorted(k)) == k).all() and len(parts.unpack(parts.pack(np.zeros(0, np.int32)), np.int32)) == 0
    assert parts.split_blobs(parts.join_blobs([b"a", b"", b"ccc"])) == [b"a", b"", b"ccc"]
    sent = list(parts.send_keys(7, k, [np.ones(len(k), np.uint32)], 5))
    assert sum(len(parts.unpack_sorted(parts.split_blobs(p)[0])) for _, _, p in sent) == len(k) and [b for _, b, _ in sent] == list(range(5))
