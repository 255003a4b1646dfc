"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text has a node between any two characters and an edge for each piece that fits. A forward Viterbi pass
gives the best score from the start to every node; those scores are exact estimates for an A-star search that runs
backward from the end, which therefore yields segmentations in order of score, the best first.

No piece of the usual vocabularies holds a space mark after another character. There the lattice is a chain of lattices,
one for each word with the spaces before it: words are searched once each, and the N best segmentations of the text
are those that change the fewest points of score in the fewest words. Otherwise the text is one lattice.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from itertools import chain, compress
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .parts import release

MODEL = os.environ.get("GLEANWORK_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
LITERAL = "\udfff"  # stands for a mark that the text itself has; no valid text holds it
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHE_WORDS, CACHE_PIECES = 400_000, 16_000_000  # about 270 bytes a word, in every worker
LOW = float("-inf")
KEPT_CHARS = 4096  # of a lattice whose edges are kept between the two passes
_ids = itemgetter(2)


class Vocabulary:
    """Pieces and scores of a model file, in which characters without a piece fall back to bytes (or to unk)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.piece = [model.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.unk = model.unk_id()
        usable = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self._build({self.piece[i]: (i, model.get_score(i)) for i in usable})

    def _build(self, pieces: dict[str, tuple[int, float]]) -> None:
        # As unigram models do for unk: below every piece. Files give -1e9 to pieces that their own merges never make
        # (runs of spaces); here those count as much as a fallback, lest a text with one have no comparable score.
        self.fallback = min([s for _, s in pieces.values() if s > -1e8], default=0.0) - 10
        self._raw: list[bytes] | None = None
        pieces = {p: (i, max(s, self.fallback)) for p, (i, s) in pieces.items()}
        #: Of each piece: its length, score and ids.
        self.edge = {p: (len(p), score, (i,)) for p, (i, score) in pieces.items()}
        self.longest = max(map(len, pieces), default=1)
        self.alone = {p for p in pieces if len(p) == 1}
        self.lone: dict[str, tuple[int, float, tuple[int, ...]]] = {}
        self.forth, self.reverse = (self._automaton(turn) for turn in (False, True)) if pieces else (None, None)
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def _automaton(self, turned: bool):
        import ahocorasick

        found = ahocorasick.Automaton()
        for p, edge in self.edge.items():
            found.add_word(p[::-1] if turned else p, edge)
        found.make_automaton()
        return found

    @classmethod
    def of(cls, scores: dict[str, float]) -> Vocabulary:
        """A vocabulary for tests: ids in the order given, 256 bytes after them."""
        self = cls.__new__(cls)
        self.piece = [*scores, *(f"<0x{b:02X}>" for b in range(256)), "<unk>"]
        self.byte = {b: len(scores) + b for b in range(256)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.silent, self.unk = set(), len(self.piece) - 1
        self._build({p: (i, s) for i, (p, s) in enumerate(scores.items())})
        return self

    def fall(self, c: str) -> tuple[int, float, tuple[int, ...]]:
        """The edge of a character that is no piece."""
        found = self.lone.get(c)
        if found is None:
            if len(self.lone) > 100_000:
                self.lone.clear()
            found = self.lone[c] = (1, self.fallback, self.bytes_of(c))
        return found

    def ending(self, s: str):
        """(end - 1, edge) for all edges of the lattice, in order of their ends. A character has an edge of its bytes
        where no piece is it alone."""
        found = self.forth.iter(s) if self.forth else ()
        if self.alone.issuperset(s):
            return found
        return heapq.merge(found, ((j, self.fall(c)) for j, c in enumerate(s) if c not in self.alone), key=itemgetter(0))

    def starting(self, s: str):
        """(end - 1, edge) for all edges, those that start last first."""
        n = len(s) - 1
        found = ((n - j + e[0] - 1, e) for j, e in self.reverse.iter(s[::-1])) if self.reverse else ()
        if self.alone.issuperset(s):
            return found
        return heapq.merge(found, ((j, self.fall(s[j])) for j in range(n, -1, -1) if s[j] not in self.alone), key=lambda x: x[1][0] - x[0])

    def into(self, s: str, node: int) -> list:
        """The edges that end at a node, in order of their ids."""
        edge = self.edge
        found = [e for k in range(max(0, node - self.longest), node) if (e := edge.get(s[k:node])) is not None]
        if s[node - 1] not in self.alone:
            found.append(self.fall(s[node - 1]))
        found.sort(key=_ids)
        return found

    def raw(self) -> list[bytes]:
        """What each id stands for in a text."""
        if self._raw is None:
            v = range(len(self.piece))
            self._raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent else self.piece[i].replace(SPACE, " ").encode() for i in v]
        return self._raw

    def bytes_of(self, c: str) -> tuple[int, ...]:
        c = SPACE if c == LITERAL else " " if c == SPACE else c
        return tuple(self.byte[b] for b in c.encode("utf-8", "surrogatepass")) if self.byte else (self.unk,)


def forward(n: int, edges) -> tuple[list[float], list]:
    """Best score from the start to each of n + 1 nodes, and the edge by which it is reached: of equals, that of the smaller ids."""
    best = [LOW] * (n + 1)
    best[0] = 0.0
    back: list = [None] * (n + 1)
    for j, edge in edges:
        j += 1
        score = best[j - edge[0]] + edge[1]
        if score > best[j] or (score == best[j] and edge[2] < back[j][2]):
            best[j], back[j] = score, edge
    return best, back


def n_best(s: str, vocabulary: Vocabulary, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of a lattice (all, if fewer): score and ids. Of equal scores, the one whose pieces, read
    from the end, have the smaller ids comes first.

    Backward A-star search; the open paths stand in order of their pieces, read from the end, so that the first of the
    best estimates is the next one by either rule. Estimates are exact: every open path has a segmentation of just that score,
    and no two paths share one. So as many open paths are kept as segmentations are missing. Paths are chains
    of places in two arrays, whose length is that of the paths that were followed.
    """
    best, _ = forward(len(s), vocabulary.ending(s))
    parent, taken = array("q"), []
    paths = [(best[-1], len(s), 0.0, -1, None)]
    out: list[tuple[float, tuple[int, ...]]] = []
    while paths and len(out) < n:
        k = max(range(len(paths)), key=lambda i: paths[i][0]) if len(paths) > 1 else 0
        _, node, done, before, edge = paths.pop(k)
        if edge is not None:
            parent.append(before)
            taken.append(edge)
            before = len(taken) - 1
        if node == 0:
            ids: list[int] = []
            while before >= 0:
                ids += taken[before][2]
                before = parent[before]
            out.append((done, tuple(ids)))
            continue
        # Within 1e-9 of the bar, so that sums taken in another order drop nothing.
        bar = min(p[0] for p in paths) - 1e-9 if len(paths) >= n - len(out) else LOW
        more = [(best[node - e[0]] + e[1] + done, node - e[0], done + e[1], before, e) for e in vocabulary.into(s, node)]
        paths[k:k] = [p for p in more if p[0] >= bar]
        if len(paths) > n - len(out):
            keep = sorted(sorted(range(len(paths)), key=lambda i: -paths[i][0])[: n - len(out)])
            paths = [paths[i] for i in keep]
    return out


def best_and_gap(s: str, vocabulary: Vocabulary) -> tuple[float, float, tuple[int, ...]]:
    """Score and ids of the best segmentation, and how far the second best is below it (inf if there is none): any other
    path has an edge off the best path, and the best path through an edge is known from both sides. The edges of a long
    lattice aren't kept, but found again by the automaton of the turned pieces."""
    n = len(s)
    kept = list(vocabulary.ending(s)) if n <= KEPT_CHARS else None
    best, back = forward(n, kept or vocabulary.ending(s))
    on, pieces, node = bytearray(n + 1), [], n
    while node:
        edge = back[node]
        on[node] = 1
        pieces.append(edge[2])
        node -= edge[0]
    behind, other = [LOW] * (n + 1), LOW
    behind[n] = 0.0
    for j, edge in reversed(kept) if kept else vocabulary.starting(s):
        j += 1
        i = j - edge[0]
        through = edge[1] + behind[j]
        if through > behind[i]:
            behind[i] = through
        through += best[i]
        if through > other and not (on[j] and back[j][0] == edge[0]):
            other = through
    return best[n], best[n] - other, tuple(chain.from_iterable(reversed(pieces)))


class _Words:
    """Best segmentations of words: numbers by word, and along them sizes, starts in `flat`, scores, gaps, and whether they
    were met again."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.flat, self.size, self.start, self.score, self.gap = array("i"), array("i"), array("q"), array("d"), array("d")
        self.again = bytearray()

    def add(self, word: str, score: float, gap: float, ids) -> int:
        k = self.at[word] = len(self.at)
        self.start.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        self.score.append(score)
        self.gap.append(gap)
        self.again.append(0)
        return k

    def turn(self) -> None:
        """Keeps the words that a later text had, too, since the last turn: most words are met once. None, if those are many."""
        stay = np.frombuffer(self.again, np.bool_)
        words = list(compress(self.at, stay))
        size, start = np.frombuffer(self.size, np.int32)[stay], np.frombuffer(self.start, np.int64)[stay]
        ends = np.cumsum(size, dtype=np.int64)
        n = int(size.sum(dtype=np.int64))
        if len(words) > CACHE_WORDS // 2 or n > CACHE_PIECES // 2:
            self.__init__()
            return
        flat = np.frombuffer(self.flat, np.int32)[np.repeat(start - ends + size, size) + np.arange(n)]
        score, gap = np.frombuffer(self.score, np.float64)[stay], np.frombuffer(self.gap, np.float64)[stay]
        self.__init__()
        self.at = {w: k for k, w in enumerate(words)}
        self.flat, self.size, self.start = array("i", flat.tobytes()), array("i", size.tobytes()), array("q", (ends - size).tobytes())
        self.score, self.gap, self.again = array("d", score.tobytes()), array("d", gap.tobytes()), bytearray(len(words))


class Encoder:
    """Encodes whole texts; keeps the words that it has met; at CACHE_WORDS of them or CACHE_PIECES pieces, those met again."""

    def __init__(self, path: str = MODEL, n: int = 4, vocabulary: Vocabulary | None = None):
        self.vocabulary = vocabulary or Vocabulary(path)
        self.n = n
        self.known = _Words()
        self.ranked: dict[str, list] = {}
        self.held = 0  # ids in it

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.known.at) >= CACHE_WORDS or len(self.known.flat) >= CACHE_PIECES:
            self.known.turn()
        at = self.known.at
        before = len(at)
        found = list(map(at.get, words))
        if None in found:
            for i, k in enumerate(found):
                if k is None:
                    k = at.get(words[i])
                    found[i] = self.known.add(words[i], *best_and_gap(words[i], self.vocabulary)) if k is None else k
        which = np.array(found, np.int64)
        np.frombuffer(self.known.again, np.uint8)[which[which < before]] = 1
        return which

    def words(self, text: str) -> list[str]:
        """The chain of lattices: a space is put before the text; marks of the text's own are set apart."""
        s = " " + text
        if SPACE in s:
            s = s.replace(SPACE, LITERAL)
        s = s.replace(" ", SPACE)
        return WORD.findall(s) if self.vocabulary.by_word else [s]

    def encode(self, text: str) -> tuple[np.ndarray, list[float], list[list[tuple[int, int, np.ndarray]]]]:
        """Ids of the best segmentation; scores of the n best; and for each of those but the first, what it changes: the
        place and number of pieces replaced, and the ids put there. An empty text: no ids, one score of 0.

        Equal scores: the segmentation whose first change comes earlier, then the one whose change ranks better there.
        """
        if not text:
            return np.zeros(0, np.int32), [0.0], []
        words = self.words(text)
        which = self._numbers(words)
        known = self.known
        sizes = np.frombuffer(known.size, np.int32)[which]
        ends = np.cumsum(sizes, dtype=np.int64)
        places = np.repeat(np.frombuffer(known.start, np.int64)[which] - ends + sizes, sizes) + np.arange(ends[-1])
        ids = np.frombuffer(known.flat, np.int32)[places]
        total = float(np.frombuffer(known.score, np.float64)[which].sum())
        gaps = np.frombuffer(known.gap, np.float64)[which]
        if self.n < 2:
            return ids, [total], []
        # Only changes in the n words that lose least, the earlier of equals, can be among the n best.
        if len(gaps) > 4 * self.n:
            edge = np.partition(gaps, self.n - 1)[self.n - 1]
            near = np.flatnonzero(gaps <= edge)
        else:
            near = np.arange(len(gaps))
        near = near[np.argsort(gaps[near], kind="stable")][: self.n]
        near = sorted(int(k) for k in near if np.isfinite(gaps[k]))
        options = []
        for k in near:
            ranked = self.ranked.get(words[k])
            if ranked is None:
                if len(self.ranked) > 20_000 or self.held > 4_000_000:
                    self.ranked.clear()
                    self.held = 0
                ranked = self.ranked[words[k]] = n_best(words[k], self.vocabulary, self.n)
                self.held += sum(len(ids) for _, ids in ranked)
            options.append([(ranked[0][0] - s, i) for s, i in ranked[1:]])
        # A change is a tuple of (word, rank) in the order of words; each is reached once, from the one without its last.
        heap: list = [(0.0, ())]
        out = []
        while heap and len(out) < self.n:
            lost, change = heapq.heappop(heap)
            out.append((lost, change))
            last = change[-1][0] if change else -1
            for at in range(last + 1, len(near)):
                for rank, (loss, _) in enumerate(options[at]):
                    heapq.heappush(heap, (lost + loss, (*change, (at, rank))))
        edits = []
        for _, change in out[1:]:
            edit = []
            for at, rank in change:
                k = near[at]
                edit.append((int(ends[k] - sizes[k]), int(sizes[k]), np.array(options[at][rank][1], np.int32)))
            edits.append(edit)
        return ids, [total - lost for lost, _ in out], edits

    def decode(self, ids) -> str:
        """The text of ids: exactly what was encoded."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        text = b"".join(map(self.vocabulary.raw().__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def apply_edits(ids: np.ndarray, edit) -> np.ndarray:
    """Ids of another of the n best."""
    parts, at = [], 0
    for start, gone, new in edit:
        parts += [ids[at:start], np.asarray(new, np.int32)]
        at = start + gone
    return np.concatenate([*parts, ids[at:]])


PIECES = "ids array<int>, scores array<double>, edits array<array<struct<at:int,gone:int,ids:array<int>>>>"
DECODED = "decoded_crc32 long, lossless boolean"
_encoders: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, n: int) -> Encoder:
    """Kept by the worker's process from one task to the next."""
    key = (path, n)
    if key not in _encoders:
        _encoders[key] = Encoder(path, n)
    return _encoders[key]


def _encode(path: str, n: int, decode: bool):
    def run(batches):
        import pyarrow as pa

        encoder = encoder_of(path, n)
        kind = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("gone", pa.int32()), ("ids", pa.list_(pa.int32()))])))

        def batch_of(rows, ids, scores, edits, crc, same):
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            edited = [[[{"at": a, "gone": g, "ids": x.tolist()} for a, g, x in e] for e in one] for one in edits]
            more = [pa.array(crc, pa.int64()), pa.array(same, pa.bool_())] if decode else []
            return pa.RecordBatch.from_arrays(
                [rows, pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(scores, pa.list_(pa.float64())), pa.array(edited, kind), *more],
                ["row", "ids", "scores", "edits", "decoded_crc32", "lossless"][: 4 + len(more)],
            )

        for batch in batches:
            rows, texts, start, held, got = batch.column(0), batch.column(1), 0, 0, tuple([] for _ in range(5))
            for k in range(len(texts)):
                text = texts[k].as_py() or ""
                for out, x in zip(got, encoder.encode(text)):
                    out.append(x)
                if decode:
                    back = encoder.decode(got[0][-1])
                    got[3].append(zlib.crc32(back.encode("utf-8", "surrogatepass")))
                    got[4].append(back == text)
                held += len(text)
                if held > 2_000_000:
                    yield batch_of(rows.slice(start, k + 1 - start), *got)
                    start, held, got = k + 1, 0, tuple([] for _ in range(5))
            if got[0]:
                yield batch_of(rows.slice(start), *got)
            batch = rows = texts = got = None
            release()

    return run


def _decode(path: str):
    def run(batches):
        import pyarrow as pa

        encoder = encoder_of(path, 1)
        for batch in batches:
            ids, edits = batch.column(1), batch.column(2)
            for k in range(len(ids)):  # a row at a time: texts of any length
                best = ids[k].as_py()
                if best is None:
                    texts = None
                else:
                    first = np.array([-1 if i is None else i for i in best], np.int32)
                    every = [first, *(apply_edits(first, [(e["at"], e["gone"], e["ids"]) for e in one]) for one in edits[k].as_py() or [])]
                    texts = [encoder.decode(x) for x in every]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([texts], pa.list_(pa.string()))], ["row", "texts"])

    return run


def decode_pieces(encoded: DataFrame, path: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `encoded` (all but ids, scores and edits) as struct `row`, with texts: what ids stand for,
    then what each of the others of the n best (by edits) stands for; all are the text that was encoded.

    Null ids: null. No ids: an empty text. Null edits: none. An id outside of the vocabulary is an error. Repeated rows: each gets
    its own. No rows: no result rows. Columns of any name pass through in `row`.
    """
    names = keep or [c for c in encoded.columns if c not in ("ids", "scores", "edits")]
    plain = encoded.select(F.struct(*[encoded[c] for c in names]).alias("row"), encoded["ids"].alias("ids"), encoded["edits"].alias("edits"))
    return plain.mapInArrow(_decode(path), plain.select("row").schema.add(_fields("texts array<string>")[0]))


def encode_pieces(docs: DataFrame, path: str = MODEL, n: int = 4, keep: list[str] | None = None, decode: bool = False) -> DataFrame:
    """The columns `keep` of `docs` (all) as struct `row`, with ids (the best segmentation of the whole text), scores (of
    the n best) and edits (what each of the others changes). decode: with the CRC-32 of the text that decoding the ids
    gives, as UTF-8, and whether it is the one that was encoded.

    Null and empty texts: no ids, a score of 0, no others. Ties as Encoder.encode says. Equal texts: equal results.
    Repeated rows: each gets its own. No rows: no result rows. Columns of any name pass through in `row`. A very long
    text is searched word by word; a word of any length takes time and memory in proportion (about 300 bytes a character). `path` is a parameter; the file must
    be on every executor.
    """
    plain = docs.select(F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = plain.select("row").schema
    for field in _fields(f"{PIECES}, {DECODED}" if decode else PIECES):
        schema = schema.add(field)
    return plain.mapInArrow(_encode(path, n, decode), schema)


def _fields(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fields


def op10_piece_nbest(spark, sf_dir):
    found = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], decode=True)
    return found.select(F.col("row.doc_id").alias("doc_id"), F.size("ids").alias("n_pieces"), "ids", "scores", "edits", "decoded_crc32", "lossless")


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage, the last: the documents' columns (without texts) and their pieces."""
    keep = [c for c in docs.columns if c != "text"]
    found = encode_pieces(docs, keep=keep)
    return found.select("row.*", F.size("ids").alias("n_pieces"), "ids", "scores", "edits")
