"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A word's candidate merges stand on an agenda by score, then by place; each may be skipped, as a
keyed hash of the seed, the document, the word's place in it and the candidate's borders decides. A
skipped candidate never comes back, but its characters can still join in other merges. With no
dropout the ids are the library's.

Every occurrence of a word goes through an agenda of its own. Words of equal length go in lockstep,
one merge each at a time, as array operations: a row of arrays holds what all words have at one
place, and a merge moves what follows it up by one row. Longer words go through agendas one by one,
in parts between characters that no piece of the vocabulary has side by side.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shingles import mix
from tidemark.llm.token_ids import spans_of
from tidemark.llm.workspace import short_batches, slices

_U = np.uint64
SPACE = "▁"
#: Symbols of the longest word that goes through in lockstep with others, and words that do at once.
LOCKSTEP, ROWS = 64, 8192
DROPOUT, SEED = 0.1, 1
#: No candidate.
NONE = 1 << 30
#: What a candidate's borders are multiplied by in its hash.
AT, MIDDLE, END = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_MASK = (1 << 64) - 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def hashed(salt, at, middle, end) -> np.ndarray:
    """The hash that decides on candidates by their borders within the word, whatever its length."""
    at, middle, end = (np.asarray(x).astype(_U) for x in (at, middle, end))
    return mix(salt + at * _U(AT) + middle * _U(MIDDLE) + end * _U(END))


def _mix(x: int) -> int:
    """``mix`` of one number."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


class Pairs:
    """Values of pairs of symbols, in a table of open addresses."""

    def __init__(self, joins: dict[int, int]):
        self.bits = max(4, (4 * len(joins)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slots = self._slots(np.array(list(joins), np.int64)).tolist() if joins else []
        for (key, value), slot in zip(joins.items(), slots):
            while self.keys[slot] >= 0:
                slot = slot + 1 & self.mask
            self.keys[slot], self.values[slot] = key, value

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(_U) * _U(AT)) >> _U(64 - self.bits)).view(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair, or -1. Negative symbols are in none."""
        keys = left.astype(np.int64) << 32 | right
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], np.int32(-1))
        places = np.flatnonzero((found != keys) & (found >= 0))  # another pair is there: look on
        slots, keys = slots[places], keys[places]
        while len(places):
            slots = (slots + 1) & self.mask
            found = self.keys[slots]
            hit = found == keys
            out[places[hit]] = self.values[slots[hit]]
            on = ~hit & (found >= 0)
            places, slots, keys = places[on], slots[on], keys[on]
        return out


class Segmenter:
    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ids = {self.pieces[i]: i for i in plain}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.chars = {p: i for p, i in ids.items() if len(p) == 1}
        self.scores = np.array([sp.get_score(i) for i in range(n)])
        # pieces by falling score, equal ones alike
        self.rank = np.unique(-self.scores, return_inverse=True)[1].astype(np.int32)
        self.ranks = self.rank.tolist()
        self.joins = {ids[a] << 32 | ids[b]: i for i in plain for k in range(1, len(self.pieces[i])) if (a := self.pieces[i][:k]) in ids and (b := self.pieces[i][k:]) in ids}
        self.lookup = Pairs(self.joins)
        self.pairs = {p[k : k + 2] for i in plain for p in (self.pieces[i],) for k in range(len(p) - 1)}
        # the symbol of each character; one without piece is a negative number of its own
        self.symbols = -2 - np.arange(0x110000, dtype=np.int32)
        self.symbols[[ord(c) for c in self.chars]] = list(self.chars.values())
        self.width = np.dtype(f"<u{2 if n <= 1 << 16 else 4}")
        self.skip_below = _U(min(int(dropout * 2**64), 2**64 - 1)) if dropout > 0 else None
        self.key = _U(int.from_bytes(hashlib.blake2b(f"{seed}".encode(), digest_size=8).digest(), "little"))
        self.mark = [self.byte_ids[b] for b in SPACE.encode()]
        # text of each id for decoding; byte pieces are told apart
        self.texts = [p.replace(SPACE, " ") for p in self.pieces]
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}

    def salts(self, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """What keys the skips of words: their documents' keys and places."""
        return mix(mix(keys.astype(_U) + self.key) + places.astype(_U))

    def _candidates(self, left, right, salt, at, middle, end) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that pairs make and their ranks; NONE for a pair that makes none or is skipped."""
        made = self.lookup.get(left, right)
        ranks = self.rank[made]  # any rank where made is -1
        gone = made < 0
        if self.skip_below is not None:
            gone |= hashed(salt, at, middle, end) < self.skip_below
        ranks[gone] = NONE
        return made, ranks

    def _lockstep(self, codes: np.ndarray, salt: np.ndarray, put) -> None:
        """Merge words of equal length, one in each column of ``codes``, and ``put`` (columns, symbols)
        of those that are done."""
        m, n = codes.shape
        columns = np.arange(n)
        symbols = codes
        start = np.repeat(np.arange(m + 1, dtype=np.int16)[:, None], n, axis=1)
        made, ranks = np.empty((max(m - 1, 0), n), np.int32), np.empty((max(m - 1, 0), n), np.int32)
        for j in range(m - 1):
            made[j], ranks[j] = self._candidates(symbols[j], symbols[j + 1], salt, start[j], start[j + 1], start[j + 2])
        while m > 1 and n:
            # the first of the best
            best, at = ranks[0].copy(), np.zeros(n, np.int64)
            for j in range(1, m - 1):
                at[ranks[j] < best] = j
                np.minimum(best, ranks[j], out=best)
            alive = best < NONE
            if not alive.all():
                put(columns[~alive], symbols[:, ~alive])
                columns, salt, at = columns[alive], salt[alive], at[alive]
                symbols, start, made, ranks = (x[:, alive] for x in (symbols, start, made, ranks))
                n = len(columns)
                if not n:
                    return
            here = np.arange(n)
            piece = made[at, here]
            m -= 1
            later = np.arange(m)[:, None] > at
            symbols = np.where(later, symbols[1:], symbols[:-1])
            symbols[at, here] = piece
            start = np.concatenate([np.where(later, start[1:-1], start[:-2]), start[-1:]])
            if m == 1:
                break
            later = later[: m - 1]
            made, ranks = (np.where(later, x[1:], x[:-1]) for x in (made, ranks))
            # the merged symbol's pairs with the one before and the one after
            a, b = np.flatnonzero(at > 0), np.flatnonzero(at < m - 1)
            row, column = np.concatenate([at[a] - 1, at[b]]), np.concatenate([a, b])
            got = self._candidates(symbols[row, column], symbols[row + 1, column], salt[column], start[row, column], start[row + 1, column], start[row + 2, column])
            made[row, column], ranks[row, column] = got
        put(columns, symbols)

    def _long(self, word: str, salt: int) -> list[int]:
        """The symbols of one long word by agendas of its parts, with the same order and skips."""
        out: list[int] = []
        start = 0
        for stop in range(1, len(word) + 1):
            if stop == len(word) or word[stop - 1 : stop + 1] not in self.pairs:
                out += self._part(word, start, stop, int(salt))
                start = stop
        return out

    def _part(self, word: str, start: int, stop: int, salt: int) -> list[int]:
        """The agenda is a heap of rank and place in one number; an entry whose candidate has changed
        since is passed over."""
        import heapq

        codes = [self.chars.get(c, -2 - ord(c)) for c in word[start:stop]]
        n, joins = len(codes), self.joins
        if n == 1:
            return codes
        follow, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        made = array("q", [joins.get(a << 32 | b, -1) if a >= 0 and b >= 0 else -1 for a, b in zip(codes, codes[1:])] + [-1])
        below = None if self.skip_below is None else int(self.skip_below)
        if below is not None:
            at = np.arange(start, start + n, dtype=np.int64)
            np.frombuffer(made, np.int64)[hashed(_U(salt), at, at + 1, at + 2) < self.skip_below] = -1
        rank = self.ranks
        heap = [rank[m] * n + at for at, m in enumerate(made) if m >= 0]
        heapq.heapify(heap)
        while heap:
            r, at = divmod(heapq.heappop(heap), n)
            m = made[at]
            if m < 0 or rank[m] != r:
                continue
            middle = follow[at]
            end = follow[middle]
            codes[at], codes[middle], made[middle] = m, -1, -1
            follow[at] = end
            if end < n:
                before[end] = at
            for at in (at, before[at]):
                if at < 0:
                    continue
                middle = follow[at]
                m = joins.get(codes[at] << 32 | codes[middle], -1) if middle < n and codes[at] >= 0 and codes[middle] >= 0 else -1
                if m >= 0 and below is not None and _mix(salt + (at + start) * AT + (middle + start) * MIDDLE + (follow[middle] + start) * END & _MASK) < below:
                    m = -1
                made[at] = m
                if m >= 0:
                    heapq.heappush(heap, rank[m] * n + at)
        return [c for c in codes if c != -1]

    def segment(self, text: str, firsts: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of ``text`` that begin at ``firsts``, one after another, and how many each
        has."""
        codes = self.symbols[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        sizes = np.diff(firsts, append=len(codes))
        counts, done = np.zeros(len(firsts), np.int64), []
        order = np.argsort(sizes, kind="stable")
        edges = np.searchsorted(sizes[order], np.arange(LOCKSTEP + 2))
        for size in range(1, LOCKSTEP + 1):
            for at in range(edges[size], edges[size + 1], ROWS):
                words = order[at : min(at + ROWS, edges[size + 1])]

                def put(columns: np.ndarray, symbols: np.ndarray, words=words) -> None:
                    counts[words[columns]] = len(symbols)
                    done.append((words[columns], symbols))

                self._lockstep(codes[firsts[words] + np.arange(size)[:, None]], salts[words], put)
        for w in order[edges[LOCKSTEP + 1] :].tolist():
            symbols = np.array(self._long(text[firsts[w] : firsts[w] + sizes[w]], salts[w]), np.int32)
            counts[w] = len(symbols)
            done.append((np.array([w]), symbols[:, None]))
        offsets = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for words, symbols in done:
            flat[offsets[words] + np.arange(len(symbols))[:, None]] = symbols
        odd = np.flatnonzero(flat < 0)
        if len(odd):  # characters without piece become their bytes
            data = [chr(-2 - c).encode("utf-8", "surrogatepass") for c in flat[odd].tolist()]
            times = np.ones(len(flat), np.int64)
            times[odd] = [len(b) for b in data]
            owner = np.repeat(np.arange(len(counts)), counts)
            counts = np.bincount(np.repeat(owner, times), minlength=len(counts)).astype(np.int64)
            flat = np.repeat(flat, times)
            flat[flat < 0] = [self.byte_ids[b] for bs in data for b in bs]
        return flat, counts

    def encode(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Ids, of type ``width``, of each text under its key. An empty text has none."""
        # a literal word mark is kept apart and written as bytes, so that decoding tells it from a space
        parts = [self._marked(t) for t in texts]
        flat = [p for ps in parts for p in ps]
        text = "".join(flat)
        if not text:
            return [b""] * len(texts)
        owner = np.repeat(np.arange(len(texts)), [len(ps) for ps in parts])
        stops = np.cumsum([len(p) for p in flat])
        # words begin at parts, at and after line ends, and where spaces begin
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        space, line = code == ord(SPACE), code == 10
        begins = line | space
        begins[1:] = line[1:] | line[:-1] | (space[1:] & ~space[:-1])
        begins[0] = True
        begins[stops[:-1][stops[:-1] < len(code)]] = True
        firsts = np.flatnonzero(begins)
        part = np.searchsorted(stops, firsts, side="right")
        of = owner[part]
        places = np.arange(len(firsts)) - np.searchsorted(of, np.arange(len(texts)))[of]
        ids, counts = self.segment(text, firsts, self.salts(np.array(keys, _U)[of], places))
        ends = np.cumsum(np.bincount(part, weights=counts, minlength=len(flat))).astype(np.int64)
        data, size = ids.astype(self.width).tobytes(), self.width.itemsize
        pieces = [data[size * a : size * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        mark, out, at = np.array(self.mark, self.width).tobytes(), [], 0
        for ps in parts:
            out.append(mark.join(pieces[at : at + len(ps)]))
            at += len(ps)
        return out

    @staticmethod
    def _marked(text: str) -> list[str]:
        """The parts of a text between literal word marks, with marks for spaces and a leading one."""
        if not text:
            return []
        first, *rest = text.split(SPACE)
        return [SPACE + first.replace(" ", SPACE), *(p.replace(" ", SPACE) for p in rest)]

    def decode(self, ids: bytes) -> str:
        """The text of ids: the exact one that was encoded."""
        values = np.frombuffer(ids, self.width).tolist()
        if not values:
            return ""
        special = self.bytes_of
        if special.keys().isdisjoint(values):
            return "".join(map(self.texts.__getitem__, values))[1:]
        out, run = [], bytearray()
        for i in values:
            b = special.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode())
                run.clear()
            out.append(self.texts[i])
        return "".join([*out, run.decode()])[1:]


@lru_cache(maxsize=4)
def segmenter(path: str, dropout: float, seed: int) -> Segmenter:
    return Segmenter(path, dropout, seed)


def key_of(doc_id: int | None, seed: int) -> int:
    """64 bits that key a document's skips."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{doc_id}".encode(), digest_size=8).digest(), "little")


def encode(docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian bytes) of ``docs`` (doc_id, text). Another seed gives
    another segmentation.

    A null or empty text has no ids. Null doc_ids and repeated rows stay; a doc_id always has, for
    the same text and seed, the same ids. Other columns are ignored.
    """
    path = path or default_path()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segmenter(path, dropout, seed)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for span in spans_of(texts):
                doc_ids = batch.column(0).slice(span.start, span.stop - span.start)
                ids = seg.encode(texts[span], [key_of(d, seed) for d in doc_ids.to_pylist()])
                yield pa.record_batch([doc_ids, pa.array([len(x) // seg.width.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encoded, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of ``encoded`` (doc_id, ids)."""
    path = path or default_path()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segmenter(path, 0.0, 0)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([seg.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with dropout and decoded again: doc_id, n_tokens, ids_crc32 (of ids
    as little-endian uint32) and the digest of the decoded text."""
    path = default_path()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segmenter(path, 0.0, 0)
        for batch in batches:
            doc_id, n, ids = batch.columns
            arrays = ids.to_pylist()
            crcs = [zlib.crc32(np.frombuffer(x, seg.width).astype("<u4").tobytes()) for x in arrays]
            texts = [hashlib.sha256(seg.decode(x).encode()).hexdigest() for x in arrays]
            yield pa.record_batch([doc_id, n, pa.array(crcs, pa.int64()), pa.array(texts)], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"])

    made = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.mapInArrow(digests, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string")
