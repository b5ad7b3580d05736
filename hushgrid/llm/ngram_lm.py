"""Interpolated modified Kneser-Ney trigram model counted in Spark (operator 6).

Counting: tasks hash words to 48 bits and count trigrams (u, v, w) of some million tokens at a time; blocks of the
distinct ones are shuffled by the range of v and merged, so counts of trigrams and bigrams, and how many words
come before a bigram, all follow in one place. Words so common that they would fill a range of their own (found on
a bounded sample, which decides on the work alone) are spread over the ranges by their follower. Words frequent in that
sample go through the shuffle as their places in a list of them, others as hashes. A range
becomes files of sorted 64-bit hashes, an array for each class of counts, values in few bytes. Sums by word and by context
follow in a second, smaller shuffle. Workers map the files into memory and look up sorted batches. Ranges grow in
number with the text, so no task holds more than a bounded share; the driver sees a single row of sums.

Trigrams of ``least`` occurrences are stored. With 1 that is the whole model; with 2, as toolkits do, those seen once
count in the discounts alone and their mass goes to the bigram. A context without a stored trigram needs no entry,
and the probability of w after (u, v) is (c(uvw) - D) / c(uv) of a stored trigram plus what that leaves over times the
interpolated bigram probability. Contexts of other than common words are complete in the range of v and written there.
In a whole model a context that occurs once has one trigram, seen once: the count of its bigram tells it, and it is not written.
Keys are stored as the 40 bits behind the first 24, by which they are indexed, where that takes less place.

Known words, their counts, N and V, which make the base, are counted apart from the trigrams by 64-bit hashes of words.

A null text is an empty one: its only token is the end. Repeated rows count each time; very long texts count whole,
in pieces. With no training rows every word has the uniform probability of a vocabulary of one. An empty table gives
no rows; columns beyond those named aren't looked at.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blobs import map_arrays, narrow, write_arrays
from .common import scratch

#: Text bytes for each context range; ranges are a power of two, at most 2^CONTEXT_BITS.
RANGE_BYTES = 8 << 20
CONTEXT_BITS = 24
WORD_BITS = 48
#: Tokens counted or scored at once in a task.
COUNT_AT_ONCE, SCORE_AT_ONCE = 3_000_000, 1_000_000
#: Words whose hashes a task remembers.
REMEMBER = 400_000
#: Text bytes of the sample on which common words are found, and how many of its words, the most frequent, are listed.
SAMPLE_BYTES, LISTED = 16 << 20, 65_000
U = np.uint64
LOW32 = U((1 << 32) - 1)


class _Hashes(dict):
    """Word -> 64-bit hash; the model takes its top 48 bits."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 0)
        return h


#: A blank is in no word, so these two hash apart from words.
WIDE_START, WIDE_END = (xxhash.xxh64_intdigest(x, 0) for x in (b" start", b" end"))
START, END = WIDE_START >> 16, WIDE_END >> 16
PAIR = np.array([WIDE_START, WIDE_START], U)
#: From a word's 64 bits to the model's.
CUT = U(64 - WORD_BITS)


def _tokens(text: str | None, hashes: _Hashes) -> np.ndarray:
    """Word hashes of 64 bits, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter([*map(hashes.__getitem__, words), WIDE_END], U, len(words) + 1)


def _mix(*parts: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of some words."""
    x = parts[0] * U(0x9E3779B97F4A7C15)
    for p in parts[1:]:
        x = (x ^ (x >> U(31))) * U(0xD6E8FEB86659FD93) + p * U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _ranges(v: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The 24 bits that deal bigrams out: the top of v, for common words v those of a mixture of both."""
    top = v >> U(WORD_BITS - CONTEXT_BITS)
    common = _is_hot(v, hot)
    if common.any():
        top = top.copy()
        top[common] = _mix(v[common], w[common]) >> U(64 - CONTEXT_BITS)
    return top


def _keys(ranges: np.ndarray, mixed: np.ndarray, bits: int) -> np.ndarray:
    """The range, then as many mixed bits as there is place for: fewer would let trigrams of one frequent word meet."""
    return ((ranges >> U(CONTEXT_BITS - bits)) << U(64 - bits)) | (mixed >> U(bits))


def bigram_keys(v: np.ndarray, w: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    return _keys(_ranges(v, w, hot), _mix(v, w), bits)


def trigram_keys(u: np.ndarray, v: np.ndarray, w: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """u counts with 32 bits."""
    return _keys(_ranges(v, w, hot), _mix(u & LOW32, v, w), bits)


def _is_hot(v: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v


def context_keys(u: np.ndarray, v: np.ndarray, bits: int) -> np.ndarray:
    """Keys by the range of v, for contexts of other than common words."""
    return _keys(v >> U(WORD_BITS - CONTEXT_BITS), _mix(u & LOW32, v, np.full(1, 7, U)), bits)


def hot_context_keys(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _mix(u & LOW32, v, np.full(1, 7, U))


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, int)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys)
    keys = keys[order]
    at = _runs(keys)
    return (keys[at], *(np.add.reduceat(x[order], at) if len(at) else x for x in values))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns as byte planes, compressed: high bytes of hashes in order and small counts nearly vanish."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(n, 8).T).tobytes() for c in columns)
    return np.array([n, len(columns)], "<i8").tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    n, k = np.frombuffer(blob, "<i8", 2)
    planes = np.frombuffer(pa.decompress(blob[16:], int(n * k * 8), codec="zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(x.T).view("<u8").ravel() for x in planes.reshape(k, 8, n)]


def _pack_sorted(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """The same for sorted keys and what goes with them: steps are smaller than keys."""
    return _pack(np.diff(keys, prepend=U(0)), *columns)


def _unpack_sorted(blob: bytes) -> list[np.ndarray]:
    steps, *columns = _unpack(blob)
    return [np.cumsum(steps, dtype=U), *columns]


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, most frequent first, and the place of each value among them."""
    values, at, n = np.unique(x, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(order), U)
    place[order] = np.arange(len(order), dtype=U)
    return values[order], place[at]


class _Words:
    """A list of words by whose places others are told."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.known, self.first = np.unique(words, return_index=True)

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word, from 1 (0: it isn't there), and the words that aren't."""
        if not len(self.known):
            return np.zeros(len(words), U), words
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        there = self.known[at] == words
        return np.where(there, self.first[at] + 1, 0).astype(U), words[~there]

    def back(self, places: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = np.empty(len(places), U)
        out[places > 0] = self.words[places[places > 0].astype(np.int64) - 1]
        out[places == 0] = others
        return out


def _lists(frequent: np.ndarray) -> tuple[_Words, _Words]:
    """For the first word of a trigram, which counts with 32 bits, and for the last."""
    return _Words(frequent & LOW32), _Words(frequent)


def _pack_trigrams(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, lists: tuple[_Words, _Words]) -> bytes:
    """Trigrams in order of v. Words on either side by their places in lists of a block's words, those by theirs in ``lists``:
    hashes don't compress, small numbers do."""
    (us, u), (ws, w) = _coded(u), _coded(w)
    at = _runs(v)
    blobs = [_pack(u, w, n), _pack_sorted(v[at], np.diff(np.append(at, len(v)))), *map(_pack, (*lists[0].places(us), *lists[1].places(ws)))]
    return np.array([len(x) for x in blobs], "<i8").tobytes() + b"".join(blobs)


def _unpack_trigrams(blob: bytes, lists: tuple[_Words, _Words]) -> list[np.ndarray]:
    ends = 48 + np.cumsum(np.frombuffer(blob, "<i8", 6))
    first, middle, *rest = (blob[x:y] for x, y in zip([48, *ends[:-1]], ends))
    (u, w, n), (v, times), ((a,), (b,), (c,), (d,)) = _unpack(first), _unpack_sorted(middle), map(_unpack, rest)
    us, ws = lists[0].back(a, b), lists[1].back(c, d)
    return [us[u.astype(np.int64)], np.repeat(v, times.astype(np.int64)), ws[w.astype(np.int64)], n]


def _joined(blobs: list[bytes], columns: int, unpack=_unpack) -> list[np.ndarray]:
    parts = [unpack(x) for x in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, U) for k in range(columns)]


def _cut(keys: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted keys by the bits above ``shift``."""
    top = keys >> U(shift)
    at = _runs(top)
    for a, b in zip(at, [*at[1:], len(keys)]):
        yield int(top[a]), int(a), int(b)


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["part", "kind", "payload"])


def _count_blocks(bits: int, hot: np.ndarray, frequent: np.ndarray = np.zeros(0, U)):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, lists, held, size = _Hashes(), _lists(frequent), [], 0

        def block(parts: list[np.ndarray]) -> pa.RecordBatch:
            t = np.concatenate(parts)
            at = np.flatnonzero(np.concatenate([np.arange(len(x)) > 1 for x in parts]))
            words, times = np.unique(t[at], return_counts=True)
            t >>= CUT
            u, v, w = t[at - 2] & LOW32, t[at - 1], t[at]
            key = trigram_keys(u, v, w, hot, bits)
            order = np.argsort(key)
            key = key[order]
            at = _runs(key)
            n, order, key = np.diff(np.append(at, len(key))), order[at], key[at]
            u, v, w = u[order], v[order], w[order]
            out = []
            for part, a, b in _cut(key, 64 - bits):
                near = a + np.argsort((v[a:b] << U(16)) | (w[a:b] >> U(32)))  # words in order need fewer bytes
                out.append((part, "trigram", _pack_trigrams(u[near], v[near], w[near], n[near], lists)))
            out += [(part, "base", _pack_sorted(words[a:b], times[a:b].astype(U))) for part, a, b in _cut(words, 64 - bits)]
            parts, kinds, payloads = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(kinds), pa.array(payloads, pa.binary())], ["part", "kind", "payload"])

        for batch in batches:
            for text in batch.column(0):
                t = np.concatenate([PAIR, _tokens(text.as_py(), hashes)])
                for a in range(2, len(t), COUNT_AT_ONCE):  # a piece begins with the two words before it
                    held.append(t[a - 2 : a + COUNT_AT_ONCE])
                    size += len(held[-1])
                    if size >= COUNT_AT_ONCE:
                        yield block(held)
                        held, size = [], 0
        if held:
            yield block(held)

    return run


#: Bits of a key that are stored behind an index of those before them, and the bits of the last byte of these.
REST, LAST = U(40), U(8)


def _split(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Sorted keys of 64 bits that agree in the first ``bits``, as three arrays, with no bit lost: where the keys of each value of the bits up to
    the 24th begin, then 32 and 8 bits of each. Few keys stay whole, as the second array."""
    lead = CONTEXT_BITS - bits
    if (2 if lead >= 8 else 4) * ((1 << lead) + 1) >= 3 * len(keys) or len(keys) >> 32:
        return [np.zeros(0, np.uint32), keys, np.zeros(0, np.uint8)]
    first = ((keys >> REST) & U((1 << lead) - 1)).astype(np.int64)
    starts = np.append(0, np.cumsum(np.bincount(first, minlength=1 << lead))).astype(np.uint32)
    if lead >= 8 and len(fine := starts - np.repeat(starts[::256], 256)[: len(starts)]) and fine.max() < 1 << 16:
        starts = np.concatenate([fine.astype("<u2"), starts[::256].astype("<u4").view("<u2")])  # from the start of each 256
    return [starts, ((keys >> LAST) & LOW32).astype(np.uint32), (keys & U(255)).astype(np.uint8)]


def _places(found: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted ``keys`` are among those that ``_split`` made ``found`` of, and their places."""
    starts, middle, last = found
    if not len(starts):
        place = np.minimum(np.searchsorted(middle, keys), len(middle) - 1)
        hit = np.flatnonzero(middle[place] == keys) if len(middle) else np.zeros(0, int)
        return hit, place[hit]
    if starts.itemsize == 2:
        size = 1 << ((len(starts) - 1).bit_length() - 1)  # then one more, and the starts of each 256 in twice two bytes
        fine, coarse = starts[: size + 1], starts[size + 1 :].reshape(-1, 2)
        first = ((keys >> REST) & U(size - 1)).astype(np.int64)
        low, end = (fine[x].astype(np.int64) + coarse[x >> 8, 0] + (coarse[x >> 8, 1].astype(np.int64) << 16) for x in (first, first + 1))
    else:
        first = ((keys >> REST) & U(len(starts) - 2)).astype(np.int64)
        low, end = starts[first].astype(np.int64), starts[first + 1].astype(np.int64)
    high, mid, byte = end, ((keys >> LAST) & LOW32).astype(np.uint32), (keys & U(255)).astype(np.uint8)
    for _ in range(int((end - low).max(initial=0)).bit_length()):
        at = (low + high) >> 1
        below = (low < high) & (middle[np.minimum(at, len(middle) - 1)] < mid)
        low, high = np.where(below, at + 1, low), np.where(below, high, np.maximum(at, low))
    while True:  # keys that agree in all but the last byte are few
        at = np.minimum(low, len(middle) - 1)
        same = (low < end) & (middle[at] == mid)
        later = same & (last[at] < byte)
        if not later.any():
            hit = np.flatnonzero(same & (last[at] == byte))
            return hit, low[hit]
        low = low + later


def _write(path: str, keys: np.ndarray, *values: np.ndarray, bits: int | None = None) -> None:
    """A file of sorted keys with their values in three classes: all values 1, all under 256, others. ``bits``: those in which keys of 64 bits agree."""
    split = (lambda k: _split(k, bits)) if bits is not None else (lambda k: [np.zeros(0, np.uint32), k, np.zeros(0, np.uint8)])
    largest = np.max(values, axis=0) if len(keys) else np.zeros(0)
    least = np.min(values, axis=0) if len(keys) else np.zeros(0)
    ones = (largest == 1) & (least == 1)
    arrays = split(keys[ones])
    for chosen in (~ones & (largest < 256), largest >= 256):
        arrays += [*split(keys[chosen]), *(narrow(np.asarray(x)[chosen]) for x in values)]
    write_arrays(path, arrays)


def _write_contexts(path: str, contexts: tuple[np.ndarray, ...], bits: int, least: int) -> None:
    """Contexts with one trigram seen once, the most, have all values 1 and need only their key; in a whole model not even that."""
    keys, total, kinds, two, more = (x[contexts[1] > 1] for x in contexts) if least == 1 else contexts
    _write(path, keys, total, kinds, two + U(1), more + U(1), bits=bits)


def _store_ngrams(root: str, bits: int, hot: np.ndarray, frequent: np.ndarray, least: int):
    def base(part: int, blobs: list[bytes]) -> pd.DataFrame:
        words, n = _summed(*_joined(blobs, 2, _unpack_sorted))
        _write(f"{root}/base/{part}", words, n, bits=bits)
        return _rows([(part, "base", _pack(np.array([len(words)], U), np.array([int(n.sum())], U)))])

    def contexts_of(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        return _summed(keys, n, np.ones(len(n), U), (n == 2).astype(U), (n > 2).astype(U))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        if key[1] == "base":
            return base(part, pdf["payload"].tolist())
        lists = _lists(frequent)
        u, v, w, n = _joined(pdf["payload"].tolist(), 4, lambda x: _unpack_trigrams(x, lists))
        keys = trigram_keys(u, v, w, hot, bits)
        order = np.argsort(keys)
        keys = keys[order]
        at = _runs(keys)
        n = np.add.reduceat(n[order], at)
        keys, u, v, w = keys[at], u[order[at]], v[order[at]], w[order[at]]
        kept = n >= least
        _write(f"{root}/trigrams/{part}", keys[kept], n[kept], bits=bits)
        common = _is_hot(v, hot)
        here, spread = kept & ~common, kept & common
        _write_contexts(f"{root}/contexts/{part}", contexts_of(context_keys(u[here], v[here], bits), n[here]), bits, least)
        contexts = contexts_of(hot_context_keys(u[spread], v[spread]), n[spread])
        pairs = bigram_keys(v, w, hot, bits)
        order = np.argsort(pairs)
        pairs = pairs[order]
        at = _runs(pairs)
        before, count = np.diff(np.append(at, len(pairs))).astype(U), np.add.reduceat(n[order], at)
        pairs, v, w = pairs[at], v[order[at]], w[order[at]]
        _write(f"{root}/bigrams/{part}", pairs, before, count, bits=bits)
        one, two, more = ((x).astype(U) for x in (before == 1, before == 2, before > 2))
        follow = _summed(v, before, one, two, more)
        words = _summed(w, np.ones(len(w), U), count)
        classes = np.array([[int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((before == k).sum()) for k in (1, 2, 3, 4)]], U).T
        out = [(part, "classes", _pack(*classes))]
        for kind, columns, shift in (("follow", follow, WORD_BITS - bits), ("word", words, WORD_BITS - bits), ("context", contexts, 64 - bits)):
            out += [(p, kind, _pack_sorted(*(x[a:b] for x in columns))) for p, a, b in _cut(columns[0], shift)]
        return _rows(out)

    return run


def _store_words(root: str, bits: int, least: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        by = {k: g["payload"].tolist() for k, g in pdf.groupby("kind")}
        w, a, c = _summed(*_joined(by.get("word", []), 3, _unpack_sorted))
        v, total, one, two, more = _summed(*_joined(by.get("follow", []), 5, _unpack_sorted))
        every = np.union1d(w, v)
        cols = np.zeros((6, len(every)), np.int64)
        cols[0:2, np.searchsorted(every, w)] = a, c
        cols[2:6, np.searchsorted(every, v)] = total, one, two, more
        _write(f"{root}/words/{int(key[0])}", every, *cols)
        _write_contexts(f"{root}/hot_contexts/{int(key[0])}", _summed(*_joined(by.get("context", []), 5, _unpack_sorted)), bits, least)
        classes = [_unpack(x) for x in by.get("classes", [])]
        n = [sum(int(x[k][0]) for x in classes) for k in range(8)]
        m = [int((a == k).sum()) for k in (1, 2, 3, 4)]
        distinct, tokens = (sum(int(x[0]) for x in column) for column in zip(*map(_unpack, by["base"]))) if "base" in by else (0, 0)
        return pd.DataFrame([[*n, *m, int((a > 2).sum()), int(a.sum()), len(w), int(c[w == END].sum()), distinct, tokens]], columns=SUMS)

    return run


SUMS = ["t1", "t2", "t3", "t4", "b1", "b2", "b3", "b4", "w1", "w2", "w3", "w4", "w_more", "bigrams", "vocabulary", "starts", "distinct", "tokens"]


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, 3 and more; where a class is empty, half its count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return [min(max(x, 0.05), k - 0.05) for k, x in enumerate(raw, 1)]


@dataclass
class TrigramModel:
    root: str
    bits: int
    hot: np.ndarray
    sums: dict[str, int]
    least: int = 2

    def score(self, df: DataFrame, id_cols: list[str], text: Column) -> DataFrame:
        """``id_cols`` with n_tokens, n_known, base_score (add-one unigrams) and score, both log10."""
        schema = T.StructType([*df.select(*id_cols).schema, *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
        return df.select(*id_cols, text.alias("_text")).mapInArrow(_scorer(self.root, self.bits, self.hot, dict(self.sums), self.least, len(id_cols)), schema)


def _sampled(text: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, SAMPLE_BYTES / max(1, size))))


def common_words(df: DataFrame, text: Column, size: int, bits: int) -> np.ndarray:
    """Hashes, sorted, of words with more than a range's share of a sample of SAMPLE_BYTES or so, and of the start."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            parts = [_tokens(x.as_py(), hashes) >> CUT for x in batch.column(0)]
            word, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, U), return_counts=True)
            often = n * (4 << bits) > n.sum()  # others can't reach a quarter of the share here
            yield pa.RecordBatch.from_arrays([pa.array([*word[often].view(np.int64), -1]), pa.array([*n[often], n.sum()], pa.int64())], ["word", "n"])

    found = df.where(_sampled(text, size)).select(text.alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = found.where("word = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = found.where((F.col("word") >= 0) & (F.col("n") * F.lit(1 << bits) > F.lit(total))).select("word").collect()  # fewer than ranges
    return np.unique(np.array([START, *(r.word for r in rows)], np.int64)).view(U)


def frequent_words(df: DataFrame, text: Column, size: int) -> np.ndarray:
    """Hashes of the most frequent words of a sample of SAMPLE_BYTES or so, ``LISTED`` at most, by falling count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            parts = [_tokens(x.as_py(), hashes) >> CUT for x in batch.column(0)]
            word, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    found = df.where(_sampled(text, size)).select(text.alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = found.where("n > 1").orderBy(F.col("n").desc(), "word").limit(LISTED).collect()
    return np.array([r.word for r in rows], np.int64).view(U)


def fit(df: DataFrame, text: Column, least: int = 2) -> TrigramModel:
    """Count every row of ``df`` and store the model in the shared folder; trigrams of ``least`` occurrences are kept (1: all)."""
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = min(CONTEXT_BITS, max(1, (size // RANGE_BYTES).bit_length()))
    root = scratch(spark, "trigrams")
    hot = common_words(df, text, size, bits)
    frequent = frequent_words(df, text, size)
    blocks = df.select(text.alias("text")).mapInArrow(_count_blocks(bits, hot, frequent), "part long, kind string, payload binary")
    stored = blocks.groupBy("part", "kind").applyInPandas(_store_ngrams(root, bits, hot, frequent, least), "part long, kind string, payload binary")
    sums = stored.groupBy("part").applyInPandas(_store_words(root, bits, least), ", ".join(f"{c} long" for c in SUMS))
    row = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS]).first()
    return TrigramModel(root, bits, hot, row.asDict(), least)


#: Files that a worker keeps mapped; beyond that the one looked at longest ago is let go (systems bound the mappings of a process).
OPEN = 4096


class _Tables:
    """The mapped files of a model; a file is opened when needed, and ``OPEN`` of them at most are."""

    def __init__(self, root: str, bits: int):
        self.root, self.bits, self.files = root, bits, OrderedDict()

    def _opened(self, kind: str, part: int) -> list[np.ndarray]:
        if (kind, part) in self.files:
            self.files.move_to_end((kind, part))
        else:
            while len(self.files) >= OPEN:
                self.files.popitem(last=False)
            self.files[kind, part] = map_arrays(f"{self.root}/{kind}/{part}")
        return self.files[kind, part] or []

    def _look_up(self, kind: str, keys: np.ndarray, shift: int, values: int) -> np.ndarray:
        """Rows of values for sorted keys, 0 for those that are not there."""
        out = np.zeros((values, len(keys)), np.int64)
        for part, a, b in _cut(keys, shift):
            got = self._opened(kind, part)
            for at in (0, 3, 6 + values)[: 3 * bool(got)]:
                if len(got[at + 1]):
                    hit, place = _places(got[at : at + 3], keys[a:b])
                    for k in range(values):
                        out[k, a + hit] = got[at + 3 + k][place] if at else 1
        return out

    def word(self, h: np.ndarray) -> np.ndarray:
        """Rows a, c, total, one, two, more for sorted hashes."""
        return self._look_up("words", h, WORD_BITS - self.bits, 6)

    def bigram(self, keys: np.ndarray) -> np.ndarray:
        """Rows before (words before the bigram) and count for sorted keys."""
        return self._look_up("bigrams", keys, 64 - self.bits, 2)

    def trigram(self, keys: np.ndarray) -> np.ndarray:
        """Counts of stored trigrams for sorted keys."""
        return self._look_up("trigrams", keys, 64 - self.bits, 1)[0]

    def base(self, h: np.ndarray) -> np.ndarray:
        """Counts of words for sorted hashes of 64 bits."""
        return self._look_up("base", h, 64 - self.bits, 1)[0]

    def context(self, u: np.ndarray, v: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Rows sum of counts, trigrams of count one, two and more, of stored trigrams after u, v."""
        out, common = np.zeros((4, len(v)), np.int64), _is_hot(v, hot)
        for kind, at in (("contexts", np.flatnonzero(~common)), ("hot_contexts", np.flatnonzero(common))):
            made = hot_context_keys(u[at], v[at]) if kind == "hot_contexts" else context_keys(u[at], v[at], self.bits)
            keys, spread = np.unique(made, return_inverse=True)
            total, kinds, two, more = self._look_up(kind, keys, 64 - self.bits, 4)
            two, more = np.maximum(two - 1, 0), np.maximum(more - 1, 0)
            out[:, at] = np.stack([total, kinds - two - more, two, more])[:, spread]
        return out


def _discounted(n: np.ndarray, d: list[float]) -> np.ndarray:
    return n - np.array([0.0, *d])[np.minimum(n, 3)]


def _log_probabilities(t: _Tables, s: dict[str, int], hot: np.ndarray, least: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known, base log10, model log10 of each token w after u, v, all as 64 bits."""
    words, inverse = np.unique(np.concatenate([w, v]), return_inverse=True)
    c = t.base(words)
    a, _, total, *classes = t.word(words >> CUT)
    u, v, w = u >> CUT, v >> CUT, w >> CUT
    third, second, first = (discounts(*(s[f"{k}{i}"] for i in (1, 2, 3, 4))) for k in "tbw")
    spared = first[0] * s["w1"] + first[1] * s["w2"] + first[2] * s["w_more"]
    uniform = 1 / (s["vocabulary"] + 1)
    unigram = (_discounted(a, first) + spared * uniform) / s["bigrams"] if s["bigrams"] else np.full(len(a), uniform)
    back = sum(d * x for d, x in zip(second, classes))
    at_w, at_v = inverse[: len(w)], inverse[len(w) :]
    keys, spread = np.unique(bigram_keys(v, w, hot, t.bits), return_inverse=True)
    n = t.bigram(keys)[0][spread]
    known = c[at_w]
    n = np.where((total[at_v] > 0) & (known > 0), n, 0)
    seen = np.maximum(total[at_v], 1)
    p = np.where(total[at_v] > 0, _discounted(n, second) / seen + back[at_v] / seen * unigram[at_w], unigram[at_w])

    def occurrences(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        keys, spread = np.unique(bigram_keys(u, v, hot, t.bits), return_inverse=True)
        return np.where((u == START) & (v == START), s["starts"], t.bigram(keys)[1][spread])

    if least == 1:
        times = occurrences(u, v)
        kept = np.stack([times == 1, times == 1, times < 0, times < 0]).astype(np.int64)
        often = np.flatnonzero(times > 1)
        kept[:, often] = t.context(u[often], v[often], hot)
    else:
        kept = t.context(u, v, hot)
    far = np.flatnonzero(kept[0])  # other contexts have no stored trigram: the bigram decides
    if len(far):
        whole = times[far] if least == 1 else occurrences(u[far], v[far])
        keys, spread = np.unique(trigram_keys(u[far], v[far], w[far], hot, t.bits), return_inverse=True)
        n = np.where(known[far] > 0, t.trigram(keys)[spread], 0)
        taken = kept[0, far] - sum(d * kept[k, far] for k, d in enumerate(third, 1))
        ok = whole >= kept[0, far]  # else hashes of different words have met
        whole = np.maximum(whole, 1)
        p[far] = np.where(ok, _discounted(n, third) / whole + (1 - taken / whole) * p[far], p[far])
    return known > 0, np.log10((known + 1) / (s["tokens"] + s["distinct"] + 1)), np.log10(p)


def _scorer(root: str, bits: int, hot: np.ndarray, sums: dict[str, int], least: int, ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tables = _Hashes(), _Tables(root, bits)

        def scored(batch: pa.RecordBatch, docs: list[np.ndarray]) -> pa.RecordBatch:
            w = np.concatenate(docs)
            size = np.array([len(d) for d in docs])
            at = np.cumsum(size) - size
            v = np.concatenate([PAIR[:1], w[:-1]])
            v[at] = WIDE_START
            u = np.concatenate([PAIR[:1], v[:-1]])
            u[at] = WIDE_START
            known, base, model = _log_probabilities(tables, sums, hot, least, u, v, w)
            found = [size, np.add.reduceat(known.astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(model, at)]
            return pa.RecordBatch.from_arrays([*batch.columns[:ids], *map(pa.array, found)], [*batch.schema.names[:ids], "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            docs, held, start = [], 0, 0
            for i, text in enumerate(batch.column(ids)):
                docs.append(_tokens(text.as_py(), hashes))
                held += len(docs[-1])
                if held >= SCORE_AT_ONCE or i + 1 == len(batch):
                    yield scored(batch.slice(start, i + 1 - start), docs)
                    docs, held, start = [], 0, i + 1

    return run
