"""Benchmark decontamination by latent semantic retrieval.

TF-IDF passages of all documents, over the words of the benchmark, give a latent space by a distributed randomised SVD.
Passages and items are compared there by cosine; for what comes near, a longest common subsequence of words in a window
little wider than the item, and a check of the item's answer, decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions
from .textkit import FOLDED, Spans, chunks, words

#: Words of a block; a passage that is compared is two blocks and starts at every block; one that the space is learned
#: from is so many, and they don't overlap.
STEP, LEARNED = 32, 4
#: Dimensions of the latent space, and more that the sketch has.
RANK, EXTRA = 256, 8
#: Words by frequency whose counts are held densely, and words of the items that one pass over the corpus searches for.
DENSE, VOCABULARY = 512, 1 << 16
#: Longer items are looked for by parts of at most so many words, the bits of one integer; and parts of one pass.
PART, PARTS = 64, 1 << 13
#: Cells of the table of places up to which it is held whole.
TABLE = 1 << 22
#: Share of an item that a passage must cover in the latent space to be a candidate.
NEAR = 0.2
#: Window of the decision, in steps of a fourth of the item; share of an item's words in common order that decides,
#: alone or with the answer.
WIDE, SURE, LIKELY, ANSWER = 7, 0.7, 0.5, 0.6
#: Words of an item's end that are its answer; items of fewer words than SHORT are found only whole and in a row.
ANSWER_WORDS, SHORT = 8, 12
#: Features of the sketch that one row of the exchange holds, and passages or candidates that are worked on at once.
SLICE, AT_ONCE = 256, 1 << 11


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one long integer (Crochemore et al., 2001)."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = where.get(y)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def window(size: int) -> tuple[int, int]:
    """Width and step of the windows in which an item of so many words is looked for."""
    return (size, 1) if size < SHORT else (WIDE * (size // 4), size // 4)


def judged(item: list[int], text: list[int], low: int = 0, high: int | None = None) -> tuple[float, float] | None:
    """(common, answer) of the best window of text that starts in [low, high), or None if the item is in none of them.

    Windows start at every step from the start of the text."""
    width, step = window(len(item))
    tail, best = item[-ANSWER_WORDS:], None
    for start in range(-(-low // step) * step, len(text) if high is None else min(high, len(text)), step):
        part = text[start : start + width]
        common = float(part == item) if len(item) < SHORT else lcs(item, part) / len(item)
        if common >= LIKELY and not (best and common < best[0]):
            answer = lcs(tail, part) / len(tail)
            if common >= SURE or answer >= ANSWER:
                best = max(best or (0.0, 0.0), (common, answer))
    return best


@dataclass
class Items:
    """Benchmark items: ids, their word hashes, and the words that make the features."""

    ids: list[int]
    texts: list[np.ndarray]
    vocabulary: np.ndarray  # sorted hashes
    feature: np.ndarray  # of each word of the vocabulary: 0 is the most frequent
    weight: np.ndarray  # of each feature

    def features(self, i: int) -> np.ndarray:
        return self.feature[np.searchsorted(self.vocabulary, self.texts[i])]

    def vectors(self, parts: list[np.ndarray]) -> np.ndarray:
        """TF-IDF of lists of features, as for passages."""
        out = np.zeros((len(parts), len(self.vocabulary)), np.float32)
        for row, part in zip(out, parts, strict=True):
            np.add.at(row, part, 1.0)
        return np.sqrt(out) * self.weight.astype(np.float32)


class _Lookup:
    """Position of each word hash in a sorted vocabulary, or -1, by its high bits."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.bits = np.uint64(max(1, 64 - 4 - len(vocabulary).bit_length()))
        starts = (vocabulary >> self.bits).astype(np.int64)
        bound = np.searchsorted(starts, np.arange((1 << (64 - int(self.bits))) + 1)).astype(np.int32)
        self.first, self.end = bound[:-1], bound[1:]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        index = np.full(len(h), -1)
        slot = (h >> self.bits).astype(np.int64)
        at, end = self.first[slot], self.end[slot]
        todo = np.flatnonzero(at < end)
        at, end = at[todo], end[todo]
        while len(todo):
            hit = self.vocabulary[at] == h[todo]
            index[todo[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            todo, at, end = todo[more], at[more], end[more]
        return index


def _hashed(batch: pa.RecordBatch, lookup: _Lookup) -> Iterator[tuple]:
    """(first row, rows, word hashes, index of each word in the vocabulary or -1, first word of each row)."""
    for first, end, data, offsets in chunks(batch.column("text")):
        starts, ends, at = words(data, offsets)
        h = Spans(data, FOLDED).hash(starts, ends)
        yield first, end - first, h, lookup(h), at


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents that hold each word of the vocabulary, and documents in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, lookup = np.zeros(len(vocabulary), np.int64), 0, _Lookup(vocabulary)
        for b in batches:
            n += b.num_rows
            for _, rows, _, index, at in _hashed(b, lookup):
                row = np.repeat(np.arange(rows), np.diff(at))
                step = max(1, (1 << 24) // max(1, len(vocabulary)))
                for a in range(0, rows, step):
                    x, y = at[a], at[min(a + step, rows)]
                    there = np.flatnonzero(index[x:y] >= 0) + x
                    holds = np.zeros((min(step, rows - a), len(vocabulary)), bool)
                    holds[row[there] - a, index[there]] = True
                    total += np.count_nonzero(holds, axis=0)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1)), pa.array(np.append(total[full], n))], ["word", "n"])

    out, n = np.zeros(len(vocabulary), np.int64), 0
    for r in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r["word"] < 0:
            n = r["n"]
        else:
            out[r["word"]] = r["n"]
    return out, n


class _Counts:
    """TF-IDF of passages: densely for the frequent features, as entries for the others.  The root of a count stands for
    it, so that a word repeated over and over does not hide the words about it."""

    def __init__(self, passage: np.ndarray, feature: np.ndarray, passages: int, items: Items):
        self.passages, self.features = passages, len(items.vocabulary)
        self.dense = min(DENSE, self.features)
        weight = items.weight.astype(np.float32)
        often = feature < self.dense
        flat = np.bincount(passage[often] * self.dense + feature[often], minlength=passages * self.dense)
        self.often = np.sqrt(flat.astype(np.float32)).reshape(passages, self.dense) * weight[: self.dense]
        width = len(items.vocabulary)
        key, n = np.unique(passage[~often] * width + feature[~often], return_counts=True)
        self.passage, self.feature = np.divmod(key, width)
        self.rare = np.sqrt(n.astype(np.float32)) * weight[self.feature]
        squares = np.einsum("ij,ij->i", self.often, self.often) + np.bincount(self.passage, weights=self.rare**2, minlength=passages)
        self.norm = np.sqrt(np.maximum(squares, 1e-12)).astype(np.float32)

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """passages x features by matrix."""
        out = self.often @ matrix[: self.dense]
        if len(self.passage):
            edge = np.flatnonzero(np.diff(self.passage, prepend=-1))
            out[self.passage[edge]] += np.add.reduceat(matrix[self.feature] * self.rare[:, None], edge, axis=0)
        return out

    def add_transposed(self, by: np.ndarray, to: np.ndarray) -> None:
        """to += features x passages by ``by``."""
        to[: self.dense] += self.often.T @ by
        if len(self.passage):
            order = np.argsort(self.feature, kind="stable")
            edge = np.flatnonzero(np.diff(self.feature[order], prepend=-1))
            to[self.feature[order][edge]] += np.add.reduceat(by[self.passage[order]] * self.rare[order, None], edge, axis=0)


def _blocks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block of each word, row of each block, first block of each row); blocks never cross rows."""
    n_words = np.diff(at)
    n = -(-n_words // STEP)
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n_words)
    block = first[row] + (np.arange(at[-1]) - at[row]) // STEP
    return block, np.repeat(np.arange(len(n)), n), first


def _space(docs: DataFrame, items: Items) -> np.ndarray:
    """Right singular vectors (features x RANK) of the TF-IDF passages of docs, each of length 1: B = A'(A W) for a random
    W, summed over all tasks, then the Nystroem form of A'A.  A direction with more than the mean energy is shortened
    to it, so that what most passages share does not drown the rest.

    A task sends its features x (RANK + EXTRA) sum in slices of SLICE features, and each slice is summed by itself, so
    no task holds more than one task's sum; the driver sees one such array.  The items count as passages, too."""
    v = len(items.vocabulary)
    width = min(RANK + EXTRA, v)
    omega = np.random.default_rng(5).standard_normal((v, width)).astype(np.float32)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lookup = np.zeros((v, width), np.float32), _Lookup(items.vocabulary)
        for b in batches:
            for _, _, _, index, at in _hashed(b, lookup):
                block, row, first = _blocks(at)
                if not len(row):
                    continue
                # passages that don't overlap: LEARNED blocks of a row
                head = (np.arange(len(row)) - first[row]) % LEARNED == 0
                passage = np.cumsum(head) - 1
                held = np.flatnonzero(index >= 0)
                counts = _Counts(passage[block[held]], items.feature[index[held]], int(head.sum()), items)
                counts.add_transposed(counts.times(omega) / counts.norm[:, None] ** 2, total)
        slices = [(a // SLICE, total[a : a + SLICE].tobytes()) for a in range(0, v, SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in slices], pa.int32()), pa.array([x for _, x in slices], pa.binary())], ["slice", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for at, part in zip(b.column("slice").to_pylist(), b.column("part"), strict=True):
                totals[at] = totals.get(at, 0.0) + np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["slice", "part"])

    parts = docs.select("text").mapInArrow(product, "slice int, part binary")
    slices = parts.repartitionById(min(partitions(docs), -(-v // SLICE)), "slice").mapInArrow(add, "slice int, part binary")
    total = np.zeros((v, width))
    for r in slices.collect():  # features x (RANK + EXTRA) numbers in all
        a = r["slice"] * SLICE
        total[a : a + SLICE] = np.frombuffer(r["part"], np.float64).reshape(-1, width)
    known = items.vectors([items.features(i) for i in range(len(items.ids))]).astype(np.float64)
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    total += known.T @ (known @ omega)
    total += 1e-8 * max(1.0, np.linalg.norm(total)) * omega
    core = omega.T.astype(np.float64) @ total
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    values = np.maximum(values, values.max() * 1e-10)
    left, sigma, _ = np.linalg.svd(total @ (vectors / np.sqrt(values)), full_matrices=False)
    keep = min(RANK, width)
    energy = sigma[:keep] ** 2
    return (left[:, :keep] / np.sqrt(energy + energy.mean())).astype(np.float32)


class _Masks:
    """For each part of an item and feature, the bits of the places that hold the feature: a whole table, or an open one
    where that would have more than TABLE cells."""

    def __init__(self, parts: list[np.ndarray], features: int):
        self.features = features
        entries: dict[int, int] = {}
        for p, part in enumerate(parts):
            for place, feature in enumerate(part.tolist()):
                key = p * features + feature
                entries[key] = entries.get(key, 0) | 1 << place
        self.whole = None
        if len(parts) * (features + 1) <= TABLE:
            self.whole = np.zeros((len(parts), features + 1), np.uint64)  # the last for no feature
            for key, bits in entries.items():
                self.whole[divmod(key, features)] = bits
            return
        size = 1 << max(4, (4 * len(entries)).bit_length())
        self.keys, self.bits, self.last = np.full(size, -1), np.zeros(size, np.uint64), size - 1
        for key, bits in entries.items():
            at = (key * 0x9E3779B1 >> 7) & self.last
            while self.keys[at] >= 0:
                at = (at + 1) & self.last
            self.keys[at], self.bits[at] = key, bits

    def of(self, part: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Bits of features (parts x words, -1 for none) for each part."""
        if self.whole is not None:
            return np.take(self.whole.ravel(), (part * (self.features + 1))[:, None] + feature + (feature < 0) * (self.features + 1))
        out = np.zeros(feature.shape, np.uint64)
        row, column = np.nonzero(feature >= 0)
        key = part[row] * self.features + feature[row, column]
        at, todo = (key * 0x9E3779B1 >> 7) & self.last, np.arange(len(key))
        found = np.zeros(len(key), np.uint64)
        while len(todo):
            there = self.keys[at]
            hit = there == key[todo]
            found[todo[hit]] = self.bits[at[hit]]
            more = ~hit & (there >= 0)
            todo, at = todo[more], (at[more] + 1) & self.last
        out[row, column] = found
        return out


def _common(masks: np.ndarray, size: int) -> np.ndarray:
    """lcs() of many texts (rows of bits for each word) with items of one size, at most 64."""
    full = np.uint64((1 << size) - 1)
    v = np.full(len(masks), full)
    for j in range(masks.shape[1]):
        u = v & masks[:, j]
        v = ((v + u) | (v - u)) & full
    return size - np.bitwise_count(v).astype(np.int64)


Found = dict[tuple[int, int], tuple[float, float, float]]


class Search:
    """What each task needs to find items, for one pass over the corpus."""

    def __init__(self, items: Items, space: np.ndarray):
        self.items, self.space = items, space
        whole = [items.features(i) for i in range(len(items.ids))]
        cuts = [np.array_split(x, -(-len(x) // PART)) for x in whole]
        parts = [y for x in cuts for y in x]
        self.item = np.repeat(np.arange(len(whole)), [len(x) for x in cuts])
        self.size = np.array([len(x) for x in parts])
        self.begin = np.concatenate([np.cumsum([0, *map(len, x[:-1])]) for x in cuts])
        self.masks = _Masks(parts, len(items.vocabulary))
        self.aims = items.vectors(parts) @ space
        self.length = np.linalg.norm(self.aims, axis=1)
        aims = (self.aims / np.maximum(self.length, 1e-9)[:, None] ** 2).T
        # few parts: one product of passages with all of them; many: by way of the space
        self.steps = [space @ aims] if len(parts) <= space.shape[1] else [space, aims]

    def near(self, index: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row of a passage, number of its first block there, part) of the candidates.

        A passage covers of a part its cosine with it, times how much longer it is than the part: the cosine itself
        falls with what stands around a short one."""
        block, row, first = _blocks(at)
        held = np.flatnonzero(index >= 0)
        spot, feature = block[held], self.items.feature[index[held]]
        # each block belongs to the passage it begins and to the one before it in its row
        later = np.flatnonzero(spot > first[row[spot]]) if len(spot) else held
        found = [(np.zeros(0, np.int64),) * 3]
        for a in range(0, len(row), AT_ONCE):
            b = min(a + AT_ONCE, len(row))
            one = slice(*np.searchsorted(spot, (a, b)))
            two = later[slice(*np.searchsorted(spot[later], (a + 1, b + 1)))]
            counts = _Counts(np.concatenate([spot[one], spot[two] - 1]) - a, np.concatenate([feature[one], feature[two]]), b - a, self.items)
            score = counts.times(self.steps[0])
            for step in self.steps[1:]:
                score = score @ step
            p, i = np.divmod(np.flatnonzero(score.ravel() >= NEAR), score.shape[1])
            found.append((row[p + a], p + a - first[row[p + a]], i))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def batch(self, b: pa.RecordBatch, lookup: _Lookup, sequences: list[list[int]]) -> Found:
        """(row, item) of all items found in a batch's texts, with cosine, common and answer."""
        found: Found = {}
        for first, _, h, index, at in _hashed(b, lookup):
            feature = np.where(index >= 0, self.items.feature[index], -1)
            candidates = self.near(index, at)
            sizes = self.size[candidates[2]]
            best: dict[tuple[int, int], tuple[float, float, int, int]] = {}
            for size in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == size)
                for a in range(0, len(some), AT_ONCE):
                    self._judge(size, [x[some[a : a + AT_ONCE]] for x in candidates], feature, h, at, sequences, best)
            for (row, item), (common, answer, number, part) in best.items():
                words_ = feature[at[row] + number * STEP : min(at[row + 1], at[row] + (number + 2) * STEP)]
                passage = self.items.vectors([words_[words_ >= 0]])[0] @ self.space
                cosine = float(passage @ self.aims[part] / max(1e-9, float(np.linalg.norm(passage)) * self.length[part]))
                found[first + row, item] = (cosine, common, answer)
        return found

    def _judge(self, size: int, candidates: list[np.ndarray], feature: np.ndarray, h: np.ndarray, at: np.ndarray, sequences: list[list[int]], best: dict) -> None:
        """Adds what is found of parts of one size to best: (row, item) to (common, answer, number of the passage, part).

        Windows start between half a part before the passage and half a part before its end."""
        row, number, part = candidates
        width, step = window(size)
        low = np.maximum(0, -(-(number * STEP - size // 2) // step))
        windows = 2 * STEP // step + 1
        place = (at[row] + low * step)[:, None] + np.arange((windows - 1) * step + width)
        inside = place < at[row + 1][:, None]
        masks = self.masks.of(part, np.where(inside, feature[np.minimum(place, len(feature) - 1)], -1))
        pieces = np.bitwise_or.reduce(masks.reshape(len(row), -1, step), axis=2)
        over = np.lib.stride_tricks.sliding_window_view(pieces, width // step, axis=1)
        least = size if size < SHORT else LIKELY * size - 1e-9
        # no window has more of the part in common order than it has of its words
        places = over[:, :, 0].copy()
        for j in range(1, over.shape[2]):
            places |= over[:, :, j]
        k, w = np.nonzero(np.bitwise_count(places) >= least)

        def add(i: int, got: tuple[float, float] | None) -> None:
            key = (int(row[i]), int(self.item[part[i]]))
            if got and (key not in best or got > best[key][:2]):
                best[key] = (float(got[0]), float(got[1]), int(number[i]), int(part[i]))

        whole = np.bincount(self.item)[self.item[part]] == 1
        for i, x in zip(k[~whole[k]].tolist(), w[~whole[k]].tolist(), strict=True):
            sequence = sequences[self.item[part[i]]]
            begin = int(low[i] + x) * step - int(self.begin[part[i]])
            reach, pace = window(len(sequence))
            start = max(0, begin - pace) // pace * pace
            text = h[at[row[i]] + start : min(at[row[i] + 1], at[row[i]] + max(0, begin + pace) + reach)]
            add(i, judged(sequence, text.tolist(), 0, max(0, begin + pace - start) + 1))
        k, w = k[whole[k]], w[whole[k]]
        for a in range(0, len(k), 1 << 14):
            i, x = k[a : a + (1 << 14)], w[a : a + (1 << 14)]
            held = masks[i[:, None], (x * step)[:, None] + np.arange(width)]
            common = _common(held, size)
            hit = np.flatnonzero(common >= least)
            tail = min(ANSWER_WORDS, size)
            answer = _common(held[hit] >> np.uint64(size - tail), tail) / tail
            for y, share in zip(hit.tolist(), answer.tolist(), strict=True):
                if common[y] >= SURE * size or share >= ANSWER:
                    add(int(i[y]), (common[y] / size, share))


def _searches(docs: DataFrame, benchmark: DataFrame) -> list[Search]:
    """One for each VOCABULARY distinct words or PARTS parts of the benchmark, a query set that the driver holds."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").collect()
    texts = []
    for _, _, data, offsets in chunks(pa.array([r[1] for r in rows], pa.string())):
        starts, ends, at = words(data, offsets)
        texts += np.split(Spans(data, FOLDED).hash(starts, ends), at[1:-1])
    passes: list[tuple[list[int], set[int]]] = []
    held = 0
    for i, text in enumerate(texts):
        if len(text):
            own, parts = set(text.tolist()), -(-len(text) // PART)
            held += parts
            if not passes or len(passes[-1][1] | own) > VOCABULARY or held > PARTS:
                passes.append(([], set()))
                held = parts
            passes[-1][0].append(i)
            passes[-1][1].update(own)
    found = []
    for members, own in passes:
        vocabulary = np.array(sorted(own), np.uint64)
        df, n = _frequencies(docs, vocabulary)
        order = np.argsort(-df, kind="stable")
        feature = np.empty(len(order), np.int64)
        feature[order] = np.arange(len(order))
        weight = np.log((n + 1) / (df[order] + 1)) + 0.1
        items = Items([rows[i][0] for i in members], [texts[i] for i in members], vocabulary, feature, weight)
        found.append(Search(items, _space(docs, items)))
    return found


def _searched(batches: Iterator[pa.RecordBatch], searches: list[Search]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, tuple[float, float, float]]]]]:
    ready = [(s, _Lookup(s.items.vocabulary), [t.tolist() for t in s.items.texts]) for s in searches]
    for b in batches:
        found = []
        for search, lookup, sequences in ready:
            found += [(row, search.items.ids[i], x) for (row, i), x in search.batch(b, lookup, sequences).items()]
        yield b, sorted(found)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, common, answer) for each document and benchmark item found in it.

    docs (doc_id, text) against benchmark (item_id, text).  Words fold A-Z.  Document frequencies, passages and the
    decomposition cover all documents.  Passages of 2 * STEP words, one from each STEP on, are compared with the items
    in the latent space; where one covers NEAR of an item, windows of the text about it are judged.  An item is found
    where a window of WIDE fourths of its length has a share ``common`` of its words in its order, of SURE or more, or
    of LIKELY or more with a share ``answer`` of ANSWER or more of its last ANSWER_WORDS words.  An item of fewer than
    SHORT words is found only whole, as so many common words come together by chance.  Items of more than PART words
    are looked for by their parts and judged whole.  The candidate search is not lossless: see README for its recall.

    An item with null item_id, null or empty text, and a document with null or empty text, match nothing.  Rows that
    repeat match each; equal items all match.  A null doc_id is carried along.  Other columns are ignored.  No rows, or
    no items: no rows."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(_searches(docs, benchmark))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _searched(batches, shared.value):
            if found:
                ids = b.column("doc_id").take(pa.array([row for row, _, _ in found]))
                rest = [pa.array([item for _, item, _ in found], pa.int64()), *(pa.array([x[j] for _, _, x in found], pa.float64()) for j in range(3))]
                yield pa.RecordBatch.from_arrays([ids, *rest], ["doc_id", "item_id", "cosine", "common", "answer"])

    return docs.mapInArrow(find, "doc_id long, item_id long, cosine double, common double, answer double")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no benchmark item is found, by the rules of matches().

    Each row is judged by itself, so repeated and null doc_ids need no exception; a null or empty text stays."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_searches(docs, benchmark))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _searched(batches, shared.value):
            stay = np.ones(b.num_rows, bool)
            stay[[row for row, _, _ in found]] = False
            yield b.filter(pa.array(stay))

    return docs.mapInArrow(keep, docs.schema)
