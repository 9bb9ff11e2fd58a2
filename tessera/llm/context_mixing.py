"""Language-model scoring by online logistic context mixing.

A text is a sequence of words (A-Z lower-cased) and an end.  The most frequent
words are leaves of one Huffman tree; the end is a leaf, and so is each class of
the other words (a hash of a word's first two bytes).  A word is thus a path of
bits, and every bit is predicted.  One predictor knows how often each branch was
taken in all training texts; two more know it under a context: the last of the
most frequent words that stands before, and the endings of the two words before,
hashed.  A fourth knows the text itself: it moves with every bit of it.  Their log odds are
combined with weights chosen by a gate (how deep the bit lies, and whether a most
frequent word stands just before).  The weights begin as a logistic
regression over all bits of all training texts has them and follow the text:
after each bit they move along the gradient of its coding cost.  The regression
is made from counts: one pass tells how many bits of either kind came with each
gate and log odds, the latter by levels.  An adaptive map from predicted to
observed odds refines the mix.

A word of a class is told apart by its own count among all training texts,
however rare it is, or else spelled: bits of bytes, predicted from the last one,
two, three and four bytes and all bytes of the word so far, which begins with its
class, and mixed in the same way, but with weights that stay.  The counts of the most frequent words are broadcast (at most MAX_WORDS),
those of the others are joined, so what is known of words grows with the texts.
The tables of contexts are of fixed size.  So score is a probability of every
word of the text; white space is not coded.

Texts are scored in lanes of LANE words side by side; each lane begins with the
same weights and its contexts reach back into the lane before.  The lanes of
several chunks of texts, up to MIXED bits, take their steps together, as a step
of few lanes costs nearly as much as one of many.  Memory does not
depend on the length of a text: one of more than AT_ONCE bytes is taken in parts
that begin like a text.

Beside it stands a unigram of words with half a count added.
"""

from __future__ import annotations

import copy
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _IS_WORD, _LOW_BYTES, _LOWER, chunks, hash_spans, mix, released, shared, spans, stored, tidy

#: Words that are leaves, classes of the other words.
TREE_WORDS, CLASSES = (1 << 12) - 65, 64
#: Contexts of each predictor; the context of a beginning is the last.  The most frequent words are contexts.
CONTEXTS, OWN = 512, 511
#: Predictors under a context, all predictors.
HASHED, INPUTS = 2, 4
#: Contexts of a byte in a word: the byte before (at the beginning 256 and the word's class), hashes of two, three and four
#: bytes, and of the word so far.
BYTE_CONTEXTS = (256 + CLASSES, 1 << 13, 1 << 14, 1 << 14, 1 << 14)
#: Words whose counts are broadcast; the others' are joined.
MAX_WORDS = 1 << 20
LANE = 512
#: Bytes of text scored at once.
AT_ONCE = 3 << 20
#: Bytes of words spelled at once.
SPELLED = 1 << 18
#: Bytes of words that are held to be counted before they are spelled.
HELD = 1 << 23
#: Bits of paths that are mixed at once: more make the lanes more, and take 16 bytes each.
MIXED = 13 << 20
#: Bits of paths whose inputs are looked up at once.
LOOKED_UP = 1 << 18
#: Of the stored log odds, steps in one.
STEPS = 12.0
RATE, FOLLOW, REFINE = 0.06, 0.04, 0.02
#: What the mix multiplies its inputs with.
HALVED = math.sqrt(RATE) / 2
#: In units of the refined map's part, what keeps all probabilities at 0.0001 at least.
FLOOR = 1 / (0.3 * 0.9998)
#: Bits of each lane that are laid out for the mix at once.
AHEAD = 32
GATES = 8
#: Nodes from the root on that the fourth predictor tells apart.
FOLLOWED = 1024
CELLS = 24
#: Stored steps of log odds in a level, by which the regression for the first weights counts bits; levels, of which the middle one is 0.
LEVEL, BYTE_LEVEL = 8, 20
LEVELS, BYTE_LEVELS = (2 * round(127 / size) + 1 for size in (LEVEL, BYTE_LEVEL))


class Tree:
    """A Huffman tree: the nodes (numbered from the root, level by level) and bits of each symbol's path."""

    def __init__(self, counts: np.ndarray):
        counts = np.maximum(np.asarray(counts, dtype=float), counts.sum() / (1 << 28) + 1e-3)
        self.symbols = many = len(counts)
        heap = [(c, k) for k, c in enumerate(counts.tolist())]
        heapq.heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[many + len(children)] = (a[1], b[1])
            heapq.heappush(heap, (a[0] + b[0], many + len(children) - 1))
        size = [1] * many
        for node in range(many, many + len(children)):
            size.append(sum(size[c] for c in children[node]))
        level, number = [(heap[0][1], 0, ())], 0
        self.low, self.middle, self.high = (np.zeros(max(0, many - 1), dtype=np.int64) for _ in range(3))
        self.leaf, paths = np.zeros(many, dtype=np.int64), [()] * many
        while level:
            below = []
            for node, first, path in level:
                if node < many:
                    self.leaf[first], paths[node] = node, path
                    continue
                left, right = children[node]
                self.low[number], self.middle[number], self.high[number] = first, first + size[left], first + size[node]
                below += [(left, first, (*path, (number, 0))), (right, first + size[left], (*path, (number, 1)))]
                number += 1
            level = below
        self.length = np.array([len(p) for p in paths], dtype=np.int64)
        most = max(1, int(self.length.max()))
        self.node, self.bit = np.zeros((many, most), dtype=np.int32), np.zeros((many, most), dtype=np.int8)
        for k, path in enumerate(paths):
            for at, (node, bit) in enumerate(path):
                self.node[k, at], self.bit[k, at] = node, bit
        self.gate = np.tile(np.minimum(np.arange(most) // 3, 3).astype(np.int8) * 2, (many, 1))

    def odds(self, counts: np.ndarray) -> np.ndarray:
        """Log odds of every node from rows of counts of symbols, in steps of 1/STEPS."""
        reach = np.zeros((len(counts), self.symbols + 1), dtype=np.float32)
        np.cumsum(counts[:, self.leaf], axis=1, out=reach[:, 1:])
        one, zero = reach[:, self.high] - reach[:, self.middle], reach[:, self.middle] - reach[:, self.low]
        return np.clip(np.rint(np.log((one + 0.4) / (zero + 0.4)) * STEPS), -127, 127).astype(np.int8)


# --- words --------------------------------------------------------------------


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lower-cased bytes, start, end, row, name) of every word; no name is 0."""
    lowered = _LOWER[data]
    start, end, row = spans(lowered, offsets, _IS_WORD[lowered])
    return lowered, start, end, row, np.maximum(hash_spans(lowered, start, end), 1)


def ending(lowered: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The last two bytes of each word."""
    return lowered[end - 1].astype(np.uint64) << np.uint64(8) | np.where(end - start > 1, lowered[end - 2], 0).astype(np.uint64)


def class_of(lowered: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the first two bytes of each word."""
    first = lowered[start].astype(np.uint64) << np.uint64(8) | np.where(end - start > 1, lowered[np.minimum(start + 1, len(lowered) - 1)], 0).astype(np.uint64)
    return (mix(first + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int64)


def parts_of(column: pa.Array):
    """(first row, rows, bytes, offsets, row of each piece, whether a piece ends its row): chunks of texts; a longer one in pieces."""
    for low, data, offsets in chunks(column, AT_ONCE):
        rows = len(offsets) - 1
        if rows > 1 or len(data) <= 2 * AT_ONCE:
            yield low, rows, data, offsets, np.arange(rows), np.ones(rows, dtype=bool)
            continue
        at = 0
        while at < len(data):
            end = at + AT_ONCE
            while end < len(data) and _IS_WORD[data[end]]:
                gap = np.flatnonzero(~_IS_WORD[data[end : end + AT_ONCE]])
                end += int(gap[0]) if len(gap) else min(AT_ONCE, len(data) - end)
            end = min(end, len(data))
            yield low, 1, data[at:end], np.array([0, end - at]), np.zeros(1, dtype=np.int64), np.array([end == len(data)])
            at = end


class Names:
    """Sorted names, found by their first bits."""

    def __init__(self, names: np.ndarray, bits: int):
        self.names, self.shift = np.append(names, np.uint64((1 << 64) - 1)), np.uint64(64 - bits)
        self.first = np.searchsorted(names, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each name is there, its place or any)."""
        at = self.first[(name >> self.shift).astype(np.int64)]
        live = np.flatnonzero(self.names[at] < name)
        while len(live):
            at[live] += 1
            live = live[self.names[at[live]] < name[live]]
        return (self.names[at] == name) & (at < len(self.names) - 1), at


class Vocabulary:
    """The words that are leaves, sorted by name, with their symbols; then the classes, then the end."""

    def __init__(self, names: np.ndarray):
        order = np.argsort(names, kind="stable")
        self.names, self.symbol, self.words = names[order], order.astype(np.int64), len(names)
        self.sorted = Names(self.names, 16)

    @property
    def symbols(self) -> int:
        return self.words + CLASSES + 1

    def sequence(self, words: tuple, rows: int, closes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(symbol, row, contexts by predictor, place of each word, whether a most frequent word stands just before) of the words of rows, an end after each row that closes."""
        lowered, start, end, row, name = words
        last = ending(lowered, start, end)
        known, at = self.sorted.find(name)
        symbol, rare = np.append(self.symbol, 0).take(at), np.flatnonzero(~known)
        symbol[rare] = self.words + class_of(lowered, start[rare], end[rare])
        frequent = known & (symbol < OWN)
        count = np.bincount(row, minlength=rows)
        stops = np.cumsum(closes) - closes
        place = np.arange(len(row)) + stops[row]
        size = count + closes
        total = int(size.sum())
        owner = np.repeat(np.arange(rows), size)
        within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        every = np.full(total, self.symbols - 1, dtype=np.int64)
        every[place] = symbol
        context = np.full((HASHED, total), CONTEXTS - 1, dtype=np.int64)
        endings = np.zeros(total, dtype=np.int64)
        endings[place] = last.astype(np.int64)
        one, two = np.flatnonzero(within > 0), np.flatnonzero(within > 1)
        far = np.zeros(total, dtype=np.int64)
        far[two] = endings[two - 2] >> 8
        hashed = lambda x: (mix(x.astype(np.uint64)) % np.uint64(CONTEXTS - 1)).astype(np.int64)
        context[1, one] = hashed(endings[one - 1] << 8 | far[one])
        # of each place how many most frequent words stand before, and how many before its row
        what, often = symbol[frequent], np.zeros(total, dtype=np.int64)
        often[place[frequent]] = 1
        before = np.cumsum(often) - often
        first = np.repeat(before[np.flatnonzero(within == 0)], size[size > 0])
        some = np.flatnonzero(before > first)
        context[0, some] = what[before[some] - 1]
        just = np.zeros(total, dtype=np.int8)
        just[one] = every[one - 1] < min(OWN, self.words)
        return every, owner, context, place, just


def letters(lowered: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, word, contexts) of the bytes of words, a space after each."""
    size = end - start + 1
    word = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    symbol = np.where(within < np.repeat(size - 1, size), lowered[np.minimum(np.repeat(start, size) + within, max(0, len(lowered) - 1))] if len(lowered) else 0, 32).astype(np.int64)
    kind = np.repeat(256 + class_of(lowered, start, end), size) if len(lowered) else np.zeros(0, dtype=np.int64)
    context = np.empty((len(BYTE_CONTEXTS), len(symbol)), dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(BYTE_CONTEXTS)])
    value = np.zeros(len(symbol), dtype=np.uint64)
    for k in range(1, 5):
        before = kind.copy()
        before[k:] = np.where(within[k:] < k, kind[k:], symbol[:-k])
        value = value * np.uint64(331) + before.astype(np.uint64)
        context[k - 1] = first[k - 1] + (mix(value) % np.uint64(BYTE_CONTEXTS[k - 1]) if k > 1 else value).astype(np.int64)
    # a chain over each word's bytes: sums of scrambled (place, byte), less what stood before the word
    chain = mix((within.astype(np.uint64) << np.uint64(9)) + symbol.astype(np.uint64) + np.uint64(7))
    reach = np.cumsum(chain, dtype=np.uint64) - chain
    sofar = reach - np.repeat(reach[np.cumsum(size) - size], size) + kind.astype(np.uint64)
    context[4] = first[4] + (mix(sofar) % np.uint64(BYTE_CONTEXTS[4])).astype(np.int64)
    return symbol, word, context


# --- gathering ----------------------------------------------------------------


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)


def _counted(name: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, class, count) of the distinct names.

    Values are sorted, many times as fast as places: names, and names whose last bits give way to the class, in the same order."""
    last = np.uint64(CLASSES - 1)
    every, both = np.sort(name), np.sort(name & ~last | kind.astype(np.uint64))
    first, at = _firsts(every), _firsts(both)
    if not np.array_equal(first, at):  # two names that differ in their last bits alone
        order = np.argsort(name)
        every = name[order]
        return every[first], kind[order[first]], np.diff(np.append(first, len(every)))
    return every[first], (both[at] & last).astype(np.int64), np.diff(np.append(first, len(every)))


@tidy
def _words(batches):
    """(key, class, n): counts of words; the end of a text is key 0."""
    for batch in batches:
        names, classes, rows = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], len(batch)
        for _, data, offsets in chunks(batch.column(0), AT_ONCE):
            lowered, start, end, _, name = split(data, offsets)
            names.append(name)
            classes.append(class_of(lowered, start, end))
        name, kind, n = _counted(np.concatenate(names), np.concatenate(classes))
        name, kind, n = np.append(name, np.uint64(0)), np.append(kind, 0), np.append(n, rows)
        yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(kind, pa.int32()), pa.array(n, pa.int64())], ["key", "class", "n"])


#: A row holds the symbols (u2) that came in a context and how often each did (u8).
PACKED = "context int, symbols binary, n binary"


def _packed(counts: np.ndarray, first: int, run: int = 256):
    """Rows of PACKED of a table of counts by context, without the contexts that have none."""
    for low in range(0, len(counts), run):
        part = counts[low : low + run]
        some = np.flatnonzero(part.any(axis=1))
        held = [np.flatnonzero(part[k]) for k in some]
        lists = [h.astype("<u2").tobytes() for h in held], [part[k][h].astype("<u8").tobytes() for k, h in zip(some, held, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(first + low + some, pa.int32()), *(pa.array(x, pa.binary()) for x in lists)], ["context", "symbols", "n"])


@tidy
def _contexts(batches, vocabulary):
    """PACKED counts of a task: symbols by context, then bytes by context of bytes in words that are no leaves."""
    vocabulary = vocabulary.value
    symbols = vocabulary.symbols
    cells, letters_ = np.zeros((HASHED * CONTEXTS, symbols), dtype=np.int32), np.zeros((sum(BYTE_CONTEXTS), 256), dtype=np.int32)
    one = np.int32(1)  # a Python number would take twenty times as long to add
    rare = Rare()

    def spelled():
        for letter, often, of in rare.taken():
            often = often.astype(np.int32)
            for k in range(len(of)):
                np.add.at(letters_.ravel(), of[k] * 256 + letter, often)

    for batch in batches:
        for _, _, data, offsets, row, closes in parts_of(batch.column(0)):
            words = split(data, offsets)
            symbol, _, context, place, _ = vocabulary.sequence(words, len(row), closes)
            for k in range(HASHED):
                np.add.at(cells.ravel(), (k * CONTEXTS + context[k]) * symbols + symbol, one)
            rare.add(words, np.flatnonzero(symbol[place] >= vocabulary.words))
            if rare.full():
                spelled()
    spelled()
    yield from _packed(cells, 0)
    yield from _packed(letters_, len(cells))


@tidy
def _merged(batches, symbols, first=HASHED * CONTEXTS, others=256):
    """PACKED sums of the rows of one partition of contexts; those from first on have others symbols."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for context, some, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if context not in held:
                held[context] = np.zeros(symbols if context < first else others, dtype=np.int64)
            held[context][np.frombuffer(some, "<u2")] += np.frombuffer(n, "<u8").astype(np.int64)
    for context, counts in held.items():
        yield from _packed(counts[None], context)


class Rare:
    """Distinct words that are no leaves and how often each came, held over chunks to be spelled once."""

    def __init__(self):
        self.held: list[tuple] = []

    def add(self, words: tuple, rare: np.ndarray) -> None:
        lowered, start, end, _, name = words
        if len(rare):
            self._hold(lowered, start[rare], end[rare], name[rare], np.ones(len(rare), dtype=np.int64))

    def _hold(self, data, start, end, name, times) -> None:
        order = np.argsort(name)
        first = _firsts(name[order])
        once, times = order[first], np.add.reduceat(times[order], first)
        order = np.argsort(once)
        once, times = once[order], times[order]
        start, end = start[once], end[once]
        edge, one = np.zeros(len(data) + 1, dtype=np.int8), np.int8(1)
        edge[start] += one
        edge[end] -= one
        self.held.append((data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)], end - start, name[once], times))

    def _merge(self) -> None:
        if len(self.held) < 2:
            return
        data, size, name, times = (np.concatenate([x[k] for x in self.held]) for k in range(4))
        self.held.clear()
        end = np.cumsum(size)
        self._hold(data, end - size, end, name, times)

    def full(self) -> bool:
        """Whether more than HELD bytes are there and half as many distinct ones."""
        if sum(len(x[0]) for x in self.held) > HELD:
            self._merge()
        return sum(len(x[0]) for x in self.held) > HELD // 2

    def taken(self):
        """(symbol, how often, contexts) of the bytes of what is held, which is given up, in runs.

        What begins alike is taken once: contexts of a byte are the bytes before it in its word, and the word's first two."""
        if not self.held:
            return
        self._merge()
        data, size, _, times = self.held.pop()
        end = np.cumsum(size)
        begin = np.ndarray((len(data),), dtype="<u8", buffer=np.append(data, np.zeros(8, dtype=np.uint8)), strides=(1,))[end - size]
        begin = (begin & _LOW_BYTES[np.minimum(size, 8)] | np.where(size < 8, np.uint64(32) << np.minimum(8 * size, 56).astype(np.uint64), np.uint64(0))).byteswap()
        order = np.argsort(begin)
        begin, start, end, times = begin[order], (end - size)[order], end[order], times[order]
        # of each word, how many of its first eight bytes the one before has too; a single one does not count
        differ, alike = begin[1:] ^ begin[:-1], np.zeros(len(begin), dtype=np.int64)
        for k in range(8):
            alike[1:] += differ >> np.uint64(56 - 8 * k) == 0
        alike[alike < 2] = 0
        often = np.empty((len(begin), 9), dtype=np.int64)
        for k in range(8):
            first = np.flatnonzero(alike <= k)
            often[first, k] = np.add.reduceat(times, first)
        often[:, 8] = times
        for some in _runs(end - start):
            letter, word, of = letters(data, start[some], end[some])
            within = np.arange(len(word)) - np.repeat(_firsts(word), np.bincount(word))
            every = np.flatnonzero(within >= alike[some][word])
            for k in range(0, len(every), SPELLED):
                new = every[k : k + SPELLED]
                yield letter[new], often[some][word[new], np.minimum(within[new], 8)], of[:, new]


def _runs(size: np.ndarray):
    """Slices of words of about SPELLED bytes together; a longer word alone."""
    reach = np.cumsum(size + 1)
    low = 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(reach, (reach[low - 1] if low else 0) + SPELLED, "right")))
        yield slice(low, high)
        low = high


@tidy
def _odds(batches, trees):
    """(context, odds) of PACKED rows: the log odds of every node."""
    words, bytes_ = trees.value
    for batch in batches:
        out = []
        for context, some, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            tree = words if context < HASHED * CONTEXTS else bytes_
            counts = np.zeros((1, tree.symbols), dtype=np.float32)
            counts[0, np.frombuffer(some, "<u2")] = np.frombuffer(n, "<u8")
            out.append(tree.odds(counts).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["context", "odds"])


# --- the model ----------------------------------------------------------------


class Mixer:
    """Trees, log odds by context and first weights; scores words by their symbols, and spells words."""

    def __init__(self, vocabulary: Vocabulary, tree: Tree, byte_tree: Tree, overall: np.ndarray, odds: np.ndarray, byte_odds: np.ndarray):
        self.vocabulary, self.tree, self.byte_tree = vocabulary, tree, byte_tree
        self.overall, self.odds, self.byte_odds = overall, odds, byte_odds
        self.start = np.tile(np.array([0.3, 0.4, 0.3, 1.0], dtype=np.float32), (GATES, 1))
        self.byte_start = np.array([0.05, 0.1, 0.2, 0.3, 0.35], dtype=np.float32)
        self.signs = np.array([1 << 31, 0], dtype=np.uint32)  # of a bit

    def fit(self, texts: DataFrame) -> None:
        """First weights from all texts(text), each gate by itself; gates without bits keep theirs.

        To the driver comes a count for each gate and levels of the log odds, never a text."""
        given = shared(texts.sparkSession, self)
        counted = texts.mapInArrow(lambda it: _levels(it, given), PACKED).repartition("context")
        first, width, others = GATES * LEVELS, 2 * LEVELS**2, 2 * BYTE_LEVELS**3
        rows = counted.mapInArrow(lambda it: _merged(it, width, first, others), PACKED).toArrow()
        released(given)
        words, bytes_ = np.zeros((first, width)), np.zeros((BYTE_LEVELS**2, others))
        for context, some, n in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
            (words if context < first else bytes_)[context if context < first else context - first, np.frombuffer(some, "<u2")] = np.frombuffer(n, "<u8")
        for g, counts in enumerate(words.reshape(GATES, -1, 2)):
            self.start[g, :-1] = regression(*_weighed(counts, LEVELS, LEVEL, INPUTS - 1), self.start[g, :-1])
        self.byte_start = regression(*_weighed(bytes_.reshape(-1, 2), BYTE_LEVELS, BYTE_LEVEL, len(BYTE_CONTEXTS)), self.byte_start)

    def levelled(self) -> Mixer:
        """The same with the levels of the log odds, counted from 0, in their place."""
        out, every = copy.copy(self), np.roll(np.maximum(np.arange(-128, 128), -127), 128)  # by the byte of each log odds
        level, byte_level = ((np.rint(every / size) + levels // 2).astype(np.int8) for size, levels in ((LEVEL, LEVELS), (BYTE_LEVEL, BYTE_LEVELS)))
        out.overall, out.odds, out.byte_odds = (of.take(x.view(np.uint8)) for of, x in ((level, self.overall), (level, self.odds), (byte_level, self.byte_odds)))
        return out

    def _paths(self, symbol: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in symbol, place in the tree's tables) of the bits of each symbol's path."""
        before = np.cumsum(many) - many
        path = np.repeat((symbol * self.tree.node.shape[1] - before).astype(np.int32), many)
        return np.repeat(np.arange(len(symbol), dtype=np.int32), many), path + np.arange(len(path), dtype=np.int32)

    def _inputs(self, context, just, where, path) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log odds of the first predictors, bit, gate, node) of every bit."""
        node, bit = self.tree.node.ravel().take(path), self.tree.bit.ravel().take(path)
        known = np.empty((len(where), INPUTS - 1), dtype=np.int8)
        known[:, 0] = self.overall.take(node)
        nodes = max(1, self.tree.symbols - 1)
        for k in range(HASHED):
            known[:, 1 + k] = self.odds[k].ravel().take((context[k] * nodes).astype(np.int32).take(where) + node)
        gate = self.tree.gate.ravel().take(path) + just.take(where)
        return known, bit, gate, node

    def score(self, symbol: np.ndarray, row: np.ndarray, context: np.ndarray, just: np.ndarray, rows: int) -> np.ndarray:
        """Natural logarithm of the probability of each row's symbols."""
        known = np.empty((int(self.tree.length[symbol].sum()), INPUTS), dtype=np.float32)
        begin, bits, of = self.lanes(symbol, row, context, just, rows, known)
        return np.bincount(of, self.mixed(known, begin, bits), rows)

    def lanes(self, symbol, row, context, just, rows: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first bit, bits, row) of each lane; known becomes what _mix takes."""
        size = np.bincount(row, minlength=rows)
        lanes_of = -(-size // LANE)
        lanes = int(lanes_of.sum())
        many = self.tree.length[symbol]
        each = np.cumsum(many) - many  # a symbol's first bit
        total = len(known)
        # a lane begins with every LANE-th symbol of a row
        begin = np.repeat(np.cumsum(size) - size, lanes_of) + LANE * (np.arange(lanes) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of))
        begin = each[begin]
        bits = np.diff(np.append(begin, total))
        code = known.view(np.uint32)[:, -1]
        first = np.searchsorted(each, np.arange(0, total, LOOKED_UP)) if total else []
        for low, high in zip(first, [*first[1:], len(symbol)], strict=True):
            some, at = slice(low, high), slice(int(each[low]), int(each[high]) if high < len(symbol) else total)
            odds, bit, gate, node = self._inputs(context[:, some], just[some], *self._paths(symbol[some], many[some]))
            np.multiply(odds, np.float32(HALVED / STEPS), out=known[at, :-1])
            np.minimum(node, FOLLOWED - 1, out=node)
            node <<= 3
            node |= gate
            code[at] = node.view(np.uint32) | self.signs.take(bit)
        return begin, bits, np.repeat(np.arange(rows), lanes_of)

    def mixed(self, known: np.ndarray, begin: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each lane's bits."""
        out = np.zeros(len(bits))
        if len(bits):
            # steps take all lanes' first bits, all second bits, ...; longest lanes first
            by_size = np.argsort(-bits, kind="stable")
            active = np.searchsorted(-bits[by_size], -np.arange(int(bits.max())), "left")
            out[by_size] = self._mix(known, begin[by_size], active)
            out -= bits * math.log(2 * FLOOR)
        return out

    def _mix(self, known, place, active) -> np.ndarray:
        """Natural logarithm of each lane's probabilities, each multiplied with 2 * FLOOR; place is each lane's first in known.

        In place of the fourth input known has a code: the sign is set if the bit is 0, then come node and gate.  A
        probability p stands as 2p - 1 and a bit as 1 or -1, inputs are multiplied with HALVED and weights divided by twice that:
        so half the mixed log odds come out and a weight moves by the miss, 1 or -1 less 2p - 1, times the input."""
        lanes = len(place)
        four = np.tile((self.start / np.float32(2 * HALVED)).view(np.complex128).ravel(), lanes)  # the four weights of a gate, moved as one value
        known = known.view(np.complex128).ravel()
        centre = (np.arange(CELLS) + 0.5) / CELLS * 16 - 8
        refined = np.tile(np.tanh(centre / 2).astype(np.float32), lanes)
        apart = FOLLOWED + 16  # lanes a power of two apart would push each other out of the processor's cache
        follow = np.full(lanes * apart, np.float32(0))
        each = np.arange(lanes, dtype=np.int64)
        gates, cells, slots = each * GATES, each * CELLS, each * apart
        one, least, most, middle, cell_of = (np.float32(x) for x in (1, -3.995, 3.995, CELLS / 2, CELLS / 8))
        learn, refine, kept, own, floor = (np.float32(x) for x in (HALVED * FOLLOW / 2, REFINE, 1 - REFINE, 0.7 / 0.3, FLOOR))
        low, three, seven, ones = np.int32((1 << 31) - 1), np.int32(3), np.int32(7), np.ones(INPUTS, dtype=np.float32)
        out, ahead = np.zeros(lanes), np.arange(AHEAD)
        for first in range(0, len(active), AHEAD):
            running = active[first : first + AHEAD].tolist()
            many = running[0]
            rows = known.take(ahead[: len(running), None] + place[:many], mode="clip")
            place[:many] += AHEAD
            inputs, code = (rows.view(kind).reshape(len(running), many, INPUTS) for kind in (np.float32, np.int32))
            code = code[:, :, -1]
            ys, gate_of, slot_of = np.copysign(one, inputs[:, :, -1]), gates[:many] + (code & seven), slots[:many] + ((code & low) >> three)
            moves, found = ys * refine, np.zeros((len(running), many), dtype=np.float32)
            for k, n in enumerate(running):
                gate, slot, s = gate_of[k, :n], slot_of[k, :n], inputs[k, :n].reshape(-1)
                moved = follow.take(slot)
                s[INPUTS - 1 :: INPUTS] = moved
                w = four.take(gate).view(np.float32)
                half = (s * w).reshape(n, INPUTS) @ ones
                np.minimum(np.maximum(half, least, out=half), most, out=half)
                p = np.tanh(half)
                half *= cell_of
                half += middle
                cell = half.astype(np.int64)
                cell += cells[:n]
                q = refined.take(cell)
                off = ys[k, :n] - p
                p *= own
                np.add(p, q, out=found[k, :n])
                q *= kept
                q += moves[k, :n]
                refined[cell] = q
                for i in range(INPUTS):
                    s[i::INPUTS] *= off
                w += s
                four[gate] = w.view(np.complex128)
                off *= learn
                moved += off
                follow[slot] = moved
            found *= ys
            found += floor
            for k, n in enumerate(running):
                found[k, n:] = 1
            out[:many] += np.log(found).sum(axis=0, dtype=float)
        return out

    def _byte_inputs(self, symbol, word, context) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        many = self.byte_tree.length[symbol]
        where = np.repeat(np.arange(len(symbol), dtype=np.int32), many)
        path = np.repeat((symbol * self.byte_tree.node.shape[1] - (np.cumsum(many) - many)).astype(np.int32), many) + np.arange(len(where), dtype=np.int32)
        node, bit = self.byte_tree.node.ravel().take(path), self.byte_tree.bit.ravel().take(path)
        known, odds = np.empty((len(where), len(context)), dtype=np.int8), self.byte_odds.ravel()
        for k, c in enumerate(context):
            known[:, k] = odds.take((c * self.byte_odds.shape[1]).astype(np.int32).take(where) + node)
        return known, bit, word.take(where)

    def spell(self, lowered: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each word's bytes and its end."""
        out = np.zeros(len(start))
        for some in _runs(end - start):
            symbol, word, context = letters(lowered, start[some], end[some])
            for k in range(0, len(symbol), SPELLED):
                part = slice(k, k + SPELLED)
                known, bit, of = self._byte_inputs(symbol[part], word[part], context[:, part])
                p = 1 / (1 + np.exp(-np.clip((known / np.float32(STEPS)) @ self.byte_start, -7.99, 7.99)))
                out[some] += np.bincount(of, np.log(np.where(bit > 0, p, 1 - p)), len(out[some]))
        return out


@tidy
def _levels(batches, mixer):
    """PACKED counts of a task: of the bits of paths by (gate, levels of the log odds, bit), then of those of spelled bytes by
    (levels, bit)."""
    mixer = mixer.value.levelled()
    vocabulary, length = mixer.vocabulary, mixer.tree.length
    words, bytes_ = np.zeros((GATES * LEVELS, 2 * LEVELS**2), dtype=np.int64), np.zeros((BYTE_LEVELS**2, 2 * BYTE_LEVELS**3), dtype=np.int64)
    one, rare = np.int64(1), Rare()

    def spelled():
        for letter, often, of in rare.taken():
            known, bit, times = mixer._byte_inputs(letter, often, of)
            np.add.at(bytes_.ravel(), _cell(0, known, bit, BYTE_LEVELS), times)

    for batch in batches:
        for _, _, data, offsets, row, closes in parts_of(batch.column(0)):
            said = split(data, offsets)
            symbol, _, context, place, just = vocabulary.sequence(said, len(row), closes)
            many = length[symbol]
            reach = np.cumsum(many)
            cut = np.searchsorted(reach, np.arange(0, int(reach[-1]) + 1, LOOKED_UP)) if len(reach) else [0]
            for low, high in zip(cut, [*cut[1:], len(symbol)], strict=True):
                some = slice(low, high)
                known, bit, gate, _ = mixer._inputs(context[:, some], just[some], *mixer._paths(symbol[some], many[some]))
                np.add.at(words.ravel(), _cell(gate, known, bit, LEVELS), one)
            rare.add(said, np.flatnonzero(symbol[place] >= vocabulary.words))
            if rare.full():
                spelled()
    spelled()
    yield from _packed(words, 0)
    yield from _packed(bytes_, len(words))


def _cell(first, level: np.ndarray, bit: np.ndarray, levels: int) -> np.ndarray:
    """The place of each bit in a table of counts by (first, levels, bit)."""
    out = np.zeros(len(bit), dtype=np.int32) + first
    for k in range(level.shape[1]):
        out *= levels
        out += level[:, k]
    out *= 2
    out += bit
    return out.astype(np.int64)


def _weighed(counts: np.ndarray, levels: int, size: int, inputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log odds, bits that are 1, all bits) of the cells that have any, from counts of (0, 1) by cell."""
    held = np.flatnonzero(counts.any(axis=1))
    at = np.stack(np.unravel_index(held, (levels,) * inputs), axis=1)
    return (at - levels // 2) * size / STEPS, counts[held, 1], counts[held].sum(axis=1)


def regression(x: np.ndarray, ones: np.ndarray, many: np.ndarray, prior: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Weights of log odds x, each with many bits of which ones are 1, by Newton steps, held near prior by a ridge; none below 0."""
    beta = prior.astype(float)
    if not len(x):
        return prior
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (ones - many * p) - 10 * (beta - prior)
        beta = beta + np.linalg.solve((x.T * (many * p * (1 - p))) @ x + 10 * np.eye(len(beta)), slope)
    return np.clip(beta, 0, 2).astype(np.float32)


class Counts:
    """What is known of words: the most frequent ones' counts, and of each class how many training tokens are no leaves."""

    def __init__(self, names, counts, leaves, classes, total, distinct, ends, novel):
        self.leaves = counts[:leaves]  # by symbol
        order = np.argsort(names, kind="stable")
        self.sorted, self.counts = Names(names[order], 20), np.append(counts[order], 0)
        self.classes, self.below, self.novel = np.maximum(classes, 1.0), total + 0.5 * (distinct + 1), novel
        self.total = total
        self.end, self.end_known = math.log10((ends + 0.5) / self.below), int(ends > 0)

    def of(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a word is among the most frequent, its count or 0)."""
        found, at = self.sorted.find(name)
        return found, np.where(found, self.counts[at], 0)


# --- scoring ------------------------------------------------------------------

PARTS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base double, score double, rest array<long>, spelled array<double>, share array<double>"


@tidy
def _score(batches, mixer, counts):
    """A row for each text, with the words whose counts are to be joined: names, log10 of how they are spelled, and what a count is multiplied with."""
    mixer, counts = mixer.value, counts.value
    number = TaskContext.get().partitionId() << 40
    vocabulary = mixer.vocabulary
    known = np.empty((MIXED, INPUTS), dtype=np.float32)
    for batch in batches:
        held: list[tuple] = []
        waiting, filled = [], 0  # chunks whose lanes are to be mixed together, their bits

        def flush(low, rows, held=held, batch=batch):
            sums = [np.concatenate([np.zeros(rows), *(np.bincount(x[0], x[1][:, k], rows) for x in held)]).reshape(-1, rows).sum(axis=0) for k in range(5)]
            owner = np.concatenate([np.zeros(0, dtype=np.int64), *(x[2] for x in held)])
            cut = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
            lists = [np.concatenate([np.zeros(0, dtype=kind), *(x[k] for x in held)]) for k, kind in ((3, np.int64), (4, np.float64), (5, np.float64))]
            tokens, seen, size, base, score = sums
            columns = [
                pa.array(number + np.arange(rows)), batch.column(0)[low : low + rows], batch.column(1)[low : low + rows], *(pa.array(x.astype(np.int64)) for x in (tokens, seen, size)), pa.array(base), pa.array(score / math.log(10)),
                *(pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in lists),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base", "score", "rest", "spelled", "share"])

        def finish(known, held=held, waiting=waiting, flush=flush):
            nonlocal number
            costs = mixer.mixed(known, *(np.concatenate([np.zeros(0, dtype=np.int64), *(x[-1][k] for x in waiting)]) for k in range(2)))
            for low, rows, closed, one, (_, bits, of) in waiting:
                one[1][:, -1] += np.bincount(of, costs[: len(bits)], len(one[0]))
                costs = costs[len(bits) :]
                held.append(one)
                if closed:
                    yield flush(low, rows)
                    number += rows
            waiting.clear()

        for low, rows, data, offsets, row, closes in parts_of(batch.column(2)):
            words = split(data, offsets)
            symbol, owner, context, place, just = vocabulary.sequence(words, len(row), closes)
            bits = int(mixer.tree.length[symbol].sum())
            if filled + bits > len(known):
                yield from finish(known)
                filled = 0
                if max(bits, MIXED) != len(known):  # one chunk may have more
                    known = np.empty((max(bits, MIXED), INPUTS), dtype=np.float32)
            lanes = mixer.lanes(symbol, owner, context, just, len(row), known[filled : filled + bits])
            lowered, start, end, at, name = words
            kind = symbol[place] - vocabulary.words
            common, n = np.ones(len(name), dtype=bool), np.empty(len(name), dtype=np.int64)
            leaf, no_leaf = np.flatnonzero(kind < 0), np.flatnonzero(kind >= 0)
            n[leaf] = counts.leaves[symbol[place[leaf]]]
            common[no_leaf], n[no_leaf] = counts.of(name[no_leaf])
            logs = np.log10((n[common] + 0.5) / counts.below)
            ends = closes.astype(float)
            base = np.bincount(at[common], logs, len(row)) + ends * counts.end
            seen = np.bincount(at[common], minlength=len(row)) + ends * counts.end_known
            told = np.flatnonzero(common & (kind >= 0))
            score = np.bincount(at[told], np.log((1 - counts.novel) * n[told] / counts.classes[kind[told]]), len(row))
            other = np.flatnonzero(~common)
            spelled = mixer.spell(lowered, start[other], end[other]) / math.log(10)
            table = np.stack([np.bincount(at, minlength=len(row)) + ends, seen, np.diff(offsets), base, score], axis=1)
            one = row, table, row[at[other]], name[other].view(np.int64), spelled, (1 - counts.novel) / counts.classes[kind[other]]
            waiting.append((low, rows, bool(closes[-1]), one, (lanes[0] + filled, *lanes[1:])))
            filled += bits
        yield from finish(known)


def trained(texts: DataFrame, fit: DataFrame) -> tuple[Mixer, Counts, DataFrame, int | None]:
    """(mixer, counts, words(key, n), the least count among the broadcast words or None if all are) from texts(text); fit are
    the texts of the regression.  To the driver come MAX_WORDS words and the log odds of a fixed number of contexts."""
    spark = texts.sparkSession
    words = stored(texts.mapInArrow(_words, "key long, class int, n long").groupBy("key", "class").agg(F.sum("n").alias("n")), "words")
    total, distinct = (int(v or 0) for v in words.agg(F.sum("n"), F.count("*")).first())
    every = words.where("key <> 0")
    top = every.orderBy(F.desc("n"), "key").limit(MAX_WORDS).toArrow()
    names, n = top.column("key").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.int64)
    leaves = min(TREE_WORDS, len(names))
    ends = int(words.where("key = 0").agg(F.sum("n")).first()[0] or 0)
    classes, single = np.zeros(CLASSES), 0
    for row in every.groupBy("class").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("single")).collect():
        classes[row["class"]], single = row["n"], single + row["single"]
    np.subtract.at(classes, top.column("class").to_numpy()[:leaves], n[:leaves])
    novel = min(0.5, (single + 1) / (classes.sum() + 2))
    vocabulary = Vocabulary(names[:leaves])
    given = shared(spark, vocabulary)
    counted = texts.mapInArrow(lambda it: _contexts(it, given), PACKED).repartition("context")
    contexts = stored(counted.mapInArrow(lambda it, symbols=vocabulary.symbols: _merged(it, symbols), PACKED), "contexts")
    released(given)
    tree = Tree(np.concatenate([n[:leaves], classes, [ends]]))
    letters_ = np.zeros(256)
    first = HASHED * CONTEXTS
    for row in contexts.where(F.col("context").between(first, first + BYTE_CONTEXTS[0] - 1)).collect():
        letters_[np.frombuffer(row["symbols"], "<u2")] += np.frombuffer(row["n"], "<u8")
    byte_tree = Tree(letters_)
    given = shared(spark, (tree, byte_tree))
    rows = contexts.mapInArrow(lambda it: _odds(it, given), "context int, odds binary").toArrow()
    released(given)
    odds, byte_odds = np.zeros((HASHED * CONTEXTS, max(1, tree.symbols - 1)), dtype=np.int8), np.zeros((sum(BYTE_CONTEXTS), 255), dtype=np.int8)
    for context, value in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
        (odds if context < first else byte_odds)[context if context < first else context - first] = np.frombuffer(value.as_py(), dtype=np.int8)
    overall = tree.odds(np.concatenate([n[:leaves], classes, [ends]])[None].astype(np.float32))[0]
    mixer = Mixer(vocabulary, tree, byte_tree, overall, odds.reshape(HASHED, CONTEXTS, -1), byte_odds)
    mixer.fit(fit)
    counts = Counts(names, n, leaves, classes, total, distinct, ends, novel)
    return mixer, counts, every.select("key", "n"), int(n[-1]) if distinct - (ends > 0) > len(n) else None


def scored(documents: DataFrame, held_out: Column) -> DataFrame:
    """Per row of documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    held_out is a boolean Column over doc_id; nothing is learned from such rows.
    score is log10 of the mix's probability of the text's words, base_score that
    of the word unigram, which gives all unknown words together one small share
    and does not spell them.  A known word has its part of what is left beside the
    share of unknown ones, which alone are spelled; so a score is a little low, by
    the same rule for words whose counts are broadcast and for those joined.  Null and empty texts are one end.
    Repeated rows and null ids are kept, other columns ignored; an empty table
    gives no rows; without training texts all branches are alike at first.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    learned = texts.where(~F.col("held_out"))
    mixer, counts, words, least = trained(learned.select("text"), learned.select("text"))
    below, novel, total = counts.below, counts.novel, counts.total
    given, table = shared(spark, mixer), shared(spark, counts)
    parts = stored(texts.mapInArrow(lambda it: _score(it, given, table), PARTS), "scores")
    released(given, table)
    # words that are not among the most frequent: counted in training at most as often as the least of those, or never
    rest = parts.select("row", F.explode(F.arrays_zip("rest", "spelled", "share")).alias("w")).select("row", F.col("w.rest").alias("key"), F.col("w.spelled").alias("spelled"), F.col("w.share").alias("share"))
    rest = rest.join(words.where(F.col("n") <= least), "key", "left") if least is not None else rest.withColumn("n", F.lit(None).cast("long"))
    count = F.coalesce("n", F.lit(0))
    own = F.when(count > 0, F.log10(count * F.col("share"))).otherwise(math.log10(novel) + F.col("spelled"))
    rest = rest.groupBy("row").agg(F.sum(F.log10((count + 0.5) / F.lit(below))).alias("more"), F.sum((count > 0).cast("long")).alias("more_known"), F.sum(own).alias("own"))
    out = parts.drop("rest", "spelled", "share").join(rest, "row", "left").withColumn("whole", F.col("score") + F.coalesce("own", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), F.col("whole").alias("score"),
        (F.col("whole") * -math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
