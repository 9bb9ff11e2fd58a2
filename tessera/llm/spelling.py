"""Spelling variants: words at one edit from each other, found through their halves.

A word that differs from another by one inserted, deleted or replaced code point
holds one half of the shorter one (of either, where both are as long) at its
beginning or end.  So every word gives its two segments to shards, a segment to
the shard of its first or last code points; each shard has an Aho-Corasick
automaton over its segments.  All words are scanned by the two shards that their
own first and last code points name.  A segment that was found counts if it
stands at the beginning or end and the lengths fit; then a quarter of the rest
must agree too, since the one edit lies in the other quarter, and the words that
are left are compared code point by code point.

A shard holds a bounded number of segments: there are as many as the words need,
and a key that many words share is cut into slices of its segments and of its
scans, each pair of which is a piece of work of its own.
Tasks send one row for each word they met, not one for each pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, mix, stored, tidy

#: Code points at the beginning or end of a word that name its shards.
KEY = 3
#: Segments of a shard, and of a key before it is cut into slices.
SHARD = 1 << 17
SLICE = 1 << 12
#: Distinct words that a task counts before it sends them.
COUNTED = 1 << 19
#: Pairs that are compared at once.
PAIRS = 1 << 20

_LOWER = bytes(k + 32 if 0x41 <= k <= 0x5A else k for k in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


# --- words --------------------------------------------------------------------


def word_counts(documents: DataFrame, *, shortest: int = 7, least: int = 2, drop: int | None = 31) -> DataFrame:
    """(word, n): the runs of letters of all texts with at least shortest code points and least occurrences.

    With drop, a run whose crc32 of `id:run` it divides loses the code point at crc32 modulo its length.  Runs are
    [A-Za-z\\u00C0-\\u00FF]+ and only A-Z are lower-cased.  A null id counts as ''.
    """
    run = re.compile(f"[a-z\\u00c0-\\u00ff]{{{shortest},}}")

    @tidy
    def count(batches):
        found: dict[str, int] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, data, offsets in chunks(batch.column(1)):
                whole = data.tobytes().translate(_LOWER)
                for k in range(len(offsets) - 1):
                    start = crc32(b"%d:" % ids[low + k] if ids[low + k] is not None else b":")
                    for match in run.finditer(whole[offsets[k] : offsets[k + 1]].decode()):
                        word = match[0]
                        if drop:
                            h = crc32(word.encode(), start)
                            if not h % drop:
                                h %= len(word)
                                word = word[:h] + word[h + 1 :]
                                if len(word) < shortest:
                                    continue
                        found[word] = found.get(word, 0) + 1
                    if len(found) >= COUNTED:
                        yield _counted(found)
                        found = {}
        yield _counted(found)

    words = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _counted(found: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])


# --- a shard ------------------------------------------------------------------


class Words:
    """Words as code points one after another, with the hash of every beginning."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.length) - self.length
        self.points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.rank = np.empty(len(words), dtype=np.int64)  # by code points, as Python compares
        self.rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        most = int(self.length.max(initial=0))
        # beginnings: place start + row + k holds the hash of the first k code points
        self.place = self.start + np.arange(len(words))
        self.hashes = np.zeros(len(self.points) + len(words), dtype=np.uint64)
        live = np.arange(len(words))
        for k in range(most):
            live = live[self.length[live] > k]
            self.hashes[self.place[live] + k + 1] = self.hashes[self.place[live] + k] * _BASE + mix(self.points[self.start[live] + k].astype(np.uint64) + np.uint64(1))

    def part(self, row: np.ndarray, low: np.ndarray, high: np.ndarray, powers: np.ndarray) -> np.ndarray:
        """Hashes of the code points low to high of the words row."""
        return mix(self.hashes[self.place[row] + high] - self.hashes[self.place[row] + low] * powers[high - low])


def _powers(most: int) -> np.ndarray:
    out = np.ones(most + 1, dtype=np.uint64)
    out[1:] = np.cumprod(np.full(most, _BASE))
    return out


def _same(a: Words, x: np.ndarray, b: Words, y: np.ndarray, back: bool) -> np.ndarray:
    """Of words x of a and y of b, how many code points agree from the beginning, or from the end."""
    out = np.zeros(len(x), dtype=np.int64)
    shorter = np.minimum(a.length[x], b.length[y])
    here, there = (a.start[x] + a.length[x] - 1, b.start[y] + b.length[y] - 1) if back else (a.start[x], b.start[y])
    live, k, sign = np.flatnonzero(shorter > 0), 0, -1 if back else 1
    while len(live):
        live = live[a.points[here[live] + sign * k] == b.points[there[live] + sign * k]]
        k += 1
        out[live] = k
        live = live[shorter[live] > k]
    return out


class Shard:
    """An automaton over the segments of some words, kind 0 their first halves and kind 1 their second ones.

    A shard may hold several slices, each for its own scans.
    """

    def __init__(self, words: list[str], n: np.ndarray, kind: np.ndarray, slice_: np.ndarray):
        self.of = Words(words, n)
        self.kind = kind
        length, half = self.of.length, self.of.length // 2
        segments: dict[str, dict[int, int]] = {}  # a number by kind and slice
        own = np.zeros(len(words), dtype=np.int64)
        for row, (word, group) in enumerate(zip(words, (2 * slice_ + kind).tolist(), strict=True)):
            segment = word[len(word) // 2 :] if group & 1 else word[: len(word) // 2]
            own[row] = segments.setdefault(segment, {}).setdefault(group, row)
        self.automaton = ahocorasick.Automaton()
        for segment, numbers in segments.items():
            self.automaton.add_word(segment, (len(segment), numbers))
        if segments:
            self.automaton.make_automaton()
        rows, powers = np.arange(len(words)), _powers(int(length.max(initial=0)) + 1)
        low, high = np.where(kind == 0, half, 0), np.where(kind == 0, length, half)
        middle = low + (high - low) // 2
        first = _key(own, length, kind, 0, self.of.part(rows, low, middle, powers))
        second = _key(own, length, kind, 1, self.of.part(rows, middle, high, powers))
        keys, self.row = np.concatenate([first, second]), np.concatenate([rows, rows])
        order = np.argsort(keys, kind="stable")
        self.keys, self.row, self.quarter = keys[order], self.row[order], order >= len(rows)

    def near(self, words: list[str], n: np.ndarray, kind: np.ndarray, slice_: np.ndarray) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
        """(scanned words, x, y): word x of the scanned and y of the shard's, of its kind and slice, are one edit apart.

        y is shorter, or as long and smaller; each pair that a half of y shows comes once, and of a
        pair that both halves show only the first one gives it.
        """
        scanned = Words(words, n)
        at, segment = [], []
        for k, (word, group) in enumerate(zip(words, (2 * slice_ + kind).tolist(), strict=True) if len(self.automaton) else ()):
            last = len(word) - 1
            for end, (size, numbers) in self.automaton.iter(word):
                if end == (last if group & 1 else size - 1) and group in numbers:
                    at.append(k), segment.append(numbers[group])
        at, segment = np.array(at, np.int64), np.array(segment, np.int64)
        kind = kind[at]
        powers = _powers(int(scanned.length.max(initial=0)) + 1)
        for shorter in (0, 1):  # lengths that fit: as long, and one longer than the shard's word
            length = scanned.length[at] - shorter
            half = length // 2
            fits = half > 0
            for quarter in (0, 1):
                # the quarter of the other half that agrees: its first at the same distance from the beginning, its second from the end
                low, high = np.where(kind == 0, half, 0), np.where(kind == 0, length, half)
                middle = low + (high - low) // 2
                begin, stop = (low, middle) if quarter == 0 else (middle + shorter, high + shorter)
                rows = np.flatnonzero(fits)
                key = _key(segment[rows], length[rows], kind[rows], quarter, scanned.part(at[rows], begin[rows], stop[rows], powers))
                from_, to = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
                some = np.flatnonzero(to > from_)
                many = np.cumsum(to[some] - from_[some])
                done = 0
                while done < len(some):
                    base = int(many[done - 1]) if done else 0
                    end = max(done + 1, int(np.searchsorted(many, base + PAIRS, "right")))
                    take = some[done:end]
                    count = to[take] - from_[take]
                    which = np.repeat(np.arange(len(take)), count)
                    place = np.repeat(from_[take] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                    x, y = at[rows[take]][which], self.row[place]
                    good = self._apart_by_one(scanned, x, y, shorter, quarter, self.kind[y])
                    if good.any():
                        yield scanned, x[good], y[good]
                    done = end

    def _apart_by_one(self, scanned: Words, x: np.ndarray, y: np.ndarray, shorter: int, quarter: int, kind: np.ndarray) -> np.ndarray:
        length, half = self.of.length[y], self.of.length[y] // 2
        front, back = _same(scanned, x, self.of, y, False), _same(scanned, x, self.of, y, True)
        good = (self.of.length[y] == scanned.length[x] - shorter) & (front + back >= length - 1 + shorter)
        if not shorter:
            good &= front < length
            p = np.minimum(front, length - 1)
            good &= self.of.points[self.of.start[y] + p] < scanned.points[scanned.start[x] + p]
        low, high = np.where(kind == 0, half, 0), np.where(kind == 0, length, half)
        good &= (kind == 0) | (front < half)  # else the first half shows the pair
        if quarter:
            good &= front < low + (high - low) // 2  # else the first quarter does
        return good


def _key(segment: np.ndarray, length: np.ndarray, kind: np.ndarray, quarter: int, part: np.ndarray) -> np.ndarray:
    head = mix((segment.astype(np.uint64) << np.uint64(2)) + (kind.astype(np.uint64) << np.uint64(1)) + np.uint64(quarter))
    return mix(mix(head + length.astype(np.uint64)) ^ part)


def _best(row: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, how often it occurs, place of its largest n and then smallest rank) for each distinct row."""
    order = np.lexsort((rank, -n, row))
    first = np.flatnonzero(np.concatenate([[True], row[order][1:] != row[order][:-1]]))
    return row[order][first], np.diff(np.append(first, len(row))), order[first]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: its segments' words come first (role 0), then the words to scan (role 1)."""
    held: list[pa.RecordBatch] = []
    shard = None
    count = best = None
    for batch in batches:
        role = np.asarray(batch.column("role"))
        split = int(np.searchsorted(role, 1))
        if split:
            held.append(batch.slice(0, split))
        if split == len(role):
            continue
        if shard is None:
            own = pa.Table.from_batches(held).combine_chunks() if held else batch.slice(0, 0)
            held = []
            shard = Shard(own.column("word").to_pylist(), *(np.asarray(own.column(c)).astype(np.int64) for c in ("n", "kind", "slice")))
            count, best = np.zeros(len(shard.kind), dtype=np.int64), {}
        rest = batch.slice(split)
        names, (n, kind, slice_) = rest.column("word").to_pylist(), (np.asarray(rest.column(c)).astype(np.int64) for c in ("n", "kind", "slice"))
        pairs = list(shard.near(names, n, kind, slice_))
        if not pairs:
            continue
        scanned, x, y = pairs[0][0], np.concatenate([p[1] for p in pairs]), np.concatenate([p[2] for p in pairs])
        row, many, place = _best(x, shard.of.n[y], shard.of.rank[y])
        yield _rows([names[k] for k in row], many, [shard.of.words[k] for k in y[place]], shard.of.n[y[place]])
        row, many, place = _best(y, scanned.n[x], scanned.rank[x])
        count[row] += many
        for k, p in zip(row.tolist(), x[place].tolist(), strict=True):
            now = (-int(n[p]), names[p])
            if k not in best or now < best[k]:
                best[k] = now
    if shard is not None and best:
        row = sorted(best)
        yield _rows([shard.of.words[k] for k in row], count[row], [best[k][1] for k in row], np.array([-best[k][0] for k in row], dtype=np.int64))


def _rows(word: list[str], many: np.ndarray, near: list[str], n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(many.astype(np.int64)), pa.array(near, pa.string()), pa.array(n.astype(np.int64))], ["word", "n_near", "near", "near_n"])


# --- all words ----------------------------------------------------------------


def near_words(words: DataFrame, *, shortest: int = 7) -> DataFrame:
    """(word, n_near, near, near_n): for each of the distinct words (word, n) that have any, how many others are one edit
    away, and the one with the largest n, then the first by code points.  Words have at least shortest code points."""
    if shortest < 4:
        raise ValueError("halves need two code points at least")
    spark = words.sparkSession
    key = min(KEY, shortest // 2)
    halves = words.select("word", "n", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.substring("word", 1, key).alias("key")), F.struct(F.lit(1).alias("kind"), F.expr(f"right(word, {key})").alias("key")))).alias("h")).select("word", "n", "h.*")
    # keys with more than SLICE words: at most two for each SLICE words
    hot = halves.groupBy("kind", "key").agg(F.count("*").alias("many")).where(F.col("many") > SLICE).select("kind", "key", F.ceil(F.col("many") / SLICE).cast("int").alias("slices"))
    halves = halves.join(F.broadcast(hot), ["kind", "key"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    # each pair of a slice of segments and a slice of scans
    part, every = F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    own = halves.withColumn("role", F.lit(0)).withColumn("other", every).withColumn("slice", part * F.col("slices") + F.col("other"))
    scans = halves.withColumn("role", F.lit(1)).withColumn("other", every).withColumn("slice", F.col("other") * F.col("slices") + part)
    both = own.unionByName(scans).select("role", "kind", "key", "slice", "word", "n")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * words.count() // SHARD))
    dealt = both.repartition(shards, "kind", "key", "slice").sortWithinPartitions("role")
    found = dealt.select("role", "kind", "slice", "word", "n").mapInArrow(tidy(_scan), "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """(word, root) of forms (word, form): forms followed to the last one, at most hops of them.  Each round doubles the reach."""
    reach = 1
    links = forms.select("word", F.col("form").alias("root"))
    while reach < hops:
        links = stored(links, "roots")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        reach *= 2
    return links


def variants(documents: DataFrame, *, shortest: int = 7, least: int = 2, drop: int | None = 31, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word that word_counts gives for documents (doc_id, text).

    form is the near word with the largest n (of equals the first by code points)
    if that n is at least ratio times the word's, else null, as is form_n.  root
    follows forms to the last one and is the word itself without a form.  Null
    and empty texts have no words; repeated rows count as often as they occur;
    empty tables give no rows; other columns are not looked at.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = stored(word_counts(documents, shortest=shortest, least=least, drop=drop), "words")
    near = near_words(words, shortest=shortest)
    is_form = F.col("near_n") >= ratio * F.col("n")
    judged = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    hops = 1
    while least * ratio**hops <= most:  # each form has ratio times the count of what it is the form of
        hops += 1
    found = roots(judged.where("form is not null"), hops)
    return judged.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
