"""Token ids in blocks of a static range asymmetric numeral system (rANS).

One frequency table, summing to 2^20, is made from the counts of all ids and
shared by all blocks.  A block holds whole consecutive documents and is encoded
alone: id i of a block goes to lane i mod LANES, each lane is a 64-bit rANS state
that gives and takes 32-bit words, and the words of all lanes are interleaved in
the order in which a decoder wants them.  Every CHECKPOINT steps the states and
the place in the words are kept, so the parts of a block decode in parallel, and
each part has a crc32 of its ids.

A block's bytes, all little-endian:
  magic 'RAN1', ids (u64), documents (u32), parts (u32), words (u64),
  parts x (crc32 u32, place in words u64), parts x LANES x state u64,
  words x u32, documents x ids of the document u64.
A file set is a folder of Parquet files that carry blocks, (shard, first, before,
doc_ids, payload), next to a folder `table` with the one row of frequencies and
`shards` with the ids before each shard.  Shards are ranges of doc_id in
ascending order, and so are the blocks in a shard and the documents in a block.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import _IS_WORD, chunks, drop_scratch, hash_spans, released, scratch_path, shared, tidy

LANES = 512
CHECKPOINT = 512
SCALE = 20
#: Ids that a block holds before it is closed; a longer document has a block of its own.
BLOCK_IDS = 1 << 19
#: Distinct pieces of text a worker remembers before it begins anew.
REMEMBERED = 3 << 19
#: New pieces that are encoded as one text.
JOINED = 256
#: Bytes of a table that a shard is to hold; there are at least as many shards as shuffle partitions.
SHARD_BYTES = 256 << 20
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(0xFFFFFFFF)
_MASK = np.uint64((1 << SCALE) - 1)
_S, _H = np.uint64(SCALE), np.uint64(32)
MAGIC = b"RAN1"


# --- the code -----------------------------------------------------------------


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies with sum 2^20, at least 1 where there is a count."""
    counts = np.asarray(counts, dtype=np.float64)
    out = np.zeros(len(counts), dtype=np.int64)
    some = counts > 0
    if not some.any():
        return out
    if some.sum() > 1 << SCALE:
        raise ValueError("more distinct ids than the table has places")
    out[some] = np.maximum(1, counts[some] / counts.sum() * (1 << SCALE)).astype(np.int64)
    order = np.argsort(-out, kind="stable")
    excess = int(out.sum()) - (1 << SCALE)
    if excess < 0:
        out[order[0]] -= excess
    for k in order:
        if excess <= 0:
            break
        take = min(excess, int(out[k]) // 2)
        out[k] -= take
        excess -= take
    return out


class Table:
    """Frequencies, their running sums, and for the decoder the id of each of the 2^20 places."""

    def __init__(self, frequencies: np.ndarray):
        self.frequencies = np.asarray(frequencies, dtype=np.uint64)
        self.before = np.cumsum(self.frequencies) - self.frequencies
        self._places = None

    def __getstate__(self):
        return self.frequencies

    def __setstate__(self, state):
        self.__init__(state)

    @property
    def places(self) -> np.ndarray:
        if self._places is None:
            self._places = np.repeat(np.arange(len(self.frequencies), dtype=np.uint32), self.frequencies.astype(np.int64))
        return self._places


def encode(ids: np.ndarray, sizes: np.ndarray, table: Table) -> bytes:
    """A block of documents with the given sizes, whose ids stand one after another."""
    steps = -(-len(ids) // LANES)
    parts = -(-steps // CHECKPOINT)
    at = ids.astype(np.int64)
    f, c = table.frequencies[at], table.before[at]
    if (f == 0).any():
        raise ValueError("an id is not in the table")
    most = f << np.uint64(63 - SCALE)
    x = np.full(LANES, _LOW, dtype=np.uint64)
    out, states, places, given = [], [], [], 0
    for step in range(steps - 1, -1, -1):
        low = step * LANES
        fs, cs = f[low : low + LANES], c[low : low + LANES]
        now = x[: len(fs)]
        full = now >= most[low : low + LANES]
        if full.any():
            word = now[full]
            out.append((word & _WORD).astype(np.uint32))
            given += len(word)
            now[full] = word >> _H
        high = now // fs
        x[: len(fs)] = (high << _S) + (now - high * fs) + cs
        if step % CHECKPOINT == 0:
            states.append(x.copy())
            places.append(given)
    crcs = [zlib.crc32(ids[k * CHECKPOINT * LANES : (k + 1) * CHECKPOINT * LANES].astype("<u4").tobytes()) for k in range(parts)]
    head = MAGIC + np.array([len(ids)], "<u8").tobytes() + np.array([len(sizes), parts], "<u4").tobytes() + np.array([given], "<u8").tobytes()
    marks = np.zeros(parts, dtype=[("crc", "<u4"), ("place", "<u8")])
    marks["crc"], marks["place"] = crcs, [given - p for p in reversed(places)]
    body = [head, marks.tobytes(), *(s.astype("<u8").tobytes() for s in reversed(states)), *(w.astype("<u4").tobytes() for w in reversed(out)), np.asarray(sizes).astype("<u8").tobytes()]
    return b"".join(body)


class Block:
    """A block's header; part(k) decodes one part without the others."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block")
        self.ids = int(np.frombuffer(payload, "<u8", 1, 4)[0])
        documents, self.parts = (int(v) for v in np.frombuffer(payload, "<u4", 2, 12))
        words = int(np.frombuffer(payload, "<u8", 1, 20)[0])
        at = 28
        self.marks = np.frombuffer(payload, [("crc", "<u4"), ("place", "<u8")], self.parts, at)
        at += 12 * self.parts
        self.states = np.frombuffer(payload, "<u8", self.parts * LANES, at).reshape(self.parts, LANES)
        at += 8 * self.parts * LANES
        self.words = np.frombuffer(payload, "<u4", words, at)
        self.sizes = np.frombuffer(payload, "<u8", documents, at + 4 * words).astype(np.int64)

    def part(self, k: int, table: Table) -> np.ndarray:
        low, high = k * CHECKPOINT * LANES, min((k + 1) * CHECKPOINT * LANES, self.ids)
        out = np.empty(high - low, dtype=np.uint32)
        x, place = self.states[k].astype(np.uint64), int(self.marks["place"][k])
        places, frequencies, before, words = table.places, table.frequencies, table.before, self.words
        for at in range(0, high - low, LANES):
            many = min(LANES, high - low - at)
            slot = x[:many] & _MASK
            ids = places[slot.astype(np.int64)]
            out[at : at + many] = ids
            now = frequencies[ids] * (x[:many] >> _S) + slot - before[ids]
            wants = now < _LOW
            taken = int(wants.sum())
            if taken:
                now[wants] = now[wants] << _H | words[place : place + taken]
                place += taken
            x[:many] = now
        if zlib.crc32(out.astype("<u4").tobytes()) != int(self.marks["crc"][k]):
            raise ValueError(f"part {k} fails its checksum")
        return out

    def all(self, table: Table) -> np.ndarray:
        """All ids: the whole parts side by side, each from its checkpoint, and then the last one."""
        whole, rest = divmod(self.ids, CHECKPOINT * LANES)
        out = np.empty((whole, CHECKPOINT, LANES), dtype=np.uint32)
        x, place = self.states[:whole].astype(np.uint64), self.marks["place"][:whole].astype(np.int64)
        places, frequencies, before, words = table.places, table.frequencies, table.before, self.words
        for step in range(CHECKPOINT if whole else 0):
            slot = x & _MASK
            ids = places[slot.astype(np.int64)]
            out[:, step] = ids
            x = frequencies[ids] * (x >> _S) + slot - before[ids]
            wants = x < _LOW
            many = wants.sum(axis=1)
            row, lane = np.nonzero(wants)
            first = np.cumsum(many) - many
            x[row, lane] = x[row, lane] << _H | words[place[row] + np.arange(len(row)) - first[row]]
            place += many
        for k in range(whole):
            if zlib.crc32(out[k].astype("<u4").tobytes()) != int(self.marks["crc"][k]):
                raise ValueError(f"part {k} fails its checksum")
        return np.concatenate([out.reshape(-1), *([self.part(whole, table)] if rest else [])])


# --- tokens -------------------------------------------------------------------


class PieceEncoder:
    """A byte-level BPE tokenizer that encodes each distinct piece of text once.

    A piece is white space and what follows it up to the next.  Its pre-tokens
    do not depend on what stands around it, so the ids of a text are those of
    its pieces, and new pieces can be encoded as one text and told apart by the
    bytes that each id stands for.  White space outside ASCII is not a place to
    cut after.  Pieces are remembered by a hash; as the bytes of all ids of a
    text must be the text again, two pieces with one hash are noticed, and such
    a text is encoded alone.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        spelled = [b""] * self.tokenizer.get_vocab_size()
        byte = _byte_of()
        for token, k in self.tokenizer.get_vocab().items():
            # the vocabulary writes each byte as one character, but added tokens as they are
            spelled[k] = token.encode() if k in added else bytes(byte[c] for c in token)
        self.bytes = np.array([len(t) for t in spelled], dtype=np.int64)
        self.spelling, self.spelled_at = np.frombuffer(b"".join(spelled), dtype=np.uint8), np.cumsum(self.bytes) - self.bytes
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.store, self.used = np.zeros(1 << 20, dtype=np.uint32), 0
        self.first, self.many = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encodes new pieces: most as parts of longer texts, those that might run into their neighbours alone."""
        plain = [k for k, p in enumerate(pieces) if not _IS_WORD[p[0]] and 32 < p[-1] < 128]
        alone = sorted(set(range(len(pieces))) - set(plain))
        groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        read = lambda texts: [x.ids for x in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        joined = read([b"".join(pieces[k] for k in group) for group in groups])
        many, told, lists = [], [], []
        for group, ids in zip(groups, joined, strict=True):
            reach = np.cumsum(self.bytes[ids])
            ends = np.cumsum([len(pieces[k]) for k in group])
            cut = np.minimum(np.searchsorted(reach, ends), len(reach) - 1)
            if np.array_equal(reach[cut], ends):
                many.append(np.diff(cut + 1, prepend=0))
                told += group
                lists.append(ids)
            else:  # an id reaches over two pieces
                alone += group
        apart = read([pieces[k] for k in alone])
        many = np.concatenate([np.fromiter(map(len, apart), np.int64, len(apart)), *many])
        ids = np.fromiter(chain(chain.from_iterable(apart), chain.from_iterable(lists)), np.uint32, int(many.sum()))
        n = len(self.keys)
        self.store = _room(self.store, self.used + len(ids))
        self.first, self.many = _room(self.first, n + len(many)), _room(self.many, n + len(many))
        self.store[self.used : self.used + len(ids)] = ids
        self.first[n : n + len(many)] = self.used + np.cumsum(many) - many
        self.many[n : n + len(many)] = many
        self.used += len(ids)
        self.keys = np.concatenate([self.keys, keys[np.array(alone + told, dtype=np.int64)]])
        self.place = np.concatenate([self.place, np.arange(n, n + len(many))])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.place = self.keys[order], self.place[order]

    def _knows(self, key: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(key), dtype=bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, ids of each row)."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(rows, dtype=np.int64)
        black = _IS_WORD[data]
        start = np.flatnonzero(~black[1:] & black[:-1]) + 1
        start = start[~_ends_in_space(data, start)]
        begins = np.zeros(len(data), dtype=bool)
        begins[start] = True
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        key, place = np.unique(hash_spans(data, start, end), return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self.forget()
        new = np.flatnonzero(~self._knows(key))
        if len(new):
            example = np.empty(len(key), dtype=np.int64)
            example[place[::-1]] = np.arange(len(place) - 1, -1, -1)
            raw = data.tobytes()
            self._learn(key[new], [raw[a:b] for a, b in zip(start[example[new]].tolist(), end[example[new]].tolist(), strict=True)])
        index = self.place[np.searchsorted(self.keys, key)][place]
        many = self.many[index]
        reach = np.cumsum(many)
        ids = self.store[np.repeat(self.first[index] - (reach - many), many) + np.arange(int(reach[-1]))]
        row = np.searchsorted(offsets, start, "right") - 1
        if not self._spells(ids, data):
            raw = data.tobytes()
            alone = [self.tokenizer.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            return np.array(list(chain.from_iterable(alone)), dtype=np.uint32), np.array([len(x) for x in alone], dtype=np.int64)
        return ids, np.bincount(row, many, minlength=rows).astype(np.int64)

    def _spells(self, ids: np.ndarray, data: np.ndarray) -> bool:
        """Whether the bytes of ids are data."""
        size = self.bytes[ids]
        reach = np.cumsum(size)
        if reach[-1] != len(data):
            return False
        return np.array_equal(self.spelling[np.repeat((self.spelled_at[ids] - (reach - size)).astype(np.int32), size) + np.arange(len(data), dtype=np.int32)], data)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, and
    those from U+0100 on for the other bytes in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _room(x: np.ndarray, size: int) -> np.ndarray:
    """x with space for at least size values."""
    if size <= len(x):
        return x
    out = np.zeros(max(size, 2 * len(x)), dtype=x.dtype)
    out[: len(x)] = x
    return out


def _ends_in_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before data[at] is white space outside ASCII."""
    a, b, c = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    e2 = (c == 0xE2) & (((b == 0x80) & (((a >= 0x80) & (a <= 0x8A)) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))) | ((b == 0x81) & (a == 0x9F)))
    return two | e2 | ((c == 0xE1) & (b == 0x9A) & (a == 0x80)) | ((c == 0xE3) & (b == 0x80) & (a == 0x80))


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


# --- Spark --------------------------------------------------------------------


@tidy
def _tokenise(batches, path, end_id):
    """(shard, at, before, doc_id, ids, counts) of the rows of a partition that is sorted by doc_id, and one with at = -1, the ids
    of the shard as before, and as counts distinct ids (u32) and how often each came (u64); to read those no ids are read."""
    encoder, shard, at, before = _encoder(path), TaskContext.get().partitionId(), 0, 0
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for low, data, offsets in chunks(batch.column(1)):
            ids, many = encoder.encode(data, offsets)
            rows = len(many)
            reach = np.cumsum(many)
            ids = np.insert(ids, reach, end_id).astype("<u4")
            many = many + 1
            cut = np.concatenate([[0], np.cumsum(many)])
            raw = ids.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, shard, dtype=np.int32)), pa.array(np.arange(at, at + rows)), pa.array(before + cut[:-1]), batch.column(0)[low : low + rows], pa.array([raw[4 * a : 4 * b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.nulls(rows, pa.binary())],
                ["shard", "at", "before", "doc_id", "ids", "counts"],
            )
            at, before = at + rows, before + int(cut[-1])
            some = np.bincount(ids).astype(np.int64)
            if len(some) > len(total):
                total, some = some, total
            total[: len(some)] += some
    if at:
        held = np.flatnonzero(total)
        packed = held.astype("<u4").tobytes() + total[held].astype("<u8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([-1], pa.int64()), pa.array([before], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())], ["shard", "at", "before", "doc_id", "ids", "counts"])


@tidy
def _count(batches):
    """(id, n) from the counts of shards, summed in a task."""
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            many = len(packed) // 12
            ids, n = np.frombuffer(packed, "<u4", many).astype(np.int64), np.frombuffer(packed, "<u8", many, 4 * many).astype(np.int64)
            if many and ids[-1] >= len(total):
                total = np.concatenate([total, np.zeros(int(ids[-1]) + 1 - len(total), dtype=np.int64)])
            total[ids] += n
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["id", "n"])


BLOCKS = "shard int, first long, before long, doc_ids array<long>, payload binary"


@tidy
def _encode(batches, table):
    table = table.value
    held: list[tuple] = []

    def block():
        sizes = np.array([len(r[3]) // 4 for r in held])
        payload = encode(np.frombuffer(b"".join(r[3] for r in held), "<u4"), sizes, table)
        shard, first, before = held[0][0], held[0][1], held[0][2]
        out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([before], pa.int64()), pa.array([[r[4] for r in held]], pa.list_(pa.int64())), pa.array([payload], pa.binary())], ["shard", "first", "before", "doc_ids", "payload"])
        held.clear()
        return out

    size = 0
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(4)]
        for k, (shard, at, before, doc_id) in enumerate(zip(*columns, strict=True)):
            ids = batch.column(4)[k].as_py()
            if held and (held[-1][0] != shard or held[-1][1] + 1 != at or size + len(ids) > 4 * BLOCK_IDS):
                yield block()
                size = 0
            held.append((shard, at, before, ids, doc_id))
            size += len(ids)
    if held:
        yield block()


@tidy
def _decode(batches, table, bases):
    table, bases = table.value, bases.value
    for batch in batches:
        for shard, before, doc_ids, payload in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
            block = Block(payload)
            ids = block.all(table).astype("<u4").tobytes()
            cut = np.concatenate([[0], np.cumsum(block.sizes)])
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(bases[shard] + before + cut[:-1]), pa.array(block.sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(documents: DataFrame, path: str, *, tokenizer: str, end_id: int = 0, shards: int | None = None) -> None:
    """Writes the ids of documents(doc_id, text), end_id after each document, to the folder path.

    Documents are dealt by ranges of doc_id and sorted before they are
    tokenised, so ids are never shuffled.  Null text counts as empty and gives
    end_id alone; null ids come first; rows that repeat an id are each written,
    in the order of their texts; other columns are ignored; an empty table gives
    no blocks.  A text is encoded and coded whole by one task.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    many = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1_000_000, -(-size // SHARD_BYTES)))
    order = F.col("doc_id").asc_nulls_first()
    dealt = texts.repartitionByRange(many, order).sortWithinPartitions(order, F.col("text").asc_nulls_first())
    ids_path = scratch_path(spark, "ids")
    schema = "shard int, at long, before long, doc_id long, ids binary, counts binary"
    dealt.mapInArrow(lambda it: _tokenise(it, tokenizer, end_id), schema).write.option("compression", "zstd").parquet(ids_path)
    ids = spark.read.schema(schema).parquet(ids_path)
    told = ids.where("at = -1")
    counts = told.select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((max(counts.column(0).to_pylist()) + 1) if len(counts) else 1, dtype=np.int64)
    total[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    frequencies = normalised(total)
    per_shard = {r["shard"]: r["before"] for r in told.select("shard", "before").collect()}
    bases, before = [], 0
    for shard in sorted(per_shard):
        bases.append((shard, before))
        before += per_shard[shard]
    spark.createDataFrame([(frequencies.tolist(),)], "frequencies array<long>").coalesce(1).write.parquet(f"{path}/table")
    spark.createDataFrame(bases, "shard int, base long").coalesce(1).write.parquet(f"{path}/shards")
    table = shared(spark, Table(frequencies))
    ids.where("at >= 0").drop("counts").mapInArrow(lambda it: _encode(it, table), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    released(table)
    drop_scratch(spark, ids_path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a folder that write_tokens made: doc_id, start, n_tokens, ids_crc32, all from the decoded blocks.

    The broadcast table is bounded by the vocabulary, the shard bases by the number of shards.
    """
    table = shared(spark, Table(np.array(spark.read.parquet(f"{path}/table").first()["frequencies"])))
    bases = shared(spark, {r["shard"]: r["base"] for r in spark.read.schema("shard int, base long").parquet(f"{path}/shards").collect()})
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return blocks.mapInArrow(lambda it: _decode(it, table, bases), "doc_id long, start long, n_tokens long, ids_crc32 long")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))
