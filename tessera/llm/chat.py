"""Chat formatting into packs of prefix trees.

Conversations that begin with the same turns share them: a node is a turn after
its predecessors, and its tokens stand once in a pack, depth-first.  Each node
carries the position id of its first token (the tokens of its ancestors), the
intervals of the pack that its tokens may attend to besides earlier tokens of
the node itself, and the part of it under the loss mask.

A node's key is a hash chained over the turns.  The keys of a conversation, one
after another, are its path; paths in byte order are a depth-first walk, so
packing is a range sort and one pass.  Equal conversations are one path, and a
tree of any size is cut into packs of about PACK tokens, each of which repeats
only the ancestors it needs.

A turn reads <|turn|>role<|text|>text<|end|>.  In roles and texts a backslash is
doubled and every control string gets a backslash after its first character, so
none is left, and dropping one backslash before each character undoes it.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, tidy

# fixed values
CONTROLS = ["<|turn|>", "<|text|>", "<|end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LOSS_ROLE = "assistant"
#: Tokens after which a pack is closed.
PACK = 1 << 16

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.S)
NODE = "struct<key:binary,parent:int,low:long,body_low:long,body_high:long,high:long,position:long,attends:array<struct<low:long,high:long>>,loss:boolean,ends:boolean>"
PACKS = f"pack long, ids array<int>, nodes array<{NODE}>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def pieces(role: str, text: str) -> tuple[str, str, str]:
    """What stands before a turn's text, the text, and what stands after it."""
    return f"<|turn|>{escape(role)}<|text|>", escape(text), "<|end|>"


def path_of(turns: list[tuple[str, str]]) -> list[bytes]:
    """The chained keys of a conversation's turns."""
    keys, last = [], b""
    for role, text in turns:
        role, text = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
        last = hashlib.blake2b(last + len(role).to_bytes(8, "big") + role + text, digest_size=16).digest()
        keys.append(last)
    return keys


_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


@tidy
def _paths(batches):
    for batch in batches:
        out = []
        for turns in batch.column(1).to_pylist():
            out.append(b"".join(path_of([(t["role"] or "", t["text"] or "") for t in turns])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(1)], ["conv_id", "path", "turns"])


class _Pack:
    def __init__(self):
        self.ids, self.nodes, self.place = [], [], {}

    def add(self, key, parent, texts, loss, encode):
        before, body, after = encode(texts)
        low = len(self.ids)
        self.ids += before + body + after
        attends, position = [], 0
        if parent is not None:
            up = self.nodes[parent]
            position = up["position"] + up["high"] - up["low"]
            attends = [dict(x) for x in up["attends"]]
            if attends and attends[-1]["high"] == up["low"]:
                attends[-1]["high"] = up["high"]
            else:
                attends.append({"low": up["low"], "high": up["high"]})
        self.place[key] = len(self.nodes)
        self.nodes.append({"key": key, "parent": -1 if parent is None else parent, "low": low, "body_low": low + len(before), "body_high": low + len(before) + len(body), "high": len(self.ids), "position": position, "attends": attends, "loss": loss, "ends": False})
        return len(self.nodes) - 1


@tidy
def _pack(batches, tokenizer, most):
    """Packs from rows (path, turns) in the order of path."""
    coder = _tokenizer(tokenizer)
    known: dict[str, list[int]] = {}
    encode = lambda texts: [known[x] for x in texts]
    number, pack = TaskContext.get().partitionId() << 32, _Pack()

    def full():
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack.ids], pa.list_(pa.int32())), pa.array([pack.nodes], _NODES)], ["pack", "ids", "nodes"])

    for batch in batches:
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        # what the batch may need is encoded at once, each text for itself
        wanted = {x for _, turns in rows for turn in turns for x in pieces(turn["role"] or "", turn["text"] or "")}
        texts = list(wanted)
        known = {x: e.ids for x, e in zip(texts, coder.encode_batch_fast(texts, add_special_tokens=False), strict=True)}
        for path, turns in rows:
            if len(pack.ids) >= most:
                yield full()
                number, pack = number + 1, _Pack()
            parent = None
            for k, turn in enumerate(turns):
                key = path[16 * k : 16 * k + 16]
                node = pack.place.get(key)
                if node is None:
                    node = pack.add(key, parent, pieces(turn["role"] or "", turn["text"] or ""), turn["role"] == LOSS_ROLE, encode)
                parent = node
            pack.nodes[parent]["ends"] = True
    if pack.nodes:
        yield full()


_NODES = pa.list_(
    pa.struct([("key", pa.binary()), ("parent", pa.int32()), ("low", pa.int64()), ("body_low", pa.int64()), ("body_high", pa.int64()), ("high", pa.int64()), ("position", pa.int64()), ("attends", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))), ("loss", pa.bool_()), ("ends", pa.bool_())])
)


def formatted(conversations: DataFrame, *, tokenizer: str, pack: int = PACK) -> tuple[DataFrame, DataFrame]:
    """(packs, members): the packs, and (conv_id, key) with the key of each conversation's last node.

    conversations has conv_id, turn, role, text; turns stand in the order of
    (turn, role, text), so ties and repeated rows have one order.  Null roles
    and texts are empty, rows with a null conv_id are one conversation, other
    columns are ignored, and an empty table gives no packs.  A conversation is
    held whole by one task; trees, groups and equal conversations are not.
    """
    turns = conversations.select("conv_id", F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.select(F.col("conv_id").cast("long").alias("conv_id"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    keyed = stored(whole.mapInArrow(_paths, "conv_id long, path binary, turns array<struct<role:string,text:string>>"), "paths")
    once = keyed.groupBy("path").agg(F.first("turns").alias("turns"))
    many = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walk = once.repartitionByRange(many, "path").sortWithinPartitions("path")
    packs = stored(walk.select("path", "turns").mapInArrow(lambda it: _pack(it, tokenizer, pack), PACKS), "packs")
    return packs, keyed.select("conv_id", F.expr("substring(path, length(path) - 15, 16)").alias("key"))


def conversations_of(ids: list[int], nodes: list[dict], decode) -> list[tuple[bytes, list[tuple[str, str, bool]], int]]:
    """(key, turns (role, text, loss), formatted length) of each conversation that ends in a pack, read from its ids.

    decode gives the texts of lists of ids.
    """
    read, out = [], []
    spans = [(n[a], n[b]) for n in nodes for a, b in (("low", "body_low"), ("body_low", "body_high"), ("body_high", "high"))]
    told = decode([ids[a:b] for a, b in spans])
    for k, n in enumerate(nodes):
        before, body, after = told[3 * k : 3 * k + 3]
        role = unescape(before[len("<|turn|>") : -len("<|text|>")])
        read.append((role, unescape(body), n["loss"], len(before) + len(body) + len(after)))
    for k, n in enumerate(nodes):
        if n["ends"]:
            chain, at = [], k
            while at >= 0:
                chain.append(read[at])
                at = nodes[at]["parent"]
            chain.reverse()
            out.append((n["key"], [c[:3] for c in chain], sum(c[3] for c in chain)))
    return out


@tidy
def _digest(batches, tokenizer):
    coder = _tokenizer(tokenizer)
    decode = lambda lists: coder.decode_batch(lists, skip_special_tokens=False)
    for batch in batches:
        for ids, nodes in zip(batch.column(1), batch.column(2), strict=True):
            rows = []
            for key, turns, size in conversations_of(ids.as_py(), nodes.as_py(), decode):
                said = "".join(f"{role}\n{text}\n" for role, text, _ in turns)
                loss = "".join(text for _, text, masked in turns if masked)
                rows.append((key, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(packs: DataFrame, members: DataFrame, *, tokenizer: str) -> DataFrame:
    """Per conversation, read back from the packs: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = packs.mapInArrow(lambda it: _digest(it, tokenizer), "key binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return members.join(read.dropDuplicates(["key"]), "key").drop("key")
