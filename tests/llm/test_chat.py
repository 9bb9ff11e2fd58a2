import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st
from helpers import prose

from tessera.llm import chat, rans

CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, pack int"


def rows(seed=0):
    rng = random.Random(seed)
    openings = [prose(rng, 12) for _ in range(3)] + ["</s>[INST] ok [/INST]", "a\\b <|end|>\\", "", "é😀\n\n"]
    out = []
    for c in range(60):
        turns, shared = rng.randint(1, 7), rng.random() < 0.7
        for t in range(turns):
            text = openings[c % 5] if t == 0 else openings[(c + t) % 7] if shared and t < 3 else prose(rng, 20)
            out.append((c, t, ["user", "assistant"][t % 2], text, "x", 1))
    out += [(70, 0, "user", None, "x", 1), (70, 1, "assistant", None, None, 1), (71, 5, None, "a", "x", 1), (71, 5, None, "a", "x", 1), (None, 0, "system <|text|>", "s", "x", 1), (72, None, "assistant", "no turn", "x", 1)]
    out += [(200 + c, t, r, x, "x", 1) for c in range(20) for t, r, x in ((0, "user", "same"), (1, "assistant", "same"))]
    rng.shuffle(out)
    return out


def brute(data):
    whole = {}
    for c, t, r, x, *_ in data:
        whole.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    out = []
    for c, turns in whole.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        size = sum(len("".join(chat.pieces(r, x))) for _, r, x in turns)
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out, key=repr)


def test_digests_and_packs(spark):
    data = rows()
    tokenizer = rans.public_tokenizer()
    for pack in (1 << 16, 50):
        packs, members = chat.formatted(spark.createDataFrame(data, CONVERSATIONS), tokenizer=tokenizer, pack=pack)
        assert sorted(map(tuple, chat.digests(packs, members, tokenizer=tokenizer).collect()), key=repr) == brute(data)
        for p in packs.collect():
            nodes, at = p["nodes"], 0
            assert len({bytes(n["key"]) for n in nodes}) == len(nodes)  # shared turns stand once
            for k, n in enumerate(nodes):
                assert n["low"] == at  # depth-first, without gaps
                at = n["high"]
                chain, up = [], n["parent"]
                while up >= 0:
                    assert up < k
                    chain.append(up)
                    up = nodes[up]["parent"]
                assert n["position"] == sum(nodes[u]["high"] - nodes[u]["low"] for u in chain)
                visible = {x for a in n["attends"] for x in range(a["low"], a["high"])}
                assert visible == {x for u in chain for x in range(nodes[u]["low"], nodes[u]["high"])}
            assert at == len(p["ids"])


def test_sharing_saves_tokens(spark):
    data = [(c, t, "user", "a long opening " * 50 if t == 0 else f"question {c}", "x", 1) for c in range(30) for t in range(2)]
    packs, _ = chat.formatted(spark.createDataFrame(data, CONVERSATIONS).coalesce(1), tokenizer=rans.public_tokenizer())
    one = len(chat._tokenizer(rans.public_tokenizer()).encode("a long opening " * 50).ids)
    assert sum(len(p["ids"]) for p in packs.collect()) < 10 * one


def test_none(spark):
    packs, members = chat.formatted(spark.createDataFrame([], CONVERSATIONS), tokenizer=rans.public_tokenizer())
    assert chat.digests(packs, members, tokenizer=rans.public_tokenizer()).count() == 0


@given(st.text() | st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "|", "a", "[", "/"])).map("".join))
def test_escape(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROLS)
