import pytest

from tessera.plans.store import DocumentStore, Interpreter, Refused


def test_store_and_commands(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "log"))
    assert store.create(" d ", "Hello World") == 1
    assert store.edit("d", 6, "Distributed ") == ("Hello Distributed World", 2)
    for call, status in ((lambda: store.edit("d", 99, "x"), "OUT_OF_RANGE"), (lambda: store.get("e"), "NOT_FOUND"), (lambda: store.create("  "), "INVALID_ARGUMENT"), (lambda: store.create("d"), "ALREADY_EXISTS")):
        with pytest.raises(Refused, match=status):
            call()
    again = DocumentStore(spark, str(tmp_path / "log"))  # the log is all there is
    feed = again.subscribe("d", polls=1, pause=0)
    assert next(feed) == (2, "Hello Distributed World")
    again.edit("d", 0, "CS")
    assert list(feed) == [(3, "CSHello Distributed World")]
    said = Interpreter(again).run(["# comment", "new e 'a b'", "insert 3 '!'", "edit d 0 x", "subscribe", "edit 0 y", "poll", "poll", "ls", "nonsense", "edit q", "show zz", "status", "exit", "show"])
    assert said == ["e v1", "e v2", "d v4", "e v2: a b!", "e v3", "e v3: ya b!", "d v4 26", "e v3 5 subscribed", "unknown command nonsense", "usage: edit [NAME] POSITION TEXT", "NOT_FOUND", "commands 12 edits 3 updates 1 refused 1"]


def test_checkpoints_and_odd_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.plans.store.EVERY", 4)
    store = DocumentStore(spark, str(tmp_path / "log"))
    assert store.create("\ta\xa0", "x") == 1
    for k in range(6):
        assert store.edit("a", 0, str(k)) == ("".join(map(str, range(k, -1, -1))) + "x", k + 2)
    assert store._checkpoint()[0] == 3 or store._checkpoint()[0] == 7
    again = DocumentStore(spark, str(tmp_path / "log"))
    assert again.get("a") == ("543210x", 7)
    assert again.checkpoint() == 7 and again.get("a") == ("543210x", 7)
    assert again.edit("a", 7, "!") == ("543210x!", 8)
    assert [v for v, _ in again.updates("a", 5)] == [6, 7, 8]
    with pytest.raises(Refused, match="INVALID_ARGUMENT"):
        again.create("\t　")


def test_other_words_and_help(spark, tmp_path):
    said = Interpreter(DocumentStore(spark, str(tmp_path / "log")))
    assert said.run(["1 d hello", "2", "3 5 !", "4", "info", "cls", "edit 'open", "Q", "show"]) == ["d v1", "d v1", "d v2", "d v2: hello!", "commands 5 edits 1 updates 0 refused 0", "", "No closing quotation"]
    assert "edit [NAME] POSITION TEXT" in said.line("?") and said.line("5") is None
