"""Documents as a service over an append-only log of operations, and a small command language for it.

The log is a folder of Parquet files, one for each call; the state of a document
is the fold of its operations since the last checkpoint of all states, which is
made after every EVERY operations and kept beside the log.  A durable log never
drops an update: a reader that falls behind reads on where it was.
"""

from __future__ import annotations

import shlex
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import shared
from tessera.operators import documents
from tessera.schema import EDIT

#: Operations after which the states of all documents are written down.
EVERY = 256

class Refused(Exception):
    """An operation that changes nothing; its argument is the status."""


class DocumentStore:
    """create, get, edit, subscribe and listing over a log in a folder.  One writer; any number of readers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.createDataFrame([], EDIT).coalesce(1).write.mode("append").parquet(folder)
        self._next = (self.log().agg(F.max("seq")).first()[0] or 0) + 1

    def log(self, name: str | None = None) -> DataFrame:
        ops = self.spark.read.schema(EDIT).parquet(self.folder)
        return ops if name is None else documents.named(ops).where(F.col("name") == name)

    def _checkpoint(self) -> tuple[int, DataFrame | None]:
        """(last operation, states) of the newest checkpoint."""
        there = [n for n in shared.names(self.spark, f"{self.folder}/_states") if n.endswith(".json")]
        if not there:
            return 0, None
        upto = shared.read_json(self.spark, f"{self.folder}/_states/{there[-1]}")["upto"]
        return upto, self.spark.read.schema("name string, content string, version long").parquet(f"{self.folder}/_states/upto={upto}")

    def checkpoint(self) -> int:
        """Writes the states of all documents down and returns the last operation in them."""
        upto = self._next - 1
        self.states().write.mode("overwrite").parquet(f"{self.folder}/_states/upto={upto}")
        shared.create_json(self.spark, f"{self.folder}/_states/{upto:015d}.json", {"upto": upto})
        return upto

    def states(self, name: str | None = None) -> DataFrame:
        """(name, content, version) of the documents, or of one: what the checkpoint has and the operations since."""
        upto, since = self._checkpoint()
        if since is not None and name is not None:
            since = since.where(F.col("name") == name)
        return documents.final_state(self.log(name).where(F.col("seq") > upto), since)

    def _apply(self, op: str, name: str, position: int | None, text: str, by: int) -> tuple[str, int]:
        """(content, version) after the operation, or Refused; refused operations are logged too."""
        own = documents.plain_name(name) if op == "create" else name
        found = [tuple(r) for r in self.states(own).select("content", "version").collect()] if own else []
        state, status = documents.step(found[0] if found else None, op, name, position, text)
        self.spark.createDataFrame([(self._next, op, name, position, text, by)], EDIT).coalesce(1).write.mode("append").parquet(self.folder)
        self._next += 1
        if self._next % EVERY == 0:
            self.checkpoint()
        if status not in documents.ACCEPTED:
            raise Refused(status)
        return state

    def create(self, name: str, content: str = "", by: int = 0) -> int:
        return self._apply("create", name, None, content, by)[1]

    def edit(self, name: str, position: int, text: str, by: int = 0) -> tuple[str, int]:
        return self._apply("insert", name, position, text, by)

    def get(self, name: str) -> tuple[str, int]:
        found = self.states(name).collect()
        if not found:
            raise Refused("NOT_FOUND")
        return found[0]["content"], found[0]["version"]

    def listing(self) -> DataFrame:
        return documents.listing(self.states()).orderBy("name")

    def updates(self, name: str, after: int) -> list[tuple[int, str]]:
        """(version, content) of the versions above `after`, in order."""
        rows = documents.history(self.log(name)).where(F.col("version") > after).orderBy("version").collect()
        return [(r["version"], r["content"]) for r in rows]

    def subscribe(self, name: str, polls: int | None = None, pause: float = 1.0) -> Iterator[tuple[int, str]]:
        """The document as it is, then each later version in order; ends after so many polls, or never."""
        content, version = self.get(name)
        yield version, content
        while polls is None or polls > 0:
            for version, content in self.updates(name, version):
                yield version, content
            polls = None if polls is None else polls - 1
            if polls is None or polls > 0:
                time.sleep(pause)


#: Other words for a command; fixed values.
ALIASES = {"new": "create", "use": "open", "insert": "edit", "cat": "show", "get": "show", "ls": "list", "sub": "subscribe", "unsub": "unsubscribe", "exit": "quit", "q": "quit", "?": "help", "info": "status", "cls": "clear", "1": "create", "2": "open", "3": "edit", "4": "subscribe", "5": "quit"}


class Interpreter:
    """Lines such as `create d "Hello"`, `open d`, `edit 5 " world"`, `edit d 0 x`, `show`, `list`, `subscribe`, `status`, `quit`."""

    def __init__(self, store: DocumentStore, by: int = 0):
        self.store, self.by = store, by
        self.active: str | None = None
        self.seen: dict[str, int] = {}
        self.counts = {"commands": 0, "edits": 0, "updates": 0, "refused": 0}

    def run(self, lines) -> list[str]:
        """Output of all lines, up to quit."""
        out = []
        for line in lines:
            said = self.line(line)
            if said is None:
                break
            out += said
        return out

    def line(self, line: str) -> list[str] | None:
        """Output of a line; None for quit."""
        try:
            words = shlex.split(line, comments=True)
        except ValueError as e:  # an open quotation
            return [str(e)]
        if not words:
            return []
        command, args = words[0].lower(), words[1:]
        command = ALIASES.get(command, command)
        if command == "quit":
            return None
        self.counts["commands"] += 1
        run = getattr(self, f"_{command}", None) if command.isalpha() else None
        if command not in COMMANDS or run is None:
            return [f"unknown command {command}"]
        try:
            return run(*args)
        except Refused as e:
            self.counts["refused"] += 1
            return [str(e)]
        except (TypeError, ValueError):
            return [f"usage: {COMMANDS[command]}"]

    def _name(self, name: str | None) -> str:
        if name is None and self.active is None:
            raise Refused("no document is open")
        return name or self.active

    def _create(self, name: str, content: str = "") -> list[str]:
        version = self.store.create(name, content, self.by)
        self.active = documents.plain_name(name)
        return [f"{self.active} v{version}"]

    def _open(self, name: str | None = None) -> list[str]:
        name = self._name(name)
        _, version = self.store.get(name)
        self.active = name
        return [f"{name} v{version}"]

    def _edit(self, *args: str) -> list[str]:
        name, (position, text) = (self._name(None), args) if len(args) == 2 else (args[0], args[1:])
        _, version = self.store.edit(name, int(position), text, self.by)
        self.counts["edits"] += 1
        return [f"{name} v{version}"]

    def _show(self, name: str | None = None) -> list[str]:
        content, version = self.store.get(self._name(name))
        return [f"{self._name(name)} v{version}: {content}"]

    def _list(self) -> list[str]:
        return [f"{r['name']} v{r['version']} {r['length']}" + " subscribed" * (r["name"] in self.seen) for r in self.store.listing().collect()]

    def _subscribe(self, name: str | None = None) -> list[str]:
        name = self._name(name)
        content, self.seen[name] = self.store.get(name)
        return [f"{name} v{self.seen[name]}: {content}"]

    def _unsubscribe(self, name: str | None = None) -> list[str]:
        self.seen.pop(self._name(name), None)
        return []

    def _poll(self) -> list[str]:
        """What has come to the subscribed documents; a version is told once."""
        out = []
        for name, seen in list(self.seen.items()):
            for version, content in self.store.updates(name, seen):
                self.seen[name] = version
                self.counts["updates"] += 1
                out.append(f"{name} v{version}: {content}")
        return out

    def _help(self) -> list[str]:
        return list(COMMANDS.values())

    def _clear(self) -> list[str]:
        """A blank line; there is no screen."""
        return [""]

    def _status(self) -> list[str]:
        return [" ".join(f"{k} {v}" for k, v in self.counts.items())]


COMMANDS = {
    "create": "create NAME [TEXT]", "open": "open NAME", "edit": "edit [NAME] POSITION TEXT", "show": "show [NAME]", "list": "list",
    "subscribe": "subscribe [NAME]", "unsubscribe": "unsubscribe [NAME]", "poll": "poll", "status": "status", "help": "help", "clear": "clear",
}
