"""Offline stand-ins for a model, for checks, tests and the example: not semantic search.

Their token counters are made up by a fixed rule."""

from __future__ import annotations

import json
import pickle
import tempfile
from collections.abc import Iterator

from corpusflow.operators.context import BASE, CHANGE
from corpusflow.operators.requests import Responder, ResponderError


def _parse_blocks(text: str) -> Iterator[tuple[str, str | None]]:
    """(path, content) of each file block of ``text`` in order; the content of a deletion marker is None."""
    for blk in ("\n\n" + text).split("\n\n--- ")[1:]:
        head, _, body = blk.partition("\n")
        if head.endswith(" [DELETED] ---") and not body:
            yield head[: -len(" [DELETED] ---")], None
            continue
        name = head.rsplit(" (lines 1-", 1)[0]
        if name.endswith(" [UPDATED]"):
            name = name[: -len(" [UPDATED]")]
        yield name, "\n".join(ln.split("\t", 1)[1] if "\t" in ln else "" for ln in body.split("\n"))


class PassageLocator:
    """Finds the query text verbatim in the files of the context and answers
    with the line span of its first occurrence in each file."""

    def open(self, instructions: str) -> PassageSession:
        return PassageSession(instructions)

    def __call__(self, messages: list[dict]) -> dict:
        session = self.open(messages[0]["content"])
        for part, m in enumerate(messages[1:-1], BASE):
            session.feed(part, m["content"])
        return session.ask(messages[-1]["content"])


class PassageSession:
    """The files of a shard in a scratch file, read one at a time for each turn; a block of a path
    replaces its earlier ones. In memory are a block, and the results of a turn."""

    #: Bytes from which the files lie on disk.
    HELD = 1 << 20

    def __init__(self, instructions: str):
        self.spool, self.chars, self.parts = tempfile.SpooledTemporaryFile(self.HELD), len(instructions), {BASE: 0, CHANGE: 0}

    def feed(self, part: int, block: str) -> None:
        before = self.parts[part]
        if block is None:  # a file without a text; what joining the blocks would say
            raise TypeError(f"sequence item {before}: expected str instance, NoneType found")
        self.chars += len(block) + (2 if before else 0)  # blocks of a part are two newlines apart
        self.parts[part] += 1
        self.spool.seek(0, 2)
        for file in _parse_blocks(block):
            pickle.dump(file, self.spool)

    def _files(self) -> Iterator[tuple[str, str | None]]:
        self.spool.seek(0)
        while True:
            try:
                yield pickle.load(self.spool)
            except EOFError:
                return

    def ask(self, turn: str) -> dict:
        query = turn.rsplit("\nQuery: ", 1)[-1]
        found = {}
        for path, content in self._files() if query else ():
            i = -1 if content is None else content.find(query)
            if i >= 0:
                start = content.count("\n", 0, i) + 1
                found[path] = {"file": path, "start_line": start, "end_line": start + query.count("\n")}
            else:
                found.pop(path, None)
        results = [found[path] for path in sorted(found)]
        prompt = (self.chars + len(turn)) // 4
        usage = {"prompt_tokens": prompt, "prompt_cache_hit_tokens": (prompt // 2) // 128 * 128,
                 "prompt_cache_miss_tokens": prompt - (prompt // 2) // 128 * 128,
                 "completion_tokens": 10 + 20 * len(results),
                 "completion_tokens_details": {"reasoning_tokens": 5}}
        return {"arguments": json.dumps({"results": results}), "content": None, "usage": usage}


class FailingResponder:
    """Always fails with a given status (None = no code, retried)."""

    def __init__(self, status: int | None = 400, message: str = "bad request"):
        self.status, self.message = status, message

    def __call__(self, messages):
        raise ResponderError(self.message, self.status)


class FlakyResponder:
    """Fails with 503 on the first ``failures`` calls of each distinct request, then delegates."""

    def __init__(self, inner: Responder, failures: int = 1):
        self.inner, self.failures, self.seen = inner, failures, {}

    def __call__(self, messages):
        key = hash(messages[-1]["content"])
        n = self.seen.get(key, 0)
        self.seen[key] = n + 1
        if n < self.failures:
            raise ResponderError("service unavailable", 503)
        return self.inner(messages)


class RaisingResponder:
    """Raises a given exception on every call."""

    def __init__(self, error: Exception):
        self.error = error

    def __call__(self, messages):
        raise self.error


class FixedResponder:
    """Answers with a given tool text; the prompt counter is the base text's length."""

    def __init__(self, text: str):
        self.text = text

    def __call__(self, messages):
        return {"arguments": self.text, "content": None, "usage": {"prompt_tokens": len(messages[1]["content"])}}


class CountingResponder:
    """A responder with sessions that keep of the blocks only their number and longest size, which
    it reports as prompt and completion tokens. Blocks out of order, or with ``fail_on``, break a session."""

    def __init__(self, fail_on: str | None = None):
        self.fail_on = fail_on

    def open(self, instructions: str):
        return CountingSession(self.fail_on)


class CountingSession:
    def __init__(self, fail_on: str | None):
        self.fail_on, self.n, self.longest, self.last = fail_on, 0, 0, (0, "")

    def feed(self, part: int, block: str) -> None:
        if (part, block) < self.last:
            raise ValueError("blocks out of order")
        if self.fail_on and self.fail_on in block:
            raise ConnectionError("lost")
        self.n, self.longest, self.last = self.n + 1, max(self.longest, len(block)), (part, block)

    def ask(self, turn: str) -> dict:
        return {"arguments": '{"results": []}', "content": None, "usage": {"prompt_tokens": self.n, "completion_tokens": self.longest}}
