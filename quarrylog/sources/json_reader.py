"""A JSON text read a piece at a time: its members and items as they come, none of them held but the one at hand."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import TextIO

#: Characters that are read at once.
CHUNK = 1 << 20
#: What the end of a piece can cut from a number, a literal or an escape.
EDGE = 16
_SPACE = re.compile(r"[ \t\n\r]*")
_decode = json.JSONDecoder().raw_decode


class JsonReader:
    def __init__(self, file: TextIO, chunk: int = CHUNK):
        self.file, self.chunk = file, chunk
        self.text, self.at, self.ended = "", 0, False

    def _more(self) -> None:
        left = self.text[self.at :]
        new = self.file.read(max(self.chunk, len(left)))  # doubled for a long value, which is decoded again
        self.text, self.at, self.ended = left + new, 0, not new

    def _wrong(self, what: str) -> json.JSONDecodeError:
        return json.JSONDecodeError(what, self.text, self.at)

    def peek(self) -> str:
        """The next character that isn't white space; empty at the end."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if self.ended:
                return ""
            self._more()

    def take(self, char: str) -> None:
        if self.peek() != char:
            raise self._wrong(f"Expecting {char!r}")
        self.at += 1

    def value(self) -> object:
        self.peek()
        while True:
            try:
                found, end = _decode(self.text, self.at)
            except json.JSONDecodeError as e:
                if self.ended or not (e.msg.startswith("Unterminated string") or e.pos > len(self.text) - EDGE):
                    raise
            else:
                if self.ended or end <= len(self.text) - EDGE:
                    self.at = end
                    return found
            self._more()

    def _parts(self, ends: str) -> Iterator[None]:
        self.take(ends[0])
        if self.peek() != ends[1]:
            yield
            while self.peek() == ",":
                self.at += 1
                yield
        self.take(ends[1])

    def items(self) -> Iterator[object]:
        """The items of a list."""
        for _ in self._parts("[]"):
            yield self.value()

    def members(self) -> Iterator[str]:
        """The names of an object's members; each one's value is to be read before the next."""
        for _ in self._parts("{}"):
            if self.peek() != '"':
                raise self._wrong("Expecting a name in double quotes")
            name = self.value()
            self.take(":")
            yield name

    def close(self) -> None:
        """Nothing may follow."""
        if self.peek():
            raise self._wrong("Extra data")
