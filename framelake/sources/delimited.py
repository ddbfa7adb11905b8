"""A recursive-descent grammar for tab-separated records that recovers from errors.

    text    := record (NEWLINE record)* | empty
    record  := field (TAB field)*
    field   := quoted | bare
    quoted  := '"' (any but '"', or '""')* '"'   followed by TAB, NEWLINE or the end
    bare    := (any but TAB and NEWLINE)*        not starting with '"'

A carriage return is data of the field it stands in. A quoted field that has no end, or is followed by
anything else, is a syntax error located by line and column. The parser then resumes at the next record
start, so a broken quote costs the text up to there and never the records behind it. Record starts are
either known (``starts``: rows that are one record each; a newline in them is data) or validated (a line
start that the anchor accepts, by default one of the expected number of tabs behind a number). No quoted
field reaches beyond the next record start: one that would is unterminated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

TAB, QUOTE, NEWLINE = "\t", '"', "\n"


@dataclass
class Record:
    """A parsed record, or the error that ended it; positions count from 1, in known records from their start."""

    line: int
    start: int
    fields: list[str] = field(default_factory=list)
    error: str | None = None
    error_line: int | None = None
    error_column: int | None = None
    lines: int = 1  # from its first line to the next record
    skipped: int = 0  # characters passed over to reach the next record start


class SyntaxFault(Exception):
    def __init__(self, reason: str, at: int) -> None:
        super().__init__(reason)
        self.at = at


class Grammar:
    """One parse of one text; ``width`` is the number of fields an anchor must promise."""

    def __init__(self, text: str, width: int, anchor: Callable[[str], bool] | None = None, starts: Sequence[int] | None = None) -> None:
        self.text, self.width, self.anchor, self.starts = text, width, anchor or self._looks_like_record, starts
        self.turn = 0  # of the known starts
        self.limit = 0  # where the record has to end: one before the next start, or the end of the text
        self.next_anchor = -1

    def records(self) -> Iterator[Record]:
        at, line = 0, 1
        while at < len(self.text) or (at == 0 and not self.text) or (self.starts is not None and self.turn < len(self.starts)):
            self.limit = self._next_start(at) - 1
            found = Record(line, at)
            try:
                end = self.record(at, found)
            except SyntaxFault as fault:
                found.error = str(fault)
                before = self.text[at : fault.at]
                found.error_line = (line if self.starts is None else 1) + before.count(NEWLINE)
                found.error_column = fault.at - (at + before.rfind(NEWLINE) + 1) + 1
                end = self.recover()
                found.skipped = max(0, end - fault.at)
            found.lines = 1 if self.starts is not None else max(1, self.text.count(NEWLINE, at, end) + (end >= len(self.text) and not self.text.endswith(NEWLINE)))
            line += self.text.count(NEWLINE, at, end)
            yield found
            if self.starts is None and end >= len(self.text):
                return
            at = end

    def record(self, at: int, found: Record) -> int:
        """Parse fields up to a newline or the limit; returns the place behind it."""
        end = self._line_end(at)
        if self.text.find(QUOTE, at, end) < 0:  # what the productions give for a line without quotes
            found.fields = self.text[at:end].split(TAB)
            return end + 1
        while True:
            at = self.field(at, found.fields)
            if at >= self.limit:
                return self.limit + 1
            at += 1
            if self.text[at - 1] == NEWLINE and self.starts is None:
                return at

    def field(self, at: int, fields: list[str]) -> int:
        return self.quoted(at, fields) if self.text.startswith(QUOTE, at) and at < self.limit else self.bare(at, fields)

    def bare(self, at: int, fields: list[str]) -> int:
        end = self._line_end(at)
        tab = self.text.find(TAB, at, end)
        end = tab if tab >= 0 else end
        fields.append(self.text[at:end])
        return end

    def quoted(self, at: int, fields: list[str]) -> int:
        pieces, start = [], at + 1
        while True:
            end = self.text.find(QUOTE, start, self.limit)
            if end < 0:
                raise SyntaxFault("unterminated quote", at)
            pieces.append(self.text[start:end])
            if end + 1 >= self.limit or not self.text.startswith(QUOTE, end + 1):
                break
            pieces.append(QUOTE)
            start = end + 2
        if end + 1 < self.limit and self.text[end + 1] != TAB and (self.text[end + 1] != NEWLINE or self.starts is not None):
            raise SyntaxFault("text after quote", end + 1)
        fields.append("".join(pieces))
        return end + 1

    def recover(self) -> int:
        """The next record start."""
        return self.limit + 1

    def _line_end(self, at: int) -> int:
        newline = self.text.find(NEWLINE, at, self.limit) if self.starts is None else -1
        return newline if newline >= 0 else self.limit

    def _next_start(self, at: int) -> int:
        """Where the record after the one at ``at`` starts; one place behind the end where there is none."""
        if self.starts is not None:
            self.turn += 1
            return self.starts[self.turn] if self.turn < len(self.starts) else len(self.text) + 1
        while self.next_anchor <= at:  # each line is looked at once, whatever the number of broken quotes
            newline = self.text.find(NEWLINE, max(at, self.next_anchor))
            if newline < 0:
                self.next_anchor = len(self.text) + 1
                break
            end = self.text.find(NEWLINE, newline + 1)
            self.next_anchor = newline + 1
            if not self.anchor(self.text[newline + 1 : end if end >= 0 else len(self.text)]):
                at = newline + 1
        return self.next_anchor

    def _looks_like_record(self, line: str) -> bool:
        head, tab, _ = line.partition(TAB)
        return bool(tab) and head.isascii() and head.isdigit() and line.count(TAB) >= self.width - 1


def parse_lines(lines: Sequence[str], width: int) -> list[Record]:
    """The records of texts that are one record each, read as one text whose record starts are known."""
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    return list(Grammar(NEWLINE.join(lines), width, starts=starts).records())


def parse_line(line: str, width: int) -> Record:
    """The record of a text that is one record; a newline in it is data."""
    return parse_lines([line], width)[0]
