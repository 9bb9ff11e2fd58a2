"""A text that takes many insertions.

The text stands in chunks.  A tree of sums over their lengths (a Fenwick tree)
finds the chunk of a position and notes a longer one in logarithmic time; a chunk
that has grown too long is cut and the tree made anew, which happens once for
every CHUNK characters put in.  So n insertions into a text of m characters cost
O(n (log m + CHUNK)), however long the text.
"""

from __future__ import annotations

#: Characters of a chunk that was cut; it may grow to twice as many.
CHUNK = 2048


class Rope:
    def __init__(self, text: str = ""):
        self._chunks, self.length = self._cut(text) or [""], len(text)
        self._count()

    @staticmethod
    def _cut(text: str) -> list[str]:
        return [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)]

    def _count(self) -> None:
        """The sums: place k has the lengths of as many chunks before it as k's lowest bit says."""
        self._sums = [0, *map(len, self._chunks)]
        for k in range(1, len(self._sums)):
            above = k + (k & -k)
            if above < len(self._sums):
                self._sums[above] += self._sums[k]

    def _find(self, position: int) -> tuple[int, int]:
        """(chunk, position in it); a position between two chunks is the end of the first one."""
        k, step = 0, 1 << (len(self._sums) - 1).bit_length()
        while step:
            if k + step < len(self._sums) and self._sums[k + step] < position:
                k += step
                position -= self._sums[k]
            step >>= 1
        return k, position

    def insert(self, position: int, text: str) -> None:
        if not 0 <= position <= self.length:
            raise IndexError("no such position")
        if not text:
            return
        k, at = self._find(position)
        chunk = self._chunks[k]
        chunk = chunk[:at] + text + chunk[at:]
        self.length += len(text)
        if len(chunk) > 2 * CHUNK:
            self._chunks[k : k + 1] = self._cut(chunk)
            self._count()
            return
        self._chunks[k] = chunk
        k += 1
        while k < len(self._sums):
            self._sums[k] += len(text)
            k += k & -k

    def __len__(self) -> int:
        return self.length

    def __str__(self) -> str:
        return "".join(self._chunks)
