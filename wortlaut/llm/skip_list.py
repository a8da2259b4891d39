"""An indexable skip list: places in a text by the rank of a unit."""

from __future__ import annotations

from collections.abc import Sequence


class SkipList:
    """Units of a text in order, each with its width in code points.

    The lowest lane links every unit to the next.  Every ``fan``-th node of a lane rises to the lane above, where a link
    carries what it skips: its width in units and its width in code points.  ``place`` goes along the highest lane as
    long as a link does not pass the rank, then down a lane, adding up both widths, so it follows fewer than ``fan``
    links per lane and ends exactly at the rank.
    """

    def __init__(self, widths: Sequence[int], fan: int = 16):
        if fan < 2:
            raise ValueError("a lane above needs fewer nodes: fan is 2 at least")
        self.fan = fan
        self.lanes = [([1] * len(widths), list(widths))]
        while len(self.lanes[-1][0]) > fan:
            units, chars = self.lanes[-1]
            starts = range(0, len(units), fan)
            self.lanes.append(([sum(units[i : i + fan]) for i in starts], [sum(chars[i : i + fan]) for i in starts]))

    def __len__(self) -> int:
        return sum(self.lanes[-1][0])

    def place(self, rank: int) -> int:
        """Code points before the unit with this rank (from 0); after the last unit, those of the whole text."""
        if not 0 <= rank <= len(self):
            raise IndexError(rank)
        units = chars = node = 0
        for lane, (skipped, width) in enumerate(reversed(self.lanes)):
            node *= self.fan if lane else 1
            while node < len(skipped) and units + skipped[node] <= rank:
                units += skipped[node]
                chars += width[node]
                node += 1
        return chars
