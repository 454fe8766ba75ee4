"""Where terms stand in a text: an Aho-Corasick automaton with whole-word borders, in time that follows the text and its hits.

Terms are met without regard to case. Of the places where terms stand as whole words the leftmost counts, of those that
begin at one place the longest, and what is taken is not looked into again: the same as an alternation of the terms,
longest first, but the number of terms does not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import ahocorasick

#: Signs that continue a word: letters, digits and low line anywhere, or only those of Western alphabets.
ANY_WORD = re.compile(r"\w")
WESTERN = re.compile(r"[A-Za-z0-9À-ÿ]", re.I)


def lowered(text: str) -> str:
    """Lower case of the same length: signs whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Terms:
    def __init__(self, terms: Iterable[str], border: re.Pattern = ANY_WORD):
        self.border = border
        self.automaton = ahocorasick.Automaton()
        for t in {lowered(t) for t in terms if t}:
            self.automaton.add_word(t, len(t))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __len__(self) -> int:
        return len(self.automaton)

    def everywhere(self, text: str) -> list[tuple[int, int]]:
        """(begin, end) of all whole-word occurrences, overlapping ones too."""
        if not len(self.automaton):
            return []
        out, border = [], self.border.match
        for last, n in self.automaton.iter(lowered(text)):
            begin, end = last - n + 1, last + 1
            if (begin == 0 or not border(text[begin - 1])) and (end == len(text) or not border(text[end])):
                out.append((begin, end))
        return out

    def taken(self, text: str, kept: Iterable[tuple[int, int]] = ()) -> list[tuple[int, int]]:
        """The occurrences that count, in order; none touches a stretch in ``kept`` (in order, apart from one another)."""
        out, at, kept, k = [], 0, list(kept), 0
        for begin, end in sorted(self.everywhere(text), key=lambda x: (x[0], -x[1])):
            while k < len(kept) and kept[k][1] <= begin:
                k += 1
            if begin >= at and not (k < len(kept) and kept[k][0] < end):
                out.append((begin, end))
                at = end
        return out


def replaced(text: str, places: Iterable[tuple[int, int]], new: str | Callable[[str], str]) -> str:
    out, at = [], 0
    for begin, end in places:
        out += [text[at:begin], new if isinstance(new, str) else new(text[begin:end])]
        at = end
    return "".join([*out, text[at:]])
