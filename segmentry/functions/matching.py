"""Matching blocks of two sequences: the longest common run, then the same to its left and right.

The longest run is found by a suffix automaton of the second sequence, in time that follows the lengths and not the number
of equal pairs; in strings without popular characters pieces of the first are looked for in the second before, which is less
work as long as they lie in few places. Of several longest runs the one that begins first in the first sequence counts, then in the second. With
``popular`` set, elements that make up more than a hundredth of a second sequence of 200 elements or more begin no run;
a run is then extended over any equal neighbours.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Sequence


def _longest(a: Sequence[Hashable], b: Sequence[Hashable], common: set, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """(begin in a, begin in b, length) of the longest run without ``common`` elements."""
    # states of the automaton: transitions, suffix link, longest length, first end
    step: list[dict] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for j in range(blo, bhi):
        c = b[j]
        if c in common:
            # nothing runs across it: the next run begins anew
            last = 0
            continue
        now = step[last].get(c)
        if now is not None and size[now] == size[last] + 1:
            last = now
            continue
        if now is not None:
            copy = len(step)
            step.append(dict(step[now]))
            link.append(link[now])
            size.append(size[last] + 1)
            first.append(first[now])
            link[now] = copy
            p = last
            while p >= 0 and step[p].get(c) == now:
                step[p][c] = copy
                p = link[p]
            last = copy
            continue
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        first.append(j)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            at = step[p][c]
            if size[at] == size[p] + 1:
                link[new] = at
            else:
                copy = len(step)
                step.append(dict(step[at]))
                link.append(link[at])
                size.append(size[p] + 1)
                first.append(first[at])
                link[at] = link[new] = copy
                while p >= 0 and step[p].get(c) == at:
                    step[p][c] = copy
                    p = link[p]
        last = new
    best = (alo, blo, 0)
    state = length = 0
    for i in range(alo, ahi):
        c = a[i]
        while state and c not in step[state]:
            state = link[state]
            length = size[state]
        if c in step[state]:
            state = step[state][c]
            length += 1
            if length > best[2]:
                best = (i - length + 1, first[state] - length + 1, length)
        else:
            length = 0
    return best


def _same(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters from two places on are equal, ``most`` at most."""
    n, step, growing = 0, 16, True
    while n < most:
        s = min(step, most - n)
        if a[i + n : i + n + s] == b[j + n : j + n + s]:
            n += s
            step = step * 2 if growing else max(1, step // 2)
        elif s == 1:
            break
        else:
            step, growing = s // 2, False
    return n


def _same_before(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters before two places are equal, ``most`` at most."""
    n, step, growing = 0, 16, True
    while n < most:
        s = min(step, most - n)
        if a[i - n - s : i - n] == b[j - n - s : j - n]:
            n += s
            step = step * 2 if growing else max(1, step // 2)
        elif s == 1:
            break
        else:
            step, growing = s // 2, False
    return n


def _longest_text(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int] | None:
    """As ``_longest`` of two strings; none if pieces lie in so many places that the automaton is less work.

    A run of 2m - 1 characters holds one of the pieces of m characters into which the first string is cut, so pieces are
    halved until the longest run that they are part of has as many.
    """
    left = 64 + (ahi - alo + bhi - blo) // 8
    m = (min(ahi - alo, bhi - blo) + 1) // 2
    best = (alo, blo, 0)
    while m:
        best = (alo, blo, 0)
        for k in range(alo, ahi - m + 1, m):
            piece = a[k : k + m]
            left -= 1
            j = b.find(piece, blo, bhi)
            while j >= 0:
                left -= 1
                if left < 0:
                    return None
                if not (j - k == best[1] - best[0] and best[0] <= k < best[0] + best[2]):
                    before = _same_before(a, k, b, j, min(k - alo, j - blo))
                    n = before + m + _same(a, k + m, b, j + m, min(ahi - k, bhi - j) - m)
                    if n > best[2] or n == best[2] and (k - before, j - before) < best[:2]:
                        best = (k - before, j - before, n)
                j = b.find(piece, j + 1, bhi)
        if best[2] >= 2 * m - 1:
            break
        m = (best[2] + 1) // 2 if best[2] else m // 2
    return best


def matching_blocks(a: Sequence[Hashable], b: Sequence[Hashable], popular: bool = True) -> list[tuple[int, int, int]]:
    """(begin in a, begin in b, length) in order; neighbouring blocks are joined."""
    common: set = set()
    if popular and len(b) >= 200:
        common = {x for x, n in Counter(b).items() if n > len(b) // 100 + 1}
    texts = isinstance(a, str) and isinstance(b, str) and not common
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, n = texts and _longest_text(a, b, alo, ahi, blo, bhi) or _longest(a, b, common, alo, ahi, blo, bhi)
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
            n += 1
        if n:
            found.append((i, j, n))
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + n < ahi and j + n < bhi:
                todo.append((i + n, ahi, j + n, bhi))
    joined: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1] = (*joined[-1][:2], joined[-1][2] + n)
        else:
            joined.append((i, j, n))
    return joined


def edits(a: Sequence[Hashable], b: Sequence[Hashable], popular: bool = True) -> list[tuple[bool, int, int, int, int]]:
    """(equal, a begin, a end, b begin, b end) covering both sequences in order."""
    out, i, j = [], 0, 0
    for bi, bj, n in [*matching_blocks(a, b, popular), (len(a), len(b), 0)]:
        if i < bi or j < bj:
            out.append((False, i, bi, j, bj))
        if n:
            out.append((True, bi, bi + n, bj, bj + n))
        i, j = bi + n, bj + n
    return out


def similarity(a: Sequence[Hashable], b: Sequence[Hashable], popular: bool = True) -> float:
    """Twice the matched elements over all elements; 1 for two empty sequences."""
    return 2 * sum(n for _, _, n in matching_blocks(a, b, popular)) / (len(a) + len(b)) if len(a) + len(b) else 1.0


def marked_words(a: str | None, b: str | None, begin: str = "<mark>", end: str = "</mark>") -> tuple[str, str]:
    """Both texts as HTML with the words in which they differ between marks, joined by blanks."""
    words = [(t or "").split() for t in (a, b)]
    out: tuple[list[str], list[str]] = ([], [])
    for equal, *bounds in edits(*words):
        for k in (0, 1):
            part = " ".join(words[k][bounds[2 * k] : bounds[2 * k + 1]])
            if bounds[2 * k] < bounds[2 * k + 1]:
                shown = part.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
                out[k].append(shown if equal else f"{begin}{shown}{end}")
    return " ".join(out[0]), " ".join(out[1])
