"""Applying a file's hunks, and the lines that one text adds to another. Plain Python, no Spark."""

from __future__ import annotations

import re

_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


class Refused(ValueError):
    """A patch that can't be applied without a guess."""


def unix(text: str) -> str:
    return text.replace("\r\n", "\n")


def hunks(patch: str) -> list[tuple[int, list[str]]]:
    """(old start, lines) of each hunk of one file's patch; '\\' lines stay with their hunk."""
    found: list[tuple[int, list[str]]] = []
    for line in patch.split("\n"):
        if m := _HUNK.match(line):
            found.append((int(m[1]), []))
        elif found and line[:1] in (" ", "+", "-", "\\"):
            found[-1][1].append(line)
        elif found and line:
            break
    return found


def apply(base: str | None, patch: str) -> str:
    """The new text. base None: the file is new. A hunk goes where its old lines stand: at its stated line,
    else at the one other place, at or after the hunk before, where they do; none or several is refused."""
    lines = [] if base is None else base.split("\n")
    ends_open = base is None or not base.endswith("\n")
    if not ends_open:
        lines.pop()
    out, done, open_end = [], 0, None
    for start, body in hunks(patch):
        old = [x[1:] for x in body if x[:1] in " -"]
        new = [x[1:] for x in body if x[:1] in " +"]
        if base is not None and not old:
            raise Refused("ZERO_CONTEXT")
        want = max(start - 1, 0)
        fits = lambda k, old=old: lines[k : k + len(old)] == old
        if not (want >= done and fits(want)):
            places = [k for k in range(done, len(lines) - len(old) + 1) if fits(k)]
            if len(places) != 1:
                raise Refused("NOT_APPLIED")
            want = places[0]
        out += lines[done:want] + new
        done = want + len(old)
        kept = [x for x in body if x[:1] in " +\\"]
        if done >= len(lines) and kept:
            open_end = kept[-1][:1] == "\\"
    if done < len(lines):
        open_end = None
    out += lines[done:]
    open_end = (ends_open and base is not None) if open_end is None else open_end
    return "\n".join(out) + ("" if open_end or not out else "\n")


def added_lines(base: str | None, new: str) -> list[int]:
    """Numbers of the lines of `new` outside a longest common subsequence with `base`: the greedy shortest
    edit script, after the common head and tail are set aside."""
    b = unix(new).split("\n")
    if b and b[-1] == "":
        b.pop()
    if base is None:
        return list(range(1, len(b) + 1))
    a = unix(base).split("\n")
    if a and a[-1] == "":
        a.pop()
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = len(a), len(b)
    reach, downs = {1: 0}, []
    for d in range(n + m + 1):
        ways = bytearray(d + 1)  # of all steps only this is kept: a byte for each diagonal, whether it was reached downwards
        downs.append(ways)
        for i, k in enumerate(range(-d, d + 1, 2)):
            down = k == -d or k != d and reach[k - 1] < reach[k + 1]
            ways[i] = down
            x = reach[k + 1] if down else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                return [head + y + 1 for y in _added(downs, a, b, k)]
    return []


def _added(downs: list[bytearray], a: list[str], b: list[str], k: int) -> list[int]:
    """The lines of b that the steps ending on diagonal k put in: their ways are followed back, then walked again from the start."""
    ways = []
    for d in range(len(downs) - 1, 0, -1):
        down = downs[d][(k + d) // 2]
        ways.append(down)
        k += 1 if down else -1
    out, x, y = [], 0, 0
    for down in [None, *reversed(ways)]:
        if down:
            out.append(y)
            y += 1
        elif down is not None:
            x += 1
        while x < len(a) and y < len(b) and a[x] == b[y]:
            x, y = x + 1, y + 1
    return out
