"""Byte-level BPE as a left-to-right transducer with bounded lookahead, and its decoder as a byte-to-text state machine.

A token sequence is what the merge list makes of a text exactly if every two neighbours are what it makes of the two alone. So the
last token of each prefix is unique, follows from the last tokens of shorter prefixes, and is found by one pass to the
right. What follows can only continue from a prefix end within the longest token; a token on which all those
ends agree is stable and is emitted.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Callable
from dataclasses import dataclass

TOP = 1 << 30
#: Two ids make one number as u * PAIR + v.
PAIR = 1 << 20


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in vocabulary files: printable Latin-1 for itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    for b in range(256):
        if b not in shown:
            letters[chr(0x100 + len(letters) - len(shown))] = b
    return letters


@dataclass
class MergeList:
    """ids: by token bytes, only tokens that encode as themselves; parts and rank: of each token; pair: rank of a merge by its two ids.
    """

    ids: dict[bytes, int]
    text: dict[int, bytes]
    parts: dict[int, tuple[int, int]]
    rank: dict[int, int]
    pair: dict[tuple[int, int], int]
    special: dict[str, int]
    longest: int
    lookahead: int = 0
    ready: Callable | None = None  # what a worker process has made of it

    def __getstate__(self):
        return self.__dict__ | {"ready": None}


def load_merges(path: str) -> MergeList:
    """Read a tokenizers file with a byte-level BPE model; runs on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    by_name = spec["model"]["vocab"]
    text = {i: bytes(letters[c] for c in name) for name, i in by_name.items() if all(c in letters for c in name)}
    parts, rank, pair = {}, {}, {}
    for k, m in enumerate(spec["model"]["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        ab = by_name[a + b]
        pair[by_name[a], by_name[b]] = k
        if ab not in parts:
            parts[ab], rank[ab] = (by_name[a], by_name[b]), k
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    merges = MergeList({}, text, parts, rank, pair, special, 0)
    single = {t: i for i, t in text.items() if len(t) == 1}
    made = {p: i for i, p in parts.items()}
    for i, t in text.items():
        if len(t) == 1 or merge_all([single[bytes([b])] for b in t], pair, made) == [i]:
            merges.ids[t] = i
    merges.longest = max(map(len, merges.ids))
    merges.lookahead = sufficient_lookahead(merges)
    merges.text.update({i: s.encode() for s, i in special.items()})
    return merges


def merge_all(ids: list[int], pair: dict, made: dict) -> list[int]:
    """Plain merging, lowest rank and leftmost first; used to prove single tokens and in tests."""
    ids = list(ids)
    while len(ids) > 1:
        best, at = TOP, -1
        for k in range(len(ids) - 1):
            r = pair.get((ids[k], ids[k + 1]), TOP)
            if r < best and (ids[k], ids[k + 1]) in made:
                best, at = r, k
        if at < 0:
            break
        ids[at:at + 2] = [made[ids[at], ids[at + 1]]]
    return ids


def sufficient_lookahead(merges: MergeList) -> int:
    """Bytes to the right after which a token end can no longer be moved by what follows.

    A merge (u, v) is prevented by what follows only if v is taken first by a merge (v, w) of lower rank, which
    again can be prevented only by one that takes w, of lower rank still, and so on: a chain of merges with falling
    ranks. The longest chain in bytes, over the whole list, plus the token itself bounds the lookahead.
    """
    best: dict[int, int] = {}  # by left part: longest chain over the merges seen so far, lowest ranks first
    reach = 0
    for (u, v), _ in sorted(merges.pair.items(), key=lambda x: x[1]):
        chain = len(merges.text[v]) + best.get(v, 0)
        if chain > best.get(u, 0):
            best[u] = chain
        reach = max(reach, chain)
    return reach + merges.longest


def stays_apart(merges: MergeList, u: int, v: int) -> bool:
    """Whether the merge list, given the bytes of u and v, ends with u and v.

    Along the boundary stand the right spine of u and the left spine of v. Each symbol lives from its own merge to its parent's;
    the boundary falls if two symbols that live at the same time merge before either parent does.
    """
    rank, parts, pair = merges.rank, merges.parts, merges.pair
    left, right = [], []
    node, until = u, TOP
    while True:
        born = rank.get(node, -1)
        left.append((node, born, until))
        if node not in parts:
            break
        node, until = parts[node][1], born
    node, until = v, TOP
    while True:
        born = rank.get(node, -1)
        right.append((node, born, until))
        if node not in parts:
            break
        node, until = parts[node][0], born
    i, j, ok = len(left) - 1, len(right) - 1, True
    while i >= 0 and j >= 0:
        a, _, a_until = left[i]
        b, _, b_until = right[j]
        r = pair.get((a, b), TOP)
        if r < a_until and r <= b_until and r < TOP:
            ok = False
            break
        # at equal ranks the left merge is first
        if a_until <= b_until:
            i -= 1
        else:
            j -= 1
    return ok


class Verdicts(dict):
    """Whether two tokens stay apart, by u * PAIR + v; forgotten altogether when full."""

    def __init__(self, merges: MergeList, limit: int = 1_000_000):
        super().__init__()
        self.merges, self.limit = merges, limit

    def __missing__(self, key: int) -> bool:
        if len(self) >= self.limit:
            self.clear()
        self[key] = ok = stays_apart(self.merges, key // PAIR, key % PAIR)
        return ok


class Transducer:
    """The merge list made ready in a task: an automaton that names, byte by byte, the few tokens that end there."""

    def __init__(self, merges: MergeList):
        import ahocorasick

        self.merges, self.verdicts = merges, Verdicts(merges)
        self.length = {i: len(t) for t, i in merges.ids.items()}
        self.keep = merges.lookahead + merges.longest
        self.automaton = ahocorasick.Automaton()
        for t, i in merges.ids.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t) - 1))
        self.automaton.make_automaton()
        ids = merges.ids
        #: Of a token: the longest token that begins it, or -1.
        self.shorter = {i: next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1) for t, i in ids.items()}

    def extend(self, data: str, ends: list[int], old: int) -> None:
        """Last tokens of the prefixes beyond `old` (bytes as Latin-1 letters); -2 where no sequence that continues ends[0] ends.

        A prefix has one last token only, so the first that stays apart from what stands before it is the one.
        """
        ends += [-2] * (len(data) - old)
        verdicts = self.verdicts
        for last, (t, back) in self.automaton.iter(data, max(0, old - self.merges.longest + 1)):
            if ends[last + 1] == -2:
                u = ends[last - back]
                if u >= 0:
                    if last >= old and verdicts[u * PAIR + t]:
                        ends[last + 1] = t
                elif u == -1:
                    ends[last + 1] = t

    def chain(self, ends: list[int], j: int) -> list[int]:
        """The tokens that lead to prefix j."""
        out, length = [], self.length
        while j > 0:
            t = ends[j]
            if t < 0:
                raise ValueError("the vocabulary lacks a byte")
            out.append(t)
            j -= length[t]
        out.reverse()
        return out

    def longest_first(self, data: str) -> list[int]:
        """Tokens of data: at each place the longest that stays apart from the token before it; a place none can leave is given up.

        A prefix has one sequence only, so a place given up once is given up for good, and the first sequence to reach the end is the one.
        """
        length, shorter, verdicts, iter_long = self.length, self.shorter, self.verdicts, self.automaton.iter_long
        out, at, before, n, dead = [], 0, -1, len(data), set()
        walk = iter_long(data)
        while at < n:
            last, (t, back) = next(walk, (n, (-1, 0)))
            whole = t if last - back == at else -1
            t = whole
            while True:
                while t >= 0 and ((before >= 0 and not verdicts[before * PAIR + t]) or at + length[t] in dead):
                    t = shorter[t]
                if t >= 0:
                    break
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead.add(at)
                t = out.pop()
                at -= length[t]
                before, t, whole = out[-1] if out else -1, shorter[t], -1
            out.append(t)
            at, before = at + length[t], t
            if t != whole:
                walk = iter_long(data, at)
        return out

    def encode(self, data: bytes) -> list[int]:
        """Tokens of one pre-token; one of more bytes than the encoder holds is fed through it."""
        whole = self.merges.ids.get(data)
        if whole is not None:
            return [whole]
        if len(data) <= self.keep:
            return self.longest_first(data.decode("latin-1"))
        stream = StreamEncoder(self)
        return stream.feed(data) + stream.finish()


class StreamEncoder:
    """Tokens of a byte stream, emitted once stable; holds about twice the lookahead and no more."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.data, self.ends = transducer, "", [-1]
        self.keep = transducer.keep

    def feed(self, data: bytes) -> list[int]:
        out = []
        for at in range(0, len(data), self.keep):
            old = len(self.data)
            self.data += data[at:at + self.keep].decode("latin-1")
            self.transducer.extend(self.data, self.ends, old)
            if len(self.data) >= 2 * self.keep:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        """Emit up to the last token end that every possible continuation passes."""
        n, length = len(self.data), self.transducer.length
        at = {j for j in range(n - self.transducer.merges.longest + 1, n + 1) if j >= 0 and self.ends[j] != -2}
        while len(at) > 1:
            j = max(at)
            at.discard(j)
            at.add(j - length[self.ends[j]])
        j = at.pop()
        if j <= 0:
            return []
        out = self.transducer.chain(self.ends, j)
        self.data, self.ends = self.data[j:], self.ends[j:]
        return out

    def finish(self) -> list[int]:
        out = self.transducer.chain(self.ends, len(self.data))
        self.data, self.ends = "", [-1]
        return out


class StreamDecoder:
    """Text of a stream of token bytes; bytes that do not yet make a character wait, and invalid ones become U+FFFD."""

    def __init__(self):
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, raw: bytes) -> str:
        return self.state.decode(raw)

    def finish(self) -> str:
        return self.state.decode(b"", True)
