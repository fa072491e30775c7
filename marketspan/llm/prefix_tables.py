"""Last tokens of byte prefixes: the table from which byte-level merges encode.

However a byte string is merged, each of its prefixes has one encoding, and that
is the encoding of a shorter prefix and one last token.  Of the tokens that end
a prefix just one is valid: the one that stays apart from the last token of what
is before it.  A table holds these last tokens; walking it from its end gives
the ids, more bytes only add entries, and a change keeps all entries before it.
"""

from __future__ import annotations

#: Pairs of tokens of which a worker remembers whether they stay apart.
CACHE_PAIRS = 1_000_000


class LastTokens:
    """Tokens are numbered in the order in which merging makes them; 0 to 255 are single bytes."""

    def __init__(self):
        self.bytes_of: list[bytes] = [bytes([b]) for b in range(256)]
        self.number = {b: k for k, b in enumerate(self.bytes_of)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merge: dict[tuple[int, int], int] = {}
        self.apart: dict[int, bool] = {}
        #: The tree of all tokens: (node, byte) leads to a node.
        self.step: dict[int, int] = {}
        #: By node: the node of its longest proper suffix, and the tokens that its bytes end in, the longest first.
        self.shorter: list[int] = []
        self.ending: list[tuple[int, ...]] = []

    @classmethod
    def from_merges(cls, merges: list[tuple[bytes, bytes]]) -> LastTokens:
        """From pairs in the order in which they are merged."""
        table = cls()
        for a, b in merges:
            table._add(table.number[a], table.number[b])
        return table

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int]) -> LastTokens:
        """From ranks, where of all neighbours whose bytes are a token the lowest rank merges first.

        A token's halves are the two lower tokens that stay apart under the merges
        before it.  ``made`` lacks tokens that have none: no merge makes these.
        """
        table = cls()
        for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
            for cut in range(1, len(token)):
                a, b = table.number.get(token[:cut]), table.number.get(token[cut:])
                if a is not None and b is not None and table._stay_apart(a, b):
                    table._add(a, b)
                    break
        return table

    def _add(self, a: int, b: int) -> None:
        token = self.bytes_of[a] + self.bytes_of[b]
        made = self.number.get(token)
        if made is None:
            made = self.number[token] = len(self.bytes_of)
            self.bytes_of.append(token)
            self.halves.append((a, b))
        self.merge[a, b] = made

    def _build(self) -> None:
        """The automaton that finds the tokens that each prefix ends in; made once all tokens are known."""
        token_at, children = [-1], [[]]
        for k, token in enumerate(self.bytes_of):
            node = 0
            for byte in token:
                after = self.step.get(node << 8 | byte)
                if after is None:
                    after = self.step[node << 8 | byte] = len(token_at)
                    children[node].append((byte, after))
                    token_at.append(-1)
                    children.append([])
                node = after
            token_at[node] = k
        self.shorter, self.ending = [0] * len(token_at), [()] * len(token_at)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, child in children[node]:
                    if node:
                        self.shorter[child] = self._after(self.shorter[node], byte)
                    own = (token_at[child],) if token_at[child] >= 0 else ()
                    self.ending[child] = own + self.ending[self.shorter[child]]
                    below.append(child)
            level = below
        self.longest = max(map(len, self.bytes_of))

    def _after(self, node: int, byte: int) -> int:
        """The node of the longest suffix that a token begins with, one byte on; single bytes are tokens."""
        while (after := self.step.get(node << 8 | byte)) is None:
            node = self.shorter[node]
        return after

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their bytes are merged side by side.

        Undoes the merges of both tokens, the latest first, and looks at the two
        pieces that touch the border at each time: a merge of these that came before
        either became part of a larger piece would have crossed the border.  Of
        equal merges the left one comes first.
        """
        left_until = right_until = len(self.halves)
        while True:
            crossing = self.merge.get((left, right))
            if crossing is not None and crossing < left_until and crossing <= right_until:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                left_until, left = left, self.halves[left][1]
            else:
                right_until, right = right, self.halves[right][0]

    def extend(self, raw: bytes, last: list[int], node: int | None = None) -> list[int]:
        """``extend_from`` where the automaton's node may be unknown."""
        return self.extend_from(raw, last, node)

    def extend_from(self, raw: bytes, last: list[int], node: int | None) -> list[int]:
        """Adds the last tokens of the prefixes of ``raw`` that are longer than those in ``last``, which begins with -1.

        node: the automaton's at the end of ``last``, if it is known; ``self.node`` is that at the end of ``raw``.
        """
        if not self.ending:
            self._build()
        step, shorter, ending, apart, sizes = self.step.get, self.shorter, self.ending, self.apart, self.bytes_of
        have = len(last) - 1
        if node is None:
            node = 0
            for byte in raw[max(0, have - self.longest) : have]:
                node = self._after(node, byte)
        for end in range(have + 1, len(raw) + 1):
            byte = raw[end - 1]
            while (after := step(node << 8 | byte)) is None:
                node = shorter[node]
            node = after
            for token in ending[node]:
                begin = end - len(sizes[token])
                if not begin:
                    break
                pair = last[begin] << 32 | token
                if (known := apart.get(pair)) is None:
                    if len(apart) >= CACHE_PAIRS:
                        apart.clear()
                    known = apart[pair] = self._stay_apart(last[begin], token)
                if known:
                    break
            last.append(token)
        self.node = node
        return last

    def tokens(self, last: list[int], end: int | None = None) -> list[int]:
        """The tokens of a prefix, by its table walked from its end."""
        end = len(last) - 1 if end is None else end
        found = []
        while end:
            found.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return found[::-1]

    def counts(self, last: list[int], counts: list[int] | None = None) -> list[int]:
        """How many tokens each prefix has, the empty one first; ``counts`` is a list of those of the first prefixes, which grows."""
        counts = [0] if counts is None else counts
        sizes = self.bytes_of
        for end in range(len(counts), len(last)):
            counts.append(counts[end - len(sizes[last[end]])] + 1)
        return counts
