"""Re-Pair grammars over token sequences, for many sequences at once.

In each round the most frequent pairs of adjacent symbols of every sequence become rules and are replaced, as Re-Pair does; a
round takes all pairs that are at least half as frequent as the sequence's most frequent one, and rounds go on until no pair repeats. All
sequences of a batch are handled by the same array operations, but a symbol is named by a hash of what it derives, so the grammar
of a sequence does not depend on the others, and equal rules have equal names wherever they are inferred.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Tokens below a rule from which it counts as long: more than a statement.
LONG = 16
#: Tokens of the phrases that are told apart by their words.
PHRASE = (8, 64)

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_INVERSE = np.uint64(pow(int(_A), -1, 2**64))


@dataclass
class Grammars:
    """Of each sequence the symbols left, the rules and the tokens below rules of LONG tokens or more; phrase[i] belongs to sequence owner[i]."""

    left: np.ndarray
    rules: np.ndarray
    long: np.ndarray
    owner: np.ndarray
    phrase: np.ndarray

    def phrases(self, i: int) -> list[int]:
        """The distinct phrases of a sequence: the words below its rules, as numbers."""
        lo, hi = np.searchsorted(self.owner, (i, i + 1))
        return np.unique(self.phrase[lo:hi]).view(np.int64).tolist()


def mixed(h: np.ndarray) -> np.ndarray:
    """The numbers with their bits mixed."""
    h = h ^ (h >> np.uint64(31))
    h = h * _B
    h = h ^ (h >> np.uint64(27))
    h = h * _C
    return h ^ (h >> np.uint64(31))


def grammars(sequences: list[np.ndarray], words: list[np.ndarray] | None = None) -> Grammars:
    """The grammars of sequences of numbers. words: of each sequence a number for the text of each token; without it there are no phrases."""
    with np.errstate(over="ignore"):
        return _grammars(sequences, words)


def _grammars(sequences: list[np.ndarray], words: list[np.ndarray] | None) -> Grammars:
    count = len(sequences)
    lengths = np.array([len(s) for s in sequences], np.int64)
    total, rules, none = int(lengths.sum()), np.zeros(count, np.int64), np.zeros(0, np.int64)
    if not total:
        return Grammars(lengths, rules, rules.copy(), none, none.astype(np.uint64))
    owner = np.repeat(np.arange(count, dtype=np.int64), lengths)
    symbol = mixed(np.concatenate([s for s in sequences if len(s)]).astype(np.uint64) + _A)
    span, start = np.ones(total, np.int64), np.arange(total, dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if words is not None:
        # Sums of words times powers: those of a span, divided by the power at its start, are its number wherever it stands.
        power, inverse = np.ones(total + 1, np.uint64), np.ones(total + 1, np.uint64)
        power[1:], inverse[1:] = np.cumprod(np.full(total, _A)), np.cumprod(np.full(total, _INVERSE))
        sums = np.zeros(total + 1, np.uint64)
        sums[1:] = np.cumsum(np.concatenate([s for s in words if len(s)]).astype(np.uint64) * power[:-1])
    while len(symbol) > 1:
        same = owner[1:] == owner[:-1]
        made = mixed(symbol[:-1] * _A + symbol[1:])
        _, at, n = np.unique(np.where(same, made ^ mixed(owner[:-1].astype(np.uint64) + _C), np.uint64(0)), return_inverse=True, return_counts=True)
        often = np.where(same, n[at], 0)
        best = np.zeros(count, np.int64)
        np.maximum.at(best, owner[:-1], often)
        chosen = same & (often >= 2) & (often * 2 >= best[owner[:-1]])
        if not chosen.any():
            break
        # Of overlapping places the one with the more frequent pair is replaced, ties by the name of the pair, so that equal phrases
        # are replaced alike wherever they stand; in a run of one pair every second place is.
        rank = (np.minimum(often, 2**22) << 40) + (made >> np.uint64(24)).astype(np.int64)
        joins = np.r_[False, (at[1:] == at[:-1]) & chosen[1:] & chosen[:-1]]
        index = np.arange(len(chosen))
        run = np.maximum.accumulate(np.where(~joins, index, 0))
        before = np.r_[-1, np.where(chosen[:-1], rank[:-1], -1)]
        after = np.r_[np.where(chosen[1:], rank[1:], -1), -1]
        taken = chosen & ((index - run) % 2 == 0) & (joins | (rank > before)) & (np.r_[joins[1:], False] | (rank > after))
        used = np.bincount(at[taken], minlength=len(n))
        taken &= used[at] >= 2
        if not taken.any():
            break
        first = np.flatnonzero(taken)
        _, one = np.unique(at[first], return_index=True)
        rules += np.bincount(owner[first[one]], minlength=count)
        symbol[first] = made[first]
        span[first] += span[first + 1]
        if words is not None:
            told = first[(span[first] >= PHRASE[0]) & (span[first] <= PHRASE[1])]
            a = start[told]
            found.append((owner[told], mixed((sums[a + span[told]] - sums[a]) * inverse[a])))
        keep = np.ones(len(symbol), bool)
        keep[first + 1] = False
        symbol, span, owner, start = symbol[keep], span[keep], owner[keep], start[keep]
    long = np.bincount(owner, weights=span * (span >= LONG), minlength=count).astype(np.int64)
    whose = np.concatenate([o for o, _ in found]) if found else none
    phrase = np.concatenate([p for _, p in found]) if found else none.astype(np.uint64)
    order = np.argsort(whose, kind="stable")
    return Grammars(np.bincount(owner, minlength=count), rules, long, whose[order], phrase[order])
