"""Interpolated Kneser-Ney character models of several languages in shared sorted arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ORDER = 4
SPACE = 32

# Fixed value: the odd multiplier of the character hash.
STEP = np.uint64(0xC6BC279692B5C323)


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.char.isalpha(np.arange(0x110000, dtype="<u4").view("<U1"))
    return _LETTERS


_LETTERS: np.ndarray | None = None


@dataclass
class Symbols:
    """Lower-case letters of several texts, other characters folded into single spaces.

    ``codes`` starts each text with ``ORDER - 1`` spaces of context; ``at`` are the
    places to score and ``bounds`` says which of them belong to which text.
    """

    codes: np.ndarray
    at: np.ndarray
    bounds: np.ndarray
    letters: np.ndarray


def symbols(texts: list[str]) -> Symbols:
    pad = " " * (ORDER - 1)
    padded = [pad + t.lower() for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) for t in padded])
    letter = letters()[codes]
    context = np.zeros(len(codes), bool)
    for j in range(ORDER - 1):
        context[np.append(0, ends[:-1]) + j] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter is a word's end
    keep |= context
    per_text = np.add.reduceat(letter, np.append(0, ends[:-1])).astype(np.int64)
    place = np.cumsum(keep)
    scored = keep & ~context
    bounds = np.append(0, np.cumsum(scored)[ends - 1])
    folded = np.where(letter, codes, SPACE)[keep].astype(np.uint64)
    return Symbols(folded, place[scored] - 1, bounds, per_text)


def keys(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of character runs given as one column per character, first to last."""
    out = np.zeros(len(columns[0]) if columns else 1, np.uint64)
    for c in columns:
        out = (out * STEP) + c + np.uint64(1)
    return out


@dataclass
class Level:
    """One order: log-probability of each run seen in any language, weight of each context."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    loggamma: np.ndarray


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]
    unseen: float

    def log_probabilities(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log-probability of each symbol under each language, ``(len(at), languages)``."""
        columns = [codes[at - j] for j in range(ORDER - 1, -1, -1)]
        out = np.zeros((len(at), len(self.languages)), np.float32)
        self._score(columns, np.arange(len(at)), ORDER, out)
        return out

    def _score(self, columns: list[np.ndarray], rows: np.ndarray, order: int, out: np.ndarray) -> None:
        if not order:
            out[rows] += np.float32(self.unseen)
            return
        level = self.levels[order - 1]
        own = columns[ORDER - order :]
        place, seen = _find(level.grams, keys(own))
        if seen.all():
            out[rows] += level.logp[place]
            return
        out[rows[seen]] += level.logp[place[seen]]
        rest = [c[~seen] for c in columns]
        place, known = _find(level.contexts, keys(rest[ORDER - order : ORDER - 1]))
        if order == 1:
            place, known = np.zeros(len(rest[0]), np.int64), np.ones(len(rest[0]), bool)
        left = rows[~seen]
        out[left[known]] += level.loggamma[place[known]]
        self._score(rest, left, order - 1, out)


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.searchsorted(table, wanted)
    place[place == len(table)] = 0
    return place, table[place] == wanted


def fit(languages: list[str], chars: np.ndarray, counts: np.ndarray) -> Model:
    """Model from distinct runs ``chars`` (rows of ``ORDER`` characters) and their ``counts`` per language.

    The highest order counts occurrences, lower orders count distinct characters
    before a run. The discount of an order and language is n1 / (n1 + 2 n2).
    """
    grams: list[tuple[np.ndarray, np.ndarray]] = [(chars.astype(np.uint64), counts.astype(np.float64))]
    for order in range(ORDER - 1, 0, -1):
        longer, seen = grams[0]
        suffix, group = np.unique(keys(list(longer.T[1:])), return_inverse=True)
        left = np.zeros((len(suffix), len(languages)))
        np.add.at(left, group, seen > 0)
        example = np.zeros(len(suffix), np.int64)
        example[group] = np.arange(len(group))
        grams.insert(0, (longer[example][:, 1:], left))
    vocabulary = len(grams[0][0]) + 1
    levels: list[Level] = []
    for order, (runs, seen) in enumerate(grams, 1):
        own = keys(list(runs.T))
        context = keys(list(runs.T[:-1])) if order > 1 else np.zeros(len(runs), np.uint64)
        contexts, group = np.unique(context, return_inverse=True)
        total, kinds = np.zeros((2, len(contexts), len(languages)))
        np.add.at(total, group, seen)
        np.add.at(kinds, group, seen > 0)
        once, twice = (seen == 1).sum(axis=0), (seen == 2).sum(axis=0)
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.05, 0.95)
        gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        if order == 1:
            lower = np.full(seen.shape, 1 / vocabulary)
        else:
            below = levels[-1]
            lower = np.exp(below.logp[np.searchsorted(below.grams, keys(list(runs.T[1:])))])
        p = np.maximum(seen - discount, 0) / np.maximum(total[group], 1) + gamma[group] * lower
        by = np.argsort(own)
        levels.append(Level(own[by], np.log(p)[by].astype(np.float32), contexts, np.log(gamma).astype(np.float32)))
    return Model(languages, levels, float(-np.log(vocabulary)))
