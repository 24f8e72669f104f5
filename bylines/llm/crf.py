"""Training of a linear-chain conditional random field on sequences that lie end to end."""

from __future__ import annotations

import numpy as np

RATE, RIDGE = 0.5, 0.1


def summed(groups: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` by group."""
    return np.stack([np.bincount(groups, v, size) for v in values.T], axis=1)


def maximise(
    rows: np.ndarray, columns: np.ndarray, gold: np.ndarray, first: np.ndarray, features: int, tags: int, epochs: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights per feature and tag, and transitions; the row behind the last tag's holds the starts.

    Place ``rows[i]`` has feature ``columns[i]``; ``gold`` are the tags, ``first`` marks where a
    sequence begins. Adagrad on the regularised likelihood of all sequences.
    """
    weights, moves = np.zeros((features, tags)), np.zeros((tags + 1, tags))
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(gold)))
    target = np.eye(tags)[gold]
    seen = np.zeros_like(moves)
    np.add.at(seen, (np.where(first, tags, np.append(0, gold[:-1])), gold), 1)
    squares = [np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)]
    for _ in range(epochs):
        chance, used = marginals(summed(rows, weights[columns], len(gold)), moves, starts, lengths)
        slope = summed(columns, (target - chance)[rows], features)
        for value, step, square in (
            (weights, slope - RIDGE * weights, squares[0]),
            (moves, seen - used - RIDGE * moves, squares[1]),
        ):
            square += step**2
            value += RATE * step / np.sqrt(square)
    return weights, moves


def marginals(
    emission: np.ndarray, moves: np.ndarray, starts: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Tag probabilities by forward-backward, all sequences in step, and the expected transitions."""
    ahead, behind = np.zeros_like(emission), np.zeros_like(emission)
    longest, between = int(lengths.max()), moves[:-1]
    ahead[starts] = emission[starts] + moves[-1]
    for k in range(1, longest):
        at = starts[lengths > k] + k
        ahead[at] = emission[at] + np.logaddexp.reduce(ahead[at - 1][:, :, None] + between, axis=1)
    for k in range(longest - 1, 0, -1):
        at = starts[lengths > k] + k
        behind[at - 1] = np.logaddexp.reduce(between + (emission[at] + behind[at])[:, None, :], axis=2)
    total = np.logaddexp.reduce(ahead + behind, axis=1, keepdims=True)
    chance = np.exp(ahead + behind - total)
    inner = np.ones(len(emission), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    pair = ahead[at - 1][:, :, None] + between + (emission[at] + behind[at])[:, None, :] - total[at][:, None]
    return chance, np.concatenate([np.exp(pair).sum(axis=0), chance[starts].sum(axis=0, keepdims=True)])
