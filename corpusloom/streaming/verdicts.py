"""Verdicts on pairs that are asked again and again while a text is written: reused while it stays alike.

The state of a session holds, for a bounded number of pairs, the words that were judged and the verdict,
and how many calls it has made. A pair whose words are alike enough gets its verdict again;
else it is judged anew, as long as the session has calls left.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

# How alike words must be, pairs that are kept, calls of a session, and the shortest text that is judged.
ALIKE, KEPT, CALLS, LEAST_CHARS = 0.6, 200, 60, 80

OUT = "session string, pair string, seq long, action string, verdict string"
_STATE = "pairs array<string>, words array<array<string>>, verdicts array<string>, calls int"


def alike(a: list[str], b: list[str]) -> float:
    """Words that both have, of all; 1 for two empty lists."""
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


class Session:
    """What a session remembers; the oldest pair goes first."""

    def __init__(self, pairs: dict[str, tuple[list[str], str]] | None = None, calls: int = 0):
        self.pairs, self.calls = pairs or {}, calls

    def ask(self, pair: str, words: list[str], chars: int, judge: Callable[[str, list[str]], str]) -> tuple[str, str | None]:
        """``action, verdict``: reused, called, or silent (too short, or no calls left)."""
        if chars < LEAST_CHARS:
            return "silent", None
        had = self.pairs.get(pair)
        if had and alike(had[0], words) >= ALIKE:
            return "reused", had[1]
        if self.calls >= CALLS:
            return "silent", None
        self.calls += 1
        self.pairs[pair] = (list(words), judge(pair, words))
        if len(self.pairs) > KEPT:
            del self.pairs[next(iter(self.pairs))]
        return "called", self.pairs[pair][1]


def verdicts(feed: DataFrame, judge: Callable[[str, list[str]], str]) -> DataFrame:
    """``session, pair, seq, action, verdict`` of a stream of ``session, pair, seq, words, chars``.

    A session's rows of a batch are taken in order of ``seq``; batches must come in that order. State
    is at most ``KEPT`` pairs for each session. Rows without a session or a pair say nothing.
    """

    def run(key, frames, state):
        s = Session()
        if state.exists:
            pairs, words, said, calls = state.get
            s = Session({p: (list(w), v) for p, w, v in zip(pairs, words, said, strict=True)}, calls)
        rows = pd.concat(list(frames)).sort_values(["seq", "pair"])
        out = [(key[0], r.pair, r.seq, *s.ask(r.pair, list(r.words) if r.words is not None else [], int(r.chars), judge)) for r in rows.itertuples()]
        state.update((list(s.pairs), [w for w, _ in s.pairs.values()], [v for _, v in s.pairs.values()], s.calls))
        yield pd.DataFrame(out, columns=["session", "pair", "seq", "action", "verdict"])

    rows = feed.where("session is not null and pair is not null").select("session", "pair", "seq", "words", "chars")
    return rows.groupBy("session").applyInPandasWithState(run, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
