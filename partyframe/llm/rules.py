"""Quality by weak supervision: rules vote or abstain, expectation-maximisation tells how far each can be trusted."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common as C
from .terms import Tokens, byte_set, run_hashes, run_of

SPACES = byte_set(bytes(C.SPACES))
SYMBOLS = byte_set("#*$%&|<>")
WINDOW = 5                  # words of a repeated stretch

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper",
           "n_alpha_words", "n_loud", "n_same", "n_ends", "n_tails")


class Rule(NamedTuple):
    """Two SQL conditions over the signals: where ``good`` holds the rule votes 1, else where ``bad`` holds -1, else 0.

    Rules of one ``fault`` look for the same kind of bad text and so can bear each other out.
    """

    name: str
    fault: str
    good: str
    bad: str


RULES = (
    Rule("length", "shape", "n_words >= 50", "n_words < 5"),
    Rule("word_length", "shape", "word_chars BETWEEN 3 * n_words AND 12 * n_words",
         "word_chars < 2 * n_words OR word_chars > 16 * n_words"),
    Rule("sentences", "shape", "n_words >= 10 AND 60 * n_ends >= n_words", "n_words >= 80 AND n_ends = 0"),
    Rule("symbols", "noise", "50 * n_symbols <= n_words", "10 * n_symbols >= n_words"),
    Rule("letters", "noise", "10 * n_alpha_words >= 9 * n_words", "10 * n_alpha_words <= 7 * n_words"),
    Rule("tails", "noise", "50 * n_tails <= n_words", "5 * n_tails >= n_words"),
    Rule("case", "shouting", "n_letters >= 40 AND 5 * n_upper <= n_letters",
         "n_letters >= 40 AND 2 * n_upper >= n_letters"),
    Rule("loud", "shouting", "50 * n_loud <= n_words", "10 * n_loud >= n_words"),
    Rule("lines", "loops", "n_lines >= 3 AND n_dup_lines = 0", "10 * n_dup_lines >= 3 * n_lines AND n_dup_lines > 0"),
    Rule("stretches", "loops", "n_words >= 20 AND 20 * n_repeat_words <= n_words", "20 * n_repeat_words > 3 * n_words"),
    Rule("stutter", "loops", "n_words >= 20 AND 50 * n_same <= n_words", "5 * n_same >= n_words AND n_words > 1"),
)

BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


# ---------------------------------------------------------------- what is counted in a text

def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per text: ``id`` and :data:`SIGNALS`, all long.

    Words are ``[^\\x20\\x09-\\x0D]+``; a line ends at ``\\n`` and counts if it
    holds a word.  ``n_repeat_words`` is the number of words in windows of
    :data:`WINDOW` words that stand twice or more in the text, ``n_same`` of
    words equal to the one before, ``n_ends`` of words that close a sentence,
    ``n_tails`` of words that end in a symbol.
    """
    schema = pa.schema([("id", pa.int64()), *((s, pa.int64()) for s in SIGNALS)])

    def run(batches):
        for batch in batches:
            for t in C.slices(batch, max_bytes=2 << 20):
                got = _count(t.column("text"))
                yield C.frame(schema, t.column("id"), *(got[s].astype(np.int64) for s in SIGNALS))

    ddl = ", ".join(["id long", *(f"{s} long" for s in SIGNALS)])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def _count(column) -> dict[str, np.ndarray]:
    t = Tokens(column, SPACES)
    data, n = t.data, t.rows
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    wide = data >= 128
    alpha = np.concatenate(([0], np.cumsum(upper | lower | wide)))
    last = data[t.end - 1]
    h = t.hashes()
    same = np.zeros(len(t), bool)
    same[1:] = (h[1:] == h[:-1]) & (t.row[1:] == t.row[:-1])
    return {
        "n_words": t.counts,
        "word_chars": t.row_sums(~t.outside & ((data & 0xC0) != 0x80)),
        "n_symbols": t.row_sums(SYMBOLS[data]),
        "n_letters": t.row_sums(upper | lower),
        "n_upper": t.row_sums(upper),
        "n_loud": t.row_sums(data == 0x21),
        "n_alpha_words": t.row_counts(alpha[t.end] > alpha[t.start]),
        "n_ends": t.row_counts((last == 0x2E) | (last == 0x21) | (last == 0x3F)),
        "n_tails": t.row_counts(SYMBOLS[last]),
        "n_same": t.row_counts(same),
        "n_repeat_words": t.row_counts(_repeated(h, t.row, n)),
        **_lines(t),
    }


def _repeated(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Words that lie in a window found twice or more in their text."""
    covered = np.zeros(len(h), bool)
    window = run_of(h, WINDOW)
    if len(window):
        inside = np.flatnonzero(row[:len(window)] == row[WINDOW - 1:])
        key = C.mix(window[inside] + row[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = inside[count[at] > 1]
        for j in range(WINDOW):
            covered[hit + j] = True
    return covered


def _lines(t: Tokens) -> dict[str, np.ndarray]:
    """Lines that hold a word, and those among them that equal an earlier one of the text."""
    cut = np.zeros(len(t.data) + 1, bool)
    cut[t.off] = True
    ends = np.flatnonzero(t.data == 0x0A)
    cut[ends + 1] = True
    start = np.flatnonzero(cut[:-1]) if len(t.data) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(t.data)) if len(start) else start
    end = end - (t.data[end - 1] == 0x0A) if len(start) else end
    words = np.concatenate(([0], np.cumsum(~t.outside)))
    full = words[end] > words[start]
    start, end = start[full], end[full]
    row = np.searchsorted(t.off, start, "right") - 1
    lines = np.bincount(row, minlength=t.rows)
    key = C.mix(run_hashes(t.data, start, end) + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first = np.unique(key, return_index=True)
    return {"n_lines": lines, "n_dup_lines": lines - np.bincount(row[first], minlength=t.rows)}


# ---------------------------------------------------------------- votes and trust

def votes(rules: Sequence[Rule] = RULES) -> list[Column]:
    return [F.when(F.expr(r.good), 1).when(F.expr(r.bad), -1).otherwise(0).cast("int").alias(f"vote_{r.name}")
            for r in rules]


class Trust(NamedTuple):
    """Shares of the kinds of text (the first is good, then one per fault), and per kind and rule how often a vote
    of the rule is 1."""

    share: np.ndarray
    plus: np.ndarray

    def weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of each fault against good: at no vote (faults), and what a vote 1 or -1 adds (faults x rules)."""
        return (np.log(self.share[1:] / self.share[0]), np.log(self.plus[1:] / self.plus[0]),
                np.log((1 - self.plus[1:]) / (1 - self.plus[0])))


def estimate(patterns: np.ndarray, counts: np.ndarray, faults: Sequence[str], rounds: int = 500,
             tol: float = 1e-10) -> Trust:
    """Expectation-maximisation over vote patterns (-1, 0, 1) and how many texts show each.

    A text is good or has one of the faults that the rules look for; given
    that, the rules vote independently, and whether a rule abstains tells
    nothing.  The first guess: a text without a vote against it is good,
    others have the faults voted against them, by number of votes.  One vote
    each way smooths every estimate, and a rule's vote 1 never speaks against
    good: where the estimates say so, the rule tells nothing about that fault.
    """
    kinds = list(dict.fromkeys(faults))
    share, half = np.full(len(kinds) + 1, 1 / (len(kinds) + 1)), np.full((len(kinds) + 1, len(faults)), 0.5)
    if not len(counts):
        return Trust(share, half)
    weight = counts.astype(float)
    plus, minus = (patterns == 1).astype(float), (patterns == -1).astype(float)
    of = np.array([[f == k for f in faults] for k in kinds], float)
    guess = np.concatenate([np.full((1, len(weight)), 0.5), of @ minus.T + 0.01])
    guess[0, minus.sum(axis=1) == 0] = 20.0
    guess /= guess.sum(axis=0)
    for _ in range(rounds):
        mass = guess * weight
        share = (mass.sum(axis=1) + 1) / (weight.sum() + len(kinds) + 1)
        rate = (mass @ plus + 1) / (mass @ (plus + minus) + 2)
        rate[1:] = np.minimum(rate[1:], rate[0])
        trust = Trust(share, rate)
        none, up, down = trust.weights()
        odds = np.concatenate([np.zeros((1, len(weight))), none[:, None] + up @ plus.T + down @ minus.T])
        odds = np.exp(odds - odds.max(axis=0))
        new = odds / odds.sum(axis=0)
        done = np.abs(new - guess).max() < tol
        guess = new
        if done:
            break
    return trust


def posterior(trust: Trust, names: Sequence[str]) -> Column:
    """Probability that a text is good, from its vote columns."""
    against = F.lit(0.0)
    for none, up, down in zip(*trust.weights()):
        odds = F.lit(float(none))
        for name, u, d in zip(names, up, down):
            odds = odds + F.when(F.col(name) == 1, float(u)).when(F.col(name) == -1, float(d)).otherwise(0.0)
        against = against + F.exp(odds)
    return F.lit(1.0) / (F.lit(1.0) + against)


def rate_by_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: Sequence[Rule] = RULES, least: float = 0.5) -> DataFrame:
    """Signals, votes and the probability of being good of every text.

    The texts are read once, their counts (no text) are written to the
    checkpoint folder; the votes are counted by pattern (at most 3^rules rows,
    summed before they reach the driver) over all documents, and
    expectation-maximisation runs on those counts.

    Returns id_col, :data:`SIGNALS`, ``base_failed`` (fewer than 10 words, or
    more than 20 % of them repeated), one ``vote_`` column per rule,
    ``p_good`` and ``kept`` (not base_failed and p_good >= ``least``): one row
    per input row.  A null or empty text has no words and fails the base; rows
    that repeat count each; extra columns are ignored.  Of an empty table
    nothing is learned and nothing returned.
    """
    if not 1 <= len(rules) <= 12:
        raise ValueError("1 to 12 rules: the number of vote patterns is 3 to that power")
    counted = cut_lineage(signals(docs, id_col, text_col))
    named = [f"vote_{r.name}" for r in rules]
    voted = counted.select("*", *votes(rules))
    seen = voted.groupBy(*named).agg(F.count(F.lit(1)).alias("n")).toArrow()
    patterns = np.stack([seen.column(c).to_numpy() for c in named], axis=1)
    order = np.lexsort(patterns.T)                      # sums don't depend on the order of the rows
    trust = estimate(patterns[order], seen.column("n").to_numpy()[order], [r.fault for r in rules])
    rated = voted.select(F.col("id").alias(id_col), *SIGNALS, F.expr(BASE_FAILED).alias("base_failed"), *named,
                         posterior(trust, named).alias("p_good"))
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
