"""Quality rules as weak supervision: each rule votes or abstains, and expectation-maximisation weighs the votes.

The rules' votes are counted by pattern over all documents (a bounded number of patterns); the model of two classes with
a vote distribution for each rule is fitted to these counts; a document's posterior probability of being good is then a
sum of weights, an ordinary column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bazaarlens.llm.arrays import LOWER, WHITE, Words, byte_sums, group_edges, slices, text_buffers, word_sums
from bazaarlens.llm.naming import names_apart

SIGNALS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_capital_words n_letter_words n_shout_marks"
    " n_symbol_words n_echo_words n_capitals n_letters n_unspaced".split()
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_LETTER = np.zeros(256, bool)
_NOT_LETTER[[x for x in range(128) if not chr(x).isalpha()]] = True


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a character of a script without spaces: Thai, Lao, Tibetan, Burmese, Khmer, Chinese, Japanese."""
    after = np.r_[data[1:], np.zeros(min(1, len(data)), np.uint8)]
    return (
        ((data >= 0xE3) & (data <= 0xE9)) | ((data == 0xE0) & (after >= 0xB8))
        | ((data == 0xE1) & ((after <= 0x82) | (after == 0x9E) | (after == 0x9F))) | ((data == 0xF0) & (after >= 0xA0) & (after <= 0xAF))
    )


def _repeats(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by (doc, h), and in it the first row of each group."""
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    return order, group_edges(doc[order], h[order])


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SIGNALS of each text, one row each."""
    rows = len(offsets) - 1
    words = Words(data, offsets, WHITE)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(flags)][offsets])

    def per_word(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return total[words.ends] - total[words.starts]

    repeat = np.zeros(len(words.starts), bool)
    at, hashes = words.windows(3), words.hashes()
    if len(at):
        h = word_sums(hashes).windows(3)[at]
        order, first = _repeats(words.doc[at], h)
        size = np.diff(np.r_[first, len(order)])
        found = at[order[np.repeat(size > 1, size)]]
        for k in range(3):
            repeat[found + k] = True
    # lines: between line feeds and the ends of texts
    breaks = np.flatnonzero(data == 10)
    doc_of = np.searchsorted(offsets, breaks, "right") - 1
    begin, end = np.r_[offsets[:-1], breaks + 1], np.r_[breaks, offsets[1:]]
    line_doc = np.r_[np.arange(rows), doc_of]
    order = np.lexsort((begin, line_doc))
    begin, line_doc = begin[order], line_doc[order]
    end = end[np.lexsort((end, np.r_[doc_of, np.arange(rows)]))]
    inside = np.r_[0, np.cumsum(words.inside)]
    full = inside[end] > inside[begin]
    begin, end, line_doc = begin[full], end[full], line_doc[full]
    h = byte_sums(data).runs(begin, end)
    _, first = _repeats(line_doc, h)
    lines = np.bincount(line_doc, minlength=rows)
    distinct = np.bincount(np.sort(line_doc, kind="stable")[first], minlength=rows)
    capital = per_word((data >= 65) & (data <= 90))
    small = per_word((data >= 97) & (data <= 122) | (data >= 0xC3))
    letters = per_word(~_NOT_LETTER[data])
    symbols = per_word(_SYMBOL[data])
    echo = np.zeros(len(words.starts), bool)
    if len(echo):
        echo[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    by_doc = lambda flags: np.bincount(words.doc[flags], minlength=rows)
    return np.stack([
        words.counts, per_text(words.inside & ((data & 0xC0) != 0x80)), per_text(_SYMBOL[data]), lines - distinct,
        by_doc(repeat), lines, by_doc((capital > 1) & (small == 0)), by_doc(letters > 0), per_text(data == ord("!")),
        by_doc(symbols > 0), by_doc(echo), per_text((data >= 65) & (data <= 90)), per_text((LOWER[data] >= 97) & (LOWER[data] <= 122)),
        per_text(_unspaced(data)),
    ], axis=1).astype(np.int64)


@names_apart
def signals(docs: DataFrame, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """SIGNALS of each text beside the columns of ``docs`` (the text only ``with_text``); null or empty: all zero."""
    keep = [c for c in docs.columns if c not in SIGNALS and (with_text or c != text_col)]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in SIGNALS)])
    target = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("__text"))
            parts = [measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
            values = np.concatenate([np.zeros((0, len(SIGNALS)), np.int64), *parts])
            new = [pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(SIGNALS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], schema=target)

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(work, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rule(share: Column, good_to: float, bad_from: float) -> Column:
    """0: bad, 1: good, null: abstains."""
    return F.when(share >= bad_from, 0).when(share <= good_to, 1)


def rules() -> dict[str, Column]:
    """Votes by rule; a document without words gets no vote but the first.

    Symptoms that one rule alone would tell have a second one that looks at them otherwise, so that votes corroborate each
    other. Rules on words abstain where a script without spaces prevails, as its words cannot be told.
    """
    n, lines = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_lines"), F.lit(0))
    length = F.col("word_chars") / n
    spaced = 4 * F.col("n_unspaced") <= F.col("word_chars")
    letters = F.when(F.col("n_letters") >= 20, F.col("n_letters"))
    return {
        "length": F.when(~spaced, None).when(F.col("n_words") < 20, 0).when(F.col("n_words") >= 50, 1),
        "symbols": _rule(F.col("n_symbols") / n, 0.05, 0.2),
        "repeats": _rule(F.col("n_repeat_words") / n, 0.15, 0.4),
        "lines": _rule(F.col("n_dup_lines") / lines, 0.1, 0.4),
        "word_length": F.when(~spaced, None).when((length < 2) | (length > 15), 0).when((length >= 3) & (length <= 10), 1),
        "capitals": _rule(F.col("n_capital_words") / n, 0.1, 0.4),
        "letters": _rule(1 - F.col("n_letter_words") / n, 0.1, 0.4),
        "marks": _rule(F.col("n_shout_marks") / n, 0.1, 0.5),
        "symbol_words": _rule(F.col("n_symbol_words") / n, 0.05, 0.2),
        "echoes": _rule(F.col("n_echo_words") / n, 0.05, 0.2),
        "upper_case": _rule(F.col("n_capitals") / letters, 0.2, 0.5),
    }


@dataclass(frozen=True)
class VoteModel:
    """Natural-log weights: ``prior`` of good over bad; ``weights[rule]`` for a bad and for a good vote."""

    prior: float
    weights: dict[str, tuple[float, float]]
    #: Estimated share of right votes among the votes of each rule.
    accuracy: dict[str, float]

    def posterior(self) -> Column:
        """Probability that a document is good."""
        total, votes = F.lit(self.prior), rules()
        for name, vote in votes.items():
            bad, good = self.weights[name]
            total = total + F.when(vote == 0, bad).when(vote == 1, good).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(measured: DataFrame, rounds: int = 100) -> VoteModel:
    """Expectation-maximisation over the counts of vote patterns of all documents: at most 3 ** rules patterns exist."""
    votes = rules()
    counted = measured.select(*[v.alias(k) for k, v in votes.items()]).groupBy(*votes).count().collect()
    counted.sort(key=lambda r: [-1 if r[k] is None else r[k] for k in votes])
    v = np.array([[-1 if r[k] is None else r[k] for k in votes] for r in counted]).reshape(-1, len(votes))
    return estimate(v, np.array([r["count"] for r in counted], float), list(votes), rounds)


def estimate(v: np.ndarray, n: np.ndarray, names: list[str], rounds: int = 100) -> VoteModel:
    """The model of vote patterns (0, 1, or -1: abstains; one row each) that ``n`` documents have.

    Pseudo-counts of a few documents say that a rule seldom votes against a good document and that about a third of the bad
    ones meet it, which also names the classes; how often each rule is wrong is learned from the votes. Without documents
    the pseudo-counts alone decide.
    """
    good = np.where((v == 0).sum(axis=1) > 1, 0.02, 0.98)  # starts from two votes that corroborate each other
    for _ in range(rounds):
        share = (n @ good + 8) / (n.sum() + 10)
        logit = np.full(len(n), np.log(share / (1 - share)))
        weights, right = {}, {}
        for i, name in enumerate(names):
            bad_vote, good_vote = v[:, i] == 0, v[:, i] == 1
            g0, g1 = n[bad_vote] @ good[bad_vote] + 0.2, n[good_vote] @ good[good_vote] + 19.8
            b0, b1 = n[bad_vote] @ (1 - good[bad_vote]) + 6, n[good_vote] @ (1 - good[good_vote]) + 12
            # chance of a bad vote, in a good and in a bad document
            p, q = g0 / (g0 + g1), b0 / (b0 + b1)
            weights[name] = (float(np.log(p / q)), float(np.log((1 - p) / (1 - q))))
            right[name] = float((g1 + b0) / (g0 + g1 + b0 + b1))
            logit = logit + np.where(bad_vote, weights[name][0], 0) + np.where(good_vote, weights[name][1], 0)
        good = 1 / (1 + np.exp(-logit))
    return VoteModel(float(np.log(share / (1 - share))), weights, right)


def judge(measured: DataFrame, model: VoteModel, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, quality (posterior probability) and kept: false if base_failed, else quality >= threshold."""
    out = measured.withColumns({"base_failed": base_failed(), "quality": model.posterior()})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
