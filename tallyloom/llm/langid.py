"""Language identification as inference of a multilingual mixture.

Every language has a distribution over hashed letter trigrams, counted over all learning documents.  A
document is a mixture of languages: expectation-maximisation estimates the proportions, and the set of
languages grows from the best single one as long as the penalised likelihood (``PENALTY * log(n)`` for
each further language) gains.  The prediction is the language with the largest proportion, its score that
proportion.

The likelihood is concave in the proportions, so its slope towards a further language bounds what that
language can gain; EM runs only for those whose bound exceeds the penalty, which changes no result.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text if nothing
could be learned; ties go to the first language by name; rows without a language or a letter teach nothing;
repeated rows count each; an empty table gives an empty result; extra columns are not read.  Texts are
read whole: trigrams are hashed some 100,000 characters at a time into counts of ``BUCKETS`` buckets, and the likelihood
is summed over buckets, so a text of any length needs a few copies of itself and 131,072 rows for each language.

The model has ``BUCKETS`` numbers for each language (0.5 MB), held by the driver and each worker: it grows with the number of
languages, not with the corpus.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import values

BUCKETS = 1 << 17
ALPHA = 0.1
PENALTY = 2.0
UNKNOWN = "und"
ROUNDS = 50
_PIECE = 100_000  # characters hashed at a time
_HELD = 32  # languages whose dense counts a learning task holds before it passes them on


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _parts(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the trigrams of letters, with one blank between and around words, some at a time; none without a letter."""
    lower = (text or "").lower()
    table = _letters()
    tail, after = np.array([32], np.uint64), False  # last symbols so far; whether the last character was a letter
    some = False
    for at in range(0, len(lower) + 1, _PIECE):
        raw = np.frombuffer(lower[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = table[raw]
        some |= bool(letter.any())
        c = np.where(letter, raw, np.uint32(32))
        c = c[letter | np.concatenate([[after], letter[:-1]])[: len(letter)]]  # of a run of other characters one blank stays
        after = bool(letter[-1]) if len(letter) else after
        c = np.concatenate([tail, c.astype(np.uint64)])
        if at + _PIECE > len(lower) and c[-1] != 32:
            c = np.append(c, np.uint64(32))
        tail = c[-2:]
        if some and len(c) > 2:
            mixed = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
            yield ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 17)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Buckets of all trigrams of a text, in order."""
    return np.concatenate([np.zeros(0, np.int64), *_parts(text)])


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    at, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in _parts(text):
        own, more = np.unique(part, return_counts=True)
        at, where = np.unique(np.concatenate([at, own]), return_inverse=True)
        n = np.bincount(where, np.concatenate([n, more]), len(at)).astype(np.int64)
    return at, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        for lang, text in values(batch.column(0), batch.column(1)):
            if lang not in held and len(held) >= _HELD:
                yield from passed()
            at, found = counts(text)
            if len(at):
                held.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += found
    yield from passed()


class Mixture:
    """Languages in order of name and the log probability of each bucket in each."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs

    def proportions(self, text: str | None) -> dict[str, float]:
        """The chosen languages and their proportions; none without a letter."""
        at, n = counts(text)
        if not len(at) or not self.languages:
            return {}
        logs, total = self.logs[at], int(n.sum())
        penalty = PENALTY * np.log(max(total, 2))
        best = n @ logs.astype(np.float64)
        chosen = [int(np.argmax(best))]
        share, value = np.ones(1), float(best[chosen[0]])
        if len(self.languages) == 1:
            return {self.languages[0]: 1.0}
        base = logs.max(axis=1)
        p = np.exp(logs - base[:, None])
        offset = float(n @ base.astype(np.float64))
        while len(chosen) < len(self.languages):
            slope = (n / (p[:, chosen] @ share)) @ p - total
            found = None
            for j in np.flatnonzero(slope > penalty):
                if j in chosen:
                    continue
                trial = [*chosen, int(j)]
                w = _em(p[:, trial], np.append(share * 0.9, 0.1), n)
                gain = float(n @ np.log(p[:, trial] @ w)) + offset - value
                if gain > penalty and (found is None or gain > found[0]):
                    found = gain, trial, w
            if found is None:
                break
            value, chosen, share = value + found[0], found[1], found[2]
        return {self.languages[i]: float(s) for i, s in zip(chosen, share)}

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.proportions(text)
        if not found:
            return UNKNOWN, 0.0
        lang = min(found, key=lambda k: (-found[k], k))
        return lang, min(1.0, found[lang])


def _em(p: np.ndarray, w: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """Proportions after expectation-maximisation; each row of ``p`` counts ``n`` times."""
    n = np.ones(len(p)) if n is None else n
    for _ in range(ROUNDS):
        new = (n / (p @ w)) @ p * w / n.sum()
        if np.abs(new - w).max() < 1e-4:
            return new
        w = new
    return w


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Mixture:
    """The mixture model of all labelled documents.

    Counting runs in one narrow pass with one dense table per language and task, then a map-side combined
    sum.  At most ``BUCKETS`` rows for each language reach the driver, whatever the size of the corpus.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, buckets, n = counts.column("lang").to_pylist(), counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    languages = sorted(set(names))
    place = {lang: i for i, lang in enumerate(languages)}
    table = np.zeros((BUCKETS, len(languages)))
    table[buckets, np.array([place[x] for x in names], np.int64)] = n
    table += ALPHA
    return Mixture(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def identified(text: Column, model: Mixture) -> Column:
    """Struct of ``lang_pred`` and ``score``."""
    def run(texts: pa.Array) -> pa.Array:
        rows = [model.predict(t) for (t,) in values(texts)]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(run, "struct<lang_pred:string,score:double>").asNondeterministic()(text.cast("string"))
