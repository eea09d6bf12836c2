"""Language identification by hierarchical discrimination.

A linear support vector machine per language family predicts the family first; inside it, one-versus-one linear
machines separate the closely related languages by votes. Features are relative frequencies of byte trigrams of the
lower-cased letters, hashed to a fixed number of slots. Every machine is linear in them, so scoring a text is one
table look-up per byte and one sum per machine, whatever the length of the text.

Machines only tell the learned languages apart, so each language also keeps a profile: how likely its texts are under
its own trigram frequencies. The score of a prediction is the margin of the family, times that of the closest rival in
it, times how typical the text is of the predicted language; all three are 0 in doubt and 1 when sure.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import checkpointed, fold, free_name

# Language codes by family. Codes that are not listed form a family of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "pa", "gu", "ne"),
    "sinitic": ("zh", "yue"),
    "semitic": ("ar", "he", "mt", "am"),
}
UNKNOWN = "und"
#: Slots of the hashed features (a power of two), folds of the split, and the most training rows taken per language.
SLOTS = 4096
FOLDS = 3
TRAIN_ROWS_PER_LANGUAGE = 1500
#: Most training rows in all: with many languages each gets an equal part, so the matrix has a fixed bound (160 MB).
TRAIN_ROWS = 10_000
#: Most languages that are learned, those with the most training rows first.
MOST_LANGUAGES = 200
#: Deviations below the learned texts of a language at which a text is as likely of no learned language.
TYPICAL = 8.0
_SHIFT = np.uint32(32 - SLOTS.bit_length() + 1)
#: Bytes of text that are turned into slots at once.
_CHUNK = 1 << 21


def family(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), f"only {lang}")


def _letters() -> np.ndarray:
    """Byte map: ASCII letters lower-cased, bytes of other scripts kept, the rest a space."""
    keep = np.full(256, 32, np.uint8)
    keep[128:] = np.arange(128, 256)
    keep[97:123] = np.arange(97, 123)
    keep[65:91] = np.arange(97, 123)
    return keep


_LETTERS = _letters()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _slots(data: np.ndarray) -> np.ndarray:
    """The slot of the trigram that starts at each byte but the last two."""
    x = _LETTERS[data].astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    code *= np.uint32(2654435761)
    return (code >> _SHIFT).astype(np.int32)


def _spread(text: str):
    """The bytes of a text between spaces, in chunks that overlap by two bytes."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
    for start in range(0, max(1, len(data) - 2), _CHUNK):
        yield data[start : start + _CHUNK + 2]


def features(text: str) -> np.ndarray:
    counts = np.zeros(SLOTS, np.int64)
    for part in _spread(text):
        counts += np.bincount(_slots(part), minlength=SLOTS)
    return (counts / max(1, counts.sum())).astype(np.float32)


def packed(x: np.ndarray) -> bytes:
    """The values of the slots that are not 0, then those slots: of most texts a small part of all."""
    slots = np.flatnonzero(x)
    return x[slots].astype(np.float32).tobytes() + slots.astype(np.uint16).tobytes()


def unpack(data: bytes, into: np.ndarray) -> None:
    """Puts what ``packed`` gave into a row of zeros."""
    n = len(data) // 6
    into[np.frombuffer(data, np.uint16, n, 4 * n)] = np.frombuffer(data, np.float32, n)


def _machine(x: np.ndarray, positive: np.ndarray, rows: np.ndarray | None = None, penalty: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient descent over the chosen rows; classes weigh the same in total.

    Rows that are not chosen weigh nothing, so that no part of the matrix is copied.
    """
    rows = np.ones(len(x), bool) if rows is None else rows
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    of = lambda chosen: 0.5 / max(1, chosen.sum())
    weight = (np.where(positive, of(positive & rows), of(~positive & rows)) * rows).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, c = w.copy(), b
    rate = 1.0 / (2 * float((weight * (np.einsum("ij,ij->i", x, x) + 1)).sum()) + penalty)
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + c)) * weight * y
        w2, b2 = v + rate * (2 * (slack @ x) - penalty * v), c + rate * 2 * float(slack.sum())
        momentum = step / (step + 3)
        v, c = w2 + momentum * (w2 - w), b2 + momentum * (b2 - b)
        w, b = w2, b2
    return w, b


class Model:
    """Family machines and, for each family, one machine per pair of its languages."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs = langs
        self.groups: dict[str, list[str]] = {}
        for lang in langs:
            self.groups.setdefault(family(lang), []).append(lang)
        self.families = sorted(self.groups)
        scale = np.ones(SLOTS, np.float32)
        if len(x):  # the matrix is scaled where it lies, column by column
            scale = (1.0 / (np.array([column.std() for column in x.T]) + 1e-5)).astype(np.float32) / np.float32(np.sqrt(SLOTS))
            x *= scale
        of = np.array([family(lang) for lang in y], object)
        found = []
        if len(self.families) > 1:  # one against the rest; with two families the second mirrors the first
            found = [_machine(x, of == name) for name in (self.families if len(self.families) > 2 else self.families[:1])]
        self.n_family = len(found)
        self.pairs = []
        for name in self.families:
            for a, b in itertools.combinations(self.groups[name], 2):
                rows = (y == a) | (y == b)
                found.append(_machine(x, y == a, rows))
                self.pairs.append((name, a, b))
        if len(x):
            x /= scale
        self.profiles = {lang: Profile(x, np.flatnonzero(y == lang)) for lang in langs}
        columns = [w * scale for w, _ in found] + [self.profiles[lang].log for lang in langs]
        self.weights = np.stack(columns, 1) if columns else np.zeros((SLOTS, 0), np.float32)
        self.bias = np.array([b for _, b in found] + [0.0] * len(langs))

    def margins(self, text: str) -> tuple[np.ndarray, int]:
        """The value of every machine, then the mean log frequency under every profile; the number of trigrams."""
        total, n = np.zeros(len(self.bias)), 0
        for part in _spread(text):
            slots = _slots(part)
            total += np.bincount(slots, minlength=SLOTS) @ self.weights
            n += len(slots)
        return total / max(1, n) + self.bias, n

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or text is None or not has_letter(text):
            return UNKNOWN, 0.0
        values, n = self.margins(text)
        machines = len(values) - len(self.langs)
        sure = 1 / (1 + np.exp(-4 * np.clip(m := values[:machines], -50, 50)))
        chosen, score = 0, 1.0
        if self.n_family == 1:
            chosen, score = (0, sure[0]) if m[0] >= 0 else (1, 1 - sure[0])
        elif self.n_family > 1:
            chosen = int(np.argmax(m[: self.n_family]))
            score = sure[chosen]
        name = self.families[chosen]
        votes = dict.fromkeys(self.groups[name], 0.0)
        least = dict.fromkeys(self.groups[name], 1.0)
        for (of, a, b), p in zip(self.pairs, sure[self.n_family :]):
            if of == name:
                votes[a if p >= 0.5 else b] += 1
                least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        lang = max(votes, key=lambda k: (votes[k], least[k]))
        margin = max(0.0, 2 * float(score) - 1) * max(0.0, 2 * float(least[lang]) - 1)
        return lang, margin * self.profiles[lang].typical(float(values[machines + self.langs.index(lang)]), n)


class Profile:
    """Log frequencies of one language's trigrams, and how they vary from text to text."""

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        # Row by row, so that no part of the matrix is copied; texts weigh the same whatever their length.
        mean = np.zeros(SLOTS)
        for i in rows:
            mean += x[i]
        mean /= max(1, len(rows))
        self.log = np.log(0.99 * mean + 0.01 / SLOTS).astype(np.float32)
        own = np.array([float(x[i] @ self.log) for i in rows])
        self.mean = float(own.mean()) if len(own) else 0.0
        self.spread = float(own.std()) if len(own) else 1.0
        self.symbol = float(np.sqrt(mean @ (self.log - mean @ self.log) ** 2)) if len(own) else 1.0

    def typical(self, value: float, n: int) -> float:
        """1 for a text as likely as the learned ones, 1/2 at TYPICAL deviations below, towards 0 beyond.

        The deviation is that between texts, and for ``n`` trigrams that of a mean of so many.
        """
        deviation = np.sqrt(self.spread**2 + self.symbol**2 / max(1, n) + 1e-4)
        return float(1 / (1 + np.exp(np.clip(2 * ((self.mean - value) / deviation - TYPICAL), -50, 50))))


def fit(docs: DataFrame, rows_per_language: int = TRAIN_ROWS_PER_LANGUAGE) -> Model:
    """Learn from the rows of the training folds (crc32 of doc_id mod 3 is not 1) with text and lang.

    At most about ``rows_per_language`` rows of each language are taken, by a hash of doc_id and text, and at most
    TRAIN_ROWS in all; their features are made on the executors and only those (a number for each slot that a text has) reach
    the driver. At most MOST_LANGUAGES languages are learned.
    """
    train = docs.select("doc_id", "text", "lang").where((fold(F.col("doc_id"), FOLDS) != 1) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    by_lang = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {row["lang"]: row["n"] for row in by_lang.collect()}
    if not counts:
        return Model([], np.zeros((0, SLOTS), np.float32), np.zeros(0, object))
    rows_per_language = max(1, min(rows_per_language, TRAIN_ROWS // len(counts)))
    share = F.element_at(F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, rows_per_language / n)))), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)
    # Rows that repeat are drawn together, so they are learned from once.
    sample = train.where(F.col("lang").isin(list(counts)) & drawn).dropDuplicates(["doc_id", "text", "lang"]).select("lang", F.pandas_udf(lambda t: t.map(lambda s: packed(features(s))), "binary")(F.col("text")).alias("x"))
    # Written once, then read a few rows at a time into the one matrix that the driver holds.
    sample = checkpointed(sample)
    x, y = np.zeros((sample.count(), SLOTS), np.float32), []
    for row in sample.coalesce(8).toLocalIterator():
        unpack(row["x"], x[len(y)])
        y.append(row["lang"])
    return Model(sorted(set(y)), x, np.array(y, object))


def with_language(docs: DataFrame, model: Model, column: str = "language") -> DataFrame:
    """``docs`` with a struct column (lang_pred, score). Nulls and texts without a letter get (und, 0).

    ``column`` must be no column of ``docs``.
    """
    if column in docs.columns:
        raise ValueError(f"{column} is a column already")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"]).astype({"score": "float64"})

    return docs.withColumn(column, F.pandas_udf(predict, "lang_pred string, score double")(F.col("text")))


def keep_known(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language with at least ``least_score``."""
    column = free_name(docs, "language")
    judged = with_language(docs, fit(docs), column)
    sure = (F.col(f"{column}.lang_pred") != UNKNOWN) & (F.col(f"{column}.score") >= least_score)
    return judged.where(sure).select(*(f"`{c}`" for c in docs.columns))


def identify(docs: DataFrame, rows_per_language: int = TRAIN_ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    A null doc_id counts as the empty text in the split (fold 0, training). Null texts and texts without a letter
    are ``und`` with score 0, as is everything where nothing could be learned. Texts of any length are read whole,
    in chunks. Equal votes go to the language whose closest machine is surest, then to the first by code. Only the
    text enters a prediction; repeated rows are predicted each; other columns are ignored; no rows give no rows.
    """
    rows = with_language(docs.select("doc_id", "text"), fit(docs, rows_per_language))
    return rows.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 1).alias("held_out"), "language.lang_pred", "language.score")
