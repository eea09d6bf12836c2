"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses. A lexicon writes each word as a class (insult, threat verb, frame of a threat, target,
negator, reporting verb, quotation mark, other), and four weighted transducers read the classes one after the other:

* reported speech marks heads (insults, threat verbs) inside quotation marks or after a reporting verb,
* negation marks heads in the reach of a negator,
* threat turns a verb into a threat if a frame precedes it or it opens the clause as a command to a target,
* target marks insults and threats that have a target near, before or after.

Some of that is only known later in the clause (whether a quotation closes, whether a target follows), so the machines
guess and accept only if the guess comes true; a guess that explains less costs more. Their composition, built state
by state as clauses need it, writes the events of a clause along its cheapest path, and a clause counts as its
gravest event: a plain insult or threat wins over a reported or negated one. The weights of the events in the score
of a text, and which further word stems the lexicon takes for insults, are learned from labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import fold

# The words of the lexicon.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid dumb imbecile imbeciles cretin fool fools loser losers scum trash clown clowns "
    "worthless pathetic disgusting vermin filth filthy scumbag jerk jackass bastard bitch dumbass asshole retard retarded "
    "connard connasse salaud imbécile crétin débile dummkopf arschloch trottel vollidiot abschaum idiota estúpido estúpida imbécil gilipollas"
).split()
THREAT_VERBS = "kill hurt destroy murder stab shoot beat strangle burn tuer détruire töten umbringen matar destruir".split()
THREAT_FRAMES = "will shall gonna going should must deserve deserves ll vais va werde werden voy va".split()
TARGETS = (
    "you your yours u ya thou yourself yourselves he she they them him her their these those people everyone nobody "
    "tu toi vous votre te du dich dir dein sie ihr tú usted vosotros"
).split()
NEGATORS = "not no never neither nor without cannot pas jamais aucun nicht kein keine nie nunca ningún jamás".split()
REPORTERS = "said says say wrote writes called calls quoted quotes claimed claims reported reports alleged dit écrit sagte schrieb dijo escribió".split()

SYMBOLS = ("insult", "insult_aimed", "threat", "threat_aimed", "negated", "reported")
#: Events from the gravest on.
_GRAVITY = ("threat_aimed", "insult_aimed", "threat", "insult", "reported", "negated")
FOLDS = 5
#: Words over which a negator, a reporting verb and a frame reach, and within which a target precedes or follows.
NEGATION_SPAN, REPORT_SPAN, FRAME_SPAN, TARGET_BEFORE, TARGET_AFTER = 3, 6, 4, 6, 4
#: Costs of taking a quotation mark as stray and of a head without target.
STRAY, LOOSE = 2, 1
#: Most labelled rows that are learned from; lengths of stems.
TRAIN_ROWS = 12_000
STEM_LENGTHS = range(3, 13)

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[.!?;:\n]|[\"“”«»]")
_STOP = frozenset(".!?;:\n")
_QUOTE = frozenset("\"“”«»")

# An arc is (written symbol, next state, cost); a machine is its start, its arcs and which states may end a clause.


def _marked(symbol: str, mark: str, on: bool) -> str:
    return symbol + mark if on and symbol.split("/")[0] in ("insult", "verb") else symbol


class Reported:
    """States: words left in the reach of a reporting verb; whether a quotation is open."""

    start = (0, False)

    def arcs(self, state, symbol: str) -> Iterator[tuple]:
        left, quoted = state
        after = max(0, left - 1)
        if symbol == "quote":
            yield "pause", (after, not quoted), 0
            if not quoted:
                yield "pause", (after, False), STRAY
        elif symbol == "report":
            yield "other", (REPORT_SPAN, quoted), 0
        else:
            yield _marked(symbol, "/reported", quoted or left > 0), (after, quoted), 0

    def ends(self, state) -> bool:
        return not state[1]


class Negation:
    """State: words left in the reach of a negator."""

    start = 0

    def arcs(self, state, symbol: str) -> Iterator[tuple]:
        if symbol == "neg":
            yield "other", NEGATION_SPAN, 0
        else:
            yield _marked(symbol, "/negated", state > 0), max(0, state - 1), 0

    def ends(self, state) -> bool:
        return True


class Threat:
    """States: whether the clause is still to open; words left in the reach of a frame; words left in which a command's
    target must follow (0: none is due)."""

    start = (True, 0, 0)

    def arcs(self, state, symbol: str) -> Iterator[tuple]:
        opens, framed, due = state
        if due == 1 and symbol != "target":
            return  # the target did not come
        due = 0 if symbol == "target" else max(0, due - 1)
        rest = max(0, framed - 1)
        if symbol == "frame":
            yield "other", (False, FRAME_SPAN, due), 0
        elif symbol.startswith("verb"):
            threat = "threat" + symbol.removeprefix("verb")
            if framed:
                yield threat, (False, rest, due), 0
            else:
                yield "other", (False, rest, due), 1
                if opens:
                    yield threat, (False, rest, TARGET_AFTER), 0
        else:
            yield symbol, (opens and symbol == "pause", rest, due), 0

    def ends(self, state) -> bool:
        return state[2] == 0


class Target:
    """States: words since the last target (TARGET_BEFORE + 1: longer); words left in which a promised one must follow."""

    start = (TARGET_BEFORE + 1, 0)

    def arcs(self, state, symbol: str) -> Iterator[tuple]:
        since, due = state
        if due == 1 and symbol != "target":
            return
        due = 0 if symbol == "target" else max(0, due - 1)
        since = 0 if symbol == "target" else min(TARGET_BEFORE + 1, since + 1)
        head, _, marks = symbol.partition("/")
        if head not in ("insult", "threat"):
            yield None, (since, due), 0
            return
        mark = "reported" if "reported" in marks else "negated" if marks else None
        if since <= TARGET_BEFORE:
            yield mark or f"{head}_aimed", (since, due), 0
        else:
            yield mark or head, (since, due), LOOSE
            yield mark or f"{head}_aimed", (since, max(due, TARGET_AFTER)), 0

    def ends(self, state) -> bool:
        return state[1] == 0


class Composition:
    """Machines of which each reads what the one before it writes; states are made when a clause first needs them."""

    def __init__(self, *machines):
        self.machines = machines
        self.start = tuple(m.start for m in machines)
        self.known: dict[tuple, list[tuple]] = {}

    def arcs(self, state: tuple, symbol: str) -> list[tuple]:
        """(event or None, next state, cost) of all paths through the machines for one symbol; equal ends keep the cheapest."""
        if (state, symbol) not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            paths = [(symbol, (), 0)]
            for machine, at in zip(self.machines, state):
                paths = [(out, (*done, to), cost + more) for read, done, cost in paths for out, to, more in machine.arcs(at, read)]
            cheapest: dict[tuple, int] = {}
            for event, to, cost in paths:
                cheapest[event, to] = min(cost, cheapest.get((event, to), cost))
            self.known[state, symbol] = [(event, to, cost) for (event, to), cost in cheapest.items()]
        return self.known[state, symbol]

    def ends(self, state: tuple) -> bool:
        return all(m.ends(s) for m, s in zip(self.machines, state))

    def gravest(self, symbols: list[str]) -> str | None:
        """The gravest event on the cheapest accepted path of a clause; of equal costs the graver path. None: no event."""
        none = len(_GRAVITY)
        alive = {self.start: (0, none)}
        for symbol in symbols:
            after: dict[tuple, tuple[int, int]] = {}
            for state, (cost, grave) in alive.items():
                for event, to, more in self.arcs(state, symbol):
                    found = (cost + more, min(grave, _GRAVITY.index(event)) if event else grave)
                    if to not in after or found < after[to]:
                        after[to] = found
            alive = after
        best = min((found for state, found in alive.items() if self.ends(state)), default=(0, none))
        return None if best[1] == none else _GRAVITY[best[1]]


def composed() -> Composition:
    return Composition(Reported(), Negation(), Threat(), Target())


class Grammar:
    """The lexicon in front of the composed machines."""

    def __init__(self, insults=INSULTS, stems=()):
        self.stems = frozenset(stems)
        self.stem_lengths = sorted({len(s) for s in stems})
        self.listed = {w: kind for kind, words in (("target", TARGETS), ("frame", THREAT_FRAMES), ("report", REPORTERS), ("neg", NEGATORS), ("verb", THREAT_VERBS), ("insult", insults)) for w in words}
        self.known: dict[str, tuple[str, ...]] = {}
        self.machine = composed()

    def _kind(self, word: str) -> str:
        if kind := self.listed.get(word):
            return kind
        return "insult" if any(word[:n] in self.stems for n in self.stem_lengths) else "other"

    def classes(self, token: str) -> tuple[str, ...]:
        """The classes of a token; contractions are several words, and n't is a negator."""
        if token not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            if token in _QUOTE:
                found = ("quote",)
            elif token.endswith("n't"):
                found = ("frame", "neg") if token in ("won't", "shan't") else ("neg",)
            else:
                found = tuple(map(self._kind, token.split("'")))
            self.known[token] = found
        return self.known[token]

    def clauses(self, text: str) -> Iterator[list[str]]:
        """The classes of each clause that holds a head."""
        tokens = _TOKEN.findall(text.lower().replace("’", "'"))
        clause: list[str] = []
        head = False
        for token in [*tokens, "."]:
            if token in _STOP:
                if head:
                    yield clause
                clause, head = [], False
            else:
                found = self.classes(token)
                clause += found
                head = head or "insult" in found or "verb" in found

    def counts(self, text: str | None) -> list[int]:
        """Matched clauses of a whole text, by symbol."""
        out = dict.fromkeys(SYMBOLS, 0)
        for clause in self.clauses(text or ""):
            if event := self.machine.gravest(clause):
                out[event] += 1
        return list(out.values())


def _inputs(counts: np.ndarray) -> np.ndarray:
    """Whether and how often each symbol was written, and whether any plain one was."""
    plain = counts[:, :4].sum(1, keepdims=True)
    return np.concatenate([np.log1p(counts), plain > 0], 1).astype(np.float64)


class Weights:
    """Logistic weights of the symbols; they cannot be negative except those of negated and reported clauses."""

    def __init__(self, counts: np.ndarray, toxic: np.ndarray, penalty: float = 1.0, steps: int = 500):
        x, y = _inputs(counts), toxic.astype(np.float64)
        # A prior of one clear case of each kind keeps the weights finite and sensible on small samples.
        prior = np.zeros((7, len(SYMBOLS)))
        prior[np.arange(6), np.arange(6)] = 1
        x, y = np.concatenate([x, _inputs(prior)]), np.concatenate([y, [1, 1, 1, 1, 0, 0, 0]])
        w = np.zeros(x.shape[1] + 1)
        z = np.concatenate([x, np.ones((len(x), 1))], 1)
        for _ in range(steps):  # Newton steps, damped
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (p - y) + penalty * np.append(w[:-1], 0)
            hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(np.append(np.full(x.shape[1], penalty), 1e-6))
            step = np.linalg.solve(hess, grad)
            w -= step * min(1, 2 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        w[[0, 1, 2, 3, 6]] = np.maximum(w[[0, 1, 2, 3, 6]], 0)
        self.w = w

    def score(self, counts: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(_inputs(np.array([counts], float))[0] @ self.w[:-1] + self.w[-1], -30, 30))))


def _stems(texts: pd.Series) -> pd.DataFrame:
    """Distinct stems of each document with the words around the first use."""
    rows = []
    for text in texts:
        tokens = ["", *(t for t in _TOKEN.findall((text or "").lower().replace("’", "'")) if len(t) > 2), ""]
        seen: dict[str, str] = {}
        for i in range(1, len(tokens) - 1):
            for n in STEM_LENGTHS:
                if n <= len(tokens[i]):
                    seen.setdefault(tokens[i][:n], f"{tokens[i - 1]} {tokens[i + 1]}")
        rows += seen.items()
    return pd.DataFrame(rows, columns=["stem", "context"])


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most about ``rows`` labelled documents of the training folds (crc32 of doc_id mod 5 is not 0), by hash.

    Labels without doc_id or toxic are left out; of several labels of a document the highest counts, of several texts
    with one doc_id the first in code point order. The drawn labels are bounded by the parameter, so they are
    broadcast to the documents.
    """
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def learn_stems(train: DataFrame) -> list[str]:
    """Word stems (the first 3 to 12 letters) that mark toxic documents in many different contexts.

    Copies of one document repeat a word in one context, so a stem needs at least 8 distinct contexts, half as many
    as the toxic documents that hold it, and 9 toxic documents of 10. Both counts are made and compared on the
    executors; only stems that pass are collected. A stem grows while a longer one has nearly its support.
    """

    def explode(batches):
        for pdf in batches:
            yield _stems(pdf["text"])

    def count(batches):
        for pdf in batches:
            yield _stems(pdf["text"])["stem"].value_counts().rename_axis("s").reset_index(name="n")

    uses = train.where("toxic = 1").select("text").mapInPandas(explode, "stem string, context string")
    stats = uses.groupBy("stem").agg(F.count(F.lit(1)).alias("p"), F.approx_count_distinct("context", 0.02).alias("c"))
    often = stats.where((F.col("c") >= 8) & (2 * F.col("c") >= F.col("p")))
    clean = train.where("toxic <> 1").select("text").mapInPandas(count, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))
    passed = often.join(clean, F.col("stem") == F.col("s"), "left").where(F.col("p") >= 9 * F.coalesce("n", F.lit(0)))
    marked = {row["stem"]: row["p"] for row in passed.select("stem", "p").collect()}
    chosen: list[str] = []
    for stem in sorted(marked, key=lambda s: (len(s), s)):
        if not any(stem.startswith(x) for x in chosen):
            while longer := [x for x in _longer(stem, marked) if marked[x] >= 0.9 * marked[stem]]:
                stem = max(longer, key=lambda x: (marked[x], x))
            chosen.append(stem)
    return sorted(set(chosen))


def _longer(stem: str, marked: dict[str, int]) -> list[str]:
    return [x for x in marked if len(x) == len(stem) + 1 and x.startswith(stem)]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Grammar, Weights]:
    train = sample(docs, labels, rows).persist()
    try:
        grammar = Grammar(INSULTS, learn_stems(train))
        count = F.pandas_udf(lambda texts: texts.map(grammar.counts), "array<int>")
        found = train.select("toxic", count("text").alias("counts")).toPandas()
    finally:
        train.unpersist()
    counts = np.array(found["counts"].tolist(), float).reshape(-1, len(SYMBOLS))
    return grammar, Weights(counts, found["toxic"].to_numpy() == 1)


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and the matched clauses for every row of ``docs`` (doc_id, text).

    Null and empty texts match no clause and get the score of the intercept, as does any text without a match. A
    null doc_id counts as the empty text in the split (fold 0, held out). Without labels only the prior decides.
    Very long texts are read whole, clause by clause; repeated rows are scored each; other columns are ignored; no rows give no rows.
    """
    grammar, weights = fit(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast((grammar, weights))

    def judge(texts: pd.Series) -> pd.DataFrame:
        g, w = shared.value
        counts = [g.counts(t) for t in texts]
        out = pd.DataFrame(counts, columns=[f"n_{s}" for s in SYMBOLS], dtype="int64")
        out.insert(0, "score", [w.score(c) for c in counts])
        return out

    schema = "score double, " + ", ".join(f"n_{s} long" for s in SYMBOLS)
    judged = docs.select("doc_id", F.pandas_udf(judge, schema)(F.col("text")).alias("j"))
    return judged.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "j.score", F.when(F.col("j.score") >= 0.5, 1).otherwise(0).alias("predicted"), *(f"j.n_{s}" for s in SYMBOLS))
