"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts are linked if the Jaccard similarity of their sets of word 5-grams is at least 0.8. Candidates share a band
of a MinHash signature. Candidate pairs compare their signatures a few values at a time: with m of n values equal,
the posterior (uniform prior) that the similarity reaches the threshold is a beta tail, and a pair is dropped once it
falls below a tolerance. The pairs that are left are verified exactly on their shingle sets.

Equal texts are one class from the start. Classes that share a band form components (one edge per class and band,
never pairs). Two passes go over components, each in blocks of bounded size, a pair of blocks at a time:

* pruning moves signatures only (500 bytes a class) and returns a spanning forest of the pairs that survive, which
  cuts components that hang together by weak bands into small ones and drops the classes without any partner;
* verification moves the texts of what is left, counts links and returns a spanning forest of them.

No pair is ever a row: what Spark stores is linear in the classes. A component of n different texts is compared pair
by pair, as the number of links of each asks for; its classes are sent to n / BLOCK_CLASSES tasks each.
"""

from __future__ import annotations

from functools import lru_cache
from math import lgamma

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import WORD, checkpointed, free_name, hot_keys, meet

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: Bands and signature values in a band: at similarity 0.8 a pair shares no band with probability 5e-5.
BANDS, ROWS = 25, 5
#: A pair is dropped when the posterior of reaching the threshold is below this; values compared in a step.
TOLERANCE, STEP = 1e-6, 25
#: Classes and characters of text in a block of a component.
BLOCK_CLASSES, BLOCK_CHARS = 2048, 8_000_000
_SIZE = BANDS * ROWS
_FACTORS = np.random.default_rng(20240607).integers(0, 1 << 32, (2, _SIZE), dtype=np.uint64).astype(np.uint32)
_FACTORS[0] |= 1
_PIECE = 1 << 15


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words, apart at ASCII white space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def shingles(words: list[bytes], seen: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-grams; fewer words are one shingle, no words none."""
    if not words:
        return np.zeros(0, np.uint64)
    for w in words:
        if w not in seen:
            seen[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter((seen[w] for w in words), np.uint64, len(words))
    width = min(SHINGLE_WORDS, len(h))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - width + 1, np.uint64)
        for i in range(width):
            out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        if width < SHINGLE_WORDS:
            out ^= np.uint64(width)
    return np.unique(out)


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty shingle set."""
    x = (grams >> np.uint64(32)).astype(np.uint32)[None, :]
    least = np.full(_SIZE, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, x.shape[1], _PIECE):
            mixed = (x[:, at : at + _PIECE] ^ _FACTORS[1][:, None]) * _FACTORS[0][:, None]
            least = np.minimum(least, mixed.min(1))
    return least


def bands(sig: Column) -> Column:
    """One hash per band of a packed signature; the band's number is part of it."""
    return F.array(*(F.xxhash64(F.substring(sig, 4 * ROWS * i + 1, 4 * ROWS), F.lit(i)) for i in range(BANDS)))


@lru_cache(maxsize=None)
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values of n with which a pair stays: posterior P(similarity >= threshold) >= tolerance."""
    grid = (np.arange(4000) + 0.5) / 4000
    for m in range(n + 1):
        log = lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(grid) + (n - m) * np.log1p(-grid)
        if np.exp(log[grid >= threshold]).sum() / 4000 >= tolerance:
            return m
    return n + 1


def survivors(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs (a[i], b[i]) of rows of the two signature tables stay after all steps."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int16)
    for start in range(0, left.shape[1], STEP):
        stop = min(start + STEP, left.shape[1])
        matches[alive] += (left[a[alive], start:stop] == right[b[alive], start:stop]).sum(1).astype(np.int16)
        alive = alive[matches[alive] >= least_matches(stop, threshold, tolerance)]
        if not len(alive):
            break
    return alive


def _common(sets_a: list, sets_b: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs."""
    if len(a) < 64 or len(a) < 0.02 * len(sets_a) * len(sets_b):
        return np.array([len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    # Many pairs: a product of the two membership tables, some columns (shingles) at a time.
    every = np.unique(np.concatenate([*sets_a, *sets_b]))
    total = np.zeros((len(sets_a), len(sets_b)), np.float32)
    where = [[np.searchsorted(every, s) for s in sets] for sets in (sets_a, sets_b)]
    for start in range(0, len(every), 4096):
        tables = []
        for places in where:
            table = np.zeros((len(places), 4096), np.float32)
            for i, p in enumerate(places):
                lo, hi = np.searchsorted(p, (start, start + 4096))
                table[i, p[lo:hi] - start] = 1
            tables.append(table)
        total += tables[0] @ tables[1].T
    return total[a, b].astype(np.int64)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _surviving(sigs: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float):
    """(rows of left, a, b): some rows of the pair table at a time, the pairs (rows[a], right[b]) that stay."""
    same = left is right
    for start in range(0, len(left), 128):
        rows = left[start : start + 128]
        a, b = np.repeat(np.arange(len(rows)), len(right)), np.tile(np.arange(len(right)), len(rows))
        if same:
            keep = b > a + start
            a, b = a[keep], b[keep]
        stay = survivors(sigs[rows], sigs[right], a, b, threshold, tolerance)
        if len(stay):
            yield rows, a[stay], b[stay]


def _forest_rows(keys: list, a: np.ndarray, b: np.ndarray, forest: _Forest) -> None:
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = forest.root(i), forest.root(j)
        if x != y:
            forest.up[max(x, y)] = min(x, y)


def prune(keys: list, sigs: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> list[tuple]:
    """(key, root key) of every class that survives with a partner: pairs of left x right, or within left if they are one."""
    forest, met = _Forest(len(keys)), np.zeros(len(keys), bool)
    for rows, a, b in _surviving(sigs, left, right, threshold, tolerance):
        a, b = rows[a], right[b]
        met[a] = met[b] = True
        # One pair for each row and root is enough for a forest.
        _forest_rows(keys, a, b, forest)
    return [(keys[i], keys[forest.root(i)]) for i in np.flatnonzero(met)]


def link(keys: list, texts: list, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> list[tuple]:
    """(key, links, root key) of every class that has a link: pairs of left x right, or within left if they are one."""
    seen: dict = {}
    sets = [shingles(words_of(t), seen) for t in texts]
    sigs = np.stack([signature(s) for s in sets])
    lengths = np.array([len(s) for s in sets])
    n_links = np.zeros(len(keys), np.int64)
    forest = _Forest(len(keys))
    for rows, a, b in _surviving(sigs, left, right, threshold, tolerance):
        common = _common([sets[i] for i in rows], [sets[i] for i in right], a, b)
        a, b = rows[a], right[b]
        similar = common >= threshold * (lengths[a] + lengths[b] - common) - 1e-9
        a, b = a[similar], b[similar]
        np.add.at(n_links, a, sizes[b])
        np.add.at(n_links, b, sizes[a])
        _forest_rows(keys, a, b, forest)
    return [(keys[i], int(n_links[i]), keys[forest.root(i)]) for i in np.flatnonzero(n_links)]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph of (a, b) edges; component is the smallest node.

    Alternating large and small stars: every round is a fixed number of aggregations and joins over the edges, each half
    cut by a checkpoint; rounds grow with the logarithm of the longest path. Minima are combined before the shuffle, and
    the few nodes with very many edges are joined by broadcast, so no task gets all edges of a node.
    """
    current = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if current.isEmpty():
        return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while not _settled(current):
        # Every node with its smallest neighbour; the larger neighbours move there. Only smaller ends can have that many
        # edges that they are hot: of the larger ends each edge has its own or few.
        both = current.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = meet(both.where("v > u"), least, "u", "w", hot_keys(current, "v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Read three times from here: without a cut the plan would hold it three times, and the driver plans, draws and
        # keeps every version of it.
        large = checkpointed(large)
        # Then every node moves its smaller neighbours, of which hubs have none, to the smallest.
        down = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        moved = large.join(down, F.col("u") == F.col("w"))
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        current = checkpointed(small)
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return checkpointed(current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))


def _settled(edges: DataFrame) -> bool:
    """Whether all larger ends have one edge and are no smaller ends: each node hangs at the smallest of its component."""
    end = lambda node, up: F.struct(F.col(node).alias("w"), F.lit(up).alias("up"), F.lit(1 - up).alias("low"))
    ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).select("e.*")
    return not ends.groupBy("w").agg(F.sum("up").alias("up"), F.max("low").alias("low")).agg(F.expr("bool_or(up + low > 1 AND up > 0)")).first()[0]


def _signatures(texts: pd.Series) -> pd.Series:
    """Packed signatures; None without words."""
    out, seen = [], {}
    for text in texts:
        if len(seen) > 300_000:
            seen.clear()
        grams = shingles(words_of(text), seen)
        out.append(signature(grams).tobytes() if len(grams) else None)
    return pd.Series(out, dtype=object)


def _blocks(placed: DataFrame, block_classes: int, block_chars: int) -> DataFrame:
    """``placed`` (key, component, chars, ...) dealt to the tasks that compare it: component, block, low, high, task.

    A component is cut into blocks by hash; each pair of blocks (low, high) is a task of its own, and components of
    one block are put together to batches.
    """
    extent = placed.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("classes"), F.sum("chars").alias("chars"))
    cuts = F.greatest(F.ceil(F.col("classes") / block_classes), F.ceil(F.col("chars") / block_chars)).cast("int")
    extent = checkpointed(extent.select("c", "classes", "chars", cuts.alias("blocks")))
    small = F.col("blocks") <= 1
    of_small = lambda column: F.coalesce(F.sum(F.when(small, F.col(column))), F.lit(0))
    *whole, n = extent.agg(of_small("classes"), of_small("chars"), F.coalesce(F.sum("classes"), F.lit(0))).first()
    hot = _hot(extent, "c", "classes", n)
    batches = max(1, -(-whole[0] // block_classes), -(-whole[1] // block_chars))
    dealt = meet(placed, extent.select("c", F.greatest("blocks", F.lit(1)).alias("blocks")), "component", "c", hot)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    task = F.when(F.col("blocks") == 1, F.concat(F.lit("batch "), F.pmod(F.xxhash64("component"), F.lit(batches)))).otherwise(F.concat_ws(" ", "component", low, high))
    return dealt.withColumns({"low": low, "high": high, "task": task}).drop("c", "other")


def _hot(counted: DataFrame, key: str, n: str, total: int) -> list:
    """The keys with more than 1/256 of all rows, by their counts: fewer than 256."""
    return [row[key] for row in counted.where(F.col(n) * 256 > total).select(key).collect()]


def _parts(pdf: pd.DataFrame):
    """(rows by key, left, right, whole) of every pair of blocks in a task's rows; whole: the component has one block."""
    for _, part in pdf.groupby(["component", "low", "high"], sort=False):
        part = part.drop_duplicates("key").sort_values("key")
        block, low = part["block"].to_numpy(), part["low"].iloc[0]
        left = np.flatnonzero(block == low)
        right = left if part["high"].iloc[0] == low else np.flatnonzero(block != low)
        yield part, left, right, bool(part["blocks"].iloc[0] == 1)


def _grown(forest: DataFrame) -> DataFrame:
    """(node, component) from the forests of all tasks (key, root, whole): those of a whole component are final, those
    of pairs of blocks are put together."""
    final = forest.where("whole").select(F.col("key").alias("node"), F.col("root").alias("component"))
    return final.unionByName(components(forest.where("NOT whole").select(F.col("key").alias("a"), F.col("root").alias("b"))))


def join_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block_classes: int = BLOCK_CLASSES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, n_docs, first_id, has_words, group, linked): one row for each distinct text of ``docs`` (doc_id, text).

    key: digest of the text; n_docs, first_id: rows with it and their smallest doc_id; linked: documents of other
    texts that are similar; group: smallest key of the connected component of links.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.md5("text"))
    signed = keyed.select("doc_id", "key", F.pandas_udf(_signatures, "binary")(F.col("text")).alias("sig"), F.length("text").alias("chars"))
    # One row for each distinct text, whatever its number of copies; combined before the shuffle.
    classes = checkpointed(
        signed.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_id"), F.max("chars").alias("chars"), F.max("sig").alias("sig"))
    )
    n_docs, n_cells = classes.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.count("sig") * BANDS).first()
    cells = classes.where("sig IS NOT NULL").select("key", F.explode(bands(F.col("sig"))).alias("band"))
    shared = checkpointed(cells.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select(F.col("band").alias("b"), "least", "n"))
    candidates = components(meet(cells, shared.drop("n"), "band", "b", _hot(shared, "b", "n", n_cells)).select(F.col("key").alias("a"), F.col("least").alias("b")))

    placed = candidates.join(classes.select("key", "chars", "sig"), F.col("node") == F.col("key")).select("key", "component", "sig", F.lit(0).cast("long").alias("chars"))

    def prune_task(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for part, left, right, whole in _parts(pdf):
            sigs = np.stack([np.frombuffer(s, np.uint32) for s in part["sig"]])
            rows += [(*row, whole) for row in prune(part["key"].tolist(), sigs, left, right, threshold, tolerance)]
        return pd.DataFrame(rows, columns=["key", "root", "whole"])

    survived = _blocks(checkpointed(placed), 4 * block_classes, block_chars).select("key", "sig", "component", "blocks", "block", "low", "high", "task")
    near = _grown(checkpointed(survived.groupBy("task").applyInPandas(prune_task, "key string, root string, whole boolean")))

    # Texts of the survivors: of a class, the row with its first id, once.
    wanted = checkpointed(near.join(classes.select("key", "n_docs", "first_id", "chars"), F.col("node") == F.col("key")).select("key", "component", "n_docs", "first_id", "chars"))
    first = wanted.select(F.col("key").alias("k"), "first_id")
    fetched = meet(keyed, first, "key", "k", _hot(classes, "key", "n_docs", n_docs)).where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    texts = fetched.groupBy("key").agg(F.first("text").alias("text"))
    work = _blocks(wanted, block_classes, block_chars).withColumnRenamed("key", "k").drop("first_id", "chars")

    def verify_task(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for part, left, right, whole in _parts(pdf):
            rows += [(*row, whole) for row in link(part["key"].tolist(), part["text"].tolist(), part["n_docs"].to_numpy(np.int64), left, right, threshold, tolerance)]
        return pd.DataFrame(rows, columns=["key", "links", "root", "whole"])

    met = work.join(texts, F.col("k") == F.col("key")).select("key", "text", "n_docs", "component", "blocks", "block", "low", "high", "task")
    linked = checkpointed(met.groupBy("task").applyInPandas(verify_task, "key string, links long, root string, whole boolean"))
    groups = _grown(linked)
    links = linked.groupBy(F.col("key").alias("lk")).agg(F.sum("links").alias("linked"))
    found = classes.select("key", "n_docs", "first_id", F.col("sig").isNotNull().alias("has_words"))
    return (
        found.join(links, F.col("key") == F.col("lk"), "left")
        .join(groups, F.col("key") == F.col("node"), "left")
        .select("key", "n_docs", "first_id", "has_words", F.coalesce("component", "key").alias("group"), F.coalesce("linked", F.lit(0)).alias("linked"))
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, n_links, group_size for every row of ``docs`` (doc_id, text).

    n_links: the other rows whose text is at least ``threshold`` similar, copies included. class_id: the smallest
    doc_id of the connected component of links (its smallest id that is not null; null if there is none). Texts
    without words (null or empty ones among them) are linked to nothing: each is a class of its own with its own
    doc_id. Texts of fewer than five words are one shingle, so they link to equal word sequences only. Rows that
    repeat are copies of each other; other columns are ignored; no rows give no rows.
    """
    classes = checkpointed(join_classes(docs, threshold, tolerance))
    n_classes, n_docs = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    groups = checkpointed(classes.groupBy(F.col("group").alias("g")).agg(F.min("first_id").alias("class_id"), F.sum("n_docs").alias("group_size"), F.count(F.lit(1)).alias("n")))
    answer = checkpointed(meet(classes, groups, "group", "g", _hot(groups, "g", "n", n_classes)).select(F.col("key").alias("k"), "has_words", "class_id", "group_size", "n_docs", (F.col("linked") + F.col("n_docs") - 1).alias("n_links")))
    rows = meet(docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key")), answer, "key", "k", _hot(answer, "k", "n_docs", n_docs))
    alone = ~F.col("has_words")
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, 1).otherwise(F.col("group_size")).cast("long").alias("group_size"),
    )


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs``, all columns: of each group of near duplicates the row with the smallest doc_id.

    Null ids come last; of equal ids with different texts that with the smaller digest stays. Of rows that repeat id and
    text one stays, any of them where further columns differ. Texts without words all stay.
    """
    columns = docs.columns
    key, found, of, id_ = (free_name(docs, n) for n in ("key", "found", "of", "id"))
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    has_words = F.coalesce(F.col("text").rlike(f"(?s){WORD}"), F.lit(False))
    classes = checkpointed(join_classes(docs, threshold, tolerance).where("has_words").select(F.col("key").alias("k"), "group", "n_docs"))
    n_docs = classes.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    slim = keyed.where(has_words).select("doc_id", F.col(key).alias("key")).groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = meet(slim, classes, "key", "k", _hot(classes, "k", "n_docs", n_docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "n")).alias("first")
    winners = checkpointed(ranked.groupBy("group").agg(first).select(F.col("first.doc_id").alias(id_), F.col("first.key").alias(of), F.col("first.n").alias(found)))
    kept = keyed.where(has_words).join(winners, (F.col(key) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(id_)))
    repeated = kept.where(F.col(found) > 1).dropDuplicates([key])  # a text that wins has one winning id
    every = kept.where(F.col(found) == 1).unionByName(repeated).select(*(f"`{c}`" for c in columns))
    return every.unionByName(docs.where(~has_words))
