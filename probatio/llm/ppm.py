"""Language-model scoring by prediction by partial matching.

A byte-context trie (contexts of 0 to ORDER bytes) counts which byte follows which context in the training texts. A
byte is coded by the longest context that has seen it; longer ones pay an escape (method C: as likely as the number
of distinct symbols), and shorter ones exclude the symbols that the longer one has already ruled out. Counts are
those of the finished training pass (pretrained code length), so every distinct (context, byte) has one fixed cost.

Distribution: runs of rows of a partition are blocks of bounded size; they are dealt once and kept. A block emits its distinct grams (context and
byte, packed in a long) with their training counts, split by a hash of the last three context bytes, so that all longer
contexts with those last bytes are together. Merging goes up a tree: FAN blocks' parts become one, which is split SPLIT
times finer, until at most FAN units are left; there every gram's cost is computed, and the costs go back down the same
tree. A task therefore reads at most FAN parts whatever the number of blocks, and blocks emit SPLIT rows each. Words of
the base model travel the same way. What moves are compressed arrays, never one row per position; the only shared table are
the counts of three-byte grams, at most 2^24 of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import checkpointed, fold

#: Longest context in bytes (the gram with its byte fits 48 bits), folds, and UTF-8 bytes of text in a block.
ORDER = 5
FOLDS = 10
BLOCK_BYTES = 8_000_000
#: Parts that are merged into one, and how many times finer the result is split.
FAN, SPLIT = 128, 64
#: Up to this order contexts come from the shared table.
SHARED = 2
#: Bytes that are worked on at once inside a block.
_CHUNK = 1 << 21
#: Neither byte occurs in UTF-8: before a text, and its end symbol.
_START, _END = 0xFE, 0xFF
_MASK = (1 << 8 * (ORDER + 1)) - 1
#: Keys of words have this bit; the end token is the key itself.
_WORD = 1 << 62
_END_TOKEN = _WORD

ARRAYS = "unit long, bucket int, keys binary, counts binary"
ANSWERS = "unit long, bucket int, keys binary, costs binary"
DEALT = "block long, doc_id string, data binary, held_out boolean"
SCORES = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def normalise(text: str | None) -> bytes:
    """UTF-8 with A to Z in lower case; null is the empty text."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def word_key(word: bytes) -> int:
    return _WORD | 1 | xxhash.xxh3_64_intdigest(word) >> 2


def _chunks(texts: list[bytes]):
    """(first, one past last, padded bytes, where each text's symbols begin) of runs of texts; a long text is cut
    into pieces that carry their context, so (i, i + 1) may come several times."""
    run: list[bytes] = []
    first, held = 0, 0
    for i, text in enumerate(texts):
        if len(text) > _CHUNK:
            if run:
                yield first, i, *_padded(run)
            whole = bytes([_START]) * ORDER + text + bytes([_END])
            for at in range(ORDER, len(whole), _CHUNK):
                piece = np.frombuffer(whole[at - ORDER : at + _CHUNK], np.uint8)
                yield i, i + 1, piece, np.array([0])
            run, first, held = [], i + 1, 0
            continue
        run.append(text)
        held += len(text) + ORDER + 1
        if held > _CHUNK:
            yield first, i + 1, *_padded(run)
            run, first, held = [], i + 1, 0
    if run:
        yield first, len(texts), *_padded(run)


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pad = bytes([_START]) * ORDER
    data = np.frombuffer(pad + (bytes([_END]) + pad).join(texts) + bytes([_END]), np.uint8)
    sizes = np.array([len(t) + 1 + ORDER for t in texts])
    return data, np.concatenate(([0], np.cumsum(sizes[:-1])))


def _grams(data: np.ndarray) -> np.ndarray:
    """The packed gram that ends at each byte from the ORDER-th on."""
    n = len(data) - ORDER
    out = np.zeros(n, np.int64)
    for i in range(ORDER + 1):
        out = (out << 8) | data[i : i + n]
    return out


def _distinct(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and the number of each gram: the trie is walked one level at a time, every level
    renumbering (node, next byte) through a table, which costs no sort of all positions."""
    n = len(data) - ORDER
    used = np.zeros(256, np.int64)
    alphabet = np.flatnonzero(np.bincount(data, minlength=256))
    used[alphabet] = np.arange(len(alphabet))
    letters, size = used[data], len(alphabet)
    node, keys = letters[:n], alphabet.astype(np.int64)
    for level in range(1, ORDER + 1):
        code = node * size + letters[level : level + n]
        if len(keys) * size <= 1 << 24:
            there = np.zeros(len(keys) * size, bool)
            there[code] = True
            found = np.flatnonzero(there)
            number = np.zeros(len(there), np.int32)
            number[found] = np.arange(len(found), dtype=np.int32)
            node = number[code]
        else:
            found, node = np.unique(code, return_inverse=True)
        node = node.astype(np.int64)
        keys = (keys[found // size] << 8) | alphabet[found % size]
    return keys, node.astype(np.int32)


def _targets(data: np.ndarray) -> np.ndarray:
    """Which grams end in a symbol, not in a START that pads the next text."""
    return data[ORDER:] != _START


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Grams by the last three bytes of their context, words by their hash."""
    with np.errstate(over="ignore"):
        mixed = np.where(keys & _WORD, keys, keys >> 8 & 0xFFFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _split(keys: np.ndarray, buckets: int):
    """(bucket, places of its keys) of the buckets that have any."""
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(bucket[places[0]]), places


@dataclass
class Chunk:
    """Some texts, or a piece of one, walked once: which gram ends at each byte."""

    first: int
    stop: int
    starts: np.ndarray  # where each text's symbols begin
    real: np.ndarray  # whether a byte is a symbol of a text
    keys: np.ndarray  # distinct grams, sorted
    node: np.ndarray  # the gram at each byte


def walk(texts: list[bytes]) -> list[Chunk]:
    return [Chunk(first, stop, starts, _targets(data), *_distinct(data)) for first, stop, data, starts in _chunks(texts)]


def block_keys(texts: list[bytes], train: np.ndarray, chunks: list[Chunk]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (grams and words) of a block and their counts in its training texts."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for c in chunks:
        sizes = np.diff(np.append(c.starts, len(c.node)))
        weigh = np.repeat(train[c.first : c.stop], sizes) & c.real
        counts = np.bincount(c.node[weigh], minlength=len(c.keys))
        real = (c.keys & 0xFF) != _START
        parts.append((c.keys[real], counts[real]))
    words: dict[bytes, int] = {}
    for text, learn in zip(texts, train):
        add = 1 if learn else 0
        for word in text.split():
            words[word] = words.get(word, 0) + add
    keys = np.fromiter((word_key(w) for w in words), np.int64, len(words))
    parts += [(keys, np.fromiter(words.values(), np.int64, len(words))), (np.array([_END_TOKEN]), np.array([train.sum()]))]
    return _merged(parts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[heads], np.add.reduceat(counts, heads)


class Level:
    """The contexts of one order: what each has seen, and how often one order below."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, below: np.ndarray):
        """grams: sorted, distinct; counts: how often each was trained; below: the same of its suffix, one byte shorter."""
        self.grams, self.counts = grams, counts
        self.contexts, of = np.unique(grams >> 8, return_inverse=True)
        sums = lambda x: np.bincount(of, weights=x, minlength=len(self.contexts)).astype(np.int64)
        self.total, self.distinct, self.below = sums(counts), sums(counts > 0), sums(np.where(counts > 0, below, 0))

    @staticmethod
    def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def count(self, grams: np.ndarray) -> np.ndarray:
        at, there = self._at(self.grams, grams)
        return np.where(there, self.counts[at], 0) if len(self.grams) else np.zeros(len(grams), np.int64)

    def look(self, grams: np.ndarray) -> tuple[np.ndarray, ...]:
        """Count of each gram; total, distinct symbols and their count below of its context."""
        at, there = self._at(self.contexts, grams >> 8)
        none = np.zeros(len(grams), np.int64)
        rest = [np.where(there, x[at], 0) if len(x) else none for x in (self.total, self.distinct, self.below)]
        return self.count(grams), *rest


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, of = np.unique(grams, return_inverse=True)
    return distinct, np.bincount(of, weights=counts, minlength=len(distinct)).astype(np.int64)


def shared_levels(grams: np.ndarray, counts: np.ndarray) -> list[Level]:
    """The levels of order 0 to SHARED from the counts of the grams of order SHARED."""
    tables = [(grams, counts)]
    for order in range(SHARED - 1, -1, -1):
        tables.insert(0, _summed(tables[0][0] & ((1 << 8 * (order + 1)) - 1), tables[0][1]))
    levels = []
    for order, (g, n) in enumerate(tables):
        below = levels[-1].count(g & ((1 << 8 * order) - 1)) if order else np.zeros(len(g), np.int64)
        levels.append(Level(g, n, below))
    return levels


def gram_costs(keys: np.ndarray, counts: np.ndarray, shared: list[Level]) -> np.ndarray:
    """log10 probability of the last byte of each gram.

    keys: sorted grams of whole suffix chains down to order SHARED + 1 (all that share the last context bytes),
    counts: how often each was trained (0: only asked for).
    """
    result = np.zeros(len(keys))
    escaped = np.zeros(len(keys))  # log10 of the escapes so far
    open_ = np.ones(len(keys), bool)
    # What the context above (longer) has excluded: the number of its symbols, and their total count one level below.
    above_distinct = np.zeros(len(keys), np.int64)
    above_total = np.zeros(len(keys), np.int64)
    for order in range(ORDER, -1, -1):
        suffix = keys & ((1 << 8 * (order + 1)) - 1)
        if order > SHARED:
            grams, n = _summed(suffix, counts)
            shorter = grams & ((1 << 8 * order) - 1)
            if order > SHARED + 1:
                low, at = np.unique(shorter, return_inverse=True)
                below = np.bincount(at, weights=n, minlength=len(low))[at]
            else:
                below = shared[SHARED].count(shorter)
            level = Level(grams, n, below)
        else:
            level = shared[order]
        n_, total_, distinct_, next_total = level.look(suffix)
        fresh = distinct_ - above_distinct  # symbols that are not excluded
        space = total_ - above_total + fresh
        usable = open_ & (fresh > 0)
        hit = usable & (n_ > 0)
        result[hit] = escaped[hit] + np.log10(n_[hit] / space[hit])
        missed = usable & ~hit
        escaped[missed] += np.log10(fresh[missed] / space[missed])
        open_ &= ~hit
        seen = distinct_ > 0
        above_distinct, above_total = np.where(seen, distinct_, above_distinct), np.where(seen, next_total, above_total)
    # Order -1: the symbols that training never saw are equally likely.
    never = max(1, 256 - int((shared[0].counts > 0).sum()))
    result[open_] = escaped[open_] - np.log10(never)
    return result


def score_block(texts: list[bytes], chunks: list[Chunk], keys: np.ndarray, costs: np.ndarray, total: int, distinct: int) -> list[tuple]:
    """n_tokens, n_known, base_score, score of each text; keys are those of block_keys, costs of words their counts."""
    scores = np.zeros(len(texts))
    for c in chunks:
        at = np.minimum(np.searchsorted(keys, c.keys), len(keys) - 1)
        cost = np.where((c.keys & 0xFF) != _START, costs[at], 0.0)[c.node]
        scores[c.first : c.stop] += np.add.reduceat(np.where(c.real, cost, 0.0), c.starts)
    first_word = np.searchsorted(keys, _WORD)
    count_of = dict(zip(keys[first_word:].tolist(), costs[first_word:].tolist()))
    floor = total + 0.1 * (distinct + 1)
    known: dict[bytes, float] = {}
    end = count_of[_END_TOKEN]
    rows = []
    for text, score in zip(texts, scores):
        words = text.split()
        for w in words:
            if w not in known:
                known[w] = count_of[word_key(w)]
        counts = np.fromiter((known[w] for w in words), np.float64, len(words))
        base = float(np.log10((counts + 0.1) / floor).sum() + np.log10((end + 0.1) / floor))
        rows.append((len(words) + 1, int((counts > 0).sum()) + (end > 0), base, float(score)))
    return rows


def _rows(pdf: pd.DataFrame) -> tuple[list[bytes], np.ndarray]:
    unpacker = zstandard.ZstdDecompressor()
    return [unpacker.decompress(bytes(data)) for data in pdf["data"]], ~pdf["held_out"].to_numpy(bool)


def pack(values: np.ndarray) -> bytes:
    """Numbers of 8 or 4 bytes, byte planes apart (high bytes hardly ever vary), compressed."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1) if len(values) else b""


def unpack(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return pack(np.diff(keys, prepend=0).astype(np.int64))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.int64))


def _arrays(unit: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple]:
    return [(unit, b, pack_keys(keys[at]), pack(counts[at].astype(np.int64))) for b, at in _split(keys, buckets)]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _parts(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(unpack_keys(k), unpack(c, np.int64)) for k, c in zip(pdf["keys"], pdf["counts"])]


def _trigrams(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The trained grams of order SHARED, sorted, and their counts: at most 2^24, packed before they are collected."""

    def totals(batches):
        for pdf in batches:
            for keys, counts in _parts(pdf):
                grams = (keys < _WORD) & (counts > 0)
                gram, n = _summed(keys[grams] & ((1 << 8 * (SHARED + 1)) - 1), counts[grams])
                yield pd.DataFrame({"gram": gram, "n": n})

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"grams": [pdf["gram"].to_numpy(np.int64).tobytes()], "counts": [pdf["n"].to_numpy(np.int64).tobytes()]})

    sums = counted.mapInPandas(totals, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = sums.mapInPandas(pack, "grams binary, counts binary").collect()
    grams, counts = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(row[i], np.int64) for row in rows)]) for i in (0, 1))
    order = np.argsort(grams)
    return grams[order], counts[order]


def _priced(levels: list[DataFrame], table: tuple[np.ndarray, np.ndarray], blocks: int, fan: int, split: int) -> tuple[DataFrame, int, int]:
    """Costs for every part of the lowest level (with empty keys), all training tokens and the distinct ones."""
    top = len(levels) - 1
    shared = levels[0].sparkSession.sparkContext.broadcast(table)

    def price(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = _parts(pdf)
        keys, counts = _merged(parts)
        first = np.searchsorted(keys, _WORD)
        words = counts[first:]
        costs = np.concatenate((gram_costs(keys[:first], counts[:first], shared_levels(*shared.value)), words))
        bucket = int(pdf["bucket"].iloc[0])
        out = [(int(u), bucket, packed if top else b"", pack(costs[np.searchsorted(keys, k)].astype(np.float32))) for u, packed, (k, _) in zip(pdf["unit"], pdf["keys"], parts)]
        out.append((-1, bucket, b"", np.array([words.sum(), (words > 0).sum()], np.float64).tobytes()))
        return _frame(out, ANSWERS)

    answers = checkpointed(levels[-1].groupBy("bucket").applyInPandas(price, ANSWERS))
    sums = answers.where("unit < 0").select("costs").mapInPandas(_add_sums, "total double, known double")
    total, known = sums.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    answers = answers.where("unit >= 0")
    for level in range(top - 1, -1, -1):
        up = F.expr(f"unit div {fan}") if level else F.pmod(F.xxhash64("unit"), F.lit(max(1, -(-blocks // fan))))
        lower = levels[level].select("unit", "bucket", "keys", up.alias("up"), F.col("bucket").alias("part"))
        upper = answers.withColumnsRenamed({"unit": "up"}).withColumn("part", F.pmod("bucket", F.lit(split ** (level + 1))))
        answers = checkpointed(lower.groupBy("up", "part").cogroup(upper.groupBy("up", "part")).applyInPandas(_handing_down(level > 0), ANSWERS))
    return answers, int(total), int(known)


def _dealer(block_bytes: int):
    """Adds the block of each row: runs of rows of a partition, of about that many bytes; texts are normalised and packed."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, packer = TaskContext.get().partitionId() << 32, 0, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            upto = held + np.cumsum(sizes) - sizes
            held += int(sizes.sum())
            data = pa.array([packer.compress(normalise(t)) for t in batch.column("text").to_pylist()], pa.binary())
            blocks = pa.array(first + upto // block_bytes, pa.int64())
            yield pa.RecordBatch.from_arrays([blocks, batch.column("doc_id"), data, batch.column("held_out")], ["block", "doc_id", "data", "held_out"])

    return deal


def _counter(split: int):
    """The grams of each block, which lie in a partition one after the other."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for pdf in batches:
            for block, part in pdf.groupby("block", sort=True):
                if block != current and held:
                    yield told(current, held)
                    held = []
                current = block
                held.append(part)
        if held:
            yield told(current, held)

    def told(block: int, held: list[pd.DataFrame]) -> pd.DataFrame:
        texts, train = _rows(pd.concat(held))
        return _frame(_arrays(int(block), *block_keys(texts, train, walk(texts)), split), ARRAYS)

    return count


def _merger(buckets: int):
    """Puts the parts of some units together as one, in finer buckets."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame(_arrays(int(pdf["up"].iloc[0]), *_merged(_parts(pdf)), buckets), ARRAYS)

    return merge

    return merge


def _handing_down(with_keys: bool):
    """Gives each part its costs out of those of the unit that it was merged into."""

    def hand_down(parts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack_keys(k) for k in found["keys"]])
        costs = np.concatenate([unpack(c, np.float32) for c in found["costs"]])
        order = np.argsort(keys)
        keys, costs = keys[order], costs[order]
        out = []
        for u, b, k in zip(parts["unit"], parts["bucket"], parts["keys"]):
            out.append((int(u), int(b), k if with_keys else b"", pack(costs[np.searchsorted(keys, unpack_keys(k))])))
        return _frame(out, ANSWERS)

    return hand_down


def _add_sums(batches):
    for pdf in batches:
        pairs = np.array([np.frombuffer(c, np.float64) for c in pdf["costs"]]).reshape(-1, 2)
        yield pd.DataFrame({"total": [pairs[:, 0].sum()], "known": [pairs[:, 1].sum()]})


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, fan: int = FAN, split: int = SPLIT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    Trained on the rows whose crc32(doc_id) mod 10 is not 0; a null doc_id counts as the empty text (fold 0, held
    out). A null or empty text is one end token and the end symbol alone. Repeated rows are trained and scored each;
    other columns are ignored. With nothing to train on every symbol costs 1 of 256; no rows give no rows. A text
    longer than a block is a block's only long text and is worked on in chunks.
    """
    held_out = (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out")
    # Ids travel as text: pandas would make nullable longs floats, which round beyond 2^53.
    plain = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text", held_out, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    # Dealt once and kept: a lost executor must not deal anew between counting and scoring.
    rows = checkpointed(plain.mapInArrow(_dealer(block_bytes), DEALT))
    levels = [checkpointed(rows.mapInPandas(_counter(split), ARRAYS))]
    blocks = levels[0].agg(F.count_distinct("unit")).first()[0]
    units, up = blocks, F.pmod(F.xxhash64("unit"), F.lit(max(1, -(-blocks // fan))))
    while units > fan:
        placed = levels[-1].withColumn("up", up)
        levels.append(checkpointed(placed.groupBy("up", "bucket").applyInPandas(_merger(split ** (len(levels) + 1)), ARRAYS)))
        units, up = -(-units // fan), F.expr(f"unit div {fan}")
    priced, total, distinct = _priced(levels, _trigrams(levels[-1]), blocks, fan, split)

    def score(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return _frame([], SCORES)
        texts, train = _rows(pdf)
        chunks = walk(texts)
        keys, _ = block_keys(texts, train, chunks)
        costs, found = np.zeros(len(keys)), dict(zip(answers["bucket"], answers["costs"]))
        for b, at in _split(keys, split):
            costs[at] = unpack(found[b], np.float32)
        out = pd.DataFrame(score_block(texts, chunks, keys, costs, total, distinct), columns=["n_tokens", "n_known", "base_score", "score"])
        out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
        out.insert(1, "held_out", pdf["held_out"].to_numpy())
        return out

    scored = rows.groupBy("block").cogroup(priced.withColumnRenamed("unit", "block").groupBy("block")).applyInPandas(score, SCORES)
    return scored.select(F.col("doc_id").cast("long"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
