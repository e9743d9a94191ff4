"""Interpolated modified Kneser-Ney over six-grams of whole bytes: sharded counts, joined with blocks of documents.

The counts grow with the corpus, so neither the driver nor a task ever holds all of them. The different n-grams and their
counts are dealt to shards by their last three symbols. All shorter suffixes of an n-gram, down to three symbols, are in its
shard, so a shard knows the counts of orders 6 to 3 by itself. Totals of contexts are summed up in shards of their own, dealt
out likewise. Orders 1 and 2 have at most 257**2 entries, which every task gets.

Documents are packed into blocks of about 20 MB of text. A block asks each shard once for each different n-gram and each
different context that it has; however often an n-gram occurs, a block asks for it once, so that no shard has more to do for a
common one. The counts that come back meet the block's texts, where they become probabilities, and sums per document.
A model is trained on the texts of fold 0, of fold 1 or of both; one set of shards serves all three.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pagequarry.llm.base import cut, give_back, keep

A, ORDER, EDGE, LOW = 257, 6, 256, 2
#: Bytes of text of a block, of a task that counts and of a slice, different n-grams of a shard, different n-grams that a task
#: holds, blocks that ask one copy of a shard.
BLOCK, COUNTED, SLICE, SHARD, HELD, ASKERS = 20 << 20, 32 << 20, 1 << 20, 1 << 18, 1 << 22, 512
#: Zstandard's level for blocks, which are most of what is shuffled; beyond 6 they hardly shrink.
LEVEL = 6
#: Models by the folds that they are trained on: all but fold 0, all but fold 1, both.
BUT_0, BUT_1, BOTH = 0, 1, 2
GRAMS, CONTEXTS = 0, 1


# --- bytes and n-grams


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int]]:
    """Where to cut texts so that each slice has about SLICE bytes: first row, number of rows."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")), at + 1)
        yield at, to - at
        at = to


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Six-grams of every text as numbers, and where each text's begin (one more entry than texts).

    A text of n bytes has n + 1: five edges stand before it and one after it. Null counts as empty.
    """
    data = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    lengths = np.diff(ends)
    last = np.cumsum(lengths + ORDER)  # of the symbols of each text
    inner = np.ones(int(last[-1]) if len(last) else 0, bool)
    own = inner.copy()
    inner[last - 1] = False
    for k in range(1, ORDER):
        inner[last - lengths - ORDER + k - 1] = False
        own[last - k] = False  # these begin in a text's last symbols and run into the next one
    symbols = np.full(len(inner), EDGE, np.int32)
    symbols[inner] = raw
    n = max(len(symbols) - ORDER + 1, 0)
    three = (symbols[: n + 3] * A + symbols[1 : n + 4]) * A + symbols[2 : n + 5] if n else symbols
    keys = three[:n].astype(np.int64) * A**3 + three[3 : n + 3]
    return keys[own[:n]], np.concatenate([[0], np.cumsum(lengths + 1)])


def different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, and how often each occurs."""
    s = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.append(first, len(s)))


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys, ascending, and the sums of their values."""
    order = np.argsort(keys, kind="stable")  # they come in ascending runs
    s = keys[order]
    if not len(s):
        return (s, *values)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return (s[first], *(np.add.reduceat(v[order], first) for v in values))


def shard_of(three: np.ndarray, n: int) -> np.ndarray:
    return ((three.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def places(keys: np.ndarray, n: int) -> list[np.ndarray]:
    """Of each shard, where its keys stand."""
    shard = shard_of(keys % A**3, n)
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.searchsorted(shard[order], np.arange(1, n)))


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers, compressed by planes of their bytes: small ones and small steps take little room."""
    x = np.concatenate([np.array([len(columns[0])]), *columns]).astype("<i8")
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(b: bytes) -> np.ndarray:
    """The columns of packed(), one to a row."""
    n = int.from_bytes(b[:8], "little")
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    x = np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()
    return x[1:].reshape(-1, x[0]) if x[0] else np.zeros((8, 0), np.int64)


def filled(values: np.ndarray, at: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """values with numbers in the columns at; of 32 bits as long as all numbers fit."""
    if values.dtype == np.int32 and numbers.max(initial=0) > np.iinfo(np.int32).max:
        values = values.astype(np.int64)
    values[:, at] = numbers
    return values


def steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=0)


# --- the model


@dataclass(frozen=True)
class Model:
    """grams: shard, data (packed keys, counts of both folds); contexts: model, shard, data (packed keys, totals, numbers of
    followers seen once, twice and more often); low: what every task needs, by model, of bounded size."""

    grams: DataFrame
    contexts: DataFrame
    low: dict[int, Low]
    shards: int


@dataclass(frozen=True)
class Low:
    """Discounts by order; probabilities of order 2; totals and what they leave of contexts of two symbols."""

    discounts: np.ndarray
    p: np.ndarray
    total: np.ndarray
    left: np.ndarray


def count_grams(docs: DataFrame) -> DataFrame:
    """key, n0, n1: six-grams of all texts (text) of each fold (fold 0 or 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []

        def told() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 100_000):  # a key cut in two is summed up with the tasks' keys
                k, many = keys[at : at + 100_000], n[at : at + 100_000]
                columns = summed(k >> 1, np.where(k & 1, 0, many), np.where(k & 1, many, 0))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["key", "n0", "n1"])

        def gathered() -> tuple[np.ndarray, ...]:
            key, many = different(np.concatenate([np.zeros(0, np.int64), *fresh]))
            fresh.clear()
            return summed(np.concatenate([keys, key]), np.concatenate([n, many]))

        for batch in batches:
            for at, rows in slices(batch.column(0)):
                found, starts = grams(batch.column(0).slice(at, rows))
                fresh.append(found * 2 + np.repeat(np.asarray(batch.column(1).slice(at, rows)), np.diff(starts)))
                if sum(map(len, fresh)) > HELD:
                    keys, n = gathered()
                    if len(keys) > HELD:
                        yield from told()
                        keys, n = keys[:0], n[:0]
        keys, n = gathered()
        yield from told()
        give_back()

    counted = docs.select("text", F.col("fold").cast("int")).mapInArrow(run, "key bigint, n0 bigint, n1 bigint")
    return counted.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def order_counts(keys: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By order, 6 to 3: the n-grams of a shard (ascending) and their counts; below 6, in how many contexts each continues."""
    seen = n > 0
    out = {ORDER: (keys[seen], n[seen])}
    for k in range(ORDER - 1, LOW, -1):
        out[k] = different(out[k + 1][0] % A**k)
    return out


def of_model(counts: np.ndarray, model: int) -> np.ndarray:
    """Counts under a model from those of the two folds."""
    return counts[1 - model] if model < BOTH else counts[0] + counts[1]


def train(docs: DataFrame) -> Model:
    """The counts of all texts of docs (text, fold) in shards."""
    counts = keep(count_grams(docs))
    shards = max(1, -(-counts.count() // SHARD))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = shard_of(np.asarray(b.column(0)) % A**3, shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *b.columns], names=["shard", *b.schema.names])

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        keys, n0, n1 = (t.column(c).to_numpy() for c in ("key", "n0", "n1"))
        order = np.argsort(keys)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([packed(steps(keys[order]), n0[order], n1[order])], pa.binary())})

    dealt = counts.mapInArrow(deal, "shard int, key bigint, n0 bigint, n1 bigint")
    kept = cut(dealt.groupBy("shard").applyInArrow(gather, "shard int, data binary"))

    def tables(row: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
        for data in row.column(row.schema.get_field_index("data")).to_pylist():
            keys, *n = unpacked(data)
            for model in (BUT_0, BUT_1, BOTH):
                yield model, order_counts(np.cumsum(keys), of_model(np.array(n), model))

    def low_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for model, orders in tables(b):
                for k, (_, n) in orders.items():
                    yield stat_rows(model, 0, [k], *([int((n == i).sum())] for i in (1, 2, 3, 4)))
                three, n = orders[LOW + 1]
                ends, many = different(three % A**LOW)
                yield stat_rows(model, 1, ends, many, *[np.zeros(len(ends), np.int64)] * 3)
                yield stat_rows(model, 2, *context_sums(three, n))

    def context_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for model, orders in tables(b):
                sums = [(k - 1, *context_sums(*orders[k])) for k in range(ORDER, LOW + 1, -1)]
                columns = [np.concatenate(c) for c in zip(*((context * 8 + k, *values) for k, context, *values in sums))]
                for shard, own in enumerate(places(columns[0] >> 3, shards)):
                    if len(own):
                        own = own[np.argsort(columns[0][own])]
                        data = packed(steps(columns[0][own]), *(c[own] for c in columns[1:]))
                        yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([shard], pa.int32()), pa.array([data], pa.binary())], names=["model", "shard", "data"])

    def add_up(key: tuple, t: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in t.column("data").to_pylist()]
        keys, *sums = summed(np.concatenate([np.cumsum(p[0]) for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in range(1, 5)))
        return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([packed(steps(keys), *sums)], pa.binary())})

    stats = kept.mapInArrow(low_stats, "model int, what int, key bigint, a bigint, b bigint, c bigint, d bigint")
    rows = stats.groupBy("model", "what", "key").agg(*[F.sum(c).alias(c) for c in "abcd"]).toPandas()  # at most 3 * (4 + 2 * 257**2)
    low = {m: low_orders(rows[rows["model"] == m]) for m in (BUT_0, BUT_1, BOTH)}
    parts = kept.mapInArrow(context_parts, "model int, shard int, data binary")
    contexts = cut(parts.groupBy("model", "shard").applyInArrow(add_up, "model int, shard int, data binary"))
    return Model(kept, contexts, low, shards)


def stat_rows(model: int, what: int, *columns) -> pa.RecordBatch:
    n = len(columns[0])
    heads = [pa.array(np.full(n, x), pa.int32()) for x in (model, what)]
    return pa.RecordBatch.from_arrays([*heads, *(pa.array(np.asarray(c), pa.int64()) for c in columns)], names=["model", "what", *("key", "a", "b", "c", "d")])


def context_sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of n-grams with the sum of their counts, and how many have count 1, 2 and more."""
    return summed(keys // A, n, *(x.astype(np.int64) for x in (n == 1, n == 2, n > 2)))


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """D1, D2, D3+ from the counts of counts (Chen and Goodman's estimates), within 0 and 1, 2, 3."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.01), k - 0.01) for k, d in enumerate(raw, 1)]


def low_orders(rows) -> Low:
    """Orders 1 and 2 in full, from the sums over all shards; order 0 is uniform over bytes and edge."""
    of = np.zeros((ORDER + 1, 3))
    for r in rows[rows["what"] == 0].itertuples():
        of[r.key] = discounts(float(r.a), float(r.b), float(r.c), float(r.d))
    ends, contexts = rows[rows["what"] == 1], rows[rows["what"] == 2]
    two = np.zeros(A * A, np.int64)
    two[ends["key"].to_numpy()] = ends["a"].to_numpy()
    one = (two.reshape(A, A) > 0).sum(axis=0)
    p = np.full(A, 1.0 / A)
    for k, n in ((1, one.reshape(1, A)), (2, two.reshape(A, A))):
        of[k] = discounts(*(float((n == i).sum()) for i in (1, 2, 3, 4)))
        cost = np.where(n > 0, of[k][np.clip(n, 1, 3) - 1], 0)
        total = n.sum(axis=1, keepdims=True)
        p = np.where(total > 0, (n - cost + cost.sum(axis=1, keepdims=True) * p) / np.maximum(total, 1), p)
    total, many = np.zeros(A * A), np.zeros((A * A, 3))
    at = contexts["key"].to_numpy()
    total[at], many[at] = contexts["a"].to_numpy(), contexts[["b", "c", "d"]].to_numpy()
    return Low(of, p.ravel(), total, many @ of[LOW + 1] / np.maximum(total, 1))


# --- scores


class Places:
    """Finds keys among different ascending ones; a direct table finds most of them without a search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(10, len(keys).bit_length() + 2))
        self.table = np.zeros(1 << int(64 - self.shift), np.int32)
        self.table[self._at(keys)] = np.arange(len(keys), dtype=np.int32)

    def _at(self, x: np.ndarray) -> np.ndarray:
        return ((x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each of x, which must all be keys."""
        at = self.table[self._at(x)]
        rest = np.flatnonzero(self.keys[at] != x)
        at[rest] = np.searchsorted(self.keys, x[rest])
        return at


def probabilities(keys: np.ndarray, counts: np.ndarray, context: np.ndarray, low: Low) -> np.ndarray:
    """Of six-grams: counts has rows for orders 6 to 3; context, for lengths 5 to 3, total and numbers of followers by count."""
    p = low.p[keys % A**LOW]
    for k in range(LOW + 1, ORDER + 1):
        d = low.discounts[k]
        if k == LOW + 1:
            at = keys // A % A**LOW
            total, left = low.total[at], low.left[at]
        else:
            total, *many = context[4 * (ORDER - k) : 4 * (ORDER - k) + 4].astype(float)
            left = (d[0] * many[0] + d[1] * many[1] + d[2] * many[2]) / np.maximum(total, 1)
        n = counts[ORDER - k]
        own = np.where(n > 0, n - d[np.clip(n, 1, 3) - 1], 0)
        p = np.where(total > 0, own / np.maximum(total, 1) + left * p, p)
    return p


def _opened(block: pa.Table) -> Iterator[pa.RecordBatch]:
    for data in block.column("rows").to_pylist():
        yield from pa.ipc.open_stream(data)


def _block_keys(block: pa.Table, text: int) -> np.ndarray:
    keys, fresh = np.zeros(0, np.int64), []
    for b in _opened(block):
        fresh.append(grams(b.column(text))[0])
        if sum(map(len, fresh)) > HELD // 4:
            keys, fresh = different(np.concatenate([keys, *fresh]))[0], []
    keys, fresh = different(np.concatenate([keys, *fresh]))[0], []
    give_back()
    return keys


def perplexity(docs: DataFrame, model: Model, which: str | int = BOTH, size: int | None = None) -> DataFrame:
    """docs with n_grams and perplexity of the column text, for every row.

    which: the model to score with, or the name of a column that tells it. size: bytes of all texts, if they are known. docs must
    give its rows in the same order when a part of it is computed again, as files do: blocks are made again after the loss of an
    executor, and a block that had changed would miss its answers. The result of a join or an aggregation is written first.
    """
    if size is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few = docs.coalesce(max(1, -(-size // (BLOCK // 4))))
    names, text = docs.columns, docs.columns.index("text")
    shards, low = model.shards, model.low
    copies = max(1, -(-size // BLOCK // ASKERS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of this task in blocks; a block is named by its content, so that one made anew is another block."""
        zstd, held = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL)), dict[int, list[bytes]]()
        sizes: dict[int, int] = {}

        def told(m: int) -> pa.RecordBatch:
            rows = held.pop(m)
            sizes.pop(m)
            name = int.from_bytes(blake2b(b"".join(blake2b(x).digest() for x in rows), digest_size=8).digest(), "little", signed=True)
            return pa.RecordBatch.from_arrays([pa.array([m] * len(rows), pa.int32()), pa.array([name] * len(rows), pa.int64()), pa.array(rows, pa.binary())], names=["model", "block", "rows"])

        for batch in batches:
            own = batch.column(batch.num_columns - 1)
            for m in pc.unique(own).to_pylist():
                part = batch.filter(pc.equal(own, m)).select(list(range(batch.num_columns - 1)))
                for at, n in slices(part.column(text)):
                    some, out = part.slice(at, n), pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, some.schema, options=zstd) as w:
                        w.write_batch(some)
                    held.setdefault(m, []).append(out.getvalue().to_pybytes())
                    sizes[m] = sizes.get(m, 0) + some.column(text).nbytes
                    if sizes[m] > BLOCK:
                        yield told(m)
        for m in list(held):
            yield told(m)
        give_back()

    def ask(key: tuple, block: pa.Table) -> pa.Table:
        m, name = key[0].as_py(), key[1].as_py()
        keys = _block_keys(block, text)
        out = []
        for kind, mine in ((GRAMS, keys), (CONTEXTS, different(keys // A)[0])):
            out += [(kind, m, s, name % copies, name, packed(steps(mine[own]))) for s, own in enumerate(places(mine, shards)) if len(own)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["kind", "model", "shard", "copy", "block", "asked"])

    def answer(key: tuple, asks: pa.Table, shard: pa.Table) -> pa.Table:
        kind, m = key[0].as_py(), key[1].as_py()
        have = [unpacked(x) for x in shard.column("data").to_pylist()]
        keys, values = (np.cumsum(have[0][0]), have[0][1:]) if have else (np.zeros(0, np.int64), np.zeros((4, 0), np.int64))
        orders = order_counts(keys, of_model(values, m)) if kind == GRAMS else {}
        out = []

        def found(sought: np.ndarray, among: np.ndarray, values: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(among, sought), max(len(among) - 1, 0))
            return np.where(among[at] == sought, values[..., at], 0) if len(among) else np.zeros((*values.shape[:-1], len(sought)), np.int64)

        for asked in asks.column("asked").to_pylist():
            want = np.cumsum(unpacked(asked)[0])
            if kind == GRAMS:
                out.append(packed(*(found(want % A**k, *orders[k]) for k in range(ORDER, LOW, -1))))
            else:
                out.append(packed(*(x for k in range(ORDER - 1, LOW, -1) for x in found(want % A**k * 8 + k, keys, values))))
        return pa.table({"model": asks.column("model"), "block": asks.column("block"), "kind": asks.column("kind"), "shard": asks.column("shard"), "told": pa.array(out, pa.binary())})

    def score(key: tuple, block: pa.Table, told: pa.Table) -> pa.Table:
        keys = _block_keys(block, text)
        context, of = different(keys // A)[0], keys // A
        values = {GRAMS: np.zeros((4, len(keys)), np.int32), CONTEXTS: np.zeros((12, len(context)), np.int32)}
        at = {GRAMS: places(keys, shards), CONTEXTS: places(context, shards)}
        due = sum(len(x) > 0 for kind in at.values() for x in kind)
        if told.num_rows != due:
            raise RuntimeError(f"a block has {told.num_rows} answers of {due}: its rows were made anew in another order")
        for kind, s, data in zip(*(told.column(c).to_pylist() for c in ("kind", "shard", "told"))):
            values[kind] = filled(values[kind], at[kind][s], unpacked(data))
        index = np.cumsum(np.concatenate([[False], of[1:] != of[:-1]])) if len(of) else of
        cost = np.zeros(len(keys))
        for at_ in range(0, len(keys), 1 << 16):  # a part at a time: the numbers by order take much room
            some = slice(at_, at_ + (1 << 16))
            cost[some] = -np.log(probabilities(keys[some], values[GRAMS][:, some], values[CONTEXTS][:, index[some]], low[key[0].as_py()]))
        del told, context, of, index, values, at
        give_back()
        where, out = Places(keys), []
        for b in _opened(block):
            found, starts = grams(b.column(text))
            total = np.concatenate([[0.0], np.cumsum(cost[where.find(found)])])
            n = np.diff(starts)
            out.append(pa.Table.from_batches([b]).append_column("n_grams", pa.array(n, pa.int64())).append_column("perplexity", pa.array(np.exp((total[starts[1:]] - total[starts[:-1]]) / n))))
        del keys, cost, where
        give_back()
        return pa.concat_tables(out)

    tagged = few.select(*[F.col(f"`{c}`") for c in names], (F.col(which) if isinstance(which, str) else F.lit(which)).cast("int").alias("model of the row"))
    blocks = tagged.mapInArrow(pack, "model int, block bigint, rows binary")
    asks = blocks.groupBy("model", "block").applyInArrow(ask, "kind int, model int, shard int, copy int, block bigint, asked binary")
    have = model.grams.select(F.lit(GRAMS).alias("kind"), F.explode(F.array(*[F.lit(m) for m in (BUT_0, BUT_1, BOTH)])).alias("model"), "shard", "data")
    have = have.unionByName(model.contexts.select(F.lit(CONTEXTS).alias("kind"), "model", "shard", "data"))
    have = have.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    place = ["kind", "model", "shard", "copy"]
    told = asks.groupBy(*place).cogroup(have.groupBy(*place)).applyInArrow(answer, "model int, block bigint, kind int, shard int, told binary")
    out = StructType([*docs.schema.fields, StructField("n_grams", LongType()), StructField("perplexity", DoubleType())])
    return blocks.groupBy("model", "block").cogroup(told.groupBy("model", "block")).applyInArrow(score, out)
