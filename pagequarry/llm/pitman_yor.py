"""Language-model scoring: a hierarchical Pitman-Yor bigram model over words, seated by Gibbs sampling over shards.

Each word is a context with a restaurant of its own, whose customers are the words that follow it in the training documents; all
these share one parent, the restaurant of single words, whose own base gives each word and the unknown one an equal share. A
restaurant's customers sit at tables, one dish (word) a table, and every table is a customer of the parent. Seating is sampled:
customers of each dish are taken from their tables at random and seated again, at a table with the chance of its size less the
discount, or at a new one with that of strength plus discounted tables times the parent's probability. Dishes are reseated side by
side, and so are up to an eighth of a dish's customers at once; within a shard the numbers of tables follow each step, those of
other shards each round. After a burn-in, the predictive probabilities of the rounds are averaged.

Everything that grows with the corpus is sharded and travels packed. Documents are dealt into blocks of some 12 MB of text, written
once as numbers of words. A block asks the shards of words for their ids and counts, then the shards of pairs for each different
pair of known words that it has; it sends its training counts along with the question. A shard of pairs keeps, per block, the
places of the asked pairs in its own sorted list, so that the answer needs no keys. Pairs are dealt out by a hash of both words,
so a frequent context is spread over all shards; how many tables it has in all is summed up, like the customers of the parent, in
the shards of words, once a round. The driver sees a handful of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.base import give_back, keep
from pagequarry.llm.byte_grams import different, packed, shard_of, slices, steps, summed, unpacked
from pagequarry.llm.shingles import word_hashes

#: Documents whose crc32(doc_id) has this remainder by 7 are held out.
HELD_OUT = 2
#: Bytes of text of a block, of a shard of words, of a shard of pairs; steps of the rounds, of which the first is the burn-in.
BLOCK, WORD_SHARD, PAIR_SHARD, STEPS = 12 << 20, 32 << 20, 8 << 20, (8, 4, 4)
#: Strength of the restaurants, part of a dish's customers that a step reseats, hash of the end of a text.
STRENGTH, PART, END, SEED = 1.0, 8, 0, 11
TOKENS, WORDS, IDS, VOCABULARY, RANKS, COUNTS, STATE, SUMS, BASE, NEED, TOLD, PAIR = range(12)
#: Rows of all tables here: what it is, where it goes, where it comes from, contents, sums for the driver.
ROW = "kind int, to bigint, of bigint, a binary, b binary, c binary, x array<bigint>"
_SCHEMA = pa.schema([("kind", pa.int32()), ("to", pa.int64()), ("of", pa.int64()), *((k, pa.binary()) for k in "abc"), ("x", pa.list_(pa.int64()))])
_WORD = 31  # bits of an id


class Rows:
    """Collects rows of the schema ROW."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, kind: int, to: int, of: int, a: bytes, b: bytes = b"", c: bytes = b"", x: tuple = ()) -> None:
        self.rows.append((kind, to, of, a, b, c, [int(v) for v in x]))

    def table(self) -> pa.Table:
        return pa.table([pa.array([r[i] for r in self.rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def columns(b: bytes, n: int) -> np.ndarray:
    """The n columns of packed()."""
    x = unpacked(b)
    return x if x.shape[1] else np.zeros((n, 0), np.int64)


def _of_kind(t: pa.Table, kind: int) -> list[dict]:
    """The rows of a kind, by where they come from."""
    return sorted((r for r in t.to_pylist() if r["kind"] == kind), key=lambda r: r["of"])


# --- seating


@dataclass
class Seating:
    """Tables of many dishes: dish of each table (ascending), its size; restaurant of each dish, tables of each restaurant."""

    dish: np.ndarray
    size: np.ndarray
    place: np.ndarray
    tables: np.ndarray

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each dish."""
        n = len(self.place)
        return np.bincount(self.dish, self.size, n).astype(np.int64), np.bincount(self.dish, minlength=n)

    def step(self, rng: np.random.Generator, share: np.ndarray, discount: float, strength: float) -> None:
        """Reseats some customers of each dish; share: the parent's probability of each dish."""
        many, _ = self.counts()
        due = np.repeat(np.arange(len(many)), np.maximum(1, many // PART))
        first = np.cumsum(many) - many
        who = np.unique(first[due] + (rng.random(len(due)) * many[due]).astype(np.int64))
        at = np.searchsorted(np.cumsum(self.size), who, "right")
        gone = np.bincount(self.dish[at], minlength=len(many))
        self.size = self.size - np.bincount(at, minlength=len(self.size))
        left = self.size > 0
        self.tables = self.tables - np.bincount(self.place[self.dish[~left]], minlength=len(self.tables))
        self.dish, self.size = self.dish[left], self.size[left]
        self._add(rng, gone, share, discount, strength)

    def _add(self, rng: np.random.Generator, more: np.ndarray, share: np.ndarray, discount: float, strength: float) -> None:
        many, tables = self.counts()
        old = many - discount * tables
        new = (strength + discount * self.tables[self.place]) * share
        who = np.repeat(np.arange(len(more)), more)
        fresh = rng.random(len(who)) * (old + new)[who] >= old[who]
        # A dish that has lost all its customers has one new table; the others of its customers sit down there.
        empty = np.flatnonzero((many == 0) & (more > 0))
        fresh[(np.cumsum(more) - more)[empty]] = True
        fresh_dishes, others = who[fresh], who[~fresh]
        weight = np.cumsum(self.size - discount)
        before = np.concatenate([[0.0], weight])[np.searchsorted(self.dish, others)]
        at = np.searchsorted(weight, before + rng.random(len(others)) * old[others], "right")
        last = np.searchsorted(self.dish, others, "right") - 1
        self.size = self.size + np.bincount(np.minimum(at, last), minlength=len(self.size))
        order = np.argsort(np.concatenate([self.dish, fresh_dishes]), kind="stable")
        self.dish = np.concatenate([self.dish, fresh_dishes])[order]
        self.size = np.concatenate([self.size, np.ones(len(fresh_dishes), np.int64)])[order]
        self.tables = self.tables + np.bincount(self.place[fresh_dishes], minlength=len(self.tables))

    def resize(self, many: np.ndarray) -> None:
        """Brings each dish to many customers, at least one: its largest table takes or gives them; where that can't, all its
        customers share one table."""
        have, _ = self.counts()
        order = np.lexsort((self.size, self.dish))
        self.dish, self.size = self.dish[order], self.size[order]
        last = np.searchsorted(self.dish, np.arange(len(many)), "right") - 1
        self.size[last] += many - have
        bad = self.size[last] < 1
        stay = ~bad[self.dish]
        stay[last] = True
        self.size[last[bad]] = many[bad]
        self.dish, self.size = self.dish[stay], self.size[stay]
        self.tables = np.bincount(self.place[self.dish], minlength=len(self.tables))


# --- blocks


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text with its end, and the number of tokens of each text; null counts as empty."""
    parts = [(t or "").encode() for t in texts.to_pylist()]
    h, start = word_hashes(np.frombuffer(b"\n".join(parts), np.uint8))
    ends = np.searchsorted(start, np.cumsum([len(p) + 1 for p in parts]))
    return np.insert(h, ends, np.uint64(END)).view(np.int64), np.diff(ends, prepend=0) + 1


def blocks_of(docs: DataFrame, size: int, shards: int) -> DataFrame:
    """Rows TOKENS (a: number of each token within the block, b: those numbers in the order of the questions, c: documents) and
    WORDS (a: hashes, training counts), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bytes_held, number = 0, 0

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal held, bytes_held, number
            block = (TaskContext.get().partitionId() << 32) + number
            tokens, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            docs_ = pa.Table.from_batches([x[2] for x in held])
            held, bytes_held, number = [], 0, number + 1
            words, at = np.unique(tokens, return_inverse=True)
            trained = np.repeat(~np.asarray(docs_.column(1).combine_chunks()), n)
            count, often = np.bincount(at[trained], minlength=len(words)), np.bincount(at, minlength=len(words))
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-often, kind="stable")] = np.arange(len(words))
            parts = _dealt(words, shards)
            sink = pa.BufferOutputStream()
            docs_ = docs_.append_column("n", pa.array(n))
            with pa.ipc.new_stream(sink, docs_.schema) as w:
                w.write_table(docs_)
            out = Rows()
            out.add(TOKENS, block, block, packed(rank[at]), packed(rank[np.concatenate(parts)]), sink.getvalue().to_pybytes())
            for s, own in enumerate(parts):
                if len(own):
                    out.add(WORDS, s, block, packed(steps(words[own]), count[own]))
            yield from out.table().to_batches()
            give_back()

        for batch in batches:
            for at, rows in slices(batch.column(2)):
                part = batch.slice(at, rows)
                held.append((*tokens_of(part.column(2)), part.select([0, 1])))
                bytes_held += part.column(2).nbytes
                if bytes_held > BLOCK:
                    yield from told()
        if held:
            yield from told()

    few = docs.coalesce(max(1, -(-size // BLOCK)))
    return keep(few.mapInArrow(run, ROW))


def _dealt(keys: np.ndarray, n: int) -> list[np.ndarray]:
    """Of each shard, where its keys stand."""
    shard = shard_of(keys, n)
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.searchsorted(shard[order], np.arange(1, n)))


def number_words(blocks: DataFrame, shards: int) -> DataFrame:
    """Rows IDS (to a block: ids, 0 for unknown words, and training counts) and VOCABULARY (a: counts by rank; x: words, tokens).
    An id is rank * shards + shard + 1."""

    def run(key: tuple, asks: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        lists = [(r["of"], *unpacked(r["a"])) for r in _of_kind(asks, WORDS)]
        lists = [(of, np.cumsum(k), n) for of, k, n in lists]
        words, count = summed(np.concatenate([k for _, k, _ in lists]), np.concatenate([n for *_, n in lists]))
        ids = np.zeros(len(words), np.int64)
        known = np.flatnonzero(count)
        known = known[np.argsort(-count[known], kind="stable")]
        ids[known] = np.arange(len(known)) * shards + shard + 1
        if len(known) and ids.max() >= 1 << _WORD:
            raise ValueError("more different words than ids")
        out = Rows()
        for of, k, _ in lists:
            at = np.searchsorted(words, k)
            out.add(IDS, of, shard, packed(ids[at], count[at]))
        out.add(VOCABULARY, shard, shard, packed(count[known]), x=(len(known), count.sum()))
        return out.table()

    return keep(blocks.where(F.col("kind") == WORDS).groupBy("to").applyInArrow(run, ROW))


def _in_order(block: dict, answers: list[np.ndarray]) -> np.ndarray:
    """Answers of all shards (rows), by the block's own numbers of words."""
    order = unpacked(block["b"])[0]
    out = np.zeros((len(answers[0]), len(order)), np.int64)
    out[:, order] = np.concatenate(answers, axis=1)
    return out


def _pairs(block: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """Of each token: its number, the number of the one before it (of the end, for a text's first), its pair (0: not both known);
    and the block's documents."""
    tokens = unpacked(block["a"])[0]
    docs = pa.ipc.open_stream(block["c"]).read_all()
    n = docs.column("n").to_numpy()
    first = np.cumsum(n) - n
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first] = tokens[first[0] + n[0] - 1]  # the last token of a text is its end
    u, w = ids[before], ids[tokens]
    return tokens, before, np.where((u > 0) & (w > 0), (u << _WORD) + w, 0), docs


def count_pairs(blocks: DataFrame, words: DataFrame, pair_shards: int, shards: int) -> DataFrame:
    """The shards of pairs: RANKS (of a block: places of its pairs), COUNTS (of all pairs; x: how many occur once, twice), STATE (a:
    pairs that occur more than once: context, word, count) and to the shards of words BASE (tables that pairs seen once give
    contexts, and customers that they give the parent), SUMS (the same of the other pairs, one table each) and NEED."""

    def ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (block,) = left.to_pylist()
        ids, _ = _in_order(block, [unpacked(r["a"]) for r in _of_kind(right, IDS)])
        _, _, pair, docs = _pairs(block, ids)
        trained = np.repeat(~np.asarray(docs.column(1).combine_chunks()), docs.column("n").to_numpy())
        k, n = different((pair << 1 | trained)[pair > 0])
        k, n = summed(k >> 1, np.where(k & 1, n, 0))
        out = Rows()
        for s, own in enumerate(_dealt(k, pair_shards)):
            if len(own):
                out.add(PAIR, s, block["of"], packed(steps(k[own]), n[own]))
        give_back()
        return out.table()

    def gather(key: tuple, asks: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        lists = [(r["of"], *unpacked(r["a"])) for r in _of_kind(asks, PAIR)]
        lists = [(of, np.cumsum(k), n) for of, k, n in lists]
        keys, n = summed(np.concatenate([k for _, k, _ in lists]), np.concatenate([n for *_, n in lists]))
        out = Rows()
        for of, k, _ in lists:
            out.add(RANKS, shard, of, packed(steps(np.searchsorted(keys, k))))
        out.add(COUNTS, shard, shard, packed(n), x=((n == 1).sum(), (n == 2).sum()))
        u, w = keys >> _WORD, keys & ((1 << _WORD) - 1)
        for kind, some in ((BASE, n == 1), (SUMS, n > 1)):
            _to_words(out, kind, shard, u[some], w[some], np.ones(int(some.sum()), np.int64), shards)
        some = n > 1
        for s, own in _by_shard(np.unique(np.concatenate([u[some], w[some]])), shards):
            out.add(NEED, s, shard, packed(steps((own - 1) // shards)))
        out.add(STATE, shard, shard, packed(steps(u[some]), w[some], n[some]))
        return out.table()

    asks = blocks.where(F.col("kind") == TOKENS).groupBy("to").cogroup(words.where(F.col("kind") == IDS).groupBy("to")).applyInArrow(ask, ROW)
    return keep(asks.groupBy("to").applyInArrow(gather, ROW))


def _by_shard(ids: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """Different ids, dealt to the shards that they name."""
    shard = (ids - 1) % shards
    return [(int(s), ids[shard == s]) for s in np.unique(shard)]


def _to_words(out: Rows, kind: int, of: int, u: np.ndarray, w: np.ndarray, tables: np.ndarray, shards: int) -> None:
    """Sums of tables by context and by word, sent to the shards of words."""
    ids = np.concatenate([u, w])
    none = np.zeros(len(u), np.int64)
    ids, as_context, as_dish = summed(ids, np.concatenate([tables, none]), np.concatenate([none, tables]))
    shard = (ids - 1) % shards
    for s in np.unique(shard):
        own = shard == s
        out.add(kind, int(s), of, packed(steps((ids[own] - 1) // shards), as_context[own], as_dish[own]))


# --- rounds


@dataclass(frozen=True)
class Sums:
    """What every task needs: words, tokens, discounts of pairs and of the parent; customers and tables of the parent by round."""

    words: int
    tokens: int
    discount: float
    parent: float
    rounds: tuple[tuple[int, int], ...] = ()

    def share(self, customers: np.ndarray, tables: np.ndarray, number: int) -> np.ndarray:
        """The parent's probability of words with so many customers and tables after a round."""
        c, t = self.rounds[number]
        rest = (STRENGTH + self.parent * t) / (self.words + 1)
        return (customers - self.parent * tables + rest) / (STRENGTH + c)


def seat_parent(state: DataFrame, pairs: DataFrame, sums: DataFrame, number: int, known: Sums) -> DataFrame:
    """Rows STATE of the shards of words (a: count, base tables as context, base customers as dish; b: tables of the parent; c: by
    round, tables as context, customers and tables as dish) and TOLD, what the shards of pairs need; x: customers, tables, dishes
    with one customer, with two."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        (row,) = left.to_pylist()
        if row["kind"] == VOCABULARY:
            (count,) = columns(row["a"], 1)
            base = np.zeros((2, len(count)), np.int64)
            _add_sums(base, _of_kind(right, BASE))
        else:
            count, *base = columns(row["a"], 3)
            base = np.array(base)
        total = base.copy()
        _add_sums(total, _of_kind(right, SUMS))
        as_context, customers = total
        seen = np.flatnonzero(customers)
        if row["kind"] == VOCABULARY:
            seats = Seating(np.arange(len(seen)), customers[seen], np.zeros(len(seen), np.int64), np.array([len(seen)]))
        else:
            dish, size = columns(row["b"], 2)
            seats = Seating(np.cumsum(dish), size, np.zeros(len(seen), np.int64), np.array([0]))
            seats.resize(customers[seen])
        rng = np.random.default_rng([SEED, 1, shard, number])
        own = int(np.bincount(seats.dish, minlength=1).sum()) if len(seen) else 0
        others = (known.rounds[-1][1] if known.rounds else known.words) - (int(row["x"][1]) if row["kind"] == STATE else own)
        seats.tables = np.array([own + max(others, 0)])
        for _ in range(STEPS[max(number - 1, 0)] if len(seen) else 0):
            seats.step(rng, np.full(len(seen), 1 / (known.words + 1)), known.parent, STRENGTH)
        tables = np.zeros(len(count), np.int64)
        tables[seen] = seats.counts()[1]
        before = list(columns(row["c"], 3 * (number - 2))) if number > 2 else []
        out = Rows()
        stats = (customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum())
        out.add(STATE, shard, shard, packed(count, *base), packed(steps(seats.dish), seats.size), packed(*before, as_context, customers, tables), stats)
        for r in _of_kind(right, NEED):
            at = np.cumsum(unpacked(r["a"])[0])
            out.add(TOLD, r["of"], shard, packed(count[at], as_context[at], customers[at], tables[at]))
        return out.table()

    messages = sums.where(F.col("kind") == SUMS).unionByName(pairs.where(F.col("kind") == NEED))
    if number == 0:
        messages = messages.unionByName(pairs.where(F.col("kind") == BASE))
    kind = VOCABULARY if number == 0 else STATE
    return keep(state.where(F.col("kind") == kind).groupBy("to").cogroup(messages.groupBy("to")).applyInArrow(run, ROW))


def _add_sums(to: np.ndarray, rows: list[dict]) -> None:
    for r in rows:
        at, as_context, as_dish = unpacked(r["a"])
        at = np.cumsum(at)
        to[0, at] += as_context
        to[1, at] += as_dish


def seat_pairs(state: DataFrame, told: DataFrame, number: int, known: Sums, shards: int) -> DataFrame:
    """Rows STATE of the shards of pairs (a as before; b: tables; c: tables of each pair by round) and SUMS for the shards of words."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        out = Rows()
        for row in left.to_pylist():
            u, w, n = columns(row["a"], 3)
            u = np.cumsum(u)
            need = np.unique(np.concatenate([u, w]))
            order = np.argsort((need - 1) % shards, kind="stable")
            have = np.zeros((4, len(need)), np.int64)
            if len(need):
                have[:, order] = np.concatenate([unpacked(r["a"]) for r in _of_kind(right, TOLD)], axis=1)
            _, as_context, customers, tables = have
            share = known.share(customers, tables, number - 1)[np.searchsorted(need, w)]
            place = np.searchsorted(need, u)
            if row["b"]:
                dish, size = columns(row["b"], 2)
                seats = Seating(np.cumsum(dish), size, place, as_context.copy())
            else:
                seats = Seating(np.arange(len(n)), n, place, as_context.copy())
            rng = np.random.default_rng([SEED, 0, shard, number])
            for _ in range(STEPS[number - 1] if len(n) else 0):
                seats.step(rng, share, known.discount, STRENGTH)
            many = seats.counts()[1]
            before = list(columns(row["c"], number - 2)) if number > 2 else []
            out.add(STATE, shard, shard, row["a"], packed(steps(seats.dish), seats.size), packed(*before, many))
            _to_words(out, SUMS, shard, u, w, many, shards)
        return out.table()

    return keep(state.where(F.col("kind") == STATE).groupBy("to").cogroup(told.where(F.col("kind") == TOLD).groupBy("to")).applyInArrow(run, ROW))


# --- scores


def scores(blocks: DataFrame, words: DataFrame, pairs: DataFrame, state_of_words: DataFrame, state_of_pairs: DataFrame, known: Sums, kind: str, shards: int, pair_shards: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document of the blocks."""
    samples = range(2, len(STEPS) + 1)

    def tell_words(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = Rows()
        (row,) = right.to_pylist()
        values = columns(row["c"], 3 * len(samples))
        for r in left.to_pylist():
            ids, count = unpacked(r["a"])
            at = np.maximum(ids - 1, 0) // shards
            told = np.where(ids > 0, values[:, at], 0) if values.shape[1] else np.zeros((3 * len(samples), len(ids)), np.int64)
            out.add(TOLD, r["to"], r["of"], packed(ids, count, *told))
        return out.table()

    def tell_pairs(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = Rows()
        (counts,) = _of_kind(left, COUNTS)
        (n,) = unpacked(counts["a"])
        tables = np.repeat(np.minimum(n, 1)[None], len(samples), axis=0)
        for row in right.to_pylist():
            tables[:, n > 1] = columns(row["c"], len(samples))
        for r in _of_kind(left, RANKS):
            at = np.cumsum(unpacked(r["a"])[0])
            out.add(PAIR, r["of"], r["to"], packed(n[at], *tables[:, at]))
        return out.table()

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (block,) = left.to_pylist()
        ids, count, *by_round = _in_order(block, [unpacked(r["a"]) for r in _of_kind(right, TOLD)])
        tokens, before, pair, docs = _pairs(block, ids)
        keys, at = np.unique(pair, return_inverse=True)  # the first may be 0, of pairs that aren't known
        asked = np.flatnonzero(keys)
        seen = np.zeros((1 + len(samples), len(keys)), np.int64)
        dealt = [own for own in _dealt(keys[asked], pair_shards) if len(own)]
        if dealt:
            seen[:, asked[np.concatenate(dealt)]] = np.concatenate([unpacked(r["a"]) for r in _of_kind(right, PAIR)], axis=1)
        p = np.zeros(len(tokens))
        for s in range(len(samples)):
            as_context, customers, tables = by_round[3 * s : 3 * s + 3]
            share = known.share(customers, tables, samples[s])
            own = np.maximum(seen[0] - known.discount * seen[1 + s], 0)
            p += (own[at] + (STRENGTH + known.discount * as_context)[before] * share[tokens]) / (STRENGTH + count)[before]
        n = docs.column("n").to_numpy()
        first = np.cumsum(n) - n
        base = np.log10((count + 1) / (known.tokens + known.words + 1))
        added = lambda v: np.add.reduceat(v, first)
        out = [docs.column(0), docs.column(1), pa.array(n, pa.int64()), pa.array(added((count > 0)[tokens].astype(np.int64))), pa.array(np.full(len(n), known.tokens, np.int64)), pa.array(added(base[tokens])), pa.array(added(np.log10(p / len(samples))))]
        give_back()
        return pa.table(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    by = lambda df, kinds, column: df.where(F.col("kind").isin(*kinds)).groupBy(column)
    from_words = by(words, [IDS], "of").cogroup(by(state_of_words, [STATE], "to")).applyInArrow(tell_words, ROW)
    from_pairs = by(pairs, [RANKS, COUNTS], "to").cogroup(by(state_of_pairs, [STATE], "to")).applyInArrow(tell_pairs, ROW)
    told = from_words.unionByName(from_pairs)
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return by(blocks, [TOKENS], "to").cogroup(told.groupBy("to")).applyInArrow(score, out)


def held_out(doc_id) -> object:
    """Whether a document is held out; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(7)) == HELD_OUT


def _discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text; other columns are
    ignored): the log10 probability of all its tokens, the end included, under the model of all documents that aren't held out.

    Null texts count as empty: their end is their only token. Rows that repeat are documents of their own. Without training
    documents every token is unknown and has probability 1, as the base has it. No rows give none.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, pair_shards = max(1, -(-size // WORD_SHARD)), max(1, -(-size // PAIR_SHARD))
    told = docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), "text")
    blocks = blocks_of(told, size, shards)
    words = number_words(blocks, shards)
    total = lambda df, kind, n: [int(v or 0) for v in df.where(F.col("kind") == kind).agg(*[F.sum(F.col("x")[i]) for i in range(n)]).first()]
    n_words, n_tokens = total(words, VOCABULARY, 2)
    pairs = count_pairs(blocks, words, pair_shards, shards)
    known = Sums(n_words, n_tokens, _discount(*total(pairs, COUNTS, 2)), 0.5)
    parent, seated = words, pairs
    for number in range(len(STEPS) + 1):
        if number:
            seated = seat_pairs(seated, parent, number, known, shards)
        parent = seat_parent(parent, pairs, seated, number, known)
        customers, tables, once, twice = total(parent, STATE, 4)
        discount = known.parent if number else _discount(once, twice)
        known = Sums(n_words, n_tokens, known.discount, discount, (*known.rounds, (customers, tables)))
    return scores(blocks, words, pairs, parent, seated, known, docs.schema["doc_id"].dataType.simpleString(), shards, pair_shards)
