"""Near-duplicate documents: circulant MinHash, banding, exact verification, connected components.

All signature coordinates come from two permutations of 2**20 slots: shingles go to slots, the first permutation scatters them, and
coordinate k is the smallest value of the second permutation, shifted by k, over a document's slots (a window of neighbours
in that permutation per shingle serves all coordinates). Equal sets of shingles become one representative. Representatives
that agree in a band share a bucket; a bucket is named by its smallest member, its hub, and the buckets of one hub make
one group. Each member is compared with its hub on the full sets, in tiles of members, so a text is sent once. Members that
link with their hub are in its class; those that don't are compared with all other members, in pairs of tiles. Of the links
that hold, a task returns a spanning forest, never all pairs. The forest's components are found by passing on smallest labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.base import HOT, SALTS, cut, give_back, join_spread, unused
from pagequarry.llm.shingles import _mix, set_names, shingle_sets

SLOTS, TILE = 1 << 20, 384
#: Bytes of a group from which its task returns the memory that it took.
LARGE = 1 << 20
#: Bands and rows: a pair at 0.85 is missed with a chance of 1e-6 (36 x 7); for a threshold of 0.8, 40 x 6 gives 5e-6.
BANDING = {85: (36, 7), 80: (40, 6)}


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows for a threshold: the most rows of which 400 signature coordinates at most miss a pair at the threshold
    with a chance of 1e-5 at most."""
    if percent in BANDING:
        return BANDING[percent]
    for rows in range(8, 0, -1):
        bands = int(np.ceil(np.log(1e-5) / np.log1p(-((percent / 100) ** rows)))) if percent < 100 else 1
        if bands * rows <= 400:
            return bands, rows
    raise ValueError(f"no banding for a similarity of {percent} %")


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    if k not in _tables:
        rng = np.random.default_rng(2024)
        first, second = rng.permutation(SLOTS), rng.permutation(SLOTS).astype(np.int32)
        circle = np.concatenate([second, second[:k]])
        _tables[k] = first, np.lib.stride_tricks.sliding_window_view(circle, k)
    return _tables[k]


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """k coordinates; coordinate j is min over the slots s of second[(first[s] + j) mod SLOTS]."""
    first, windows = _permutations(k)
    at = first[np.unique(shingles >> np.uint64(44)).astype(np.int64)]
    best = np.full(k, SLOTS, np.int32)
    for i in range(0, len(at), 1024):
        np.minimum(best, windows[at[i : i + 1024]].min(axis=0), out=best)
    return best


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, which holds the number of the band."""
    s = signatures.astype(np.uint64).reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), s.shape[:2]).copy()
    for r in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return key.view(np.int64)


def signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n, h1, h2, keys of every row: size and name of its set of shingles, and its band keys (none if it is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column(1).to_pylist(), words)
                name = set_names(sets)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(np.stack([signature(sets[i], bands * rows) for i in full]), bands, rows) if full else []
                listed: list = [[] for _ in sets]
                for i, key in zip(full, keys):
                    listed[i] = key
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(listed, pa.list_(pa.int64()))], names=["doc_id", "n", "h1", "h2", "keys"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, keys array<bigint>")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs: frequent shingles by a matrix product, the others by listing their rows."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((m, m), np.float32)
    frequent = np.flatnonzero(count > max(8, m // 16))
    place = np.full(len(count), -1)
    for at in range(0, len(frequent), 4096):
        some = frequent[at : at + 4096]
        place[:] = -1
        place[some] = np.arange(len(some))
        mine = place[col] >= 0
        dense = np.zeros((m, len(some)), np.float32)
        dense[row[mine], place[col[mine]]] = 1
        out += dense @ dense.T
    rare = (count[col] > 1) & (count[col] <= max(8, m // 16))
    order = np.argsort(col[rare], kind="stable")
    r, c = row[rare][order], count[col[rare][order]]
    if len(r):
        first = np.flatnonzero(np.concatenate([[True], np.diff(col[rare][order]) != 0]))
        begin = np.repeat(first, c[first])
        flat = np.zeros(m * m)
        step = max(1, 2_000_000 // int(c.max()))
        for at in range(0, len(r), step):
            n = c[at : at + step]
            left = np.repeat(r[at : at + step], n)
            inside = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            right = r[np.repeat(begin[at : at + step], n) + inside]
            flat += np.bincount(left * m + right, minlength=m * m)
        out += flat.reshape(m, m)
    return out


def spanning_forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the symmetric boolean matrix connects."""
    left, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(linked[at] & left)
            left[new] = False
            edges += [(at, int(x)) for x in new]
            todo += new.tolist()
    return edges


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    both = intersections(sets)
    size = np.array([len(s) for s in sets], float)
    return 100 * both >= percent * (size[:, None] + size[None, :] - both)


def star_links(stars: DataFrame, words: int, percent: int) -> DataFrame:
    """hub, id, linked, alone for every member of stars (hub, t, tiles, id, text); each tile t holds the hub's row too. alone:
    it is the only member besides the hub."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        hub, ids = key[0].as_py(), table.column("id").to_numpy()
        sets = shingle_sets(table.column("text").to_pylist(), words)
        linked: dict[int, bool] = {}
        for centre in (sets[i] for i in np.flatnonzero(ids == hub)):
            for i, s in zip(ids.tolist(), sets):
                both = len(np.intersect1d(centre, s, assume_unique=True))
                linked[i] = linked.get(i, False) or 100 * both >= percent * (len(centre) + len(s) - both)
        linked.pop(hub, None)
        alone = len(linked) == 1 and table.column("tiles")[0].as_py() == 1
        if table.nbytes > LARGE:
            del sets
            give_back()
        return pa.table({"hub": pa.array([hub] * len(linked), pa.int64()), "id": pa.array(list(linked), pa.int64()), "linked": pa.array(list(linked.values()), pa.bool_()), "alone": pa.array([alone] * len(linked), pa.bool_())})

    return stars.groupBy("hub", "t").applyInArrow(run, "hub bigint, id bigint, linked boolean, alone boolean")


def verified_links(groups: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: a spanning forest of the links within each group (hub, i, j) of (id, text); 100 * intersection >= percent * union."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        edges = spanning_forest(_linked(shingle_sets(table.column("text").to_pylist(), words), percent))
        a, b = (np.array([ids[e[i]] for e in edges], np.int64) for i in (0, 1))
        if table.nbytes > LARGE:
            give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return groups.groupBy("hub", "i", "j").applyInArrow(run, "a bigint, b bigint")


def candidate_pairs(reps: DataFrame) -> DataFrame:
    """hub, id: the members of each group of representatives (id, keys) but the hub itself."""
    keyed = cut(reps.select("id", F.explode("keys").alias("key")))
    bucket = cut(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where(F.col("n") > 1))
    met = join_spread(keyed, bucket.drop("n"), ["key"], "id", heavy=bucket.where(F.col("n") > HOT))
    return cut(met.where("id <> hub").select("hub", "id").distinct())


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)).cast("int"))


def _tiled(pairs: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """pairs with the number of tiles that the hub's members make. Only hubs with more than one tile are joined, by hub and a
    salt, so that a large hub's rows are spread."""
    tiles = members.groupBy("hub").agg(F.ceil(F.count("*") / float(TILE)).cast("int").alias(name)).where(F.col(name) > 1)
    salted = tiles.select(F.col("hub").alias("of_hub"), name, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
    joined = _salted(pairs).join(salted, (F.col("hub") == F.col("of_hub")) & (F.col("salt") == F.col("of_salt")), "left")
    return joined.select(*pairs.columns, F.coalesce(name, F.lit(1)).alias(name))


def links_of_groups(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: links that connect what is linked within the groups; texts: id, text."""
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    dealt = _tiled(pairs, pairs, "tiles").select("hub", place("tiles").alias("t"), "tiles", "id")
    stars = dealt.unionByName(dealt.select("hub", "t", "tiles", F.col("hub").alias("id")).distinct())
    found = cut(star_links(texts.join(stars, "id"), words, percent))
    links = found.where("linked").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    # What doesn't link with its hub may link with any other member.
    failed = cut(found.where("not linked and not alone").select("hub", "id"))
    if failed.isEmpty():
        return links
    hubs = failed.select("hub").distinct().select("hub", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = _salted(found.select("hub", "id")).join(hubs, ["hub", "salt"], "left_semi").select("hub", "id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = _tiled(_tiled(failed, failed, "lost"), members, "tiles").select("hub", place("lost").alias("i"), every("tiles").alias("j"), "id")
    cols = _tiled(_tiled(members, members, "tiles"), failed, "lost").select("hub", every("lost").alias("i"), place("tiles").alias("j"), "id")
    groups = rows.unionByName(cols).distinct()
    return links.unionByName(verified_links(texts.join(groups, "id"), words, percent))


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for every id in links (a, b). Labels pass over links and then jump to the label
    of their label, so rounds grow with the logarithm of the longest path; each round is cut off in the checkpoint folder."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("c")))
    busy = cut(both.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("b"))
    while True:
        heard = join_spread(both, label.select(F.col("id").alias("b"), "c"), ["b"], "a", heavy=busy).groupBy("a").agg(F.min("c").alias("h"))
        step = cut(label.join(heard, label["id"] == heard["a"], "left").select("id", F.col("c").alias("old"), F.least("c", F.coalesce("h", "c")).alias("c")))
        far = label.select(F.col("id").alias("c"), F.col("c").alias("further"))
        new = cut(join_spread(step, far, ["c"], "id", "left").select("id", "old", F.least("c", F.coalesce("further", "c")).alias("c")))
        label = new.select("id", "c")
        if new.where("c <> old").isEmpty():
            return label.select("id", F.col("c").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    Documents are linked if 100 * intersection >= percent * union of their sets of word shingles; component_id is the
    smallest doc_id reachable over links. Without words (null or empty text) a document is linked with nothing. Equal sets are
    linked. Rows with one doc_id are one document, linked with whatever one of them is linked with. Rows without doc_id stand
    alone. No rows give none.
    """
    bands, rows = banding(percent)
    all_rows = cut(signed(docs, words, bands, rows))
    name = ["n", "h1", "h2"]
    known = all_rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    reps = cut(known.groupBy(*name).agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.count("*").alias("copies")))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where(F.col("id").isNotNull())
    links = links_of_groups(candidate_pairs(reps), texts, words, percent)
    # Documents that are given twice with different texts connect their sets.
    heavy = cut(reps.where(F.col("copies") > HOT).select(*name))
    twice = known.groupBy("doc_id").agg(F.count_distinct("h1", "h2").alias("k")).where("k > 1").select("doc_id")
    same = join_spread(known.select(*name, "doc_id").join(twice, "doc_id", "left_semi"), reps.select(*name, "id"), name, "doc_id", heavy=heavy)
    label = components(links.union(same.where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))))
    class_of = reps.select(*name, "id").join(label, "id", "left").select(*name, F.coalesce("component", "id").alias("component"))
    # Rows without words have no class to find: they don't travel.
    worded = join_spread(all_rows.select("doc_id", *name).where("n > 0"), class_of, name, "doc_id", "left", heavy)
    out = worded.unionByName(all_rows.where("n = 0").select("doc_id", *name, F.lit(None).cast("long").alias("component")))
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component, all their columns; of rows with one doc_id, all."""
    own = unused(docs, "doc of class")
    kept = near_duplicates(docs, words, percent).where("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col(f"`{own}`")), "left_semi")
