"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The public model is a byte-pair model with byte fallback. Its segmentation of a text is the only sequence of pieces that
spells the text and in which every two neighbours are stable: the model splits their joint text into just those two. So
encoding is a best-path problem with weights 0 (stable) and minus infinity. A giant document is cut into chunks at any
characters. A boundary state is the piece that covers the cut: its start before the cut and its end at or after it. Each
chunk yields a matrix from the states at its left cut to those at its right one; products in the max-plus algebra are
associative, so the chunks' matrices are combined in rounds, each round joining neighbours; the states on the best path are
then handed back down the rounds, and every chunk is traced back by itself between its two states. Other documents are encoded
word by word from a memo, as no piece holds a blank after another character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pagequarry.llm.base import as_row, cut, give_back, row_columns

BLANK = "\u2581"
#: Characters from which a document is scanned in chunks, characters of a chunk, nodes that a round joins, words in the memo.
GIANT, CHUNK, FAN, MEMO = 1 << 14, 1 << 12, 32, 250_000
_WORD, _BEGIN = re.compile(f"{BLANK}+[^{BLANK}]*"), re.compile(f"(?<=[^{BLANK}]){BLANK}")
NEVER = -np.inf


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_coders: dict = {}


def coder(path: str) -> Coder:
    """The worker's coder of a model. Spark uses its Python workers again, so the memo serves many tasks."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


class Coder:
    """Encodes and decodes with one model. "Spelled" text has U+2581 for blanks and one of them put before it."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        self.number = {sp.id_to_piece(i): i for i in normal}
        self.longest = max(map(len, self.score))
        assert not any(BLANK in p.lstrip(BLANK) for p in self.score), "a piece goes on after a blank"
        self.memo = pa.array([], pa.string())  # words, where the ids of each begin in memo_ids, how many they are, how often it was met of late
        self.memo_at, self.memo_n, self.memo_met, self.memo_ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int32)
        self.begins = np.array([sp.id_to_piece(i)[:1] == BLANK for i in range(sp.get_piece_size())])
        self.stable_memo: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.surfaces = None

    @staticmethod
    def spelled(text: str) -> str:
        return BLANK + text.replace(" ", BLANK) if text else ""

    def ids(self, piece: str) -> list[int]:
        """Of a piece, or of a character without one: its bytes."""
        if piece in self.number:
            return [self.number[piece]]
        return [self.sp.piece_to_id(f"<0x{b:02X}>") for b in piece.encode()]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids as the library gives them, of each text."""
        flat, ends = self.encode_flat(pa.array(texts, pa.string()))
        return np.split(flat, ends[:-1]) if texts else []

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids as the library gives them, of all texts one after another, and where each text's end; word by word: a word is a
        run of blanks with what follows it. Each different word is looked up once."""
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.or_(pc.match_substring(texts, BLANK), pc.equal(texts, "")))).astype(bool)
        own = [[w[1:].replace(BLANK, " ") for w in _WORD.findall(self.spelled(t))] for t in texts.filter(pa.array(odd)).to_pylist()]
        parts = [pc.split_pattern(texts.filter(pa.array(~odd)), " "), pa.array(own, pa.list_(pa.string()))]
        words = pa.concat_arrays([p.flatten() for p in parts]).dictionary_encode()
        index = np.asarray(words.indices)
        at, n, ids = self._looked_up(words.dictionary, np.bincount(index, minlength=len(words.dictionary)))
        flat = gathered(ids, at[index], n[index])
        ends = np.concatenate([[0], np.cumsum(n[index])])[np.cumsum(np.concatenate([np.asarray(pc.list_value_length(p)) for p in parts]), dtype=np.int64)]
        if not odd.any():
            return flat, ends
        order = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
        starts = np.concatenate([[0], ends[:-1]])[order]
        many = ends[order] - starts
        return gathered(flat, starts, many), np.cumsum(many)

    def _looked_up(self, words: pa.Array, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of different words, where the ids of each begin in the third array, and how many they are. The memo keeps the words
        that were met most often; what was met before counts half."""
        known = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.memo), -1))
        new = words.filter(pa.array(known < 0))
        new_at, new_n, new_ids = self._learned(new)
        all_at = np.concatenate([self.memo_at, new_at + len(self.memo_ids)]).astype(np.int32)
        all_n, ids = np.concatenate([self.memo_n, new_n]).astype(np.int32), np.concatenate([self.memo_ids, new_ids])
        place = known.copy()
        place[known < 0] = len(self.memo) + np.arange(len(new))
        count = np.concatenate([self.memo_met / 2, np.zeros(len(new))])
        count[place] += met
        rest = np.argpartition(-count, MEMO)[:MEMO] if len(count) > MEMO else np.arange(len(count))
        self.memo, self.memo_met, self.memo_n = pa.concat_arrays([self.memo, new]).take(pa.array(rest)), count[rest], all_n[rest]
        self.memo_ids = gathered(ids, all_at[rest], self.memo_n)
        self.memo_at = (np.cumsum(self.memo_n) - self.memo_n).astype(np.int32)
        return all_at[place], all_n[place], ids

    def _learned(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _looked_up(), from the library. It puts a blank before every text, the first one of a word. Words without further
        blanks are given to it in lines of 128, whose ids part where a piece begins with a blank."""
        special = np.asarray(pc.or_(pc.starts_with(words, " "), pc.equal(words, ""))).astype(bool)
        plain, n, ids = words.filter(pa.array(~special)), np.zeros(len(words), np.int32), [np.zeros(0, np.int32)]
        if len(plain):
            cuts = np.append(np.arange(0, len(plain), 128), len(plain)).astype(np.int32)
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), plain), " ")
            for k in range(0, len(lines), 256):
                ids += self.sp.encode(lines.slice(k, 256).to_pylist(), num_threads=1, return_type="numpy")
        flat = np.concatenate(ids).astype(np.int32)
        begins = np.flatnonzero(self.begins[flat])
        assert len(begins) == len(plain), "a word's first piece has no blank, or another one has"
        n[~special] = np.diff(np.append(begins, len(flat)))
        own = [np.array(self.sp.encode(w) if w else [self.number[BLANK]], np.int32) for w in words.filter(pa.array(special)).to_pylist()]
        n[special] = [len(x) for x in own]
        at = np.zeros(len(words), np.int32)
        at[~special], at[special] = begins, len(flat) + np.cumsum(n[special]) - n[special]
        return at, n, np.concatenate([flat, *own])

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids, num_threads=1) if ids else []

    def _surfaces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces one after another, where each begins, its length; -1 for ids that stand for no text."""
        sp, parts, lengths = self.sp, [], []
        for i in range(sp.get_piece_size()):
            plain = not (sp.is_control(i) or sp.is_unknown(i))
            parts.append((bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(BLANK, " ").encode()) if plain else b"")
            lengths.append(len(parts[-1]) if plain else -1)
        n = np.array(lengths)
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(np.maximum(n, 0))[:-1]]), n

    def decode_flat(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of rows of ids (flat, and the end of each row in it), by gathering the pieces' bytes for all rows at once. The
        blank that the library puts before a text goes. Rows with other ids or broken bytes go to the library."""
        if self.surfaces is None:
            self.surfaces = self._surfaces()
        raw, begin, length = self.surfaces
        known = (flat >= 0) & (flat < len(length))
        n = np.where(known, length[np.where(known, flat, 0)], -1)
        starts = np.concatenate([[0], ends[:-1]])
        odd = np.concatenate([[0], np.cumsum(n < 0)])
        n = np.maximum(n, 0)
        at = np.cumsum(n)
        whole = np.repeat(begin[np.where(known, flat, 0)] - (at - n), n) + np.arange(at[-1] if len(at) else 0)
        text = raw[whole].tobytes()
        edge = np.concatenate([[0], at])
        out = []
        for s, e, strange in zip(starts.tolist(), ends.tolist(), (odd[ends] - odd[starts]).tolist()):
            part = text[edge[s] : edge[e]]
            try:
                out.append(self.sp.decode(flat[s:e].tolist()) if strange else part[part[:1] == b" " :].decode())
            except UnicodeDecodeError:
                out.append(self.sp.decode(flat[s:e].tolist()))
        return out

    # --- pieces of spelled text

    def merged(self, stretch: str) -> list[str]:
        """Pieces of a short stretch by the model's rule: the best-scored neighbours join first, the leftmost of equals."""
        parts = list(stretch)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, a: str, b: str) -> bool:
        """Whether a and b stay as they are side by side."""
        if b[0] == BLANK and a[-1] != BLANK:
            return True  # nothing joins across the beginning of a word
        if (a, b) not in self.stable_memo:
            if len(self.stable_memo) > MEMO:
                self.stable_memo.clear()
            self.stable_memo[a, b] = self.merged(a + b) == [a, b]
        return self.stable_memo[a, b]

    def is_piece(self, p: str) -> bool:
        """A character, or a piece that its own characters merge to."""
        if len(p) == 1 or p not in self.score:
            return len(p) == 1
        if p not in self.whole:
            self.whole[p] = self.merged(p) == [p]
        return self.whole[p]

    def states(self, t: str, cut: int) -> list[tuple[int, int]]:
        """The pieces of t that begin before cut and end at or after it."""
        reach = range(max(0, cut - self.longest), cut)
        return [(s, e) for s in reach for e in range(cut, min(len(t), s + self.longest) + 1) if self.is_piece(t[s:e])]

    def chain(self, t: str, before: tuple[int, int] | None, start: int, end: int) -> dict[int, int]:
        """Ends and starts of all pieces that can follow `before` from start on, each end with its only piece, up to end."""
        last: dict[int, int] = {}
        for e in range(start + 1, end + 1):
            for s in range(max(start, e - self.longest), e):
                p = t[s:e]
                if not self.is_piece(p):
                    continue
                if s == start:
                    if before is not None and not self.stable(t[before[0] : before[1]], p):
                        continue
                elif s not in last or not self.stable(t[last[s] : s], p):
                    continue
                last[e] = s
                break
        return last

    def last_word(self, t: str, start: int, end: int) -> int:
        """The last place in start + 1 .. end - 1 where a word begins, so that a piece must end there; -1: none."""
        at = t.rfind(BLANK, start + 1, end)
        while at > start and t[at - 1] == BLANK:
            at -= 1
        return at if at > start else -1

    def next_word(self, t: str, start: int, final: int) -> int:
        """The first place in start..final where a word begins; -1: none."""
        found = _BEGIN.search(t, start, final + 1) if start <= final else None
        return found.start() if found else -1

    def transfer(self, t: str, begin: int, end: int) -> tuple[list, list, np.ndarray]:
        """Boundary states at begin and end (positions in t) and the matrix of best weights between them.

        begin 0 has one state, before any piece; the end of t has those that end there. From the first beginning of a word
        after a state, up to the last one before end, words are the same for all states, so only the ends of the chunk are
        tried: up to that first beginning state by state, from that last one once for all.
        """
        into = [(0, 0)] if begin == 0 else self.states(t, begin)
        out = self.states(t, end)
        m = np.full((len(into), len(out)), NEVER)
        final, goal = self.last_word(t, begin, end), max(e for _, e in out)
        tail = self.chain(t, None, final, goal) if final >= 0 else {}
        ends = np.array([0.0 if tail.get(e) == s else NEVER for s, e in out])
        for i, state in enumerate(into):
            before, first = state if state[1] else None, self.next_word(t, state[1], final)
            if first < 0:
                last = self.chain(t, before, state[1], goal)
                for j, (s, e) in enumerate(out):
                    if last.get(e) == s or (s, e) == state:
                        m[i, j] = 0
            elif first == state[1] or first in self.chain(t, before, state[1], first):
                m[i] = ends
        return into, out, m

    def trace(self, t: str, state: tuple[int, int], goal: tuple[int, int], begin: int, end: int) -> tuple[list[int], str, list[int]]:
        """The pieces after state, up to and with goal: ids of the first ones, whole words as encode() takes them, ids of the last."""
        if state == goal:
            return [], "", []
        before, final = state if state[1] else None, self.last_word(t, begin, end)
        first = self.next_word(t, state[1], final)
        if first < 0:
            return self._back(t, self.chain(t, before, state[1], goal[1]), state[1], goal[1]), "", []
        head = self._back(t, self.chain(t, before, state[1], first), state[1], first)
        words = t[first + 1 : final].replace(BLANK, " ")  # encode() puts a blank before them
        return head + [self.number[BLANK]] * (final - first == 1), words, self._back(t, self.chain(t, None, final, goal[1]), final, goal[1])

    def _back(self, t: str, last: dict[int, int], start: int, end: int) -> list[int]:
        pieces = []
        while end > start:
            pieces.append(t[last[end] : end])
            end = last[end]
        return [i for p in reversed(pieces) for i in self.ids(p)]


def gathered(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One after another, n of values from each place at on."""
    ends = np.cumsum(n, dtype=np.int64)
    kind = np.int32 if max(len(values), int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
    return values[np.repeat((at - (ends - n)).astype(kind), n) + np.arange(ends[-1] if len(ends) else 0, dtype=kind)]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def best_states(mats: list[np.ndarray], start: int, end: int) -> list[int]:
    """The states at all boundaries of a row of chunks on the best path from one state to another."""
    ahead = [np.where(np.arange(mats[0].shape[0]) == start, 0.0, NEVER)]
    for m in mats:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    at, path = end, [end]
    for m, a in zip(reversed(mats), reversed(ahead[:-1])):
        at = int(np.argmax(a + m[:, at]))
        path.append(at)
    return path[::-1]


_NODE = "doc bigint, no int, into array<bigint>, out array<bigint>, weights array<double>"


def _chunks(giants: DataFrame) -> DataFrame:
    """doc, no, begin, end, base, t: chunks of spelled text with as much around them as a piece may reach."""
    size = F.length("t")
    n = F.greatest(F.floor(size / CHUNK), F.lit(1)).cast("int")
    no = F.explode(F.sequence(F.lit(0), n - 1)).alias("no")
    cutting = giants.select("doc", "t", n.alias("n"), no)
    begin, end = F.col("no") * CHUNK, F.when(F.col("no") == F.col("n") - 1, size).otherwise((F.col("no") + 1) * CHUNK)
    with_ends = cutting.select("doc", "no", "t", begin.alias("begin"), end.alias("end"))
    base = F.greatest(F.col("begin") - 64, F.lit(0))
    return with_ends.select("doc", "no", "begin", "end", base.alias("base"), F.substr("t", base + 1, F.col("end") - base + 64).alias("t"))


def scan_giants(giants: DataFrame, path: str) -> DataFrame:
    """doc, ids of giant documents (doc, text): matrices of chunks, products in rounds, states handed back, traces by chunk."""
    spelled = giants.select("doc", F.concat(F.lit(BLANK), F.translate("text", " ", BLANK)).alias("t"))
    chunks = cut(_chunks(spelled).repartition("doc", "no"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, columns = b.slice(at, 64), ([], [], [])
                for r in part.select(["begin", "end", "base", "t"]).to_pylist():
                    into, out, m = c.transfer(r["t"], r["begin"] - r["base"], r["end"] - r["base"])
                    for column, x in zip(columns, (*([x + r["base"] for state in states for x in state] for states in (into, out)), m.ravel())):
                        column.append(x)
                kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("no"), *map(pa.array, columns, kinds)], names=["doc", "no", "into", "out", "weights"])
        give_back()

    def matrices(t: pa.Table) -> tuple[list[dict], list[np.ndarray]]:
        rows = sorted(t.to_pylist(), key=lambda r: r["no"])
        return rows, [np.array(r["weights"]).reshape(len(r["into"]) // 2, -1) for r in rows]

    def join(t: pa.Table) -> pa.Table:
        rows, mats = matrices(t)
        whole = mats[0]
        for m in mats[1:]:
            whole = times(whole, m)
        return pa.table({"doc": [rows[0]["doc"]], "no": pa.array([rows[0]["no"] // FAN], pa.int32()), "into": [rows[0]["into"]], "out": [rows[-1]["out"]], "weights": [whole.ravel()]})

    def hand_back(key: tuple, above: pa.Table, below: pa.Table) -> pa.Table:
        rows, mats = matrices(below)
        goal = above.to_pylist()[0]
        find = lambda flat, s, e: next(i for i in range(len(flat) // 2) if flat[2 * i] == s and flat[2 * i + 1] == e)
        path_ = best_states(mats, find(rows[0]["into"], goal["s0"], goal["e0"]), find(rows[-1]["out"], goal["s1"], goal["e1"]))
        at = [(*rows[0]["into"][2 * path_[0] : 2 * path_[0] + 2],)] + [(*r["out"][2 * p : 2 * p + 2],) for r, p in zip(rows, path_[1:])]
        return pa.table({"doc": [r["doc"] for r in rows], "no": pa.array([r["no"] for r in rows], pa.int32()), **{f"{n}{k}": [x[j] for x in (at[:-1] if k == 0 else at[1:])] for k in (0, 1) for j, n in enumerate("se")}})

    levels = [cut(chunks.mapInArrow(leaves, _NODE))]
    most = levels[0].agg(F.max("no")).first()[0]
    while most:
        levels.append(cut(levels[-1].groupBy("doc", F.floor(F.col("no") / FAN).alias("up")).applyInArrow(join, _NODE)))
        most //= FAN

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                j = int(np.argmax(np.array(r["weights"]).reshape(len(r["into"]) // 2, -1)[0]))
                s, e = r["out"][2 * j : 2 * j + 2]
                yield pa.RecordBatch.from_pydict({"doc": [r["doc"]], "no": pa.array([0], pa.int32()), "s0": [0], "e0": [0], "s1": [s], "e1": [e]})

    ends = "doc bigint, no int, s0 bigint, e0 bigint, s1 bigint, e1 bigint"
    goals = levels[-1].mapInArrow(only, ends)
    for level in reversed(levels[:-1]):
        below = level.select(*[F.col(c).alias(f"b_{c}") for c in level.columns])

        def renamed(key: tuple, above: pa.Table, mine: pa.Table) -> pa.Table:
            return hand_back(key, above, mine.rename_columns([c.removeprefix("b_") for c in mine.column_names]))

        goals = goals.groupBy("doc", "no").cogroup(below.groupBy("b_doc", F.floor(F.col("b_no") / FAN).cast("int").alias("b_up"))).applyInArrow(renamed, ends)
    goals = cut(goals)

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            for at in range(0, b.num_rows, 1_024):
                part, found = b.slice(at, 1_024), []
                for r in part.to_pylist():
                    k = r["base"]
                    found.append(c.trace(r["t"], (r["s0"] - k, r["e0"] - k), (r["s1"] - k, r["e1"] - k), r["begin"] - k, r["end"] - k))
                words = c.encode([x[1] for x in found])
                ids = [np.concatenate([head, mid, tail]).astype(np.int32) for (head, _, tail), mid in zip(found, words)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("no"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=["doc", "no", "ids"])
        give_back()

    traced = chunks.join(goals, ["doc", "no"]).mapInArrow(traces, "doc bigint, no int, ids array<int>")
    parts = F.array_sort(F.collect_list(F.struct("no", "ids")))
    return traced.groupBy("doc").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, path: str | None = None, giant: int = GIANT, text: str = "text") -> DataFrame:
    """docs with ids (array<int>) for text, as the library's encode() gives them; null texts have the ids of the empty text. A
    column ids of docs is replaced; all others stay, whatever their names.

    Texts of more than giant characters go through the scan; a document's ids come together in its row. Giant rows are told
    apart by a hash of their other columns and text, so repeated rows are scanned once and each gets the ids.
    """
    path = path or model_path()
    packed, place = docs.select(as_row(docs).alias("r")), [c.lower() for c in docs.columns].index(text.lower())
    out = StructType([packed.schema["r"], StructField("ids", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            for at in range(0, b.num_rows, 1_024):
                part = b.slice(at, 1_024)
                flat, ends = c.encode_flat(part.column(0).field(place))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))], names=["r", "ids"])
            b = part = flat = ends = None  # before the next batch is read
        give_back()

    t = F.col("r").getField(text)
    is_giant = F.coalesce(F.length(t), F.lit(0)) > giant
    small = packed.where(~is_giant).mapInArrow(run, out)
    big = packed.where(is_giant).withColumn("doc", F.xxhash64(F.sha2(t.cast("binary"), 256)))
    if not big.isEmpty():
        done = scan_giants(big.select("doc", t.alias("text")).dropDuplicates(["doc"]), path)
        small = small.unionByName(big.join(done, "doc").select("r", "ids"))
    return small.select(*[c for c, name in zip(row_columns(docs, "r"), docs.columns) if name.lower() != "ids"], "ids")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with decoded (string) for ids; null ids give null. A column decoded is replaced."""
    path = path or model_path()
    packed, place = encoded.select(as_row(encoded).alias("r")), [c.lower() for c in encoded.columns].index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                ids = part.column(0).field(place)
                ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(ids), 0)))
                flat = np.asarray(pc.fill_null(pc.list_flatten(ids), -1)).astype(np.int64)
                texts = c.decode_flat(flat, ends)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t if fine else None for t, fine in zip(texts, ids.is_valid().to_pylist())], pa.string())], names=["r", "decoded"])
            b = part = ids = flat = texts = None  # before the next batch is read
        give_back()

    out = packed.mapInArrow(run, StructType([packed.schema["r"], StructField("decoded", StringType())]))
    return out.select(*[c for c, name in zip(row_columns(encoded, "r"), encoded.columns) if name.lower() != "decoded"], "decoded")


def piece_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_sha256 (of the ids, comma-joined), round_trip: decoding gives the text back (blanks for
    U+2581, which the model writes for blanks)."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    out = decode(encode(docs.select("doc_id", whole.alias("text"))))
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        (F.col("decoded") == F.translate("text", BLANK, " ")).alias("round_trip"),
    )
