"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Texts become token ids and one end token; only documents longer than a sequence
are cut. Pieces that fill a sequence stand alone. The others are dealt to
blocks of about BLOCK pieces, and each block is packed by ISLANDS islands, each
one group of a distributed stage. An island keeps a small population of
packings and breeds it: a child takes whole well-filled bins of one parent,
drops the bins of the other that hold the same pieces, and puts the pieces that
lost their place back by best fit, largest first. After each epoch the elite of
each island migrates to the next one. The best packing of a block wins; pieces
of its poorly filled bins are dealt and packed once more, across blocks.

Blocks are bounded, so work and memory of a task don't grow with the corpus.
Everything is seeded by block and island: equal input gives equal packings.

Ids are those of the named vocabulary by `tokenizers`. Texts of Latin script
are encoded with the same vocabulary by tiktoken, which is some five times
faster; all other texts by tokenizers itself. Strings of control tokens inside a
text are plain text by default, so no document can forge a token; with
`control=True` (as in the query and the pipeline's stage) they become their
tokens, as `tokenizers` has it unless told otherwise.

Cases: null and empty texts are one end token; repeated rows are pieces of
their own; null ids stay null; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import documents, table, written

LENGTH = 1024
END = 2
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
BLOCK, ISLANDS, EPOCHS = 8192, 3, 2
POPULATION, GENERATIONS = 4, 3
#: Bins under this share of a sequence are taken apart and packed again across blocks.
POOR = 0.97

_OTHER_SCRIPT = re.compile("[^\u0000-ɏ‐-›€]")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
STATE = "block long, island int, lengths binary, bins int, cost double, places binary"


@functools.cache
def _whole(vocabulary: str, control: bool):
    """The tokenizer itself, loaded by a worker at the first text that needs it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    out.encode_special_tokens = not control
    return out


@functools.cache
def _control(vocabulary: str) -> re.Pattern:
    """Any string that the tokenizer finds before it splits a text into words."""
    return re.compile("|".join(re.escape(t.content) for t in _whole(vocabulary, True).get_added_tokens_decoder().values()) or "(?!)")


@functools.cache
def _latin(ranks: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as lines:
        merged = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merged, special_tokens={})


def token_ids(text: str, vocabulary: str = VOCABULARY, ranks: str = RANKS, control: bool = False) -> np.ndarray:
    """Token ids of a whole text, then END, as little-endian unsigned 32-bit numbers."""
    if _OTHER_SCRIPT.search(text) or control and _control(vocabulary).search(text):
        ids = np.asarray(_whole(vocabulary, control).encode(text, add_special_tokens=False).ids, "<u4")
    else:
        ids = _latin(ranks).encode_to_numpy(text, disallowed_special=())
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1], out[-1] = ids, END
    return out


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be short."""
    first = n - (n - 1) // length * length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS, control: bool = False) -> DataFrame:
    """The pieces of all documents; columns as in PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for batch in batches:
            rows: list[tuple[int | None, int, int, int, int]] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = token_ids(text.as_py() or "", vocabulary, ranks, control)
                rows += [(doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes())) for k, (start, n) in enumerate(cuts(len(ids)))]
            doc, piece, start, n, crc = zip(*rows) if rows else ([],) * 5
            yield pa.record_batch({
                "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "salt": pa.array(range(salt, salt + len(rows)), pa.int64()),
            })
            salt += len(rows)

    return documents(docs).mapInArrow(run, PIECES)


class Bins:
    """Open bins by the room that is left in them."""

    def __init__(self, size: int) -> None:
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]
        self.mask, self.size = 0, size

    def add(self, room: int) -> int:
        self.room.append(room)
        self.by_room[room].append(len(self.room) - 1)
        self.mask |= 1 << room
        return len(self.room) - 1

    def best_fit(self, length: int) -> int:
        """Puts a piece into the fullest bin that holds it, or a new one; gives the bin."""
        fits = self.mask >> length
        room = length + (fits & -fits).bit_length() - 1 if fits else self.size
        if fits:
            own = self.by_room[room]
            at = own.pop()
            if not own:
                self.mask &= ~(1 << room)
            self.room[at] = room - length
            self.by_room[room - length].append(at)
            self.mask |= 1 << (room - length)
            return at
        return self.add(self.size - length)


def _fill(lengths: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.bincount(places, lengths).astype(np.int64)


def _cost(fill: np.ndarray, size: int) -> float:
    """Mean squared fill: of packings with as many bins the one with fuller and emptier bins is better."""
    return float(np.mean((fill / size) ** 2)) if len(fill) else 1.0


def _compact(places: np.ndarray) -> np.ndarray:
    return np.unique(places, return_inverse=True)[1].astype(np.int32)


def first_packing(lengths: np.ndarray, rng: np.random.Generator | None, size: int = LENGTH) -> np.ndarray:
    """Best fit, largest first; with a generator the order is shaken."""
    key = lengths if rng is None else lengths * rng.uniform(0.9, 1.1, len(lengths))
    bins, places = Bins(size), np.empty(len(lengths), np.int32)
    lens = lengths.tolist()
    for k in np.argsort(-key, kind="stable").tolist():
        places[k] = bins.best_fit(lens[k])
    return places


def refit(lengths: np.ndarray, places: np.ndarray, displaced: np.ndarray, size: int = LENGTH) -> np.ndarray:
    """Best-fits the displaced pieces (places -1) into the bins that are left, largest first."""
    kept = places >= 0
    out = np.full(len(places), -1, np.int32)
    out[kept] = _compact(places[kept])
    bins = Bins(size)
    for fill in _fill(lengths[kept], out[kept]).tolist() if kept.any() else []:
        bins.add(size - fill)
    for k in displaced[np.argsort(-lengths[displaced], kind="stable")].tolist():
        out[k] = bins.best_fit(int(lengths[k]))
    return out


def cross(lengths: np.ndarray, one: np.ndarray, other: np.ndarray, rng: np.random.Generator, size: int = LENGTH) -> np.ndarray:
    """`one` with whole well-filled bins of `other` injected."""
    fill = _fill(lengths, other)
    full = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(full, max(1, len(full) // 4), replace=False)] = True
    injected = chosen[other]
    struck = np.zeros(int(one.max()) + 1, bool)
    struck[one[injected]] = True
    worst = np.argsort(_fill(lengths, one), kind="stable")[: max(1, len(struck) // 100)]
    struck[worst] = True  # mutation: the emptiest bins are dissolved too
    places = np.where(injected, other + len(struck), np.where(struck[one], -1, one))
    return refit(lengths, places, np.flatnonzero(places < 0), size)


def evolve(lengths: np.ndarray, population: list[np.ndarray], rng: np.random.Generator, size: int = LENGTH) -> list[np.ndarray]:
    """A few generations; the population's size holds. Ends early at the least number of bins that there can be."""
    least = -(-int(lengths.sum()) // size)
    ranked = sorted(((int(p.max()) + 1, -_cost(_fill(lengths, p), size), k) for k, p in enumerate(population)))
    pool = [(n, c, population[k]) for n, c, k in ranked][:POPULATION]
    for _ in range(GENERATIONS):
        if pool[0][0] <= least or len(pool) < 2:
            break
        for _ in range(len(pool) // 2):
            a, b = rng.choice(len(pool), 2, replace=False)
            child = cross(lengths, pool[a][2], pool[b][2], rng, size)
            pool.append((int(child.max()) + 1, -_cost(_fill(lengths, child), size), child))
        pool.sort(key=lambda x: x[:2])
        pool = pool[:POPULATION]
    return [p for _, _, p in pool]


def _states(block: int, island: int, lengths: np.ndarray, population: list[np.ndarray], size: int) -> list[tuple]:
    raw = lengths.astype("<i4").tobytes()
    return [(block, island, raw, int(p.max()) + 1, _cost(_fill(lengths, p), size), p.astype("<i4").tobytes()) for p in population]


def _as_table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(schema, columns)})


_STATE = [("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("bins", pa.int32()), ("cost", pa.float64()), ("places", pa.binary())]


def _ordered(block: pa.Table) -> pa.Table:
    return block.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "start", "ids_crc32", "salt")])


def _pack_blocks(short: DataFrame, size: int) -> DataFrame:
    """The best packing of each block: block, places (a bin for each piece in the block's order)."""

    def settle(block: pa.Table) -> pa.Table:
        lengths = _ordered(block)["length"].to_numpy().astype(np.int64)
        number = block["block"][0].as_py()
        rows = []
        for island in range(ISLANDS):
            rng = np.random.default_rng([number, island, 1])
            rows += _states(number, island, lengths, [first_packing(lengths, rng if k or island else None, size) for k in range(POPULATION)], size)
        return _as_table(rows, _STATE)

    def epoch(step: int):
        def run(state: pa.Table) -> pa.Table:
            number, island = state["block"][0].as_py(), state["island"][0].as_py()
            lengths = np.frombuffer(state["lengths"][0].as_py(), "<i4").astype(np.int64)
            found = sorted(zip(state["bins"].to_pylist(), (-c for c in state["cost"].to_pylist()), state["places"].to_pylist()))
            population = evolve(lengths, [np.frombuffer(p, "<i4").astype(np.int32) for _, _, p in found], np.random.default_rng([number, island, step + 2]), size)
            rows = _states(number, island, lengths, population, size)
            return _as_table(rows + [(r[0], (island + 1) % ISLANDS, *r[2:]) for r in rows[:1]], _STATE)  # the elite migrates

        return run

    state = short.groupBy("block").applyInArrow(settle, STATE)
    for step in range(EPOCHS):
        state = state.groupBy("block", "island").applyInArrow(epoch(step), STATE)
    return state.groupBy("block").agg(F.min(F.struct("bins", (-F.col("cost")).alias("cost"), "places")).alias("best")).select("block", "best.places")


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, sequence_id long, offset long, poor boolean"


def _place(short: DataFrame, best: DataFrame, size: int, first: int) -> DataFrame:
    """Each piece's sequence (numbers from `first`, by block) and offset, and whether its bin is poorly filled."""

    def run(pieces: pa.Table, packing: pa.Table) -> pa.Table:
        if not pieces.num_rows:
            return _as_table([], [(f.split()[0], pa.int64()) for f in _PLACED.split(", ")]).cast(_PLACED_ARROW)
        pieces = _ordered(pieces)
        lengths = pieces["length"].to_numpy().astype(np.int64)
        places = _compact(np.frombuffer(packing["places"][0].as_py(), "<i4"))
        fill = _fill(lengths, places)
        order = np.argsort(places, kind="stable")
        run_up = np.cumsum(lengths[order]) - lengths[order]
        head = np.searchsorted(places[order], np.arange(len(fill)))
        offset = np.empty(len(lengths), np.int64)
        offset[order] = run_up - run_up[head][places[order]]
        number = first + (pieces["block"][0].as_py() << 24)
        out = pieces.drop_columns(["block"])
        out = out.append_column("sequence_id", pa.array(number + places.astype(np.int64))).append_column("offset", pa.array(offset))
        return out.append_column("poor", pa.array((fill < POOR * size)[places]))

    return short.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(run, _PLACED)


_PLACED_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("salt", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("poor", pa.bool_()),
])


def _dealt(pieces: DataFrame, n: int, round_: int) -> DataFrame:
    return pieces.withColumn("block", F.pmod(F.xxhash64("salt", "doc_id", "piece", "ids_crc32", F.lit(round_)), F.lit(max(1, -(-n // BLOCK)))))


def pack(docs: DataFrame, size: int = LENGTH, control: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = written(tokenised(docs, control=control), "pieces")
    short = pieces.where(F.col("length") < size)
    whole = pieces.where(F.col("length") >= size)
    dealt = _dealt(short, short.count(), 0)
    once = written(_place(dealt, _pack_blocks(dealt, size), size, 0), "packed")
    poor = once.where("poor").select("doc_id", "piece", "start", "length", "ids_crc32", "salt")
    again = _dealt(poor, poor.count(), 1)
    twice = _place(again, _pack_blocks(again, size), size, 1 << 61)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return once.where("not poor").select(columns).unionByName(twice.select(columns)).unionByName(alone.select(columns))


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS, control: bool = False) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids; for documents with ids of their own."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = token_ids(text.as_py() or "", vocabulary, ranks, control)
            own = cuts(len(ids))
            yield pa.record_batch({"doc_id": pa.array([doc] * len(own), pa.int64()), "piece": pa.array(range(len(own)), pa.int32()), "ids": pa.array([ids[s : s + n].tolist() for s, n in own], pa.list_(pa.int32()))})

    texts = documents(docs).mapInArrow(lambda batches: (out for b in batches for out in run(b)), "doc_id long, piece int, ids array<int>")
    rows = packed.join(texts, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), control=True)


def packed_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: where every piece of every document lies."""
    return pack(docs, control=True)
