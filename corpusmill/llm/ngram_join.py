"""Near duplicates by an n-gram Jaccard join.

1. One pass over the texts makes each document's set of word n-grams, as 64-bit hashes. Equal sets are one class.
2. N-grams are dealt by range of their hash, packed, and counted. Only n-grams that stand in more than one set go back to
   their documents: they are all that two sets can share.
3. Sets are ordered rare-first. An n-gram that no other set has comes first and needs no posting, so a document with a
   quarter of its own n-grams drops out. The others emit their prefix, with size, position and the bits of a suffix filter.
4. Classes that stand side by side in the list of a prefix n-gram are verified first; the components of what links them
   leave little to compare. What remains are pairs from different components that pass the length, positional and suffix
   filters; each is verified once.

Sets are compared as 56-bit hashes, in every session the same ones: two different n-grams of one pair coincide with a chance
below 1e-8. Nodes of the links are classes, so ids that repeat or are missing tie nothing together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import BATCH_ROWS, WORD, bounded
from corpusmill.llm.graph import components
from corpusmill.session import materialize

N = 5
#: Two sets link when 100 * shared >= PERCENT * united.
PERCENT = 75
#: N-grams and documents that a task packs together, and the share of these documents from which on an n-gram's documents
#: stay with the pack and only their number is dealt.
PACK_GRAMS, PACK_DOCS, HOT_SHARE, HOT_LEAST = 1_500_000, 60_000, 16, 64
#: Stands for the place of a document in the pack, which 16 bits number; PACK_DOCS stays below it.
HOT = 0xFFFF
#: Bits of an n-gram's hash that count; the ranges that n-grams are dealt to are its first 8 to MOST_BITS ones.
WIDTH, LEAST_BITS, MOST_BITS = 56, 8, 18
#: Parts of a range that are counted one after the other.
SLICES = 16
#: Postings of one n-gram that are compared in one task; longer lists are compared in tiles.
TILE = 2048
#: Width of a band of sizes, as a logarithm.
SIZE_BAND = 0.1
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MESSAGE = pa.schema([("dealt", pa.int32()), ("pack", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
MESSAGE_DDL = "dealt int, pack bigint, kind int, payload binary"
GRAMS, DOCS, LISTS = 0, 1, 2
ROWS_DDL = "kind int, doc_id bigint, n int, key binary, mark binary, grams binary, prefix binary"
ROWS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("key", pa.binary()), ("mark", pa.binary()), ("grams", pa.binary()),
                  ("prefix", pa.binary())])


def least_shared(total):
    """Shared n-grams that two sets of ``total`` n-grams together need."""
    return -(-PERCENT * total // (100 + PERCENT))


def prefix_size(n):
    """N-grams of a set of ``n`` of which a linked set has at least one among its own first ones."""
    return n - -(-PERCENT * n // 100) + 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """Hashes of all words of a buffer of UTF-8 bytes at once: differences of running sums of byte * power."""

    def __init__(self):
        self.lower = np.arange(256, dtype=np.uint64) + np.uint64(1)
        self.lower[65:91] += np.uint64(32)
        self.blank = np.zeros(256, dtype=bool)
        self.blank[[32, 9, 10, 11, 12, 13]] = True
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = 1 << int(n).bit_length()
            back = pow(int(MULTIPLIER), -1, 2**64)
            for name, factor in (("power", int(MULTIPLIER)), ("inverse", back)):
                out = np.ones(size, dtype=np.uint64)
                width, step = 1, factor
                while width < size:  # doubling
                    out[width:2 * width] = out[:width] * np.uint64(step)
                    step = step * step % 2**64
                    width *= 2
                setattr(self, name, out)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each word; ``data`` ends with a blank."""
        blank = self.blank[data]
        starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        self.grow(len(data))
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.lower[data] * self.power[:len(data)], dtype=np.uint64)])
        raw = (total[ends] - total[starts]) * self.inverse[starts]
        return starts, mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def gram_sets(texts: list[str | None], hasher: WordHasher, n: int = N) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; a text of fewer words is one sequence, one without words empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    starts, hashes = hasher.words(data)
    edges = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    count = max(0, len(hashes) - n + 1)
    grams = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        grams = grams * MULTIPLIER + hashes[i:i + count]
    grams = mixed(grams)
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a >= n:
            s = np.sort(grams[a:b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for h in hashes[a:b]:
                short = short * MULTIPLIER + h
            out.append(mixed(short ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def packs(batches: Iterator[pa.RecordBatch], bits: int, n: int) -> Iterator[pa.RecordBatch]:
    """Messages of the documents of a task. A pack is named by its content, so a task that runs again names it alike."""
    hasher, docs, sets, marks, size = WordHasher(), [], [], [], 0

    def flush() -> pa.RecordBatch:
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        place: dict[bytes, int] = {}
        firsts = []
        for i, k in enumerate(keys):
            if k is not None and k not in place:
                place[k] = len(place)
                firsts.append(i)
        ids = pa.array(docs, pa.int64())
        table = pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.binary()),
                                            pa.array([-1 if k is None else place[k] for k in keys], pa.int32()), pa.array(marks, pa.binary())],
                                           ["doc_id", "n", "key", "place", "mark"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_batch(table)
        whole = sink.getvalue().to_pybytes()
        name = xxhash.xxh3_64_intdigest(whole) - 2**63
        rows = [(name % 2**bits, name, DOCS, whole)]
        grams = np.concatenate([sets[i] for i in firsts] or [np.zeros(0, np.uint64)])
        at = np.repeat(np.arange(len(firsts), dtype=np.uint16), [len(sets[i]) for i in firsts])
        order = np.argsort(grams, kind="stable")
        grams, at = grams[order] >> np.uint64(64 - WIDTH) << np.uint64(64 - WIDTH), at[order]
        new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        runs = np.diff(np.concatenate([new, [len(grams)]]))
        hot = runs >= max(HOT_LEAST, len(firsts) // HOT_SHARE)
        if hot.any():
            inside = np.repeat(hot, runs)
            kept = at[inside]
            rows.append((name % 2**bits, name, LISTS, grams[inside].tobytes() + kept.tobytes()))
            # One marker, and how many documents stand behind it, in place of the list.
            many = np.repeat(np.where(hot, runs, 1), np.where(hot, 1, runs)).astype(np.uint32)
            keep = ~inside
            keep[new[hot]] = True
            at = np.where(inside, HOT, at)[keep].astype(np.uint16)
            grams = grams[keep]
            marked = many[at == HOT]
        else:
            marked = np.zeros(0, np.uint32)
        part = (grams >> np.uint64(64 - bits)).astype(np.int64)
        low = (grams >> np.uint64(64 - WIDTH)) & np.uint64(2**48 - 1)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        done = 0
        for p, a, b in zip(part[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(part)]):
            n_hot = int(np.count_nonzero(at[a:b] == HOT))
            rows.append((p, name, GRAMS, np.array([b - a], np.uint32).tobytes() + (low[a:b] >> np.uint64(32)).astype(np.uint16).tobytes()
                         + low[a:b].astype(np.uint32).tobytes() + at[a:b].tobytes() + marked[done:done + n_hot].tobytes()))
            done += n_hot
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), MESSAGE.types)], schema=MESSAGE)

    # Batches may be larger than a pack can number.
    for batch in (whole.slice(i, BATCH_ROWS) for whole in batches for i in range(0, whole.num_rows, BATCH_ROWS)):
        if size >= PACK_GRAMS or len(docs) + batch.num_rows > PACK_DOCS:
            yield flush()
            docs, sets, marks, size = [], [], [], 0
        found = gram_sets(batch.column("text").to_pylist(), hasher, n)
        docs += batch.column("doc_id").to_pylist()
        marks += batch.column("mark").to_pylist()
        sets += found
        size += sum(map(len, found))
    if docs:
        yield flush()


def unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit n-grams, places, and documents behind each (more than one at a marker)."""
    n = int(np.frombuffer(payload, np.uint32, 1)[0])
    high = np.frombuffer(payload, np.uint16, n, 4).astype(np.uint64)
    low = np.frombuffer(payload, np.uint32, n, 4 + 2 * n).astype(np.uint64)
    at = np.frombuffer(payload, np.uint16, n, 4 + 6 * n)
    many = np.ones(n, np.uint32)
    many[at == HOT] = np.frombuffer(payload, np.uint32, -1, 4 + 8 * n)
    return high << np.uint64(32) | low, at, many


def repeated(table: pa.Table, bits: int) -> pa.Table:
    """Of one range of n-grams, those that more than one set holds, with their count, addressed to their packs; what is
    addressed to a pack already passes. Payloads are sorted, so the range is counted in slices, one after the other."""
    rows = table.to_pylist()
    passing = [r for r in rows if r["kind"] != GRAMS]
    rows = sorted((r for r in rows if r["kind"] == GRAMS), key=lambda r: r["pack"])
    if rows:
        parts = [unpacked(r["payload"]) for r in rows]
        # Bits 8 to 55 of a hash are in the payload, the first 8 in the number of the range.
        dealt = rows[0]["dealt"]
        top = np.uint64(dealt >> (bits - LEAST_BITS)) << np.uint64(WIDTH)
        first = (dealt << (WIDTH - bits)) & (2**48 - 1)
        edges = np.array([first + (i << (WIDTH - bits)) // SLICES for i in range(SLICES + 1)], dtype=np.uint64)
        cuts = [np.searchsorted(p[0], edges) for p in parts]
        found: list[list] = [[] for _ in rows]
        for i in range(SLICES):
            grams, at, many = (np.concatenate([p[k][c[i]:c[i + 1]] for p, c in zip(parts, cuts)]) for k in range(3))
            source = np.repeat(np.arange(len(rows)), [c[i + 1] - c[i] for c in cuts])
            distinct, where = np.unique(grams, return_inverse=True)
            count = np.bincount(where, weights=many, minlength=len(distinct)).astype(np.uint32)[where]
            twice = count > 1
            grams, at, count, source = grams[twice], at[twice], count[twice], source[twice]
            ends = np.searchsorted(source, np.arange(len(rows) + 1))
            for j in np.unique(source):
                found[j].append((top | grams[ends[j]:ends[j + 1]] << np.uint64(64 - WIDTH), count[ends[j]:ends[j + 1]], at[ends[j]:ends[j + 1]]))
        for r, mine in zip(rows, found):
            if mine:
                passing.append({"dealt": 0, "pack": r["pack"], "kind": GRAMS, "payload": b"".join(np.concatenate(x).tobytes() for x in zip(*mine))})
    return pa.Table.from_pylist(passing, schema=MESSAGE)


def sets_of_pack(table: pa.Table) -> pa.Table:
    """Rows of the documents of a pack, and of its classes that may have a partner: repeated n-grams in order of their
    hash, and those of them that stand in the prefix in rare-first order."""
    rows = table.to_pylist()
    tables = {r["payload"] for r in rows if r["kind"] == DOCS}
    out = []
    if not tables:
        raise ValueError("a pack came without its documents; the input changed while it was read")
    docs = pa.ipc.open_stream(next(iter(tables))).read_all()
    # Equal packs (the same rows read twice) have one name: their rows count as often as they came.
    for _ in range(sum(r["kind"] == DOCS for r in rows)):
        empty = pa.nulls(len(docs), pa.binary())
        out.append(pa.table([pa.array(np.full(len(docs), DOCS), pa.int32()), docs["doc_id"], docs["n"], docs["key"], docs["mark"], empty, empty],
                            schema=ROWS))
    lists: dict[int, np.ndarray] = {}
    for payload in {r["payload"] for r in rows if r["kind"] == LISTS}:
        n = len(payload) // 10
        g, at = np.frombuffer(payload, np.uint64, n), np.frombuffer(payload, np.uint16, n, 8 * n)
        new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        lists = {int(g[i]): p for i, p in zip(new, np.split(at, new[1:]))}
    found = []
    for payload in {r["payload"] for r in rows if r["kind"] == GRAMS}:
        n = len(payload) // 14
        g, c, at = np.frombuffer(payload, np.uint64, n), np.frombuffer(payload, np.uint32, n, 8 * n), np.frombuffer(payload, np.uint16, n, 12 * n)
        found.append((g[at != HOT], c[at != HOT], at[at != HOT]))
        for i in np.flatnonzero(at == HOT):
            behind = lists[int(g[i])]
            found.append((np.full(len(behind), g[i]), np.full(len(behind), c[i]), behind))
    if found:
        g, c, at = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((g, c, at))
        g, at = g[order], at[order]
        place, first = np.unique(docs["place"].to_numpy(), return_index=True)
        sizes, keys = docs["n"].to_numpy(), docs["key"].to_pylist()
        cuts = np.searchsorted(at, np.arange(int(place.max(initial=-1)) + 2))
        classes = []
        for p, i in zip(place, first):
            if p < 0:
                continue
            mine, n = g[cuts[p]:cuts[p + 1]], int(sizes[i])
            inside = prefix_size(n) - (n - len(mine))
            if inside > 0 and len(mine):
                classes.append((LISTS, None, n, keys[i], None, np.sort(mine).tobytes(), mine[:inside].tobytes()))
        if classes:
            out.append(pa.table([pa.array(col, t) for col, t in zip(zip(*classes), ROWS.types)], schema=ROWS))
    return pa.concat_tables(out)


POSTING_DDL = "gram bigint, cid bigint, n int, m int, pos int, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
PAIR_DDL = "a bigint, b bigint"


def signature(grams: np.ndarray) -> np.ndarray:
    """256 parity bits: in how many places two of them differ bounds from below by how many n-grams two sets differ."""
    bit = (mixed(grams) >> np.uint64(56)).astype(np.int64)
    odd = np.bincount(bit, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in POSTING_DDL.split(", ")]
    for batch in batches:
        cols: list[list[np.ndarray]] = [[] for _ in names]
        for cid, n, grams, prefix in zip(*[batch.column(c).to_pylist() for c in ("cid", "n", "grams", "prefix")]):
            g, p = np.frombuffer(grams, np.uint64), np.frombuffer(prefix, np.int64)
            k, s = len(p), signature(g)
            each = [p, np.full(k, cid), np.full(k, n, np.int32), np.full(k, len(g), np.int32), np.arange(n - len(g), n - len(g) + k, dtype=np.int32),
                    *[np.full(k, x) for x in s]]
            for col, x in zip(cols, each):
                col.append(x)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names)


def possible(n1, m1, pos1, s1, n2, m2, pos2, s2) -> np.ndarray:
    """Length, positional and suffix filter: whether two sets that first meet at these positions can still link."""
    need = least_shared(n1 + n2)
    far = sum(np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64) for a, b in zip(s1, s2))
    return ((np.minimum(n1, n2) * 100 >= PERCENT * np.maximum(n1, n2)) & (np.minimum(n1 - pos1, n2 - pos2) >= need)
            & ((m1 + m2 - far) // 2 >= need))


def columns(batch) -> dict[str, np.ndarray]:
    out = {c: batch.column(c).to_numpy() for c in batch.schema.names}
    return out | {c: out[c].astype(np.int64) for c in ("n", "m", "pos")}


def side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours in sorted lists that pass the filters."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        c = columns(batch)
        if last is not None:
            c = {k: np.concatenate([last[k], v]) for k, v in c.items()}
        last = {k: v[-1:] for k, v in c.items()}
        x, y = ({k: v[s] for k, v in c.items()} for s in (slice(None, -1), slice(1, None)))
        signs = [[z[f"s{i}"] for i in range(4)] for z in (x, y)]
        fine = ((x["gram"] == y["gram"]) & (x["cid"] != y["cid"])
                & possible(x["n"], x["m"], x["pos"], signs[0], y["n"], y["m"], y["pos"], signs[1]))
        if fine.any():
            pair = np.stack([x["cid"][fine], y["cid"][fine]])
            pair = np.unique(np.sort(pair, axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])


def tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each tile, across components, that pass the filters. Rows come sorted by tile; all tiles of a batch are
    compared at once, each row with the one that stands d places behind it, for d = 1, 2 ... while it is of its tile."""
    rest: dict[str, np.ndarray] = {}

    def pairs(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        new = np.zeros(len(c["gram"]), dtype=bool)
        for k in ("gram", "i", "j"):
            new[1:] |= c[k][1:] != c[k][:-1]
        tile = np.cumsum(new)
        signs = [c[f"s{i}"] for i in range(4)]
        found, at, d = [np.zeros((2, 0), np.int64)], np.arange(len(tile)), 1
        while True:
            at = at[at + d < len(tile)]
            at = at[tile[at] == tile[at + d]]
            if not len(at):
                break
            for k in range(0, len(at), 1 << 18):
                x = at[k:k + (1 << 18)]
                y = x + d
                apart = (c["root"][x] != c["root"][y]) & ((c["i"][x] == c["j"][x]) | (c["block"][x] != c["block"][y]))
                x, y = x[apart], y[apart]
                fine = possible(c["n"][x], c["m"][x], c["pos"][x], [s[x] for s in signs], c["n"][y], c["m"][y], c["pos"][y], [s[y] for s in signs])
                found.append(np.stack([c["cid"][x[fine]], c["cid"][y[fine]]]))
            d += 1
        pair = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        c = columns(batch)
        if rest:
            c = {k: np.concatenate([rest[k], v]) for k, v in c.items()}
        same = np.logical_and.reduce([c[k] == c[k][-1] for k in ("gram", "i", "j")])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        rest = {k: v[cut:] for k, v in c.items()}
        if cut:
            yield pairs({k: v[:cut] for k, v in c.items()})
    if rest:
        yield pairs(rest)


def verify(pairs: DataFrame, sets: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """(a, b, linked) of the distinct ``pairs`` that ``tried`` doesn't hold: each pair is looked at once."""
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for n1, n2, g1, g2 in zip(*[batch.column(c).to_pylist() for c in ("n1", "n2", "g1", "g2")]):
                both = len(np.intersect1d(np.frombuffer(g1, np.uint64), np.frombuffer(g2, np.uint64), assume_unique=True))
                linked.append(100 * both >= PERCENT * (n1 + n2 - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    one = sets.select(F.col("cid").alias("a"), F.col("n").alias("n1"), F.col("grams").alias("g1"))
    two = sets.select(F.col("cid").alias("b"), F.col("n").alias("n2"), F.col("grams").alias("g2"))
    new = pairs.distinct()
    if tried is not None:
        new = new.join(tried, ["a", "b"], "left_anti")
    return new.join(one, "a").join(two, "b").mapInArrow(shared, "a bigint, b bigint, linked boolean")


def classes(docs: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, n_shingles, mark, key), classes (key, cid, least: smallest doc_id), and sets (cid, n, grams, prefix) of the
    classes that may have a partner. ``docs``: doc_id, text, mark. Class numbers are written, so that all readers see the same."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * parts - 1).bit_length()))
    dealt = docs.select("doc_id", "text", "mark").mapInArrow(lambda b: packs(b, bits, n), MESSAGE_DDL)
    counted = dealt.groupBy("dealt").applyInArrow(lambda t: repeated(t, bits), MESSAGE_DDL)
    rows = materialize(counted.groupBy("pack").applyInArrow(sets_of_pack, ROWS_DDL), "gram-sets")
    members = rows.where(F.col("kind") == DOCS).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "mark", "key")
    ids = materialize(members.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least")).withColumn(
        "cid", F.monotonically_increasing_id()), "gram-ids")
    found = rows.where(F.col("kind") == LISTS).select("key", "n", "grams", "prefix").dropDuplicates(["key"])
    return members, ids, materialize(found.join(ids.select("key", "cid"), "key").drop("key"), "gram-classes")


def links_and_roots(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) that connect the classes, and (node, root) of their components."""
    spark = sets.sparkSession
    listed = sets.mapInArrow(postings, POSTING_DDL)
    shared = listed.groupBy("gram").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi").select("gram")
    listed = materialize(listed.join(shared, "gram", "left_semi"), "gram-postings")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Inside a list, sets of about equal size are in an order that differs from list to list, so that a large group of near
    # copies meets in many different pairs and ends up in one component. Sorted by range, so that a list of any length is
    # spread; a pair that a range's end parts is left to the tiles.
    order = [F.floor(F.log(F.col("n")) / SIZE_BAND).alias("band"), F.xxhash64("gram", "cid").alias("turn")]
    near = listed.select("*", *order).repartitionByRange(parts, "gram", "band", "turn").sortWithinPartitions("gram", "band", "turn")
    tried = materialize(verify(near.mapInArrow(side_by_side, PAIR_DDL), sets), "gram-tried")
    links = tried.where("linked").select("a", "b")
    roots = components(links)

    # Lists with more than one component left, in tiles of at most TILE postings a side. A class has as many postings as
    # its prefix is long, so the join by class is even.
    whole = listed.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    mixed_lists = whole.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where(
        "lo < hi").select("gram", F.ceil(F.col("size") / TILE).alias("blocks"))
    blocked = whole.join(mixed_lists, "gram").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    tiles = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    pairs = tiles.repartition(parts, "gram", "i", "j").sortWithinPartitions("gram", "i", "j").mapInArrow(tile_pairs, PAIR_DDL)
    more = verify(pairs, sets, tried.select("a", "b")).where("linked").select("a", "b")
    links = materialize(links.union(more), "gram-links")
    return links, components(links)


def grouped(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_shingles, mark, group, least) for every row of ``docs`` (doc_id, text, mark): the number of its group of linked
    texts and the smallest doc_id in it. A text without words has a null group."""
    bounded(docs.sparkSession)
    members, ids, sets = classes(docs, n)
    _, roots = links_and_roots(sets)
    # Every class in a component of several, its root among them.
    inside = roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
    named = inside.join(ids.select(F.col("cid").alias("node"), "least"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("first"))
    found = inside.join(least, "root").select(F.col("node").alias("cid"), "root", "first")
    # One short row for each class; joined by number, and copies of one text don't multiply it.
    told = ids.join(found, "cid", "left").select("key", F.coalesce("root", "cid").alias("group"), F.when(
        F.col("root").isNull(), F.col("least")).otherwise(F.col("first")).alias("least"))
    return members.join(told, "key", "left").select("doc_id", "n_shingles", "mark", "group", "least")


def jaccard_join(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Words are lower-cased in A-Z only. component_id is the smallest doc_id among the texts that links lead to, the document's
    own included. Texts without words are linked with nothing, not even each other; a text of fewer than ``n`` words is one
    n-gram. Links join texts: two rows that share a doc_id but not a text are no link. Rows with a null doc_id have the
    component of their text, null where none of its texts has an id. Repeated rows come out as often as they came in; an
    empty table gives an empty one; further columns don't matter.
    """
    rows = grouped(docs.select("doc_id", "text", F.lit(None).cast("binary").alias("mark")), n)
    return rows.select("doc_id", "n_shingles", F.coalesce("least", F.when(F.col("group").isNull(), F.col("doc_id"))).alias("component_id"))


def row_mark(df: DataFrame) -> Column:
    """128 bits that tell rows of ``df`` apart."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), *cols)), 16, "0") for i in range(2)]))


def one_of_each(docs: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest doc_id (a null id after all others), of
    several such rows any one, the same in every run. Rows without words all stay, and columns and their values are those
    of ``docs``. Rows are told apart by a hash of all their columns, so repeated and missing ids mix nothing up; column
    types that Spark can't hash (maps) must be left out.
    """
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_mark(docs).alias("mark"))
    rows = grouped(marked.select("row.doc_id", "row.text", "mark"), n).where("`group` is not null")
    # Rows that are equal in all columns count as one line.
    lines = materialize(rows.groupBy("group", "mark").agg(F.min("doc_id").alias("doc_id")), "near-lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    firsts = lines.groupBy("group").agg(F.min(place).alias("first"), F.count("*").alias("lines")).where("lines > 1")
    gone = lines.join(firsts, "group").where("mark <> first.mark").select("mark")
    # Equal rows become one before they are dealt by their mark; what goes is dealt alike, so each text travels once.
    worded = F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))
    single = marked.where(worded).dropDuplicates(["mark"]).join(gone, "mark", "left_anti")
    return single.unionByName(marked.where(~worded)).select("row.*")
