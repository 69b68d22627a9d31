"""Exact Jaccard join of word shingle sets as a metric-space join.

1 - J is a metric. The join runs in four steps:

1. Regions. Two sets within the radius differ in at most D shingles, where D
   follows from their sizes. The shingle space is split by hash into more than
   D parts, so two such sets agree on a known number of whole parts. A document
   joins one region for each of its parts (by the part's content), and, near
   the upper end of its size class, those of the next class.
2. Groups. Each document leaves out the largest of its regions, one fewer than
   it must share with any set that it is linked to, so every link still has a
   region. There the hashes of all its parts (a byte each) tell which members
   may be linked; what leaves a task is a forest of those, never the pairs.
3. Pivots. Each connected group is dealt by bytes of text to tasks. Inside a
   task pivots create Voronoi regions; a member joins the region of its nearest
   pivot, and, by the triangle inequality, those of all pivots that are at most
   twice the radius farther. Regions recurse with new pivots. Where pivots do
   not separate the members, documents outside the largest class are compared
   with all others, in blocks. Distances are exact: they come from the sets.
4. A group that is too large for a task is dealt in shares; pivots drawn from
   outside its largest class are copied to every share and compared with all
   members. A compared pivot is done; the rounds end when all that are left are
   of one class.

Equal sets are one node with any number of documents. Nodes and shingles are
64-bit hashes.

Defined results: a text without words (or null) has an empty set and is linked
with nothing; a text with fewer words than a shingle has one shingle, all its
words; rows with equal or null doc_id are separate rows of a class, and the
class id is the least id in it (null only if it has no other); an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components
from .textkit import LOWER, SPACE, U, discard, flat, mix, ngram_hash, slices, span_hash, windows, words, written

#: Regions with so many members at most compare the parts of them all, others by pivots first.
SMALL = 32
#: Members of one region in one task's rows from which they do not meet in the region's task (LARGE stands for their number).
FREQUENT, LARGE = 256, 2**31 - 1
#: Parts of a class up to which they are compared in its regions; members of a region of longer documents form one group.
WIDE = 256
#: Pairs of members of a region that are compared without looking for a common part first.
PAIRS = 4 << 20
#: Bytes of rows that a task packs at once; bytes of one task's rows.
PACKED, DEALT = 10 << 20, 10 << 20
#: Bytes of text of a group, or of a share of it, in one task; bytes of the pivots that are copied to each share.
BUDGET, DRAWN = 24 << 20, 2 << 20
#: Members that are compared directly, and pivots of a region.
DIRECT, PIVOTS = 192, 12
#: Ids that are broadcast at most (32 MB).
SENT = 2_000_000
NO_ID = -(2**63)
_HI = np.unique(np.ceil(1 / 0.7 ** np.arange(1, 90))).astype(np.int64)


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all texts, offsets by text)."""
    low = LOWER[buf]
    starts, ends, woff = words(low, off, SPACE)
    wh = span_hash(low, starts, ends - starts)
    counts = np.diff(woff)
    at, text = windows(woff, n)
    g = ngram_hash(wh, n)[at] if len(at) else np.zeros(0, np.uint64)
    for t in np.flatnonzero((counts > 0) & (counts < n)):  # the whole sequence as one
        h = U(int(counts[t]))
        for w in wh[woff[t] : woff[t + 1]]:
            h = mix(np.array([h], np.uint64) ^ w)[0]
        g, text = np.append(g, h), np.append(text, t)
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    g, text = g[new], text[new]
    return g, np.searchsorted(text, np.arange(len(off)))


def set_keys(g: np.ndarray, goff: np.ndarray) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(g[i:j].tobytes(), digest_size=8).digest(), "little", signed=True) for i, j in zip(goff[:-1], goff[1:], strict=True)], np.int64)


def most_different(hi: np.ndarray, percent: int) -> np.ndarray:
    """Shingles in which two linked sets of `hi` shingles at most differ, at most."""
    return (2 * hi * (100 - percent)) // (100 + percent)


def meetings(different: np.ndarray) -> np.ndarray:
    """In how many regions two linked sets meet at least."""
    return 1 + different // 4


def may_be_empty(different: np.ndarray) -> np.ndarray:
    """Empty parts that are no regions; a set with more of them has a region for each."""
    return 2 + different // 16


def empty_regions(cls: int, m: int) -> np.ndarray:
    """The regions of the m parts of a class where they are empty."""
    return _region(np.zeros(m, np.uint64), np.arange(m), cls)


def _region(content: np.ndarray, number: np.ndarray, cls) -> np.ndarray:
    return np.maximum(mix(mix(content) ^ mix((number + (cls << 32)).astype(np.uint64) + U(0x51ED27))) >> U(16), U(1))


def size_classes(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(class, parts, regions that a link must share) of a set of n shingles, one for each class that it joins."""
    out = []
    for c in range(int(np.searchsorted(_HI, n, "left")), int(np.searchsorted(_HI, n * 100 // percent, "left")) + 1):
        different = most_different(_HI[c : c + 1], percent)
        if n and different[0] > 0:
            m = int(different[0] + meetings(different)[0])
            own = (n + min(int(_HI[c]), n * 100 // percent)) * (100 - percent) // (100 + percent)  # with a partner of this class
            out.append((c, m + int(may_be_empty(different)[0]), m - own))
    return out


def part_regions(g: np.ndarray, goff: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By step of the size class: (sets, parts of each, 48-bit region of all their parts; 0 where a part has none)."""
    sizes = np.diff(goff)
    own = np.searchsorted(_HI, sizes, "left")
    top = np.searchsorted(_HI, sizes * 100 // percent, "left")
    out = []
    for step in range(int((top - own).max()) + 1 if len(sizes) else 0):
        who = np.flatnonzero((sizes > 0) & (own + step <= top))
        cls = own[who] + step
        different = most_different(_HI[cls], percent)
        who, cls, different = who[different > 0], cls[different > 0], different[different > 0]
        if not len(who):
            continue
        most_empty = may_be_empty(different)
        m = different + meetings(different) + most_empty
        base = np.concatenate([[0], np.cumsum(m)])
        n = sizes[who]
        at = np.repeat(goff[:-1][who] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        s = g[at]
        part = (mix(s) >> U(20)) % np.repeat(m, n).astype(np.uint64)
        idx = np.repeat(base[:-1], n) + part.astype(np.int64)
        low = np.bincount(idx, (s & U(0xFFFFFFFF)).astype(float), base[-1]).astype(np.uint64)
        high = np.bincount(idx, (s >> U(32)).astype(float), base[-1]).astype(np.uint64)
        count = np.bincount(idx, minlength=base[-1])
        owner = np.repeat(np.arange(len(who)), m)
        empty = np.bincount(owner[count == 0], minlength=len(who))
        number = np.arange(base[-1]) - base[:-1][owner]
        rid = _region(low + (high << U(32)) + count.astype(np.uint64) * U(0x9E3779B97F4A7C15), number, cls[owner])
        go = (count > 0) | (empty > most_empty)[owner]
        out.append((who, m, np.where(go, rid, U(0))))
    return out


def regions(g: np.ndarray, goff: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(region, set) for all sets that may have a link to a different set."""
    found = part_regions(g, goff, percent)
    rid = np.concatenate([r for _, _, r in found] or [np.zeros(0, np.uint64)])
    who = np.concatenate([np.repeat(w, m) for w, m, _ in found] or [np.zeros(0, np.int64)])
    return rid[rid > 0], who[rid > 0]


def _bytes6(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _from6(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1)


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new row value begins."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _packed(by: list[np.ndarray], columns: dict[str, np.ndarray]) -> Iterator[tuple[list[int], dict[str, bytes]]]:
    """Rows of the same `by` as one row of bytes."""
    order = np.lexsort(by[::-1])
    by = [b[order] for b in by]
    columns = {k: v[order] for k, v in columns.items()}
    at = _starts(*by)
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(order)][: len(at)], strict=True):
        yield [int(b[i]) for b in by], {k: v[i:j].tobytes() for k, v in columns.items()}


class Classes:
    """Classes of 0..n-1 that only ever join."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Takes each a[i] and b[i] for one class; the least member stands for it."""
        of = self.of
        while len(a):
            x, y = of[a], of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(of, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = of[of]
                if (up == of).all():
                    break
                of[:] = up


def likely(x: np.ndarray, size: np.ndarray, percent: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows may be links: no more parts differ than shingles may."""
    out = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
    i, j = i[out], j[out]
    most = (size[i] + size[j]) * (100 - percent) // (100 + percent)
    ok, step = np.zeros(len(i), bool), max(1, (8 << 20) // max(1, x.shape[1]))
    for k in range(0, len(i), step):
        ok[k : k + step] = (x[i[k : k + step]] != x[j[k : k + step]]).sum(1) <= most[k : k + step]
    out[out] = ok
    return out


def grouped(x: np.ndarray, size: np.ndarray, node: np.ndarray, need: int, percent: int, classes: Classes, rows: np.ndarray) -> None:
    """Joins what may be linked among the rows of one region.

    Pivots first, for members of a large region are mostly near copies. If
    they leave more than one class, each pair that may be a link agrees on a
    part beyond the need - 1 most common ones (need: parts in which linked
    sets agree at least, empty ones included); members meet by those.
    """
    if len(rows) < 2 or (classes.of[node[rows]] == classes.of[node[rows[0]]]).all():
        return
    if not x.shape[1]:
        classes.join(node[rows[1:]], np.full(len(rows) - 1, node[rows[0]]))
        return
    if len(rows) <= SMALL:
        i, j = np.triu_indices(len(rows), 1)
        i, j = rows[i], rows[j]
        ok = likely(x, size, percent, i, j)
        classes.join(node[i[ok]], node[j[ok]])
        return
    common = np.array([(v := np.bincount(x[rows, p])).dot(v) for p in range(x.shape[1])])
    by_all = (common == len(rows) ** 2).sum()
    if by_all >= need:  # nothing that the parts could tell apart
        classes.join(node[rows[1:]], np.full(len(rows) - 1, node[rows[0]]))
        return
    for p in rows[:: max(1, len(rows) // 16)][:16]:
        at = np.full(len(rows), p)
        ok = likely(x, size, percent, rows, at)
        classes.join(node[rows[ok]], node[at[ok]])
    names, times = np.unique(classes.of[node[rows]], return_counts=True)
    out = rows[classes.of[node[rows]] != names[np.argmax(times)]]
    if len(out) * len(rows) <= PAIRS:
        i, j = np.repeat(out, len(rows)), np.tile(rows, len(out))
        apart = classes.of[node[i]] != classes.of[node[j]]
        i, j = i[apart], j[apart]
        ok = likely(x, size, percent, i, j)
        classes.join(node[i[ok]], node[j[ok]])
        return
    left = np.argsort(common, kind="stable")[: x.shape[1] - need + 1]
    for p in left.tolist():
        v = x[rows, p]
        order = np.argsort(v, kind="stable")
        at = _starts(v[order])
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(rows)], strict=True):
            if b - a > 1:
                grouped(x, size, node, need, percent, classes, rows[order[a:b]])


def region_groups(rid: np.ndarray, key: np.ndarray, size: np.ndarray, x: np.ndarray, need: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its group) for all members that may be linked to another in one of the regions."""
    order = np.lexsort((key, rid))
    order = order[_starts(rid[order], key[order])]
    rid, size, x = rid[order], size[order], x[order]
    names, node = np.unique(key[order], return_inverse=True)
    classes = Classes(len(names))
    at = _starts(rid)
    ends = np.r_[at[1:], len(rid)]
    number = np.repeat(np.arange(len(at)), ends - at)
    small = (ends - at <= SMALL)[number]
    for d in range(1, SMALL):
        i = np.flatnonzero((number[d:] == number[:-d]) & small[:-d]) if len(rid) > d else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[classes.of[node[i]] != classes.of[node[i + d]]]
        ok = likely(x, size, percent, i, i + d)
        classes.join(node[i[ok]], node[i[ok] + d])
    for k in np.flatnonzero(ends - at > SMALL).tolist():
        grouped(x, size, node, need, percent, classes, np.arange(at[k], ends[k]))
    moved = np.flatnonzero(classes.of != np.arange(len(names)))
    return names[moved], names[classes.of[moved]]


class Space:
    """Shingle sets as points of the Jaccard metric, and their classes of links."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.off = np.concatenate([[0], np.cumsum(self.size)])
        names, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.ids, self.shingles, self.shared = ids, len(names), times[ids] > 1
        self.percent, self.radius = percent, 1 - percent / 100
        self.classes = Classes(len(sets))

    def flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingle, place of its set among rows) of those that two sets share."""
        n = self.size[rows]
        at = np.arange(int(n.sum())) + np.repeat(self.off[rows] - (np.cumsum(n) - n), n)
        place = np.repeat(np.arange(len(rows)), n)
        keep = self.shared[at]
        return self.ids[at[keep]], place[keep]

    def both(self, pivots: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sizes of the intersections, a row a pivot."""
        out = np.zeros((len(pivots), len(rows)), np.int64)
        ids, place = self.flat(rows)
        own, where = self.flat(pivots)
        used = np.unique(own)
        if len(ids) < 10 * len(used) * len(rows) / 250:  # which is less work: a pass of all rows a pivot, or dense products
            mark = np.zeros(self.shingles, bool)
            for k, p in enumerate(pivots.tolist()):
                own = self.ids[self.off[p] : self.off[p + 1]]
                mark[own] = True
                out[k] = np.bincount(place[mark[ids]], minlength=len(rows))
                mark[own] = False
            return out
        column = np.full(self.shingles, -1)
        column[used] = np.arange(len(used))
        c, keep = column[ids], column[ids] >= 0
        c, place = c[keep], place[keep]
        order = np.argsort(c, kind="stable")
        c, place = c[order], place[order]
        oc = column[own]
        order = np.argsort(oc, kind="stable")
        oc, where = oc[order], where[order]
        step = max(64, (4 << 20) // max(1, len(rows) + len(pivots)))
        total = np.zeros((len(pivots), len(rows)), np.float64)
        for lo in range(0, len(used), step):
            a, b = np.searchsorted(c, [lo, lo + step])
            left, right = np.zeros((len(pivots), step), np.float32), np.zeros((step, len(rows)), np.float32)
            right[c[a:b] - lo, place[a:b]] = 1
            a, b = np.searchsorted(oc, [lo, lo + step])
            left[where[a:b], oc[a:b] - lo] = 1
            total += left @ right
        return total.astype(np.int64)

    def compare(self, pivots: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Joins pivots with all rows within the radius; gives the distances, a row a pivot."""
        both = self.both(pivots, rows)
        either = self.size[pivots][:, None] + self.size[rows][None, :] - both
        i, j = np.nonzero(100 * both >= self.percent * either)
        self.classes.join(pivots[i], rows[j])
        return 1 - both / either

    def direct(self, rows: np.ndarray) -> None:
        """Joins all links among rows: those outside the largest class are compared with all, in blocks."""
        done = np.zeros(len(rows), bool)
        while True:
            of = self.classes.of[rows]
            names, inverse, times = np.unique(of, return_inverse=True, return_counts=True)
            left = np.flatnonzero(~done & (inverse != np.argmax(times)))
            if not len(left):
                return
            left = left[:DIRECT]
            done[left] = True
            for k in range(0, len(rows), 4096):
                self.compare(rows[left], rows[k : k + 4096])

    def join(self, rows: np.ndarray) -> None:
        """Joins all links among rows by pivots and Voronoi regions with windows."""
        if len(rows) < 2 or (self.classes.of[rows] == self.classes.of[rows[0]]).all():
            return
        if len(rows) <= DIRECT:
            return self.direct(rows)
        pivots = rows[:: max(1, len(rows) // PIVOTS)][:PIVOTS]
        d = self.compare(pivots, rows)
        near = d.min(0) + 2 * self.radius + 1e-9
        rest = ~np.isin(rows, pivots)
        cells = [rows[(d[k] <= near) & rest] for k in range(len(pivots))]
        if sum(map(len, cells)) > 3 * len(rows) or max(map(len, cells)) > 0.7 * len(rows):  # they all are about as far from one pivot as from another
            return self.direct(rows)
        for cell in cells:
            self.join(cell)

    def links(self) -> np.ndarray:
        """The least member of each member's class."""
        self.join(np.arange(len(self.size)))
        return self.classes.of


def sets_of(table: pa.Table, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(distinct keys in order, their shingle sets) of rows (key, text)."""
    sets = {}
    for b in slices(iter(table.combine_chunks().to_batches())):
        g, goff = shingle_sets(*flat(b.column("text")), n)
        for i, k in enumerate(b.column("key").to_pylist()):
            sets.setdefault(k, g[goff[i] : goff[i + 1]])
    keys = sorted(sets)
    return np.array(keys, np.int64), [sets[k] for k in keys]


class Join:
    """The steps of one join; `words_per` words a shingle, `percent` the least similarity."""

    def __init__(self, docs: DataFrame, words_per: int, percent: int):
        self.n, self.percent = words_per, percent
        self.spark = docs.sparkSession
        self.texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
        self.rows = written(self.keyed(), "sets")

    def keyed(self) -> DataFrame:
        """id, number of shingles and set key of each row."""
        n = self.n

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                g, goff = shingle_sets(*flat(b.column("text")), n)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(goff)), pa.array(set_keys(g, goff))], names=["id", "n_shingles", "key"])

        return self.texts.mapInArrow(rows, "id long, n_shingles long, key long")

    def wanted(self, ids: DataFrame) -> DataFrame:
        """Texts of the rows with one of the ids."""
        return self.texts.join(F.broadcast(ids) if ids.count() <= SENT else ids, "id", "left_semi").select("text")

    def buckets(self, entries: int, width: int) -> int:
        """Into how many tasks rows of so many bytes are dealt."""
        return int(max(1, entries * width // DEALT, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), entries * width >> 20)))

    def members(self) -> DataFrame:
        """(key, shared): the regions that a node shares with another (long, little-endian), then their numbers of members."""
        n, percent = self.n, self.percent
        entries = int(self.rows.agg(F.sum("n_shingles")).first()[0] or 0) // 2  # regions are fewer
        buckets = self.buckets(entries, 14)
        by_key = max(1, buckets // 4)

        def pack(rid: list, key: list) -> Iterator[pa.RecordBatch]:
            rid, key = np.concatenate(rid), np.concatenate(key)
            order = np.lexsort((key, rid))
            order = order[_starts(rid[order], key[order])]
            rid, key = rid[order], key[order]
            at = _starts(rid)
            times = np.diff(np.r_[at, len(rid)])
            often = np.repeat(times >= FREQUENT, times)
            # members of what is frequent here go anywhere; the region's task hears of it by a member 0 times
            bucket = (rid % U(buckets)).astype(np.int64)
            salted = (mix(key.view(np.uint64) ^ rid) % U(buckets)).astype(np.int64) + buckets
            say = at[times >= FREQUENT]
            rid, key, mark = np.r_[rid, rid[say]], np.r_[key, key[say]], np.r_[np.zeros(len(rid), np.int64), np.ones(len(say), np.int64)]
            bucket = np.r_[np.where(often, salted, bucket), bucket[say]]
            rows = list(_packed([bucket, mark], {"rid": _bytes6(rid), "key": key.astype("<i8")}))
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b, _ in rows], pa.int64()), pa.array([b[1] for b, _ in rows], pa.int64()), pa.array([c["rid"] for _, c in rows], pa.binary()), pa.array([c["key"] for _, c in rows], pa.binary())], names=["bucket", "mark", "rid", "key"])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rid, key, held = [], [], 0
            for b in slices(batches):
                g, goff = shingle_sets(*flat(b.column("text")), n)
                r, who = regions(g, goff, percent)
                rid.append(r)
                key.append(set_keys(g, goff)[who])
                held += 14 * len(r)
                if held > PACKED:
                    yield from pack(rid, key)
                    rid, key, held = [], [], 0
            if held:
                yield from pack(rid, key)

        def meet(bucket: tuple, table: pa.Table) -> pa.Table:
            mark = table["mark"].to_pylist()
            rid = [_from6(r) for r in table["rid"].to_pylist()]
            said = np.unique(np.concatenate([np.zeros(0, np.uint64), *(r for r, m in zip(rid, mark, strict=True) if m)]))
            rid = np.concatenate([np.zeros(0, np.uint64), *(r for r, m in zip(rid, mark, strict=True) if not m)])
            key = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(k, "<i8") for k, m in zip(table["key"].to_pylist(), mark, strict=True) if not m)])
            order = np.lexsort((key, rid))
            order = order[_starts(rid[order], key[order])]
            rid, key = rid[order], key[order]
            at = _starts(rid)
            times = np.diff(np.r_[at, len(rid)])
            size = np.repeat(times, times)
            size[np.isin(rid, said) | (bucket[0].as_py() >= buckets)] = LARGE
            keep = size > 1
            rid, key, size = rid[keep], key[keep], size[keep]
            rows = list(_packed([(key.view(np.uint64) % U(by_key)).astype(np.int64)], {"rid": _bytes6(rid), "key": key, "size": size.astype("<i4")}))
            return pa.table({"by_key": pa.array([b[0] for b, _ in rows], pa.int64())} | {c: pa.array([r[c] for _, r in rows], pa.binary()) for c in ("rid", "key", "size")})

        def gather(bucket: tuple, table: pa.Table) -> pa.Table:
            rid, key, size = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("rid", np.uint8), ("key", np.int64), ("size", "<i4")))
            rows = list(_packed([key], {"rid": _from6(rid.tobytes()), "size": size.astype("<i8")}))
            return pa.table({"key": pa.array([b[0] for b, _ in rows], pa.int64()), "shared": pa.array([c["rid"] + c["size"] for _, c in rows], pa.binary())})

        dealt = self.texts.mapInArrow(deal, "bucket long, mark long, rid binary, key binary")
        shared = dealt.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(meet, "by_key long, rid binary, key binary, size binary")
        return shared.repartition(by_key, "by_key").groupBy("by_key").applyInArrow(gather, "key long, shared binary")

    def groups(self) -> DataFrame:
        """(node, label): nodes that may be linked, by connected group."""
        percent = self.percent
        nodes = self.rows.where("n_shingles > 0").groupBy("key").agg(F.min("n_shingles").alias("n"), F.min("id").alias("id"))
        found = self.members().join(nodes, "key")

        def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                times = pc.divide(pc.binary_length(b.column("shared")), 16).to_pylist()
                yield b.filter(pa.array([any(t >= need for _, _, need in size_classes(n, percent)) for t, n in zip(times, b.column("n").to_pylist(), strict=True)], pa.bool_()))

        live = written(found.select("key", "n", "id", "shared").mapInArrow(enough, "key long, n long, id long, shared binary"), "shared")
        looks = F.octet_length("shared") / 16 * (F.least(F.lit(WIDE), F.col("n") / 3) + 22)
        buckets = self.buckets(int(live.agg(F.sum(looks)).first()[0] or 0), 1)
        nodes = self.wanted(live.select("id").distinct()).mapInArrow(self.parts(), "key long, parts binary").join(live.select("key", "n", "shared"), "key")

        def prefix(parts: bytes, shared: bytes, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """(class, its parts' regions, those that stay)."""
            rid, at = _from6(parts), 0
            name, size = np.frombuffer(shared, "<i8").reshape(2, -1)
            order = np.argsort(name)
            name, size = name[order].astype(np.uint64), size[order]
            for cls, m, need in size_classes(n, percent):
                own = rid[at : at + m]
                at += m
                where = np.minimum(np.searchsorted(name, own), len(name) - 1)
                mine = np.flatnonzero((name[where] == own) & (own > 0))
                if len(mine) >= need:
                    s = size[where[mine]]
                    stay = mine[np.lexsort((own[mine], s))][: len(mine) - need + 1]
                    yield cls, own, own[stay]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    by_class: dict[int, list] = {}
                    for row in batch.slice(lo, 4096).to_pylist():
                        for cls, own, stay in prefix(row["parts"], row["shared"], row["n"]):
                            by_class.setdefault(cls, []).append((row["key"], row["n"], own, stay))
                    out = []
                    for cls, found in by_class.items():
                        times = [len(f[3]) for f in found]
                        rid = np.concatenate([f[3] for f in found])
                        who = np.repeat(np.arange(len(found)), times)
                        parts = np.stack([f[2] for f in found])
                        none = (parts == 0) | (parts == empty_regions(cls, parts.shape[1]))
                        look = np.where(none, U(0), parts % U(255) + U(1)).astype(np.uint8)
                        look = look[:, : look.shape[1] if look.shape[1] <= WIDE else 0]
                        key, n = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
                        bucket = (rid % U(buckets)).astype(np.int64)
                        for b, c in _packed([bucket], {"rid": rid.astype("<u8"), "who": who}):
                            w = np.frombuffer(c["who"], np.int64)
                            out.append((b[0], cls, c["rid"], key[w].tobytes(), n[w].tobytes(), look[w].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), *(pa.array([o[k] for o in out], pa.binary()) for k in (2, 3, 4, 5))], names=["bucket", "cls", "rid", "key", "n", "look"])

        def meet(bucket: tuple, table: pa.Table) -> pa.Table:
            by_class: dict[int, list] = {}
            for row in table.to_pylist():
                by_class.setdefault(row["cls"], []).append(row)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for cls, rows in by_class.items():
                different = most_different(_HI[cls : cls + 1], percent)
                m = int(different[0] + meetings(different)[0] + may_be_empty(different)[0])
                rid, key, n = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("rid", "<u8"), ("key", np.int64), ("n", np.int64)))
                look = np.frombuffer(b"".join(r["look"] for r in rows), np.uint8).reshape(len(rid), m if m <= WIDE else 0)
                node, least = region_groups(rid, key, n, look, m - int(different[0]), percent)
                a.append(node)
                b.append(least)
            return pa.table({"u": np.concatenate(a), "v": np.concatenate(b)})

        dealt = nodes.select("key", "n", "parts", "shared").mapInArrow(deal, "bucket long, cls long, rid binary, key binary, n binary, look binary")
        edges = dealt.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "u long, v long")
        found = written(components(edges), "groups")
        discard(live)
        return found

    def parts(self):
        """Set key and regions by part of each distinct text of a batch."""
        n, percent = self.n, self.percent

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                g, goff = shingle_sets(*flat(b.column("text")), n)
                keys, parts = set_keys(g, goff), [[] for _ in range(b.num_rows)]
                for who, m, rid in part_regions(g, goff, percent):
                    raw, off = _bytes6(rid).tobytes(), np.concatenate([[0], 6 * np.cumsum(m)]).tolist()
                    for k, w in enumerate(who.tolist()):
                        parts[w].append(raw[off[k] : off[k + 1]])
                first = np.unique(keys, return_index=True)[1].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array([b"".join(parts[i]) for i in first], pa.binary())], names=["key", "parts"])

        return rows

    def fetched(self, groups: DataFrame) -> DataFrame:
        """(label, key, text) of all nodes in groups, one text a node."""
        n = self.n

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(*shingle_sets(*flat(b.column("text")), n))), b.column("text")], names=["key", "text"])

        ids = self.rows.where("n_shingles > 0").groupBy("key").agg(F.min("id").alias("id")).join(groups.withColumnRenamed("node", "key"), "key")
        ids = written(ids.select("id").distinct(), "ids")
        texts = self.wanted(ids).mapInArrow(keys, "key long, text string")
        one = texts.join(groups.withColumnRenamed("node", "key"), "key").groupBy("key").agg(F.first("label").alias("label"), F.first("text").alias("text"))
        return written(one.select("label", "key", "text"), "texts")

    def labels(self) -> DataFrame:
        """(key, label) of all nodes with a link to another node."""
        groups = self.groups()
        texts = self.fetched(groups)
        size = written(texts.groupBy("label").agg(F.sum(F.octet_length("text")).alias("bytes")), "group_sizes")
        total, most = size.agg(F.sum("bytes"), F.max("bytes")).first()
        if not total:
            return size.select(F.col("label").alias("key"), "label")
        found = self.within(texts.join(size.where(F.col("bytes") <= BUDGET), "label", "left_semi"), total)
        if most > BUDGET:
            found = found.union(self.beyond(texts.join(size.where(F.col("bytes") > BUDGET), "label")))
        return written(found, "labels")

    def within(self, texts: DataFrame, total: int) -> DataFrame:
        """Classes in groups that fit a task; many groups share one."""
        n, percent = self.n, self.percent
        buckets = self.buckets(total, 2)

        def classes(bucket: tuple, table: pa.Table) -> pa.Table:
            labels = np.array(table["label"].to_pylist(), np.int64)
            order = np.argsort(labels, kind="stable")
            at = _starts(labels[order])
            key, label = [], []
            table = table.select(["key", "text"]).take(pa.array(order)).combine_chunks()
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
                keys, sets = sets_of(table.slice(a, b - a), n)
                of = Space(sets, percent).links()
                linked = np.bincount(of, minlength=len(of))[of] > 1
                key.append(keys[linked])
                label.append(keys[of[linked]])
            return pa.table({"key": np.concatenate(key), "label": np.concatenate(label)})

        return texts.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets))).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(classes, "key long, label long")

    def beyond(self, texts: DataFrame) -> DataFrame:
        """Classes in groups (label, key, text, bytes) that are dealt in shares."""
        n, percent = self.n, self.percent

        def measure(share: tuple, table: pa.Table) -> pa.Table:
            keys, sets = sets_of(table.select(["key", "text"]), n)
            drawn = np.isin(keys, np.array([k for k, d in zip(table["key"].to_pylist(), table["drawn"].to_pylist(), strict=True) if d], np.int64))
            space, pivots, rows = Space(sets, percent), np.flatnonzero(drawn), np.arange(len(keys))
            for i in range(0, len(pivots), DIRECT):
                for j in range(0, len(rows), 4096):
                    space.compare(pivots[i : i + DIRECT], rows[j : j + 4096])
            moved = np.flatnonzero(space.classes.of != rows)
            return pa.table({"u": keys[moved], "v": keys[space.classes.of[moved]]})

        texts = written(texts.withColumn("own", F.octet_length("text")), "beyond")
        state = written(texts.select("label", "key", "own", F.col("key").alias("class"), F.lit(False).alias("done")), "state")
        while True:
            most = state.groupBy("label", "class").agg(F.count("*").alias("times")).groupBy("label").agg(F.max_by("class", F.struct("times", "class")).alias("largest"))
            left = state.join(most, "label").where(~F.col("done") & (F.col("class") != F.col("largest")))
            of = left.groupBy("label").agg(F.ceil(F.sum("own") / DRAWN).alias("of"), F.min("key").alias("least"))
            drawn = written(left.join(of, "label").where((F.col("key") == F.col("least")) | (F.pmod(F.xxhash64("key"), F.col("of")) == 0)).select("key", "label"), "drawn")
            if drawn.isEmpty():
                return state.select("key", F.col("class").alias("label"))
            rows = texts.join(drawn.select("label").distinct(), "label", "left_semi").join(drawn.select("key", F.lit(True).alias("drawn")), "key", "left").fillna(False, ["drawn"])
            shares = F.ceil(F.col("bytes") / BUDGET)
            to = F.when(F.col("drawn"), F.sequence(F.lit(0).cast("long"), shares - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), shares)))
            edges = rows.select("label", "key", "text", "drawn", F.explode(to).alias("share")).groupBy("label", "share").applyInArrow(measure, "u long, v long")
            joined = components(edges.join(state.select(F.col("key").alias("u"), F.col("class").alias("cu")), "u").join(state.select(F.col("key").alias("v"), F.col("class").alias("cv")), "v").select("cu", "cv"), "cu", "cv")
            after = state.join(joined.select(F.col("node").alias("class"), F.col("label").alias("to")), "class", "left").join(drawn.select("key", F.lit(True).alias("now")), "key", "left")
            before, state = state, written(after.select("label", "key", "own", F.coalesce("to", "class").alias("class"), (F.col("done") | F.coalesce("now", F.lit(False))).alias("done")), "state")
            discard(before, drawn)

    def by_key(self) -> DataFrame:
        """(key, label, least): each non-empty node, its class, and the least real id of its own rows."""
        real = F.when(F.col("id") != NO_ID, F.col("id"))
        nodes = self.rows.where("n_shingles > 0").groupBy("key").agg(F.min(real).alias("least"), F.count("*").alias("rows"))
        return nodes.join(self.labels(), "key", "left").withColumn("label", F.coalesce("label", "key"))

    def classes(self) -> DataFrame:
        """(doc_id, n_shingles, component_id), a row a row."""
        real = F.when(F.col("id") != NO_ID, F.col("id"))
        known = written(self.by_key(), "nodes")
        known = known.join(known.groupBy("label").agg(F.min("least").alias("component_id")), "label").select(F.col("key").alias("k"), "component_id")
        out = self.rows.withColumn("k", F.when(F.col("n_shingles") > 0, F.col("key"))).join(known, "k", "left")
        return out.select(real.alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(real).alias("component_id"))


def similarity_classes(docs: DataFrame, words_per: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id: the least doc_id that the document reaches by links."""
    return Join(docs, words_per, percent).classes()


def one_of_each(docs: DataFrame, words_per: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class of near copies, with all its columns: the one with the least doc_id (rows without one last).

    Rows that share an id are told apart by their contents; of equal rows one
    stays. Rows without words are linked with nothing, and all stay. Only rows
    of classes with several rows are shuffled by class, pre-aggregated.
    """
    join = Join(docs, words_per, percent)
    nodes = written(join.by_key(), "nodes")
    several = nodes.join(nodes.groupBy("label").agg(F.sum("rows").alias("of")).where("of > 1"), "label").select("key", "label")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    n = words_per

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            g, goff = shingle_sets(*flat(b.column(text)), n)
            key = pa.array(set_keys(g, goff), mask=np.diff(goff) == 0)
            yield pa.RecordBatch.from_arrays([*b.columns, key], names=[*names, "key"])

    rows = rows.mapInArrow(keys, StructType([*rows.schema.fields, StructField("key", LongType())]))
    rows = rows.join(several, "key", "left")
    own = F.struct(*names)
    number = names[docs.columns.index("doc_id")]
    first = F.struct(F.col(number).isNull(), F.col(number).cast("long"), F.xxhash64(text), F.xxhash64(F.to_json(own)))
    alone = rows.where("label is null").select(*names)
    chosen = rows.where("label is not null").groupBy("label").agg(F.min_by(own, first).alias("own")).select("own.*")
    return alone.union(chosen).toDF(*docs.columns)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * m >= 85 * (x.k + y.k - m)),
e AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.v, r.c FROM r JOIN e ON r.doc_id = e.u)
SELECT d.doc_id, coalesce(any_value(n.k), 0) AS n_shingles, coalesce(min(r.c), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""
