"""Repeated byte strings by column-wise construction of a collection's sorted suffixes.

Every window of 400 bytes has an anchor: of its 128-byte strings the one with the smallest
hash, the leftmost of equals. Consecutive windows with one anchor make a segment, so equal
windows lie in segments with equal anchors, at the same distance from it. That deals the
collection: segments are counted by anchor, an anchor seen once rules its windows out, and
segments that are equal elsewhere are repeated as a whole. What is left, one segment of
each content under an anchor with several contents, is brought together by anchor.

There the suffixes of all segments are sorted column by column, from the last to the first:
each round inserts one symbol of every segment in front of its last suffix. The order of
the round before, stably sorted by the inserted symbols (the Burrows-Wheeler column), is
the order of the new suffixes, and the common prefix of neighbours is the range minimum of
the old ones plus one. Segments are aligned at their anchors, so only suffixes of one
column can hold equal windows and only the newest slice of the transform is kept: a round
costs the number of segments, not the size of the collection. A window repeats if the
common prefix with a neighbour reaches 400 bytes. Segments are written to the shared
folder in the order of anchors and read in sequence, a bounded number at a time.

An anchor with more than `CHUNK` bytes of segments is hot, and no task sorts it: its windows are
told apart by two 64-bit hashes of their 400 bytes. Windows met twice in a piece are settled there,
one of them is dealt on by its hash. Anchors that are hot by what single groups of texts hold of
them are found early and their segments dealt by content; the others when their segments are counted.
A text with more than `OFTEN` copies is shuffled once: the others lose all or nothing by their length.

Nulls, empty texts and texts under 400 bytes lose nothing. A null doc_id is carried along;
repeated rows are copies of each other and lose everything if long enough. Empty tables
give no rows; extra columns are ignored. Segments and anchors are told apart by 64 bits.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chars import byte_groups, mix
from tidemark.llm.common import small, small_batches, table
from tidemark.llm.packed import REPLY, bucket_of, by_bucket, column, cut, n_buckets, replies, runs, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 400
ANCHOR = 128
REACH = LENGTH - ANCHOR  # largest distance of an anchor from the start of its window
PIECE = 1 << 20  # bytes handled at a time
CHUNK = 8 << 20  # bytes of segments sorted together; an anchor with more is hot
HOT_WINDOWS = 1 << 20  # windows of hot segments in a bucket
OFTEN = 1000  # copies of a text; of one with more all but one are settled where they are read
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_OTHER_BASE = 0x9E3779B97F4A7C15
_OTHER_INVERSE = pow(_OTHER_BASE, -1, 1 << 64)
# A segment: start of its first window, distance of the anchor, windows less one.
PLACE = np.dtype([("at", "<u4"), ("anchor", "<u2"), ("more", "<u2")])
HOT = 1 << 15  # bit of `more` of a segment under a hot anchor
SPAN = np.dtype([("a", "<u4"), ("b", "<u4")])  # starts of the first window and of the one after the last
PACKED = "bucket int, owners binary, others binary, counts binary, hashes binary, contents binary, places binary, local boolean, hot boolean"
_PACKED = pa.schema(
    [("bucket", pa.int32())] + [(n, pa.binary()) for n in ("owners", "others", "counts", "hashes", "contents", "places")]
    + [("local", pa.bool_()), ("hot", pa.bool_())]
)
_tables: dict[str, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    step = np.full(n, base, dtype=np.uint64)
    step[0] = 1
    return np.cumprod(step, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _tables or len(_tables["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            _tables[name] = _powers_of(base, n)
        _tables["spread"] = mix(np.arange(1, 257, dtype=np.uint64))
    return _tables["up"], _tables["down"], _tables["spread"]


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, at, anchor distance, more windows, anchor hash, content hash) of all segments.

    A text larger than a piece is cut into pieces that overlap by a window less one byte.
    """
    out, pieces, held = [], [], 0
    for i, data in enumerate(texts):
        at = 0
        while len(data) - at >= LENGTH:
            end = min(len(data), at + PIECE)
            if held + end - at > PIECE and pieces:
                out.append(_segments(pieces))
                pieces, held = [], 0
            pieces.append((i, at, data[at:end]))
            held += end - at
            if end == len(data):
                break
            at = end - LENGTH + 1
    if pieces:
        out.append(_segments(pieces))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _segments(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in pieces), dtype=np.uint8)
    n = len(data)
    up, down, spread = _power_tables(2 * PIECE + 1 if n <= 2 * PIECE else n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(spread[data] * up[:n], out=total[1:])
    anchors = mix((total[ANCHOR:] - total[:-ANCHOR]) * down[: n + 1 - ANCHOR])
    key = (anchors & ~np.uint64(0xFFFFFF)) | np.arange(len(anchors), dtype=np.uint64)
    width, least = 1, key
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    where = (least & np.uint64(0xFFFFFF)).astype(np.int64)  # anchor of the window from each byte on
    size = np.fromiter((len(p) for _, _, p in pieces), dtype=np.int64, count=len(pieces))
    begin = np.cumsum(size) - size
    windows = size - LENGTH + 1
    piece = np.repeat(np.arange(len(pieces)), windows)
    start = begin[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    where = where[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (where[1:] != where[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    more = np.diff(np.append(first, len(start))) - 1
    a, m, owner = start[first], where[first], piece[first]
    content = mix((total[a + more + LENGTH] - total[a]) * down[a] + mix((m - a).astype(np.uint64) * np.uint64(1 << 20) + more.astype(np.uint64)))
    text = np.array([i for i, _, _ in pieces])[owner]
    base = np.array([at for _, at, _ in pieces])[owner]
    return text, base + a - begin[owner], m - a, more, mix(anchors[m] + np.uint64(1)), content


def _places(at: np.ndarray, anchor: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), dtype=PLACE)
    out["at"], out["anchor"], out["more"] = at, anchor, more
    return out


def _deal(buckets: int):  # noqa: ANN202 - a function over batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """k1, k2, text -> segments packed by bucket; the lowest bit of a content set where it
        is met again in its group of texts, of which then one entry is dealt."""
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, texts in byte_groups(batch.column(2).to_pylist(), 4 * PIECE):
                # Copies are told by their keys; one of each group of texts speaks for them.
                _, one = np.unique(np.stack([k1[row : row + len(texts)], k2[row : row + len(texts)]]), axis=1, return_index=True)
                one = np.sort(one)
                own1, own2 = k1[row + one], k2[row + one]
                text, at, anchor, more, h, content = segments([texts[i] for i in one])
                if not len(text):
                    continue
                place = _places(at, anchor, more)
                content = content & ~np.uint64(1)
                order = np.lexsort((content, h))
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (content[order][1:] != content[order][:-1])
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(h)))
                again = np.zeros(len(h), dtype=bool)
                again[order] = np.repeat(size > 1, size)
                lead = np.zeros(len(h), dtype=bool)
                lead[order[first]] = True
                content = content | again.astype(np.uint64)
                out = []
                keep = np.flatnonzero(lead)
                for b, part in cut(bucket_of(h[keep], buckets)):
                    i = keep[part]
                    owners, counts = runs(text[i])
                    out.append({"bucket": b, "owners": own1[owners].tobytes(), "others": own2[owners].tobytes(), "counts": counts.tobytes(),
                                "hashes": h[i].tobytes(), "contents": content[i].tobytes(), "places": place[i].tobytes(), "local": False, "hot": False})
                rest = np.flatnonzero(again & ~lead)
                owners, counts = runs(text[rest])
                ends = np.cumsum(counts)
                for o, e, c in zip(owners, ends, counts, strict=True):
                    i = rest[e - c : e]
                    out.append({"bucket": int(own1[o]) % buckets, "owners": own1[o : o + 1].tobytes(), "others": own2[o : o + 1].tobytes(),
                                "places": place[i].tobytes(), "local": True, "hot": False})
                for a in range(0, len(out), 500):
                    yield pa.RecordBatch.from_pylist(out[a : a + 500], schema=_PACKED)

    return run


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed segments -> (anchor, bytes) of anchors with several contents in one group of texts.

    What is left out is one segment of each group of texts at most; `_count` has the whole.
    """
    for batch in batches:
        found = []
        for h, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            name, back, n = np.unique(np.frombuffer(h, np.int64), return_inverse=True, return_counts=True)
            windows = np.bincount(back, np.frombuffer(place, PLACE)["more"] + 1.0).astype(np.int64)
            several = n > 1
            found.append((name[several], (windows + n * (LENGTH - 1))[several]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["anchor", "bytes"])


def _deal_hot(hot: np.ndarray, buckets: int):  # noqa: ANN202 - a function over batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed segments -> the same, those of hot anchors by their content and marked."""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                h = np.frombuffer(row["hashes"] or b"", np.uint64)
                is_hot = np.isin(h, hot)
                if not is_hot.any():
                    out.append(row)
                    continue
                o1, o2 = np.frombuffer(row["owners"], np.int64), np.frombuffer(row["others"], np.int64)
                content, place = np.frombuffer(row["contents"], np.uint64), np.frombuffer(row["places"], PLACE)
                text = np.repeat(np.arange(len(o1)), np.frombuffer(row["counts"], np.int32))
                at = np.flatnonzero(is_hot)
                parts = [(b, at[part], True) for b, part in cut(bucket_of(mix(content[at] >> np.uint64(1)), buckets))]
                rest = np.flatnonzero(~is_hot)
                for b, i, mark in [*parts, (row["bucket"], rest, False)] if len(rest) else parts:
                    owners, counts = runs(text[i])
                    out.append({"bucket": b, "owners": o1[owners].tobytes(), "others": o2[owners].tobytes(), "counts": counts.tobytes(),
                                "hashes": h[i].tobytes(), "contents": content[i].tobytes(), "places": place[i].tobytes(), "local": False, "hot": mark})
            for a in range(0, len(out), 500):
                yield pa.RecordBatch.from_pylist(out[a : a + 500], schema=_PACKED)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed segments of a bucket -> (k1, k2, repeated, compare) places and the windows under hot anchors.

    An anchor whose different contents come to more than `CHUNK` bytes is hot from here on.
    """
    rows = whole(batches)
    if rows is None:
        return
    names = ["k1", "k2", "repeated", "compare", "hot_windows"]
    local = rows.filter(rows.column("local"))
    if local.num_rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(column(local, "owners", np.int64)), pa.array(column(local, "others", np.int64)), local.column("places").combine_chunks(),
             pa.nulls(local.num_rows, pa.binary()), pa.array(np.zeros(local.num_rows, np.int64))], names=names,
        )
    rows = rows.filter(pc.invert(rows.column("local")))
    if not rows.num_rows:
        return
    counts, h = column(rows, "counts", np.int32), column(rows, "hashes", np.uint64)
    content, place = column(rows, "contents", np.uint64), column(rows, "places", PLACE)
    o1, o2 = (np.repeat(column(rows, n, np.int64), counts) for n in ("owners", "others"))
    entries = np.fromiter((len(x) // 8 for x in rows.column("hashes").to_pylist()), dtype=np.int64, count=rows.num_rows)
    hot = np.repeat(rows.column("hot").to_numpy().astype(bool), entries)
    order = np.lexsort((content, h))
    x, y = h[order], content[order] >> np.uint64(1)
    new_anchor = np.ones(len(x), dtype=bool)
    new_anchor[1:] = x[1:] != x[:-1]
    new_content = new_anchor.copy()
    new_content[1:] |= y[1:] != y[:-1]
    first = np.flatnonzero(new_content)
    size = np.diff(np.append(first, len(x)))
    again = (size > 1) | (np.bitwise_or.reduceat(content[order], first) & np.uint64(1) > 0)
    anchor = np.cumsum(new_anchor)[first] - 1
    several = (np.bincount(anchor)[anchor] > 1) | hot[order[first]]  # other contents of a hot anchor are elsewhere
    held = np.bincount(anchor, (place["more"][order[first]] + float(LENGTH)) * several)
    hot[order[first]] |= several & (held[anchor] > CHUNK)
    marked = place.copy()
    marked["more"][hot] |= HOT
    repeated, compare = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
    repeated[order] = np.repeat(again, size)
    compare[order[first[several]]] = True
    n_hot = np.where(hot & compare, place["more"].astype(np.int64) + 1, 0)
    hit = np.flatnonzero(repeated | compare)
    hit = hit[np.lexsort((o2[hit], o1[hit]))]
    edges = np.flatnonzero((o1[hit][1:] != o1[hit][:-1]) | (o2[hit][1:] != o2[hit][:-1])) + 1 if len(hit) else []
    groups = np.split(hit, edges) if len(hit) else []
    for a in range(0, len(groups), 10_000):
        now = groups[a : a + 10_000]
        head = [g[0] for g in now]
        yield pa.RecordBatch.from_arrays(
            [pa.array(o1[head]), pa.array(o2[head]), pa.array([place[g[repeated[g]]].tobytes() or None for g in now], pa.binary()),
             pa.array([marked[g[compare[g]]].tobytes() or None for g in now], pa.binary()),
             pa.array([int(n_hot[g].sum()) for g in now], pa.int64())], names=names,
        )


def repeated_windows(data: np.ndarray, offset: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which windows of aligned segments stand in another one too: (segments, REACH + 1).

    Segment i holds columns start[i] to end[i] (exclusive); its bytes begin at offset[i].
    Groups are contiguous numbers; segments come sorted by group. The state of a round is the order of
    the suffixes and, for each, the column at which its match with the suffix before ends;
    -1 stands before the first of a group.
    """
    found = np.zeros((len(start), REACH + 1), dtype=bool)
    entry = np.argsort(-end, kind="stable")
    entry_end = -end[entry]
    cur, match = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for col in range(int(end.max()) - 1, int(start.min()) - 1, -1):
        a, b = np.searchsorted(entry_end, [-(col + 1), -col])
        if b > a:  # segments that end here: their suffix was empty, so they come first
            fresh = entry[a:b]
            cur = np.concatenate([fresh, cur])
            match = np.concatenate([np.full(len(fresh), col + 1), match])
            order = np.argsort(group[cur], kind="stable")
            cur, match = cur[order], match[order]
            head = np.ones(len(cur), dtype=bool)
            head[1:] = group[cur][1:] != group[cur][:-1]
            match[(match == -1) & ~head] = col + 1
            match[head] = -1
        symbol = data[offset[cur] + (col - start[cur])]
        key = group[cur] * 256 + symbol
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = np.zeros(len(cur), dtype=bool)
        same[1:] = key[1:] == key[:-1]
        inside = np.zeros(len(cur), dtype=bool)
        inside[1:] = key[1:] >> 8 == key[:-1] >> 8
        fresh_match = np.where(inside, col, -1)
        at = np.flatnonzero(same)
        low, high = order[at - 1] + 1, order[at]
        value = match[high]
        far = np.flatnonzero(low < high)
        if len(far):  # the least match between the two in the old order
            ends = np.stack([low[far], high[far] + 1], 1).ravel()
            value[far] = np.minimum.reduceat(np.append(match, np.iinfo(np.int64).max), ends)[::2]
        fresh_match[at] = value
        cur, match = cur[order], fresh_match
        long = match - col >= LENGTH
        long[:-1] |= long[1:] & inside[1:]
        hit = cur[long]
        hit = hit[col - start[hit] < windows[hit]]
        found[hit, col - start[hit]] = True
        stay = start[cur] < col
        if not stay.all():
            kept = np.flatnonzero(stay)
            if len(kept):
                low = np.concatenate([[0], kept[:-1] + 1])
                ends = np.stack([low, kept + 1], 1).ravel()
                match = np.minimum.reduceat(np.append(match, np.iinfo(np.int64).max), ends)[::2]
            else:
                match = match[:0]
            cur = cur[kept]
    return found


def _sort_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, k1, k2, at, distance, segment, sorted by anchor -> (k1, k2, runs of repeated windows)."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        raw = rows.column("segment").to_pylist()
        size = np.fromiter((len(x) for x in raw), dtype=np.int64, count=len(raw))
        anchors = rows.column("anchor").to_numpy()
        group = np.cumsum(np.concatenate([[0], anchors[1:] != anchors[:-1]]))
        start = REACH - rows.column("distance").to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        windows = size - LENGTH + 1
        found = repeated_windows(data, np.cumsum(size) - size, start, start + size, group, windows)
        hit = np.flatnonzero(found.any(1))
        at = rows.column("at").to_numpy()
        spans = []
        for i in hit:
            turn = np.flatnonzero(np.diff(np.concatenate([[0], found[i].astype(np.int8), [0]])))
            spans.append((at[i] + turn).astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays(
            [rows.column(n).combine_chunks().take(pa.array(hit)) for n in ("k1", "k2")] + [pa.array(spans, pa.binary())], names=["k1", "k2", "spans"]
        )

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        anchors = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1).tolist(), len(anchors)]
        bytes_ = np.fromiter((len(x) for x in batch.column(5).to_pylist()), dtype=np.int64, count=len(anchors))
        total = np.concatenate([[0], np.cumsum(bytes_)])
        done = 0
        for a, b in zip(edges, edges[1:], strict=False):
            last = held[-1].column(0)[-1].as_py() if held else None
            if a == done and held and size >= CHUNK and last != int(anchors[a]):
                yield solve(pa.Table.from_batches(held))
                held, size = [], 0
            if size + total[b] - total[done] >= CHUNK and b < len(anchors):
                held.append(batch.slice(done, b - done))
                yield solve(pa.Table.from_batches(held))
                held, size, done = [], 0, b
        held.append(batch.slice(done))
        size += int(total[-1] - total[done])
    if held:
        yield solve(pa.Table.from_batches(held))


STATE = (
    "doc_id bigint, k1 bigint, k2 bigint, n_bytes bigint, state int, lead boolean, kept_sha256 string, text string, repeated binary, compare binary"
)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the places found for them -> 0 nothing repeats, 1 all goes, 2 to be cut."""
    for batch in batches:
        copies, lead = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        text, got = batch.column(3).to_pylist(), [batch.column(i).to_pylist() for i in (6, 7)]
        n, state, sha, kept_text, out = [], [], [], [], ([], [])
        for i, t in enumerate(text):
            data = t.encode("utf-8", "surrogatepass")
            repeated, compare = (b"".join(x or b"" for x in g[i] or []) for g in got)
            if copies[i] > 1 and len(data) >= LENGTH:
                s, compare = 1, compare if lead[i] else b""
            else:
                s = 2 if repeated or compare else 0
            n.append(len(data))
            state.append(s)
            sha.append(hashlib.sha256(data if s == 0 else b"").hexdigest())
            kept_text.append(t if s == 2 or compare else None)
            out[0].append(repeated or None if s == 2 else None)
            out[1].append(compare or None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(state, pa.int32()), batch.column(5), pa.array(sha),
             pa.array(kept_text, pa.string()), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())],
            names=["doc_id", "k1", "k2", "n_bytes", "state", "lead", "kept_sha256", "text", "repeated", "compare"],
        )


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k1, k2, text, compare -> one row for each segment to compare."""
    names = ["anchor", "k1", "k2", "at", "distance", "segment"]
    for batch in batches:
        out, held = [[] for _ in names], 0
        for k1, k2, text, compare in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for at, distance, more in np.unique(np.frombuffer(compare, PLACE)).tolist():
                if more & HOT:
                    continue
                anchor = data[at + distance : at + distance + ANCHOR]
                name = int.from_bytes(hashlib.blake2b(anchor, digest_size=8).digest(), "little", signed=True)
                for column_, value in zip(out, (name, k1, k2, at, distance, data[at : at + more + LENGTH]), strict=True):
                    column_.append(value)
                held += more + LENGTH
            if held > 4 * PIECE:
                yield _slices(out, names)
                out, held = [[] for _ in names], 0
        yield _slices(out, names)


def _slices(out: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)


def window_hashes(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window that starts at one of the given places."""
    up, down, spread = _power_tables(len(data) + 1)
    if len(_tables.get("other_up", ())) <= len(data):
        _tables["other_up"], _tables["other_down"] = _powers_of(_OTHER_BASE, len(data) + 1), _powers_of(_OTHER_INVERSE, len(data) + 1)
    symbol = np.frombuffer(data, np.uint8)
    total = np.zeros(len(symbol) + 1, dtype=np.uint64)
    out = []
    for value, up_, down_ in ((spread, up, down), (mix(spread + np.uint64(1)), _tables["other_up"], _tables["other_down"])):
        np.cumsum(value[symbol] * up_[: len(symbol)], out=total[1:])
        out.append(mix((total[at + LENGTH] - total[at]) * down_[at]))
    return out[0], out[1]


def _hot_windows(buckets: int):  # noqa: ANN202 - a function over batches
    def deal(held: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        k1, k2, at = (np.array([x[i] for x in held], dtype=np.int64) for i in range(3))
        size = np.fromiter((len(x[3]) for x in held), dtype=np.int64, count=len(held))
        windows = size - LENGTH + 1
        of = np.repeat(np.arange(len(held)), windows)
        step = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        h, other = window_hashes(b"".join(x[3] for x in held), (np.cumsum(size) - size)[of] + step)
        other = other & ~np.uint64(1)
        order = np.lexsort((other, h))
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(h)))
        again, lead = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
        again[order] = np.repeat(n > 1, n)
        lead[order[first]] = True
        other = other | again.astype(np.uint64)
        start = (at[of] + step).astype(np.uint32)
        # A lead that is met again is settled too; the entry dealt on tells the others.
        i = np.flatnonzero(again)
        edge = np.ones(len(i), dtype=bool)
        edge[1:] = (of[i][1:] != of[i][:-1]) | (step[i][1:] != step[i][:-1] + 1)
        a = np.flatnonzero(edge)
        span = np.empty(len(a), dtype=SPAN)
        span["a"], span["b"] = start[i[a]], start[i[np.append(a[1:], len(i)) - 1]] + 1 if len(a) else 0
        out = []
        rows = [(b, of[i[a[part]]], None, span[part]) for b, part in cut(np.mod(k1[of[i[a]]], buckets))]
        keep = np.flatnonzero(lead)
        rows += [(b, of[keep[part]], keep[part], start[keep[part]]) for b, part in cut(bucket_of(h[keep], buckets))]
        for b, owner, j, places in rows:
            owners, counts = runs(owner)
            out.append({"bucket": b, "owners": k1[owners].tobytes(), "others": k2[owners].tobytes(), "counts": counts.tobytes(),
                        "hashes": None if j is None else h[j].tobytes(), "contents": None if j is None else other[j].tobytes(),
                        "places": places.tobytes(), "local": j is None, "hot": True})
        for a in range(0, len(out), 500):
            yield pa.RecordBatch.from_pylist(out[a : a + 500], schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """k1, k2, text, compare -> windows of hot segments packed by bucket; those met twice in a piece as spans of texts."""
        held, size = [], 0
        for batch in batches:
            for k1, k2, text, compare in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                place = np.unique(np.frombuffer(compare, PLACE))
                place = place[place["more"] & HOT > 0]
                data = text.encode("utf-8", "surrogatepass") if len(place) else b""
                for at, _, more in place.tolist():
                    held.append((k1, k2, at, data[at : at + more - HOT + LENGTH]))
                    size += more - HOT + LENGTH
                    if size >= PIECE:
                        yield from deal(held)
                        held, size = [], 0
        if held:
            yield from deal(held)

    return run


def _count_windows(buckets: int):  # noqa: ANN202 - a function over batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed windows of a bucket -> spans of repeated windows, packed by the bucket of their texts."""
        held = []
        for batch in batches:
            local = batch.filter(batch.column(7))
            if local.num_rows:  # settled before
                yield pa.RecordBatch.from_arrays([local.column(i) for i in (0, 1, 2, 3, 6)], names=["bucket", "owners", "others", "counts", "answers"])
            held.append(batch.filter(pc.invert(batch.column(7))))
        rows = whole(held)
        if rows is None:
            return
        counts, h, other = column(rows, "counts", np.int32), column(rows, "hashes", np.uint64), column(rows, "contents", np.uint64)
        start = column(rows, "places", np.uint32)
        o1, o2 = (np.repeat(column(rows, n, np.int64), counts) for n in ("owners", "others"))
        order = np.lexsort((other, h))
        x, y = h[order], other[order] >> np.uint64(1)
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(x)))
        repeated = np.repeat((n > 1) | (np.bitwise_or.reduceat(other[order], first) & np.uint64(1) > 0), n)
        i = order[repeated]
        i = i[np.lexsort((start[i], o2[i], o1[i]))]
        span = np.empty(len(i), dtype=SPAN)
        span["a"], span["b"] = start[i], start[i] + 1
        if len(i):
            yield replies(o1[i], o2[i], span, buckets)

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed spans of the texts of a bucket -> (k1, k2, runs of repeated windows)."""
    rows = whole(batches)
    if rows is None:
        return
    counts, span = column(rows, "counts", np.int32), column(rows, "answers", SPAN)
    o1, o2 = (np.repeat(column(rows, n, np.int64), counts) for n in ("owners", "others"))
    order = np.lexsort((span["a"], o2, o1))
    o1, o2, span = o1[order], o2[order], span[order]
    text = np.ones(len(span), dtype=bool)
    text[1:] = (o1[1:] != o1[:-1]) | (o2[1:] != o2[:-1])
    new = text.copy()
    new[1:] |= span["a"][1:] != span["b"][:-1]
    first = np.flatnonzero(new)
    merged = np.empty(len(first), dtype=SPAN)
    merged["a"], merged["b"] = span["a"][first], span["b"][np.append(first[1:], len(span)) - 1]
    edges = np.append(np.flatnonzero(text[first]), len(first))
    for a in range(0, len(edges) - 1, 10_000):
        now = edges[a : a + 10_001]
        head = first[now[:-1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(o1[head]), pa.array(o2[head]), pa.array([merged[i:j].tobytes() for i, j in zip(now, now[1:], strict=False)], pa.binary())],
            names=["k1", "k2", "spans"],
        )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, repeated, spans -> what is left of each text."""
    for batch in batches:
        n, removed, spans, sha = [], [], [], []
        for text, repeated, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            gone = np.zeros(len(data) + 1, dtype=np.int64)
            whole_ = np.frombuffer(repeated or b"", PLACE)
            np.add.at(gone, whole_["at"].astype(np.int64), 1)
            np.subtract.at(gone, whole_["at"].astype(np.int64) + whole_["more"] + LENGTH, 1)
            for x in found or []:
                edge = np.frombuffer(x, np.uint32).astype(np.int64)
                np.add.at(gone, edge[0::2], 1)
                np.subtract.at(gone, edge[1::2] - 1 + LENGTH, 1)
            cut_ = np.cumsum(gone[:-1]) > 0
            n.append(len(data))
            removed.append(int(cut_.sum()))
            spans.append(int((np.diff(np.concatenate([[0], cut_.astype(np.int8)])) == 1).sum()))
            sha.append(hashlib.sha256(data[~cut_].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The contract of op6: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    small_batches(docs.sparkSession)
    buckets = n_buckets(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(3), text).alias("k2"), text.alias("text")
    )
    dealt = table(keyed.select("k1", "k2", "text").mapInArrow(_deal(buckets), PACKED), "dealt")
    weights = dealt.filter("not local").select("hashes", "places").mapInArrow(_weigh, "anchor bigint, bytes bigint")
    # Anchors of over CHUNK bytes each: a few for each GB of the input.
    hot = weights.groupBy("anchor").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") > CHUNK).collect()
    if hot:
        dealt = dealt.mapInArrow(_deal_hot(np.array([r["anchor"] for r in hot], np.int64).view(np.uint64), buckets), PACKED)
    counted = table(by_bucket(dealt, buckets).mapInArrow(_count, "k1 bigint, k2 bigint, repeated binary, compare binary, hot_windows bigint"), "counted")
    hot_windows = counted.agg(F.sum("hot_windows")).first()[0] or 0
    places = counted.groupBy(F.col("k1").alias("p1"), F.col("k2").alias("p2")).agg(
        F.collect_set("repeated").alias("repeated"), F.collect_set("compare").alias("compare")
    )
    copies = keyed.groupBy(F.col("k1").alias("c1"), F.col("k2").alias("c2")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    copies = table(copies.filter("copies > 1"), "copies")
    often = copies.filter(F.col("copies") > OFTEN).select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.col("first").alias("one"))
    rare, spare = keyed, None
    if not often.isEmpty():
        told = keyed.join(small(often.withColumn("often", F.lit(True))), ["k1", "k2"], "left")
        is_spare = F.col("often").isNotNull() & ~F.col("one").eqNullSafe(F.col("doc_id"))
        rare, spare = told.filter(~is_spare).drop("one", "often"), told.filter(is_spare)
    known = (
        rare.join(places, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")), "left")
        .join(copies, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
        .select("doc_id", "k1", "k2", "text", F.coalesce("copies", F.lit(1)).alias("copies"),
                F.coalesce(F.col("first").eqNullSafe(F.col("doc_id")), F.lit(False)).alias("lead"), "repeated", "compare")
    )
    state = table(known.mapInArrow(_settle, STATE), "state")
    sliced = state.filter(F.col("compare").isNotNull()).select("k1", "k2", "text", "compare")
    rows = sliced.mapInArrow(_slice, "anchor bigint, k1 bigint, k2 bigint, at bigint, distance int, segment binary")
    rows = rows.repartition("anchor").sortWithinPartitions("anchor")
    found = rows.mapInArrow(_sort_columns, "k1 bigint, k2 bigint, spans binary")
    if hot_windows:
        many = max(buckets, -(-hot_windows // HOT_WINDOWS))
        windows = by_bucket(sliced.mapInArrow(_hot_windows(many), PACKED), many).mapInArrow(_count_windows(many), REPLY)
        found = found.unionByName(by_bucket(windows, many).mapInArrow(_spans, "k1 bigint, k2 bigint, spans binary"))
    found = found.groupBy("k1", "k2").agg(F.collect_list("spans").alias("spans"))
    parts = state.filter("state = 2").select("doc_id", "k1", "k2", "text", "repeated").join(found, ["k1", "k2"], "left")
    cut_texts = parts.select("doc_id", "text", "repeated", "spans").mapInArrow(
        _remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
    gone = F.col("state") == 1
    rest = state.filter("state < 2").select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"), "kept_sha256",
    )
    if spare is None:
        return rest.unionByName(cut_texts)
    size = F.octet_length("text").cast("long")
    goes = size >= LENGTH
    copied = spare.select(
        "doc_id", size.alias("n_bytes"), F.when(goes, size).otherwise(0).cast("long").alias("n_removed"), F.when(goes, 1).otherwise(0).cast("long").alias("n_spans"),
        F.sha2(F.when(goes, F.lit("")).otherwise(F.col("text")), 256).alias("kept_sha256"),
    )
    return rest.unionByName(cut_texts).unionByName(copied)
