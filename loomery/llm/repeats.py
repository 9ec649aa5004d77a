"""Exact substring de-duplication: bytes covered by a 50-byte string that also starts in a document of smaller id.

A suffix array of all suffixes would put several times the corpus into a global sort, so it is sampled: of the GRAM-byte
strings in each LENGTH-byte window, the one of smallest hash is the window's anchor (about one byte in 16 is), and only
suffixes that begin at anchors are sorted. Equal windows have equal anchors, so no repeat is missed:

1. Equal texts: only the first of them takes part, the others are covered whole.
2. Anchors meet by the range of their hash, with a fingerprint of their context, which is all that any window around
   them can hold. If an equal context stands in a smaller document, all windows around the anchor are covered. If no
   other document has the anchor (in a context not covered), its windows cannot repeat.
3. The contexts of the other anchors (80 bytes) meet by the same ranges. There the suffixes at the anchors are sorted by bytes with
   their longest common prefixes, an enhanced suffix array, and so are the texts before the anchors, read backwards. The
   intervals of common prefix >= k, for each k from GRAM to LENGTH, form the interval tree, level by level; an interval's
   occurrences whose LENGTH - k bytes to the left also agree share a LENGTH-byte string, all of them, not only neighbours. Where the
   smallest document of such a group is smaller than an occurrence's own, the string is covered there. Bytes decide, no hash does.
4. Hot anchors, of more than HOT documents of one batch or WIDE occurrences in all, would meet in one task. Their windows are dealt
   out by 96 bits of fingerprint instead, of equal ones in a batch only the smallest document's.

`repeat_groups` scans the same sampled suffix array with a stack: it gives maximal repeats (extending a group on either side would lose an
occurrence) with all their occurrences, up to REACH bytes on each side of an anchor. Matches never cross documents. Texts with
anchors to compare are joined with them, by id, and those that lose something with what they lose; what is returned of the
others needs no join with a text.

Defined results: null text has no bytes; texts under LENGTH bytes lose nothing; rows that repeat an id are not each
other's smaller document; a row without an id loses nothing and covers nothing; an empty table gives an empty table.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import bytescan
from loomery.llm.common import BROADCAST_ROWS, sized, staged, table

LENGTH, GRAM = 50, 20
BACK = LENGTH - GRAM
#: Documents of one batch with an anchor, in contexts of their own, beyond which it counts as shared everywhere.
HOT = 16
#: Occurrences of an anchor beyond which its windows, not its contexts, are exchanged.
WIDE = 1 << 15
#: Bytes on each side of an anchor that repeat_groups sees.
REACH = 1000
#: Entries of one fingerprint range on average.
RANGE = 1 << 17
#: Text bytes of one scan; it holds a dozen 8-byte values for each.
SLICE = 1 << 20
U64 = np.uint64
_PLACE = U64((1 << 30) - 1)
ROWS = "range int, tokens binary, contexts binary, docs binary, owners binary, places binary, marks binary, checks binary"
NAMES = [x.split()[0] for x in ROWS.split(", ")]


#: Values of a second fingerprint: 32 bits of it stand beside the 64 of the first, which at 10**14 windows would collide.
SECOND = bytescan.seeded(256, 23)


class Prints:
    """Fingerprints of any strings of the given bytes."""

    def __init__(self, data: np.ndarray, values: np.ndarray = bytescan.VALUES):
        self.total = np.zeros(len(data) + 1, U64)
        np.cumsum(values[data] * bytescan.powers(bytescan.BASE, len(data)), out=self.total[1:])
        self.back = bytescan.powers(bytescan.INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return bytescan.mix((self.total[end] - self.total[start]) * self.back[start])

    def rolling(self, size: int) -> np.ndarray:
        n = len(self.total) - size
        return bytescan.mix((self.total[size:] - self.total[:n]) * self.back[:n])


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place in the data, text, fingerprint and fingerprint of the context of every anchor."""
    none = np.zeros(0, np.int64)
    n = len(data) - LENGTH + 1
    if n < 1:
        return none, none, none.astype(U64), none.astype(U64)
    prints = Prints(data)
    gram = prints.rolling(GRAM)
    key = (gram & ~_PLACE) | np.arange(len(gram), dtype=U64)
    least, span = key, 1
    while span * 2 <= BACK + 1:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    rest = BACK + 1 - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    valid = np.zeros(n + LENGTH, bool)
    long = np.diff(at) >= LENGTH
    edge = np.zeros(n + LENGTH, np.int64)
    np.add.at(edge, at[:-1][long], 1)
    np.add.at(edge, at[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(edge)[:n] > 0
    flag = np.zeros(len(gram), bool)
    flag[(least[valid] & _PLACE).astype(np.int64)] = True
    place = np.flatnonzero(flag)
    text = np.searchsorted(at, place, side="right") - 1
    lo, hi = np.maximum(place - BACK, at[text]), np.minimum(place + LENGTH, at[text + 1])
    return place, text, gram[place], prints.of(lo, hi) + (place - lo).astype(U64)


def _starts(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether a new value of keys begins at each place of an order."""
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return new


def _smaller(order: np.ndarray, new: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """In an order that ends with ids: whether the group of each place holds a smaller id."""
    s = ids[order]
    first = np.flatnonzero(new)
    return s > np.repeat(s[first], np.diff(np.append(first, len(s))))


def _owned(owner: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> tuple[bytes, bytes]:
    """The documents that own entries, each once, and each entry's number among them."""
    some, number = np.unique(owner, return_inverse=True)
    return np.column_stack([ids[some], keys[some]]).astype("<i8").tobytes(), number.astype("<u2").tobytes()


def _sent(ranges: int, token: np.ndarray, context: np.ndarray | None, owner: np.ndarray, ids: np.ndarray, keys: np.ndarray, places: np.ndarray, mark: np.ndarray | None, check: np.ndarray | None, settled: dict[int, tuple[np.ndarray, np.ndarray]], first: int = 0, routed: bool = True) -> pa.RecordBatch:
    """Rows of the exchange, by range of token (in order) from number `first` on, with the token unless it only routes; and
    those that carry what is settled here: kind -> owner, places."""
    cut = np.append(np.searchsorted(token, (np.arange(ranges, dtype=object) * (1 << 64) // ranges).astype(U64)), len(token))
    part = lambda x, i, j: x[i:j].tobytes() if x is not None else None
    rows = [(first + k, part(token, i, j) if routed else None, part(context, i, j), *_owned(owner[i:j], ids, keys), part(places, i, j), part(mark, i, j), part(check, i, j)) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
    spread = int(ids[0]) % ranges
    rows += [(-1 - spread - k * ranges, None, None, *_owned(o, ids, keys), p.tobytes(), None, None) for k, (o, p) in settled.items() if len(o)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.binary()) for i in range(len(NAMES))], NAMES)


#: What a mark says of an anchor's windows: covered, to be compared by contexts, or by windows. What one batch settled
#: goes past the ranges, in as many rows-by-number again for each kind.
_COVERED, _COMPARE, _WIDE = 0, 1, 2


def _gathered(rows: pa.Table) -> dict[str, np.ndarray]:
    """All entries of a range as arrays."""
    out: dict[str, list] = {n: [] for n in ("tokens", "contexts", "ids", "keys", "places", "marks", "checks")}
    for row in zip(*(rows[n] for n in NAMES[1:]), strict=True):
        token, context, docs, owners, places, mark, check = (x.as_py() for x in row)
        who = np.frombuffer(docs, "<i8").reshape(-1, 2)[np.frombuffer(owners, "<u2")]
        out["ids"].append(who[:, 0])
        out["keys"].append(who[:, 1])
        for name, data, kind in (("tokens", token, U64), ("contexts", context, U64), ("places", places, np.int32), ("marks", mark, np.uint8), ("checks", check, np.uint32)):
            if data is not None:
                out[name].append(np.frombuffer(data, kind))
    return {n: np.concatenate(x) if x else np.zeros(0, U64) for n, x in out.items()}


def _marks(ids: np.ndarray, keys: np.ndarray, places: np.ndarray, kind: np.ndarray | int) -> pa.Table:
    kind = np.broadcast_to(np.asarray(kind, np.int32), len(ids))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "place": pa.array(places, pa.int32()), "kind": pa.array(kind, pa.int32())})


MARKS = "doc_id long, key long, place int, kind int"


def _anchor_rows(ranges: int):
    """(doc_id, key, text) -> the anchors' exchange, with what one batch can settle settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for rows, data, at in bytescan.slices(batches, most=SLICE):
                place, text, token, context = anchors(data, at)
                if not len(place):
                    continue
                own_ids, own_keys = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                ids, places = own_ids[text], (place - at[text]).astype(np.int32)
                order = np.lexsort((ids, context, token))
                covered = _smaller(order, _starts(order, token, context), ids)
                over, order = order[covered], order[~covered]
                # an anchor with contexts in many documents here: its windows go on, and one mark tells the others
                new = _starts(order, token)
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(order)))
                pairs = order[np.lexsort((ids[order], token[order]))]
                owners = np.add.reduceat(_starts(pairs, token, ids).astype(np.int64), first) if len(first) else size
                hot = np.repeat(owners > HOT, size)
                keep, wide = order[~hot | new], order[hot]
                settled = {_COVERED: (text[over], places[over]), _WIDE: (text[wide], places[wide])}
                yield _sent(ranges, token[keep], context[keep], text[keep], own_ids, own_keys, places[keep], (hot & new)[~hot | new].astype(np.uint8), None, settled)

    return run


def _anchor_marks(ranges: int, key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A range of anchors -> marks: covered ones, and those whose windows must be compared."""
    x = _gathered(rows)
    if key[0].as_py() < 0:
        return _marks(x["ids"], x["keys"], x["places"], (-1 - key[0].as_py()) // ranges)
    order = np.lexsort((x["ids"], x["contexts"], x["tokens"]))
    covered = _smaller(order, _starts(order, x["tokens"], x["contexts"]), x["ids"]) & (x["marks"][order] == 0)
    over, left = order[covered], order[~covered]
    if not len(left):
        return _marks(x["ids"][over], x["keys"][over], x["places"][over], _COVERED)
    left = left[np.lexsort((x["ids"][left], x["tokens"][left]))]
    new = _starts(left, x["tokens"])
    group = np.cumsum(new) - 1
    owners, hot, size = np.bincount(group, _starts(left, x["tokens"], x["ids"])), np.bincount(group, x["marks"][left]), np.bincount(group)
    wide = (hot > 0) | (size > WIDE)
    open_ = ((owners > 1) | (hot > 0))[group] & (x["marks"][left] == 0)
    both = np.concatenate([over, left[open_]])
    kind = np.concatenate([np.full(len(over), _COVERED), np.where(wide[group[open_]], _WIDE, _COMPARE)])
    return _marks(x["ids"][both], x["keys"][both], x["places"][both], kind)


def _ranges(places: np.ndarray, owner: np.ndarray, lo: int, hi: int, at: np.ndarray, size: int) -> np.ndarray:
    """Over all bytes: whether place + lo .. place + hi of any place holds it, within the owner's text less `size` - 1 bytes at its end."""
    edge = np.zeros(int(at[-1]) + 2, np.int64)
    begin = at[owner]
    a, b = np.maximum(places + lo, 0), np.minimum(places + hi, at[owner + 1] - begin - size + 1)
    some = a < b
    np.add.at(edge, begin[some] + a[some], 1)
    np.add.at(edge, begin[some] + b[some], -1)
    return np.cumsum(edge)[: int(at[-1])] > 0


def _list(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(n), sizes)


def _contexts(data: np.ndarray, at: np.ndarray, place: np.ndarray, owner: np.ndarray, back: int, ahead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes around each place of the data, from `back` before to `ahead` after, 0 beyond the text, and how many on each side are real."""
    before, after = np.minimum(place - at[owner], back), np.minimum(at[owner + 1] - place, ahead)
    span = np.arange(-back, ahead)
    real = (span >= -before[:, None]) & (span < after[:, None])
    return np.where(real, data[np.where(real, place[:, None] + span, 0)], np.uint8(0)), before, after


def _open_rows(ranges: int):
    """(doc_id, key, text, covered, compare, wide) -> the exchange of contexts (ranges from 0) and of windows (the next as many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for rows, data, at in bytescan.slices(batches, most=SLICE):
                n = rows.num_rows
                own_ids, own_keys = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                (sure, sure_of), (cold, cold_of), (wide, wide_of) = (_list(rows.column(k), n) for k in (3, 4, 5))
                left_open = ~_ranges(sure, sure_of, -BACK, 1, at, LENGTH)
                prints = Prints(data)
                place = np.flatnonzero(_ranges(wide, wide_of, -BACK, 1, at, LENGTH) & left_open)
                if len(place):
                    text = np.searchsorted(at, place, side="right") - 1
                    token, check = prints.of(place, place + LENGTH), Prints(data, SECOND).of(place, place + LENGTH).astype(np.uint32)
                    ids, places = own_ids[text], (place - at[text]).astype(np.int32)
                    order = np.lexsort((ids, check, token))
                    covered = _smaller(order, _starts(order, token, check), ids)
                    over, keep = order[covered], order[~covered]
                    yield _sent(ranges, token[keep], None, text[keep], own_ids, own_keys, places[keep], None, check[keep], {_COVERED: (text[over], places[over])}, first=ranges)
                # anchors with a window that is not covered yet
                still = np.concatenate([[0], np.cumsum(_ranges(cold, cold_of, -BACK, 1, at, LENGTH) & left_open)])
                place = at[cold_of] + cold
                some = still[place + 1] > still[np.maximum(place - BACK, at[cold_of])]
                place, owner, cold = place[some], cold_of[some], cold[some]
                if len(place):
                    token = prints.of(place, place + GRAM)
                    order = np.argsort(token, kind="stable")
                    context, before, after = _contexts(data, at, place[order], owner[order], BACK, LENGTH)
                    yield _sent(ranges, token[order], context, owner[order], own_ids, own_keys, cold[order].astype(np.int32), np.column_stack([before, after]).astype(np.uint8), None, {}, routed=False)

    return run


def _array(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings (rows of bytes, 0 beyond their size) and the common prefix of each with the one before it.

    A string that ends sorts before all that go on from it, so that an interval's common prefix is the least between its strings.
    """
    n, width = text.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = text
    words = wide.view(">u8").astype(U64)
    order = np.lexsort((size, *words.T[::-1]))
    text, size = text[order], size[order]
    common = np.zeros(n, np.int64)
    if n > 1:
        other = text[1:] != text[:-1]
        common[1:] = np.minimum(np.where(other.any(1), other.argmax(1), width), np.minimum(size[1:], size[:-1]))
    return order, common


def covered_windows(context: np.ndarray, before: np.ndarray, after: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of anchors -> occurrences, and bytes before the anchor, at which a LENGTH-byte string begins that a smaller document holds.

    Of windows side by side only the outer two are given; they cover what all do.
    """
    n = len(ids)
    right, left = _array(context[:, BACK:], after), _array(context[:, :BACK][:, ::-1], before)
    hit = np.zeros((n, BACK + 3), bool)
    group = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for level in range(GRAM, LENGTH + 1):
        back = LENGTH - level
        for g, (order, common), least in zip(group, (right, left), (level, back), strict=True):
            g[order] = np.cumsum(common < least)
        some = np.flatnonzero((after >= level) & (before >= back) & (np.bincount(group[0])[group[0]] > 1))
        if len(some):
            both = group[0][some] * (n + 1) + group[1][some]
            order = np.lexsort((ids[some], both))
            hit[some[order[_smaller(order, _starts(order, both), ids[some])]], back + 1] = True
    inner = hit[:, 1:-1] & hit[:, :-2] & hit[:, 2:]
    which, back = np.nonzero(hit[:, 1:-1] & ~inner)
    return which, back


def _open_marks(ranges: int, key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A range of contexts or of windows -> windows that a smaller document holds."""
    x, k = _gathered(rows), key[0].as_py()
    if k < 0:
        return _marks(x["ids"], x["keys"], x["places"], _COVERED)
    if k < ranges:
        context, size = x["contexts"].view(np.uint8).reshape(-1, BACK + LENGTH), x["marks"].reshape(-1, 2).astype(np.int64)
        over, back = covered_windows(context, size[:, 0], size[:, 1], x["ids"])
        return _marks(x["ids"][over], x["keys"][over], x["places"][over] - back.astype(np.int32), _COVERED)
    order = np.lexsort((x["ids"], x["checks"], x["tokens"]))
    over = order[_smaller(order, _starts(order, x["tokens"], x["checks"]), x["ids"])]
    return _marks(x["ids"][over], x["keys"][over], x["places"][over], _COVERED)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, text, covered, windows) -> what is left of each text."""
    for rows, data, at in bytescan.slices(batches, most=SLICE):
        n = rows.num_rows
        a, a_of = _list(rows.column(3), n)
        w, w_of = _list(rows.column(4), n)
        gone = _ranges(a, a_of, -BACK, LENGTH, at, 1) | _ranges(w, w_of, 0, LENGTH, at, 1)
        owner = np.repeat(np.arange(n), np.diff(at))
        begins = bytescan.runs(~gone, at)[2]
        kept = [hashlib.sha256(data[i:j][~gone[i:j]].tobytes()).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]
        out = [rows.column(0), rows.column(1), pa.array(np.bincount(owner[gone], minlength=n)), pa.array(np.bincount(begins, minlength=n)), pa.array(kept)]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _lists(marks: DataFrame, **kinds) -> DataFrame:
    """Marks by document; a document's lists are bounded by its length."""
    return marks.groupBy("doc_id", "key").agg(*(F.collect_list(F.when(c, F.col("place"))).alias(n) for n, c in kinds.items()))


KEY = ["doc_id", "key"]


def _of(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """docs joined with what marked holds for them. Where the marked keys may be broadcast, other texts are dropped before they are shuffled."""
    if marked.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(marked.select(*KEY)), KEY, "left_semi")
    return docs.join(marked, KEY)


def marks(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, text) -> facts of every row (doc_id, key, n, sha), copies (doc_id, key) of smaller documents, and the others'
    marks by (doc_id, key): places of covered anchors and of covered windows."""
    info = docs.select("doc_id", "key", F.xxhash64("text", F.lit(1)).alias("key2"), F.octet_length("text").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    info = staged(info, "repeat-texts")
    slim = info.where((F.col("n") >= LENGTH) & F.col("doc_id").isNotNull())
    first = slim.groupBy("key", "key2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("_most"))
    copies = staged(slim.join(first.where("rep < _most").drop("_most"), ["key", "key2", "n"]).where("doc_id > rep").select(*KEY).distinct(), "repeat-copies")
    total = slim.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-total // (RANGE * 16)))
    long = docs.where((F.octet_length("text") >= LENGTH) & F.col("doc_id").isNotNull()).join(sized(copies), KEY, "left_anti").select(*KEY, "text")

    def settle(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _anchor_marks(ranges, key, rows)

    found = long.mapInArrow(_anchor_rows(ranges), ROWS).groupBy("range").applyInArrow(settle, MARKS)
    kind = F.col("kind")
    by_doc = staged(_lists(found, covered=kind == _COVERED, compare=kind == _COMPARE, wide=kind == _WIDE), "repeat-anchors")
    open_ = _of(long, by_doc.where("size(compare) + size(wide) > 0")).select(*KEY, "text", "covered", "compare", "wide")

    def compared(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _open_marks(ranges, key, rows)

    windows = open_.mapInArrow(_open_rows(ranges), ROWS).groupBy("range").applyInArrow(compared, MARKS)
    windows = staged(_lists(windows, windows=F.lit(True)), "repeat-windows")
    both = by_doc.where("size(covered) > 0").select(*KEY, "covered").join(windows, KEY, "full")
    return info, copies, staged(both, "repeat-marks")


def strip(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of docs. Only texts that lose something are joined with their marks."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    info, copies, marked = marks(docs)
    cut = _of(docs, marked).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text", "covered", "windows")
    cut = cut.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    gone, n = F.col("_gone").isNotNull(), F.col("n").cast("long")
    rest = info.join(sized(marked.select(*KEY)), KEY, "left_anti").join(sized(copies).withColumn("_gone", F.lit(True)), KEY, "left")
    rest = rest.select("doc_id", n.alias("n_bytes"), F.when(gone, n).otherwise(0).alias("n_removed"), F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"), F.when(gone, hashlib.sha256().hexdigest()).otherwise(F.col("sha")).alias("kept_sha256"))
    return cut.unionByName(rest)


def intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan of common prefixes -> every interval (first, last, common prefix) of two or more with at least `least` in common."""
    stack: list[tuple[int, int]] = []  # (common prefix, first)
    for i, h in enumerate([*common[1:].tolist(), 0], 1):
        first = i - 1
        while stack and stack[-1][0] > h:
            height, first = stack.pop()
            yield first, i - 1, height
        if h >= least and (not stack or stack[-1][0] < h):
            stack.append((h, first))


def maximal_groups(context: np.ndarray, before: np.ndarray, after: np.ndarray, back: int, length: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Contexts of one anchor -> (occurrences, bytes before the anchor, bytes from it on) of its maximal repeats of at least `length` bytes."""
    order, common = _array(context[:, back:], after)
    for first, last, ahead in intervals(common, GRAM):
        inside = order[first : last + 1]
        left, shared = _array(context[inside, :back][:, ::-1], before[inside])
        found = [(0, len(inside) - 1, int(shared[1:].min()))] if ahead >= length and shared[1:].min() == 0 else []
        for a, z, size in [*found, *intervals(shared, max(1, length - ahead))]:
            group = inside[left[a : z + 1]]
            place = np.sort(np.flatnonzero(np.isin(order, group)))
            # left-diverse by its interval; right-diverse unless a deeper interval holds all of it
            if min(int(common[p + 1 : q + 1].min()) for p, q in zip(place[:-1], place[1:], strict=True)) == ahead:
                yield group, size, ahead


def repeat_groups(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Maximal repeats of LENGTH bytes or more with all their occurrences: repeat (a digest of its bytes), length, doc_id, place.

    Extending a group by a byte on either side would lose an occurrence, or passes `reach` bytes around the anchor. Every anchor of docs takes
    part with its whole context, so this form is for bounded sets of documents; `strip` is the one for a corpus.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for rows, data, at in bytescan.slices(batches, most=SLICE // 16):
                place, text, token, _ = anchors(data, at)
                context, before, after = _contexts(data, at, place, text, reach, reach)
                out = [pa.array(token.view(np.int64)), rows.column(0).take(pa.array(text)), pa.array(place - at[text]), pa.array([c.tobytes() for c in context], pa.binary()), pa.array(before), pa.array(after)]
                yield pa.RecordBatch.from_arrays(out, ["token", "doc_id", "place", "context", "before", "after"])

    def grouped(rows: pa.Table) -> pa.Table:
        context = np.frombuffer(b"".join(rows["context"].to_pylist()), np.uint8).reshape(-1, 2 * reach)
        before, after, place = (rows[c].to_numpy() for c in ("before", "after", "place"))
        repeat, length, which, where = [], [], [], []
        for group, left, ahead in maximal_groups(context, before, after, reach, LENGTH):
            text = context[group[0], reach - left : reach + ahead].tobytes()
            repeat += [hashlib.sha256(text).hexdigest()] * len(group)
            length += [left + ahead] * len(group)
            which.append(group)
            where.append(place[group] - left)
        which, where = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, where))
        return pa.table({"repeat": pa.array(repeat, pa.string()), "length": pa.array(length, pa.int64()), "doc_id": rows["doc_id"].combine_chunks().take(pa.array(which)), "place": pa.array(where, pa.int64())})

    every = docs.select("doc_id", "text").mapInArrow(around, f"token long, doc_id {kind}, place long, context binary, before long, after long")
    some = every.groupBy("token").agg(F.count("*").alias("_n")).where("_n > 1").select("token")
    return every.join(some, "token", "left_semi").groupBy("token").applyInArrow(grouped, f"repeat string, length long, doc_id {kind}, place long").distinct()


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip(table(spark, sf_dir, "documents"))


#: Every window of a text as hexadecimal digits, cut in pieces of 2,000 first.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT r, doc_id, hex(b) AS x, octet_length(b) AS n FROM d),
c AS (SELECT r, doc_id, unnest(range(0, greatest(n - 49, 0), 2000)) AS base, x, n FROM h),
k AS (SELECT r, doc_id, base, substr(x, 2*base + 1, 4098) AS x, least(n - 49, base + 2000) - base AS m FROM c),
w AS (SELECT r, doc_id, base, unnest(range(0, m)) AS o, x FROM k),
s AS (SELECT r, doc_id, base + o AS p, substr(x, 2*o + 1, 100) AS s FROM w),
f AS (SELECT s, min(doc_id) AS low FROM s WHERE doc_id IS NOT NULL GROUP BY s),
g AS (SELECT s.r, s.p FROM s JOIN f USING (s) WHERE f.low < s.doc_id),
i AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM g),
j AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS span FROM i),
v AS (SELECT r, span, min(p) AS a, max(p) + 50 AS z FROM j GROUP BY r, span),
u AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last FROM v GROUP BY r),
t AS (SELECT r, span, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS z FROM v),
e AS (SELECT t.r, string_agg(substr(h.x, 2*t.a + 1, 2*(t.z - t.a)), '' ORDER BY t.a) AS x FROM t JOIN h USING (r) GROUP BY t.r)
SELECT h.doc_id, h.n AS n_bytes, coalesce(u.n_removed, 0)::BIGINT AS n_removed, coalesce(u.n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN u.r IS NULL THEN h.x ELSE e.x || substr(h.x, 2*u.last + 1) END)) AS kept_sha256 FROM h LEFT JOIN u USING (r) LEFT JOIN e USING (r)
"""
