"""Line dedup by winnowing over line hashes.

Lines longer than a few words are cut after the words with the least hash of those around them, so that copies
inside long lines are cut alike; a line or such a part is a unit. A window is the shortest run of units from
some unit on that holds enough words. Of each window the least hash of two units in a row is selected;
positions selected by several windows count once. Equal runs hold equal windows and select equal minima. The
first position with a hash is its holder, and the others are joined with it: a match is the run around both
in which their units agree, extended in both directions. Units of matches that hold enough words are deleted;
what the holder has stays.

A holder may share no more than the minimum with a later position that repeats a third one. Positions left
with too short a run are therefore followed up, with all positions of the same hash: the windows that selected
them are hashed whole, and the first window with a hash is the holder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import mixed, runs_hash, text_pieces, word_hashes, written

#: A line is cut after the least word hash of every so many consecutive words; no part is longer than this.
SPAN = 8
#: Units compared at once, units of which windows are taken at once; windows are hashed by an eighth of it.
SLICE = 1 << 17
#: Units up to which a pair's are compared over all its shifts, how far is walked otherwise, and what a pair's long runs may hold then.
FEW, FAR, HEAVY = 1 << 6, 48, 1 << 22
#: Words of a passage inside longer lines that whole units lack at its two ends together: as a rule, and at most.
LOST, MOST_LOST = SPAN + 5, 4 * SPAN - 3


def _cuts(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and hash of every word of consecutive texts of ``sizes`` bytes, and the words that begin a unit."""
    row, begin, _, value = word_hashes(raw, sizes)
    n = len(row)
    if not n:
        return row, begin, value, row
    cut = np.zeros(n + 1, dtype=bool)
    cut[0] = True
    cut[np.searchsorted(begin, np.r_[np.flatnonzero(raw == 10), np.cumsum(sizes)])] = True  # rows are parted as lines are
    if n >= SPAN:
        line = np.cumsum(cut[:n])
        least, _ = _last_least(value, SPAN)
        cut[least[line[SPAN - 1 :] == line[: n - SPAN + 1]] + 1] = True
    return row, begin, value, np.flatnonzero(cut[:n])


def _last_least(values: np.ndarray, width: int, places: np.ndarray | None = None, known: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The place of the least of every ``width`` consecutive values, the last of equal ones, and the value there.

    ``values`` and ``places`` may be those of ``known`` consecutive values already.
    """
    places = np.arange(len(values)) if places is None else places
    while known < width:
        step = min(known, width - known)
        later = values[step:] <= values[:-step]
        values, places = np.where(later, values[step:], values[:-step]), np.where(later, places[step:], places[:-step])
        known += step
    return places, values


def units_of(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte, hash and number of words of every unit of consecutive texts of ``sizes`` bytes."""
    row, begin, value, first = _cuts(raw, sizes)
    if not len(row):
        return row, begin, value, row
    words = np.diff(np.r_[first, len(row)])
    return row[first], begin[first], runs_hash(value, first, np.arange(len(row)) - np.repeat(first, words)), words


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, body, hashes, sizes): per document a hash of its text, and of each unit a hash and its number of words.

    Lines are parted by ``\\n``; white space parts words and counts for nothing else. ``hashes`` and ``sizes`` are
    binary, four bytes and one byte a unit: every join moves them, and lists would go value by value.
    """

    def whole(raw, sizes):
        row, _, value, words = units_of(raw, sizes)
        return np.bincount(row, minlength=len(sizes)), value, words

    def cut(parts):
        found = [units_of(part, np.array([len(part)])) for part in parts]
        return np.array([sum(len(f[0]) for f in found)]), np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])

    @F.arrow_udf("struct<hashes: binary, sizes: binary>")
    def of(texts: pa.Array) -> pa.Array:
        counts, values, words = (np.concatenate(side) for side in zip(*text_pieces(texts, whole, cut)))
        offsets = np.r_[0, np.cumsum(counts)]
        parts = [_blobs((values >> np.uint64(32)).astype(np.uint32), offsets), _blobs(words.astype(np.int8), offsets)]
        return pa.StructArray.from_arrays(parts, ["hashes", "sizes"])

    return docs.select(F.col(key).alias("key"), _body(text).alias("body"), of(F.col(text)).alias("_")).select("key", "body", "_.hashes", "_.sizes")


def _body(text: str) -> Column:
    """XXH64 of a text's UTF-8 bytes."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _blobs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The bytes of ``values`` from each offset up to the next."""
    ends = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _units(blobs: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all blobs in a row, and where each blob begins; the last ends at one more place."""
    wide = isinstance(blobs, pa.LargeBinaryArray)
    _, ends, data = blobs.buffers()
    ends = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64) if len(blobs) else np.zeros(1, dtype=np.int64)
    values = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.empty(0, dtype=np.uint8)
    size = np.dtype(kind).itemsize
    if values.ctypes.data % size:
        values = values.copy()
    return values.view(kind), (ends - ends[0]) // size


def _pairs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hashes of two units in a row."""
    wide = lambda hashes: hashes.view(np.uint32).astype(np.uint64)
    return mixed(mixed(wide(one) + np.uint64(1)) * np.uint64(3) + wide(two))


def _selected(hashes: np.ndarray, sizes: np.ndarray, words: int, ends_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every window, the place of its least hash of two units, the last of equal ones, and these hashes.

    ``ends_of`` are the ends of consecutive documents, which windows don't cross; without it there is one.
    """
    pairs = _pairs(hashes[:-1], hashes[1:])
    total = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    ends = np.searchsorted(total, total[:-1] + words)
    last = np.full(len(hashes), len(hashes)) if ends_of is None else np.repeat(ends_of, np.diff(np.r_[0, ends_of]))
    begins = np.flatnonzero(ends <= last)
    ends = ends[begins]  # a window has two units at least, as it holds more words than one can
    place = begins.copy()
    width = ends - begins - 1  # pairs of a window; two overlapping stretches of a power of two cover it
    known, (places, least) = 1, (np.arange(len(pairs)), pairs)
    while len(width) and known <= width.max():
        mine = np.flatnonzero((width >= known) & (width < 2 * known))
        left, right = begins[mine], ends[mine] - 1 - known
        place[mine] = np.where(least[right] <= least[left], places[right], places[left])
        if 2 * known <= len(pairs):
            places, least = _last_least(least, 2 * known, places, known)
        known *= 2
    return begins, ends, place, pairs


def _sliced(hashes: np.ndarray, sizes: np.ndarray, words: int, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Begin, end and place of ``_selected`` for all documents of a batch, by windows that begin in ``SLICE`` units each."""
    for low in range(0, len(hashes), SLICE):
        high = min(len(hashes), low + SLICE + words)  # a window has no more units than words
        if high - low > 1:
            inside = np.r_[ends[np.searchsorted(ends, low, side="right") : np.searchsorted(ends, high)], high] - low
            begins, stops, place, _ = _selected(hashes[low:high], sizes[low:high], words, inside)
            n = np.searchsorted(begins, SLICE)
            yield begins[:n] + low, stops[:n] + low, place[:n] + low


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit hashes and sizes of all documents of ``batch`` in a row, and where each document ends."""
    hashes, begins = _units(batch.column("hashes"), np.int32)
    return hashes, _units(batch.column("sizes"), np.int8)[0], begins[1:]


def _rows(batch: pa.RecordBatch, places: np.ndarray, hashes: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    row = np.searchsorted(ends, places, side="right")
    at = (places - np.r_[0, ends][row]).astype(np.int32)
    taken = pa.array(row)
    columns = [batch.column("key").take(taken), batch.column("body").take(taken), pa.array(hashes.view(np.int64)), pa.array(at)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "body", "least", "at"])


def positions(lines: DataFrame, words: int) -> DataFrame:
    """(key, body, least, at): the positions that windows of each document select, and their hashes."""

    def run(batches):
        for batch in batches:
            hashes, sizes, ends = _flat(batch)
            if len(hashes) > 1:
                selected = np.zeros(len(hashes), dtype=bool)
                for _, _, place in _sliced(hashes, sizes, words, ends):
                    selected[place] = True
                place = np.flatnonzero(selected)
                yield _rows(batch, place, _pairs(hashes[place], hashes[place + 1]), ends)

    kind = dict(lines.dtypes)["key"]
    return lines.select("key", "body", "hashes", "sizes").mapInArrow(run, f"key {kind}, body long, least long, at int")


def windows(lines: DataFrame, words: int) -> DataFrame:
    """(key, body, least, at): the windows of ``lines`` that selected one of the positions ``wanted``, by whole hash and begin."""

    def run(batches):
        for batch in batches:
            hashes, sizes, ends = _flat(batch)
            if len(hashes) < 2:
                continue
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("wanted")).to_numpy(zero_copy_only=False))
            wanted = np.zeros(len(hashes), dtype=bool)
            wanted[np.r_[0, ends][row] + batch.column("wanted").flatten().to_numpy(zero_copy_only=False)] = True
            units = mixed(hashes.view(np.uint32).astype(np.uint64) + np.uint64(1))
            for begins, stops, place in _sliced(hashes, sizes, words, ends):
                begins, stops = begins[wanted[place]], stops[wanted[place]]
                for part in range(0, len(begins), SLICE // 8):
                    begin = begins[part : part + SLICE // 8]
                    length = stops[part : part + SLICE // 8] - begin
                    first = np.cumsum(length) - length
                    step = np.arange(int(length.sum())) - np.repeat(first, length)
                    yield _rows(batch, begin, runs_hash(units[np.repeat(begin, length) + step], first, step), ends)

    kind = dict(lines.dtypes)["key"]
    return lines.select("key", "body", "hashes", "sizes", "wanted").mapInArrow(run, f"key {kind}, body long, least long, at int")


def _of_same(left: DataFrame, right: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """``left`` joined with the columns of ``right`` for the same document."""
    named = right.withColumnsRenamed({"key": "_k", "body": "_b"})
    return left.join(named, F.col(key).eqNullSafe(F.col("_k")) & (F.col(body) == F.col("_b"))).drop("_k", "_b")


def _matches(lines: DataFrame, found: DataFrame, words: int) -> DataFrame:
    """(key, body, units, failed): units of matches of ``found`` (key, body, least, at) with their holders, and the
    hashes of positions that are in no match of enough words."""
    places = Window.partitionBy("least").orderBy(F.col("key").isNull(), "key", "body", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = found.select("*", *(F.first(name).over(places).alias(held) for name, held in (("key", "hkey"), ("body", "hbody"), ("at", "held"))))
    itself = F.col("key").eqNullSafe(F.col("hkey")) & (F.col("body") == F.col("hbody"))
    spans = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("held").cast("long"))  # a position of a document comes once at most
    pairs = met.filter(~(itself & (F.col("at") == F.col("held")))).groupBy("key", "body", "hkey", "hbody").agg(F.collect_list(spans).alias("spans"))
    pairs = _of_same(pairs, lines.select("key", "body", F.col("hashes").alias("own"), "sizes"))
    pairs = _of_same(pairs, lines.select("key", "body", F.col("hashes").alias("theirs")), "hkey", "hbody")
    pairs = pairs.withColumn("itself", itself)

    @F.arrow_udf("struct<units: array<int>, failed: array<long>>")
    def extended(own: pa.Array, sizes: pa.Array, theirs: pa.Array, spans: pa.Array, itself: pa.Array) -> pa.Array:
        (a, ends), (n, _), (b, stops), (places, last) = _units(own, np.int32), _units(sizes, np.int8), _units(theirs, np.int32), _flattened(spans)
        places = places.to_numpy(zero_copy_only=False)
        at, held = places >> 32, places & 0xFFFFFFFF
        alone = itself.to_numpy(zero_copy_only=False)
        gone, short = np.zeros(len(a), dtype=bool), np.zeros(len(at), dtype=bool)
        load = np.cumsum(np.diff(ends) + np.diff(stops) + 8 * np.diff(last)) // (8 * SLICE)  # pairs in hand at once, for bounded memory
        edges = np.r_[0, np.flatnonzero(np.diff(load)) + 1, len(alone)].tolist()
        for i, j in zip(edges, edges[1:]):
            own_, held_, mine = slice(ends[i], ends[j]), slice(stops[i], stops[j]), slice(last[i], last[j])
            gone[own_], short[mine] = _extend_all(a[own_], ends[i : j + 1] - ends[i], n[own_], b[held_], stops[i : j + 1] - stops[i], at[mine], held[mine], last[i : j + 1] - last[i], alone[i:j], words)
        units, number = np.flatnonzero(gone), np.flatnonzero(short)
        first = ends[np.searchsorted(last, number, side="right") - 1]
        following = np.minimum(at[number] + 1, np.diff(ends)[np.searchsorted(last, number, side="right") - 1] - 1)
        hashes = _pairs(a[first + at[number]], a[first + following]).view(np.int64)
        units -= ends[np.searchsorted(ends, units, side="right") - 1]
        lists = [_lists(units.astype(np.int32), gone, ends), _lists(hashes, short, last)]
        return pa.StructArray.from_arrays(lists, ["units", "failed"])

    return pairs.select("key", "body", extended("own", "sizes", "theirs", "spans", "itself").alias("_")).select("key", "body", "_.units", "_.failed")


def _flattened(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists in a row, and where each list begins; the last ends at one more place."""
    return lists.flatten(), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))].astype(np.int64)


def _lists(values: np.ndarray, taken: np.ndarray, begins: np.ndarray) -> pa.Array:
    """``values``, one for each place that is ``taken``, as lists of the places from each begin on."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(taken)][begins].astype(np.int32)), pa.array(values))


def _extend_all(
    own: np.ndarray, ends: np.ndarray, sizes: np.ndarray, theirs: np.ndarray, stops: np.ndarray,
    at: np.ndarray, held: np.ndarray, last: np.ndarray, alone: np.ndarray, words: int,
) -> tuple[np.ndarray, np.ndarray]:
    """``_extend`` for many pairs at once: marks of the units of ``own`` in matches and of the positions in none.

    Pair i has the units of ``own`` from ``ends[i]`` on, of ``theirs`` from ``stops[i]`` on and the positions from
    ``last[i]`` on. Where a pair has very few units to compare, all of a shift are compared. Else each position is
    walked from, up to the next one of its shift, so that a run is walked once. Where a run goes on after that but
    holds enough words already, and differs at the edge of the stretch that such runs cover together, it adds nothing.
    All units are compared of the shifts of the others. A pair whose long runs have too many units goes by itself.
    """
    gone, short = np.zeros(len(own), dtype=bool), np.zeros(len(at), dtype=bool)
    if not len(at):
        return gone, short
    pair, shift = np.repeat(np.arange(len(last) - 1), np.diff(last)), at - held
    key, group = np.unique(pair << 33 | (shift + (1 << 32)), return_inverse=True)
    of, by = key >> 33, (key & ((1 << 33) - 1)) - (1 << 32)
    low = np.maximum(by, 0)
    count = np.minimum(np.diff(ends)[of], np.diff(stops)[of] + by) - low
    left, right = at.copy(), at.copy()
    whole = ~(np.bincount(of, count, len(last) - 1) > FEW)[of]  # shifts of which all units are compared
    order = np.argsort(group << 32 | at)
    walked = order[~whole[group[order]]]
    here, there, mine = at[walked], held[walked], pair[walked]
    room = np.minimum(np.diff(ends)[mine] - here, np.diff(stops)[mine] - there)
    gap = np.where(np.diff(group[walked], append=-1) == 0, np.diff(here, append=0), np.iinfo(np.int64).max)
    after, on = _walk(own, theirs, ends[mine] + here, stops[mine] + there, np.minimum(room, gap), 1)
    opens = np.r_[True, after != gap][: len(walked)]  # the first position of its run
    before, back = _walk(own, theirs, ends[mine] + here - 1, stops[mine] + there - 1, np.where(opens, np.minimum(here, there), 0), -1)
    run, begin = np.cumsum(opens) - 1, np.flatnonzero(opens)
    end = np.r_[begin[1:], len(run)][: len(begin)] - 1
    left[walked], right[walked] = (here - before)[begin][run], (here + after)[end][run]
    base, total = ends[pair], np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    far, deep = np.zeros(len(walked), dtype=bool), np.zeros(len(walked), dtype=bool)
    far[on], deep[back] = True, True
    far, deep = far[end][run], deep[begin][run]
    # all long runs tell which pairs go by themselves, whether settled or not
    long = ((right - at >= FAR)[walked] & (room > FAR)) | ((at - left >= FAR)[walked] & (np.minimum(here, there) > FAR))
    many = whole.copy()
    many[group[walked[long]]] = True
    heavy = np.bincount(of[many], count[many], len(last) - 1) > HEAVY
    open_ = _open(own, theirs, walked[far | deep], far[far | deep], deep[far | deep], walked, left, right, at, shift, pair, alone, ends, stops, total, words)
    whole[group[open_]] = True
    for i in np.flatnonzero(heavy).tolist():
        units, places = slice(ends[i], ends[i + 1]), slice(last[i], last[i + 1])
        found, short[places] = _extend(own[units], sizes[units], theirs[stops[i] : stops[i + 1]], at[places], held[places], bool(alone[i]), words)
        gone[ends[i] + found] = True
    whole &= ~heavy[of]
    first = np.r_[np.searchsorted(group[order], np.arange(len(key))), len(order)]
    chosen = np.flatnonzero(whole)
    for part in np.split(chosen, np.flatnonzero(np.diff(np.cumsum(count[chosen]) // SLICE)) + 1) if len(chosen) else []:
        n = count[part]
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum()))
        breaks = np.flatnonzero(own[place + np.repeat(ends[of[part]] + low[part] - begin, n)] != theirs[place + np.repeat(stops[of[part]] + low[part] - by[part] - begin, n)])
        number = order[first[part[0]] : first[part[-1] + 1]]
        number = number[whole[group[number]]]
        g = np.searchsorted(part, group[number])
        moved = begin[g] - low[part][g]
        run = np.searchsorted(breaks, at[number] + moved)
        left[number] = np.maximum(np.r_[0, breaks + 1][run], begin[g]) - moved
        right[number] = np.minimum(np.r_[breaks, len(place)][run], begin[g] + n[g]) - moved
    right = np.where(alone[pair], np.minimum(right, np.maximum(left + shift, at)), right)
    light = ~heavy[pair]
    enough = light & (total[base + right] - total[base + left] >= words)
    gone |= _covered(len(own), (base + left)[enough], (base + right)[enough])[:-1]
    short[light] = ~enough[light] & ~gone[(base + at)[light]]
    return gone, short


def _open(
    own: np.ndarray, theirs: np.ndarray, numbers: np.ndarray, far: np.ndarray, deep: np.ndarray, walked: np.ndarray,
    left: np.ndarray, right: np.ndarray, at: np.ndarray, shift: np.ndarray, pair: np.ndarray, alone: np.ndarray,
    ends: np.ndarray, stops: np.ndarray, total: np.ndarray, words: int,
) -> np.ndarray:
    """Those of the positions ``numbers``, whose runs go on to the right (``far``) or left (``deep``), that may add units.

    What all of ``walked`` cover so far, as far as it holds enough words, is in matches for certain.
    """
    if not len(numbers):
        return numbers
    most = np.where(alone[pair], np.maximum(left + shift, at), np.iinfo(np.int64).max)
    unsure = numbers[deep & alone[pair[numbers]]]  # where a match inside one document ends depends on where it begins
    taken = np.ones(len(at), dtype=bool)
    taken[unsure] = False
    sure = walked[taken[walked]]
    base, reached = ends[pair], np.minimum(right, most)
    enough = np.zeros(len(at), dtype=bool)
    enough[sure] = total[(base + reached)[sure]] - total[(base + left)[sure]] >= words
    sure = sure[enough[sure]]
    free = np.flatnonzero(~_covered(len(own), (base + left)[sure], (base + reached)[sure]))
    # the last place, after all units, is always free
    mine, begin = pair[numbers], ends[pair[numbers]]
    edge = np.minimum(free[np.searchsorted(free, begin + right[numbers] - 1)], ends[mine + 1]) - begin
    there = edge - shift[numbers]
    on = far & (right[numbers] < most[numbers]) & (edge < np.minimum(most[numbers], ends[mine + 1] - begin)) & (there < np.diff(stops)[mine])
    on[on] = own[(begin + edge)[on]] == theirs[(stops[mine] + there)[on]]
    edge = np.maximum(np.r_[-1, free][np.searchsorted(free, begin + left[numbers])], begin - 1) - begin
    there = edge - shift[numbers]
    back = deep & (edge >= 0) & (there >= 0)
    back[back] = own[(begin + edge)[back]] == theirs[(stops[mine] + there)[back]]
    return np.r_[numbers[on | back | ~enough[numbers]], unsure]


def _covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places, and one more after them that never is, lie in a stretch from a begin up to its end."""
    depth = np.bincount(begins, minlength=n + 1)
    depth -= np.bincount(ends, minlength=n + 1)
    return np.cumsum(depth, out=depth) > 0


def _walk(own: np.ndarray, theirs: np.ndarray, at: np.ndarray, held: np.ndarray, room: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How many units agree from each of the places on, and the numbers of the places where more than ``FAR`` do."""
    n, open_ = np.zeros(len(at), dtype=np.int64), np.flatnonzero(room > 0)
    at, held, room = at[open_], held[open_], room[open_]
    for far in range(FAR):
        same = own[at] == theirs[held]
        on = same & (room > far + 1)
        if not on.all():
            n[open_] = far + same
            open_, at, held, room = open_[on], at[on], held[on], room[on]
        if not len(open_):
            break
        at, held = at + step, held + step
    n[open_] = FAR
    return n, open_


def _agree(own: np.ndarray, theirs: np.ndarray) -> int:
    """How many units agree from the beginning on; looks at little more than those."""
    n, at, step = min(len(own), len(theirs)), 0, 16
    while at < n:
        end = min(n, at + step)
        differ = own[at:end] != theirs[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, step = end, step * 2
    return n


def _extend(
    own: np.ndarray, sizes: np.ndarray, theirs: np.ndarray, at: np.ndarray, held: np.ndarray, itself: bool, words: int
) -> tuple[np.ndarray, np.ndarray]:
    """Units of ``own`` in matches with ``theirs``, and which positions ``at`` are in none of ``words`` words.

    Positions with one shift are in one run as long as units agree, which is walked once. A position inside
    units that are deleted already is passed over unless its run goes on at their edge. Inside one document
    a match and what it repeats don't overlap.
    """
    total = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    shifts = at.astype(np.int64) - held
    several = np.unique(shifts)
    if len(several) <= 4:  # as a rule; all runs of a shift at once
        depth, long = np.zeros(len(own) + 1, dtype=np.int64), np.zeros(len(at), dtype=bool)
        for shift in several.tolist():
            low, high, mine = max(0, shift), min(len(own), len(theirs) + shift), np.flatnonzero(shifts == shift)
            breaks = np.flatnonzero(own[low:high] != theirs[low - shift : high - shift]) + low
            edges, here = np.r_[low, breaks + 1], at[mine]
            run = np.searchsorted(breaks, here)
            left, right = edges[run], np.r_[breaks, high][run]
            if itself:
                right = np.minimum(right, np.maximum(left + shift, here))
            enough = total[right] - total[left] >= words
            long[mine] = enough
            np.add.at(depth, left[enough], 1)
            np.add.at(depth, right[enough], -1)
        gone = np.cumsum(depth)[:-1] > 0
        return np.flatnonzero(gone), ~long & ~gone[at]
    gone, failed = np.zeros(len(own), dtype=bool), np.zeros(len(at), dtype=bool)
    walked: dict[int, int] = {}  # end of the last run by shift
    begin, end = 0, 0  # the stretch of deleted units reached last
    for number in np.lexsort((held, at)).tolist():
        here, shift = int(at[number]), int(at[number]) - int(held[number])
        if here < walked.get(shift, 0):
            failed[number] = not gone[here]
            continue
        if begin <= here < end:
            after = end < min(len(own), len(theirs) + shift) and own[end] == theirs[end - shift]
            before = begin > max(0, shift) and own[begin - 1] == theirs[begin - 1 - shift]
            if not after and not before:
                continue
        left = here - _agree(own[:here][::-1], theirs[: here - shift][::-1])
        right = here + _agree(own[here:], theirs[here - shift :])
        if itself:
            right = min(right, max(left + shift, here))
        walked[shift] = right
        if total[right] - total[left] >= words:
            gone[left:right] = True
            begin, end = (min(begin, left), max(end, right)) if left <= end and right >= begin and end else (left, right)
        else:
            failed[number] = not gone[here]
    return np.flatnonzero(gone), failed


def repeated_units(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> tuple[DataFrame, DataFrame]:
    """The line table, and (key, body, units): sorted numbers of the units to delete, for documents that have any."""
    words = min_words - LOST
    if words <= 2 * SPAN:
        raise ValueError(f"min_words must exceed {LOST + 2 * SPAN}")
    lines = written(line_table(docs, key, text).dropDuplicates(["key", "body"]))
    selected = written(positions(lines, words))
    first = written(_matches(lines, selected, words))
    failed = written(first.select(F.explode("failed").alias("least")).distinct())
    # positions of the same hash, whatever became of them: any may be what a failed one repeats
    again = selected.join(failed, "least", "left_semi").groupBy("key", "body").agg(F.collect_list("at").alias("wanted"))
    followed = written(windows(_of_same(lines, written(again)), words))
    second = _matches(lines, followed, words)
    units = first.select("key", "body", "units").unionByName(second.select("key", "body", "units")).filter("size(units) > 0")
    return lines, units.groupBy("key", "body").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("units")))).alias("units"))


def _without(text: str, units: np.ndarray) -> str:
    """``text`` without the given units. A line that loses all its units goes with its end."""
    return _all_without(pa.array([text]), pa.array([units]))[0].as_py()


def _all_without(texts: pa.Array, units: pa.Array) -> pa.Array:
    """``_without`` for many texts, about ``PIECE`` bytes at a time; null where ``texts`` are."""
    known = texts.is_valid()
    numbers, last = _flattened(units.filter(known))
    numbers, at, size = numbers.to_numpy(zero_copy_only=False), 0, 0
    texts = texts.filter(known)
    left = np.zeros(len(texts), dtype=np.int64)
    data = np.empty(pc.sum(pc.binary_length(texts)).as_py() or 0, dtype=np.uint8)
    for raw, lengths, counts, begins in text_pieces(texts, _begins, _begins_of_one):
        of = last[at : at + len(lengths) + 1]
        gone = np.zeros(len(begins), dtype=bool)
        gone[numbers[of[0] : of[-1]] + np.repeat(np.cumsum(counts) - counts, np.diff(of))] = True
        stays = _stays(raw, lengths, begins, gone)
        left[at : at + len(lengths)] = np.diff(np.r_[0, np.cumsum(stays)][np.r_[0, np.cumsum(lengths)]])
        shorter = raw[stays]
        data[size : size + len(shorter)] = shorter
        at, size = at + len(lengths), size + len(shorter)
    there = known.to_numpy(zero_copy_only=False)
    ends = np.zeros(len(there) + 1, dtype=np.int32)
    ends[1:][there] = left
    np.cumsum(ends, out=ends, dtype=np.int32)
    return pa.Array.from_buffers(pa.string(), len(there), [pa.array(there).buffers()[1], pa.py_buffer(ends), pa.py_buffer(data[:size])])


def _begins(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts themselves, and the number and the first bytes of their units."""
    row, begin, _, first = _cuts(raw, sizes)
    return raw, sizes, np.bincount(row[first], minlength=len(sizes)), begin[first]


def _begins_of_one(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(part) for part in parts])
    begins = np.concatenate([_begins(part, lengths[i : i + 1])[3] + at for i, (part, at) in enumerate(zip(parts, (np.cumsum(lengths) - lengths).tolist()))])
    return np.concatenate(parts), np.array([lengths.sum()]), np.array([len(begins)]), begins


def _stays(raw: np.ndarray, sizes: np.ndarray, begins: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Which bytes of consecutive texts stay. A unit's bytes reach from its line's begin or its own to the next unit or its line's end."""
    ends, breaks = np.cumsum(sizes), np.flatnonzero(raw == 10)
    stops = np.r_[ends, breaks]
    order = np.argsort(stops, kind="stable")  # where a text ends and the next one begins with a line end, the text's end comes first
    stops, broken = stops[order], order >= len(ends)
    starts = np.r_[0, (stops + broken)[:-1]]
    line = np.searchsorted(stops, begins, side="right")
    other = line[1:] != line[:-1]
    here = np.where(np.r_[True, other][: len(line)], starts[line], begins)
    following = np.where(np.r_[other, True][: len(line)], stops[line], np.r_[here[1:], 0][: len(line)])
    out = np.zeros(len(raw) + 1, dtype=np.int8)
    out[here[gone]] += 1
    out[following[gone]] -= 1
    out = np.cumsum(out[:-1], dtype=np.int8).astype(bool)
    whole = np.bincount(line, minlength=len(stops)) == np.bincount(line[gone], minlength=len(stops))
    whole[np.bincount(line, minlength=len(stops)) == 0] = False
    out[stops[whole & broken]] = True
    # a text whose last line goes ends with what is left before, not with its line end
    final = np.flatnonzero(~broken)
    kept = np.maximum.accumulate(np.where(whole, -1, np.arange(len(stops))))[final]
    out[stops[kept[whole[final] & (kept >= np.r_[0, final[:-1] + 1])]]] = True
    return ~out


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with repeated runs taken out of ``text``, and n_lines, n_deleted.

    Runs are found by whole units: every repeated run whose units hold ``min_words`` - ``LOST`` words goes,
    shorter ones stay. A passage of ``min_words`` words that begins and ends inside lines has as many words in
    whole units as a rule, one longer by ``MOST_LOST`` - ``LOST`` words for certain. The copy that stays is the first by key (null last), then by a hash of the
    text, then by unit. Rows equal in key and text are one document read more than once: each gets the same
    result. ``n_lines`` counts units, so a long line counts several times; blank lines have none and stay.
    Null texts stay null, texts without words have no units. A line beyond ``PIECE`` bytes is cut once more
    where the piece ends. Columns named n_lines or n_deleted are replaced; names that begin with an underscore
    are reserved.
    """
    lines, deleted = repeated_units(docs, key, text, min_words)
    counts = lines.select("key", "body", F.octet_length("sizes").alias("_n"))
    facts = counts.join(deleted.withColumnsRenamed({"key": "_k", "body": "_b"}), F.col("key").eqNullSafe(F.col("_k")) & (F.col("body") == F.col("_b")), "left")
    facts = facts.select(F.col("key").alias("_key"), F.col("body").alias("_body"), "_n", F.col("units").alias("_gone"))
    joined = docs.withColumn("_own", _body(text)).join(facts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_body")))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, units: pa.Array) -> pa.Array:
        return _all_without(texts, units)

    touched = F.col("_gone").isNotNull()
    shorter = cut(F.when(touched, F.col(text)), F.col("_gone"))  # Python sees the texts that change
    joined = joined.withColumns({"n_lines": F.col("_n").cast("long"), "n_deleted": F.coalesce(F.array_size("_gone"), F.lit(0)).cast("long")})
    return joined.withColumn("_cut", shorter).withColumn(text, F.when(touched, F.col("_cut")).otherwise(F.col(text))).drop("_own", "_key", "_body", "_gone", "_n", "_cut")
