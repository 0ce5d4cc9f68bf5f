"""Peaks of long recordings, found in chunks: no task holds a recording.

Each chunk of an epoch is summed up by a few numbers: its ends, its extremes, and two stacks, the maxima that stand out when one looks at the chunk from its right or left end, each with the lowest value in front of it.
Stacks merge: behind a chunk only maxima above its own highest are seen. A scan over the summaries of an epoch tells every chunk what lies before and after it, and then a chunk finds its peaks, plateaus over its borders
included, and their prominence. Of peaks too close to each other the higher stays; near a border a chunk may have to leave that open, and only such peaks meet those of the next chunk.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import SAMPLES, _schema, in_groups, numbers
from .epochs import within


def highest(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The highest value of a group up to each of its samples; without one, minus infinity."""
    levels, rank = np.unique(np.where(np.isnan(v), -np.inf, v), return_inverse=True)
    group = np.zeros(len(v), int)
    group[starts[1:]] = 1
    return levels[np.maximum.accumulate(np.cumsum(group) * len(levels) + rank) % len(levels)]


def seen(v: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heights of the maxima that stand out from the first sample of each group, from the nearest on, the lowest value between each and that end, and where those of each group begin.

    Of maxima next to each other, which rise without a dip, the highest is enough.
    """
    opens = np.zeros(len(v), bool)
    opens[starts] = True
    over = v > np.where(opens, -np.inf, np.roll(highest(v, starts), 1))
    at = np.flatnonzero(over & ~np.append(over[1:] & ~opens[1:], False))
    return v[at], np.where(opens, np.inf, np.roll(-highest(-v, starts), 1))[at], np.searchsorted(at, np.append(starts, len(v)))


def seen_from_right(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``seen`` from the right end of one group."""
    return seen(v[::-1], np.zeros(1, int))[:2]


def behind(height: np.ndarray, low: np.ndarray, far: tuple[np.ndarray, np.ndarray], top: float, bottom: float) -> tuple[np.ndarray, np.ndarray]:
    """The stack of two stretches: a near one, with its extremes, and what is seen behind it."""
    over = ~(far[0] <= top)  # a stretch without numbers hides nothing
    return np.concatenate([height, far[0][over]]), np.concatenate([low, np.fmin(far[1][over], bottom)])


def lowest_before_higher(v: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sample the lowest value back to the last higher one of its group, that one left out, and whether there is a higher one."""
    low, found = [], []
    values = v.tolist()
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(v)]):
        stack: list[tuple[float, float]] = []
        for x in values[a:b]:
            if x != x:
                low.append(x)
                found.append(False)
                continue
            least = x
            while stack and stack[-1][0] <= x:
                least = min(least, stack.pop()[1])
            low.append(least)
            found.append(bool(stack))
            stack.append((x, least))
    return np.array(low, dtype=float), np.array(found, dtype=bool)


def spaced(pos: np.ndarray, height: np.ndarray, distance: int, open_left: float = -np.inf, open_right: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Which peaks stay if of any two closer than ``distance`` the higher stays (of equal ones the later), and which are undecided.

    Peaks unknown here may lie at ``open_left`` or before and at ``open_right`` or after; a peak is undecided if it depends on one of those.
    """
    kept, unknown = np.zeros(len(pos), bool), np.zeros(len(pos), bool)
    stay: list[int] = []
    doubt: list[int] = []

    def close(held: list[int], p: int) -> bool:
        i = bisect_left(held, p)
        return (i < len(held) and held[i] - p < distance) or (i > 0 and p - held[i - 1] < distance)

    for k in np.lexsort((pos, height))[::-1]:
        p = int(pos[k])
        if close(stay, p):
            continue
        if close(doubt, p) or p - open_left < distance or open_right - p < distance:
            unknown[k] = True
            insort(doubt, p)
        else:
            kept[k] = True
            insort(stay, p)
    return kept, unknown


def runs(v: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sample of each run of equal values, and of each group the number of its first and of its last run."""
    new = np.append(True, v[1:] != v[:-1])
    new[starts] = True
    first = np.flatnonzero(new)
    a = np.searchsorted(first, starts)
    return first, a, np.append(a[1:], len(first)) - 1


def slices(group: np.ndarray) -> list[tuple[int, slice]]:
    """The stretch of each group that has members, of members in the order of their groups."""
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)
    return [(int(group[a]), slice(a, b)) for a, b in zip(cuts, [*cuts[1:], len(group)])]


def lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, pa.float64()))


def flat(table: pa.Table, column: str) -> tuple[np.ndarray, list[int]]:
    """The values of all lists of a column, one after another, and where each list begins."""
    own = table.column(column).combine_chunks()
    return own.flatten().to_numpy(), [0, *np.cumsum(own.value_lengths().to_numpy()).tolist()]


def with_columns(table: pa.Table, columns: dict) -> pa.Table:
    for name, column in columns.items():
        table = table.append_column(name, column if isinstance(column, pa.Array) else pa.array(column))
    return table


def find_peaks(df: DataFrame, ids: list[str], frame: str, value: str, distance: int = 1, prominence: float = 0.0, samples: int = SAMPLES) -> DataFrame:
    """``ids, frame, pos, height, prominence``: maxima of each series, ``pos`` counting its samples from 0 in the order of ``frame``.

    As ``kernels.peaks``: a maximum is the middle of a run of equal values with lower ones on both sides; of maxima closer than ``distance`` samples the higher stays; then those of less ``prominence`` go.
    Frames must be unique in a series; they need not be without gaps.
    """
    found = _peaks_and_ends(df, ids, frame, value, distance, samples).where(F.col("side") == 1).drop("side")
    return found.where(F.col("prominence") >= prominence) if prominence > 0 else found


def _peaks_and_ends(df: DataFrame, ids: list[str], frame: str, value: str, distance: int, samples: int) -> DataFrame:
    """Peaks of any prominence, ``side`` 1, and the first and the last sample of each series, ``side`` 0 and 2, their prominence null."""
    by = [*ids, "_chunk"]
    rows = df.select(*ids, F.col(frame).alias("frame"), F.col(value).cast("double").alias("v"), F.floor(F.col(frame) / samples).alias("_chunk"))
    in_order = F.col("frame").asc_nulls_last()

    def summary(table: pa.Table, starts: np.ndarray) -> pa.Table:
        v, ends = numbers(table, "v"), np.append(starts[1:], table.num_rows)
        first, a, b = runs(v, starts)
        then, one = np.append(first[1:], len(v)), a == b
        own = {"n": ends - starts, "first": v[starts], "last": v[ends - 1], "lead": then[a] - starts, "trail": ends - first[b]}
        own |= {"after_lead": np.where(one, np.nan, v[then[a] % len(v)]), "before_trail": np.where(one, np.nan, v[first[b] - 1]), "top": np.fmax.reduceat(v, starts), "bottom": np.fmin.reduceat(v, starts)}
        left, right = seen(v, starts), seen(v[::-1], (len(v) - ends)[::-1])
        turned = pa.array(np.arange(len(starts))[::-1])
        own |= {"right": lists(right[0], right[2]).take(turned), "right_low": lists(right[1], right[2]).take(turned), "left": lists(left[0], left[2]), "left_low": lists(left[1], left[2])}
        return with_columns(table.select(by).take(pa.array(starts)), own)

    def scan(table: pa.Table, starts: np.ndarray) -> pa.Table:
        ends = np.append(starts[1:], table.num_rows)
        plain = {c: table.column(c).to_pylist() for c in ("n", "lead", "trail")} | {c: numbers(table, c).tolist() for c in ("first", "last", "after_lead", "before_trail", "top", "bottom")}
        stacks = {c: flat(table, c) for c in ("right", "right_low", "left", "left_low")}

        def walk(order, opens, first, last, lead, trail, before_trail, stack):
            """Per chunk, in one direction: start of the run that its first sample is in, the value before that run, and the stack and lowest value so far."""
            found = [None] * table.num_rows
            first, last, lead, trail, before_trail, n, top, bottom = (plain[c] for c in (first, last, lead, trail, before_trail, "n", "top", "bottom"))
            (height, at), (least, _) = stacks[stack], stacks[f"{stack}_low"]
            opens = set(opens.tolist())
            for k in order:
                if k in opens:
                    passed, run, previous, value, before, low = 0, 0, np.nan, np.nan, (np.zeros(0), np.zeros(0)), np.inf
                if passed == 0 or first[k] != value:
                    run, previous = passed, value
                found[k] = (run, previous, *before, low)
                if lead[k] < n[k]:
                    run, previous = passed + n[k] - trail[k], before_trail[k]
                passed, value = passed + n[k], last[k]
                before, low = behind(height[at[k] : at[k + 1]], least[at[k] : at[k + 1]], before, top[k], bottom[k]), np.fmin(low, bottom[k])
            return found

        ahead = walk(range(table.num_rows), starts, "first", "last", "lead", "trail", "before_trail", "right")
        back = walk(range(table.num_rows - 1, -1, -1), ends - 1, "last", "first", "trail", "lead", "after_lead", "left")
        n = table.column("n").to_numpy()
        passed, total = np.cumsum(n), np.repeat(np.add.reduceat(n, starts), ends - starts)
        start = passed - n - np.repeat(passed[starts] - n[starts], ends - starts)
        columns = {"start": start, "total": total}
        for name, side in (("before", ahead), ("after", back)):
            run, value, stack, low, least = zip(*side)
            at = np.append(0, np.cumsum([len(x) for x in stack]))
            columns[f"{name}_run"] = np.array(run, dtype=np.int64) if name == "before" else total - 1 - np.array(run, dtype=np.int64)
            columns |= {f"{name}_value": np.array(value, dtype=float), f"{name}_stack": lists(np.concatenate(stack), at), f"{name}_low": lists(np.concatenate(low), at), f"{name}_least": np.array(least, dtype=float)}
        return with_columns(table.select(by), columns)

    def peaks(table: pa.Table, starts: np.ndarray) -> pa.Table:
        """The first row of each chunk is its state, the others are samples."""
        at, sample = table.take(pa.array(starts)), np.ones(table.num_rows, bool)
        sample[starts] = False
        table, starts = table.filter(pa.array(sample)), starts - np.arange(len(starts))
        v, ends = numbers(table, "v"), np.append(starts[1:], table.num_rows)
        first, a, b = runs(v, starts)
        then = np.append(first[1:], len(v))
        chunk = np.repeat(np.arange(len(starts)), b - a + 1)
        start, total = at.column("start").to_numpy(), at.column("total").to_numpy()
        shift = (start - starts)[chunk]
        begin, end, before, after = first + shift, then - 1 + shift, v[first - 1], v[then % len(v)]
        begin[a], end[b], before[a], after[b] = at.column("before_run").to_numpy(), at.column("after_run").to_numpy(), numbers(at, "before_value"), numbers(at, "after_value")
        place = (begin + end) // 2 - shift
        here = (before < v[first]) & (after < v[first]) & (place >= starts[chunk]) & (place < ends[chunk])
        place, chunk = place[here], chunk[here]
        pos = place + (start - starts)[chunk]
        unknown = np.zeros(len(pos), bool)
        if distance > 1:
            stay, past = np.zeros(len(pos), bool), start + ends - starts
            for k, one in slices(chunk):
                stay[one], unknown[one] = spaced(pos[one], v[place[one]], distance, start[k] - 1 if start[k] else -np.inf, past[k] if past[k] < total[k] else np.inf)
            stay |= unknown
            place, chunk, pos, unknown = place[stay], chunk[stay], pos[stay], unknown[stay]
        height = v[place]
        deepest = np.full(len(pos), -np.inf)
        for side, turned in (("before", False), ("after", True)):
            low, higher = lowest_before_higher(v[::-1], (len(v) - ends)[::-1]) if turned else lowest_before_higher(v, starts)
            own = len(v) - 1 - place if turned else place
            low, higher = low[own], higher[own]
            (heights, bounds), lows, least = flat(at, f"{side}_stack"), flat(at, f"{side}_low")[0], numbers(at, f"{side}_least")
            heights, outer = heights.tolist(), least[chunk]
            for i in np.flatnonzero(~higher):
                past = bounds[chunk[i] + 1]
                rank = bisect_right(heights, height[i], bounds[chunk[i]], past)  # the stack rises
                if rank < past:
                    outer[i] = lows[rank]
            deepest = np.maximum(deepest, np.where(higher, low, np.fmin(low, outer)))
        heads, tails = np.flatnonzero(start == 0), np.flatnonzero(start + ends - starts == total)
        place = np.concatenate([place, starts[heads], ends[tails] - 1])
        own = {"pos": np.concatenate([pos, start[heads], total[tails] - 1]), "height": v[place]}
        more = len(heads) + len(tails)
        own |= {"prominence": pa.array([*(height - deepest), *[None] * more], pa.float64()), "undecided": np.append(unknown, np.zeros(more, bool)), "side": np.repeat(np.array([1, 0, 2], np.int32), [len(pos), len(heads), len(tails)])}
        return with_columns(table.select([*ids, "frame"]).take(pa.array(place)), own)

    def decide(table: pa.Table, starts: np.ndarray) -> pa.Table:
        pos, height, stay = table.column("pos").to_numpy(), numbers(table, "height"), np.zeros(table.num_rows, bool)
        for a, b in zip(starts, np.append(starts[1:], table.num_rows)):
            stay[a:b] = spaced(pos[a:b], height[a:b], distance)[0]
        return table.filter(pa.array(stay)).drop_columns("_near")

    known, values, arrays = _schema(rows, by), "first double, last double, lead long, trail long, after_lead double, before_trail double, top double, bottom double", "right array<double>, right_low array<double>, left array<double>, left_low array<double>"
    summaries = in_groups(rows, by, [in_order], summary, f"{known}, n long, {values}, {arrays}")
    sides = ", ".join(f"{s}_run long, {s}_value double, {s}_stack array<double>, {s}_low array<double>, {s}_least double" for s in ("before", "after"))
    states = in_groups(summaries, ids, [F.col("_chunk").asc_nulls_last()], scan, f"{known}, start long, total long, {sides}")
    made = f"{_schema(rows, [*ids, 'frame'])}, pos long, height double, prominence double, undecided boolean, side int"
    # empty lists, as Arrow's writer takes the square of a batch's rows for null ones in a row
    samples_of = rows.withColumns({f"{s}_{c}": F.array().cast("array<double>") for s in ("before", "after") for c in ("stack", "low")})
    found = in_groups(samples_of.unionByName(states, allowMissingColumns=True), by, [F.col("total").isNull(), in_order], peaks, made)
    if distance > 1:
        # undecided peaks depend only on undecided ones nearby, so that those with a gap of the distance between them are apart
        order = Window.partitionBy(ids).orderBy("pos")
        open_ones = found.where("undecided").withColumn("_new", F.coalesce((F.col("pos") - F.lag("pos").over(order) >= distance).cast("int"), F.lit(0)))
        open_ones = open_ones.withColumn("_near", F.sum("_new").over(order)).drop("_new")
        closed = in_groups(open_ones, [*ids, "_near"], ["pos"], decide, made)
        found = found.where(~F.col("undecided")).unionByName(closed)
    return found.drop("undecided")


def split_at_minima(df: DataFrame, epochs: DataFrame, key: list[str], frame: str, value: str, distance: int, prominence: float, samples: int = SAMPLES) -> DataFrame:
    """Sub-epochs between local minima of each epoch: ``key, epoch_id, sub_epoch_id, start_frame, end_frame, global_id``."""
    inside = within(df, epochs, key, frame, "start_frame", "end_frame", closed="left")
    ids = [*key, "epoch_id"]
    found = _peaks_and_ends(inside.withColumn("_v", -F.col(value).cast("double")), ids, frame, "_v", distance, samples)
    points = found.where((F.col("side") != 1) | (F.col("prominence") >= prominence)).select(*ids, F.struct("side", "frame").alias("at"))
    order = Window.partitionBy(ids).orderBy("at")
    out = points.select(*ids, (F.row_number().over(order) - 1).alias("sub_epoch_id"), F.col("at.frame").alias("start_frame"), F.lead("at.frame").over(order).alias("end_frame"))
    out = out.where(F.col("end_frame").isNotNull())
    return out.withColumn("global_id", F.row_number().over(Window.partitionBy(key).orderBy("epoch_id", "sub_epoch_id")) - 1)
