"""Splitting oversized items at natural boundaries by dynamic programming.

An item longer than its limit is cut at positions chosen by dynamic programming over its
boundary positions: the sum of the penalties of the cuts and of the squared deviation of
the pieces from equal sizes is least, no piece is longer than the limit, and each piece
repeats exactly the overlap of the one before.  Where a stretch has no line end, blanks and
punctuation serve, and where it has none of these either, every so many characters.

A cut's best predecessor lies within one limit.  As the imbalance is a square, predecessors
are lines over the cut's place, whose lower hull is kept while it is walked: the time is
linear in the boundaries, however many fit into a limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalties of a cut after: a blank line, a closed block, a line, a blank, punctuation, anything.
BLANK_LINE, BLOCK, LINE, SPACE, POINT, ANY = 0.0, 0.05, 0.15, 0.6, 0.8, 2.0

_LINE = re.compile(r"\n")
_BLANK = re.compile(r"\n[ \t\r]*\n")
_BLOCK = re.compile(r"^[ \t]*[\]})]+[;,]?[ \t\r]*\n", re.M)
_SOFT = re.compile(r"(\s+)|[,;.)\]}>。、]")


def boundaries(text: str, step: int) -> tuple[list[int], list[float]]:
    """The positions at which a text may be cut and their penalties, none further than ``step`` apart."""
    cost = {m.end(): LINE for m in _LINE.finditer(text)}
    for m in _BLOCK.finditer(text):
        cost[m.end()] = BLOCK
    for m in _BLANK.finditer(text):
        cost[m.end()] = BLANK_LINE
    n, last, extra = len(text), 0, {}
    for at in [*sorted(cost), n]:
        if at - last > step:
            soft = {m.end(): SPACE if m.group(1) else POINT for m in _SOFT.finditer(text, last, at)}
            chosen, grid = last, last
            while at - grid > step:  # of each stretch of a step the best soft place, else its end
                grid = chosen + step
                near = [p for p in range(grid, max(chosen, grid - step // 2), -1) if p in soft]
                chosen = min(near, key=soft.__getitem__) if near else _whole(text, grid, chosen)
                if chosen >= at:
                    break
                extra[chosen] = soft.get(chosen, ANY)
                grid = chosen
        last = at
    for p, c in extra.items():
        cost.setdefault(p, c)
    cost.pop(0, None)
    cost[n] = 0.0
    places = sorted(cost)
    return places, [cost[p] for p in places]


def _whole(text: str, at: int, floor: int) -> int:
    """A place that parts no line end and no combined character, if one is near."""
    while at > floor + 1 and (0x300 <= ord(text[at]) < 0x370 or text[at] in "‍️" or text[at - 1] == "‍" or text[at - 1 : at + 1] == "\r\n"):
        at -= 1
    return at


class _Hull:
    """The lower hull of lines that are added by falling slope and asked at rising places."""

    def __init__(self):
        self.lines: list[tuple[int, int, int]] = []
        self.at = 0

    def add(self, slope: int, height: int, name: int) -> None:
        lines = self.lines
        while len(lines) > 1:
            (m1, b1, _), (m2, b2, _) = lines[-2:]
            if (height - b1) * (m1 - m2) > (b2 - b1) * (m1 - slope):
                break
            lines.pop()
        self.at = min(self.at, len(lines))
        lines.append((slope, height, name))

    def least(self, x: int, late: bool) -> tuple[int, int] | None:
        """The least value at ``x`` and its line; of equal ones the later or the earlier."""
        lines, at = self.lines, self.at
        if not lines:
            return None
        now = lines[at][0] * x + lines[at][1]
        while at + 1 < len(lines):
            after = lines[at + 1][0] * x + lines[at + 1][1]
            if after > now or after == now and not late:
                break
            at, now = at + 1, after
        self.at = at
        return now, lines[at][2]


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The pieces of a text as (start, end), in order; the whole text if it is within the limit."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit - 1))
    room = limit - overlap  # what each piece but the first can add
    places, penalty = boundaries(text, max(1, room // 4))
    pieces = 1 + -(-(n - limit) // room)
    # in whole numbers: 20 * pieces ** 2 * limit ** 2 times the cost, so that equal costs are equal
    whole, weight = n + (pieces - 1) * overlap, pieces * pieces * limit * limit
    own = [round(20 * p + 1) * weight for p in penalty]  # each cut costs 1/20 beside its penalty
    x = [pieces * (at + overlap) - whole for at in places]
    best, back = [0] * len(places), [-1] * len(places)
    before, start = range(0), 0  # the stretch before: boundaries of one room's width
    while start < len(places):
        stop, edge = start, (places[start] // room + 1) * room
        while stop < len(places) and places[stop] < edge:
            stop += 1
        reach, older = _Hull(), {}
        i = before.stop - 1
        for j in range(stop - 1, start - 1, -1):  # what the stretch before offers, from the far end
            while i >= before.start and places[i] >= places[j] - room:
                y = pieces * places[i]
                reach.add(40 * y, best[i] + 20 * y * y, i)
                i -= 1
            older[j] = reach.least(-x[j], True)
        inside = _Hull()
        for j in range(start, stop):
            low, chosen = older[j] or (None, -2)
            if places[j] <= limit:  # the first piece
                first = 20 * ((x[j] - pieces * overlap) ** 2 - x[j] ** 2)
                if low is None or first <= low:
                    low, chosen = first, -1
            if (found := inside.least(x[j], False)) and (low is None or found[0] < low):
                low, chosen = found
            best[j], back[j] = low + 20 * x[j] ** 2 + own[j], chosen
            y = pieces * places[j]
            inside.add(-40 * y, best[j] + 20 * y * y, j)
        before, start = range(start, stop), stop  # no two boundaries are a room apart
    ends, j = [], len(places) - 1
    while j >= 0:
        ends.append(places[j])
        j = back[j]
    ends.reverse()
    return [(max(0, start - overlap), end) for start, end in zip([0, *ends], ends)]


def limits(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """The chunks that may be too long, with ``lim`` and ``over`` of their language.

    A language without a row, a null language and a null value take the value of the row
    ``default``; a limit below 1 counts as null.  Of repeated rows of a language the largest
    values hold.  The configuration is joined, so it may have any number of rows.
    """
    limit, overlap = F.when(F.col("max_chunk_size") > 0, F.col("max_chunk_size")), F.col("overlap_chars")
    values = config.where(F.col("language").isNotNull()).groupBy(F.col("language").alias("_of")).agg(F.max(limit).alias("_m"), F.max(overlap).alias("_o"))
    named = config.where(F.col("language") == "default")
    m0, o0 = F.coalesce(named.agg(F.max(limit)).scalar(), F.lit(1500)), F.coalesce(named.agg(F.max(overlap)).scalar(), F.lit(150))
    least = F.coalesce(F.least(config.agg(F.min(limit)).scalar(), m0), F.lit(1500))
    placed = chunks.where(F.length("content") > least).join(values, F.col("language") == F.col("_of"), "left")
    return placed.withColumns({"lim": F.coalesce("_m", m0).cast("int"), "over": F.coalesce("_o", o0).cast("int")}).drop("_of", "_m", "_o")


def split_oversized(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """The ordered pieces of every distinct chunk whose content is longer than its limit.

    ``id``, ``piece`` from 0, ``content``, ``start_line``, ``end_line`` (null where the chunk's
    is), ``start`` and ``end`` in characters and ``max_chunk_size``.  Null and empty contents
    are never longer.  Rows with the same id, content, place and limit are one chunk.
    """
    large = limits(chunks.select("id", "content", "language", F.col("start_line").cast("int").alias("first")), config).where(F.length("content") > F.col("lim"))
    one = large.withColumn("h", F.xxhash64("content")).dropDuplicates(["id", "h", "first", "lim", "over"]).select("id", "content", "first", "lim", "over")

    def pieces(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            out = []
            for key, text, first, lim, over in zip(b["id"], b["content"], b["first"], b["lim"], b["over"]):
                line, seen = 0, 0
                for k, (start, end) in enumerate(cut(text, int(lim), int(over))):
                    line += text.count("\n", seen, start)
                    seen = start
                    to = line + text.count("\n", start, end - 1)
                    known = not pd.isna(first)
                    out.append((key, k, text[start:end], int(first) + line if known else None, int(first) + to if known else None, start, end, int(lim)))
            made = pd.DataFrame(out, columns=["id", "piece", "content", "start_line", "end_line", "start", "end", "max_chunk_size"])
            yield made.astype({"start_line": "Int32", "end_line": "Int32"})

    return one.mapInPandas(pieces, "id string, piece int, content string, start_line int, end_line int, start int, end int, max_chunk_size int")
