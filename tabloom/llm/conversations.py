"""Repair of conversation structure by a checkpointed dynamic program over edits.

A repaired conversation has role initials ``(s?(ua)+)?``. Rows are kept (0), given the role user or
assistant (3) or deleted (4); rows without text can be inserted (3). Blank and duplicate rows have
to go; a truncated row that stays adds 3. Of the cheapest edit sequences the one whose initials (D, I, K,
R) are least in ASCII order is taken.

What a row means to the program is one byte. Rows are sorted by (conversation, turn, digest) over ranges,
and a task sees the bytes of each conversation's part in its range, a segment. Costs back from the end are
a vector over the four states of the pattern. For a segment of n rows, vectors are kept at about sqrt(n)
checkpoints only; walking forward, a block's vectors are computed again and each row takes the
least letter whose cost is tight.

Conversations inside one range, nearly all, are done there. Others leave an open segment at the edge of each
range they reach, two a task at most: the segment as a min-plus matrix goes to its conversation, whose
matrices give the vector at the end of each segment; segments are then walked from every state, and the
states are joined up in order. So a conversation with a third of all rows is spread over a third
of the tasks, whole texts move once, and only its final replay, which streams, meets in one task.

Defined cases: rows of a conversation come by turn, nulls first, then by the digest of role and text;
a null role or text is one space; null conversation ids are one conversation; equal rows are duplicates
of the first; a conversation left without rows has an empty repair; an empty table gives no rows.
"""

import hashlib
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..sources.shared import stage

FAR = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
AFTER = (USER, USER, ASSISTANT, USER)  # the role that comes next, as the state it leads to
KEEPS = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
INITIALS, ROLES = "sua", {USER: "user", ASSISTANT: "assistant"}
INSERT, RENAME, DELETE, TRUNCATED = 3, 3, 4, 3
CLEAN, CUT, GONE = 0, 1, 2  # a row's fault as the program sees it; its code is initial + 4 * fault
BLANK = "[^\\x20\\x09-\\x0D]"
STATS = ("rows", "blank", "duplicate", "truncated", "illegal")


def _closed(costs):
    """Costs of a place, rows inserted there included."""
    costs = list(costs)
    for _ in range(2):  # two insertions reach every state
        costs = [min(c, INSERT + costs[AFTER[s]]) for s, c in enumerate(costs)]
    return costs


def _relative(costs):
    least = min(costs)
    return tuple(FAR if c > FAR // 2 else c - least for c in costs)


END = tuple(_closed([0, FAR, FAR, 0]))


def _moves(state, code):
    """(letter, cost, next state) of what can be done with a row, in ASCII order without insertion."""
    initial, fault = code % 4, code // 4
    yield "D", DELETE, state
    if fault != GONE:
        more = TRUNCATED if fault == CUT else 0
        if KEEPS[state][initial] is not None:
            yield "K", more, KEEPS[state][initial]
        yield "R", RENAME + more, AFTER[state]


@lru_cache(maxsize=None)  # relative costs are bounded, so there are few of them
def _step(code, costs):
    """(offset, relative costs) before a row, from the relative costs after it."""
    new = _closed([min(cost + costs[to] for _, cost, to in _moves(s, code)) for s in STATES])
    return min(new), _relative(new)


def _back(codes, costs):
    """Relative costs before the first of the rows, and what was taken off them."""
    total = 0
    for code in reversed(codes):
        off, costs = _step(code, costs)
        total += off
    return total, costs


def checkpoints(codes, costs):
    """Relative costs at the end of each block of about sqrt(n) rows, and the block size."""
    size = isqrt(len(codes)) + 1
    kept = [costs]
    for first in range((len(codes) - 1) // size * size, 0, -size):
        kept.append(_back(codes[first : first + size], kept[-1])[1])
    return kept[::-1], size


def walk(codes, costs, state, last):
    """(edits, end state) of the least tight edits of a segment; the last one also goes to the end."""
    kept, size = checkpoints(codes, costs)
    edits = []
    for b, after in enumerate(kept if codes else ()):
        block = codes[b * size : (b + 1) * size]
        offs, vectors = [], [after]
        for code in reversed(block):
            off, vector = _step(code, vectors[-1])
            offs.append(off)
            vectors.append(vector)
        offs, vectors = offs[::-1], vectors[::-1]
        for i, code in enumerate(block):
            here, then, off = vectors[i], vectors[i + 1], offs[i]
            while True:
                cost = here[state]
                moves = {m: to for m, c, to in _moves(state, code) if c + then[to] - off == cost}
                if "D" in moves or INSERT + here[AFTER[state]] != cost:
                    letter = min(moves)
                    edits.append(letter)
                    state = moves[letter]
                    break
                edits.append("I")
                state = AFTER[state]
    if last:
        while state not in (START, ASSISTANT):
            edits.append("I")
            state = AFTER[state]
    return "".join(edits), state


def matrix(codes):
    """Costs from each state before the rows to each state after them."""
    columns = []
    for end in STATES:
        off, costs = _back(codes, tuple(0 if s == end else FAR for s in STATES))
        columns.append([min(off + c, FAR) for c in costs])
    return [[columns[e][s] for e in STATES] for s in STATES]


def _times(table, costs):
    return [min(min(a + b, FAR) for a, b in zip(row, costs)) for row in table]


def judged(rows):
    """(conv_id, turn, key, initial, fault, n) of distinct rows, fault being blank, truncated or none, and
    late where an earlier turn has the same role and text."""
    light = rows.groupBy("conv_id", "turn", "key", "initial", "fault").agg(F.sum("copies").alias("n"))
    light = stage(light, "turns")
    first = light.filter("fault <> 'blank'").groupBy("conv_id", "key").agg(
        F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("times")
    )
    first = first.filter("times > 1").select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key"))
    late = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return light.join(first, same, "left").select("conv_id", "turn", "key", "initial", "fault", "n", late.alias("late"))


def readable(rows):
    """Turns with what is judged of them: nulls as one space, digest, role initial, fault, copies."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("bigint").alias("copies"))
    rows = rows.filter("copies > 0")
    fault = F.when(~F.col("text").rlike(BLANK), "blank").when(
        ~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), "truncated"
    )
    key = F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"))
    return rows.withColumns({"key": key, "initial": F.substring("role", 1, 1), "fault": F.coalesce(fault, F.lit(""))})


SEGMENT = pa.schema(
    [("part", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("key", pa.string()), ("open", pa.bool_()),
     ("codes", pa.binary()), ("matrix", pa.list_(pa.list_(pa.int64()))), ("audit", pa.string()), ("cost", pa.int64())]
    + [(x, pa.int64()) for x in (*STATS, "turns", "low", "high")] + [("head", pa.string()), ("tail", pa.string())]
)
LEGAL = ("su", "ua", "au")


class _Segment:
    """What a task knows of a conversation's rows in its range."""

    def __init__(self, conv, part, seq, turn, key):
        self.conv, self.codes = conv, bytearray()
        self.row = {"part": part, "seq": seq, "turn": turn, "key": key, "low": None, "high": None, "head": None, "tail": None, "turns": 0}
        self.row |= dict.fromkeys(STATS, 0)

    def add(self, turn, initial, fault, n, late):
        r = self.row
        if turn is not None and turn != r["high"]:
            r["turns"] += 1
            r["low"] = turn if r["low"] is None else r["low"]
            r["high"] = turn
        at = INITIALS.find(initial) if initial else -1
        r["illegal"] += (r["head"] is not None and r["tail"] + initial not in LEGAL) + (n - 1) * (initial + initial not in LEGAL)
        r["head"], r["tail"] = initial if r["head"] is None else r["head"], initial
        r["rows"] += n
        kind = "blank" if fault == "blank" else "duplicate" if late else fault
        if kind:
            r[kind] += 1
        r["blank" if fault == "blank" else "duplicate"] += n - 1
        place = at if at >= 0 else 3
        self.codes.append(place + 4 * {"": CLEAN, "truncated": CUT}.get(kind, GONE))
        self.codes.extend(bytes([place + 4 * GONE]) * (n - 1))

    def closed(self):
        edits, _ = walk(self.codes, END, START, True)
        off, costs = _back(self.codes, END)
        return self.row | {"open": False, "audit": edits, "cost": off + costs[START]}

    def opened(self):
        return self.row | {"open": True, "codes": bytes(self.codes), "matrix": matrix(self.codes)}


def segments(light):
    """Segments of conversations in range order; those inside one range are finished."""
    conv = light.schema["conv_id"]

    def cut(batches):
        part, seq, own, done = TaskContext.get().partitionId(), 0, None, []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([s.conv for s, _ in done], conv_type)]
                + [pa.array([r.get(f.name) for _, r in done], f.type) for f in SEGMENT], ["conv_id", *SEGMENT.names]
            )

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for c, turn, key, initial, fault, n, late in zip(*(x.to_pylist() for x in batch.columns)):
                if own is None or c != own.conv:
                    if own is not None:
                        done.append((own, own.closed() if own.row["seq"] else own.opened()))
                    own, seq = _Segment(c, part, seq, turn, key), seq + 1
                own.add(turn, initial, fault, n, late)
            if len(done) >= 1000:
                yield flush()
                done.clear()
        if own is not None:
            done.append((own, own.opened()))
            yield flush()

    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(SEGMENT).fields
    ordered = light.select("conv_id", "turn", "key", "initial", "fault", "n", "late")
    ordered = ordered.repartitionByRange("conv_id", "turn", "key").sortWithinPartitions("conv_id", "turn", "key")
    return ordered.mapInArrow(cut, type(light.schema)([conv, *schema]))


def _chained(parts):
    """(report, end costs of each segment) of a conversation's open segments in order."""
    report = {x: sum(p[x] for p in parts) for x in (*STATS, "turns")}
    low = [p["low"] for p in parts if p["low"] is not None]
    high = [p["high"] for p in parts if p["high"] is not None]
    for a, b in zip(parts, parts[1:]):
        report["illegal"] += a["tail"] + b["head"] not in LEGAL
        report["turns"] -= a["high"] is not None and a["high"] == b["low"]
    report |= {"low": low[0] if low else None, "high": high[-1] if high else None}
    costs, ends = list(END), []
    for p in reversed(parts):
        ends.append(list(_relative(costs)))
        costs = _times(p["matrix"], costs)
    return report | {"cost": costs[START]}, ends[::-1]


def join_open(found):
    """(part, seq, audit) of the open segments, and the reports of their conversations."""
    summary = [x for x in SEGMENT.names if x not in ("codes", "audit", "open", "cost", "turn", "key")]
    each = found.filter("open").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*summary))).alias("parts"))
    listed = ("part", "seq", "costs", "last")
    numbers = (*STATS, "turns", "low", "high", "cost")

    def chain(batches):
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():  # segments of a conversation: one a task at most
                report, ends = _chained(parts)
                ends = [dict(zip(listed, (p["part"], p["seq"], e, p is parts[-1]))) for p, e in zip(parts, ends)]
                out.append((report, ends))
            places = pa.list_(pa.struct([("part", pa.int64()), ("seq", pa.int64()), ("costs", pa.list_(pa.int64())), ("last", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[x] for r, _ in out], pa.int64()) for x in numbers), pa.array([e for _, e in out], places)],
                ["conv_id", *numbers, "places"],
            )

    kind = each.schema["conv_id"].dataType.simpleString()
    chained = each.mapInArrow(
        chain,
        f"conv_id {kind}, " + ", ".join(f"{x} long" for x in numbers)
        + ", places array<struct<part: long, seq: long, costs: array<long>, last: boolean>>",
    )
    chained = stage(chained, "chains")
    ends = chained.select("conv_id", F.inline("places"))
    codes = found.filter("open").select("part", "seq", "codes")

    def walked(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = [[walk(r["codes"], tuple(r["costs"]), s, r["last"]) for s in STATES] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array([[e for e, _ in x] for x in out], pa.list_(pa.string())),
                 pa.array([[s for _, s in x] for x in out], pa.list_(pa.int32()))],
                ["conv_id", "part", "seq", "edits", "ends"],
            )

    ways = ends.join(codes, ["part", "seq"]).select("conv_id", "part", "seq", "costs", "last", "codes")
    ways = stage(ways.mapInArrow(walked, f"conv_id {kind}, part long, seq long, edits array<string>, ends array<int>"), "ways")
    # The state before a segment is what the ones before it lead to.
    steps = ways.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "ends"))).alias("s"))

    def joined_up(batches):
        for batch in batches:
            taken = []
            for parts in batch.column(0).to_pylist():
                state = START
                for p in parts:
                    taken.append((p["part"], p["seq"], state))
                    state = p["ends"][state]
            if taken:
                yield _columns(taken, [("part", pa.int64()), ("seq", pa.int64()), ("state", pa.int32())])

    taken = steps.select("s").mapInArrow(joined_up, "part long, seq long, state int")
    audits = ways.join(taken, ["part", "seq"]).select("part", "seq", F.get("edits", F.col("state")).alias("audit"))
    return audits, chained.drop("places")


def plan_repairs(rows):
    """(plan, reports): edits by segment (conv_id, turn, key, part, seq, audit), which stand before the
    segment's first row, and a row of counts and cost for each conversation that has rows."""
    found = stage(segments(judged(rows)), "segments")
    audits, joined = join_open(found)
    numbers = ["conv_id", *STATS, "turns", "low", "high", "cost"]
    reports = found.filter("not open").select(numbers).unionByName(joined.select(numbers))
    shape = ["conv_id", "turn", "key", "part", "seq", "audit"]
    opened = found.filter("open").drop("audit").join(audits, ["part", "seq"]).select(shape)
    return found.filter("not open").select(shape).union(opened), reports


def _ordered(rows, plan, reports):
    """Reports, edits and rows of each conversation in one stream, sorted by their places."""
    # Of all that has the same place the kind decides: report, edits, rows.
    kind = lambda n: F.lit(n).alias("kind")
    given = rows.select("conv_id", "turn", "key", kind(2), "copies", "role", "text")
    edits = plan.select("conv_id", "turn", "key", kind(1), F.lit(0).alias("copies"), F.lit("").alias("role"), F.col("audit").alias("text"), "part", "seq")
    heads = reports.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("key"), kind(0))
    both = heads.unionByName(edits, allowMissingColumns=True).unionByName(given, allowMissingColumns=True)
    # A null turn's digest comes after the empty one of the report.
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "key", "kind", "part", "seq")
    return both.select("conv_id", "turn", "kind", F.col("copies").cast("bigint").alias("copies"), "role", "text")


class _Replay:
    """Edits of a conversation applied to its rows as they come."""

    def __init__(self):
        self.state, self.waiting, self.at = START, [], 0

    def edits(self, text):
        self.waiting.append(text)

    def _next(self):
        while self.waiting and self.at == len(self.waiting[0]):
            self.waiting.pop(0)
            self.at = 0
        return self.waiting[0][self.at] if self.waiting else ""

    def inserted(self):
        while self._next() == "I":
            self.at += 1
            self.state = AFTER[self.state]
            yield "I", ROLES[self.state], ""

    def row(self, role, text):
        yield from self.inserted()
        letter = self._next()
        self.at += 1
        if letter == "R":
            self.state = AFTER[self.state]
            role = ROLES[self.state]
        elif letter == "K":
            self.state = KEEPS[self.state][INITIALS.find(role[:1])]
        yield letter, role, text


def _replayed(batches):
    """(conversation, edit, turn, role, text) of the rows in order; edit is None where a conversation begins."""
    conv, replay = None, None
    for batch in batches:
        for c, turn, kind, copies, role, text in zip(*(x.to_pylist() for x in batch.columns)):
            if kind == 0:
                if replay is not None:
                    yield from ((conv, e, None, r, t) for e, r, t in replay.inserted())
                conv, replay = c, _Replay()
                yield conv, None, None, None, None
            elif kind == 1:
                replay.edits(text)
            else:
                for _ in range(copies):
                    yield from ((conv, e, None if e == "I" else turn, r, t) for e, r, t in replay.row(role, text))
    if replay is not None:
        yield from ((conv, e, None, r, t) for e, r, t in replay.inserted())


def _written(rows, names, size=2000):
    """Arrow batches of rows, a tuple of (name, type) giving the columns."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _columns(held, names)
            held = []
    if held:
        yield _columns(held, names)


def _columns(held, names):
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, (_, t) in zip(zip(*held), names)], [n for n, _ in names])


def _conv(df):
    kind = df.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return kind.simpleString(), to_arrow_type(kind)


def repaired_rows(rows):
    """(conv_id, place, edit, turn, role, text) of the repaired conversations; inserted rows have no turn."""
    rows = stage(readable(rows), "judged")
    kind, arrow = _conv(rows)

    def numbered(batches):
        place = 0
        for conv, edit, turn, role, text in _replayed(batches):
            if edit is None:
                place = 0
            elif edit != "D":
                yield conv, place, edit, turn, role, text
                place += 1

    names = [("conv_id", arrow), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    return _ordered(rows, *plan_repairs(rows)).mapInArrow(
        lambda b: _written(numbered(b), names), f"conv_id {kind}, place long, edit string, turn long, role string, text string"
    )


def repair_reports(rows):
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_rows) of every
    conversation, also of those all of whose rows have no copies."""
    every = rows.select("conv_id").distinct()
    rows = stage(readable(rows), "judged")
    kind, arrow = _conv(rows)
    plan, reports = plan_repairs(rows)
    reports = stage(reports, "reports")

    def summed(batches):
        conv, audit, digest, first = None, [], None, True
        for c, edit, _, role, text in _replayed(batches):
            if edit is None:
                if digest is not None:
                    yield conv, "".join(audit), digest.hexdigest()
                conv, audit, digest, first = c, [], hashlib.sha256(), True
                continue
            audit.append(edit)
            if edit != "D":
                digest.update((("" if first else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                first = False
        if digest is not None:
            yield conv, "".join(audit), digest.hexdigest()

    names = [("conv_id", arrow), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    done = _ordered(rows, plan, reports).mapInArrow(
        lambda b: _written(summed(b), names), f"conv_id {kind}, audit string, repaired_sha256 string"
    )
    done = done.withColumnRenamed("conv_id", "_done")
    reports = reports.withColumnRenamed("conv_id", "_report")
    out = every.join(reports, F.col("conv_id").eqNullSafe(F.col("_report")), "left")
    out = out.join(done, F.col("conv_id").eqNullSafe(F.col("_done")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("bigint").alias("gaps")
    return out.select(
        "conv_id", gaps, zero("blank"), zero("duplicate"), zero("truncated"), zero("illegal"), zero("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        zero("rows").alias("n_rows"),
    )
