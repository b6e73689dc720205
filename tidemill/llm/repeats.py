"""Exact repeats of `length` units over all documents by seed and extend (operators 8 and 4).

1. anchors    a window of `length` units names as its anchors the least of the hashes of its `gram`-unit grams, so equal
              windows name anchors at equal places. An anchor's context is what windows that hold it can reach.
2. classes    occurrences of repeated anchors are counted by anchor and context (64 bits of XXH3 beside the anchor's own 64).
              In a class that stands twice every window is repeated; a class stands for its copies from here on.
3. extension  the classes of an anchor are joined with the anchor's leader, the class with most copies. Each is extended
              both ways against the leader's text; a match of `length` or more is a maximal repeat.
4. descent    what a class has beyond its match with the leader can still be shared with classes that differ from the
              leader at the same unit in the same way. These form groups of their own with longer seeds and go to step 3.
5. cut        all stretches of a class hold its anchor, so together they are one; they are laid over each document and
              removed in one go.

With `rounds`, groups that are open after so many rounds are not followed further: the suffixes of their contexts are sorted by
induction (see induced), and windows are equal where neighbours share `length` bytes.

Nothing is compared in pairs but with a leader. An anchor of over `crowd` classes is dealt out in parts of about that size,
each with the leader's text; its groups of step 4 form anew over all parts. Grams are hashed for speed only: windows are
equal because their text is, or because XXH3 over the whole context of one and the same anchor is.
"""

from __future__ import annotations

import pickle
import tempfile
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidemill.llm.common import Bitmap, Rolling, byte_texts, discard, joined_words, mixed, release, written
from tidemill.llm.induced import repeats

#: Rows of a record batch that is built in numpy.
ROWS = 1 << 16
#: Repeated anchors up to which their bit table (32 MB at most) is sent to the tasks; more are joined with the occurrences.
TABLED = 1 << 25


def least(values: np.ndarray, window: int) -> np.ndarray:
    """The least of each window of that many values, from block-wise running minima."""
    n = len(values)
    padded = np.full(-(-n // window) * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - window + 1], ahead[window - 1 : n])


@dataclass
class Plan:
    """What a repeat is: `unit` is "word" or "byte". Texts are hashed in pieces of `piece` units, which bounds a task's memory."""

    unit: str
    length: int
    gram: int
    piece: int = 1 << 19
    crowd: int = 4096
    rounds: int = 0
    hashes: Rolling = field(default_factory=lambda: Rolling(11))

    @property
    def reach(self) -> int:
        """Units that a window can hold before its anchor."""
        return self.length - self.gram

    def units(self, text: bytes):
        """Bytes, and the start and end of each unit (None where units are bytes)."""
        if self.unit == "byte":
            return text, None, None
        return joined_words(text)

    def spots(self, data: bytes, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of every gram that is the least of some window; mixed anew, as least hashes are all small ones."""
        raw = np.frombuffer(data, np.uint8)
        n, gram, wide = len(raw) if starts is None else len(starts), self.gram, self.reach + 1
        places, values = [], []
        for at in range(0, n - self.length + 1, self.piece):
            stop = min(n, at + self.piece + self.length - 1)
            if starts is None:
                prefix = self.hashes.prefix(raw[at:stop])
                grams = mixed((prefix[gram:] - prefix[:-gram]) * self.hashes.inverse[: stop - at - gram + 1])
            else:
                low = starts[at]
                prefix = self.hashes.prefix(raw[low : ends[stop - 1]])
                grams = self.hashes.ranges(prefix, starts[at : stop - gram + 1] - low, ends[at + gram - 1 : stop] - low)
            low = np.full(len(grams) + wide - 1, np.uint64(0xFFFFFFFFFFFFFFFF))
            low[wide - 1 : len(grams)] = ~least(grams, wide)
            named = np.flatnonzero(~least(low, wide) == grams)  # the largest of the minima of the windows that hold a gram
            places.append(named + at)
            values.append(grams[named])
        if len(places) < 2:
            return (places[0], mixed(values[0])) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        spots, first = np.unique(np.concatenate(places), return_index=True)
        return spots, mixed(np.concatenate(values)[first])

    def bounds(self, spots: np.ndarray, data: bytes, starts, ends):
        """Units before the anchor in its context, and the first, anchor's and last byte of the context."""
        low = np.maximum(spots - self.reach, 0)
        high = np.minimum(spots + self.length, len(data) if starts is None else len(starts))
        if starts is None:
            return spots - low, low, spots, high
        return spots - low, starts[low], starts[spots], ends[high - 1]

    def classes(self, spots: np.ndarray, data: bytes, starts, ends) -> np.ndarray:
        """A hash of each anchor's context and of where the anchor stands in it."""
        left, low, _, high = self.bounds(spots, data, starts, ends)
        digest, view = xxhash.xxh3_64_intdigest, memoryview(data)
        found = (digest(view[a:b], s) for a, b, s in zip(low.tolist(), high.tolist(), left.tolist()))
        return np.fromiter(found, np.uint64, len(left)).view(np.int64)

    def matched(self, one: "Member", two: "Member") -> tuple[int, int]:
        """Units that two contexts share before the anchor, and from it on."""
        before, after = _shared(one.before, two.before, "little"), _shared(one.after, two.after, "big")
        if self.unit == "byte":
            return before, after
        whole = _ends(one.before, len(one.before) - before - 1) and _ends(two.before, len(two.before) - before - 1)
        left = one.before[len(one.before) - before :].count(b" ") - (before > 0 and not whole)
        return left, one.after[:after].count(b" ") + (_ends(one.after, after) and _ends(two.after, after))


def _shared(one: bytes, two: bytes, order: str) -> int:
    """Bytes that two strings share at their beginnings (order big) or ends (little)."""
    n = min(len(one), len(two))
    if order == "big":
        differ = int.from_bytes(one[:n], "big") ^ int.from_bytes(two[:n], "big")
    else:
        differ = int.from_bytes(one[len(one) - n :], "little") ^ int.from_bytes(two[len(two) - n :], "little")
    return n - (differ.bit_length() + 7) // 8


def _ends(text: bytes, at: int) -> bool:
    """Whether a word cannot go on at this place."""
    return at < 0 or at >= len(text) or text[at] == 32


class Member:
    """A class of an anchor: its context, and the windows of it that are open.

    Open are the windows that hold `low` units before the anchor and `high` from it on, and reach no further than `left`
    units before it and `right` from it on.
    """

    __slots__ = ("key", "copies", "before", "after", "low", "high", "left", "right")

    def __init__(self, key, copies, before, after, low, high, left, right):
        self.key, self.copies, self.before, self.after = key, copies, before, after
        self.low, self.high, self.left, self.right = low, high, left, right

    def unit(self, plan: Plan, at: int) -> bytes:
        """The unit `at` places from the anchor, which is 0."""
        if plan.unit == "byte":
            return self.after[at : at + 1] if at >= 0 else self.before[len(self.before) + at :][:1]
        return self.after.split(b" ")[at] if at >= 0 else self.before.split(b" ")[at - 1]


def extend(plan: Plan, leader: Member, members: list[Member]):
    """(member, left, right) of each maximal repeat with the leader, and (side, place, unit, member) of what stays open.

    A window that is open in a member and not in its match goes on past it to the right, or else to the left.
    """
    repeats, rest = [], []
    for one in members:
        left, right = plan.matched(leader, one)
        left, right = min(left, plan.reach), min(right, plan.length)
        if left + right >= plan.length:
            repeats.append((one, left, right))
        high = max(one.high, right + 1)
        if right < one.right and max(one.low, plan.length - one.right) <= min(one.left, plan.length - high):
            rest.append(("r", right, one.unit(plan, right), Member(one.key, one.copies, one.before, one.after, one.low, high, one.left, one.right)))
        stop = min(right, one.right)
        if left < one.left and max(left + 1, plan.length - stop) <= min(one.left, plan.length - one.high):
            rest.append(("l", left, one.unit(plan, -left - 1), Member(one.key, one.copies, one.before, one.after, left + 1, one.high, one.left, stop)))
    return repeats, rest


def led(plan: Plan, group: list[Member]):
    """The maximal repeats of a group with its leader, as (member, left, right), and the groups that are left open."""
    leader = max(group, key=lambda m: m.copies)
    found, rest = extend(plan, leader, [m for m in group if m is not leader])
    if found:
        found.append((leader, max(left for _, left, _ in found), max(right for _, _, right in found)))
    groups = defaultdict(list)
    for side, at, unit, member in rest:
        groups[side, at, unit].append(member)
    return found, [g for g in groups.values() if len(g) > 1]


def settle(plan: Plan, members: list[Member]) -> tuple[list, list[list[Member]]]:
    """The maximal repeats, as (member, left, right), of a group whose members all share its seed, and the groups still open after plan.rounds."""
    found, groups, n = [], [members], 0
    while groups and not (plan.rounds and n == plan.rounds):
        now, groups = groups, []
        for group in now:
            more, rest = led(plan, group)
            found += more
            groups += rest
        n += 1
    return found, groups


class Shard:
    """Contexts that a task sorts the suffixes of: their texts on disk, keys and places of their anchors in memory."""

    def __init__(self, plan: Plan):
        self.plan, self.keys, self.left, self.file = plan, [], [], tempfile.TemporaryFile()

    def add(self, groups: list[list[Member]]) -> None:
        """The members of an anchor's open groups, each once."""
        for member in {m.key: m for g in groups for m in g}.values():
            self.keys.append(member.key)
            self.left.append(len(member.before))
            pickle.dump(member.before + member.after, self.file, 5)

    def texts(self):
        self.file.seek(0)
        for _ in self.keys:
            yield pickle.load(self.file)

    def stretches(self):
        """anchor, c, left, right: windows of one anchor, at one place from it, that two classes share."""
        marks: dict[int, int] = defaultdict(int)
        for run in repeats(self.texts(), self.plan.length):
            same = defaultdict(set)
            for number, place in run:
                off = self.left[number] - place
                if 0 <= off <= self.plan.reach:
                    same[self.keys[number][0], off].add(number)
            for (_, off), numbers in same.items():
                if len({self.keys[n] for n in numbers}) > 1:
                    for n in numbers:
                        marks[n] |= 1 << off
        for n, bits in marks.items():
            yield (*self.keys[n], bits.bit_length() - 1, self.plan.length - (bits & -bits).bit_length() + 1)


KEYS = "d bigint, mark bigint"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and d and mark, which tell apart rows that differ in either; never null."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("d"), F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias("mark"))


def _anchors(docs: DataFrame, plan: Plan) -> DataFrame:
    """Anchors that stand at more than one place."""

    def run(batches):
        def counted(held):
            values, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times > 1)], ["anchor", "many"])

        held, size = [], 0
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                _, values = plan.spots(*plan.units(text))
                held.append(values)
                size += len(values)
                if size >= 1 << 20:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    found = docs.select("text").mapInArrow(run, "anchor bigint, many boolean")
    return found.groupBy("anchor").agg((F.max("many") | (F.count("*") > 1)).alias("many")).filter("many").select("anchor")


def _occurrences(docs: DataFrame, plan: Plan, repeated) -> DataFrame:
    """anchor, c (its context), d, mark, at: every place of an anchor that `repeated`, if given, has."""

    def run(batches):
        def batch_of(rows):
            anchors, classes, d, mark, spots = (np.concatenate(x) for x in zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(anchors.view(np.int64)), pa.array(classes), pa.array(d), pa.array(mark), pa.array(spots.astype(np.int32))],
                ["anchor", "c", "d", "mark", "at"],
            )

        known = repeated.value if repeated is not None else None
        rows, size = [], 0
        for batch in batches:
            for d, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2))):
                data, starts, ends = plan.units(text)
                spots, values = plan.spots(data, starts, ends)
                if known is not None:
                    keep = known.has(values)
                    spots, values = spots[keep], values[keep]
                for low in range(0, len(spots), ROWS):
                    s = slice(low, low + ROWS)
                    n = len(spots[s])
                    rows.append((values[s], plan.classes(spots[s], data, starts, ends), np.full(n, d), np.full(n, mark), spots[s]))
                    size += n
                    if size >= ROWS:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return docs.select("d", "mark", "text").mapInArrow(run, f"anchor bigint, c bigint, {KEYS}, at int")


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """Texts compressed before they are shuffled."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([pack(t) for t in byte_texts(batch.column(batch.num_columns - 1))], pa.binary())], [*names, "text"])

    kept = docs.select(*names, "text")
    return kept.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", text binary")


MEMBER = "anchor bigint, c bigint, copies bigint, before binary, after binary, low int, high int, left int, right int"


def _members(docs: DataFrame, plan: Plan, classes: DataFrame) -> DataFrame:
    """classes (how many its anchor has), lead, and the columns of MEMBER for each class of an anchor with several."""
    leads = classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.max_by("c", F.struct("copies", "c")).alias("l")).filter("classes > 1")
    opened = classes.join(leads, "anchor").select("anchor", "classes", (F.col("c") == F.col("l")).alias("lead"), "c", "copies", "place.d", "place.mark", "place.at")
    wanted = opened.groupBy("d", "mark").agg(F.collect_list(F.struct("at", "classes", "lead", "anchor", "c", "copies")).alias("spots"))
    names = ["classes", "lead", "anchor", "c", "copies"]

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for text, held in zip(batch.column(0), batch.column(1)):
                data, starts, ends = plan.units(unpack(text.as_py()))
                fields = held.values
                spots = fields.field("at").to_numpy()
                for at in range(0, len(spots), 1 << 12):
                    s = slice(at, at + (1 << 12))
                    left, low, mid, high = plan.bounds(spots[s], data, starts, ends)
                    n = len(left)
                    right = np.minimum(plan.length, (len(data) if starts is None else len(starts)) - spots[s])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[fields.field(x).slice(at, n) for x in names],
                            pa.array([data[a:b] for a, b in zip(low.tolist(), mid.tolist())], pa.binary()),
                            pa.array([data[a:b] for a, b in zip(mid.tolist(), high.tolist())], pa.binary()),
                            pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, plan.gram, np.int32)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)),
                        ],
                        [*names, "before", "after", "low", "high", "left", "right"],
                    )

    joined = _packed(docs, "d", "mark").join(wanted, ["d", "mark"]).select("text", "spots")
    return joined.mapInArrow(run, f"classes bigint, lead boolean, {MEMBER}")


STRETCH = "l int, r int"


def _extended(members: DataFrame, plan: Plan, group: list[str]) -> DataFrame:
    """anchor, c, l, r of maximal repeats; and MEMBER with a group (g1, g2) for what crowded groups leave open."""
    parts = F.ceil(F.col("classes") / plan.crowd).cast("int")
    salt = F.when(F.col("lead"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("c", "anchor"), parts).cast("int")))
    dealt = members.withColumns({"part": F.explode(salt)}).repartition(*group, "part").sortWithinPartitions(*group, "part", F.desc("lead"), "anchor", "c")
    names = [f.split()[0] for f in MEMBER.split(", ")]
    kept = dealt.select(*[F.col(g).alias(f"__{g}") for g in group], "part", "classes", *names)

    def run(batches):
        stretches, opened, shard = [], [], Shard(plan)

        def kept(found):
            """One stretch for each class that stands once; a class that stands twice is repeated as a whole anyway."""
            wide: dict[tuple, tuple] = {}
            for member, left, right in found:
                if member.copies == 1:
                    low, high = wide.get(member.key, (0, 0))
                    wide[member.key] = max(low, left), max(high, right)
            stretches.extend((*key, *reach) for key, reach in wide.items())

        def closed(key, members):
            if len(members) < 2:
                return
            if key[-1] <= plan.crowd:
                found, rest = settle(plan, members)
                shard.add(rest)
                kept(found)
                return
            leader = members[0]
            found, rest = extend(plan, leader, members[1:])
            if found:
                found.append((leader, max(left for _, left, _ in found), max(right for _, _, right in found)))
            kept(found)
            for side, at, unit, m in rest:
                name = xxhash.xxh3_128_digest(repr((key[: len(group)], side, at, unit)).encode())
                opened.append((*np.frombuffer(name, "<i8").tolist(), *m.key, m.copies, m.before, m.after, m.low, m.high, m.left, m.right))

        def batch_of():
            shape = [("anchor", 0), ("c", 1), ("l", 2), ("r", 3)]
            blank = len(stretches), len(opened)
            column = lambda rows, i, kind: pa.array([x[i] for x in rows], kind)
            types = dict(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int32()] * 4)))
            out = {k: pa.concat_arrays([column(stretches, i, pa.int64() if i < 2 else pa.int32()), column(opened, i + 2, pa.int64()) if i < 2 else pa.nulls(blank[1], pa.int32())]) for k, i in shape}
            for i, k in enumerate(("g1", "g2")):
                out[k] = pa.concat_arrays([pa.nulls(blank[0], pa.int64()), column(opened, i, pa.int64())])
            for i, k in enumerate(names[2:], 4):
                out[k] = pa.concat_arrays([pa.nulls(blank[0], types[k]), column(opened, i, types[k])])
            stretches.clear(), opened.clear()
            return pa.RecordBatch.from_arrays(list(out.values()), list(out))

        current, members = None, []
        wide = len(group) + 2
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:wide] != current:
                    closed(current, members)
                    current, members = row[:wide], []
                    if len(stretches) + 8 * len(opened) >= ROWS:
                        yield batch_of()
                anchor, c, *rest = row[wide:]
                members.append(Member((anchor, c), *rest))
        closed(current, members)
        for stretch in shard.stretches():
            stretches.append(stretch)
            if len(stretches) >= ROWS:
                yield batch_of()
        yield batch_of()

    return kept.mapInArrow(run, f"anchor bigint, c bigint, l int, r int, g1 bigint, g2 bigint, {MEMBER.split(', ', 2)[2]}")


def _stretches(docs: DataFrame, plan: Plan, classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """anchor, c, l, r: the repeated stretch of each class, as units before its anchor and from it on; and the tables it reads."""
    whole = classes.filter("copies > 1").select("anchor", "c", F.lit(plan.reach).alias("l"), F.lit(plan.length).alias("r"))
    found = [written(_extended(_members(docs, plan, classes), plan, ["anchor"]), "extended")]
    while not (rest := found[-1].filter("l is null")).isEmpty():
        groups = rest.groupBy("g1", "g2").agg(F.count("*").alias("classes"), F.max_by(F.struct("anchor", "c"), F.struct("copies", "anchor", "c")).alias("h")).filter("classes > 1")
        lead = ((F.col("anchor") == F.col("h.anchor")) & (F.col("c") == F.col("h.c"))).alias("lead")
        members = rest.join(groups, ["g1", "g2"]).select("g1", "g2", "classes", lead, *[f.split()[0] for f in MEMBER.split(", ")])
        found.append(written(_extended(members, plan, ["g1", "g2"]), "extended"))
    every = whole
    for table in found:
        every = every.unionByName(table.filter("l is not null").select("anchor", "c", "l", "r"))
    return every.groupBy("anchor", "c").agg(F.max("l").alias("l"), F.max("r").alias("r")), found


def _listed(spans: DataFrame) -> DataFrame:
    """d, mark and spans: the distinct spans of each document, put together from rows in order rather than in hash tables."""

    def run(batches):
        def batch_of(keys, lists):
            ends = np.cumsum([0, *map(len, lists)])
            flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["d", "mark", "spans"])

        key, held = None, []
        for batch in batches:
            d, mark, s = (c.to_numpy() for c in batch.columns)
            change = np.concatenate(([0], np.flatnonzero((d[1:] != d[:-1]) | (mark[1:] != mark[:-1])) + 1, [len(d)])) if len(d) else [0]
            keys, lists = [], []
            for low, high in zip(change[:-1], change[1:]):
                now = int(d[low]), int(mark[low])
                if now != key:
                    if held:
                        keys.append(key)
                        lists.append(np.unique(np.concatenate(held)))
                    key, held = now, []
                held.append(np.unique(s[low:high]))
                if len(held) > 64:  # a document of very many rows, or one repeated very often
                    held = [np.unique(np.concatenate(held))]
            yield batch_of(keys, lists)
        if held:
            yield batch_of([key], [np.unique(np.concatenate(held))])

    dealt = spans.repartition("d", "mark").sortWithinPartitions("d", "mark")
    return dealt.mapInArrow(run, f"{KEYS}, spans array<bigint>")


def cut_repeats(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept (the text left): every unit in a repeated window removed, in one go.

    Null and empty texts have no windows and come out whole. Rows with one doc_id are texts of their own; a repeated row
    repeats every window it has. Other columns of `docs` are ignored, whatever their names. Copies are judged on the
    input alone. Words kept are joined by one space; bytes kept are concatenated.
    """
    spark = docs.sparkSession
    docs = keyed(docs)
    anchors = written(_anchors(docs, plan), "anchors")
    count = anchors.count()
    if count <= TABLED:
        places = _occurrences(docs, plan, spark.sparkContext.broadcast(Bitmap.of(anchors, "anchor", count)))
    else:
        places = _occurrences(docs, plan, None).join(anchors, "anchor", "left_semi")
    places = written(places, "places")
    discard(anchors)
    classes = written(places.groupBy("anchor", "c").agg(F.count("*").alias("copies"), F.min(F.struct("d", "mark", "at")).alias("place")), "classes")
    release(spark)
    stretches, tables = _stretches(docs, plan, classes)
    met = places.join(stretches, ["anchor", "c"])
    span = F.shiftleft(F.greatest(F.col("at") - F.col("l"), F.lit(0)).cast("bigint"), 32).bitwiseOR((F.col("at") + F.col("r")).cast("bigint"))  # first unit, and the one after the last
    spans = written(_listed(met.select("d", "mark", span.alias("s"))), "spans")
    discard(places, classes, *tables)
    release(spark)
    joined = _packed(docs, "doc_id", "d", "mark").join(spans, ["d", "mark"], "left").select("doc_id", "text", "spans")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for text, held in zip(batch.column(1), batch.column(2)):
                text = unpack(text.as_py())
                data, starts, ends = plan.units(text)
                n = len(data) if starts is None else len(starts)
                turn = np.zeros(n + 1, np.int64)
                if held.is_valid:
                    ends_of = held.values.to_numpy()
                    turn += np.bincount(ends_of >> 32, minlength=n + 1) - np.bincount(np.minimum(ends_of & 0xFFFFFFFF, n), minlength=n + 1)
                gone = np.cumsum(turn[:n]) > 0
                removed = int(np.count_nonzero(gone))
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(n > 0 and gone[0])
                if not removed:
                    kept = data
                elif starts is None:
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                else:
                    kept = b" ".join(data[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist()))
                out.append((n, removed, spans, kept))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())],
                ["doc_id", "n_units", "n_removed", "n_spans", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_units bigint, n_removed bigint, n_spans bigint, kept binary")
