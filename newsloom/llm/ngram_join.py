"""N-gram Jaccard join of all documents with themselves, by prefix trees.

Which sets can link: put all n-grams into one order. Two sets that link share a member among the
first n - ceil(n p / 100) + 1 of each (its prefix). The order is: n-grams whose hash lies in a fixed
lower range come first, rare before common as counted over all sets; then all others, rare before
common as counted over the sets that have too few members in the lower range to fill their prefix.
Only those sets, which are short, have prefix members of the second kind, so nothing else of it is
counted, and a passage that many documents share is no part of a prefix unless a document has little
else. Sets that share a prefix member get into one cluster, over its smallest document, and so on
transitively; this loses no link. Equal sets count once from the start.

The join: in a cluster, packs of sets are stored in a prefix tree, in an order of their members
that all sets of the tree share (most frequent first, so near copies share long paths). A pack's own
sets go down its tree, and those of the cluster's other sets that share a prefix member with a set of
the pack whose size and component leave a link open. They go in batches; the overlap along a shared
path is counted once, and a subtree is left when its remaining length cannot bring any of its sets to
the needed overlap, or when it holds only sets of the same component. What comes out are links that
connect; a link between sets already connected is not searched for. Packs are of bounded members. A
cluster, however large, is dealt over tasks in salted slices, which meet a pack in a stream; its
largest component needs no packs, so a group of copies takes as many rounds as it has sets outside
that component, in packs.

Defined results: null text, empty text and texts without words have an empty set and link with
nothing; fewer words than n make one member; rows with a null doc_id have a size but no component;
rows that repeat a doc_id each have the component of their own text; where a doc_id is the smallest of
two texts' classes, these count as linked; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.llm.common import broadcast_if_small, parts_of, written
from newsloom.llm.components import components, components_of_few
from newsloom.settings import discard, release

U64 = np.uint64

#: Bytes of text whose sets a worker holds at a time.
SPAN_BYTES = 1 << 20


@dataclass(frozen=True)
class JoinOptions:
    """Links from `percent` of similarity on; sets of `words`-grams. `counted` is the share of n-grams that
    is counted in all sets, in tenths of the share that prefixes have: the more, the more common
    members a set can leave out; long n-grams are rarely common. The rest bounds a task's memory."""

    words: int = 3
    percent: int = 90
    counted: int = 18
    pack_sets: int = 256
    pack_members: int = 1_000_000
    slice_members: int = 4_000_000
    slice_sets: int = 1024
    packs_per_round: int = 16

    def prefix(self, n: int) -> int:
        return n - -(-n * self.percent // 100) + 1

    @property
    def lower(self) -> int:
        """End of the hash range that is counted in all sets."""
        return min((1 << 64) - 1, (100 - self.percent) * self.counted * (1 << 64) // 1000)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift), applied to hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ U64(salt)) * U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


class Shingler:
    """Distinct n-gram hashes of texts, ascending, of all texts of a batch at once.

    A word's hash is the sum of its letters' numbers times powers of an odd base, which running sums over
    all letters give for every word in a few steps; mixing follows where words make n-grams.
    """

    #: Letters whose running sums are held together, unless one word is longer.
    block = 1 << 18
    base = 0x9E3779B97F4A7C15
    blanks = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
    # A number for each byte; A-Z count as a-z.
    letters = mixed(np.where(np.isin(np.arange(256), np.arange(65, 91)), np.arange(256) + 32, np.arange(256)).astype(U64) + U64(1), 5)

    def __init__(self, words: int):
        self.words = words
        self._powers = self._inverse = np.ones(1, U64)

    def _ready(self, size: int) -> None:
        """Powers of the base and of its inverse for blocks of so many letters."""
        if len(self._powers) < size:
            powers = [np.full(size, base, U64) for base in (self.base, pow(self.base, -1, 1 << 64))]
            for p in powers:
                p[0] = 1
            with np.errstate(over="ignore"):
                self._powers, self._inverse = (np.cumprod(p, dtype=U64) for p in powers)

    def _words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of texts that lie one after another in data, and how many words each text has. ends: of the texts."""
        word = ~self.blanks[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        # A text's ends also end its words.
        sizes = np.diff(ends, prepend=0)
        begins, stops = (ends - sizes)[sizes > 0], ends[sizes > 0]
        first[begins], last[stops - 1] = word[begins], word[stops - 1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes, done = np.empty(len(starts), U64), 0
        with np.errstate(over="ignore"):
            while done < len(starts):
                low = int(starts[done])
                end = max(done + 1, int(np.searchsorted(stops, low + self.block, "right")))
                size = int(stops[end - 1]) - low
                self._ready(size)
                sums = np.zeros(size + 1, U64)
                np.cumsum(self.letters[data[low : low + size]] * self._powers[:size], out=sums[1:])
                own = starts[done:end] - low
                hashes[done:end] = (sums[stops[done:end] - low] - sums[own]) * self._inverse[own]
                done = end
        return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)

    def _grams(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n words from each word on."""
        with np.errstate(over="ignore"):
            grams = np.full(len(hashes) - n + 1, n, U64)
            for i in range(n):
                grams = grams * U64(0x100000001B3) + mixed(hashes[i : len(hashes) - n + 1 + i], i + 1)
        return mixed(grams, 77)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The members of all texts one after another, and where each text's begin, with the end. Null reads as empty."""
        # Arrow's bytes as they are: only A-Z count as letters with two cases, only \x20 and \x09-\x0D as blanks.
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        _, places, letters = texts.buffers()
        places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(letters, np.uint8)[places[0] : places[-1]] if letters is not None else np.zeros(0, np.uint8)
        hashes, counts = self._words(data, places[1:] - places[0])
        n = self.words
        sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        to = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        members = np.empty(to[-1], U64)
        short = (counts > 0) & (counts < n)
        long = np.ones(len(members), bool)
        long[to[:-1][short]] = False
        if len(hashes) >= n:
            whole = np.ones(len(hashes) - n + 1, bool)
            for i in range(1, n):
                cut = ends[counts >= i] - i
                whole[cut[cut < len(whole)]] = False
            members[long] = self._grams(hashes, n)[whole]
        for k in range(1, n):
            of = np.flatnonzero(counts == k)
            at = (ends[of] - k)[:, None] + np.arange(k)
            members[to[of]] = self._grams(hashes[at.ravel()], k)[::k] if len(of) else members[:0]
        for start, end in zip(to[:-1].tolist(), to[1:].tolist()):
            members[start:end].sort()
        new = np.ones(len(members), bool)
        new[1:] = members[1:] != members[:-1]
        new[to[:-1][sizes > 0]] = True
        return members[new], np.concatenate([[0], np.cumsum(summed(new, to, np.int64))])


def summed(values: np.ndarray, places: np.ndarray, kind: type) -> np.ndarray:
    """Sums of the values between each place and the next; 0 where nothing lies between."""
    sums = np.zeros(len(places) - 1, kind)
    filled = np.flatnonzero(np.diff(places))
    if len(filled):
        sums[filled] = np.add.reduceat(values, places[filled], dtype=kind)
    return sums


def fingerprints(members: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that tell sets apart, for the sets that lie between the places."""
    return summed(mixed(members, 3), places, U64).view(np.int64), summed(mixed(members, 4), places, U64).view(np.int64)


def _lists(members: np.ndarray, places: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept members of each set as a list column."""
    ends = np.cumsum(summed(kept, places, np.int64))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(members[kept].view(np.int64)))


def text_hash() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string")).alias("text_hash")


def counted_sets(docs: DataFrame, options: JoinOptions) -> DataFrame:
    """doc_id, text_hash, n_shingles, f1 and f2 (what identifies the set), low (its n-grams of the lower range), more (all others, where the lower range does not fill its prefix)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, end = Shingler(options.words), U64(options.lower)
        for batch in parts_of(batches, 2, SPAN_BYTES):
            members, places = shingle(batch.column(2))
            sizes = np.diff(places)
            low = members < end
            unfilled = (sizes > 0) & (summed(low, places, np.int64) < options.prefix(sizes))
            more = ~low & np.repeat(unfilled, sizes)
            out = [batch.column(0), batch.column(1), pa.array(sizes), *map(pa.array, fingerprints(members, places)), _lists(members, places, low), _lists(members, places, more)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "text_hash", "n_shingles", "f1", "f2", "low", "more"])

    schema = f"doc_id {kind}, text_hash bigint, n_shingles bigint, f1 bigint, f2 bigint, low array<bigint>, more array<bigint>"
    return docs.select("doc_id", text_hash(), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def member_sets(docs: DataFrame, wanted: DataFrame, options: JoinOptions) -> DataFrame:
    """rep, cluster, n, members (bytes of ascending 64-bit hashes) of the wanted sets (rep, cluster, n, f1, f2), as a written table."""
    count = wanted.count()
    side = broadcast_if_small(wanted.withColumnRenamed("rep", "doc_id"), count, 64)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(side, "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(options.words)
        for batch in parts_of(batches, 1, SPAN_BYTES):
            members, places = shingle(batch.column(1))
            f1, f2 = fingerprints(members, places)
            fits = (np.diff(places) > 0) & (f1 == batch.column(4).to_numpy()) & (f2 == batch.column(5).to_numpy())
            names = ["rep", "cluster", "n", "members"]
            sets = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((places * 8).astype(np.int32)), pa.py_buffer(members)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), sets], names=names).filter(pa.array(fits))

    found = texts.select("doc_id", "text", "cluster", "n", "f1", "f2").mapInArrow(run, f"rep {kind}, cluster {kind}, n bigint, members binary")
    found = written(found, "member-sets")
    if found.count() <= count:
        return found
    # Rows repeat a doc_id and its text.
    single = written(found.dropDuplicates(["rep", "n", "members"]), "member-sets")
    discard(found)
    return single


# --- prefix trees -----------------------------------------------------------------------------


class PrefixTree:
    """A compressed trie of sets, each a path of member ranks."""

    def __init__(self, sets: list[np.ndarray], groups: list):
        universe, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(universe), np.int64)
        rank[np.lexsort((universe, -counts))] = np.arange(len(universe))
        self.universe, self.rank = universe, rank
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        paths = [np.sort(p) for p in np.split(rank[which], cuts)]
        order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">i4").tobytes())
        self.paths, self.groups = paths, groups
        # Node: [path, first step, end step, children, set numbers that end here, shortest, longest, group]
        self.root = [paths[order[0]], 0, 0, [], [], 0, 0, None]
        stack, before = [self.root], None
        for i in order:
            path, shared = paths[i], 0
            if before is not None:
                width = min(len(before), len(path))
                differs = np.flatnonzero(before[:width] != path[:width])
                shared = int(differs[0]) if len(differs) else width
            while len(stack) > 1 and stack[-1][1] >= shared:
                stack.pop()
            top = stack[-1]
            if top[2] > shared:  # the edge is longer than what is shared: split it
                rest = [top[0], shared, top[2], top[3], top[4], 0, 0, None]
                top[2], top[3], top[4] = shared, [rest], []
            if shared == len(path):
                top[4].append(i)
            else:
                leaf = [path, shared, len(path), [], [i], 0, 0, None]
                top[3].append(leaf)
                stack.append(leaf)
            before = path
        self._sum_up()

    def _sum_up(self) -> None:
        nodes, waiting = [], [self.root]
        while waiting:
            node = waiting.pop()
            nodes.append(node)
            waiting += node[3]
        for node in reversed(nodes):
            lengths = [len(self.paths[i]) for i in node[4]] + [c[5] for c in node[3]]
            node[5], node[6] = min(lengths), max([len(self.paths[i]) for i in node[4]] + [c[6] for c in node[3]])
            groups = {self.groups[i] for i in node[4]} | {c[7] for c in node[3]}
            node[7] = groups.pop() if len(groups) == 1 else None

    def links(self, members: list[np.ndarray], groups: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
        """(number of the given set, number of the tree's set) of linked pairs in different groups."""
        if not members:
            return
        sizes = np.array([len(m) for m in members])
        flat = np.concatenate(members)
        at = np.minimum(np.searchsorted(self.universe, flat), len(self.universe) - 1)
        known = self.universe[at] == flat
        has = np.zeros((len(self.universe), len(members)), np.uint8)
        has[self.rank[at[known]], np.repeat(np.arange(len(members)), sizes)[known]] = 1
        whole, need = 100 + percent, percent
        waiting = [(self.root, np.arange(len(members)), np.zeros(len(members), np.int64))]
        while waiting:
            node, active, overlap = waiting.pop()
            fits = 100 * sizes[active] >= need * node[5]
            if node[7] is not None:
                fits &= groups[active] != node[7]
            active, overlap = active[fits], overlap[fits]
            if not len(active):
                continue
            if node[2] > node[1]:
                overlap = overlap + has[node[0][node[1] : node[2]]].sum(0, dtype=np.int64)[active]
                # With all that remains of its longest set, does the subtree reach the needed overlap?
                fits = whole * (overlap - node[2]) + (whole - need) * node[6] >= need * sizes[active]
                active, overlap = active[fits], overlap[fits]
            for i in node[4]:
                linked = (whole * overlap >= need * (sizes[active] + len(self.paths[i]))) & (groups[active] != self.groups[i])
                for j in active[linked]:
                    yield int(j), i
            waiting += [(child, active, overlap) for child in node[3]]


def _probe(rows: Iterator[tuple], percent: int, own: bool) -> Iterator[tuple]:
    """Links of one pack's stream: its sets (kind 0) come first, then the sets to look up (kind 1).

    own: the pack's sets are looked up too.

    rows: (kind, rep, group, members). A link comes out as the two sets' groups. Groups that a found link
    connects are joined for the rest of the stream, so at most one link comes out per set and pack member.
    """
    tree, pack, parent = None, [], {}

    def top(x):
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    held: list[tuple] = []
    room = weight = 0

    def flush():
        nonlocal held
        if not held or tree is None:
            held = []
            return
        groups = np.empty(len(held), object)
        groups[:] = [h[1] for h in held]
        for j, i in tree.links([h[2] for h in held], groups, percent):
            a, b = top(held[j][1]), top(pack[i][1])
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield held[j][1], pack[i][1]
        held = []

    def looked_up():
        nonlocal tree, room
        rest = None
        for kind, *row in rows:
            if kind == 1:
                rest = row
                break
            pack.append(row)
        if not pack:
            return
        if rest is None and not own:
            return
        tree = PrefixTree([p[2] for p in pack], [p[1] for p in pack])
        room = max(1, min(256, (32 << 20) // max(1, len(tree.universe))))
        if own:
            yield from pack
        if rest is not None:
            yield rest
            for _, *row in rows:
                yield row

    for row in looked_up():
        held.append(row)
        weight += len(row[2])
        if len(held) >= room or weight >= 4_000_000:
            yield from flush()
            weight = 0
    yield from flush()


def pack_links(stream: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, from rows (pack, salt, kind, rep, comp, members) that come sorted and together by (pack, salt)."""
    kind = stream.schema["rep"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = None

        def rows():
            nonlocal ids
            for batch in batches:
                ids = batch.schema.field("rep").type
                columns = [c.to_pylist() for c in batch.columns[:5]]
                for i, key in enumerate(zip(*columns)):
                    yield key[:2], (key[2], key[3], key[4], np.frombuffer(batch.column(5)[i].as_py(), U64))

        def groups():
            current, buffer = None, rows()
            ahead = next(buffer, None)
            while ahead is not None:
                current = ahead[0]

                def one():
                    nonlocal ahead
                    while ahead is not None and ahead[0] == current:
                        value = ahead[1]
                        ahead = next(buffer, None)
                        yield value

                yield current, one()

        out: list[tuple] = []
        for (_, salt), group in groups():
            for link in _probe(group, percent, salt == 0):
                out.append(link)
                if len(out) >= 50_000:
                    yield made(out, ids)
                    out = []
        if out:
            yield made(out, ids)

    def made(out: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], ids), pa.array([o[1] for o in out], ids)], names=["a", "b"])

    return stream.select("pack", "salt", "kind", "rep", "comp", "members").mapInArrow(run, f"a {kind}, b {kind}")


# --- the join ---------------------------------------------------------------------------------


def _rarest(reps: DataFrame, column: str, room: Column) -> DataFrame:
    """(rep, gram): the members of a list column that take part in prefixes of `room` members and are held by several sets.

    Members held by one set come first in its order and link with nothing; of the others a prefix
    takes the rarest. Counts are aggregated before the shuffle; the join back is an ordinary join,
    which Spark splits where an n-gram is common.
    """
    members = reps.select("rep", F.explode(column).alias("gram"))
    shared = members.groupBy("gram").agg(F.count("*").alias("held_by")).where(F.col("held_by") > 1)
    # Counts are the smaller side: hashed, so that the members need not be sorted to meet them.
    ranked = members.join(shared.hint("shuffle_hash"), "gram").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("held_by", "gram"))).alias("common"))
    rooms = reps.where(F.size(column) > 0).select(F.col("rep").alias("_rep"), (room - F.size(column)).cast("int").alias("_room"))
    kept = ranked.join(rooms, F.col("rep") == F.col("_rep")).withColumn("_room", F.col("_room") + F.size("common")).where(F.col("_room") > 0)
    return kept.select("rep", F.explode(F.slice("common", F.lit(1), F.col("_room"))["gram"]).alias("gram"))


def clusters(reps: DataFrame, options: JoinOptions) -> tuple[DataFrame, DataFrame]:
    """(node, component): sets that share a prefix member, transitively; and (rep, gram, lead) of the shared ones. reps: rep, n, low, more.

    lead: the one of a set's shared members that most sets hold.
    """
    prefix = F.col("n") - F.ceil(F.col("n") * options.percent / 100).cast("long") + 1
    members = written(_rarest(reps, "low", prefix).unionByName(_rarest(reps, "more", prefix - F.size("low"))), "prefixes")
    release(reps.sparkSession)
    hubs = members.groupBy("gram").agg(F.min("rep").alias("hub"), F.max("rep").alias("_last"), F.count("*").alias("_sets")).where(F.col("hub") < F.col("_last"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("_sets"), "gram"))
    held = written(members.join(hubs, "gram").select("rep", "gram", "hub", (place == 1).alias("lead")), "shared-prefixes")
    discard(members)
    edges = held.where(F.col("rep") != F.col("hub")).select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    return components(edges), held


def _meetings(asked: DataFrame, bounds: DataFrame, percent: int, *others: Column) -> DataFrame:
    """(rep, n, cluster, comp, pack_no) for each member that an asked set shares with a pack it may link to. asked: rep, n, cluster, comp, _own, gram."""
    near = (100 * F.col("n") >= percent * F.col("_low")) & (100 * F.col("_high") >= percent * F.col("n"))
    other = (F.col("_c1") != F.col("comp")) | (F.col("_c2") != F.col("comp"))
    later = F.col("_own").isNull() | (F.col("_own") < F.col("pack_no"))
    met = asked.join(bounds, "gram").where(near & other & later)
    for condition in others:
        met = met.where(condition)
    return met.select("rep", "n", "cluster", "comp", "pack_no")


def _routes(waiting: DataFrame, packed: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(rep, n, cluster, comp, pack_no): the packs that hold a set which a waiting set may link to, its own and earlier packs left out; a written table.

    Two sets may link when they share a prefix member, their sizes are near enough and their
    components differ. Of two packs' sets, those of the earlier pack are looked up in the later one.
    Near copies share many members, of which one is enough: a set's lead member goes first, a row for
    each pack at most, and its other members meet only the packs that this one has not found.
    """
    bounds = packed.join(held, "rep").groupBy("gram", "pack_no").agg(F.min("n").alias("_low"), F.max("n").alias("_high"), F.min("comp").alias("_c1"), F.max("comp").alias("_c2"))
    bounds = written(bounds, "join-bounds")
    own = packed.select("rep", "n", F.col("pack_no").alias("_own"))
    asked = waiting.select("rep", "n", "cluster", "comp").join(own, ["rep", "n"], "left")
    first = written(_meetings(asked.join(held.where("lead"), "rep"), bounds, percent), "join-leads")
    found = first.groupBy("rep", "n").agg(F.collect_list("pack_no").alias("_found"))
    rest = asked.join(found, ["rep", "n"], "left").join(held.where(~F.col("lead")), "rep")
    new = F.col("_found").isNull() | ~F.array_contains("_found", F.col("pack_no"))
    routes = written(first.unionByName(_meetings(rest, bounds, percent, new).distinct()), "join-routes")
    discard(bounds, first)
    return routes


def _rounds(sets: DataFrame, held: DataFrame, options: JoinOptions) -> DataFrame:
    """(node, component) of the sets that link to one of a smaller rep. Each round makes packs of the sets that still have to be looked up.

    The state holds every set's component so far, and links are found between components: a round joins
    the components of its own links only, which after the first round are few. Rounds take more and more
    packs of a cluster, as long as the sets meet few of them, so their number grows with its logarithm.
    """
    state_now = written(sets.select("rep", "cluster", "n", F.col("rep").alias("comp"), F.lit(False).alias("done")).distinct(), "join-state")
    total, packs = state_now.count(), 1
    while True:
        state = state_now
        # A cluster goes on while its sets that were in no pack belong to several components.
        open_sets = state.where(~F.col("done"))
        going = open_sets.groupBy("cluster").agg(F.min("comp").alias("_c1"), F.max("comp").alias("_c2")).where(F.col("_c1") < F.col("_c2"))
        going = written(going.select("cluster"), "join-going")
        if not going.take(1):
            discard(going)
            return state.where(F.col("rep") != F.col("comp")).select(F.col("rep").alias("node"), F.col("comp").alias("component")).distinct()
        waiting = written(open_sets.join(going, "cluster").select("rep", "n", "cluster", "comp"), "join-waiting")
        sizes = waiting.groupBy("cluster", "comp").agg(F.count("*").alias("_size"))
        # Small components first: once all sets outside the largest one were in packs, the cluster is through.
        # Among components of one size, sets of near sizes share a pack.
        rank = Window.partitionBy("cluster").orderBy("_size", "n", "comp", "rep")
        most = options.pack_sets * packs
        ranked = waiting.join(sizes, ["cluster", "comp"]).withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= most)
        weight = F.sum("n").over(Window.partitionBy("cluster").orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        number = F.floor((F.col("_rank") - 1) / options.pack_sets) * 1_000_000 + F.floor(weight / options.pack_members)
        packed = written(ranked.withColumn("pack_no", number.cast("long")).select("rep", "n", "comp", "cluster", "pack_no"), "join-packs")
        # Only the members of sets that still wait are met: after the first round these are few.
        live = waiting.select("rep").distinct()
        met = held.join(broadcast_if_small(live, live.count(), 32), "rep", "left_semi")
        routes = _routes(waiting, packed, met, options.percent)
        release(sets.sparkSession)
        slices = F.greatest(F.ceil(F.sum("n") / options.slice_members), F.ceil(F.count("*") / options.slice_sets)).cast("int")
        dealt = routes.groupBy("cluster", "pack_no").agg(slices.alias("slices"))
        pack, salts = F.xxhash64("cluster", "pack_no").alias("pack"), F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)
        stored = packed.join(dealt, ["cluster", "pack_no"], "left").select("rep", "n", pack, F.explode(salts).alias("salt"), F.lit(0).alias("kind"), "comp")
        looked_up = routes.join(dealt, ["cluster", "pack_no"]).select("rep", "n", pack, F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int").alias("salt"), F.lit(1).alias("kind"), "comp")
        keys = written(stored.unionByName(looked_up), "join-keys")
        moved = keys.count()
        stream = sets.select("rep", "n", "members").join(broadcast_if_small(keys, moved, 96), ["rep", "n"])
        stream = stream.repartition("pack", "salt").sortWithinPartitions("pack", "salt", "kind", "rep")
        found = written(pack_links(stream, options.percent), "join-links")
        release(sets.sparkSession)
        labels = components_of_few(found)
        done = packed.select("rep", "n", F.lit(True).alias("_done"))
        state = state.join(done, ["rep", "n"], "left").join(labels.withColumnRenamed("node", "comp"), "comp", "left")
        before = state_now
        state_now = written(state.select("rep", "cluster", "n", F.coalesce("component", "comp").alias("comp"), (F.col("done") | F.coalesce("_done", F.lit(False))).alias("done")), "join-state")
        discard(before, going, waiting, packed, routes, keys, found)
        release(sets.sparkSession)
        packs = options.packs_per_round if packs < options.packs_per_round else packs * (4 if moved <= total else 1)


def _labelled(docs: DataFrame, options: JoinOptions) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row."""
    counted = written(counted_sets(docs, options), "sets")
    same = ["n_shingles", "f1", "f2"]
    base = written(counted.select("doc_id", "text_hash", *same), "set-marks")
    full = base.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).select("doc_id", *same)
    classes = written(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("_copies")), "classes")
    # One set per class of equal sets goes on; the copies are left out (an id may be another set's first), by broadcast where they are few.
    copies = classes.where(F.col("_copies") > 1).select("rep", *same).join(full, same).where(F.col("doc_id") != F.col("rep")).select("doc_id", *same)
    copies = written(copies, "copies")
    firsts = counted.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).join(broadcast_if_small(copies, copies.count(), 40), ["doc_id", *same], "left_anti")
    found, held = clusters(firsts.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "low", "more"), options)
    discard(counted, copies)
    release(docs.sparkSession)
    wanted = classes.join(found, classes["rep"] == found["node"]).select("rep", F.col("component").alias("cluster"), F.col("n_shingles").alias("n"), "f1", "f2")
    wanted = written(wanted, "wanted")
    sets = member_sets(docs, wanted, options)
    release(docs.sparkSession)
    labels = _rounds(sets, held.select("rep", "gram", "lead"), options)
    discard(held, wanted, sets)
    classes = classes.join(labels, classes["rep"] == labels["node"], "left").withColumn("rep", F.coalesce("component", "rep"))
    moved = classes.where((F.col("_copies") > 1) | F.col("component").isNotNull())
    out = base.select("doc_id", "text_hash", *same).join(moved.select(*[F.col(c).alias(f"_{c}") for c in same], "rep"), [F.col(c) == F.col(f"_{c}") for c in same], "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return _labelled(docs, options).drop("text_hash")


def keep_first(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """Rows without those whose text links, directly or over others, to one of a smaller doc_id.

    Rows that repeat a doc_id are judged each by its own text; rows without an id stay.
    """
    later = _labelled(docs, options).where(F.col("doc_id") != F.col("component_id")).select("doc_id", F.col("text_hash").alias("_text_hash")).distinct()
    later = written(later, "later-copies")
    # By broadcast where these are few: a shuffle would move and store all texts.
    later = broadcast_if_small(later, later.count(), 40)
    return docs.withColumn("_text_hash", text_hash()).join(later, ["doc_id", "_text_hash"], "left_anti").select(*docs.columns)
