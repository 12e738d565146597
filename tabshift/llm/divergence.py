"""Source divergence audit by systolic rotation.

Each (lang, source) group has a smoothed distribution over the terms that its language keeps (those in at least ``least``
documents): p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)), in whole numbers throughout. Two distributions diverge by the sum of
f = floor((p - q)^2 / (p + q)) over all kept terms.

1. Tasks count terms by group before anything is shuffled, so that a source that holds a third of all rows sends one row a term
   and task. One exchange by (lang, term) sums the counts, finds document frequencies and drops rare terms.
2. Tasks that hold a run of terms number them, cut them into blocks and write each block's groups as compressed vectors, by team:
   the groups of a language are dealt into TEAMS teams. A vector holds only the terms whose p differs from that of an absent term.
   Local heaps keep each group's terms that stand out most from its language.
3. A cell (lang, block, team) stays resident in its partition, and the other teams' vectors come to it in the rounds of a
   round-robin tournament (circle method), one after the other: each pair of teams meets once, at one of the two. A meeting gives
   both directions of every pair of groups, over the block's terms; a team meets itself at home. A resident unfolds one group at a
   time and holds one visitor at a time.
4. Sums over blocks are ranked.

A language has as many pairs as its result has rows; nothing else grows with pairs but the partial sums of a task.

Defined results: null texts have no terms; null languages and sources are empty strings; a group without kept terms takes part
with the p of absent terms; a language without kept terms has divergence 0 between all its sources; a language with one source has
no pairs; repeated rows are documents each; ties go by the item's UTF-8 bytes; an empty table gives an empty result. Columns other
than the three named are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabshift.llm.common import discard, staged

SCALE = 1_000_000_000
TEAMS = 16
#: Counted terms that a task holds before it sends them on; vector entries of a block.
HELD, BLOCK = 400_000, 1 << 17
PAIRS_HELD = 1 << 20

#: Letters and bytes beyond ASCII, A-Z lower-cased; all else parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
COUNTS_SQL = "lang string, source string, term string, n long, docs long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a task, and a row without a term for each group."""
    said: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in said.items():
            size = len(n) + 1
            terms = pa.concat_arrays([pa.array(n.keys(), pa.binary()), pa.array([None], pa.binary())]).view(pa.string())
            once = lambda x, size=size: pa.repeat(pa.scalar(x, pa.string()), size)
            yield pa.RecordBatch.from_arrays([once(lang), once(source), terms, pa.array([*n.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, n), 0], pa.int64())], schema=COUNTS)

    for batch in batches:
        lang, source, text = (batch.column(i) for i in range(3))
        for group, data in zip(zip(lang.to_pylist(), source.to_pylist(), strict=True), text.cast(pa.binary()), strict=True):
            n, docs = said.setdefault(group, (Counter(), Counter()))
            if found := terms_of(data.as_py()):
                before = len(n)
                n.update(found)
                docs.update(set(found))
                held += len(n) - before
            if held >= HELD:
                yield from flush()
                said, held = {}, 0
    yield from flush()


def kept_terms(docs: DataFrame, *, least: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, n_lang, first) of each group's kept terms; each group also has a row without a term."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    summed = rows.mapInArrow(_count, COUNTS_SQL).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    seen = summed.withColumns({"df": F.sum("docs").over(term), "n_lang": F.sum("n").over(term), "first": (F.row_number().over(term.orderBy("source")) == 1) & F.col("term").isNotNull()})
    return seen.filter(F.col("term").isNull() | (F.col("df") >= least)).drop("docs", "df")


def _p(count: str | int, total: str) -> Column:
    """1 + floor(SCALE * (count + 2) / total) in decimals, which hold the product of any two longs here."""
    return F.expr(f"1 + ({SCALE}BD * ({count} + 2)) div greatest({total}, 1L)")


def groups_of(kept: DataFrame) -> DataFrame:
    """One row a group: (g, lang, source, n_group, n_kept, n_all, absent, team)."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.sum(F.col("first").cast("long")).alias("firsts"))
    langs = own.groupBy("lang").agg(F.sum("n_group").alias("n_all"), F.sum("firsts").alias("n_kept"))
    both = own.drop("firsts").join(langs, "lang").withColumn("absent", _p(0, "n_group + 2 * n_kept"))
    return both.select(F.monotonically_increasing_id().alias("g"), "*", F.pmod(F.xxhash64("source"), F.lit(TEAMS)).cast("int").alias("team"))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def pack(groups: np.ndarray, sizes: np.ndarray, terms: np.ndarray, more: np.ndarray, n_terms: int) -> bytes:
    """A team's vectors over a block: its groups, their numbers of entries, and entries by group as (term, p less that of an absent term)."""
    head = np.array([n_terms, len(groups), len(terms)], "<i8")
    return zlib.compress(b"".join(x.tobytes() for x in (head, groups.astype("<i8"), sizes.astype("<i8"), np.diff(terms, prepend=0).astype("<i4"), more.astype("<i8"))), 1)


class Team:
    """A team's vectors over a block; groups without entries are there too."""

    def __init__(self, payload: bytes, groups: np.ndarray, absent: np.ndarray) -> None:
        data = zlib.decompress(payload)
        self.n_terms, n, m = np.frombuffer(data, "<i8", 3).tolist()
        told = np.frombuffer(data, "<i8", n, 24)
        order = np.argsort(groups)
        self.groups, self.absent = groups[order], absent[order]
        size = np.zeros(len(groups), np.int64)
        size[np.searchsorted(self.groups, told)] = np.frombuffer(data, "<i8", n, 24 + 8 * n)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.terms = np.cumsum(np.frombuffer(data, "<i4", m, 24 + 16 * n), dtype=np.int64)
        self.of = np.repeat(np.arange(len(groups)), size)
        self.p = np.frombuffer(data, "<i8", m, 24 + 16 * n + 4 * m) + self.absent[self.of]


def meeting(host: Team, guest: Team) -> Iterator[tuple[int, np.ndarray]]:
    """(number of a host's group, its divergence over the block from each of the guest's groups)."""
    sizes = guest.ends - guest.starts
    for i in range(len(host.groups)):
        mine = slice(int(host.starts[i]), int(host.ends[i]))
        terms, p, absent = host.terms[mine], host.p[mine], int(host.absent[i])
        unfolded = np.full(host.n_terms, absent, np.int64)
        unfolded[terms] = p
        met = unfolded[guest.terms]
        there = met != absent
        q0 = guest.absent[guest.of]
        # terms of the guest; then those of the host alone; then those of neither
        parts = divergence(met, guest.p) - np.where(there, divergence(met, q0), 0)
        sums = np.zeros(len(guest.groups), np.int64)
        np.add.at(sums, guest.of, parts)
        both = np.bincount(guest.of[there], minlength=len(guest.groups))
        alone = np.array([divergence(p, q).sum() for q in guest.absent], np.int64)
        neither = host.n_terms - len(p) - sizes + both
        yield i, sums + alone + neither * divergence(np.int64(absent), guest.absent)


SEATS = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("team", pa.int32()), ("payload", pa.binary()), ("g", pa.int64()), ("term", pa.string()), ("value", pa.int64())])
SEATS_SQL = "lang string, block long, team int, payload binary, g long, term string, value long"


def _seated(most: int):
    """Rows (lang, term, g, team, p, q, absent) in order of lang and term -> a language's blocks by team, and each group's terms that stand out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        heaps: dict[int, list[tuple[int, bytes]]] = {}

        def write(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal block
            lang = rows["lang"][0].as_py()
            rows = rows.filter(pc.is_valid(rows["term"])).combine_chunks()
            g, team, p, q, absent = (rows[c].to_numpy() for c in ("g", "team", "p", "q", "absent"))
            term = rows["term"].combine_chunks()
            new = np.r_[True, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)] if len(term) else np.empty(0, bool)
            number = np.cumsum(new) - 1
            out = np.flatnonzero(p > q)
            value = divergence(p[out], q[out])
            order = np.lexsort((number[out], -value, g[out]))
            best, sorted_g = out[order], g[out][order]
            starts = np.flatnonzero(np.r_[True, sorted_g[1:] != sorted_g[:-1]]) if len(order) else np.empty(0, np.int64)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=False):
                top = [(-int(v), term[int(i)].as_py().encode()) for v, i in zip(value[order[s : min(e, s + most)]], best[s : min(e, s + most)], strict=True)]
                heaps[int(sorted_g[s])] = heapq.nsmallest(most, heaps.get(int(sorted_g[s]), []) + top)
            own = np.flatnonzero(p != absent)
            own = own[np.lexsort((number[own], g[own], team[own]))]
            payloads = []
            for t in range(TEAMS):
                at = own[np.searchsorted(team[own], t, "left") : np.searchsorted(team[own], t, "right")]
                groups, sizes = np.unique(g[at], return_counts=True)
                payloads.append(pack(groups, sizes, number[at], (p - absent)[at], int(new.sum())))
            none = pa.nulls(TEAMS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), TEAMS), pa.repeat(pa.scalar(block, pa.int64()), TEAMS), pa.array(range(TEAMS), pa.int32()), pa.array(payloads, pa.binary()), none, pa.nulls(TEAMS, pa.string()), none], schema=SEATS)
            block += 1

        waiting: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            waiting = rows if waiting is None else pa.concat_tables([waiting, rows])
            lang, term = (waiting[c].combine_chunks() for c in ("lang", "term"))
            other = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
            begins = [0, *(np.flatnonzero(other) + 1).tolist()]
            for a, b in zip(begins, begins[1:], strict=False):
                yield from write(waiting.slice(a, b - a))
            waiting = waiting.slice(begins[-1])
            if len(waiting) >= BLOCK:  # up to the last term that is whole
                last = pc.fill_null(pc.equal(term[begins[-1] :], term[-1]), False).to_numpy(zero_copy_only=False)
                if whole := int(np.argmax(last)):
                    yield from write(waiting.slice(0, whole))
                    waiting = waiting.slice(whole)
        if waiting is not None and len(waiting):
            yield from write(waiting)
        found = [(g, t.decode(), -v) for g, heap in heaps.items() for v, t in heap]
        for at in range(0, len(found), 10_000):
            part = found[at : at + 10_000]
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.string()), pa.array([x[2] for x in part], pa.int64())], schema=SEATS)

    return run


def rounds(teams: int = TEAMS) -> list[tuple[int, int, int]]:
    """(round, guest, host) of a tournament of an even number of teams, by the circle method: every two teams meet once, and host about as often."""
    ring, out = teams - 1, []
    for r in range(ring):
        pairs = [(ring, r) if r % 2 else (r, ring)]
        pairs += [((r - k) % ring, (r + k) % ring) for k in range(1, teams // 2)]
        out += [(r, guest, host) for guest, host in pairs]
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Residents come before their guests, who come by round; both directions of every pair of groups are summed within the task."""
    resident: tuple | None = None
    host: Team | None = None
    parts: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        x = np.concatenate(parts)
        order = np.lexsort((x[:, 1], x[:, 0]))
        x = x[order]
        starts = np.flatnonzero(np.r_[True, (x[1:, :2] != x[:-1, :2]).any(axis=1)])
        return pa.RecordBatch.from_arrays([pa.array(x[starts, 0]), pa.array(x[starts, 1]), pa.array(np.add.reduceat(x[:, 2], starts))], names=["a", "b", "value"])

    for batch in batches:
        places = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        for i, place in enumerate(places):
            roster = batch.column(5)[i].values
            at_home = batch.column(3)[i].as_py() < 0
            if not at_home and place != resident:
                continue  # the host's team has no groups in this language
            guest = Team(batch.column(4)[i].as_py(), *(roster.field(k).to_numpy() for k in ("g", "absent")))
            if at_home:
                resident, host = place, guest
            for k, values in meeting(host, guest):
                other = np.flatnonzero(guest.groups != host.groups[k])
                mine = np.full(len(other), host.groups[k])
                there, value = guest.groups[other], values[other]
                parts.append(np.stack([mine, there, value], axis=1))
                if not at_home:  # at home each pair is met from both sides
                    parts.append(np.stack([there, mine, value], axis=1))
                held += 2 * len(other)
            if held >= PAIRS_HELD:
                yield flush()
                parts, held = [], 0
    if held:
        yield flush()


def audit(docs: DataFrame, *, least: int = 10, most: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and the terms that set it apart."""
    kept = staged(kept_terms(docs, least=least, text_col=text_col, lang_col=lang_col, source_col=source_col), "divergence-kept")
    groups = staged(groups_of(kept), "divergence-groups")
    known = groups.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    rows = kept.join(known, (kept["lang"] == known["g_lang"]) & (kept["source"] == known["g_source"]))
    rows = rows.select("lang", "term", "g", "team", _p("n", "n_group + 2 * n_kept").alias("p"), _p("n_lang", "n_all + 2 * n_kept").alias("q"), "absent")
    seats = staged(rows.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_seated(most), SEATS_SQL), "divergence-seats")

    # a team's groups; of as many as its language has sources, one in TEAMS
    rosters = groups.groupBy("lang", "team").agg(F.collect_list(F.struct("g", "absent")).alias("roster"))
    cells = seats.filter("payload is not null").select("lang", "block", "team", "payload").join(rosters, ["lang", "team"])
    trips = docs.sparkSession.createDataFrame(rounds(), "round int, guest int, host int")  # a fixed number of rows, by TEAMS
    home = cells.select("lang", "block", F.col("team").alias("host"), F.lit(-1).alias("round"), "payload", "roster")
    away = cells.join(F.broadcast(trips), cells["team"] == trips["guest"]).select("lang", "block", "host", "round", "payload", "roster")
    dealt = home.unionByName(away).repartition("lang", "block", "host").sortWithinPartitions("lang", "block", "host", "round")
    pairs = dealt.mapInArrow(_meet, "a long, b long, value long").groupBy("a", "b").agg(F.sum("value").alias("value"))

    names = groups.select("g", "lang", "source")
    peers = names.select(F.col("g").alias("b"), F.col("source").alias("item"))
    pair = pairs.join(peers, "b").select(F.col("a").alias("g"), F.lit("pair").alias("part"), "item", "value")
    term = seats.filter("payload is null").select("g", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    by = Window.partitionBy("g").orderBy(F.col("value").desc(), "item")
    ranked = pair.withColumn("rank", F.row_number().over(by)).unionByName(term.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most))
    out = staged(ranked.join(names, "g").select(F.col("lang").alias("lang"), F.col("source").alias("source"), "part", "item", "value", "rank"), "divergence")
    discard(kept, groups, seats)
    return out
