"""Mixing overlapping sources to target weights by min-cost flow.

Documents that belong to the same sources are one pattern. Patterns and
sources, never documents, form the network; its flows say how many words of a
pattern each source gets, and documents are then chosen by seeded hash. Sources
that no pattern connects do not compete, so each connected part of the network
is solved by itself in a Spark task, and targets come from aggregates: any
number of sources can be mixed.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.posture import positioned_by_range
from .near_dup import components
from .shared import free_name, new_folder, word_count, written
from .sharding import PIECE

#: Documents of a pattern are ordered in this many parts, so that no task orders a whole source.
PARTS = 4096
#: Memberships (pattern and source) of one connected part of the network, which one task holds. More is an error;
#: sources that share no documents are parts of their own and have no such bound.
MAX_MEMBERSHIPS = 200_000
#: Passes of seeded choice: each fills what the pass before left open with documents that still fit; those
#: behind FIRST_PASSES also offer what has been taken once more, while `epochs` allows it.
PASSES, FIRST_PASSES = 5, 3
#: Exchanges of one document for another (or for none) that close what the passes left open; most patterns need one or two.
EXCHANGES = 8
SEED = 20


def capped_targets(sizes: Mapping[object, int], weights: Mapping[object, float], share: float, most: float) -> dict[object, float]:
    """Targets of all sources: `share` of all sizes by weight, none over `most` times its size.

    The excess of capped sources goes to the others by weight until none is
    above. Sources fill up in order of size by weight, so one pass decides.
    """
    rest, weight = share * sum(sizes.values()), float(sum(weights.values()))
    targets: dict[object, float] = {}
    for s in sorted(sizes, key=lambda s: most * sizes[s] / weights[s]):
        if rest * weights[s] >= most * sizes[s] * weight:
            targets[s] = most * sizes[s]
            rest -= targets[s]
            weight -= weights[s]
        else:
            targets[s] = rest * weights[s] / weight
    return targets


def min_cost_flow(capacity: Sequence[int], member: Sequence[Sequence[int]], quota: Sequence[int], epochs: int) -> list[dict[int, int]]:
    """Words of each pattern for each of its sources, by successive shortest paths.

    A pattern's words of pass e cost 2e - 1 each, so repeats spread over all
    patterns before any repeats more. Quotas beyond what patterns can give stay
    unfilled.
    """
    n, m = len(capacity), len(quota)
    used, need = [0] * n, list(quota)
    flow: list[dict[int, int]] = [{} for _ in range(n)]
    holders: list[list[int]] = [[] for _ in range(m)]
    for p, sources in enumerate(member):
        for s in sources:
            holders[s].append(p)

    def price(p: int) -> int | None:
        e = used[p] // capacity[p] + 1 if capacity[p] else epochs + 1
        return 2 * e - 1 if e <= epochs else None

    # A source is served by its cheapest pattern, or by one whose words another source can replace.
    for s in range(m):
        while need[s] > 0:
            best: dict[int, int] = {s: 0}
            back: dict[int, tuple[int, int]] = {}
            heap, end = [(0, s)], None
            closed: set[int] = set()
            while heap:
                cost, at = heapq.heappop(heap)
                if at in closed:
                    continue
                closed.add(at)
                for p in holders[at]:
                    add = price(p)
                    if add is not None and (end is None or cost + add < end[0]):
                        end = (cost + add, p, at)
                    for other in flow[p]:  # take the words of another source, which then looks further
                        if flow[p][other] > 0 and other not in closed and cost < best.get(other, 1 << 60):
                            best[other] = cost
                            back[other] = (at, p)
                            heapq.heappush(heap, (cost, other))
            if end is None:
                break
            _, p, at = end
            room = capacity[p] - used[p] % capacity[p]
            chain, x = [], at
            while x != s:
                before, via = back[x]
                chain.append((x, before, via))
                room = min(room, flow[via][x])
                x = before
            move = min(room, need[s])
            used[p] += move
            flow[p][at] = flow[p].get(at, 0) + move
            for x, before, via in chain:
                flow[via][x] -= move
                flow[via][before] = flow[via].get(before, 0) + move
            need[s] -= move
    return [{s: f for s, f in x.items() if f} for x in flow]


def choose(sized: DataFrame, amounts: DataFrame, epochs: int, seed: int = SEED) -> DataFrame:
    """`copies` of each row so that every pattern gives its words: whole passes for all, the rest by seeded hash.

    sized: key columns, `pattern` and `size`; amounts: `pattern`, `words` to
    take, `total` words of the pattern. Rows that are equal are counted and
    chosen as one. What the passes leave open is then closed by exchanges: each
    adds the document, and drops the one, whose sizes bring the pattern nearest
    to its words, as long as that is nearer than before. No document is taken
    more than `epochs` times. A pattern without amounts gives nothing.
    """
    keys = [c for c in sized.columns]
    counted = sized.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.count(F.lit(1)).alias("_n"))
    order = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in keys if c != "pattern"])
    rest = amounts.withColumn("_base", F.when(F.col("total") > 0, F.expr("least(words div total, {e})".format(e=int(epochs)))).otherwise(F.lit(0)))
    rest = rest.select(F.col("pattern").alias("_pattern"), "_base", (F.col("words") - F.col("_base") * F.col("total")).alias("_open"), (F.col("_base") < epochs).alias("_more"))
    # small tables are written before they are joined: Spark then knows their size and broadcasts them only if it is small
    state = counted.join(written(rest, "mix-rest"), F.col("pattern") == F.col("_pattern"), "left").drop("_pattern").withColumns({
        "_base": F.coalesce("_base", F.lit(0)), "_open": F.coalesce("_open", F.lit(0)), "_more": F.coalesce("_more", F.lit(False)),
        "_order": order, "_part": F.shiftright(order, 52), "_extra": F.lit(0).cast("long")})
    state = written(state, "mix")
    for turn in range(PASSES):
        # rows that may still be taken once more and fit into what is open
        most = F.col("_n") if turn < FIRST_PASSES else F.col("_n") * (epochs - F.col("_base"))
        offered = F.when(F.col("_more") & (F.col("size") > 0) & (F.col("size") <= F.col("_open")), most - F.col("_extra")).otherwise(0)
        state = state.withColumn("_offer", offered)
        parts = state.groupBy("pattern", "_part").agg(F.sum(F.col("_offer") * F.col("size")).alias("_sum"))
        before = parts.select(F.col("pattern").alias("_p"), F.col("_part").alias("_q"),
                              F.coalesce(F.sum("_sum").over(W.partitionBy("pattern").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
        inner = W.partitionBy("pattern", "_part").orderBy("_order", *[F.col(f"`{c}`") for c in keys if c != "pattern"]).rowsBetween(W.unboundedPreceding, -1)
        placed = state.withColumn("_before", F.coalesce(F.sum(F.col("_offer") * F.col("size")).over(inner), F.lit(0)))
        placed = placed.join(before, (F.col("pattern") == F.col("_p")) & (F.col("_part") == F.col("_q"))).drop("_p", "_q")
        fits = F.when(F.col("_offer") > 0, F.least(F.col("_offer"), F.greatest(F.lit(0), F.expr("(_open - _start - _before) div size")))).otherwise(0).cast("long")
        took = placed.withColumn("_take", fits).withColumn("_extra", F.col("_extra") + F.col("_take"))
        took = written(took.drop("_before", "_start", "_offer"), "mix")
        spent = written(took.groupBy("pattern").agg(F.sum(F.col("_take") * F.col("size")).alias("_spent")).withColumnRenamed("pattern", "_p"), "mix-spent")
        state = took.join(spent, (F.col("pattern") == F.col("_p"))).withColumn("_open", F.col("_open") - F.col("_spent")).drop("_p", "_spent", "_take")
    for _ in range(EXCHANGES):
        best = _best_exchanges(state, epochs)
        if not best.limit(1).count():
            break
        state = written(_exchanged(state, best, [c for c in keys if c != "pattern"], epochs), "mix")
    extra = F.expr("_extra div _n") + F.when(F.col("_copy") <= F.col("_extra") % F.col("_n"), 1).otherwise(0)
    # copies in two steps, so that a row repeated without end needs no array of that length
    pieces = state.withColumn("_piece", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"), F.lit(PIECE).cast("long"))))
    each = F.explode(F.sequence(F.col("_piece"), F.least(F.col("_piece") + PIECE - 1, F.col("_n"))))
    return pieces.select(*[F.col(f"`{c}`") for c in keys], each.alias("_copy"), "_n", "_base", "_extra") \
        .select(*[F.col(f"`{c}`") for c in keys], F.when(F.col("size") > 0, F.col("_base") + extra).otherwise(F.lit(0).cast("long")).alias("copies"))


def _offered(epochs: int) -> Column:
    return (F.col("size") > 0) & (F.col("_extra") < F.col("_n") * (epochs - F.col("_base")))


def _best_exchanges(state: DataFrame, epochs: int) -> DataFrame:
    """(pattern, add, drop): the sizes whose exchange brings a pattern nearest to its words, if any does.

    Works on the distinct sizes of a pattern: for every size on offer the two
    sizes in use that lie next to what would have to go; 0 stands for none on either side.
    """
    sizes = state.filter(F.col("_open") != 0).groupBy("pattern", "_open", "size").agg(F.max(_offered(epochs)).alias("in"), F.max(F.col("_extra") > 0).alias("out"))
    none = sizes.select("pattern", "_open", F.lit(0).cast("long")).distinct()
    add = sizes.filter("`in`").select("pattern", "_open", "size").union(none).select(
        "pattern", "_open", F.col("size").alias("add"), (F.col("size") - F.col("_open")).alias("at"), F.lit(None).cast("long").alias("drop"))
    used = sizes.filter("out").select("pattern", "_open", "size").union(none).select("pattern", "_open", F.lit(None).cast("long").alias("add"), F.col("size").alias("at"), F.col("size").alias("drop"))
    order = W.partitionBy("pattern").orderBy("at", F.col("add").isNotNull())
    near = add.union(used).withColumns({"under": F.last("drop", True).over(order.rowsBetween(W.unboundedPreceding, 0)), "above": F.first("drop", True).over(order.rowsBetween(0, W.unboundedFollowing))})
    either = near.filter("add is not null").select("pattern", "_open", "add", F.explode(F.array("under", "above")).alias("drop")).filter("drop is not null and drop <> add")
    left = F.col("_open") - F.col("add") + F.col("drop")
    best = either.filter(F.abs(left) < F.abs("_open")).groupBy("pattern").agg(F.min(F.struct(F.abs(left).alias("d"), "add", "drop")).alias("b"))
    return written(best.select("pattern", "b.add", "b.drop"), "mix-exchange")


def _exchanged(state: DataFrame, best: DataFrame, keys: list[str], epochs: int) -> DataFrame:
    """The state after one exchange in each pattern that has one, by the first documents in seeded order."""
    both = state.join(best, "pattern")
    picked = both.groupBy("pattern", "add", "drop").agg(
        F.min(F.when(_offered(epochs) & (F.col("size") == F.col("add")), F.struct("_order", *[F.col(f"`{c}`") for c in keys]))).alias("_plus"),
        F.min(F.when((F.col("_extra") > 0) & (F.col("size") == F.col("drop")), F.struct("_order", *[F.col(f"`{c}`") for c in keys]))).alias("_minus"))
    picked = written(picked.select(F.col("pattern").alias("_p"), "_plus", "_minus", (F.col("add") - F.col("drop")).alias("_moved")), "mix-picked")
    own = F.struct("_order", *[F.col(f"`{c}`") for c in keys])
    told = state.join(picked, F.col("pattern") == F.col("_p"), "left")
    step = F.when(own.eqNullSafe(F.col("_plus")), 1).otherwise(0) - F.when(own.eqNullSafe(F.col("_minus")), 1).otherwise(0)
    return told.withColumns({"_extra": F.col("_extra") + step, "_open": F.col("_open") - F.coalesce("_moved", F.lit(0))}).drop("_p", "_plus", "_minus", "_moved")


def source_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds `target`, as capped_targets has it, to a written table of sources with `size` and `weight`.

    A source is capped where its share by weight exceeds `most` times its size.
    Capping frees words for the others, whose level rises, so rounds of one
    aggregate each cap more until none follows.
    """
    sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")]
    every = sources.agg(*sums, F.count_if(F.coalesce(F.col("weight") <= 0, F.lit(True))).alias("unweighted")).first()
    if every.unweighted:
        raise ValueError(f"{every.unweighted} sources have no positive weight")
    rest, free, capped = share * every.size, every.weight, 0
    while True:
        over = F.lit(rest) * F.col("weight") >= F.lit(float(most)) * F.col("size") * F.lit(free)
        found = sources.filter(over).agg(*sums).first()
        if found.n <= capped or found.n == every.n:
            break
        rest, free, capped = share * every.size - most * found.size, every.weight - found.weight, found.n
    full = F.lit(True) if found.n == every.n else over
    return sources.withColumn("target", F.when(full, F.lit(float(most)) * F.col("size")).otherwise(F.lit(rest) * F.col("weight") / F.lit(free)))


def weighted_sources(patterns: DataFrame, weights, share: float, epochs: int) -> DataFrame:
    """(at, source, size, weight, target) of every source: its place in code point order, null last, and the words it holds."""
    held = patterns.select(F.explode(F.array_distinct("pattern")).alias("source"), "total").groupBy("source").agg(F.sum("total").alias("size"))
    placed = positioned_by_range(held, [], [F.col("source").isNull(), F.col("source")], new_folder(patterns.sparkSession, "mix-sources"))
    placed = placed.select((F.col("pos") - 1).alias("at"), "source", "size")
    if callable(weights):
        told = placed.withColumn("weight", weights(F.col("at")))
    else:
        given = patterns.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "_s string, weight double")
        told = placed.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return written(source_targets(written(told, "mix-sources"), share, epochs), "mix-targets")


def connected(members: DataFrame) -> DataFrame:
    """Adds `part` to (pattern, total, at, ...): the least place of the sources that patterns connect with this one."""
    meet = W.partitionBy("pattern")
    links = members.filter(F.size(F.array_distinct("pattern")) > 1).select(F.min("at").over(meet).alias("a"), F.col("at").alias("b")).filter("a <> b").distinct()
    links = written(links, "mix-links")
    if not links.limit(1).count():
        return members.withColumn("part", F.col("at"))
    part = written(components(links), "mix-parts").select(F.col("node").alias("at"), "class_node")
    return members.join(part, "at", "left").withColumn("part", F.coalesce("class_node", "at")).drop("class_node")


def routed(patterns: DataFrame, sources: DataFrame, epochs: int) -> DataFrame:
    """(pattern, words, total, routes): the min-cost flow, one connected part of the network a group."""
    members = patterns.withColumn("member", F.explode(F.array_distinct("pattern")))
    quota = sources.select("at", "source", F.bround("target").cast("long").alias("quota"))
    members = members.join(quota, F.col("member").eqNullSafe(F.col("source"))).select("pattern", "total", "at", "source", "quota")
    parts = written(connected(written(members, "mix-members")), "mix-network")
    large = parts.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    if large > MAX_MEMBERSHIPS:
        raise ValueError(f"{large} memberships of overlapping sources are connected, more than {MAX_MEMBERSHIPS}: group sources first")
    order = lambda pattern: [(s is None, s or "") for s in pattern]
    kind = pa.schema([("pattern", pa.list_(pa.string())), ("words", pa.int64()), ("total", pa.int64()),
                      ("routes", pa.list_(pa.struct([("source", pa.string()), ("words", pa.int64())])))])

    def solve(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        names = {r["at"]: (r["source"], r["quota"]) for r in rows}
        places = {at: i for i, at in enumerate(sorted(names))}
        total = {tuple(r["pattern"]): r["total"] for r in rows}
        member: dict[tuple, list[int]] = {}
        for r in sorted(rows, key=lambda r: r["at"]):
            member.setdefault(tuple(r["pattern"]), []).append(places[r["at"]])
        held = sorted(total, key=order)
        flows = min_cost_flow([total[p] for p in held], [member[p] for p in held], [names[at][1] for at in places], epochs)
        source = [names[at][0] for at in places]
        return pa.Table.from_pylist([{"pattern": list(p), "words": sum(f.values()), "total": total[p], "routes": [{"source": source[s], "words": w} for s, w in f.items()]}
                                     for p, f in zip(held, flows)], kind)

    return parts.groupBy("part").applyInArrow(solve, "pattern array<string>, words long, total long, routes array<struct<source:string,words:long>>")


def mixed(sized: DataFrame, weights, share: float = 1.5, epochs: int = 2, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with copies, flows, sources), for any number of sources.

    sized has key columns, `pattern` (array of the sources a row belongs to)
    and `size`. weights maps sources to weights, or makes the weight from a
    column that holds a source's place (from 0) in code point order, null last.
    sources has one row per source: its words (`size`) and `target`, as
    capped_targets says. flows has one row per pattern: words to take, total
    words and `routes`, pairs of source and words. Rows without words or
    sources are never taken; a null pattern is an empty one. An empty table
    gives no rows.
    """
    sized = sized.withColumn("pattern", F.coalesce("pattern", F.array().cast("array<string>")))
    patterns = written(sized.groupBy("pattern").agg(F.sum("size").alias("total")), "mix-patterns")
    sources = weighted_sources(patterns, weights, share, epochs)
    flows = written(routed(patterns, sources, epochs), "mix-flows")
    return choose(sized, flows.select("pattern", "words", "total"), epochs, seed), flows, sources


def mix(sized: DataFrame, weights, share: float = 1.5, epochs: int = 2, seed: int = SEED) -> tuple[DataFrame, DataFrame, dict, dict]:
    """(rows with copies, flows, target by source, size by source): `mixed` for sources few enough to look at."""
    chosen, flows, sources = mixed(sized, weights, share, epochs, seed)
    rows = sources.collect()
    return chosen, flows, {r.source: r.target for r in rows}, {r["source"]: r["size"] for r in rows}


def by_turns(turns: Sequence[float] = (3, 1, 2)):
    """Weights of sources in order: the given ones, repeating."""
    return lambda at: F.element_at(F.array(*[F.lit(float(t)) for t in turns]), (at % len(turns) + 1).cast("int"))


def mix_documents(docs: DataFrame, weights=by_turns(), share: float = 1.5, epochs: int = 2, seed: int = SEED,
                  doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target, taken (words the mix takes, repeats counted).

    The source of a row is its only membership; a null source is one source.
    Null and empty texts have size 0 and are not taken. Repeated rows are
    documents of their own. Reruns agree, since order depends on row values only.
    """
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.array(F.col(source).cast("string")).alias("pattern"), word_count(text).alias("size"))
    sized = written(sized, "sizes")
    chosen, _, sources = mixed(sized, weights, share, epochs, seed)
    known = sources.select(F.array("source").alias("_p"), F.col("size").alias("source_size"), "target")
    return chosen.join(known, F.col("pattern") == F.col("_p")).select(
        "doc_id", F.col("pattern")[0].alias("source"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def take_mix(docs: DataFrame, weights=by_turns(), share: float = 1.5, epochs: int = 2, seed: int = SEED,
             doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents as the mix has them: a document of k copies comes k times, all columns kept.

    Rows are matched by id, source, text digest and size; of m such rows that
    the mix takes c times in all, c come back.
    """
    key = free_name(docs, "_mix_key")
    ident = F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    sized = written(docs.select(ident.alias("key"), F.array(F.col(source).cast("string")).alias("pattern"), word_count(text).alias("size")), "sizes")
    chosen, _, _ = mixed(sized, weights, share, epochs, seed)
    copies, rows, same, number, piece, held, start, of_key, of_piece = (
        free_name(docs, f"_mix_{n}") for n in ("copies", "rows", "same", "row", "piece", "held", "start", "key_of", "piece_of"))
    counts = written(chosen.groupBy(F.col("key").alias(same)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)).filter(F.col(copies) > 0), "mix-counts")
    each, left = F.expr(f"`{copies}` div `{rows}`"), F.col(copies) % F.col(rows)
    keyed = docs.withColumn(key, ident)
    # most rows are alone under their key or have as many copies as the rows equal to them: nothing to number
    even = keyed.join(counts.filter(left == 0), F.col(key) == F.col(same)).withColumn(copies, each)
    # of m equal rows the first c % m get one copy more; they are numbered by pieces of the input, since all rows may be equal
    uneven = keyed.withColumn(piece, F.spark_partition_id()).join(written(counts.filter(left != 0), "mix-uneven"), F.col(key) == F.col(same))
    uneven = written(uneven, "mix-equal")
    sums = uneven.groupBy(F.col(same).alias(of_key), F.col(piece).alias(of_piece)).agg(F.count(F.lit(1)).alias(held))
    earlier = F.sum(held).over(W.partitionBy(of_key).orderBy(of_piece).rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(of_key, of_piece, F.coalesce(earlier, F.lit(0)).alias(start))
    ranked = uneven.join(starts, (F.col(same) == F.col(of_key)) & (F.col(piece) == F.col(of_piece)))
    ranked = ranked.withColumn(number, F.col(start) + F.row_number().over(W.partitionBy(same, piece).orderBy(same)))
    ranked = ranked.withColumn(copies, each + F.when(F.col(number) <= left, 1).otherwise(0)).filter(F.col(copies) > 0)
    both = [x.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(copies)) for x in (even, ranked)]
    again = free_name(both[0], "_mix_again")
    return both[0].union(both[1]).withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
