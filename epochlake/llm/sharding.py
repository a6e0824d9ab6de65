"""Shards of even size that keep linked documents together: groups packed whole, then balanced label propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_KEYS, attach, join_hot, persist, running

#: Shards, and rounds of propagation at most; it ends sooner when no follower finds a place.
SHARDS, ROUNDS = 24, 12
#: Rows of one shard or group that are numbered by one task.
BUCKET_ROWS = 20_000


def _numbered(rows: DataFrame, key: str, order: list[str], out: str, buckets: int) -> DataFrame:
    return running(rows.withColumn("_one", F.lit(1).cast("long")), key, order, "_one", out, buckets).drop("_one")


def exchange(wishes: dict[tuple[int, int], int], idle: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wishes (from, to) to grant, so that no shard takes more than leave it, by wishes or as one of its `idle` nodes.

    A wish is granted where a place is free, which frees one where it came from; then cycles of wishes are, which need no place.
    """
    left, slack = {k: n for k, n in wishes.items() if n and k[0] != k[1]}, list(idle)
    out: dict[tuple[int, int], int] = {}

    def grant(arcs: list[tuple[int, int]], n: int) -> None:
        for s, t in arcs:
            out[s, t] = out.get((s, t), 0) + n
            left[s, t] -= n
            if not left[s, t]:
                del left[s, t]
            slack[t] -= n
            slack[s] += n

    def cycle() -> list[tuple[int, int]]:
        done: set[int] = set()
        for start in sorted({s for s, _ in left}):
            path: list[int] = []
            todo = [(start, 0)]
            while todo:
                at, depth = todo.pop()
                del path[depth:]
                if at in path:
                    ring = [*path[path.index(at) :], at]
                    return list(zip(ring, ring[1:], strict=False))
                if at in done:
                    continue
                path.append(at)
                nxt = sorted(t for s, t in left if s == at)
                if not any(t not in done for t in nxt):
                    done.add(at)
                todo += [(t, depth + 1) for t in nxt]
            done.add(start)
        return []

    while left:
        free = next((k for k in sorted(left) if slack[k[1]] > 0), None)
        arcs = [free] if free else cycle()
        if not arcs:
            break
        grant(arcs, min(left[k] for k in arcs) if not free else min(left[free], slack[free[1]]))
    return out


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) of nodes(node), whose numbers run from 0 without gaps: linked nodes share a shard where room allows.

    Every node starts in its shard, or in node mod shards if nodes has no such column, so counts differ by one at most. In each
    round a node that has links follows the shard for which its smaller-numbered neighbours vote, each with weight one over its
    links, so that the members of small groups come first; as votes only go from smaller to larger numbers, no two nodes chase
    each other. A shard takes as many followers as leave it, and as many more as it holds nodes without links; these make room
    and fill the places that are left over. So counts never change, and what doesn't fit stays where it is for the next round.
    links(a, b) may repeat and hold loops.
    """
    total = nodes.count()
    buckets = max(64, -(-total // (BUCKET_ROWS * 8)))
    pairs = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    start = F.col("shard") if "shard" in nodes.columns else F.pmod("node", F.lit(shards))
    state = persist(nodes.join(degree, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), start.cast("int").alias("shard")))
    votes = persist(pairs.join(degree.withColumnRenamed("node", "a"), "a").select("a", "b", (1 / F.col("degree")).alias("weight")))
    for _ in range(rounds):
        label = state.select(F.col("node").alias("a"), F.col("shard").alias("to"))
        heard = votes.join(label, "a").groupBy("b", "to").agg(F.sum("weight").alias("weight"))
        wish = heard.groupBy("b").agg(F.max(F.struct("weight", (-F.col("to")).alias("minus"))).alias("best"))
        wish = wish.select(F.col("b").alias("node"), (-F.col("best.minus")).alias("to"), F.floor(4 * F.log2("best.weight")).cast("int").alias("level"))
        arc = F.col("shard").cast("long") * shards + F.col("to")
        movers = persist(state.join(wish, "node").filter("shard <> to").select("node", "shard", "to", arc.alias("arc"), (arc * 100_000 + F.col("level")).alias("rank_key"), "level"))
        free = {r["shard"]: r["n"] for r in state.filter("degree = 0").groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row for each shard
        wishes = {(r["shard"], r["to"]): r["n"] for r in movers.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}  # shards^2 rows at most
        flow = exchange(wishes, [free.get(s, 0) for s in range(shards)])
        if not flow:
            break
        # followers by both shards and level of their votes: at most a few hundred levels for each pair
        level = movers.groupBy("arc", "level", "rank_key").agg(F.count("*").alias("n"))
        ahead = Window.partitionBy("arc").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(F.col("rank_key").alias("_rank_key"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
        ranked = _numbered(movers, "rank_key", ["node"], "nth", buckets).join(level, F.col("rank_key") == F.col("_rank_key"))
        pick = lambda values, c: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (F.col(c) + 1).cast("int"))
        room = pick([flow.get((s, t), 0) for s in range(shards) for t in range(shards)], "arc")
        going = persist(ranked.filter(F.col("nth") + F.col("ahead") < room).select("node", "shard", "to"))
        net = [sum(n for (_, t), n in flow.items() if t == x) - sum(n for (s, _), n in flow.items() if s == x) for x in range(shards)]
        leave, place = [max(0, n) for n in net], [max(0, -n) for n in net]
        # those without links that make room, numbered through all shards, fill the places in the order of the shards
        gone = [sum(leave[:s]) for s in range(shards)]
        idle = _numbered(state.filter("degree = 0").select("node", "shard"), "shard", ["node"], "nth", buckets)
        idle = idle.filter(F.col("nth") < pick(leave, "shard")).withColumn("n", F.col("nth") + pick(gone, "shard"))
        to, end = F.when(F.lit(False), F.lit(0)), 0
        for s in range(shards):
            end += place[s]
            to = to.when(F.col("n") < end, F.lit(s))
        moved = going.select("node", F.col("to").alias("new")).unionByName(idle.select("node", to.alias("new")))
        state = persist(state.join(moved, "node", "left").select("node", "degree", F.coalesce("new", "shard").cast("int").alias("shard")))
    return state.select("node", "shard")


def pack(counts: dict[int, int], shards: int = SHARDS) -> list[tuple[int, int, int, int, int, int]]:
    """Places for counts[n] groups of n rows: (n, first, end, shard, from, until), where rows [from, until) of the groups [first, end) of size n go.

    Shards end at most one row apart. Larger groups come first, each into the first shard that holds it whole. A group larger
    than a shard fills whole shards; one that no shard can hold whole is split, before single rows fill what is left.
    """
    total = sum(n * c for n, c in counts.items())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    most, out, late = max(room), [], []

    def split(n: int, g: int) -> None:
        at = 0
        while at < n:
            s = max(range(shards), key=lambda x: (room[x], -x))
            take = min(n - at, room[s])
            out.append((n, g, g + 1, s, at, at + take))
            room[s] -= take
            at += take

    for n in sorted(counts, reverse=True):
        if n == 1:
            for k, g in late:
                split(k, g)
            late = []
        at = 0
        if n > most:
            for g in range(counts[n]):
                split(n, g)
            continue
        for s in range(shards):
            k = min(counts[n] - at, room[s] // n)
            if k:
                out.append((n, at, at + k, s, 0, n))
                room[s] -= n * k
                at += k
        late += [(n, g) for g in range(at, counts[n])]
    for k, g in late:
        split(k, g)
    return out


def _mark(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _mark(F.col("text")).alias("mark"),
    )


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, mark, shard, slot): every row in one of the shards, whose counts are at most one apart.

    Documents of equal texts are linked, to the first of them, and go to one shard as far as first-fit packing allows: a group
    larger than a shard fills whole shards, and one is split only if no shard could hold it when its turn came; see pack. size
    is the text's UTF-8 bytes plus 8; slot runs from 0 without gaps in each shard. A null text counts as an empty one. Null ids
    and repeated rows each have a place of their own. Other columns are ignored. `mark` is the text's MD5. No rows: no rows.
    """
    rows = persist(_narrow(docs))
    buckets = max(512, -(-rows.count() // BUCKET_ROWS))
    nodes = persist(_numbered(rows.withColumn("_all", F.lit(0)), "_all", ["mark", "doc_id"], "node", buckets).drop("_all"))
    groups = persist(nodes.groupBy("mark").agg(F.min("node").alias("a"), F.count("*").alias("n")))
    links = join_hot(nodes.select("node", "mark"), groups.filter("n > 1"), "mark").select("a", F.col("node").alias("b"))
    counts = {r["n"]: r["c"] for r in groups.groupBy("n").agg(F.count("*").alias("c")).collect()}  # sizes: at most the root of twice the rows
    places = pack(counts, shards)
    plan = docs.sparkSession.createDataFrame(places, "_n long, _first long, _end long, shard int, _from long, _until long")
    dealt = _numbered(groups.select("mark", "n"), "n", ["mark"], "group", buckets)
    dealt = persist(dealt)
    grouped = persist(join_hot(nodes.select("node", "mark"), dealt, "mark"))
    many = _numbered(grouped.filter("n > 1"), "mark", ["node"], "nth", buckets)
    each = many.unionByName(grouped.filter("n = 1").withColumn("nth", F.lit(0).cast("long")))
    fits = (F.col("n") == F.col("_n")) & F.col("group").between(F.col("_first"), F.col("_end") - 1) & F.col("nth").between(F.col("_from"), F.col("_until") - 1)
    start = each.join(F.broadcast(plan) if len(places) <= BROADCAST_KEYS else plan, fits).select("node", "shard")
    placed = nodes.join(propagate(start, links, shards, rounds), "node")
    return _numbered(placed, "shard", ["node"], "slot", max(64, buckets // 8)).drop("node")


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """docs with the columns shard and slot; see assign. Columns of docs by these names give way, all others stay.

    Rows alike in doc_id and text share out their places in the order of the hashes of all their columns.
    """
    docs = docs.drop("shard", "slot")
    placed = persist(assign(docs, shards, rounds).select("doc_id", "mark", F.struct("shard", "slot").alias("payload")))
    keys = {"doc_id": F.col("doc_id").cast("long"), "mark": _mark(F.col("text"))}
    many = placed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return attach(docs, placed, keys, many).select("row.*", "payload.*")
