"""Links between sets that share a table key, confirmed on the whole sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regista.llm import common
from regista.llm.common import gathered, materialise, with_rank
from regista.llm.components import components

Test = Callable[[DataFrame], DataFrame]

#: Members of a block that one row of an array holds; more of them make more rows, which a join can deal out.
CHUNK = 512
#: Pairs of a node that are tested in a turn, the likeliest ones, and how many of them a chunk offers.
LIKELY, OFFERED = 16, 3
#: Turns go on while at least one in so many of the tested pairs is linked.
YIELD = 500
#: Pairs of the rest that are tested at a time.
REST = 2_000_000
#: A pair is not likely if so many standard deviations more of its lanes differ than of pairs at the threshold on average.
SPREAD = 4
#: Lanes of a sketch, one bit each, and longs that hold them.
LANES = 256
WORDS = LANES // 64
#: Longs of a parity map, of 64 bits each, and how many of them are looked at first.
PARITIES, FEW = 16, 4
#: Members of a block of which all meet in one task; more of them are dealt to the tasks of pairs of parts.
MEET = 2048


def confirmed(pairs: DataFrame, items: DataFrame, alike: Callable[[Column, Column], Column]) -> DataFrame:
    """The pairs (a, b) for which alike(x, y) holds. items has a row (id, items) for each id of pairs."""
    return (
        pairs.join(items.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        .join(items.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
        .where(alike(F.col("x"), F.col("y")))
        .select("a", "b")
    )


def live(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What of nodes (id, keys) shares a key with another: members (key, node), and node, id.

    Nodes are numbered from 0, those that share most first, so that the least
    node of a key is the most central one. Counts are combined before they are
    shuffled, and the joins are of plain rows, which can be split.
    """
    each = nodes.select("id", F.explode("keys").alias("key"))
    shared = materialise(each.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    members = materialise(each.join(shared, "key"))
    scores = members.groupBy("id").agg(F.sum("m").alias("score"))
    ranked = with_rank(scores, F.col("score").desc(), F.col("id").asc(), name="node").select("id", "node")
    return materialise(members.join(ranked, "id").select("key", "node")), materialise(ranked)


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each member (key, node) with the least node of each of its keys, one pair for a node and key however large the bucket. Minima are taken before the shuffle, and the join can be split."""
    hubs = members.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    return members.join(hubs, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()


#: Up to so many ids (8 bytes each) are broadcast to filter rows; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose column is one of the distinct ids, a table of one column, nulls included."""
    name = ids.columns[0]
    ids = ids.withColumnRenamed(name, "_among")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, F.col(column).eqNullSafe(F.col("_among")), "left_semi")


def bits_of(h: Column, lane: Column) -> list[Column]:
    """What bit_or() over a set's lanes makes its sketch of, one column for each word: the last bit of each lane's least hash h. An empty lane has 0."""
    put = F.call_function("shiftleft", h.bitwiseAND(F.lit(1)), lane.bitwiseAND(F.lit(63)).cast("int"))
    return [F.when(F.shiftright(lane, 6) == w, put).otherwise(F.lit(0).cast("long")) for w in range(WORDS)]


def most_unequal(used: Column, percent: int) -> Column:
    """Lanes in which a pair that meets the threshold may differ, SPREAD standard deviations more than on average, if so many lanes are used. The last bits of unequal minimums differ in one of two."""
    q = (1 - percent / 100) / 2
    return (used * q + F.sqrt(used * q * (1 - q)) * SPREAD).cast("int")


def _placed(members: DataFrame, known: DataFrame) -> DataFrame:
    """The members of blocks with several components: key, node, c (its component), main (the block's largest), m (the block's size)."""
    placed = materialise(members.join(known, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")))
    sizes = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("key").agg(F.sum("k").alias("m"), F.count(F.lit(1)).alias("n"), F.max_by("c", F.struct("k", -F.col("c"))).alias("main")).where("n > 1 and m > 2").drop("n")
    return materialise(placed.join(materialise(mixed), "key"))


def _offered(placed: DataFrame, sketches: DataFrame, turn: int) -> DataFrame:
    """key, node, best: for each node outside its block's main component and each chunk of the block the members of other components that are likeliest to be linked with it, as (over, node) with the most likely first, OFFERED of them; chunks, which are drawn anew in each turn, without any are left out."""
    rows = placed.join(sketches, "node")
    chunk = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("m") / CHUNK))
    words = [f"w{k}" for k in range(WORDS)]
    chunks = rows.groupBy("key", chunk.alias("chunk")).agg(F.collect_list(F.struct("node", "c", "most", *words)).alias("others"))
    outside = rows.where("open and c <> main").select("key", "node", "c", "most", *words)

    def unequal(z: Column) -> Column:
        return sum((F.bit_count(F.col(w).bitwiseXOR(z[w])) for w in words[1:]), F.bit_count(F.col(words[0]).bitwiseXOR(z[words[0]])))

    told = F.transform(F.filter("others", lambda z: z["c"] != F.col("c")), lambda z: F.struct((unequal(z) - F.greatest("most", z["most"])).alias("over"), z["node"].alias("node")))
    best = F.slice(F.array_sort(F.filter(told, lambda s: s["over"] <= 0)), 1, OFFERED)
    return materialise(outside.join(chunks.select("key", "others"), "key").select("key", "node", best.alias("best"))).where("size(best) > 0")


def _likeliest(offered: DataFrame, tested: DataFrame) -> DataFrame:
    """(a, b): of what the chunks of all blocks offer a node and is not tested yet the LIKELY likeliest pairs."""
    each = offered.select("node", F.explode("best").alias("s")).select("node", F.least("node", "s.node").alias("a"), F.greatest("node", "s.node").alias("b"), "s.over")
    each = each.groupBy("node", "a", "b").agg(F.min("over").alias("over")).join(tested, ["a", "b"], "left_anti")
    place = F.row_number().over(Window.partitionBy("node").orderBy("over", "a", "b"))
    return each.withColumn("place", place).where(F.col("place") <= LIKELY).select("a", "b").distinct()


def _sent(rows: DataFrame) -> DataFrame:
    """Materialised rows to be broadcast in a join if they are few."""
    return F.broadcast(rows) if rows.count() <= common.FEW else rows


def _told(rows: DataFrame, known: DataFrame, **of: str) -> DataFrame:
    """rows with the component of each node that is named in of, under the name given there; a node that is not in known (node, component) is a component of its own. Few components are broadcast."""
    known = _sent(known)
    for x, c in of.items():
        rows = rows.join(known.select(F.col("node").alias(x), F.col("component").alias("_component")), x, "left")
        rows = rows.withColumn(c, F.coalesce("_component", x)).drop("_component")
    return rows


def _unlike(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components."""
    return _told(pairs.select("a", "b"), known, a="ca", b="cb").where("ca <> cb").select("a", "b")


def _merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """known (node, component) with the components joined that links (a, b) join."""
    known = gathered(known)
    named = _told(links, known, a="ca", b="cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = materialise(components(named).select(F.col("id").alias("root"), F.col("component").alias("to")))
    moved = known.join(_sent(roots), F.col("component") == F.col("root"), "left").select("node", F.coalesce("to", "component").alias("component"))
    new = roots.join(_sent(known), F.col("root") == F.col("node"), "left_anti").select(F.col("root").alias("node"), F.col("to").alias("component"))
    return gathered(materialise(moved.union(new)))


def _rest(members: DataFrame, known: DataFrame, tested: DataFrame, test: Test) -> DataFrame:
    """known (node, component) after all pairs that share a key of members (key, node), lie in different components and are not among those tested have been tested.

    They are as many as the members of mixed blocks make, however unlikely, so
    they grow with the square of a block that stays in many components. About
    REST of them are tested at a time, and those that have come into one
    component meanwhile are left out.
    """
    placed = _placed(members, known).select("key", "node", "c", "m")
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / CHUNK))
    chunks = placed.groupBy("key", chunk.alias("chunk")).agg(F.collect_list(F.struct("node", "c")).alias("others"))
    others = F.filter("others", lambda z: (z["node"] > F.col("node")) & (z["c"] != F.col("c")))
    each = placed.select("key", "node", "c").join(chunks.select("key", "others"), "key").select(F.col("node").alias("a"), F.explode(others).alias("z")).select("a", F.col("z.node").alias("b"))
    pairs = materialise(each.distinct().join(tested, ["a", "b"], "left_anti"))
    return _all_tested(pairs, known, test)


def _all_tested(pairs: DataFrame, known: DataFrame, test: Test) -> DataFrame:
    """known (node, component) after the test of all pairs (a, b) that lie in different components, about REST of them at a time."""
    parts = -(-pairs.count() // REST)
    for k in range(parts):
        some = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == k)
        links = materialise(test(_unlike(some, known)))
        if links.take(1):
            known = _merged(known, links)
    return known


def linked(stars: DataFrame, members: DataFrame, sketches: Callable[[DataFrame], DataFrame], test: Test, percent: int) -> DataFrame:
    """Components (node, component) of the confirmed links between the nodes of members (key, node).

    stars are the pairs that star_pairs() makes of the table keys: they are
    tested first. Central nodes have small numbers and so are the hubs of
    their buckets, to which most copies are linked directly. members are the
    blocks for what is left; sketches gives (node, used, words), a bit of each
    of LANES lanes of a one-permutation MinHash, for a table of nodes. test
    gives the linked ones of a table of pairs (a, b).

    A pair inside a component cannot change the components. So in each turn,
    in each block that has several components, each node outside the block's
    largest one is held against the members of the others by their sketches,
    and the likeliest pairs of each node are tested, in the next turn the next
    likely ones, as long as at least one in YIELD of them is linked. A block
    is joined with its chunks, so the rows that are made grow with its nodes
    outside the main component times its chunks only; chunks have about CHUNK
    members, and the rows of a hot block are dealt to many tasks. These turns
    only bring components together early: at the end all pairs that share a
    key and still lie in different components are tested, so no link is lost.
    Nodes without a link have no row in the result.
    """
    links = materialise(test(stars))
    known = materialise(components(links).withColumnRenamed("id", "node"))
    tested, turn = stars, 0
    placed = _placed(members, known).withColumn("open", F.lit(True))
    described = sketches(placed.select("node").distinct())
    described = materialise(described.select("node", most_unequal(F.col("used"), percent).alias("most"), "words.*"))
    while True:
        offered = _offered(placed, described, turn)
        pairs = materialise(_likeliest(offered, tested))
        more = materialise(test(pairs))
        n = more.count()
        if n:
            known = _merged(known, more)
        tested, turn = tested.union(pairs), turn + 1
        if n * YIELD < pairs.count() or not n:
            return _rest(members, known, tested, test)
        open_ = materialise(offered.select("key", "node").distinct().withColumn("open", F.lit(True)))
        placed = _placed(members.join(open_.select("key").distinct(), "key", "left_semi"), known)
        placed = placed.join(open_, ["key", "node"], "left").withColumn("open", F.coalesce("open", F.lit(False)))


def parities(items: DataFrame) -> DataFrame:
    """node, n, p0, p1, ... for the distinct items (node, h) of sets: their number, and for each of 64 * PARITIES bits whether an odd number of items falls to it.

    An item that one of two sets has alone changes one bit, so their maps never
    differ in more bits than there are such items.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 52).bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftrightunsigned("h", 58).cast("int") % PARITIES
    each = items.select("node", word.alias("word"), bit.alias("bit"))
    return each.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"p{k}") for k in range(PARITIES)])


def _mixed(members: DataFrame, known: DataFrame) -> DataFrame:
    """The members of blocks of more than two with several components: key, node, c (its component), m (the block's size)."""
    placed = materialise(_told(members.select("key", "node"), known, node="c").select("key", "node", "c"))
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("low"), F.max("c").alias("high"))
    return materialise(placed.join(sizes.where("low < high and m > 2").select("key", "m"), "key"))


def _possible(placed: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """(a, b, apart): the pairs of members of one block (key, node, c, m), of different components c, that can meet the threshold by their sizes and parity maps; apart is the share of their items in which they differ at least, in millionths, by the first FEW longs of their maps.

    A similarity of percent bounds the number of items that only one of the two
    has, and no pair that keeps this bound is left out. Pairs are told apart
    inside the join, so that only possible ones become rows, in the block of
    the least key that both have.
    """
    parts = F.ceil(F.col("m") / MEET)
    own = F.pmod(F.xxhash64("node"), parts)
    words = [f"p{k}" for k in range(PARITIES)]
    keys = placed.groupBy("node").agg(F.collect_list("key").alias("keys"))
    rows = materialise(placed.join(keys.join(maps, "node"), "node"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))

    def side(x: str, *deal: Column) -> DataFrame:
        return rows.select("key", *deal, F.col("node").alias(x), F.col("c").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("keys").alias(f"keys{x}"), *[F.col(w).alias(f"{x}{w}") for w in words])

    pairs = side("a", own.alias("i"), every.alias("j")).join(side("b", every.alias("i"), own.alias("j")), ["key", "i", "j"])
    differ = [F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in words]
    few = sum(differ[1:FEW], differ[0])
    both = F.col("na") + F.col("nb")
    most = F.floor(both * (100 - percent) / (100 + percent))
    sized = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    once = F.array_min(F.array_intersect("keysa", "keysb")) == F.col("key")
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sized & (few <= most) & (sum(differ[FEW:], few) <= most) & once)
    return pairs.select("a", "b", F.floor(few * 1_000_000 / both).alias("apart"))


def linked_sets(stars: DataFrame, members: DataFrame, items: Callable[[DataFrame], DataFrame], test: Test, percent: int) -> DataFrame:
    """Components (node, component) of all links between the nodes of members (key, node) that share a key; items gives the distinct hashes (node, h) of the sets of a table of nodes, and test the linked ones of a table of pairs (a, b).

    stars are the pairs that star_pairs() makes of the table keys: they are
    tested first. A pair inside a component cannot change the components, so
    what is left are the pairs of blocks with several components. Those that
    parity maps rule out are no links, whatever the block; of the others the
    likeliest pair of each node is tested, and then all that still lie in
    different components. No link is lost. Nodes without a link have no row in
    the result.
    """
    known = gathered(materialise(components(test(stars)).withColumnRenamed("id", "node")))
    placed = _mixed(members, known)
    maps = parities(items(placed.select("node").distinct()))
    pairs = materialise(_possible(placed, maps, percent).join(stars, ["a", "b"], "left_anti"))
    each = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.struct("apart", "a", "b").alias("pair"))
    likely = materialise(each.groupBy("node").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct())
    links = materialise(test(likely))
    if links.take(1):
        known = _merged(known, links)
    # what has come into one component is left out first: most pairs of a group of near copies have
    return _all_tested(materialise(_unlike(pairs, known).join(likely, ["a", "b"], "left_anti")), known, test)
