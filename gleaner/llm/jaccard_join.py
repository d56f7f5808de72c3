"""N-gram Jaccard join by prefix trees, and the classes that its links form.

A document's set holds its distinct word n-grams (64-bit hashes), in a global order from a count-min sketch of all
documents: by level of estimated frequency, then by hash. Any order that all sets share gives exact results. From it
follow, without loss:

* A set of which too few n-grams may occur elsewhere has no link. It is set aside at once.
* Equal sets are one class; one representative of each goes on.
* Two linked sets share an n-gram of their prefixes (the n - ceil(t n) + 1 rarest), and their sizes differ by one band
  at most. A posting is the holders of a prefix n-gram in a band, its hub the smallest of them. All holders of all
  postings of a hub meet in one group, so two linked sets meet in some group, and a set goes only once to each of its
  hubs. A group of more than ``BLOCK`` sets is dealt by its single postings where these make fewer pairs; what is still
  larger is cut into blocks, of which each pair is joined in one task. Nothing is followed beyond a hub: sets that are
  only tied through others never meet.
* A group is joined by a trie: sets are stored as paths in the global order, frequent n-grams first, without those that
  occur in one document only. A probe walks the trie with the overlap so far, which sets below share, and leaves a
  subtree when even its whole remaining length can't reach the threshold, or when all sets below are already in the
  probe's class. So a task returns links that span its classes, not all pairs.

A hot n-gram or a class of many copies is never gathered: counts are pre-aggregated and joins on n-grams spread
their hot keys. Defined results: NULL, empty and wordless texts have n_shingles 0 and are linked with nothing; a
text of fewer words than n is one n-gram; of rows with equal doc_id each gets the class of its own
set, and sets whose smallest holder is the same doc_id share its class; a row without doc_id is linked with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import sketch
from gleaner.llm.textkernel import Chunk, chunks, mix, rolling
from gleaner.operators.graph import connected_components
from gleaner.operators.skew import join_counted
from gleaner.workspace import Workspace

#: Sketch counts at which an n-gram reaches the next level of the order, and the log2 bits of each level's bitmap.
LEVELS, FOLDS = [2, 3, 6, 16, 128, 1024], [28, 26, 25, 24, 24, 24]
BLOCK = 512


def shingle_sets(chunk: Chunk, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each row; a row of fewer than n words is one gram."""
    words = chunk.word_hash()
    grams = rolling(words, n)
    out = []
    for a, b in zip(chunk.word_at[:-1].tolist(), chunk.word_at[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(rolling(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(n: int, percent: int) -> int:
    """The smallest intersection that a set of n can have with a set it is linked to."""
    return -(-percent * n // 100)


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def size_band(size: Column, percent: int) -> Column:
    """A set's band of sizes, on a scale whose steps are the ratio 100 / percent: linked sets are at most one band apart."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(100.0 / percent)) * (1 - 1e-9)).cast("int") if percent < 100 else size.cast("int") * 2


def _sets(sent, n: int, percent: int):
    names = ["doc_id", "n_shingles", "k1", "k2", "tokens", "levels", "prefix"]

    def of(batches):
        marks = sent.value
        for batch in batches:
            for c in chunks(batch.column("text"), lower=True):
                sizes, rest = [], [[] for _ in names[2:]]
                sets = shingle_sets(c, n)
                whole = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                level = marks.reach(whole).astype(np.int8)
                for at in range(1, len(LEVELS)):
                    some = np.flatnonzero(level == at)
                    level[some] += marks.reach(whole[some], at)
                edge = np.cumsum([0, *(len(s) for s in sets)])
                for i, s in enumerate(sets):
                    sizes.append(len(s))
                    own = level[edge[i] : edge[i + 1]]
                    least = least_overlap(len(s), percent)
                    if not len(s) or np.count_nonzero(own) < least:
                        for x in rest:
                            x.append(None)
                        continue
                    again = np.flatnonzero(own)
                    order = again[np.lexsort((s[again], -own[again]))]
                    # the rarest len(s) - least + 1, less those that no other document has
                    head = order[min(least - 1, len(order)) :]
                    with np.errstate(over="ignore"):
                        keys = [int(mix(s ^ np.uint64(x)).sum(dtype=np.uint64).astype(np.int64)) for x in (0, 0x5851F42D4C957F2D)]
                    for x, v in zip(rest, (*keys, s[order].tobytes(), own[order].tobytes(), s[head].astype(np.int64)), strict=True):
                        x.append(v)
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.first, c.rows), pa.array(sizes, pa.int64()), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], names)

    return of


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


class _Node:
    """A stretch of tokens shared by all sets below; ``low`` and ``high`` bound the sizes of the sets below, ``long`` their paths."""

    __slots__ = ("stretch", "children", "ends", "low", "high", "long", "depth", "first", "root", "all_in")

    def __init__(self, stretch: frozenset, depth: int, first: int):
        self.stretch, self.depth, self.first, self.children, self.ends = stretch, depth, first, [], []
        self.low = self.high = self.long = 0
        self.root, self.all_in = -1, False


def _build(paths: list[np.ndarray], sizes: list[int], order: list[int]) -> _Node:
    """A compressed trie of the paths of ``order``, which is sorted by path; depth counts the tokens down to a node's end."""
    top = _Node(frozenset(), 0, -1)
    work = [(top, order, 0)]
    while work:
        node, group, at = work.pop()
        node.low, node.high = min(sizes[i] for i in group), max(sizes[i] for i in group)
        node.long = max(len(paths[i]) for i in group)
        i = 0
        while i < len(group):
            path = paths[group[i]]
            if len(path) == at:
                node.ends.append(group[i])
                i += 1
                continue
            j = i + 1
            while j < len(group) and paths[group[j]][at] == path[at]:
                j += 1
            last = paths[group[j - 1]]
            m = min(len(path), len(last))
            differ = np.flatnonzero(path[at:m] != last[at:m])
            stop = at + int(differ[0]) if len(differ) else m
            child = _Node(frozenset(path[at:stop].tolist()), stop, int(path[at]))
            node.children.append(child)
            work.append((child, group[i:j], stop))
            i = j
    return top


def global_paths(tokens: list[np.ndarray], levels: list[np.ndarray]) -> list[np.ndarray]:
    """Each set's tokens as ranks of the global order (by falling level, then by token), in which they are stored."""
    if not tokens:
        return []
    token, at, inverse = np.unique(np.concatenate(tokens), return_index=True, return_inverse=True)
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, -np.concatenate(levels)[at]))] = np.arange(len(token))
    return np.split(rank[inverse], np.cumsum([len(t) for t in tokens])[:-1])


def trie_links(paths: list[np.ndarray], sizes: list[int], probes: np.ndarray, stored: np.ndarray, own: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that span the classes formed by all links between a set of ``probes`` and one of ``stored``, of which
    one at least is in ``own``. ``sizes`` count the tokens that occur in one set only, too."""
    order = sorted(np.flatnonzero(stored).tolist(), key=lambda i: paths[i].tolist())
    if not order:
        return []
    top = _build(paths, sizes, order)
    classes, found = _Union(len(paths)), []

    def settled(node: _Node, mine: int) -> bool:
        """All sets below are in the class ``mine``; what is once in one class stays in one."""
        rest = [node]
        while rest:
            x = rest.pop()
            if x.all_in:
                if classes.find(x.root) != mine:
                    return False
                continue
            if any(classes.find(e) != mine for e in x.ends):
                return False
            rest.extend(x.children)
        node.root, node.all_in = mine, True
        return True

    for x in np.flatnonzero(probes).tolist():
        path, size = paths[x], sizes[x]
        probe = set(path.tolist())
        stack = [(top, 0)]
        while stack:
            node, common = stack.pop()
            common += len(node.stretch & probe)
            for e in node.ends:
                if e != x and linked(common, size, sizes[e], percent) and (own[x] or own[e]) and classes.find(e) != classes.find(x):
                    classes.join(e, x)
                    found.append((x, e))
            for child in node.children:
                if child.high * 100 < percent * size or child.low * percent > 100 * size:
                    continue
                # paths ascend: below, only the probe's tokens from the child's first on can still be met
                rest = min(len(path) - int(np.searchsorted(path, child.first)), child.long - node.depth)
                if (common + rest) * (100 + percent) < percent * (size + max(child.low, least_overlap(size, percent))):
                    continue
                if not settled(child, classes.find(x)):
                    stack.append((child, common))
    return found


def _join_blocks(percent: int):
    def of(table: pa.Table) -> pa.Table:
        ids, sizes = table.column("rep").to_pylist(), table.column("n_shingles").to_pylist()
        paths = global_paths([np.frombuffer(t.as_buffer(), np.uint64) for t in table.column("tokens")], [np.frombuffer(t.as_buffer(), np.int8) for t in table.column("levels")])
        block, bi, bj = table.column("block").to_numpy(), table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        pairs = trie_links(paths, sizes, block == bi, block == bj, table.column("own").to_numpy(), percent)
        return pa.table({"src": pa.array([ids[i] for i, _ in pairs], pa.int64()), "dst": pa.array([ids[j] for _, j in pairs], pa.int64())})

    return of


def _groups(one: DataFrame, work: Workspace) -> DataFrame:
    """(rep, k1, k2, hub, band, gram, own, blocks): the sets of each group, gram 0 where the hub's postings are joined together.

    A set is at home (``own``) in the smaller of its two bands. Two sets of one home are compared there and not in the
    other band that they share.
    """
    posted = one.select("rep", "k1", "k2", F.explode(F.array(F.struct(F.col("band"), F.lit(True).alias("own")), F.struct((F.col("band") + 1).alias("band"), F.lit(False).alias("own")))).alias("x"), "prefix")
    posted = posted.select("rep", "k1", "k2", "x.band", "x.own", F.explode("prefix").alias("gram"))
    held = posted.groupBy("gram", "band").agg(F.count("*").alias("holders"), F.min("rep").alias("hub"), F.max("own").alias("any")).filter("holders > 1 and any").drop("any")
    held = work.stash(held, "held")
    members = work.stash(join_counted(posted, held, ["gram", "band"], "holders", F.col("rep")).select("hub", "band", "rep", "k1", "k2", "own").distinct(), "members")
    pairs = held.groupBy("hub", "band").agg(F.sum(F.col("holders").cast("double") * F.col("holders")).alias("pairs"))
    size = members.groupBy("hub", "band").agg(F.count("*").alias("members")).join(pairs, ["hub", "band"])
    size = work.stash(size.select("hub", "band", "members", ((F.col("members") > BLOCK) & (F.col("pairs") < F.col("members").cast("double") * F.col("members"))).alias("split")), "sizes")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int").alias("blocks")
    whole = join_counted(members, size.filter("not split").drop("split"), ["hub", "band"], "members", F.col("rep")).select("rep", "k1", "k2", "hub", "band", F.lit(0).cast("long").alias("gram"), "own", blocks("members"))
    parts = work.stash(held.join(size.filter("split").select("hub", "band"), ["hub", "band"]), "parts")
    return whole.unionByName(join_counted(posted, parts, ["gram", "band"], "holders", F.col("rep")).select("rep", "k1", "k2", "hub", "band", "gram", "own", blocks("holders")))


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Documents link when 100 * |A and B| >= percent * |A or B|.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def keys(batch: pa.RecordBatch):
        for c in chunks(batch.column("text"), lower=True):
            sets = shingle_sets(c, n)
            if sets:
                yield np.concatenate(sets)

    sent = work.broadcast(sketch.mark_repeated(docs.select("text"), keys, LEVELS, 1, FOLDS))
    sets = work.stash(docs.mapInArrow(_sets(sent, n, percent), "doc_id long, n_shingles long, k1 long, k2 long, tokens binary, levels binary, prefix array<long>"), "sets")
    work.release()
    kept = sets.filter("k1 is not null and doc_id is not null")
    reps = work.stash(kept.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
    # tokens stay where they are written until groups are known; of a representative only its prefix moves before
    one = kept.select("doc_id", "k1", "k2", "n_shingles", "prefix").join(reps.select("k1", "k2", F.col("rep").alias("doc_id")), ["doc_id", "k1", "k2"])
    one = one.select(F.col("doc_id").alias("rep"), "k1", "k2", size_band(F.col("n_shingles"), percent).alias("band"), "prefix")
    one = work.stash(one.dropDuplicates(["rep", "k1", "k2"]), "one")
    ids = work.stash(sets.select("doc_id", "n_shingles", "k1", "k2"), "ids")
    cut = work.stash(_groups(one, work), "groups").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    whole = kept.select(F.col("doc_id").alias("rep"), "k1", "k2", "n_shingles", "tokens", "levels").dropDuplicates(["rep", "k1", "k2"])
    dealt = cut.join(whole, ["rep", "k1", "k2"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("rep", "hub", "band", "gram", "own", "block", "n_shingles", "tokens", "levels", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    links = work.stash(dealt.groupBy("hub", "band", "gram", "bi", "bj").applyInArrow(_join_blocks(percent), "src long, dst long"), "links")
    work.discard("sets", "one", "held", "members", "groups", "parts")
    classes = connected_components(links)
    named = reps.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "copies", F.coalesce("component", "rep").alias("component_id"))
    named = work.stash(named, "named")
    out = join_counted(ids, named, ["k1", "k2"], "copies", F.col("doc_id"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
