"""N-gram Jaccard join over prefix trees: linked documents and their components.

Two documents are linked when the Jaccard similarity of their sets of word n-grams
reaches a threshold.  No link between different sets is lost, and none is reported
that was not computed exactly:

1. One pass over the texts gives each document the 64-bit hash of its set (equal sets
   are one class from here on) and the lowest quarter of its n-gram hashes.
2. A set can only have partners if its rarest ``p = n - ceil(t * n) + 1`` n-grams hold
   one that another set has.  Sets with ``p`` n-grams of their own in the lowest quarter
   are done: one count over that quarter finds them.
3. For the rest, n-grams are ordered by frequency; shared ones among the ``p`` rarest
   bind sets into candidate clusters.  Sets whose lowest quarter holds too few rare
   n-grams do this over all their n-grams.
4. Each cluster is joined in a trie: sets as paths of n-grams in one order, frequent
   first, inserted one by one; a probe walks the trie carrying the overlap of the path
   so far, shared by all sets below, and leaves a subtree when even the remaining
   lengths cannot reach the threshold.
5. Clusters of more than ``CHUNK`` sets are dealt by their most likely originals: of all
   sets that share a rare n-gram with it, a set takes the one with the fewest n-grams of
   its own.  An original's sets are cut into chunks of about ``CHUNK``, each joined in a
   trie together with the original, so that near copies of one text hang together
   through it.  What is then still apart is decided pair by pair, for pairs that share
   one of their rarest n-grams and stand in different components; sets of a frequent
   n-gram are dealt over tasks.

Hashes: 64 bits an n-gram and a class, so wrong equality is possible in principle (a
chance of about 1e-9 in a quarter of a million documents).

Defined results: a null or word-less text has an empty set and is linked with nothing;
fewer words than ``n`` give one n-gram of all of them; equal sets are linked; a repeated
row is a document of its own with the same id; rows with a null id are answered with
their group's smallest id, if it has one; an empty table gives an empty result; other
columns of any name are not read, and a column that has the name of the text or id
column in other letters of case is another column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .graph import components

#: Sets of one trie at most; distinct words kept by a task; sets a task remembers.
CHUNK, CACHE_WORDS, CACHE_SETS = 256, 120_000, 60_000
#: N-gram hashes below 2**62 are the lowest quarter; of these, 48 bits are kept.
LOW, LOW_SHIFT, LOW_BYTES = 62, 14, 6
#: N-grams of the lowest quarter in more sets than this are left to step 3's second half.
COLD = 64
#: Sets that share an n-gram and are held against others in one task, about.
HOT = 1024
#: Bits of the filters that spare other documents; their size is fixed, a full filter only spares fewer.
FILTER_BITS = 1 << 26
#: Bits of one bucket of Spark's bitmap functions; value v is bit (v - 1) % BUCKET_BITS of bucket (v - 1) / BUCKET_BITS + 1.
BUCKET_BITS = 32768


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _odd(k: int) -> np.uint64:
    """The k-th multiplier: an odd number from a hash of k."""
    return np.uint64(xxhash.xxh3_64_intdigest(b"multiplier%d" % k) | 1)


def shingle_sets(texts: list[str | None], n: int, known: _Hashes) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each whole text; A-Z lower-cased, words parted by ASCII white space."""
    if len(known) > CACHE_WORDS:
        known.clear()
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        if not words:
            out.append(np.zeros(0, np.uint64))
        elif len(words) < n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"%d " % len(words) + b" ".join(words))], np.uint64))
        else:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            m = len(words) - n + 1
            s = np.zeros(m, np.uint64)
            for k in range(n):
                s += h[k : k + m] * _odd(k)
            s ^= s >> np.uint64(32)
            s *= _odd(n)
            s ^= s >> np.uint64(29)
            s.sort()
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if m > 1 else s)
    return out


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _prefix(n: Column, percent: int) -> Column:
    """n - ceil(n * percent / 100) + 1."""
    return n - F.floor((n * percent + 99) / 100) + 1


def _seen(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, key, n, sid, low): key is a hash of id and text; low is null where the task has given that set's before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        known, had = _Hashes(), set()
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                sets = shingle_sets(b["t"].to_pylist(), n, known)
                ids = [set_id(s) for s in sets]
                if len(had) > CACHE_SETS:
                    had.clear()
                low: list[bytes | None] = []
                for s, k in zip(sets, ids):
                    if k in had or not len(s):
                        low.append(None)
                        continue
                    had.add(k)
                    part = s[: np.searchsorted(s, np.uint64(1 << LOW))] >> np.uint64(LOW_SHIFT)
                    low.append(part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES].tobytes())
                yield pa.RecordBatch.from_arrays([b["id"], b["key"], pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array(low, pa.binary())], names=["id", "key", "n", "sid", "low"])
        known.clear()
        had.clear()
        common.forget()

    id_, text = common.col(id_col).cast("bigint"), common.col(text_col)
    return df.select(id_.alias("id"), text.alias("t"), row_key(id_, text).alias("key")).mapInArrow(run, "id bigint, key bigint, n bigint, sid bigint, low binary")


def row_key(id_: Column, text: Column) -> Column:
    """64 bits for an id and its text."""
    return F.xxhash64(id_, text)


def _unpacked(width: int, member=None):
    """Rows (token, sid) from packed tokens; only sids in the filter, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                if member is not None:
                    b = b.filter(pa.array(_in(member.value, b["pos"])))
                raw, sid = b["low"].to_pylist(), b["sid"].to_numpy()
                flat = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
                token = np.zeros((len(flat), 8), np.uint8)
                token[:, :width] = flat
                yield pa.RecordBatch.from_arrays([pa.array(token.view("<i8").ravel()), pa.array(np.repeat(sid, [len(x) // width for x in raw]))], names=["token", "sid"])
        common.forget()

    return run


TOKENS = "token bigint, sid bigint"


def _position(x: Column) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(FILTER_BITS))


def _filter(df: DataFrame, col: str):
    """A broadcast bit filter of fixed size over the values of a column."""
    pos = _position(F.col(col)) + 1  # Spark's buckets start at value 1
    rows = df.select(F.bitmap_bucket_number(pos).alias("k"), F.bitmap_bit_position(pos).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    bits = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
    for r in rows.toLocalIterator():  # FILTER_BITS / 8 bytes at most
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[r["k"] * len(part) : (r["k"] + 1) * len(part)] = part
    return df.sparkSession.sparkContext.broadcast(bits)


def _in(bits: np.ndarray, pos: pa.Array) -> np.ndarray:
    p = pos.to_numpy()
    one = BUCKET_BITS + p
    return (bits[one >> 3] >> (one & 7).astype(np.uint8)) & 1 == 1


def _rarest(tokens: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(sid, n, token, df, rn): rank of each set's n-grams by frequency; df is null for those of one set only."""
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    w = Window.partitionBy("sid").orderBy(F.coalesce("df", F.lit(1)), "token")  # a set's own n-grams: bounded by its text
    return tokens.join(shared, "token", "left").join(sizes.select("sid", "n", "own"), "sid").withColumn("rn", F.row_number().over(w))


class SetTrie:
    """Sets as paths of ranked tokens; edges hold runs of tokens."""

    def __init__(self, percent: int):
        self.percent = percent
        self.root = [np.zeros(0, np.int64), {}, [], 1 << 60, 0]  # run, children by first token, sets that end here, least and most size below

    def insert(self, tokens: np.ndarray, who: int) -> None:
        node, at, n = self.root, 0, len(tokens)
        while True:
            node[3], node[4] = min(node[3], n), max(node[4], n)
            if at == n:
                node[2].append(who)
                return
            child = node[1].get(int(tokens[at]))
            if child is None:
                node[1][int(tokens[at])] = [tokens[at:], {}, [who], n, n]
                return
            run = child[0]
            m = min(len(run), n - at)
            differ = np.flatnonzero(run[:m] != tokens[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(run):  # the run is cut where the paths part
                upper = [run[:same], {int(run[same]): child}, [], child[3], child[4]]
                child[0] = run[same:]
                node[1][int(tokens[at])] = child = upper
            node, at = child, at + same

    def probe(self, tokens: np.ndarray, universe: int) -> list[int]:
        """Sets in the trie whose similarity with ``tokens`` reaches the threshold."""
        percent, n, found = self.percent, len(tokens), []
        inside = np.zeros(universe, bool)
        inside[tokens] = True
        todo = [(c, 0, 0) for c in self.root[1].values()]
        while todo:
            (run, children, ends, least, most), overlap, depth = todo.pop()
            overlap += int(np.count_nonzero(inside[run]))
            depth += len(run)
            left = n - int(np.searchsorted(tokens, run[-1], "right"))
            # the size below that leaves most room: as many tokens left as the probe has
            size = min(max(depth + left, least), most)
            reach = overlap + min(left, size - depth)
            if 100 * reach < percent * (n + size - reach):
                continue
            if ends and 100 * overlap >= percent * (n + depth - overlap):
                found += ends
            todo += [(c, overlap, depth) for c in children.values()]
        return found


def trie_links(sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """For each set the place of the first set of its component, by an exact trie join, and its number of links."""
    root, degree = list(range(len(sets))), [0] * len(sets)

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    if not sets:
        return root, degree
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")  # frequent first, so that paths share their beginnings
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ranked = np.split(rank[token], np.cumsum([len(s) for s in sets])[:-1])
    trie = SetTrie(percent)
    for k, s in enumerate(ranked):
        s = np.sort(s)
        for other in trie.probe(s, len(order)):
            a, b = find(k), find(other)
            root[max(a, b)] = min(a, b)
            degree[k] += 1
            degree[other] += 1
        trie.insert(s, k)
    return [find(k) for k in range(len(sets))], degree


def _joined(sets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that give the local components of the groups in ``placed`` (sid, cluster, chunk), each joined in a trie."""

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["sid"].to_numpy(), kind="stable")
        sid, raw = group["sid"].to_numpy()[order], group["tokens"].to_pylist()
        root, _ = trie_links([np.frombuffer(raw[k], "<u8") for k in order], percent)
        first = sid[root]
        linked = sid != first
        if len(sid) >= CHUNK:
            common.forget()
        return pa.table({"a": pa.array(sid[linked]), "b": pa.array(first[linked])})

    return sets.join(placed, "sid").select("cluster", "chunk", "sid", "tokens").groupBy("cluster", "chunk").applyInArrow(run, "a bigint, b bigint")


def _part(parts: Column | int, seed: int = 5) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "sid"), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                keep = []
                for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist()):
                    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    o = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * o >= percent * (len(x) + len(y) - o))
                yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    x = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _links(sets: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that give the components of all sets.  ``prefixes``: kind, token, sid, n, rn, own."""
    held = prefixes.groupBy("kind", "token").agg(F.min("sid").alias("head"), F.max("sid").alias("tail"), F.min(F.struct("own", "sid")).alias("best"))
    held = held.where("head <> tail").select("kind", "token", "head", "best")
    # one row a token on the right: the rows of a frequent one are split by AQE, however many there are
    bound = prefixes.join(held, ["kind", "token"]).groupBy("sid", "head").agg(F.min("best").alias("best"))
    bound = common.stage(bound, "jaccard-bound")
    clusters = components(bound.select(F.col("sid").alias("a"), F.col("head").alias("b"))).select(F.col("id").alias("sid"), F.col("root").alias("cluster"))
    clusters = common.stage(clusters, "jaccard-clusters")
    large = clusters.groupBy("cluster").agg(F.count("*").alias("c")).where(F.col("c") > CHUNK).select("cluster")
    large = common.stage(large, "jaccard-large")
    small = clusters.join(large, "cluster", "left_anti").select("sid", "cluster", F.lit(0).alias("chunk"))
    if large.limit(1).count() == 0:
        return common.stage(_joined(sets, small, percent), "jaccard-links")
    member = common.stage(clusters.join(large, "cluster", "left_semi"), "jaccard-member")
    origin = bound.groupBy("sid").agg(F.min("best")["sid"].alias("origin")).join(member.select("sid"), "sid", "left_semi")
    sizes = origin.groupBy("origin").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    dealt = common.stage(origin.join(sizes, "origin").select("sid", "origin", _part(F.col("parts"), 1).alias("chunk")), "jaccard-dealt")
    # clusters and originals are both named by sets; chunks of originals are counted from 1
    dealt = dealt.select("sid", F.col("origin").alias("cluster"), (F.col("chunk") + 1).alias("chunk"))
    placed = dealt.unionByName(dealt.select(F.col("cluster").alias("sid"), "cluster", "chunk")).distinct()
    links = common.stage(_joined(sets, small.unionByName(placed), percent), "jaccard-links")
    roots = components(links).select(F.col("id").alias("sid"), "root")
    comp = common.stage(member.join(roots, "sid", "left").select("sid", F.coalesce("root", "sid").alias("comp")), "jaccard-comps")
    # what is still apart: pairs of different components that share one of their rarest n-grams
    all_own = common.stage(prefixes.drop("own").join(comp, "sid"), "jaccard-own")
    mixed = all_own.groupBy("kind", "token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("c0 <> c1")
    own = common.stage(all_own.join(mixed.select("kind", "token", "parts"), ["kind", "token"]), "jaccard-apart")
    # sets of a frequent n-gram are dealt out, so that no task meets more than about HOT of them at once
    other = own.select("kind", "token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("sid").alias("b"), F.col("n").alias("m"), F.col("rn").alias("rm"), F.col("comp").alias("comp_b"))
    own = own.withColumn("part", _part(F.col("parts")))
    # at the first n-gram that both share, no more can follow than stand behind it
    reach = F.least(F.col("n") - F.col("rn"), F.col("m") - F.col("rm")) + 1
    pairs = own.join(other, ["kind", "token", "part"]).where("comp < comp_b").where(F.col("m") * 100 >= F.col("n") * percent).where(F.col("n") * 100 >= F.col("m") * percent)
    pairs = pairs.where(reach * (100 + percent) >= (F.col("n") + F.col("m")) * percent)
    # both sets' rarest n-grams are held against each other before any whole set is moved
    rarest = all_own.groupBy("kind", "sid").agg(F.collect_list("token").alias("ts"))  # a set's own: bounded by its text
    pairs = pairs.select("kind", F.col("sid").alias("a"), "b", "n", "m").distinct()
    pairs = pairs.join(rarest.select("kind", F.col("sid").alias("a"), F.col("ts").alias("x")), ["kind", "a"]).join(rarest.select("kind", F.col("sid").alias("b"), F.col("ts").alias("y")), ["kind", "b"])
    n, m = F.col("n"), F.col("m")
    after = F.greatest(n - _prefix(n, percent), m - _prefix(m, percent))  # n-grams behind the rarest ones
    close = (F.size(F.array_intersect("x", "y")) + after) * (100 + percent) >= (n + m) * percent
    apart = _verified(common.stage(pairs.where(close).select("a", "b").distinct(), "jaccard-pairs"), sets, percent)
    return common.stage(links.unionByName(apart), "jaccard-links")


def _grouped(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, n, sid, low) and classes of equal sets (sid, id, n, root); classes of one root hang together."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    seen = common.stage(_seen(df, id_col, text_col, n), "jaccard-seen")
    packed = seen.where(F.col("low").isNotNull()).select("sid", "low")

    held = packed.mapInArrow(_unpacked(LOW_BYTES), TOKENS).groupBy("token").agg(F.min("sid").alias("a"), F.max("sid").alias("b"))
    alone = common.stage(held.where("a = b").groupBy(F.col("a").alias("sid")).agg(F.count("*").alias("alone")), "jaccard-alone")
    classes = common.stage(seen.groupBy("sid").agg(F.min("id").alias("id"), F.max("n").alias("n")), "jaccard-classes")
    p = _prefix(F.col("n"), percent)
    rest = common.stage(classes.where("n > 0").join(alone, "sid", "left").where(F.coalesce("alone", F.lit(0)) < p).select("sid", "id", "n", F.coalesce("alone", F.lit(0)).alias("own")), "jaccard-rest")

    member = _filter(rest, "sid")
    tokens = packed.withColumn("pos", _position(F.col("sid"))).mapInArrow(_unpacked(LOW_BYTES, member), TOKENS).distinct()
    ranked = common.stage(_rarest(common.stage(tokens, "jaccard-tokens"), rest, percent), "jaccard-ranked")
    cold = F.coalesce("df", F.lit(1)) <= COLD
    first = ranked.where(F.col("df").isNotNull() & cold & (F.col("rn") <= p)).select(F.lit(0).alias("kind"), "token", "sid", "n", "rn", "own")
    enough = ranked.where(cold).groupBy("sid").agg(F.count("*").alias("cold"))
    heavy = common.stage(rest.join(enough, "sid", "left").where(F.coalesce("cold", F.lit(0)) < p).select("sid", "id", "n", "own"), "jaccard-heavy")

    needed = common.stage(heavy.select("sid").unionByName(first.select("sid")).distinct().join(rest, "sid"), "jaccard-needed")
    chosen = _filter(needed, "id")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        known = _Hashes()
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                b = b.filter(pa.array(_in(chosen.value, b["pos"])))
                sets = shingle_sets(b["t"].to_pylist(), n, known)
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["sid", "tokens"])
        known.clear()
        common.forget()

    texts = df.select(common.col(text_col).alias("t"), _position(common.col(id_col).cast("bigint")).alias("pos"))
    sets = texts.mapInArrow(again, "sid bigint, tokens binary").join(needed.select("sid"), "sid", "left_semi")
    sets = common.stage(sets.groupBy("sid").agg(F.first("tokens").alias("tokens")), "jaccard-sets")

    all_tokens = sets.join(heavy.select("sid"), "sid", "left_semi").select("sid", F.col("tokens").alias("low")).mapInArrow(_unpacked(8), TOKENS)
    second = _rarest(all_tokens, heavy, percent).where(F.col("df").isNotNull() & (F.col("rn") <= p)).select(F.lit(1).alias("kind"), "token", "sid", "n", "rn", "own")
    prefixes = common.stage(first.unionByName(second), "jaccard-prefixes")

    roots = components(_links(sets, prefixes, percent)).select(F.col("id").alias("sid"), "root")
    grouped = classes.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    return seen, common.stage(grouped, "jaccard-grouped")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row; see the module's text."""
    seen, grouped = _grouped(df, id_col, text_col, n, percent)
    least = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    answer = common.stage(grouped.join(least, "root").select("sid", "component_id"), "jaccard-answer")
    done = seen.select("id", "n", "sid").join(answer, "sid")
    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``df`` that stay if one row of each linked group stays, in all columns.

    The row with the smallest id stays (null ids come last), of several rows with that id
    the one whose hash of id and text is least, and of rows equal in both the one whose
    hash over all columns is least; rows that are equal altogether count as one.  Rows of
    one id with different texts are different documents.  Wordless texts are linked with
    nothing, so each (id, text) of them stays.
    """
    seen, grouped = _grouped(df, id_col, text_col, n, percent)
    rows = seen.select("id", "key", "n", "sid").join(grouped.select("sid", "root"), "sid")
    first = F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"]
    stay = rows.groupBy((F.col("n") == 0).alias("bare"), F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("root")).alias("group")).agg(first.alias("key"))
    stay = common.stage(stay.select("key"), "jaccard-stay")
    key, look = common.free_name(df, "__key"), common.free_name(df, "__look")
    keyed = df.withColumns({key: row_key(common.col(id_col).cast("bigint"), common.col(text_col)), look: F.xxhash64(*common.hashable(df))})
    chosen = keyed.select(key, look).join(stay.withColumnRenamed("key", key), key, "left_semi").groupBy(key).agg(F.min(look).alias("least"))
    chosen = common.stage(chosen.select(F.col(key).alias("k"), "least"), "jaccard-chosen")
    kept = keyed.join(chosen, (F.col(key) == F.col("k")) & (F.col(look) == F.col("least")), "left_semi")
    return kept.dropDuplicates([key]).drop(key, look)


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
