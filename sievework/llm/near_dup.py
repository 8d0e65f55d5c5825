"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact check, components.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes); equal sets are one class, named by its
   least doc_id, so groups of exact copies are one row from here on.
2. A class has VALUES MinHash values, dealt into bands. Classes that agree in a band are candidates. A pair is compared in
   batches of values and dropped as soon as the posterior chance of its similarity reaching the threshold falls
   below MISS; survivors are checked on the full sets.
3. Buckets are never expanded into all pairs. In each of HUBS rounds every member of a bucket is compared with one
   hub of it; links join components, and only members outside their hub's component are compared. What then still
   spans several components of a bucket is compared block by block inside tasks, with signatures and sets at hand, so
   that no link between components is lost; only links become rows, and only as many as join components.

The threshold is a parameter of cluster(), in percent: the bands, the pruning, the size filter and the exact checks
follow it. A pair at the threshold t shares no band with chance (1 - t^rows)^bands, below UNSEEN: 30 bands of 6 values
at 85 %, 36 of 5 at 80 %.

Edge cases: texts without words have an empty set, a component of their own, and are linked with nothing; texts of
fewer than 5 words are one shingle; rows of one doc_id are one document (if their texts differ, each text is compared,
and all that they are linked with falls into one component); rows without a doc_id take no part, have a null component and are kept; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import ascii_lower, row_key, stored, whole
from sievework.operators.skew import lookup_join

SHINGLE = 5
#: Links need 100 * intersection >= percent * union; this is the percent where a caller names none.
PERCENT = 85
VALUES, BATCH = 180, 30
#: Chance below which a pair at the threshold may share no band.
UNSEEN = 1e-6
#: Chance at which a pair at the threshold may be pruned; pairs above it are pruned far more seldom.
MISS = 1e-4
HUBS = 3
#: Members of a block, and hashes of their sets, about.
BLOCK, BLOCK_HASHES = 512, 1 << 20
#: Rows of the block comparison that share a call, about, and bytes of their sets.
SLOT, SLOT_BYTES = 4096, 8 << 20
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@functools.cache
def banding(percent: int) -> tuple[int, int]:
    """(values a band, bands): the longest bands with which a pair at the threshold is unseen with a chance below UNSEEN."""
    for rows in range(VALUES, 0, -1):
        if (1 - (percent / 100) ** rows) ** (VALUES // rows) < UNSEEN:
            return rows, VALUES // rows
    raise ValueError(f"{VALUES} values are too few for a threshold of {percent} %")


ROWS, BANDS = banding(PERCENT)

_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> 64-bit hash; forgets all when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        out = self[word] = zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1], 0x5BD1E995)
        return out


_word_hash = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes of a text whose A-Z are lower-cased."""
    found = _WORDS.findall(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter((_word_hash[w] for w in found), np.uint64, len(found))
    size = min(SHINGLE, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = _mix(out * _M + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def minhash(s: np.ndarray) -> np.ndarray:
    """VALUES 32-bit MinHash values of a set."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        part = s[i : i + 1024, None] * _MULT + _ADD
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(values: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    rows, bands = banding(percent)
    keys = np.arange(1, bands + 1, dtype=np.uint64)  # a band's number is part of its keys
    grid = values[: rows * bands].reshape(bands, rows).astype(np.uint64)
    for j in range(rows):
        keys = _mix(keys * _M + grid[:, j] + np.uint64(j))
    return keys.view(np.int64)


def _beta_above(t: float, a: int, b: int) -> float:
    """Chance that a Beta(a, b) variable is above t (a, b whole): a binomial tail."""
    from math import exp, lgamma, log

    n = a + b - 1
    logs = [lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(t) + (n - j) * log(1 - t) for j in range(a)]
    return sum(map(exp, logs))


@functools.cache
def fewest_matches(threshold: float = PERCENT / 100, miss: float = MISS) -> list[tuple[int, int]]:
    """(values compared, least number of equal ones at which a pair goes on). Prior: Beta(1, 1)."""
    out = []
    for n in range(BATCH, VALUES + 1, BATCH):
        m = 0
        while _beta_above(threshold, m + 1, n - m + 1) < miss:
            m += 1
        out.append((n, m))
    return out


def survives(sig: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which of the pairs (row left[i], row right[i] of a signature matrix) no batch prunes."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), np.int64)
    done = 0
    for n, m in fewest_matches(percent / 100):
        equal[alive] += (sig[left[alive], done:n] == sig[right[alive], done:n]).sum(axis=1)
        alive = alive[equal[alive] >= m]
        done = n
        if not len(alive):
            break
    return alive


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact check of two sorted distinct sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(parts: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = []
        for text in pdf["_text"]:
            s = shingles(text)
            if len(s):
                values = minhash(s)
                k = _mix(s ^ _M)
                set_key = int(k.sum(dtype=np.uint64) % (2**63)), int(np.bitwise_xor.reduce(_mix(k))) % 2**63
                rows.append((len(s), *set_key, values.tobytes(), band_keys(values, percent)))
            else:
                rows.append((0, 0, 0, b"", np.empty(0, np.int64)))
        yield pd.concat([pdf[["_id", "_th"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n", "k1", "k2", "sig", "keys"])], axis=1)


def signed(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """_id, _th, n (set size), k1, k2 (the set's key), sig, keys; docs has _id, _th, _text."""
    lowered = docs.withColumn("_text", ascii_lower(whole(F.col("_text"))))
    return lowered.mapInPandas(lambda parts: _signatures(parts, percent), "_id long, _th long, n long, k1 long, k2 long, sig binary, keys array<long>")


def _matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), VALUES)


def _survive(percent: int) -> Callable[..., Column]:
    @F.pandas_udf(T.BooleanType())
    def survive(a: pd.Series, b: pd.Series) -> pd.Series:
        out, n = np.zeros(len(a), bool), len(a)
        if n:
            out[survives(_matrix(pd.concat([a, b])), np.arange(n), np.arange(n, 2 * n), percent)] = True
        return pd.Series(out)

    return survive


@functools.lru_cache(maxsize=64)
def _recent(text: str) -> np.ndarray:
    return shingles(text)


def _linked(percent: int) -> Callable[..., Column]:
    """Pairs come sorted by one side, so that side's set is mostly at hand."""

    @F.pandas_udf(T.BooleanType())
    def link(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([linked(_recent(x), _recent(y), percent) for x, y in zip(a, b, strict=True)], dtype=bool)

    return link


@F.pandas_udf(T.BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    """The sorted shingle hashes of each text as bytes."""
    return texts.map(lambda x: shingles(x).tobytes())


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that are links by their full sets; texts has node, text."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").where(_linked(percent)("ta", "tb")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, comp of all nodes of the links (a, b): the least node that each can reach.

    Each round a node takes the least label of its neighbours, the node that its old label names takes it as well, and
    labels are followed one step; so chains shrink by a factor a round, not by a link. Rounds go on, each written to the
    shared folder, until nothing changes."""
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("node"), "comp")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "comp": "c"}), "b").groupBy("a").agg(F.min("c").alias("c"))
        seen = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("c"))
        hooks = seen.where("c < old").select(F.col("old").alias("node"), F.lit(None).cast("long").alias("old"), "c")
        hooked = seen.unionByName(hooks).groupBy("node").agg(F.max("old").alias("old"), F.min("c").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        moved = stored(hooked.join(jump, "new").select("node", F.least("new", "far").alias("comp"), "old"), "labels")
        labels = moved.select("node", "comp")
        if not moved.where("comp <> old").limit(1).count():
            return labels


def joined_up(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, comp) after links between nodes have joined components; only components are linked and relabelled."""
    a = comps.withColumnsRenamed({"node": "a", "comp": "ca"})
    b = comps.withColumnsRenamed({"node": "b", "comp": "cb"})
    between = stored(links.join(a, "a").join(b, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "between")
    if not between.limit(1).count():
        return comps
    moved = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    return stored(comps.join(moved, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")), "components")


def _across(part: np.ndarray, kind: int, i: int, j: int, blk: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to compare of one bucket in one meeting: core with others, or block i with block j."""
    if kind == 0:
        left, right = part[core[part]], part[~core[part]]
    elif i != j:
        left, right = part[blk[part] == i], part[blk[part] == j]
    else:
        a, b = np.triu_indices(len(part), 1)
        return part[a], part[b]
    return np.repeat(left, len(right)), np.tile(right, len(left))


#: Pairs compared at once.
PAIRS = 1 << 14


class _Sets:
    """The shingle sets of a call's rows, as places in one vocabulary, so that one set is checked against many at once."""

    def __init__(self, packed: pd.Series):
        sets = [np.frombuffer(x, np.uint64) for x in packed]
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.ends = np.cumsum(self.sizes)
        words, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids = ids.astype(np.int32)
        self.mark = np.zeros(len(words), bool)

    def of(self, row: int) -> np.ndarray:
        return self.ids[self.ends[row] - self.sizes[row] : self.ends[row]]

    def linked(self, row: int, others: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """Which of the other rows are links of the row: the exact check."""
        own, n = self.of(row), self.sizes[others]
        self.mark[own] = True
        held = self.mark[np.concatenate([self.of(x) for x in others])]
        self.mark[own] = False
        both = np.add.reduceat(held, np.cumsum(n) - n, dtype=np.int64)
        return 100 * both >= percent * (len(own) + n - both)


class _Joined(dict):
    """Component -> the component that it has joined in this call."""

    def root(self, x: int) -> int:
        while x in self:
            x = self[x]
        return x

    def unite(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y


def _blocks(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between components, of the meetings of many buckets. A link between components that other links of this
    call have joined already is left out, as it joins nothing; so there are fewer links than components."""
    pdf = pdf.sort_values(["key", "kind", "i", "j"], ignore_index=True)
    sig, node, comp = _matrix(pdf["sig"]), pdf["node"].to_numpy(), pdf["comp"].to_numpy().copy()
    blk, core = pdf["blk"].to_numpy(), pdf["core"].to_numpy()
    where = pdf[["key", "kind", "i", "j"]].to_numpy()
    cuts = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
    band = pdf["band"].to_numpy()
    rows, bands = banding(percent)
    sets, joined = _Sets(pdf["set"]), _Joined()
    found: list[tuple[int, int]] = []
    lefts, rights, waiting = [], [], 0

    def compare(l: np.ndarray, r: np.ndarray) -> None:  # noqa: E741
        apart = comp[l] != comp[r]
        l, r = l[apart], r[apart]  # noqa: E741
        n, m = sets.sizes[l], sets.sizes[r]
        near = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        l, r = l[near], r[near]  # noqa: E741
        alive = survives(sig, l, r, percent)
        l, r = l[alive], r[alive]  # noqa: E741
        agree = (sig[l] == sig[r])[:, : rows * bands].reshape(-1, bands, rows).all(axis=2)
        first = agree.any(axis=1) & (agree.argmax(axis=1) == band[l])  # each pair is told by its first common band
        l, r = l[first], r[first]  # noqa: E741
        order = np.argsort(l, kind="stable")
        l, r = l[order], r[order]  # noqa: E741
        before = len(found)
        for own in np.split(np.arange(len(l)), np.flatnonzero(l[1:] != l[:-1]) + 1) if len(l) else ():
            row, others = l[own[0]], r[own]
            for x in others[sets.linked(row, others, percent)]:
                if joined.unite(int(comp[row]), int(comp[x])):
                    found.append((min(node[row], node[x]), max(node[row], node[x])))
        if len(found) > before:
            names, at = np.unique(comp, return_inverse=True)
            comp[:] = np.array([joined.root(int(x)) for x in names])[at]

    def compare_all() -> None:
        left, right = np.concatenate(lefts), np.concatenate(rights)
        for x in range(0, len(left), PAIRS):
            compare(left[x : x + PAIRS], right[x : x + PAIRS])
        lefts.clear()
        rights.clear()

    for part in np.split(np.arange(len(pdf)), cuts):
        _, kind, i, j = where[part[0]]
        left, right = _across(part, kind, i, j, blk, core)
        lefts.append(left)
        rights.append(right)
        waiting += len(left)
        if waiting >= PAIRS:
            compare_all()
            waiting = 0
    if lefts:
        compare_all()
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def spanning_buckets(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """key, band, node, comp, core (in the bucket's largest component), cores and outs (blocks of either kind), of the
    buckets that hold more than one component. Of buckets with the same members the one of the least band stands for all."""
    labelled = buckets.select("key", "band", "node", "n").join(comps, "node")
    sizes = labelled.groupBy("key", "band", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("h"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("x2"))
    per = (
        sizes.groupBy("key", "band")
        .agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("m", "comp", "h")).alias("top"), F.sum("m").alias("all"), F.sum("h").alias("hashes"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
        .where("k > 1")
    )
    per = per.groupBy("all", "x1", "x2").agg(F.min(F.struct("band", "key", "top", "hashes")).alias("one")).select("all", "one.*")

    def blocks(members: Column, hashes: Column) -> Column:
        return F.ceil(F.greatest(members / BLOCK, hashes / BLOCK_HASHES)).cast("int")

    top = F.col("top")
    per = per.select("key", top["comp"].alias("_core"), blocks(top["m"], top["h"]).alias("cores"), blocks(F.col("all") - top["m"], F.col("hashes") - top["h"]).alias("outs"))
    return labelled.join(per, "key").withColumn("core", F.col("comp") == F.col("_core")).drop("_core")


def rest_links(spanning: DataFrame, sigs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links across components of the spanning buckets, enough of them to join what is linked. Members are dealt into
    blocks of about BLOCK; blocks of the largest component meet blocks of the other members, and these meet each other.
    A call has the signatures and sets of its rows at hand, so pairs that are no links never become rows.
    sigs: node, sig, set (the packed sorted shingle hashes)."""
    blk = F.pmod(F.xxhash64("node", F.lit("block")), F.when(F.col("core"), F.col("cores")).otherwise(F.col("outs"))).cast("int")
    placed = spanning.withColumn("blk", blk).join(sigs, "node")

    def meets(kind: int, n: str, i, j) -> object:
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda x: F.struct(F.lit(kind).alias("kind"), i(x).alias("i"), j(x).alias("j")))

    own = F.col("blk")
    of_core = meets(0, "outs", lambda x: own, lambda x: x)
    of_rest = F.concat(meets(0, "cores", lambda x: x, lambda x: own), meets(1, "outs", lambda x: F.least(x, own), lambda x: F.greatest(x, own)))
    dealt = placed.withColumn("to", F.explode(F.when(F.col("core"), of_core).otherwise(of_rest))).select("key", "band", "node", "comp", "sig", "set", "blk", "core", "to.*")
    # many small meetings share a call; one large meeting has about 2 x BLOCK rows
    load = placed.select(F.when(F.col("core"), F.col("outs")).otherwise(F.col("cores") + F.col("outs")).alias("times"), F.octet_length("set").alias("bytes"))
    total = load.agg(F.sum("times").alias("rows"), F.sum(F.col("times") * F.col("bytes")).alias("bytes")).first()
    slots = max(1, -(-(total["rows"] or 0) // SLOT), -(-(total["bytes"] or 0) // SLOT_BYTES))
    slot = F.pmod(F.xxhash64("key", "kind", "i", "j"), F.lit(slots)).alias("slot")
    return dealt.groupBy(slot).applyInPandas(lambda pdf: _blocks(pdf, percent), "a long, b long").distinct()


def class_members(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets: (node, _id, _th of the first member) and members (_id, _th, node).

    A class is named by its least doc_id. A doc_id that is the least of several classes names one of them; the others
    are named by a hash, until the rows of that doc_id join them. The class of a row is looked up by the set's key; classes
    of many copies are split off, so that they meet in no task."""
    first = stored(sets.groupBy("k1", "k2").agg(F.min(F.struct("_id", "_th")).alias("first"), F.count(F.lit(1)).alias("m")), "set-classes")
    leads = first.groupBy("first._id").agg(F.min("first._th").alias("_lead"))
    named = first.select("k1", "k2", "m", "first.*").join(leads, "_id")
    node = F.when(F.col("_th") == F.col("_lead"), F.col("_id")).otherwise(F.xxhash64(F.lit("class"), "_id", "_th"))
    classes = stored(named.select("k1", "k2", "m", "_id", "_th", node.alias("node")), "classes")
    total = classes.agg(F.sum("m")).first()[0] or 0
    members = lookup_join(sets.select("_id", "_th", "k1", "k2"), classes.select("k1", "k2", "m", "node"), ["k1", "k2"], "m", total)
    return classes.select("node", "_id", "_th"), stored(members.select("_id", "_th", "node").distinct(), "members")


def several_ids(own: DataFrame) -> DataFrame:
    """_id, least (component) of the ids that stand in more than one component; own: _id, comp."""
    return own.groupBy("_id").agg(F.min("comp").alias("least"), F.max("comp").alias("_most")).where("least <> _most").select("_id", "least")


def named_by_ids(comps: DataFrame, classes: DataFrame) -> DataFrame:
    """comps (node, comp) with each component named by the least doc_id of its classes, where a hash had named it."""
    ids = comps.join(classes, "node").groupBy("comp").agg(F.min("_id").alias("least")).where("comp <> least")
    return stored(comps.join(ids, "comp", "left").select("node", F.coalesce("least", "comp").alias("comp")), "components")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row of docs: the id, n_shingles, component_id, kept (and _th, a hash of the text). Sets of which percent is shared are linked."""
    rows = row_key(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    table = stored(signed(rows, percent), "signatures")
    sets = table.where("n > 0 and _id is not null")
    classes, members = class_members(sets)
    heads = classes.select(F.col("_id").alias("_n"), F.col("_th").alias("_t"), "node")
    of_head = (F.col("_id") == F.col("_n")) & (F.col("_th") == F.col("_t"))
    sigs = stored(table.where("n > 0").join(heads, of_head).dropDuplicates(["node"]).select("node", "n", "sig", "keys"), "class-signatures")

    flat = sigs.select("node", "n", F.posexplode("keys").alias("band", "key"))
    shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    buckets = flat.join(shared, "key")
    hubs = [F.min("node").alias("hub0"), *[F.min_by("node", F.xxhash64("node", F.lit(r))).alias(f"hub{r}") for r in range(1, HUBS)]]
    buckets = stored(buckets, "buckets")
    hubs = buckets.groupBy("key").agg(*hubs)
    grouped = stored(buckets.select("node").distinct(), "grouped")
    sig_of = stored(sigs.join(grouped, "node", "left_semi").select("node", "sig"), "grouped-signatures")
    texts = stored(rows.join(heads.join(grouped, "node", "left_semi"), of_head).dropDuplicates(["node"]).select("node", ascii_lower(whole(F.col("_text"))).alias("text")), "texts")

    comps = stored(grouped.withColumn("comp", F.col("node")), "components")
    tried: list[DataFrame] = []

    def new_links(pairs: DataFrame, name: str) -> DataFrame:
        """The links among pairs (a, b) that were not checked before."""
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for known in tried:
            ordered = ordered.join(known, ["a", "b"], "left_anti")
        tried.append(stored(ordered, "pairs"))
        return stored(verified(tried[-1], texts, percent), name)

    for r in range(HUBS):
        pairs = buckets.join(hubs.select("key", F.col(f"hub{r}").alias("hub")), "key").where("node <> hub").select("node", "hub").distinct()
        here = comps.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        apart = pairs.join(comps, "node").join(here, F.col("hub") == F.col("_n")).where("comp <> _c").select("node", "hub")
        both = apart.join(sig_of.select("node", "sig"), "node").join(sig_of.select(F.col("node").alias("hub"), F.col("sig").alias("sig2")), "hub")
        alive = both.where(_survive(percent)("sig", "sig2")).select(F.col("node").alias("a"), F.col("hub").alias("b"))
        comps = joined_up(comps, new_links(alive, "hub-links"))
    spanning = stored(spanning_buckets(buckets, comps), "spanning")
    wanted = texts.join(spanning.select("node").distinct(), "node", "left_semi").select("node", _packed("text").alias("set"))
    with_sets = stored(sig_of.select("node", "sig").join(wanted, "node"), "spanning-sets")
    comps = joined_up(comps, stored(rest_links(spanning, with_sets, percent), "rest-links"))

    # rows of one doc_id are one document: its classes belong together
    own = members.join(comps, "node", "left").select("_id", F.coalesce("comp", "node").alias("comp"))
    several = stored(own.groupBy("_id").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("a", "b").distinct(), "several")
    if several.limit(1).count():
        between = own.join(several_ids(own), "_id").select(F.col("comp").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        ends = several.select(F.col("a").alias("node")).union(several.select("b")).union(classes.select("node")).distinct()
        comps = joined_up(ends.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), stored(between, "same-id"))
        comps = named_by_ids(comps, classes)

    named = members.join(comps, "node", "left").select(F.col("_id").alias("_n"), F.col("_th").alias("_t"), F.coalesce("comp", "node").alias("component_id"))
    out = table.select("_id", "_th", "n").join(named, of_head, "left").withColumn("component_id", F.coalesce("component_id", "_id"))
    return out.select(F.col("_id").alias(id_col), "_th", F.col("n").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
