"""Exact Jaccard join on word shingles by set relations.

Texts with the same shingle set form a class and are compared once. A block
exchange counts in how many classes each shingle occurs; the rare ones come
first in a set's order, and only sets that could reach the threshold with
their shared shingles stay. Their rarest shingles are posted to index lists,
held in blocks by set size and position; pairs of blocks that size, position
or membership rule out are skipped whole.

Answers are derived from the answers of similar sets: every list first joins
its sets to its most central one (``leader``). Sets already in one component
are never compared again, and for two sets of different components the
overlap of their leaders, with what each differs from its leader, decides most
pairs before any set is read. What remains is verified on the sets.

Lower-cases A-Z; words are ``[^\\x20\\x09-\\x0D]+``. A text with fewer words
than ``size`` is one shingle; null, empty and blank texts have none and are
linked with nothing. Rows count for themselves: repeated ``doc_id`` values are
documents of their own, and a null ``doc_id`` never names a component that has
another. Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm.components import components
from tessera.llm.kernels import U64, doc_shingles, portions, text_arrays, words
from tessera.session import materialize

LIST_BLOCK = 512
"""Postings in a block of an index list, about."""
SIZE_STEP = 1.05
"""Ratio of set sizes from one block to the next."""


def _sets(t: pa.Table, size: int, only: np.ndarray | None = None):
    """(place, sorted distinct shingles) of the texts of a block."""
    data, off = text_arrays(t.column("text"))
    places = np.arange(len(off) - 1) if only is None else only
    size_of = off[places + 1] - off[places]
    for lo, hi in portions(np.concatenate([[0], np.cumsum(size_of)])):
        some = places[lo:hi]
        if only is None:
            part, at = data[off[some[0]] : off[some[-1] + 1]], off[some[0] : some[-1] + 2] - off[some[0]]
        else:
            part = np.concatenate([data[off[p] : off[p + 1]] for p in some])
            at = np.concatenate([[0], np.cumsum(off[some + 1] - off[some])])
        h, _, first = words(part, at)
        for j, p in enumerate(some.tolist()):
            yield p, doc_shingles(h[first[j] : first[j + 1]], size)


def _make(size: int):
    def make(block: int, t: pa.Table) -> dict:
        n, f1, f2 = (np.zeros(t.num_rows, d) for d in (np.int32, np.uint64, np.uint64))
        for p, s in _sets(t, size):
            n[p] = len(s)
            f1[p], f2[p] = (np.add.reduce(s), np.add.reduce(s * s ^ (s >> U64(7)))) if len(s) else (0, 0)
        return {"sets": B.pack(doc_id=t.column("doc_id"), n=n, f1=f1.view(np.int64), f2=f2.view(np.int64))}

    return make


def _set_rows(batches):
    for b in batches:
        for block, sets in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t = B.unpack(sets)
            uid = (np.int64(block) << 16) | np.arange(t.num_rows)
            yield from t.add_column(0, "uid", pa.array(uid)).to_batches()


def _block_keys(t: pa.Table, size: int, places: np.ndarray):
    sets = list(_sets(t, size, places))
    every = np.concatenate([s for _, s in sets]) if sets else np.zeros(0, U64)
    keys, code, count = np.unique(every, return_inverse=True, return_counts=True)
    return sets, keys, code, count


def _count(size: int, dests: int):
    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if blocks.num_rows and told.num_rows:
            _, keys, _, count = _block_keys(B.unpack(blocks.column("payload")[0].as_py()), size, B.told_places(told))
            out = B.send(blocks.column("block")[0].as_py(), keys, dests, count.astype(np.uint32))
        return B.table(out)

    return run


_CAND = "uid long, n int, alone int, shared binary"


def need(n, percent: int):
    """Shingles that a set of n must share with any partner."""
    return -(-(n * percent) // 100)


def _candidates(size: int, percent: int):
    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        uid, n_all, alone_all, shared_all = [], [], [], []
        if blocks.num_rows and told.num_rows:
            block = blocks.column("block")[0].as_py()
            sets, _, code, _ = _block_keys(B.unpack(blocks.column("payload")[0].as_py()), size, B.told_places(told))
            df = B.answers(told.filter(pa.compute.greater_equal(told.column("dest"), 0)), np.uint32)[code]
            at = 0
            for place, s in sets:
                n, own = len(s), df[at : at + len(s)]
                at += n
                alone = int((own < 2).sum())
                if n and n - alone >= need(n, percent):
                    keep = own > 1
                    order = np.lexsort((s[keep], own[keep]))
                    uid.append((block << 16) | place)
                    n_all.append(n)
                    alone_all.append(alone)
                    shared_all.append(s[keep][order].tobytes())
        return pa.table({"uid": pa.array(uid, pa.int64()), "n": pa.array(n_all, pa.int32()), "alone": pa.array(alone_all, pa.int32()), "shared": pa.array(shared_all, pa.binary())})

    return run


def _postings(percent: int):
    def run(batches):
        for b in batches:
            uid, n, alone, shared = (b.column(i).to_pylist() for i in range(4))
            out = [[], [], []]
            for u, size, a, s in zip(uid, n, alone, shared, strict=True):
                long = size - need(size, percent) + 1 - a
                tok = np.frombuffer(s, np.int64, long)
                out[0].append(tok)
                out[1].append(np.full(long, u))
                out[2].append(np.arange(a, a + long))
            tok, u, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            yield pa.RecordBatch.from_pydict({"token": tok, "uid": u, "pos": pa.array(pos, pa.int32())})

    return run


def required(n1, n2, percent: int):
    """Overlap at which sets of n1 and n2 shingles reach the threshold."""
    return -(-(percent * (n1 + n2)) // (100 + percent))


def _required_col(a, b, percent):
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def _fits(percent: int, pre1: str, pre2: str):
    """Size and position leave room for the overlap that a pair needs."""
    n1, n2 = F.col(pre1 + "n"), F.col(pre2 + "n")
    room = F.lit(1) + F.least(n1 - F.col(pre1 + "pos"), n2 - F.col(pre2 + "pos")) - F.lit(1)
    return room * F.lit(100 + percent) >= F.lit(percent) * (n1 + n2)


def _verify(pairs: DataFrame, cands: DataFrame) -> DataFrame:
    """pairs (a, b) with their sizes and their overlap."""

    def run(batches):
        for t in batches:
            o = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(t.column(4).to_pylist(), t.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(t.column(i) for i in range(4)), pa.array(o, pa.int32())], names=["a", "b", "na", "nb", "overlap"])

    one = cands.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    two = cands.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    got = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb")
    return got.mapInArrow(run, "a long, b long, na int, nb int, overlap int")


def _linked(percent: int):
    return F.col("overlap") * F.lit(100 + percent) >= F.lit(percent) * (F.col("na") + F.col("nb"))


def _block_pairs(percent: int):
    """Pairs of different components from two blocks of one index list."""

    def arrays(x):
        s = x.values.slice(x.offsets[0].as_py(), 0) if len(x) == 0 else x.flatten()
        return {f: s.field(f).to_numpy(zero_copy_only=False) for f in ("uid", "n", "pos", "comp")}

    def run(batches):
        for t in batches:
            out_a, out_b = [], []
            for i in range(t.num_rows):
                x, y = arrays(t.column(0).slice(i, 1)), arrays(t.column(1).slice(i, 1))
                for lo in range(0, len(x["n"]), 256):
                    part = {k: v[lo : lo + 256, None].astype(np.int64) for k, v in x.items()}
                    room = np.minimum(part["n"] - part["pos"], y["n"] - y["pos"])
                    ok = (part["comp"] != y["comp"]) & (room * (100 + percent) >= percent * (part["n"] + y["n"]))
                    p, q = np.nonzero(ok)
                    u, v = part["uid"][p, 0], y["uid"][q]
                    out_a.append(np.minimum(u, v))
                    out_b.append(np.maximum(u, v))
            a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
            b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
            o = np.lexsort((b, a))
            a, b = a[o], b[o]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield pa.RecordBatch.from_pydict({"a": a[new], "b": b[new]})

    return run


def _cross_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components that share a posted shingle."""
    lists = posts.groupBy("token").agg(F.count("*").alias("length"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    in_blocks = (
        posts.join(lists.select("token", "length"), "token")
        .withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(SIZE_STEP)))).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("uid"), F.ceil(F.col("length") / F.lit(LIST_BLOCK)).cast("int")).cast("int"))
        .groupBy("token", "size", "part")
        .agg(
            F.collect_list(F.struct("uid", "n", "pos", "comp")).alias("posts"),
            F.min("n").alias("least"),
            F.max("n").alias("most"),
            F.max(F.col("n") - F.col("pos")).alias("room"),
            F.min("comp").alias("lo"),
            F.max("comp").alias("hi"),
        )
    )
    in_blocks = materialize(in_blocks, "lists")
    x, y = in_blocks.alias("x"), in_blocks.alias("y")
    reach = int(np.ceil(np.log(100 / percent) / np.log(SIZE_STEP))) + 1
    meet = (
        (F.col("x.token") == F.col("y.token"))
        & ((F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.part") <= F.col("y.part"))))
        & (F.col("y.size") <= F.col("x.size") + F.lit(reach))
        & (F.col("y.least") * F.lit(percent) <= F.col("x.most") * F.lit(100))
        & (F.least("x.room", "y.room") * F.lit(100 + percent) >= F.lit(percent) * (F.col("x.least") + F.col("y.least")))
        & ~((F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo")))
    )
    pairs = x.join(y, meet).select(F.col("x.posts").alias("p"), F.col("y.posts").alias("q"))
    return pairs.mapInArrow(_block_pairs(percent), "a long, b long").distinct()


def similar_sets(cands: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the candidate sets that link with any other."""
    posts = materialize(cands.mapInArrow(_postings(percent), "token long, uid long, pos int").join(cands.select("uid", "n", "alone"), "uid"), "postings")

    # 1. Every list joins its sets to its most central one: the fewest shingles of its own.
    leader = posts.groupBy("token").agg(F.count("*").alias("length"), F.min(F.struct("alone", "uid", "n", "pos")).alias("l")).where("length > 1")
    star = posts.join(leader, "token").select("uid", "n", "pos", F.col("l.uid").alias("luid"), F.col("l.n").alias("ln"), F.col("l.pos").alias("lpos"))
    star = star.where((F.col("uid") != F.col("luid")) & _fits(percent, "", "l"))
    first = materialize(_verify(star.select(F.col("luid").alias("a"), F.col("uid").alias("b")).distinct(), cands), "stars")
    links = first.where(_linked(percent)).select("a", "b")
    comp = materialize(components(links), "components")

    # 2. Pairs of different components that still share a posted shingle.
    near = first.where(_linked(percent)).groupBy(F.col("b").alias("uid")).agg(F.max(F.struct(F.col("overlap"), F.col("a"))).alias("s"))
    lead = cands.select("uid", "n").join(near, "uid", "left").join(comp.withColumnRenamed("id", "uid"), "uid", "left")
    lead = materialize(
        lead.select("uid", "n", F.coalesce("component", "uid").alias("comp"), F.coalesce("s.a", "uid").alias("leader"), F.coalesce("s.overlap", "n").alias("kept")),
        "leaders",
    )
    cross = materialize(_cross_pairs(posts.join(lead.select("uid", "comp"), "uid"), percent), "pairs")

    # 3. What the leaders' overlap says about their followers decides, or leaves, a pair.
    def side(c):
        return lead.select(F.col("uid").alias(c), F.col("n").alias("n" + c), F.col("leader").alias("l" + c), F.col("kept").alias("k" + c))

    ask = cross.join(side("a"), "a").join(side("b"), "b")
    ask = ask.withColumns({"x": F.least("la", "lb"), "y": F.greatest("la", "lb")})
    size = cands.select(F.col("uid"), F.col("n"))
    led = materialize(_verify(ask.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), cands), "led")
    known = led.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("overlap").alias("between"))
    ask = ask.join(known, ["x", "y"], "left").join(size.select(F.col("uid").alias("la"), F.col("n").alias("nla")), "la").join(size.select(F.col("uid").alias("lb"), F.col("n").alias("nlb")), "lb")
    between = F.when(F.col("x") == F.col("y"), F.col("nla")).otherwise(F.col("between"))
    ask = ask.withColumn("most", between + (F.col("na") - F.col("ka")) + (F.col("nb") - F.col("kb")))
    ask = ask.withColumn("sure", between - (F.col("nla") - F.col("ka")) - (F.col("nlb") - F.col("kb")))
    must = _required_col(F.col("na"), F.col("nb"), percent)
    ask = materialize(ask.where(F.col("most") >= must).select("a", "b", (F.col("sure") >= must).alias("derived")), "asked")
    checked = _verify(ask.where(~F.col("derived")).select("a", "b"), cands).where(_linked(percent)).select("a", "b")
    more = materialize(checked.unionByName(ask.where("derived").select("a", "b")), "links")
    return materialize(components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")


def _join(blocks: DataFrame, total: int, percent: int, size: int) -> DataFrame:
    """uid, doc_id, n, component_id, part (least uid of a linked class) of each row."""
    dests = B.destinations(total)
    sets = materialize(blocks.select("block", "sets").mapInArrow(_set_rows, "uid long, doc_id long, n int, f1 long, f2 long"), "sets")
    classes = materialize(sets.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least")), "classes")
    told_places = materialize(B.places(classes), "places")
    texts = blocks.select("block", "payload")
    sent = B.with_blocks(texts, told_places, _count(size, dests), B.PAYLOAD)
    told = materialize(B.sum_keys(sent, wide=np.uint32), "shingles")
    cands = materialize(B.with_blocks(texts, told.unionByName(told_places), _candidates(size, percent), _CAND), "candidates")
    comp = similar_sets(cands, percent)
    found = classes.join(comp.withColumnRenamed("id", "uid"), "uid").select("uid", "least", "component")
    least = found.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = classes.join(found.join(least, "component").select("uid", "component", "component_id"), "uid", "left")
    by_class = by_class.select("n", "f1", "f2", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component", "uid").alias("part"))
    out = sets.where("n > 0").join(by_class, ["n", "f1", "f2"]).select("uid", "doc_id", "n", "component_id", "part")
    return out.unionByName(sets.where("n = 0").select("uid", "doc_id", "n", F.col("doc_id").alias("component_id"), F.col("uid").alias("part")))


def jaccard_components(docs: DataFrame, percent: int = 80, size: int = 5, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of each row, and ``uid`` (its number).

    ``component_id`` is the smallest doc_id reachable over links; two sets link
    when 100 * intersection >= percent * union.
    """
    blocks, total = B.document_blocks(docs, "jaccard", _make(size), "sets binary", block_bytes)
    return _join(blocks, total, percent, size).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "uid")


def distinct_documents(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """One row of each component, the one of smallest doc_id (nulls last); rows without words stay."""
    blocks, total = B.row_blocks(docs, "distinct", _make(size), "sets binary")
    rows = _join(blocks, total, percent, size)
    first = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid")).alias("m"))
    return B.keep_rows(blocks, first.select(F.col("m.uid").alias("uid")), docs)
