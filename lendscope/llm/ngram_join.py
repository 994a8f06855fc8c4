"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

A document's set is its distinct ``n``-word shingles (64-bit hashes of the
lower-cased words; with fewer words the whole sequence is one).  The global
order is the order of these hashes, cut into fragments; two documents link
when 100 * |A and B| >= percent * |A or B|.

*Candidates.*  Sets of a link differ in at most d shingles, d following from
the sizes.  With more than d fragments at least one fragment is equal on both
sides, so each set emits one key per non-empty fragment: a hash of the
fragment's shingles.  The number of fragments depends on the size class (steps
of ``STEP``, or 100 / percent if that is more); a set near the border of a class emits the keys of both.  A set
with so many empty fragments that the rest wouldn't prove the link emits its
empty fragments as well, so no link is lost.  A common passage alone doesn't
make a key: the whole fragment must be equal.

*Pruning without loss.*  Each set carries its size and an odd sketch (parity
bits of hashed shingles): sets whose sketches differ in more bits than a link
allows can't link.

*Verification.*  The shingles of a candidate pair are compared fragment by
fragment; the partial overlaps are counted separately and summed per pair.

*Hot groups.*  Keys are collapsed per Arrow batch before the shuffle, so a
fragment that a third of all documents share costs one entry per batch and
key.  Equal sets become one representative.  A key's members are first
compared with one of their keys' smallest members only; after the components
of these links are known, only members of different components still need comparing, and
those pairs pass the sketch in blocks of ``BLOCK`` x ``BLOCK``.  No group is
gathered in one task and pairs within a group aren't spelt out.

Defined results: documents without words (null, empty, only separators) have
no shingles and are their own component; a null doc_id links with nothing
(component null); rows that share a doc_id are one document for linking (it
links where any of its texts does), n_shingles is the row's own.  Only doc_id
and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from . import textbuf as tb
from .common import bounded_batches, split_by_ids
from .components import connected_components

STEP = 1.6
SKETCH_WORDS = 32          # 2,048 bits
BLOCK = 1024
FRAGMENTS = 8              # of a verification
FLUSH = 1 << 20            # keys of a batch of documents
KEYS_PER_TASK = 1 << 21

U64 = np.uint64


def max_difference(a, b, percent: int):
    """The largest symmetric difference of linked sets of sizes a and b:
    |A xor B| = a + b - 2i with 100 i >= percent (a + b - i)."""
    least = -(-(percent * (a + b)) // (100 + percent))
    return a + b - 2 * least


def most_difference(total, percent: int):
    """The largest symmetric difference of linked sets whose sizes sum up to
    ``total`` at most (it grows with the sum but for parity)."""
    return np.maximum(max_difference(total, 0, percent), max_difference(total - 1, 0, percent))


def _levels(percent: int):
    """(size limits, fragments): class k has sizes below limits[k]; pairs whose
    larger set is in class k are found with fragments[k] fragments."""
    limits, fragments, at = [], [], 1
    while at < 1 << 62:
        nxt = max(at + 1, math.ceil(at * max(STEP, 100 / percent)))
        limits.append(nxt)
        big = nxt - 1
        fragments.append(int(most_difference(2 * big, percent)) + 1)
        at = nxt
    return np.array(limits, dtype=np.int64), np.array(fragments, dtype=np.int64)


def keys_of_sets(tokens, offsets, percent: int):
    """Candidate keys of a slice of sorted sets: (key, document)."""
    limits, fragments = _levels(percent)
    sizes = np.diff(offsets)
    own = np.searchsorted(limits, sizes, side="right")
    upper = np.searchsorted(limits, (sizes * 100) // percent, side="right")
    keys, docs = [], []
    for extra in (0, 1):
        # a linked set may be in the next class only: a class spans more than 100 / percent
        use = np.flatnonzero((sizes > 0) & ((upper > own) if extra else True))
        if not len(use):
            continue
        level = own[use] + extra
        k = fragments[level]
        many = k > 1                      # one fragment: only equal sets, which are collapsed before
        use, level, k = use[many], level[many], k[many]
        if not len(use):
            continue
        n = sizes[use]
        at = np.repeat(offsets[use] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        t = tokens[at]
        row = np.repeat(np.arange(len(use)), n)
        # the fragment of a token: its place in the order times the number of fragments
        frag = ((t >> U64(32)) * k[row].astype(U64)) >> U64(32)
        code = row.astype(np.int64) * int(k.max()) + frag.astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        total = np.add.reduceat(tb.mix(t + U64(0x51ED27)), first)
        owner, part = row[first], frag[first]
        key = tb.mix(total + tb.mix(part * U64(0xA24BAED4963EE407) + k[owner].astype(U64) * U64(0x9FB21C651E98DF25)))
        keys.append(key)
        docs.append(use[owner])
        # too few non-empty fragments to prove a link: the empty ones too
        filled = np.bincount(owner, minlength=len(use))
        largest = np.minimum(limits[level] - 1, (n * 100) // percent)
        need = most_difference(n + largest, percent)
        for i in np.flatnonzero((filled <= need) & (filled < k)):
            empty = np.setdiff1d(np.arange(k[i]), part[owner == i].astype(np.int64)).astype(U64)
            keys.append(tb.mix(tb.mix(empty * U64(0xA24BAED4963EE407) + U64((int(k[i]) * 0x9FB21C651E98DF25) & 0xFFFFFFFFFFFFFFFF)) + U64(7)))
            docs.append(np.full(len(empty), use[i]))
    if not keys:
        return np.empty(0, U64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(docs)


def sketches(tokens, offsets):
    """Odd sketch of each set: SKETCH_WORDS 64-bit words of parity bits."""
    docs, bits = len(offsets) - 1, SKETCH_WORDS * 64
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    cell = owner * bits + (tb.mix(tokens * U64(0xD6E8FEB86659FD93)) % U64(bits)).astype(np.int64)
    odd = (np.bincount(cell, minlength=docs * bits) & 1).astype(np.uint8) if docs else np.zeros(0, np.uint8)
    return np.packbits(odd.reshape(docs, bits), axis=1)


def _fingerprints(tokens, offsets):
    """Two 64-bit sums over each set (0 for empty sets)."""
    a = np.concatenate([np.zeros(1, U64), np.cumsum(tb.mix(tokens + U64(1)))])
    b = np.concatenate([np.zeros(1, U64), np.cumsum(tb.mix(tokens ^ U64(0x5DEECE66D1234567)))])
    return (a[offsets[1:]] - a[offsets[:-1]]).view(np.int64), (b[offsets[1:]] - b[offsets[:-1]]).view(np.int64)


_MAP = "part int, kind string, doc_id long, n int, fp1 long, fp2 long, sketch binary, k binary, ids binary"
_NAMES = [x.split()[0] for x in _MAP.split(", ")]


def _rows(part=None, kind="", doc_id=None, n=None, fp1=None, fp2=None, sketch=None, k=None, ids=None, size=0):
    blank = lambda t: pa.nulls(size, t)
    pick = lambda v, t: blank(t) if v is None else pa.array(v, t)
    return pa.RecordBatch.from_arrays([
        pick(part, pa.int32()), pa.array([kind] * size, pa.string()), pick(doc_id, pa.int64()), pick(n, pa.int32()),
        pick(fp1, pa.int64()), pick(fp2, pa.int64()), pick(sketch, pa.binary()), pick(k, pa.binary()), pick(ids, pa.binary())], names=_NAMES)


def pack_ids(ids) -> bytes:
    """Ids as differences from the smallest, in 4 bytes each where they fit."""
    base = int(ids.min())
    wide = int(ids.max()) - base >= 1 << 32
    rest = (ids - base).astype(np.uint64 if wide else np.uint32)
    return np.array([base, 8 if wide else 4], np.int64).tobytes() + rest.tobytes()


def unpack_ids(blob: bytes):
    base, size = np.frombuffer(blob, np.int64, 2)
    return np.frombuffer(blob, np.uint32 if size == 4 else np.uint64, offset=16).astype(np.int64) + base


def _members(keys):
    """Runs of equal keys (sorted): which entries are in a run of two or more."""
    same = keys[1:] == keys[:-1]
    inside = np.zeros(len(keys), dtype=bool)
    inside[1:] |= same
    inside[:-1] |= same
    return inside


def _member_rows(keys, ids):
    """Members of shared keys as blobs, cut so that no row is large."""
    out = []
    for lo in range(0, len(keys), 1 << 16):
        out.append((keys[lo:lo + (1 << 16)].tobytes(), pack_ids(ids[lo:lo + (1 << 16)]), int(keys[lo] >> U64(1))))
    return out


def _map_task(words: int, percent: int, parts: int):
    def run(batches):
        pend_k, pend_i, held = [], [], 0

        def flush():
            """Keys of the documents so far: shared ones as members, then one
            entry per key by target part."""
            nonlocal pend_k, pend_i, held
            if not held:
                return
            k, i = np.concatenate(pend_k), np.concatenate(pend_i)
            pend_k, pend_i, held = [], [], 0
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            keep = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])])
            k, i = k[keep], i[keep]
            inside = _members(k)
            blobs = _member_rows(k[inside], i[inside])
            if blobs:
                yield _rows(part=[b[2] % parts for b in blobs], kind="m", k=[b[0] for b in blobs],
                            ids=[b[1] for b in blobs], size=len(blobs))
            first = np.concatenate([[True], k[1:] != k[:-1]])
            k, i = k[first], i[first]
            part = (k % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            k, i, part = k[order], i[order], part[order]
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            if len(k):
                yield _rows(part=part[cut[:-1]].tolist(), kind="k", k=[k[a:b].tobytes() for a, b in zip(cut, cut[1:])],
                            ids=[pack_ids(i[a:b]) for a, b in zip(cut, cut[1:])], size=len(cut) - 1)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            views = tb.utf8_views(batch.column(1))
            for lo, hi in tb.slices(views):
                tokens, off = tb.shingle_sets(views[lo:hi], words)
                sizes = np.diff(off)
                fp1, fp2 = _fingerprints(tokens, off)
                sketch = sketches(tokens, off)
                yield _rows(part=((ids[lo:hi] & 0x7FFFFFFF) % parts).tolist(), kind="d", doc_id=ids[lo:hi], n=sizes.astype(np.int32),
                            fp1=fp1, fp2=fp2, sketch=[s.tobytes() for s in sketch], size=hi - lo)
                k, d = keys_of_sets(tokens, off, percent)
                pend_k.append(k)
                pend_i.append(ids[lo:hi][d])
                held += len(k)
                if held >= FLUSH:
                    yield from flush()
        yield from flush()
    return run


def _reduce_task():
    def run(batches):
        ks, vs = [], []
        for batch in batches:
            kind = batch.column(1).to_pylist()
            other = [i for i, x in enumerate(kind) if x != "k"]
            if other:
                yield batch.take(pa.array(other))
            for i, x in enumerate(kind):
                if x == "k":
                    ks.append(np.frombuffer(batch.column(7)[i].as_py(), U64))
                    vs.append(unpack_ids(batch.column(8)[i].as_py()))
        if ks:
            k, v = np.concatenate(ks), np.concatenate(vs)
            order = np.lexsort((v, k))
            k, v = k[order], v[order]
            inside = _members(k)
            blobs = _member_rows(k[inside], v[inside])
            if blobs:
                yield _rows(kind="m", part=[0] * len(blobs), k=[b[0] for b in blobs], ids=[b[1] for b in blobs], size=len(blobs))
    return run


def _unblob(batches):
    for batch in batches:
        for k, i in zip(batch.column(0), batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k.as_py(), np.int64)), pa.array(unpack_ids(i.as_py()))],
                                             names=["key", "doc_id"])


def _verify_task(words: int, percent: int):
    """Rows (grp, salt, role, id, text) sorted so that a group's
    representative (role 0) comes before its members: the links of each."""
    def partial(a, b):
        """Overlap of two sorted sets, fragment by fragment, given up when
        the rest can't reach what a link needs."""
        need = -(-(percent * (len(a) + len(b))) // (100 + percent))
        total, left = 0, min(len(a), len(b))
        cuts = (np.arange(1, FRAGMENTS, dtype=U64) << U64(64 - 3))
        ca, cb = np.concatenate([[0], np.searchsorted(a, cuts), [len(a)]]), np.concatenate([[0], np.searchsorted(b, cuts), [len(b)]])
        rest = np.minimum(np.diff(ca), np.diff(cb))
        left = int(rest.sum())
        for f in range(FRAGMENTS):
            if total + left < need:
                return False
            x, y = a[ca[f]:ca[f + 1]], b[cb[f]:cb[f + 1]]
            if len(x) and len(y):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                total += int((y[at] == x).sum())
            left -= int(rest[f])
        return 100 * total >= percent * (len(a) + len(b) - total)

    def run(batches):
        group, rep = None, []
        for batch in batches:
            grp, salt, role, ids = (batch.column(i).to_pylist() for i in range(4))
            views = tb.utf8_views(batch.column(4))
            a, b = [], []
            for lo, hi in tb.slices(views):
                tokens, off = tb.shingle_sets(views[lo:hi], words)
                for i in range(lo, hi):
                    own = tokens[off[i - lo]:off[i - lo + 1]]
                    if (grp[i], salt[i]) != group:
                        group, rep = (grp[i], salt[i]), []
                    if role[i] == 0:
                        rep.append(own.copy())
                    elif any(partial(r, own) for r in rep):
                        a.append(grp[i])
                        b.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int, members: int = 128) -> DataFrame:
    """The pairs (a, b) whose texts link.  Each a is dealt to groups of about
    ``members`` partners, so a popular a is split over tasks.  Only the texts of
    pairs move."""
    texts, _ = split_by_ids(texts, "doc_id", pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))))
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    salted = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / members)).cast("int"))
    roles = (salted.select(F.col("a").alias("grp"), "salt", F.lit(1).alias("role"), F.col("b").alias("id"))
             .unionByName(salted.select(F.col("a").alias("grp"), "salt", F.lit(0).alias("role"), F.col("a").alias("id")).distinct()))
    rows = roles.join(texts, roles.id == texts.doc_id).select("grp", "salt", "role", "id", "text")
    return (rows.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "role", "id")
            .mapInArrow(_verify_task(words, percent), "a long, b long").distinct())


def _may_link(percent: int):
    """Column test on sizes and sketches of a pair (na, nb, sa, sb)."""
    def run(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), U64).reshape(-1, SKETCH_WORDS) for i in (4, 5))
            differ = np.bitwise_count(sa ^ sb).sum(axis=1)
            ok = differ <= max_difference(na, nb, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))
    return run


def _block_pairs(percent: int):
    """Sorted rows (key, i, j, side, doc_id, comp, n, sketch): of each pair of
    blocks of a key's members, the pairs of different components that sizes
    and sketches allow.  Holds one pair of blocks at a time."""
    def pairs(ids, comp, n, sketch, left, right):
        near = (comp[left][:, None] != comp[right][None, :]) & (ids[left][:, None] != ids[right][None, :])
        low, high = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
        x, y = np.nonzero(near & (low * 100 >= percent * high))
        a, b = left[x], right[y]
        keep = np.empty(len(a), dtype=bool)
        for lo in range(0, len(a), 1 << 15):
            p, q = a[lo:lo + (1 << 15)], b[lo:lo + (1 << 15)]
            keep[lo:lo + (1 << 15)] = np.bitwise_count(sketch[p] ^ sketch[q]).sum(axis=1) <= max_difference(n[p], n[q], percent)
        a, b = ids[a[keep]], ids[b[keep]]
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches):
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                own = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(7)]
                own.append(np.frombuffer(b"".join(batch.column(7).to_pylist()), U64).reshape(-1, SKETCH_WORDS))
                held = own if held is None else [np.concatenate(x) for x in zip(held, own)]
            if held is None or not len(held[0]):
                continue
            key, i, j = held[:3]
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
            last = len(cut) - 1 if batch is None else len(cut) - 2   # the last group may go on
            out = []
            for lo, hi in zip(cut[:last], cut[1:last + 1]):
                side = held[3][lo:hi]
                middle = int(np.searchsorted(side, 1))
                out.append(pairs(*(x[lo:hi] for x in (held[4], held[5], held[6].astype(np.int64), held[7])),
                                 np.arange(middle), np.arange(middle, hi - lo)))
            held = [x[cut[last]:] for x in held]
            if out:
                a, b = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _with_end(batches):
    yield from batches
    yield None


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows, links' components): rows has doc_id and n_shingles of every row
    with a non-null doc_id; components (id, component) of linked ids."""
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    total = src.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = max(1, int(total * 0.07 / KEYS_PER_TASK) + 1)
    made = (src.mapInArrow(_map_task(words, percent, parts), _MAP).repartitionById(parts, "part")
            .mapInArrow(_reduce_task(), _MAP))
    made = materialize(spark, made, "ngram-keys")
    rows = made.where("kind = 'd'").select("doc_id", F.col("n").alias("n_shingles"), "fp1", "fp2", "sketch")

    # equal sets: one representative each
    sets = (rows.where("n_shingles > 0").groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    of = rows.where("n_shingles > 0").join(sets, ["fp1", "fp2", "n_shingles"])
    of = materialize(spark, of.select("doc_id", "rep", F.col("n_shingles").alias("n"), "sketch"), "ngram-sets")
    equal = of.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    info = of.where("doc_id = rep").select("doc_id", "n", "sketch")
    member = (made.where("kind = 'm'").select("k", "ids").mapInArrow(_unblob, "key long, doc_id long")
              .join(of.select("doc_id", "rep"), "doc_id").select("key", F.col("rep").alias("doc_id")).distinct())
    member = materialize(spark, member, "ngram-members")

    def allowed(pairs):
        left = info.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        right = info.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        return (pairs.join(left, "a").join(right, "b").where(f"least(na, nb) * 100L >= {percent} * greatest(na, nb)")
                .select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_may_link(percent), "a long, b long"))

    # first each member with the smallest member of its keys that sizes and sketches allow
    star = (member.join(member.groupBy("key").agg(F.min("doc_id").alias("a")), "key").where("a <> doc_id")
            .select("a", F.col("doc_id").alias("b")).distinct())
    one = allowed(star).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    one = materialize(spark, one, "ngram-star")
    found = connected_components(verified(one, src, words, percent).unionByName(equal))

    def comp_of(df, name, out):
        return (df.join(found.select(F.col("id").alias(name), F.col("component").alias("__c")), name, "left")
                .withColumn(out, F.coalesce("__c", name)).drop("__c"))

    # keys whose members are still of different components: all such pairs, in blocks
    open_ = comp_of(member, "doc_id", "comp")
    keys = (open_.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            .where("lo <> hi").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    rows_ = (open_.join(keys, "key").join(info, "doc_id")
             .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    # block pairs (i, j), i <= j: a row is on the left of those with its block as i and on the right of those with it as j
    sides = F.expr("""concat(transform(sequence(block, blocks - 1), x -> struct(0 as side, block as i, x as j)),
                             transform(sequence(0, block), x -> struct(1 as side, x as i, block as j)))""")
    pairs = (rows_.withColumn("s", F.explode(sides)).select("key", "s.i", "s.j", "s.side", "doc_id", "comp", "n", "sketch")
             .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
             .mapInArrow(_block_pairs(percent), "a long, b long").distinct())
    pairs = materialize(spark, pairs.join(one, ["a", "b"], "left_anti"), "ngram-rest")
    known = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    found = connected_components(known.unionByName(verified(pairs, src, words, percent)))
    found = materialize(spark, found, "ngram-components")
    discard(of, member, one, pairs)
    return rows.select("doc_id", "n_shingles"), found


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles (long) and component_id of every row of ``docs``."""
    rows, found = components(docs, words, percent)
    out = (rows.join(found, rows.doc_id == found.id, "left")
           .select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
    nulls = docs.where("doc_id is null").select("text").mapInArrow(_count_task(words), "n_shingles long")
    return out.unionByName(nulls.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))


def _count_task(words: int):
    def run(batches):
        for batch in batches:
            views = tb.utf8_views(batch.column(0))
            out = [np.diff(tb.shingle_sets(views[lo:hi], words)[1]) for lo, hi in tb.slices(views)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.empty(0, np.int64), pa.int64())], names=["n_shingles"])
    return run
