"""Near-duplicate documents: probability-Jaccard sketches, banding, verification, classes.

A text is its runs of five words, each weighing as often as it occurs. Every register of a sketch is a race of Poisson
processes, one per run with its weight as rate; the earliest arrival wins. Two texts agree in a register with
probability J_P, the probability Jaccard similarity of their weights (the plain Jaccard similarity where no run
repeats). Arrivals later than the latest winner change nothing, so a run's process ends there: most runs of a long text
arrive once.

The plain Jaccard similarity of texts that repeat runs can be high where J_P is low (a line repeated often in one of
them). Such a text also has the bands of a second sketch, with all weights 1; for texts without repeats both sketches are
the same.

Equal texts fall together first. Texts that agree in all registers of a band meet in that band's bucket. Links are
verified exactly on both texts: J_P or the plain Jaccard similarity of the runs is at least 0.8. A bucket's members are
compared with its leader (the smallest id), so a bucket of n texts makes n - 1 pairs and not n^2/2. Both distances obey
the triangle inequality, hence a link between two members that the leader leaves in different classes needs distances to
the leader that differ by at most 0.2. Only those pairs are compared next. They are few unless a group's texts all lie
near the limit; such large buckets are compared in squares that give out links only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm import textops as T
from colonnade.llm.components import both_ways, components, reached
from colonnade.llm.runtime import beside, quoted, stored, text_of

RUN, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
HOT = 2000  # pairs of one leader that one task takes
FEW, SIDE = 32, 256  # members of a bucket that are paired one by one; texts on a side of a square beyond that
U = T.U


def weighted_runs(block: T.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of each text: hash, text (ascending), number of occurrences. Fewer than five words: one run of all."""
    starts, ends, texts = T.spans(block)
    h, t = T.windows(T.hashes(block.data, starts, ends), texts, RUN, whole=True)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.append(at, len(h)))


def sketches(h: np.ndarray, t: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n rows of k registers, each the hash of the run whose process arrives first there; 0 for a text without runs."""
    best = np.full(n * k, np.inf)
    who = np.zeros(n * k, dtype=np.uint64)
    alone = np.bincount(t, minlength=n) == 1
    who.reshape(n, k)[t[alone[t]]] = h[alone[t]][:, None]
    active = np.flatnonzero(~alone[t])
    hh, tt, rate = h[active], t[active], weight[active].astype(float)
    time = np.zeros(len(active))
    limit = np.full(n, np.inf)
    arrival = 0
    while len(hh):
        arrival += 1
        draw = T.mix(hh + U(arrival * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> U(12)).astype(float) + 0.5) * 2.0 ** -52) / rate
        live = time < limit[tt]
        hh, tt, rate, time, draw = hh[live], tt[live], rate[live], time[live], draw[live]
        if not len(hh):
            break
        slot = tt * k + (T.mix(draw ^ U(0x5851F42D4C957F2D)) % U(k)).astype(np.int64)
        np.minimum.at(best, slot, time)
        won = best[slot] == time
        who[slot[won]] = hh[won]
        there = np.unique(tt)
        limit[there] = best.reshape(n, k)[there].max(1)
    return who.reshape(n, k)


def bands(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of each row; different bands have different keys."""
    n = len(registers)
    parts = registers.reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * U(0xD1342543DE82EF95), (n, BANDS)).copy()
    for i in range(ROWS):
        key = T.mix(key * U(0x2545F4914F6CDD1D) + parts[:, :, i])
    return key.view(np.int64)


def band_keys(block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of all texts in a row and how many each has: none without runs, those of both sketches if runs repeat."""
    h, t, weight = weighted_runs(block)
    keys, there = np.zeros((block.n, 2 * BANDS), np.int64), np.zeros((block.n, 2 * BANDS), bool)
    keys[:, :BANDS] = bands(sketches(h, t, weight, block.n, BANDS * ROWS))
    there[:, :BANDS] = (np.bincount(t, minlength=block.n) > 0)[:, None]
    repeating = np.unique(t[weight > 1])
    if len(repeating):
        own = np.isin(t, repeating)
        keys[repeating, BANDS:] = bands(sketches(h[own], np.searchsorted(repeating, t[own]), np.ones(own.sum(), np.int64), len(repeating), BANDS * ROWS))
        there[repeating, BANDS:] = True
    return keys[there], there.sum(1)


def _sketch_work():
    def work(texts):
        keys, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for block in T.blocks(texts):
            flat, size = band_keys(block)
            keys.append(flat)
            sizes.append(size)
        cut = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(keys), pa.int64()))]

    return work


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """The probability Jaccard and the plain Jaccard similarity of two sorted weighted sets."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return (float(len(ha) == len(hb)),) * 2
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0, 0.0
    union = len(ha) + len(hb) - len(ia)
    plain = len(ia) / union
    if wa.max() == 1 and wb.max() == 1:
        return plain, plain
    # sum over shared i of 1 / sum_j max(x_j / x_i, y_j / y_i): y counts for elements of a ratio x/y up to i's, x for others
    x, y = np.zeros(union), np.zeros(union)
    x[:len(ha)], y[ia] = wa, wb[ib]
    rest = np.ones(len(hb), dtype=bool)
    rest[ib] = False
    y[len(ha):] = wb[rest]
    ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    cx, cy = np.concatenate([[0], np.cumsum(x[order])]), np.concatenate([[0], np.cumsum(y[order])])
    up_to = np.searchsorted(ratio[order], ratio[ia], side="right")
    total = cy[up_to] / y[ia] + (cx[-1] - cx[up_to]) / x[ia]
    return float((1 / total).sum()), plain


def _verify_work():
    def work(left, right):
        out = []
        for a, b in zip(left, right, strict=True):
            sides = []
            for block in T.blocks(pa.array([a.as_py(), b.as_py()], pa.large_string())):
                h, t, w = weighted_runs(block)
                cut = np.searchsorted(t, np.arange(block.n + 1))
                sides += [(h[cut[i]:cut[i + 1]], w[cut[i]:cut[i + 1]]) for i in range(block.n)]
            out.append(similarities(*sides))
        found = np.array(out).reshape(-1, 2)
        return [pa.array(found[:, 0]), pa.array(found[:, 1])]

    return work


def _numbered(digest: Column) -> Column:
    """An id above 2^62 for a text without one of its own."""
    return F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(digest), 2)


def vertices(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): `rows` has doc_id and its text's vertex, `texts` has each distinct text's digest, vertex, least and bands.

    `least` is the smallest doc_id of the equal texts, and the vertex is that id. Where no row has an id, or where a text
    of a smaller digest has the same one, the vertex is a number above 2^62 from the text's digest.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    keyed = plain.withColumn("digest", F.md5(F.col("text").cast("binary")))
    marked = stored(beside(keyed, [("bands", "array<long>")], _sketch_work).drop("text"), "sketches")
    texts = marked.groupBy("digest").agg(F.min("doc_id").alias("least"), F.any_value("bands").alias("bands"))
    heads = marked.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("head"))
    own = F.when(F.col("head") == F.col("digest"), F.col("least")).otherwise(_numbered(F.col("digest")))
    texts = stored(texts.join(heads, F.col("least") == F.col("doc_id"), "left").select("digest", own.alias("vertex"), "least", "bands"), "texts")
    rows = marked.select("doc_id", "digest").join(texts.select("digest", "vertex"), "digest")
    return rows, texts


def buckets(texts: DataFrame) -> DataFrame:
    """(bucket, vertex) of every bucket that two texts or more share."""
    each = texts.select("vertex", F.explode("bands").alias("bucket")).distinct()
    shared = each.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").select("bucket")
    return each.join(shared, "bucket")


def texts_of(docs: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vertex, text) of the wanted vertices."""
    chosen = texts.join(wanted.select("vertex").distinct(), "vertex", "left_semi").select("vertex", "digest", "least")
    plain = docs.select(text_of().alias("text"), F.col("doc_id").cast("long").alias("doc_id")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    # of equal texts only the rows of the least id are joined
    same = F.col("doc_id").eqNullSafe(F.col("least")) & (plain["digest"] == chosen["digest"])
    return plain.join(chosen, same).groupBy("vertex").agg(F.any_value("text").alias("text"))


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pairs (a, b) with jp and j, both similarities. The texts of a vertex with many pairs are dealt over several tasks."""
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts"))
    spread = pairs.join(load, "a").withColumn("part", F.pmod(F.hash("b"), F.col("parts"))).drop("parts")
    left = bodies.withColumnsRenamed({"vertex": "a", "text": "left"}).join(load, "a").select(
        "a", "left", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    right = spread.join(bodies.withColumnsRenamed({"vertex": "b", "text": "right"}), "b")
    both = right.join(left, ["a", "part"]).select("a", "b", "left", "right")
    return beside(both, [("jp", "double"), ("j", "double")], _verify_work, ("left", "right")).select("a", "b", "jp", "j")


def _linked(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.greatest("jp", "j") >= SIMILARITY)


def _fresh(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    """The distinct pairs as (a, b), ends in the given order, that have not been compared in either order."""
    pairs = pairs.filter("a <> b").distinct()
    if tried is None:
        return pairs
    return pairs.join(both_ways(tried.select("a", "b")), ["a", "b"], "left_anti")


def unresolved(met: DataFrame, hubs: DataFrame, tried: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold several classes: bucket, hub, vertex, root (its class), main (the hub's class), jp and j
    (similarity with the hub), n (members of the bucket)."""
    both = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b"), "jp", "j")).withColumnsRenamed({"a": "hub", "b": "vertex"})
    one = F.when(F.col("vertex") == F.col("hub"), F.lit(1.0))
    placed = (met.join(hubs, "bucket").join(both, ["hub", "vertex"], "left")
              .select("bucket", "vertex", "hub", F.coalesce(one, F.col("jp"), F.lit(0.0)).alias("jp"), F.coalesce(one, F.col("j"), F.lit(0.0)).alias("j")))
    known = (placed.join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
             .join(roots.withColumnsRenamed({"vertex": "hub", "root": "main"}), "hub", "left").withColumn("main", F.coalesce("main", "hub")))
    mixed = known.groupBy("bucket").agg(F.count("*").alias("n"), F.bool_or(F.col("root") != F.col("main")).alias("mixed")).filter("mixed").drop("mixed")
    return known.join(mixed, "bucket")


def few(members: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs of small buckets that are in different classes and whose distances to the hub allow a link.

    A distance falls in steps of 0.2; a link needs, by either measure, the same or a neighbouring step. A bucket has at
    most `FEW` members, so a row meets that many others at most.
    """
    small, found = members.filter(F.col("n") <= FEW), None
    for measure in ("jp", "j"):
        step = F.floor(F.round((1 - F.col(measure)) * 5, 9)).cast("int")
        x = small.filter("root <> main").select("bucket", F.col("vertex").alias("x"), F.col("root").alias("xr"), F.col(measure).alias("xs"), F.explode(F.array(step - 1, step, step + 1)).alias("step"))
        y = small.select("bucket", F.col("vertex").alias("y"), F.col("root").alias("yr"), F.col(measure).alias("ys"), step.alias("step"))
        near = x.join(y, ["bucket", "step"]).filter(f"xr <> yr AND abs(xs - ys) <= {1 - SIMILARITY} + 1e-9")
        pairs = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        found = pairs if found is None else found.unionByName(pairs)
    return _fresh(found, tried)


def many(members: DataFrame, bodies: DataFrame) -> DataFrame:
    """The links (a, b) between classes in large buckets.

    Buckets of one hub hold much the same texts, so they are compared as one group. In it the texts outside the hub's
    class meet all texts in squares of at most about `SIDE` times `SIDE`, one square a task's group, so no task holds a
    whole group and only links leave it.
    """
    large = members.filter(F.col("n") > FEW).select("hub", "vertex", "root", "main", "jp", "j").distinct()
    sized = large.groupBy("hub").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("ys"), F.ceil(F.count_if(F.col("root") != F.col("main")) / SIDE).cast("int").alias("xs"))
    dealt = large.join(sized, "hub")
    own = lambda n: F.pmod(F.hash("vertex"), F.col(n))
    over = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    x = dealt.filter("root <> main").select("hub", own("xs").alias("xb"), over("ys").alias("yb"), F.lit(True).alias("outside"), "vertex", "root", "jp", "j")
    y = dealt.select("hub", over("xs").alias("xb"), own("ys").alias("yb"), F.lit(False).alias("outside"), "vertex", "root", "jp", "j")
    squares = x.unionByName(y).join(bodies, "vertex")
    return squares.groupBy("hub", "xb", "yb").applyInArrow(_square, "a long, b long").distinct()


def _square(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    outside = table["outside"].to_numpy()
    vertex, root = table["vertex"].to_numpy(), table["root"].to_numpy()
    jp, j = table["jp"].to_numpy(), table["j"].to_numpy()
    sets = []
    for block in T.blocks(table["text"]):
        h, t, w = weighted_runs(block)
        cut = np.searchsorted(t, np.arange(block.n + 1))
        sets += [(h[cut[i]:cut[i + 1]], w[cut[i]:cut[i + 1]]) for i in range(block.n)]
    xs, ys = np.flatnonzero(outside), np.flatnonzero(~outside)
    if not len(xs) or not len(ys):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    shared = overlaps([sets[i][0] for i in xs], [sets[i][0] for i in ys])
    size = np.array([len(h) for h, _ in sets])
    once = np.array([not len(w) or w.max() == 1 for _, w in sets])
    plain = shared / np.maximum(size[xs][:, None] + size[ys][None, :] - shared, 1)
    apart = root[xs][:, None] != root[ys][None, :]
    link = apart & (plain >= SIMILARITY)
    # repeated runs: the other measure, where the distances to the hub allow it
    doubt = apart & ~link & (shared > 0) & ~(once[xs][:, None] & once[ys][None, :]) & (np.abs(jp[xs][:, None] - jp[ys][None, :]) <= 1 - SIMILARITY + 1e-9)
    for i, k in zip(*np.nonzero(doubt), strict=True):
        link[i, k] = max(similarities(sets[xs[i]], sets[ys[k]])) >= SIMILARITY
    p, q = vertex[xs][np.nonzero(link)[0]], vertex[ys][np.nonzero(link)[1]]
    return pa.table({"a": pa.array(np.minimum(p, q), pa.int64()), "b": pa.array(np.maximum(p, q), pa.int64())})


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """How many hashes each pair of sets shares: products of 0/1 matrices over `width` hashes at a time."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count[back] > 1
    _, column = np.unique(back[often], return_inverse=True)
    owner = owner[often]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        out += part[:len(left)] @ part[len(left):].T
    return out


def near_copies(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, class_id, text_id.

    class_id is the smallest text_id of the texts connected by links, text_id the smallest doc_id of equal texts. A null
    text counts as the empty one; all empty texts are one class. Different texts under one doc_id are texts of their own:
    that of the smallest digest has the id as text_id, the others, like texts without any id, a number above 2^62 from
    their digest. Extra columns are not read; an empty table gives none.
    """
    rows, texts = vertices(docs)
    roots = classes(docs, texts)
    return rows.join(roots, "vertex", "left").select("doc_id", F.coalesce("root", "vertex").alias("class_id"), F.col("vertex").alias("text_id"))


def classes(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(vertex, root) of the texts that have links; the root is the smallest vertex connected."""
    met = stored(buckets(texts), "buckets")
    bodies = stored(texts_of(docs, texts, met), "bodies")
    first = met.groupBy("bucket").agg(F.min("vertex").alias("a"))
    tried = stored(verified(_fresh(met.join(first, "bucket").select("a", F.col("vertex").alias("b")), None), bodies), "tried")
    # the text with most links leads next: of copies that differ more from each other than from their model, the model
    ends = _linked(tried).select(F.explode(F.array("a", "b")).alias("vertex"))
    degree = ends.groupBy("vertex").agg(F.count("*").alias("degree"))
    ranked = met.join(degree, "vertex", "left").groupBy("bucket").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)), -F.col("vertex"))).alias("best"))
    hubs = stored(ranked.select("bucket", (-F.col("best.col2")).alias("hub")), "hubs")
    again = stored(verified(_fresh(met.join(hubs, "bucket").select(F.col("hub").alias("a"), F.col("vertex").alias("b")), tried), bodies), "tried")
    tried = tried.unionByName(again)
    roots = reached(_linked(tried), 3)
    members = stored(unresolved(met, hubs, tried, roots), "members")
    last = _linked(verified(stored(few(members, tried), "few"), bodies)).select("a", "b").unionByName(many(members, bodies))
    return components(_linked(tried).select("a", "b").unionByName(last), "a", "b")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay: one row of every class, with all its columns.

    It is a row that holds the text whose text_id is the class_id, under the least doc_id of that text. Rows equal in id
    and text are copies, of which any one stays.
    """
    _, texts = vertices(docs)
    roots = classes(docs, texts)
    # a text without links is a class of its own
    kept = texts.join(roots.filter("vertex <> root"), "vertex", "left_anti").select("digest", "least")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.md5(text_of().cast("binary")).alias("own"))
    same = F.col("id").eqNullSafe(F.col("least")) & (F.col("own") == F.col("digest"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "own"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
