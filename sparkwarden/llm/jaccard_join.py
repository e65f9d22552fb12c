"""Exact near-duplicate join on word shingles: size-banded tiles, bitmap bounds, sorted-array intersection.

Two documents link when the Jaccard similarity of their sets of distinct five-word shingles reaches the
threshold.  The result names each document's component of links; no link between different texts is lost.

1. *Sets.*  One pass hashes each whole text to its shingles (64 bits) and keeps per document the set's size,
   a 128-bit fingerprint, a bitmap as wide as the set is large, a few minimum hashes and the prefix: so many
   shingles in a fixed global order that two linked documents must share one.  The order puts shingles of
   more than about ``HEAVY`` of all documents last, so a passage that many documents share leaves the
   prefixes.  That list has at most ``2 / HEAVY`` times the mean set size entries, whatever the input; it
   affects cost, never results.  Documents of equal sets are one from here on.
2. *Leaders.*  The smallest member leads each group with an equal minimum hash.  A document is compared with the leader it meets most often,
   twice at least.  This finds most links of large groups in linear work and gives their documents a common label.
3. *Tiles.*  Documents meet in tiles: one prefix shingle and one band of sizes.  Sizes in a ratio of the
   threshold are in the same or neighbouring bands.  In a tile, differing bits of two bitmaps bound the overlap
   from above, and only pairs of different labels that pass go on, each in the tile of its first common prefix shingle as
   far as the documents' ``FIRSTS`` first shingles tell (they nearly always do).  First each document names its best partner, the
   confirmed links join labels, then all remaining pairs follow.  In that last step the bitmaps are ``WIDE`` times as wide, so their bound comes
   within a few percent of the overlap and drops the many pairs of a large group that are alike but not alike enough.  A large tile is dealt out in
   blocks to several tasks.
4. *Verification* intersects the sorted shingle arrays of the candidates only.

Null and empty texts, and texts of white space, have an empty set and link with nothing.  With fewer words than a
shingle the whole sequence is the only shingle.  Rows that repeat a document id count as one document, each with its own
set size.  Rows with a null id keep their set size, link with nothing and have a null component.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import LIGHT_CHARS, Scratch, chunks, lower_words, mix64
from sparkwarden.llm.components import components

WORDS = 5
PERCENT = 80
HEAVY, HEAVY_LEAST = 0.0004, 64
LEADERS = 4
SEGMENT = 2_000_000
FIRSTS = 3
TILE = 512
WIDE = 16
MEETS = 2
_STEPS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (as signed 64-bit integers) of each text."""
    hashes, bounds = lower_words(texts)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        if n > k:
            rolled[: n - k] += hashes[k:] * _STEPS[k]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        if b - a >= words:
            out.append(np.unique(rolled[a: b - words + 1].view(np.int64)))
        elif b > a:
            short = (hashes[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix64(np.array([short], np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _bitmap(items: np.ndarray, times: int = 1) -> bytes:
    """Bits of the shingles' places; a wider map folds onto a narrower one."""
    width = times * max(64, 1 << int(len(items) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(items.view(np.uint64) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of one width, that of the narrowest."""
    width = min(map(len, maps)) // 8
    out = np.zeros((len(maps), width), np.uint64)
    for i, m in enumerate(maps):
        out[i] = np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, width), axis=0)
    return out


_SALTS = mix64(np.arange(101, 101 + LEADERS, dtype=np.uint64))


def _marks(items: np.ndarray) -> tuple[int, int]:
    """A fingerprint of 128 bits of a set."""
    u = items.view(np.uint64)
    return tuple(int(mix64(u ^ salt).sum(dtype=np.uint64).view(np.int64)) for salt in _SALTS[:2])


def heavy_shingles(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Sorted shingles of more than about ``HEAVY`` of all documents (all of those, and none below half of that)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = docs_held = 0

        def flush():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(2, HEAVY / 2 * docs_held)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((token[often], [0]))), pa.array(np.concatenate((n[often], [0]))), pa.array([0] * int(often.sum()) + [docs_held], pa.int64())], ["token", "n", "docs"])

        for whole in batches:
            for batch in chunks(whole, "__text"):
                sets = shingle_sets(batch.column("__text").to_pylist(), words)
                held += sets
                size += sum(map(len, sets))
                docs_held += len(sets)
                if size >= SEGMENT:
                    yield flush()
                    held, size, docs_held = [], 0, 0
        if held:
            yield flush()

    counts = docs.select("__text").mapInArrow(count, "token long, n long, docs long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    scratch = Scratch(docs.sparkSession)
    counts = scratch.save(counts.where("n >= 8 or docs > 0"), "heavy")
    total = counts.agg(F.sum("docs")).first()[0] or 0
    least = max(HEAVY_LEAST, HEAVY / 2 * total)
    out = np.sort(counts.where(F.col("n") >= least).select("token").toArrow().column(0).to_numpy())
    scratch.drop(counts)
    return out


def describe_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n, f1, f2, bitmap, mins, rare, common): set size, fingerprint and what candidates are found by.

    ``rare`` and ``common`` are the prefix's light and heavy shingles.
    """
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, words))

    def run(batches):
        often = heavy.value
        for whole in batches:
            for batch in chunks(whole, "__text", LIGHT_CHARS):
                cols: dict[str, list] = {k: [] for k in ("n", "f1", "f2", "bitmap", "mins", "rare", "common")}
                for s in shingle_sets(batch.column("__text").to_pylist(), words):
                    u = s.view(np.uint64)
                    n = len(s)
                    hashed = [mix64(u ^ salt) for salt in _SALTS]
                    cols["n"].append(n)
                    cols["f1"].append(int(hashed[0].sum(dtype=np.uint64).view(np.int64)))
                    cols["f2"].append(int(hashed[1].sum(dtype=np.uint64).view(np.int64)))
                    cols["bitmap"].append(_bitmap(s) if n else b"")
                    cols["mins"].append([int(x.min().view(np.int64)) for x in hashed] if n else [])
                    place = np.minimum(np.searchsorted(often, s), max(0, len(often) - 1))
                    is_heavy = often[place] == s if len(often) else np.zeros(n, bool)
                    take = n - (percent * n + 99) // 100 + 1 if n else 0
                    light = s[~is_heavy][:take]
                    cols["rare"].append(light)
                    cols["common"].append(s[is_heavy][: take - len(light)])
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column("__id"), pa.array(cols["n"], pa.int64()), pa.array(cols["f1"], pa.int64()), pa.array(cols["f2"], pa.int64()),
                    pa.array(cols["bitmap"], pa.binary()), *(pa.array(cols[k], lists) for k in ("mins", "rare", "common"))],
                    ["id", "n", "f1", "f2", "bitmap", "mins", "rare", "common"])

    return docs.mapInArrow(run, "id long, n long, f1 long, f2 long, bitmap binary, mins array<long>, rare array<long>, common array<long>")


def _sizes_fit(a, b, percent: int):
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(__id, __text) of the ids."""
    # A bitmap of fixed size (65,536 words) keeps most other texts out of the shuffle; the join decides.
    slot = F.xxhash64("__id").bitwiseAND(F.lit((1 << 22) - 1))
    bits = ids.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(xxhash64(__id) & 63 AS int))")).alias("bits"))
    near = docs.withColumn("word", F.shiftright(slot, 6)).join(F.broadcast(bits), "word").where(F.expr("(bits & shiftleft(1L, cast(xxhash64(__id) & 63 AS int))) <> 0"))
    return near.join(ids, "__id", "left_semi").select("__id", "__text")


def _wide_maps(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, f1, f2, bitmap) of the ids' texts, with bitmaps ``WIDE`` times as wide."""
    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "__text", LIGHT_CHARS):
                sets = shingle_sets(batch.column("__text").to_pylist(), words)
                marks = [_marks(x) for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                                                  pa.array([_bitmap(x, WIDE) if len(x) else b"" for x in sets], pa.binary())], ["id", "f1", "f2", "bitmap"])

    return _texts_of(ids, docs).mapInArrow(run, "id long, f1 long, f2 long, bitmap binary").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, by intersecting their sorted arrays."""
    pairs = scratch.save(pairs.distinct(), "pairs")
    ids = scratch.save(pairs.select(F.col("a").alias("__id")).union(pairs.select(F.col("b").alias("__id"))).distinct(), "ids")

    def arrays(batches):
        for whole in batches:
            for batch in chunks(whole, "__text", LIGHT_CHARS):
                sets = shingle_sets(batch.column("__text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "items"])

    sets = scratch.save(_texts_of(ids, docs).mapInArrow(arrays, "id long, items array<long>"), "sets")

    def intersect(batches):
        for batch in batches:
            a, b = batch.column("x"), batch.column("y")
            xs, ys = a.values.to_numpy(), b.values.to_numpy()
            xo, yo = a.offsets.to_numpy().tolist(), b.offsets.to_numpy().tolist()
            keep = []
            for i in range(len(batch)):
                x, y = xs[xo[i]: xo[i + 1]], ys[yo[i]: yo[i + 1]]
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    out = scratch.save(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(intersect, "a long, b long").distinct(), "links")
    scratch.drop(pairs, ids, sets)
    return out


def _leader_pairs(nodes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    each = nodes.select("id", "n", F.posexplode("mins").alias("k", "least"))
    led = scratch.save(each.groupBy("k", "least").agg(F.min(F.struct("id", "n")).alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1").select(
        "k", "least", F.col("leader.id").alias("a"), F.col("leader.n").alias("an")), "leaders")
    met = each.join(led, ["k", "least"]).where((F.col("a") != F.col("id")) & _sizes_fit(F.col("n"), F.col("an"), percent)).groupBy(F.col("id").alias("b"), "a").count()
    return met.where(F.col("count") >= MEETS).groupBy("b").agg(F.max(F.struct("count", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")


def _rare_meetings(base: DataFrame) -> DataFrame:
    """(token, id) of light prefix shingles that at least two documents have.

    A light shingle is in less than about ``HEAVY`` of the documents, so no partition is hot.
    """
    each = base.select("id", F.explode("rare").alias("token")).repartition("token").sortWithinPartitions("token")

    def shared(batches):
        def pick(token, ids):
            same = token[1:] == token[:-1]
            keep = np.zeros(len(token), bool)
            keep[1:] |= same
            keep[:-1] |= same
            return pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(ids[keep])], ["token", "id"])

        rest_t, rest_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            token = np.concatenate((rest_t, batch.column("token").to_numpy()))
            ids = np.concatenate((rest_i, batch.column("id").to_numpy()))
            stop = int(np.searchsorted(token, token[-1])) if len(token) else 0
            yield pick(token[:stop], ids[:stop])
            rest_t, rest_i = token[stop:], ids[stop:]
        yield pick(rest_t, rest_i)

    return each.select("token", "id").mapInArrow(shared, "token long, id long")


def _met_before(token: int, heavy: bool, firsts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the pairs share one of their first light or heavy shingles that comes before ``token`` in the order, and so met in another tile.

    ``firsts`` holds ``FIRSTS`` light ones, then ``FIRSTS`` heavy ones.  Of a token that is not among them all of its own kind and all lighter ones come before.
    """
    known = np.where((firsts == token).any(axis=1), (firsts == token).argmax(axis=1), 2 * FIRSTS if heavy else FIRSTS)
    out = np.zeros(len(x), bool)
    for p in range(2 * FIRSTS):
        for q in range(2 * FIRSTS):
            out |= (firsts[x, p] == firsts[y, q]) & (p < known[x]) & (q < known[y])
    return out


def _tiles(meetings: DataFrame, nodes: DataFrame, labels: DataFrame, scratch: Scratch, percent: int, best: bool, docs: DataFrame, words: int) -> DataFrame:
    """Candidate pairs (a, b, token, band) of different labels that the bitmaps let pass.

    With ``best`` each document of a tile names its best partner only, and tiles that hold more pairs are named in
    rows without a pair.  Otherwise wide bitmaps judge all pairs.
    """
    node = scratch.save(nodes.join(labels, "id", "left").select("id", "f1", "f2", "n", "bitmap", "firsts", F.coalesce("label", "id").alias("label"), F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int").alias("band")), "node")
    met = scratch.save(meetings.join(node.select("id", "label", "band"), "id"), "met")
    seats = met.withColumn("guest", F.lit(False)).union(met.withColumn("band", F.col("band") + 1).withColumn("guest", F.lit(True)))
    counted = lambda guest: F.ceil(F.sum(F.when(F.col("guest") == guest, 1).otherwise(0)) / TILE).cast("int")
    tiles = seats.groupBy("token", "band").agg(counted(False).alias("homes"), counted(True).alias("guests"), F.min("label").alias("low"), F.max("label").alias("high"))
    # a tile needs two labels; guests among themselves meet in the tile below
    tiles = scratch.save(tiles.where("homes > 0 and low < high").drop("low", "high"), "tiles")
    h = F.xxhash64("id")
    mine = F.when(F.col("guest"), F.pmod(h, F.greatest("guests", F.lit(1)))).otherwise(F.pmod(h, "homes")).cast("int")
    cell = lambda k, i, j: F.struct(F.lit(k).alias("k"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    # cells (0, i, j): home blocks i <= j; cells (1, i, j): guest block i against home block j
    to = F.when(F.col("guest"), F.transform(upto(F.col("homes")), lambda j: cell(1, mine, j))).otherwise(F.concat(
        F.transform(upto(F.col("homes")), lambda j: cell(0, F.least(mine, j), F.greatest(mine, j))),
        F.when(F.col("guests") > 0, F.transform(upto(F.col("guests")), lambda i: cell(1, i, mine))).otherwise(F.array().cast("array<struct<k:int,i:int,j:int>>"))))
    cells = ["token", "band", "k", "i", "j"]
    dealt = seats.join(tiles, ["token", "band"]).withColumn("mine", mine).withColumn("cell", F.explode(to)).select("token", "band", F.col("cell.k").alias("k"), F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "id", "label", "guest", "mine", "heavy")
    maps = node.select("id", "n", "bitmap", "firsts")
    if not best:
        ids = scratch.save(met.select(F.col("id").alias("__id")).distinct(), "ids")
        maps = node.drop("bitmap", "band", "label").join(scratch.save(_wide_maps(ids, docs, words), "wide"), ["id", "f1", "f2"]).select("id", "n", "bitmap", "firsts")
    rows = dealt.join(maps, "id").withColumn("cell", F.xxhash64(*cells)).repartition(*cells).sortWithinPartitions("cell", *cells)
    share = percent / (100 + percent)

    def passing(token: int, heavy: bool, n: np.ndarray, label: np.ndarray, apart: np.ndarray | None, maps: list[bytes], firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of places (p < q) that may reach the threshold, with the bound of their similarity."""
        m, wide, out = None, None, []
        for at in range(0, len(n), 256):
            first = np.arange(at, min(at + 256, len(n)))[:, None]
            second = np.arange(at + 1, len(n))[None, :]
            ok = (second > first) & (label[first] != label[second]) & (100 * np.minimum(n[first], n[second]) >= percent * np.maximum(n[first], n[second]))
            if apart is not None:
                ok &= apart[first] != apart[second]
            p, q = np.nonzero(ok)
            p, q = p + at, q + at + 1
            for k in range(0, len(p), 20_000):
                if m is None:
                    m = wide = _fold(maps)
                    if not best:
                        m = np.bitwise_or.reduce(wide.reshape(len(wide), WIDE, -1), axis=1)
                x, y = p[k: k + 20_000], q[k: k + 20_000]
                both = n[x] + n[y]
                bound = (both - np.bitwise_count(m[x] ^ m[y]).sum(axis=1, dtype=np.int64)) / 2
                fits = bound >= share * both - 1e-9
                if fits.any():
                    fits[fits] = ~_met_before(token, heavy, firsts, x[fits], y[fits])
                if not best and fits.any():
                    x, y, both = x[fits], y[fits], both[fits]
                    bound = (both - np.bitwise_count(wide[x] ^ wide[y]).sum(axis=1, dtype=np.int64)) / 2
                    fits = bound >= share * both - 1e-9
                if fits.any():
                    out.append((x[fits], y[fits], (bound / (both - bound))[fits]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def run(batches):
        held: list[pa.RecordBatch] = []
        found: list[tuple] = []

        def work(t: pa.Table):
            cols = {c: t.column(c).to_numpy() for c in (*cells, "id", "n", "label", "mine")}
            guest, maps = t.column("guest").to_numpy(), t.column("bitmap")
            firsts = t.column("firsts").combine_chunks().flatten().to_numpy().reshape(-1, 2 * FIRSTS)
            heavy = t.column("heavy").to_numpy()
            cuts = np.zeros(len(t), bool)
            cuts[0] = True
            for c in cells:
                cuts[1:] |= cols[c][1:] != cols[c][:-1]
            at = np.append(np.flatnonzero(cuts), len(t))
            several = np.flatnonzero(np.diff(at) > 1)
            lowest, highest = np.minimum.reduceat(cols["label"], at[:-1]), np.maximum.reduceat(cols["label"], at[:-1])
            for g in several[lowest[several] < highest[several]].tolist():
                a, b = int(at[g]), int(at[g + 1])
                apart = guest[a:b] if cols["k"][a] == 1 else cols["mine"][a:b] if cols["i"][a] != cols["j"][a] else None
                x, y, near = passing(cols["token"][a], bool(heavy[a]), cols["n"][a:b], cols["label"][a:b], apart, maps.slice(a, b - a).to_pylist(), firsts[a:b])
                if not len(x):
                    continue
                place = (int(cols["token"][a]), int(cols["band"][a]))
                if best:
                    whole = len(x)
                    ends, pair = np.concatenate((x, y)), np.tile(np.arange(whole), 2)
                    order = np.lexsort((pair, -np.tile(near, 2), ends))
                    first = np.append(True, ends[order][1:] != ends[order][:-1])
                    chosen = np.unique(pair[order][first])
                    x, y = x[chosen], y[chosen]
                    if len(x) < whole:
                        found.append((np.array([-1]), np.array([-1]), place))
                u, v = cols["id"][a:b][x], cols["id"][a:b][y]
                found.append((np.minimum(u, v), np.maximum(u, v), place))

        def flush():
            a, b, token, band = (np.concatenate([f(*x) for x in found]) if found else np.zeros(0, np.int64) for f in (
                lambda u, v, w: u, lambda u, v, w: v, lambda u, v, w: np.full(len(u), w[0]), lambda u, v, w: np.full(len(u), w[1])))
            found.clear()
            if not best and len(a):
                kept = np.unique(np.stack((a, b)), axis=1)
                a, b = kept
                token = band = np.zeros(len(a), np.int64)
            none = a == -1
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64(), mask=none), pa.array(b, pa.int64(), mask=none), pa.array(token, pa.int64()), pa.array(band, pa.int64())], ["a", "b", "token", "band"])

        for batch in batches:
            if not len(batch):
                continue
            last = batch.column("cell").to_numpy()
            inner = np.flatnonzero(last != last[-1])
            stop = int(inner[-1]) + 1 if len(inner) else 0
            if held and last[0] != held[0].column("cell")[0].as_py() or stop:
                work(pa.Table.from_batches([*held, batch.slice(0, stop)]).combine_chunks())
                held = []
            held.append(batch.slice(stop))
            if sum(len(x) for x, _, _ in found) > 50_000:
                yield flush()
        if held:
            work(pa.Table.from_batches(held).combine_chunks())
        yield flush()

    out = scratch.save(rows.mapInArrow(run, "a long, b long, token long, band long").distinct(), "candidates")
    scratch.drop(node, met, tiles)
    return out


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row; see the module for method and cases."""
    scratch = Scratch(df.sparkSession)
    every = df.select(F.col(id_column).alias("__id"), F.col(text).alias("__text"))
    docs = every.where("__id is not null")
    base = scratch.save(describe_sets(every, words, percent), "base")
    some = base.where("id is not null and n > 0")
    key = ["n", "f1", "f2"]
    classes = scratch.save(some.groupBy(*key).agg(F.min("id").alias("rep")), "classes")
    # a missing one is a value of the document's own
    firsts = F.array(*[F.coalesce(F.get(part, F.lit(i)), F.xxhash64(F.lit("none"), "id", F.lit(part), F.lit(i))) for part in ("rare", "common") for i in range(FIRSTS)])
    nodes = some.select(*key, "id", "mins", "bitmap", firsts.alias("firsts")).join(classes.withColumnRenamed("rep", "id"), [*key, "id"])
    nodes = scratch.save(nodes.dropDuplicates([*key, "id"]).select("id", *key, "mins", "bitmap", "firsts"), "nodes")
    led = _verified(_leader_pairs(nodes, scratch, percent), docs, scratch, words, percent)
    labels = scratch.save(led.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label")), "labels")
    meetings = scratch.save(_rare_meetings(some).withColumn("heavy", F.lit(False)).union(some.select(F.explode("common").alias("token"), "id", F.lit(True).alias("heavy"))), "meetings")
    tried = _tiles(meetings, nodes, labels, scratch, percent, True, docs, words)
    found = _verified(tried.where("a is not null").select("a", "b"), docs, scratch, words, percent)
    links = scratch.save(led.union(found).distinct(), "links")
    scratch.drop(labels, led, found)
    labels = scratch.save(components(links, scratch).select(F.col("node").alias("id"), F.col("root").alias("label")), "labels")
    # what the best partners leave open; both ends of a pair sit in the tile as home, or one band below as its guest
    again = scratch.save(tried.where("a is null").select("token").distinct(), "again")
    left = scratch.save(meetings.join(again, "token", "left_semi"), "rest")
    scratch.drop(meetings)
    rest = _tiles(left, nodes, labels, scratch, percent, False, docs, words)
    found = _verified(rest.select("a", "b").join(tried.select("a", "b"), ["a", "b"], "left_anti"), docs, scratch, words, percent)
    scratch.drop(nodes, left, again, tried, rest)
    many = some.groupBy("id").agg(F.min("f1").alias("x"), F.max("f1").alias("y")).where("x <> y").select("id")
    found = found.union(some.join(many, "id").join(classes, key).select("id", "rep"))
    roots = scratch.save(components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(found), scratch), "roots")
    named = scratch.save(classes.join(roots, F.col("rep") == F.col("node"), "left").select(*key, F.coalesce("root", "rep").alias("root")), "named")
    scratch.drop(labels, links, classes, roots)
    root = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return base.select("id", *key).join(named, key, "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), root.alias("component_id"))
