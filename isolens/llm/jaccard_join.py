"""Self-join of documents whose sets of word n-grams have a Jaccard similarity of at least least / 100, exactly.

Equal sets form a class, and only classes are joined.  The shingles of a set are ordered from rare to common;
two similar sets share a shingle among the first |x| - ceil(t |x|) + 1 of each, so the index lists, for
each shingle, the classes that have it there.  Any order is exact: which shingles are common is
counted by the tasks that read the texts, and at most MOST_COMMON of them are moved to the end.

Set relations save the comparison of all pairs of a list:

1. Every list has a leader, its first class.  Each class is compared with the leaders of its lists, a number
   linear in the index.  The links found merge most classes of a large group of near copies.
2. Of each list, pairs of classes that are not yet connected are candidates, if no bound rules them out.  In one
   round a spanning forest of the candidates of each list is compared, the likeliest first, again a linear
   number; it merges nearly all that belongs together.  In the last round all that remain are compared.
   The bounds:  a set's answer is derived
   from the leader's: with o(x) tokens of the leader in x, a pair shares at most
   min(o(x), o(y)) + min(|x| - o(x), |y| - o(y)).  Lists are sorted by size and cut into blocks, which are
   skipped whole when sizes and positions (tokens that follow the shared one) rule out every pair; single pairs are
   ruled out by sizes, positions, the leader's bound, and the distance of 512-bit parity sketches, a lower
   bound of the sets' difference.  The pairs that are left are compared exactly.
3. Lists are never gathered: their lengths, leaders and components are counted by aggregation and joined back.  Lists longer
   than BLOCK entries are cut into bands of similar sizes, of which only equal and neighbouring ones can hold similar sets,
   and each pair of bands into blocks of BLOCK entries.  Entries of the component that has most of a band are paired with
   the other entries alone, so a hot list of near copies costs its length times the number of blocks that the others fill.

Components are exact: what is not compared is either connected already or ruled out by a bound.  The links are those that
were needed to connect the components, not all similar pairs: pairs that are connected already are never compared.

Sets are compared by 64-bit hashes of shingles and of sets.  A document with fewer words than n has its whole word
sequence as the one shingle; without words or text its set is empty and it is linked with nothing.  Rows
without doc_id are linked with nothing; repeated rows give a row each; columns besides doc_id and text are ignored; an empty
table gives no rows.  A text of any length is one set; chunks of text bound the memory but for that of its own shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isolens.llm import textkit
from isolens.llm.components import components, extended
from isolens.llm.scratch import broadcast_up_to, passing, saved

MOST_COMMON = 200_000
#: A task names a shingle common that it saw in so many of its documents.
COMMON = 4
BLOCK = 8192
SKIP = 64
MOST_WANTED = 2_000_000
SKETCH = 512
#: Classes or shingles that a task remembers, to say less twice; what it forgets costs time alone.
REMEMBERED = 500_000

#: Of lists up to this length all candidates are compared in the first round.
SMALL = 32
#: Most bits of a wide sketch, which has about as many bits as its set has shingles.
WIDEST = 1 << 16

SETS = "doc_id bigint, n_shingles bigint, class bigint, prefix array<bigint>, sketch array<bigint>, wide array<bigint>"


def shingles(chunk: textkit.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each n words in a row; of a text with fewer, of all its words."""
    low = textkit.LOWER[chunk.data]
    at = textkit.words(textkit.Chunk(0, low, chunk.offsets))
    h = textkit.Hasher(low)(at.start, at.end)
    first, gram = textkit.ngrams(h, at.doc, n)
    docs, grams = [at.doc[first]], [gram]
    counts = np.bincount(at.doc, minlength=chunk.n)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        whole = np.full(len(short), k, np.uint64)
        for i in range(k):
            whole = textkit.mix(whole * np.uint64(0x9DDFEA08EB382D69) + h[begin[short] + i])
        docs.append(short)
        grams.append(whole)
    return np.concatenate(docs), np.concatenate(grams)


def ordered_sets(chunk: textkit.Chunk, n: int, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of distinct shingles, each text's in index order: by hash, then the common ones by rank."""
    doc, h = shingles(chunk, n)
    key = h >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        hit = common[at] == h
        key[hit] = (np.uint64(1) << np.uint64(63)) + rank[at[hit]]
    by = np.lexsort((h, key, doc))
    doc, h = doc[by], h[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _sketches(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """(n, SKETCH / 64) longs: the parity of the shingles that fall on each bit."""
    out = np.zeros((n, SKETCH // 8), np.uint8)
    cuts = np.searchsorted(doc, np.arange(0, n + 1024, 1024))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        low, high = k * 1024, min(n, (k + 1) * 1024)
        bit = (doc[a:b] - low) * SKETCH + (h[a:b] & np.uint64(SKETCH - 1)).astype(np.int64)
        parity = np.bincount(bit, minlength=(high - low) * SKETCH) & 1
        out[low:high] = np.packbits(parity.astype(np.uint8).reshape(high - low, SKETCH), axis=1)
    return out.view(np.int64)


def _wide_sketches(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, longs): parity sketches whose width, a power of two, follows the size of each set."""
    width = np.left_shift(1, np.clip(np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), int(np.log2(SKETCH)), int(np.log2(WIDEST))))
    base = np.concatenate([[0], np.cumsum(width)])
    parity = np.bincount(base[doc] + (h & (width[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=base[-1]) & 1
    return base // 64, np.packbits(parity.astype(np.uint8)).view(np.int64)


def _near(least: int):
    """Rows (a, b, size_a, size_b) of those with wide_a and wide_b whose sketches, the wider folded, do not rule out similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            allowed = size - 2 * -(-size * least // (100 + least))
            sides = [(c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in (batch.column(4), batch.column(5))]
            keep = np.ones(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (values[offsets[i] : offsets[i + 1]] for offsets, values in sides)
                m = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(v.reshape(-1, m), axis=0) for v in (x, y))
                keep[i] = np.bitwise_count(x ^ y).sum(dtype=np.int64) <= allowed[i]
            yield batch.select(["a", "b", "size_a", "size_b"]).filter(pa.array(keep))

    return run


def _common(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        held, held_n = [none], [np.zeros(0, np.int64)]

        def summed() -> tuple[np.ndarray, np.ndarray]:
            h, back = np.unique(np.concatenate(held), return_inverse=True)
            return h, np.bincount(back, weights=np.concatenate(held_n), minlength=len(h)).astype(np.int64)

        def named() -> pa.RecordBatch:
            h, count = summed()
            many = count >= COMMON
            return pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64)), pa.array(count[many])], ["h", "n"])

        for batch in batches:
            for chunk in textkit.chunks(batch.column(0), 2 * textkit.CHUNK):
                _, h = ordered_sets(chunk, n, none, none)
                h, count = np.unique(h, return_counts=True)
                held.append(h[count > 1])
                held_n.append(count[count > 1])
            if sum(map(len, held)) > REMEMBERED:
                h, count = summed()
                held, held_n = [h], [count]
                if len(h) > REMEMBERED // 2:
                    yield named()
                    held, held_n = [none], [np.zeros(0, np.int64)]
        yield named()

    return run


def common_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, rank of each) of the shingles that many documents have, at most MOST_COMMON."""
    rows = docs.select("text").mapInArrow(_common(n), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    rank = np.empty(len(h), np.uint64)
    rank[np.lexsort((h, rows.column("n").to_numpy()))] = np.arange(len(h), dtype=np.uint64)
    by = np.argsort(h)
    return h[by], rank[by]


def _class_keys(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, a hash of each text's set, whatever its order)."""
    size = np.bincount(doc, minlength=n)
    cuts = np.concatenate([[0], np.cumsum(size)])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textkit.mix(h ^ np.uint64(0x5851F42D4C957F2D)))])
    return size, textkit.mix(total[cuts[1:]] - total[cuts[:-1]] + size.astype(np.uint64)).view(np.int64)


def _prefixes(n: int, least: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = shared.value
        met: set[int] = set()  # a task gives the prefix of a class once, however many copies it reads
        for batch in batches:
            for chunk in textkit.chunks(batch.column(1)):
                doc, h = ordered_sets(chunk, n, common, rank)
                size, key = _class_keys(doc, h, chunk.n)
                begin = np.concatenate([[0], np.cumsum(size)])
                ids = batch.column(0)[chunk.first : chunk.first + chunk.n]
                named = np.flatnonzero(~ids.is_null().to_numpy(zero_copy_only=False))
                first = named[np.unique(key[named], return_index=True)[1]]
                new = np.zeros(chunk.n, bool)
                new[[i for i in first if key[i] not in met]] = True
                met = met if len(met) < REMEMBERED else set()
                met.update(key[new].tolist())
                prefix = np.where(new & (size > 0), size + (-least * size) // 100 + 1, 0)
                place = np.arange(len(doc)) - begin[doc]
                kept = h[place < prefix[doc]].view(np.int64)
                classes = pa.array(key, mask=(size == 0) | ids.is_null().to_numpy(zero_copy_only=False))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(prefix)]).astype(np.int32)), pa.array(kept))
                sketches = pa.ListArray.from_arrays(pa.array(np.arange(chunk.n + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(_sketches(doc, h, chunk.n).reshape(-1)))
                offsets, longs = _wide_sketches(doc, h, size)
                wide = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(longs))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size), classes, lists, sketches, wide], [c.split()[0] for c in SETS.split(", ")])

    return run


def _own_texts(n: int):
    """(class, text) of the rows whose text makes the set that the class stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for chunk in textkit.chunks(batch.column(1)):
                _, key = _class_keys(*ordered_sets(chunk, n, none, none), chunk.n)
                own = batch.slice(chunk.first, chunk.n)
                yield own.filter(pa.array(key == own.column(0).to_numpy()))

    return run


def _intersected(n: int):
    """(a, b, both) of rows (a, b, text_a, text_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            both = np.zeros(batch.num_rows, np.int64)
            weight = np.asarray(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))), np.int64)
            cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(np.cumsum(weight) // textkit.CHUNK)) + 1, [0, batch.num_rows]]))
            for low, high in zip(cuts[:-1], cuts[1:]):
                sides = []
                for column in (2, 3):
                    for chunk in textkit.chunks(batch.column(column)[low:high], 1 << 62):
                        doc, h = ordered_sets(chunk, n, none, none)
                        sides.append(textkit.mix(h + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
                        if column == 2:
                            rows = doc
                at = np.argsort(sides[1])
                place = np.minimum(np.searchsorted(sides[1], sides[0], sorter=at), max(len(at) - 1, 0))
                shared = sides[1][at[place]] == sides[0] if len(at) else np.zeros(len(sides[0]), bool)
                both[low:high] = np.bincount(rows[shared], minlength=high - low)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both)], ["a", "b", "both"])

    return run


def _fits(size_a: Column, size_b: Column, least: int) -> Column:
    return F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * least


def _compared(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """pairs (a, b and sizes) with the size of the intersection of the two sets.

    The texts of the classes meet, not their sets: hashes cannot be compressed, texts can.  Up to MOST_WANTED ids
    are broadcast to find them; beyond, the documents are shuffled by id.
    """
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct().join(classes.select("class", "rep"), "class")
    wanted = broadcast_up_to(saved(wanted.select(F.col("rep").alias("doc_id"), "class"), "wanted"), MOST_WANTED)
    texts = docs.join(wanted, "doc_id").select("class", "text").mapInArrow(_own_texts(n), "class bigint, text string")
    # another row may have the doc_id with another text, or with the same again
    texts = texts.groupBy("class").agg(F.first("text").alias("text"))
    of = lambda end: texts.select(F.col("class").alias(end), F.col("text").alias(f"text_{end}"))
    met = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b")
    return met.mapInArrow(_intersected(n), "a bigint, b bigint, both bigint").join(pairs, ["a", "b"])


def _spanning(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[int]:
    """Which of the pairs (x, y), in this order, join different labels; label is updated."""
    out = []
    left = np.flatnonzero(label[x] != label[y])
    while len(left):
        k = left[0]
        out.append(k)
        label[label == label[y[k]]] = label[x[k]]
        left = left[label[x[left]] != label[y[left]]]
    return out


def _blocks_of_pairs(least: int, forest: bool):
    """Pairs of each group of a list (a row of each entry) that no bound rules out, or a spanning forest of them; all pairs in block 0, else those across blocks."""
    names = ["token", "group", "block", "class", "size", "pos", "component", "led"]

    def candidates(g: dict, sketch: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, sketch distance as a share of what similar sets may have), block by block."""
        size, rest = g["size"], g["size"] - g["pos"]
        starts = np.arange(0, len(size), SKIP)
        smallest, largest, longest = size[starts], np.maximum.reduceat(size, starts), np.maximum.reduceat(rest, starts)
        one = not g["block"].any()
        for i, s in enumerate(starts):
            x = slice(s, s + SKIP)
            # blocks from this one on, while sizes and positions allow a similar pair
            fits = (np.arange(len(starts)) >= i) & (smallest * least <= 100 * largest[i])
            fits &= np.minimum(longest, longest[i]) * (100 + least) >= least * (smallest + smallest[i])
            for j in np.flatnonzero(fits):
                y = slice(starts[j], starts[j] + SKIP)
                ok = label[x][:, None] != label[y][None, :]
                if not one:
                    ok &= g["block"][x][:, None] != g["block"][y][None, :]
                if i == j:
                    ok &= np.arange(ok.shape[0])[:, None] < np.arange(ok.shape[1])[None, :]
                if not ok.any():
                    continue
                sx, sy = size[x][:, None], size[y][None, :]
                need = -(-(sx + sy) * least // (100 + least))
                ok &= (np.minimum(sx, sy) * 100 >= np.maximum(sx, sy) * least) & (np.minimum(rest[x][:, None], rest[y][None, :]) >= need)
                ox, oy = g["led"][x][:, None], g["led"][y][None, :]
                bound = np.minimum(ox, oy) + np.minimum(sx - ox, sy - oy)
                ok &= (ox < 0) | (oy < 0) | (bound >= need)
                a, b = np.nonzero(ok)
                if len(a):
                    apart = np.bitwise_count(sketch[x][a] ^ sketch[y][b]).sum(axis=1, dtype=np.int64)
                    allowed = sx[a, 0] + sy[0, b] - 2 * need[a, b]
                    near = np.flatnonzero(apart <= allowed)
                    yield a[near] + s, b[near] + starts[j], apart[near] / np.maximum(allowed[near], 1)

    def pairs(g: dict, sketch: np.ndarray) -> np.ndarray:
        by = np.argsort(g["size"], kind="stable")
        g = {k: v[by] for k, v in g.items()}
        label = np.unique(g["component"], return_inverse=True)[1]
        out = [np.zeros((0, 2), np.int64)]
        for likely in (0.7, 1.0) if forest else (1.0,):
            for x, y, apart in candidates(g, sketch[by], label):
                if forest:
                    order = np.argsort(apart, kind="stable")
                    order = order[apart[order] <= likely]
                    kept = order[_spanning(label, x[order], y[order])]
                    x, y = x[kept], y[kept]
                out.append(np.sort(np.stack([g["class"][x], g["class"][y]], axis=1), axis=1))
        return np.concatenate(out)

    def of_small(g: dict, sketch: np.ndarray, group: np.ndarray) -> np.ndarray:
        """All candidates of many short lists at once: each entry with the k-th after it, while both are of one list."""
        out = [np.zeros((0, 2), np.int64)]
        for k in range(1, SMALL):
            x = np.flatnonzero(group[k:] == group[:-k])
            if not len(x):
                break
            y = x + k
            ok = g["component"][x] != g["component"][y]
            x, y = x[ok], y[ok]
            sx, sy = g["size"][x], g["size"][y]
            need = -(-(sx + sy) * least // (100 + least))
            ox, oy = g["led"][x], g["led"][y]
            ok = (np.minimum(sx, sy) * 100 >= np.maximum(sx, sy) * least) & (np.minimum(sx - g["pos"][x], sy - g["pos"][y]) >= need)
            ok &= (ox < 0) | (oy < 0) | (np.minimum(ox, oy) + np.minimum(sx - ox, sy - oy) >= need)
            x, y, allowed = x[ok], y[ok], (sx + sy - 2 * need)[ok]
            near = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64) <= allowed
            out.append(np.sort(np.stack([g["class"][x[near]], g["class"][y[near]]], axis=1), axis=1))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            g = {k: t.column(k).to_numpy() for k in names}
            sketch = t.column("sketch").combine_chunks()
            sketch = (sketch.chunk(0) if isinstance(sketch, pa.ChunkedArray) else sketch).flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH // 64)
            new = np.flatnonzero((np.diff(g["token"]) != 0) | (np.diff(g["group"]) != 0)) + 1
            cuts = np.concatenate([[0], new, [len(sketch)]])
            n = np.diff(cuts)
            group = np.repeat(np.arange(len(n)), n)
            small = n[group] <= SMALL
            out = [of_small({k: v[small] for k, v in g.items()}, sketch[small], group[small])]
            out += [pairs({k: v[a:b] for k, v in g.items()}, sketch[a:b]) for a, b in zip(cuts[:-1][n > SMALL], cuts[1:][n > SMALL])]
            rows = np.unique(np.concatenate(out), axis=0)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            keys = [t.column(k).to_numpy() for k in ("token", "group")]
            last = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = t.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                yield from found(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from found(rest)

    return run


def _band(size: Column, least: int) -> Column:
    """The band of a size: two sets of which the larger has at most 100 / least times the shingles are in equal or neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / (math.log(100 / least) + 1e-6))


def _bands(long: DataFrame, least: int) -> DataFrame:
    """For each band of the lists (token, class, size, component): main, its component of most entries, and how many blocks it and the rest fill."""
    of_component = long.groupBy("token", _band(F.col("size"), least).alias("band"), "component").agg(F.count(F.lit(1)).alias("k"))
    of = of_component.groupBy("token", "band").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("k"))
    return of.select("token", "band", "main", F.ceil(F.col("most") / BLOCK).alias("mains"), F.ceil((F.col("k") - F.col("most")) / BLOCK).alias("others"))


def _dealt(own: DataFrame, bands: DataFrame, least: int) -> DataFrame:
    """own (token, class, size, component, n, ...), each entry once for every group in which it meets others: with group, and block in it.

    A list of up to BLOCK entries is one group, of block 0.  Of longer lists, two entries of different components whose sizes
    allow a similar pair meet in exactly one group; its entries are of one block (0 again: all pairs) or of two, which are paired
    across.  Blocks are numbered from 0 up, those of the main component from -1 down.
    """
    columns = [c for c in own.columns if c != "n"]
    if bands.isEmpty():
        return own.select(*columns, F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("block"))
    beside = lambda by, name: bands.select("token", (F.col("band") - by).alias("band"), *[F.col(c).alias(f"{name}_{c}") for c in ("main", "mains", "others")])
    around = bands.join(beside(1, "up"), ["token", "band"], "left").join(beside(-1, "down"), ["token", "band"], "left")
    at = own.withColumn("band", F.when(F.col("n") > BLOCK, _band(F.col("size"), least))).join(broadcast_up_to(saved(around, "around"), MOST_WANTED), ["token", "band"], "left")
    is_main, band, spread = F.col("component") == F.col("main"), F.col("band"), F.xxhash64("class")
    at = at.withColumn("own", F.when(is_main, -1 - F.pmod(spread, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(spread, F.greatest("others", F.lit(1)))))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    all_of = lambda mains, others: F.concat(F.transform(upto(F.col(mains)), lambda x: -1 - x), upto(F.col(others)))
    met = {
        0: F.when(is_main, upto(F.col("others"))).otherwise(all_of("mains", "others")),
        1: F.when(is_main & (F.col("main") == F.col("up_main")), upto(F.col("up_others"))).otherwise(all_of("up_mains", "up_others")),
        -1: F.when(is_main & (F.col("main") == F.col("down_main")), upto(F.col("down_others"))).otherwise(all_of("down_mains", "down_others")),
    }
    side = lambda band, x: F.struct(band.alias("band"), x.alias("block"))

    def pairs(by: int, blocks: Column) -> Column:
        mine = side(band, F.col("own"))
        return F.transform(blocks, lambda x: F.struct(F.least(mine, side(band + by, x)).alias("lo"), F.greatest(mine, side(band + by, x)).alias("hi")))

    kind = "array<struct<lo:struct<band:bigint,block:bigint>,hi:struct<band:bigint,block:bigint>>>"
    at = at.withColumn("pair", F.explode(F.when(F.col("main").isNull(), F.array(F.lit(None)).cast(kind)).otherwise(F.concat(*[pairs(by, blocks) for by, blocks in met.items()]))))
    within = F.col("pair").isNull() | (F.col("pair.lo") == F.col("pair.hi"))
    return at.select(*columns, F.when(F.col("pair").isNull(), F.lit(0)).otherwise(F.xxhash64("pair")).alias("group"), F.when(within, F.lit(0)).otherwise(F.xxhash64("band", "own")).alias("block"))


def join_classes(docs: DataFrame, n: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sets: doc_id, n_shingles, class; classes: class, rep, size; links: a, b, both; components: v, root) of classes.

    links connect every component and hold similar pairs only, but not all of them: see above.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    with passing(spark) as keep:
        shared = spark.sparkContext.broadcast(common_shingles(docs, n))
        sets = keep(saved(docs.mapInArrow(_prefixes(n, least, shared), SETS), "sets"))
        grouped = sets.filter("class is not null").groupBy("class")
        prefix = F.first(F.when(F.size("prefix") > 0, F.col("prefix")), ignorenulls=True)
        info = keep(saved(grouped.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"), prefix.alias("prefix")), "classes"))
        entries = info.select("class", F.posexplode("prefix").alias("pos", "token"))
        # counted by partial sums, so a hot list is one row for each task; the join splits what is skewed
        counts = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("leader")).filter("n > 1")
        lists = saved(entries.join(counts, "token"), "lists")

        def plausible(pairs: DataFrame) -> DataFrame:
            """The pairs, with sizes, that sizes and wide sketches do not rule out."""
            of = lambda end: info.select(F.col("class").alias(end), F.col("size").alias(f"size_{end}"), F.col("wide").alias(f"wide_{end}"))
            both = pairs.join(of("b"), "b").join(of("a"), "a").filter(_fits(F.col("size_a"), F.col("size_b"), least))
            return both.select("a", "b", "size_a", "size_b", "wide_a", "wide_b").mapInArrow(_near(least), "a bigint, b bigint, size_a bigint, size_b bigint")

        led = saved(plausible(lists.filter("leader <> class").select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct()), "pairs")
        led = keep(saved(_compared(docs, info, led, n), "led"))
        similar = F.col("both") * 100 >= least * (F.col("size_a") + F.col("size_b") - F.col("both"))
        first_links = led.filter(similar).select("a", "b", "both")
        roots = components(first_links)

        answers = led.select(F.col("a").alias("leader"), F.col("b").alias("class"), F.col("both").alias("led"))
        known = lists.join(answers, ["leader", "class"], "left").withColumn("led", F.when(F.col("leader") == F.col("class"), F.lit(-2)).otherwise(F.coalesce("led", F.lit(-1))).cast("long"))

        def open_pairs(roots: DataFrame, tried: DataFrame, forest: bool) -> DataFrame:
            """Pairs of classes of different components that may be similar and were not compared."""
            placed = lambda of: of.join(roots.select(F.col("v").alias("class"), "root"), "class", "left").withColumn("component", F.coalesce("root", "class")).drop("root")
            mixed = placed(lists.select("token", "class")).groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
            sized = info.select("class", "size", "sketch")
            long = placed(lists.filter(F.col("n") > BLOCK).select("token", "class").join(mixed.select("token"), "token", "left_semi")).join(sized.drop("sketch"), "class")
            bands = saved(_bands(long, least), "bands")
            own = placed(known.join(mixed.select("token"), "token", "left_semi"))
            own = own if forest else own.filter(F.col("n") > SMALL)
            own = own.join(sized, "class").withColumn("led", F.when(F.col("led") == -2, F.col("size")).otherwise(F.col("led")))
            own = own.select("token", "class", "size", F.col("pos").cast("long").alias("pos"), "component", "led", "sketch", "n")
            dealt = _dealt(own, bands, least).repartition("token", "group").sortWithinPartitions("token", "group")
            found = dealt.select("token", "group", "block", "class", "size", "pos", "component", "led", "sketch").mapInArrow(_blocks_of_pairs(least, forest), "a bigint, b bigint").distinct().join(tried, ["a", "b"], "left_anti")
            return saved(plausible(found), "open")

        tried = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = first_links
        for forest in (True, False):
            more = open_pairs(roots, tried, forest)
            if more.isEmpty():
                continue
            found = keep(saved(_compared(docs, info, more, n).filter(similar).select("a", "b", "both"), "links"))
            tried = tried.unionByName(more.select("a", "b"))
            if not found.isEmpty():
                links, roots = links.unionByName(found), extended(roots, found)
        keep(roots)
    return sets.select("doc_id", "n_shingles", "class"), info.select("class", "rep", "size"), links, roots


def similar_documents(docs: DataFrame, n: int = 4, least: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, for every row of docs."""
    with passing(docs.sparkSession) as keep:
        sets, classes, _, roots = join_classes(docs, n, least)
        placed = classes.join(roots.select(F.col("v").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
        of_class = placed.join(smallest, "root").select("class", "component_id")
        return keep(saved(sets.join(of_class, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "similar"))
