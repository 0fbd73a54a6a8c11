"""Quality rules for documents: repetition and length counts, and bands of n-gram perplexity for each language.

The language model is modified Kneser-Ney over the bytes of texts (order ORDER, every text preceded by
padding), two models for each language: texts are dealt by hash into halves, and a text is scored by the model of
the half that it is not in, so that neither it nor its exact copies vouch for it.  Spark counts the n-grams of every document: a task sums its own
before they are shuffled.  Continuation counts, discounts, context totals and interpolated probabilities
are DataFrame aggregations, windows over one context (at most 256 rows) and joins by the next shorter n-gram.  N-grams that texts of the other half ask
for take part with a count of 0, so that the interpolation yields their probability too, whatever it backs off to.

What texts ask for is then a table of 64-bit hash of (half and language, n-gram) and log probability (float32), which is written in
sorted shards of about SHARD entries, split by range of hash.  A task sorts the hashes of a chunk of text and looks them up
shard by shard; it holds KEPT shards at most, the last used, and reads the others from the shared folder.  The table grows with
the corpus, and nothing of it passes through the driver.

A text's cross entropy (log perplexity), for each byte and for each word, is compared with the quartiles of all documents
that the same model scores: outside [lower quartile - w * s, upper quartile + w * s] in either, it is rejected, where s is
the distance between quartiles times sqrt(1 + SHORT / bytes), as short texts scatter more, and w is width + UNSURE / sqrt(n)
for quartiles of n documents: three standard errors of such a bound, if entropies were normal.  Both are needed:
signs repeated after every word are cheap for each byte, but not for each word.  A language of which one half has no
text is scored by no model: its texts are alike, and the bands reject none.

A null text counts as empty, a null language as the empty one; repeated rows give a row each; columns besides doc_id,
text and lang are ignored; an empty table gives no rows.  A text of any length is counted and scored whole.  Equal entropies are
judged alike; a bound of a band is inside it.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isolens.llm import textkit
from isolens.llm.scratch import broadcast_up_to, passing, saved

ORDER = 5
SHARD, KEPT = 1_000_000, 12
#: Languages (and halves) whose discounts are broadcast at most; more of them are joined by a shuffle.
MOST_LANGUAGES = 100_000
WIDTH = 2.0
SHORT = 500.0
UNSURE = 7.5
#: n-grams that a task sums before it passes them on.
HELD = 2_000_000

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LINE = np.where(np.arange(256) == 10, 0, 1).astype(np.uint8)

STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_bytes bigint"


def _repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each of the hashes, whether its text has it twice or more."""
    keys = textkit.mix(h + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def stats(chunk: textkit.Chunk) -> list[np.ndarray]:
    """The STATS columns of the texts of a chunk."""
    data, offsets, n = chunk.data, chunk.offsets, chunk.n
    hasher = textkit.Hasher(data)
    at = textkit.words(chunk)
    inside = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~textkit.SPACE[data])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    lines = textkit.runs(chunk, _LINE)
    with_word = inside[lines.end] > inside[lines.start]
    start, end, doc = lines.start[with_word], lines.end[with_word], lines.doc[with_word]
    keys = np.unique(np.stack([doc.astype(np.uint64), hasher(start, end)]), axis=1) if len(doc) else np.zeros((2, 0), np.uint64)
    dup_lines = np.bincount(doc, minlength=n) - np.bincount(keys[0].astype(np.int64), minlength=n)
    first, gram = textkit.ngrams(hasher(at.start, at.end), at.doc, 5)
    often = first[_repeated(at.doc[first], gram)]
    change = np.zeros(len(at.start) + 1, np.int64)
    np.add.at(change, often, 1)
    np.add.at(change, often + 5, -1)
    repeats = np.bincount(at.doc, weights=np.cumsum(change[:-1]) > 0, minlength=n).astype(np.int64)
    of = lambda sums: sums[offsets[1:]] - sums[offsets[:-1]]
    return [np.bincount(at.doc, minlength=n), of(inside), of(symbols), dup_lines, repeats, np.diff(offsets)]


def gram_codes(chunk: textkit.Chunk, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) for each byte: the byte and the order - 1 before it in its text, zeros before the first."""
    data = chunk.data.astype(np.uint64)
    doc = np.repeat(np.arange(chunk.n), np.diff(chunk.offsets))
    place = np.arange(len(data)) - chunk.offsets[doc]
    code = data.copy()
    for k in range(1, order):
        shifted = np.zeros_like(data)
        shifted[k:] = data[:-k]
        shifted[place < k] = 0
        code |= shifted << np.uint64(8 * k)
    return doc, code


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[new], np.add.reduceat(count, new)


def _counted(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        total = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, (codes, counts) in held.items():
                code, count = _summed(codes, counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(count)], ["lang", "gram", "c"])

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for chunk in textkit.chunks(batch.column(0)):
                doc, code = gram_codes(chunk, order)
                own = langs[chunk.first : chunk.first + chunk.n]
                for lang in dict.fromkeys(own):
                    picked = np.sort(code[(own == lang)[doc]])
                    if not len(picked):
                        continue
                    new = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
                    codes, counts = held.setdefault(lang, ([], []))
                    codes.append(picked[new])
                    counts.append(np.diff(np.append(new, len(picked))))
                    total += len(new)
            if total > HELD:
                for lang, (codes, counts) in held.items():
                    code, count = _summed(codes, counts)
                    held[lang] = ([code], [count])
                total = sum(len(x[0][0]) for x in held.values())
                if total > HELD // 2:
                    yield from rows()
                    held, total = {}, 0
        yield from rows()

    return run


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, c: the n-grams of all documents."""
    own = docs.select("text", F.coalesce("lang", F.lit("")).alias("lang"))
    return own.mapInArrow(_counted(order), "lang string, gram bigint, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> DataFrame:
    """d1, d2, d3 for each language, from how many n-grams have counts of 1 to 4."""
    n = [F.sum(F.when(F.col("c") == k, 1.0).otherwise(0.0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    of = counts.groupBy("lang").agg(*n)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    have = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    d = lambda k: F.when(have, F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(F.lit(k / 2)).alias(f"d{k}")
    return of.select("lang", d(1), d(2), d(3))


def kneser_ney(grams: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, logp for each of the asked n-grams (lang, gram) by the model of the counted ones (lang, gram, c)."""
    mask = lambda k: F.lit((1 << (8 * k)) - 1)
    both = grams.select("lang", "gram", "c", F.lit(False).alias("asked")).unionByName(asked.select("lang", "gram", F.lit(0).cast("long").alias("c"), F.lit(True).alias("asked")))
    counts = {order: saved(both.groupBy("lang", "gram").agg(F.sum("c").alias("c"), F.max("asked").alias("asked")), f"counts{order}")}
    for k in range(order - 1, 0, -1):
        shorter = counts[k + 1].groupBy("lang", F.col("gram").bitwiseAND(mask(k)).alias("gram"))
        counts[k] = saved(shorter.agg(F.count(F.when(F.col("c") > 0, 1)).alias("c")), f"counts{k}")
    below = None
    by_context = Window.partitionBy("lang", "context")
    for k in range(1, order + 1):
        c = F.col("c")
        d = F.when(c == 0, 0.0).when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        of = broadcast_up_to(saved(_discounts(counts[k]), f"discounts{k}"), MOST_LANGUAGES)
        t = counts[k].join(of, "lang").withColumn("context", F.shiftright("gram", 8)).withColumn("d", d)
        t = t.withColumn("total", F.sum("c").over(by_context)).withColumn("spare", F.sum("d").over(by_context))
        seen = F.col("total") > 0
        share, backoff = F.when(seen, (c - F.col("d")) / F.col("total")).otherwise(0.0), F.when(seen, F.col("spare") / F.col("total")).otherwise(1.0)
        if below is None:
            below = t.select("lang", "gram", (share + backoff / 256).alias("p"))
        else:
            lower = below.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("q"))
            t = t.withColumn("shorter", F.col("gram").bitwiseAND(mask(k - 1))).join(lower, ["lang", "shorter"])
            below = t.select("lang", "gram", (share + backoff * F.col("q")).alias("p"), *(["asked"] if k == order else []))
    if order == 1:
        below = below.join(counts[1].select("lang", "gram", "asked"), ["lang", "gram"])
    return below.filter("asked").select("lang", "gram", F.log("p").alias("logp"))


def _lang_key(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode() + b"\n", np.uint8)
    return textkit.Hasher(raw)(np.array([0]), np.array([len(raw)]))[0]


def entry_keys(langs: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Hashes, as they are ordered by Spark, of n-grams of the languages whose keys are given."""
    return textkit.mix(textkit.mix(grams + langs) ^ np.uint64(0xA0761D6478BD642F)).view(np.int64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        of = np.array([_lang_key(x) for x in lang.dictionary.to_pylist()], np.uint64)
        keys = entry_keys(of[lang.indices.to_numpy()], batch.column(1).to_numpy().view(np.uint64)) if batch.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(2).cast(pa.float32())], ["key", "logp"])


def shards(answers: DataFrame, n: int, shard: int = SHARD) -> DataFrame:
    """answers (lang, gram, logp), of which there are n, as a table of key and logp in files of about shard entries, sorted and apart by key."""
    keyed = answers.mapInArrow(_keyed, "key bigint, logp float")
    return saved(keyed.repartitionByRange(max(1, -(-n // shard)), "key").sortWithinPartitions("key"), "shards")


_held: OrderedDict[str, tuple[np.ndarray, np.ndarray]] = OrderedDict()


def _shard(uri: str, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys and log probabilities of a shard; a worker process keeps those last used."""
    if uri not in _held:
        system, path = fs.FileSystem.from_uri(uri)
        rows = pq.read_table(path, filesystem=system)
        _held[uri] = tuple(rows.column(c).to_numpy() for c in ("key", "logp"))
        while len(_held) > kept:
            _held.popitem(last=False)
    _held.move_to_end(uri)
    return _held[uri]


def _looked_up(keys: np.ndarray, files: list[tuple[str, int, int]], kept: int) -> np.ndarray:
    """The log probabilities of sorted keys; files (uri, least key, largest key)."""
    out = np.full(len(keys), -np.log(256))
    for uri, least, largest in files:
        low, high = np.searchsorted(keys, least), np.searchsorted(keys, largest, side="right")
        if high > low:
            known, logp = _shard(uri, kept)
            at = np.minimum(np.searchsorted(known, keys[low:high]), len(known) - 1)
            out[low:high] = np.where(known[at] == keys[low:high], logp[at], out[low:high])
    return out


def _scored(files: list[tuple[str, int, int]], order: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "lang", *[c.split()[0] for c in STATS.split(", ")], "logp"]
        for batch in batches:
            for chunk in textkit.chunks(batch.column(1), 2 * textkit.CHUNK):
                rows = slice(chunk.first, chunk.first + chunk.n)
                lang = batch.column(2)[rows].dictionary_encode()
                of = np.array([_lang_key(x) for x in lang.dictionary.to_pylist()], np.uint64)[lang.indices.to_numpy()]
                doc, code = gram_codes(chunk, order)
                keys = entry_keys(of[doc], code)
                by = np.argsort(keys)
                keys = keys[by]
                new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else by
                logp = np.repeat(_looked_up(keys[new], files, kept), np.diff(np.append(new, len(keys))))
                # in the order of keys, so that a text's sum does not depend on the texts beside it
                total = np.bincount(doc[by], weights=logp, minlength=chunk.n).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(2)[rows], *map(pa.array, stats(chunk)), pa.array(total)], names)

    return run


def score(docs: DataFrame, table: DataFrame, order: int = ORDER, kept: int = KEPT) -> DataFrame:
    """doc_id, lang, the STATS and logp, the natural log of the text's probability by the table of shards, for every row of docs; an n-gram it lacks is uniform."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    ranges = table.groupBy(F.input_file_name().alias("file")).agg(F.min("key").alias("least"), F.max("key").alias("largest"))
    files = sorted(map(tuple, ranges.collect()), key=lambda r: r[1])  # one row for each SHARD entries
    return own.mapInArrow(_scored(files, order, kept), f"doc_id bigint, lang string, {STATS}, logp double")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with the language of the model that they are counted for, and with that of the one that scores them."""
    half = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2))
    named = lambda n: docs.select("doc_id", "text", F.concat_ws(":", n.cast("string"), F.coalesce("lang", F.lit(""))).alias("lang"))
    return named(half), named(1 - half)


def judge(docs: DataFrame, order: int = ORDER, width: float = WIDTH, shard: int = SHARD, kept: int = KEPT) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, entropy (nats a byte), low and high (its band), and the same for each word."""
    counted, asked = _halves(docs)
    with passing(docs.sparkSession) as keep:
        grams = saved(count_grams(counted, order), "grams")
        # a half asks the other's model for its own n-grams
        other = F.concat_ws(":", (1 - F.substring_index("lang", ":", 1).cast("int")).cast("string"), F.substring("lang", 3, 1 << 30))
        table = shards(kneser_ney(grams, grams.select(other.alias("lang"), "gram"), order), grams.count(), shard)
        scored = keep(saved(score(asked, table, order, kept), "scored"))
    each = lambda n: F.when(F.col(n) > 0, -F.col("logp") / F.col(n))
    scored = scored.withColumn("entropy", each("n_bytes")).withColumn("word_entropy", each("n_words"))
    quartiles = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)), 10_000)
    bands = scored.groupBy("lang").agg(quartiles("entropy").alias("q"), quartiles("word_entropy").alias("word_q"), F.count("word_entropy").alias("n"))
    scatter = F.sqrt(1 + SHORT / F.greatest("n_bytes", F.lit(1)))
    judged = scored.join(bands, "lang")
    wide = width + UNSURE / F.sqrt(F.greatest("n", F.lit(1)))
    for q, prefix in (("q", ""), ("word_q", "word_")):
        spread = F.greatest(F.col(q)[1] - F.col(q)[0], F.lit(0.01)) * scatter
        judged = judged.withColumn(f"{prefix}low", F.col(q)[0] - wide * spread).withColumn(f"{prefix}high", F.col(q)[1] + wide * spread)
    failed = base_failed()
    inside = F.col("entropy").between(F.col("low"), F.col("high")) & F.col("word_entropy").between(F.col("word_low"), F.col("word_high"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.coalesce(inside, F.lit(False))).alias("kept"), "entropy", "low", "high", "word_entropy", "word_low", "word_high",
    )
