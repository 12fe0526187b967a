"""Phrase collocations of every language, by exact counts of word n-grams.

ASCII letters are lower-cased; texts are split at `.,;:!?` and line ends into pieces and those at blanks into words. A phrase is
a run of words inside a piece. What is rarer than `least` can be no part of a candidate, so the work shrinks by levels:

1. Words are counted by language. Frequent ones (f >= least) get dense 32-bit ids, the most frequent the smallest: the
   first KNOWN are sent with the tasks, the others (the tail, none of them hot) are joined by word.
2. Texts become packed arrays of ids, written once; 0 stands for the end of a piece and for every other word, so both break phrases.
3. For each length, runs of ids are packed into fixed-width binary keys, radix sorted and run-length counted inside the
   task, so that a hot phrase leaves a task once in RUN occurrences; the counted keys are range partitioned by the
   place that the dictionary's cumulative frequencies give to their first two words, sorted and run-length counted
   again. From length 3 on, only runs enter whose parts of one word less pass a bitmap of the frequent ones. The
   bitmap's size is bounded: when it fills up, more runs are counted and results stay the same.
4. Frequent phrases join the counts of their parts; the lowest-scoring cut counts. Ranks are taken inside salted
   groups of a language before those of the language.

Bounds, as documented parameters: KNOWN words of at most KNOWN_BYTES bytes (longer ones get the last ids), BITS bits of bitmap, CHUNK bytes of text
and RUN keys at once in a task.

Defined results: null texts have no words; null languages count as `und`, together with documents of that language;
repeated rows count again; empty tables give no phrases; extra columns are ignored, whatever their names; texts and
words of any length are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volatide.llm.common import cut, shared_folder

KNOWN, KNOWN_BYTES = 1 << 16, 64
BITS, BITS_A_KEY = 1 << 26, 16
CHUNK, RUN = 4 << 20, 1 << 20
#: Occurrences that one range holds, and the most ranges; beyond, sorting spills.
RANGE, MOST_RANGES = 1 << 22, 100_000
SALTS = 32

#: In decimals of up to 38 digits; the quotient is at most a million.
SCORE = "cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Words, the row of each, and whether it begins a row or piece; in chunks, between words, of about CHUNK bytes."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    at, fresh = 0, True
    while at < len(data):
        to = min(len(data), at + CHUNK)
        while to < len(data) and _KIND[data[to]] == 0:
            step = np.flatnonzero(_KIND[data[to : to + CHUNK]])
            to = to + int(step[0]) if len(step) else min(len(data), to + CHUNK)
        part, kind = data[at:to], _KIND[data[at:to]]
        first = np.zeros(len(part), bool)
        first[(ends[:-1] - at)[(ends[:-1] >= at) & (ends[:-1] < to)]] = True
        word = kind == 0
        begins = word & (first | ~np.concatenate([[False], word[:-1]]))
        starts = np.flatnonzero(begins)
        breaks = np.cumsum((kind == 2) | first, dtype=np.int32)
        if len(starts):
            lengths = np.add.reduceat(word, starts, dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[part[word]]))
            before = np.concatenate([[0 if not fresh else -1], breaks[starts[:-1]]])
            yield words, np.searchsorted(ends[1:], starts + at, side="right"), breaks[starts] != before
            fresh = breaks[-1] != breaks[starts[-1]]
        else:
            fresh = fresh or bool(breaks[-1])
        at = to


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f) of (lang, text); a null word has the number of all."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        of_row, names = langs.indices.to_numpy(), langs.dictionary
        for words, rows, _ in tokens(batch.column(1)):
            coded = words.dictionary_encode()
            size = len(coded.dictionary)
            pairs, n = np.unique(of_row[rows].astype(np.int64) * size + coded.indices.to_numpy(), return_counts=True)
            totals = np.bincount(of_row[rows], minlength=len(names))
            there = np.flatnonzero(totals)
            lang = np.concatenate([pairs // size, there])
            found = pa.concat_arrays([coded.dictionary.cast(pa.string()).take(pa.array(pairs % size)), pa.nulls(len(there), pa.string())])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang)), found, pa.array(np.concatenate([n, totals[there]]))], ["lang", "word", "f"])


class Dictionary:
    """The known words by language, each with its id, and how frequencies add up over ids. Bounded by KNOWN rows."""

    def __init__(self, table: pa.Table, n: int, total: int):
        self.words: dict[str, pa.Array] = {}
        self.ids: dict[str, np.ndarray] = {}
        lang, word, f = (table.column(c).combine_chunks() for c in ("lang", "word", "f"))
        coded = lang.dictionary_encode()
        order = coded.indices.to_numpy()
        for i, name in enumerate(coded.dictionary.to_pylist()):
            at = np.flatnonzero(order == i)
            self.words[name], self.ids[name] = word.take(pa.array(at)).cast(pa.large_string()), (at + 1).astype(np.uint32)
        self.size, self.tail = len(table), n - len(table)
        f = np.asarray(f.to_numpy(), np.float64)
        self.upto, self.tail_share = np.concatenate([[0.0, 0.0], np.cumsum(f)]) / max(1, total), (total - f.sum()) / max(1, total)

    def place(self, ids: np.ndarray) -> np.ndarray:
        """The share of occurrences of words with smaller ids; increases with the id."""
        known = self.upto[np.minimum(ids, self.size + 1)]
        return known + np.clip(ids.astype(np.float64) - self.size - 1, 0, None) / max(1, self.tail) * self.tail_share

    def range_of(self, keys: np.ndarray, ranges: int) -> np.ndarray:
        low, high = self.place(keys[:, 0]), self.place(keys[:, 0].astype(np.int64) + 1)
        return np.minimum(ranges - 1, (low + (high - low) * self.place(keys[:, 1])) * ranges).astype(np.int32)


def _packed(ids: np.ndarray) -> bytes:
    """Ids by zstd, behind their number of bytes."""
    return len(ids).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(np.ascontiguousarray(ids).view(np.uint8), asbytes=True)


def _unpacked(raw: pa.Buffer) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(raw[8:], 4 * n), np.uint32)


def _encoded(dictionary: Dictionary):
    """(uid, ids, rest) of (uid, lang, text): ids end with 0; rest holds the places of words that aren't known."""

    def run(batches):
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            of_row, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            parts: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            length, rest = np.zeros(batch.num_rows, np.int64), []
            for words, rows, begins in tokens(batch.column(2)):
                coded = words.dictionary_encode()
                codes, table = coded.indices.to_numpy(), np.zeros((len(names), len(coded.dictionary)), np.uint32)
                for i, name in enumerate(names):
                    if name in dictionary.words:
                        found = pc.index_in(coded.dictionary, value_set=dictionary.words[name])
                        table[i, found.is_valid().to_numpy(zero_copy_only=False)] = dictionary.ids[name][found.drop_null().to_numpy()]
                ids = table[of_row[rows], codes]
                places = np.arange(len(ids)) + np.cumsum(begins)
                out = np.zeros(int(places[-1]) + 1, np.uint32)
                out[places] = ids
                starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                bounds = np.concatenate([places[starts] - begins[starts], [len(out)]])
                if dictionary.tail:
                    away = np.flatnonzero(ids == 0)
                    owner = np.searchsorted(starts, away, side="right") - 1
                    rest.append((rows[away], places[away] - bounds[owner] + length[rows[away]], words.take(pa.array(away)).cast(pa.string())))
                for k, row in enumerate(rows[starts].tolist()):
                    parts[row].append(out[bounds[k] : bounds[k + 1]])
                    length[row] += bounds[k + 1] - bounds[k]
            packed = pa.array([_packed(np.concatenate([*p, np.zeros(1, np.uint32)])) for p in parts], pa.binary())
            rows = np.concatenate([r[0] for r in rest]) if rest else np.zeros(0, np.int64)
            order = np.argsort(rows, kind="stable")
            word = pa.concat_arrays([r[2] for r in rest]).take(pa.array(order)) if rest else pa.array([], pa.string())
            at = (np.concatenate([r[1] for r in rest]) if rest else rows)[order].astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(at), word], ["at", "word"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, listed], ["uid", "lang", "ids", "rest"])

    return run


def _patched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids with those of the tail's words put in their places."""
    for batch in batches:
        out = []
        for raw, found in zip(batch.column(0), batch.column(1), strict=True):
            if found.is_valid:
                ids = _unpacked(raw.as_buffer()).copy()
                ids[found.values.field(0).to_numpy()] = found.values.field(1).to_numpy()
                out.append(_packed(ids))
            else:
                out.append(raw.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of unsigned 32-bit numbers, by 16 bits at a time from the last."""
    order = np.arange(len(keys))
    for column in range(keys.shape[1] - 1, -1, -1):
        for shift in (0, 16):
            digit = (keys[:, column] >> shift).astype(np.uint16)
            if digit.any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of unsigned 32-bit numbers, in order, and how often each occurs."""
    keys = keys[radix_order(keys)]
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.concatenate([starts, [len(keys)]]))


def _binary(keys: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(keys.astype(">u4"))
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * (4 * keys.shape[1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _positions(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = np.zeros(len(keys), np.uint64)
    for column in range(keys.shape[1]):
        h = (h ^ keys[:, column]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return [(h >> np.uint64(s)) & np.uint64(bits - 1) for s in (0, 27)]


def _bitmap(frequent: DataFrame, n: int) -> np.ndarray:
    """Bits that hold all keys, and others more often the fuller they are; at most BITS."""
    bits = 1 << max(16, min(BITS.bit_length() - 1, (BITS_A_KEY * frequent.count()).bit_length()))

    def words(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u4").reshape(-1, n).astype(np.uint32)
            places = np.unique(np.concatenate(_positions(keys, bits)))
            starts = np.flatnonzero(np.concatenate([[True], np.diff(places >> np.uint64(6)) > 0])) if len(places) else np.zeros(0, np.int64)
            if len(starts):
                values = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), starts)
                yield pa.RecordBatch.from_arrays([pa.array((places[starts] >> np.uint64(6)).astype(np.int64)), pa.array(values.view(np.int64))], ["word", "bits"])

    found = frequent.select("key").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _passes(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    good = np.ones(len(keys), bool)
    for places in _positions(keys, len(bitmap) * 64):
        good &= (bitmap[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) == 1
    return good


def _grams(ids: np.ndarray, n: int, bitmap: np.ndarray | None) -> np.ndarray:
    """All runs of n ids without 0 whose parts of n - 1 pass the bitmap."""
    if len(ids) < n:
        return np.zeros((0, n), np.uint32)
    there = ids != 0
    whole = there[: len(ids) - n + 1].copy()
    for i in range(1, n):
        whole &= there[i : len(ids) - n + 1 + i]
    at = np.flatnonzero(whole)
    keys = ids[at[:, None] + np.arange(n)]
    if bitmap is not None and len(keys):
        keys = keys[_passes(keys[:, :-1], bitmap)]
        keys = keys[_passes(keys[:, 1:], bitmap)]
    return keys


def _counted_grams(dictionary: Dictionary, n: int, ranges: int, bitmap: np.ndarray | None):
    def packed(parts):
        keys, counts = run_lengths(np.concatenate(parts))
        for at in range(0, len(keys), 1 << 16):
            k = keys[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(dictionary.range_of(k, ranges)), _binary(k), pa.array(counts[at : at + (1 << 16)].astype(np.int64))], ["range", "key", "a"])

    def run(batches):
        rows, there, parts, held = [], 0, [], 0
        for raw in chain((raw for batch in batches for raw in batch.column(0)), [None]):
            if raw is not None:
                rows.append(_unpacked(raw.as_buffer()))
                there += len(rows[-1])
            if rows and (there >= RUN or raw is None):
                ids = np.concatenate(rows)
                rows, there = [], 0
                for at in range(0, len(ids), RUN):
                    parts.append(_grams(ids[at : at + RUN + n - 1], n, bitmap))
                    held += len(parts[-1])
                    if held >= RUN:
                        yield from packed(parts)
                        parts, held = [], 0
        if held:
            yield from packed(parts)

    return run


def _summed_runs(n: int, least: int):
    """(key, a) of sorted (key, a): equal keys, which follow one another, as one, if they reach `least`."""

    def run(batches):
        last, sum_last = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 4 * n)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            keys, sums = keys[starts], np.add.reduceat(batch.column(1).to_numpy(), starts)
            if last is not None and (keys[0] == last).all():
                sums[0] += sum_last
            elif last is not None:
                keys, sums = np.vstack([last[None], keys]), np.concatenate([[sum_last], sums])
            last, sum_last = keys[-1], int(sums[-1])
            good = sums[:-1] >= least
            yield pa.RecordBatch.from_arrays([_binary(keys[:-1][good].copy().view(">u4").astype(np.uint32).reshape(-1, n)), pa.array(sums[:-1][good])], ["key", "a"])
        if last is not None and sum_last >= least:
            yield pa.RecordBatch.from_arrays([pa.array([last.tobytes()], pa.binary()), pa.array([sum_last])], ["key", "a"])

    return run


def _numbered(words: DataFrame) -> tuple[Dictionary, DataFrame]:
    """The dictionary of the known words, and all frequent words as (id, lang, word, f), by falling f."""
    order = [F.octet_length("word") > KNOWN_BYTES, F.desc("f"), "lang", "word"]
    rows = cut(words.orderBy(*order).select(F.monotonically_increasing_id().alias("row"), "lang", "word", "f"))
    # Rows are numbered inside their partitions; the partitions' sizes make that dense.
    sizes = sorted(rows.groupBy(F.shiftright("row", 33).alias("p")).agg(F.count("*").alias("n"), F.sum("f").alias("f")).collect())
    firsts = list(zip((p["p"] for p in sizes), accumulate((p["n"] for p in sizes), initial=1)))
    n, total = sum(p["n"] for p in sizes), sum(p["f"] for p in sizes)
    if n >= 2**32 - 1:
        raise ValueError("more frequent words than 32-bit ids")
    numbers = F.broadcast(words.sparkSession.createDataFrame(firsts, "p long, first long"))  # a row a partition
    listed = rows.join(numbers, F.shiftright("row", 33) == F.col("p")).select((F.col("first") + F.col("row").bitwiseAND(2**33 - 1)).alias("id"), "lang", "word", "f")
    known = listed.where((F.col("id") <= KNOWN) & (F.octet_length("word") <= KNOWN_BYTES)).toArrow().sort_by("id")
    return Dictionary(known, n, total), listed


def frequent_phrases(docs: DataFrame, longest: int, least: int, lang: str, text: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Words (id, lang, word, f), word occurrences (lang, n), and (key, a) of the frequent phrases of 2, 3, ... words."""
    spark, folder = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/collocations-{uuid.uuid4().hex}"

    def delete(*part: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path("/".join([folder, *part]))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    docs = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    counted = docs.mapInArrow(_counted_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counted = cut(counted.where(F.col("word").isNull() | (F.col("f") >= least)))
    totals = counted.where("word is null").select("lang", F.col("f").alias("n"))
    dictionary, words = _numbered(counted.where("word is not null"))
    encoded = docs.select(F.monotonically_increasing_id().alias("uid"), "lang", "text").mapInArrow(_encoded(dictionary), "uid long, lang string, ids binary, rest array<struct<at int, word string>>")
    encoded.write.parquet(f"{folder}/known")
    ids = spark.read.parquet(f"{folder}/known")
    if dictionary.tail:
        rest = ids.select("uid", "lang", F.explode("rest").alias("r")).select("uid", "lang", "r.at", "r.word").join(words.where(F.col("id") > dictionary.size).select("lang", "word", "id"), ["lang", "word"])
        found = rest.groupBy("uid").agg(F.collect_list(F.struct("at", "id")).alias("found"))
        ids.select("uid", "ids").join(found, "uid", "left").select("ids", "found").mapInArrow(_patched, "ids binary").write.parquet(f"{folder}/all")
        ids = spark.read.parquet(f"{folder}/all")
        delete("known")
    occurrences = totals.agg(F.sum("n")).first()[0] or 0
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), occurrences // RANGE))
    levels, bitmap = [], None
    for n in range(2, longest + 1):
        grams = ids.select("ids").mapInArrow(_counted_grams(dictionary, n, ranges, bitmap), "range int, key binary, a long")
        level = grams.repartitionById(ranges, F.col("range")).select("key", "a").sortWithinPartitions("key").mapInArrow(_summed_runs(n, least), "key binary, a long")
        levels.append(cut(level))
        bitmap = _bitmap(levels[-1], n) if n < longest else None
    delete()
    return words, totals, levels


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """Each language's `top` phrases of 2 to `longest` words with a >= least, by score, then a, then phrase.

    Columns: lang, rank, phrase, a (occurrences), l and r (of the parts at the lowest-scoring cut, the first of equal
    ones), n (all words of the language), score = floor(1000000 * a * a / (l * r)). A phrase whose words lie inside
    a longer one with at least `inside` per cent of its occurrences is left out. Counts stay below 10^15.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words and one occurrence at least")
    words, totals, levels = frequent_phrases(docs, longest, least, lang, text)
    part = lambda key, at, n: F.substring(key, at * 4 + 1, n * 4)
    phrases, counts, longer = None, words.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), "f"), []
    for n, level in enumerate(levels, 2):
        one = level.withColumn("size", F.lit(n))
        phrases = one if phrases is None else phrases.union(one)
        counts = counts.union(level)
        longer += [level.select(part("key", at, m).alias("key"), "a") for m in range(2, n) for at in range(n - m + 1)]
    cuts = phrases.select("key", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring(key, 1, 4 * k)"), "right": F.expr("substring(key, 4 * k + 1)")})
    cuts = cuts.join(counts.toDF("left", "l"), "left").join(counts.toDF("right", "r"), "right")
    cuts = cuts.withColumn("score", F.expr(SCORE))
    best = cuts.groupBy("key", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    if longer:
        covers = longer[0]
        for one in longer[1:]:
            covers = covers.union(one)
        over = covers.groupBy("key").agg(F.max("a").alias("over"))
        best = best.join(over, "key", "left").where(F.col("over").isNull() | (F.lit(100) * F.col("over") < F.lit(inside) * F.col("a")))
    at = F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("at")
    named = best.select("key", "a", "cut", at).withColumn("id", F.conv(F.hex(F.expr("substring(key, 4 * at + 1, 4)")), 16, 10).cast("long"))
    named = named.join(words.select("id", "lang", "word"), "id").groupBy("key", "a", "cut").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("said"))
    named = named.select("lang", F.array_join("said.word", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    firsts = named.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
