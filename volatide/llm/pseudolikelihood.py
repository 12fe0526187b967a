"""Scoring documents by masked pseudo-likelihood of a bidirectional window network.

Every token is predicted from the tokens on both sides of it, never from itself; a document's score is the sum of
its tokens' conditional log-probabilities. Tokens are words (ASCII letters lower-cased), known by 64-bit hashes.

Words are counted exactly over the whole corpus, in a distributed table that grows with it. Codes are made from it:
the FREQUENT most frequent words have a code each; words that are less frequent, up to KNOWN words, share BANDS codes
with words of like rank; all rarer words (the tail) share one code. A code has a class and a place in it, and

    log p(word | both sides) = log p(class | both sides) + log p(place | class, both sides) + log p(word | code)

The first two terms are a network trained in numpy: embeddings of the SIDE codes on each side, one tanh layer, a
softmax over CLASSES classes, and one over the PLACES places of the class, both over the hidden layer. The third is 0
for frequent words and otherwise the word's share of its code in the exact counts. KNOWN counts are sent with the
tasks (a bounded table); the counts of the tail are joined from the distributed table by hash. No word of the tail is
hot, since KNOWN others are more frequent.

Beside its probability a document gets the number of its novel tokens: those whose word occurs in no other document of
the corpus (by the exact counts), which tells what the corpus holds once from what it holds again elsewhere.

Training: texts are cut into pieces of at most PIECE positions, which keep the codes beside them, so that every position
sees both of its sides. A start is fitted in one task to START_PIECES pieces. All pieces are then dealt by a hash of id,
codes and place into shards of about SHARD_POSITIONS positions, a task each; every shard goes on from the start over all
its positions, in an order of its own, and the shards' weights are averaged by their numbers of positions, on the
executors. So the model depends on the rows alone, not on how they are partitioned (but for rounding), and neither many
nor long texts make a task larger.

Defined results: null and empty texts have no tokens and log-probability 0; the mean of no tokens is 0; a document's
score depends on its text and the corpus, and repeated texts get the very same one; words that the counts lack (in
texts outside the corpus) count as half an occurrence; an empty table gives an empty table; extra columns are ignored;
texts of any length are scored whole, in stretches of STRETCH tokens, however many texts these are of.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volatide.llm.common import cut, slices

CLASSES, PLACES = 64, 64
CODES = CLASSES * PLACES
BANDS = 63
FREQUENT = CODES - BANDS - 1
TAIL = FREQUENT  # the code of the rarest words; the bands follow
KNOWN = 1 << 18
SIDE = 2
EMBED, HIDDEN = 12, 24
PIECE = 1 << 14
START_PIECES, SHARD_POSITIONS = 512, 1 << 20
BATCH, BLOCK = 4096, 8192
TOGETHER = 1 << 18  # positions that are held and put in random order at once
SCORED_ROWS, STRETCH = 256, 1 << 18
TEXTS, WORDS_CACHED = 256, 300_000
PAD = CODES  # beyond either end of a text
PARTS = 32


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of words of each text, all their words as places among the distinct ones, and the hashes of these."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found, sizes = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
    filled = pc.greater(pc.binary_length(found), 0).to_numpy(zero_copy_only=False)  # there are empty ones at a text's ends
    if not filled.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[filled], minlength=len(sizes))
        found = found.filter(pa.array(filled))
    numbered = found.dictionary_encode()
    distinct = numbered.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    return sizes, numbered.indices.to_numpy(), np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))


def words(text: str | None) -> list[bytes]:
    """What `tokens` finds, plainly and of one text."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(h, n): the count of every word of the corpus, by hash."""

    def summed(held):
        h, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        return h[first], np.add.reduceat(n[order], first) if len(h) else n

    def given(h, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    def run(batches):
        held, many = [], 0
        for batch in slices(batches, TEXTS):
            _, found, hashes = tokens(batch.column(0))
            held.append((hashes, np.bincount(found, minlength=len(hashes))))
            many += len(hashes)
            if many > 2 * WORDS_CACHED:
                held = [summed(held)]
                many = len(held[0][0])
                if many > WORDS_CACHED:
                    yield given(*held[0])
                    held, many = [], 0
        if held:
            yield given(*summed(held))

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Codes and log shares of the known words: those with at least `least` occurrences, sorted by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int):
        rank = np.lexsort((hashes, -counts))
        code = np.empty(len(hashes), np.uint16)
        code[rank[:FREQUENT]] = np.arange(min(FREQUENT, len(hashes)))
        rest = rank[FREQUENT:]
        # Bands hold words of like rank, with about equal counts in all.
        mass = np.cumsum(counts[rest])
        code[rest] = TAIL + 1 + np.minimum((mass - counts[rest]) * BANDS // max(1, int(mass[-1]) if len(mass) else 1), BANDS - 1)
        totals = np.bincount(code, counts, minlength=CODES)
        order = np.argsort(hashes)
        self.hashes, self.codes = hashes[order], code[order]
        self.shares = np.log(counts / totals[code])[order]
        self.counts = counts[order]
        self.tail = total - int(counts.sum())

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, log shares and counts of words; of words of the tail TAIL, 0 and 0."""
        if not len(self.hashes):
            return np.full(len(hashes), TAIL, np.uint16), np.zeros(len(hashes)), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return np.where(known, self.codes[at], np.uint16(TAIL)), np.where(known, self.shares[at], 0.0), np.where(known, self.counts[at], 0)

    @classmethod
    def of(cls, table: DataFrame) -> Vocabulary:
        """At most KNOWN words of a table of counts: all from the least count at which they aren't more."""
        # Counts in bins whose edges are exact below 1024 and 64 an octave above: a bounded number of them.
        step = F.pow(F.lit(2.0), F.floor(F.log2("n")) - 6)
        low = F.when(F.col("n") < 1024, F.col("n").cast("double")).otherwise(F.floor(F.col("n") / step) * step)
        bins = table.groupBy(low.alias("low")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).toArrow()
        edge, many, n = (bins.column(c).to_numpy() for c in ("low", "words", "n"))
        order = np.argsort(-edge)
        fits = np.cumsum(many[order]) <= KNOWN
        least = float(edge[order][fits].min()) if fits.any() else float("inf")
        got = table.where(F.col("n") >= least).toArrow()
        return cls(got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy(), int(n.sum()))


def coded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, print, n, codes, share, novel, tail): 16-bit codes, novel tokens of known words, the tail's words with their numbers."""

    def run(batches):
        for batch in slices(batches, TEXTS):
            sizes, found, hashes = tokens(batch.column(1))
            code, share, count = vocabulary.known(hashes)
            texts, many = len(sizes), max(1, len(hashes))
            codes, ends = code[found], np.append(0, np.cumsum(sizes)).tolist()
            # The distinct words of each text, and how often it has them.
            own, k = np.unique(np.repeat(np.arange(texts) * many, sizes) + found, return_counts=True)
            owner, word = own // many, own % many
            rare = code[word] == TAIL
            rows = pa.array(np.append(0, np.cumsum(np.bincount(owner[rare], minlength=texts))), pa.int32())
            tail = pa.StructArray.from_arrays([pa.array(hashes[word[rare]].view(np.int64)), pa.array(k[rare])], ["h", "k"])
            novel = np.bincount(owner, np.where(count[word] == k, k, 0), minlength=texts).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(sizes), pa.array([codes[a:b].tobytes() for a, b in pairwise(ends)], pa.binary()),
                    pa.array(np.bincount(owner, share[word] * k, minlength=texts)), pa.array(novel), pa.ListArray.from_arrays(rows, tail),
                ],
                ["doc_id", "print", "n", "codes", "share", "novel", "tail"],
            )

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("print"))
    return text.mapInArrow(run, "doc_id long, print string, n long, codes binary, share double, novel long, tail array<struct<h:long,k:long>>")


#: Codes beside it, positions, codes: a piece trains the positions from `skip` on, `many` of them.
Piece = tuple[int, int, np.ndarray]


class Network:
    def __init__(self, weights: list[np.ndarray] | None = None, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = weights or [
            rng.normal(0, 0.3, (CODES + 1, EMBED)).astype(np.float32),
            rng.normal(0, (2 * SIDE * EMBED) ** -0.5, (2 * SIDE * EMBED, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            np.zeros((HIDDEN, CLASSES), np.float32),
            np.zeros(CLASSES, np.float32),
            np.zeros((CLASSES, HIDDEN, PLACES), np.float32),
            np.zeros((CLASSES, PLACES), np.float32),
        ]

    @staticmethod
    def windows(codes: np.ndarray) -> np.ndarray:
        """(positions, 2 * SIDE) codes on both sides."""
        ends = np.full(SIDE, PAD, np.uint16)
        padded = np.concatenate([ends, codes.astype(np.uint16), ends])
        return np.stack([padded[SIDE + o : SIDE + o + len(codes)] for o in range(-SIDE, SIDE + 1) if o], 1)

    def forward(self, around: np.ndarray, target: np.ndarray):
        """Inputs, hidden layer, logits of the classes; order by class, bounds of the classes in it, logits of the places in that order."""
        embed, w1, b1, w2, b2, w3, b3 = self.w
        x = embed.take(around.ravel(), axis=0).reshape(len(around), -1)
        h = x @ w1
        h += b1
        np.tanh(h, out=h)
        z = h @ w2
        z += b2
        klass = target >> 6
        order = np.argsort(klass.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(klass, minlength=CLASSES)).tolist()
        hs, y, a = h.take(order, axis=0), np.empty((len(target), PLACES), np.float32), 0
        for c, b in enumerate(ends):
            if b > a:
                np.matmul(hs[a:b], w3[c], out=y[a:b])
                y[a:b] += b3[c]
                a = b
        return x, h, z, order, ends, hs, y

    @staticmethod
    def _own(z: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of one column of each row; z is used up."""
        own, total = Network._powers(z, at)
        return own - np.log(total)

    @staticmethod
    def _powers(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One logit of each row and the sum of the row's powers, which take the logits' place; shifted so that none overflows or vanishes."""
        top = z.max()
        z -= top if top - z.min() < 60 else z.max(1, keepdims=True)
        own = z[np.arange(len(z)), at]
        np.exp(z, out=z)
        return own, z @ np.ones(z.shape[1], z.dtype)

    def log_probability(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each code, given those around it."""
        out = np.empty(len(target))
        for at in range(0, len(target), BLOCK):
            t = target[at : at + BLOCK].astype(np.int64)
            _, _, z, order, _, _, y = self.forward(around[at : at + BLOCK], t)
            part = self._own(z, t >> 6).astype(float)
            part[order] += self._own(y, t[order] & 63)
            out[at : at + BLOCK] = part
        return out

    def step(self, around: np.ndarray, target: np.ndarray, memory: list[np.ndarray], rate: float) -> None:
        """One AdaGrad step on a batch."""
        embed, w1, _, w2, _, w3, b3 = self.w
        t = target.astype(np.int64)
        x, h, z, order, ends, hs, y = self.forward(around, t)
        for logits, at in ((z, t >> 6), (y, t[order] & 63)):
            _, total = self._powers(logits, at)
            logits /= (total * logits.dtype.type(len(t)))[:, None]
            logits[np.arange(len(t)), at] -= np.float32(1 / len(t))
        dh, back, g3, gb3, a, ones = z @ w2.T, np.empty_like(hs), np.zeros_like(w3), np.zeros_like(b3), 0, np.ones(len(t), y.dtype)
        for c, b in enumerate(ends):
            if b > a:
                np.matmul(y[a:b], w3[c].T, out=back[a:b])
                np.matmul(hs[a:b].T, y[a:b], out=g3[c])
                np.matmul(ones[a:b], y[a:b], out=gb3[c])
                a = b
        dh[order] += back
        dh *= 1 - h * h
        dx = (dh @ w1.T).reshape(-1, EMBED)
        flat, de = around.ravel(), np.zeros_like(embed)
        by_code = np.argsort(flat, kind="stable")
        ordered = flat[by_code]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        de[ordered[starts]] = np.add.reduceat(dx.take(by_code, axis=0), starts, axis=0)
        for w, m, g in zip(self.w, memory, (de, x.T @ dh, dh.sum(0), h.T @ z, z.sum(0), g3, gb3), strict=True):
            m += g * g
            w -= rate * g / (np.sqrt(m) + 1e-6)

    def train(self, pieces: list[Piece], memory: list[np.ndarray], rate: float, rng: np.random.Generator) -> int:
        """All positions of these pieces once, in batches in random order; gives their number."""
        if not (n := sum(many for _, many, _ in pieces)):
            return 0
        around = np.concatenate([self.windows(codes)[skip : skip + many] for skip, many, codes in pieces])
        target = np.concatenate([codes[skip : skip + many] for skip, many, codes in pieces])
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            mine = order[at : at + BATCH]
            self.step(around.take(mine, axis=0), target.take(mine), memory, rate)
        return n

    def memory(self, value: float) -> list[np.ndarray]:
        return [np.full_like(w, value) for w in self.w]


def pieces(rows: DataFrame) -> DataFrame:
    """(h, skip, many, codes): the pieces of coded documents with up to SIDE codes on either side, and a hash to deal them by."""
    at = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE).cast("int"))

    def piece(i):
        skip = F.when(i == 0, 0).otherwise(SIDE)
        many = F.least(F.lit(PIECE), F.col("n") - i.cast("long") * PIECE)
        codes = F.substring("codes", 1 + 2 * (i * PIECE - skip), 2 * (skip + PIECE + SIDE))
        return F.struct(i.alias("i"), skip.alias("skip"), many.cast("int").alias("many"), codes.alias("codes"))

    found = rows.where("n > 0").select(F.xxhash64("doc_id", "codes").alias("d"), F.inline(F.transform(at, piece)))
    return found.select(F.xxhash64("d", "i").alias("h"), "skip", "many", "codes")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Piece]]:
    """Pieces of about TOGETHER positions at once, however the batches are cut."""
    held, n = [], 0
    for batch in batches:
        for skip, many, codes in zip(*(batch.column(c).to_pylist() for c in ("skip", "many", "codes")), strict=True):
            held.append((skip, many, np.frombuffer(codes, np.uint16)))
            n += many
            if n >= TOGETHER:
                yield held
                held, n = [], 0
    if held:
        yield held


def _weighed(parts: DataFrame) -> Network:
    """The average network from rows (i, part) of summed weights times positions; `positions` is how many were seen."""

    def run(batches):
        now, total = None, np.zeros(0)
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "part"])
                    now, total = i, np.zeros(len(part) // 8)
                total = total + np.frombuffer(part)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "part"])

    rows = parts.repartition("i").sortWithinPartitions("i").mapInArrow(run, "i int, part binary").collect()  # PARTS rows, one network in all
    network = Network()
    network.positions = 0
    if rows:
        flat = np.concatenate([np.frombuffer(r["part"]) for r in sorted(rows, key=lambda r: r["i"])])
        network.positions = int(flat[-1])
        flat, at = np.round(flat[:-1] / max(1.0, flat[-1]), 6), 0
        for i, w in enumerate(network.w):
            network.w[i] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
    return network


def _parts(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in np.array_split(total, PARTS)], pa.binary())], ["i", "part"])


def _flat(network: Network, seen: int) -> np.ndarray:
    return np.append(np.concatenate([w.ravel() for w in network.w]).astype(float) * seen, float(seen))


def start(cuts: DataFrame, total: int) -> Network:
    """A network fitted to a bounded sample of pieces (whole texts, but for those longer than PIECE), for weights that the shards can be averaged from."""
    h = F.pmod(F.xxhash64("h", F.lit("start")), F.lit(2**32))
    # A hash threshold leaves a few times as many before they are ordered, however many partitions there are.
    some = cuts.where(h < int(4 * START_PIECES / total * 2**32)) if total > 4 * START_PIECES else cuts
    some = some.select("skip", "many", "codes", h.alias("h")).orderBy("h", "codes").limit(START_PIECES).coalesce(1)

    def run(batches):
        if groups := list(_together(batches)):
            network, rng = Network(), np.random.default_rng(1)
            memory = network.memory(1e-6)
            seen = [sum(network.train(g, memory, 0.2, rng) for g in groups) for _ in range(2)][0]
            yield _parts(_flat(network, seen))

    return _weighed(some.select("skip", "many", "codes").mapInArrow(run, "i int, part binary"))


def fit(rows: DataFrame) -> Network:
    """From coded documents."""
    whole = F.floor((F.col("n") + PIECE - 1) / PIECE)
    total, positions = rows.agg(F.coalesce(F.sum(whole), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return Network()
    cuts = pieces(rows)
    first = start(cuts, total).w
    shards = -(-positions // SHARD_POSITIONS)
    # A shard is a partition: by number, since hashes of the numbers would put several into one.
    dealt = cuts.repartitionById(shards, F.pmod("h", F.lit(shards)).cast("int")).sortWithinPartitions("h", "codes")

    def run(batches):
        network, rng = Network([w.copy() for w in first]), np.random.default_rng(1)
        memory = network.memory(1e-6)
        seen = sum(network.train(group, memory, 0.1, rng) for group in _together(batches))
        if seen:
            yield _parts(_flat(network, seen))

    return _weighed(dealt.select("skip", "many", "codes").mapInArrow(run, "i int, part binary"))


def _scored(rows: DataFrame, network: Network) -> DataFrame:
    """(print, n, total, novel, tail) of coded documents: all terms but those of the tail's words."""

    def run(batches):
        ends, sides = np.full(SIDE, PAD, np.uint16), np.array([o for o in range(-SIDE, SIDE + 1) if o])
        for batch in slices(batches, SCORED_ROWS):
            codes = [np.frombuffer(c, np.uint16) for c in batch.column(1).to_pylist()]
            sizes = np.array([len(c) for c in codes], np.int64)
            total, bounds = batch.column(2).to_numpy().copy(), np.cumsum(sizes)
            flat = np.concatenate([ends, *(part for c in codes for part in (c, ends))])
            for a in range(0, int(sizes.sum()), STRETCH):
                at = np.arange(a, min(a + STRETCH, bounds[-1]))
                owner = np.searchsorted(bounds, at, side="right")
                at += SIDE * (owner + 1)
                total += np.bincount(owner, network.log_probability(flat[at[:, None] + sides], flat[at]), minlength=len(codes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(total), batch.column(3), batch.column(4)], ["print", "n", "total", "novel", "tail"])

    return rows.select("print", "codes", "share", "novel", "tail").mapInArrow(run, "print string, n long, total double, novel long, tail array<struct<h:long,k:long>>")


class Model:
    """Exact counts (distributed), the codes made from them, and the network; with the corpus' coded rows if they are to be scored."""

    def __init__(self, docs: DataFrame):
        self.counts = cut(corpus_counts(docs))
        self.vocabulary = Vocabulary.of(self.counts)
        self.rows = cut(coded(docs, self.vocabulary))
        self.network = fit(self.rows)


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_probability, mean_log_probability, novel_tokens, novel_share) of every row.

    By a model of the whole table unless one is given. The last two are of tokens that occur in no other document.
    """
    used = model or Model(docs)
    rows = used.rows if model is None else cut(coded(docs, used.vocabulary))
    # A text once, so that equal texts have equal scores.
    texts = _scored(rows, used.network).groupBy("print")
    texts = cut(texts.agg(F.min("total").alias("total"), F.any_value("n").alias("n"), F.any_value("novel").alias("novel"), F.any_value("tail").alias("tail")))
    spelled = texts.select("print", F.inline("tail")).join(used.counts.withColumnRenamed("n", "c"), "h", "left")
    share = F.col("k") * F.log(F.coalesce("c", F.lit(0.5)) / F.lit(float(max(1, used.vocabulary.tail))))
    rare = spelled.groupBy("print").agg(F.sum(share).alias("shares"), F.sum(F.when(F.coalesce("c", "k") == F.col("k"), F.col("k")).otherwise(0)).alias("novel_rare"))
    done = texts.select("print", "total", "n", "novel").join(rare, "print", "left")
    done = done.select("print", "n", (F.col("total") + F.coalesce("shares", F.lit(0.0))).alias("log_probability"), (F.col("novel") + F.coalesce("novel_rare", F.lit(0))).alias("novel"))
    per_token = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0))
    out = rows.select("doc_id", "print").join(done, "print")
    return out.select("doc_id", F.col("n").alias("n_tokens"), "log_probability", per_token("log_probability").alias("mean_log_probability"), F.col("novel").alias("novel_tokens"), per_token("novel").alias("novel_share"))
