"""Quality rules: word, symbol and repetition counts, then perplexity bands of a modified Kneser-Ney n-gram model.

The model's symbols are the bytes of the text. Its n-grams are counted over all documents in Spark: each task sorts
its n-grams and sends each different one once, and Spark sums them. (Word n-grams were tried first: nearly every word
pair of such text is new, so their counts outgrow the text itself.) Discounts, interpolated probabilities and back-off
weights follow Chen and Goodman; they are kept in arrays sorted by the n-grams' hashes.

The order is the same at every size. Above ``most`` n-grams the model is cut into parts by the two bytes before the
last one: an n-gram, its suffixes of three bytes and more, and their contexts share these, so each part is exact on its
own once the counts of counts and the byte pairs (65,536 at most) are summed over all. Parts are gathered, built and
broadcast in turn, each scores the bytes that are its own, and a text's sums are added up. A part exceeds ``most`` only
if one pair of bytes does by itself (2^24 n-grams at most). N-grams of the highest order seen fewer than ``least``
times count in the discounts but are scored by back-off, so a document's own rare strings don't vouch for it.

A document's perplexity is that of its bytes. The log perplexity of n bytes varies about its language's median as
1 / sqrt(n), so deviations from the median are multiplied by sqrt(n) before their quartiles are taken, for each
language over the different texts that pass the base rules. These give Tukey's fences at every length: rejected are
documents more than ``above`` inter-quartile ranges over the third quartile or ``below`` under the first. ``below`` is
wider since texts that have copies vouch for each other: they lie low, and are left to the near-duplicate stage. Each
fence is moved out by ``few`` / sqrt(texts) ranges, four standard errors of a fence, as quartiles of few documents
are uncertain; a range counts as ``floor`` at least, so that a language of copies alone has a band. A run uses no labels; ``below`` was chosen on those of sf0.1.

Null text has no words and fails the base rules. A null language is a language of its own. Repeated rows each get
their verdict and each count in the model. A very long text is one text like any other: it is scored in one piece.
Perplexities that tie with a fence are kept. An empty table gives no rows. Extra columns are ignored by ``judge`` and
kept by ``keep``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifline.llm.common import SPACE, Scratch, fresh, mix64, slices, word_hashes, words

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
WINDOW = 5
GRAMS = "gram long, n long"
SCORES = "doc_id long, lang string, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, log_prob double"


def grams(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """For each byte the n-gram that it ends, as an integer; bytes before a text's first count as 0."""
    out = data.astype(np.uint64)
    if not len(data):
        return out
    first = np.repeat(starts[:-1], np.diff(starts))
    place = np.arange(len(data)) - first
    for k in range(1, order):
        back = np.zeros(len(data), np.uint64)
        back[k:] = data[:-k]
        back[place < k] = 0
        out |= back << np.uint64(8 * k)
    return out


def _summed(keys: np.ndarray, counts: np.ndarray):
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def count(docs: DataFrame, order: int) -> DataFrame:
    """(gram, n) over all texts; tasks send each different n-gram of theirs once."""

    def tally(batches):
        held, size = [], 0
        for batch in batches:
            for _, data, starts in slices(batch):
                held.append(np.unique(grams(data, starts, order), return_counts=True))
                size += len(held[-1][0])
                if size > 3_000_000:
                    held = [_summed(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    if size > 2_000_000:
                        yield _batch(*held[0])
                        held, size = [], 0
        if held:
            yield _batch(*_summed(*map(np.concatenate, zip(*held))))

    def _batch(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tally, GRAMS).groupBy("gram").agg(F.sum("n").alias("n"))


class Hashed:
    """Values by key in arrays sorted by the keys' hashes. The hashes' top bits index the array, so a probe reads a few neighbours."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        hashes = mix64(keys)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], [v[order].astype(np.float32) for v in values]
        self.bits = max(1, int(len(keys)).bit_length())
        self.index = np.searchsorted(self.hashes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.index).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.hashes):
            return out
        hashes = mix64(keys)
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        here, end = self.index[at].astype(np.int64), self.index[at + 1]
        left = np.arange(len(keys))
        for _ in range(self.longest):
            ok = here < end
            left, here, end, hashes = left[ok], here[ok], end[ok], hashes[ok]
            if not len(left):
                break
            hit = self.hashes[here] == hashes
            out[left[hit]] = here[hit]
            miss = ~hit
            left, here, end, hashes = left[miss], here[miss] + 1, end[miss], hashes[miss]
        return out


def _levels(keys: np.ndarray, n: np.ndarray, order: int, lowest: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted n-grams and counts of each order; below the highest, how many different symbols go before."""
    by = np.argsort(keys)
    levels = {order: (keys[by].astype(np.uint64), n[by].astype(np.int64))}
    for k in range(order - 1, lowest - 1, -1):
        above = levels[k + 1][0]
        levels[k] = _summed(above & np.uint64((1 << 8 * k) - 1), np.ones(len(above), np.int64))
    return levels


def _tally(n: np.ndarray) -> np.ndarray:
    """How many n-grams are counted 1, 2, 3 and 4 times."""
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5]


class Whole:
    """What the parts of a model share: counts of counts by order, and the byte pairs with how many symbols go before."""

    def __init__(self, order: int):
        self.order, self.tallies = order, {k: np.zeros(4, np.int64) for k in range(3, order + 1)}
        self.pairs = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        levels = _levels(keys, n, self.order, 2)
        for k in self.tallies:
            self.tallies[k] += _tally(levels[k][1])
        self.pairs = _summed(*map(np.concatenate, zip(self.pairs, levels[2])))


class Model:
    """Interpolated modified Kneser-Ney over bytes, from the counts of the highest order's n-grams (keys as ``grams`` makes them)."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int, least: int = 1, whole: Whole | None = None, span: tuple[int, int] = (0, 1 << 16)):
        self.order, self.span = order, span
        levels = _levels(keys, n, order, 1 if whole is None else 3)
        if whole is not None:
            levels[2] = whole.pairs
            levels[1] = _summed(whole.pairs[0] & np.uint64(255), np.ones(len(whole.pairs[0]), np.int64))
        self.tables: dict[int, Hashed] = {}
        self.backs: dict[int, Hashed] = {}
        lower_keys, lower = None, None
        for k in range(1, order + 1):
            keys, n = levels[k]
            d = self._discounts(_tally(n) if whole is None or k < 3 else whole.tallies[k])
            context = keys >> np.uint64(8)
            # a level's n-grams are sorted by context: the last symbol is lowest
            new = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.zeros(0, np.int64)
            group = np.cumsum(np.r_[True, context[1:] != context[:-1]]) - 1 if len(keys) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, new) if len(new) else n
            taken = d[np.minimum(n, 3)]
            back = np.add.reduceat(taken, new) / total if len(new) else np.zeros(0)
            own = (n - taken) / total[group] if len(new) else np.zeros(0)
            if k == 1:
                prob = own + back[group] / 256 if len(new) else own
            else:
                below = lower[np.searchsorted(lower_keys, keys & np.uint64((1 << 8 * (k - 1)) - 1))]
                prob = own + back[group] * below
            lower_keys, lower = keys, prob
            stored = n >= least if k == order else np.ones(len(n), bool)
            self.tables[k] = Hashed(keys[stored], np.log(prob[stored]))
            self.backs[k] = Hashed(context[new], np.log(np.maximum(back, 1e-12)))

    @staticmethod
    def _discounts(tally: np.ndarray) -> np.ndarray:
        n1, n2, n3, n4 = tally.tolist()
        if not (n1 and n2 and n3):  # too few n-grams to tell
            return np.array([0, 0.5, 0.75, 0.9])
        y = n1 / (n1 + 2 * n2)
        return np.clip(np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]), 0.01, [0.01, 0.99, 1.99, 2.99])

    def own_log_probs(self, keys: np.ndarray) -> np.ndarray:
        """``log_probs`` of the n-grams of this part, 0 for others."""
        if self.span == (0, 1 << 16):
            return self.log_probs(keys)
        pair = _pair(keys)
        own = np.flatnonzero((pair >= self.span[0]) & (pair < self.span[1]))
        out = np.zeros(len(keys))
        out[own] = self.log_probs(keys[own])
        return out

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """Natural logs of each last symbol's probability after the symbols before it."""
        out, left, back = np.zeros(len(keys)), np.arange(len(keys)), np.zeros(len(keys))
        for k in range(self.order, 0, -1):
            own = keys[left] & np.uint64((1 << 8 * k) - 1)
            at = self.tables[k].find(own)
            hit = at >= 0
            out[left[hit]] = back[left[hit]] + self.tables[k].values[0][at[hit]]
            left, own = left[~hit], own[~hit]
            if not len(left):
                return out
            at = self.backs[k].find(own >> np.uint64(8))
            back[left[at >= 0]] += self.backs[k].values[0][at[at >= 0]]
        out[left] = back[left] - np.log(256)
        return out


def _pair(keys: np.ndarray) -> np.ndarray:
    """The two bytes before the last one."""
    return (keys >> np.uint64(8)) & np.uint64(0xFFFF)


def parts(docs: DataFrame, order: int = 5, least: int = 2, most: int = 4_000_000, scratch: Scratch | None = None):
    """Yields the model of all texts in parts of about ``most`` n-grams, each of which is gathered when it is asked for."""
    counted = (scratch or Scratch(docs.sparkSession, "grams")).put(count(docs, order), f"grams{order}")
    pair = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(0xFFFF).cast("long"))
    sizes = np.zeros(1 << 16, np.int64)
    for r in counted.groupBy(pair.alias("pair")).count().collect():
        sizes[r["pair"]] = r["count"]
    cuts, size = [0], 0
    for k in np.flatnonzero(sizes).tolist():
        if size and size + sizes[k] > most and order > 2:
            cuts.append(k)
            size = 0
        size += int(sizes[k])
    spans = list(zip(cuts, [*cuts[1:], 1 << 16]))

    def gathered(span):
        got = counted.where((pair >= span[0]) & (pair < span[1])).toArrow()
        return got["gram"].to_numpy().astype(np.uint64), got["n"].to_numpy()

    if len(spans) == 1:
        yield Model(*gathered(spans[0]), order, least)
        return
    whole = Whole(order)
    for span in spans:
        whole.add(*gathered(span))
    for span in spans:
        yield Model(*gathered(span), order, least, whole, span)


def train(docs: DataFrame, order: int = 5, least: int = 2) -> Model:
    """A model of all texts in one piece, for small corpora (``judge`` scores by ``parts``)."""
    got = Scratch(docs.sparkSession, "grams").put(count(docs, order), f"grams{order}").toArrow()
    return Model(got["gram"].to_numpy().astype(np.uint64), got["n"].to_numpy(), order, least)


def base(data: np.ndarray, starts: np.ndarray):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    begin, end, n_words = words(data, starts)
    n = len(starts) - 1

    def per_text(x: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(x, dtype=np.int64)]
        return sums[starts[1:]] - sums[starts[:-1]]

    chars = per_text(((data & 0xC0) != 0x80) & ~SPACE[data])
    symbols = per_text(SYMBOLS[data])
    raw, dup = data.tobytes(), np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        lines = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        dup[i] = len(lines) - len(set(lines))
    # five-word windows: equal if their words are
    word = word_hashes(data, begin, end)[:, 0]
    doc = np.repeat(np.arange(n), n_words)
    repeat = np.zeros(n, np.int64)
    if len(begin) >= WINDOW:
        m = len(begin) - WINDOW + 1
        h = doc[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(WINDOW):
            h = mix64(h + word[k : k + m])
        inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
        order = inside[np.argsort(h[inside], kind="stable")]
        same = h[order][1:] == h[order][:-1]
        again = order[np.r_[False, same] | np.r_[same, False]]
        edge = np.zeros(len(begin) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + WINDOW, -1)
        repeat = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)
    return n_words, chars, symbols, dup, repeat


def key_of() -> Column:
    """Tells rows with one id apart."""
    return F.xxhash64(F.col("text").cast("string"), F.col("lang").cast("string"))


def score(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """The base counts and the log probability of each text; of the bytes of the model's part, if it is one."""

    def rows(batches):
        for batch in batches:
            for own, data, starts in slices(batch):
                m = shared.value
                logs = np.r_[0.0, np.cumsum(m.own_log_probs(grams(data, starts, m.order)))]
                columns = [*base(data, starts), np.diff(starts), logs[starts[1:]] - logs[starts[:-1]]]
                names = [f.split()[0] for f in SCORES.split(", ")]
                kinds = [pa.int64()] * 6 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), *(pa.array(np.asarray(c), t) for c, t in zip(columns, kinds))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), key_of().alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(rows, SCORES)


def score_by_parts(docs: DataFrame, models, scratch: Scratch) -> DataFrame:
    """``score`` with the parts of a model in turn, their log probabilities added up. Repeated rows stay repeated."""
    done = []
    for k, model in enumerate(models):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        done.append(scratch.put(score(docs, shared), f"scores{k}"))
        shared.destroy()
    if len(done) == 1:
        return done[0]
    same = [f.split()[0] for f in SCORES.split(", ")][:-1]
    every = None
    for k, one in enumerate(done):
        one = one.withColumn("_first", F.lit(int(k == 0)))
        every = one if every is None else every.unionByName(one)
    out = every.groupBy(*same).agg(F.sum("log_prob").alias("log_prob"), F.sum("_first").alias("_rows"))
    out = out.withColumn("log_prob", F.col("log_prob") / F.col("_rows")).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")))
    return scratch.put(out.select(*same, "log_prob"), "scores")


def _quartiles(rows: DataFrame, value: Column, step: float, **shares: float) -> DataFrame:
    """For each language the documents (_docs) and exact quantiles of ``value`` rounded to ``step``, from a histogram."""
    bins = rows.groupBy("lang", F.round(value / step).cast("long").alias("_bin")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("lang").orderBy("_bin")
    share = bins.withColumn("_share", F.sum("_n").over(upto) / F.sum("_n").over(Window.partitionBy("lang")))
    at = [(F.min(F.when(F.col("_share") >= q, F.col("_bin"))) * step).alias(name) for name, q in shares.items()]
    return share.groupBy("lang").agg(F.sum("_n").alias("_docs"), *at).withColumnRenamed("lang", "_lang")


def judge(spark: SparkSession, docs: DataFrame, order: int = 5, least: int = 2, most: int = 4_000_000, above: float = 1.5, below: float = 3.0, few: float = 10.0, floor: float = 0.5) -> DataFrame:
    """docs (doc_id, text, lang) to counts, base_failed, perplexity, its language's band at its length and kept."""
    scratch = Scratch(spark, "quality")
    scored = score_by_parts(docs, parts(docs, order, least, most, scratch), scratch)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn("_bits", F.when(F.col("n_bytes") > 0, -F.col("log_prob") / F.col("n_bytes")))
    passed, same = scored.where(~F.col("base_failed")).dropDuplicates(["lang", "key"]), F.col("lang").eqNullSafe(F.col("_lang"))
    middle = scratch.put(_quartiles(passed, F.col("_bits"), 0.001, _middle=0.5).drop("_docs"), "middle")
    apart, step = (F.col("_bits") - F.col("_middle")) * F.sqrt("n_bytes"), 0.01
    bands = _quartiles(passed.join(middle, same).drop("_lang"), apart, step, _q1=0.25, _q3=0.75)
    spread, unsure = F.greatest(F.col("_q3") - F.col("_q1"), F.lit(floor)), F.lit(few) / F.sqrt("_docs")
    bands = bands.select("_lang", (F.col("_q1") - step - spread * (unsure + below)).alias("_low"), (F.col("_q3") + step + spread * (unsure + above)).alias("_high"))
    bands = scratch.put(bands.join(middle.withColumnRenamed("_lang", "_of"), F.col("_lang").eqNullSafe(F.col("_of"))).drop("_of"), "bands")
    out = scored.join(bands, same, "left")
    at = lambda side: F.col("_middle") + F.col(side) / F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1)))
    out = out.withColumn("_low", at("_low")).withColumn("_high", at("_high"))
    inside = F.coalesce((F.col("_bits") >= F.col("_low")) & (F.col("_bits") <= F.col("_high")), F.lit(True))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"),
        "key", "lang", F.exp("_bits").alias("perplexity"), F.exp("_low").alias("band_low"), F.exp("_high").alias("band_high"),
    )


def keep(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    id_, key = fresh(docs, "_id", "_key")
    good = judge(spark, docs.select("doc_id", "text", "lang"), **options).where("kept").select(F.col("doc_id").alias(id_), F.col("key").alias(key))
    return docs.join(good, docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (key_of() == F.col(key)), "left_semi")
