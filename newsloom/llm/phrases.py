"""Phrase collocation mining after Toivonen.

Texts are read once into a table of word ids, and all words are counted. A
sample of the documents, level by level, proposes the phrases that are frequent
in it at a lowered floor. One pass over everything then counts the proposals
together with their negative border: every occurring phrase whose first and
last part of one word less are both proposed, or frequent words. A border
phrase that turns out frequent is a failure: it joins the proposals, and a
further pass counts what its addition brings into the border, until no pass
finds a failure. All counts are exact whatever the sample holds; it only
decides how many passes are needed.

The proposals reach the tasks as Bloom filters of bounded size. A false
positive makes a task count a phrase more than needed and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, drop_stored, stored

LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: 0: in a word, 1: between words, 2: between pieces.
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
SLICE = 2_000_000  # bytes of text, or word ids, that a task handles at once
ROW = 32_768  # word ids in a row, or more where one piece has more
BLOCKS = 256
COUNTED = "k tinyint, p long, w long, c long"


@dataclass(frozen=True)
class Settings:
    """``floor`` occurrences make a phrase frequent; the sample holds one in ``one_in`` documents.

    Its floor is the expected count minus ``slack`` standard deviations. A
    filter takes 16 bits a proposal, at most 2**``filter_bits`` bits.
    """

    floor: int = 30
    most_words: int = 4
    one_in: int = 4
    slack: float = 1.5
    inside: int = 80
    top: int = 2000
    filter_bits: int = 28

    @property
    def sample_floor(self) -> int:
        expected = self.floor / self.one_in
        return max(2, int(expected - self.slack * expected**0.5))


def mix(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit ids of phrases from the id of all words but the last, and the last word's."""
    z = p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def _tables(salt: int) -> tuple[np.ndarray, np.uint64]:
    rng = np.random.default_rng(salt)
    return rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(int(rng.integers(1, 2**62)) * 2 + 1)


def _slices(buffer: bytes) -> Iterator[np.ndarray]:
    """Parts of the buffer that begin with a separator (but for the first) and hold whole words."""
    data, at = np.frombuffer(buffer, np.uint8), 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            back = np.flatnonzero(KIND[data[at + 1 : end]])
            if len(back):
                end = at + 1 + back[-1]
            else:  # one word is longer than a slice
                while end < len(data) and not KIND[data[end]]:
                    end += 1
        yield data[at:end]
        at = end


def _encoded(data: np.ndarray, lang: np.int64, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word ids, where each word starts and ends, and whether a new piece starts before it."""
    byte_hash, base = _tables(salt)
    kind = KIND[data]
    edge = np.diff((kind == 0).astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.int64), start, end, np.full(0, False)
    size = end - start
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size.max() - 1, base)]), dtype=np.uint64)
    sums = np.add.reduceat(byte_hash[data[kind == 0]] * power[place], np.cumsum(size) - size)
    ids = mix(np.full(len(sums), lang), sums + size.astype(np.uint64))
    ids[ids == 0] = 1
    pieces = np.cumsum(kind == 2)[start]
    return ids, start, end, np.diff(pieces, prepend=0) > 0


def encode(docs: DataFrame, lang: str, text: str, salt: int) -> DataFrame:
    """Rows of two kinds from ``docs`` (``lang``, ``text``, sampled): (sampled, ids), where each piece follows a 0, and (sampled, id, lang, word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: dict[tuple[str, bool], list[bytes]] = {}
            for l, t, s in zip(b["lang"].to_pylist(), b["text"].to_pylist(), b["sampled"].to_pylist()):
                if t:
                    texts.setdefault((l, s), []).append(t.encode().translate(LOWER))
            for (l, s), own in texts.items():
                name, rows = np.int64(pd.util.hash_array(np.array([l], object)).view(np.int64)[0]), [np.zeros(1, np.int64)]
                for data in _slices(b"\n".join(own)):
                    ids, start, end, new = _encoded(data, name, salt)
                    if len(ids):
                        rows.append(np.insert(ids, np.flatnonzero(new), 0))
                        one, first, n = np.unique(ids, return_index=True, return_counts=True)
                        raw = data.tobytes()
                        words = [raw[start[i] : end[i]].decode() for i in first]
                        yield _rows(s, None, one, l, words, n)
                if len(rows) > 1:
                    yield _rows(s, np.concatenate(rows), None, l, None, None)

    source = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"), "sampled")
    return source.mapInArrow(run, "sampled boolean, ids array<long>, id long, lang string, word string, n long")


def _rows(sampled: bool, ids, one, lang: str, words, n) -> pa.RecordBatch:
    if ids is not None:
        zeros = np.flatnonzero(ids == 0)
        cuts = zeros[np.unique(np.searchsorted(zeros, np.arange(0, len(ids), ROW)).clip(max=len(zeros) - 1))]
        lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(ids)), pa.int32()), pa.array(ids))
        size = len(lists)
        empty = [pa.nulls(size, x) for x in (pa.int64(), pa.string(), pa.string(), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([sampled] * size), lists, *empty], ["sampled", "ids", "id", "lang", "word", "n"])
    size = len(one)
    return pa.RecordBatch.from_arrays(
        [pa.array([sampled] * size), pa.nulls(size, pa.list_(pa.int64())), pa.array(one), pa.array([lang] * size), pa.array(words), pa.array(n, pa.int64())],
        ["sampled", "ids", "id", "lang", "word", "n"],
    )


@dataclass(frozen=True)
class Bloom:
    """A set of ids in blocks of bits; has() is true for all members and few others."""

    blocks: np.ndarray | None  # (BLOCKS, bytes), None: nothing is in it

    def has(self, ids: np.ndarray) -> np.ndarray:
        if self.blocks is None:
            return np.zeros(len(ids), bool)
        x = ids.view(np.uint64)
        block, bits = (x >> np.uint64(56)).astype(np.int64), self.blocks.shape[1] * 8
        found = np.ones(len(ids), bool)
        for shift in (0, 28):
            at = ((x >> np.uint64(shift)) % np.uint64(bits)).astype(np.int64)
            found &= (self.blocks[block, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def bloom(ids: DataFrame, settings: Settings) -> Bloom:
    """The filter of the column ``id``; each block of bits is built in a task of its own, at most 2**filter_bits bits come to the driver."""
    size = ids.count()
    if not size:
        return Bloom(None)
    width = max(64, min(2**settings.filter_bits, 1 << (16 * size - 1).bit_length()) // BLOCKS // 8)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        x, bits = part["id"].to_numpy().view(np.uint64), np.zeros(width * 8, np.uint8)
        for shift in (0, 28):
            bits[((x >> np.uint64(shift)) % np.uint64(width * 8)).astype(np.int64)] = 1
        return pd.DataFrame({"block": [int(part["block"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    blocks = np.zeros((BLOCKS, width), np.uint8)
    parted = ids.select("id", F.shiftrightunsigned("id", 56).cast("int").alias("block"))
    for row in parted.groupBy("block").applyInPandas(build, "block int, bits binary").collect():  # BLOCKS rows of bounded size
        blocks[row.block] = np.frombuffer(row.bits, np.uint8)
    return Bloom(blocks)


def counted(rows: DataFrame, proposed: list[Bloom], levels: range, fresh: list[Bloom] | None = None) -> DataFrame:
    """(k, p, w, c): exact counts in ``rows`` (ids) of the phrases of ``levels`` words whose two parts are ``proposed``.

    With ``fresh``, only those with a part in it. p is the id of the phrase without its last word w.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((proposed, fresh))  # filters of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, new = sent.value
        for b in batches:
            ids, ends = b["ids"].flatten().to_numpy(), b["ids"].offsets.to_numpy()
            at, ends = 0, (ends - ends[0])[1:]
            while at < len(ids):  # whole rows
                end = ends[max(np.searchsorted(ends, at + SLICE // 2, "right") - 1, np.searchsorted(ends, at, "right"))]
                yield from _phrases(ids[at:end], filters, levels, new)
                at = end

    emitted = rows.select("ids").mapInArrow(run, COUNTED)
    return emitted.groupBy("k", "p", "w").agg(F.sum("c").alias("c"))


def _members(which: Bloom, ids: np.ndarray, where: np.ndarray) -> np.ndarray:
    out = where.copy()
    out[where] = which.has(ids[where])
    return out


def _phrases(words: np.ndarray, filters: list[Bloom], levels: range, new: list[Bloom] | None) -> Iterator[pa.RecordBatch]:
    part, good = words, _members(filters[0], words, words != 0)
    for k in range(2, levels.stop):
        both = good[:-1] & good[1:]
        last = words[k - 1 :]
        whole = np.zeros(len(both), np.int64)
        whole[both] = mix(part[:-1][both], last[both])
        if k in levels:
            wanted = both
            if new is not None:
                fresh = _members(new[k - 2], part, good)
                wanted = both & (fresh[:-1] | fresh[1:])
            at = np.flatnonzero(wanted)
            _, first, n = np.unique(whole[at], return_index=True, return_counts=True)
            if len(first):
                at = at[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int8)), pa.array(part[at]), pa.array(last[at]), pa.array(n, pa.int64())], ["k", "p", "w", "c"])
        if k + 1 < levels.stop:
            part, good = whole, _members(filters[k - 1], whole, both)


def _with_id(frame: DataFrame) -> DataFrame:
    """Adds ``id``, the phrase's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = mix(b["p"].to_numpy(), b["w"].to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], ["k", "p", "w", "c", "id"])

    return frame.mapInArrow(run, f"{COUNTED}, id long")


def frequent(rows: DataFrame, words: DataFrame, settings: Settings) -> DataFrame:
    """(k, id, p, w, c): all phrases of 2 to ``most_words`` words that are frequent, with exact counts.

    ``rows`` has (sampled, ids), ``words`` has (id, f).
    """
    top = settings.most_words
    known = [stored(words.filter(F.col("f") >= settings.floor).select("id"))]
    filters = [bloom(known[0], settings)]
    for k in range(2, top):  # proposals of the sample
        found = counted(rows.filter("sampled"), filters, range(k, k + 1)).filter(F.col("c") >= settings.sample_floor)
        known.append(stored(_with_id(found).select("id")))
        filters.append(bloom(known[-1], settings))
    total, fresh = None, None
    while True:
        found = stored(_with_id(counted(rows, filters, range(2, top + 1), fresh).filter(F.col("c") >= settings.floor)))
        if total is None:
            total = found
        else:  # a phrase that was counted again has the same count again
            both = stored(total.unionByName(found).groupBy("k", "id", "p", "w").agg(F.max("c").alias("c")).select("k", "p", "w", "c", "id"))
            drop_stored(total, found)
            total = both
        failed = [stored(total.filter(F.col("k") == k).select("id").join(known[k - 1], "id", "left_anti")) for k in range(2, top)]
        fresh = [Bloom(None), *[bloom(x, settings) for x in failed]]  # all frequent words are known
        if all(x.blocks is None for x in fresh):
            drop_stored(*failed, *known)
            return total
        wider = [stored(s.unionByName(x)) for s, x in zip(known[1:], failed)]
        drop_stored(*failed, *known[1:])
        known[1:] = wider
        filters[1:] = [bloom(x, settings) for x in wider]


def _spelled(found: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """(ws array of word ids, f) of all frequent words and phrases: each phrase is its first part, which is frequent too, and a word."""
    level = words.select("id", F.array("id").alias("ws"), F.col("f"))
    out = level.select("ws", "f")
    for k in range(2, most + 1):
        own = found.filter(F.col("k") == k)
        level = own.join(level.select(F.col("id").alias("p"), "ws"), "p").select("id", F.concat("ws", F.array("w")).alias("ws"), F.col("c").alias("f"))
        out = out.unionByName(level.select("ws", "f"))
    return out


def _number(value, kind: str = "decimal(38,0)"):
    return value.cast(kind)


def scored(phrases: DataFrame, settings: Settings) -> DataFrame:
    """(ws, a, l, r, score): candidates by their lowest-scoring cut, without those that a longer candidate covers."""
    candidates = phrases.filter(F.size("ws") > 1)
    size = F.size("ws")
    cuts = candidates.select("ws", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.select("ws", "a", "cut", F.slice("ws", F.lit(1), F.col("cut")).alias("left"), F.slice("ws", F.col("cut") + 1, size - F.col("cut")).alias("right"))
    cuts = cuts.join(phrases.select(F.col("ws").alias("left"), F.col("f").alias("l")), "left").join(phrases.select(F.col("ws").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.select("ws", "a", "cut", "l", "r", _number(2_000_000 * _number(F.col("a"), "decimal(28,0)"), "decimal(38,0)").alias("x"), (_number(F.col("l"), "decimal(28,0)") + F.col("r")).cast("decimal(38,0)").alias("y"))
    lowest = cuts.withColumn("score", F.expr("x div y")).groupBy("ws", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.slice("ws", at, n))))
    covers = candidates.filter(size > 2).select(F.col("f").alias("longer"), F.explode(F.array_distinct(spans)).alias("ws")).groupBy("ws").agg(F.max("longer").alias("longer"))
    covered = F.coalesce(100 * _number(F.col("longer"), "decimal(28,0)") >= settings.inside * _number(F.col("a"), "decimal(28,0)"), F.lit(False))
    return lowest.join(covers, "ws", "left").filter(~covered).select("ws", "a", "m.l", "m.r", "m.score")


def mine(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of each language.

    Texts, A-Z in lower case, are split at ``.,;:!?`` and line ends into pieces
    and those at blanks and tabs into words. ``a`` counts a phrase's
    occurrences, ``l`` and ``r`` those of its parts at the lowest-scoring cut
    (of equal ones the first), ``n`` the words of the language; ``score`` is
    floor(2000000 a / (l + r)). Phrases inside a longer one that has
    ``inside`` percent of their occurrences or more are left out.

    Null and empty texts have no words, a null language is ``und``; texts of any
    length are taken whole. Repeated rows count as often as they stand. Ties
    in score go by falling ``a``, then by the phrase's bytes. Other columns are
    ignored. An empty table gives no rows. Words are told apart by 64-bit
    hashes; where two words of the corpus share one, other hashes are taken.
    """
    sampled = F.pmod(F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`")), F.lit(settings.one_in)) == 0
    source = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), sampled.alias("sampled"))
    for salt in range(1, 9):
        table = stored(encode(source, "lang", "text", salt), **{"parquet.dictionary.page.size": 8 << 20})
        words = stored(table.filter("id IS NOT NULL").groupBy("id", "lang", "word").agg(F.sum("n").alias("f")))
        if not words.groupBy("id").count().filter("count > 1").limit(1).count():
            break
        drop_stored(table, words)
    else:
        raise RuntimeError("words share ids under every salt")
    found = frequent(table.filter("ids IS NOT NULL").select("sampled", "ids"), words, settings)
    drop_stored(table)
    vocabulary = words.filter(F.col("f") >= settings.floor)
    phrases = stored(_spelled(found, vocabulary, settings.most_words))
    drop_stored(found)
    langs = vocabulary.select(F.col("id").alias("first"), "lang")
    best = stored(scored(phrases, settings).withColumn("first", F.get("ws", 0)).join(langs, "first").drop("first"))
    # the place of the last row in reach, so that only rows that can be listed are spelled out
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    least = best.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= settings.top).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("least"))
    reach = best.join(least, "lang").filter(F.struct("score", "a") >= F.col("least")).drop("least")
    spelled = (
        reach.select("lang", "ws", "a", "l", "r", "score", F.posexplode("ws").alias("at", "id"))
        .join(vocabulary.select("id", "word"), "id")
        .groupBy("lang", "ws", "a", "l", "r", "score")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    final = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(final).cast("long")).filter(F.col("rank") <= settings.top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
