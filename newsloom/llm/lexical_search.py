"""Ranked lexical search for many items at once, with shared parts evaluated once.

The term sets of the items are mined for common parts: terms that stand in
exactly the same items form one class, and classes that are neighbours in the
order of popularity in two items or more are joined, again and again, into the
inner nodes of a sharing DAG. For a chunk of documents the partial
accumulators of all classes are filled once from the documents' postings,
those of the inner nodes follow level by level from their two parts, and an
item's scores are the sum of its few top nodes.

Items are taken in blocks whose size is a parameter, each against all documents.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, drop_stored, stored

#: Terms are runs of digits, letters and everything beyond ASCII; in UTF-8 all bytes of the latter are over 0x7F.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


@dataclass(frozen=True)
class Settings:
    """``top`` documents an item; a block holds at most ``block_terms`` terms of items, a task ``cells`` accumulator cells."""

    top: int = 10
    block_terms: int = 200_000
    cells: int = 4_000_000


@dataclass(frozen=True)
class Sharing:
    """Which class a term belongs to, the two parts of each inner node by level, and the top nodes of each item.

    Nodes 0 to ``classes`` - 1 are classes of terms; inner nodes follow, parts before wholes.
    """

    class_of: np.ndarray
    classes: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # nodes, left parts, right parts
    nodes: int
    tops: list[list[int]]


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, A-Z in lower case; none for null."""
    return TERM.findall(text.encode().translate(LOWER)) if text else []


def share(item_terms: list[list[int]], n_terms: int) -> Sharing:
    """Mine the parts that items share; ``item_terms`` lists distinct term numbers per item."""
    holders: dict[int, list[int]] = defaultdict(list)
    for item, own in enumerate(item_terms):
        for t in own:
            holders[t].append(item)
    class_of, known = np.zeros(n_terms, np.int64), {}
    for t, held in holders.items():
        class_of[t] = known.setdefault(tuple(held), len(known))
    parts: list[list[int]] = [[] for _ in item_terms]
    for held, c in sorted(known.items(), key=lambda x: (-len(x[0]), x[1])):  # most popular first
        for item in held:
            parts[item].append(c)
    nodes, levels = len(known), []
    while True:
        pairs = Counter(p for own in parts for p in zip(own, own[1:]))
        chosen = []
        for own in parts:
            taken, mine = set(), []
            for count, i in sorted(((-pairs[p], i) for i, p in enumerate(zip(own, own[1:])) if pairs[p] > 1)):
                if i not in taken and i + 1 not in taken:
                    taken |= {i, i + 1}
                    mine.append(i)
            chosen.append(mine)
        used = Counter((own[i], own[i + 1]) for own, mine in zip(parts, chosen) for i in mine)
        made = {p: nodes + k for k, p in enumerate(p for p, c in used.items() if c > 1)}
        if not made:
            break
        for item, mine in enumerate(chosen):
            own = parts[item]
            for i in mine:
                if (own[i], own[i + 1]) in made:
                    own[i], own[i + 1] = made[own[i], own[i + 1]], -1
            parts[item] = [x for x in own if x >= 0]
        levels.append((np.array([*made.values()]), np.array([p[0] for p in made]), np.array([p[1] for p in made])))
        nodes += len(made)
    return Sharing(class_of, len(known), levels, nodes, parts)


def _blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Item ids and their distinct terms, block by block, in any order of items."""
    ids, own, size = [], [], 0
    for row in items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        distinct = sorted(set(terms(row.t)))
        if not distinct:
            continue
        if ids and size + len(distinct) > most:
            yield ids, own
            ids, own, size = [], [], 0
        ids.append(row.i)
        own.append(distinct)
        size += len(distinct)
    if ids:
        yield ids, own


def postings(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(id, n, term, tf): per document its number of terms and, as two arrays, how often it holds which term of the vocabulary."""
    kind = docs.select(F.col(f"`{doc_id}`").alias("id")).schema["id"].dataType
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most a block's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            n, found, often = [], [], []
            for t in b["text"].to_pylist():
                all_terms = terms(t)
                held = Counter(k for w in all_terms if (k := known.get(w)) is not None)
                n.append(len(all_terms))
                found.append(list(held))
                often.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))], ["id", "n", "term", "tf"])

    out = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("term", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))])
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, out)


def _best(found: pa.Table, top: int) -> pa.Table:
    """The ``top`` rows of each item by falling score, then rising id (nulls last)."""
    found = found.sort_by([("item", "ascending"), ("score", "descending"), ("id", "ascending")])
    item = found["item"].to_numpy()
    first = np.searchsorted(item, item)
    return found.filter(pa.array(np.arange(len(item)) - first < top))


def _scored(index: DataFrame, shared: Sharing, weights: np.ndarray, n_docs: int, n_terms: int, settings: Settings) -> DataFrame:
    """(item, id, score): the best documents of each partition for each item, whose number in the block is ``item``."""
    kind = index.schema["id"].dataType
    flat = np.array([x for own in shared.tops for x in own])
    starts = np.cumsum([0, *map(len, shared.tops[:-1])])
    wide = max(1, settings.cells // (shared.nodes + len(flat) + len(starts)))
    sent = index.sparkSession.sparkContext.broadcast((shared, weights, flat, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dag, w, tops, begin = sent.value
        best = None
        for batch in batches:
            for at in range(0, batch.num_rows, wide):
                b = batch.slice(at, wide)
                width = b.num_rows
                term, tf = b["term"].flatten().to_numpy(), b["tf"].flatten().to_numpy()
                doc = np.repeat(np.arange(width), np.diff(b["term"].offsets.to_numpy()))
                m = 10 + 90 * b["n"].to_numpy() * n_docs // n_terms
                gain = w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                acc = np.zeros((dag.nodes, width), np.int64)
                np.add.at(acc, (dag.class_of[term], doc), gain)
                for nodes, left, right in dag.levels:
                    acc[nodes] = acc[left] + acc[right]
                scores = np.add.reduceat(acc[tops], begin, axis=0)
                k = min(settings.top, width)
                least = np.maximum(np.partition(scores, width - k, axis=1)[:, width - k], 1)
                item, col = np.nonzero(scores >= least[:, None])
                found = pa.table({"item": pa.array(item, pa.int32()), "id": b["id"].take(pa.array(col)), "score": pa.array(scores[item, col])})
                best = _best(found if best is None else pa.concat_tables([best, found]), settings.top)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    out = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.LongType())])
    return index.mapInArrow(run, out)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents with a score above 0 for each row of ``items``.

    A term is a run of digits, letters and characters beyond ASCII, A-Z in
    lower case. Its weight is floor(1000 ln((2N+2)/(2df+1))), a document's
    length factor m is 10 + 90 n N div L, and a term adds
    weight * (10^9 tf div (1000 tf + 8 m)), all in 64-bit integers.

    Null and empty texts have no terms: such documents are never ranked and such
    items have no rows. Texts of any length are taken whole; a task holds the
    postings of an Arrow batch. Equal scores go by rising document id, null ids
    last; repeated document rows are ranked as often as they stand, repeated
    items are answered as often. Other columns are ignored. Empty tables give no rows.
    """
    spark = docs.sparkSession
    id_kind = items.select(F.col(f"`{item_id}`").alias("i")).schema["i"].dataType
    doc_kind = docs.select(F.col(f"`{doc_id}`").alias("i")).schema["i"].dataType
    result = None
    for ids, own in _blocks(items, item_id, item_text, settings.block_terms):
        vocabulary = {t: k for k, t in enumerate(sorted({t for x in own for t in x}))}
        index = stored(postings(docs, vocabulary, doc_id, text))
        n_docs, n_terms = index.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in index.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row per term of the block at most
            weights[term] = floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))
        shared = share([[vocabulary[t] for t in x] for x in own], len(vocabulary))
        found = stored(_scored(index.filter("size(term) > 0"), shared, weights, n_docs, n_terms, settings))
        drop_stored(index)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_kind)]))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.top).join(F.broadcast(names), "item")  # a row per item of the block
        block = ranked.select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        result = block if result is None else result.unionByName(block)
    if result is None:
        empty = T.StructType([T.StructField("item_id", id_kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", doc_kind), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], empty)
    return result
