"""BM25 retrieval over an inverted index that is three DataFrames."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..session import stored

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Up to so many query term rows are broadcast; more are joined by shuffle.
MAX_BROADCAST_TERMS = 500_000
#: Scores of documents and queries that a task holds at once.
BLOCK_SCORES = 1 << 18
#: Words of documents that a task looks up at once, and distinct words whose documents it counts before it hands them on.
MAX_WORDS = 1 << 20


@dataclass(frozen=True)
class Index:
    """postings (term, id, tf, dl), terms (term, df, raw) and corpus (n, avgdl, avg_raw).

    ``words`` (term, id, dl), a row per word, and ``texts`` (id, text), lower-cased, stand behind
    the postings of an index that is not written: a search then cuts each text
    once, keeps the words of its queries alone, and scores a document where it stands.
    """

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    words: DataFrame | None = None
    texts: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        """An index that ``write_index`` stored; its buckets are known to the planner, so a join on the term moves no postings."""
        corpus = spark.read.parquet(f"{path}/corpus")
        buckets = corpus.first()["buckets"]
        return cls(_bucketed(spark, f"{path}/postings", POSTINGS, buckets), _bucketed(spark, f"{path}/terms", TERMS, buckets), corpus.drop("buckets"))


POSTINGS = "term STRING, id {id}, dl INT, tf BIGINT"
TERMS = "term STRING, df BIGINT, raw DOUBLE"
SURVEY = "id {id}, dl INT, code ARRAY<INT>, tf ARRAY<INT>, term STRING, df BIGINT"


def _bucketed(spark: SparkSession, path: str, columns: str, buckets: int) -> DataFrame:
    """The files at ``path`` as a table of the session's catalog that is bucketed by term."""
    name = "newsloom_" + hashlib.sha256(path.encode()).hexdigest()[:24]
    if "{id}" in columns:
        columns = columns.format(id=spark.read.parquet(path).schema["id"].dataType.simpleString())
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # of the catalog alone: the files are not the table's own
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (term) SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def _write_bucketed(df: DataFrame, path: str, buckets: int) -> None:
    name = f"newsloom_{uuid.uuid4().hex}"
    # dealt as the buckets are, so that each is one file
    df.repartition(buckets, "term").write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").format("parquet").option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def write_index(docs: DataFrame, doc_id: str, text: str, path: str, buckets: int = 64) -> Index:
    """Store the index of every document in ``buckets`` files by term and return it.

    Texts are cut into words once; what is known per term and of the corpus follows from the stored postings, where a term stands in one bucket.
    """
    spark = docs.sparkSession
    tokenized = docs.select(F.col(doc_id).alias("id"), fx.tokens(F.col(text)).alias("ws"))
    if _repeats(tokenized):
        counted = _counted(tokenized.select("id", F.size("ws").alias("dl"), F.explode("ws").alias("term")))
    else:  # a document counts its own words, so postings move once
        counted = tokenized.mapInArrow(_own_postings, POSTINGS.format(id=dict(tokenized.dtypes)["id"]))
    _write_bucketed(counted.select("term", "id", "dl", "tf"), f"{path}/postings", buckets)
    postings = _bucketed(spark, f"{path}/postings", POSTINGS, buckets)
    n = docs.count()
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    _write_bucketed(df.select("term", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")), f"{path}/terms", buckets)
    total, raw = postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0], _bucketed(spark, f"{path}/terms", TERMS, buckets).agg(F.avg("raw")).first()[0]
    corpus = spark.createDataFrame([(n, total / n if n else None, raw, buckets)], "n long, avgdl double, avg_raw double, buckets int")
    corpus.write.mode("overwrite").parquet(f"{path}/corpus")
    return Index.read(spark, path)


def build_index(docs: DataFrame, doc_id: str, text: str) -> Index:
    """Index of every document; documents without words count in n and avgdl with length 0."""
    tokenized = docs.select(F.col(doc_id).alias("id"), fx.tokens(F.col(text)).alias("ws"))
    words = tokenized.select("id", F.size("ws").alias("dl"), F.explode("ws").alias("term"))
    counted = _document_counts(tokenized)
    sizes = counted.filter("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.try_divide(F.sum("dl"), F.sum("df")).alias("avgdl"))
    df = counted.filter("term IS NOT NULL").select("term", "df")
    terms = df.join(F.broadcast(sizes.select("n"))).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    corpus = sizes.join(F.broadcast(terms.agg(F.avg("raw").alias("avg_raw"))))
    return Index(_counted(words), terms, corpus, words, docs.select(F.col(doc_id).alias("id"), fx.lowered(F.col(text)).alias("text")))


def _document_counts(texts: DataFrame) -> DataFrame:
    """(term, df, dl): each document names its distinct words, and itself under no word, so one aggregation counts documents per term and the corpus."""
    named = texts.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("ws"))).alias("term"), F.size("ws").alias("dl"))
    return named.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("dl"))


def _counted(words: DataFrame) -> DataFrame:
    return words.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def _own_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = pc.unique(batch.column("ws").flatten().cast(pa.string()))
        doc, term, tf, dl = _tallies(batch, names)
        for low in range(0, len(doc), 1 << 16):
            d, w = doc[low : low + (1 << 16)], term[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(w)), batch.column("id").take(pa.array(d)), pa.array(dl[d].astype(np.int32)), pa.array(tf[low : low + (1 << 16)])], ["term", "id", "dl", "tf"])


def _repeats(docs: DataFrame) -> bool:
    """Whether two rows share an id."""
    return docs.groupBy("id").count().filter("count > 1").limit(1).count() > 0


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, term, qtf): repeated words of a query count as often as they stand."""
    ws = queries.select(F.col(query_id).alias("query_id"), F.explode(fx.tokens(F.col(text))).alias("term"))
    return ws.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def scores(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, id, score): only documents that share a word with the query are touched."""
    small = terms.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS
    asked = terms.join(index.terms, "term").join(F.broadcast(index.corpus))
    idf = F.when(F.col("raw") >= 0, F.col("raw")).otherwise(EPSILON * F.col("avg_raw"))
    asked = asked.select("query_id", "term", "qtf", idf.alias("idf"), "avgdl")
    postings = index.postings
    if index.words is not None:  # words that no query has go before they are counted
        wanted = terms.select("term").distinct()
        postings = _counted(index.words.join(F.broadcast(wanted) if small else wanted, "term", "left_semi"))
    hits = postings.join(F.broadcast(asked) if small else asked, "term")
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / norm
    return hits.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, positive: bool = False, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Ranks by rounded score, ties by id; positive drops scores <= 0 after the cut."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 6)), F.asc("id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.filter("score > 0") if positive else ranked


def search(index: Index, queries: DataFrame, query_id: str, text: str, k: int) -> DataFrame:
    """(query_id, id, score, rank).

    No pair is shuffled beyond the k best of each query in a task: a written
    index moves the postings of its query terms to their documents, another one
    has them there, unless two documents share an id.
    """
    terms = query_terms(queries, query_id, text)
    if index.texts is not None and _repeats(index.texts):
        return top_k(scores(index, terms), k, positive=True)
    return top_k(_in_blocks(index, terms, k), k, positive=True)


def search_with_holders(index: Index, queries: DataFrame, query_id: str, text: str, k: int, keys: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """``search``, and (query_id, id) of the documents with the rarest of ``keys(words)`` of a query's text, from the same pass over the documents.

    Each row of ``queries`` has its own rarest key, also where rows share a query_id; a row without keys has no holders.
    """
    terms = query_terms(queries, query_id, text)
    keyed = queries.select(F.col(query_id).alias("query_id"), keys(fx.tokens(F.col(text))).alias("keys")).filter("size(keys) > 0")
    found = stored(_in_blocks(index, terms, k, keyed))
    apart = index.texts is not None and _repeats(index.texts)
    scored = scores(index, terms) if apart else found.filter("score IS NOT NULL")
    return top_k(scored, k, positive=True), found.filter("score IS NULL").select("query_id", "id")


def _in_blocks(index: Index, terms: DataFrame, k: int, keyed: DataFrame | None = None) -> DataFrame:
    """``_best_in_tasks`` for MAX_BROADCAST_TERMS terms at a time."""
    blocks = max(1, -(-terms.count() // max(1, MAX_BROADCAST_TERMS)))
    found = None
    for i in range(blocks):
        part = lambda df: df if blocks == 1 or df is None else df.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)  # noqa: B023, E731
        own = _best_in_tasks(index, part(terms), k, part(keyed))
        found = own if found is None else found.unionByName(own)
    return found


def _best_in_tasks(index: Index, terms: DataFrame, k: int, keyed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): the k best documents of every query in each task, ties included.

    ``terms`` are sent to the documents: MAX_BROADCAST_TERMS on average. One
    pass cuts the texts into words (``_survey``) and stores what the search
    needs of them. One aggregation of it counts the documents of all terms; of
    that the driver gets the counts of the query terms, and how many terms have
    each count. With ``keyed`` (query_id, keys) the documents that hold the
    rarest key of a row follow, with score null.
    """
    spark = terms.sparkSession
    asked = terms.select("query_id", "term", "qtf").collect()
    names = pa.array(sorted({r.term for r in asked}), pa.string())
    at = {term: i for i, term in enumerate(names.to_pylist())}
    shared = spark.sparkContext.broadcast(names)

    if index.texts is not None:
        surveyed = stored(index.texts.mapInArrow(lambda batches: _survey(batches, shared.value), SURVEY.format(id=dict(index.texts.dtypes)["id"])))
        documents = surveyed.filter("term IS NULL").select("id", "dl", "code", "tf")
        marked = surveyed.groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).join(F.broadcast(terms.select("term", F.lit(True).alias("asked")).distinct()), "term", "left")
        tally = marked.groupBy(F.col("term").isNull().alias("whole"), F.when(F.col("asked"), F.col("term")).alias("term"), "df").agg(F.count("*").alias("c"), F.sum("dl").alias("dl")).collect()
        n, avgdl = next(((r.df, r.dl / r.df) for r in tally if r.whole), (0, None))
        counted = {at[r.term]: r.df for r in tally if r.term is not None}
        of_df = np.array([(r.df, r.c) for r in tally if not r.whole], np.float64).reshape(-1, 2).T
    else:
        wanted = F.broadcast(terms.select("term").distinct())
        held = index.postings.join(wanted, "term", "left_semi")
        documents = held.groupBy("id").agg(F.collect_list(F.struct("term", "tf", "dl")).alias("ps")).select("id", "ps.term", "ps.tf", "ps.dl")
        corpus = index.corpus.first()
        n, avgdl = corpus["n"], corpus["avgdl"]
        counted = {at[r.term]: r.df for r in index.terms.join(wanted, "term", "left_semi").select("term", "df").collect()}
    schema = f"query_id {dict(terms.dtypes)['query_id']}, id {dict(documents.dtypes)['id']}, score double"
    if not counted:
        return spark.createDataFrame([], schema)
    df = np.array([counted.get(i, 0) for i in range(len(names))], np.float64)
    raw = np.log(n - df + 0.5) - np.log(df + 0.5)
    avg_raw = corpus["avg_raw"] if index.texts is None else np.average(np.log(n - of_df[0] + 0.5) - np.log(of_df[0] + 0.5), weights=of_df[1])
    idf = np.where(raw >= 0, raw, EPSILON * avg_raw)
    # the queries of each term, and the weight it has in them
    query_names = list(dict.fromkeys(r.query_id for r in asked))
    place = {name: i for i, name in enumerate(query_names)}
    of, code = np.array([place[r.query_id] for r in asked]), np.array([at[r.term] for r in asked])
    order = np.argsort(code, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(names)))])
    held = [] if keyed is None else [(min((counted.get(at[w], 0), w) for w in r["keys"]), r.query_id) for r in keyed.collect()]
    held = sorted({(at[w], place[name]) for (c, w), name in held if c})
    key_code, key_of = np.array(held, np.int64).reshape(-1, 2).T
    key_starts = np.searchsorted(key_code, np.arange(len(names) + 1))
    sent = spark.sparkContext.broadcast((starts, of[order], (np.array([r.qtf for r in asked], np.float64) * idf[code])[order], query_names, avgdl, key_starts, key_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, query, weight, query_names, avgdl, key_starts, key_of = sent.value
        width = len(query_names)
        best = np.full((k, width), -np.inf)  # the k best scores of each query so far
        query_ids = None

        def rows(j, i, score):
            nonlocal query_ids
            query_ids = pa.array(query_names) if query_ids is None else query_ids
            return pa.RecordBatch.from_arrays([query_ids.take(pa.array(j)), batch.column("id").take(pa.array(i)), score], ["query_id", "id", "score"])

        for batch in _parts(batches, "tf"):
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("tf")).to_numpy(zero_copy_only=False))
            tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False)
            if "code" in batch.schema.names:
                term, dl = batch.column("code").flatten().to_numpy(zero_copy_only=False), batch.column("dl").to_numpy(zero_copy_only=False)[doc]
            else:
                term = pc.index_in(batch.column("term").flatten().cast(pa.string()), value_set=shared.value).to_numpy(zero_copy_only=False)
                dl = batch.column("dl").flatten().to_numpy(zero_copy_only=False)
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            step = max(1, BLOCK_SCORES // width)
            for low in range(0, batch.num_rows, step):
                high = min(low + step, batch.num_rows)
                own = slice(*np.searchsorted(doc, [low, high]))
                posting, entry = _entries(key_starts, term, own)
                if len(posting):
                    yield rows(key_of[entry], doc[posting], pa.nulls(len(posting), pa.float64()))
                posting, entry = _entries(starts, term, own)
                if not len(posting):
                    continue
                cell = (doc[posting] - low) * width + query[entry]
                score = np.bincount(cell, part[posting] * weight[entry], minlength=(high - low) * width).reshape(-1, width)
                shown = np.full(score.size, -np.inf)
                shown[cell] = np.round(score.ravel()[cell], 6)
                shown = shown.reshape(-1, width)
                best = -np.partition(-np.concatenate([best, shown]), k - 1, axis=0)[:k]
                i, j = np.nonzero((shown >= best.min(0) - 2e-6) & (shown > -np.inf))  # ties are decided later, by the exact rounding and the id
                if len(i):
                    yield rows(j, i + low, pa.array(score[i, j]))

    return documents.mapInArrow(run, schema)


def _entries(starts: np.ndarray, term: np.ndarray, own: slice) -> tuple[np.ndarray, np.ndarray]:
    """(posting, entry) for every entry from ``starts[t]`` to ``starts[t + 1]`` of the terms t of the postings in ``own``."""
    times = starts[term[own] + 1] - starts[term[own]]
    posting = np.repeat(np.arange(own.start, own.stop), times)
    return posting, np.arange(len(posting)) - np.repeat(np.cumsum(times) - times, times) + starts[term[posting]]


def _survey(batches: Iterator[pa.RecordBatch], names: pa.Array) -> Iterator[pa.RecordBatch]:
    """The columns of ``SURVEY`` from (id, text): a row per document, with its words among ``names`` by place, and rows (term, df) that sum up to the documents of each word.

    A document's row has term null and df 1, so one aggregation by term counts them too.
    """
    columns = ["id", "dl", "code", "tf", "term", "df"]
    gathered, rows, ids = [], 0, None

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in table.to_batches(1 << 16):
            none = [pa.nulls(b.num_rows, t) for t in (ids, pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*none, b.column("term"), b.column("df")], columns)

    for batch in _parts(map(_cut, batches)):
        ids, ws = batch.column("id").type, batch.column("ws")
        words = ws.flatten().dictionary_encode()
        known, width, at = words.dictionary, max(len(words.dictionary), 1), words.indices.to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(ws)), pc.list_value_length(ws).to_numpy(zero_copy_only=False))
        full = pc.not_equal(known, "").to_numpy(zero_copy_only=False)[at]  # blanks at an end of a text leave an empty word
        of, at = of[full], at[full]
        dl = np.bincount(of, minlength=len(ws))
        key, tf = np.unique(of * width + at, return_counts=True)
        doc, word = key // width, key % width
        code = pc.index_in(known, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)[word]
        own = np.flatnonzero(code >= 0)
        own = own[np.lexsort((code[own], doc[own]))]
        ends = pa.array(np.searchsorted(doc[own], np.arange(len(dl) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[own].astype(np.int32))) for x in (code, tf)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(dl.astype(np.int32)), *lists, pa.nulls(len(dl), pa.string()), pa.array(np.ones(len(dl), np.int64))], columns)
        df = np.bincount(word, minlength=len(known))
        gathered.append(pa.table({"term": known, "df": df}).filter(pa.array(df > 0)))
        rows += len(known)
        if rows > 2 * MAX_WORDS:
            merged = _summed(gathered)
            gathered, rows = [merged], len(merged)
            if rows > MAX_WORDS:
                yield from counted(merged)
                gathered, rows = [], 0
    if gathered:
        yield from counted(_summed(gathered))


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(id, ws) from (id, text): the words of ``fx.tokens``, which parts texts at the same six blanks; besides them, empty words at the ends."""
    return pa.RecordBatch.from_arrays([batch.column("id"), pc.ascii_split_whitespace(batch.column("text").cast(pa.string()))], ["id", "ws"])


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("term", use_threads=False).aggregate([("df", "sum")]).rename_columns(["term", "df"]).combine_chunks()


def _parts(batches: Iterator[pa.RecordBatch], lists: str = "ws") -> Iterator[pa.RecordBatch]:
    """The documents of the batches, so many at a time that the entries of their ``lists`` are about MAX_WORDS; never less than one."""
    for batch in batches:
        words = pc.list_value_length(batch.column(lists)).to_numpy(zero_copy_only=False)
        part = np.cumsum(words) // MAX_WORDS
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for low, high in zip(bounds, bounds[1:]):
            yield batch.slice(low, high - low)


def _tallies(batch: pa.RecordBatch, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, term, tf) by place in the batch and in ``names``, in the order of documents; and dl of every document."""
    ws = batch.column("ws")
    dl = pc.list_value_length(ws).to_numpy(zero_copy_only=False).astype(np.int64)
    code = pc.index_in(ws.flatten().cast(pa.string()), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    key, tf = np.unique((np.repeat(np.arange(len(dl)), dl) * max(len(names), 1) + code)[code >= 0], return_counts=True)
    return key // max(len(names), 1), key % max(len(names), 1), tf, dl
